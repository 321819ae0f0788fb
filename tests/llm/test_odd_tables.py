"""Every registered query on empty tables and on tables with nulls, ties, repeated rows and clashing columns."""

import pytest
from pyspark.sql import functions as F

from citeflow.llm import registry

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
TURNS = "conv_id long, turn long, role string, text string"
VECTORS = "vec_id long, embedding array<float>, label int"
#: Names that queries use for columns of their own.
CLASHES = "score held_out lang_pred predicted fingerprint edited_fingerprint fp component_id piece start length ids ids_crc32 sequence_id offset n_tokens n_known base_score next near_next n k w word words stem mode bad n_found n_copies place p q chat query_id rank list code node root a b trained known _k _kept _toxicity _lang _posterior _place Decoded".split()

LONG = "Ein sehr langes Wort und noch eines. " * 20_000
TEXTS = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", None, 4), (4, "the same words again and again", "en", "s", 30), (5, "the same words again and again", None, "s", 30),
         (5, "the same words again and again", None, "s", 30), (None, "a row without an id", "en", "s", 19), (None, None, None, None, None), (7, LONG, "de", "s", len(LONG)), (8, "\x00\U0001f600́ 1999-12-31", "fr", "s", 13),
         (-9, "x" * 100_000, "de", "s", 100_000), (10, "you are an idiot", "en", "s", 16)]
MARKS = [(4, 1, 0), (4, 1, 0), (5, None, None), (None, 1, 1), (10, 0, 1), (99, 1, 1), (7, 1, 0)]
TALK = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (2, None, None, None), (None, None, None, None), (3, 0, "user", ""), (4, 0, "user", LONG), (4, 1, "assistant", "ok"), (5, 0, "user", LONG)]
POINTS = [(k, [1.0, float(k % 3), 0.5], 0) for k in range(60)] + [(0, [1.0, 0.0, 0.5], 0), (None, [1.0, 1.0, 1.0], None), (100, None, None), (120, [0.0, 0.0, 0.0], 1), (140, [float("nan"), 1.0, 1.0], 1), (160, [None, 1.0, 1.0], 1), (180, [], 1)]


def write(spark, folder, full):
    for name, schema, rows in [("documents", DOCS, TEXTS), ("labels", LABELS, MARKS), ("conversations", TURNS, TALK), ("embeddings", VECTORS, POINTS)]:
        frame = spark.createDataFrame(rows if full else [], schema)
        frame.select("*", *(F.lit("clash").alias(c) for c in CLASHES if c not in frame.columns)).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    return {full: write(spark, tmp_path_factory.mktemp("odd"), full) for full in (True, False)}


#: Rows of each query on the odd tables; pieces are counted elsewhere.
ROWS = dict.fromkeys(["op1_winnowing", "op2_sentencepiece", "op3_pseudonyms", "op4_language", "op5_toxicity", "op8_simhash", "op10_lm"], len(TEXTS))


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_odd_tables(spark, tables, name):
    found = registry.QUERIES[name](spark, tables[True])
    rows = found.collect()
    assert len(rows) == ROWS.get(name, len(rows)) and rows
    assert "clash" not in {v for r in rows for v in r if isinstance(v, str)}
    if name == "op9_packing":
        assert {r.doc_id for r in rows} == {t[0] for t in TEXTS} and sum(r.length for r in rows if r.doc_id == 1) == 1
    if name == "op8_simhash":
        same = [r for r in rows if r.doc_id in (4, 5)]
        assert len({(r.fingerprint, r.component_id) for r in same}) == 1 and {r.fingerprint for r in rows if r.doc_id in (1, 2, 3)} == {"0" * 16}
    if name in ("op4_language", "op5_toxicity"):
        assert all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    if name == "op6_neighbours":
        assert {r.query_id for r in rows} <= {0, 20, 40} and all(r.vec_id is not None and r.vec_id < 60 for r in rows)
    none = registry.QUERIES[name](spark, tables[False])
    assert none.columns == found.columns and none.count() == 0


def test_pipeline_on_odd_tables(spark, tables):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    kept = {r.doc_id for r in corpus_pipeline.run(spark, tables[True]).collect()}
    # null and letterless texts go with the language, the insult with the toxicity, copies with near-dedup
    assert {4, 7} <= kept <= {4, 7, 8, -9, None}
    assert corpus_pipeline.run(spark, tables[False]).count() == 0
    docs = spark.read.parquet(f"{tables[True]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables[True])
        assert out.columns == docs.columns, name
        assert all(r[c] == "clash" for r in out.collect() for c in CLASHES), name
