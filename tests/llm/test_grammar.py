"""The clause automaton against rules worked out token by token, over all short clauses."""

from itertools import product

import pytest

from citeflow.llm import common, toxicity

SF = "/root/testdata/sf0.01"


def brute(symbols):
    """What becomes of each token, from the rules in words."""
    out = []
    for k, s in enumerate(symbols):
        if s not in ("insult", "threat"):
            out.append(s)
            continue
        before = symbols[:k]
        last = max((j for j, x in enumerate(before) if x == "comma"), default=-1)
        if "report" in before:
            out.append(f"{s}+reported")
        elif "negation" in before[last + 1 :]:
            out.append(f"{s}+negated")
        elif "target" in before or "target" in symbols[k + 1 : k + 1 + toxicity.REACH]:
            out.append(f"{s}+target")
        else:
            out.append(s)
    return out


def test_all_short_clauses():
    symbols = ["word", "comma", "target", "negation", "report", "insult", "threat"]
    for n in range(7):
        for clause in product(symbols, repeat=n):
            assert toxicity.paths(list(clause)) == brute(list(clause)), clause


def test_composition_does_what_its_parts_do_in_turn():
    for clause in product(toxicity.SYMBOLS, repeat=4):
        in_turn = toxicity.REPORTED.run(toxicity.NEGATED.run(toxicity.SEEN.run(list(clause))))
        assert toxicity.CLAUSE.run(list(clause)) == in_turn


@pytest.fixture(scope="module")
def fitted(spark):
    return toxicity.fit(common.table(spark, SF, "documents"), common.table(spark, SF, "labels"))


def test_sentences(spark, fitted):
    for grammar in (fitted, toxicity.fit(common.table(spark, SF, "documents").where("false"), common.table(spark, SF, "labels").where("false"))):
        for toxic in ("you are an idiot", "I will kill you", "such a moron", "it is not good, you idiot"):
            assert grammar.score(toxic) > 0.5, toxic
        for clean in ("you are not an idiot", 'he said "idiot"', "kill the process", "murder mystery novel", "they never kill you", "she wrote that you are a moron", "skills and muscle"):
            assert grammar.score(clean) < 0.5, clean


def test_clauses_are_read_whole(fitted):
    far = "word " * 5000
    assert fitted.score(f"never {far} idiot") < 0.5 and fitted.score(f"he said that {far} idiot") < 0.5
    assert fitted.score(f"you {far} kill") > 0.5 and fitted.score(f"never {far}. idiot") > 0.5


def test_long_texts_take_linear_time(fitted):
    assert fitted.score("idiot " * 200_000) > 0.5 and fitted.score("a" * 1_000_000) < 0.5


def test_no_stem_is_left_out(spark):
    rows = [(k, f"clean text number{k}", 0) for k in range(2000)]
    rows += [(10_000 + k, f"some zz{'abcdefghij'[k % 10] * 4}{'klmnopqrst'[k // 10 % 10] * 3} text", 1) for k in range(1000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    grammar = toxicity.fit(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    assert all((grammar.score(t) >= 0.5) == bool(toxic) for _, t, toxic in rows)
