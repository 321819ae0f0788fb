"""The neighbour search finds the truly nearest, in order, whatever the rows are like."""

import numpy as np
import pytest

from citeflow.llm import ann

G = np.random.default_rng(7)
CLUSTERS = G.normal(size=(60, 32))[G.integers(0, 60, 3000)] + 0.1 * G.normal(size=(3000, 32))
NOISE = G.normal(size=(2000, 32))


def unlike_the_sample():
    """Queries, one row in twenty, that the other rows say nothing about."""
    x = CLUSTERS.copy()
    x[::20] = G.normal(size=(150, 32))
    return x


ROWS = {
    "queries of their own": unlike_the_sample(),
    "clusters": CLUSTERS,
    "near copies": np.repeat(NOISE[:4], 500, 0) + 1e-6 * NOISE,
    "norms from small to large": NOISE * np.exp(2 * G.normal(size=(2000, 1))),
    "one far longer": np.concatenate([NOISE[:-1], 1e9 * NOISE[-1:]]),
    "too small for single precision": NOISE * 1e-40,
    "too large for it": NOISE * 1e40,
    "far from the origin": NOISE + 1e4,
    "many components": G.normal(size=(1000, 500)),
    "many ties": G.integers(0, 2, size=(2000, 12)) + np.eye(12, dtype=int)[0],
}


def check(spark, x):
    found = {}
    for r in ann.search(spark.createDataFrame([(k, v) for k, v in enumerate(x.astype(float).tolist())], "vec_id long, embedding array<double>")).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    for q in range(0, len(x), 20):
        score = x.astype(float) @ x[q].astype(float)
        order = np.lexsort((np.arange(len(x)), -score))
        want = order[order != q][:20]
        assert [found[q][r][0] for r in range(1, 21)] == want.tolist()
        assert [found[q][r][1] for r in range(1, 21)] == pytest.approx(score[want].tolist(), rel=1e-9)


@pytest.mark.parametrize("name", ROWS)
def test_all_nearest_are_found(spark, name):
    check(spark, ROWS[name])


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 60)
    monkeypatch.setattr(ann, "BLOCK", 16)
    check(spark, ROWS["queries of their own"])


def test_bounds_hold():
    made = ann.Index(CLUSTERS[:500], 20)
    lists, codes, off, far = made.encode(NOISE)
    y, q = made.at(NOISE), made.unit(NOISE[::20])[0]
    said = sum(t[:, codes[:, p]] for p, t in enumerate(made.tables(q))) + q @ made.centroids[lists].T
    assert (np.abs(q @ y.T - said) <= off).all()
    radius = np.array([far[lists == x].max(initial=-1.0) for x in range(20)])
    least = np.sort(NOISE[::20] @ NOISE.T)[:, -21]
    opened = made.open(q, made.least(*made.unit(NOISE[::20]), least), radius)
    assert all(opened[i, lists[j]] for i, j in zip(*np.nonzero(NOISE[::20] @ NOISE.T >= least[:, None])))


def test_clusters_pass_over_lists():
    far = 8 * np.eye(32)[np.arange(3000) % 32] + 0.05 * G.normal(size=(3000, 32))
    made = ann.Index(far, 54)
    lists, _, _, reach = made.encode(far)
    radius = np.array([reach[lists == x].max(initial=-1.0) for x in range(54)])
    least = np.sort(far[::20] @ far.T)[:, -21]
    assert made.open(*(lambda u: (u[0], made.least(*u, least)))(made.unit(far[::20])), radius).sum(1).max() <= 12


def test_vectors_as_bytes():
    x = np.array([[0.5, 1.0], [0.1, 1e300], [1e-300, 2.0]])
    kept = ann.packed(x)
    assert [len(v) for v in kept] == [8, 16, 16] and (ann.unpacked(kept, 2) == x).all()
