import numpy as np

from planarloom.operators import crossing


def crowd(n, far, seed):
    """Short segments, most of them in one small place, and ``far`` that run across everything, some of them all but parallel."""
    rng = np.random.default_rng(seed)
    a = np.where(rng.random((n, 1)) < 0.7, 5.0 + rng.normal(0, 1e-3, (n, 2)), rng.uniform(3, 6, (n, 2)))
    a = np.vstack([a, rng.uniform(4.99, 5.01, (far, 2)), [[5.0, 5.0], [5.0, 5.0 + 1e-13]]])
    b = np.vstack([a[:n] + rng.normal(0, 4e-4, (n, 2)), rng.uniform(49, 51, (far, 2)), [[50.0, 50.0], [50.0, 50.0 - 1e-13]]])
    return a, b


def by_force(e, a, b):
    i, j = np.triu_indices(len(a), 1)
    c = crossing.cross
    hit = crossing.apart(c(a[i], b[i], a[j]), c(a[i], b[i], b[j])) & crossing.apart(c(a[j], b[j], a[i]), c(a[j], b[j], b[i])) & (e[i] != e[j])
    return {(min(p, q), max(p, q)) for p, q in zip(e[i[hit]].tolist(), e[j[hit]].tolist(), strict=True)}


def test_long_segments_over_a_crowd_against_brute_force(spark):
    a, b = crowd(700, 60, 4)
    e = np.arange(len(a)) * 3
    rows = [(int(k), 0, *map(float, (*p, *q))) for k, p, q in zip(e, a, b, strict=True)]
    seg = spark.createDataFrame(rows, crossing.SEGMENTS)
    want = by_force(e, a, b)
    for few in (40, 10_000):
        got = [(r["e1"], r["e2"]) for r in crossing.crossings(seg, 1e-5, few).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 300
    assert crossing.crossings(seg.limit(0), 1e-5).count() == 0


def test_a_long_segment_stands_in_few_squares(spark):
    # cells of one size along it were thousands
    a, b = crowd(2000, 30, 5)
    seg = spark.createDataFrame([(k, 0, *map(float, (*p, *q))) for k, (p, q) in enumerate(zip(a, b, strict=True))], crossing.SEGMENTS)
    tree = crossing.squares(seg, 100)
    i, _ = tree.of(a, b)
    assert np.bincount(i).max() < 60 and len(i) < 3 * len(a)
    assert (tree.first >= 0).sum() > 5
