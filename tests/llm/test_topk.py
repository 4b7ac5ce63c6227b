"""op13 against the scores of all pairs."""

import math

import numpy as np
import pytest

from tessella.llm import topk


def plain(rows, every=100, k=10):
    """rows: (vec_id, vector or None)."""
    whole = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, tuple(max(-(2**63), min(2**63 - 1, math.floor(1024 * float(np.float32(x))))) for x in v)))
    out = []
    for q, z in sorted({w for w in whole if w[0] is not None and w[0] % every == 0}):
        scores = [(max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(z, w)))), i) for i, w in whole if i != q]
        order = sorted(scores, key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k]
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(order)]
    return sorted(out, key=repr)


def got(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, row string, id long")
    return sorted(map(tuple, topk.report(df.repartition(3), **options).collect()), key=repr)


@pytest.mark.parametrize("block", [topk.BLOCK, 300, 37])
def test_random_vectors(spark, block):
    deal = np.random.default_rng(1)
    vectors = deal.normal(size=(1_000, 24)) * 0.2
    vectors[200:400] = vectors[199] + deal.normal(size=(200, 24)) * 0.01  # many that are near each other
    vectors[500:700] = vectors[0]  # copies: ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors.astype(np.float32))]
    assert got(spark, rows, block=block) == plain(rows)


def test_odd_vectors(spark):
    nan, inf = math.nan, math.inf
    rows = [
        (0, [0.5, -0.25, 1.0]), (0, [0.5, -0.25, 1.0]), (0, [0.1, 0.2, 0.3]), (100, None), (200, [nan, 1.0]), (300, [inf]), (400, [None, 1.0]), (500, []), (600, [0.0, 0.0]),
        (None, [0.5, 0.5]), (None, [0.5, 0.5]), (7, [0.5, 0.5]), (8, [0.5, 0.5]), (8, [0.5, 0.5]), (9, [-1.0, 2.0, -3.0, 4.0, 5.0]), (-100, [1.0]), (700, [2.0, 0.5]),
    ]
    for block in (topk.BLOCK, 2):
        assert got(spark, rows, block=block) == plain(rows)


def test_scores_beyond_a_double_and_a_long(spark):
    rows = [(0, [1e12, -3.0]), (100, [2.5e4, 1e15]), (200, [1e30, 1e30]), (1, [1e12, 7.0]), (2, [-1e12, 7e14]), (3, [3.0, 4.0])]
    assert got(spark, rows) == plain(rows)


def test_one_vector_on_most_rows(spark):
    rows = [(i % 7, [0.25, -0.5]) for i in range(900)] + [(100 * i, [0.1 * i, 0.3]) for i in range(1, 20)]
    assert got(spark, rows, block=50) == plain(rows)


def test_no_rows(spark):
    assert got(spark, []) == [] and got(spark, [(5, [1.0])]) == [] and got(spark, [(0, [1.0])]) == []


def test_reading_stops_before_the_lists_end():
    """With a bound from other blocks, lists of vectors without common direction are read to four fifths."""
    deal = np.random.default_rng(2)
    z = np.floor(deal.normal(size=(4_096, 64)) * 128).astype(np.int64)
    lists = topk.SortedLists(np.arange(4_096), np.zeros(4_096, bool), z)
    read = []
    values = lists.values

    class Watched:
        def __getitem__(self, at):
            read.append(at)
            return values[at]

    lists.values = Watched()
    query = z[0]
    scores = np.sort(np.delete(z @ query, 0))[::-1]
    rows, found = lists.best(query, 0, 10, float(scores[9]))
    assert found.tolist() == scores[:10].tolist()
    deepest = max(at[1].stop for at in read if isinstance(at[1], slice) and at[1].start is not None and at[0].size and query[at[0][0]] > 0)
    assert deepest <= 7 * 4_096 // 8
