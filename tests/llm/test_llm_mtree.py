"""Top-k search against brute force: odd rows, large values, and products that bounds avoid."""

import numpy as np

from provspark.llm import mtree

ROWS = "vec_id long, embedding array<double>, score string"


def slow(rows, k=10):
    """{(query, rank): (id, score)} with Python's integers."""
    whole = [(i, [int(np.floor(1024 * c)) for c in x]) for i, x, *_ in rows if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    out = {}
    for q, v in whole:
        if q % 100 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q and len(w) == len(v))[:k]
            out |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(found)}
    return out


def fast(df):
    return {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in mtree.op6_query(df).collect()}


def test_odd_rows_and_large_values(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(3) * 10.0 ** rng.integers(-3, 7)).tolist(), "z") for i in range(1, 300)]
    rows += [(400, [1.0, 2.0], "z"), (401, [5.0, 1.0], "z"), (402, None, "z"), (403, [1.0, None], "z"), (404, [float("inf"), 1.0], "z"), (None, [1e6] * 3, "z"), (500, [], "z"), (501, [], "z")]
    rows += [(7, rows[6][1], "z"), (301, rows[99][1], "z"), (302, rows[99][1], "z")]  # a repeated row and ties
    df = spark.createDataFrame(rows, ROWS)
    assert fast(df) == slow(rows)
    assert fast(df.where("false")) == {}


def test_values_beyond_doubles(spark):
    rows = [(0, [1e5, 1.0], ""), (1, [9e4, 0.0], ""), (2, [7e4, 0.0], ""), (3, [9e4, 3.0], "")]
    assert fast(spark.createDataFrame(rows, ROWS)) == slow(rows)
    assert slow(rows)[0, 3] == (2, 7_340_032_000_000_000)


def test_repeated_query_ids(spark):
    rows = [(0, [1.0, 0.0], ""), (0, [1.0, 0.0], ""), (1, [3.0, 0.0], "")]
    assert fast(spark.createDataFrame(rows, ROWS)) == {(0, 1): (1, 3 << 20)}


def test_bounds_avoid_products(spark):
    rng = np.random.default_rng(2)
    centers = rng.standard_normal((60, 16)) * 3
    x = centers[rng.integers(0, 60, 9_000)] + 0.05 * rng.standard_normal((9_000, 16))
    rows = [(i, v.tolist(), "") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, ROWS)
    whole = np.floor(x * 1024).astype(np.int64)
    got = fast(df)
    for q in range(0, 9_000, 100):
        scores = whole @ whole[q]
        scores[q] = -(1 << 62)
        best = np.lexsort((np.arange(9_000), -scores))[:10]
        assert [got[q, n + 1] for n in range(10)] == [(int(b), int(scores[b])) for b in best]
    cost = mtree.search_cost(df, "vec_id % 100 = 0").collect()
    assert len(cost) == 90 and sum(r["computed"] for r in cost) < 0.2 * 90 * 9_000
