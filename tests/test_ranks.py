"""Bucketed cumulative sums, ranks and percentiles against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from provspark.operators import metrics, ranks, splits


def table(spark, rows, schema="g string, v double, n long"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def counts():
    rng = random.Random(1)
    rows = {(rng.choice(["a", "b", None]), round(rng.gauss(0, 3), 2)): rng.randrange(5) for _ in range(4000)} | {("a", None): 3, (None, None): 4, ("c", 1.0): 2}
    return [(*k, n) for k, n in rows.items()]


@pytest.mark.parametrize("down", [True, False])
@pytest.mark.parametrize("by", [["g"], []])
def test_running_sums(spark, counts, by, down):
    rows = counts if by else list({v: ("x", v, n) for _, v, n in counts}.values())
    got = {(r["g"] if by else None, r["v"]): r["sum"] for r in ranks.running_by_value(table(spark, rows), by, "v", {"sum": "n"}, down).collect()}
    assert len(got) == len(rows)
    low = lambda v: -1e9 if v is None else v  # noqa: E731  nulls are least: first going up, last going down
    for g in {r[0] for r in rows} if by else {None}:
        total = 0
        for _, v, n in sorted((r for r in rows if not by or r[0] == g), key=lambda r: low(r[1]), reverse=down):
            total += n
            assert got[g, v] == total


def test_greatest_onward(spark):
    rng = random.Random(2)
    rows = [("a", float(i), rng.randrange(1000)) for i in range(700)]
    got = {r["v"]: r["m"] for r in ranks.greatest_onward(table(spark, rows), ["g"], "v", "n", "m").collect()}
    most = 0
    for _, v, n in rows:
        most = max(most, n)
        assert got[v] == most


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(3)
    values = {"a": rng.normal(size=777).round(2), "b": rng.integers(0, 5, 400).astype(float), "c": np.array([4.5])}
    rows = [(g, float(v), 1) for g, vs in values.items() for v in vs] + [("a", None, 1), ("d", None, 1)]
    points = {"low": 0.0, "mid": 0.5, "odd": 0.333, "top": 0.99, "all": 1.0}
    got = {r["g"]: r for r in ranks.percentiles(table(spark, rows), "v", points, ["g"]).collect()}
    assert got["d"]["mid"] is None
    for g, vs in values.items():
        for name, p in points.items():
            assert got[g][name] == pytest.approx(np.percentile(vs, 100 * p))
    assert ranks.percentiles(table(spark, []), "v", points).first()["mid"] is None


def test_hash_ranks(spark):
    rows = [(["a", "b", None][i % 3], float(i), i) for i in range(500)]
    df = table(spark, rows)
    digest = F.md5(F.col("n").cast("string").cast("binary"))
    got = {r["n"]: r["k"] for r in ranks.hash_rank(df, ["g"], digest, ["n"], "k").collect()}
    import hashlib

    for g in ("a", "b", None):
        mine = sorted((r[2] for r in rows if r[0] == g), key=lambda n: (hashlib.md5(str(n).encode()).hexdigest(), n))
        assert [got[n] for n in mine] == list(range(1, len(mine) + 1))


def test_metrics_of_nothing_and_nulls(spark):
    df = spark.createDataFrame([(0.5, 1), (None, 0), (0.5, 0), (0.9, 1)], "score double, label int")
    assert metrics.roc_auc(df).first()["auc"] == pytest.approx((2 + 1 + 0.5) / 4)
    assert metrics.average_precision(df).first()["ap"] == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert metrics.average_precision(df.where("false")).first()["ap"] is None


def test_too_many_folds_raise(spark):
    with pytest.raises(ValueError):
        splits.leave_one_out(spark.range(20).withColumnRenamed("id", "host"), "host", 10)


def test_a_percentile_between_equal_values_is_that_value(spark):
    # 5 x 7.3 and 5 x 29.27: mixing (1 - p) * v + p * v came out above the one and below the other
    rows = [(g, v, 1) for g, v in (("a", 7.3), ("b", 29.27), ("c", 60.1)) for _ in range(4 if g == "c" else 5)]
    got = {r["g"]: r["p"] for r in ranks.percentiles(table(spark, rows), "v", {"p": 0.9}, ["g"]).collect()}
    assert got == {"a": 7.3, "b": 29.27, "c": 60.1}
    flags = metrics.flag_overlap(table(spark, [r for r in rows if r[0] == "b"]).select("v", F.col("v").alias("w")), "v", "w", [90.0]).first()
    assert (flags["a_flags"], flags["b_flags"], flags["both"]) == (0, 0, 0)
