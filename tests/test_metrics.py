"""Ranking metrics on small cases with known results."""

import numpy as np
import pytest

from provspark.operators import metrics as m


def frame(spark, scores, attacks):
    return spark.createDataFrame([(float(s), int(a), int(a >= 0)) for s, a in zip(scores, attacks, strict=True)], "score double, attack_id int, label int")


@pytest.mark.parametrize(("scores", "attacks", "want"), [
    ([9, 1, 1, 1], [0, -1, -1, -1], 1.0),
    ([9, 8, 7, 1, 0], [0, 1, 2, -1, -1], 1.0),
    (list(range(100, 0, -1)) + [0], [-1] * 100 + [0], 1 / 101),
    ([5, 4, 3], [0, -1, 1], (1 + 2 / 3) / 2),
    ([1, 1], [0, -1], 0.5),
    ([1, 1], [-1, 0], 0.5),
])
def test_adp(spark, scores, attacks, want):
    assert m.adp(frame(spark, scores, attacks)).first()["adp"] == pytest.approx(want)


def test_adp_without_attacks_gives_nothing(spark):
    assert m.adp(frame(spark, [1, 2], [-1, -1])).first()["adp"] is None


def test_auc_and_ap_with_ties(spark):
    rng = np.random.default_rng(3)
    score, label = rng.integers(0, 6, 80), rng.integers(0, 2, 80)
    df = spark.createDataFrame([(float(s), int(y)) for s, y in zip(score, label, strict=True)], "score double, label int")
    pos, neg = score[label == 1], score[label == 0]
    auc = np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg])
    ap, before = 0.0, 0
    for t in sorted(set(score), reverse=True):
        tp = int((pos >= t).sum())
        ap += (tp - before) / len(pos) * tp / (tp + int((neg >= t).sum()))
        before = tp
    assert m.roc_auc(df).first()["auc"] == pytest.approx(auc)
    assert m.average_precision(df).first()["ap"] == pytest.approx(ap)


def test_seed_stability(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "k string, v double")
    got = {r["k"]: r["relative_sigma"] for r in m.seed_stability(df, ["k"], "v").collect()}
    assert got == {"a": pytest.approx(0.5), "b": 0.0}


def test_empty_table(spark):
    df = spark.createDataFrame([], "score double, label int")
    assert m.roc_auc(df, []).count() <= 1 and m.threshold_sweep(df, spark.range(2).selectExpr("id * 1.0D AS threshold")).count() == 0


def test_bootstrap_interval_draws_its_rows_once(spark, monkeypatch):
    from provspark.plans import q_metrics

    seen = []
    monkeypatch.setattr(q_metrics, "written", lambda df, name: seen.append(df.columns) or df.limit(0))
    q_metrics.d14_bootstrap_interval(spark, "/root/testdata/sf0.001")
    assert seen == [["replicate", "score", "label", "weight"]]
