"""Neighbourhoods and components on graphs with hubs, against plain Python."""

import random

from provspark.operators import graph as g


def test_alerts_at_a_hub_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(g, "ENDS_A_TASK", 5)
    rng = random.Random(4)
    ends = [f"n{i}" for i in range(12)]
    rows = [(f"e{i}", rng.randrange(150), rng.choice(ends), "hub" if i % 2 else rng.choice(ends), "READ") for i in range(400)]
    rows += [("none", None, "n1", "hub", "READ"), ("loop", 149, "hub", "hub", "READ"), ("open", 149, "n2", None, "READ")]
    edges = spark.createDataFrame(rows, "event_id string, ts long, src_id string, dst_id string, edge_type string")
    alerts = [(f"a{i}", f"n{i % 12}", "hub") for i in range(60)] + [("same", "hub", "hub"), ("half", None, "n3"), ("far", "x", "y"), ("two", "n1", "n2"), ("two", "n3", "n4")]
    got: dict[str, list[str]] = {}
    found = g.alert_subgraph(edges, spark.createDataFrame(alerts, "alert_id string, src_id string, dst_id string"), 30)
    shares = found.selectExpr("alert_id", "event_id", "spark_partition_id() AS task").collect()
    for r in shares:
        got.setdefault(r["alert_id"], []).append(r["event_id"])
    newest = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    for name in {a[0] for a in alerts}:
        at = {x for a in alerts if a[0] == name for x in a[1:] if x is not None}
        want = [r[0] for r in newest if r[2] in at or r[3] in at][:30]
        assert sorted(got.get(name, [])) == sorted(want), name
    assert len({r["task"] for r in shares}) > 5  # alerts that all end at the hub do not share a task


def test_components_bring_no_labels_to_the_driver(spark, monkeypatch):
    plans, write = [], g.written
    monkeypatch.setattr(g, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    edges = spark.createDataFrame([(i, i + 1) for i in range(20) if i != 9], "src_id long, dst_id long")
    got = {r["node"]: r["component"] for r in g.connected_components(edges).collect()}
    assert got == {i: 0 if i < 10 else 10 for i in range(21)}
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)
