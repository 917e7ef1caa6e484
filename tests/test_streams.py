"""Streams give what the batch forms give, to the last window."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from provspark.plans import q_streaming
from provspark.plans.adapt import edges
from provspark.plans.registry import QUERIES
from provspark.streaming import streams as st

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="the test tables are not here")


class Running:
    """A stream that does not end."""

    stopped = False

    def awaitTermination(self, timeout=None):  # noqa: N802
        return False

    def stop(self):
        self.stopped = True

    def exception(self):
        return None


def test_drain_raises_while_the_stream_runs():
    query = Running()
    with pytest.raises(TimeoutError):
        st.drain(query, 1)
    assert query.stopped


@needs_tables
def test_files_come_in_time_order(spark):
    seen = []
    stream = q_streaming.edge_stream(spark, SF, 5)
    q = stream.writeStream.foreachBatch(lambda b, _: seen.append(b.agg(F.min("ts"), F.max("ts"), F.count("*")).first()))
    st.drain(q.option("checkpointLocation", q_streaming.folder(spark, "checkpoint")).trigger(availableNow=True).start())
    assert len(seen) == 5 and all(a[1] < b[0] for a, b in zip(seen, seen[1:], strict=False))
    assert sum(x[2] for x in seen) == edges(spark, SF).count()


@needs_tables
def test_rates_match_batch(spark):
    timed = edges(spark, SF).withColumn("at", F.timestamp_micros(F.expr("ts div 1000")))
    want = sorted(map(tuple, st.edge_rates(timed, "10 seconds", "5 seconds").collect()))
    assert sorted(map(tuple, QUERIES["t7_stream_rates"](spark, SF).collect())) == want


@needs_tables
def test_every_score_comes_out(spark):
    want = sorted((r["event_id"], r["size"] % 10 == 3) for r in edges(spark, SF).collect())
    assert sorted((r["event_id"], r["orphan"]) for r in QUERIES["j4_t6_stream_score_join"](spark, SF).collect()) == want


@needs_tables
def test_last_alert_windows_close(spark):
    found = QUERIES["t1_stream_alert_dedup"](spark, SF).groupBy("kind").agg(F.count("*").alias("n"), F.sum("suppressed").alias("s")).collect()
    n = {r["kind"]: r for r in found}
    assert n["alert"]["n"] == n["closed"]["n"] and n["alert"]["n"] + n["closed"]["s"] == edges(spark, SF).count()


def test_alerts_of_many_keys_keep_their_state_in_groups(spark, tmp_path):
    """Windows of 3,000 keys, a null one among them, over files that come in turn; state is a row a group, not a key."""
    kind, second, at = "key string, ts long", 10**9, 1_700_000_000
    rows = [(None if k == 0 else f"k{k}", (at + t * 200 + k % 7) * second + k) for t in range(6) for k in range(3000) if (k + t) % 5]
    for n in range(3):
        part = [r for r in rows if n * 400 <= r[1] // second - at < (n + 1) * 400]
        spark.createDataFrame(part[::-1], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame([("end", st.END_NS)], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = st.available_now(st.stream_alert_dedup(stream), "many_keys")
    st.drain(q)
    want, live = [], {}
    for key, ts in sorted(rows, key=lambda r: r[1]):
        if key in live and ts - live[key][0] <= 300 * second:
            live[key][1] += 1
        else:
            want += [(key, *live[key], "closed")] if key in live else []
            live[key] = [ts, 0]
            want.append((key, ts, 0, "alert"))
    want += [(k, *v, "closed") for k, v in live.items()]
    got = [(r["key"], r["ts"], r["suppressed"], r["kind"]) for r in spark.table("many_keys").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert max(o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]) <= 1024


def test_scoring_is_triggered_by_lulls_and_intervals():
    t = st.ScoringTrigger(min_edges=10, idle_for_s=15, every_s=60)
    assert not t.before(0)
    t.arrived(6, 5)
    assert not t.before(100)  # too few edges
    t.arrived(6, 9)
    assert not t.before(23) and t.before(24)  # idle after new edges
    t.scored(24)
    assert not t.before(83) and t.before(84)  # nothing new, but the interval is over
    t.arrived(1, 80)
    assert not t.before(83) and t.before(95)


def test_a_trigger_remembers_over_a_stop(spark, tmp_path):
    """The runs of a stream that stops after each file are those of a stream that does not; a lull inside a batch counts."""
    seconds = [*range(0, 40), *range(60, 70), *range(200, 260), 300]
    files = [seconds[:25], seconds[25:55], seconds[55:56], seconds[56:]]
    kind = "event_id string, ts long"
    score = lambda g: g.agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    trigger = st.ScoringTrigger(min_edges=10, idle_for_s=15, every_s=50)
    for i, f in enumerate(files):
        spark.createDataFrame([(f"e{s}", s * 10**9 + 5) for s in f], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        st.drain(st.triggered_scoring(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), score, f"{tmp_path}/out", f"{tmp_path}/check{0}", None, trigger))
    whole = st.ScoringTrigger(10, 15, 50)
    want = []
    for i, s in enumerate(seconds):
        if whole.before(s):
            want.append((s, i))
            whole.scored(s)
        whole.arrived(1, s)
    runs = sorted((r["run"], r["edges"]) for r in spark.read.parquet(f"{tmp_path}/out/runs").collect())
    assert runs == want and [s for s, _ in want] == [60, 200, 250, 300]
    scores = {r["run"]: (r["n"], r["last"] // 10**9) for r in spark.read.parquet(f"{tmp_path}/out/scores").collect()}
    assert scores == {s: (n, seconds[n - 1]) for s, n in want}


def test_live_scores_with_a_fitted_pipeline(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    rows = [(f"e{i}" if i % 10 else "", float(i), float(i > 50)) for i in range(100)]
    df = spark.createDataFrame(rows, "event_id string, size double, label double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["size"], outputCol="features"), LogisticRegression()]).fit(df)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    score = lambda b: model.transform(b).select("event_id", vector_to_array("probability")[1].alias("score"))
    out = str(tmp_path / "out")
    st.drain(st.live_scores(stream, score, 0.5, out, str(tmp_path / "check")))
    scores, alerts = spark.read.parquet(f"{out}/scores"), spark.read.parquet(f"{out}/alerts")
    assert scores.count() == 90 and {r["event_id"] for r in alerts.collect()} == {r["event_id"] for r in scores.where("score >= 0.5").collect()}
    assert 30 < alerts.count() < 60 and scores.where(F.col("event_id") == "").count() == 0


def test_upserts_add_only_new_keys(spark, tmp_path):
    kind = "edge_type string, event_id string, src_id string, dst_id string, ts long, note string"
    batch = lambda *rows: spark.createDataFrame([("READ", *r) for r in rows], kind)
    path = str(tmp_path / "edges")
    st.upsert_batch(batch(("e1", "a", "b", 5, "later"), ("e1", "a", "b", 3, "first"), ("e2", None, "b", 1, "null")), path, 0)
    second = batch(("e1", "a", "b", 1, "too late"), ("e2", None, "b", 0, "again"), ("e3", "a", None, 9, "new"))
    for _ in range(2):  # a batch that is repeated after a failure
        st.upsert_batch(second, path, 1)
    got = sorted((r["event_id"], r["note"]) for r in st.stored_edges(spark, path).collect())
    assert got == [("e1", "first"), ("e2", "null"), ("e3", "new")]
    assert st.stored_edges(spark, str(tmp_path / "none")) is None


def test_first_writes_over_a_stop(spark, tmp_path):
    """A stream that stops after each file knows its keys, drops nothing as late, and puts nothing twice."""
    kind = "edge_type string, event_id string, src_id string, dst_id string, ts long, note string"
    day = 86_400 * 10**9
    files = [
        [("e1", "a", "b", 100 * day + 5, "later"), ("e1", "a", "b", 100 * day, "first"), ("e2", None, "b", 100 * day, "null")],
        [("e1", "a", "b", 1, "too late"), ("e2", None, "b", 0, "again"), ("e3", "a", None, None, "new"), ("e4", "x", "y", day, "long ago")],
        [("e4", "x", "y", 0, "earlier yet"), ("e1", None, "b", 7, "another key"), ("", "", "", st.END_NS, "marker")],
        [("e3", "a", None, 1, "known")],
    ]
    path, rows = str(tmp_path / "edges"), lambda: sorted((r["event_id"], r["src_id"] or "", r["note"]) for r in st.stored_edges(spark, path).collect())
    for f in files:
        spark.createDataFrame([("READ", *r) for r in f], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        st.drain(st.micro_batch_upsert(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), path, f"{tmp_path}/check", None))
    want = [("e1", "", "another key"), ("e1", "a", "first"), ("e2", "", "null"), ("e3", "a", "new"), ("e4", "x", "long ago")]
    assert rows() == want
    before = st.whole_batches(spark, path)
    st.drain(st.micro_batch_upsert(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), path, f"{tmp_path}/check", None))
    assert rows() == want and before >= 4
    # what a batch that is not whole has put is not seen
    st.stored_edges(spark, path).write.parquet(f"{path}/edges/batch={st.whole_batches(spark, path) + 5}")
    assert rows() == want


def test_state_settings_are_put_back(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    with st.keyed_state(spark):
        assert "RocksDB" in spark.conf.get(key)
    assert spark.conf.get(key) == before


def test_only_its_own_end_ends_a_stream():
    class Told:
        def __init__(self, id):
            self.id = id

    seen = st.Counters()
    seen.onQueryTerminated(Told("other"))
    with pytest.raises(TimeoutError):
        seen.wait(Told("mine"), 0.01)
    seen.onQueryTerminated(Told("mine"))
    seen.wait(Told("mine"), 0.01)
