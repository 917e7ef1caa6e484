"""Streams over the event table, and round trips through the readers and writers.

A query lays its input out in the shared folder, runs its stream to the end and
returns the table that the stream wrote.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from provspark.operators import graph as g
from provspark.plans.adapt import PROV, edges, load
from provspark.plans.q_functions import raw_lines
from provspark.plans.q_graph import NODES
from provspark.plans.registry import query
from provspark.sources import cdm, files
from provspark.sources.config import rule_library
from provspark.streaming import streams as st


def folder(spark: SparkSession, name: str) -> str:
    return f"{g.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Fewest files of a range of the edge stream, which are one batch, and the rows beyond which a range has more.
FILES, FILE_ROWS = 8, 1_000_000


def edge_stream(spark: SparkSession, sf_dir: str, batches: int = 3, ends: bool = False, of: DataFrame | None = None, late: DataFrame | None = None) -> DataFrame:
    """The edges, or those of ``of``, as a stream of ranges of as many files as their rows ask for, in time order; ``late`` comes after them.

    With ``ends`` a marker closes the stream (``with_event_time`` takes it out).
    """
    e, path = edges(spark, sf_dir) if of is None else of, folder(spark, "stream")
    rows, cuts = e.agg(F.count("*"), F.percentile_approx("ts", [i / batches for i in range(1, batches)], 10_000)).first()
    files = max(FILES, -(-rows // (batches * FILE_ROWS)))
    bounds = [None, *sorted(set(cuts or [])), None]
    # the stream takes files by their modification time: each range is written when the one before it is whole
    for low, high in zip(bounds, bounds[1:]):
        ts = F.col("ts")
        above = F.lit(True) if low is None else ts > low
        within = above if high is None else above & (ts <= high)
        e.where(within | ts.isNull() if low is None else within).repartition(files).write.mode("append").parquet(path)
    if late is not None:
        late.select(*e.columns).repartition(files).write.mode("append").parquet(path)
    if ends:
        # no value is null, or filters that the optimiser moves before the watermark would drop the marker
        value = {"ts": F.lit(st.END_NS)}
        marker = spark.range(1, numPartitions=1).select(*[value.get(f.name, F.lit("0")).cast(f.dataType).alias(f.name) for f in e.schema])
        marker.write.mode("append").parquet(path)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", files).parquet(path)


def started(spark: SparkSession, stream: DataFrame, out: str, mode: str = "append") -> StreamingQuery:
    """A stream over what is there, into a table at ``out``."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", folder(spark, "checkpoint")).trigger(availableNow=True).start()


def collected(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives when it has run over what is there, as a table."""
    out = folder(spark, "result")
    st.drain(started(spark, stream, out, mode))
    return spark.read.schema(stream.schema).parquet(out)


@query("SELECT sourcetype, count(*) AS n FROM (SELECT ['stream_tcp', 'suricata', 'access_combined', 'XmlWinEventLog:Sysmon', 'pan_traffic', 'mysql_x', 'WinHostMon', 'auditd', 'WinRegistry', 'other'][event_id % 10 + 1] AS sourcetype FROM events) GROUP BY 1")
def s16_stream_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "raw")
    good = raw_lines(spark, sf_dir).select(F.to_json(F.struct("_raw", "sourcetype", "host", "_time", "label", "scenario")).alias("value"))
    good.union(good.limit(5).select(F.lit("{broken"))).write.text(path)
    return collected(spark, st.stream_raw(spark, path)).groupBy("sourcetype").agg(F.count("*").alias("n"))


@query("SELECT count(*) + 5 AS received, 5::BIGINT AS bad FROM events")
def t5_stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a listener has counted when the ingest stream has ended."""
    path, seen = folder(spark, "raw"), st.Counters()
    good = raw_lines(spark, sf_dir).select(F.to_json(F.struct("_raw", "sourcetype", "host", "_time", "label", "scenario")).alias("value"))
    good.union(good.limit(5).select(F.lit("{broken"))).write.text(path)
    spark.streams.addListener(seen)
    try:
        ingest = started(spark, st.stream_raw(spark, path), folder(spark, "result"))
        st.drain(ingest)
        seen.wait(ingest, 120)
    finally:
        spark.streams.removeListener(seen)
    told = seen.sums["ingest"]
    return spark.createDataFrame([(told["received"], told["bad"])], "received long, bad long")


#: A logistic score of an edge, and the threshold of its alerts.
LOGIT, ALERT = "1 / (1 + exp((100 - score) / 20))", 0.8


@query(f"WITH {PROV}, s AS (SELECT event_id, edge_type, round({LOGIT}, 9) AS score FROM prov) SELECT event_id, score, score >= {ALERT} AS alerted FROM s")
def t6_live_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges scored as they arrive; both sinks joined."""
    path = folder(spark, "live")
    model = lambda batch: batch.withColumn("score", F.round(F.expr(LOGIT), 9)).select("event_id", "edge_type", "score")
    st.drain(st.live_scores(edge_stream(spark, sf_dir), model, ALERT, path, folder(spark, "checkpoint")))
    alerts = spark.read.parquet(f"{path}/alerts").select("event_id", F.lit(True).alias("alerted"))
    return spark.read.parquet(f"{path}/scores").join(alerts, "event_id", "left").select("event_id", "score", F.coalesce("alerted", F.lit(False)).alias("alerted"))


#: A scoring every ten minutes of event time, or after a lull of fifteen seconds.
TRIGGER = st.ScoringTrigger(min_edges=300, idle_for_s=15, every_s=600)
#: Second by second: what has come, when the last edge came, when the graph was last scored, and whether it is due.
TRIGGERED = f"""clock AS (SELECT s, n, row_number() OVER (ORDER BY s) AS i, lag(s) OVER (ORDER BY s) AS last_edge, sum(n) OVER (ORDER BY s) - n AS edges
    FROM (SELECT ts // 1000000000 AS s, count(*)::BIGINT AS n FROM prov GROUP BY 1)),
  told AS (SELECT 1::BIGINT AS i, s, s AS last_score, 0::BIGINT AS edges, false AS fires FROM clock WHERE i = 1
    UNION ALL SELECT i, s, CASE WHEN due THEN s ELSE last_score END, edges, due FROM (
      SELECT c.i, c.s, t.last_score, c.edges::BIGINT AS edges, c.edges >= {TRIGGER.min_edges} AND (c.s - c.last_edge >= {TRIGGER.idle_for_s} OR c.s - t.last_score >= {TRIGGER.every_s}) AS due
      FROM told t JOIN clock c ON c.i = t.i + 1)),
  runs AS (SELECT s AS run, edges FROM told WHERE fires)"""


def triggered(spark: SparkSession, sf_dir: str, score: Callable[[DataFrame], DataFrame], window: int | None) -> DataFrame:
    """What every triggered run of a scorer over the edge stream has written, with the edges that had come."""
    path = folder(spark, "graph")
    st.drain(st.triggered_scoring(edge_stream(spark, sf_dir), score, path, folder(spark, "checkpoint"), window, TRIGGER))
    return spark.read.parquet(f"{path}/scores").join(spark.read.parquet(f"{path}/runs").drop("batch"), "run")


@query(f"""WITH RECURSIVE {PROV}, {TRIGGERED},
  placed AS (SELECT run, edges, src_id, row_number() OVER (PARTITION BY run ORDER BY ts DESC, event_id) AS nr FROM runs JOIN prov ON ts < run * 1000000000)
SELECT run, edges, src_id AS node, count(*) AS degree FROM placed WHERE nr <= 600 GROUP BY ALL""")
def t3_t4_triggered_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of a sliding-window scorer that lulls and intervals in event time have triggered, and what they gave."""
    score = lambda graph: graph.groupBy(F.col("src_id").alias("node")).agg(F.count("*").alias("degree"))
    return triggered(spark, sf_dir, score, 600).select("run", "edges", "node", "degree")


@query(f"WITH RECURSIVE {PROV}, {TRIGGERED} SELECT run, edges, edge_type, count(*) AS n, count(DISTINCT src_id) AS subjects FROM runs JOIN prov ON ts < run * 1000000000 GROUP BY ALL")
def t4_accumulated_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the whole graph that had accumulated."""
    score = lambda graph: graph.groupBy("edge_type").agg(F.count("*").alias("n"), F.count_distinct("src_id").alias("subjects"))
    return triggered(spark, sf_dir, score, None).select("run", "edges", "edge_type", "n", "subjects")


@query(f"WITH {PROV} SELECT edge_type, count(*) AS n FROM prov GROUP BY edge_type")
def s17_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = folder(spark, "sink"), folder(spark, "sink")
    sinks = {"graph": lambda d, n: d.write.mode("overwrite").parquet(f"{a}/n={n}"), "rules": lambda d, n: d.write.mode("overwrite").parquet(f"{b}/n={n}")}
    st.drain(st.fan_out(edge_stream(spark, sf_dir), sinks, folder(spark, "checkpoint")))
    both = spark.read.parquet(a).join(spark.read.parquet(b).select("event_id"), "event_id")
    return both.groupBy("edge_type").agg(F.count("*").alias("n"))


@query(f"WITH {PROV}, {NODES} SELECT label, uuid, name, first_seen, last_seen FROM nodes")
def s19_g1_micro_batch_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "graph")
    st.drain(st.micro_batch_upsert(edge_stream(spark, sf_dir), path, folder(spark, "checkpoint"), None))
    return st.nodes_of(path, spark).select("label", "uuid", "name", "first_seen", "last_seen")


@query()
def r2_r5_stream_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence firings with the partial matches as state, over all chains."""
    path = folder(spark, "sequences")
    st.drain(st.stream_sequences(edge_stream(spark, sf_dir), rule_library(), path, folder(spark, "checkpoint")))
    return spark.read.parquet(f"{path}/firings").drop("batch")


@query(f"""WITH RECURSIVE {PROV}, a AS (SELECT src_id AS key, ts FROM prov), f AS (SELECT key, min(ts) AS ts FROM a GROUP BY key UNION ALL SELECT f.key, (SELECT min(a.ts) FROM a WHERE a.key = f.key AND a.ts > f.ts + 300000000000) FROM f WHERE f.ts IS NOT NULL),
  w AS (SELECT f.key, f.ts, (SELECT count(*) FROM a WHERE a.key = f.key AND a.ts BETWEEN f.ts AND f.ts + 300000000000) - 1 AS suppressed FROM f WHERE f.ts IS NOT NULL)
SELECT key, ts, 'alert' AS kind, 0::BIGINT AS suppressed FROM w UNION ALL SELECT key, ts, 'closed', suppressed FROM w""")
def t1_stream_alert_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = edge_stream(spark, sf_dir, ends=True).select(F.col("src_id").alias("key"), "ts")
    return collected(spark, st.stream_alert_dedup(alerts))


@query(f"WITH {PROV} SELECT make_timestamp(ts // 10000000000 * 10000000) AS window_start, endpoint_id, edge_type, count(*) AS edges FROM prov GROUP BY ALL")
def t7_edge_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = edges(spark, sf_dir).withColumn("at", F.timestamp_micros(F.expr("ts div 1000")))
    return st.edge_rates(timed).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(f"WITH {PROV} SELECT make_timestamp((ts // 5000000000 - back) * 5000000) AS window_start, endpoint_id, edge_type, count(*) AS edges FROM prov, (SELECT unnest([0, 1]) AS back) GROUP BY ALL")
def t7_stream_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = collected(spark, st.edge_rates(st.with_event_time(edge_stream(spark, sf_dir, ends=True), "0 seconds"), "10 seconds", "5 seconds"))
    return rates.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(f"""WITH {PROV}, t AS (SELECT endpoint_id, ts // 1000 AS us FROM prov), g AS (SELECT *, coalesce(us - lag(us) OVER w >= 30000000, true)::INTEGER AS fresh FROM t WINDOW w AS (PARTITION BY endpoint_id ORDER BY us)),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY endpoint_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS nr FROM g)
SELECT make_timestamp(min(us)) AS start, make_timestamp(max(us) + 30000000) AS "end", endpoint_id, count(*) AS edges FROM s GROUP BY endpoint_id, nr""")
def t7_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = edges(spark, sf_dir).withColumn("at", F.timestamp_micros(F.expr("ts div 1000")))
    return st.session_rates(timed).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query(f"WITH {PROV} SELECT event_id, score, size % 10 = 3 AS orphan FROM prov")
def j4_t6_stream_score_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores joined to edges of another stream; those without an edge are orphans."""
    s = st.with_event_time(edge_stream(spark, sf_dir, ends=True), "60 seconds")
    e = st.with_event_time(edge_stream(spark, sf_dir, ends=True).where("size % 10 <> 3"), "60 seconds")
    return collected(spark, st.score_edge_join(e, s.select("event_id", "score", "at"))).select("event_id", "score", "orphan")


#: How far behind the late writes are, and whose first write is the late one.
BEHIND, UNSEEN = 1_000_000_000_000_000, "substr(event_id, -1) = '7'"


@query(f"WITH {PROV} SELECT * EXCLUDE (ts, size), CASE WHEN {UNSEEN} THEN ts - {BEHIND} ELSE ts END AS ts, CASE WHEN {UNSEEN} THEN size + 2 ELSE size END AS size FROM prov")
def g1_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First writes of a stream whose edges come again a moment later and once more eleven days behind, some of them only then."""
    e = edges(spark, sf_dir)
    again = lambda d, ns, more: d.withColumns({"ts": F.col("ts") + ns, "size": F.col("size") + more})
    seen, path = e.where(f"NOT {UNSEEN}"), folder(spark, "graph")
    stream = edge_stream(spark, sf_dir, of=seen.unionByName(again(seen, 1, 1)), late=again(e, -BEHIND, 2))
    st.drain(st.micro_batch_upsert(stream, path, folder(spark, "checkpoint"), None))
    return st.stored_edges(spark, path)


@query("SELECT event_id, ['stream_tcp', 'suricata', 'access_combined', 'XmlWinEventLog_Sysmon', 'pan_traffic', 'mysql_x', 'WinHostMon', 'auditd', 'WinRegistry', 'other'][event_id % 10 + 1] AS sourcetype FROM events WHERE event_id % 10 IN (1, 3)")
def s1_s4_log_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV out and in, cleaned, partitioned, and two partitions read."""
    csv, table = folder(spark, "csv"), folder(spark, "table")
    raw = raw_lines(spark, sf_dir).select((F.col("event_id") + 0.25).alias("_time"), F.lit("source::s").alias("source"), F.concat(F.lit("host::"), "host").alias("host"), "sourcetype", F.concat("_raw", F.lit('\n"q", x')).alias("_raw"), F.lit("m").alias("_meta"))
    raw.write.csv(csv, header=True, quote='"', escape='"', quoteAll=True)
    rows, _ = files.read_log_csv(spark, csv)
    files.write_partitioned(files.clean_log(rows), table)
    back = files.read_partitions(spark, table, ["suricata", "XmlWinEventLog_Sysmon"])
    return back.select(F.col("_time").alias("event_id"), "sourcetype")


@query("SELECT count(*) FILTER (event_id % 50 <> 0) AS good, count(*) FILTER (event_id % 50 = 0) AS malformed FROM events")
def s1_malformed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a log file that do not parse are counted, not lost."""
    path = folder(spark, "csv")
    names = [c.split()[0] for c in files.RAW_SCHEMA.split(", ") if not c.startswith("_corrupt")]
    line = F.concat_ws(",", *[F.when(F.lit(c) == "_time", F.col("event_id").cast("string")).otherwise(F.concat(F.lit('"'), F.lit(c), F.lit('"'))) for c in names])
    load(spark, sf_dir, "events").select(F.when(F.col("event_id") % 50 == 0, F.concat(line, F.lit(",one,too,many"))).otherwise(line).alias("value")).write.text(path)
    rows, bad = files.read_log_csv(spark, path, header=False)
    # what is parsed is saved before it is counted, as the reader demands
    n = lambda t, name: g.written(t.select("_raw"), name).agg(F.count("*").alias(name))
    return n(rows, "good").crossJoin(n(bad, "malformed"))  # one row each


@query("SELECT 'run' || event_id % 3 AS scenario, count(*) AS n FROM events WHERE event_id % 4 <> 0 GROUP BY 1")
def s11_attack_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attack records of a tree of files; the folder names the scenario."""
    path = folder(spark, "attacks")
    line = F.expr("""concat('{"Channel":"Microsoft-Windows-Sysmon/Operational","EventID":', event_id % 5, if(event_id % 4 = 0, '', concat(',"UtcTime":"', 1704067200 + event_id, '"')), ',"Hostname":"h"}')""")
    e = load(spark, sf_dir, "events").select(line.alias("value"), (F.col("event_id") % 3).alias("run"))
    for run in range(3):
        e.where(F.col("run") == run).select("value").write.text(f"{path}/run{run}")
    return files.read_ndjson_attacks(spark, f"{path}/*").groupBy("scenario").agg(F.count("*").alias("n"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def s18_report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts written as JSON and as CSV; both say the same when they are read again."""
    a, b = folder(spark, "summary"), folder(spark, "report")
    counts = load(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    files.write_summary_json(counts, a)
    files.write_report_csv(counts, b)
    kind = "lang string, n long"
    return spark.read.schema(kind).json(a).intersect(spark.read.schema(kind).csv(b, header=True))


@query(f"WITH {PROV} SELECT event_id, src_id, dst_id, edge_type FROM prov")
def s9_edge_tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, cols = folder(spark, "tsv"), ["event_id", "src_id", "dst_id", "edge_type"]
    files.write_edge_tsv(edges(spark, sf_dir).select(*cols), path)
    return files.read_edge_tsv(spark, path, cols, 4)


@query("SELECT 'host' || (event_id % 3) AS hostname, count(*) AS n FROM events WHERE event_id % 3 = 1 GROUP BY 1")
def s10_read_ecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "ecar")
    e = load(spark, sf_dir, "events")
    e.select(F.expr("""concat('{"action":"A","actorID":"a","objectID":"b","object":"FILE","pid":1,"ppid":2,"timestamp":"t","hostname":"host', event_id % 3, '","properties":{"k":"v"}}')""").alias("value")).write.option("compression", "gzip").text(path)
    return files.read_ecar(spark, path, "host1").groupBy("hostname").agg(F.count("*").alias("n"))


@query("""WITH lines AS (SELECT event_id, 'host' || (event_id % 30) || '.' AS a, 'host' || (user_id % 7) || '.' AS b FROM events) SELECT h.host, count(*) AS lines, count(DISTINCT a) AS names
  FROM (SELECT 'host' || unnest(range(1, 30)) || '.' AS host) h JOIN lines ON host = a OR host = b GROUP BY h.host""")
def s10_ecar_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus dealt to 29 hosts' files in one pass; lines that name two hosts are in both."""
    path, out = folder(spark, "ecar"), folder(spark, "hosts")
    line = F.expr("""concat('{"action":"A","actorID":"a","objectID":"b","object":"FLOW","pid":1,"ppid":2,"timestamp":"t","hostname":"host', event_id % 30, '.","properties":{"peer":"host', user_id % 7, '."}}')""")
    load(spark, sf_dir, "events").select(line.alias("value")).write.option("compression", "gzip").text(path)
    files.write_ecar_hosts(spark, path, out, [f"host{i}." for i in range(1, 30)])
    each = spark.read.text(out).select("host", F.get_json_object("value", "$.hostname").alias("name"))
    return each.groupBy("host").agg(F.count("*").alias("lines"), F.countDistinct("name").alias("names"))


@query("SELECT DISTINCT 'u' || user_id AS uuid FROM events")
def s12_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "gt")
    load(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id", F.lit("  ")).alias("value")).write.text(path)
    return files.read_ground_truth(spark, path)


UUID = "'00000000-0000-0000-0000-' || lpad({0}::VARCHAR, 12, '0')"


@query(f"""SELECT {UUID.format("(1000 + user_id)")} AS actor_id, {UUID.format("k")} AS object_id, CASE WHEN k % 2 = 0 THEN 'NetFlowObject' ELSE 'FILE_OBJECT_BLOCK' END AS object_cdm, 'cmd' || user_id AS exec,
  CASE WHEN k % 2 = 0 THEN '1.2.3.4:' || k ELSE '/p' END AS path, event_id::VARCHAR AS timestamp, (k < 3)::INTEGER AS label FROM (SELECT *, (props->>'$.k')::INTEGER AS k FROM events)""")
def s6_s7_cdm_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node and event records as JSON lines, read back as messages."""
    e = load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    p, u = cdm.PREFIX, lambda c: f"concat('00000000-0000-0000-0000-', lpad(cast({c} AS string), 12, '0'))"
    subject = e.select("user_id").distinct().selectExpr(f"""concat('{{"datum":{{"{p}.Subject":{{"uuid":"', {u('1000 + user_id')}, '","type":"SUBJECT_PROCESS","cmdLine":{{"string":"cmd', user_id, '"}}}}}}}}') AS value""")
    flow = e.select("k").distinct().where("k % 2 = 0").selectExpr(f"""concat('{{"datum":{{"{p}.NetFlowObject":{{"uuid":"', {u('k')}, '","remoteAddress":"1.2.3.4","remotePort":', k, '}}}}}}') AS value""")
    event = e.selectExpr(f"""concat('{{"datum":{{"{p}.Event":{{"type":"EVENT_READ","timestampNanos":', event_id, ',"subject":{{"{p}.UUID":"', {u('1000 + user_id')}, '"}},"predicateObject":{{"{p}.UUID":"', {u('k')}, '"}}', if(k % 2 = 0, '', ',"predicateObjectPath":{{"string":"/p"}}'), '}}}}}}') AS value""")
    path = folder(spark, "cdm")
    subject.union(flow).union(event).write.text(path)
    lines = cdm.read_lines(spark, path)
    truth = e.where("k < 3").selectExpr(f"{u('k')} AS uuid").distinct()
    return cdm.cdm_events(lines, cdm.cdm_nodes(lines), truth).select("actor_id", "object_id", "object_cdm", "exec", "path", "timestamp", "label")


@query("SELECT sourcetype, least(count(*), 200) AS n FROM (SELECT ['stream_tcp', 'suricata', 'access_combined', 'XmlWinEventLog:Sysmon', 'pan_traffic', 'mysql_x', 'WinHostMon', 'auditd', 'WinRegistry', 'other'][event_id % 10 + 1] AS sourcetype FROM events) WHERE sourcetype <> 'other' GROUP BY 1")
def s20_fair_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.fair_sample(raw_lines(spark, sf_dir), 1800).groupBy("sourcetype").agg(F.count("*").alias("n"))
