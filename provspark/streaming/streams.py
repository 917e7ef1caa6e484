"""Streaming ingest, upserts, rules and alerts on Structured Streaming.

Every stream is at-least-once with a checkpoint; sinks are idempotent (upserts
by key). Event time comes from the edges' nanoseconds, as microseconds.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import reduce
from threading import Event
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from provspark.operators.graph import upsert_edges, upsert_nodes
from provspark.operators.rules import continue_sequence, match_selection

#: The ``ts`` (ns) of a marker that ends a stream: it moves the watermark past everything, so that open windows come out.
END_NS = 9_000_000_000_000_000_000
MESSAGE = "_raw string, sourcetype string, host string, _time long, label int, scenario string"


def stream_raw(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Raw messages of JSON lines that arrive in a folder; what is no JSON has a null ``_raw`` and is counted by ``observe``."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    parsed = lines.select(F.from_json("value", MESSAGE).alias("m"), "value")
    counted = parsed.observe("ingest", F.count("*").alias("received"), F.count_if(F.col("m._raw").isNull()).alias("bad"))
    return counted.where("m._raw IS NOT NULL").select("m.*")


def with_event_time(edges: DataFrame, delay: str = "300 seconds") -> DataFrame:
    """``edges`` with at (timestamp; now where ts is missing) and a watermark on it; end markers move the watermark and go no further."""
    at = F.when(F.coalesce(F.col("ts"), F.lit(0)) > 0, F.timestamp_micros(F.expr("ts div 1000"))).otherwise(F.current_timestamp())
    # a filter on ``at`` stays behind the watermark; one on other columns would be moved before it
    return edges.withColumn("at", at).withWatermark("at", delay).where(F.col("at") < F.timestamp_micros(F.lit(END_NS // 1000)))


KEYS = ["edge_type", "event_id", "src_id", "dst_id"]


def first_writes(edges: DataFrame) -> DataFrame:
    """(update mode) each key's first write, once: the earliest row of the batch that brings it, however late that is in event time.

    The state is one row a key (the one that won) and has no end, so a repeat
    is known after any number of batches and nothing is dropped as late. A
    batch costs a look-up for each of its own keys; ``keyed_state`` keeps the
    state on disk.
    """
    rest = [c for c in edges.columns if c not in KEYS]
    row, now = F.struct(*rest), F.col("_now")
    order = F.struct(now, F.coalesce("ts", F.lit(2**62)), F.to_json(row))
    told = edges.withColumn("_now", F.current_timestamp()).groupBy(*KEYS).agg(F.min_by(row, order).alias("_row"), F.min("_now").alias("_came"), F.max("_now").alias("_last"))
    # the time of a batch is the same in all its rows, and when it is repeated: a key that came in an earlier batch has an earlier one
    return told.where("_came = _last").select(*KEYS, "_row.*").select(*edges.columns)


ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, on executors' disks with a log of changes in the checkpoint, not in their memory."""
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Rows of a batch up to which its keys are broadcast to the stored ones.
SMALL_BATCH = 1_000_000


def put_batch(rows: DataFrame, path: str, number: int) -> None:
    """Write ``rows`` as batch ``number`` of the table at ``path`` and say that it is whole; a batch that is repeated replaces what it has put.

    Which batch is the last whole one stands in two places in turn, so that one
    can be read while the other is written.
    """
    rows.write.mode("overwrite").parquet(f"{path}/edges/batch={number}")
    last = rows.sparkSession.createDataFrame([(number,)], "last long")
    last.coalesce(1).write.mode("overwrite").parquet(f"{path}/whole/turn={number % 2}")


def whole_batches(spark: SparkSession, path: str) -> int:
    """How many batches of the table at ``path`` are whole."""
    try:
        last = spark.read.schema("last long, turn int").parquet(f"{path}/whole").agg(F.max("last")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0
    return 0 if last is None else last + 1


def stored_edges(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The edge table at ``path`` (None if there is none): its whole batches, or those before batch ``before``."""
    whole = whole_batches(spark, path)
    upto = whole if before is None else min(before, whole)
    return spark.read.parquet(f"{path}/edges").where(F.col("batch") < upto).drop("batch") if upto else None


def upsert_batch(batch: DataFrame, path: str, number: int) -> None:
    """Add a batch's new edges to the table at ``path``; the first write of a key wins.

    For batches of any origin, numbered from 0: the stored keys are read, the
    stored rows never written again. A stream that knows its keys
    (``micro_batch_upsert``) need not read them.
    """
    new, stored = upsert_edges(batch, None), stored_edges(batch.sparkSession, path, number)
    if stored is None:
        return put_batch(new, path, number)
    same = lambda a, b: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in KEYS])
    keys, old = new.select(*KEYS).persist(), stored.select(*KEYS)
    known = old.join(F.broadcast(keys) if keys.count() <= SMALL_BATCH else keys, same(old, keys), "left_semi").distinct()
    put_batch(new.join(known, same(new, known), "left_anti").select(*batch.columns), path, number)
    keys.unpersist()


def micro_batch_upsert(edges: DataFrame, path: str, checkpoint: str, seconds: int | None = 2) -> StreamingQuery:
    """Put each micro-batch's first writes into the table at ``path``; without ``seconds`` all that is there is taken and the stream ends.

    The stream's state knows every key, so a batch's cost does not grow with
    the table. Table and checkpoint belong together: neither goes on without
    the other. End markers go no further.
    """
    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    kept = edges.where(F.coalesce(F.col("ts"), F.lit(0)) < END_NS)
    with keyed_state(edges.sparkSession):
        writer = first_writes(kept).writeStream.outputMode("update").foreachBatch(lambda b, n: put_batch(b, path, n))
        return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def fan_out(edges: DataFrame, sinks: dict[str, Callable[[DataFrame, int], None]], checkpoint: str) -> StreamingQuery:
    """Each batch once to every consumer; the batch is computed once."""

    def send(batch: DataFrame, number: int) -> None:
        batch.persist()
        for sink in sinks.values():
            sink(batch, number)
        batch.unpersist()

    return edges.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def nodes_of(path: str, spark: SparkSession) -> DataFrame:
    return upsert_nodes(stored_edges(spark, path))


def stream_selection(edges: DataFrame, rules: list[dict[str, Any]]) -> DataFrame:
    return match_selection(edges, rules)


def sequence_batch(batch: DataFrame, number: int, rules: list[dict[str, Any]], path: str) -> None:
    """Put a batch's firings at ``{path}/firings/batch=...`` and the partials that live on at ``{path}/live/batch=...``.

    The partials of the batch before are the state: what lives within the
    rules' windows, whatever came before. A batch that is repeated finds the
    same state and replaces what it has put.
    """
    live = batch.sparkSession.read.parquet(f"{path}/live/batch={number - 1}") if number else None
    firings, left = continue_sequence(batch, rules, live)
    firings.write.mode("overwrite").parquet(f"{path}/firings/batch={number}")
    left.write.mode("overwrite").parquet(f"{path}/live/batch={number}")


def stream_sequences(edges: DataFrame, rules: list[dict[str, Any]], path: str, checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Firings of sequence rules over all chains, within an endpoint and across; batches come in time order, a batch's edges in any.

    An edge that comes after a later batch is matched when it comes. Without
    ``seconds`` all that is there is taken and the stream ends.
    """
    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    kept = edges.where(F.coalesce(F.col("ts"), F.lit(0)) < END_NS)
    return kept.writeStream.foreachBatch(lambda b, n: sequence_batch(b, n, rules, path)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


#: Groups over which the keys of alerts are dealt: Python is called, and a row of state kept, for a group and not for a key.
GROUPS = 1024


def stream_alert_dedup(alerts: DataFrame, window_s: int = 300) -> DataFrame:
    """First alert of each key in a window anchored at it (key, ts); the number suppressed comes with the next window's first alert.

    A group of keys has the open windows of its keys as its state; windows that
    the watermark has passed leave it. An alert without a time is one of now.
    """
    width = window_s * 1_000_000_000

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        now, out = state.getCurrentWatermarkMs(), []
        live = {k: [anchor, n] for k, anchor, n in zip(*state.get, strict=True)} if state.exists else {}
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values("ts")
            for key, ts in zip(rows["key"].tolist(), rows["ts"].tolist(), strict=True):
                held = live.get(key)
                if held is not None and ts - held[0] <= width:
                    held[1] += 1
                    continue
                if held is not None:
                    out.append((key, held[0], "closed", held[1]))
                live[key] = [ts, 0]
                out.append((key, ts, "alert", 0))
        ends = {k: anchor // 1_000_000 + window_s * 1000 for k, (anchor, _) in live.items()}
        for key in [k for k, end in ends.items() if end < now]:
            out.append((key, live[key][0], "closed", live.pop(key)[1]))
        if live:
            state.update((list(live), [anchor for anchor, _ in live.values()], [n for _, n in live.values()]))
            state.setTimeoutTimestamp(max(min(ends[k] for k in live), now + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "ts", "kind", "suppressed"])

    timed = with_event_time(alerts, "60 seconds")
    # a missing time is filled before rows meet in a group, where it would turn the others' into floats
    keyed = timed.select(F.pmod(F.xxhash64("key"), F.lit(GROUPS)).alias("group"), F.col("key").cast("string").alias("key"), F.coalesce("ts", F.unix_micros("at") * 1000).alias("ts"), "at")
    kept = "keys array<string>, anchors array<long>, suppressed array<long>"
    return keyed.groupBy("group").applyInPandasWithState(step, "key string, ts long, kind string, suppressed long", kept, "append", "EventTimeTimeout")


def score_edge_join(edges: DataFrame, scores: DataFrame, horizon: str = "35 seconds") -> DataFrame:
    """Scored edges of two streams by event id; a score whose edge does not come within the horizon is left without one."""
    e = edges.select(F.col("event_id").alias("e_id"), "src_id", "dst_id", "edge_type", F.col("at").alias("e_at"))
    on = F.expr(f"event_id = e_id AND e_at BETWEEN at - INTERVAL {horizon} AND at + INTERVAL {horizon}")
    return scores.join(e, on, "leftOuter").withColumn("orphan", F.col("e_id").isNull())


@dataclass
class ScoringTrigger:
    """When an accumulated graph is to be scored again, told second by second in event time.

    Due once there are ``min_edges`` edges and either ``idle_for_s`` have passed
    since the last edge after new ones, or ``every_s`` since the last scoring.
    """

    min_edges: int = 300
    idle_for_s: int = 15
    every_s: int = 60
    edges: int = 0
    fresh: int = 0
    last_edge: int | None = None
    last_score: int | None = None

    def before(self, now: int) -> bool:
        """Whether what came so far is due when edges of second ``now`` arrive."""
        if self.last_edge is None or self.edges < self.min_edges:
            return False
        idle = self.fresh > 0 and now - self.last_edge >= self.idle_for_s
        return idle or now - self.last_score >= self.every_s

    def arrived(self, n: int, now: int) -> None:
        self.edges, self.fresh, self.last_edge = self.edges + n, self.fresh + n, max(now, self.last_edge or now)
        self.last_score = now if self.last_score is None else self.last_score

    def scored(self, now: int) -> None:
        self.fresh, self.last_score = 0, now


#: What a trigger remembers, one row a batch.
MEMORY = "edges long, fresh long, last_edge long, last_score long"
RUNS = "run long, edges long"


def triggered_scoring(edges: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, window: int | None = None, trigger: ScoringTrigger | None = None) -> StreamingQuery:
    """Accumulate edges and score their graph whenever ``trigger`` says so.

    ``{path}/scores/run=S`` has the scores of the graph as it was before second
    S, ``{path}/runs`` which runs fired and over how many edges, and
    ``{path}/trigger`` what the trigger remembers; all are kept by batch, so a
    stream that starts again goes on where it stopped, and a repeated batch
    overwrites itself. Without ``window`` the whole accumulated graph is
    scored, with it the newest ``window`` edges. A batch is looked at second by
    second (one number a second of its time passes through the driver), so that
    lulls inside it count as well; end markers are left out.
    """
    start = trigger or ScoringTrigger()

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kept = batch.where(F.coalesce(F.col("ts"), F.lit(0)) < END_NS)
        known = spark.read.schema(MEMORY).parquet(f"{path}/trigger/batch={number - 1}").first().asDict() if number else {}
        now, runs = replace(start, **known), []
        kept.write.mode("overwrite").parquet(f"{path}/graph/batch={number}")
        second = F.expr("coalesce(ts, 0) div 1000000000")
        clock = spark.read.schema(batch.schema).parquet(f"{path}/graph/batch={number}").groupBy(second.alias("s")).agg(F.count("*").alias("n"))
        for s, n in clock.orderBy("s").toLocalIterator():
            if now.before(s):
                score_graph(spark, score, path, s, window, number)
                runs.append((s, now.edges))
                now.scored(s)
            now.arrived(n, s)
        spark.createDataFrame(runs, RUNS).coalesce(1).write.mode("overwrite").parquet(f"{path}/runs/batch={number}")
        spark.createDataFrame([(now.edges, now.fresh, now.last_edge, now.last_score)], MEMORY).coalesce(1).write.mode("overwrite").parquet(f"{path}/trigger/batch={number}")

    return edges.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def score_graph(spark: SparkSession, score: Callable[[DataFrame], DataFrame], path: str, run: int, window: int | None = None, batch: int | None = None) -> None:
    """Score what had accumulated before second ``run`` (or its newest ``window`` edges), up to ``batch``."""
    graph = spark.read.parquet(f"{path}/graph").where(F.coalesce(F.col("ts"), F.lit(0)) < run * 1_000_000_000)
    graph = (graph if batch is None else graph.where(F.col("batch") <= batch)).drop("batch")
    graph = graph if window is None else graph.orderBy(F.desc("ts"), "event_id").limit(window)
    score(graph).write.mode("overwrite").parquet(f"{path}/scores/run={run}")


def live_scores(edges: DataFrame, score: Callable[[DataFrame], DataFrame], threshold: float, path: str, checkpoint: str) -> StreamingQuery:
    """Score every arriving edge: all scores to ``{path}/scores``, those at or over the threshold to ``{path}/alerts`` as well.

    ``score`` adds the column score to a batch (a fitted pipeline's transform,
    say); edges without an event id are skipped. Sinks are keyed by batch.
    """

    def send(batch: DataFrame, number: int) -> None:
        scored = score(batch.where(F.length("event_id") > 0)).withColumn("is_alert", F.col("score") >= threshold)
        scored.write.mode("overwrite").parquet(f"{path}/scores/batch={number}")
        kept = batch.sparkSession.read.parquet(f"{path}/scores/batch={number}")
        kept.where("is_alert").write.mode("overwrite").parquet(f"{path}/alerts/batch={number}")

    return edges.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Counters(StreamingQueryListener):
    """Sums of what streams observe (``DataFrame.observe``), by observation and name."""

    def __init__(self) -> None:
        self.sums: dict[str, dict[str, int]] = {}
        self.ended: defaultdict[str, Event] = defaultdict(Event)

    def onQueryStarted(self, event: Any) -> None: ...

    def onQueryProgress(self, event: Any) -> None:
        for name, row in event.progress.observedMetrics.items():
            told = self.sums.setdefault(name, {})
            for k, v in row.asDict().items():
                told[k] = told.get(k, 0) + (v or 0)

    def onQueryIdle(self, event: Any) -> None: ...

    def onQueryTerminated(self, event: Any) -> None:
        self.ended[str(event.id)].set()

    def wait(self, query: StreamingQuery, timeout_s: float) -> None:
        """Wait until ``query``'s end has been told, and with it all it has observed; other streams' ends do not count."""
        if not self.ended[str(query.id)].wait(timeout_s):
            raise TimeoutError("the listener has not been told that the stream ended")


def edge_rates(edges: DataFrame, window: str = "10 seconds", slide: str | None = None, by: list[str] = ["endpoint_id", "edge_type"]) -> DataFrame:  # noqa: B006
    """(window_start, by, edges) of tumbling or, with ``slide``, sliding windows."""
    w = F.window("at", window, slide) if slide else F.window("at", window)
    return edges.groupBy(w.alias("w"), *by).agg(F.count("*").alias("edges")).select(F.col("w.start").alias("window_start"), *by, "edges")


def session_rates(edges: DataFrame, gap: str = "30 seconds", by: str = "endpoint_id") -> DataFrame:
    """(start, end, by, edges) of sessions that a gap ends."""
    t = edges.groupBy(F.session_window("at", gap).alias("w"), by).agg(F.count("*").alias("edges"))
    return t.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "edges")


def drain(query: StreamingQuery, timeout_s: float | None = None) -> None:
    """Wait until a stream has taken all that is there, and raise what went wrong; with ``timeout_s`` one that still runs then is stopped and raises."""
    if timeout_s is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"the stream has not ended within {timeout_s} s; what it has written is a part only")
    if query.exception() is not None:
        raise query.exception()


def available_now(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> StreamingQuery:
    """Run a stream over what is there into a table in memory, for tests and small looks."""
    w = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    return (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
