"""Detection rules over edges: one-edge selections and ordered sequences, and the incidents they raise."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provspark.operators.graph import written

WINDOW_S = 300


def edge_condition(c: dict[str, Any]) -> Column:
    """A condition {subject_type, subject_re, edge, object_type, object_re} as a column; what is missing matches all."""
    tests = []
    for end, side in (("subject", "src"), ("object", "dst")):
        if c.get(f"{end}_type"):
            tests.append(F.col(f"{side}_type") == c[f"{end}_type"])
        if c.get(f"{end}_re"):
            tests.append(F.coalesce(F.col(f"{side}_name"), F.lit("")).rlike("(?i)" + c[f"{end}_re"]))
    if c.get("edge"):
        tests.append(F.col("edge_type").isin([c["edge"]] if isinstance(c["edge"], str) else list(c["edge"])))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def match_selection(edges: DataFrame, rules: list[dict[str, Any]]) -> DataFrame:
    """Firings of the one-edge rules: one scan, an array of the rules each edge satisfies, exploded."""
    single = [r for r in rules if len(r["steps"]) == 1]
    hits = F.array(*[F.when(edge_condition(r["steps"][0]), F.lit(r["id"])) for r in single]).cast("array<string>")
    return edges.withColumn("rule_id", F.explode(F.filter(hits, lambda x: x.isNotNull()))).select(
        "rule_id", F.col("src_id").alias("root"), F.col("ts").alias("fired_at"), F.col("event_id").alias("last_event_id"), "endpoint_id",
        F.col("src_name").alias("subject_name"), F.array("event_id").alias("event_ids"), F.array_distinct(F.array("src_id", "dst_id")).alias("node_ids"),
    )


def sequences(rules: list[dict[str, Any]]) -> list[dict[str, Any]]:
    return [r for r in rules if len(r["steps"]) > 1]


def step_marks(many: list[dict[str, Any]]) -> Column:
    """array<struct<rule int, mask int>>: for each sequence rule (by its place in ``many``) the steps that an edge can serve, as bits."""
    mask = lambda r: reduce(lambda a, b: a + b, [F.when(edge_condition(c), 1 << k).otherwise(0) for k, c in enumerate(r["steps"])])
    every = [F.struct(F.lit(i).alias("rule"), mask(r).cast("int").alias("mask")) for i, r in enumerate(many)]
    return F.filter(F.array(*every), lambda m: m["mask"] > 0)


EDGE_COLUMNS = ["event_id", "ts", "endpoint_id", "src_id", "src_name", "dst_id", "dst_type"]


def _advance(partials: DataFrame, marked: DataFrame, step: int) -> DataFrame:
    """``partials`` of which those with ``step`` steps done take the next edge that serves one more, if it comes within the window.

    That edge is the first after a partial's last one, at its active subject.
    Both sides meet by (rule, subject, slot), a slot being as long as the
    window; an edge counts in its own slot and the one before, so a busy
    subject lies in as many groups as its time has slots.
    """
    able = marked.where(F.col("mask").bitwiseAND(1 << step) > 0)
    active = F.when(F.col("dst_type") == "PROCESS", F.col("dst_id")).otherwise(F.col("src_id"))
    edge = F.struct("at", active.alias("node"), F.struct("event_id", "src_id", "dst_id").alias("hop"), "endpoint_id", "src_name")
    offered = able.select("rule", F.col("src_id").alias("node"), F.explode(F.array(F.col("slot"), F.col("slot") - 1)).alias("slot"), "at", edge.alias("edge"))
    both = partials.unionByName(offered, allowMissingColumns=True)
    later = Window.partitionBy("rule", "node", "slot").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("next", F.last("edge", ignorenulls=True).over(later)).where("edge IS NULL").drop("edge")
    moves = (F.col("done") == step) & (F.col("steps") > step) & (F.col("next.at.ts") - F.col("at.ts") <= F.col("window"))
    moved = {c: F.when(moves, F.col(f"next.{c}")).otherwise(F.col(c)) for c in ("node", "at", "endpoint_id", "src_name")}
    return found.withColumn("moves", F.coalesce(moves, F.lit(False))).withColumns({
        **moved, "slot": F.when(F.col("moves"), F.floor(F.col("next.at.ts") / F.col("window"))).otherwise(F.col("slot")),
        "hops": F.when(F.col("moves"), F.concat("hops", F.array("next.hop"))).otherwise(F.col("hops")), "done": F.col("done") + F.col("moves").cast("int"),
    }).drop("next", "moves")


def _per_rule(values: list[int]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.col("rule") + 1)


def _widths(many: list[dict[str, Any]]) -> list[int]:
    return [(r.get("window") or WINDOW_S) * 1_000_000_000 for r in many]


def _marked(edges: DataFrame, many: list[dict[str, Any]]) -> DataFrame:
    """The edges that serve steps, a row a rule, with ``at`` (their place in the order) and the slot of their time."""
    marked = edges.withColumn("ts", F.coalesce("ts", F.lit(0)).cast("long")).select(*EDGE_COLUMNS, F.explode(step_marks(many)).alias("m"))
    at = F.struct("ts", "event_id", F.monotonically_increasing_id().alias("n"))
    marked = marked.select(*EDGE_COLUMNS, "m.rule", "m.mask", at.alias("at")).withColumn("slot", F.floor(F.col("ts") / _per_rule(_widths(many))))
    return written(marked, "marked")


def _followed(marked: DataFrame, many: list[dict[str, Any]], live: DataFrame | None = None) -> DataFrame:
    """Every possible start, and every partial of ``live``, as far as the marked edges take it."""
    steps = [len(r["steps"]) for r in many]
    active = F.when(F.col("dst_type") == "PROCESS", F.col("dst_id")).otherwise(F.col("src_id"))
    partials = marked.where(F.col("mask").bitwiseAND(1) > 0).select(
        "rule", F.col("src_id").alias("root"), F.col("at").alias("start"), active.alias("node"), "slot", "at", "endpoint_id", "src_name",
        F.array(F.struct("event_id", "src_id", "dst_id")).alias("hops"), F.lit(1).alias("done"), _per_rule(steps).alias("steps"), _per_rule(_widths(many)).alias("window"),
    )
    if live is not None:
        partials = partials.unionByName(live)
    for step in range(1, max(steps, default=1)):
        partials = _advance(partials, marked, step)
    return written(partials, "followed")


def _counting(followed: DataFrame) -> DataFrame:
    """(rule, root, n, fires) of the starts that come when no partial of their root lives; ``n`` is the start's own number.

    A pause longer than a partial can live parts the starts of a root; slots
    are that long, so it lies between slots only.
    """
    life = F.col("window") * F.col("steps")
    slotted = followed.withColumn("slot", F.floor(F.col("start.ts") / life))
    slots = slotted.groupBy("rule", "root", "slot").agg(F.min("start.ts").alias("first"), F.max("start.ts").alias("last"), F.first(life).alias("life"))
    by = Window.partitionBy("rule", "root").orderBy("slot")
    pause = F.coalesce(F.col("first") - F.lag("last").over(by) > F.col("life"), F.lit(True)).cast("int")
    stretch = slots.withColumn("pause", pause).select("rule", F.col("root").alias("_root"), "slot", F.sum("pause").over(by).alias("stretch"))
    light = slotted.select("rule", "root", "slot", "start", (F.col("done") == F.col("steps")).alias("fires"), "at", "window")
    starts = light.join(stretch, (light["rule"] == stretch["rule"]) & (light["slot"] == stretch["slot"]) & light["root"].eqNullSafe(stretch["_root"])).select(
        light["rule"], "root", "stretch", F.col("start.ts").alias("ts"), F.col("start.event_id").alias("event_id"), F.col("start.n").alias("n"),
        "fires", F.col("at.ts").alias("end_ts"), F.col("at.event_id").alias("end_id"), F.col("at.n").alias("end_n"), "window",
    )

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, live = None, None
        for x in batches:
            out = []
            for rule, root, part, ts, event, n, fires, end_ts, end_id, end_n, window in x.itertuples(index=False, name=None):
                if (rule, root, part) != key:
                    key, live = (rule, root, part), None
                # the edge that ends a partial by firing may start the next
                if live is None or (((ts, event, n) >= live[1:4]) if live[0] else ts - live[1] > window):
                    live = fires, end_ts, end_id, end_n
                    out.append((rule, root, n, fires))
            yield pd.DataFrame(out, columns=["rule", "root", "n", "fires"])

    dealt = starts.repartition("rule", "root", "stretch").sortWithinPartitions("rule", "root", "stretch", "ts", "event_id", "n")
    return dealt.mapInPandas(count, "rule int, root string, n long, fires boolean")


def _of(followed: DataFrame, counting: DataFrame) -> DataFrame:
    named = counting.select(F.col("rule").alias("_rule"), F.col("root").alias("_root"), F.col("n").alias("_n"))
    on = (followed["rule"] == named["_rule"]) & followed["root"].eqNullSafe(named["_root"]) & (followed["start"]["n"] == named["_n"])
    return followed.join(named, on).select(*followed.columns)


def _firings(done: DataFrame, many: list[dict[str, Any]]) -> DataFrame:
    names = F.element_at(F.array(*[F.lit(r["id"]) for r in many]), F.col("rule") + 1)
    nodes = F.array_distinct(F.flatten(F.transform("hops", lambda h: F.array(h["src_id"], h["dst_id"]))))
    return done.select(
        names.alias("rule_id"), "root", F.col("at.ts").alias("fired_at"), F.col("at.event_id").alias("last_event_id"), "endpoint_id", F.col("src_name").alias("subject_name"),
        F.transform("hops", lambda h: h["event_id"]).alias("event_ids"), nodes.alias("node_ids"),
    )


def match_sequence(edges: DataFrame, rules: list[dict[str, Any]]) -> DataFrame:
    """Firings of the sequence rules, in (ts, event_id) order.

    A partial's course depends on the edges alone, not on other partials: so
    every edge that can start one is followed, step by step, by joins with the
    edges that serve the next step, all subjects and times side by side. What
    remains is that a root has one live partial a rule: of its possible starts,
    each with the time until which it lives, those count that come when none is
    live. That fold streams sorted starts, apart for each rule, root and
    stretch of starts without a pause longer than a partial can live.
    """
    many = sequences(rules)
    followed = _followed(_marked(edges, many), many)
    return _firings(_of(followed.where("done = steps"), _counting(followed).where("fires")), many)


def continue_sequence(edges: DataFrame, rules: list[dict[str, Any]], live: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(firings, live partials) after ``edges``, which come no earlier than those that left ``live``.

    Batch after batch this gives what ``match_sequence`` gives over all edges.
    A partial stays live while an edge as late as the last could advance it.
    """
    many = sequences(rules)
    marked = _marked(edges, many)
    followed = _followed(marked, many, live)
    counting = written(_counting(followed), "counting")
    now = edges.agg(F.max("ts")).first()[0]
    left = _of(followed.where("done < steps"), counting.where("NOT fires"))
    if now is not None:
        left = left.where(F.col("at.ts") + F.col("window") >= now)
    # a root has one live partial a rule, so its number need not differ from others' any more
    left = left.withColumn("start", F.struct(F.col("start.ts").alias("ts"), F.col("start.event_id").alias("event_id"), F.lit(-1).cast("long").alias("n")))
    return _firings(_of(followed.where("done = steps"), counting.where("fires")), many), left


def build_incidents(firings: DataFrame, rules: DataFrame) -> DataFrame:
    """One incident for each (rule, root), as the latest firing left it. ``rules`` has rule_id, name, severity, mitre, description."""
    latest = firings.groupBy("rule_id", "root").agg(
        F.max_by(F.struct("fired_at", "last_event_id", "endpoint_id", "subject_name", "event_ids", "node_ids"), F.struct("fired_at", "last_event_id")).alias("f"), F.count("*").alias("fires")
    )
    title = F.concat(F.lit("["), F.coalesce("mitre", F.lit("?")), F.lit("] "), "name", F.when(F.length("f.subject_name") > 0, F.concat(F.lit(" — "), "f.subject_name")).otherwise(F.lit("")))
    return latest.join(rules, "rule_id").select(
        F.concat("rule_id", F.lit(":"), F.coalesce("root", F.lit("noroot"))).alias("incident_id"), "rule_id", "severity", F.lit("new").alias("status"), title.alias("title"),
        "description", F.col("mitre").alias("mitre_technique"), "f.endpoint_id", F.col("root").alias("root_node_id"), "f.event_ids", "f.node_ids", F.lit(1.0).alias("confidence"),
        F.col("f.fired_at").alias("created_at"), "fires", F.lit("").alias("notes"), F.lit("rule-engine").alias("source"),
    )


def set_incident_status(incidents: DataFrame, updates: DataFrame) -> DataFrame:
    """``incidents`` with the status of ``updates`` (incident_id, status, notes); empty notes leave the old ones."""
    u = updates.select("incident_id", F.col("status").alias("_status"), F.col("notes").alias("_notes"))
    t = incidents.join(u, "incident_id", "left")
    return t.withColumn("status", F.coalesce("_status", "status")).withColumn("notes", F.coalesce(F.nullif("_notes", F.lit("")), "notes")).drop("_status", "_notes").select(*incidents.columns)


def dedup_alerts(alerts: DataFrame, window_s: int = 300) -> DataFrame:
    """Alerts (key, ts ns, ...) of which the first of each window stays, with ``suppressed``, how many it stands for.

    A window is anchored at its first alert, so each key runs in order; a gap
    longer than the window always starts anew. Only (key, ts, count) of the
    distinct times are folded, as a stream of sorted rows; of alerts of one
    key and time the first by the other columns stays.
    """
    width = window_s * 1_000_000_000
    # ts by slots as long as the window: longer gaps lie between slots only
    slotted = alerts.groupBy("key", "ts").agg(F.count("*").alias("n")).withColumn("slot", F.floor(F.col("ts") / width))
    slots = slotted.groupBy("key", "slot").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    by = Window.partitionBy("key").orderBy("slot")
    gap = F.coalesce(F.col("first") - F.lag("last").over(by) > width, F.lit(True)).cast("int")
    stretch = slots.withColumn("gap", gap).select(F.col("key").alias("_k"), F.col("slot").alias("_s"), F.sum("gap").over(by).alias("stretch"))
    parted = slotted.join(stretch, slotted["key"].eqNullSafe(stretch["_k"]) & slotted["slot"].eqNullSafe(stretch["_s"])).select("key", "stretch", "ts", "n")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list | None = None  # the open window: key, stretch, anchor, alerts
        for x in batches:
            out = []
            for key, part, ts, n in zip(x["key"], x["stretch"], x["ts"], x["n"], strict=True):
                if held is not None and held[:2] == [key, part] and ts - held[2] <= width:
                    held[3] += n
                else:
                    if held is not None:
                        out.append((held[0], held[2], held[3] - 1))
                    held = [key, part, ts, n]
            yield pd.DataFrame(out, columns=["_k", "_t", "suppressed"])
        if held is not None:
            yield pd.DataFrame([(held[0], held[2], held[3] - 1)], columns=["_k", "_t", "suppressed"])

    kind = alerts.schema["key"].dataType.simpleString()
    anchors = parted.repartition("key", "stretch").sortWithinPartitions("key", "stretch", "ts").mapInPandas(fold, f"_k {kind}, _t long, suppressed long")
    first = alerts.groupBy("key", "ts").agg(F.min(F.struct(*alerts.columns)).alias("_a"))
    joined = first.join(anchors, first["key"].eqNullSafe(anchors["_k"]) & (first["ts"] == anchors["_t"]))
    return joined.select("_a.*", "suppressed")


def cap_per_run(alerts: DataFrame, cap: int = 50, order: str = "score") -> DataFrame:
    return alerts.orderBy(F.desc(order)).limit(cap)


def rules_frame(spark: Any, rules: list[dict[str, Any]]) -> DataFrame:
    rows = [(r["id"], r["name"], r["severity"], r.get("mitre"), r.get("description", "")) for r in rules]
    return spark.createDataFrame(rows, "rule_id string, name string, severity string, mitre string, description string")
