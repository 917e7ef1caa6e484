"""Analyst queries over nodes, edges, incidents and analyses. Every function takes and gives DataFrames.

nodes: label, uuid, name, endpoint_id, last_seen (+ detector columns); edges as
in ``normalize``; incidents: incident_id, status, severity, endpoint_id,
created_at, node_ids, title, description, rule_id; analyses: event_id,
provider, status, updated_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provspark.functions import ids
from provspark.operators.graph import k_hop, k_hop_edges

# How telling an action is, most telling first.
SIGNAL_RANK = {
    "EXEC": 0, "EXECUTE": 0, "FORK": 1, "CONNECT": 2, "SEND": 3, "RECEIVE": 4, "WRITE": 5, "DELETE": 5, "LOAD": 6, "MODIFY_REG": 6, "RENAME": 7,
    "READ": 8, "MMAP": 9, "MPROTECT": 9, "ACCESS": 9,
}


def node_counts(nodes: DataFrame, edges: DataFrame, incidents: DataFrame, without_label: str = "Meta", without_edge: str = "HAS") -> DataFrame:
    """(kind, n): nodes of each label, all edges, incidents and new incidents."""
    by_label = nodes.where(F.col("label") != without_label).groupBy(F.concat(F.lit("node:"), "label").alias("kind")).agg(F.count("*").alias("n"))
    e = edges.where(F.col("edge_type") != without_edge).agg(F.lit("edges").alias("kind"), F.count("*").alias("n"))
    i = incidents.agg(F.lit("incidents").alias("kind"), F.count("*").alias("n"))
    new = incidents.where("status = 'new'").agg(F.lit("new_incidents").alias("kind"), F.count("*").alias("n"))
    return by_label.union(e).union(i).union(new)


def incident_stats(incidents: DataFrame) -> DataFrame:
    """One row: total, counts of three statuses and four severities, in one pass."""
    count = lambda c, v: F.count_if(F.col(c) == v).alias(v)
    return incidents.agg(F.count("*").alias("total"), *[count("status", s) for s in ("new", "investigating", "resolved")], *[count("severity", s) for s in ("critical", "high", "medium", "low")])


def endpoint_summary(nodes: DataFrame, edges: DataFrame, incidents: DataFrame) -> DataFrame:
    """Endpoints that have a process: nodes, outgoing edges, incidents, new incidents, last seen; busiest first."""
    n = nodes.groupBy("endpoint_id").agg(F.count("*").alias("nodes"), F.max("last_seen").alias("last_seen"), F.count_if(F.upper("label") == "PROCESS").alias("_p")).where("_p > 0").drop("_p")
    e = edges.groupBy("endpoint_id").agg(F.count("*").alias("edges"))
    i = incidents.groupBy("endpoint_id").agg(F.count("*").alias("incidents"), F.count_if(F.col("status") == "new").alias("new_incidents"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return n.join(e, "endpoint_id", "left").join(i, "endpoint_id", "left").select("endpoint_id", "nodes", zero("edges"), zero("incidents"), zero("new_incidents"), "last_seen").orderBy(F.desc("incidents"), F.desc("edges"), "endpoint_id")


def incident_filter(incidents: DataFrame, status: str | None = None, severity: str | None = None, rule_id: str | None = None, search: str | None = None) -> DataFrame:
    for column, value in (("status", status), ("severity", severity), ("rule_id", rule_id)):
        if value:
            incidents = incidents.where(F.col(column) == value)
    if search:
        found = lambda c: F.lower(F.coalesce(c, F.lit(""))).contains(search.lower())
        incidents = incidents.where(found("title") | found("description"))
    return incidents


def page(df: DataFrame, offset: int, limit: int, order: str = "created_at", key: str = "incident_id") -> DataFrame:
    """One page, newest first, with the total in every row."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(F.desc(order), key).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def recent_edges(edges: DataFrame, n: int) -> DataFrame:
    return edges.orderBy(F.desc("ts"), "event_id").limit(n)


def last_edges_window(edges: DataFrame, n: int = 20_000) -> DataFrame:
    """The last ``n`` edges: a top-n, so that no window over all edges is needed."""
    return recent_edges(edges, n)


def subgraph(edges: DataFrame, root: DataFrame, hops: int, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around the roots; at most ``limit`` edges a root."""
    e = k_hop_edges(edges, root, hops)
    kept = e.withColumn("_r", F.row_number().over(Window.partitionBy("root").orderBy("event_id"))).where(F.col("_r") <= limit).drop("_r")
    return k_hop(edges, root, hops), kept


def node_incidents(incidents: DataFrame) -> DataFrame:
    return incidents.select("incident_id", F.explode("node_ids").alias("uuid")).distinct()


def process_scores(nodes: DataFrame, incidents: DataFrame, n: int) -> DataFrame:
    """Processes by score with the number of incidents that hold them."""
    counts = node_incidents(incidents).groupBy("uuid").agg(F.countDistinct("incident_id").alias("incidents"))
    p = nodes.where("label = 'PROCESS' AND score IS NOT NULL").join(counts, "uuid", "left")
    return p.select("uuid", "name", "endpoint_id", "score", F.coalesce("incidents", F.lit(0)).alias("incidents")).orderBy(F.desc("score"), "uuid").limit(n)


def tactic_scores(scored: DataFrame, n: int) -> DataFrame:
    """The ``n`` best by score with their map of tactics: (uuid, name, score, top_tactic, tactic_scores).

    ``scored`` has uuid, name, score, top_tactic and tactic_scores (a JSON text
    or null); a text that is no map counts as empty, a missing top_tactic is
    the tactic of the greatest score.
    """
    told = F.coalesce(F.from_json("tactic_scores", "map<string,double>"), F.create_map().cast("map<string,double>"))
    best = F.element_at(F.array_sort(F.transform(F.map_entries(told), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))), 1)["k"]
    top = scored.where("score IS NOT NULL").orderBy(F.desc("score"), "uuid").limit(n)
    return top.select("uuid", F.coalesce("name", F.lit("")).alias("name"), "score", F.coalesce("top_tactic", best).alias("top_tactic"), told.alias("tactic_scores"))


def rule_clear(edges: DataFrame, incidents: DataFrame) -> DataFrame:
    """Edges neither end of which is in an incident: what a model found and the rules missed."""
    inside = node_incidents(incidents).select("uuid").distinct()
    free = edges.join(inside, edges["src_id"] == inside["uuid"], "left_anti")
    return free.join(inside, free["dst_id"] == inside["uuid"], "left_anti")


def with_analysis(edges: DataFrame, analyses: DataFrame) -> DataFrame:
    """``edges`` with analysis: ok, failed or none."""
    best = analyses.groupBy("event_id").agg(F.max(F.when(F.col("status") == "ok", 2).otherwise(1)).alias("_a"))
    return edges.join(best, "event_id", "left").withColumn("analysis", F.when(F.col("_a") == 2, "ok").when(F.col("_a") == 1, "failed").otherwise("none")).drop("_a")


def top_scored_edges(edges: DataFrame, limit: int) -> DataFrame:
    """The best row of each (src, dst, type), at most half of ``limit`` of a type, then the best ``limit``.

    Both windows follow grouped aggregates, so a busy pair or type is combined before it is shuffled.
    """
    rest = [c for c in edges.columns if c not in ("src_id", "dst_id", "edge_type")]
    best = edges.groupBy("src_id", "dst_id", "edge_type").agg(F.min_by(F.struct(*rest), F.struct((-F.col("score")).alias("s"), "event_id")).alias("b")).select("src_id", "dst_id", "edge_type", "b.*")
    rank = F.row_number().over(Window.partitionBy("edge_type").orderBy(F.desc("score"), "event_id"))
    return best.withColumn("_r", rank).where(F.col("_r") <= (limit + 1) // 2).drop("_r").orderBy(F.desc("score"), "event_id").limit(limit).select(*edges.columns)


def edge_findings(edges: DataFrame, incidents: DataFrame, analyses: DataFrame, limit: int = 50, min_score: float = 0.0, clear_of_rules: bool = False, analysis: str | None = None) -> DataFrame:
    """Scored edges for triage. Filters apply before the caps, so that rare types keep their place.

    ``analysis``: ok, failed, none, or any (ok or failed).
    """
    scored = edges.where((F.col("quality") == "full") & (F.col("score") >= min_score))
    if clear_of_rules:
        scored = rule_clear(scored, incidents)
    told = with_analysis(scored, analyses)
    if analysis == "any":
        told = told.where("analysis <> 'none'")
    elif analysis:
        told = told.where(F.col("analysis") == analysis)
    return top_scored_edges(told, limit)


def edge_by_event(edges: DataFrame, event_id: str) -> DataFrame:
    return edges.where(F.col("event_id") == event_id).limit(1)


def edge_score_summary(edges: DataFrame, alert: float = 0.85) -> DataFrame:
    s = F.col("score")
    return edges.where(s.isNotNull()).agg(F.count("*").alias("scored"), F.avg(s).alias("mean_score"), F.count_if(s >= alert).alias("alerts"), F.count_if(F.col("quality") == "degraded").alias("degraded"))


def process_score_summary(nodes: DataFrame) -> DataFrame:
    s = F.col("score")
    return nodes.where(s.isNotNull()).agg(F.count("*").alias("scored"), F.avg(s).alias("mean_score"), F.max(s).alias("max_score"), F.count_if(s >= 0.5).alias("suspicious"))


def latest_analysis(analyses: DataFrame) -> DataFrame:
    """One row for each (event_id, provider): the latest."""
    rest = [c for c in analyses.columns if c not in ("event_id", "provider")]
    return analyses.groupBy("event_id", "provider").agg(F.max_by(F.struct(*rest), F.struct("updated_at", "status")).alias("a")).select("event_id", "provider", "a.*")


def detector_summary(nodes: DataFrame) -> DataFrame:
    """Scored nodes and seeds of two detectors (a_seed, b_score, b_seed) by label, and in all (label ALL)."""
    count = lambda c: F.count_if(c)
    a, b = F.coalesce(F.col("a_seed") == 1, F.lit(False)), F.coalesce(F.col("b_seed") == 1, F.lit(False))
    t = nodes.rollup("label").agg(
        F.grouping("label").alias("_g"), count(F.col("a_seed").isNotNull()).alias("a_scored"), count(a).alias("a_seeds"),
        count(F.col("b_score").isNotNull()).alias("b_scored"), count(b).alias("b_seeds"), count(a & b).alias("both"),
    )
    return t.withColumn("label", F.when(F.col("_g") == 1, "ALL").otherwise(F.col("label"))).withColumn("active", ((F.col("a_scored") > 0) | (F.col("b_scored") > 0)).cast("int")).drop("_g")


def detector_comparison(nodes: DataFrame, limit: int, seeds_only: bool = False) -> DataFrame:
    """Nodes by agreement (both, b only, a only, none), then score, label, name."""
    a, b = F.coalesce(F.col("a_seed") == 1, F.lit(False)), F.coalesce(F.col("b_seed") == 1, F.lit(False))
    order = F.when(a & b, 0).when(b, 1).when(a, 2).otherwise(3)
    t = nodes.withColumn("agreement", F.when(a & b, "both").when(b, "b_only").when(a, "a_only").otherwise("none"))
    if seeds_only:
        t = t.where("agreement <> 'none'")
    return t.orderBy(order, F.desc_nulls_last("b_score"), "label", "name", "uuid").limit(limit)


def normalise_incidents(rules: DataFrame, models: DataFrame) -> DataFrame:
    """Rule incidents and model analyses (event_id, hypothesis, mitre, confidence word, created_ms) in one form."""
    cols = ["incident_id", "source", "title", "severity", "status", "confidence", "mitre_technique", "created_at"]
    a = rules.select("incident_id", "source", "title", "severity", "status", F.col("confidence").cast("double").alias("confidence"), "mitre_technique", F.col("created_at").cast("long").alias("created_at"))
    c = ids.confidence_number(F.col("confidence"))
    b = models.select(
        F.col("event_id").alias("incident_id"), F.lit("ml-llm").alias("source"), F.coalesce(ids.present(F.col("hypothesis")), F.lit("(no hypothesis)")).alias("title"), ids.severity_of(c).alias("severity"),
        F.lit("new").alias("status"), c.alias("confidence"), F.col("mitre").alias("mitre_technique"), (F.col("created_ms") * 1_000_000).alias("created_at"),
    )
    return a.select(*cols).unionByName(b.select(*cols))


def collapse_edges(edges: DataFrame, by: list[str] = ["src_id", "edge_type", "dst_id"]) -> DataFrame:  # noqa: B006
    """Repeated edges once, with their number."""
    return edges.groupBy(*by).agg(F.count("*").alias("times"))


def signal_rank(edge_type: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SIGNAL_RANK.items() for x in kv]), edge_type), F.lit(9))


def signal_edges(edges: DataFrame, by: str, n: int = 25) -> DataFrame:
    """(by, src_name, edge_type, dst_name, times, place, more): the most telling distinct edges of each group, and how many are left out."""
    grouped = edges.groupBy(by, "src_name", "edge_type", "dst_name").agg(F.count("*").alias("times"))
    order = Window.partitionBy(by).orderBy(signal_rank(F.col("edge_type")), F.desc("times"), "src_name", "edge_type", "dst_name")
    t = grouped.withColumn("place", F.row_number().over(order)).withColumn("more", F.greatest(F.count("*").over(Window.partitionBy(by)) - n, F.lit(0)))
    return t.where(F.col("place") <= n)


def prune_alerts(edges: DataFrame, alerts: DataFrame, cap1: int = 40, cap2: int = 20, fold_over: int = 3) -> DataFrame:
    """Edges of many alerts' neighbourhoods, thinned out: (alert_id, tier, columns, fold, any_alert, samples).

    ``edges`` has alert_id, event_id, src_id, dst_id, types, names, score; an
    alert its event_id, src_id, dst_id. Tier 0 is the alert's own edge, 1
    touches one of its ends, 2 is the rest. In tiers 1 and 2, more than
    ``fold_over`` edges of one (source type, action, target type) become one
    with their number and three target names; then each tier is capped.
    """
    own = alerts.select("alert_id", F.col("event_id").alias("_e"), F.col("src_id").alias("_s"), F.col("dst_id").alias("_d"))
    t = edges.join(own, "alert_id")
    touch = F.col("src_id").isin(F.col("_s"), F.col("_d")) | F.col("dst_id").isin(F.col("_s"), F.col("_d"))
    t = t.withColumn("tier", F.when(F.col("event_id") == F.col("_e"), 0).when(touch, 1).otherwise(2)).drop("_e", "_s", "_d")
    sign = ["alert_id", "tier", "src_type", "edge_type", "dst_type"]
    group, order = Window.partitionBy(*sign), Window.partitionBy(*sign).orderBy("ts", "event_id")
    t = t.withColumn("fold", F.count("*").over(group)).withColumn("_i", F.row_number().over(order))
    samples = F.array_compact(F.collect_list(F.when(F.col("_i") <= 3, F.nullif("dst_name", F.lit("")))).over(group))
    t = t.withColumn("any_alert", F.max("is_alert").over(group)).withColumn("samples", samples)
    t = t.where((F.col("tier") == 0) | (F.col("fold") <= fold_over) | (F.col("_i") == 1))
    rank = F.row_number().over(Window.partitionBy("alert_id", "tier").orderBy(F.desc("is_alert"), F.desc(F.coalesce("score", F.lit(0.0))), "event_id"))
    return t.withColumn("_r", rank).where((F.col("tier") == 0) | ((F.col("tier") == 1) & (F.col("_r") <= cap1)) | ((F.col("tier") == 2) & (F.col("_r") <= cap2))).drop("_i", "_r")


#: Most techniques that alerts are held against.
MOST_TECHNIQUES = 10_000


def technique_candidates(alerts: DataFrame, techniques: DataFrame, most: int = 6) -> DataFrame:
    """(alert_id, technique, points, place): 3 for the edge type, 2 for the sourcetype, 2 for each word found.

    ``alerts`` has alert_id, edge_type, sourcetype, words (text). The table of
    techniques is a fixed list of tens of rows.
    """
    if techniques.limit(MOST_TECHNIQUES + 1).count() > MOST_TECHNIQUES:
        raise ValueError(f"more than {MOST_TECHNIQUES} techniques: every alert is held against each of them")
    hay = F.lower("words")
    points = (
        F.when(F.array_contains("edges", F.col("edge_type")), 3).otherwise(0) + F.when(F.array_contains("sourcetypes", F.col("sourcetype")), 2).otherwise(0)
        + 2 * F.size(F.filter("keywords", lambda k: F.contains(hay, k)))
    )
    t = alerts.crossJoin(F.broadcast(techniques)).withColumn("points", points).where("points > 0")
    place = F.row_number().over(Window.partitionBy("alert_id").orderBy(F.desc("points"), "id"))
    return t.withColumn("place", place).where(F.col("place") <= most).select("alert_id", F.col("id").alias("technique"), "name", "tactic", "points", "place")


def verdict_overlap(a: DataFrame, b: DataFrame, key: str = "node") -> DataFrame:
    """One row: both, a_only, b_only and their Jaccard index."""
    t = a.select(key, F.lit(1).alias("a")).distinct().join(b.select(key, F.lit(1).alias("b")).distinct(), key, "full")
    n = lambda c: F.count_if(c)
    x, y = F.col("a").isNotNull(), F.col("b").isNotNull()
    return t.agg(n(x & y).alias("both"), n(x & ~y).alias("a_only"), n(~x & y).alias("b_only"), (n(x & y) / F.count("*")).alias("jaccard"))


def split_leak(train: DataFrame, test: DataFrame, content: list[str]) -> DataFrame:
    """One row: test rows, and how many of them have a content that occurs in training."""
    key = lambda t: t.withColumn("_h", ids.content_hash(*[F.col(c) for c in content]))
    seen = key(train).select("_h").distinct().withColumn("_in", F.lit(1))
    return key(test).join(seen, "_h", "left").agg(F.count("*").alias("rows"), F.count("_in").alias("leaked"))


def score_join(scores: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scored edges, orphans): scores without an edge are kept apart."""
    return edges.join(scores, "event_id"), scores.join(edges, "event_id", "left_anti")


def alert_nodes(alerts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``alerts`` with what is known of their node."""
    return alerts.join(nodes.select(F.col("uuid").alias("node_id"), F.col("name").alias("node_name"), F.col("label").alias("node_label")), "node_id", "left")


def similar_neighbourhood(nodes: DataFrame, stored: DataFrame, size: int, threshold: float = 0.5) -> DataFrame:
    """(node, label, embedding): a stored embedding of the label where neighbour names agree enough, else zeros.

    ``nodes`` has node, label, names; ``stored`` label, names, embedding (one a label).
    """
    s = stored.select("label", F.col("names").alias("_n"), F.col("embedding").alias("_e"))
    t = nodes.join(s, "label", "left")
    jaccard = F.size(F.array_intersect("names", "_n")) / F.size(F.array_union("names", "_n"))
    zero = F.array_repeat(F.lit(0.0), size)
    return t.select("node", "label", F.when(jaccard >= threshold, F.col("_e")).otherwise(zero).alias("embedding"))
