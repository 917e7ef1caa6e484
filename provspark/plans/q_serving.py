"""Rules, incidents and the analyst queries."""

from __future__ import annotations

import uuid

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.operators import graph as g
from provspark.operators import reports
from provspark.operators import rules as r
from provspark.plans import serving
from provspark.plans.adapt import PROV, edges, load
from provspark.plans.q_graph import NODES
from provspark.plans.registry import query
from provspark.sources.config import TECHNIQUES, load_iocs, load_techniques, rule_library, technique_library

STATUS = ["new", "investigating", "resolved", "false_positive"]
SEVERITY = ["critical", "high", "medium", "low"]


def order_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents from the order table: one an order, at an endpoint of the event stream, holding two processes."""
    o = load(spark, sf_dir, "orders")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("o_orderkey") % len(xs) + 1).cast("int"))
    return o.select(
        F.concat(F.lit("i"), "o_orderkey").alias("incident_id"), pick(STATUS).alias("status"), pick(SEVERITY[:3]).alias("severity"), F.concat(F.lit("host"), F.col("o_custkey") % 9).alias("endpoint_id"),
        F.concat(F.lit("Order "), "o_orderpriority").alias("title"), F.lit("d").alias("description"), F.concat(F.lit("rule"), F.col("o_orderkey") % 3).alias("rule_id"), F.col("o_orderkey").alias("created_at"),
        F.array(F.concat(F.lit("proc:"), F.col("o_custkey") % 40), F.concat(F.lit("proc:"), F.col("o_custkey") % 7)).alias("node_ids"),
    )


INCIDENTS = """incidents AS (SELECT 'i' || o_orderkey AS incident_id, ['new', 'investigating', 'resolved', 'false_positive'][o_orderkey % 4 + 1] AS status, ['critical', 'high', 'medium'][o_orderkey % 3 + 1] AS severity,
  'host' || (o_custkey % 9) AS endpoint_id, 'Order ' || o_orderpriority AS title, 'd' AS description, 'rule' || (o_orderkey % 3) AS rule_id, o_orderkey AS created_at, ['proc:' || (o_custkey % 40), 'proc:' || (o_custkey % 7)] AS node_ids FROM orders)"""


def scored_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).withColumn("quality", F.when(F.col("size") % 4 == 0, "degraded").otherwise("full")).withColumn("score", F.round(F.col("size") / 100, 2))


SCORED = "scored AS (SELECT * REPLACE (round(size / 100, 2) AS score), CASE WHEN size % 4 = 0 THEN 'degraded' ELSE 'full' END AS quality FROM prov)"


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir).where("size % 3 <> 0")
    return e.select("event_id", F.concat(F.lit("p"), F.col("size") % 2).alias("provider"), F.when(F.col("size") % 5 == 0, "failed").otherwise("ok").alias("status"), F.col("ts").alias("updated_at"))


ANALYSES = "analyses AS (SELECT event_id, 'p' || (size % 2) AS provider, CASE WHEN size % 5 = 0 THEN 'failed' ELSE 'ok' END AS status, ts AS updated_at FROM prov WHERE size % 3 <> 0)"


def detected_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = g.upsert_nodes(edges(spark, sf_dir))
    x = F.length("uuid") + F.length("name")
    t = F.expr("first_seen div 1000 % 97")
    return n.select("label", "uuid", "name", "endpoint_id", "last_seen", F.when(x % 3 != 0, (t % 2).cast("int")).alias("a_seed"), F.when(x % 5 != 0, t / 100).alias("b_score"), F.when(x % 5 != 0, (t > 48).cast("int")).alias("b_seed"), F.when(x % 7 != 0, t / 97).alias("score"))


DETECTED = f"""{NODES}, detected AS (SELECT label, uuid, name, endpoint_id, last_seen, CASE WHEN x % 3 <> 0 THEN (t % 2)::INTEGER END AS a_seed, CASE WHEN x % 5 <> 0 THEN t / 100 END AS b_score, CASE WHEN x % 5 <> 0 THEN (t > 48)::INTEGER END AS b_seed, CASE WHEN x % 7 <> 0 THEN t / 97 END AS score
  FROM (SELECT *, len(uuid) + len(name) AS x, (first_seen // 1000) % 97 AS t FROM nodes))"""


@query(f"WITH {PROV}, {NODES}, {INCIDENTS} SELECT 'node:' || label AS kind, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT 'edges', count(*) FROM prov UNION ALL SELECT 'incidents', count(*) FROM incidents UNION ALL SELECT 'new_incidents', count(*) FROM incidents WHERE status = 'new'")
def q1_a1_graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return serving.node_counts(g.upsert_nodes(e), e, order_incidents(spark, sf_dir))


@query(f"WITH {INCIDENTS} SELECT incident_id, title, status, created_at, (SELECT count(*) FROM incidents WHERE severity = 'high' AND contains(lower(title), 'urgent')) AS total FROM incidents WHERE severity = 'high' AND contains(lower(title), 'urgent') ORDER BY created_at DESC, incident_id LIMIT 10 OFFSET 5")
def q2_w7_n2_incident_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = serving.incident_filter(order_incidents(spark, sf_dir), severity="high", search="Urgent")
    return serving.page(found, 5, 10).select("incident_id", "title", "status", "created_at", "total")


@query(f"WITH {INCIDENTS} SELECT count(*) AS total, {', '.join(f'count(*) FILTER (status = {chr(39)}{s}{chr(39)}) AS {s}' for s in STATUS[:3])}, {', '.join(f'count(*) FILTER (severity = {chr(39)}{s}{chr(39)}) AS {s}' for s in SEVERITY)} FROM incidents")
def q3_a2_incident_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.incident_stats(order_incidents(spark, sf_dir))


@query(f"""WITH {PROV}, {NODES}, {INCIDENTS} SELECT n.endpoint_id, nodes, coalesce(edges, 0) AS edges, coalesce(incidents, 0) AS incidents, coalesce(new_incidents, 0) AS new_incidents, last_seen
  FROM (SELECT endpoint_id, count(*) AS nodes, max(last_seen) AS last_seen FROM nodes GROUP BY endpoint_id HAVING count(*) FILTER (label = 'PROCESS') > 0) n LEFT JOIN (SELECT endpoint_id, count(*) AS edges FROM prov GROUP BY endpoint_id) e USING (endpoint_id)
  LEFT JOIN (SELECT endpoint_id, count(*) AS incidents, count(*) FILTER (status = 'new') AS new_incidents FROM incidents GROUP BY endpoint_id) i USING (endpoint_id)""")
def q4_a3_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return serving.endpoint_summary(g.upsert_nodes(e), e, order_incidents(spark, sf_dir))


@query(f"""WITH {PROV}, near AS (SELECT 'proc:3' AS root, 'proc:3' AS node UNION SELECT 'proc:3', dst_id FROM prov WHERE src_id = 'proc:3' UNION SELECT 'proc:3', src_id FROM prov WHERE dst_id = 'proc:3')
SELECT * FROM (SELECT DISTINCT root, event_id, src_id, dst_id, edge_type FROM prov JOIN near ON node IN (src_id, dst_id)) QUALIFY row_number() OVER (PARTITION BY root ORDER BY event_id) <= 500""")
def q5_d4_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.subgraph(edges(spark, sf_dir), spark.createDataFrame([("proc:3",)], "node string"), 2)[1]


@query(f"WITH {PROV} SELECT event_id, ts, edge_type FROM prov ORDER BY ts DESC, event_id LIMIT 100")
def q6_recent_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.recent_edges(edges(spark, sf_dir), 100).select("event_id", "ts", "edge_type")


@query(f"""WITH {PROV}, {DETECTED}, {INCIDENTS} SELECT uuid, name, endpoint_id, score, coalesce(n, 0) AS incidents FROM detected LEFT JOIN (SELECT unnest(node_ids) AS uuid, count(DISTINCT incident_id) AS n FROM incidents GROUP BY 1) USING (uuid)
WHERE label = 'PROCESS' AND score IS NOT NULL ORDER BY score DESC, uuid LIMIT 50""")
def q7_j7_n5_process_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.process_scores(detected_nodes(spark, sf_dir), order_incidents(spark, sf_dir), 50)


@query(f"""WITH {PROV}, s AS (SELECT src_id AS uuid, edge_type, count(*) AS n FROM prov GROUP BY ALL), t AS (SELECT uuid, max(n) AS score, arg_min(edge_type, (-n, edge_type)) AS top_tactic, count(*) AS tactics FROM s GROUP BY uuid)
SELECT uuid, score::DOUBLE AS score, top_tactic, tactics FROM t ORDER BY score DESC, uuid LIMIT 50""")
def n5_tactic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processes by their greatest tactic score, tactics parsed from JSON (here: how often each action)."""
    acts = edges(spark, sf_dir).groupBy(F.col("src_id").alias("uuid"), "edge_type").agg(F.count("*").alias("n"))
    per = acts.groupBy("uuid").agg(F.max("n").cast("double").alias("score"), F.to_json(F.map_from_entries(F.collect_list(F.struct("edge_type", "n")))).alias("tactic_scores"))
    t = serving.tactic_scores(per.withColumns({"name": F.lit(None).cast("string"), "top_tactic": F.lit(None).cast("string")}), 50)
    return t.select("uuid", "score", "top_tactic", F.size("tactic_scores").cast("long").alias("tactics"))


FINDINGS = """told AS (SELECT s.*, CASE WHEN ok THEN 'ok' WHEN ok IS NOT NULL THEN 'failed' ELSE 'none' END AS analysis FROM scored s LEFT JOIN (SELECT event_id, bool_or(status = 'ok') AS ok FROM analyses GROUP BY event_id) USING (event_id) WHERE quality = 'full' AND score >= 0.2),
  best AS (SELECT * FROM told {where} QUALIFY row_number() OVER (PARTITION BY src_id, dst_id, edge_type ORDER BY score DESC, event_id) = 1), capped AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY edge_type ORDER BY score DESC, event_id) <= 15)
SELECT event_id, src_id, dst_id, edge_type, score, analysis FROM capped ORDER BY score DESC, event_id LIMIT 30"""


@query(f"WITH {PROV}, {SCORED}, {ANALYSES}, " + FINDINGS.format(where=""))
def q8_n1_j8_edge_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = serving.edge_findings(scored_edges(spark, sf_dir), order_incidents(spark, sf_dir), analyses(spark, sf_dir), 30, 0.2)
    return t.select("event_id", "src_id", "dst_id", "edge_type", "score", "analysis")


@query(f"WITH {PROV}, {SCORED}, {ANALYSES}, inc AS (SELECT DISTINCT 'proc:' || (o_custkey % 7) AS uuid FROM orders), " + FINDINGS.format(where="WHERE analysis <> 'none' AND src_id NOT IN (SELECT uuid FROM inc) AND dst_id NOT IN (SELECT uuid FROM inc)"))
def q8_j5_j6_clear_of_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    inc = order_incidents(spark, sf_dir).withColumn("node_ids", F.slice("node_ids", 2, 1))
    t = serving.edge_findings(scored_edges(spark, sf_dir), inc, analyses(spark, sf_dir), 30, 0.2, clear_of_rules=True, analysis="any")
    return t.select("event_id", "src_id", "dst_id", "edge_type", "score", "analysis")


@query(f"WITH {PROV} SELECT event_id, src_id, dst_id FROM prov WHERE event_id = 'e7'")
def q9_edge_by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.edge_by_event(edges(spark, sf_dir), "e7").select("event_id", "src_id", "dst_id")


@query(f"WITH {PROV}, {SCORED}, {DETECTED} SELECT 'edges' AS kind, count(*) AS scored, round(avg(score), 9) AS mean_score, count(*) FILTER (score >= 0.85) AS alerts FROM scored UNION ALL SELECT 'processes', count(score), round(avg(score), 9), count(*) FILTER (score >= 0.5) FROM detected")
def q10_a4_score_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, p = serving.edge_score_summary(scored_edges(spark, sf_dir)), serving.process_score_summary(detected_nodes(spark, sf_dir))
    mean = F.round("mean_score", 9).alias("mean_score")
    return e.select(F.lit("edges").alias("kind"), "scored", mean, "alerts").union(p.select(F.lit("processes"), "scored", mean, "suspicious"))


@query(f"WITH {PROV}, {ANALYSES} SELECT event_id, provider, status, updated_at + 1 AS updated_at FROM analyses")
def q11_x6_latest_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = analyses(spark, sf_dir)
    return serving.latest_analysis(a.union(a.withColumn("updated_at", F.col("updated_at") + 1)))


@query(f"""WITH {PROV}, {DETECTED} SELECT coalesce(label, 'ALL') AS label, count(a_seed) AS a_scored, count(*) FILTER (a_seed = 1) AS a_seeds, count(b_score) AS b_scored, count(*) FILTER (b_seed = 1) AS b_seeds, count(*) FILTER (a_seed = 1 AND b_seed = 1) AS "both",
  (count(a_seed) > 0 OR count(b_score) > 0)::INTEGER AS active FROM detected GROUP BY ROLLUP (label)""")
def q12_a5_detector_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.detector_summary(detected_nodes(spark, sf_dir))


@query(f"""WITH {PROV}, {DETECTED}, t AS (SELECT *, CASE WHEN a_seed = 1 AND b_seed = 1 THEN 0 WHEN b_seed = 1 THEN 1 WHEN a_seed = 1 THEN 2 ELSE 3 END AS o FROM detected) SELECT uuid, ['both', 'b_only', 'a_only', 'none'][o + 1] AS agreement FROM t WHERE o < 3 ORDER BY o, b_score DESC NULLS LAST, label, name, uuid LIMIT 60""")
def q13_n4_detector_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.detector_comparison(detected_nodes(spark, sf_dir), 60, True).select("uuid", "agreement")


@query(f"""WITH {PROV}, {INCIDENTS} SELECT incident_id, 'rule-engine' AS source, severity, 1.0::DOUBLE AS confidence, created_at FROM incidents
UNION ALL SELECT event_id, 'ml-llm', CASE size % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'medium' ELSE 'low' END, [0.9, 0.6, 0.3][size % 3 + 1], size * 1000000 FROM prov WHERE label = 1""")
def q14_normalise_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = order_incidents(spark, sf_dir).withColumns({"source": F.lit("rule-engine"), "confidence": F.lit(1.0), "mitre_technique": F.lit(None).cast("string")})
    word = F.element_at(F.array(*map(F.lit, ["high", "medium", "low"])), (F.col("size") % 3 + 1).cast("int"))
    models = edges(spark, sf_dir).where("label = 1").select("event_id", F.lit("h").alias("hypothesis"), F.lit("T1").alias("mitre"), word.alias("confidence"), F.col("size").alias("created_ms"))
    return serving.normalise_incidents(rules, models).select("incident_id", "source", "severity", "confidence", "created_at")


@query(f"WITH {PROV}, {SCORED} SELECT event_id, src_id FROM scored WHERE size % 10 <> 3")
def j4_score_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    matched, orphans = serving.score_join(e.select("event_id", F.col("score").alias("s")), e.where("size % 10 <> 3").drop("score"))
    return matched.join(orphans.select("event_id"), "event_id", "left_anti").select("event_id", "src_id")


@query(f"WITH {PROV}, {NODES} SELECT event_id AS alert_id, dst_id AS node_id, n.name AS node_name, n.label AS node_label FROM prov LEFT JOIN nodes n ON n.uuid = dst_id AND n.label <> 'FILE' WHERE size % 9 = 0")
def j9_j10_alert_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    known = g.upsert_nodes(e).where("label <> 'FILE'")
    return serving.alert_nodes(e.where("size % 9 = 0").select(F.col("event_id").alias("alert_id"), F.col("dst_id").alias("node_id")), known)


@query(f"WITH {PROV} SELECT src_id, src_name, edge_type, dst_name, count(*) AS times FROM prov GROUP BY src_id, src_name, edge_type, dst_name QUALIFY row_number() OVER (PARTITION BY src_id ORDER BY CASE edge_type WHEN 'FORK' THEN 1 WHEN 'CONNECT' THEN 2 WHEN 'WRITE' THEN 5 WHEN 'DELETE' THEN 5 WHEN 'READ' THEN 8 ELSE 9 END, count(*) DESC, src_name, edge_type, dst_name) <= 5")
def n7_signal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.signal_edges(edges(spark, sf_dir), "src_id", 5).select("src_id", "src_name", "edge_type", "dst_name", "times")


def alert_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(alerts, edges around each alert)."""
    e = edges(spark, sf_dir)
    alerts = e.where("size % 50 = 7").select(F.col("event_id").alias("alert_id"), "event_id", "src_id", "dst_id", "edge_type", F.lit("x").alias("sourcetype"), F.concat_ws(" ", "src_name", "dst_name").alias("words"))
    around = g.alert_subgraph(e, alerts).select("alert_id", "event_id")
    return alerts, around.join(e, "event_id").withColumn("is_alert", (F.col("label") == 1).cast("int"))


#: ``kept`` has the edges around each alert that stay, ``n`` all of them.
PRUNED = f"""{PROV}, a AS (SELECT event_id AS alert_id, src_id AS s, dst_id AS d FROM prov WHERE size % 50 = 7), n AS (SELECT a.*, e.* FROM a JOIN prov e ON e.src_id IN (s, d) OR e.dst_id IN (s, d) QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY ts DESC, event_id) <= 200),
  t AS (SELECT *, CASE WHEN event_id = alert_id THEN 0 ELSE 1 END AS tier FROM n), f AS (SELECT *, count(*) OVER w AS fold, row_number() OVER (w ORDER BY ts, event_id) AS i FROM t WINDOW w AS (PARTITION BY alert_id, tier, src_type, edge_type, dst_type)),
  kept AS (SELECT * FROM f WHERE tier = 0 OR fold <= 3 OR i = 1 QUALIFY tier = 0 OR row_number() OVER (PARTITION BY alert_id, tier ORDER BY label DESC, score DESC, event_id) <= 40)"""


@query(f"WITH {PRUNED} SELECT alert_id, event_id, tier, fold FROM kept")
def n6_prune_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts, around = alert_edges(spark, sf_dir)
    return serving.prune_alerts(around, alerts).select("alert_id", "event_id", "tier", "fold")


def _techniques_sql() -> str:
    listed = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs or []) + "]::VARCHAR[]"
    rows = yaml.safe_load(TECHNIQUES.read_text(encoding="utf-8"))
    values = [f"('{t['id']}', '{t['name']}', '{t['tactic']}', {listed(t.get('edges'))}, {listed(t.get('sourcetypes'))}, {listed([k.lower() for k in t.get('keywords') or []])})" for t in rows]
    return "techniques(id, name, tactic, edges, sourcetypes, keywords) AS (VALUES " + ", ".join(values) + ")"


@query(f"""WITH {PROV}, {_techniques_sql()}, p AS (SELECT event_id AS alert_id, id, name, tactic, CASE WHEN list_contains(edges, edge_type) THEN 3 ELSE 0 END + CASE WHEN list_contains(sourcetypes, 'x') THEN 2 ELSE 0 END
  + 2 * len(list_filter(keywords, lambda k: contains(lower(src_name || ' ' || dst_name), k))) AS points FROM prov CROSS JOIN techniques WHERE size % 50 = 7),
  r AS (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY points DESC, id) AS place FROM p WHERE points > 0)
SELECT alert_id, string_agg('- ' || id || ' ' || name || ' (' || tactic || ')', chr(10) ORDER BY place) AS section FROM r WHERE place <= 6 GROUP BY alert_id""")
def j11_x2_techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Technique candidates of each alert as a section of text."""
    alerts, _ = alert_edges(spark, sf_dir)
    path, triggers = f"{g.shared_dir(spark)}/techniques-{uuid.uuid4().hex}", F.struct("edges", "sourcetypes", "keywords").alias("triggers")
    whole = technique_library(spark).agg(F.collect_list(F.struct("id", "name", "tactic", "desc", triggers)).alias("techniques"))  # a fixed list of tens
    whole.write.json(path)
    return reports.technique_section(serving.technique_candidates(alerts, load_techniques(spark, path)))


@query(f"""WITH {PRUNED}, k AS (SELECT *, tier > 0 AND fold > 3 AS folded FROM kept), e AS (SELECT alert_id, count(*) AS edges FROM n GROUP BY alert_id)
SELECT alert_id, concat_ws(chr(10), '## Flagged edge ' || alert_id, '## Edges', string_agg('  ' || src_name || '  --[' || edge_type || ']-->  ' || dst_name || CASE WHEN folded THEN '  x' || fold ELSE '' END, chr(10) ORDER BY tier, ts, event_id),
  '## Left out: ' || (any_value(edges) - sum(CASE WHEN folded THEN fold ELSE 1 END))::BIGINT) AS context FROM k JOIN e USING (alert_id) GROUP BY alert_id""")
def x1_alert_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text context of each alert."""
    alerts, around = alert_edges(spark, sf_dir)
    return reports.alert_context(alerts, serving.prune_alerts(around, alerts), around.groupBy("alert_id").agg(F.count("*").alias("edges")))


def _selection_sql() -> str:
    parts = []
    for rule in (x for x in rule_library() if len(x["steps"]) == 1):
        c = rule["steps"][0]
        tests = [f"edge_type IN ({', '.join(repr(e) for e in c['edge'])})", f"src_type = '{c['subject_type']}'", f"dst_type = '{c['object_type']}'"]
        for column, pattern in (("src_name", c["subject_re"]), ("dst_name", c["object_re"])):
            if pattern:
                tests.append(f"regexp_matches({column}, '{pattern}', 'i')")
        parts.append(f"SELECT '{rule['id']}' AS rule_id, event_id, src_id, ts, endpoint_id, src_name FROM prov WHERE {' AND '.join(tests)}")
    return "fired AS (" + " UNION ALL ".join(parts) + ")"


@query(f"WITH {PROV}, {_selection_sql()} SELECT rule_id, src_id AS root, event_id AS last_event_id, ts AS fired_at FROM fired")
def r1_match_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.match_selection(edges(spark, sf_dir), rule_library()).select("rule_id", "root", "last_event_id", "fired_at")


@query(f"WITH {PROV}, {_selection_sql()} SELECT rule_id || ':' || src_id AS incident_id, count(*) AS fires, max(ts) AS created_at FROM fired GROUP BY rule_id, src_id")
def r3_build_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = rule_library()
    return r.build_incidents(r.match_selection(edges(spark, sf_dir), rules), r.rules_frame(spark, rules)).select("incident_id", "fires", "created_at")


@query()
def r2_match_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Firings of the ordered rules; tests hold it against one machine over all edges."""
    return r.match_sequence(edges(spark, sf_dir), rule_library())


@query(f"WITH {INCIDENTS} SELECT incident_id, CASE WHEN created_at % 10 = 0 THEN 'resolved' ELSE status END AS status, CASE WHEN created_at % 20 = 0 THEN 'seen' ELSE 'old' END AS notes FROM incidents")
def r4_set_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = order_incidents(spark, sf_dir).withColumn("notes", F.lit("old"))
    updates = i.where("created_at % 10 = 0").select("incident_id", F.lit("resolved").alias("status"), F.when(F.col("created_at") % 20 == 0, "seen").otherwise("").alias("notes"))
    return r.set_incident_status(i, updates).select("incident_id", "status", "notes")


@query(f"""WITH RECURSIVE {PROV}, a AS (SELECT src_id AS key, ts FROM prov), f AS (SELECT key, min(ts) AS ts FROM a GROUP BY key UNION ALL SELECT f.key, (SELECT min(a.ts) FROM a WHERE a.key = f.key AND a.ts > f.ts + 300000000000) FROM f WHERE f.ts IS NOT NULL)
SELECT f.key, f.ts, (SELECT count(*) FROM a WHERE a.key = f.key AND a.ts BETWEEN f.ts AND f.ts + 300000000000) - 1 AS suppressed FROM f WHERE f.ts IS NOT NULL""")
def t1_dedup_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.dedup_alerts(edges(spark, sf_dir).select(F.col("src_id").alias("key"), "ts"))


@query(f"WITH {PROV} SELECT event_id, score FROM prov ORDER BY score DESC LIMIT 50")
def t2_cap_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.cap_per_run(edges(spark, sf_dir)).select("event_id", "score")


def _selection_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = rule_library()
    return r.build_incidents(r.match_selection(edges(spark, sf_dir), rules), r.rules_frame(spark, rules))


_RULES = "rules(rule_id, name, severity, mitre) AS (VALUES " + ", ".join(f"('{x['id']}', '{x['name']}', '{x['severity']}', '{x['mitre']}')" for x in rule_library()) + ")"
_LEVELS = {"critical": 14, "high": 12, "medium": 7, "low": 4, "informational": 3}


@query(f"""WITH {PROV}, {_selection_sql()}, {_RULES}, i AS (SELECT rule_id, src_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(src_name, (ts, event_id)) AS src_name FROM fired GROUP BY rule_id, src_id)
SELECT rule_id || ':' || src_id AS incident_id, concat_ws(chr(10), '# [' || mitre || '] ' || name || ' — ' || src_name, 'severity: ' || severity, 'technique: ' || mitre, 'events:', '  ' || event_id) AS context FROM i JOIN rules USING (rule_id)""")
def x3_incident_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.incident_context(_selection_incidents(spark, sf_dir))


def _clean_sql(c: str, length: int) -> str:
    return f"left(trim(regexp_replace(regexp_replace({c}, '[^\\x20-\\x7E]+', ' ', 'g'), '\\s+', ' ', 'g')), {length})"


def _escaped_sql(c: str) -> str:
    return f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _level_sql() -> str:
    return "CASE severity " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _LEVELS.items()) + " ELSE '7' END"


@query(f"""WITH {PROV}, {_selection_sql()}, {_RULES}, i AS (SELECT rule_id, src_id, arg_max(event_id, (ts, event_id)) AS event_id FROM fired GROUP BY rule_id, src_id),
  c AS (SELECT rule_id || ':' || src_id AS id, name, severity, mitre, edge_type, src_name FROM i JOIN rules USING (rule_id) JOIN prov USING (event_id, src_id)),
  x AS (SELECT *, 100000 + list_reduce(list_transform(string_split(sha1(id), ''), lambda d: instr('0123456789abcdef', d) - 1), lambda r, d: (r * 16 + d) % 9000, 0)::INTEGER AS rule_number FROM c)
SELECT id, rule_number, '<group name="provenance,sigma,">' || chr(10) || '  <rule id="' || rule_number || '" level="' || {_level_sql()} || '">' || chr(10) || '    <description>' || {_escaped_sql(_clean_sql('name', 250))} || '</description>'
  || chr(10) || '    <field name="EventType">' || {_escaped_sql(_clean_sql('edge_type', 200))} || '</field>' || chr(10) || '    <field name="Image">' || {_escaped_sql(_clean_sql('src_name', 200))} || '</field>'
  || chr(10) || '    <mitre><id>' || upper(string_split('attack.' || lower(mitre), '.')[-1]) || '</id></mitre>' || chr(10) || '    <options>no_full_log</options>' || chr(10) || '  </rule>' || chr(10) || '</group>' || chr(10) AS xml FROM x""")
def x4_x5_rule_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents, with the edges of their events, as sigma rules and manager XML."""
    return _exported(spark, sf_dir, _selection_incidents(spark, sf_dir))


def _exported(spark: SparkSession, sf_dir: str, incidents: DataFrame) -> DataFrame:
    i = incidents.join(r.rules_frame(spark, rule_library()).select("rule_id", F.col("name").alias("rule_name")), "rule_id")
    of = i.select("incident_id", F.explode("event_ids").alias("event_id")).join(edges(spark, sf_dir), "event_id")
    chain = of.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "edge_type", F.col("src_name").alias("subject_name")))).alias("matched_edges"))  # a rule's steps
    return reports.sigma_to_xml(reports.incidents_to_sigma(i.join(chain, "incident_id")))


@query()
def x3_x5_sequence_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-step incidents, each with all edges of its chain: context and manager XML; tests hold it against one machine."""
    rules = rule_library()
    incidents = g.written(r.build_incidents(r.match_sequence(edges(spark, sf_dir), rules), r.rules_frame(spark, rules)), "incidents")
    xml = _exported(spark, sf_dir, incidents).select(F.col("id").alias("incident_id"), "xml")
    return reports.incident_context(incidents).join(xml, "incident_id")


@query("SELECT 'a' AS id, count(*) AS hits FROM documents WHERE contains(lower(text), 'licensed under')")
def s14_ioc_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provspark.operators.splits import label_iocs

    raw = {"scenarios": [{"id": "a", "domains": ["Licensed Under", "blocked", "x"]}, {"id": "off", "enabled": False, "domains": ["the"]}], "labeling": {"match_categories": ["domains"], "blocklist_patterns": ["blocked"], "min_ioc_specificity": 4}}
    t = label_iocs(load(spark, sf_dir, "documents"), load_iocs(raw), "text", "doc_id").where("label = 1")
    return t.groupBy(F.col("scenario").alias("id")).agg(F.count("*").alias("hits"))
