"""Queries over the provenance graph, its joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.operators import graph as g
from provspark.operators import quality, scoring
from provspark.plans import serving
from provspark.plans.adapt import PROV, TRADE, edges, load, trade_edges
from provspark.plans.registry import query
from provspark.sources import cdm

BOTH = "both_ways AS (SELECT src_id AS node, dst_id AS nbr FROM prov WHERE src_id <> dst_id UNION SELECT dst_id, src_id FROM prov WHERE src_id <> dst_id)"
SEEN = """seen AS (SELECT src_type AS label, src_id AS uuid, src_name AS name, endpoint_id, ts, event_id, 0 AS role FROM prov
  UNION ALL SELECT dst_type, dst_id, dst_name, endpoint_id, ts, event_id, 1 FROM prov)"""
NODES = f"""{SEEN}, nodes AS (SELECT label, uuid, coalesce(
    arg_min(name, (ts, event_id, role)) FILTER (contains(name, ' ')), arg_min(name, (ts, event_id, role)) FILTER (NOT regexp_matches(name, '^[a-z]+:[0-9a-fA-F-]+$')),
    arg_max(name, (ts, event_id, role))) AS name, arg_min(endpoint_id, (ts, event_id, role)) AS endpoint_id, '{{}}' AS properties, min(ts) AS first_seen, max(ts) AS last_seen FROM seen GROUP BY label, uuid)"""


@query(f"WITH {PROV} SELECT event_id, edge_type, src_id, dst_id, ts, endpoint_id FROM prov WHERE event_id <> 'e0'")
def g1_upsert_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir).where("event_id <> 'e0'")
    stored = e.where("size % 3 = 0")
    return g.upsert_edges(e.union(e.where("size % 2 = 0")), stored).select("event_id", "edge_type", "src_id", "dst_id", "ts", "endpoint_id")


@query(f"WITH {PROV}, {NODES} SELECT * FROM nodes")
def g2_upsert_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.upsert_nodes(edges(spark, sf_dir))


@query(f"WITH {PROV}, {NODES} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM prov) AS edges")
def g3_graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return g.graph_stats(g.upsert_nodes(e), e)


@query(f"""WITH {PROV}, {BOTH}, h AS (SELECT 'proc:1' AS root, 'proc:1' AS node, 0 AS hop UNION ALL SELECT 'proc:2', 'proc:2', 0),
  h1 AS (SELECT DISTINCT root, nbr AS node FROM h JOIN both_ways USING (node)), h2 AS (SELECT DISTINCT root, b.nbr AS node FROM h1 JOIN both_ways b USING (node))
SELECT root, node, min(hop) AS hop FROM (SELECT * FROM h UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY root, node""")
def g4_k_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = spark.createDataFrame([("proc:1",), ("proc:2",)], "node string")
    return g.k_hop(edges(spark, sf_dir), roots, 2)


@query(f"""WITH {PROV}, a AS (SELECT event_id AS alert_id, src_id, dst_id FROM prov WHERE size % 50 = 7)
SELECT alert_id, event_id, ts, src_id, dst_id, edge_type FROM (SELECT DISTINCT a.alert_id, e.event_id, e.ts, e.src_id, e.dst_id, e.edge_type FROM a JOIN prov e ON e.src_id IN (a.src_id, a.dst_id) OR e.dst_id IN (a.src_id, a.dst_id))
QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY ts DESC, event_id) <= 20""")
def g5_alert_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return g.alert_subgraph(e, e.where("size % 50 = 7").select(F.col("event_id").alias("alert_id"), "src_id", "dst_id"), 20)


@query(f"""WITH {PROV}, {BOTH}, s AS (SELECT DISTINCT dst_id AS node FROM prov WHERE label = 1 AND size < 3), z AS (SELECT node FROM s SEMI JOIN both_ways USING (node)),
  one AS (SELECT DISTINCT nbr AS node FROM z JOIN both_ways USING (node)) SELECT node FROM z UNION SELECT node FROM one UNION SELECT nbr FROM one JOIN both_ways USING (node)""")
def g6_two_hop_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return g.two_hop_closure(e, e.where("label = 1 AND size < 3").select(F.col("dst_id").alias("node")))


@query(f"WITH {PROV}, {BOTH} SELECT node, list_sort(list(nbr)) AS neighbours FROM both_ways GROUP BY node")
def g7_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.adjacency(edges(spark, sf_dir))


@query(f"""WITH {PROV}, {BOTH}, c AS (SELECT node, nbr, row_number() OVER (PARTITION BY node ORDER BY nbr) AS pos FROM both_ways QUALIFY pos <= 6), z AS (SELECT 'proc:' || n AS seed FROM range(20) t(n)),
  one AS (SELECT seed, nbr AS node, pos AS o FROM z JOIN c ON node = seed), two AS (SELECT seed, c.nbr AS node, o * 7 + pos AS o FROM one JOIN c USING (node)),
  f AS (SELECT seed, node, min((hop, o)) AS m FROM (SELECT seed, seed AS node, 0 AS hop, 0::BIGINT AS o FROM z UNION ALL SELECT seed, node, 1, o FROM one UNION ALL SELECT seed, node, 2, o FROM two) GROUP BY seed, node)
SELECT seed, node, m[1]::INTEGER AS hop, row_number() OVER (PARTITION BY seed ORDER BY m, node)::INTEGER AS place FROM f QUALIFY place <= 15""")
def g8_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.range(20).select(F.concat(F.lit("proc:"), "id").alias("node"))
    return g.assemble(edges(spark, sf_dir), seeds, 6, 15)


@query(f"""WITH RECURSIVE {TRADE}, e AS (SELECT DISTINCT src, dst FROM trade WHERE quantity > 45), b AS (SELECT src AS node, dst AS nbr FROM e UNION SELECT dst, src FROM e),
  r AS (SELECT DISTINCT node, node AS root FROM b UNION SELECT b.nbr, r.root FROM r JOIN b USING (node) WHERE b.nbr > r.root)
SELECT node, min(root) AS component FROM r GROUP BY node""")
def g9_connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.connected_components(trade_edges(spark, sf_dir).where("quantity > 45"), "src", "dst")


@query(f"WITH {PROV} SELECT node, list_sort(list(DISTINCT name)) AS names FROM (SELECT src_id AS node, dst_name AS name FROM prov UNION ALL SELECT dst_id, src_name FROM prov) GROUP BY node")
def g10_neighbour_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.neighbour_name_sets(edges(spark, sf_dir))


@query(f"""WITH {PROV}, {BOTH}, f AS (SELECT node, count(*)::DOUBLE AS x, len(node)::DOUBLE AS y FROM both_ways GROUP BY node), m AS (SELECT b.node, avg(x) AS x, avg(y) AS y FROM both_ways b JOIN f ON f.node = b.nbr GROUP BY b.node)
SELECT node, round(x / sqrt(x * x + y * y), 9) AS x, round(y / sqrt(x * x + y * y), 9) AS y FROM m""")
def g11_neighbour_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    features = g.both_ways(e).groupBy("node").agg(F.array(F.count("*").cast("double"), F.length("node").cast("double")).alias("features"))
    return g.neighbour_mean(e, features, 2).select("node", F.round(F.get("features", F.lit(0)), 9).alias("x"), F.round(F.get("features", F.lit(1)), 9).alias("y"))


@query(f"""WITH {PROV}, i AS (SELECT DISTINCT src_id AS root, src_id || ':' || label AS incident_id, label FROM prov), near AS (SELECT src_id AS root, event_id, ts FROM prov UNION SELECT dst_id, event_id, ts FROM prov),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY ts DESC, event_id) AS r FROM near)
SELECT incident_id, CASE WHEN label = 1 THEN 1 ELSE count(*) END AS edges, CASE WHEN label = 1 THEN 'kept' ELSE arg_min(event_id, r) END AS first_event FROM i JOIN ranked USING (root) WHERE r <= 15 GROUP BY incident_id, label""")
def g12_fill_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents without a chain get one from their root's newest edges; the others keep theirs."""
    e = edges(spark, sf_dir)
    old = F.when(F.col("label") == 1, F.array(F.struct(F.lit("kept").alias("event_id"), F.lit("").alias("edge_type"), F.lit("").alias("src_id"), F.lit("").alias("dst_id"))))
    incidents = e.select("label", F.col("src_id").alias("root_node_id")).distinct().select(F.concat_ws(":", "root_node_id", "label").alias("incident_id"), "root_node_id", old.alias("matched_edges"))
    t = g.fill_chains(incidents, e)
    return t.select("incident_id", F.size("matched_edges").cast("long").alias("edges"), F.element_at("matched_edges", 1)["event_id"].alias("first_event"))


@query(f"""WITH {PROV}, i AS (SELECT src_id AS incident_id, event_id, ts, row_number() OVER (PARTITION BY src_id ORDER BY ts, event_id) AS r FROM prov WHERE edge_type = 'FORK')
SELECT incident_id, count(*) AS edges, arg_min(event_id, (ts, event_id)) AS first_event, arg_max(event_id, (ts, event_id)) AS last_event FROM i WHERE r <= 15 GROUP BY incident_id""")
def g12_incident_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    incidents = e.where("edge_type = 'FORK'").groupBy(F.col("src_id").alias("incident_id")).agg(F.collect_list("event_id").alias("event_ids"))
    t = g.incident_to_chain(incidents, e)
    return t.select("incident_id", F.size("edges").cast("long").alias("edges"), F.element_at("edges", 1)["event_id"].alias("first_event"), F.element_at("edges", -1)["event_id"].alias("last_event"))


@query(f"""WITH {PROV}, {BOTH}, t AS (SELECT DISTINCT dst_id AS node FROM prov WHERE label = 1), a AS (SELECT DISTINCT 'proc:' || n AS seed, nbr AS node FROM range(20) t(n) JOIN both_ways ON node = 'proc:' || n UNION SELECT 'proc:' || n, 'proc:' || n FROM range(20) t(n)),
  d AS (SELECT seed, avg((t.node IS NOT NULL)::INTEGER) AS d FROM a LEFT JOIN t USING (node) GROUP BY seed)
SELECT round((SELECT avg(d) FROM d), 9) AS gt_density, (SELECT count(DISTINCT node) FROM a SEMI JOIN t USING (node)) / (SELECT count(*) FROM t) AS gt_coverage""")
def g13_reconstruction_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    near = g.k_hop(e, spark.range(20).select(F.concat(F.lit("proc:"), "id").alias("node")), 1).withColumnRenamed("root", "seed")
    return g.reconstruction_quality(near, e.where("label = 1").select(F.col("dst_id").alias("node"))).withColumn("gt_density", F.round("gt_density", 9))


@query(f"WITH {PROV}, f AS (SELECT DISTINCT dst_id FROM prov WHERE label = 1 AND size < 5) SELECT event_id FROM prov WHERE src_id IN (SELECT dst_id FROM f) OR dst_id IN (SELECT dst_id FROM f)")
def g14_top_nodes_to_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return g.top_nodes_to_edges(e, e.where("label = 1 AND size < 5").select(F.col("dst_id").alias("node"))).select("event_id")


@query(f"""WITH {PROV}, t AS (SELECT src_id AS node, ts, event_id, edge_type, dst_name FROM prov UNION ALL SELECT dst_id, ts, event_id, edge_type, dst_name FROM prov)
SELECT node, flatten(list([edge_type, dst_name] ORDER BY ts, event_id)) AS tokens FROM t GROUP BY node""")
def a6_node_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.documents_of(edges(spark, sf_dir), F.array("edge_type", "dst_name"))


@query(f"""WITH {PROV}, t AS (SELECT src_id AS node, ts, event_id, edge_type, dst_name FROM prov UNION ALL SELECT dst_id, ts, event_id, edge_type, dst_name FROM prov),
  p AS (SELECT *, (row_number() OVER (PARTITION BY node ORDER BY ts, event_id) - 1) // 20 AS chunk FROM t)
SELECT node, chunk, flatten(list([edge_type, dst_name] ORDER BY ts, event_id)) AS tokens FROM p GROUP BY node, chunk""")
def a6_document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of nodes in pieces of twenty edges, however many edges a node has."""
    return g.document_chunks(edges(spark, sf_dir), F.array("edge_type", "dst_name"), 20)


@query(f"WITH {PROV} SELECT node, round(avg(score), 6) AS score FROM (SELECT src_id AS node, score FROM prov UNION ALL SELECT dst_id, score FROM prov) GROUP BY node")
def a7_node_mean_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.node_mean_loss(edges(spark, sf_dir).withColumnRenamed("score", "loss")).withColumn("score", F.round("score", 6))


@query(f"""WITH {PROV}, t AS (SELECT src_id AS node, 1 AS o, 0 AS i, dst_id AS ob, NULL AS ib, ts, src_type AS ty, event_id FROM prov UNION ALL SELECT dst_id, 0, 1, NULL, src_id, ts, dst_type, event_id FROM prov)
SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, count(DISTINCT ob) AS out_neighbours, count(DISTINCT ib) AS in_neighbours, min(ts) AS first_ts, arg_min(ty, (ts, event_id, ty)) AS first_type FROM t GROUP BY node""")
def a8_structural_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.structural_features(edges(spark, sf_dir))


@query(f"""WITH {PROV}, t AS (SELECT src_id AS node, 'out_' || dst_type AS k FROM prov UNION ALL SELECT dst_id, 'in_' || src_type FROM prov)
SELECT node, {', '.join(f"round(ln(1 + count(*) FILTER (k = '{d}_{t}')), 9) AS {d}_{t}" for d in ('out', 'in') for t in ('PROCESS', 'FILE', 'SOCKET'))} FROM t GROUP BY node""")
def a9_type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = g.neighbour_type_histogram(edges(spark, sf_dir))
    return t.select("node", *[F.round(c, 9).alias(c) for c in t.columns[1:]])


@query(f"""WITH {PROV}, t AS (SELECT src_id AS node, score, size FROM prov UNION ALL SELECT dst_id, score, size FROM prov) SELECT node, round(avg(score), 6) AS x, round(avg(size), 6) AS y, round(ln(1 + count(*)), 9) AS log_degree FROM t GROUP BY node""")
def a10_mean_edge_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    t = g.mean_edge_embedding(e, e.select("event_id", F.array(F.col("score"), F.col("size").cast("double")).alias("vector")), 2)
    return t.select("node", F.round(F.get("embedding", F.lit(0)), 6).alias("x"), F.round(F.get("embedding", F.lit(1)), 6).alias("y"), F.round("log_degree", 9).alias("log_degree"))


IOCS = ("licensed under", "token =", "@mail", "no such thing")


@query(f"""WITH h AS (SELECT p.ioc, d.doc_id AS t, source AS grp FROM (SELECT unnest([{', '.join(f"'{i}'" for i in IOCS)}]) AS ioc) p LEFT JOIN documents d ON contains(lower(d.text), p.ioc)),
  c AS (SELECT ioc, grp, count(*) AS n FROM h WHERE grp IS NOT NULL GROUP BY ioc, grp QUALIFY row_number() OVER (PARTITION BY ioc ORDER BY n DESC, grp) <= 3)
SELECT ioc, count(t) AS hits, min(t) AS t_min, max(t) AS t_max, (max(t) - min(t)) / 86400 AS span_days, coalesce((SELECT string_agg(grp, ',' ORDER BY n DESC, grp) FROM c WHERE c.ioc = h.ioc), '') AS top_groups FROM h GROUP BY ioc""")
def a11_ioc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ioc_audit(load(spark, sf_dir, "documents"), list(IOCS), "text", "doc_id", "source")


@query("SELECT coalesce(lang, x.l) AS lang, a AS anchor, coalesce(n, 0) AS n, coalesce(n, 0) - a AS delta FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang) d FULL JOIN (SELECT * FROM (VALUES ('en', 600::BIGINT), ('de', 100), ('xx', 5)) t(l, a)) x ON d.lang = x.l")
def a12_anchor_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.anchor_check(load(spark, sf_dir, "documents"), "lang", {"en": 600, "de": 100, "xx": 5})


@query(f"WITH {PROV}, a AS (SELECT DISTINCT dst_id FROM prov WHERE endpoint_id = 'host1'), b AS (SELECT DISTINCT dst_id FROM prov WHERE endpoint_id = 'host2') SELECT (SELECT count(*) FROM a) AS in_a, (SELECT count(*) FROM b) AS in_b, (SELECT count(*) FROM a SEMI JOIN b USING (dst_id)) AS shared, (SELECT count(*) FROM a SEMI JOIN b USING (dst_id)) / (SELECT count(*) FROM b) AS shared_of_b")
def a14_vocabulary_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return quality.vocabulary_overlap(e.where("endpoint_id = 'host1'"), e.where("endpoint_id = 'host2'"), "dst_id")


COMPOSITION = """comp AS (SELECT src_type, dst_type, edge_type, (count(p.event_id) + 1) / (sum(count(p.event_id)) OVER (PARTITION BY src_type, dst_type) + count(*) OVER (PARTITION BY src_type, dst_type)) AS p
  FROM (SELECT DISTINCT src_type, dst_type FROM prov) CROSS JOIN (SELECT DISTINCT edge_type FROM prov) LEFT JOIN prov p USING (src_type, dst_type, edge_type) GROUP BY src_type, dst_type, edge_type)"""


@query(f"WITH {PROV}, {COMPOSITION} SELECT src_type, dst_type, edge_type, round(p, 9) AS p FROM comp")
def a15_composition_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.composition_table(edges(spark, sf_dir)).withColumn("p", F.round("p", 9))


@query(f"WITH {PROV}, {COMPOSITION}, l AS (SELECT src_id, dst_id, -ln(p) AS loss FROM prov JOIN comp USING (src_type, dst_type, edge_type)) SELECT node, round(avg(loss), 6) AS score FROM (SELECT src_id AS node, loss FROM l UNION ALL SELECT dst_id, loss FROM l) GROUP BY node")
def l13_composition_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return scoring.composition_floor(e, e).withColumn("score", F.round("score", 6))


@query(f"WITH {PROV} SELECT dst_type, (sum(label) + 1) / (count(*) + 2) AS p FROM prov GROUP BY dst_type")
def a16_frequency_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.frequency_floor(edges(spark, sf_dir), "dst_type")


@query("SELECT l_returnflag, min(l_quantity) AS p0, quantile_cont(l_quantity, 0.1) AS p10, quantile_cont(l_quantity, 0.5) AS p50, quantile_cont(l_quantity, 0.9) AS p90, max(l_quantity) AS p100 FROM lineitem GROUP BY l_returnflag")
def a17_percentile_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.percentile_profile(load(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag")


@query(f"WITH {PROV} SELECT dst_type, avg((size < 20)::INTEGER) AS before, avg((size BETWEEN 20 AND 60)::INTEGER) AS inside, avg((size > 60)::INTEGER) AS after FROM prov GROUP BY dst_type")
def a17_window_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.window_fractions(edges(spark, sf_dir), F.col("size"), 20, 60, "dst_type")


@query(f"WITH {PROV} SELECT dst_type, count(*) AS total, sum(label)::BIGINT AS flagged, avg(label) AS share FROM prov GROUP BY dst_type")
def a18_flagged_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.flagged_by_type(edges(spark, sf_dir).withColumn("flagged", F.col("label")), "dst_type")


@query(f"WITH {PROV} SELECT src_id, {', '.join(f'avg((dst_type = {chr(39)}{t}{chr(39)})::INTEGER) AS {t}' for t in ('FILE', 'PROCESS', 'SOCKET'))} FROM prov GROUP BY src_id")
def a19_composition_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.composition_vector(edges(spark, sf_dir), "src_id", "dst_type", ["FILE", "PROCESS", "SOCKET"])


@query("""SELECT label, round(avg(embedding[1]::DOUBLE), 6) AS mean_1, round(sum(embedding[1]::DOUBLE * exp(w - m)) / sum(exp(w - m)), 6) AS weighted_1
  FROM (SELECT *, embedding[2]::DOUBLE AS w, max(embedding[2]::DOUBLE) OVER (PARTITION BY label) AS m FROM embeddings) GROUP BY label""")
def a20_pooled_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("v")).withColumn("w", F.element_at("v", 2))
    mean, weighted = scoring.pooled_embedding(e, "label", "v", 1), scoring.pooled_embedding(e, "label", "v", 1, "w").withColumnRenamed("pooled", "p2")
    return mean.join(weighted, "label").select("label", F.round(F.get("pooled", F.lit(0)), 6).alias("mean_1"), F.round(F.get("p2", F.lit(0)), 6).alias("weighted_1"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def a21_group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query(f"WITH {PROV} SELECT src_id, edge_type, dst_id, count(*) AS times FROM prov GROUP BY ALL")
def a22_collapse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.collapse_edges(edges(spark, sf_dir))


@query(f"WITH {PROV} SELECT e.event_id, e.dst_name FROM prov e WHERE size % 2 = 0")
def j1_join_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir).withColumn("action", F.col("edge_type"))
    known = e.where("size % 2 = 0").select("src_id", "dst_id", "action", "ts", "dst_name")
    return cdm.join_attributes(e.select("event_id", "src_id", "dst_id", "action", "ts"), known.union(known)).select("event_id", "dst_name")


@query(f"WITH {PROV} SELECT event_id, 'PROCESS' AS src_type, dst_type FROM prov WHERE dst_type <> 'SOCKET'")
def j2_s8_resolve_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    known = g.upsert_nodes(e).where("label <> 'SOCKET'").select("uuid", F.col("label").alias("type"))
    return cdm.resolve_edges(e, known).select("event_id", "src_type", "dst_type")


@query(f"WITH {PROV}, t AS (SELECT DISTINCT dst_id AS u FROM prov WHERE size < 3) SELECT event_id, (src_id IN (SELECT u FROM t) OR dst_id IN (SELECT u FROM t))::INTEGER AS label FROM prov")
def j3_ground_truth_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return cdm.ground_truth_label(e.drop("label"), e.where("size < 3").select(F.col("dst_id").alias("uuid"))).select("event_id", "label")


@query("""SELECT vec_id, label, CASE WHEN label % 2 = 0 THEN embedding[1]::DOUBLE ELSE 0.0 END AS x FROM embeddings""")
def j12_similar_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    names = lambda c: F.array(F.lit("a"), F.lit("b"), c)
    nodes = e.select(F.col("vec_id").alias("node"), "label", names(F.lit("c")).alias("names"), "embedding")
    stored = e.select("label").distinct().select("label", F.when(F.col("label") % 2 == 0, names(F.lit("d"))).otherwise(F.array(F.lit("z"))).alias("names"), F.array(F.lit(1.0)).alias("embedding"))
    t = serving.similar_neighbourhood(nodes.drop("embedding"), stored, 1, 0.5).join(e.select(F.col("vec_id").alias("node"), F.element_at("embedding", 1).cast("double").alias("v")), "node")
    return t.select(F.col("node").alias("vec_id"), "label", (F.get("embedding", F.lit(0)) * F.col("v")).alias("x"))
