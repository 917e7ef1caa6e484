"""Queries over ranking metrics, windows, splits and sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.operators import metrics as m
from provspark.operators import quality
from provspark.operators import splits as s
from provspark.operators.graph import written
from provspark.plans import serving
from provspark.plans.adapt import PROV, SCORES, edges, load, scores
from provspark.plans.registry import query

RANKED = f"""{SCORES}, t AS (SELECT host, score, sum(label) AS pos, count(*) - sum(label) AS neg FROM scores GROUP BY host, score),
  c AS (SELECT *, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER (PARTITION BY host) AS p, sum(neg) OVER (PARTITION BY host) AS n FROM t WINDOW d AS (PARTITION BY host ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""
RATES = """tp / nullif(tp + fp, 0)"""


@query(f"WITH {SCORES}, r AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY host, score) - 1) / 2 AS r FROM scores WINDOW w AS (PARTITION BY host ORDER BY score)) SELECT host, round((sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))), 9) AS auc FROM r GROUP BY host")
def m1_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.roc_auc(scores(spark, sf_dir), ["host"]).withColumn("auc", F.round("auc", 9))


@query(f"WITH {RANKED} SELECT host, round(sum(pos / p * tp / (tp + fp)), 9) AS ap FROM c GROUP BY host")
def m2_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.average_precision(scores(spark, sf_dir), ["host"]).withColumn("ap", F.round("ap", 9))


@query(f"WITH {RANKED}, x AS (SELECT host, score, tp / p AS r, tp / (tp + fp) AS pr FROM c), y AS (SELECT *, lag(r, 1, 0) OVER w AS r0, lag(pr, 1, 1) OVER w AS p0 FROM x WINDOW w AS (PARTITION BY host ORDER BY score DESC)) SELECT host, round(sum((r - r0) * (pr + p0) / 2), 9) AS pr_auc FROM y GROUP BY host")
def m2_pr_auc_trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.pr_auc_trapezoid(scores(spark, sf_dir), ["host"]).withColumn("pr_auc", F.round("pr_auc", 9))


def _rates_sql(source: str, keys: str) -> str:
    return f"""SELECT {keys}, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1,
  round(coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 9) AS mcc, round(coalesce(fp / nullif(fp + tn, 0), 0), 9) AS fpr, round((tp + fn) / (tp + fp + fn + tn), 9) AS base_rate,
  round(coalesce(tp / nullif(tp + fp, 0), 0) / nullif((tp + fn) / (tp + fp + fn + tn), 0), 9) AS lift FROM ({source})"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1", "mcc", "fpr", "base_rate", "lift")})


@query(f"WITH {SCORES} " + _rates_sql("SELECT node_type, count(*) FILTER (label = 1 AND score >= 60) AS tp, count(*) FILTER (label = 0 AND score >= 60) AS fp, count(*) FILTER (label = 1 AND score < 60) AS fn, count(*) FILTER (label = 0 AND score < 60) AS tn FROM scores WHERE node_type = 'FILE' GROUP BY node_type", "node_type"))
def m3_m5_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(m.confusion(scores(spark, sf_dir).where("node_type = 'FILE'"), F.col("score") >= 60, ["node_type"]))


BOTH = "both_ways AS (SELECT src_id AS node, dst_id AS nbr FROM prov WHERE src_id <> dst_id UNION SELECT dst_id, src_id FROM prov WHERE src_id <> dst_id)"
CLOSED = "SELECT node FROM {0} SEMI JOIN both_ways USING (node) UNION SELECT b.nbr FROM {0} JOIN both_ways b USING (node) UNION SELECT c.nbr FROM {0} JOIN both_ways b USING (node) JOIN both_ways c ON c.node = b.nbr"


@query(f"""WITH {PROV}, {BOTH}, v AS (SELECT dst_id AS node, (max(score) > 170)::INTEGER AS flagged, (max(label) = 1 AND max(size) < 8)::INTEGER AS label FROM prov GROUP BY dst_id), t AS (SELECT node FROM v WHERE label = 1), f AS (SELECT node FROM v WHERE label = 1 AND flagged = 1),
  nt AS ({CLOSED.format('t')}), nf AS ({CLOSED.format('f')}), c AS (SELECT count(*) FILTER (flagged = 1 AND label = 1) AS raw_tp, count(*) FILTER (flagged = 1 AND label = 0) AS raw_fp, count(*) FILTER (flagged = 0 AND label = 1) AS raw_fn,
  count(*) FILTER (flagged = 1 AND label = 0 AND node IN (SELECT node FROM nt)) AS forgiven, count(*) FILTER (flagged = 0 AND label = 1 AND node IN (SELECT node FROM nf)) AS promoted FROM v)
SELECT *, round(coalesce(2 * raw_tp / nullif(2 * raw_tp + raw_fp + raw_fn, 0), 0), 9) AS raw_f1, round(coalesce(2 * (raw_tp + promoted) / nullif(2 * (raw_tp + promoted) + raw_fp - forgiven + raw_fn - promoted, 0), 0), 9) AS adjusted_f1 FROM c""")
def m4_two_hop_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    v = e.groupBy(F.col("dst_id").alias("node")).agg((F.max("score") > 170).cast("int").alias("flagged"), ((F.max("label") == 1) & (F.max("size") < 8)).cast("int").alias("label"))
    t = m.hop_adjusted(e, v)
    return t.withColumn("raw_f1", F.round("raw_f1", 9)).withColumn("adjusted_f1", F.round("adjusted_f1", 9))


SWEEP = f"SELECT h.threshold, count(*) FILTER (label = 1 AND score >= threshold) AS tp, count(*) FILTER (label = 0 AND score >= threshold) AS fp, count(*) FILTER (label = 1 AND score < threshold) AS fn, count(*) FILTER (label = 0 AND score < threshold) AS tn FROM scores CROSS JOIN (SELECT n * 2.0::DOUBLE AS threshold FROM range(91) t(n)) h GROUP BY h.threshold"


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.threshold_sweep(scores(spark, sf_dir), spark.range(91).select((F.col("id") * 2.0).alias("threshold")))


@query(f"WITH {SCORES} " + _rates_sql(SWEEP, "threshold"))
def m6_m7_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_sweep(spark, sf_dir))


@query(f"WITH {SCORES}, w AS (SELECT *, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f FROM ({SWEEP})) SELECT threshold, round(f, 9) AS f1, (SELECT min(threshold) FROM w WHERE tp / nullif(tp + fp, 0) >= 0.16) AS for_precision FROM w ORDER BY round(coalesce(f, 0), 12) DESC, threshold LIMIT 1")
def m6_best_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    sweep = _sweep(spark, sf_dir)
    return m.best_f1(sweep).withColumn("f1", F.round("f1", 9)).crossJoin(m.threshold_for_precision(sweep, 0.16).withColumnRenamed("threshold", "for_precision"))


@query(f"WITH {RANKED} SELECT host, x.recall, arg_max(tp / (tp + fp), score) AS precision FROM c CROSS JOIN (SELECT unnest([0.5, 0.9])::DOUBLE AS recall) x WHERE tp >= x.recall * p - 1e-9 GROUP BY host, x.recall")
def m8_precision_at_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.precision_at_recall(scores(spark, sf_dir), [0.5, 0.9], ["host"])


@query(f"WITH {RANKED} SELECT host, b.budget, coalesce(max(tp) FILTER (fp <= b.budget), 0)::BIGINT AS recalled, round(coalesce(max(tp) FILTER (fp <= b.budget), 0) / max(p), 9) AS recall FROM c CROSS JOIN (SELECT unnest([10, 50, 100, 1000]) AS budget) b GROUP BY host, b.budget")
def m9_recall_at_fp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.recall_at_fp(scores(spark, sf_dir), [10, 50, 100, 1000], ["host"]).withColumn("recall", F.round("recall", 9))


@query(f"WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY score DESC, entity) AS rnk FROM scores) SELECT host, k.k, sum(label) / k.k AS precision FROM r JOIN (SELECT unnest([5, 20]) AS k) k ON r.rnk <= k.k GROUP BY host, k.k")
def m10_precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.precision_at_k(scores(spark, sf_dir), [5, 20], ["host"])


@query(f"""WITH {SCORES}, f AS (SELECT attack_id, max(score) AS score FROM scores WHERE attack_id >= 0 GROUP BY attack_id), t AS (SELECT score, sum((attack_id >= 0)::INTEGER) AS pos, count(*) AS n FROM scores GROUP BY score),
  c AS (SELECT score, sum(pos) OVER w / sum(n) OVER w AS precision, (SELECT count(*) FROM f WHERE f.score = t.score) AS found FROM t WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
  e AS (SELECT found, max(precision) OVER (ORDER BY score DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM c) SELECT round(sum(found * env) / (SELECT count(*) FROM f), 9) AS adp FROM e""")
def m11_adp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.adp(scores(spark, sf_dir)).select(F.round("adp", 9).alias("adp"))


@query(f"WITH {SCORES} SELECT node_type, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sigma, round(stddev_pop(v) / abs(avg(v)), 6) AS relative_sigma FROM (SELECT node_type, host, avg(score) AS v FROM scores GROUP BY node_type, host) GROUP BY node_type")
def m12_seed_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = scores(spark, sf_dir).groupBy("node_type", "host").agg(F.avg("score").alias("v"))
    return m.seed_stability(v, ["node_type"], "v").select("node_type", *[F.round(c, 6).alias(c) for c in ("mean", "sigma", "relative_sigma")])


@query(f"WITH {PROV}, r AS (SELECT dst_type, rank() OVER (PARTITION BY dst_type ORDER BY score) + (count(*) OVER (PARTITION BY dst_type, score) - 1) / 2 AS a, rank() OVER (PARTITION BY dst_type ORDER BY size) + (count(*) OVER (PARTITION BY dst_type, size) - 1) / 2 AS b FROM prov) SELECT dst_type, round(corr(a, b), 9) AS rho FROM r GROUP BY dst_type")
def m13_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.spearman(edges(spark, sf_dir), "score", "size", ["dst_type"]).withColumn("rho", F.round("rho", 9))


@query(f"""WITH {PROV}, c AS (SELECT unnest([90.0, 95.0, 99.0])::DOUBLE AS pc, unnest(ca) AS ca, unnest(cb) AS cb FROM (SELECT quantile_cont(score, [0.9, 0.95, 0.99]) AS ca, quantile_cont(size, [0.9, 0.95, 0.99]) AS cb FROM prov)),
  f AS (SELECT pc AS percent, count(*) FILTER (score > ca) AS a_flags, count(*) FILTER (size > cb) AS b_flags, count(*) FILTER (score > ca AND size > cb) AS n FROM prov CROSS JOIN c GROUP BY pc)
SELECT percent, a_flags, b_flags, n AS "both", coalesce(n / nullif(a_flags + b_flags - n, 0), 0) AS jaccard, coalesce(n / nullif(b_flags, 0), 0) AS b_in_a FROM f""")
def m14_flag_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.flag_overlap(edges(spark, sf_dir).select("score", "size"), "score", "size", [90.0, 95.0, 99.0])


@query(f"WITH {SCORES}, v AS (SELECT v, s.* FROM scores s JOIN (VALUES ('full', 'X'), ('no_socket', 'SOCKET'), ('file_only', 'F')) x(v, drop_type) ON (v = 'full' OR (v = 'no_socket' AND node_type <> 'SOCKET') OR (v = 'file_only' AND node_type = 'FILE'))) SELECT v AS variant, count(*) FILTER (label = 1 AND score >= 60) AS tp, count(*) FILTER (label = 0 AND score >= 60) AS fp, count(*) FILTER (label = 1 AND score < 60) AS fn FROM v GROUP BY v")
def m15_denominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("node_type")
    variant = F.explode(F.array_compact(F.array(F.lit("full"), F.when(t != "SOCKET", "no_socket"), F.when(t == "FILE", "file_only"))))
    return m.confusion(scores(spark, sf_dir).withColumn("variant", variant), F.col("score") >= 60, ["variant"]).select("variant", "tp", "fp", "fn")


@query(f"WITH {SCORES} SELECT label, CASE WHEN score < 20 THEN 0 WHEN score < 60 THEN 1 ELSE 2 END AS bin, count(*) AS n FROM scores WHERE score BETWEEN 0 AND 100000 GROUP BY ALL")
def m16_score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.score_histogram(scores(spark, sf_dir), [0.0, 20.0, 60.0, 100_000.0])


@query(f"WITH {SCORES}, r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r, count(*) OVER () AS n FROM scores) SELECT least(floor((r - 0.5) * 20 / n), 19)::INTEGER AS bin, round(avg(score), 6) AS mean_score, avg(label) AS observed, count(*) AS n FROM r GROUP BY 1")
def m16_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.calibration_curve(scores(spark, sf_dir)).withColumn("mean_score", F.round("mean_score", 6))


@query(f"WITH {RANKED}, a AS (SELECT host, sum(pos / p * tp / (tp + fp)) AS ap FROM c GROUP BY host), b AS (SELECT host, avg(label) AS ap_floor FROM scores GROUP BY host) SELECT host, round(ap - ap_floor, 9) AS residual FROM a JOIN b USING (host)")
def m17_residual_over_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    sc = scores(spark, sf_dir)
    floor = m.average_precision(sc.withColumn("score", F.lit(0.0)), ["host"]).withColumnRenamed("ap", "f")
    return m.average_precision(sc, ["host"]).join(floor, "host").select("host", F.round(F.col("ap") - F.col("f"), 9).alias("residual"))


@query(f"WITH {PROV} SELECT round(corr(label, (endpoint_id = 'host1')::INTEGER), 9) AS pearson FROM prov")
def m18_origin_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).agg(F.round(F.corr("label", (F.col("endpoint_id") == "host1").cast("int")), 9).alias("pearson"))


@query(f"WITH {SCORES}, x AS (SELECT a.host AS train_host, b.* FROM (SELECT DISTINCT host FROM scores) a JOIN scores b ON true), r AS (SELECT *, rank() OVER (PARTITION BY train_host, host ORDER BY score) + (count(*) OVER (PARTITION BY train_host, host, score) - 1) / 2 AS r FROM x) SELECT train_host, host AS test_host, round((sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))), 9) AS auc FROM r GROUP BY ALL")
def m19_cross_host_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sc = scores(spark, sf_dir)
    table = m.roc_auc(s.leave_one_out(sc, "host"), ["fold", "host"])
    return table.select(F.col("fold").alias("train_host"), F.col("host").alias("test_host"), F.round("auc", 9).alias("auc"))


@query(f"WITH {SCORES} SELECT host, (avg(label) > 0.1)::INTEGER AS enough, (count(*) > 50)::INTEGER AS many, (avg(label) > 0.1 AND count(*) > 50)::INTEGER AS go FROM scores GROUP BY host")
def m20_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = scores(spark, sf_dir).groupBy("host").agg(F.avg("label").alias("rate"), F.count("*").alias("n"))
    return quality.gates(t, {"enough": "rate > 0.1", "many": "n > 50"}).select("host", "enough", "many", "go")


@query(f"WITH {RANKED} SELECT host, score, tp::BIGINT AS tp, fp::BIGINT AS fp FROM c")
def n8_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m._score_table(scores(spark, sf_dir), ["host"]).select("host", "score", "tp", "fp")


@query(f"WITH {SCORES} SELECT entity, rank() OVER (PARTITION BY host ORDER BY score) + (count(*) OVER (PARTITION BY host, score) - 1) / 2 AS rank FROM scores")
def n9_mid_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.mid_ranks(scores(spark, sf_dir), "score", ["host"]).select("entity", "rank")


@query(f"WITH {SCORES} SELECT host, entity, score, label FROM scores QUALIFY row_number() OVER (PARTITION BY host, label ORDER BY score DESC, entity) <= 3")
def n10_top_per_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("host", "label").orderBy(F.desc("score"), "entity"))
    return scores(spark, sf_dir).withColumn("_r", rank).where("_r <= 3").select("host", "entity", "score", "label")


@query(f"WITH {PROV} SELECT event_id, ts FROM prov ORDER BY ts DESC, event_id LIMIT 500")
def n3_n11_last_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.last_edges_window(edges(spark, sf_dir), 500).select("event_id", "ts")


@query("""WITH g AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), e AS (SELECT *, n * least(333, sum(n) OVER ()) / sum(n) OVER () AS x FROM g), r AS (SELECT *, row_number() OVER (ORDER BY x - floor(x) DESC, lang) AS r, least(333, sum(n) OVER ()) - sum(floor(x)) OVER () AS rest FROM e)
SELECT lang, n, (floor(x) + (r <= rest)::INTEGER)::BIGINT AS quota FROM r""")
def n12_largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.largest_remainder(load(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n")), 333)


@query("SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) <= 5")
def n13_reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.reservoir(load(spark, sf_dir, "documents"), "lang", 5, ["doc_id"]).select("lang", "doc_id")


LABELED = "SELECT doc_id, text, lang, CASE WHEN contains(lower(text), 'licensed under') AND doc_id BETWEEN 10 AND 900 THEN 'license' WHEN contains(lower(text), 'token =') OR contains(lower(text), '@mail') THEN 'private' END AS scenario FROM documents"
SCENARIOS = [{"id": "license", "patterns": ["licensed under"], "start": 10, "end": 900}, {"id": "private", "patterns": ["token =", "@mail"]}]


@query(f"SELECT doc_id, scenario, (scenario IS NOT NULL)::INTEGER AS label FROM ({LABELED})")
def w4_s14_label_iocs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.label_iocs(load(spark, sf_dir, "documents"), SCENARIOS, "text", "doc_id").select("doc_id", "scenario", "label")


#: Lines of the edges, and each endpoint's suspect objects as the patterns of its scenario.
SUSPECTS = f"{PROV}, lines AS (SELECT event_id, ts, endpoint_id, src_name || ' ' || edge_type || ' <' || dst_id || '>' AS line FROM prov), suspects AS (SELECT DISTINCT endpoint_id AS scenario, upper('<' || dst_id) AS pattern FROM prov WHERE label = 1)"


def suspect_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(lines of all edges, (endpoint, pattern) of the labelled edges' objects: an indicator list, as its file would hold it)."""
    e = edges(spark, sf_dir)
    lines = e.select("event_id", "ts", "endpoint_id", F.concat("src_name", F.lit(" "), "edge_type", F.lit(" <"), "dst_id", F.lit(">")).alias("line"))
    listed = e.where("label = 1").select("endpoint_id", F.upper(F.concat(F.lit("<"), "dst_id")).alias("pattern")).distinct().orderBy("endpoint_id", "pattern")
    return lines, [tuple(x) for x in listed.collect()]  # objects are few: a file's indicators


@query(f"WITH {SUSPECTS} SELECT event_id, min(scenario) AS scenario, (min(scenario) IS NOT NULL)::INTEGER AS label FROM lines LEFT JOIN suspects ON contains(lower(line), lower(pattern)) GROUP BY event_id")
def w4_many_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hundreds of indicators in eight scenarios over raw lines: one pass of one automaton."""
    lines, listed = suspect_lines(spark, sf_dir)
    scenarios = [{"id": h, "patterns": [p for x, p in listed if x == h]} for h in sorted({x for x, _ in listed})]
    return s.label_iocs(lines, scenarios, "line", "ts").select("event_id", "scenario", "label")


@query(f"WITH {SUSPECTS}, p AS (SELECT DISTINCT lower(pattern) AS ioc FROM suspects) SELECT ioc, count(ts) AS hits, min(ts) AS t_min, max(ts) AS t_max FROM p LEFT JOIN lines ON contains(lower(line), ioc) GROUP BY ioc")
def a11_many_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, listed = suspect_lines(spark, sf_dir)
    return quality.ioc_audit(lines, [p for _, p in listed], "line", "ts", "endpoint_id").select("ioc", "hits", "t_min", "t_max")


@query(f"SELECT coalesce(scenario, 'none') AS scenario, count(*) AS hits FROM ({LABELED}) GROUP BY 1")
def s18_scenario_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = s.label_iocs(load(spark, sf_dir, "documents"), SCENARIOS, "text", "doc_id")
    return t.groupBy(F.coalesce("scenario", F.lit("none")).alias("scenario")).agg(F.count("*").alias("hits"))


@query("SELECT id, t.kind FROM (SELECT doc_id::VARCHAR AS id, 'documents' AS kind FROM documents UNION ALL SELECT url, 'pages' FROM pages) t")
def s5_d1_union_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("documents").alias("kind"))
    return s.union_schema([a, load(spark, sf_dir, "pages").select(F.col("url").alias("id"), F.lit("pages").alias("kind"))])


@query(f"WITH {PROV}, a AS (SELECT DISTINCT dst_id FROM prov WHERE score > 120), t AS (SELECT DISTINCT dst_id FROM prov WHERE label = 1), u AS (SELECT DISTINCT dst_id, dst_id IN (SELECT dst_id FROM a) AS a, dst_id IN (SELECT dst_id FROM t) AS t FROM prov) SELECT count(*) FILTER (a AND t) AS tp, count(*) FILTER (a AND NOT t) AS fp, count(*) FILTER (NOT a AND t) AS fn, count(*) FILTER (NOT a AND NOT t) AS tn FROM u")
def d2_set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return s.set_algebra(e.where("score > 120"), e.where("label = 1"), e, "dst_id")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text, lang")
def d3_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.dedup_keep_first(load(spark, sf_dir, "documents"), ["text"], ["doc_id"], "lang").select("doc_id")


@query(f"""WITH {PROV}, g AS (SELECT dst_type, count(*) AS n FROM prov WHERE label = 0 GROUP BY dst_type), e AS (SELECT *, n * least(200, sum(n) OVER ()) / sum(n) OVER () AS x FROM g),
  q AS (SELECT dst_type, floor(x) + (row_number() OVER (ORDER BY x - floor(x) DESC, dst_type) <= least(200, sum(n) OVER ()) - sum(floor(x)) OVER ())::INTEGER AS quota FROM e)
SELECT event_id FROM prov WHERE label = 1 UNION ALL SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY dst_type ORDER BY md5(event_id), event_id) AS r FROM prov WHERE label = 0) JOIN q USING (dst_type) WHERE r <= quota""")
def d5_proportional_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.proportional_sample(edges(spark, sf_dir), "dst_type", 200, ["event_id"]).select("event_id")


@query("""WITH c AS (SELECT o_orderdate AS d, sum(count(*)) OVER (ORDER BY o_orderdate) / sum(count(*)) OVER () AS f FROM orders GROUP BY o_orderdate), k AS (SELECT max(d) FILTER (f <= 0.6) AS a, max(d) FILTER (f <= 0.8) AS b FROM c)
SELECT o_orderkey, CASE WHEN o_orderdate <= a THEN 'train' WHEN o_orderdate <= b THEN 'val' ELSE 'test' END AS split FROM orders CROSS JOIN k""")
def d6_temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.temporal_split(load(spark, sf_dir, "orders"), "o_orderdate").select("o_orderkey", "split")


@query("SELECT o_orderkey, CASE WHEN b < 60 THEN 'train' WHEN b < 80 THEN 'val' ELSE 'test' END AS split FROM (SELECT o_orderkey, ('0x' || left(md5('42|' || o_orderstatus || '|' || o_orderkey), 8))::BIGINT % 100 AS b FROM orders)")
def d7_hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.hash_split(load(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus").select("o_orderkey", "split")


@query("SELECT o_orderkey, CASE WHEN r <= floor(n * 0.6::DOUBLE) THEN 'train' WHEN r <= floor(n * 0.8::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey::VARCHAR), o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)")
def d8_stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.stratified_split(load(spark, sf_dir, "orders"), ["o_orderkey"], "o_orderstatus").select("o_orderkey", "split")


@query(f"WITH {PROV} SELECT event_id, CASE WHEN size <= (SELECT quantile_cont(size, 0.5) FROM prov WHERE label = 1) THEN 'early' ELSE 'late' END AS by_label, CASE WHEN size <= (SELECT quantile_cont(size, 0.5) FROM prov) THEN 'early' ELSE 'late' END AS by_all FROM prov")
def d9_median_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = s.median_split(edges(spark, sf_dir), "size", "label").withColumnRenamed("half", "by_label")
    return s.median_split(t, "size").select("event_id", "by_label", F.col("half").alias("by_all"))


@query(f"WITH {PROV} SELECT f.fold, CASE WHEN endpoint_id = f.fold THEN 'test' ELSE 'train' END AS role, count(*) AS n, sum(label)::BIGINT AS pos FROM prov CROSS JOIN (SELECT DISTINCT endpoint_id AS fold FROM prov) f GROUP BY ALL")
def d10_leave_one_host_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.leave_one_out(edges(spark, sf_dir), "endpoint_id").groupBy("fold", "role").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))


@query(f"WITH {PROV}, x AS (SELECT s.seed, prov.* FROM prov CROSS JOIN (SELECT unnest([1, 2]) AS seed) s) SELECT seed, event_id, label FROM x QUALIFY label = 0 OR row_number() OVER (PARTITION BY seed, label ORDER BY md5(seed || '|' || event_id), event_id) <= 10")
def d11_few_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.few_shot(edges(spark, sf_dir), 10, [1, 2], "event_id").select("seed", "event_id", "label")


@query(f"""WITH {PROV}, a AS (SELECT event_id, dst_type, row_number() OVER (PARTITION BY dst_type ORDER BY md5(event_id), event_id) - 1 AS r FROM prov WHERE label = 1), b AS (SELECT event_id, dst_type, row_number() OVER (PARTITION BY dst_type ORDER BY md5(event_id), event_id) - 1 AS r, count(*) OVER (PARTITION BY dst_type) AS n FROM prov WHERE label = 0)
SELECT a.event_id AS attack, b.event_id AS benign, dst_type FROM a JOIN b USING (dst_type) WHERE a.r % b.n = b.r""")
def d12_type_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return s.type_matched_sample(e.where("label = 1"), e.where("label = 0"), "dst_type", "event_id")


@query(f"""WITH {PROV}, u AS (SELECT i, ('0x' || left(md5('42|score|' || i), 8))::BIGINT / 4294967296.0::DOUBLE AS a, ('0x' || left(md5('42|size|' || i), 8))::BIGINT / 4294967296.0::DOUBLE AS b FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i FROM prov)),
  m AS (SELECT min(score) AS sl, max(score) AS sh, min(size) AS zl, max(size) AS zh FROM prov) SELECT round(sl + a * (sh - sl), 6) AS score, round(zl + b * (zh - zl), 6) AS size FROM u CROSS JOIN m""")
def d13_uniform_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    drawn = s.uniform_background(e, ["score", "size"], e.count())
    return drawn.select(F.round("score", 6).alias("score"), F.round("size", 6).alias("size"))


@query(f"""WITH {PROV}, u AS (SELECT r.r AS replicate, label, ('0x' || left(md5('42|' || r.r || '|' || event_id), 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM prov CROSS JOIN (SELECT unnest(range(1, 11)) AS r) r),
  w AS (SELECT replicate, label, (u >= 0.36787944117144233)::INTEGER + (u >= 0.73575888234288467)::INTEGER + (u >= 0.91969860292860584)::INTEGER + (u >= 0.98101184312384626)::INTEGER + (u >= 0.99634015317265634)::INTEGER + (u >= 0.99940581518241833)::INTEGER + (u >= 0.99991675885071197)::INTEGER + (u >= 0.99998975080332531)::INTEGER AS w FROM u)
SELECT replicate, sum(w)::BIGINT AS rows, round(sum(w * label) / sum(w), 9) AS rate FROM w GROUP BY replicate""")
def d14_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = s.bootstrap(edges(spark, sf_dir), 10, "event_id")
    return t.groupBy("replicate").agg(F.sum("weight").alias("rows"), F.round(F.sum(F.col("weight") * F.col("label")) / F.sum("weight"), 9).alias("rate"))


#: The Poisson distribution function at 0 to 7, as ``bootstrap`` has it.
POISSON = (0.36787944117144233, 0.73575888234288467, 0.91969860292860584, 0.98101184312384626, 0.99634015317265634, 0.99940581518241833, 0.99991675885071197, 0.99998975080332531)


@query(f"""WITH {SCORES}, u AS (SELECT r AS replicate, score, label, ('0x' || left(md5('42|' || r || '|' || entity), 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM scores CROSS JOIN (SELECT unnest(range(1, 21)) AS r)),
  w AS (SELECT replicate, score, label, {" + ".join(f"(u >= {x!r})::INTEGER" for x in POISSON)} AS w FROM u),
  t AS (SELECT replicate, score, sum(w * label)::DOUBLE AS pos, sum(w * (1 - label))::DOUBLE AS neg FROM w WHERE w > 0 GROUP BY ALL),
  c AS (SELECT *, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER a AS p, sum(neg) OVER a AS n FROM t WINDOW d AS (PARTITION BY replicate ORDER BY score DESC), a AS (PARTITION BY replicate)),
  m AS (SELECT sum(pos * (n - fp + neg / 2)) / (max(p) * max(n)) AS auc, sum(pos / p * tp / (tp + fp)) AS ap FROM c GROUP BY replicate)
SELECT {", ".join(f"round(quantile_cont({c}, {q}), 9) AS {c}_{n}" for c in ("auc", "ap") for n, q in (("low", 0.025), ("high", 0.975)))} FROM m""")
def d14_bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """95 % intervals of AUC and average precision over weighted replicates."""
    # a row costs a digest a replicate, whatever its bytes: tasks by cores, not by the file's blocks
    rows = scores(spark, sf_dir).select("entity", "score", "label").repartition(2 * spark.sparkContext.defaultParallelism, "entity")
    drawn = s.bootstrap(rows, 20, "entity")
    # the rows are drawn once; what both metrics read again is a row for each replicate, score and label
    sc = written(drawn.groupBy("replicate", "score", "label").agg(F.sum("weight").alias("weight")), "replicates")
    parts = [f(sc, ["replicate"], F.col("weight")) for f in (m.roc_auc, m.average_precision)]
    both = reduce(lambda a, b: a.join(b, "replicate"), parts)
    return both.agg(*[F.round(F.percentile(c, F.lit(p)), 9).alias(f"{c}_{n}") for c in ("auc", "ap") for n, p in (("low", 0.025), ("high", 0.975))])  # one row a replicate


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 100")
def d15_random_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.random_rows(load(spark, sf_dir, "documents"), 100, ["doc_id"]).select("doc_id")


@query(f"WITH {PROV}, a AS (SELECT DISTINCT dst_id FROM prov WHERE score > 120), b AS (SELECT DISTINCT dst_id FROM prov WHERE size > 70), u AS (SELECT coalesce(a.dst_id, b.dst_id) AS n, a.dst_id IS NOT NULL AS x, b.dst_id IS NOT NULL AS y FROM a FULL JOIN b USING (dst_id)) SELECT count(*) FILTER (x AND y) AS both, count(*) FILTER (x AND NOT y) AS a_only, count(*) FILTER (NOT x AND y) AS b_only, count(*) FILTER (x AND y) / count(*) AS jaccard FROM u")
def j13_verdict_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir).withColumnRenamed("dst_id", "node")
    return serving.verdict_overlap(e.where("score > 120"), e.where("size > 70"))


@query("SELECT count(*) AS rows, count(*) FILTER (text IN (SELECT text FROM documents WHERE doc_id % 5 <> 0)) AS leaked FROM documents WHERE doc_id % 5 = 0")
def j14_split_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    return serving.split_leak(d.where("doc_id % 5 <> 0"), d.where("doc_id % 5 = 0"), ["text"])
