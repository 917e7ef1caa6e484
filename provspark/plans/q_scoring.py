"""Learned and statistical scores. Trained results have no SQL; tests check their quality and determinism."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.functions import ids
from provspark.functions.features import FEATURES, engineer_features, model_columns
from provspark.operators import graph as g
from provspark.operators import metrics as m
from provspark.operators import scoring as sc
from provspark.operators import splits as s
from provspark.operators.parsers import parse_logs
from provspark.plans.adapt import PROV, edges, load
from provspark.plans.q_functions import INPUTS_SQL, _features_sql, raw_lines
from provspark.plans.registry import query


def node_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.documents_of(edges(spark, sf_dir), F.concat(F.array("edge_type"), ids.subtokens(F.col("dst_name"))))


def edge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as a classification problem: is it a DELETE, from size, score and names."""
    return edges(spark, sf_dir).select("event_id", F.col("size").cast("double").alias("size"), F.col("score").alias("value"), "src_name", "dst_name", "endpoint_id", "label", "ts")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), "label")


@query()
def l1_l2_document_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word2Vec on node documents, then mean vectors with positions; equal documents are embedded once."""
    docs = node_docs(spark, sf_dir)
    words = sc.word2vec(docs, size=8)
    keyed = docs.withColumn("key", F.xxhash64("tokens"))
    once = keyed.groupBy("key").agg(F.first("tokens").alias("tokens"), F.min("node").alias("node"))
    embedded = once.select("key", "node").join(sc.embed_documents(once.select("node", "tokens"), words, 8), "node").select("key", "embedding")
    return keyed.select("node", "key").join(embedded, "key").select("node", F.transform("embedding", lambda x: F.round(x, 4)).alias("embedding"))


#: Documents of nodes word by word; those of DELETE alone go.
WORDS = f"""{PROV}, ends AS (SELECT src_id AS node, edge_type, dst_name FROM prov UNION ALL SELECT dst_id, edge_type, dst_name FROM prov),
  docs AS (SELECT node, unnest([edge_type] || list_filter(regexp_split_to_array(lower(dst_name), '[\\\\/.:\\-_]+'), lambda p: len(p) > 0 AND len(p) < 40 AND NOT regexp_matches(p, '^\\d+$'))) AS word FROM ends),
  words AS (SELECT node, word, count(*) AS c FROM docs GROUP BY node, word QUALIFY NOT (sum(count(*)) OVER (PARTITION BY node) = 1 AND word = 'DELETE'))"""


@query(f"""WITH {WORDS}, d AS (SELECT word, count(*) AS df FROM words GROUP BY word), w AS (SELECT node, c * (1 + ln(((SELECT count(DISTINCT node) FROM words) + 1) / (df + 1))) AS x FROM words JOIN d USING (word)),
  v AS (SELECT node, x / sqrt(sum(x * x) OVER (PARTITION BY node)) AS x FROM w) SELECT node, list(round(x, 6) ORDER BY x DESC) AS weights FROM v GROUP BY node""")
def l3_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node's weights, greatest first."""
    from pyspark.ml.functions import vector_to_array

    t = sc.tfidf(node_docs(spark, sf_dir), 1_000)
    return t.select("node", F.transform(F.sort_array(F.filter(vector_to_array("tfidf"), lambda x: x > 0), asc=False), lambda x: F.round(x, 6)).alias("weights"))


@query()
def l4_l22_edge_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of test edges by trees trained on the earlier ones, with early stopping."""
    rows = s.temporal_split(edge_rows(spark, sf_dir), "ts")
    train = rows.where("split <> 'test'").withColumn("is_val", F.col("split") == "val")
    model, kept = sc.train_edge_classifier(train, ["size", "value"], ["dst_name"], rounds=5, validation="is_val")
    return sc.score_edges(rows.where("split = 'test'").drop("split"), model, kept, ["size", "value"]).select("event_id", "label", F.round("score", 6).alias("score"))


@query()
def l5_supervised_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    labels = e.groupBy(F.col("dst_id").alias("node")).agg(F.max("label").alias("label"))
    rows = g.structural_features(e).join(labels, "node")
    numeric = ["out_degree", "in_degree", "in_neighbours"]
    model, kept = sc.train_edge_classifier(rows, numeric, ["first_type"], rounds=3)
    return sc.score_edges(rows, model, kept, numeric).select("node", "label", F.round("score", 6).alias("score"))


def node_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.structural_features(edges(spark, sf_dir)).select("node", *[F.col(c).cast("double").alias(c) for c in ("out_degree", "in_degree", "out_neighbours")])


@query()
def l6_novelty_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = node_numbers(spark, sf_dir)
    return sc.novelty_density(n, n, ["out_degree", "in_degree"]).select("node", F.round("score", 4).alias("score"))


@query()
def l7_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = node_numbers(spark, sf_dir)
    return sc.isolation_forest(n, n, ["out_degree", "in_degree", "out_neighbours"], trees=10).select("node", F.round("score", 6).alias("score"))


@query("SELECT vec_id, round(-sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS score, 0 AS unknown FROM embeddings")
def l8_embedding_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.embedding_norm(vectors(spark, sf_dir)).select(F.col("node").alias("vec_id"), F.round("score", 6).alias("score"), "unknown")


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type guesses of three rounds for each node, from its events."""
    e = edges(spark, sf_dir)
    guess = F.element_at(F.array(F.lit("FILE"), F.lit("SOCKET"), F.col("dst_type")), (F.col("size") % 3 + 1).cast("int"))
    return e.select(F.col("dst_id").alias("node"), F.col("dst_type").alias("type"), guess.alias("predicted"), (F.col("size") / 100).alias("confidence"), (F.col("size") % 4).alias("host"))


ROUNDS = "rounds AS (SELECT dst_id AS node, dst_type AS type, ['FILE', 'SOCKET', dst_type][size % 3 + 1] AS predicted, size / 100 AS confidence, size % 4 AS host FROM prov)"


@query(f"WITH {PROV}, {ROUNDS} SELECT node, 1 - max((type = predicted AND confidence > 0.5)::INTEGER) AS seed, round(min(CASE WHEN type = predicted THEN 1 - confidence ELSE 1 END), 9) AS score FROM rounds GROUP BY node")
def l9_l11_explain_away(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rounds(spark, sf_dir)
    return sc.explain_away(r, 0.5).join(sc.explain_away_score(r), "node").withColumn("score", F.round("score", 9))


@query(f"WITH {PROV}, {ROUNDS} SELECT host, round(avg(CASE WHEN hi > lo THEN (confidence - lo) / (hi - lo) ELSE 0 END), 6) AS min_max, round(avg(CASE WHEN hi > 0 THEN (confidence - lo) / hi ELSE 0 END), 6) AS by_max FROM (SELECT *, min(confidence) OVER w AS lo, max(confidence) OVER w AS hi FROM rounds WINDOW w AS (PARTITION BY host)) GROUP BY host")
def l9_confidence_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rounds(spark, sf_dir)
    mean = lambda method, name: sc.normalised_confidence(r, ["host"], method).groupBy("host").agg(F.round(F.avg("confidence"), 6).alias(name))
    return mean("min_max", "min_max").join(mean("max", "by_max"), "host")


@query()
def l10_residual_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = g.structural_features(edges(spark, sf_dir)).select("node", F.col("first_type").alias("type"), *[F.col(c).cast("double").alias(c) for c in ("out_degree", "in_degree")])
    told = sc.residual_rounds(n, ["out_degree", "in_degree"], limit=2)
    return sc.explain_away(told, 0.5)


@query()
def l12_action_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    f = g.neighbour_type_histogram(e)
    features = f.select("node", F.array(*f.columns[1:]).alias("features"))
    return sc.action_reconstruction(e, features, 6).select("node", F.round("score", 4).alias("score"))


@query(f"WITH {PROV}, c AS (SELECT quantile_cont(score, 0.99) AS c FROM prov WHERE label = 0) SELECT event_id, (score > c)::INTEGER AS flagged FROM prov CROSS JOIN c WHERE score > 20")
def l14_l15_calibrated_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return sc.threshold_seeds(sc.calibrate_quantile(e.where("label = 0"), e), 20.0).select("event_id", "flagged")


@query(f"WITH {PROV}, n AS (SELECT DISTINCT dst_id AS uuid FROM prov) SELECT uuid, arg_max(score, (ts, score)) AS score, coalesce(max(ts), 0) AS scored_at FROM n LEFT JOIN prov ON dst_id = uuid AND size % 3 = 0 GROUP BY uuid")
def l16_attach_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    told = e.where("size % 3 = 0").select(F.col("dst_id").alias("uuid"), "score", F.col("ts").alias("scored_at"))
    return sc.attach_scores(e.select(F.col("dst_id").alias("uuid")).distinct(), told).withColumn("scored_at", F.coalesce("scored_at", F.lit(0)))


@query()
def l17_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return sc.kmeans_prototypes(v.where("label = 1"), v, k=4).select("node", F.round("score", 6).alias("score"))


@query()
def l18_l19_knockout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Can the origin be told from the features, and which of them tell it."""
    rows = edge_rows(spark, sf_dir).withColumn("label", (F.col("endpoint_id") == "host1").cast("int"))
    model, kept = sc.train_edge_classifier(rows, ["size", "value"], ["src_name"], rounds=2)
    t = sc.feature_knockout(rows, model, kept, ["size", "value"])
    return t.select("feature", F.round("auc", 6).alias("auc"), F.round("drop", 6).alias("drop"))


@query()
def l20_permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edge_rows(spark, sf_dir)
    model, kept = sc.train_edge_classifier(rows, ["size", "value"], ["dst_name"], rounds=2)
    return sc.permutation_importance(rows, model, kept, ["size", "value"], "event_id").select("feature", F.round("auc", 6).alias("auc"), F.round("drop", 6).alias("drop"))


@query(f"WITH {PROV}, s AS (SELECT avg(size) AS a, stddev_samp(size) AS d, avg(score) AS b, stddev_samp(score) AS e FROM prov) SELECT event_id, round((size - a) / d, 6) AS size_z, round((score - b) / e, 6) AS score_z FROM prov CROSS JOIN s")
def l21_standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = sc.standard_scale(edges(spark, sf_dir), ["size", "score"])
    return t.select("event_id", F.round(F.get("scaled", F.lit(0)), 6).alias("size_z"), F.round(F.get("scaled", F.lit(1)), 6).alias("score_z"))


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), p AS (SELECT vec_id, label, sum(v * v) AS q FROM x GROUP BY ALL),
  y AS (SELECT label AS c, i, sum(v) AS y FROM x GROUP BY ALL), c AS (SELECT label AS c, count(*) AS n, sum(q) AS psi FROM p GROUP BY label),
  dots AS (SELECT vec_id, y.c, sum(v * y) AS dot FROM x JOIN y USING (i) GROUP BY ALL), d AS (SELECT vec_id, p.label = c.c AS own, n, q + psi / n - 2 * dot / n AS d FROM p JOIN dots USING (vec_id) JOIN c USING (c)),
  s AS (SELECT vec_id, max(CASE WHEN own THEN n END) AS n, max(CASE WHEN own THEN d * n / (n - 1) END) AS a, min(CASE WHEN NOT own THEN d END) AS b FROM d GROUP BY vec_id)
SELECT count(*) AS vectors, round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s""")
def l21_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    v = vectors(spark, sf_dir).select(array_to_vector("embedding").alias("features"), F.col("label").cast("int").alias("prediction"))
    value = ClusteringEvaluator().evaluate(v)
    return v.agg(F.count("*").alias("vectors")).withColumn("silhouette", F.round(F.lit(value), 6))


FEATURE_NAMES = ", ".join(model_columns(list(FEATURES)))


@query(f"SELECT event_id, subject_type, edge_type, {FEATURE_NAMES} FROM ({_features_sql(INPUTS_SQL, 'subject_type, edge_type, ')})")
def f63_featurize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed lines with all behavioural features, as a model sees them."""
    p = parse_logs(raw_lines(spark, sf_dir))
    get = lambda k: F.element_at("fields", k)
    target = F.when(F.col("object_type") == "FILE", F.col("object_name"))
    t = engineer_features(p, image=get("image"), parent_image=get("parent_image"), command_line=get("command_line"), target=target, registry_key=get("registry_key"), http_uri=get("http_uri"))
    return t.select("event_id", "subject_type", "edge_type", *model_columns(list(FEATURES)))


@query(f"WITH {PROV}, t AS (SELECT score, sum(label) AS pos, count(*) AS n FROM prov GROUP BY score) SELECT count(*) AS scores, sum(n)::BIGINT AS rows FROM t")
def m_distinct_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many score groups the ranking windows run over."""
    t = m._score_table(edges(spark, sf_dir), [])
    return t.agg(F.count("*").alias("scores"), F.sum(F.col("pos") + F.col("neg")).alias("rows"))
