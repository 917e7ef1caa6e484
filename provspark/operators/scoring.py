"""Features, detectors and scores on Spark ML or plain column algebra."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, StandardScaler, StringIndexer, VectorAssembler, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provspark.operators import ranks
from provspark.operators.graph import node_mean_loss, written
from provspark.operators.metrics import roc_auc


def word2vec(docs: DataFrame, size: int = 30, window: int = 5, min_count: int = 1, seed: int = 42, iterations: int = 1) -> DataFrame:
    """(word, vector) learnt from token arrays (column tokens)."""
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, seed=seed, maxIter=iterations, inputCol="tokens", outputCol="v").fit(docs)
    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))


def position_code(place: Column, size: int) -> Column:
    """Sinusoidal code of a position from 0."""
    part = lambda i: (F.sin if i % 2 == 0 else F.cos)(place / F.lit(10000.0 ** (2 * (i // 2) / size)))
    return F.array(*[part(i) for i in range(size)])


def embed_documents(docs: DataFrame, vectors: DataFrame, size: int, long_from: int = 100_000) -> DataFrame:
    """(node, embedding): mean of known tokens' vectors plus position codes; zeros if none is known.

    Documents of ``long_from`` known tokens and more go without position codes.
    ``docs`` has node and tokens, and where they come in pieces chunk (from 0,
    in order); a token's position is its place in its piece and the known tokens
    of the pieces before it, so pieces give what whole documents give.
    """
    pieces = docs if "chunk" in docs.columns else docs.withColumn("chunk", F.lit(0).cast("long"))
    words = pieces.select("node", "chunk", F.posexplode("tokens").alias("at", "word")).join(vectors, "word")
    each, earlier = Window.partitionBy("node"), Window.partitionBy("node").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = words.groupBy("node", "chunk").agg(F.count("*").alias("n")).select("node", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(each).alias("known"))
    place = F.row_number().over(Window.partitionBy("node", "chunk").orderBy("at")) - 1
    ranked = words.withColumn("place", place).join(before, ["node", "chunk"]).withColumn("place", F.col("place") + F.col("before"))
    code = F.when(F.col("known") < long_from, position_code(F.col("place"), size)).otherwise(F.array_repeat(F.lit(0.0), size))
    summed = ranked.withColumn("x", F.zip_with("vector", code, lambda a, b: a + b)).groupBy("node").agg(F.array(*[F.avg(F.element_at("x", i + 1)) for i in range(size)]).alias("embedding"))
    return docs.select("node").distinct().join(summed, "node", "left").withColumn("embedding", F.coalesce("embedding", F.array_repeat(F.lit(0.0), size)))


def tfidf(docs: DataFrame, features: int = 8000) -> DataFrame:
    """``docs`` with a length-one tf-idf vector (column tfidf) of token arrays; idf is ln((n + 1) / (df + 1)) + 1."""
    counts = CountVectorizer(vocabSize=features, inputCol="tokens", outputCol="_tf").fit(docs).transform(docs)
    weighed = IDF(inputCol="_tf", outputCol="_idf").fit(counts).transform(counts)
    sum_ = F.zip_with(vector_to_array("_tf"), vector_to_array("_idf"), lambda a, b: a + b)
    return Normalizer(inputCol="_sum", outputCol="tfidf").transform(weighed.withColumn("_sum", array_to_vector(sum_))).drop("_tf", "_idf", "_sum")


def folded_categories(train: DataFrame, columns: list[str], keep: int = 30) -> dict[str, list[str]]:
    """The most frequent values of each category in training; all others share one."""
    out = {}
    for c in columns:
        top = train.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(keep)
        out[c] = [r[0] for r in top.collect()]  # at most ``keep`` rows
    return out


def with_categories(df: DataFrame, kept: dict[str, list[str]]) -> DataFrame:
    return df.withColumns({f"{c}_cat": F.when(F.col(c).isin(v), F.col(c)).when(F.col(c).isNull(), "(missing)").otherwise("(other)") for c, v in kept.items()})


def class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """``df`` with weights that make both classes count alike."""
    rate = df.agg(F.avg(label).alias("_rate"))
    w = F.when(F.col(label) == 1, 0.5 / F.greatest("_rate", F.lit(1e-9))).otherwise(0.5 / F.greatest(1 - F.col("_rate"), F.lit(1e-9)))
    return df.crossJoin(F.broadcast(rate)).withColumn("weight", w).drop("_rate")  # one row


def train_edge_classifier(train: DataFrame, numeric: list[str], categorical: list[str] = [], rounds: int = 20, validation: str | None = None, seed: int = 42) -> tuple[PipelineModel, dict[str, list[str]]]:  # noqa: B006
    """Boosted trees with class weights; early stopping where a boolean ``validation`` column is given."""
    kept = folded_categories(train, categorical)
    stages = [StringIndexer(inputCols=[f"{c}_cat" for c in kept], outputCols=[f"{c}_idx" for c in kept], handleInvalid="keep")] if kept else []
    stages.append(VectorAssembler(inputCols=[*numeric, *[f"{c}_idx" for c in kept]], outputCol="features", handleInvalid="keep"))
    gbt = GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxIter=rounds, seed=seed, maxBins=64)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    stages.append(gbt)
    return Pipeline(stages=stages).fit(with_categories(class_weight(train), kept).fillna(-1.0, numeric)), kept


def score_edges(df: DataFrame, model: PipelineModel, kept: dict[str, list[str]], numeric: list[str]) -> DataFrame:
    """``df`` with the probability of label 1 as score."""
    scored = model.transform(with_categories(df, kept).fillna(-1.0, numeric))
    return scored.select(*df.columns, vector_to_array("probability")[1].alias("score"))


def novelty_density(train: DataFrame, test: DataFrame, columns: list[str], seed: int = 42) -> DataFrame:
    """``test`` with the probability of being background: a forest tells training rows from uniform ones."""
    from provspark.operators.splits import uniform_background

    background = uniform_background(train, columns, train.count(), seed).withColumn("label", F.lit(1.0))
    both = train.select(*columns).withColumn("label", F.lit(0.0)).unionByName(background)
    assemble = VectorAssembler(inputCols=columns, outputCol="features")
    forest = RandomForestClassifier(labelCol="label", numTrees=20, maxDepth=6, seed=seed)
    return Pipeline(stages=[assemble, forest]).fit(both).transform(test).select(*test.columns, vector_to_array("probability")[1].alias("score"))


def grow_tree(x: np.ndarray, depth: int, rng: np.random.Generator) -> tuple:
    """An isolation tree: (column, cut, left, right) or (size,)."""
    spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) > 1 else np.zeros(0, int)
    if not depth or not len(spread):
        return (len(x),)
    column = int(rng.choice(spread))
    cut = float(rng.uniform(x[:, column].min(), x[:, column].max()))
    left = x[:, column] < cut
    return column, cut, grow_tree(x[left], depth - 1, rng), grow_tree(x[~left], depth - 1, rng)


def mean_path(n: int) -> float:
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def path_lengths(tree: tuple, x: np.ndarray, depth: int = 0) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), depth + mean_path(tree[0]))
    out, left = np.empty(len(x)), x[:, tree[0]] < tree[1]
    out[left], out[~left] = path_lengths(tree[2], x[left], depth + 1), path_lengths(tree[3], x[~left], depth + 1)
    return out


def isolation_forest(train: DataFrame, test: DataFrame, columns: list[str], trees: int = 50, sample: int = 256, key: str = "node") -> DataFrame:
    """``test`` with an anomaly score in (0, 1]. Each tree grows in a task of its own from ``sample`` rows drawn by hash."""
    # each row goes to the few trees whose draw it may win; the ranks run over about four times the sample
    share = F.lit(min(1.0, 4 * sample / max(train.count(), 1)) * (1 << 30))
    near = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64(t, F.col(key), F.lit("draw")), F.lit(1 << 30)) < share)
    each = train.select(key, *columns).withColumn("tree", F.explode(near))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.xxhash64("tree", key), key))
    drawn = each.withColumn("_r", rank).where(F.col("_r") <= sample)

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        import pickle

        x = group[columns].to_numpy(float)
        tree = grow_tree(x, int(np.ceil(np.log2(sample))), np.random.default_rng(int(group["tree"].iloc[0])))
        return pd.DataFrame([{"tree": int(group["tree"].iloc[0]), "n": len(x), "model": pickle.dumps(tree)}])

    grown = drawn.groupBy("tree").applyInPandas(grow, "tree int, n int, model binary").orderBy("tree").collect()  # ``trees`` small rows
    models = [(bytes(r["model"]), r["n"]) for r in grown]

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        import pickle

        forest = [pickle.loads(m) for m, _ in models]
        for cols in batches:
            x = np.stack([c.to_numpy(float) for c in cols], axis=1)
            mean = np.mean([path_lengths(tree, x) for tree in forest], axis=0)
            yield pd.Series(2.0 ** (-mean / max(mean_path(models[0][1]), 1e-9)))

    return test.withColumn("score", score(*[F.col(c).cast("double") for c in columns]))


def embedding_norm(df: DataFrame, column: str = "embedding") -> DataFrame:
    """``df`` with score, the negated length of the vector, and unknown, whether it is zero."""
    norm = F.sqrt(F.aggregate(F.transform(column, lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x * x))
    return df.withColumn("score", -norm).withColumn("unknown", (norm == 0).cast("int"))


def confidence(probabilities: Column) -> Column:
    """(p1 - p2) / p1 of the two greatest probabilities."""
    top = F.sort_array(probabilities, asc=False)
    first, second = F.get(top, F.lit(0)), F.coalesce(F.get(top, F.lit(1)), F.lit(0.0))
    return F.when(first > 0, (first - second) / first).otherwise(0.0)


def normalised_confidence(df: DataFrame, by: list[str], method: str = "min_max", column: str = "confidence") -> DataFrame:
    """Rescaled within ``by``: min_max (c - min) / (max - min), or max (c - min) / max; constants become 0."""
    w = Window.partitionBy(*by)
    low, high, c = F.min(column).over(w), F.max(column).over(w), F.col(column)
    below = high - low if method == "min_max" else high
    return df.withColumn(column, F.when(below > 0, (c - low) / below).otherwise(0.0))


def explain_away(rounds: DataFrame, threshold: float) -> DataFrame:
    """(node, seed): a node stays suspicious unless some round typed it right with confidence over the threshold.

    ``rounds`` has node, type, predicted, confidence.
    """
    away = (F.col("type") == F.col("predicted")) & (F.col("confidence") > threshold)
    return rounds.groupBy("node").agg((1 - F.max(away.cast("int"))).alias("seed"))


def explain_away_score(rounds: DataFrame) -> DataFrame:
    """(node, score): 1 - confidence where typed right, else 1; the least over the rounds."""
    return rounds.groupBy("node").agg(F.min(F.when(F.col("type") == F.col("predicted"), 1 - F.col("confidence")).otherwise(1.0)).alias("score"))


def residual_rounds(df: DataFrame, columns: list[str], label: str = "type", limit: int = 20, sure: float = 0.9) -> DataFrame:
    """(node, type, predicted, confidence, round): classifiers trained in turn on the nodes that are still hard."""
    indexed = StringIndexer(inputCol=label, outputCol="_y").fit(df)
    names = F.array(*[F.lit(x) for x in indexed.labels])
    left = VectorAssembler(inputCols=columns, outputCol="features").transform(indexed.transform(df)).select("node", label, "_y", "features")
    every, out = left, []
    for r in range(limit):
        if left.select("_y").distinct().count() < 2:
            break
        model = LogisticRegression(labelCol="_y", maxIter=20, regParam=0.01).fit(left)
        told = model.transform(every).select("node", F.col(label).alias("type"), F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted"), confidence(vector_to_array("probability")).alias("confidence"))
        told = written(told.withColumn("round", F.lit(r)), "round")
        out.append(told)
        hard = told.where((F.col("type") != F.col("predicted")) | (F.col("confidence") < sure)).select("node")
        left = left.join(hard, "node", "left_semi")
    if not out:  # one class from the start: nothing to train
        return df.select("node", F.col(label).alias("type"), F.lit("").alias("predicted"), F.lit(0.0).alias("confidence"), F.lit(0).alias("round")).limit(0)
    return reduce(DataFrame.unionByName, out)


def action_reconstruction(edges: DataFrame, features: DataFrame, size: int) -> DataFrame:
    """(node, score): mean surprise -log P(action | both ends) of a node's edges under a multinomial linear model."""
    ends = lambda end: features.select(F.col("node").alias(f"{end}_id"), F.col("features").alias(f"_{end}"))
    joined = edges.join(ends("src"), "src_id").join(ends("dst"), "dst_id").withColumn("_x", array_to_vector(F.concat("_src", "_dst")))
    indexed = StringIndexer(inputCol="edge_type", outputCol="_y").fit(joined).transform(joined)
    model = LogisticRegression(featuresCol="_x", labelCol="_y", family="multinomial", maxIter=20, regParam=0.001).fit(indexed)
    p = F.element_at(vector_to_array("probability"), F.col("_y").cast("int") + 1)
    return node_mean_loss(model.transform(indexed).select("src_id", "dst_id", (-F.log(F.greatest(p, F.lit(1e-12)))).alias("loss")))


def composition_table(train: DataFrame) -> DataFrame:
    """(src_type, dst_type, edge_type, p): P(action | types), add-one over all actions seen in training."""
    actions = train.select("edge_type").distinct()
    pairs = train.select("src_type", "dst_type").distinct()
    counts = train.groupBy("src_type", "dst_type", "edge_type").agg(F.count("*").alias("c"))
    grid = pairs.crossJoin(F.broadcast(actions)).join(counts, ["src_type", "dst_type", "edge_type"], "left")  # both enumerations
    pair = Window.partitionBy("src_type", "dst_type")
    c = F.coalesce("c", F.lit(0))
    return grid.select("src_type", "dst_type", "edge_type", ((c + 1) / (F.sum(c).over(pair) + F.count("*").over(pair))).alias("p"))


def composition_floor(train: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, score): mean of -log P(action | types) over a node's edges; unseen combinations take the rarest action's share."""
    table = composition_table(train)
    rarest = train.groupBy("edge_type").agg(F.count("*").alias("c")).agg((F.lit(1.0) / (F.sum("c") + F.count("*"))).alias("_rare"))
    joined = edges.join(table, ["src_type", "dst_type", "edge_type"], "left").crossJoin(F.broadcast(rarest))  # one row
    return node_mean_loss(joined.select("src_id", "dst_id", (-F.log(F.coalesce("p", "_rare"))).alias("loss")))


def frequency_floor(train: DataFrame, by: str, label: str = "label") -> DataFrame:
    """(by, p): (malicious + 1) / (all + 2)."""
    return train.groupBy(by).agg(((F.sum(label) + 1) / (F.count("*") + 2)).alias("p"))


def calibrate_quantile(benign: DataFrame, scored: DataFrame, q: float = 0.99) -> DataFrame:
    """``scored`` with flagged: over the benign scores' quantile."""
    cut = ranks.percentiles(benign, "score", {"_cut": q})
    return scored.crossJoin(F.broadcast(cut)).withColumn("flagged", (F.col("score") > F.col("_cut")).cast("int")).drop("_cut")  # one row


def threshold_seeds(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.where(F.col("score") > threshold)


def attach_scores(nodes: DataFrame, scores: DataFrame) -> DataFrame:
    """``nodes`` with the latest score of each uuid (uuid, score, scored_at), whatever its label."""
    latest = scores.groupBy("uuid").agg(F.max_by("score", F.struct("scored_at", "score")).alias("score"), F.max("scored_at").alias("scored_at"))
    return nodes.join(latest, "uuid", "left")


def kmeans_prototypes(attacks: DataFrame, df: DataFrame, column: str = "embedding", k: int = 8, seed: int = 42) -> DataFrame:
    """``df`` with score: minus the distance to the nearest of up to ``k`` prototypes of the attack vectors."""
    as_vector = lambda t: t.withColumn("features", array_to_vector(F.transform(column, lambda x: x.cast("double"))))
    model = KMeans(k=k, seed=seed, maxIter=20).fit(as_vector(attacks))
    centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.clusterCenters()])  # k vectors
    near = lambda c: F.aggregate(F.zip_with(F.col(column), c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return df.withColumn("score", -F.sqrt(F.array_min(F.transform(centres, near))))


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with scaled: zero mean and unit deviation for each of the columns."""
    assembled = VectorAssembler(inputCols=columns, outputCol="_x").transform(df)
    return StandardScaler(inputCol="_x", outputCol="_s", withMean=True).fit(assembled).transform(assembled).withColumn("scaled", vector_to_array("_s")).drop("_x", "_s")


def _importance(each: DataFrame, model: PipelineModel, kept: dict[str, list[str]], numeric: list[str]) -> DataFrame:
    """(feature, auc, drop) of variants of the same rows, told apart by ``feature``; those of feature '' are unchanged."""
    auc = written(roc_auc(score_edges(each, model, kept, numeric), ["feature"]), "auc")
    base = auc.where("feature = ''").select(F.col("auc").alias("_base"))
    return auc.where("feature <> ''").crossJoin(F.broadcast(base)).select("feature", "auc", (F.col("_base") - F.col("auc")).alias("drop"))  # one row


def _variants(df: DataFrame, columns: list[str], changed: dict[str, Column]) -> DataFrame:
    """(feature, label, columns): each row as it is and once for each feature, with that feature changed."""
    each = df.withColumn("feature", F.explode(F.array(F.lit(""), *map(F.lit, columns))))
    return each.select("feature", "label", *[F.when(F.col("feature") == c, changed[c]).otherwise(F.col(c)).alias(c) for c in columns])


def feature_knockout(df: DataFrame, model: PipelineModel, kept: dict[str, list[str]], numeric: list[str]) -> DataFrame:
    """(feature, auc, drop): AUC with each feature missing, and how much is lost; all features in one pass."""
    columns = [*numeric, *kept]
    gone = {c: F.lit(None).cast(dict(df.dtypes)[c]) for c in columns}
    return _importance(_variants(df.select("label", *columns), columns, gone), model, kept, numeric)


def dealt(df: DataFrame, columns: list[str], key: str, seed: int = 42) -> DataFrame:
    """(label, columns, given): with each row, the columns of the row before it in hash order, the last row's with the first.

    That is one random cycle through all rows, so that no row keeps its own
    values if there are two. Rows are numbered in ranges by hash and meet in
    one join on the number, whatever the number of columns.
    """
    order = F.xxhash64(F.col(key), F.lit(seed))
    rows = df.select("label", *columns, order.alias("_order"), F.col(key).alias("_key"), F.lit(0).alias("_all"))
    placed = written(ranks.numbered(rows, "_all", [F.col("_order"), F.col("_key")]).drop("_order", "_key", "_all"), "dealt")
    following = F.pmod(F.col("position") + 1, F.lit(max(placed.count(), 1)))
    given = placed.select(following.alias("position"), F.struct(*columns).alias("given"))
    return placed.join(given, "position").drop("position")


def permutation_importance(df: DataFrame, model: PipelineModel, kept: dict[str, list[str]], numeric: list[str], key: str, seed: int = 42) -> DataFrame:
    """(feature, auc, drop): AUC with each feature's values dealt to other rows at random, all features by one shuffle."""
    columns = [*numeric, *kept]
    other = {c: F.col(f"given.{c}") for c in columns}
    return _importance(_variants(dealt(df, columns, key, seed), columns, other), model, kept, numeric)


def pooled_embedding(df: DataFrame, by: str, column: str, size: int, weight: str | None = None) -> DataFrame:
    """(by, pooled): mean vector of each group, or mean weighted by the softmax of a column."""
    if weight is None:
        return df.groupBy(by).agg(F.array(*[F.avg(F.element_at(column, i + 1)) for i in range(size)]).alias("pooled"))
    t = df.withColumn("_w", F.exp(F.col(weight) - F.max(weight).over(Window.partitionBy(by))))
    return t.groupBy(by).agg(F.array(*[F.sum(F.element_at(column, i + 1) * F.col("_w")) / F.sum("_w") for i in range(size)]).alias("pooled"))


def composition_vector(df: DataFrame, by: str, kind: str, kinds: list[str]) -> DataFrame:
    """(by, share of each kind)."""
    return df.groupBy(by).agg(*[(F.count_if(F.col(kind) == k) / F.count("*")).alias(k) for k in kinds])
