"""Learned scores against plain numpy versions of what they compute, and on data whose answer is known."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from provspark.operators import scoring as sc
from provspark.operators.metrics import roc_auc


def test_document_embeddings_are_means_with_positions(spark):
    vectors = {"a": [1.0, 0.0, 2.0, 0.5], "b": [0.0, 4.0, 1.0, 1.0], "c": [2.0, 2.0, 2.0, 2.0]}
    docs = {"x": ["a", "b", "a"], "y": ["c", "unknown", "b"], "z": ["unknown"], "w": [], "long": ["a", "b", "c"] * 3}
    t = sc.embed_documents(spark.createDataFrame(list(docs.items()), "node string, tokens array<string>"), spark.createDataFrame(list(vectors.items()), "word string, vector array<double>"), 4, long_from=9)
    got = {r["node"]: r["embedding"] for r in t.collect()}
    for node, tokens in docs.items():
        known = [vectors[w] for w in tokens if w in vectors]
        code = lambda p: [(math.sin, math.cos)[i % 2](p / 10000 ** (2 * (i // 2) / 4)) for i in range(4)]
        rows = [np.array(v) + (np.array(code(p)) if len(known) < 9 else 0) for p, v in enumerate(known)]
        assert got[node] == pytest.approx(list(np.mean(rows, axis=0)) if rows else [0.0] * 4), node


def test_pieces_of_documents_embed_as_the_whole(spark, monkeypatch):
    from provspark.operators import graph as g

    monkeypatch.setattr(sc.ranks.numbered, "__defaults__", (False, 50))  # the hub lies in many ranges
    rows = [(f"e{i:04}", "hub" if i % 3 else f"p{i % 5}", f"f{i % 40}", i // 2, "DELETE" if i % 7 == 0 else "READ") for i in range(300)]
    rows += [("x1", "lone", "lone2", 5, "DELETE"), ("x2", None, "f1", 6, "READ")]
    e = spark.createDataFrame(rows, "event_id string, src_id string, dst_id string, ts long, edge_type string")
    tokens = F.when(F.col("edge_type") == "DELETE", F.array("edge_type")).otherwise(F.array("edge_type", "dst_id"))
    whole = {r["node"]: r["tokens"] for r in g.documents_of(e, tokens).where("node IS NOT NULL").collect()}
    chunks = g.document_chunks(e, tokens, 8).cache()
    got = {}
    for r in sorted(chunks.collect(), key=lambda r: (r["node"], r["chunk"])):
        assert len(r["tokens"]) <= 16
        got.setdefault(r["node"], []).extend(r["tokens"])
    assert got == whole and "lone" not in got and chunks.where("node = 'hub'").count() == 25
    vectors = spark.createDataFrame([(w, [float(i), 1.0, -float(i % 5)]) for i, w in enumerate(["READ", "DELETE", "f1", "f2", "f7", "f12"])], "word string, vector array<double>")
    for long_from in (100, 100_000):
        a = {r["node"]: r["embedding"] for r in sc.embed_documents(g.documents_of(e, tokens).where("node IS NOT NULL"), vectors, 3, long_from).collect()}
        b = {r["node"]: r["embedding"] for r in sc.embed_documents(chunks, vectors, 3, long_from).collect()}
        assert a.keys() == b.keys() and all(a[n] == pytest.approx(b[n]) for n in a)
    assert g.document_chunks(e.limit(0), tokens).count() == 0


def test_word2vec_knows_every_word_once(spark):
    docs = spark.createDataFrame([(["p", "q", "r"] * 20,), (["p", "s"],)], "tokens array<string>")
    first, again = ({r["word"]: r["vector"] for r in sc.word2vec(docs, size=5).collect()} for _ in range(2))
    assert set(first) == {"p", "q", "r", "s"} and first == again and all(len(v) == 5 for v in first.values())


def planted(spark, n=3000):
    """Label 1 where x > 60 or the kind is 'bad'; y and z tell nothing."""
    return spark.range(n).select(
        F.col("id"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)).cast("double").alias("x"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(100)).cast("double").alias("y"),
        F.when(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(10)) == 0, "bad").otherwise("good").alias("kind"), F.lit("same").alias("z"),
    ).withColumn("label", ((F.col("x") > 60) | (F.col("kind") == "bad")).cast("int"))


@pytest.fixture(scope="module")
def trained(spark):
    rows = planted(spark).cache()
    model, kept = sc.train_edge_classifier(rows, ["x", "y"], ["kind", "z"], rounds=5)
    return rows, model, kept


def test_edge_classifier_finds_the_planted_rule(spark, trained):
    rows, model, kept = trained
    assert kept == {"kind": ["good", "bad"], "z": ["same"]}
    scored = sc.score_edges(rows, model, kept, ["x", "y"])
    assert roc_auc(scored).first()["auc"] > 0.999
    odd = spark.createDataFrame([(1, None, 5.0, "never seen", None, 0), (2, 99.0, None, None, "same", 0)], "id int, x double, y double, kind string, z string, label int")
    assert all(0 <= r["score"] <= 1 for r in sc.score_edges(odd, model, kept, ["x", "y"]).collect())


def test_early_stopping_where_nothing_can_be_learnt(spark):
    rows = planted(spark, 1000).withColumn("val", F.col("id") % 4 == 0).withColumn("label", F.pmod(F.xxhash64("id", F.lit(9)), F.lit(2)).cast("int"))
    model, _ = sc.train_edge_classifier(rows, ["x"], ["kind"], rounds=20, validation="val")
    assert 1 <= model.stages[-1].getNumTrees < 20


def test_class_weights_balance(spark):
    w = sc.class_weight(planted(spark)).groupBy("label").agg(F.sum("weight").alias("w")).collect()
    assert w[0]["w"] == pytest.approx(w[1]["w"])


def test_knockout_and_permutation_name_the_features_that_tell(spark, trained):
    rows, model, kept = trained
    for t in (sc.feature_knockout(rows, model, kept, ["x", "y"]), sc.permutation_importance(rows, model, kept, ["x", "y"], "id")):
        drop = {r["feature"]: r["drop"] for r in t.collect()}
        assert set(drop) == {"x", "y", "kind", "z"}
        assert drop["x"] > 0.2 and drop["kind"] > 0.02 and abs(drop["y"]) < 0.01 and abs(drop["z"]) < 1e-9, drop


def test_knockout_is_the_auc_without_the_feature(spark, trained):
    rows, model, kept = trained
    got = {r["feature"]: r["auc"] for r in sc.feature_knockout(rows, model, kept, ["x", "y"]).collect()}
    one = roc_auc(sc.score_edges(rows.withColumn("x", F.lit(None).cast("double")), model, kept, ["x", "y"])).first()["auc"]
    assert got["x"] == pytest.approx(one)


def test_dealt_rows_are_one_cycle_by_hash(spark, monkeypatch):
    rows = planted(spark, 1000).withColumn("x", F.col("id").cast("double"))
    monkeypatch.setattr(sc.ranks.numbered, "__defaults__", (False, 64))  # many ranges
    got = {int(r["x"]): int(r["given"]["x"]) for r in sc.dealt(rows, ["x", "y"], "id", 5).collect()}
    order = [r["id"] for r in rows.orderBy(F.xxhash64("id", F.lit(5)), "id").collect()]
    assert got == {now: before for before, now in zip(order, order[1:] + order[:1])}
    one = sc.dealt(rows.limit(1), ["x"], "id").collect()
    assert len(one) == 1 and one[0]["given"]["x"] == one[0]["x"]
    assert sc.dealt(rows.limit(0), ["x"], "id").count() == 0
    doubled = rows.where("id < 20").unionByName(rows.where("id < 20"))
    assert sc.dealt(doubled, ["x"], "id").count() == 40


def test_isolation_paths_and_outliers(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(256, 2))

    def walk(tree, row, depth=0):
        if len(tree) == 1:
            n = tree[0]
            return depth + (0 if n <= 1 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n)
        return walk(tree[2] if row[tree[0]] < tree[1] else tree[3], row, depth + 1)

    tree = sc.grow_tree(x, 8, np.random.default_rng(1))
    assert sc.path_lengths(tree, x) == pytest.approx([walk(tree, r) for r in x])
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(600, 2)))] + [(600, 40.0, -40.0), (601, 0.0, 0.0)]
    df = spark.createDataFrame(points, "node int, a double, b double")
    once = {r["node"]: r["score"] for r in sc.isolation_forest(df, df, ["a", "b"], trees=20).collect()}
    assert max(once, key=once.get) == 600 and once[600] > 0.7 > 0.5 > once[601]
    again = {r["node"]: r["score"] for r in sc.isolation_forest(df.repartition(7), df.repartition(3), ["a", "b"], trees=20).collect()}
    assert once.keys() == again.keys()


def test_novelty_density_of_dense_and_empty_places(spark):
    df = spark.range(2000).select(F.col("id").alias("node"), (F.pmod(F.xxhash64("id"), F.lit(100)) / 100 + F.when(F.col("id") % 2 == 0, 0).otherwise(9)).alias("a"))
    told = {r["a"]: r["score"] for r in sc.novelty_density(df, spark.createDataFrame([(0, 0.5), (1, 5.0), (2, 9.5)], "node int, a double"), ["a"]).collect()}
    assert told[0.5] < 0.3 and told[9.5] < 0.3 and told[5.0] > 0.9


def test_residual_rounds_train_on_what_is_left(spark):
    # A and B lie apart; C and D share their place, so they stay hard in every round
    rows = [(f"n{i}", "ABCD"[i % 4], [0.0, 10.0, 5.0, 5.0][i % 4] + i % 3 / 10, [0.0, 0.0, 9.0, 9.0][i % 4]) for i in range(200)]
    t = sc.residual_rounds(spark.createDataFrame(rows, "node string, type string, a double, b double"), ["a", "b"], limit=3)
    got = t.collect()
    assert {r["round"] for r in got} == {0, 1, 2} and len(got) == 600
    seeds = {r["node"]: r["seed"] for r in sc.explain_away(t, 0.5).collect()}
    assert all(seeds[n] == 0 for n, k, *_ in rows if k in "AB")
    single = spark.createDataFrame(rows, "node string, type string, a double, b double").where("type = 'A'")
    assert sc.residual_rounds(single, ["a", "b"]).count() == 0


def test_action_surprise_follows_the_ends(spark):
    kind = {"p": [1.0, 0.0, 0.0], "f": [0.0, 1.0, 0.0], "s": [0.0, 0.0, 1.0]}
    features = spark.createDataFrame([(f"{k}{i}", v) for k, v in kind.items() for i in range(20)], "node string, features array<double>")
    edges = [(f"p{i}", f"f{j}", "READ") for i in range(10) for j in range(10)] + [(f"p{i}", f"s{j}", "SEND") for i in range(10) for j in range(10)]
    edges.append(("p15", "s15", "READ"))  # nothing reads sockets otherwise
    t = sc.action_reconstruction(spark.createDataFrame(edges, "src_id string, dst_id string, edge_type string"), features, 3)
    score = {r["node"]: r["score"] for r in t.collect()}
    assert score["p15"] == score["s15"] == max(score.values()) and score["p15"] > 1 and score["p3"] < 0.3


def test_prototypes_are_the_attacks_centres(spark):
    rng = np.random.default_rng(0)
    centres = np.array([[0.0, 0.0], [50.0, 0.0], [0.0, 50.0]])
    attacks = [(i, [float(v) for v in centres[i % 3] + rng.normal(size=2)]) for i in range(90)]
    other = [(100, [10.0, 10.0]), (101, [50.0, 1.0]), (102, [-3.0, 49.0])]
    frame = lambda rows: spark.createDataFrame(rows, "node int, embedding array<double>")
    got = {r["node"]: r["score"] for r in sc.kmeans_prototypes(frame(attacks), frame(other), k=3).collect()}
    means = [np.mean([v for i, v in attacks if i % 3 == c], axis=0) for c in range(3)]
    for n, v in other:
        assert got[n] == pytest.approx(-min(np.linalg.norm(np.array(v) - m) for m in means))
