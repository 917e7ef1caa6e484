"""The provenance graph as two tables: upserts, neighbourhoods, closures and components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provspark.functions import ids


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="provspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: it cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def upsert_edges(edges: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row for each (edge_type, event_id, src_id, dst_id); what is stored wins over what comes, then the earliest."""
    keys = ["edge_type", "event_id", "src_id", "dst_id"]
    rows = edges.withColumn("_stored", F.lit(0))
    if stored is not None:
        rows = stored.withColumn("_stored", F.lit(1)).unionByName(rows, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct((-F.col("_stored")).alias("s"), F.coalesce("ts", F.lit(2**62)).alias("t"), F.to_json(F.struct(*rest)).alias("j"))).alias("row"))
    return first.select(*keys, "row.*").drop("_stored").select(*[c for c in edges.columns])


def sightings(edges: DataFrame) -> DataFrame:
    """Both ends of every edge: label, uuid, name, endpoint_id, properties, ts, order."""

    def side(end: str, role: int) -> DataFrame:
        has = "properties" in edges.columns
        props = F.to_json("properties") if has and dict(edges.dtypes)["properties"].startswith("map") else F.col("properties") if has else F.lit("{}")
        return edges.select(
            F.col(f"{end}_type").alias("label"), F.col(f"{end}_id").alias("uuid"), F.col(f"{end}_name").alias("name"), "endpoint_id",
            props.alias("properties"), "ts", F.lit(role).alias("role"), F.struct("ts", "event_id", F.lit(role).alias("role")).alias("order"),
        )

    return side("src", 0).unionByName(side("dst", 1))


def upsert_nodes(edges: DataFrame) -> DataFrame:
    """Nodes folded from their sightings in (ts, event_id, role) order, in closed form.

    The first sighting gives endpoint, type and first_seen; the name is the
    first that holds a space, else the first that is no placeholder, else the
    last; properties are the last non-empty ones seen as a subject, else the
    first.
    """
    s, order = sightings(edges), F.col("order")
    first = lambda value, where=None: F.min_by(value, order if where is None else F.when(where, order))
    last = lambda value, where=None: F.max_by(value, order if where is None else F.when(where, order))
    name = F.col("name")
    spaced, real = F.instr(name, " ") > 0, ~ids.is_placeholder_name(name)
    return s.groupBy("label", "uuid").agg(
        F.coalesce(first(name, spaced), first(name, real), last(name)).alias("name"),
        first(F.col("endpoint_id")).alias("endpoint_id"),
        F.coalesce(last(F.col("properties"), (F.col("role") == 0) & (F.col("properties") != "{}")), first(F.col("properties"))).alias("properties"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
    )


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n, e = nodes.agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges"))
    return n.crossJoin(e)  # one row each


def both_ways(edges: DataFrame, src: str = "src_id", dst: str = "dst_id") -> DataFrame:
    """(node, nbr), each undirected pair once a direction."""
    ends = edges.select(F.col(src).alias("node"), F.col(dst).alias("nbr"))
    return ends.union(ends.select("nbr", "node")).where("node <> nbr").distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, neighbours): sorted distinct undirected neighbours."""
    return both_ways(edges).groupBy("node").agg(F.array_sort(F.collect_set("nbr")).alias("neighbours"))


def k_hop(edges: DataFrame, roots: DataFrame, hops: int) -> DataFrame:
    """(root, node, hop): all nodes within ``hops`` of each root, with the least hop. ``roots`` has node."""
    pairs = both_ways(edges)
    reached = roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("hop")).distinct()
    frontier = reached
    for hop in range(1, hops + 1):
        step = frontier.join(pairs, "node").select("root", F.col("nbr").alias("node")).distinct()
        frontier = step.join(reached, ["root", "node"], "left_anti").withColumn("hop", F.lit(hop))
        reached = reached.unionByName(frontier)
    return reached


def k_hop_edges(edges: DataFrame, roots: DataFrame, hops: int) -> DataFrame:
    """(root, event_id, src_id, dst_id, edge_type): the edges that touch a node closer than ``hops`` to the root."""
    inner = k_hop(edges, roots, hops - 1)
    cols = ["event_id", "src_id", "dst_id", "edge_type"]
    touch = lambda end: edges.join(inner, edges[end] == inner["node"]).select("root", *cols)
    return touch("src_id").union(touch("dst_id")).distinct()


def two_hop_closure(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node): the given nodes that have an edge, and all within two hops of them."""
    pairs = both_ways(edges)
    start = nodes.select("node").distinct().join(pairs.select("node").distinct(), "node")
    one = start.join(pairs, "node").select(F.col("nbr").alias("node"))
    two = one.distinct().join(pairs, "node").select(F.col("nbr").alias("node"))
    return start.union(one).union(two).distinct()


#: Ends of alerts that one task gives their lists of edges.
ENDS_A_TASK = 2_000


def alert_subgraph(edges: DataFrame, alerts: DataFrame, limit: int = 200) -> DataFrame:
    """(alert_id, event_id, ts, src_id, dst_id, edge_type): up to ``limit`` edges at either end of each alert, newest first.

    Only a node's newest edges can be among an alert's newest, so a node has one
    list of them. Lists meet the alerts' ends in tasks sized by ends; a node at
    which many alerts end is dealt over as many tasks as they ask for.
    """
    cols = ["event_id", "ts", "src_id", "dst_id", "edge_type"]
    ends = written(alerts.select("alert_id", F.explode(F.array("src_id", "dst_id")).alias("end")).where("end IS NOT NULL").distinct(), "ends")
    tasks = max(1, -(-ends.count() // ENDS_A_TASK))
    crowds = ends.groupBy("end").agg(F.ceil(F.count("*") / ENDS_A_TASK).alias("shares")).where("shares > 1")  # at most one row for ENDS_A_TASK ends
    of_node = lambda side: F.row_number().over(Window.partitionBy(side).orderBy(F.desc("ts"), "event_id"))
    item = F.struct(F.coalesce(-F.col("ts"), F.lit(2**63 - 1)).alias("back"), *cols).alias("edge")
    near = lambda side: edges.select(*cols).withColumn("rank", of_node(side)).where(F.col("rank") <= limit).select(F.col(side).alias("end"), item)
    asked = near("src_id").union(near("dst_id")).join(ends.select("end").distinct(), "end", "left_semi")
    lists = asked.groupBy("end").agg(F.slice(F.array_sort(F.collect_set("edge")), 1, limit).alias("newest"))
    shares = F.coalesce("shares", F.lit(1))
    dealt = lists.join(F.broadcast(crowds), "end", "left").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1))).select("end", "share", "newest")
    taking = ends.join(F.broadcast(crowds), "end", "left").select("alert_id", "end", F.pmod(F.xxhash64("alert_id"), shares).alias("share"))
    met = taking.repartition(tasks, "end", "share").join(dealt.repartition(tasks, "end", "share"), ["end", "share"]).select("alert_id", "newest")
    # an edge between both ends is in both lists: sorted, the two lie side by side
    every = met.repartition(tasks, "alert_id").groupBy("alert_id").agg(F.array_sort(F.flatten(F.collect_list("newest"))).alias("every"))
    once = F.filter("every", lambda x, i: (i == 0) | ~x.eqNullSafe(F.get("every", i - 1)))
    return every.select("alert_id", F.explode(F.slice(once, 1, limit)).alias("edge")).select("alert_id", *[F.col(f"edge.{c}").alias(c) for c in cols])


def assemble(edges: DataFrame, seeds: DataFrame, cap: int = 40, max_nodes: int = 150) -> DataFrame:
    """(seed, node, hop, place): breadth-first neighbourhoods of two hops, at most ``cap`` neighbours a node, ``max_nodes`` a seed."""
    capped = both_ways(edges).withColumn("at", F.row_number().over(Window.partitionBy("node").orderBy("nbr"))).where(F.col("at") <= cap)
    zero = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hop"), F.lit(0).cast("long").alias("order"))
    one = zero.join(capped, "node").select("seed", F.col("nbr").alias("node"), F.lit(1).alias("hop"), F.col("at").cast("long").alias("order"))
    two = one.join(capped, "node").select("seed", F.col("nbr").alias("node"), F.lit(2).alias("hop"), (F.col("order") * (cap + 1) + F.col("at")).alias("order"))
    found = zero.union(one).union(two).groupBy("seed", "node").agg(F.min(F.struct("hop", "order")).alias("m")).select("seed", "node", "m.hop", "m.order")
    place = F.row_number().over(Window.partitionBy("seed").orderBy("hop", "order", "node"))
    return found.withColumn("place", place).where(F.col("place") <= max_nodes).select("seed", "node", "hop", "place")


def connected_components(edges: DataFrame, src: str = "src_id", dst: str = "dst_id", max_rounds: int = 40) -> DataFrame:
    """(node, component): the smallest node of each undirected component.

    Labels spread to neighbours and jump to their label's label, so rounds grow
    with the logarithm of the diameter; each round is a table in the shared folder.
    The joins are sort-merge joins: a broadcast would bring the labels to the
    driver three times a round.
    """
    pairs = written(both_ways(edges, src, dst), "pairs")
    labels = written(pairs.select("node").distinct().withColumn("component", F.col("node")), "labels")
    for _ in range(max_rounds):
        near = pairs.hint("merge").join(labels.withColumnRenamed("node", "nbr"), "nbr").groupBy("node").agg(F.min("component").alias("least"))
        spread = labels.hint("merge").join(near, "node").withColumn("lower", F.least("component", "least"))
        hop = labels.select(F.col("node").alias("lower"), F.col("component").alias("beyond"))
        new = written(spread.hint("merge").join(hop, "lower").select("node", F.least("lower", "beyond").alias("component"), (F.least("lower", "beyond") != F.col("component")).alias("moved")), "labels")
        moved = new.where("moved").limit(1).count()
        labels = new.drop("moved")
        if not moved:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def neighbour_name_sets(edges: DataFrame) -> DataFrame:
    """(node, names): distinct names of all neighbours, sorted."""
    a = edges.select(F.col("src_id").alias("node"), F.col("dst_name").alias("name"))
    b = edges.select(F.col("dst_id").alias("node"), F.col("src_name").alias("name"))
    return a.union(b).groupBy("node").agg(F.array_sort(F.collect_set("name")).alias("names"))


def neighbour_mean(edges: DataFrame, features: DataFrame, size: int, normalise: bool = True) -> DataFrame:
    """(node, features): mean of the neighbours' vectors (node, features array), scaled to length one."""
    joined = both_ways(edges).join(features.withColumnRenamed("node", "nbr"), "nbr")
    means = joined.groupBy("node").agg(F.array(*[F.avg(F.element_at("features", i + 1)) for i in range(size)]).alias("mean"))
    norm = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda a, x: a + x * x))
    return means.select("node", (F.transform("mean", lambda x: F.when(norm > 0, x / norm).otherwise(x)) if normalise else F.col("mean")).alias("features"))


def incident_to_chain(incidents: DataFrame, edges: DataFrame, limit: int = 15) -> DataFrame:
    """(incident_id, nodes, edges): up to ``limit`` edges of the matched event ids in time order, and their nodes."""
    exploded = incidents.select("incident_id", F.explode("event_ids").alias("event_id")).join(edges, "event_id")
    rank = F.row_number().over(Window.partitionBy("incident_id").orderBy("ts", "event_id"))
    kept = exploded.withColumn("rank", rank).where(F.col("rank") <= limit)
    node = lambda end: F.struct(F.col(f"{end}_id").alias("id"), F.upper(f"{end}_type").alias("type"), F.coalesce(ids.present(F.col(f"{end}_name")), F.col(f"{end}_id")).alias("name"))
    return kept.groupBy("incident_id").agg(
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.array(node("src"), node("dst")).alias("n")))), lambda x: x["n"]))).alias("nodes"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", F.struct("event_id", "edge_type", "src_id", "dst_id").alias("e")))), lambda x: x["e"]).alias("edges"),
    )


def fill_chains(incidents: DataFrame, edges: DataFrame, limit: int = 15, around: int = 200) -> DataFrame:
    """``incidents`` (incident_id, root_node_id, matched_edges, ...) whose chain is null or empty get one, with nodes in ``matched_nodes``.

    The chain is what touches the root node, newest first: ``limit`` of its
    edges, and the nodes of ``around``. An incident whose root has no edges
    gets empty arrays; those that have a chain keep it.
    """
    missing = F.col("matched_edges").isNull() | (F.size("matched_edges") == 0)
    roots = incidents.where(missing).select("incident_id", "root_node_id")
    cols = ["event_id", "ts", "edge_type", "src_id", "src_name", "src_type", "dst_id", "dst_name", "dst_type"]
    newest = Window.partitionBy("root").orderBy(F.desc("ts"), "event_id")
    # the newest of each end first: a hub's edges are ranked where they lie and never meet the incidents as a whole
    ends = [edges.select(F.col(end).alias("root"), *cols).withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= around).drop("rank") for end in ("src_id", "dst_id")]
    near = ends[0].union(ends[1]).distinct().withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= around)
    found = roots.join(near, roots["root_node_id"] == near["root"])
    node = lambda end: F.struct(F.col(f"{end}_id").alias("id"), F.upper(f"{end}_type").alias("type"), F.coalesce(ids.present(F.col(f"{end}_name")), F.col(f"{end}_id")).alias("name"))
    edge = F.struct("event_id", "edge_type", "src_id", "dst_id")
    chain = found.groupBy("incident_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= limit, F.struct("rank", edge.alias("e"))))), lambda x: x["e"]).alias("_edges"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.array(node("src"), node("dst")).alias("n")))), lambda x: x["n"]))).alias("_nodes"),
    )
    kind = {"_edges": "array<struct<event_id:string,edge_type:string,src_id:string,dst_id:string>>", "_nodes": "array<struct<id:string,type:string,name:string>>"}
    told = incidents.join(chain, "incident_id", "left")
    new = {c: F.coalesce(f, F.array()).cast(kind[f]) for c, f in (("matched_edges", "_edges"), ("matched_nodes", "_nodes"))}
    has = "matched_nodes" in incidents.columns
    return told.withColumns({
        "matched_edges": F.when(missing, new["matched_edges"]).otherwise(F.col("matched_edges")),
        "matched_nodes": F.when(missing, new["matched_nodes"]).otherwise(F.col("matched_nodes") if has else F.lit(None).cast(kind["_nodes"])),
    }).drop("_edges", "_nodes")


def reconstruction_quality(assembled: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: mean share of truth nodes in a subgraph, and share of the truth that the subgraphs cover."""
    flagged = assembled.join(truth.select("node").distinct().withColumn("gt", F.lit(1)), "node", "left").withColumn("gt", F.coalesce("gt", F.lit(0)))
    density = flagged.groupBy("seed").agg(F.avg("gt").alias("d")).agg(F.avg("d").alias("gt_density"))
    covered = flagged.where("gt = 1").agg(F.countDistinct("node").alias("c"))
    total = truth.agg(F.countDistinct("node").alias("t"))
    return density.crossJoin(covered).crossJoin(total).select("gt_density", (F.col("c") / F.col("t")).alias("gt_coverage"))


def top_nodes_to_edges(edges: DataFrame, flagged: DataFrame) -> DataFrame:
    """Edges with a flagged node at either end."""
    nodes = flagged.select("node").distinct()
    a = edges.join(nodes, edges["src_id"] == nodes["node"], "left_semi")
    b = edges.join(nodes, edges["dst_id"] == nodes["node"], "left_semi")
    return a.union(b).dropDuplicates(["event_id"])


def documents_of(edges: DataFrame, tokens: Column) -> DataFrame:
    """(node, tokens): the tokens of all edges at a node, in (ts, event_id) order; documents of DELETE alone go."""
    each = edges.withColumn("_tokens", tokens)
    ends = each.select(F.col("src_id").alias("node"), "ts", "event_id", "_tokens").union(each.select("dst_id", "ts", "event_id", "_tokens"))
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "_tokens")))
    docs = ends.groupBy("node").agg(F.flatten(F.transform(ordered, lambda x: x["_tokens"])).alias("tokens"))
    return docs.where(~((F.size("tokens") == 1) & (F.get("tokens", F.lit(0)) == "DELETE")))


def document_chunks(edges: DataFrame, tokens: Column, size: int = 10_000) -> DataFrame:
    """(node, chunk, tokens): the documents of ``documents_of`` in pieces (from 0) of the tokens of ``size`` edges each.

    No row grows with a node's degree: edges are numbered within their node in
    ranges sized by rows, so the edges of a hub lie in many tasks. Edges without
    an end are not in that end's document.
    """
    from provspark.operators import ranks

    each = edges.select("src_id", "dst_id", "ts", "event_id", tokens.alias("_tokens"))
    ends = each.select(F.col("src_id").alias("node"), "ts", "event_id", "_tokens").union(each.select("dst_id", "ts", "event_id", "_tokens")).where("node IS NOT NULL")
    ends = written(ends, "ends")
    alone = ends.groupBy("node").agg(F.sum(F.size("_tokens")).alias("_n"), F.max(F.array_contains("_tokens", "DELETE")).alias("_d")).where("_n = 1 AND _d").select("node")
    placed = ranks.numbered(ends, "node", [F.col("ts"), F.col("event_id"), F.col("_tokens")]).withColumn("chunk", F.expr(f"position div {int(size)}"))
    ordered = F.array_sort(F.collect_list(F.struct("position", "_tokens")))
    pieces = placed.groupBy("node", "chunk").agg(F.flatten(F.transform(ordered, lambda x: x["_tokens"])).alias("tokens"))
    return pieces.join(alone, "node", "left_anti")


def node_mean_loss(losses: DataFrame) -> DataFrame:
    """(node, score): mean loss of the edges at either end (src_id, dst_id, loss)."""
    ends = losses.select(F.col("src_id").alias("node"), "loss").union(losses.select("dst_id", "loss"))
    return ends.groupBy("node").agg(F.avg("loss").alias("score"))


def structural_features(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree, out_neighbours, in_neighbours, first_ts, first_type)."""
    out = edges.select(F.col("src_id").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("dst_id").alias("out_nbr"), F.lit(None).cast("string").alias("in_nbr"), "ts", F.col("src_type").alias("type"), "event_id")
    into = edges.select(F.col("dst_id").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.lit(None).cast("string").alias("out_nbr"), F.col("src_id").alias("in_nbr"), "ts", F.col("dst_type").alias("type"), "event_id")
    return out.union(into).groupBy("node").agg(
        F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.countDistinct("out_nbr").alias("out_neighbours"),
        F.countDistinct("in_nbr").alias("in_neighbours"), F.min("ts").alias("first_ts"), F.min_by("type", F.struct("ts", "event_id", "type")).alias("first_type"),
    )


def neighbour_type_histogram(edges: DataFrame, types: tuple[str, ...] = ("PROCESS", "FILE", "SOCKET")) -> DataFrame:
    """(node, out_TYPE..., in_TYPE...): log(1 + count) of neighbour types by direction."""
    out = edges.select(F.col("src_id").alias("node"), F.concat(F.lit("out_"), "dst_type").alias("kind"))
    into = edges.select(F.col("dst_id").alias("node"), F.concat(F.lit("in_"), "src_type").alias("kind"))
    kinds = [f"{d}_{t}" for d in ("out", "in") for t in types]
    counts = out.union(into).groupBy("node").pivot("kind", kinds).count()
    return counts.select("node", *[F.log1p(F.coalesce(F.col(k), F.lit(0))).alias(k) for k in kinds])


def mean_edge_embedding(edges: DataFrame, embeddings: DataFrame, size: int) -> DataFrame:
    """(node, embedding, log_degree): mean of the vectors (event_id, vector) of a node's edges."""
    ends = edges.select(F.col("src_id").alias("node"), "event_id").union(edges.select("dst_id", "event_id")).join(embeddings, "event_id")
    return ends.groupBy("node").agg(
        F.array(*[F.avg(F.element_at("vector", i + 1)) for i in range(size)]).alias("embedding"), F.log1p(F.count("*")).alias("log_degree")
    )
