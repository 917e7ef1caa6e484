"""CDM18 JSON lines: node types and names, and (subject, action, object) edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.functions import ids

UUID = r"([0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12})"
PREFIX = "com.bbn.tc.schema.avro.cdm18"
# Record kinds that are no nodes, and kinds that name their own type.
NOT_NODES = ("Event", "Host", "TimeMarker", "StartMarker", "UnitDependency", "EndMarker")
OWN_TYPE = ("MemoryObject", "NetFlowObject", "UnnamedPipeObject")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, pos): lines with a position that grows along each file."""
    return spark.read.text(path).withColumn("pos", F.monotonically_increasing_id())


def cdm_nodes(lines: DataFrame) -> DataFrame:
    """(uuid, type, name): the first record of each uuid gives the type, the last named one the name."""
    v = F.col("value")
    is_node = ~v.rlike("|".join(rf"cdm18\.{k}\"" for k in NOT_NODES))
    own = F.lit(None).cast("string")
    for kind in reversed(OWN_TYPE):
        own = F.when(v.contains(f".{kind}"), kind).otherwise(own)
    found = lambda pattern: ids.present(F.regexp_extract(v, pattern, 1))
    kind = F.coalesce(found(r'"type":"([^"]+)"'), own)
    address, port = found(r'"remoteAddress":"([^"]+)"'), found(r'"remotePort":(\d+)')
    name = F.coalesce(found(r'"cmdLine":(?:\{"string":)?"([^"]+)"'), F.when(kind == "NetFlowObject", F.concat(address, F.coalesce(F.concat(F.lit(":"), port), F.lit("")))))
    nodes = lines.where(is_node).select(found(UUID).alias("uuid"), kind.alias("type"), name.alias("name"), "pos").where("uuid IS NOT NULL")
    at = F.col("pos")
    return nodes.groupBy("uuid").agg(F.min_by("type", F.when(F.col("type").isNotNull(), at)).alias("type"), F.min_by("name", F.when(F.col("name").isNotNull(), at)).alias("name"))


def _id(path: str) -> Column:
    return ids.present(F.get_json_object("value", f"$.datum['{PREFIX}.Event'].{path}['{PREFIX}.UUID']"))


def cdm_events(lines: DataFrame, nodes: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """Messages (actor_id, actor_cdm, object_id, object_cdm, action, exec, path, timestamp, label): one for each object of an event."""
    event = lambda k: F.get_json_object("value", f"$.datum['{PREFIX}.Event'].{k}")
    text = lambda k: F.coalesce(F.get_json_object(event(k), "$.string"), event(k))
    two = F.array(*[F.struct(_id(o).alias("object_id"), text(f"{o}Path").alias("path")) for o in ("predicateObject", "predicateObject2")])
    rows = lines.where(F.col("value").contains(".Event")).select(
        _id("subject").alias("actor_id"), F.coalesce(event("type"), F.lit("")).alias("action"), F.coalesce(event("timestampNanos"), F.lit("")).alias("timestamp"),
        event("properties.map.cmdLine").alias("cmd"), F.explode(two).alias("o"),
    ).select("actor_id", "action", "timestamp", "cmd", "o.object_id", "o.path").where("actor_id IS NOT NULL AND object_id IS NOT NULL")
    of = lambda end: nodes.select(F.col("uuid").alias(f"{end}_id"), F.col("type").alias(f"{end}_type"), F.col("name").alias(f"{end}_name"))
    named = rows.join(of("actor"), "actor_id", "left").join(of("object"), "object_id", "left")
    if truth is not None:
        bad = truth.select("uuid").distinct().withColumn("_bad", F.lit(1))
        named = named.join(bad.toDF("actor_id", "_a"), "actor_id", "left").join(bad.toDF("object_id", "_o"), "object_id", "left").withColumn("label", F.coalesce("_a", "_o", F.lit(0)))
    else:
        named = named.withColumn("label", F.lit(0))
    return named.select(
        "actor_id", F.coalesce("actor_type", F.lit("SUBJECT_PROCESS")).alias("actor_cdm"), "object_id", F.coalesce("object_type", F.lit("FILE_OBJECT_BLOCK")).alias("object_cdm"),
        "action", F.coalesce(ids.present(F.col("cmd")), "actor_name", F.lit("")).alias("exec"), F.coalesce(ids.present(F.col("path")), "object_name", F.lit("")).alias("path"), "timestamp", "label",
    )


def resolve_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src_id, dst_id, ...) both of whose ends are known, with src_type and dst_type; only referenced nodes are joined."""
    used = edges.select(F.explode(F.array("src_id", "dst_id")).alias("uuid")).distinct()
    known = nodes.join(used, "uuid", "left_semi").select("uuid", "type")
    at = lambda end: known.select(F.col("uuid").alias(f"{end}_id"), F.col("type").alias(f"{end}_type"))
    base = edges.drop("src_type", "dst_type")
    return base.join(at("src"), "src_id").join(at("dst"), "dst_id")


def join_attributes(edges: DataFrame, attributes: DataFrame) -> DataFrame:
    """Edges with what is known of (src_id, dst_id, action, ts); repeated rows go."""
    return edges.join(attributes, ["src_id", "dst_id", "action", "ts"]).dropDuplicates()


def ground_truth_label(edges: DataFrame, truth: DataFrame) -> DataFrame:
    """``edges`` with label 1 where either end is in ``truth`` (uuid)."""
    t = truth.select("uuid").distinct().withColumn("_hit", F.lit(1))
    joined = edges.join(t.toDF("src_id", "_s"), "src_id", "left").join(t.toDF("dst_id", "_d"), "dst_id", "left")
    return joined.withColumn("label", F.coalesce("_s", "_d", F.lit(0))).drop("_s", "_d")
