"""Parsed lines, system-call dumps and eCAR records -> normalised edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provspark.functions import ids

# CDM18 kinds and actions, as node and edge types.
CDM_NODE = {
    "SUBJECT_PROCESS": "PROCESS", "FILE_OBJECT_BLOCK": "FILE", "FILE_OBJECT_FILE": "FILE", "FILE_OBJECT_DIR": "FILE", "NetFlowObject": "SOCKET",
    "MemoryObject": "MEMORY", "UnnamedPipeObject": "PIPE", "PRINCIPAL_LOCAL": "USER", "PRINCIPAL_REMOTE": "USER",
}
CDM_EDGE = {
    "EVENT_EXECUTE": "EXEC", "EVENT_CLONE": "FORK", "EVENT_FORK": "FORK", "EVENT_READ": "READ", "EVENT_READ_SOCKET_PARAMS": "READ",
    "EVENT_OPEN": "READ", "EVENT_RECVFROM": "RECEIVE", "EVENT_RECVMSG": "RECEIVE", "EVENT_WRITE": "WRITE", "EVENT_WRITE_SOCKET_PARAMS": "WRITE",
    "EVENT_MODIFY_FILE_ATTRIBUTES": "WRITE", "EVENT_SENDTO": "SEND", "EVENT_SENDMSG": "SEND", "EVENT_CONNECT": "CONNECT", "EVENT_MMAP": "MMAP",
    "EVENT_MPROTECT": "MMAP", "EVENT_SHM": "MMAP", "EVENT_UNLINK": "DELETE",
}
NODE_TYPES = ("PROCESS", "FILE", "SOCKET", "REGISTRY", "MEMORY", "PIPE", "HOST", "USER", "URL")
EDGE_TYPES = ("FORK", "EXEC", "READ", "WRITE", "CONNECT", "SEND", "RECEIVE", "MMAP", "RENAME", "DELETE", "LOAD", "MODIFY_REG", "ACCESS", "AUTH")
EDGE_COLUMNS = ("event_id", "ts", "endpoint_id", "edge_type", "src_id", "src_type", "src_name", "dst_id", "dst_type", "dst_name", "size", "properties")


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def usable_triple(df: DataFrame) -> DataFrame:
    """Rows with known types and both ids."""
    known = F.col("subject_type").isin(*NODE_TYPES) & F.col("object_type").isin(*NODE_TYPES) & F.col("edge_type").isin(*EDGE_TYPES)
    return df.where(known & ids.present(F.col("subject_id")).isNotNull() & ids.present(F.col("object_id")).isNotNull())


def normalize_splunk(parsed: DataFrame) -> DataFrame:
    """Edges of parsed lines (_raw, host, sourcetype, _time s, label, scenario, and the parser's columns)."""
    optional = lambda c: F.col(c).cast("string") if c in parsed.columns else F.lit(None).cast("string")
    props = F.map_filter(
        F.map_concat(F.create_map(F.lit("label"), optional("label"), F.lit("scenario"), ids.present(optional("scenario"))), F.coalesce("fields", F.create_map().cast("map<string,string>"))),
        lambda _, v: v.isNotNull(),
    )
    at = F.coalesce(F.col("_time").cast("long"), F.lit(0))
    return usable_triple(parsed).select(
        ids.content_hash(F.col("_raw"), F.col("host"), F.col("sourcetype"), at).alias("event_id"), (at * 1_000_000_000).alias("ts"),
        F.coalesce(ids.present(F.col("host")), F.lit("botsv2")).alias("endpoint_id"), "edge_type",
        F.col("subject_id").alias("src_id"), F.col("subject_type").alias("src_type"), F.coalesce(ids.present(F.col("subject_name")), "subject_id").alias("src_name"),
        F.col("object_id").alias("dst_id"), F.col("object_type").alias("dst_type"), F.coalesce(ids.present(F.col("object_name")), "object_id").alias("dst_name"),
        F.element_at("fields", "bytes").cast("long").alias("size"), props.alias("properties"),
    )


def normalize_cdm(edges: DataFrame) -> DataFrame:
    """Edges of CDM messages (actor_id, actor_cdm, object_id, object_cdm, action, exec, path, timestamp, label); unknown actions go."""
    kind = lookup(CDM_EDGE, F.col("action"))
    actor, obj = F.coalesce("actor_cdm", F.lit("SUBJECT_PROCESS")), F.coalesce("object_cdm", F.lit("FILE_OBJECT_BLOCK"))
    src, dst = F.coalesce(lookup(CDM_NODE, actor), F.lit("PROCESS")), F.coalesce(lookup(CDM_NODE, obj), F.lit("FILE"))
    ts = F.coalesce(ids.to_int(F.col("timestamp")), F.lit(0))
    named = lambda name, of, uuid: F.coalesce(ids.present(name), F.concat(F.lower(of), F.lit(":"), uuid))
    props = F.create_map(*[x for c in ("action", "exec", "path", "label") for x in (F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("")))])
    usable = ids.present(F.col("actor_id")).isNotNull() & ids.present(F.col("object_id")).isNotNull() & kind.isNotNull()
    return edges.where(usable).select(
        ids.event_id(F.col("actor_id"), F.col("object_id"), F.col("action"), ts).alias("event_id"), ts.alias("ts"), F.lit("theia").alias("endpoint_id"), kind.alias("edge_type"),
        F.col("actor_id").alias("src_id"), src.alias("src_type"), named(F.col("exec"), src, F.col("actor_id")).alias("src_name"),
        F.col("object_id").alias("dst_id"), dst.alias("dst_type"), named(F.col("path"), dst, F.col("object_id")).alias("dst_name"),
        F.lit(None).cast("long").alias("size"), props.alias("properties"),
    )


def normalize_stream(splunk: DataFrame, cdm: DataFrame) -> DataFrame:
    """One edge table from both sources; every row is tagged with where it came from."""
    return normalize_splunk(splunk).withColumn("dataset", F.lit("splunk")).unionByName(normalize_cdm(cdm).withColumn("dataset", F.lit("theia")))


# By object type, the properties that name the actor, name the object, and make the phrase before and after the action.
ECAR_NAMES = {
    "PROCESS": ("parent_image_path", ("image_path",)), "FILE": ("image_path", ("file_path",)),
    "MODULE": ("image_path", ("module_path",)), "FLOW": ("image_path", ("dest_ip", "dest_port")),
}
ECAR_PHRASE = {
    "PROCESS": ("parent_image_path", ("image_path", "command_line")), "FILE": ("image_path", ("file_path",)),
    "MODULE": ("image_path", ("module_path",)), "FLOW": ("image_path", ("src_ip", "src_port", "dest_ip", "dest_port", "direction")),
}


def _property(key: str) -> Column:
    return F.element_at("properties", key)


def ecar_semantics(events: DataFrame) -> DataFrame:
    """eCAR events with actorname and objectname by object type; events that lack a part go."""
    actor = name = F.lit(None).cast("string")
    for kind, (by, parts) in ECAR_NAMES.items():
        here = F.col("object") == kind
        actor = F.when(here, ids.present(_property(by))).otherwise(actor)
        # concat is null if any part is
        spaced = [x for p in parts for x in (F.lit(" "), ids.present(_property(p)))][1:]
        name = F.when(here, F.concat(*spaced)).otherwise(name)
    return events.withColumn("actorname", actor).withColumn("objectname", name).where("actorname IS NOT NULL AND objectname IS NOT NULL")


TRAVERSAL_KEYS = ("action", "actorID", "objectID", "object", "pid", "ppid")


def ecar_traversal_dedup(events: DataFrame, objects: tuple[str, ...] = ("PROCESS", "FILE", "FLOW", "MODULE"), position: str = "timestamp") -> DataFrame:
    """Valid objects without START, TERMINATE and self loops; of events equal in six keys the last stays."""
    valid = events.where(F.col("object").isin(*objects) & ~F.col("action").isin("START", "TERMINATE") & (F.col("actorID") != F.col("objectID")))
    last = Window.partitionBy(*TRAVERSAL_KEYS).orderBy(F.desc(position))
    return valid.withColumn("_last", F.row_number().over(last)).where("_last = 1").drop("_last")


def ecar_phrase(events: DataFrame) -> DataFrame:
    """``events`` with ts and phrase, the tokens of the type's template; events that lack a part of it go."""
    text = F.lit(None).cast("string")
    for kind, (before, after) in ECAR_PHRASE.items():
        spaced = [x for p in (_property(before), F.col("action"), *map(_property, after)) for x in (F.lit(" "), p)][1:]
        text = F.when(F.col("object") == kind, F.concat(*spaced)).otherwise(text)
    at = F.try_to_timestamp(F.substring("timestamp", F.lit(1), F.length("timestamp") - 6))
    return events.withColumn("ts", at).withColumn("phrase", F.split(text, " ")).where("phrase IS NOT NULL")


def drop_self_loops(edges: DataFrame, non_reflexive: tuple[str, ...] = ("ACCESS", "CONNECT", "SEND", "RECEIVE", "READ", "WRITE")) -> DataFrame:
    """Edges from a node to itself go where the action cannot be reflexive."""
    return edges.where(~(F.col("edge_type").isin(*non_reflexive) & (F.col("src_id") == F.col("dst_id"))))


def drop_null_hub(edges: DataFrame) -> DataFrame:
    """Edges with the all-zero id at either end go."""
    zero = "00000000-0000-0000-0000-000000000000"
    return edges.where(~(F.col("src_id").startswith(zero) | F.col("dst_id").startswith(zero)))


def dataset_filter(edges: DataFrame, dataset: str) -> DataFrame:
    return edges.where(F.col("dataset") == dataset)
