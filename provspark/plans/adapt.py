"""The supplied tables seen as provenance data, and the same views in SQL.

``prov_events`` maps the event table to edges (one event = one subject, action,
object); time is compressed a thousandfold so that rule windows see chains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
START_NS = 1_704_067_200_000_000_000
NAMES = ("/bin/bash", "curl -O x", "python3 a.py", "wget x", "nginx", "tar")
FILES = ("/etc/shadow", "/tmp/p", "/var/log/x", "/etc/cron.d/p", "/home/u")
EDGE_OF = {"click": "CONNECT", "view": "READ", "purchase": "WRITE", "signup": "FORK", "error": "DELETE"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_us(ts: Column) -> Column:
    """Microseconds of a timestamp without time zone, whatever the session's zone."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    second = F.hour(ts) * 3600 + F.minute(ts) * 60
    return (days * 86_400 + second) * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def prov_events(events: DataFrame) -> DataFrame:
    """Edges: event_id, ts (ns), endpoint_id, edge_type, src_*, dst_*, size, score, label, attack_id."""
    k = F.get_json_object("props", "$.k").cast("int")
    edge = F.element_at(F.create_map(*[F.lit(x) for kv in EDGE_OF.items() for x in kv]), F.col("event_type"))
    child = (F.col("user_id") * 7 + F.col("k")) % 150
    base = events.withColumn("k", k).withColumn("edge_type", edge).withColumn("label", (F.col("event_type") == "error").cast("int"))
    dst_id = (
        F.when(F.col("edge_type") == "CONNECT", F.concat(F.lit("sock:10.0.0."), F.col("k"), F.lit(":"), 4440 + F.col("k") % 8))
        .when(F.col("edge_type") == "FORK", F.concat(F.lit("proc:"), child)).otherwise(F.concat(F.lit("file:"), F.col("k")))
    )
    return base.select(
        F.concat(F.lit("e"), "event_id").alias("event_id"),
        (F.lit(START_NS) + epoch_us(F.col("ts")) - F.lit(START_NS // 1000)).alias("ts"),
        F.concat(F.lit("host"), F.col("user_id") % 8).alias("endpoint_id"),
        "edge_type",
        F.concat(F.lit("proc:"), "user_id").alias("src_id"), F.lit("PROCESS").alias("src_type"), _pick(NAMES, F.col("user_id")).alias("src_name"),
        dst_id.alias("dst_id"),
        F.when(F.col("edge_type") == "CONNECT", "SOCKET").when(F.col("edge_type") == "FORK", "PROCESS").otherwise("FILE").alias("dst_type"),
        F.when(F.col("edge_type") == "CONNECT", dst_id).when(F.col("edge_type") == "FORK", _pick(NAMES, child)).otherwise(_pick(FILES, F.col("k"))).alias("dst_name"),
        F.col("k").cast("long").alias("size"), F.col("value").alias("score"), "label",
        F.when(F.col("label") == 1, (F.col("user_id") % 5).cast("int")).otherwise(-1).alias("attack_id"),
    )


def _sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


#: ``prov`` as a common table expression.
PROV = f"""prov AS (
  SELECT 'e' || event_id AS event_id, {START_NS}::BIGINT + epoch_us(ts) - {START_NS // 1000}::BIGINT AS ts, 'host' || (user_id % 8) AS endpoint_id, edge_type,
    'proc:' || user_id AS src_id, 'PROCESS' AS src_type, {_sql_list(NAMES)}[user_id % 6 + 1] AS src_name,
    CASE edge_type WHEN 'CONNECT' THEN 'sock:10.0.0.' || k || ':' || (4440 + k % 8) WHEN 'FORK' THEN 'proc:' || ((user_id * 7 + k) % 150) ELSE 'file:' || k END AS dst_id,
    CASE edge_type WHEN 'CONNECT' THEN 'SOCKET' WHEN 'FORK' THEN 'PROCESS' ELSE 'FILE' END AS dst_type,
    CASE edge_type WHEN 'CONNECT' THEN 'sock:10.0.0.' || k || ':' || (4440 + k % 8) WHEN 'FORK' THEN {_sql_list(NAMES)}[((user_id * 7 + k) % 150) % 6 + 1]
      ELSE {_sql_list(FILES)}[k % 5 + 1] END AS dst_name,
    k::BIGINT AS size, value AS score, label, CASE WHEN label = 1 THEN (user_id % 5)::INTEGER ELSE -1 END AS attack_id
  FROM (SELECT *, (props->>'$.k')::INTEGER AS k, (event_type = 'error')::INTEGER AS label,
    CASE event_type WHEN 'click' THEN 'CONNECT' WHEN 'view' THEN 'READ' WHEN 'purchase' THEN 'WRITE' WHEN 'signup' THEN 'FORK' WHEN 'error' THEN 'DELETE' END AS edge_type
    FROM events)
)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prov_events(load(spark, sf_dir, "events"))


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier -> part edges of the order lines: a larger bipartite graph (src, dst, quantity)."""
    lines = load(spark, sf_dir, "lineitem")
    return lines.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.col("l_quantity").alias("quantity"))


TRADE = "trade AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, l_quantity AS quantity FROM lineitem)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking input from the events: entity, score, label, attack_id, node_type, host."""
    return edges(spark, sf_dir).select(
        F.col("event_id").alias("entity"), F.round("score", 1).alias("score"), "label", "attack_id", F.col("dst_type").alias("node_type"), F.col("endpoint_id").alias("host")
    )


SCORES = f"{PROV}, scores AS (SELECT event_id AS entity, round(score, 1) AS score, label, attack_id, dst_type AS node_type, endpoint_id AS host FROM prov)"
