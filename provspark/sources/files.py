"""Readers and writers of logs, edges, attack corpora and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.functions import ids
from provspark.operators.patterns import groups_found

RAW_SCHEMA = "_time double, source string, host string, sourcetype string, _raw string, _meta string, _corrupt string"
# The keys of an attack record that its canonical line is made of.
CANONICAL_KEYS = (
    "Image", "ParentImage", "CommandLine", "ParentCommandLine", "User", "IntegrityLevel", "TargetFilename", "TargetObject", "Details",
    "DestinationIp", "DestinationPort", "SourceIp", "SourcePort", "Protocol", "ProcessId", "ParentProcessId", "ImageLoaded",
)


def read_log_csv(spark: SparkSession, path: str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed): multi-line quoted CSV; rows that do not parse are set apart, to be counted."""
    df = spark.read.schema(RAW_SCHEMA).csv(path, header=header, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
    return df.where("_corrupt IS NULL").drop("_corrupt"), df.where("_corrupt IS NOT NULL")


def clean_log(raw: DataFrame) -> DataFrame:
    """Prefixes such as ``host::`` go, ``_time`` becomes whole seconds, ``_meta`` goes."""
    for c in ("source", "host", "sourcetype"):
        raw = raw.withColumn(c, F.regexp_replace(c, f"^{c}::", ""))
    return raw.withColumn("_time", F.col("_time").cast("long")).drop("_meta")


def partition_name(sourcetype: Column) -> Column:
    """A sourcetype as a folder name: ten unsafe characters become ``_``, null ``_null``."""
    return F.coalesce(F.regexp_replace(sourcetype, r'[/\\:*?"<>| ]', "_"), F.lit("_null"))


def write_partitioned(df: DataFrame, path: str, by: str = "sourcetype") -> None:
    df.withColumn(by, partition_name(F.col(by))).write.mode("overwrite").partitionBy(by).option("compression", "zstd").parquet(path)


def read_partitions(spark: SparkSession, path: str, only: list[str] | None = None, by: str = "sourcetype") -> DataFrame:
    """The table, or the partitions named; others are not opened."""
    df = spark.read.parquet(path)
    return df if only is None else df.where(F.col(by).isin(only))


def clean_text(c: Column) -> Column:
    """Tabs and line ends as spaces."""
    return F.translate(c, "\t\r\n", "   ")


def write_edge_tsv(edges: DataFrame, path: str) -> None:
    edges.select(*[clean_text(F.col(c).cast("string")).alias(c) for c in edges.columns]).write.mode("overwrite").csv(path, sep="\t", quote="", emptyValue="")


def read_edge_tsv(spark: SparkSession, path: str, columns: list[str], min_fields: int | None = None, limit: int | None = None) -> DataFrame:
    """Tab-separated edges; lines with fewer than ``min_fields`` fields go."""
    parts = spark.read.text(path).select(F.split("value", "\t", -1).alias("f")).where(F.size("f") >= (min_fields or len(columns)))
    df = parts.select(*[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(columns)])
    return df if limit is None else df.limit(limit)


ECAR_SCHEMA = "action string, actorID string, objectID string, object string, pid long, ppid long, timestamp string, hostname string, properties map<string,string>"


def read_ecar(spark: SparkSession, path: str, host: str | None = None) -> DataFrame:
    """eCAR JSON lines (also gzipped); blank lines go, ``host`` keeps the lines that contain it."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    if host is not None:
        lines = lines.where(F.col("value").contains(host))
    return lines.select(F.from_json("value", ECAR_SCHEMA).alias("e")).where("e IS NOT NULL").select("e.*")


def write_ecar_hosts(spark: SparkSession, path: str, out: str, hosts: list[str]) -> None:
    """The lines of an eCAR corpus by host: one folder ``host=...`` of gzipped lines for each of ``hosts``.

    A line belongs to every host whose name it contains, as it is written.
    Lines stay as they are. One pass for all hosts, without a shuffle; a later
    run replaces the folders of its hosts and leaves the others.
    """
    lines = spark.read.text(path).withColumn("_host", F.explode(groups_found(F.col("value"), [[h] for h in hosts], fold=False)))
    named = lines.select("value", F.element_at(F.array(*map(F.lit, hosts)), F.col("_host") + 1).alias("host")) if hosts else lines.select("value", F.lit("").alias("host"))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "gzip").partitionBy("host").text(out)


def attack_records(lines: DataFrame, scenario: Column) -> DataFrame:
    """Raw log rows of attack records (column value, JSON): Sysmon records with an event id and a time, label 1."""
    get = lambda k: F.get_json_object("value", f"$.{k}")
    at = F.coalesce(ids.to_epoch(get("UtcTime")), ids.to_epoch(get("@timestamp")), ids.to_epoch(get("EventTime")))
    clean = lambda k: F.substring(F.regexp_replace(get(k), r"[<>'\x00-\x1f]", " "), 1, 500)
    data = F.concat_ws("", *[F.when(get(k).isNotNull(), F.concat(F.lit(f"<Data Name='{k}'>"), clean(k), F.lit("</Data>"))) for k in CANONICAL_KEYS])
    raw = F.concat(F.lit("<EventID>"), get("EventID"), F.lit("</EventID>"), F.coalesce(F.concat(F.lit("<Computer>"), get("Hostname"), F.lit("</Computer>")), F.lit("")), data)
    return (
        lines.where(get("Channel").contains("Sysmon") & get("EventID").isNotNull() & at.isNotNull())
        .select(at.alias("_time"), F.lit("mordor").alias("source"), get("Hostname").alias("host"), F.lit("mordor_sysmon").alias("sourcetype"), raw.alias("_raw"), F.lit(1).alias("label"), scenario.alias("scenario"))
    )


def read_ndjson_attacks(spark: SparkSession, path: str) -> DataFrame:
    """Attack records of all files; the scenario is the file's folder."""
    lines = spark.read.text(path).withColumn("_file", F.input_file_name())
    return attack_records(lines, F.element_at(F.split("_file", "/"), -2))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(uuid): distinct ids of a JSON list or of white-space separated text."""
    text = spark.read.text(path, wholetext=True)
    listed = F.coalesce(F.from_json("value", "array<string>"), F.split("value", r"\s+"))
    return text.select(F.explode(listed).alias("uuid")).where(F.length(F.trim("uuid")) > 0).distinct()


def write_summary_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def write_report_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def fair_sample(raw: DataFrame, limit: int | None = None, by: str = "sourcetype", key: tuple[str, ...] = ("_time", "_raw")) -> DataFrame:
    """Rows of parseable sourcetypes, at most max(200, limit / partitions) of each (2000 without a limit)."""
    from pyspark.sql import Window

    from provspark.operators.parsers import PARSERS

    known = PARSERS[0][0](F.col(by))
    for which, _ in PARSERS[1:]:
        known = known | which(F.col(by))
    usable = raw.where(known & (F.length("_raw") > 0))
    kinds = usable.select(by).distinct().count()
    cap = 2000 if limit is None else max(200, limit // max(1, kinds))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*key))
    out = usable.withColumn("_rank", rank).where(F.col("_rank") <= cap).drop("_rank")
    return out if limit is None else out.orderBy("_time").limit(limit)
