"""WARC records, and a Merkle audit of their fixity across replicas.

Pages become WARC response records, laid out in segments by record number with
byte offsets. The audit hashes each record (SHA-256); the hashes of ``FANOUT``
neighbours in offset order are hashed into a node, level by level up to one
root a segment. Two replicas are compared from the roots down: only children of
mismatching nodes are read at the next level, until the corrupt, missing or
added records remain. Each level is a grouped aggregation of at most FANOUT
rows a group; nothing passes through the driver but the tree's height.

Defined results: null url or html count as empty; a null page_id gives a record
without number in its name; rows are placed by hash and then by page_id,
content hash, so repeated rows give records of their own; empty tables give no
records; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provspark.llm.common import written

FANOUT = 16
SEGMENT_RECORDS = 4_096


def record_bytes(page_id: Column, url: Column, payload: Column) -> Column:
    """One WARC/1.1 response record as a binary."""
    body = F.coalesce(payload.cast("binary"), F.lit("").cast("binary"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def hex_number(digest: Column) -> Column:
    """The first 32 bits of a hex digest as a long."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def placed(records: DataFrame, segment_records: int = SEGMENT_RECORDS) -> DataFrame:
    """``records`` (page_id, length, sha256, ...) with segment, number and offset.

    Segments are drawn by digest; the window sorts about ``segment_records``
    rows. Leave the record bytes out of ``records`` where digests suffice.
    """
    segments = max(1, -(-records.count() // segment_records))
    order = Window.partitionBy("segment").orderBy(F.col("page_id").asc_nulls_first(), "sha256")
    return (
        records.withColumn("segment", hex_number(F.col("sha256")) % segments)
        .withColumn("number", (F.row_number().over(order) - 1).cast("long"))
        .withColumn("offset", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))
    )


def to_warc(pages: DataFrame, segment_records: int = SEGMENT_RECORDS) -> DataFrame:
    """(page_id, record, length, sha256, segment, number, offset) of the pages' records."""
    made = pages.select("page_id", record_bytes(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    return placed(made.withColumn("length", F.octet_length("record").cast("long")).withColumn("sha256", F.sha2("record", 256)), segment_records)


def leaf_hash(offset: Column, length: Column, sha256: Column) -> Column:
    """A record's hash covers its place, its length and its bytes."""
    return F.sha2(F.concat_ws(":", offset, length, sha256).cast("binary"), 256)


def tree(leaf: DataFrame, height: int) -> list[DataFrame]:
    """Levels (segment, number, hash) from the leaves to the roots; a node hashes its children in offset order."""
    levels = [leaf]
    for _ in range(height):
        below = levels[-1].withColumn("up", F.floor(F.col("number") / FANOUT))
        children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "hash"))), lambda c: c["hash"]), "")
        levels.append(written(below.groupBy("segment", "up").agg(F.sha2(children.cast("binary"), 256).alias("hash")).withColumnRenamed("up", "number"), "merkle"))
    return levels


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(segment, number, status) of the leaves that differ: corrupt, missing (in theirs) or added.

    ``ours`` and ``theirs`` are leaf tables of two replicas.
    """
    most = ours.union(theirs).agg(F.max("number")).first()[0] or 0
    height, reach = 0, 1
    while reach <= most:
        height, reach = height + 1, reach * FANOUT
    a, b = tree(ours, height), tree(theirs, height)
    open_: DataFrame | None = None  # nodes whose hashes differ, one level up
    for level in range(height, -1, -1):
        x, y = a[level].withColumnRenamed("hash", "x"), b[level].withColumnRenamed("hash", "y")
        if open_ is not None:
            inside = lambda t, o=open_: t.withColumn("up", F.floor(F.col("number") / FANOUT)).join(o, ["segment", "up"], "left_semi").drop("up")
            x, y = inside(x), inside(y)
        differ = x.join(y, ["segment", "number"], "full").where(~F.col("x").eqNullSafe(F.col("y")))
        if level:
            open_ = differ.select("segment", F.col("number").alias("up"))
    status = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "added").otherwise("corrupt")
    return differ.select("segment", "number", status.alias("status"))


def damage(page_id: Column) -> tuple[Column, Column]:
    """Which pages the damaged replica has changed (one in 97) and lost (one in 389), by the hash of their id."""
    draw = hex_number(F.md5(F.coalesce(page_id.cast("string"), F.lit("")).cast("binary")))
    return draw % 97 == 3, draw % 389 == 5


def op5_query(pages: DataFrame) -> DataFrame:
    """Every record with its place and digest, and what the audit says of it against a replica with damage.

    The replica holds the same records with the middle byte of some zeroed and
    some gone; both replicas' digests come from the record bytes.
    """
    changed, lost = damage(F.col("page_id"))
    record = record_bytes(F.col("page_id"), F.col("url"), F.col("html"))
    length = F.octet_length("record").cast("long")
    cut = F.floor(F.col("length") / 2).cast("int")
    worn = F.concat(F.substring(F.col("record"), F.lit(1), cut), F.lit(b"\x00"), F.substring(F.col("record"), cut + 2, F.col("length").cast("int")))
    made = (
        pages.select("page_id", record.alias("record")).withColumn("length", length)
        .select("page_id", "length", F.sha2("record", 256).alias("sha256"), F.when(changed, F.sha2(worn, 256)).alias("worn"))
    )
    records = written(placed(written(made, "digests")), "records")
    at = F.col("offset"), F.col("length")
    ours = records.select("segment", "number", leaf_hash(*at, F.col("sha256")).alias("hash"))
    theirs = records.where(~lost).select("segment", "number", leaf_hash(*at, F.coalesce("worn", "sha256")).alias("hash"))
    return records.join(audit(ours, theirs), ["segment", "number"], "left").select(
        "page_id", "segment", "number", "offset", "length", "sha256", F.coalesce("status", F.lit("intact")).alias("status")
    )


OP5_SQL = r"""
WITH made AS (
  SELECT page_id, concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Record-ID: <urn:page:', page_id, '>', chr(13), chr(10),
    'WARC-Target-URI: ', url, chr(13), chr(10), 'Content-Type: text/html', chr(13), chr(10), 'Content-Length: ', strlen(coalesce(html, '')),
    chr(13), chr(10), chr(13), chr(10), html, chr(13), chr(10), chr(13), chr(10)) AS record
  FROM pages
), hashed AS (
  SELECT page_id, strlen(record)::BIGINT AS length, sha256(record) AS sha256, ('0x' || substr(md5(coalesce(page_id::VARCHAR, '')), 1, 8))::BIGINT AS draw FROM made
), segmented AS (
  SELECT *, ('0x' || substr(sha256, 1, 8))::BIGINT % (SELECT greatest(1, (count(*) + 4095) // 4096) FROM pages) AS segment FROM hashed
)
SELECT page_id, segment, row_number() OVER w - 1 AS number, (sum(length) OVER w - length)::BIGINT AS offset, length, sha256,
  CASE WHEN draw % 389 = 5 THEN 'missing' WHEN draw % 97 = 3 THEN 'corrupt' ELSE 'intact' END AS status
FROM segmented WINDOW w AS (PARTITION BY segment ORDER BY page_id NULLS FIRST, sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""
