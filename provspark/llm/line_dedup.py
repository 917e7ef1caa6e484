"""Line dedup by overlapping three-line windows.

Every run of three consecutive lines is hashed; windows that occur more than
once anywhere in the corpus keep their first occurrence, in the order of
(doc_id, line), and each later occurrence covers its three lines. Covered
positions of a document are merged into ranges and the lines in them go.
A window of blank lines only is not counted.

Defined results: null text stays null, texts under three lines stay as they
are; a null doc_id sorts first; rows that repeat both id and text count as one
document and share its result, rows that repeat the id with another text are
told apart by the text's hash; an empty table gives no rows; further columns
pass through. Names that begin with ``_line_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provspark.llm.common import written

SIZE = 3


def windows(docs: DataFrame) -> DataFrame:
    """(doc_id, _line_text, pos, key) of every window; pos counts from 0."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("_line_text"), F.split("text", "\n", -1).alias("lines")).where(F.size("lines") >= SIZE)
    joined = F.transform(F.sequence(F.lit(1), F.size("lines") - (SIZE - 1)), lambda i: F.array_join(F.slice("lines", i, SIZE), "\n"))
    each = lines.select("doc_id", "_line_text", F.posexplode(joined).alias("pos", "window")).where(F.col("window").rlike(r"\S"))
    return each.select("doc_id", "_line_text", "pos", F.unhex(F.md5(F.col("window").cast("binary"))).alias("key"))


def covered_ranges(docs: DataFrame) -> DataFrame:
    """(_line_id, _line_hash, _line_ranges): merged ranges [first, last] of covered lines, sorted, by document."""
    found = written(windows(docs), "windows")
    at = F.struct("doc_id", "_line_text", "pos")
    repeated = found.groupBy("key").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    later = found.join(repeated, "key").where(at != F.col("first")).select("doc_id", "_line_text", "pos").distinct()
    in_doc = Window.partitionBy("doc_id", "_line_text").orderBy("pos")
    apart = F.col("pos") - F.lag("pos").over(in_doc) > SIZE
    runs = (
        later.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
        .withColumn("run", F.sum("new").over(in_doc))
        .groupBy("doc_id", "_line_text", "run").agg(F.min("pos").alias("first"), (F.max("pos") + (SIZE - 1)).alias("last"))
    )
    return runs.groupBy(F.col("doc_id").alias("_line_id"), F.col("_line_text").alias("_line_hash")).agg(
        F.array_sort(F.collect_list(F.struct("first", "last"))).alias("_line_ranges")
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without covered lines; ``_line_removed`` counts them. Other columns are unchanged."""
    ranges = covered_ranges(docs)
    hashed = docs.withColumn("_line_text", F.xxhash64("text"))
    joined = hashed.join(ranges, hashed["doc_id"].eqNullSafe(ranges["_line_id"]) & (hashed["_line_text"] == ranges["_line_hash"]), "left")
    lines, spans = F.split("text", "\n", -1), F.col("_line_ranges")
    edges = F.concat(F.array(F.lit(-1)), F.transform(spans, lambda r: r["last"]))
    until = F.concat(F.transform(spans, lambda r: r["first"]), F.array(F.size(lines)))
    kept = F.zip_with(edges, until, lambda after, end: F.slice(F.col("_line_lines"), after + 2, end - after - 1))
    removed = F.aggregate(spans, F.lit(0), lambda n, r: n + (r["last"] - r["first"] + 1))
    text = F.when(spans.isNull(), F.col("text")).otherwise(F.array_join(F.flatten(kept), "\n"))
    return (
        joined.withColumn("_line_lines", F.when(spans.isNotNull(), lines))
        .withColumn("_line_removed", F.coalesce(removed, F.lit(0)).cast("long")).withColumn("text", text)
        .drop("_line_text", "_line_id", "_line_hash", "_line_ranges", "_line_lines")
    )


def op2_query(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "text", F.col("_line_removed").alias("n_removed"))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), windows AS (
  SELECT doc_id, pos, concat(line, chr(10), lead(line, 1) OVER w, chr(10), lead(line, 2) OVER w) AS win, lead(pos, 2) OVER w AS last
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), occurrences AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS nth FROM windows WHERE last IS NOT NULL AND regexp_matches(win, '\S')
), covered AS (
  SELECT DISTINCT doc_id, pos + unnest([0, 1, 2]) AS pos FROM occurrences WHERE nth > 1
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (c.pos IS NULL) AS text, count(c.pos) AS n_removed
  FROM lines l LEFT JOIN covered c USING (doc_id, pos) GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text, coalesce(k.n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
