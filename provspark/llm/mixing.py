"""Mixing sources to target weights along a time-varying curriculum.

Targets: the sources, ranked by code point with null last, weigh ``weights``
in turn and share ``epochs`` times all words; no source takes more than
``cap`` times its own words, and what it cannot take is shared out again by
weight (water filling in closed form over the sources sorted by cap / weight).

Curriculum: a source's weight at training time t in [0, 1] is its target times
1 + s (2t - 1), where the slopes ``s`` turn by rank. The integral of the
schedule is the source's cumulative demand; a document copy at cumulative
token midpoint m stands at the t where that demand reaches m.

Documents of a source are taken in the order of their id's hash, whole passes
first; the last partial pass ends at the document nearest to the target.
Cumulative sums run in hash buckets of about ``BUCKET_ROWS`` rows, so that no
source is ever gathered in one task.

Defined results: null or empty text has size 0 and takes no words; a null
source is a source of its own; repeated rows count each; ties in the order
fall to doc_id, then size; an empty table gives no rows; further columns pass
through, whatever their names, but for names that begin with ``_mix_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provspark.llm.common import WORD, word_count, written

WEIGHTS = (5, 2, 1)
SLOPES = (0.8, 0.0, -0.8)
EPOCHS, CAP = 1.5, 2.0
BUCKET_ROWS = 20_000
#: Rows up to which the sources' targets and the buckets' starts are broadcast, so that texts are not dealt anew to meet them.
FEW = 100_000
#: What ``plan`` adds; columns of the input by these names are kept as ``_mix_own_`` and their name, and ``mix`` gives them back.
MADE = ("size", "source_size", "target", "slope", "copies", "taken")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, epochs: float = EPOCHS, cap: float = CAP) -> DataFrame:
    """(source, source_size, n_rows) with rank, weight, slope and target; one row a source."""
    everything, by_rank = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    turn = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("rank") % len(xs) + 1).cast("int"))
    ranked = (
        totals.withColumn("rank", F.row_number().over(by_rank) - 1)
        .withColumn("weight", turn(weights).cast("double")).withColumn("slope", turn(slopes).cast("double"))
        .withColumn("cap", F.col("source_size") * cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    to_share = epochs * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    still = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    leveled = ranked.withColumn("level", to_share / still)
    share = F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(level)
    return leveled.withColumn("share", share).select(
        "source", "source_size", "n_rows", "slope",
        F.when(F.col("level") > F.col("ratio"), F.col("cap")).otherwise(F.col("share") * F.col("weight")).alias("target"),
    )


def time_of(fraction: Column, slope: Column) -> Column:
    """The t in [0, 1] at which t + slope (t^2 - t) reaches ``fraction``."""
    u, b = F.least(fraction, F.lit(1.0)), 1 - slope
    return F.when(slope == 0, u).otherwise((F.sqrt(b * b + 4 * slope * u) - b) / (2 * slope))


def beside(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a table of the shared folder, broadcast to what it is joined with if there are few."""
    rows = written(rows, name)
    return F.broadcast(rows) if rows.count() <= FEW else rows


def plan(docs: DataFrame, **options: object) -> DataFrame:
    """``docs`` with size, source_size, target, copies, taken and ``_mix_before`` (words of the source before the row)."""
    # rows of one id (all null ids, say) are told apart by their text
    told = F.when(F.col("doc_id").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(F.col("doc_id").cast("string"))
    keyed = docs.select(*[F.col(c).alias(f"_mix_own_{c}") if c in MADE else F.col(c) for c in docs.columns])
    keyed = keyed.withColumn("size", word_count(F.col("text"))).withColumn("_mix_key", F.md5(told.cast("binary")))
    sized = written(keyed.select("doc_id", "source", "size", "_mix_key"), "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    targets = beside(source_targets(totals, **options).withColumnRenamed("source", "_mix_source").withColumnRenamed("n_rows", "_mix_rows"), "targets")
    uniform = F.conv(F.substring("_mix_key", 1, 8), 16, 10).cast("long")
    buckets = F.floor((F.col("_mix_rows") + (BUCKET_ROWS - 1)) / BUCKET_ROWS)
    bucket = F.floor(uniform * buckets / F.lit(1 << 32)).cast("long")

    def bucketed(df: DataFrame) -> DataFrame:
        return df.join(targets, df["source"].eqNullSafe(targets["_mix_source"])).withColumn("_mix_bucket", bucket)

    sums = bucketed(sized).groupBy("_mix_source", "_mix_bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("_mix_source").orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("_mix_source").alias("_mix_s"), F.col("_mix_bucket").alias("_mix_b"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("_mix_start")
    )
    starts = beside(starts, "starts")
    # a scan of small columns reads the table just written; texts, where asked for, come from the input
    rows = bucketed(sized if set(docs.columns) <= {"doc_id", "source", "text"} else keyed)
    rows = rows.join(starts, rows["_mix_source"].eqNullSafe(starts["_mix_s"]) & (rows["_mix_bucket"] == starts["_mix_b"]))
    within = Window.partitionBy("_mix_source", "_mix_bucket").orderBy("_mix_key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    ready = rows.withColumn("_mix_before", F.col("_mix_start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - passes * F.col("source_size")
    copies = passes + F.when((F.col("size") > 0) & (F.col("_mix_before") + F.col("size") / 2 <= rest), 1).otherwise(0)
    return (
        ready.withColumn("copies", copies.cast("int")).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
        .drop("_mix_key", "_mix_source", "_mix_bucket", "_mix_start", "_mix_s", "_mix_b", "_mix_rows")
    )


def position(copy: Column) -> Column:
    """Training position of a row's copy number ``copy`` (from 0)."""
    middle = copy * F.col("source_size") + F.col("_mix_before") + F.col("size") / 2
    return time_of(middle / F.col("target"), F.col("slope"))


def mix(docs: DataFrame, **options: object) -> DataFrame:
    """The training order: each taken copy of each row, with the columns of ``docs``, sorted by position.

    Rows of size 0 hold no words to take and do not appear.
    """
    planned = plan(docs, **options).where("copies > 0")
    copy = planned.withColumn("_mix_copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return copy.withColumn("_mix_at", position(F.col("_mix_copy"))).orderBy("_mix_at", "doc_id").select(*[F.col(f"_mix_own_{c}").alias(c) if c in MADE else F.col(c) for c in docs.columns])


def op4_query(docs: DataFrame) -> DataFrame:
    planned = plan(docs.select("doc_id", "source", "text"))
    return planned.select(
        "doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken", "copies",
        F.when(F.col("copies") > 0, F.round(position(F.lit(0)), 6)).alias("position"),
    ).orderBy("position", "doc_id")


OP4_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size, md5(coalesce(doc_id::VARCHAR, text, '')) AS h
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5.0, 2.0, 1.0][rnk % 3 + 1]::DOUBLE AS weight, [0.8, 0.0, -0.8][rnk % 3 + 1]::DOUBLE AS slope, source_size * 2.0::DOUBLE AS cap FROM totals
), leveled AS (
  SELECT *, cap / weight AS ratio,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS lvl
  FROM weighed WINDOW w AS (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, slope, CASE WHEN lvl > ratio THEN cap ELSE weight * (SELECT arg_min(lvl, ratio) FROM leveled WHERE lvl <= ratio) END AS target
  FROM leveled
), placed AS (
  SELECT s.doc_id, s.size, t.*,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS passes
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), taken AS (
  SELECT *, (passes + CASE WHEN size > 0 AND before + size / 2.0::DOUBLE <= target - passes * source_size THEN 1 ELSE 0 END)::INTEGER AS copies,
    least((before + size / 2.0::DOUBLE) / target, 1.0::DOUBLE) AS u
  FROM placed
)
SELECT doc_id, size::BIGINT AS size, source_size, round(target, 4) AS target, (copies * size)::BIGINT AS taken, copies,
  CASE WHEN copies > 0 THEN round(CASE WHEN slope = 0 THEN u ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * u) - (1 - slope)) / (2 * slope) END, 6) END AS position
FROM taken
"""
