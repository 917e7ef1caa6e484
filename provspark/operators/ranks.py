"""Cumulative sums, ranks and exact percentiles that no single task has to hold.

A window over a whole table (or over two classes) is one task. Here the order
is cut into buckets first: by approximate quantiles of the values, or by the
leading digits of a hash. Sums of buckets are small and get their prefix sums
by a window of their own; the rows' sums are taken inside their bucket. The
cuts only decide where the work is done, not what comes out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from provspark.operators.graph import written

BUCKETS = 128


def together(t: DataFrame, small: DataFrame, by: list[str]) -> DataFrame:
    """``t`` with the columns of ``small``, one row a group (one in all without ``by``); null keys meet."""
    if not by:
        return t.crossJoin(F.broadcast(small))  # one row
    named = small.select(*[F.col(c).alias(f"_by_{c}") for c in by], *[c for c in small.columns if c not in by])
    on = F.lit(True)
    for c in by:
        on = on & t[c].eqNullSafe(named[f"_by_{c}"])
    return t.join(named, on).drop(*[f"_by_{c}" for c in by])


def _running(t: DataFrame, by: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``t``, which has ``_bucket`` in the order's sense, with running totals: new column -> summed column, the row included."""
    partial = {new: F.sum(old).alias(f"_in_{new}") for new, old in sums.items()}
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = t.groupBy(*by, "_bucket").agg(*partial.values())
    starts = starts.select(*by, "_bucket", *[F.coalesce(F.sum(f"_in_{new}").over(earlier), F.lit(0)).alias(f"_to_{new}") for new in sums])
    within = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = together(t, starts, [*by, "_bucket"])
    out = out.withColumns({new: F.col(f"_to_{new}") + F.sum(old).over(within) for new, old in sums.items()})
    return out.drop("_bucket", *[f"_to_{new}" for new in sums])


def running_by_value(t: DataFrame, by: list[str], value: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """Running totals down (or up) the values of ``value``, which are distinct within ``by``; nulls come last going down, first going up."""
    cuts = t.groupBy(*by).agg(F.percentile_approx(value, [i / BUCKETS for i in range(1, BUCKETS)], 10_000).alias("_cuts"))
    over = F.size(F.filter("_cuts", lambda c: (c > F.col(value)) if descending else (c < F.col(value))))
    bucket = F.when(F.col(value).isNull(), BUCKETS + 1 if descending else -1).otherwise(F.coalesce(over, F.lit(0)))
    placed = together(t, cuts, by).withColumn("_bucket", bucket).drop("_cuts")
    return _running(placed, by, [F.desc(value) if descending else F.col(value)], sums)


def greatest_onward(t: DataFrame, by: list[str], value: str, of: str, name: str) -> DataFrame:
    """``t`` with the greatest ``of`` at this or any lower value of ``value`` (distinct within ``by``)."""
    cuts = t.groupBy(*by).agg(F.percentile_approx(value, [i / BUCKETS for i in range(1, BUCKETS)], 10_000).alias("_cuts"))
    bucket = F.when(F.col(value).isNull(), -1).otherwise(F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(value))), F.lit(0)))
    placed = together(t, cuts, by).withColumn("_bucket", bucket).drop("_cuts")
    lower = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    beyond = placed.groupBy(*by, "_bucket").agg(F.max(of).alias("_most")).select(*by, "_bucket", F.max("_most").over(lower).alias("_beyond"))
    within = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return together(placed, beyond, [*by, "_bucket"]).withColumn(name, F.greatest("_beyond", F.max(of).over(within))).drop("_bucket", "_beyond")


def hash_rank(df: DataFrame, by: list[str], digest: Column, ties: list[str], name: str) -> DataFrame:
    """``df`` with the row's number (from 1) within ``by`` in the order of a hexadecimal digest, then ``ties``."""
    placed = df.withColumn("_digest", digest).withColumn("_bucket", F.substring("_digest", 1, 2)).withColumn("_one", F.lit(1))
    return _running(placed, by, [F.col("_digest"), *map(F.col, ties)], {name: "_one"}).drop("_digest", "_one")


def percentiles(df: DataFrame, value: str, points: dict[str, float], by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, one column a point): exact percentiles with linear interpolation, nulls aside; null for groups without values."""
    counts = df.groupBy(*by, value).agg(F.count(value).alias("_n"))
    t = running_by_value(counts, by, value, {"_upto": "_n"})
    t = together(t, counts.groupBy(*by).agg(F.sum("_n").alias("_all")), by)

    def at(index: Column) -> Column:
        """The value at a place (from 0) of the order."""
        return F.max(F.when((F.col("_n") > 0) & (F.col("_upto") - F.col("_n") <= index) & (index < F.col("_upto")), F.col(value)))

    place = {name: (F.col("_all") - 1) * p for name, p in points.items()}
    ends = [at(f(place[n])).alias(f"{n}_{k}") for n in points for k, f in (("lo", F.floor), ("hi", F.ceil))]
    found = t.groupBy(*by).agg(F.max("_all").alias("_all"), *ends)
    part = {n: place[n] - F.floor(place[n]) for n in points}
    mixed = lambda n: F.when(part[n] == 0, F.col(f"{n}_lo").cast("double")).otherwise(F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * part[n])  # noqa: E731  equal ends give themselves, to the last bit
    return found.select(*by, *[mixed(n).alias(n) for n in points])


#: Rows in a range of ``numbered``, and rows of a small table that may be broadcast once they are counted.
RANGE_ROWS, FEW_ROWS = 1 << 18, 100_000


def numbered(t: DataFrame, key: str, order: list[Column], sized: bool = False, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``t`` with position (long, from 0 in its ``key``), and group_rows if ``sized``, in the order of ``order``, which should be total.

    The rows are dealt by ranges of (key, order), as many as their number asks
    for, so that a key with a third of all rows lies in many of them; each range
    counts its own rows as they stream by, and what a key has in earlier ranges
    is added. ``key`` is never null; ``t`` is read three times, so write it first
    where it is dear.
    """
    schema = StructType([*t.schema.fields, StructField("_range", IntegerType()), StructField("_at", LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, after = TaskContext.get().partitionId(), None, 0
        for b in batches:
            keys = b.column(key)
            n = len(keys)
            if not n:
                continue
            new = np.ones(n, bool)
            new[0] = keys[0].as_py() != last
            new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            i = np.arange(n)
            begun = np.maximum.accumulate(np.where(new, i, -1))
            at = np.where(begun >= 0, i - begun, after + i)
            last, after = keys[n - 1].as_py(), int(at[-1]) + 1
            columns = [*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(at)]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, "_range", "_at"])

    ranges = max(1, -(-t.count() // range_rows))
    ranged = t.repartitionByRange(ranges, key, *order).sortWithinPartitions(key, *order)
    placed = written(ranged.mapInArrow(count, schema), "ranges")
    ends = placed.groupBy(key, "_range").agg((F.max("_at") + 1).alias("_rows"))
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # only a key that goes on in the next range has an entry: fewer rows than ranges
    starts = ends.withColumn("_start", F.sum("_rows").over(earlier)).where("_start IS NOT NULL").select(key, "_range", "_start")
    out = placed.join(F.broadcast(starts), [key, "_range"], "left").withColumn("position", F.col("_at") + F.coalesce("_start", F.lit(0)))
    if sized:
        sizes = ends.groupBy(key).agg(F.sum("_rows").alias("group_rows"))
        out = out.join(F.broadcast(sizes) if sizes.count() <= FEW_ROWS else sizes, key)
    return out.drop("_range", "_at", "_start")
