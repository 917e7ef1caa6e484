"""Corpus and label audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.operators import patterns, ranks


def ioc_audit(raw: DataFrame, iocs: list[str], text: str, time: str, group: str, top: int = 3) -> DataFrame:
    """(ioc, hits, t_min, t_max, span_days, top_groups): one pass for all indicators; those without hits stay."""
    listed = sorted({p.lower() for p in iocs})
    hits = raw.select(F.explode(patterns.groups_found(F.col(text), [[p] for p in listed])).alias("_i"), F.col(time).alias("at"), F.col(group).alias("g"))
    by_group = hits.groupBy("_i", "g").agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "g"))), 1, top)
    total = by_group.groupBy("_i").agg(F.sum("n").alias("hits"), F.min("lo").alias("t_min"), F.max("hi").alias("t_max"), F.array_join(F.transform(ranked, lambda x: x["g"]), ",").alias("top_groups"))
    every = raw.sparkSession.createDataFrame(list(enumerate(listed)), "_i int, ioc string")
    return every.join(total, "_i", "left").select("ioc", F.coalesce("hits", F.lit(0)).alias("hits"), "t_min", "t_max", ((F.col("t_max") - F.col("t_min")) / 86_400).alias("span_days"), F.coalesce("top_groups", F.lit("")).alias("top_groups"))


def anchor_check(df: DataFrame, group: str, anchors: dict[str, int]) -> DataFrame:
    """(group, anchor, n, delta): counts against expected ones; both sides are kept."""
    expected = df.sparkSession.createDataFrame(list(anchors.items()), f"{group} string, anchor long")
    counts = df.groupBy(F.col(group).cast("string").alias(group)).agg(F.count("*").alias("n"))
    t = counts.join(expected, group, "full")
    return t.select(group, "anchor", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) - F.col("anchor")).alias("delta"))


def graph_fill(parsed: DataFrame, group: str, least: float = 0.8) -> DataFrame:
    """(group, rows, fill, ok): share of rows with a whole triple."""
    whole = F.col("subject_type").isNotNull() & F.col("object_type").isNotNull() & F.col("edge_type").isNotNull()
    fill = F.avg(F.when(whole, 1.0).otherwise(0.0))
    return parsed.groupBy(group).agg(F.count("*").alias("rows"), fill.alias("fill"), (fill >= least).cast("int").alias("ok"))


def vocabulary_overlap(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: distinct values of each side, shared ones, and the shared part of b."""
    t = a.select(F.col(column).alias("v"), F.lit(1).alias("a")).distinct().join(b.select(F.col(column).alias("v"), F.lit(1).alias("b")).distinct(), "v", "full")
    both = F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull())
    return t.agg(F.count("a").alias("in_a"), F.count("b").alias("in_b"), both.alias("shared"), (both / F.count("b")).alias("shared_of_b"))


def percentile_profile(df: DataFrame, value: str, by: str, points: tuple[float, ...] = (0.0, 0.1, 0.5, 0.9, 1.0)) -> DataFrame:
    return ranks.percentiles(df, value, {f"p{int(p * 100)}": p for p in points}, [by])


def window_fractions(df: DataFrame, time: Column, start: int, end: int, by: str) -> DataFrame:
    """(by, before, inside, after): shares of rows by time."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return df.groupBy(by).agg(share(time < start).alias("before"), share((time >= start) & (time <= end)).alias("inside"), share(time > end).alias("after"))


def flagged_by_type(df: DataFrame, by: str) -> DataFrame:
    """(by, total, flagged, share)."""
    return df.groupBy(by).agg(F.count("*").alias("total"), F.sum("flagged").alias("flagged"), F.avg("flagged").alias("share"))


def gates(metrics: DataFrame, conditions: dict[str, str]) -> DataFrame:
    """``metrics`` with a column for each named SQL condition, 1 where it holds, and go, 1 where all hold."""
    t = metrics.withColumns({k: F.coalesce(F.expr(c), F.lit(False)).cast("int") for k, c in conditions.items()})
    return t.withColumn("go", F.least(*[F.col(k) for k in conditions]) if len(conditions) > 1 else F.col(next(iter(conditions))))
