"""Labels, sampling, splits, deduplication and resampling; deterministic, without drawing on row order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provspark.functions import ids
from provspark.operators import patterns, ranks


def label_iocs(raw: DataFrame, scenarios: list[dict], text: str = "_raw", time: str = "_time") -> DataFrame:
    """``raw`` with label and scenario: the first scenario whose patterns occur in its time window.

    A scenario is {id, patterns, start, end}. All scenarios' patterns are looked
    for in one pass over a text, however many they are.
    """
    found = raw.withColumn("_found", patterns.groups_found(F.col(text), [s["patterns"] for s in scenarios]))
    inside = lambda s: (F.col(time) >= s.get("start", -(2**62))) & (F.col(time) <= s.get("end", 2**62))
    tests = [F.when(F.array_contains("_found", i) & inside(s), s["id"]) for i, s in enumerate(scenarios)]
    first = F.coalesce(*tests) if tests else F.lit(None).cast("string")
    return found.withColumn("scenario", first).withColumn("label", F.col("scenario").isNotNull().cast("int")).drop("_found")


def hash_order(*key: str) -> Column:
    """A stable pseudo-random order of rows by their key, the same in any engine."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key]).cast("binary"))


def dedup_keep_first(df: DataFrame, content: list[str], order: list[str], label: str = "label") -> DataFrame:
    """One row for each (content hash, label): the first in ``order``."""
    keyed = df.withColumn("_hash", ids.content_hash(*[F.col(c) for c in content]))
    rank = F.row_number().over(Window.partitionBy("_hash", label).orderBy(*order))
    return keyed.withColumn("_rank", rank).where("_rank = 1").drop("_hash", "_rank")


def largest_remainder(groups: DataFrame, total: int, size: str = "n") -> DataFrame:
    """``groups`` with quota: ``total`` shared in proportion to ``size``, summing to it exactly (and never over the size)."""
    whole = Window.partitionBy()
    exact = F.col(size) * F.least(F.lit(total), F.sum(size).over(whole)) / F.sum(size).over(whole)
    t = groups.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    first = [c for c in groups.columns if c != size][0]
    t = t.withColumn("_left", F.least(F.lit(total), F.sum(size).over(whole)) - F.sum("_floor").over(whole))
    t = t.withColumn("_rank", F.row_number().over(Window.orderBy((F.col("_exact") - F.col("_floor")).desc(), first)))
    return t.withColumn("quota", (F.col("_floor") + (F.col("_rank") <= F.col("_left")).cast("int")).cast("long")).drop("_exact", "_floor", "_left", "_rank")


def proportional_sample(df: DataFrame, group: str, total: int, key: list[str], label: str = "label") -> DataFrame:
    """All positives, and negatives in proportion to their group's size up to ``total`` negatives."""
    negative = df.where(F.col(label) == 0)
    quotas = largest_remainder(negative.groupBy(group).agg(F.count("*").alias("n")), total).select(group, "quota")
    sampled = ranks.hash_rank(negative, [group], hash_order(*key), key, "_rank").join(quotas, group).where(F.col("_rank") <= F.col("quota")).select(*df.columns)
    return df.where(F.col(label) == 1).unionByName(sampled)


def temporal_split(df: DataFrame, time: str, fractions: tuple[float, float] = (0.6, 0.8)) -> DataFrame:
    """``df`` with split train, val or test by time; rows of one time never straddle a boundary."""
    counts = df.groupBy(F.col(time).alias("_at")).agg(F.count("*").alias("_n"))
    running = ranks.together(ranks.running_by_value(counts, [], "_at", {"_sum": "_n"}), counts.agg(F.sum("_n").alias("_all")), [])
    cuts = running.withColumn("_upto", F.col("_sum") / F.col("_all")).agg(*[F.max(F.when(F.col("_upto") <= f, F.col("_at"))).alias(f"_cut{i}") for i, f in enumerate(fractions)])
    before = lambda c: F.coalesce(F.col(time) <= F.col(c), F.lit(False))
    split = F.when(before("_cut0"), "train").when(before("_cut1"), "val").otherwise("test")
    return df.crossJoin(F.broadcast(cuts)).withColumn("split", split).drop("_cut0", "_cut1")  # cuts: one row


def hash_split(df: DataFrame, key: str, label: str = "label", seed: int = 42) -> DataFrame:
    """``df`` with split 60/20/20 by a stable bucket of (label, key)."""
    bucket = ids.stable_bucket(F.col(label), F.col(key), seed)
    return df.withColumn("split", F.when(bucket < 60, "train").when(bucket < 80, "val").otherwise("test"))


def stratified_split(df: DataFrame, key: list[str], label: str = "label", fractions: tuple[float, float] = (0.6, 0.8)) -> DataFrame:
    """``df`` with split cut at exactly int(n f) rows of each label, in hash order."""
    t = ranks.together(ranks.hash_rank(df, [label], hash_order(*key), key, "_at"), df.groupBy(label).agg(F.count("*").alias("_n")), [label])
    split = F.when(F.col("_at") <= F.floor(F.col("_n") * fractions[0]), "train").when(F.col("_at") <= F.floor(F.col("_n") * fractions[1]), "val").otherwise("test")
    return t.withColumn("split", split).drop("_at", "_n")


def median_split(df: DataFrame, time: str, label: str | None = None) -> DataFrame:
    """``df`` with half early or late, cut at the median time of all rows or, with ``label``, of the positives."""
    cut = ranks.percentiles(df if label is None else df.where(F.col(label) == 1), time, {"_cut": 0.5})
    return df.crossJoin(F.broadcast(cut)).withColumn("half", F.when(F.col(time) <= F.col("_cut"), "early").otherwise("late")).drop("_cut")  # one row


def leave_one_out(df: DataFrame, group: str, max_groups: int = 1000) -> DataFrame:
    """(fold, role, columns): each row once a fold; test where its group is the fold, else train. More than ``max_groups`` folds raise."""
    folds = df.select(F.col(group).alias("fold")).distinct()
    if folds.limit(max_groups + 1).count() > max_groups:
        raise ValueError(f"more than {max_groups} groups: one copy of all rows a group is not what this is for")
    return df.crossJoin(F.broadcast(folds)).withColumn("role", F.when(F.col(group) == F.col("fold"), "test").otherwise("train"))


def few_shot(df: DataFrame, k: int, seeds: list[int], key: str, label: str = "label") -> DataFrame:
    """(seed, columns): all negatives and ``k`` positives for each seed; rows whose label is null are positives of their own.

    Negatives are only copied. Positives are cut to the ``k`` first by hash in
    each partition before they shuffle, so a seed's group holds ``k`` rows a partition.
    """
    seeded = df.withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    negative = F.coalesce(F.col(label) == 0, F.lit(False))
    rank = F.row_number().over(Window.partitionBy("seed", label).orderBy(hash_order("seed", key), key))
    chosen = seeded.where(~negative).withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")
    return seeded.where(negative).unionByName(chosen)


def type_matched_sample(attacks: DataFrame, benign: DataFrame, kind: str, key: str) -> DataFrame:
    """(attack, benign, type): for each attack seed a benign one of its type, reused in turn if there are fewer."""
    rank = lambda t: ranks.hash_rank(t, [kind], hash_order(key), [key], "_r").withColumn("_r", F.col("_r") - 1)
    pool = rank(benign).select(F.col(kind).alias("_k"), F.col(key).alias("benign"), F.col("_r").alias("_b"))
    sizes = pool.groupBy("_k").agg(F.count("*").alias("_n"))
    wanted = rank(attacks).select(F.col(key).alias("attack"), kind, "_r").join(sizes, F.col(kind) == F.col("_k")).drop("_k")
    return wanted.join(pool, (F.col(kind) == F.col("_k")) & (F.col("_r") % F.col("_n") == F.col("_b"))).select("attack", "benign", kind)


def uniform_background(df: DataFrame, columns: list[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows drawn evenly between each column's least and greatest value; a row's draw follows from its number and the seed."""
    spans = df.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.min, F.max)])
    u = lambda c: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(c), F.col("id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    draw = lambda c: F.col(f"min_{c}") + u(c) * (F.col(f"max_{c}") - F.col(f"min_{c}"))
    return df.sparkSession.range(n).crossJoin(F.broadcast(spans)).select(*[draw(c).alias(c) for c in columns])  # one row


def bootstrap(df: DataFrame, replicates: int, key: str, seed: int = 42) -> DataFrame:
    """(replicate, weight, columns): Poisson(1) weights for each replicate, by hash of the row; rows of weight 0 go."""
    each = df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("replicate").cast("string"), F.col(key).cast("string")).cast("binary"))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)
    total, term, weight = 0.0, 0.36787944117144233, F.lit(0)
    for i in range(8):  # the Poisson distribution function, to 1e-6
        total += term
        weight = weight + F.when(u >= total, 1).otherwise(0)
        term /= i + 1
    return each.withColumn("weight", weight).where("weight > 0")


def random_rows(df: DataFrame, n: int, key: list[str]) -> DataFrame:
    return df.orderBy(hash_order(*key), *key).limit(n)


def reservoir(df: DataFrame, group: str, n: int, key: list[str]) -> DataFrame:
    """``n`` rows of each group in hash order."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(hash_order(*key), *key))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def set_algebra(alert: DataFrame, truth: DataFrame, universe: DataFrame, key: str) -> DataFrame:
    """One row: tp, fp, fn, tn of three sets of keys."""
    flag = lambda t, name: t.select(key).distinct().withColumn(name, F.lit(1))
    u = universe.select(key).distinct().join(flag(alert, "a"), key, "left").join(flag(truth, "t"), key, "left")
    a, t = F.col("a").isNotNull(), F.col("t").isNotNull()
    count = lambda c: F.count_if(c)
    return u.agg(count(a & t).alias("tp"), count(a & ~t).alias("fp"), count(~a & t).alias("fn"), count(~a & ~t).alias("tn"))


def union_schema(frames: list[DataFrame]) -> DataFrame:
    """Union by name; a column whose types conflict becomes a string, a missing one null."""
    kinds: dict[str, set[str]] = {}
    for f in frames:
        for name, kind in f.dtypes:
            kinds.setdefault(name, set()).add(kind)
    to = {n: k.pop() if len(k) == 1 else "string" for n, k in kinds.items()}
    cast = lambda f: f.select(*[F.col(c).cast(to[c]).alias(c) for c in f.columns])
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(cast, frames))
