"""Ranking and classification metrics as aggregations, exact under ties, for any grouping.

Scores are grouped before any cumulative window, so windows run over distinct
scores; equal scores always count together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provspark.operators import ranks


def _score_table(df: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """(by, score, pos, neg) with cumulative tp and fp down the ranking, ties together, and totals p and n."""
    w = F.lit(1) if weight is None else weight
    t = df.groupBy(*by, "score").agg(F.sum(F.when(F.col("label") == 1, w).otherwise(0)).alias("pos"), F.sum(F.when(F.col("label") == 1, 0).otherwise(w)).alias("neg"))
    totals = t.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return ranks.together(ranks.running_by_value(t, by, "score", {"tp": "pos", "fp": "neg"}, descending=True), totals, by)


def roc_auc(df: DataFrame, by: list[str] = [], weight: Column | None = None) -> DataFrame:  # noqa: B006
    """(by, auc): Mann-Whitney with ties counting half; null without both classes."""
    t = _score_table(df, by, weight)
    wins = F.sum(F.col("pos") * (F.col("n") - F.col("fp") + F.col("neg") / 2))
    return t.groupBy(*by).agg((wins / F.when(F.max("p") * F.max("n") > 0, F.max("p") * F.max("n"))).alias("auc"))


def average_precision(df: DataFrame, by: list[str] = [], weight: Column | None = None) -> DataFrame:  # noqa: B006
    """(by, ap): sum of recall steps times precision, tie groups as one step."""
    t = _score_table(df, by, weight)
    step = F.col("pos") / F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return t.where("p > 0").groupBy(*by).agg(F.sum(step).alias("ap"))


def pr_auc_trapezoid(df: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, pr_auc): area under the linearly joined precision-recall curve from (0, 1)."""
    t = _score_table(df, by).where("p > 0").withColumn("r", F.col("tp") / F.col("p")).withColumn("pr", F.col("tp") / (F.col("tp") + F.col("fp")))
    down = Window.partitionBy(*by).orderBy(F.desc("score"))
    before_r, before_p = F.lag("r", 1, 0.0).over(down), F.lag("pr", 1, 1.0).over(down)
    return t.withColumn("a", (F.col("r") - before_r) * (F.col("pr") + before_p) / 2).groupBy(*by).agg(F.sum("a").alias("pr_auc"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion(df: DataFrame, flagged: Column, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, tp, fp, fn, tn, precision, recall, f1, mcc, fpr, base_rate, lift)."""
    y, f = F.col("label") == 1, flagged
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    t = df.groupBy(*by).agg(count(y & f).alias("tp"), count(~y & f).alias("fp"), count(y & ~f).alias("fn"), count(~y & ~f).alias("tn"))
    return with_rates(t)


def with_rates(t: DataFrame) -> DataFrame:
    """Rates from the columns tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    precision, recall, base = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tp + fn, tp + fp + fn + tn)
    return t.withColumns({
        "precision": precision, "recall": recall, "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "mcc": ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
        "fpr": ratio(fp, fp + tn), "base_rate": base, "lift": ratio(precision, base),
    })


def threshold_sweep(df: DataFrame, thresholds: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Rates at each of a few thresholds (column threshold); scores at or over it are flagged."""
    table = df.groupBy(*by, "score").agg(F.sum("label").alias("pos"), F.count("*").alias("all"))
    on = F.col("score") >= F.col("threshold")
    count = lambda c, where: F.sum(F.when(where, c).otherwise(0))
    t = table.crossJoin(F.broadcast(thresholds)).groupBy(*by, "threshold").agg(  # thresholds: a stated grid
        count(F.col("pos"), on).alias("tp"), count(F.col("all") - F.col("pos"), on).alias("fp"),
        count(F.col("pos"), ~on).alias("fn"), count(F.col("all") - F.col("pos"), ~on).alias("tn"),
    )
    return with_rates(t)


def best_f1(sweep: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """The least threshold of greatest F1."""
    return sweep.groupBy(*by).agg(F.min(F.struct((-F.round("f1", 12)).alias("f"), "threshold")).alias("m")).select(*by, F.col("m.threshold").alias("threshold"), (-F.col("m.f")).alias("f1"))


def threshold_for_precision(sweep: DataFrame, target: float, by: list[str] = []) -> DataFrame:  # noqa: B006
    """The least threshold whose precision reaches the target."""
    return sweep.where((F.col("precision") >= target) & (F.col("tp") + F.col("fp") > 0)).groupBy(*by).agg(F.min("threshold").alias("threshold"))


def precision_at_recall(df: DataFrame, recalls: list[float], by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, recall, precision): precision where the ranking first reaches each recall."""
    t = _score_table(df, by).where("p > 0").withColumn("r", F.explode(F.array(*map(F.lit, recalls))))
    reached = t.where(F.col("tp") >= F.col("r") * F.col("p") - 1e-9)
    return reached.groupBy(*by, F.col("r").alias("recall")).agg(F.max_by(F.col("tp") / (F.col("tp") + F.col("fp")), "score").alias("precision"))


def recall_at_fp(df: DataFrame, budgets: list[int], by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, budget, recalled, recall): positives above the point where false positives pass the budget."""
    t = _score_table(df, by).withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    recalled = F.coalesce(F.max(F.when(F.col("fp") <= F.col("budget"), F.col("tp"))), F.lit(0))
    return t.groupBy(*by, "budget").agg(recalled.alias("recalled"), (recalled / F.max("p")).alias("recall"))


def precision_at_k(df: DataFrame, ks: list[int], by: list[str] = [], tie: str = "entity") -> DataFrame:  # noqa: B006
    """(by, k, precision) of the k best by score, then ``tie``."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), tie))
    best = df if by else df.orderBy(F.desc("score"), tie).limit(max(ks))  # a window without keys has one task: only the best go there
    top = best.withColumn("rank", rank).where(F.col("rank") <= max(ks)).withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("rank <= k")
    return top.groupBy(*by, "k").agg((F.sum("label") / F.col("k")).alias("precision"))


def adp(df: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, adp): area under the precision envelope over the share of attacks found; ties count together.

    ``attack_id`` is -1 for benign rows. Null without attacks.
    """
    mal = F.col("attack_id") >= 0
    first = df.where(mal).groupBy(*by, "attack_id").agg(F.max("score").alias("score")).groupBy(*by, "score").agg(F.count("*").alias("found"))
    rows = df.groupBy(*by, "score").agg(F.sum(mal.cast("int")).alias("pos"), F.count("*").alias("all"))
    t = rows.join(first, [*by, "score"], "left")
    t = t.withColumn("found", F.coalesce("found", F.lit(0)))
    down = ranks.running_by_value(t, by, "score", {"pos_down": "pos", "all_down": "all"}, descending=True).withColumn("precision", F.col("pos_down") / F.col("all_down"))
    totals = first.groupBy(*by).agg(F.sum("found").alias("attacks"))
    t = ranks.together(ranks.greatest_onward(down, by, "score", "precision", "envelope"), totals, by)
    area = F.col("found") / F.col("attacks") * F.col("envelope")
    return t.where("attacks > 0").groupBy(*by).agg(F.sum(area).alias("adp"))


def seed_stability(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, mean, sigma, relative_sigma) over seeds, population deviation."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sigma"), ratio(F.stddev_pop(value), F.abs(F.avg(value))).alias("relative_sigma"))


def mid_ranks(df: DataFrame, column: str, by: list[str] = [], name: str = "rank") -> DataFrame:  # noqa: B006
    """``df`` with the mean rank of equal values (from 1), by way of a table of distinct values."""
    counts = df.groupBy(*by, column).agg(F.count("*").alias("_n"))
    placed = ranks.running_by_value(counts, by, column, {"_upto": "_n"}).select(*by, column, (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2).alias(name))
    return df.join(placed, [*by, column])


def spearman(df: DataFrame, a: str, b: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, rho): correlation of mid-ranks."""
    ranked = mid_ranks(mid_ranks(df, a, by, "_ra"), b, by, "_rb")
    return ranked.groupBy(*by).agg(F.corr("_ra", "_rb").alias("rho"))


def flag_overlap(df: DataFrame, a: str, b: str, percents: list[float]) -> DataFrame:
    """(percent, a_flags, b_flags, both, jaccard, b_in_a) where each flags scores over its own percentile."""
    of = lambda c: ranks.percentiles(df, c, {f"{c}_{i}": p / 100 for i, p in enumerate(percents)})
    cut = of(a).crossJoin(F.broadcast(of(b))) if a != b else of(a)  # one row each
    stated = F.explode(F.array(*[F.struct(F.lit(p).alias("percent"), F.col(f"{a}_{i}").alias("ca"), F.col(f"{b}_{i}").alias("cb")) for i, p in enumerate(percents)]))
    grid = cut.select(stated.alias("g")).select("g.*")
    fa, fb = (F.col(a) > F.col("ca")).cast("int"), (F.col(b) > F.col("cb")).cast("int")
    t = df.crossJoin(F.broadcast(grid)).groupBy("percent").agg(F.sum(fa).alias("a_flags"), F.sum(fb).alias("b_flags"), F.sum(fa * fb).alias("both"))  # a stated grid
    return t.withColumn("jaccard", ratio(F.col("both"), F.col("a_flags") + F.col("b_flags") - F.col("both"))).withColumn("b_in_a", ratio(F.col("both"), F.col("b_flags")))


def score_histogram(df: DataFrame, edges: list[float]) -> DataFrame:
    """(label, bin, n): counts in fixed half-open bins; the last is closed."""
    bin_ = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        top = F.col("score") <= edges[i + 1] if i == len(edges) - 2 else F.col("score") < edges[i + 1]
        bin_ = F.when((F.col("score") >= edges[i]) & top, i).otherwise(bin_)
    return df.withColumn("bin", bin_).where("bin IS NOT NULL").groupBy("label", "bin").agg(F.count("*").alias("n"))


def calibration_curve(df: DataFrame, bins: int = 20) -> DataFrame:
    """(bin, mean_score, observed, n): quantile bins of the score; equal scores share a bin."""
    ranked = mid_ranks(df, "score", [], "_rank").withColumn("bin", F.lit(0))
    total = df.agg(F.count("*").alias("_all"))
    binned = ranked.crossJoin(F.broadcast(total)).withColumn("bin", F.least(F.floor((F.col("_rank") - 0.5) * bins / F.col("_all")), F.lit(bins - 1)).cast("int"))  # one row
    return binned.groupBy("bin").agg(F.avg("score").alias("mean_score"), F.avg("label").alias("observed"), F.count("*").alias("n"))


def hop_adjusted(edges: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row: raw and two-hop-adjusted counts. ``verdicts`` has node, flagged, label.

    A false positive within two hops of a true node is forgiven; a missed true
    node within two hops of a found one is promoted.
    """
    from provspark.operators.graph import two_hop_closure

    true = verdicts.where("label = 1").select("node")
    found = verdicts.where("label = 1 AND flagged = 1").select("node")
    near_true, near_found = two_hop_closure(edges, true).withColumn("nt", F.lit(1)), two_hop_closure(edges, found).withColumn("nf", F.lit(1))
    v = verdicts.join(near_true, "node", "left").join(near_found, "node", "left")
    fl, y = F.col("flagged") == 1, F.col("label") == 1
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    t = v.agg(
        count(fl & y).alias("raw_tp"), count(fl & ~y).alias("raw_fp"), count(~fl & y).alias("raw_fn"),
        count(fl & ~y & F.col("nt").isNotNull()).alias("forgiven"), count(~fl & y & F.col("nf").isNotNull()).alias("promoted"),
    )
    tp, fp, fn = F.col("raw_tp") + F.col("promoted"), F.col("raw_fp") - F.col("forgiven"), F.col("raw_fn") - F.col("promoted")
    f1 = lambda a, b, c: ratio(2 * a, 2 * a + b + c)
    return t.withColumn("raw_f1", f1(F.col("raw_tp"), F.col("raw_fp"), F.col("raw_fn"))).withColumn("adjusted_f1", f1(tp, fp, fn))
