"""Embedding near-duplicates by NN-descent within equal labels.

Equal vectors of a label form one class. Every class keeps a list of its best
``k`` neighbours, whatever their cosine: links are found by walking over
neighbours of neighbours, and an isolated pair shares its other neighbours.
The lists start from random-hyperplane leaves of bounded size. In a round the
neighbours and reverse neighbours of each vector meet one another; only pairs
with an entry that is new since the last round are compared, and only those
that improve a list come out. A list that is full of links (saturated) doubles
up to ``MAX_K``. What it cannot hold is found otherwise: once the lists give
components, a second search fills new lists with neighbours from outside one's
own component only, so that groups larger than a list meet wherever they touch
and their components merge; then the links of all members of the merged
component are counted exactly, where blocks that lie wholly within or beyond
the threshold's angle of each other need no products.

The graph is kept in 8-bit codes; entries that the codes' error leaves open are
decided in doubles. The final counts are audited against brute force on a
random share of the vectors and on linked vectors of each degree; the random
share grows until it holds enough linked vectors. While recall is under the
target another forest of leaves is added and refined; if it stays under, the
operator raises.

Defined results: vectors that are null, zero or hold null or non-finite
components, and null labels, link with nothing (n_links 0, component their own
id, kept); vectors of different lengths do not link; repeated rows count as
copies; a null vec_id keeps component null and counts as kept; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provspark.llm.common import whole_groups, written
from provspark.llm.components import components

THRESHOLD = 0.93
K, MAX_K, REVERSE = 8, 32, 12
LEAF, TREES, ROUNDS = 128, 8, 6
BLOCK = 512
#: Random vectors in the first audit, the most it grows to, linked vectors of each degree, and linked vectors it wants.
PROBES, MOST_PROBES, BY_DEGREE, ENOUGH = 8_192, 32_768, 64, 200
TARGET_RECALL = 0.98
FOUND = "id long, nbr long, cos float"
ENTRY = "array<struct<nbr:bigint,cos:float,fresh:boolean>>"


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, key) of the rows that take part, and one row (id, key, label, dims, copies, unit, code, off) for each distinct vector of a label."""

    @F.pandas_udf("unit binary, code binary, off double")
    def scaled(batch: pd.Series) -> pd.DataFrame:
        out = []
        for x in batch:
            v = np.asarray(x, dtype=np.float64)
            v = v / np.abs(v).max()
            v /= np.sqrt(v @ v)
            step = np.float32(np.abs(v).max() / 127)
            q = np.rint(v / step).astype(np.int8)
            out.append((v.tobytes(), step.tobytes() + q.tobytes(), float(np.sqrt(((v - q * np.float64(step)) ** 2).sum()))))
        return pd.DataFrame(out, columns=["unit", "code", "off"])

    x = F.col("embedding")
    number = lambda c: c.cast("double")
    fine = ~F.exists(x, lambda c: c.isNull() | F.isnan(number(c)) | (F.abs(number(c)) == float("inf"))) & F.exists(x, lambda c: number(c) != 0)
    key = F.md5(F.concat_ws(",", F.col("label").cast("string"), x.cast("array<string>")).cast("binary"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & fine)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding", key.alias("key"))
    reps = rows.groupBy("key").agg(F.min("vec_id").alias("id"), F.first("label").alias("label"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    reps = reps.select("id", "key", "label", F.size("embedding").alias("dims"), "copies", scaled("embedding").alias("s")).select("id", "key", "label", "dims", "copies", "s.*")
    return rows.select("vec_id", "key"), written(reps, "classes")


def _matrix(units: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(units), dtype=np.float64).reshape(len(units), -1)


def _decoded(codes: pd.Series) -> np.ndarray:
    raw = np.frombuffer(b"".join(codes), dtype=np.int8).reshape(len(codes), -1)
    return raw[:, 4:].astype(np.float32) * raw[:, :4].copy().view(np.float32)


def leaves(reps: DataFrame, seed: int, trees: int, k: int) -> DataFrame:
    """Each vector's ``k`` best of another ``own`` in each random-hyperplane leaf it falls in; a crowded leaf is dealt to chunks of about ``LEAF`` vectors."""
    sizes = reps.groupBy("label", "dims").agg(F.count("*").alias("n"))
    deep = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / (LEAF / 2)))).cast("int")

    def fall(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for dims, part in x.groupby("dims"):
                m = _decoded(part["code"])
                for t in range(trees):
                    planes = np.random.default_rng([seed, t, int(dims)]).standard_normal((int(dims), 40), dtype=np.float32)
                    bits = (m @ planes > 0) & (np.arange(40) < part["deep"].to_numpy()[:, None])
                    out.append(pd.DataFrame({"id": part["id"], "label": part["label"], "dims": part["dims"], "tree": t, "leaf": bits @ (1 << np.arange(40, dtype=np.int64))}))
            if out:
                yield pd.concat(out)

    fallen = reps.join(sizes, ["label", "dims"]).select("id", "label", "dims", "code", deep.alias("deep"))
    fallen = fallen.mapInPandas(fall, "id long, label string, dims int, tree int, leaf long").select("id", "dims", F.xxhash64("label", "tree", "leaf").alias("leaf"))
    fallen = written(fallen, "leaves")
    crowded = fallen.groupBy("leaf", "dims").agg(F.ceil(F.count("*") / LEAF).alias("chunks")).where("chunks > 1")
    chunk = F.pmod(F.xxhash64("id", "leaf"), F.coalesce("chunks", F.lit(1)))
    dealt = fallen.join(crowded, ["leaf", "dims"], "left").select("id", "leaf", "dims", chunk.alias("chunk")).join(reps.select("id", "code", "own"), "id")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x, at in whole_groups(batches, ["leaf", "dims", "chunk"]):
            ids, own, out = x["id"].to_numpy(), x["own"].to_numpy(), []
            for i, j in zip(at[:-1], at[1:], strict=True):
                m = _decoded(x["code"].iloc[i:j])
                c = m @ m.T
                c[own[i:j, None] == own[i:j]] = -2
                near = np.argpartition(-c, min(k, j - i - 1), axis=1)[:, :k]
                a, b = np.repeat(np.arange(j - i), near.shape[1]), near.ravel()
                other = c[a, b] > -2
                a, b = a[other], b[other]
                out.append((ids[i:j][a], ids[i:j][b], c[a, b]))
            ends = [np.concatenate(z) for z in zip(*out, strict=True)]
            yield pd.DataFrame(dict(zip(("id", "nbr", "cos"), ends, strict=True)))

    return dealt.repartition("leaf", "dims", "chunk").sortWithinPartitions("leaf", "dims", "chunk").mapInPandas(compare, FOUND)


def merged(found: DataFrame, lists: DataFrame | None, threshold: float) -> DataFrame:
    """(id, k, entries) with each list's best entries by falling cosine; entries that were not there before are fresh, saturated lists double."""
    new = found.select("id", "nbr", "cos", F.lit(True).alias("fresh"), F.lit(K).alias("k"))
    if lists is not None:
        old = lists.select("id", "k", F.explode("entries").alias("e")).select("id", "e.nbr", "e.cos", F.lit(False).alias("fresh"), "k")
        new = new.unionByName(old)
    # dealt by id once: that also serves the grouping by pairs
    pairs = new.repartition("id").groupBy("id", "nbr").agg(F.max("cos").alias("cos"), F.bool_and("fresh").alias("fresh"), F.max("k").alias("k"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cos"), "nbr"))
    best = pairs.withColumn("rank", rank).where(F.col("rank") <= MAX_K)
    entry = F.struct((-F.col("rank")).alias("r"), "nbr", "cos", "fresh")
    listed = best.groupBy("id").agg(F.max("k").alias("k"), F.sort_array(F.collect_list(entry), False).alias("all"))
    full = (F.size("all") >= F.col("k")) & (F.element_at("all", F.least(F.col("k"), F.size("all")))["cos"] >= threshold)
    listed = listed.withColumn("k", F.when(full, F.least(F.col("k") * 2, F.lit(MAX_K))).otherwise(F.col("k")))
    entries = F.transform(F.slice("all", F.lit(1), F.col("k")), lambda e: F.struct(e["nbr"].alias("nbr"), e["cos"].alias("cos"), e["fresh"].alias("fresh")))
    return listed.select("id", "k", entries.cast(ENTRY).alias("entries"))


def meet(lists: DataFrame, reps: DataFrame) -> DataFrame:
    """One round: pairs of neighbours and reverse neighbours of each vector, of different ``own``, that improve a list of theirs."""
    entry = lists.select("id", F.explode("entries").alias("e"))
    forth = entry.select(F.col("id").alias("at"), F.col("e.nbr").alias("member"), "e.fresh", "e.cos", F.lit(False).alias("back"))
    back = entry.select(F.col("e.nbr").alias("at"), F.col("id").alias("member"), "e.fresh", "e.cos", F.lit(True).alias("back"))
    own = lists.select(F.col("id").alias("at"), F.col("id").alias("member"), F.lit(False).alias("fresh"), F.lit(1.0).cast("float").alias("cos"), F.lit(False).alias("back"))
    rank = F.row_number().over(Window.partitionBy("at", "back").orderBy(F.desc("fresh"), F.desc("cos"), "member"))
    around = forth.union(back).union(own).repartition("at").withColumn("rank", rank).where(~F.col("back") | (F.col("rank") <= REVERSE))
    around = around.withColumn("any", F.max("fresh").over(Window.partitionBy("at"))).where("any").select("at", "member", "fresh")
    # what a candidate has to beat: the last entry of a full list
    low = F.when(F.size("entries") >= F.col("k"), F.element_at("entries", -1)["cos"]).otherwise(F.lit(-2.0)).cast("float")
    nodes = reps.select("id", "code", "dims", "own").join(lists.select("id", low.alias("low")), "id").withColumnRenamed("id", "member")
    placed = around.join(nodes, "member").repartition("at").sortWithinPartitions("at")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x, at in whole_groups(batches, ["at"]):
            dims = x["dims"].to_numpy()[at[:-1]]
            for d in np.unique(dims):  # the members of a group have one length
                groups = np.flatnonzero(dims == d)
                sizes = (at[1:] - at[:-1])[groups]
                most = int(sizes.max())
                place = at[:-1][groups][:, None] + np.arange(most)
                there = np.arange(most) < sizes[:, None]
                place = np.where(there, place, at[:-1][groups][:, None])
                flat = place.ravel()
                ids, own, low, fresh = (x[c].to_numpy()[flat].reshape(place.shape) for c in ("member", "own", "low", "fresh"))
                rows = np.unique(flat, return_inverse=True)
                m = _decoded(x["code"].iloc[rows[0]])[rows[1]].reshape(*place.shape, -1)
                c = np.matmul(m, m.transpose(0, 2, 1))
                ask = there[:, :, None] & there[:, None, :] & (fresh[:, :, None] | fresh[:, None, :]) & (own[:, :, None] != own[:, None, :]) & (c > low[:, :, None])
                g, i, j = np.nonzero(ask)
                yield pd.DataFrame({"id": ids[g, i], "nbr": ids[g, j], "cos": c[g, i, j]}).drop_duplicates(["id", "nbr"])

    return placed.select("at", "member", "own", "fresh", "code", "dims", "low").mapInPandas(compare, FOUND)


def links_of(lists: DataFrame, reps: DataFrame, threshold: float, margin: float) -> DataFrame:
    """(a, b), a < b: entries whose cosine reaches the threshold; those within ``margin`` of it are decided in doubles."""
    e = lists.select("id", F.explode("entries").alias("e")).select(F.least("id", "e.nbr").alias("a"), F.greatest("id", "e.nbr").alias("b"), "e.cos")
    pairs = written(e.where(F.col("cos") >= threshold - margin).groupBy("a", "b").agg(F.max("cos").alias("cos")), "candidates")
    units = lambda c: reps.select(F.col("id").alias(c), F.col("unit").alias(f"unit_{c}"), F.col("label").alias(f"label_{c}"))
    open_ = pairs.where(F.col("cos") < threshold + margin).join(units("a"), "a").join(units("b"), "b").where("label_a = label_b")

    @F.pandas_udf("double")
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float(np.frombuffer(x) @ np.frombuffer(y)) for x, y in zip(a, b, strict=True)])

    decided = open_.where(cosine("unit_a", "unit_b") >= threshold).select("a", "b")
    return written(pairs.where(F.col("cos") >= threshold + margin).select("a", "b").union(decided), "links")


def counted(reps: DataFrame, member: DataFrame, full: DataFrame, threshold: float) -> DataFrame:
    """(id, n): exact links, copies counted, of the saturated classes ``full``; each is compared with its component block by block."""
    of = member.select(F.col("node").alias("id"), "component").union(member.select(F.col("component").alias("id"), "component").distinct())
    some = full.join(of, "id").select("component").distinct()
    inside = reps.select("id", "copies", "unit").join(of.join(some, "component", "left_semi"), "id").join(full.withColumn("full", F.lit(True)), "id", "left")
    sizes = inside.groupBy("component").agg(F.ceil(F.log2(F.count("*") / BLOCK)).alias("deep"))

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                code = np.zeros(len(x), np.int64)
                for dims, part in x.groupby(x["unit"].str.len()):
                    planes = np.random.default_rng([5, int(dims)]).standard_normal((int(dims) // 8, 40))
                    bits = (_matrix(part["unit"]) @ planes > 0) & (np.arange(40) < part["deep"].to_numpy()[:, None])
                    code[x.index.get_indexer(part.index)] = bits @ (1 << np.arange(40, dtype=np.int64))
                yield x.assign(cell=code).drop(columns="deep")

    celled = inside.join(sizes, "component").select("component", "id", "copies", F.coalesce("full", F.lit(False)).alias("full"), "unit", F.greatest("deep", F.lit(0)).cast("int").alias("deep"))
    celled = written(celled.mapInPandas(cells, "component long, id long, copies long, full boolean, unit binary, cell long"), "cells")
    chunks = celled.groupBy("component", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("chunks"))
    blocked = celled.join(chunks, ["component", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
    block = F.xxhash64("cell", "chunk")

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(part["unit"])
        center = m.mean(axis=0)
        center /= max(np.sqrt(center @ center), 1e-300)
        radius = float(np.arccos(np.clip(m @ center, -1, 1)).max())
        row = (part["component"].iloc[0], part["block"].iloc[0], int(part["copies"].sum()), bool(part["full"].any()), center.tobytes(), radius)
        arrays = (part["id"].to_numpy(np.int64).tobytes(), part["copies"].to_numpy(np.int64).tobytes(), part["full"].to_numpy(bool).tobytes(), m.tobytes())
        return pd.DataFrame([(*row, *arrays)], columns=["component", "block", "all", "any", "center", "radius", "ids", "copies", "full", "x"])

    kind = "component long, block long, all long, any boolean, center binary, radius double, ids binary, copies binary, full binary, x binary"
    blocks = written(blocked.withColumn("block", block).groupBy("component", "block").applyInPandas(packed, kind), "blocks")
    light = blocks.select("component", "block", "all", "any", "center", "radius")
    angle = float(np.arccos(threshold))

    def spread(part: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(part["center"])
        mean = m.mean(axis=0)
        mean /= max(np.sqrt(mean @ mean), 1e-300)
        radius = (np.arccos(np.clip(m @ mean, -1, 1)) + part["radius"]).max()
        return pd.DataFrame({"component": part["component"].iloc[:1], "dense": 2 * radius < angle - 1e-6, "whole": int(part["all"].sum())})

    # one row for each block of a component: its members are within one angle of each other if the component is small enough
    dense = written(light.groupBy("component").applyInPandas(spread, "component long, dense boolean, whole long"), "dense")
    easy = celled.where("full").join(dense.where("dense"), "component").select("id", (F.col("whole") - F.col("copies")).alias("n"))
    left = light.join(dense.where("NOT dense"), "component", "left_semi")
    other = left.select("component", *[F.col(c).alias(f"{c}2") for c in ("block", "all", "center", "radius")])

    @F.pandas_udf("int")
    def relation(a: pd.Series, b: pd.Series, ra: pd.Series, rb: pd.Series) -> pd.Series:
        """1: all linked, -1: none, 0: to be compared."""
        between = np.array([float(np.arccos(np.clip(np.frombuffer(x) @ np.frombuffer(y), -1, 1))) for x, y in zip(a, b, strict=True)])
        return pd.Series(np.where(between + ra + rb < angle - 1e-6, 1, np.where(between - ra - rb > angle + 1e-6, -1, 0)).astype(np.int32))

    pairs = left.where("any").join(other, "component").select("component", "block", "block2", "all2", relation("center", "center2", "radius", "radius2").alias("r")).where("r >= 0")
    pairs = written(pairs, "block_pairs")
    heavy = blocks.select("component", "block", "ids", "copies", "full", "x")
    second = blocks.select("component", F.col("block").alias("block2"), F.col("copies").alias("copies2"), F.col("x").alias("x2"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for r in x.itertuples():
                ids, mine, own = np.frombuffer(r.ids, np.int64), np.frombuffer(r.full, bool), np.frombuffer(r.copies, np.int64)
                if r.r:
                    n = np.full(len(ids), r.all2)
                else:
                    a, b = np.frombuffer(r.x).reshape(len(ids), -1), np.frombuffer(r.x2)
                    n = (a @ b.reshape(-1, a.shape[1]).T >= threshold).astype(np.int64) @ np.frombuffer(r.copies2, np.int64)
                if r.block == r.block2:
                    n = n - own  # a vector does not link with itself
                yield pd.DataFrame({"id": ids[mine], "n": n[mine]})

    both = pairs.join(heavy, ["component", "block"]).join(second, ["component", "block2"], "left")
    both = both.withColumn("x2", F.when(F.col("r") == 0, F.col("x2"))).repartition("component", "block", "block2")
    hard = both.mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return easy.unionByName(hard)


def audit(reps: DataFrame, counts: DataFrame, threshold: float) -> tuple[float, int]:
    """Mean share of their brute-force links that sampled vectors have in ``counts`` (id, n), and how many of them have links.

    The sample is ``BY_DEGREE`` linked vectors of each power of two of links,
    and a random share that grows until it holds ``ENOUGH`` linked vectors (or
    ``MOST_PROBES``, or all). Of both parts' means the lower counts.
    """
    degree, all_ = F.floor(F.log2("n")).alias("degree"), reps.count()
    rank = F.row_number().over(Window.partitionBy("degree").orderBy(F.xxhash64("id"), "id"))
    linked = counts.where("n > 0").select("id", degree).withColumn("rank", rank).where(F.col("rank") <= BY_DEGREE).select("id", F.lit(False).alias("drawn"))
    size = PROBES
    while True:
        share = F.lit(size / max(all_, 1)) * (1 << 30)
        drawn = reps.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < share).select("id", F.lit(True).alias("drawn"))
        chosen = linked.union(drawn).groupBy("id").agg(F.max("drawn").alias("drawn"))
        probe = chosen.join(reps.select("id", "label", "dims", "unit"), "id").join(counts, "id", "left").toPandas()  # about MOST_PROBES rows at most, and a few hundred
        if probe.empty:
            return 1.0, 0

        def true_links(batches: Iterator[pd.DataFrame], probe: pd.DataFrame = probe) -> Iterator[pd.DataFrame]:
            rooms = {k: (v["id"].to_numpy(), _matrix(v["unit"])) for k, v in probe.groupby(["label", "dims"])}
            for x in batches:
                for key, part in x.groupby(["label", "dims"]):
                    if key in rooms:
                        ids, m = rooms[key]
                        for i in range(0, len(ids), 4096):
                            near = (m[i : i + 4096] @ _matrix(part["unit"]).T >= threshold) & (ids[i : i + 4096, None] != part["id"].to_numpy())
                            n = near.astype(np.int64) @ part["copies"].to_numpy(np.int64)
                            yield pd.DataFrame({"id": ids[i : i + 4096][n > 0], "n": n[n > 0]})

        true = reps.select("id", "label", "dims", "copies", "unit").mapInPandas(true_links, "id long, n long").groupBy("id").agg(F.sum("n").alias("true")).toPandas()
        told = probe.merge(true, "inner", "id")
        found = (told["n"].fillna(0) / told["true"]).clip(upper=1)
        means = [found[told["drawn"]].mean(), found[~told["drawn"]].mean()]
        if told["drawn"].sum() >= ENOUGH or size >= min(MOST_PROBES, all_):
            return float(np.nanmin([*means, 1.0])), len(told)
        size *= 4


def searched(reps: DataFrame, lists: DataFrame | None, seed: int, trees: int, rounds: int, least: float) -> DataFrame:
    """``lists`` after another forest of leaves and the rounds that follow, until no entry of at least ``least`` is new."""
    lists = written(merged(leaves(reps, seed, trees, K), lists, least), "lists")
    for turn in range(rounds):
        lists = written(merged(meet(lists, reps), lists, least), "lists")
        if turn and lists.select(F.explode("entries").alias("e")).where((F.col("e.cos") >= least) & F.col("e.fresh")).isEmpty():
            break
    return lists


def linked_classes(reps: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, rounds: int = ROUNDS, target_recall: float = TARGET_RECALL, max_forests: int = 4) -> tuple[DataFrame, DataFrame, float]:
    """(id, n) with the links of each linked class to others, (node, component), and the audited recall."""
    margin = 2.1 * (reps.agg(F.max("off")).first()[0] or 0.0) + 1e-5
    least = threshold - margin
    alone = reps.withColumn("own", F.col("id"))
    lists: DataFrame | None = None
    links: DataFrame | None = None
    for forest in range(max_forests):
        lists = searched(alone, lists, forest, trees, rounds, least)
        new = links_of(lists, reps, threshold, margin)
        links = new if links is None else links.union(new).distinct()
        member = components(links)
        full = written(lists.where((F.size("entries") >= F.col("k")) & (F.element_at("entries", -1)["cos"] >= least)).select("id"), "saturated")
        saturated = not full.isEmpty()
        if saturated:
            # what saturated lists have no room for: neighbours outside their own component
            of = member.select(F.col("node").alias("id"), "component").union(member.select(F.col("component").alias("id"), "component").distinct())
            crowded = of.join(of.join(full, "id").select("component").distinct(), "component")
            outside = written(reps.join(crowded, "id", "left").withColumn("own", F.coalesce("component", "id")).drop("component"), "outside")
            more = links_of(searched(outside, None, max_forests + forest, trees, 2, least), reps, threshold, margin)
            if not more.isEmpty():
                links = written(links.union(more).distinct(), "links")
                member = components(links)
        ends = links.select(F.col("a").alias("id"), F.col("b").alias("nbr")).union(links.select("b", "a"))
        near = ends.join(reps.select(F.col("id").alias("nbr"), "copies"), "nbr").groupBy("id").agg(F.sum("copies").alias("n"))
        exact = near
        if saturated:
            # beside a saturated list others may be short of entries as well: all of its component are counted
            of = member.select(F.col("node").alias("id"), "component").union(member.select(F.col("component").alias("id"), "component").distinct())
            full = written(of.join(of.join(full, "id").select("component").distinct(), "component", "left_semi").select("id"), "saturated")
            exact = near.join(full, "id", "left_anti").select("id", "n").union(counted(reps, member, full, threshold))
        counts = written(exact.select("id", "n"), "counts")
        recall, seen = audit(reps, counts, threshold)
        if recall >= target_recall:
            return counts, member, recall
    raise RuntimeError(f"recall {recall:.3f} of {seen} linked vectors after {max_forests} forests is under {target_recall}")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, **options: float) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audited_recall) of every row of ``vectors``."""
    rows, reps = classes(vectors)
    counts, member, recall = linked_classes(reps, threshold, **options)
    told = reps.select("id", "key", "copies").join(counts, "id", "left").join(member.withColumnRenamed("node", "id"), "id", "left")
    told = told.select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = rows.join(told, "key").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    same: Column = F.col("vec_id").eqNullSafe(F.coalesce("component_id", "vec_id"))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(linked, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        same.alias("kept"), F.lit(recall).alias("audited_recall"),
    )
