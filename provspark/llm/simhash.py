"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint is a majority vote over hashed word shingles. Its bit positions
are grouped into parts of correlated bits; part i gets its own threshold t_i,
and fingerprints that differ in at most t_i bits of some part are candidates.
Numbers and widths of the parts follow the number of fingerprints; thresholds
come from dynamic programming over candidate counts estimated on a bounded
sample of fingerprints. Each fingerprint is indexed once a part and probes the
keys within t_i bits; candidates are verified.

``near_duplicates`` finds all pairs of 64-bit fingerprints within ``radius``
bits: with sum(t_i + 1) = radius + 1, one part must differ in at most t_i bits.
``similar`` finds texts whose sets of word shingles have a Jaccard similarity
of ``similarity`` or more. Such pairs differ in about a seventh of all bits, so
fingerprints are long and no radius is certain: thresholds are allocated so
that a pair at exactly that similarity is a candidate with probability
``recall`` (pairs above it more often). Candidates whose 128 check bits agree
well enough are decided on their shingle sets.

Defined results: null text counts as empty; documents without words get
fingerprint zero and link like any other; rows that repeat a doc_id keep their
own fingerprint; a null doc_id gets the smallest non-null id of its group or
null; an empty table gives no rows; further columns of the input are ignored by
``near_duplicates`` and pass through ``keep_one``, where names that begin with
``_sim_`` are reserved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations
from math import acos, ceil, comb, inf, log, log2, pi

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import text_batches, whole_groups, written
from provspark.llm.components import components

BITS = 64
SEED = 42
#: Relative price of a probe (shuffled and sorted) against one compared pair.
PROBE_COST = 100.0
#: Fingerprints of the sample that candidate counts are estimated on, and the most probes of a part.
SAMPLE, MOST_PROBES = 1_024, 2_048
#: Nodes stand for null ids from here on.
NULL_BASE = 1 << 62
#: Chance that a pair at just the similarity is found; and of the 128 check bits, in how many candidates may differ.
RECALL, APART = 0.97, 34
#: Members up to which a bucket gives all its pairs, nearest of each member beyond, and members beyond which a bucket is split.
SMALL, NEAREST, CROWD = 32, 3, 1_024
#: Shingles beyond which one side of a group whose sets are compared is dealt over several.
HEAVY = 1 << 19


def fingerprint(text: str | None, words: int = 4) -> int:
    """SimHash of one text, as an unsigned integer."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return 0
    flat = b" ".join(w)
    if len(w) <= words:
        hashes = [xxhash.xxh64_intdigest(flat, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
        starts = [0, *ends[:-words].tolist()]
        hashes = [xxhash.xxh64_intdigest(flat[i:j], SEED) for i, j in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)).tobytes(), "big")


def fingerprint_column(text: Column, words: int = 4) -> Column:
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64))

    return run(text)


def sampled(fps: DataFrame, column: str = "fp") -> np.ndarray:
    """Bits (rows x positions, least first) of at most ``SAMPLE`` fingerprints; a fingerprint is a long or bytes of longs."""
    got = fps.orderBy(F.xxhash64(column), column).select(column).limit(SAMPLE).toPandas()[column].tolist()
    raw = b"".join(x if isinstance(x, (bytes, bytearray)) else int(x).to_bytes(8, "little", signed=True) for x in got)
    return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(got), -1) if got else np.zeros((0, 8), np.uint8), axis=1, bitorder="little")


def group_bits(bits: np.ndarray, widths: list[int]) -> list[list[int]]:
    """Parts of the given widths; each grows from the strongest remaining correlation by the bit most correlated with it."""
    x = bits - bits.mean(axis=0) if len(bits) else np.zeros((1, bits.shape[1]))
    sd = np.sqrt(np.maximum((x**2).mean(axis=0), 1e-12))
    corr = np.abs(x.T @ x / len(x) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, groups = np.ones(bits.shape[1], bool), []
    for width in widths:
        inside = np.where(free[:, None] & free[None, :], corr, -1)
        group = [int(inside.max(axis=1).argmax())]
        free[group[0]] = False
        near = corr[group[0]].copy()
        while len(group) < width:
            group.append(int(np.where(free, near, -1).argmax()))
            free[group[-1]] = False
            near += corr[group[-1]]
        groups.append(sorted(group))
    return groups


def costs(bits: np.ndarray, groups: list[list[int]], n: float, most: int) -> list[dict[int, float]]:
    """For each part, threshold -> estimated cost (-1: the part is not used): probes, and candidates by the sample's pairs, but not under chance."""
    out = []
    for g in groups:
        x = 2.0 * bits[:, g] - 1
        apart = ((len(g) - x @ x.T) / 2)[np.triu_indices(len(x), 1)]
        c = {-1: 0.0}
        for t in range(min(most, len(g)) + 1):
            masks = sum(comb(len(g), d) for d in range(t + 1))
            if masks <= MOST_PROBES:
                share = max((apart <= t + 0.5).mean() if len(apart) else 0.0, masks / 2.0 ** len(g))
                c[t] = PROBE_COST * n * (masks + (t > 0)) + share * n * n / 2
        out.append(c)
    return out


def allocate(cost: list[dict[int, float]], gains: Callable[[int, int], int], need: int) -> tuple[float, list[int]]:
    """Least cost and its thresholds with a total gain of at least ``need``; ``gains(part, threshold)`` are whole numbers."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i, c in enumerate(cost):
        step: dict[int, tuple[float, list[int]]] = {}
        for have, (price, chosen) in best.items():
            for t, more in c.items():
                u = min(need, have + (gains(i, t) if t >= 0 else 0))
                if price + more < step.get(u, (inf,))[0]:
                    step[u] = (price + more, [*chosen, t])
        best = step
    return best.get(need, (inf, []))


def radius_parts(bits: np.ndarray, n: float, radius: int) -> list[tuple[list[int], int]]:
    """Parts and thresholds that together catch every pair within ``radius`` bits, of least estimated cost."""
    found: tuple[float, list[tuple[list[int], int]]] = (inf, [])
    for parts in range(2, radius + 2):
        even = [bits.shape[1] // parts + (k < bits.shape[1] % parts) for k in range(parts)]
        more = (radius + 1) % parts  # parts with one bit more to differ: they may be wider
        shift = [4 * (parts - more) // parts if k < more else -(4 * more // parts) for k in range(parts)]
        uneven = [w + s for w, s in zip(even, shift, strict=True)]
        uneven[0] += bits.shape[1] - sum(uneven)
        for widths in {tuple(even), tuple(uneven)}:
            groups = group_bits(bits, list(widths))
            price, limits = allocate(costs(bits, groups, n, radius), lambda _, t: t + 1, radius + 1)
            if price < found[0]:
                found = price, [(g, t) for g, t in zip(groups, limits, strict=True) if t >= 0]
    return found[1]


def chance(width: int, t: int, apart: float) -> float:
    """Probability that at most ``t`` of ``width`` bits differ if each does with probability ``apart``."""
    return sum(comb(width, d) * apart**d * (1 - apart) ** (width - d) for d in range(t + 1))


def bit_distance(similarity: float) -> float:
    """Share of bits in which SimHashes of two sets of one size and this Jaccard similarity differ."""
    return acos(2 * similarity / (1 + similarity)) / pi


def wanted(n: float, similarity: float, recall: float) -> tuple[int, int]:
    """Width and number of parts that reach ``recall`` with equal keys, a few fingerprints a key."""
    width = max(8, ceil(log2(max(n, 2))) - 2)
    return width, ceil(log(1 - recall) / log(1 - chance(width, 0, bit_distance(similarity))))


def recall_parts(bits: np.ndarray, n: float, similarity: float, recall: float) -> list[tuple[list[int], int]]:
    """Parts and thresholds of least estimated cost with which a pair at the similarity is a candidate with probability ``recall``."""
    apart, steps, found = bit_distance(similarity), 1_000, (inf, [])
    base = wanted(n, similarity, recall)[0]
    for width in (base - 1, base, base + 2):
        groups = group_bits(bits, [width] * (bits.shape[1] // width))
        gain = {t: int(steps * log(1 - chance(width, t, apart)) / log(1 - recall)) for t in (0, 1)}
        price, limits = allocate(costs(bits, groups, n, 1), lambda _, t, gain=gain: gain[t], steps)
        if price < found[0]:
            found = price, [(g, t) for g, t in zip(groups, limits, strict=True) if t >= 0]
    return found[1]


def _masks(width: int, t: int) -> list[int]:
    return [sum(1 << b for b in c) for d in range(t + 1) for c in combinations(range(width), d)]


def _key(bits: list[int]) -> Column:
    key = F.lit(0).cast("long")
    for j, b in enumerate(bits):
        key = key.bitwiseOR(F.shiftleft(F.shiftright(F.col("fp"), b).bitwiseAND(F.lit(1).cast("long")), j))
    return key


def hamming_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """All pairs (a, b), a < b, of the distinct longs ``fp`` that differ in 1 to ``radius`` bits."""
    parts = radius_parts(sampled(fps), float(fps.count()), radius)
    # a part's number leads its key, which may take all other bits
    part = lambda k, key: F.struct(F.lit(k).alias("part"), key.alias("key"))
    index = fps.select(F.col("fp").alias("a"), F.explode(F.array(*[part(k, _key(g)) for k, (g, _) in enumerate(parts)])).alias("at"))
    flipped = lambda k, g: lambda mask: part(k, _key(g).bitwiseXOR(mask))
    probes = [F.transform(F.lit(_masks(len(g), t)).cast("array<bigint>"), flipped(k, g)) for k, (g, t) in enumerate(parts)]
    asked = fps.select(F.col("fp").alias("b"), F.explode(F.concat(*probes)).alias("at"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return index.join(asked, (index["at"] == asked["at"]) & near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4) -> DataFrame:
    """(doc_id, text_key, fp, component_id) of every row of ``docs``; links are transitive."""
    marked = written(
        docs.select("doc_id", F.xxhash64("text").alias("text_key"), fingerprint_column(F.col("text"), words).alias("fp")), "fingerprints"
    )
    classes = written(
        marked.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.shiftright("fp", 2).bitwiseAND(F.lit((1 << 60) - 1)) + NULL_BASE).alias("node")), "classes"
    )
    links = hamming_links(classes.select("fp"), radius)
    ends = classes.select("fp", "node")
    linked = (
        links.join(ends.toDF("a", "x"), "a").join(ends.toDF("b", "y"), "b").select("x", "y")
    )
    comp = components(linked, "x", "y")
    label = F.coalesce("component", "node")
    merged = (
        classes.join(comp, "node", "left")
        .select("fp", F.when(label < NULL_BASE, label).alias("component_id"))
    )
    return marked.join(merged, "fp").select("doc_id", "text_key", "fp", "component_id")


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Distinct hashes of a text's word shingles (fewer words: of the whole; none: nothing)."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return np.zeros(0, np.uint64)
    flat = b" ".join(w)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(flat, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = [0, *ends[:-words].tolist()]
    return np.unique(np.array([xxhash.xxh64_intdigest(flat[i:j], SEED) for i, j in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64))


def long_fingerprint(hashes: np.ndarray, lanes: int) -> bytes:
    """Majority votes over ``lanes`` times 64 bits, each lane from a hash of its own."""
    if not len(hashes):
        return bytes(8 * lanes)
    own = np.arange(1, lanes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    votes = np.zeros(64 * lanes, np.int64)
    for i in range(0, len(hashes), 255):  # counts of 255 rows fit a byte
        z = hashes[i : i + 255, None] + own
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        on = np.unpackbits((z ^ (z >> np.uint64(31))).view(np.uint8), axis=1, bitorder="little")
        votes += np.add.reduce(on, axis=0, dtype=np.uint8)
    return np.packbits(2 * votes > len(hashes), bitorder="little").tobytes()


def _spanning(apart: np.ndarray) -> np.ndarray:
    """Edges (i, j) of a tree of least total distance."""
    n = len(apart)
    near, by, free = apart[0].copy(), np.zeros(n, np.int64), np.ones(n, bool)
    free[0] = False
    out = np.empty((n - 1, 2), np.int64)
    for k in range(n - 1):
        i = int(np.where(free, near, 1 << 20).argmin())
        out[k], free[i] = (by[i], i), False
        closer = apart[i] < near
        near[closer], by[closer] = apart[i][closer], i
    return out


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` with the bucket they meet in: their key, but rows of a crowded key are split twice, by two draws of check bits.

    Similar texts mostly agree in a few bits, so the second key costs few
    pairs; what is still crowded consists of near copies, and is dealt by hash.
    Which keys are crowded is told from a sixteenth of the nodes.
    """
    some = F.pmod(F.xxhash64("node"), F.lit(16)) == 0

    def crowds(t: DataFrame, key: str) -> DataFrame:
        found = written(t.where(some).groupBy(key).agg((F.count("*") * 16).alias("n")).where(F.col("n") > CROWD).withColumnRenamed(key, "_key"), "crowds")
        return F.broadcast(found) if found.count() <= 100_000 else found

    key = crowds(rows, "at")
    marked = rows.join(key, F.col("at") == F.col("_key"), "left").drop("_key")
    bits = lambda turn: F.expr(f"shiftrightunsigned(c0, pmod(hash(at, {turn}), 40)) & (shiftleft(1L, cast(ceil(log2(n / {CROWD // 4})) AS int)) - 1)")
    split = marked.where("n IS NOT NULL").withColumn("bucket", F.explode(F.array(*[F.xxhash64("at", F.lit(turn), bits(turn)) for turn in (1, 2)]))).drop("n")
    again = split.join(crowds(split, "bucket"), F.col("bucket") == F.col("_key"), "left").drop("_key")
    chunk = F.pmod(F.xxhash64("node", "bucket"), F.coalesce(F.ceil(F.col("n") / CROWD), F.lit(1)))
    plain = marked.where("n IS NULL").select(F.col("at").alias("bucket"), F.lit(0).cast("long").alias("chunk"), "probe", "node", "c0", "c1")
    return plain.unionByName(again.select("bucket", chunk.cast("long").alias("chunk"), "probe", "node", "c0", "c1"))


def bucket_pairs(rows: DataFrame) -> DataFrame:
    """(a, b) of rows (at, probe, node, c0, c1) that share ``at`` and differ in at most ``APART`` check bits; one of a pair is no probe.

    A bucket of up to ``SMALL`` members gives all such pairs. A larger one (a
    group of near copies) gives those that join it most closely: each member's
    ``NEAREST``, and a tree of least distance; ``rest_pairs`` has the others.
    """

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x, at in whole_groups(batches, ["bucket", "chunk"]):
            node, probe, c0, c1 = (x[c].to_numpy() for c in ("node", "probe", "c0", "c1"))
            sizes = np.diff(at)
            left = np.repeat(np.where(sizes <= SMALL, sizes, 0), sizes) - (np.arange(len(x)) - np.repeat(at[:-1], sizes))
            first, second = [], []
            for lag in range(1, min(SMALL, int(sizes.max()))):  # row i with row i + lag, where both are in one bucket
                i = np.flatnonzero(left > lag)
                i = i[~(probe[i] & probe[i + lag])]
                i = i[np.bitwise_count((c0[i] ^ c0[i + lag]).view(np.uint64)).astype(int) + np.bitwise_count((c1[i] ^ c1[i + lag]).view(np.uint64)) <= APART]
                first.append(node[i])
                second.append(node[i + lag])
            for k in np.flatnonzero(sizes > SMALL):
                here = slice(at[k], at[k + 1])
                checks = np.stack((c0[here], c1[here]), axis=1)
                _, one = np.unique(node[here], return_index=True)
                on = 2.0 * np.unpackbits(checks[one].view(np.uint8), axis=1).astype(np.float32) - 1
                apart = (on.shape[1] - on @ on.T) / 2
                tree = _spanning(apart)
                np.fill_diagonal(apart, 1 << 20)
                near = np.argpartition(apart, min(NEAREST, len(one) - 1), axis=1)[:, :NEAREST]
                edges = np.concatenate((tree, np.stack((np.repeat(np.arange(len(one)), near.shape[1]), near.ravel()), axis=1)))
                edges = edges[apart[edges[:, 0], edges[:, 1]] <= APART]
                first.append(node[here][one][edges[:, 0]])
                second.append(node[here][one][edges[:, 1]])
            a, b = np.concatenate([*first, node[:0]]), np.concatenate([*second, node[:0]])
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})[a != b].drop_duplicates()

    met = dealt(rows).repartition("bucket", "chunk").sortWithinPartitions("bucket", "chunk").mapInPandas(compare, "a long, b long")
    return met.distinct()


def may_link(x: pd.DataFrame, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows ``i`` and ``j`` differ in at most ``APART`` check bits, are of different components and not both probes."""
    c0, c1, component, probe = (x[c].to_numpy() for c in ("c0", "c1", "component", "probe"))
    near = np.bitwise_count((c0[i] ^ c0[j]).view(np.uint64)) + np.bitwise_count((c1[i] ^ c1[j]).view(np.uint64)) <= APART
    return near & (component[i] != component[j]) & ~(probe[i] & probe[j])


def similar_sets(sets: tuple[list[np.ndarray], list[np.ndarray]], ids: tuple[np.ndarray, np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all left and right sets of a Jaccard similarity of ``similarity`` or more; sets of one id may be left out.

    Overlaps are products of 0/1 matrices over the members that two sets share.
    Before, sets go of which less than that share is in any other one: the
    overlap of similar sets is at least that share of each.
    """
    size = [np.array([len(s) for s in side], np.int64) for side in sets]
    row = [np.repeat(np.arange(len(n)), n) for n in size]
    _, number = np.unique(np.concatenate([*sets[0], *sets[1], np.zeros(0, np.uint64)]), return_inverse=True)
    word, n, kept = [number[: len(row[0])], number[len(row[0]) :]], int(number.max(initial=-1)) + 1, -1
    while kept != len(row[0]) + len(row[1]):
        kept = len(row[0]) + len(row[1])
        times, last = [np.bincount(w, minlength=n) for w in word], [np.zeros(n, np.int64), np.zeros(n, np.int64)]
        for s in (0, 1):
            last[s][word[s]] = ids[s][row[s]]
        shared = (times[0] > 0) & (times[1] > 0) & ((times[0] + times[1] > 2) | (last[0] != last[1]))
        for s in (0, 1):
            on = shared[word[s]]
            on &= (np.bincount(row[s][on], minlength=len(size[s])) >= similarity * size[s] - 1e-6)[row[s]]
            row[s], word[s] = row[s][on], word[s][on]
    rows, words = [np.unique(r) for r in row], np.unique(np.concatenate(word))
    at = [np.searchsorted(u, r) for u, r in zip(rows, row, strict=True)]
    both = np.zeros((len(rows[0]), len(rows[1])), np.float32)
    for k in range(0, len(words), 2_048):
        block, ones = words[k : k + 2_048], []
        for s in (0, 1):
            on = (word[s] >= block[0]) & (word[s] <= block[-1])
            ones.append(np.zeros((len(rows[s]), len(block)), np.float32))
            ones[s][at[s][on], np.searchsorted(block, word[s][on])] = 1
        both += ones[0] @ ones[1].T
    i, j = np.nonzero(both >= similarity * (size[0][rows[0], None] + size[1][rows[1]] - both.astype(float)))
    return rows[0][i], rows[1][j]


def rest_pairs(rows: DataFrame, comp: DataFrame, sets: Callable[[DataFrame], DataFrame] | None = None, similarity: float = 0.8) -> DataFrame:
    """(a, b) as in ``bucket_pairs``, all those of keys of more than ``SMALL`` rows whose ends ``comp`` (node, component) has in different components.

    With them no pair that shares a key is left out: pairs inside a component
    would link nothing new. At a key, a component of more than ``CROWD`` rows
    is cut into pieces of its own, which are not compared with each other, and
    the other rows into pieces that are; every two pieces are one group.

    With ``sets`` (from nodes to their shingles) pairs are decided where they
    meet, so that only links come out, one for two components of a group.
    """
    few = lambda t: F.broadcast(t) if t.count() <= 100_000 else t
    crowded = written(rows.groupBy("at").agg(F.count("*").alias("n")).where(F.col("n") > SMALL).select("at"), "crowded")
    held = rows.join(few(crowded), "at").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    held = written(held.select("at", "probe", "node", "c0", "c1", "component"), "held")
    sizes = held.groupBy("at", "component").agg(F.count("*").alias("n"))
    split = sizes.groupBy("at").agg(F.count("*").alias("components")).where("components > 1").select("at")
    sizes = written(sizes.join(split, "at").withColumn("own", F.when(F.col("n") > CROWD, F.col("component")).otherwise(-1)), "sizes")
    kinds = sizes.groupBy("at", "own").agg(F.ceil(F.sum("n") / CROWD).alias("pieces"))
    pieces = written(kinds.select("at", "own", "pieces", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece")), "pieces")
    one, two = pieces.select("at", "own", "piece"), pieces.select("at", F.col("own").alias("own_b"), F.col("piece").alias("piece_b"))
    first, second = F.struct("own", "piece"), F.struct(F.col("own_b").alias("own"), F.col("piece_b").alias("piece"))
    met = one.join(two, "at").where((first <= second) & ((F.col("own") != F.col("own_b")) | (F.col("own") == -1)))
    side = lambda s, n: F.struct(s["own"].alias("own"), s["piece"].alias("piece"), F.lit(n).alias("side"))
    sides = F.when(first == second, F.array(side(first, 2))).otherwise(F.array(side(first, 0), side(second, 1)))
    places = met.select("at", F.xxhash64("at", "own", "piece", "own_b", "piece_b").alias("pair"), F.explode(sides).alias("s")).select("at", "pair", "s.*")
    members = held.join(sizes.select("at", "component", "own"), ["at", "component"]).join(kinds, ["at", "own"])
    dealt = members.withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces"))).join(places, ["at", "own", "piece"])

    def blocks(x: pd.DataFrame, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        side = x["side"].to_numpy()
        for begin, end in zip(at[:-1], at[1:], strict=True):
            left, right = (begin + np.flatnonzero(side[begin:end] != other) for other in (1, 0))
            for k in range(0, len(left), 256):
                yield left[k : k + 256], right, may_link(x, left[k : k + 256, None], right)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x, at in whole_groups(batches, ["pair"]):
            node = x["node"].to_numpy()
            found = [(left[i], right[j]) for left, right, near in blocks(x, at) for i, j in [np.nonzero(near)]]
            a, b = (np.concatenate([node[:0], *[node[f[s]] for f in found]]) for s in (0, 1))
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x, at in whole_groups(batches, ["pair"]):
            hit = np.zeros((2, len(x)), bool)
            for left, right, near in blocks(x, at):
                hit[0, left] |= near.any(axis=1)
                hit[1, right] |= near.any(axis=0)
            yield pd.concat([x[hit[s]].assign(side=s) for s in (0, 1)])

    ordered = dealt.select("pair", "side", "node", "probe", "c0", "c1", "component").repartition("pair").sortWithinPartitions("pair")
    if sets is None:
        return ordered.mapInPandas(compare, "a long, b long").distinct()
    near = written(ordered.mapInPandas(asked, "pair long, side int, node long, probe boolean, c0 long, c1 long, component long"), "near")
    shingles = sets(near.select("node").distinct())
    # a side of many shingles is dealt once more: each of its parts meets each part of the other side
    heavy = near.join(shingles.select("node", "size"), "node").groupBy("pair", "side").agg(F.ceil(F.sum("size") / HEAVY).alias("n"))
    parts = heavy.groupBy("pair").agg(*[F.greatest(F.max(F.when(F.col("side") == s, F.col("n"))), F.lit(1)).alias(f"n{s}") for s in (0, 1)])
    own, others = (F.when(F.col("side") == 0, F.col(a)).otherwise(F.col(b)) for a, b in (("n0", "n1"), ("n1", "n0")))
    placed = near.join(parts, "pair").withColumn("own", F.pmod(F.xxhash64("node"), own)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), others - 1)))
    part = [F.when(F.col("side") == s, F.col("own")).otherwise(F.col("other")).alias(f"part{s}") for s in (0, 1)]
    placed = placed.select(*near.columns, *part).join(shingles.select("node", "hashes"), "node")
    group = ["pair", "part0", "part1"]

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x, at in whole_groups(batches, group):
            node, side, component = (x[c].to_numpy() for c in ("node", "side", "component"))
            hashes = [np.frombuffer(h, np.uint64) for h in x["hashes"]]
            for begin, end in zip(at[:-1], at[1:], strict=True):
                places = tuple(begin + np.flatnonzero(side[begin:end] == s) for s in (0, 1))
                i, j = similar_sets(tuple([hashes[k] for k in p] for p in places), tuple(node[p] for p in places), similarity)
                i, j = places[0][i], places[1][j]
                on = may_link(x, i, j)
                ends = [f(v[i[on]], v[j[on]]) for v in (node, component) for f in (np.minimum, np.maximum)]
                yield pd.DataFrame(dict(zip(("a", "b", "low", "high"), ends, strict=True))).drop_duplicates(["low", "high"])[["a", "b"]]

    with text_batches(rows.sparkSession):
        return written(placed.repartition(*group).sortWithinPartitions(*group).mapInPandas(decide, "a long, b long").distinct(), "rest")


def similar(docs: DataFrame, words: int = 5, similarity: float = 0.8, recall: float = RECALL) -> DataFrame:
    """(doc_id, text_key, node, component) of every row of ``docs``: node stands for the text's words, component for its group of similar texts."""
    n = docs.count()
    width, parts = wanted(n, similarity, recall)
    lanes = ceil(1.15 * width * parts / 64)

    @F.pandas_udf("node long, fp binary, c0 long, c1 long")
    def prints(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            hashes = shingle_hashes(text, words)
            fp = long_fingerprint(hashes, lanes + 2)
            node = xxhash.xxh64_intdigest(hashes.tobytes(), 7) >> 1 if len(hashes) else 0
            out.append((node, fp[:-16], int.from_bytes(fp[-16:-8], "little", signed=True), int.from_bytes(fp[-8:], "little", signed=True)))
        return pd.DataFrame(out, columns=["node", "fp", "c0", "c1"])

    marked = docs.select("doc_id", F.xxhash64("text").alias("text_key"), prints("text").alias("p"))
    with text_batches(docs.sparkSession):
        marked = written(marked.select("doc_id", "text_key", "p.*"), "fingerprints")
    nodes = written(marked.groupBy("node").agg(F.min("text_key").alias("text_key"), *[F.first(c).alias(c) for c in ("fp", "c0", "c1")]), "nodes")
    chosen = recall_parts(sampled(nodes), float(n), similarity, recall)
    masks = [_masks(len(g), t) for g, t in chosen]

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if not len(x):
                continue
            bits = np.unpackbits(np.frombuffer(b"".join(x["fp"]), np.uint8).reshape(len(x), -1), axis=1, bitorder="little")
            for k, ((g, _), probes) in enumerate(zip(chosen, masks, strict=True)):
                key = bits[:, g].astype(np.int64) @ (1 << np.arange(len(g), dtype=np.int64))
                for m in probes:
                    yield pd.DataFrame({"at": (k << 48) | (key ^ m), "probe": m > 0, "node": x["node"], "c0": x["c0"], "c1": x["c1"]})

    rows = written(nodes.select("node", "fp", "c0", "c1").mapInPandas(keys, "at long, probe boolean, node long, c0 long, c1 long"), "keys")
    pairs = written(bucket_pairs(rows), "pairs")

    @F.pandas_udf("boolean")
    def alike(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        @lru_cache(maxsize=256)
        def of(text: str | None) -> np.ndarray:
            return shingle_hashes(text, words)

        for first, second in batches:
            both = [(of(a), of(b)) for a, b in zip(first, second, strict=True)]
            shared = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in both]
            yield pd.Series([s >= similarity * (len(x) + len(y) - s) for s, (x, y) in zip(shared, both, strict=True)])

    @F.pandas_udf("binary")
    def hashes(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_hashes(t, words).tobytes() for t in texts])

    def texts_of(asked: DataFrame) -> DataFrame:
        keyed = asked.join(nodes.select("node", "text_key"), "node")
        return docs.select(F.xxhash64("text").alias("text_key"), "text").join(keyed, "text_key").groupBy("node").agg(F.first("text").alias("text"))

    def alike_of(pairs: DataFrame) -> DataFrame:
        texts = written(texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "texts")
        joined = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
        with text_batches(docs.sparkSession):
            return written(joined.where(alike("text_a", "text_b")).select("a", "b"), "links")

    def sets_of(asked: DataFrame) -> DataFrame:
        with text_batches(docs.sparkSession):
            found = written(texts_of(asked).select("node", hashes("text").alias("hashes")), "sets")
        return found.withColumn("size", F.expr("octet_length(hashes) div 8"))

    links = alike_of(pairs)
    comp = components(links)
    rest = rest_pairs(rows, comp, sets_of, similarity)
    if not rest.isEmpty():
        comp = components(links.union(rest))
    return marked.select("doc_id", "text_key", "node").join(comp, "node", "left").select("doc_id", "text_key", "node", F.coalesce("component", "node").alias("component"))


def keep_one(docs: DataFrame, **options: float) -> DataFrame:
    """``docs`` with one document of each group of similar texts: the one of the smallest id.

    Rows that repeat that id within the group count as one document; the row
    of the smallest text hash stays. A group of null ids only keeps one row.
    """
    found = similar(docs, **options)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    kept = found.groupBy("component").agg(first).select(F.col("first.doc_id").alias("_sim_id"), F.col("first.text_key").alias("_sim_kept"))
    keyed = docs.withColumn("_sim_text", F.xxhash64("text"))
    return (
        keyed.join(kept, keyed["doc_id"].eqNullSafe(kept["_sim_id"]) & (keyed["_sim_text"] == kept["_sim_kept"]), "left_semi")
        .dropDuplicates(["doc_id", "_sim_text"]).drop("_sim_text")
    )


def op3_query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
