"""Exact top-k inner products by best-first search of a paged M-tree.

The tree's upper level is Spark's: pivots are sampled from all rows, each row is
routed to its nearest pivot's page, and a page has a covering radius and the
greatest length of its vectors. The levels below are built where a page (or a
chunk of it, where it is large) is searched: nodes and pages of ``PAGE`` rows
hold a pivot, a covering radius and the distance to the parent's pivot.

For a query q and anything x at distance at most r from a pivot p, the triangle
inequality bounds the product by q.p + |q| r, and, with d = |q - p| - r, by
(|q|^2 + |x|^2 - d^2) / 2. A query first searches its own page, which gives it
a k-th score; only pages whose bound reaches that score are searched next.
Inside, nodes are visited by falling bound until the bound is under the k-th
score, and the stored distances decide which entries' products are computed at
all. ``search_cost`` tells how many were. In 64 dimensions without clusters the
bounds exclude little, as they must; vectors of tight groups are passed over.

Defined results: vectors that are null or hold null or non-finite components
take no part; vectors of different lengths are not compared; rows that share
the query's id are not its candidates; repeated query rows count once (one of
the vectors of that id); null ids are neither queries nor candidates; fewer
than k candidates give fewer ranks; components beyond a long's range count as
its ends, products are exact and scores beyond a long's range are reported as
its ends (ranked by their true value within a page); an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provspark.llm.common import written

SCALE = 1024
#: Rows a page of the upper level has on average, the most such pages, and rows of a page that are searched together.
PAGE_ROWS, MOST_PAGES, CHUNK = 4_096, 256, 16_384
PAGE, FANOUT = 512, 16
LONG = 2**63 - 1


@dataclass
class Tree:
    """Nodes by number; 0 is the root. Leaves own the rows ``first:last``."""

    pivots: np.ndarray
    radius: np.ndarray
    to_parent: np.ndarray
    longest: np.ndarray
    children: list[np.ndarray | None]
    first: np.ndarray
    last: np.ndarray
    vectors: np.ndarray
    doubles: np.ndarray
    ids: np.ndarray
    to_pivot: np.ndarray
    squares: np.ndarray
    peak: float


def _spread(x: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` rows of ``x``, each farthest from those before it."""
    picked, far = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(picked) < n and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[picked[-1]]) ** 2).sum(axis=1))
    return np.array(picked)


def build(vectors: np.ndarray, ids: np.ndarray) -> Tree:
    """Bulk load: rows go to the nearest of well-spread pivots, level by level, until they fit a page."""
    x = vectors.astype(np.float64)
    squares = (x**2).sum(axis=1)
    pivots, radius, to_parent, longest, children, spans, order, to_pivot = [], [], [], [], [], [], [], []

    def node(rows: np.ndarray, parent: np.ndarray | None) -> int:
        pivot = x[rows].mean(axis=0)
        distance = np.sqrt(((x[rows] - pivot) ** 2).sum(axis=1))
        k = len(pivots)
        pivots.append(pivot)
        radius.append(distance.max())
        to_parent.append(0.0 if parent is None else float(np.sqrt(((pivot - parent) ** 2).sum())))
        longest.append(squares[rows].max())
        children.append(None)
        spans.append((0, 0))
        if len(rows) <= PAGE or distance.max() == 0:
            spans[k] = len(order), len(order) + len(rows)
            order.extend(rows.tolist())
            to_pivot.extend(distance.tolist())
            return k
        seeds = x[rows[_spread(x[rows], FANOUT)]]
        nearest = ((seeds**2).sum(axis=1) - 2 * x[rows] @ seeds.T).argmin(axis=1)
        parts = [p for s in range(len(seeds)) if len(p := rows[nearest == s])]
        if len(parts) == 1:  # rounding put all rows together
            parts = np.array_split(rows, FANOUT)
        children[k] = np.array([node(p, pivot) for p in parts])
        return k

    node(np.arange(len(x)), None)
    first, last = np.array(spans).T
    return Tree(
        np.array(pivots), np.array(radius), np.array(to_parent), np.array(longest), children, first, last,
        vectors[order], x[order], ids[order], np.array(to_pivot), squares[order], float(np.abs(x).max(initial=0)),
    )


def bound(product: np.ndarray, norm: float, pivot_square: np.ndarray, reach: np.ndarray, square: np.ndarray) -> np.ndarray:
    """Most that q.x can be for vectors of squared length ``square`` at most ``reach`` from a pivot with ``product`` = q.pivot."""
    apart = np.sqrt(np.maximum(norm * norm + pivot_square - 2 * product, 0)) - reach
    return np.minimum(product + norm * reach, (norm * norm + square - np.maximum(apart, 0) ** 2) / 2)


def products(tree: Tree, near: np.ndarray | slice, query: np.ndarray) -> np.ndarray:
    """Exact inner products with the entries ``near``: in doubles, longs or Python's integers, as their size asks."""
    most = float(np.abs(query.astype(np.float64)).max(initial=0)) * tree.peak * len(query)
    if most < 2.0**53:
        return (tree.doubles[near] @ query.astype(np.float64)).astype(np.int64)
    return tree.vectors[near] @ query if most < 2.0**62 else tree.vectors[near].astype(object) @ query.astype(object)


def search(tree: Tree, query: np.ndarray, own: int, k: int, worst: float = -np.inf) -> tuple[list[tuple[int, int]], int]:
    """The k best (score, id) that reach ``worst`` by falling score, then rising id, without rows of id ``own``; and how many products it took."""
    q = query.astype(np.float64)
    norm = float(np.sqrt(q @ q))
    best: list[tuple[int, int]] = []  # (score, -id), a heap whose first is the k-th
    slack = 1e-9 * (1 + (norm + tree.peak) * tree.peak * len(q) + norm * norm)
    product = float(tree.pivots[0] @ q)
    heap = [(-np.inf, 0, product)]
    computed = 0
    while heap:
        most, at, product = heapq.heappop(heap)
        if -most + slack < worst:
            break
        kids = tree.children[at]
        square = float(tree.pivots[at] @ tree.pivots[at])
        if kids is None:
            span = slice(tree.first[at], tree.last[at])
            fine = (bound(product, norm, square, tree.to_pivot[span], tree.squares[span]) + slack >= worst) & (tree.ids[span] != own)
            passed = int(np.count_nonzero(fine))
            if not passed:
                continue
            computed += passed
            near = span if passed == len(fine) else np.flatnonzero(fine) + tree.first[at]  # a span needs no copy
            scores = products(tree, near, query)
            good = np.flatnonzero(scores >= worst)
            for s, i in zip(scores[good].tolist(), tree.ids[near][good].tolist(), strict=True):
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
            if len(best) == k:
                worst = max(worst, best[0][0])
            continue
        through = bound(product, norm, square, tree.to_parent[kids] + tree.radius[kids], tree.longest[kids])  # no new product needed
        kids, through = kids[through + slack >= worst], through[through + slack >= worst]
        own_product = tree.pivots[kids] @ q
        direct = bound(own_product, norm, (tree.pivots[kids] ** 2).sum(axis=1), tree.radius[kids], tree.longest[kids])
        computed += len(kids)
        for b, kid, p in zip(np.minimum(through, direct).tolist(), kids.tolist(), own_product.tolist(), strict=True):
            if b + slack >= worst:
                heapq.heappush(heap, (-b, kid, p))
    return [(s, -i) for s, i in sorted(best, reverse=True)], computed


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, dims, v) of the rows that take part; v is floor(1024 x) as longs."""
    x = F.col("embedding")
    fine = ~F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.size(x).alias("dims"), scaled.alias("v"))


def routed(rows: DataFrame) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """(vec_id, dims, page, away, square, v as bytes) of all rows, and the pivots by length; at most ``MOST_PAGES`` rows are sampled for them."""
    pages = max(1, min(MOST_PAGES, -(-rows.count() // PAGE_ROWS)))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pages).select("dims", "v").toPandas()
    pivots = {int(d): np.array(part["v"].tolist(), dtype=np.float64).reshape(len(part), -1) for d, part in sample.groupby("dims")}

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for dims, part in x.groupby("dims"):
                whole = np.array(part["v"].tolist(), dtype=np.int64).reshape(len(part), -1)
                v, p = whole.astype(np.float64), pivots.get(int(dims), np.zeros((1, int(dims))))
                page = ((p**2).sum(axis=1) - 2 * v @ p.T).argmin(axis=1)
                away = np.sqrt(((v - p[page]) ** 2).sum(axis=1))
                yield pd.DataFrame({"vec_id": part["vec_id"], "dims": part["dims"], "page": page, "away": away, "square": (v**2).sum(axis=1), "v": [r.tobytes() for r in whole]})

    return written(rows.mapInPandas(route, "vec_id long, dims int, page int, away double, square double, v binary"), "routed"), pivots


ANSWER = "query_id long, vec_id long, score long, computed long"


def answers(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """What each (dims, page, chunk) of ``rows`` has for the queries ``asked`` of it: their best, and one row without vec_id with the products computed."""

    def answer(page: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(page) and len(questions):
            tree = build(np.frombuffer(b"".join(page["v"]), np.int64).reshape(len(page), -1), page["vec_id"].to_numpy(np.int64))
            for q, v, worst in zip(questions["query_id"], questions["v"], questions["worst"], strict=True):
                found, computed = search(tree, np.frombuffer(v, np.int64), q, k, -np.inf if pd.isna(worst) else int(worst))
                out += [(q, i, max(-LONG - 1, min(LONG, s)), 0) for s, i in found]
                out.append((q, None, None, computed))
        columns = zip(*out, strict=True) if out else ((),) * 4
        return pd.DataFrame({name: pd.array(c, dtype="Int64") for name, c in zip(("query_id", "vec_id", "score", "computed"), columns, strict=True)})

    keys = ["dims", "page", "chunk"]
    return rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(answer, ANSWER)


def searched(vectors: DataFrame, is_query: str, k: int = 10) -> DataFrame:
    """The answers of every page that had to be searched, for the rows of ``vectors`` where the SQL condition ``is_query`` holds."""
    rows, pivots = routed(quantised(vectors))
    # one row a page of the upper level
    table = rows.groupBy("dims", "page").agg(F.count("*").alias("n"), F.max("away").alias("reach"), F.max("square").alias("square"))
    of = {d: part for d, part in table.toPandas().groupby("dims")}
    chunks = F.broadcast(table.select("dims", "page", F.ceil(F.col("n") / CHUNK).alias("chunks")))  # at most MOST_PAGES rows a length
    placed = rows.join(chunks, ["dims", "page"]).select("vec_id", "dims", "page", F.pmod(F.xxhash64("vec_id", "v"), "chunks").alias("chunk"), "v")
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min(F.struct("dims", "page", "v")).alias("q")).select(F.col("vec_id").alias("query_id"), "q.*")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")
    to = lambda asked: asked.join(chunks, ["dims", "page"]).select("query_id", "dims", "page", every, "v", "worst")
    home = written(answers(placed, to(queries.withColumn("worst", F.lit(None).cast("long"))), k), "home")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    kth = home.where("vec_id IS NOT NULL").withColumn("rank", rank).where(F.col("rank") == k).select("query_id", F.col("score").alias("worst"))

    @F.pandas_udf("array<int>")
    def reached(dims: pd.Series, page: pd.Series, v: pd.Series, worst: pd.Series) -> pd.Series:
        """Pages, but the own, whose bound reaches the k-th score so far."""
        out = []
        for d, own, raw, w in zip(dims, page, v, worst, strict=True):
            there, q = of[d], np.frombuffer(raw, np.int64).astype(np.float64)
            p = pivots.get(int(d), np.zeros((1, int(d))))[there["page"].to_numpy()]
            norm, square = float(np.sqrt(q @ q)), there["square"].to_numpy()
            most = bound(p @ q, norm, (p**2).sum(axis=1), there["reach"].to_numpy(), square)
            slack = 1e-9 * (1 + norm * norm + square.max() + (p**2).sum(axis=1).max())
            out.append([int(x) for x in there["page"][(most + slack >= (-np.inf if pd.isna(w) else w)) & (there["page"] != own)]])
        return pd.Series(out)

    further = queries.join(kth, "query_id", "left")
    further = further.withColumn("page", F.explode(reached("dims", "page", "v", "worst")))
    return home.union(answers(placed, to(further), k))


def top_k(vectors: DataFrame, is_query: str, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``vectors`` where the SQL condition ``is_query`` holds."""
    ranked = searched(vectors, is_query, k).where("vec_id IS NOT NULL")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_cost(vectors: DataFrame, is_query: str, k: int = 10) -> DataFrame:
    """(query_id, computed, rows): products with entries and pivots that each query's search computed, and the rows it was asked of."""
    n = quantised(vectors).count()
    return searched(vectors, is_query, k).groupBy("query_id").agg(F.sum("computed").alias("computed")).withColumn("rows", F.lit(n))


def op6_query(vectors: DataFrame) -> DataFrame:
    return top_k(vectors, "vec_id % 100 = 0")


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""
