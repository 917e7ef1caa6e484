"""A Merkle manifest of a dataset: one root over all documents, and each document's proof.

A leaf is the hash of a document's columns. The leaves of a group (lang) in
the order of doc_id are hashed in runs of ``ARITY`` neighbours, level by level,
to the group's subroot; the subroots in the order of their groups give the root
in the same way. No level is a grouping: rows stay in the order of their
leaves, a node lives on the row of its first leaf, lag and lead columns at the
level's fixed offsets, masked by the node's slot and its run's length, give a
node's siblings, and first-child rows hash them into the parent.

Up to ``LEVELS`` levels share one window over blocks of 4,096 neighbouring
nodes and thus one shuffle; the first rows of the blocks are the nodes of the
next step. So no window holds more than a block, however large a group is, and
the proofs come down by one join a step whose other side is that much smaller.

Defined results: nulls in any column are part of the leaf; null ids come first
in their group and are never tampered with; a null group is a group of its own,
the first; rows of one id are ordered by leaf, and equal rows are leaves of
their own; empty and very long texts are hashed whole; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import sql_crc32, written
from provspark.operators.ranks import numbered

ARITY, LEVELS = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<slot:int,siblings:string>>"


def digest(*texts: Column) -> Column:
    """Hexadecimal SHA-256 of the texts, one after another."""
    return F.sha2(F.concat(*texts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value so that no two rows of columns read alike: `-` for null, else its bytes' number and the bytes."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**changed: Column) -> Column:
    """The hash of a document, with some of its columns changed."""
    return digest(*[field(changed.get(c, F.col(c))) for c in FIELDS])


def levels(nodes: DataFrame, depth: int) -> DataFrame:
    """``nodes`` (key, position, hash, group_rows, ...) with block, path and top.

    ``path`` has slot and siblings of each of ``depth`` levels at which the
    group has more than one node; ``top`` is the block's node above them, on
    the block's first row.
    """
    block = ARITY**depth
    own = "OVER (PARTITION BY key, block ORDER BY position"
    t = nodes.withColumns({"block": F.expr(f"div(position, {block})"), "_hash": F.col("hash")})
    for level in range(depth):
        span = ARITY**level  # leaves of the step under a node whose run is full
        index, nodes_here = f"div(position, {span})", f"div(group_rows + {span - 1}, {span})"
        others = range(1, ARITY)
        t = t.selectExpr("*", *[f"{side}(_hash, {i * span}) {own}) AS _{side}{i}" for side in ("lag", "lead") for i in others])
        left = ", ".join(f"IF({index} % {ARITY} >= {i}, _lag{i}, '')" for i in reversed(others))
        right = ", ".join(f"IF({index} % {ARITY} + {i} < {ARITY} AND {index} + {i} < {nodes_here}, _lead{i}, '')" for i in others)
        t = t.withColumns({
            "_witness": F.expr(f"IF(position % {span} = 0 AND {nodes_here} > 1, named_struct('slot', int({index} % {ARITY}), 'siblings', concat({left}, {right})), NULL)"),
            "_hash": F.expr(f"IF(position % {span * ARITY} = 0, IF({nodes_here} > 1, sha2(binary(concat(_hash, {right})), 256), _hash), NULL)"),
        })
        kept = [c for c in t.columns if not c.startswith(("_lag", "_lead", "_witness"))]
        # from the row a node lives on to the rows under it
        t = t.selectExpr(*kept, f"last(_witness) IGNORE NULLS {own} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _path{level}")
    path = F.expr(f"array_compact(array({', '.join(f'_path{i}' for i in range(depth))}))")
    return t.withColumn("path", path).withColumnRenamed("_hash", "top").drop(*[f"_path{i}" for i in range(depth)])


def grown(nodes: DataFrame) -> list[tuple[DataFrame, int]]:
    """The steps of a forest with one tree a key: nodes and the number of levels above them, up to one node a key."""
    most = nodes.agg(F.max("group_rows")).first()[0] or 0
    steps = []
    while most > 1:
        depth = next((d for d in range(1, LEVELS) if most <= ARITY**d), LEVELS)
        steps.append((nodes, depth))
        size = ARITY**depth
        first = levels(nodes, depth).where(F.col("position") % size == 0)
        up = first.select("key", F.col("block").alias("position"), F.col("top").alias("hash"), F.expr(f"(group_rows + {size - 1}) div {size}").alias("group_rows"))
        nodes, most = written(up, "manifest"), -(-most // size)
    return [*steps, (nodes, 0)]


def proven(steps: list[tuple[DataFrame, int]], above: DataFrame) -> DataFrame:
    """The first step's nodes with path (all levels) and what ``above`` (key, path, ...) says of their key's root."""
    carried = [c for c in above.columns if c not in ("key", "path")]
    upper = steps[-1][0].join(above, "key")
    for nodes, depth in reversed(steps[:-1]):
        rest = upper.select("key", F.col("position").alias("block"), F.col("path").alias("_rest"), *carried)
        upper = levels(nodes, depth).drop("top").join(rest, ["key", "block"]).withColumn("path", F.concat("path", "_rest")).drop("_rest", "block")
    return upper


def manifest(docs: DataFrame, tampered: Column | None = None, **changed: Column) -> DataFrame:
    """(doc_id, leaf, worn, subroot, root, path) of every row; ``worn`` is the leaf of tampered rows with ``changed`` columns, else null."""
    worn = F.when(tampered, leaf(**changed)) if tampered is not None else F.lit(None).cast("string")
    key = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("lang")))  # never null, in the order asked for
    leaves = docs.select(key.alias("key"), F.col("doc_id"), leaf().alias("hash"), worn.alias("worn"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("row")]
    groups = grown(numbered(written(leaves, "leaves"), "key", order, sized=True).drop("row"))
    subroots = groups[-1][0].select(F.lit("").alias("key"), F.col("key").alias("name"), "hash")
    whole = grown(numbered(subroots, "key", [F.col("name")], sized=True))
    no_path = F.array().cast(PATH)
    top = proven(whole, whole[-1][0].select("key", no_path.alias("path"), F.col("hash").alias("root")))
    above = written(top.select(F.col("name").alias("key"), F.col("hash").alias("subroot"), "root", "path"), "subroots")
    return proven(groups, above).select("doc_id", F.col("hash").alias("leaf"), "worn", "subroot", "root", "path")


def folded(start: Column, path: Column) -> Column:
    """The root that ``start`` gives with the siblings of ``path``."""
    hexes = 64
    put = lambda s, h: digest(F.substring(s["siblings"], F.lit(1), s["slot"] * hexes), h, F.substring(s["siblings"], s["slot"] * hexes + 1, F.lit(ARITY * hexes)))
    return F.aggregate(path, start, lambda h, s: put(s, h))


def op12_query(docs: DataFrame) -> DataFrame:
    """Every document's leaf, its proof, and what the root says of it after some texts were put into lower case."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    made = manifest(docs.select(*FIELDS), tampered, text=F.translate("text", ascii_uppercase, ascii_lowercase))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: s["siblings"]), "").cast("binary"), 256)
    return (
        made.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.coalesce("worn", "leaf"), F.col("path")).alias("folded_root"))
        .withColumn("verified", F.col("folded_root") == F.col("root"))
    )


def _sql_field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(_sql_field(text if c == "text" else c) for c in FIELDS) + ")"


_SQL_LOWER = reduce(lambda t, c: f"replace({t}, '{c}', '{c.lower()}')", ascii_uppercase, "text")

OP12_SQL = f"""
WITH RECURSIVE lowered AS (
  SELECT *, {_SQL_LOWER} AS low FROM documents
), leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS key, {_sql_leaf('text')} AS leaf, {_sql_leaf('low')} AS worn FROM lowered
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS position FROM leaves
), nodes AS (
  SELECT 0 AS level, key, position, leaf AS hash, count(*) OVER (PARTITION BY key) AS n FROM placed
  UNION ALL
  SELECT level + 1, key, position // 8, sha256(string_agg(hash, '' ORDER BY position)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY level, key, position // 8, n
), subroots AS (
  SELECT key, hash, row_number() OVER (ORDER BY key) - 1 AS place FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, place AS position, hash, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, position // 8, sha256(string_agg(hash, '' ORDER BY position)), (n + 7) // 8 FROM tops WHERE n > 1 GROUP BY level, position // 8, n
), runs AS (
  SELECT level, key, position // 8 AS run, list(hash ORDER BY position) AS kids FROM nodes WHERE n > 1 GROUP BY ALL
), top_runs AS (
  SELECT level, position // 8 AS run, list(hash ORDER BY position) AS kids FROM tops WHERE n > 1 GROUP BY ALL
), steps AS (
  SELECT p.key, p.position, r.level, r.kids, (p.position // (8 ** r.level)::BIGINT) % 8 + 1 AS slot
  FROM placed p JOIN runs r ON r.key = p.key AND r.run = p.position // (8 ** (r.level + 1))::BIGINT
  UNION ALL
  SELECT p.key, p.position, 100 + r.level, r.kids, (s.place // (8 ** r.level)::BIGINT) % 8 + 1
  FROM placed p JOIN subroots s USING (key) JOIN top_runs r ON r.run = s.place // (8 ** (r.level + 1))::BIGINT
), numbered AS (
  SELECT key, position, row_number() OVER (PARTITION BY key, position ORDER BY level) AS step,
    array_to_string(kids[1:slot - 1], '') AS before, array_to_string(kids[slot + 1:], '') AS after
  FROM steps
), proofs AS (
  SELECT key, position, sha256(string_agg(before || after, '' ORDER BY step)) AS proof_sha256 FROM numbered GROUP BY ALL
), folds AS (
  SELECT key, position, 0 AS step, CASE WHEN {sql_crc32('doc_id::VARCHAR')} % 3 = 0 THEN worn ELSE leaf END AS hash FROM placed
  UNION ALL
  SELECT f.key, f.position, f.step + 1, sha256(n.before || f.hash || n.after) FROM folds f JOIN numbered n ON n.key = f.key AND n.position = f.position AND n.step = f.step + 1
), ends AS (
  SELECT key, position, arg_max(hash, step) AS folded_root FROM folds GROUP BY ALL
)
SELECT p.doc_id, p.leaf, s.hash AS subroot, t.hash AS root, coalesce(f.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = t.hash AS verified
FROM placed p JOIN subroots s ON s.key = p.key JOIN tops t ON t.n = 1
JOIN ends e ON e.key = p.key AND e.position = p.position LEFT JOIN proofs f ON f.key = p.key AND f.position = p.position
"""
