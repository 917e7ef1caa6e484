"""Repair of conversations: the cheapest edits that give a lawful sequence of roles.

A lawful conversation is empty, or has one system row at most, in front, and
then user and assistant rows in turn. The search for the cheapest edits (ties:
the least audit, a letter an edit) is depth-first branch and bound: an explicit
stack, lower bounds of what the rest of the rows must cost, the incumbent
(cost, audit), and a dominance table with the best prefix of each node (rows
used, role state) that ends worse ones. The bound is the exact cost under a
laxer law, (s|ua)*, so it is tight unless system rows stand in the wrong place.

Rows are searched in slices of ``SLICE``: for every state in which a slice may
begin and end, its cheapest edits; a conversation is then the cheapest chain of
its slices. So the rows of one conversation are searched by many tasks, however
long it is; one task only folds its slices, and hashes its repaired rows as
they stream by, which a SHA-256 of them all cannot do otherwise.

Defined results: null role or text (and an empty role) is one space; null turns
come first; rows of one turn follow by role, then text; a null conv_id is a
conversation of its own; repeated rows are duplicates; roles other than system,
user and assistant are known by their first letter, as all are; an empty table
gives no rows; further columns are ignored; texts of any length are whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import WORD, sql_crc32, whole_groups, written
from provspark.operators.ranks import numbered

SLICE = 64
RETYPE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: States by the last role: none yet, system, user, assistant; where a conversation may end; the role that a state lets follow.
NONE, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (NONE, ASSISTANT)
NEXT = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
OTHER = "-"  # any initial that no state lets follow
#: A row as the search sees it: its initial (s, u, a or OTHER), whether it has to go, what staying costs.
Row = tuple[str, bool, int]


def kept(state: int, initial: str) -> int | None:
    """The state after a row that stays as it is, or None."""
    if initial == "s":
        return SYSTEM if state == NONE else None
    return NEXT[state] if initial == "ua"[NEXT[state] - USER] else None


def bounds(rows: tuple[Row, ...], ends: tuple[int, ...]) -> list[list[int]]:
    """Least cost of the rows from each place on, by state, where system rows may stand before any user row."""
    far = 1 << 60
    open_ends = any(e != USER for e in ends)
    table = [[0] * 4 for _ in range(len(rows) + 1)]
    for i in range(len(rows), -1, -1):
        if i == len(rows):
            wait, asked = (0 if open_ends else far), (0 if USER in ends else far)
        else:
            initial, gone, stay = rows[i]
            after_wait, after_asked = table[i + 1][NONE], table[i + 1][USER]
            wait, asked = DELETE + after_wait, DELETE + after_asked
            if not gone:
                wait = min(wait, stay + (after_wait if initial == "s" else after_asked + (initial != "u") * RETYPE), stay + RETYPE + after_asked)
                asked = min(asked, stay + (initial != "a") * RETYPE + after_wait)
        wait, asked = min(wait, INSERT + asked), min(asked, INSERT + wait)
        table[i] = [wait, wait, asked, wait]
    return table


@cache
def cheapest(rows: tuple[Row, ...], begin: int, ends: tuple[int, ...]) -> tuple[int, str, int] | None:
    """(cost, audit, end state) of the cheapest edits from ``begin`` to one of ``ends``, the least audit of them; None if there are none."""
    bound = bounds(rows, ends)
    best: tuple[int, str, int] | None = None
    seen: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, "", 0, begin)]  # cost, audit, rows used, state
    while stack:
        cost, audit, i, state = stack.pop()
        if best and (cost + bound[i][state], audit) > best[:2] and not (cost + bound[i][state] == best[0] and best[1].startswith(audit)):
            continue
        if (i, state) in seen and seen[i, state] <= (cost, audit):
            continue
        seen[i, state] = cost, audit
        if i == len(rows) and state in ends and (best is None or (cost, audit) < best[:2]):
            best = cost, audit, state
        moves = [(cost + INSERT, audit + "I", i, NEXT[state])]
        if i < len(rows):
            initial, gone, stay = rows[i]
            moves.append((cost + DELETE, audit + "D", i + 1, state))
            if not gone:
                to = kept(state, initial)
                if to is not None:
                    moves.append((cost + stay, audit + "K", i + 1, to))
                moves.append((cost + stay + RETYPE, audit + "R", i + 1, NEXT[state]))
        # the most promising move is looked at first
        stack += sorted(moves, key=lambda m: (m[0] + bound[m[2]][m[3]], m[1]), reverse=True)
    return best


def chained(slices: Iterator[list[tuple[int, int, int, str]]]) -> Iterator[tuple[int, int, str, int]]:
    """(slice, begin state, audit, cost) of a conversation's cheapest chain; each slice offers (begin, end, cost, audit).

    Live chains end in different states, at most four. Their texts are held
    from where they part only; what was chosen is traced back at the end.
    """
    live = {NONE: (0, "")}
    steps: list[dict[int, tuple[int, int, str]]] = []  # end state -> begin state, cost, audit, a slice each
    for offers in slices:
        best: dict[int, tuple[int, str]] = {}
        step: dict[int, tuple[int, int, str]] = {}
        for begin, end, cost, audit in offers:
            if begin in live:
                whole = live[begin][0] + cost, live[begin][1] + audit
                if end not in best or whole < best[end]:
                    best[end], step[end] = whole, (begin, cost, audit)
        texts = [a for _, a in best.values()]
        same = next((k for k, cs in enumerate(zip(*texts, strict=False)) if len(set(cs)) > 1), min(map(len, texts), default=0))
        live = {e: (c, a[same:]) for e, (c, a) in best.items()}
        steps.append(step)
    end = min((s for s in FINAL if s in live), key=lambda s: live[s])
    chosen = []
    for number in range(len(steps) - 1, -1, -1):
        begin, cost, audit = steps[number][end]
        chosen.append((number, begin, audit, cost))
        end = begin
    return reversed(chosen)


def repaired(rows: Iterator[tuple[str, str]], begin: int, audit: str) -> Iterator[str]:
    """The `role:text` of a slice's rows (role, text) after its edits."""
    state = begin
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K" and role[:1] == "s":
            state = SYSTEM
        else:
            state = NEXT[state]
            role = role if edit == "K" else ROLES[state]
        yield f"{role}:{text}"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the planned damage: rows lost, emptied, cut off, repeated, or with a wrong role."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    times = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    role = F.when(kind == 4, F.lit("user")).otherwise(blank("role"))
    return conversations.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_copy")).drop("_copy")


def _key(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def diagnosed(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with key, position, slice, initial and fault (blank, duplicate, truncated or null)."""
    role = F.when(F.coalesce("role", F.lit("")) == "", F.lit(" ")).otherwise(F.col("role"))
    own = rows.select(_key(F.col("conv_id")).alias("key"), "turn", role.alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row")]
    placed = numbered(written(own, "turns"), "key", order).drop("row")
    digest = F.sha2("text", 256)
    again = placed.groupBy("key", "role", digest.alias("_digest")).agg(F.min("position").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    full = F.rtrim(F.translate("text", "\t\n\v\f\r", "     "))
    fault = (
        F.when(full == "", "blank").when(F.col("position") > F.col("_first"), "duplicate").when(~F.substring(full, -1, 1).isin(".", "!", "?"), "truncated")
    )
    told = placed.withColumn("_digest", digest).join(again, ["key", "role", "_digest"], "left")
    first = F.substring("role", 1, 1)
    return told.withColumns({"fault": fault, "slice": F.expr(f"position div {SLICE}"), "initial": first}).drop("_digest", "_first")


OFFERS = "key string, slice long, begin int, end int, cost long, audit string, first string, last string, illegal long"


def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each slice (rows sorted by key, slice, position) offers: its cheapest edits from and to every state."""
    for rows, at in whole_groups(batches, ["key", "slice"]):
        keys, slices, initials, faults = (rows[c].to_numpy() for c in ("key", "slice", "initial", "fault"))
        out = []
        for i, j in zip(at[:-1], at[1:], strict=True):
            seen = tuple((c if c in ("s", "u", "a") else OTHER, f in ("blank", "duplicate"), CUT_OFF if f == "truncated" else 0) for c, f in zip(initials[i:j], faults[i:j], strict=True))
            broken = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials[i : j - 1], initials[i + 1 : j], strict=True))
            only = slices[i] == 0 and j - i < SLICE  # the whole conversation
            for begin in (NONE,) if slices[i] == 0 else range(4):
                for ends in (FINAL,) if only else ((e,) for e in range(4)):
                    found = cheapest(seen, begin, ends)
                    if found:
                        out.append((keys[i], slices[i], begin, found[2], found[0], found[1], initials[i], initials[j - 1], broken))
        cheapest.cache_clear()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OFFERS.split(", ")])


PLANS = "key string, slice long, begin int, audit string, cost long, illegal long"


def planned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The chosen edits of each slice, from the offers sorted by key, slice, begin, end."""
    held: list[list[tuple[int, int, int, str]]] = []
    key, previous, last, illegal = None, None, "", 0
    done: list[tuple] = []

    def close() -> None:
        for number, begin, audit, cost in chained(iter(held)):
            done.append((key, number, begin, audit, cost, illegal if number == 0 else 0))

    for x in batches:
        for k, number, begin, end, cost, audit, first, final, broken in x.itertuples(index=False, name=None):
            if k != key:
                if key is not None:
                    close()
                key, previous, illegal, held = k, None, 0, []
            if number != previous:
                illegal += broken + (previous is not None and last + first not in ("su", "ua", "au"))
                previous, last = number, final
                held.append([])
            held[-1].append((begin, end, cost, audit))
        if done:
            yield pd.DataFrame(done, columns=[c.split()[0] for c in PLANS.split(", ")])
            done.clear()
    if key is not None:
        close()
        yield pd.DataFrame(done, columns=[c.split()[0] for c in PLANS.split(", ")])


def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, cost, audit, illegal, repaired_sha256) from plans and rows together, sorted by key, slice, plans first, position."""
    key, digest, empty = None, hashlib.sha256(), True
    audits: list[str] = []
    cost = illegal = 0
    plan: tuple[int, str] = (NONE, "")
    texts: list[tuple[str, str]] = []
    done: list[tuple] = []

    def slice_ends() -> None:
        nonlocal empty
        for line in repaired(iter(texts), *plan):
            digest.update(("" if empty else "\n").encode() + line.encode())
            empty = False
        texts.clear()

    for x in batches:
        for k, begin, audit, c, broken, role, text in x[["key", "begin", "audit", "cost", "illegal", "role", "text"]].itertuples(index=False, name=None):
            if audit is None:
                texts.append((role, text))
                continue
            if key is not None:
                slice_ends()
            if k != key:
                if key is not None:
                    done.append((key, cost, "".join(audits), illegal, digest.hexdigest()))
                key, digest, empty, cost, illegal, audits = k, hashlib.sha256(), True, 0, 0, []
            plan = int(begin), audit
            audits.append(audit)
            cost, illegal = cost + int(c), illegal + int(broken)
        if done:
            yield pd.DataFrame(done, columns=["key", "cost", "audit", "illegal", "repaired_sha256"])
            done.clear()
    if key is not None:
        slice_ends()
        done.append((key, cost, "".join(audits), illegal, digest.hexdigest()))
        yield pd.DataFrame(done, columns=["key", "cost", "audit", "illegal", "repaired_sha256"])


def plans(rows: DataFrame) -> DataFrame:
    """(key, slice, begin, audit, cost, illegal) of every slice of diagnosed ``rows``."""
    seen = rows.select("key", "slice", "position", "initial", "fault")
    offers = seen.repartition("key", "slice").sortWithinPartitions("key", "slice", "position").drop("position").mapInPandas(searched, OFFERS)
    return offers.repartition("key").sortWithinPartitions("key", "slice", "begin", "end").mapInPandas(planned, PLANS)


def repair(rows: DataFrame) -> DataFrame:
    """(key, cost, audit, illegal, repaired_sha256) of every conversation of diagnosed ``rows``."""
    none = lambda kind: F.lit(None).cast(kind)
    chosen = plans(rows).select("key", "slice", F.lit(-1).cast("long").alias("position"), "begin", "audit", "cost", "illegal", none("string").alias("role"), none("string").alias("text"))
    texts = rows.select("key", "slice", "position", none("int").alias("begin"), none("string").alias("audit"), none("long").alias("cost"), none("long").alias("illegal"), "role", "text")
    both = chosen.union(texts).repartition("key").sortWithinPartitions("key", "slice", "position")
    return both.mapInPandas(told, "key string, cost long, audit string, illegal long, repaired_sha256 string")


def op13_query(conversations: DataFrame) -> DataFrame:
    """Every conversation after damage: its faults, the cheapest repair, and the repaired rows' hash."""
    rows = written(diagnosed(damaged(conversations)), "diagnosed")
    count = lambda f: F.count_if(F.col("fault") == f)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
    faults = rows.groupBy("key").agg(gaps.alias("gaps"), *[count(f).alias(f) for f in ("blank", "duplicate", "truncated")])
    ids = conversations.select("conv_id").distinct().withColumn("key", _key(F.col("conv_id")))
    found = ids.join(faults, "key", "left").join(repair(rows), "key", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return found.select(
        "conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


_CONV, _TURN = "coalesce(conv_id::VARCHAR, ' ')", "coalesce(turn::VARCHAR, ' ')"
#: One step a row: every prefix is inserted after (at most three times), then deletes, keeps or retypes the row; the least by state goes on.
OP13_SQL = rf"""
WITH RECURSIVE drawn AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {sql_crc32(f"{_CONV} || ':' || {_TURN}")} % 20 AS kind FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' WHEN role = '' THEN ' ' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM drawn WHERE kind <> 0
), placed AS (
  SELECT *, coalesce('=' || conv_id, '') AS key, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged
), looked AS (
  SELECT *, row_number() OVER (PARTITION BY key, role, text ORDER BY i) AS nth, right(regexp_replace(text, '[ 	-
]+$', ''), 1) AS ending,
    left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY key ORDER BY i) AS before
  FROM placed
), told AS (
  SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM looked
), faults AS (
  SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM told GROUP BY key
), moves(edit, initial, old, new, price) AS (
  VALUES ('K', 's', 0, 1, 0), ('K', 'u', 0, 2, 0), ('K', 'u', 1, 2, 0), ('K', 'u', 3, 2, 0), ('K', 'a', 2, 3, 0), ('R', NULL, 0, 2, 1), ('R', NULL, 1, 2, 1), ('R', NULL, 3, 2, 1),
    ('R', NULL, 2, 3, 1), ('D', NULL, 0, 0, 2), ('D', NULL, 1, 1, 2), ('D', NULL, 2, 2, 2), ('D', NULL, 3, 3, 2)
), inserts(old, new, price, edits) AS (
  VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'), (1, 2, 5, 'I'), (3, 2, 5, 'I'), (2, 3, 5, 'I'), (0, 3, 10, 'II'), (1, 3, 10, 'II')
), steps AS (
  SELECT key, 0 AS i, 0 AS state, {{'cost': 0::BIGINT, 'audit': ''}} AS best FROM faults
  UNION ALL
  SELECT key, i, state, min(best) FROM (
    SELECT s.key, t.i, m.new AS state, {{'cost': s.best.cost + n.price + m.price + CASE WHEN m.edit <> 'D' AND coalesce(t.fault, '') = 'truncated' THEN 5 ELSE 0 END,
      'audit': s.best.audit || n.edits || m.edit}} AS best
    FROM steps s JOIN told t ON t.key = s.key AND t.i = s.i + 1 JOIN inserts n ON n.old = s.state
    JOIN moves m ON m.old = n.new AND (m.initial IS NULL OR m.initial = t.initial) AND (m.edit = 'D' OR coalesce(t.fault, '') NOT IN ('blank', 'duplicate'))
  ) GROUP BY key, i, state
), ended AS (
  SELECT s.key, min({{'cost': s.best.cost + n.price, 'audit': s.best.audit || n.edits}}) AS best
  FROM steps s JOIN faults f ON f.key = s.key AND f.n = s.i JOIN inserts n ON n.old = s.state AND n.new IN (0, 3) GROUP BY s.key
), edits AS (
  SELECT key, unnest(string_split(best.audit, '')) AS edit, unnest(range(1, len(best.audit) + 1)) AS place FROM ended WHERE best.audit <> ''
), walked AS (
  SELECT key, place, edit, count(*) FILTER (edit <> 'I') OVER w AS i, count(*) FILTER (edit <> 'D') OVER w AS o FROM edits WINDOW w AS (PARTITION BY key ORDER BY place)
), joined AS (
  SELECT w.*, t.role, t.text, max(CASE WHEN w.o = 1 AND w.edit = 'K' AND t.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY w.key) AS shift
  FROM walked w LEFT JOIN told t ON t.key = w.key AND t.i = w.i
), texts AS (
  SELECT key, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (o - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY place)) AS sha
  FROM joined WHERE edit <> 'D' GROUP BY key
), ids AS (
  SELECT DISTINCT conv_id, coalesce('=' || conv_id, '') AS key FROM conversations
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM ids LEFT JOIN faults USING (key) LEFT JOIN ended USING (key) LEFT JOIN texts USING (key)
"""
