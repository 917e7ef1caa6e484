"""Many fixed texts looked for in one pass over each text, by an automaton over all of them at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to so many patterns are plain tests inside the JVM; each more would be one more pass over every text.
FEW = 16
#: Characters of patterns in one automaton; longer lists take several, one after the other.
BLOCK = 4_000_000


@lru_cache(maxsize=4)
def automaton(patterns: tuple[tuple[str, tuple[int, ...]], ...]) -> Any:
    """The automaton of (pattern, its groups); a Python worker builds it once and keeps it for its later tasks."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for pattern, groups in patterns:
        found.add_word(pattern, groups)
    found.make_automaton()
    return found


def _blocks(patterns: dict[str, list[int]]) -> list[tuple[tuple[str, tuple[int, ...]], ...]]:
    out, size = [[]], 0
    for p in sorted(patterns):
        if out[-1] and size + len(p) > BLOCK:
            out, size = [*out, []], 0
        out[-1].append((p, tuple(patterns[p])))
        size += len(p)
    return [tuple(b) for b in out if b]


def groups_found(text: Column, groups: list[list[str]], few: int = FEW, fold: bool = True) -> Column:
    """array<int>, ascending: which of ``groups`` (from 0) have a pattern that occurs in the lower-cased ``text``.

    Patterns are compared in lower case, or with ``fold`` off all as they are. Null texts hold nothing; an empty
    pattern occurs in every other text; a group without patterns is never
    found. Up to ``few`` patterns are tested by ``contains``, more by
    Aho-Corasick, in one pass whatever their number.
    """
    by_pattern: dict[str, list[int]] = {}
    for i, patterns in enumerate(groups):
        for p in {p.lower() if fold else p for p in patterns}:
            by_pattern.setdefault(p, []).append(i)
    low, none = F.lower(text) if fold else text, F.array().cast("array<int>")
    always = by_pattern.pop("", [])
    if sum(map(len, by_pattern.values())) <= few:
        test = lambda i: reduce(lambda a, b: a | b, [low.contains(p) for p, of in by_pattern.items() if i in of], F.lit(i in always))
        tests = [F.when(test(i), F.lit(i)) for i, patterns in enumerate(groups) if patterns]
        return F.when(text.isNotNull(), F.array_compact(F.array(*tests)) if tests else none).otherwise(none)
    blocks = _blocks(by_pattern)

    @F.pandas_udf("array<int>")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machines = [automaton(b) for b in blocks]
        for texts in batches:
            out = []
            for t in texts:
                seen = set() if t is None else set(always)
                for m in machines if t else ():
                    for _, of in m.iter(t):
                        seen.update(of)
                out.append(sorted(seen))
            yield pd.Series(out, dtype=object)

    return search(low)
