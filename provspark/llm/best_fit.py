"""Best-fit packing of documents under several capacities at once.

A document becomes token ids and an end id; only one that is longer than a
sequence is cut, into pieces as long as a sequence may be. A piece demands
three things of its sequence: its tokens, one document, and the attention cost
of its length squared. Pieces go in decreasing order, each into the open
sequence that has room in every respect and fits it best: the least weighted
norm of what would remain, or the greatest weighted dot product of demand and
room; where none has room a new sequence opens. Weights are the mean demands,
so what is scarce counts.

Pieces are dealt into blocks of about ``BLOCK`` by a hash of their number and
each block is packed apart. Sequences that a block leaves short are undone and
their pieces dealt again into fewer blocks, round by round while that pays, so
that the waste does not grow with the number of blocks. Whole sequences' pieces
never move. Ids stay where they were written; blocks see lengths only.

Defined results: null or empty text is the end id alone; repeated rows and
repeated ids are documents of their own; null ids are kept; an empty table
gives no rows; further columns are ignored. Texts of any length stay whole.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import whole_groups, written
from provspark.llm.packing import _tokenizer

LENGTH, END_ID = 4096, 1
#: Pieces that are packed together, and the sequences they should fill at least (so more pieces, where they are short).
BLOCK, SEQUENCES = 1 << 12, 64
#: A sequence is short, and its pieces may be dealt again, if less than this share of every capacity is used.
SHORT = 0.98
PIECES = "number long, doc_id long, piece int, start long, length long, ids binary, ids_crc32 long"


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most: tokens, documents, and the sum of its pieces' squared lengths."""

    tokens: int = LENGTH
    documents: int = LENGTH
    cost: int = LENGTH * LENGTH

    @property
    def longest(self) -> int:
        """The longest piece that has room in an empty sequence."""
        return min(self.tokens, math.isqrt(self.cost))

    def shares(self, lengths: np.ndarray) -> np.ndarray:
        """Demand of pieces as shares of the capacities, a row a piece."""
        n = lengths.astype(np.float64)
        return np.stack([n / self.tokens, np.full(len(n), 1 / self.documents), n * n / self.cost], axis=1)


def pieces(docs: DataFrame, tokenizer_path: str, longest: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """(number, doc_id, piece, start, length, ids as 16-bit numbers, ids_crc32 of them as 32-bit ones) of all documents; ``number`` is the piece's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = _tokenizer(tokenizer_path), np.array([end_id], "<u2").tobytes()
        number = TaskContext.get().partitionId() << 40
        names = [c.split()[0] for c in PIECES.split(", ")]
        for batch in batches:
            ids = [x + end for x in tokens(batch.column("text").to_pylist())]
            size = np.array([len(x) // 2 for x in ids], np.int64)
            count = -(-size // longest)
            doc = np.repeat(np.arange(len(ids)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * longest
            length = np.minimum(longest, size[doc] - start)
            cut = [ids[d][2 * s : 2 * (s + n)] for d, s, n in zip(doc, start, length, strict=True)]
            sums = [zlib.crc32(np.frombuffer(x, "<u2").astype("<u4")) for x in cut]
            numbers = pa.array(number + np.arange(len(doc))), batch.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length)
            yield pa.RecordBatch.from_arrays([*numbers, pa.array(cut, pa.binary()), pa.array(sums, pa.int64())], names)
            number += len(doc)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, capacity: Capacity, weights: np.ndarray, by: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces that come in decreasing order; sequences count from 0."""
    demand = capacity.shares(lengths)
    room = np.empty((len(lengths), 3))
    ends = np.zeros(len(lengths), np.int64)
    into, at = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    opened = 0
    slack = 1e-12  # shares are fractions; a capacity is never overrun by a whole unit
    for i, need in enumerate(demand):
        left = room[:opened] - need
        fits = np.flatnonzero((left >= -slack).all(axis=1))
        if len(fits):
            score = (left[fits] ** 2) @ weights if by == "norm" else -(room[:opened][fits] @ (weights * need))
            chosen = fits[np.argmin(score)]
        else:
            chosen, opened = opened, opened + 1
            room[chosen] = 1.0
        room[chosen] -= need
        into[i], at[i] = chosen, ends[chosen]
        ends[chosen] += lengths[i]
    return into, at


def _round(free: DataFrame, number: int, blocks: int, capacity: Capacity, weights: np.ndarray, by: str) -> DataFrame:
    """``free`` (number, length) packed within blocks: (number, length, sequence_id, offset, short)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, at in whole_groups(batches, ["block"]):
            for i, j in zip(at[:-1], at[1:], strict=True):
                x = rows.iloc[i:j]
                lengths = x["length"].to_numpy()
                into, offset = best_fit(lengths, capacity, weights, by)
                used = np.zeros((into.max() + 1, 3))
                np.add.at(used, into, capacity.shares(lengths))
                first = number << 56 | int(x["block"].iloc[0]) << 24
                yield pd.DataFrame({"number": x["number"], "length": lengths, "sequence_id": first + into, "offset": offset, "short": (used < SHORT).all(axis=1)[into]})

    block = F.pmod(F.xxhash64("number", F.lit(number)), F.lit(blocks))
    dealt = free.withColumn("block", block).repartition(blocks, "block").sortWithinPartitions("block", F.desc("length"), "number")
    return written(dealt.select("block", "number", "length").mapInPandas(run, "number long, length long, sequence_id long, offset long, short boolean"), "packed")


def assign(demands: DataFrame, capacity: Capacity = Capacity(), weights: list[float] | None = None, by: str = "norm") -> DataFrame:
    """(number, sequence_id, offset) of every row of ``demands`` (number, length); no length exceeds ``capacity.longest``."""
    whole = F.col("length") >= capacity.tokens
    alone = demands.where(whole).select("number", (-1 - F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    free = demands.where(~whole).select("number", "length")
    known = free.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), F.avg(F.col("length") * F.col("length")).alias("squares")).first()
    n = known["n"]
    mean = np.array([(known["mean"] or 0) / capacity.tokens, 1 / capacity.documents, (known["squares"] or 0) / capacity.cost])
    scale = np.array(weights if weights is not None else mean)
    done = [alone]
    for number in range(1, 64):
        if not n:
            break
        blocks = max(1, min(-(-n // BLOCK), int(n * mean.max()) // SEQUENCES))
        packed = _round(free, number, blocks, capacity, scale, by)
        short = packed.where("short").count()
        if blocks == 1 or not short or short > n // 2:
            done.append(packed.select("number", "sequence_id", "offset"))
            break
        done.append(packed.where("NOT short").select("number", "sequence_id", "offset"))
        free, n = packed.where("short").select("number", "length"), short
    return reduce(DataFrame.union, done)


def pack(cut: DataFrame, capacity: Capacity = Capacity(), **options: object) -> DataFrame:
    """``cut`` (number, length, and whatever a piece carries) with sequence_id and offset; ``cut`` is written and read again."""
    return cut.join(assign(cut.select("number", "length"), capacity, **options), "number")


def op11_query(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Every piece with its sequence, its place there and its ids' checksum."""
    capacity = Capacity()
    cut = written(pieces(docs, tokenizer_path, capacity.longest), "pieces")
    return pack(cut.drop("ids"), capacity).drop("number")
