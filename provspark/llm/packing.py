"""Packing documents along a space-filling curve.

Each document becomes token ids; a hashed vector (the mean of pseudo-random
directions of its ids) is projected to a few dimensions, quantised, and mapped
to its Hilbert key. A range sort by that key puts similar documents side by
side; each range is then cut into sequences of at most ``length`` ids. Full
sequences have no padding; what is left at a range's end is cut into pieces
whose lengths are powers of two, which need none.

Defined results: null or empty text is the end id alone; repeated rows and
repeated ids are documents of their own; null ids are kept; an empty table
gives no rows; further columns are ignored. Texts of any length stay whole
(their ids may span sequences).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import text_batches, written

LENGTH = 4096
END_ID = 2
DIMS, DIM_BITS = 4, 15
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Characters of text that are tokenized at a time, and words encoded in one call.
TOGETHER, AT_ONCE = 4_000_000, 20_000
#: Bytes of words and ids that a worker remembers; beyond, it keeps those of the latest texts.
REMEMBERED = 64 << 20
#: Bytes of ids in a range of the curve.
RANGE_BYTES = 32 << 20
#: Marks that end words; the tokenizer splits them from a letter or digit before them.
MARKS = ".,;:!?*%$&#)]"


class WordTokenizer:
    """Ids of a tokenizer that lower-cases and never joins across white space.

    Texts are cut into words, and those into a stem and the marks behind it,
    all in Arrow; each distinct piece is encoded once and remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        assert self.inner.get_vocab_size() <= 1 << 16, "ids are held in 16 bits"
        self.pieces = pa.array([], pa.string())
        self.ids = pa.array([], pa.list_(pa.uint16()))

    def _encode(self, texts: list[str]) -> pa.ListArray:
        flat: list[np.ndarray] = []
        ends = np.zeros(len(texts) + 1, np.int32)
        for i in range(0, len(texts), AT_ONCE):
            got = [e.ids for e in self.inner.encode_batch_fast(texts[i : i + AT_ONCE], add_special_tokens=False)]
            ends[i + 1 : i + 1 + len(got)] = list(map(len, got))
            flat.append(np.fromiter(chain.from_iterable(got), np.uint16))
        return pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.uint16)))

    @staticmethod
    def prepared(text: str) -> str | None:
        """The text in lower case if its words' ids add up to its own; None if it has to be encoded as a whole."""
        if "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f") or not text.isascii() and not is_normalized("NFC", text):
            return None
        low = text.lower()
        return text if not low.isascii() and ("\u03a3" in text or not is_normalized("NFC", low)) else low

    def _positions(self, pieces: pa.StringArray) -> np.ndarray:
        """Where the ids of each (distinct) piece are; new ones are learned."""
        at = pc.index_in(pieces, value_set=self.pieces)
        missing = pc.is_null(at)
        new = pieces.filter(missing)
        where = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        if len(new):
            where[missing.to_numpy(zero_copy_only=False)] = np.arange(len(self.pieces), len(self.pieces) + len(new))
            self.ids = pa.concat_arrays([self.ids, self._encode(new.to_pylist())])
            self.pieces = pa.concat_arrays([self.pieces, new])
        return where

    def _together(self, texts: list[str]) -> list[bytes]:
        low = [self.prepared(t) for t in texts]
        cut = pc.utf8_split_whitespace(pa.array([x or "" for x in low], pa.string()))
        words = cut.flatten().dictionary_encode()
        bare = pc.utf8_rtrim(words.dictionary, characters=MARKS)
        stems = pc.if_else(pc.match_substring_regex(bare, r"[\p{L}\p{N}]$"), bare, words.dictionary)
        n = len(stems)
        marked = pc.subtract(pc.binary_length(words.dictionary), pc.binary_length(stems)).to_numpy()
        some = np.flatnonzero(marked)
        marks = [w[-k:] for w, k in zip(words.dictionary.take(pa.array(some)).to_pylist(), marked[some].tolist(), strict=True)]
        pieces = pa.concat_arrays([stems, pa.array([*marks, ""], pa.string())]).dictionary_encode()
        where = self._positions(pieces.dictionary)[pieces.indices.to_numpy()]
        both = np.full((n, 2), where[-1])
        both[:, 0], both[some, 1] = where[:n], where[n:-1]
        both = both[words.indices.to_numpy()]  # a stem and its marks for each word of the texts
        ids = self.ids.take(pa.array(both.ravel()))
        flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
        if self.pieces.nbytes + self.ids.nbytes > REMEMBERED:
            used = np.unique(where)
            self.pieces, self.ids = self.pieces.take(pa.array(used)), self.ids.take(pa.array(used))
        bounds = ends[2 * (cut.offsets.to_numpy() - cut.offsets[0].as_py())]
        whole = iter(self._encode([t for t, x in zip(texts, low, strict=True) if x is None]).to_pylist())
        return [np.array(next(whole), "<u2").tobytes() if x is None else flat[i:j].tobytes() for x, i, j in zip(low, bounds[:-1], bounds[1:], strict=True)]

    def __call__(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text, 16 bits each."""
        held: list[str] = []
        size = 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= TOGETHER:
                yield from self._together(held)
                held, size = [], 0
        if held:
            yield from self._together(held)


@cache
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


@cache
def _directions(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((1 << 16, DIMS), dtype=np.float32)


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of ``cells`` (unsigned, below 2^bits), all dimensions of ``bits`` bits."""
    x = [c.astype(np.int64) for c in cells.T]
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(len(x)):
            on = (x[i] >> b) & 1 == 1
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0]) ^ swap
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | (((c ^ flip) >> b) & 1)
    return key


def encode(docs: DataFrame, tokenizer_path: str, seed: int = 7) -> DataFrame:
    """(doc_id, ids binary of 16-bit ids, curve long, size in bytes) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, to = _tokenizer(tokenizer_path), _directions(seed)
        end = np.array([END_ID], dtype="<u2").tobytes()
        for batch in batches:
            ids = [x + end for x in tokens(batch.column("text").to_pylist())]
            mean = np.array([to.take(i, axis=0).sum(axis=0) / len(i) for x in ids for i in (np.frombuffer(x, dtype="<u2"),)]).reshape(-1, DIMS)
            cells = ((np.tanh(3 * mean) + 1) / 2 * ((1 << DIM_BITS) - 1)).astype(np.int64)
            columns = [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(hilbert_key(cells, DIM_BITS), pa.int64()), pa.array(list(map(len, ids)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "curve", "size"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, curve long, size long")


def tail_lengths(n: int) -> list[int]:
    """``n`` as powers of two, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def cut(batches: Iterator[pa.RecordBatch], length: int, first: int) -> Iterator[pa.RecordBatch]:
    """Pieces of one range of documents, in order; ``first`` is the range's first sequence number."""
    out: list[tuple] = []
    open_: list[tuple] = []  # the pieces of the sequence being filled: fewer ids than length
    filled, sequence = 0, first

    def piece(doc: int | None, ids: np.ndarray, start: int, n: int, at: int) -> tuple:
        return doc, start, n, zlib.crc32(ids[start : start + n].astype("<u4").tobytes()), len(ids), sequence, at

    def emitted() -> pa.RecordBatch:
        names = [c.split()[0] for c in PIECES.split(", ")]
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)
        out.clear()
        return batch

    for batch in batches:
        for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            ids, start = np.frombuffer(raw, dtype="<u2"), 0
            while start < len(ids):
                n = min(len(ids) - start, length - filled)
                open_.append((doc, ids, start, n, filled))
                start, filled = start + n, filled + n
                if filled == length:
                    out += [piece(*x) for x in open_]
                    open_, filled, sequence = [], 0, sequence + 1
        if out:
            yield emitted()
    for size in tail_lengths(filled):
        room = size
        while room:
            doc, ids, start, n, _ = open_.pop(0)
            if n > room:
                open_.insert(0, (doc, ids, start + room, n - room, 0))
            out.append(piece(doc, ids, start, min(n, room), size - room))
            room -= min(n, room)
        sequence += 1
    if out:
        yield emitted()


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH) -> DataFrame:
    """Pieces of all documents in sequences of at most ``length`` ids."""
    with text_batches(docs.sparkSession):
        coded = written(encode(docs, tokenizer_path), "tokens")
    parts = max(1, -(-(coded.agg(F.sum("size")).first()[0] or 0) // RANGE_BYTES))
    ranged = coded.repartitionByRange(parts, "curve", "doc_id").sortWithinPartitions("curve", "doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from cut(batches, length, TaskContext.get().partitionId() << 40)

    return ranged.select("doc_id", "ids").mapInArrow(run, PIECES)


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
