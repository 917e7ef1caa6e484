"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

The lexicon is learned: words and word beginnings whose document frequency
among toxic labelled documents is significantly above their frequency among
the others. A trie holds them; each word of a text is run against the trie
with a Levenshtein automaton (one row of edit distances a trie node), so
misspelled terms are found too, whichever letter is wrong; digits and signs
inside a word are letters of it. A hit is weighed by its term's log odds and
looked at in a window of words around it: inside quotation marks or after a
reporting verb it counts as quoted, next to a second-person pronoun as
addressed. A logistic regression on these sums gives the score.

Labels are learned only from rows whose crc32(doc_id) mod 4 is not 2. The
lexicon is fitted on remainders 0 and 1, the regression on remainder 3, each on
at most ``FIT_ROWS`` labelled rows (taken by hash); every document is scored
whole.

Defined results: null or empty text is scored as a text without hits; a null
doc_id is never learned from and counts as not held out; repeated rows are
scored alike; without labels of both kinds the lexicon is empty and every score
is the rate of toxic labels (0 without labels); an empty table gives no rows;
further columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log, log1p

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest as hash64

from provspark.llm.common import written

#: Most labelled rows that either fit uses.
FIT_ROWS = 20_000
#: Longest lexicon, by significance.
MAX_TERMS = 5_000
MIN_PREFIX, MAX_PREFIX = 4, 9
THRESHOLD = 0.3
WINDOW = 6
#: Letters, with digits or signs that stand for letters inside.
WORDS = re.compile(r"[^\W\d_]+(?:[0-9@$*]{1,2}[^\W\d_]+)*")
#: Quotation marks, reporting words and second-person pronouns in four languages.
QUOTES = "\"“”„«»‹›‘"
REPORTING = {"said", "says", "called", "wrote", "quote", "quoted", "word", "sagte", "schrieb", "nannte", "wort", "dit", "écrit", "mot", "dijo", "escribió", "palabra"}
ADDRESS = {"you", "your", "youre", "du", "dich", "dein", "ihr", "tu", "toi", "vous", "te", "usted", "eres"}
REMEMBERED = 250_000


@dataclass(slots=True)
class Node:
    children: dict[str, Node] = field(default_factory=dict)
    term: str | None = None
    prefix: bool = False


def build_trie(terms: dict[str, float]) -> Node:
    """A term that ends in ``*`` stands for all words that begin with it."""
    root = Node()
    for term in terms:
        node = root
        for c in term.rstrip("*"):
            node = node.children.setdefault(c, Node())
        if node.term is None or term.endswith("*"):
            node.term, node.prefix = term, term.endswith("*")
    return root


def allowed_edits(length: int) -> int:
    return 0 if length < 5 else 1 if length < 9 else 2


class Gate:
    """Which words can be within the allowed edits of a term: with k edits, one of k + 1 pieces of the term is whole in the word."""

    def __init__(self, terms: dict[str, float]):
        self.first: dict[int, set[str]] = {}
        self.last: dict[int, set[str]] = {}
        self.middle: dict[tuple[int, int], set[str]] = {}
        for term in terms:
            if term.endswith("*") or not (edits := allowed_edits(len(term))):
                continue
            cuts = [len(term) * i // (edits + 1) for i in range(edits + 2)]
            self.first.setdefault(cuts[1], set()).add(term[: cuts[1]])
            self.last.setdefault(len(term) - cuts[-2], set()).add(term[cuts[-2] :])
            for i, j in zip(cuts[1:-2], cuts[2:-1], strict=True):
                for shift in range(-edits, edits + 1):
                    self.middle.setdefault((i + shift, j - i), set()).add(term[i:j])

    def passes(self, word: str) -> bool:
        return (
            any(word[:n] in s for n, s in self.first.items()) or any(word[-n:] in s for n, s in self.last.items())
            or any(word[i : i + n] in s for (i, n), s in self.middle.items())
        )


def match(word: str, root: Node, gate: Gate | None = None) -> tuple[str, int] | None:
    """The lexicon term nearest to ``word`` and its edit distance, or None.

    Beginnings (``x*``) match exactly, whole terms within ``allowed_edits`` of
    the term's length. Words that ``gate`` turns away are not run.
    """
    node = root
    for c in word:
        node = node.children.get(c)
        if node is None:
            break
        if node.prefix:
            return node.term, 0
    else:
        if node.term:
            return node.term, 0
    # a term may be longer than the word by as many letters as it allows edits
    most = max(k for k in range(3) if k <= allowed_edits(len(word) + k))
    if not most or gate is not None and not gate.passes(word):
        return None
    best: tuple[str, int] | None = None
    n, far = len(word), most + 1
    # row[j]: edits between the path to the node and word[:depth + j - most]; only this band can stay within most
    start = [j - most if 0 <= j - most <= n else far for j in range(2 * most + 1)]
    stack = [(root, start, 0)]
    while stack:
        node, row, depth = stack.pop()
        at = n - depth + most
        if node.term and not node.prefix and depth and 0 <= at <= 2 * most and row[at] <= min(most, allowed_edits(depth)) and (best is None or (row[at], node.term) < (best[1], best[0])):
            best = node.term, row[at]
        for c, child in node.children.items():
            new, left, alive = [], far, False
            for j in range(2 * most + 1):
                i = depth + 1 + j - most
                if i < 1 or i > n:
                    left = depth + 1 if i == 0 else far
                else:
                    cost = row[j] + (word[i - 1] != c)
                    if j < 2 * most and row[j + 1] + 1 < cost:
                        cost = row[j + 1] + 1
                    left = cost if cost <= left else left + 1
                new.append(left)
                alive = alive or left <= most
            if alive:
                stack.append((child, new, depth + 1))
    return best


class Lexicon:
    """Terms with weights; remembers the text pieces it has looked up."""

    def __init__(self, terms: dict[str, float]):
        self.terms, self.root, self.gate, self.clean = terms, build_trie(terms), Gate(terms), set()
        self.hits: dict[str, dict[str, tuple[str, int]]] = {}

    def look_up(self, pieces: set[str]) -> dict[str, tuple[str, int]]:
        """Words that match, among white-space separated pieces of a lower-cased text, with their terms."""
        for piece in pieces.difference(self.clean, self.hits):
            found = {w: m for w in WORDS.findall(piece) if (m := match(w, self.root, self.gate))}
            if found:
                self.hits[piece] = found
            else:
                self.clean.add(piece)
        found = {w: m for piece in self.hits.keys() & pieces for w, m in self.hits[piece].items()}
        for held in (self.clean, self.hits):
            if len(held) > REMEMBERED:
                held.clear()
        return found

    def features(self, text: str | None) -> list[float]:
        """log(1 + sum of weights) of plain, quoted, addressed and misspelled hits, and distinct terms."""
        low = text.lower() if text else ""
        found = self.look_up(set(low.split())) if self.terms and low else {}
        if not found:
            return [0.0] * 5
        spans = list(WORDS.finditer(low))
        words = [m.group() for m in spans]
        plain = quoted = addressed = fuzzy = 0.0
        for i, w in enumerate(words):
            if w not in found:
                continue
            term, edits = found[w]
            weight = self.terms[term] / (1 + edits)
            before, after = words[max(0, i - WINDOW) : i], words[i + 1 : i + 1 + WINDOW]
            left = low[spans[max(0, i - WINDOW)].start() : spans[i].start()]
            right = low[spans[i].end() : spans[min(len(spans) - 1, i + WINDOW)].end() + 2]
            inside = any(q in left for q in QUOTES) and any(q in right for q in QUOTES)
            if inside or REPORTING.intersection(before[-3:]):
                quoted += weight
            elif edits:
                fuzzy += weight
            else:
                plain += weight
            if not inside and ADDRESS.intersection(before + after):
                addressed += weight
        return [log1p(plain), log1p(quoted), log1p(addressed), log1p(fuzzy), log1p(len({t for t, _ in found.values()}))]


@dataclass
class Model:
    terms: dict[str, float]
    coefficients: list[float]
    intercept: float

    def score(self, lexicon: Lexicon, text: str | None) -> float:
        z = self.intercept + sum(a * b for a, b in zip(self.coefficients, lexicon.features(text), strict=True))
        return 1 / (1 + exp(-max(-30.0, min(30.0, z))))


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def document_terms(text: str | None) -> set[str]:
    """Distinct words, and their beginnings marked by ``*``."""
    words = set(WORDS.findall((text or "").lower()))
    long = [w for w in words if len(w) >= MIN_PREFIX]
    return words | {f"{w[:k]}*" for w in long for k in range(MIN_PREFIX, min(MAX_PREFIX, len(w)) + 1)}


def sketch_column(text: Column) -> Column:
    """The least hash of a text's five-word shingles: equal for copies, and for near copies most of the time."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> int:
            words = (text or "").lower().split()
            return min(hash64(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))) >> 1

        return texts.map(one).astype("int64")

    return run(text)


def learn_lexicon(labelled: DataFrame) -> dict[str, float]:
    """Significant terms of toxic texts; ``labelled`` has text and toxic, each text once."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: list[Counter] = [Counter(), Counter()]
        for x in batches:
            for text, toxic in zip(x["text"], x["toxic"], strict=True):
                seen[int(toxic)].update(document_terms(text))
                seen[int(toxic)][""] += 1
        terms = list(seen[0].keys() | seen[1].keys())
        if terms:
            yield pd.DataFrame({"term": terms, "other": [seen[0][t] for t in terms], "toxic": [seen[1][t] for t in terms]})

    counts = written(labelled.mapInPandas(count, "term string, other long, toxic long").groupBy("term").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")), "terms")
    n = counts.where("term = ''").first()
    if n is None or not n["other"] or not n["toxic"]:
        return {}
    base, tested = n["toxic"] / (n["toxic"] + n["other"]), counts.count()
    p = F.col("toxic") / (F.col("toxic") + F.col("other"))
    # Chernoff: n KL(p || base) is over log(tests / level) only by chance of level over all terms together
    kl = p * F.log(p / base) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - base))).otherwise(0)
    strength = (F.col("toxic") + F.col("other")) * kl
    best = (
        counts.where((F.col("term") != "") & (F.col("toxic") >= 4) & (p >= 0.75)).where(strength > log(tested / 0.1))
        .orderBy(strength.desc(), "term").limit(MAX_TERMS).collect()
    )
    odds = {r["term"]: log((r["toxic"] + 0.5) / (n["toxic"] + 1)) - log((r["other"] + 0.5) / (n["other"] + 1)) for r in best}
    # a beginning speaks for all words and longer beginnings under it, unless it is a single word's own
    exact = {r["term"]: r["toxic"] for r in best if not r["term"].endswith("*")}
    support = {r["term"]: r["toxic"] for r in best}
    stems = [t[:-1] for t in sorted((t for t in odds if t.endswith("*")), key=len)]
    kept: dict[str, float] = {}
    for stem in stems:
        whole = max((exact.get(w, 0) for w in exact if w.startswith(stem)), default=0)
        if whole < 0.8 * support[f"{stem}*"] and not any(f"{stem[:k]}*" in kept for k in range(MIN_PREFIX, len(stem))):
            kept[f"{stem}*"] = odds[f"{stem}*"]
    for word in exact:  # words under a stem too: they are what a misspelling is near to
        kept[word] = odds[word]
    return kept


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Lexicon and regression from labelled documents outside the held-out quarter."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    by = remainder(F.col("doc_id"))
    marked = labels.where(F.col("toxic").isin(0, 1)).select("doc_id", "toxic", by.alias("part"), F.xxhash64("doc_id").alias("draw")).where("part <> 2")
    chosen = marked.where("part < 2").orderBy("draw", "doc_id").limit(FIT_ROWS).union(marked.where("part = 3").orderBy("draw", "doc_id").limit(FIT_ROWS))
    # copies and near copies count once, or their words would pass for signs of toxicity
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("sketch", sketch_column(F.col("text")))
    rows = written(texts.groupBy("sketch").agg(F.min_by("text", F.struct("part", "doc_id")).alias("text"), F.min_by("toxic", F.struct("part", "doc_id")).alias("toxic"), F.min("part").alias("part")), "labelled")
    terms = learn_lexicon(rows.where("part < 2").select("text", "toxic"))
    rate = rows.agg(F.avg("toxic")).first()[0] or 0.0
    fallback = Model({}, [0.0] * 5, log(rate / (1 - rate)) if 0 < rate < 1 else 30.0 * (2 * rate - 1))
    if not terms:
        return fallback

    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(terms)
        for texts in batches:
            yield pd.Series([lexicon.features(t) for t in texts])

    points = written(rows.where("part = 3").select(features("text").alias("x"), F.col("toxic").cast("double").alias("label")), "points")
    points = points.select(array_to_vector("x").alias("features"), "label")
    if points.select("label").distinct().count() < 2:
        return fallback
    fitted = LogisticRegression(regParam=0.001, maxIter=30).fit(points)
    return Model(terms, [float(c) for c in fitted.coefficients], float(fitted.intercept))


def scored(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(model.terms)
        for texts in batches:
            yield pd.Series([model.score(lexicon, t) for t in texts], dtype="float64")

    return docs.withColumn(column, run(F.col("text")))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score stays under ``threshold``, columns unchanged."""
    return scored(docs, fit(docs, labels), "_tox_score").where(F.col("_tox_score") < threshold).drop("_tox_score")


def op7_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs.select("doc_id", "text"), fit(docs, labels)).select(
        "doc_id", F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
