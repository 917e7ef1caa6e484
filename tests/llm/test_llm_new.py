"""Best-fit packing, the Merkle manifest and conversation repair against plain versions, on odd rows too."""

import hashlib
import random
import re
import zlib
from itertools import pairwise

import duckdb
import numpy as np
import pytest

from provspark.llm import best_fit, manifest, packing, repair

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, position string, hash string, length string"


def prose(i, n):
    r = random.Random(i)
    return " ".join("".join(r.choice("abcdefgh Éß.") for _ in range(r.randrange(2, 9))) for _ in range(n))


def odd_docs():
    rows = [(i, prose(i, 5 + i * 3), ["en", "de", None, "é"][i % 4], "ab"[i % 2], i) for i in range(150)]
    rows += [(3, prose(3, 9), "en", None, None)] * 3 + [(None, "A b", "en", "a", 1), (None, None, None, None, None), (None, None, None, None, None)]
    rows += [(200, None, "en", "a", None), (201, "", "", "", 0), (202, "Long Text " * 30_000, "fr", "a", 300_000)]
    return [(*r, "own", "own", None, "own") for r in rows]


# --- best fit


def encoder():
    return packing._tokenizer(packing.word_bpe_path()).inner


def test_pieces_give_every_document_back(spark):
    docs = odd_docs()
    got = best_fit.op11_query(spark.createDataFrame(docs, DOCS).repartition(3), packing.word_bpe_path()).toPandas()
    inner = encoder()
    expected = []
    for doc_id, text, *_ in docs:
        ids = [*inner.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            expected.append((-1 if doc_id is None else doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    mine = got.fillna({"doc_id": -1})[["doc_id", "piece", "start", "length", "ids_crc32"]].astype("int64")
    assert sorted(map(tuple, mine.to_numpy().tolist())) == sorted(expected)
    got = got.sort_values(["sequence_id", "offset"])
    assert (got["offset"] == got.groupby("sequence_id")["length"].cumsum() - got["length"]).all()
    assert got.groupby("sequence_id")["length"].sum().max() <= 4096 and got["sequence_id"].nunique() <= -(-got["length"].sum() // 4096) + 1


def lengths_of(kind, n=900):
    r = random.Random(kind)
    draw = {"prose": lambda: min(4095, int(r.lognormvariate(5.5, 1))), "halves": lambda: r.choice([2047, 2048, 2049]), "large": lambda: r.randrange(1400, 4096), "one": lambda: 1}[kind]
    return [max(1, draw()) for _ in range(n)] + [4096, 4096]


@pytest.mark.parametrize("by", ["norm", "dot"])
@pytest.mark.parametrize("kind", ["prose", "halves", "large", "one"])
@pytest.mark.parametrize("capacity", [best_fit.Capacity(), best_fit.Capacity(4096, 7, 4096**2), best_fit.Capacity(4096, 64, 4096**2 // 2)])
def test_no_capacity_is_overrun_and_little_is_wasted(spark, capacity, kind, by, monkeypatch):
    monkeypatch.setattr(best_fit, "BLOCK", 200)  # several blocks and rounds
    monkeypatch.setattr(best_fit, "SEQUENCES", 4)
    lengths = [min(n, capacity.longest) for n in lengths_of(kind)]
    cut = spark.createDataFrame(list(enumerate(lengths)), "number long, length long")
    got = best_fit.pack(cut, capacity, by=by).toPandas()
    assert sorted(got["number"]) == list(range(len(lengths))) and got["length"].sum() == sum(lengths)
    sums = got.assign(cost=got["length"] ** 2).groupby("sequence_id").agg(n=("length", "size"), tokens=("length", "sum"), cost=("cost", "sum"))
    assert sums["tokens"].max() <= capacity.tokens and sums["n"].max() <= capacity.documents and sums["cost"].max() <= capacity.cost
    whole = np.sort(np.array(lengths))[::-1]
    together = best_fit.best_fit(whole, capacity, np.ones(3))[0].max() + 1
    assert len(sums) <= together * 1.02 + 2


def slow_best_fit(lengths, capacity, weights, by):
    bins, out = [], []
    for n in lengths:
        need = np.array([n / capacity.tokens, 1 / capacity.documents, n * n / capacity.cost])
        fits = [k for k, b in enumerate(bins) if sum(b) + n <= capacity.tokens and len(b) < capacity.documents and sum(x * x for x in b) + n * n <= capacity.cost]
        room = lambda b: 1 - np.array([sum(b) / capacity.tokens, len(b) / capacity.documents, sum(x * x for x in b) / capacity.cost])
        score = lambda k: round(float(weights @ (room(bins[k]) - need) ** 2 if by == "norm" else -(weights @ (need * room(bins[k])))), 9)
        at = min(fits, key=lambda k: (score(k), k)) if fits else len(bins)
        if at == len(bins):
            bins.append([])
        out.append((at, sum(bins[at])))
        bins[at].append(n)
    return out


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_best_fit_chooses_as_a_plain_loop_does(by):
    r = random.Random(5)
    for capacity in (best_fit.Capacity(100, 5, 6000), best_fit.Capacity(64, 64, 64 * 64)):
        lengths = sorted((r.randrange(1, capacity.longest + 1) for _ in range(120)), reverse=True)
        weights = np.array([0.6, 0.3, 0.1])
        into, at = best_fit.best_fit(np.array(lengths), capacity, weights, by)
        plain = slow_best_fit(lengths, capacity, weights, by)
        assert into.max() + 1 <= max(k for k, _ in plain) + 2  # equal scores may differ in their last digit
        if by == "norm":
            assert list(zip(into.tolist(), at.tolist(), strict=True)) == plain


# --- manifest


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def slow_manifest(docs):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: h(*map(field, (r[0], r[3], r[2], r[4], t)))

    def tree(hashes):
        levels = [hashes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    groups = {}
    for r in docs:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in names:
        groups[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[k] = tree([leaf(r, r[1]) for r in groups[k]])
    top = tree([trees[k][-1][0] for k in names])
    for place, k in enumerate(names):
        for i, r in enumerate(groups[k]):
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            found, proof = leaf(r, text), []
            for levels, at in ((trees[k], i), (top, place)):
                for hashes in levels[:-1]:
                    run = hashes[at - at % 8 : at - at % 8 + 8]
                    before, after = run[: at % 8], run[at % 8 + 1 :]
                    proof += before + after
                    found, at = h(*before, found, *after), at // 8
            root = top[-1][0]
            yield r[0], trees[k][0][i], trees[k][-1][0], root, h(*proof), found, found == root


PROOF = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def rows_of(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize("docs", [
    odd_docs(), [(i, f"T{i}", "en", "a", i) + ("",) * 4 for i in range(1 + 8 * 64)], [(i, "x", f"l{i:03}", "a", 1) + ("",) * 4 for i in range(70)], [(5, "X", None, None, None) + ("",) * 4],
], ids=["odd", "one-node-over", "many-groups", "one-row"])
def test_manifest_as_plain_hashing(spark, docs):
    assert rows_of(manifest.op12_query(spark.createDataFrame(docs, DOCS).repartition(4)), PROOF) == sorted(slow_manifest(docs), key=repr)


def test_manifest_over_several_steps_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(manifest, "LEVELS", 2)  # blocks of 64
    monkeypatch.setattr(manifest, "numbered", lambda *a, f=manifest.numbered, **k: f(*a, **k, range_rows=300))
    docs = [(i, f"Text {i}", "en" if i % 3 else None, "s", i) + ("",) * 4 for i in range(2_000)]
    assert rows_of(manifest.op12_query(spark.createDataFrame(docs, DOCS)), PROOF) == sorted(slow_manifest(docs), key=repr)


def test_manifest_sql(spark, tmp_path):
    docs = spark.createDataFrame(odd_docs(), DOCS)
    docs.write.parquet(f"{tmp_path}/documents")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    theirs = con.execute(f"SELECT {', '.join(PROOF)} FROM ({manifest.OP12_SQL})").fetchall()
    assert sorted(theirs, key=repr) == rows_of(manifest.op12_query(docs), PROOF)


# --- repair

TURNS = "conv_id long, turn long, role string, text string, key string, fault string, slice string"
FOUND = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def slow_repair(rows):
    """A table of the cheapest prefixes, row by row, with the repaired lines in it."""
    known = lambda v: " " if v is None else str(v)
    talks = {}
    for conv, turn, role, text in rows:
        talk = talks.setdefault(conv, [])
        kind = zlib.crc32(f"{known(conv)}:{known(turn)}".encode()) % 20
        role, text = known(role) or " ", known(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            talk += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, talk in talks.items():
        talk.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in talk if t is not None]
        seen, faults = set(), []
        for _, role, text in talk:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        best = {"": (0, "", ())}

        def offer(table, state, value):
            if state not in table or value[:2] < table[state][:2]:
                table[state] = value

        def with_inserts(table):
            for _ in range(3):
                for state, (cost, audit, lines) in list(table.items()):
                    role = "assistant" if state == "u" else "user"
                    offer(table, role[0], (cost + 5, audit + "I", (*lines, f"{role}:")))
            return table

        with_inserts(best)
        for (_, role, text), fault in zip(talk, faults, strict=True):
            after = {}
            for state, (cost, audit, lines) in best.items():
                offer(after, state, (cost + 2, audit + "D", lines))
                for name, edit, price in ((role, "K", 0), ("user", "R", 1), ("assistant", "R", 1)):
                    allowed = name[0] == "s" and state == "" or name[0] == ("a" if state == "u" else "u")
                    if allowed and fault not in ("blank", "duplicate"):
                        offer(after, name[0], (cost + price + 5 * (fault == "truncated"), audit + edit, (*lines, f"{name}:{text}")))
            best = with_inserts(after)
        cost, audit, lines = min((v for s, v in best.items() if s in ("", "a")), key=lambda v: v[:2])
        illegal = sum(a[1][0] + b[1][0] not in ("su", "ua", "au") for a, b in pairwise(talk))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        yield conv, gaps, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, h("\n".join(lines))


def odd_talks():
    r = random.Random(11)
    texts = ["a.", "b?", "c", "  ", "", "d!\t", None, "e. f", "x ", "Ü.", "long " * 20_000 + "."]
    roles = ["user", "assistant", "system", "tool", None, "", "unknown", "assist"]
    rows = [(c, r.choice([None, *range(12)]), r.choice(roles[: 8 if c % 2 else 3]), r.choice(texts)) for c in range(120) for _ in range(r.randrange(9))]
    rows += [(None, i // 3, r.choice(roles[: 3 if i % 50 else 8]), r.choice(["q", "w.", f"t{i}.", f"u{i}"])) for i in range(500)]  # one conversation of many slices
    rows += [(7777, i, "system", f"t{i}.") for i in range(200)] + [(7778, i, "ua"[i % 2] + "x", f"t{i}.") for i in range(129)]
    return rows


def test_repair_as_a_table_of_prefixes(spark):
    rows = odd_talks()
    df = spark.createDataFrame([(*x, "own", None, "own") for x in rows], TURNS).repartition(3)
    assert rows_of(repair.op13_query(df), FOUND) == sorted(slow_repair(rows), key=repr)


def test_repair_sql(spark, tmp_path):
    rows = [x for x in odd_talks() if len(x[3] or "") < 50]
    spark.createDataFrame([(*x, "", "", "") for x in rows], TURNS).select("conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/c")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    assert sorted(con.execute(f"SELECT {', '.join(FOUND)} FROM ({repair.OP13_SQL})").fetchall(), key=repr) == sorted(slow_repair(rows), key=repr)


def test_search_against_all_edits():
    """Short rows, every sequence of edits with up to two inserts before each row and at the end."""
    r = random.Random(2)
    for _ in range(150):
        rows = tuple((r.choice("suua-a"), r.random() < 0.2, r.choice([0, 0, 5])) for _ in range(r.randrange(4)))
        begin, end = r.randrange(4), r.randrange(4)
        found = []

        def walk(i, state, cost, audit):
            for inserts in range(4):
                if i == len(rows):
                    if state == end:
                        found.append((cost, audit))
                else:
                    initial, gone, stay = rows[i]
                    walk(i + 1, state, cost + 2, audit + "D")
                    if not gone:
                        if (to := repair.kept(state, initial)) is not None:
                            walk(i + 1, to, cost + stay, audit + "K")
                        walk(i + 1, repair.NEXT[state], cost + stay + 1, audit + "R")
                state, cost, audit = repair.NEXT[state], cost + 5, audit + "I"

        walk(0, begin, 0, "")
        got = repair.cheapest(rows, begin, (end,))
        assert (got and got[:2]) == min(found, default=None)


def test_a_long_slice_is_searched_in_reasonable_steps():
    for initials in ("s" * 64, "us" * 32, "a" * 64, "ssuuaa" * 10):
        rows = tuple((c, i % 7 == 3, 5 * (i % 5 == 1)) for i, c in enumerate(initials))
        for begin in range(4):
            repair.cheapest(rows, begin, (3,))


def test_empty_tables_give_no_rows(spark):
    assert best_fit.op11_query(spark.createDataFrame([], DOCS), packing.word_bpe_path()).count() == 0
    assert manifest.op12_query(spark.createDataFrame([], DOCS)).count() == 0
    assert repair.op13_query(spark.createDataFrame([], TURNS)).count() == 0
