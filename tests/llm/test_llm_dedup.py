"""SimHash, line dedup and embeddings against brute force."""

import itertools
import random
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from provspark.llm import common, line_dedup, nn_descent, simhash
from provspark.llm.components import components

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="the test tables are not here")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprints():
    rng = random.Random(1)
    for n in [0, 1, 2, 3, 4, 5, 40]:
        text = " \t\n".join(rng.choice(["Ab", "ÄB", "c", "d!"]) for _ in range(n))
        assert simhash.fingerprint(text) == slow_fingerprint(text)
    assert simhash.fingerprint(None) == 0


def test_all_hamming_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = base ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 7), replace=False)) for _ in base], dtype=np.uint64)
    fps = np.unique(np.concatenate((base, near, [np.uint64(0), np.uint64(15), np.uint64(2**64 - 1)])).astype(np.uint64)).view(np.int64).tolist()
    want = {(a, b) for a, b in itertools.combinations(sorted(fps), 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    got = {tuple(r) for r in simhash.hamming_links(spark.createDataFrame([(f,) for f in fps], "fp long"), 4).collect()}
    assert got == want


def test_parts_cover_the_radius():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, (300, 64)).astype(np.uint8)
    bits[:, 10:20] = bits[:, 10:11]  # correlated bits go together
    few, many = simhash.radius_parts(bits, 1e4, 4), simhash.radius_parts(bits, 1e9, 4)
    for parts in (few, many):
        used = [b for g, _ in parts for b in g]
        assert sum(t + 1 for _, t in parts) == 5 and len(set(used)) == len(used) and {t for _, t in parts} <= {0, 1, 2, 3, 4}
    assert len(few) > len(many) and len({len(g) for g, _ in many}) + len({t for _, t in many}) > 2
    crowded = [{-1: 0.0, 0: 9.0, 1: 99.0}, {-1: 0.0, 0: 1.0, 1: 2.0}, {-1: 0.0, 0: 1.0, 1: 2.0}, {-1: 0.0, 0: 1.0, 1: 5.0}]
    price, limits = simhash.allocate(crowded, lambda _, t: t + 1, 5)
    assert (price, limits) == (5.0, [-1, 1, 1, 0])
    groups = simhash.group_bits(bits, [10, 27, 27])
    assert groups[0] == list(range(10, 20)) and sorted(b for g in groups for b in g) == list(range(64))


def shingle_set(text, n=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} or ({" ".join(w)} if w else {None})


def near_copies(rng, groups, share):
    """Texts with copies of which ``share`` words are replaced, and their true links at 0.8."""
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 8))) for _ in range(2_000)]
    texts = []
    for size in groups:
        base = [rng.choice(words) for _ in range(rng.randint(60, 300))]
        for k in range(size):
            copy = list(base)
            for _ in range(int(len(copy) * share * rng.random()) if k else 0):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    return texts


def test_keep_one_of_similar_texts(spark):
    rng = random.Random(9)
    texts = near_copies(rng, [1] * 250 + [2] * 150 + [12] * 8, 0.04) + ["", None, " \t", "one two", "One Two", "x" * 9]
    docs = [(i, t, "x", "s", 0) for i, t in enumerate(texts)]
    sets = [shingle_set(t) for t in texts]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = roots(range(len(texts)), pairs)
    df = spark.createDataFrame(docs, DOCS)
    found = simhash.similar(df).collect()
    group = {r["doc_id"]: r["component"] for r in found}
    assert sum(group[a] == group[b] for a, b in pairs) >= 0.97 * len(pairs) and len(pairs) > 300
    assert all(want[a] == want[b] for a, b in itertools.combinations(range(len(texts)), 2) if group[a] == group[b])
    kept = simhash.keep_one(df.withColumn("component", F.lit(1)))
    ids = sorted(r["doc_id"] for r in kept.collect())
    least = {}
    for d in group:
        least[group[d]] = min(d, least.get(group[d], d))
    assert ids == sorted(least.values()) and kept.columns == [*df.columns, "component"]


def test_large_groups_of_near_copies(spark):
    texts = near_copies(random.Random(10), [700, 3, 1, 1], 0.03)
    sets = [shingle_set(t) for t in texts]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    df = spark.createDataFrame([(i, t, "x", "s", 0) for i, t in enumerate(texts)], DOCS)
    group = {r["doc_id"]: r["component"] for r in simhash.similar(df).collect()}
    assert sum(group[a] == group[b] for a, b in pairs) >= 0.97 * len(pairs)
    want = roots(range(len(texts)), pairs)
    assert all(len({want[d] for d in group if group[d] == g}) == 1 for g in set(group.values()))


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 160)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for p in links if None not in p for x in p}
    want = roots(nodes, [p for p in links if None not in p])
    assert {n: got.get(n, n) for n in nodes} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@needs_tables
def test_simhash_query(spark):
    rows = duckdb.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    fp = {d: slow_fingerprint(t) for d, t in rows}
    want = roots(fp, [(a, b) for a, b in itertools.combinations(sorted(fp), 2) if (fp[a] ^ fp[b]).bit_count() <= 4])
    got = simhash.op3_query(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in got} == {d: (fp[d], want[d]) for d in fp}
    assert all(len(r["fingerprint"]) == 16 for r in got)


def test_simhash_odd_rows(spark):
    docs = spark.createDataFrame([(3, "a b c d e", "x", None, 1), (3, "a b c d e", "x", None, 1), (None, "a b c d e", "x", None, 1), (5, None, None, None, None), (4, "", None, None, 0), (9, "zz", None, None, 2)], DOCS)
    got = {(r["doc_id"], r["component_id"]) for r in simhash.op3_query(docs).collect()}
    assert got == {(3, 3), (None, 3), (5, 4), (4, 4), (9, 9)}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 9]
    assert simhash.op3_query(docs.where("false")).count() == 0


def slow_lines(docs):
    """{(id, text): text after removal}, documents in (id) order."""
    seen, out = set(), {}
    for d, text in sorted(set(docs), key=lambda x: (x[0] is not None, x[0] or 0)):
        lines = (text or "").split("\n")
        covered = set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if not any(x.strip() for x in w):
                continue
            if w in seen:
                covered |= {i, i + 1, i + 2}
            seen.add(w)
        out[d, text] = None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in covered)
    return out


def test_line_dedup(spark):
    rng = random.Random(4)
    docs = [(i, "\n".join(rng.choice("abcd") for _ in range(rng.randrange(12)))) for i in range(60)]
    docs += [(None, "a\nb\nc\nd"), (100, None), (101, ""), (102, "\n\n\n\n"), (103, "\n\n\n\n"), (104, "x\n" * 3000), (1, docs[1][1])]
    df = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, n_removed string")
    got = {(r["doc_id"], i): r for i, r in enumerate(line_dedup.dedup_lines(df).collect())}
    assert len(got) == len(docs)
    want = slow_lines(docs)
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in got.values()))) == sorted(repr((d, want[d, t])) for d, t in docs)
    assert line_dedup.op2_query(df.where("false")).count() == 0


def unit(rng, n=16):
    v = rng.standard_normal(n)
    return v / np.linalg.norm(v)


def test_nn_descent(spark):
    rng = np.random.default_rng(7)
    rows, i = [], 0
    for size in (1, 1, 2, 5, 40, 90, *[1] * 60):
        c = unit(rng)
        for _ in range(size):
            rows.append((i, (c + 0.03 * rng.standard_normal(16)).astype(np.float32).tolist(), int(rng.integers(0, 2))))
            i += 1
    rows += [(1000, rows[5][1], rows[5][2]), (1001, rows[5][1], None), (1002, None, 1), (1003, [0.0] * 16, 1), (1004, [float("nan")] * 16, 1), (1005, [1.0, None], 1), (1006, [1.0, 2.0], 1)]
    ok = [r for r in rows if r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    link = lambda a, b: a[2] == b[2] and len(a[1]) == len(b[1]) and np.dot(a[1], b[1]) / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.93
    pairs = [(a[0], b[0]) for a, b in itertools.combinations(ok, 2) if link(a, b)]
    want = roots([r[0] for r in rows], pairs)
    got = {r["vec_id"]: r for r in nn_descent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert len(got) == len(rows)
    for v, r in got.items():
        assert (r["n_links"], r["component_id"], r["kept"]) == (sum(v in p for p in pairs), want[v], want[v] == v)


def test_nn_descent_empty(spark):
    assert nn_descent.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_nn_descent_finds_isolated_pairs(spark):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((12_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for i in range(0, 80, 2):
        v = rng.standard_normal(64)
        v -= v @ x[i] * x[i]
        x[i + 1] = 0.935 * x[i] + np.sqrt(1 - 0.935**2) * v / np.linalg.norm(v)
    rows = spark.createDataFrame([(i, v.tolist(), 1, "z") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int, n_links string")
    got = nn_descent.near_duplicates(rows).where("n_links > 0").collect()
    assert len(got) >= 78 and {r["n_links"] for r in got} == {1} and got[0]["audited_recall"] >= 0.95
    assert {(r["vec_id"] & ~1) for r in got} == {r["component_id"] for r in got}


def test_nn_descent_dense_and_wide_groups(spark):
    rng = np.random.default_rng(12)
    center, way = unit(rng, 32), unit(rng, 32)
    dense = center + 0.01 * rng.standard_normal((700, 32))
    wide = np.array([center * np.cos(t) + way * np.sin(t) for t in np.linspace(1, 2.6, 1500)]) + 0.01 * rng.standard_normal((1500, 32))
    x = np.concatenate((dense, wide)) * rng.uniform(0.1, 1e6, (2200, 1))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = (u @ u.T >= 0.93).sum(axis=1) - 1
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(5000, x[0].tolist(), 1), (None, x[0].tolist(), 1), (5001, x[9].tolist(), 2)]
    got = {r["vec_id"]: r for r in nn_descent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    near = u @ u[0] >= 0.93
    assert all(got[i]["n_links"] == links[i] + near[i] for i in range(2200))
    assert got[5000]["n_links"] == links[0] + 1 and got[5001]["n_links"] == 0 and got[5001]["kept"] and got[None]["component_id"] is None


@pytest.mark.parametrize(("size", "noise"), [(60, 0.01), (400, 0.01), (150, 0.16)])
def test_groups_larger_than_a_list_that_touch(spark, size, noise):
    """Two groups whose vectors all (or here and there) link across; lists hold far fewer neighbours than one group has."""
    rng = np.random.default_rng(size)
    dims, across = 32, 0.945
    a = rng.standard_normal(dims)
    a /= np.linalg.norm(a)
    b = rng.standard_normal(dims)
    b -= (b @ a) * a
    b = across * a + np.sqrt(1 - across**2) * b / np.linalg.norm(b)
    x = np.concatenate([c + noise * rng.standard_normal((size, dims)) / np.sqrt(dims) for c in (a, b)] + [rng.standard_normal((300, dims))]).astype(np.float32)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    linked = unit @ unit.T >= nn_descent.THRESHOLD
    np.fill_diagonal(linked, False)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in nn_descent.near_duplicates(df).collect()}
    assert [got[i]["n_links"] for i in range(len(x))] == linked.sum(axis=1).tolist()
    assert {got[i]["component_id"] for i in range(2 * size)} == {0} and linked[:size, size : 2 * size].any()


def test_pairs_that_crowded_buckets_leave_out(spark, monkeypatch):
    """Every pair of a crowded key between components comes, whatever pieces it is dealt in."""
    monkeypatch.setattr(simhash, "CROWD", 16)
    rng = random.Random(21)
    flip = lambda v, n: v ^ sum(1 << b for b in rng.sample(range(63), n))
    base = [rng.getrandbits(62), rng.getrandbits(62)]
    rows, group = [], {}
    for node in range(140):
        group[node] = 0 if node < 60 else 1 if node < 110 else node  # two components, and nodes of their own
        c0, c1 = (flip(base[0], rng.randrange(3)), base[1]) if node < 60 else (flip(base[0], 14), flip(base[1], rng.randrange(14)))
        rows += [(key, node % 3 == 0 and key == 5, node, c0, c1) for key in (5, 6) if key == 5 or node % 2]
    rows += [(9, False, 200 + i, base[0], base[1]) for i in range(20)] + [(8, False, 300 + i, base[0], base[1]) for i in range(50)]
    group |= {300 + i: 300 for i in range(50)}
    comp = spark.createDataFrame([(n, c) for n, c in group.items() if n != c], "node long, component long")
    df = spark.createDataFrame(rows, "at long, probe boolean, node long, c0 long, c1 long")
    got = {(r["a"], r["b"]) for r in simhash.rest_pairs(df, comp).collect()}
    want = set()
    for (at, p, a, x, y), (at_b, q, b, z, w) in itertools.combinations(rows, 2):
        if at == at_b and at in (5, 6) and not (p and q) and group[a] != group[b] and (x ^ z).bit_count() + (y ^ w).bit_count() <= simhash.APART:
            want.add((min(a, b), max(a, b)))
    assert got == want and len(want) > 3_000
    before = {(r["a"], r["b"]) for r in simhash.bucket_pairs(df).collect()}
    assert len(before & want) < len(want) / 2


def test_similar_sets_as_by_brute_force():
    rng = random.Random(5)
    base = [[rng.getrandbits(64) for _ in range(200)] for _ in range(3)]
    for rate in (0.02, 0.1, 0.2):
        sets = [np.array(sorted({rng.getrandbits(64) if rng.random() < rate else h for h in base[i % 3]}), np.uint64) for i in range(90)]
        sets += [np.array([7], np.uint64), np.array([7, 8], np.uint64), np.zeros(0, np.uint64)]
        ids, half = np.arange(len(sets)), len(sets) // 2
        for left, right in ((ids, ids), (ids[:half], ids[half:]), (ids[:0], ids)):
            i, j = simhash.similar_sets(([sets[k] for k in left], [sets[k] for k in right]), (left, right), 0.8)
            got = {(left[a], right[b]) for a, b in zip(i, j, strict=True) if left[a] != right[b]}
            both = lambda a, b: len(set(sets[a].tolist()) & set(sets[b].tolist()))
            assert got == {(a, b) for a in left for b in right if a != b and both(a, b) >= 0.8 * (len(sets[a]) + len(sets[b]) - both(a, b))}


def test_rest_pairs_are_decided_where_they_meet(spark, monkeypatch):
    """Links of crowded keys, one for two components of a group, join what all pairs join, whatever pieces they are dealt in."""
    monkeypatch.setattr(simhash, "CROWD", 16)
    monkeypatch.setattr(simhash, "HEAVY", 500)
    rng, bits = random.Random(22), [random.Random(23).getrandbits(62) for _ in range(2)]
    base = [[rng.getrandbits(62) for _ in range(100)] for _ in range(4)]
    sets = {n: {rng.getrandbits(62) if rng.random() < rng.choice((0.01, 0.2)) else h for h in base[n % 4]} for n in range(120)}
    group = {n: n % 40 if n % 4 == 0 else n for n in range(120)}
    rows = spark.createDataFrame([(key, n % 5 == 0, n, *bits) for key in (5, 6) for n in range(120)], "at long, probe boolean, node long, c0 long, c1 long")
    comp = spark.createDataFrame([(n, c) for n, c in group.items() if n != c], "node long, component long")
    table = spark.createDataFrame([(n, len(s), np.array(sorted(s), np.uint64).tobytes()) for n, s in sets.items()], "node long, size long, hashes binary")
    got = [(r["a"], r["b"]) for r in simhash.rest_pairs(rows, comp, lambda asked: table.join(asked, "node")).collect()]
    all_pairs = {(r["a"], r["b"]) for r in simhash.rest_pairs(rows, comp).collect()}
    want = {(a, b) for a, b in all_pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    held = [(n, c) for n, c in group.items()]
    assert set(got) <= want and roots(range(120), held + got) == roots(range(120), held + list(want)) != roots(range(120), held)


def test_unlike_texts_of_a_crowd_are_not_joined(spark, monkeypatch):
    """A group of texts that nearly link: what is written grows with the texts, not with their pairs."""
    rows = {}

    def written(df, name):
        out = common.written(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(simhash, "written", written)
    texts = near_copies(random.Random(12), [300], 0.05)
    df = spark.createDataFrame([(i, t, "x", "s", 0) for i, t in enumerate(texts)], DOCS)
    groups = simhash.similar(df).select("component").distinct().count()
    assert groups > 100 and rows["rest"] < 300 and rows["held"] > 600


def test_texts_go_to_python_by_bytes(spark, monkeypatch):
    before, at = spark.conf.get(common.BATCH_BYTES), {}

    def written(df, name):
        at.setdefault(name, spark.conf.get(common.BATCH_BYTES))
        return common.written(df, name)

    monkeypatch.setattr(simhash, "written", written)
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(60)) + " x" * (i % 2)) for i in range(4)], "doc_id long, text string")
    assert simhash.keep_one(docs).count() == 1
    assert at["fingerprints"] == at["links"] == common.TEXT_BYTES != before
    assert spark.conf.get(common.BATCH_BYTES) == before

    def sizes(batches):
        for x in batches:
            yield pd.DataFrame({"n": [int(x["text"].str.len().sum())]})

    long = spark.range(100, numPartitions=1).selectExpr("repeat('x', 500000) AS text")
    with common.text_batches(spark):
        got = long.mapInPandas(sizes, "n long").toPandas()["n"]
    assert got.sum() == 50_000_000 and got.max() < 6_000_000
