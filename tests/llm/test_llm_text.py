"""Toxicity, surrogates, page text, packing, mixing, WARC, top-k and the pipeline."""

import itertools
import json
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

from provspark.llm import mixing, mtree, packing, pii, toxicity, warc, wrapper
from provspark.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="the test tables are not here")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@needs_tables
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    plain = lambda f: sorted(map(repr, (tuple(None if x != x else round(float(x), 5) if isinstance(x, (int, float, np.number)) else x for x in r) for r in f[sorted(f.columns)].itertuples(index=False))))
    assert plain(QUERIES[name](spark, SF).toPandas()) == plain(con.execute(SQL[name]).df())


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_finds_what_distances_say():
    rng = random.Random(1)
    for _ in range(60):
        terms = {"".join(rng.choice("abc") for _ in range(rng.randint(3, 11))): 1.0 for _ in range(6)}
        trie = toxicity.build_trie(terms)
        for _ in range(30):
            word = list(rng.choice(list(terms)))
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(word))
                word[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
                word = word or ["a"]
            word = "".join(word)
            near = [(edit_distance(word, t), t) for t in terms]
            near = [x for x in near if x[0] <= toxicity.allowed_edits(len(x[1]))]
            want = (word, 0) if word in terms else min(near)[::-1] if near else None
            assert toxicity.match(word, trie) == want
            assert want is None or want[1] == 0 or toxicity.Gate(terms).passes(word)


def test_misspellings_of_all_kinds():
    lex = toxicity.Lexicon({"stupid": 3.0, "moro*": 3.0, "moron": 3.0, "imbecilic": 3.0})
    hit = lambda w: any(lex.features(f"so {w} indeed"))
    assert all(map(hit, ["stupid", "xtupid", "tupid", "st*pid", "stup1d", "sstupid", "m0ron", "noron", "moronic", "imbecxlik", "mbecilix", "1mbecilic"]))
    assert toxicity.match("abcdefg", toxicity.build_trie({"abcdefghi": 1.0})) == ("abcdefghi", 2)
    assert not any(map(hit, ["stxxid", "mor", "morn1ng", "imbxcxlxc", "pid"]))
    assert lex.look_up({"m0ron!"}) == {"m0ron": ("moron", 1)}


def test_context_separates_quotation():
    lex = toxicity.Lexicon({"stupid": 3.0, "moro*": 3.0})
    plain, quoted, addressed, fuzzy, kinds = range(5)
    assert lex.features("you are stupid")[plain] > 0 and lex.features("you are stupid")[addressed] > 0
    assert lex.features('he said: "stupid thing" again')[quoted] > 0 == lex.features('he said: "stupid thing" again')[plain]
    assert lex.features("so stupidd indeed")[fuzzy] > 0 and lex.features("morons")[plain] > 0
    assert lex.features(None) == lex.features("") == [0.0] * 5


def toxic_corpus(n=900):
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        text, bad = [rng.choice(words) for _ in range(rng.randint(5, 60))], i % 6 == 0
        if bad:
            for w in rng.sample(["wretchgob", "zorkbag", "plimfool"], 2):
                text.insert(rng.randrange(len(text)), w)
        rows.append((i, " ".join(text), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_corpus()
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.op7_query(docs, lab).collect()}
    held = [(y, got[d]["predicted"]) for d, _, y in labels if got[d]["held_out"]]
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d in got)
    assert sum(y == p for y, p in held) / len(held) > 0.97
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, 0), (1, "wretchgob " * 5000, None, None, 0)], DOCS)
    scores = [r["score"] for r in toxicity.op7_query(odd.union(docs), lab).where("doc_id IS NULL OR doc_id = 1").collect()]
    assert all(0 <= s <= 1 for s in scores)
    assert toxicity.op7_query(docs, lab.where("false")).where("score > 0.000001").count() == 0
    assert toxicity.op7_query(docs.where("false"), lab).count() == 0


PRIVATE = ["ann.lee@mail.example.com", "+1 (974) 555-3436", "4952935900253052", "144.137.247.239", "123-45-6789", "04dbebab91ab85687d33eeaaf9ac699e1188f962", "DE89 3704 0044 0532 0130 00", "Mrs Smith", "Herr Müller"]


def test_surrogates(spark):
    docs = [(i, f"x {p}, y {p}. z") for i, p in enumerate(PRIVATE)] + [(50, "nothing here 12 3.5 a@b"), (51, None), (52, ""), (53, "ANN.LEE@mail.example.com and 4952-9359-0025-3052"), (54, "no " * 30000 + PRIVATE[0])]
    df = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, n_entities string")
    got = {r["doc_id"]: r for r in pii.replace(df, "k").collect()}
    made = {}
    for i, p in enumerate(PRIVATE):
        text = got[i]["text"]
        assert p not in text and got[i]["_pii_found"] == 2
        a, b = re.fullmatch(r"x (.*), y (.*)\. z", text).groups()
        assert a == b
        made[p] = a
    assert [got[i]["text"] for i in (50, 51, 52)] == ["nothing here 12 3.5 a@b", None, ""]
    assert got[53]["text"].startswith(made[PRIVATE[0]].lower()) and re.sub(r"\D", "", got[53]["text"][-19:]) == made[PRIVATE[2]]
    assert re.fullmatch(r"\+\d \(\d{3}\) \d{3}-\d{4}", made[PRIVATE[1]]) and re.fullmatch(r"\d{16}", made[PRIVATE[2]]) and re.fullmatch(r"[0-9a-f]{40}", made[PRIVATE[5]])
    assert all(int(x) < 256 for x in made[PRIVATE[3]].split(".")) and made[PRIVATE[7]].startswith("Mrs ") and made[PRIVATE[7]].endswith("a") and made[PRIVATE[8]].startswith("Herr ")
    assert pii.op8_query(df.where("false")).count() == 0


def test_surrogates_stay_distinct(spark):
    ips = [f"10.0.{i}.{j}" for i in range(40) for j in range(50)]
    df = spark.createDataFrame([(i, f"at {ip} ok") for i, ip in enumerate(ips)], "doc_id long, text string")
    out = [r["text"].split()[1] for r in pii.replace(df, "k").collect()]
    assert len(set(out)) == len(ips) and not set(out) & set(ips)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu {n}</a></li></ul></nav><!-- ad <p> -->
<div class="ad">Buy {n}</div><div class="note-box">Same words everywhere</div><{main}><h1>Head&amp;er {n}</h1><p>First <b>bold {n}.<br><p>Second&nbsp;  line {n}</p><form>no</form></{main}><div id="comments"><p>rude</p></div><footer>&copy; {n}</footer>"""


def test_page_text(spark):
    rows = [(i, f"http://h/{i}", PAGE.format(n=i, main="article")) for i in range(12)] + [(100 + i, f"http://g/{i}", PAGE.format(n=i, main="div")) for i in range(12)]
    rows += [(200, None, None), (201, "x", ""), (202, "http://h/0", rows[0][2]), (203, "http://z/", "<p>a<p>b" + "<i>" * 3000 + "c < d & e"), (204, "http://q/", "<p title='x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrapper.op10_query(df).collect()}
    want = lambda i: f"Head&er {i}\nFirst bold {i}.\nSecond line {i}"
    assert all(got[i] == want(i) for i in range(12)) and got[202] == want(0)
    assert all(got[100 + i] == want(i) for i in range(12))  # the repeated box is template, no element marks the content
    assert got[200] == got[201] == "" and got[203] == "a\nbc < d & e"
    assert wrapper.op10_query(df.where("false")).count() == 0


def test_hilbert_neighbours_touch():
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    keys = packing.hilbert_key(cells, 3)
    assert sorted(keys) == list(range(512))
    steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_tokens_are_the_tokenizers():
    from tokenizers import Tokenizer

    texts = ["it's OK. don't!! re. İstanbul. Σας Σ. café, J̌x. a ².,x 12,5.", "", " ", ".,", "a.b, c.d\n.", "\x1cfoo\x85bar z", "naïve Straße, ÉTÉ!! x<|endoftext|>."]
    inner, ours = Tokenizer.from_file(packing.word_bpe_path()), packing.WordTokenizer(packing.word_bpe_path())
    assert [np.frombuffer(x, "<u2").tolist() for x in ours(texts)] == [inner.encode(t, add_special_tokens=False).ids for t in texts]


@needs_tables
def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    inner = Tokenizer.from_file(packing.word_bpe_path())
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(None, None), (10**17 + 1, "")], "doc_id long, text string"))
    want = {r["doc_id"]: [*inner.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    rows = packing.pack(docs, packing.word_bpe_path()).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
        ids = np.array(want[r["doc_id"]][r["start"] : r["start"] + r["length"]], dtype="<u4")
        assert zlib.crc32(ids.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(want[r["doc_id"]]) and len(ids) == r["length"]
    assert pieces.keys() == want.keys()
    for d, ps in pieces.items():
        ps = sorted(ps, key=lambda r: r["start"])
        assert [p["start"] for p in ps] == [0, *itertools.accumulate(p["length"] for p in ps)][:-1] and sum(p["length"] for p in ps) == len(want[d])
    for ps in sequences.values():
        ps = sorted(ps, key=lambda r: r["offset"])
        n = sum(p["length"] for p in ps)
        assert [p["offset"] for p in ps] == [0, *itertools.accumulate(p["length"] for p in ps)][:-1]
        assert n <= 4096 and n & (n - 1) == 0


def test_mix(spark):
    rng = random.Random(5)
    docs = [(i, " ".join("w" for _ in range(rng.randrange(40))), "en", rng.choice(["b", "b", "b", "a", None, "ä"]), 0) for i in range(400)]
    docs += [(None, None, None, "a", None), (7, "w w", "en", "b", 0), (7, "w w", "en", "b", 0)]
    df = spark.createDataFrame(docs, DOCS)
    rows = mixing.op4_query(df).collect()
    assert len(rows) == len(docs) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r["target"], r["source_size"]].append(r)
    total = sum(len((d[1] or "").split()) for d in docs)
    assert sum(t for t, _ in by) == pytest.approx(1.5 * total, rel=1e-6)
    for (target, size), rs in by.items():
        assert target <= 2 * size + 1e-6 and abs(sum(r["taken"] for r in rs) - target) <= max(r["size"] for r in rs)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert mixed.count() == sum(r["copies"] for r in rows)
    assert rows == mixing.op4_query(df).collect()
    from pyspark.sql import functions as F

    named = df.withColumns({c: F.lit("own") for c in ("target", "size", "slope", "source_size", "copies", "taken", "n_rows", "words", "rank")})
    other = mixing.mix(named)
    assert other.columns == named.columns and other.where("size <> 'own' OR n_rows <> 'own' OR rank <> 'own'").count() == 0
    assert [r["doc_id"] for r in other.collect()] == [r["doc_id"] for r in mixed.collect()]
    assert mixing.op4_query(df.where("false")).count() == 0


def test_mix_deals_texts_twice_only(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 40), "en", "ab"[i % 2], 0) for i in range(400)], DOCS)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables of any size
    try:
        plan = mixing.mix(docs)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # once to their bucket, once to their place
    assert len(re.findall(r"\) Exchange\nInput \[\d+\]: \[[^\]]*\btext#", plan)) == 2


def test_mix_without_broadcasts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (i % 40), "en", ["a", "b", None][i % 3], 0) for i in range(400)], DOCS)
    want = mixing.mix(docs).collect()
    monkeypatch.setattr(mixing, "FEW", 0)
    assert mixing.mix(docs).collect() == want


def test_audit_finds_damage(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}") for i in range(700)] + [(None, None, None)], "page_id long, url string, html string")
    r = warc.to_warc(pages, 300).cache()
    ours = r.select("segment", "number", warc.leaf_hash(r["offset"], r["length"], r["sha256"]).alias("hash"))
    bad, gone = {3, 77, 500}, {9}
    from pyspark.sql import functions as F

    theirs = ours.join(r.select("segment", "number", "page_id"), ["segment", "number"]).where("page_id IS NULL OR page_id <> 9")
    theirs = theirs.withColumn("hash", F.when(F.col("page_id").isin(*bad), F.lit("x")).otherwise(F.col("hash"))).drop("page_id")
    found = {(x["page_id"], x["status"]) for x in warc.audit(ours, theirs).join(r, ["segment", "number"]).collect()}
    assert found == {(b, "corrupt") for b in bad} | {(g, "missing") for g in gone}
    assert warc.audit(ours, ours).count() == 0
    assert warc.op5_query(pages.where("false")).count() == 0
    one = r.where("page_id = 3").first()["record"].decode()
    assert one.startswith("WARC/1.1\r\n") and one.endswith("<p>3\r\n\r\n") and "Content-Length: 4\r\n" in one


def test_top_k(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(600)]
    rows += [(700 + i, rows[0][1]) for i in range(150)] + [(900, None), (1000, [float("inf")] * 8), (1001, [1.0, 2.0]), (1100, [1.0, 3.0]), (1200, [0.5])]
    ok = [(i, np.floor(np.float64(v) * 1024).astype(np.int64)) for i, v in rows if v is not None and np.isfinite(v).all()]
    want = {}
    for q, x in ok:
        if q % 100 == 0:
            best = sorted((-int(x @ y), i) for i, y in ok if i != q and len(y) == len(x))[:10]
            want |= {(q, n): (i, -s) for n, (s, i) in enumerate(best, 1)}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in mtree.op6_query(df).collect()}
    assert got == want
    assert mtree.op6_query(df.where("false")).count() == 0


@needs_tables
def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "mixing", "packing"]
    sf = SF.replace("0.001", "0.01")  # enough labels to learn from
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    toxic, lines, near, mixed, packed = (f for _, f in corpus_pipeline.STAGES)
    kept = toxic(spark, docs, sf).cache()
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    cleaned = lines(spark, kept, sf).cache()
    assert cleaned.columns == docs.columns and cleaned.count() == kept.count() and cleaned.where("n_chars <> char_length(text)").count() == 0
    single = near(spark, cleaned, sf).cache()
    assert single.columns == docs.columns and single.count() == single.select("doc_id").distinct().count() < cleaned.count()
    mix = mixed(spark, single, sf).cache()
    assert mix.columns == docs.columns
    assert packed(spark, mix, sf).where("start = 0").count() == mix.count()
    assert json.dumps(corpus_pipeline.ORACLE_SQL) == "null"
