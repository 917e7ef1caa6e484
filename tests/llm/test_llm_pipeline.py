"""The corpus pipeline on odd rows: nulls in any column, empty and long texts, ties, repeated rows, empty tables, clashing names."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="the test tables are not here")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, target string, node string, score string, slope string, component string"


def prose(i, n=60):
    return " ".join(f"w{(i * 7919 + k * k * 31) % 997}" for k in range(n))


def odd_rows():
    lines = "\n".join(["one shared line", "another shared line", "a third shared line"])
    rows = [(i, prose(i) + "\n" + (lines if i < 2 else prose(i + 100, 5)), "en", "ab"[i % 2], 0) for i in range(12)]
    rows += [(3, rows[3][1], "en", "b", 0), (3, rows[3][1], "en", "b", 0)]  # repeated rows
    rows += [(40, rows[5][1], None, None, None), (41, rows[5][1] + " end", "en", "a", 1)]  # a copy and a near copy
    rows += [(50, None, "en", "a", None), (51, "", "en", "a", 0), (None, prose(70), None, None, None), (None, None, None, None, None), (52, "x " * 200_000, "en", "c", 400_000)]
    return [(*r, "own", None, "own", "own", "own", None) for r in rows]


@needs_tables
def test_stages_on_odd_rows(spark):
    import corpus_pipeline

    docs = spark.createDataFrame(odd_rows(), DOCS)
    names = [n for n, _ in corpus_pipeline.STAGES]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs_in, docs = docs, stage(spark, docs, SF)
        if name != names[-1]:
            assert docs.columns == docs_in.columns and docs.schema["doc_id"].dataType == docs_in.schema["doc_id"].dataType
        docs = docs.cache()
        kept[name] = docs.collect()
        if name not in (names[-1],):
            assert docs.where("size <> 'own' OR score <> 'own'").count() == 0
    assert len(kept["toxicity"]) == len(odd_rows())  # nothing here is toxic
    texts = {r["doc_id"]: r["text"] for r in kept["line_dedup"]}
    assert len(kept["line_dedup"]) == len(odd_rows()) and texts[50] is None and texts[51] == "" and ("third shared" in texts[0]) + ("third shared" in texts[1]) == 1
    ids = sorted(r["doc_id"] for r in kept["simhash_near_dedup"] if r["doc_id"] is not None)
    assert ids == [*range(12), 50, 52]  # 51 is as empty as 50; 40 and 41 are copies of 5
    assert sum(r["doc_id"] is None for r in kept["simhash_near_dedup"]) == 1
    pieces = kept["packing"]
    assert {r["doc_id"] for r in kept["mixing"]} == {r["doc_id"] for r in pieces} and max(r["offset"] + r["length"] for r in pieces) <= 4096


@needs_tables
def test_stages_on_empty_tables(spark):
    import corpus_pipeline

    empty = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_stages_state_their_results():
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES:
        assert "null" in stage.__doc__.lower() and "empty" in stage.__doc__


def test_null_texts_count_as_empty(spark):
    from provspark.llm import simhash

    docs = spark.createDataFrame([(2, None), (1, ""), (7, " \n")], "doc_id long, text string").withColumn("p", F.lit(1))
    assert [r["doc_id"] for r in simhash.keep_one(docs).collect()] == [1]
