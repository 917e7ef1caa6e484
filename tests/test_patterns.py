"""Pattern search against plain substring tests, and samples that follow from their keys alone."""

import random

from pyspark.sql import functions as F

from provspark.operators import patterns, splits


def brute(text, groups):
    return [] if text is None else [i for i, g in enumerate(groups) if any(p.lower() in text.lower() for p in g)]


def both_ways(spark, texts, groups):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").repartition(3)
    for few in (0, 10**6):
        got = {r["id"]: r["f"] for r in df.select("id", patterns.groups_found(F.col("t"), groups, few).alias("f")).collect()}
        assert got == {i: brute(t, groups) for i, t in enumerate(texts)}, few


def test_random_texts(spark):
    rng = random.Random(7)
    word = lambda least, most: "".join(rng.choice("abAé|") for _ in range(rng.randint(least, most)))
    texts = [word(0, 60) for _ in range(150)] + [None, "", "ab" * 100_000]
    both_ways(spark, texts, [[word(1, 5) for _ in range(rng.randint(0, 6))] for _ in range(9)])


def test_nested_repeated_and_empty_patterns(spark):
    texts = ["abcd", "bc", "ABC", "", None, "a.c", "x|y"]
    both_ways(spark, texts, [["abc", "bc", "c"], ["BC"], ["abc", "abc"], [], ["", "zz"], ["a.c"], ["x|y"]])
    both_ways(spark, texts, [])
    both_ways(spark, texts, [[]])
    both_ways(spark, [], [["a"], ["b"]])


def test_long_lists_take_several_automata(spark, monkeypatch):
    monkeypatch.setattr(patterns, "BLOCK", 40)
    groups = [[f"<ioc{i}>", f"{i}.example"] for i in range(300)]
    assert len(patterns._blocks({p: [i] for i, g in enumerate(groups) for p in g})) > 50
    both_ways(spark, ["", "see <ioc7> and 299.example", "<ioc12", "x<IOC120>y"], groups)


def test_first_scenario_inside_its_window_wins(spark):
    raw = spark.createDataFrame([(1, "Evil.example x"), (5, "evil.example x"), (5, "x"), (9, None), (None, "evil.example x")], "_time long, _raw string")
    scenarios = [{"id": "a", "patterns": ["evil.example"], "start": 4, "end": 6}, {"id": "b", "patterns": ["x", *[f"p{i}" for i in range(50)]]}]
    got = [(r["_time"], r["_raw"], r["scenario"], r["label"]) for r in splits.label_iocs(raw, scenarios).collect()]
    # a row without a time is in no scenario's window
    assert got == [(1, "Evil.example x", "b", 1), (5, "evil.example x", "a", 1), (5, "x", "b", 1), (9, None, None, 0), (None, "evil.example x", None, 0)]
    assert {r["label"] for r in splits.label_iocs(raw, []).collect()} == {0}


def test_background_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(0.0, 10.0), (4.0, 30.0)], "a double, b double")
    one = sorted(splits.uniform_background(df, ["a", "b"], 500).coalesce(1).collect())
    assert one == sorted(splits.uniform_background(df.repartition(7), ["a", "b"], 500).collect())
    assert all(0 <= r["a"] < 4 and 10 <= r["b"] < 30 for r in one) and 1.8 < sum(r["a"] for r in one) / 500 < 2.2


def test_few_shot_cuts_before_the_shuffle(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 50 == 0, None).otherwise((F.col("id") % 4 == 0).cast("int")).alias("label"))
    t = splits.few_shot(df, 3, [1, 2], "id")
    n = {(r["seed"], r["label"]): r["count"] for r in t.groupBy("seed", "label").count().collect()}
    negatives = df.where("label = 0").count()
    assert n == {(1, 0): negatives, (2, 0): negatives, (1, 1): 3, (2, 1): 3, (1, None): 3, (2, None): 3}
    assert "WindowGroupLimit" in t._jdf.queryExecution().toString()


def test_hosts_of_a_corpus_in_files_of_their_own(spark, tmp_path):
    from provspark.sources import files

    lines = ['{"hostname":"A1","action":"x"}', "", "not json A1 and B2", '{"hostname":"a1"}', '{"hostname":"B2","action":"y"}', '{"hostname":"C3"}']
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    files.write_ecar_hosts(spark, str(tmp_path / "in"), out, ["A1", "B2", "Z9"])
    got = sorted((r["host"], r["value"]) for r in spark.read.text(out).collect())
    assert got == sorted([("A1", lines[0]), ("A1", lines[2]), ("B2", lines[2]), ("B2", lines[4])])
    files.write_ecar_hosts(spark, str(tmp_path / "in"), out, ["C3"])
    assert {r["host"] for r in spark.read.text(out).select("host").collect()} == {"A1", "B2", "C3"}
    assert [r["action"] for r in files.read_ecar(spark, f"{out}/host=A1").collect() if r["action"]] == ["x"]
    files.write_ecar_hosts(spark, str(tmp_path / "in"), out, [])
