"""The edge stream's files: as many a range as its rows ask for, ranges in time order."""

from provspark.plans import q_streaming as q


def test_ranges_have_files_by_their_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(q, "FILE_ROWS", 20, raising=False)
    monkeypatch.setattr(q, "folder", lambda spark, name: str(tmp_path / name))
    of = spark.range(900).selectExpr("id AS ts", "id AS event_id").union(spark.createDataFrame([(None, -1)], "ts long, event_id long"))
    q.edge_stream(spark, "", of=of)
    files = sorted((tmp_path / "stream").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    assert len(files) == 48  # 901 rows in 3 ranges of 20 a file: 16 files each
    parts = [[r["ts"] for r in spark.read.parquet(*map(str, files[i : i + 16])).collect()] for i in (0, 16, 32)]
    assert sum(map(len, parts)) == 901 and None in parts[0]
    low = [min(t for t in p if t is not None) for p in parts]
    high = [max(t for t in p if t is not None) for p in parts]
    assert high[0] < low[1] and high[1] < low[2]
