"""Labelled events, parsers' odd lines, and the ends of small functions."""

import pytest

from provspark.functions import features, ids
from provspark.operators.parsers import parse_logs

CASES = [
    ({"image": r"D:\win\system32\rundll32.exe", "command_line": "rundll32 shell32.dll,Control_RunDLL"}, {"f_image_is_lolbin"}),
    ({"image": r"C:\x\excel.exe", "parent_image": r"C:\windows\explorer.exe", "command_line": "excel /n book.csv"}, set()),
    ({"image": "/opt/rubeus.exe", "command_line": "rubeus asktgt /user:eve"}, {"f_image_is_offensive_tool", "f_cmd_has_creddump"}),
    ({"image": "/usr/bin/python3", "command_line": "python3 -c 1 | sh"}, {"f_cmd_has_pipe_shell"}),
    ({"image": "/usr/bin/env", "command_line": "curl https://a.example/i"}, {"f_cmd_has_downloadstring", "f_cmd_has_url"}),
    ({"image": r"C:\a\b.exe", "target": r"E:\share\plan.odt"}, {"f_ext_is_document"}),
    ({"image": r"C:\a\b.exe", "command_line": "whoami /all"}, {"f_cmd_has_recon"}),
]


def test_labelled_events(spark):
    rows = [tuple(c.get(k) for k in features.INPUTS) for c, _ in CASES]
    df = spark.createDataFrame(rows, ", ".join(f"{k} string" for k in features.INPUTS))
    for (_, want), got in zip(CASES, features.engineer_features(df).collect(), strict=True):
        assert {f for f in features.FEATURES if got[f]} == want


def test_38_features():
    assert len(features.FEATURES) == 38


@pytest.mark.parametrize("sourcetype", ["stream_tcp", "suricata", "access_combined", "mordor_sysmon", "pan_traffic", "mysql_x", "WinHostMon", "WinRegistry", "auditd", "odd"])
@pytest.mark.parametrize("raw", ["", "{", "no keys here", None])
def test_unparsable_lines_give_empty_rows(spark, sourcetype, raw):
    df = spark.createDataFrame([(raw, sourcetype, "h")], "_raw string, sourcetype string, host string")
    got = parse_logs(df).first()
    assert got["edge_type"] is None and got["object_id"] is None


def test_ids_of_missing_parts(spark):
    from pyspark.sql import functions as F

    n = F.lit(None).cast("string")
    got = spark.range(1).select(ids.proc_id(n, F.lit("0"), F.lit("C:\\a\\b.exe")).alias("p"), ids.file_id(n, n).alias("f"), ids.socket_id(n, n, n, F.lit("1"), n).alias("s"), ids.url_id(n, n).alias("u")).first()
    assert got == ("proc:?:b.exe", None, None, None)
