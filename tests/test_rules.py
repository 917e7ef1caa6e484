"""Sequence rules against one machine over all edges; streams against batch; configuration."""

import re
from pathlib import Path
from types import SimpleNamespace

import pytest
from sequence_machine import SequenceMachine

from provspark.operators import rules as r
from provspark.plans import q_serving, q_streaming  # noqa: F401  (they register the queries)
from provspark.plans.adapt import edges
from provspark.plans.registry import QUERIES
from provspark.sources.config import load_rules, parse_rule, rule_library
from provspark.streaming import streams as st

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="the test tables are not here")


def edge(n, kind, src, dst, at_s, dst_type="PROCESS", src_name="bash", dst_name="bash"):
    return SimpleNamespace(event_id=f"e{n}", edge_type=kind, src_id=src, dst_id=dst, src_type="PROCESS", dst_type=dst_type, src_name=src_name, dst_name=dst_name, ts=at_s * 10**9, endpoint_id="h")


def serves(c, e):
    """Whether an edge satisfies a condition, by Python's own expressions."""
    kinds = c.get("edge") or ()
    kinds = {kinds} if isinstance(kinds, str) else set(kinds)
    ends = ((c.get("subject_type"), c.get("subject_re"), e.src_type, e.src_name), (c.get("object_type"), c.get("object_re"), e.dst_type, e.dst_name))
    return (not kinds or e.edge_type in kinds) and all((not kind or kind == t) and (not pattern or re.search(pattern, name or "", re.I)) for kind, pattern, t, name in ends)


class Machine(SequenceMachine):
    """The library's machine, fed with whole edges."""

    def see(self, e):
        masks = [(i, sum(1 << k for k, c in enumerate(x["steps"]) if serves(c, e))) for i, x in enumerate(self.rules)]
        return [f for i, mask in masks if mask for f in self.feed(i, mask, e)]


def machine(*ids):
    return Machine([x for x in rule_library(True) if x["id"] in ids])


def slow_firings(edges, rules):
    """{(rule, root, last event)}: every edge against every live partial, in order."""
    live, out = {}, set()
    for e in sorted(edges, key=lambda e: (e.ts, e.event_id)):
        for rule in (x for x in rules if len(x["steps"]) > 1):
            active = e.dst_id if e.dst_type == "PROCESS" else e.src_id
            for key in [k for k, (_, last, _) in live.items() if k[0] == rule["id"] and e.ts - last > (rule.get("window") or 300) * 10**9]:
                del live[key]
            for key in [k for k, (_, _, at) in live.items() if k[0] == rule["id"] and at == e.src_id]:
                step = live[key][0]
                if serves(rule["steps"][step], e):
                    live[key] = step + 1, e.ts, active
                    if step + 1 == len(rule["steps"]):
                        out.add((rule["id"], key[1], e.event_id))
                        del live[key]
            if (rule["id"], e.src_id) not in live and serves(rule["steps"][0], e):
                live[rule["id"], e.src_id] = 1, e.ts, active
    return out


def test_library_size():
    assert len(rule_library()) == 33 and len(rule_library(True)) == 35
    assert sum(len(x["steps"]) > 1 for x in rule_library()) == 13


def test_chain_follows_the_child():
    m = machine("download_and_execute")
    steps = [edge(1, "FORK", "a", "b", 1, dst_name="curl x"), edge(2, "CONNECT", "b", "s", 5, "SOCKET", "curl x"), edge(3, "WRITE", "b", "f", 9, "FILE", "curl x")]
    fired = [f for e in steps for f in m.see(e)]
    assert [(f["root"], f["event_ids"]) for f in fired] == [("a", ["e1", "e2", "e3"])]
    assert not m.live


def test_window_runs_from_the_last_advance():
    m = machine("download_and_execute")
    for e in (edge(1, "FORK", "a", "b", 0, dst_name="wget"), edge(2, "CONNECT", "b", "s", 290, "SOCKET", "wget")):
        m.see(e)
    assert m.see(edge(3, "WRITE", "b", "f", 580, "FILE", "wget"))
    m.see(edge(4, "FORK", "a", "b", 1000, dst_name="wget"))
    assert not m.see(edge(5, "CONNECT", "b", "s", 1301, "SOCKET", "wget")) and not m.live


def test_restart_after_fire_and_one_partial_a_root():
    m = machine("python_http_server")
    on = {"src_name": "python3"}
    assert not m.see(edge(1, "CONNECT", "a", "s", 1, "SOCKET", **on)) and not m.see(edge(2, "CONNECT", "a", "s", 2, "SOCKET", **on))
    assert len(m.live) == 1 and len(m.see(edge(3, "READ", "a", "f", 3, "FILE", **on))) == 1
    assert not m.see(edge(4, "READ", "a", "f", 4, "FILE", **on))


@needs_tables
def test_sequences_match_one_machine(spark):
    got = [(x["rule_id"], x["root"], x["last_event_id"]) for x in QUERIES["r2_match_sequence"](spark, SF).collect()]
    want = slow_firings(edges(spark, SF).toPandas().itertuples(), rule_library())
    assert set(got) == want and len(got) == len(want) > 0


@needs_tables
def test_multi_step_incidents_are_exported_whole(spark):
    """The last firing of each (rule, root), with the texts and edges of its whole chain."""
    rules, m, last = {x["id"]: x for x in rule_library()}, Machine(rule_library()), {}
    events = sorted(edges(spark, SF).toPandas().itertuples(), key=lambda e: (e.ts, e.event_id))
    for e in events:
        for f in m.see(e):
            last[f["rule_id"], f["root"]] = f
    by_id = {e.event_id: e for e in events}
    got = {x["incident_id"]: x for x in QUERIES["x3_x5_sequence_export"](spark, SF).collect()}
    assert got.keys() == {f"{rule}:{root}" for rule, root in last} and got
    for (rule, root), f in last.items():
        x, of = got[f"{rule}:{root}"], rules[rule]
        lines = [f"# [{of['mitre']}] {of['name']} — {f['subject_name']}", f"severity: {of['severity']}", f"technique: {of['mitre']}", "events:", *[f"  {e}" for e in f["event_ids"]]]
        assert x["context"] == "\n".join(lines) and len(f["event_ids"]) > 1
        assert re.findall('name="EventType">([^<]*)<', x["xml"]) == sorted({by_id[e].edge_type for e in f["event_ids"]})
        assert re.findall('name="Image">([^<]*)<', x["xml"]) == sorted({by_id[e].src_name for e in f["event_ids"]})


def test_gaps_and_ties(spark):
    """Stretches end only at gaps longer than the window; edges of one time run by event id; nulls do no harm."""
    import random

    rng = random.Random(4)
    names = ["curl x", "bash", "python3", "wget y", "tar", None]
    rows, at = [], 0
    for n in range(3000):
        at += rng.choice([0, 1, 1, 2, 5, 20, 20, 299, 301])
        kind = rng.choice(["FORK", "CONNECT", "WRITE", "READ"])
        a, b = f"p{rng.randrange(6)}", rng.randrange(6)
        dst = (f"p{b}", "PROCESS") if kind == "FORK" else (f"s{b}", "SOCKET") if kind == "CONNECT" else (f"f{b}", "FILE")
        rows.append((f"e{n:04}", at * 10**9, "h", kind, a, "PROCESS", rng.choice(names), dst[0], dst[1], rng.choice(["/tmp/x", "/etc/shadow", "curl z", None])))
    df = spark.createDataFrame(rows, "event_id string, ts long, endpoint_id string, edge_type string, src_id string, src_type string, src_name string, dst_id string, dst_type string, dst_name string")
    got = {(x["rule_id"], x["root"], x["last_event_id"]) for x in r.match_sequence(df, rule_library(True)).collect()}
    want = slow_firings([SimpleNamespace(**dict(zip(df.columns, x))) for x in rows], rule_library(True))
    assert got == want and len({x[0] for x in want}) > 1
    assert r.match_sequence(df.where("false"), rule_library()).count() == 0


def test_one_busy_chain_is_many_tasks_work(spark, monkeypatch):
    """40,000 edges of connected processes without a pause: the firings of one machine that sees them all, from many groups."""
    import random

    rng = random.Random(9)
    rows = []
    for n in range(40_000):
        kind = rng.choice(["FORK", "CONNECT", "WRITE", "READ"])
        a, b = f"p{rng.randrange(40)}", rng.randrange(40)
        dst = (f"p{b}", "PROCESS") if kind == "FORK" else (f"s{b}", "SOCKET") if kind == "CONNECT" else (f"f{b}", "FILE")
        rows.append((f"e{n:05}", n // 3 * 10**9, "h", kind, a, "PROCESS", rng.choice(["curl x", "bash", "python3"]), *dst, rng.choice(["/tmp/x", "curl z"])))
    columns = "event_id string, ts long, endpoint_id string, edge_type string, src_id string, src_type string, src_name string, dst_id string, dst_type string, dst_name string"
    df = spark.createDataFrame(rows, columns)
    rules = [x for x in rule_library(True) if x["id"] in ("download_and_execute", "python_http_server")]
    m = Machine(rules)
    want = sorted((f["rule_id"], f["root"], f["fired_at"], tuple(f["event_ids"]), tuple(f["node_ids"])) for x in rows for f in m.see(SimpleNamespace(**dict(zip(df.columns, x)))))
    groups = []
    monkeypatch.setattr(r, "_advance", lambda p, e, k, f=r._advance: groups.append(e.select("rule", "src_id", "slot").distinct().count()) or f(p, e, k))
    got = sorted((x["rule_id"], x["root"], x["fired_at"], tuple(x["event_ids"]), tuple(x["node_ids"])) for x in r.match_sequence(df, rules).collect())
    assert got == want and len(want) > 100 and min(groups) > 1000


@needs_tables
def test_stream_fires_what_the_batch_fires(spark):
    columns = ["rule_id", "root", "fired_at", "last_event_id", "endpoint_id", "subject_name", "event_ids", "node_ids"]
    got = sorted((tuple(x[c] for c in columns) for x in QUERIES["r2_r5_stream_sequences"](spark, SF).collect()), key=repr)
    assert got == sorted((tuple(x[c] for c in columns) for x in QUERIES["r2_match_sequence"](spark, SF).collect()), key=repr) and got


@needs_tables
def test_stream_of_sequences_goes_on_after_a_stop(spark, tmp_path):
    """Stopped and started again between any two files, a batch repeated: the firings of one run, and only live partials as state."""
    e = edges(spark, SF).orderBy("ts", "event_id").toPandas()
    schema, rules = edges(spark, SF).schema, rule_library()
    for i in range(4):
        spark.createDataFrame(e.iloc[i * len(e) // 4 : (i + 1) * len(e) // 4], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        st.drain(st.stream_sequences(stream, rules, f"{tmp_path}/out", f"{tmp_path}/check"))
    last = spark.createDataFrame(e.iloc[3 * len(e) // 4 :], schema)
    st.sequence_batch(last, 3, rules, f"{tmp_path}/out")
    got = [(x["rule_id"], x["root"], x["last_event_id"]) for x in spark.read.parquet(f"{tmp_path}/out/firings").collect()]
    assert set(got) == slow_firings(e.itertuples(), rules) and len(set(got)) == len(got)
    live = spark.read.parquet(f"{tmp_path}/out/live/batch=3")
    assert live.where(f"at.ts + window < {e['ts'].max()}").count() == 0 and live.groupBy("rule", "root").count().where("count > 1").count() == 0


def test_alerts_of_one_key_and_time(spark):
    rows = [("a", t * 10**9, i) for i, t in enumerate([0, 0, 100, 300, 301, 602, 5000, 5299, 5301, 5601, 5602])] + [("b", 7, 0), (None, 3, 1), (None, 4, 2)]
    got = sorted((x["key"] or "", x["ts"] // 10**9, x["i"], x["suppressed"]) for x in r.dedup_alerts(spark.createDataFrame(rows, "key string, ts long, i int")).collect())
    assert got == [("", 0, 1, 1), ("a", 0, 0, 3), ("a", 301, 4, 0), ("a", 602, 5, 0), ("a", 5000, 6, 1), ("a", 5301, 8, 1), ("a", 5602, 10, 0), ("b", 0, 0, 0)]


@needs_tables
def test_stream_alerts_match_batch(spark):
    batch = {(x["key"], x["ts"]) for x in QUERIES["t1_dedup_alerts"](spark, SF).collect()}
    stream = {(x["key"], x["ts"]) for x in QUERIES["t1_stream_alert_dedup"](spark, SF).where("kind = 'alert'").collect()}
    assert stream == batch


def test_bad_rules_are_reported(tmp_path):
    (tmp_path / "a.yml").write_text("id: a\ndetection: {condition: selection, selection: {edge: FORK}}\ntags: [attack.t1059.001]\n")
    (tmp_path / "b.yml").write_text("id: b\ndetection: {condition: other}\n")
    (tmp_path / "c.yml").write_text(": : [")
    rules, problems = load_rules(str(tmp_path))
    assert [(x["id"], x["mitre"]) for x in rules] == [("a", "T1059.001")] and len(problems) == 2
    with pytest.raises(ValueError):
        parse_rule({"id": "x"})
