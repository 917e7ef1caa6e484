"""Raw log lines -> (subject, action, object), set-based: one pass, a CASE on the sourcetype.

Key-value formats are turned into parallel arrays of keys and values once; each
parser then looks its keys up. Add an entry to ``PARSERS`` for another format.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.functions import ids

# Formats, key names, positions and code tables of the log sources.
STREAM_KEYS = {
    "src_ip": "src_ip", "dest_ip": "dest_ip", "src_port": "src_port", "dest_port": "dest_port", "transport": "transport",
    "protocol_stack": "protocol", "bytes": "bytes", "bytes_in": "bytes_in", "bytes_out": "bytes_out", "packets_in": "packets_in",
    "packets_out": "packets_out", "http_method": "http_method", "http_status": "http_status", "http_user_agent": "http_user_agent",
    "http_referrer": "http_referrer", "http_content_type": "http_content_type", "http_content_length": "http_content_length",
    "uri_path": "http_uri", "site": "site", "query": "dns_query", "query_type": "dns_qtype", "reply_code": "dns_rcode", "app": "app_proto",
}
SURICATA_PATHS = {
    "src_ip": "$.src_ip", "dest_ip": "$.dest_ip", "src_port": "$.src_port", "dest_port": "$.dest_port", "transport": "$.proto",
    "app_proto": "$.app_proto", "suricata_event_type": "$.event_type", "bytes_in": "$.flow.bytes_toserver",
    "bytes_out": "$.flow.bytes_toclient", "packets_in": "$.flow.pkts_toserver", "packets_out": "$.flow.pkts_toclient",
    "suricata_alert_category": "$.alert.category", "suricata_alert_severity": "$.alert.severity", "http_method": "$.http.http_method",
    "http_status": "$.http.status", "http_uri": "$.http.url", "http_user_agent": "$.http.http_user_agent",
    "http_referrer": "$.http.http_refer", "http_content_type": "$.http.http_content_type", "site": "$.http.hostname",
}
PAN_POSITIONS = {
    "src_ip": 7, "dest_ip": 8, "user": 12, "app_proto": 14, "src_port": 24, "dest_port": 25, "transport": 29,
    "bytes": 31, "bytes_out": 32, "bytes_in": 33, "packets_in": 34, "duration": 36,
}
NUMERIC = (
    "src_port", "dest_port", "http_status", "http_content_length", "bytes", "bytes_in", "bytes_out", "packets_in", "packets_out",
    "duration", "event_id", "process_id", "suricata_alert_severity",
)
ACCESS_LINE = r'^(\S+) \S+ \S+ \S+(?: \S+)? \[[^\]]+\] "(\S+) (\S+)(?: [^"]*)?" (?:"[^"]*" )?(\d+) (\S+)(?: "([^"]*)" "([^"]*)")?'
SYSMON_DATA = r"<Data Name='([^']+)'>([^<]*)</Data>"
SYSMON_EDGES = {
    1: "FORK", 2: "WRITE", 3: "CONNECT", 7: "LOAD", 8: "MMAP", 10: "READ", 11: "WRITE", 12: "MODIFY_REG", 13: "MODIFY_REG",
    14: "MODIFY_REG", 15: "WRITE", 17: "CONNECT", 18: "CONNECT", 23: "DELETE", 25: "MMAP", 26: "DELETE",
}
SYSCALL_EDGES = {
    "EXEC": ("execve", "execveat"), "READ": ("open", "openat", "read", "readv", "pread64"), "WRITE": ("write", "writev", "pwrite64", "creat"),
    "DELETE": ("unlink", "unlinkat", "rmdir"), "RENAME": ("rename", "renameat", "renameat2"), "CONNECT": ("connect", "sendto", "send"),
    "FORK": ("clone", "fork", "vfork"),
}
QUOTED_PAIR = r'(\w+)\s*=\s*"((?:[^"\\]|\\.)*)"'
LINE_PAIR = r'(?m)^(\w+)\s*=\s*(?:"([^"]*)"|(\S.*?))\s*$'
AUDIT_PAIR = r'(\w+)=(?:"([^"]*)"|(\S+))'


def _null() -> Column:
    return F.lit(None).cast("string")


def known(fields: dict[str, Column]) -> Column:
    """The fields that have a value, as a map of texts. Build it once where several forms of a line share it."""
    numeric = {k: ids.to_int(v).cast("string") if k in NUMERIC else v.cast("string") for k, v in fields.items()}
    pairs = [x for k, v in numeric.items() for x in (F.lit(k), v)]
    return F.map_filter(F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>"), lambda _, v: v.isNotNull())


@dataclass
class Parsed:
    """Columns of one parser's result; what a format does not say stays None (null)."""

    subject: tuple[str | None, Column | None, Column | None] = (None, None, None)
    object: tuple[str | None | Column, Column | None, Column | None] = (None, None, None)
    edge: Column | str | None = None
    src_ip: Column | None = None
    dest_ip: Column | None = None
    fields: dict[str, Column] | Column = field(default_factory=dict)
    valid: Column | None = None

    def struct(self) -> Column:
        lit = lambda x: _null() if x is None else F.lit(x) if isinstance(x, str) else x.cast("string")
        fields = known(self.fields) if isinstance(self.fields, dict) else self.fields
        made = F.struct(
            lit(self.subject[0]).alias("subject_type"), lit(self.subject[1]).alias("subject_id"), lit(self.subject[2]).alias("subject_name"),
            lit(self.object[0]).alias("object_type"), lit(self.object[1]).alias("object_id"), lit(self.object[2]).alias("object_name"),
            lit(self.edge).alias("edge_type"), lit(self.src_ip).alias("src_ip"), lit(self.dest_ip).alias("dest_ip"), fields.alias("fields"),
        )
        return made if self.valid is None else F.when(self.valid, made)


def _or(*cols: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[ids.present(c) for c in cols])


def _end(ip: Column, port: Column) -> Column:
    return F.concat(F.coalesce(_or(ip), F.lit("?")), F.lit(":"), F.coalesce(_or(port), F.lit("?")))


def _flow(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column, transport: Column, fields: dict[str, Column], valid: Column | None) -> Parsed:
    nothing = _null()
    return Parsed(
        ("SOCKET", ids.socket_id(src_ip, src_port, nothing, nothing, transport), _end(src_ip, src_port)),
        ("SOCKET", ids.socket_id(nothing, nothing, dst_ip, dst_port, transport), _end(dst_ip, dst_port)),
        "CONNECT", src_ip, dst_ip, fields, valid,
    )


def parse_stream(raw: Column, host: Column) -> Column:
    get = lambda k: F.expr(f"if(startswith(element_at(_json, '{k}'), '['), get_json_object(element_at(_json, '{k}'), '$[0]'), element_at(_json, '{k}'))")
    fields = known({to: get(k) for k, to in STREAM_KEYS.items()})
    site, uri, valid = get("site"), get("uri_path"), F.col("_json").isNotNull()
    web = Parsed(
        ("HOST", ids.host_id(host), host), ("URL", ids.url_id(site, uri), F.concat(F.coalesce(site, F.lit("")), F.coalesce(uri, F.lit("")))),
        "ACCESS", get("src_ip"), get("dest_ip"), fields, valid,
    )
    transport = F.coalesce(_or(get("transport"), get("protocol_stack")), F.lit("tcp"))
    flow = _flow(get("src_ip"), get("src_port"), get("dest_ip"), get("dest_port"), transport, fields, valid)
    return F.when(_or(site, uri).isNotNull(), web.struct()).otherwise(flow.struct())


def parse_suricata(raw: Column, host: Column) -> Column:
    fields = {k: F.col("_nested" + p[1:]) for k, p in SURICATA_PATHS.items()}
    transport = F.coalesce(_or(fields["transport"]), F.lit("tcp"))
    return _flow(fields["src_ip"], fields["src_port"], fields["dest_ip"], fields["dest_port"], transport, fields, F.col("_json").isNotNull()).struct()


def parse_access(raw: Column, host: Column) -> Column:
    part = lambda i: F.expr(f"get(_parts, {i - 1})")
    uri = part(3)
    fields = {
        "http_method": _or(part(2)), "http_uri": _or(uri), "http_referrer": _or(part(6)), "http_user_agent": _or(part(7)),
        "http_status": part(4), "bytes_out": F.nullif(part(5), F.lit("-")),
    }
    return Parsed(("HOST", ids.host_id(host), host), ("URL", ids.url_id(host, uri), uri), "ACCESS", part(1), None, fields, F.col("_parts").isNotNull()).struct()


def _value(key: str) -> Column:
    """The value of a key in the arrays of pairs; null where it is missing."""
    return F.expr(f"get(_values, cast(array_position(_keys, '{key}') AS int) - 1)")


def parse_sysmon(raw: Column, host: Column) -> Column:
    eid = ids.to_int(F.regexp_extract(raw, r"<EventID>(\d+)</EventID>", 1))
    computer = F.coalesce(_or(F.regexp_extract(raw, r"<Computer>([^<]+)</Computer>", 1)), host)
    image, command, parent = _value("Image"), _value("CommandLine"), _value("ParentCommandLine")
    fields = {
        "event_id": eid, "process_id": _value("ProcessId"), "image": image, "process_name": ids.basename(image), "command_line": command,
        "parent_command_line": parent, "parent_image": _value("ParentImage"), "user": _value("User"), "integrity_level": _value("IntegrityLevel"),
        "registry_key": _value("TargetObject"), "registry_value": _value("Details"),
    }
    table = F.create_map(*[F.lit(x) for kv in SYSMON_EDGES.items() for x in kv])
    edge = F.coalesce(F.element_at(table, eid.cast("int")), F.lit("EXEC"))
    me, name = ids.proc_id(computer, _value("ProcessId"), image), F.coalesce(command, ids.basename(image))
    path = F.coalesce(_value("TargetFilename"), _value("TargetObject"))
    protocol = F.lower(F.coalesce(_value("Protocol"), F.lit("tcp")))
    net = known(fields | {"dest_port": _value("DestinationPort"), "src_port": _value("SourcePort"), "transport": protocol})
    fields = known(fields)
    process = ("PROCESS", me, name)
    by_event = {
        (1,): Parsed(("PROCESS", ids.proc_id(computer, _value("ParentProcessId"), _value("ParentImage")), F.coalesce(parent, _value("ParentImage"))), process, "FORK", fields=fields),
        (12, 13, 14): Parsed(process, ("REGISTRY", ids.registry_id(computer, _value("TargetObject")), _value("TargetObject")), "MODIFY_REG", fields=fields),
        (2, 11, 15, 23, 26): Parsed(process, ("FILE", ids.file_id(computer, path), path), edge, fields=fields),
        (3,): Parsed(
            process,
            ("SOCKET", ids.socket_id(_value("SourceIp"), _value("SourcePort"), _value("DestinationIp"), _value("DestinationPort"), protocol), _end(_value("DestinationIp"), _value("DestinationPort"))),
            "CONNECT", _value("SourceIp"), _value("DestinationIp"), net,
        ),
        (7,): Parsed(process, ("FILE", ids.file_id(computer, _value("ImageLoaded")), _value("ImageLoaded")), "LOAD", fields=fields),
    }
    out = F.when(eid.isNull(), F.lit(None))
    for events, parsed in by_event.items():
        out = out.when(eid.isin(*events), parsed.struct())
    return out.otherwise(Parsed(process, edge=edge, fields=fields).struct())


def parse_pan(raw: Column, host: Column) -> Column:
    get = {k: F.expr(f"nullif(trim(get(_parts, {i})), '')") for k, i in PAN_POSITIONS.items()}
    return _flow(get["src_ip"], get["src_port"], get["dest_ip"], get["dest_port"], F.coalesce(get["transport"], F.lit("tcp")), get, F.col("_parts").isNotNull()).struct()


def parse_mysql(raw: Column, host: Column) -> Column:
    user, at = _or(_value("user"), _value("USER")), _or(_value("hostname"), host)
    duration = F.floor(_value("Duration").try_cast("double") * 1000).cast("long")
    fields = {
        "user": user, "event_id": _value("EVENT_ID"), "duration": duration, "command_line": _or(_value("SQL_TEXT"), _value("sql_text")),
        "site": _or(_value("database_name"), _value("database")), "dest_port": _value("port"),
    }
    return Parsed(("USER", ids.user_id(at, user), user), ("HOST", ids.host_id(at), at), "ACCESS", fields=fields, valid=user.isNotNull() & at.isNotNull()).struct()


def parse_winhostmon(raw: Column, host: Column) -> Column:
    image, pid, name, command = _or(_value("Path"), _value("ProcessImage")), _or(_value("ProcessId"), _value("PID")), _value("Name"), _value("CommandLine")
    port, protocol = _value("LocalPort"), _or(_value("Protocol"), _value("transport"))
    fields = {"image": image, "process_name": F.coalesce(ids.basename(image), name), "command_line": command, "dest_port": port, "transport": protocol}
    fields = known(fields)
    me = ("PROCESS", ids.proc_id(host, pid, F.coalesce(image, name)), F.coalesce(command, image, name))
    listening = ("SOCKET", F.concat(F.lit("sock:*:"), port, F.lit("/"), F.lower(F.coalesce(protocol, F.lit("tcp")))), F.concat(F.lit("*:"), port))
    some = F.size("_keys") > 0
    return F.when(port.isNotNull(), Parsed(me, listening, "CONNECT", fields=fields, valid=some).struct()).otherwise(Parsed(me, fields=fields, valid=some).struct())


def parse_audit(raw: Column, host: Column) -> Column:
    exe, command, call, name = _or(_value("exe"), _value("comm")), _value("proctitle"), _value("syscall"), _value("name")
    fields = {"image": exe, "process_name": ids.basename(exe), "command_line": command, "user": _or(_value("uid"), _value("auid")), "process_id": _value("pid")}
    fields, edge = known(fields), F.lit(None).cast("string")
    for kind, calls in SYSCALL_EDGES.items():
        edge = F.when(call.isin(*calls), kind).otherwise(edge)
    me, some = ("PROCESS", ids.proc_id(host, _value("pid"), exe), F.coalesce(command, exe)), F.size("_keys") > 0
    to_file = name.isNotNull() & edge.isin("READ", "WRITE", "DELETE", "RENAME", "EXEC")
    on_file = Parsed(me, ("FILE", ids.file_id(host, name), name), edge, fields=fields, valid=some)
    return F.when(to_file, on_file.struct()).otherwise(Parsed(me, edge=edge, fields=fields, valid=some).struct())


def parse_winregistry(raw: Column, host: Column) -> Column:
    image, key, data = _value("process_image"), _value("key_path"), _value("data")
    value = F.when(F.length(data) < 200, data).otherwise(_value("registry_type"))
    fields = {"image": image, "process_name": ids.basename(image), "user": _value("user"), "registry_key": key, "registry_value": value, "process_id": _value("pid")}
    return Parsed(("PROCESS", ids.proc_id(host, _value("pid"), image), image), ("REGISTRY", ids.registry_id(host, key), key), "MODIFY_REG", fields=fields, valid=F.size("_keys") > 0).struct()


def _nested_schema(paths: dict[str, str]) -> str:
    """The schema of the (at most twice nested) values that paths like ``$.a.b`` name, all of them text."""
    top: dict[str, list[str]] = {}
    for path in paths.values():
        first, *rest = path.removeprefix("$.").split(".")
        top.setdefault(first, []).extend(rest)
    return ", ".join(f"{k} struct<{', '.join(f'{c}: string' for c in inner)}>" if inner else f"{k} string" for k, inner in top.items())


def _sysmon_type(s: Column) -> Column:
    return (s.startswith("XmlWinEventLog") & s.contains("Sysmon")) | (s == "mordor_sysmon")


#: (which sourcetypes, parser), in order of precedence; others give a row without a triple.
PARSERS: list[tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = [
    (lambda s: s.startswith("stream_"), parse_stream),
    (lambda s: s == "suricata", parse_suricata),
    (lambda s: s.isin("access_combined", "WebLogic_Access_Combined"), parse_access),
    (_sysmon_type, parse_sysmon),
    (lambda s: s == "pan_traffic", parse_pan),
    (lambda s: s.startswith("mysql_"), parse_mysql),
    (lambda s: s == "WinHostMon", parse_winhostmon),
    (lambda s: s == "WinRegistry", parse_winregistry),
    (lambda s: s.isin("linux_audit", "auditd"), parse_audit),
]


def _pairs(raw: Column, sourcetype: Column) -> Column:
    """Pairs (k, v) of the key-value formats, without empty values, in the order in which the first one counts."""

    def found(pattern: str, groups: int) -> Column:
        of = lambda i: F.regexp_extract_all(raw, F.lit(pattern), F.lit(i))
        value = of(2) if groups == 2 else F.zip_with(of(2), of(3), lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b))
        return F.filter(F.zip_with(of(1), value, lambda k, v: F.struct(k.alias("k"), v.alias("v"))), lambda p: F.length(p["v"]) > 0)

    kv = F.when(_sysmon_type(sourcetype), F.reverse(found(SYSMON_DATA, 2)))  # the last of equal names counts
    kv = kv.when(sourcetype.startswith("mysql_"), F.reverse(found(QUOTED_PAIR, 2)))
    kv = kv.when(sourcetype == "WinHostMon", found(LINE_PAIR, 3))
    return kv.when(sourcetype.isin("linux_audit", "auditd", "WinRegistry"), found(AUDIT_PAIR, 3))


def _parts(raw: Column, sourcetype: Column) -> Column:
    """The values of the formats that go by position; null where a line is of another format or does not have its form."""
    fields = F.split(F.substring(raw, F.instr(raw, " 1,") + 1, F.length(raw)), ",")
    groups = F.array(*[F.regexp_extract(raw, ACCESS_LINE, i) for i in range(1, 8)])
    access = sourcetype.isin("access_combined", "WebLogic_Access_Combined")
    return F.when((sourcetype == "pan_traffic") & (F.instr(raw, " 1,") > 0), fields).when(access & raw.rlike(ACCESS_LINE), groups)


def parse_logs(df: DataFrame, raw: str = "_raw", host: str = "host", sourcetype: str = "sourcetype") -> DataFrame:
    """``df`` with subject_*, object_*, edge_type, src_ip, dest_ip and fields (map); all null where a line does not parse."""
    r, h, s = F.col(raw), F.col(host), F.col(sourcetype)
    json = F.when(s.startswith("stream_") | (s == "suricata"), F.from_json(r, "map<string,string>"))
    nested = F.when(s == "suricata", F.from_json(r, _nested_schema(SURICATA_PATHS)))
    pairs = _pairs(r, s)
    # inline() keeps each step in an operator of its own: what follows refers to its columns and does not repeat it
    step = F.struct(F.transform(pairs, lambda p: p["k"]).alias("_keys"), F.transform(pairs, lambda p: p["v"]).alias("_values"), json.alias("_json"), nested.alias("_nested"), _parts(r, s).alias("_parts"))
    ready = df.select("*", F.inline(F.array(step)))
    parsed = F.when(F.length(r) == 0, F.lit(None))
    for which, parser in PARSERS:
        parsed = parsed.when(which(s), parser(r, h))
    return ready.select(*df.columns, F.inline(F.array(parsed)))
