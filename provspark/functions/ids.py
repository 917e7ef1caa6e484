"""Identifiers, small scalar functions and safe conversions, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TEXT, MAX_ID = 100, 200


def present(c: Column) -> Column:
    """Null for an empty string, else the value."""
    return F.nullif(c.cast("string"), F.lit(""))


def basename(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot, or null."""
    base = basename(path)
    return F.when(F.instr(base, ".") > 0, F.concat(F.lit("."), F.lower(F.substring_index(base, ".", -1))))


def parent_dir(path: Column) -> Column:
    """Everything before the last slash, lower-cased; null without one."""
    unix = F.replace(path, F.lit("\\"), F.lit("/"))
    return present(F.lower(F.regexp_extract(unix, r"^(.*)/[^/]*$", 1)))


def proc_id(host: Column, pid: Column, image: Column) -> Column:
    known = F.trim(pid.cast("string"))
    head = F.concat(F.lit("proc:"), F.coalesce(present(host), F.lit("?")), F.lit(":"))
    base = present(basename(image))
    return F.when(pid.isNotNull() & ~known.isin("", "0"), F.concat(head, pid.cast("string"))).when(base.isNotNull(), F.concat(head, base))


def _located(kind: str, host: Column, what: Column) -> Column:
    head = F.concat(F.lit(f"{kind}:"), F.coalesce(present(host), F.lit("?")), F.lit(":"))
    return F.substring(F.concat(head, F.lower(present(what))), 1, MAX_ID)


def file_id(host: Column, path: Column) -> Column:
    return _located("file", host, path)


def registry_id(host: Column, key: Column) -> Column:
    return _located("reg", host, key)


def socket_id(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column, transport: Column) -> Column:
    part = lambda c: F.coalesce(present(c), F.lit("?"))
    made = F.concat(
        F.lit("sock:"), part(src_ip), F.lit(":"), part(src_port), F.lit("->"), part(dst_ip), F.lit(":"), part(dst_port), F.lit("/"), F.lower(part(transport))
    )
    return F.when(present(src_ip).isNotNull() | present(dst_ip).isNotNull(), made)


def url_id(site: Column, uri: Column) -> Column:
    both = F.concat(F.coalesce(site, F.lit("")), F.coalesce(uri, F.lit("")))
    return F.when(present(both).isNotNull(), F.substring(F.concat(F.lit("url:"), both), 1, MAX_ID))


def host_id(host: Column) -> Column:
    return F.concat(F.lit("host:"), present(host))


def user_id(host: Column, user: Column) -> Column:
    return F.concat(F.lit("user:"), F.coalesce(present(host), F.lit("?")), F.lit(":"), F.lower(present(user)))


def trunc100(c: Column) -> Column:
    return F.substring(c.cast("string"), 1, MAX_TEXT)


def to_int(c: Column) -> Column:
    """Integer value of a text; null where it is none."""
    return F.when(F.trim(c.cast("string")).rlike(r"^[+-]?\d{1,18}$"), F.trim(c.cast("string")).cast("long"))


def is_private_ip(ip: Column) -> Column:
    """RFC 1918 ranges; a missing address counts as private."""
    return F.coalesce(ip.rlike(r"^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)"), F.lit(True))


def external_ip(src: Column, dst: Column) -> Column:
    """The first public end of a connection, else the destination."""
    return F.when(~is_private_ip(src), src).otherwise(dst)


def event_id(actor: Column, obj: Column, action: Column, timestamp: Column) -> Column:
    return F.sha1(F.concat_ws("|", actor, obj, action, timestamp.cast("string")).cast("binary"))


def to_epoch(c: Column) -> Column:
    """Epoch seconds of a number (seconds or milliseconds) or of one of four timestamp formats."""
    number = to_int(c)
    text = F.trim(c.cast("string"))
    at = F.coalesce(
        F.try_to_timestamp(F.regexp_replace(text, r"\.\d+", ""), F.lit("yyyy-MM-dd'T'HH:mm:ssX")),
        F.try_to_timestamp(F.regexp_replace(text, r"\.\d+", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss")),
        F.try_to_timestamp(F.regexp_replace(text, r"\.\d+", ""), F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd")),
    )
    return F.when(number > 100_000_000_000, F.floor(number / 1000)).when(number.isNotNull(), number).otherwise(F.unix_timestamp(at)).cast("long")


def is_placeholder_name(name: Column) -> Column:
    """``type:uuid`` stands for a name that is not known yet."""
    return name.rlike(r"^[a-z]+:[0-9a-fA-F-]+$")


def subtokens(text: Column) -> Column:
    """Lower-cased path parts without numbers and without parts of 40 characters and more."""
    parts = F.split(F.lower(text), r"[\\/.:\-_]+")
    return F.filter(parts, lambda p: (F.length(p) > 0) & (F.length(p) < 40) & ~p.rlike(r"^\d+$"))


def stable_bucket(label: Column, rank: Column, seed: int = 42) -> Column:
    """0 to 99, equal wherever and whenever it is computed."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), label.cast("string"), rank.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100


def content_hash(*cols: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]).cast("binary"), 256)


def confidence_number(word: Column) -> Column:
    low = F.lower(word)
    return F.when(low == "high", 0.9).when(low == "medium", 0.6).when(low == "low", 0.3).otherwise(0.5)


def severity_of(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "critical").when(confidence >= 0.7, "high").when(confidence >= 0.4, "medium").otherwise("low")


def to_instant(epoch: Column) -> Column:
    """Timestamp of epoch milliseconds or seconds."""
    return F.when(epoch > 100_000_000_000, F.timestamp_millis(epoch)).otherwise(F.timestamp_seconds(epoch))


def mitre_agreement(a: Column, b: Column) -> Column:
    """exact, parent (same technique, other sub-technique), conflict, one_null or both_null."""
    x, y = F.upper(present(F.trim(a))), F.upper(present(F.trim(b)))
    return (
        F.when(x.isNull() & y.isNull(), "both_null").when(x.isNull() | y.isNull(), "one_null").when(x == y, "exact")
        .when(F.substring_index(x, ".", 1) == F.substring_index(y, ".", 1), "parent").otherwise("conflict")
    )


def attack_id(tags: Column) -> Column:
    """The first ATT&CK technique among Sigma-style tags, upper-cased."""
    found = F.filter(tags, lambda t: t.rlike(r"(?i)^attack\.t\d{4}"))
    return F.upper(F.regexp_extract(F.get(found, F.lit(0)), r"(?i)^attack\.(t\d{4}(?:\.\d{3})?)", 1))


def ascii_clean(s: Column, length: int = 250) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(s, r"[^\x20-\x7E]+", " "), r"\s+", " ")), 1, length)


def rule_number(rule_id: Column) -> Column:
    """A stable number from 100000 to 108999: the SHA-1 of the id as one number, modulo 9000."""
    digits = F.split(F.sha1(rule_id.cast("binary")), "")
    rest = F.aggregate(digits, F.lit(0), lambda r, d: ((r * 16 + F.instr(F.lit("0123456789abcdef"), d) - 1) % 9000).cast("int"))
    return rest + 100_000


def severity_level(severity: Column) -> Column:
    s = F.lower(severity)
    return F.when(s == "critical", 14).when(s == "high", 12).when(s == "medium", 7).when(s == "low", 4).when(s == "informational", 3).otherwise(7)


def parsed_json(text: Column, schema: str) -> Column:
    """Parsed JSON, with an empty array or map where the text is none."""
    empty = F.array().cast(schema) if schema.startswith("array") else F.create_map().cast(schema)
    return F.coalesce(F.from_json(text, schema), empty)
