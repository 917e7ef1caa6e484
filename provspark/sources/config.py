"""Rules, indicators and technique tables: small configuration files, read on the driver."""

from __future__ import annotations

import re
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIBRARY = Path(__file__).with_name("rules.yml")
TECHNIQUES = Path(__file__).with_name("techniques.yml")


def parse_step(step: dict[str, Any]) -> dict[str, Any]:
    """A sigma-style step {subject: {type, name|re}, edge, object: {...}} as a flat condition."""
    subject, obj = step.get("subject") or {}, step.get("object") or {}
    return {
        "subject_type": subject.get("type"), "subject_re": subject.get("name|re"), "edge": step.get("edge"),
        "object_type": obj.get("type"), "object_re": obj.get("name|re"),
    }


def parse_rule(raw: dict[str, Any]) -> dict[str, Any]:
    """A sigma-style rule as {id, name, severity, mitre, description, steps, window, tags}."""
    detection = raw.get("detection") or {}
    if detection.get("condition") == "sequence":
        steps = [parse_step(s) for named in detection["sequence"]["steps"] for s in named.values()]
        window = detection["sequence"].get("window", 300)
    elif detection.get("condition") == "selection":
        steps, window = [parse_step(detection["selection"])], None
    else:
        raise ValueError(f"rule {raw.get('id')}: the condition must be selection or sequence")
    tags = raw.get("tags") or []
    found = [m.group(1).upper() for t in tags if (m := re.match(r"(?i)attack\.(t\d{4}(?:\.\d{3})?)", t))]
    return {
        "id": raw["id"], "name": raw.get("title", raw["id"]), "severity": raw.get("severity", "medium"), "mitre": found[0] if found else None,
        "description": raw.get("description", ""), "steps": steps, "window": window, "tags": tags,
    }


def load_rules(folder: str) -> tuple[list[dict[str, Any]], list[str]]:
    """(rules, problems): all ``*.yml`` rules of a folder; bad files are reported and skipped."""
    import yaml

    rules, problems = [], []
    for path in sorted(Path(folder).glob("*.yml")):
        try:
            rules.append(parse_rule(yaml.safe_load(path.read_text(encoding="utf-8"))))
        except (yaml.YAMLError, ValueError, KeyError, AttributeError, TypeError) as problem:
            problems.append(f"{path.name}: {problem}")
    return rules, problems


def rule_library(disabled: bool = False) -> list[dict[str, Any]]:
    """The rules that come with the library; ``disabled`` adds those that are off by default."""
    import yaml

    rows = yaml.safe_load(LIBRARY.read_text(encoding="utf-8"))
    return [{**parse_rule(r), "description": r["title"]} for r in rows if disabled or not r.get("disabled")]


def load_iocs(raw: dict[str, Any]) -> list[dict[str, Any]]:
    """Scenarios {id, patterns, start, end} of an indicator file's content.

    Only enabled scenarios and the listed categories count; patterns are
    lower-cased, distinct, long enough (exempt categories aside) and not blocked.
    """
    labeling = raw.get("labeling") or {}
    categories, blocked = labeling.get("match_categories") or [], {b.lower() for b in labeling.get("blocklist_patterns") or []}
    least, exempt = labeling.get("min_ioc_specificity") or 0, set(labeling.get("length_exempt_categories") or ())
    out = []
    for s in raw.get("scenarios") or []:
        if not s.get("enabled", True):
            continue
        patterns = [p.lower() for c in categories for p in map(str, s.get(c) or []) if p.lower() not in blocked and (c in exempt or len(p) >= least)]
        window = s.get("time_window") or {}
        out.append({"id": s["id"], "patterns": list(dict.fromkeys(patterns)), "start": window.get("start", -(2**62)), "end": window.get("end", 2**62)})
    return out


def load_techniques(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, tactic, desc, edges, sourcetypes, keywords) of a technique table."""
    kind = "techniques array<struct<id:string,name:string,tactic:string,desc:string,triggers:struct<edges:array<string>,sourcetypes:array<string>,keywords:array<string>>>>"
    t = spark.read.schema(kind).json(path, multiLine=True).select(F.explode("techniques").alias("t")).select("t.*")
    listed = lambda k: F.coalesce(F.col(f"triggers.{k}"), F.array().cast("array<string>"))
    return t.select(
        "id", "name", "tactic", F.coalesce("desc", F.lit("")).alias("desc"), listed("edges").alias("edges"), listed("sourcetypes").alias("sourcetypes"),
        F.transform(listed("keywords"), F.lower).alias("keywords"),
    )


def techniques_frame(spark: SparkSession, rows: list[dict[str, Any]]) -> DataFrame:
    values = [(t["id"], t["name"], t["tactic"], t.get("desc", ""), t.get("edges") or [], t.get("sourcetypes") or [], [k.lower() for k in t.get("keywords") or []]) for t in rows]
    return spark.createDataFrame(values, "id string, name string, tactic string, desc string, edges array<string>, sourcetypes array<string>, keywords array<string>")


def technique_library(spark: SparkSession) -> DataFrame:
    import yaml

    return techniques_frame(spark, yaml.safe_load(TECHNIQUES.read_text(encoding="utf-8")))
