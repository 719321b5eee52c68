"""Settings files: rules, entry points, path aliases, crate metadata and baselines."""

from __future__ import annotations

import json
import re
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.globs import glob_regex
from graphloom.operators.lint import LintConfig, Rule
from graphloom.operators.resolve import Cargo, TsConfig
from graphloom.schema import SEVERITIES

#: Where rules are looked for below a project's folder.
RULES = (".graphloom/rules.toml", "graphloom.toml")
KINDS = ("boundary", "layer", "containment", "import_restriction", "fan_limit", "cycle_policy", "stability_limit", "naming_boundary", "restricted_consumer", "export_limit", "coupling_weight", "cohesion", "tag_boundary")
ANNOTATIONS = ("SpringBootApplication", "RestController", "Controller", "Service", "Component", "Repository", "Configuration", "Bean", "Test", "Entity", "WebServlet", "Path", "Scheduled")
BASELINE = "rule_id STRING, source_file STRING, target_file STRING, line BIGINT"


def find_rules(root: str, override: str | None = None) -> Path | None:
    if override is not None:
        if not Path(override).is_file():
            raise FileNotFoundError(override)
        return Path(override)
    return next((Path(root, r) for r in RULES if Path(root, r).is_file()), None)


def parse_rules(text: str) -> LintConfig:
    """Each entry of ``rules`` has an id, a severity, a description and exactly one table named after its kind."""
    spec = tomllib.loads(text)
    if "rules" not in spec:
        raise ValueError("rules is missing")
    out, seen = [], set()
    for r in spec["rules"]:
        kinds = [k for k in KINDS if k in r]
        if len(kinds) != 1:
            raise ValueError(f"rule {r.get('id')}: one of {', '.join(KINDS)} is needed")
        if r["severity"] not in SEVERITIES:
            raise ValueError(f"rule {r['id']}: severity {r['severity']}")
        if r["id"] in seen:
            raise ValueError(f"rule {r['id']} occurs twice")
        seen.add(r["id"])
        for g in _globs(r[kinds[0]]):
            glob_regex(g.removeprefix("!"))
        if kinds[0] == "naming_boundary":
            re.compile(r["naming_boundary"]["must_match"])
        out.append(Rule(r["id"], r["severity"], r["description"], kinds[0], r[kinds[0]], r.get("rationale"), r.get("fix_direction")))
    return LintConfig(out, spec.get("tags") or {})


def _globs(settings: dict) -> list[str]:
    names = ("from", "deny", "except", "module", "public_api", "target", "pattern", "allowed_consumers")
    own = [g for n in names for g in (settings.get(n) if isinstance(settings.get(n), list) else [])]
    return own + [g for x in settings.get("layers", []) for g in x["patterns"]]


def entry_points(text: str | None) -> tuple[list[str], list[str]]:
    """(patterns, annotations) that mark entry points; any error gives the defaults."""
    try:
        own = (tomllib.loads(text) if text else {}).get("entry_points") or {}
        return list(own.get("patterns", [])), [*ANNOTATIONS, *own.get("annotations", [])]
    except (tomllib.TOMLDecodeError, AttributeError, TypeError):
        return [], list(ANNOTATIONS)


def tsconfig(text: str | None, root: str = "") -> TsConfig | None:
    try:
        return None if text is None else TsConfig.of(json.loads(text).get("compilerOptions") or {}, root)
    except (ValueError, AttributeError):
        return None


def cargo(text: str | None) -> Cargo | None:
    try:
        return None if text is None else Cargo.of(tomllib.loads(text))
    except tomllib.TOMLDecodeError:
        return None


def _at(spark: SparkSession, path: str):
    """A path and its file system, whichever kind that is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path if "://" in path or path.startswith("file:") else "file://" + str(Path(path).resolve()))
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_baseline(spark: SparkSession, path: str) -> DataFrame | None:
    """Known violations, or None without the file, which may be on any file system that the session reads."""
    p, fs = _at(spark, path)
    if not fs.exists(p):
        return None
    schema = f"version INT, created STRING, violations ARRAY<STRUCT<{BASELINE.replace(' STRING', ': STRING').replace(' BIGINT', ': BIGINT')}>>"
    return spark.read.schema(schema).json(p.toString(), multiLine=True).select(F.explode("violations").alias("v")).select("v.*")


def write_baseline(violations: DataFrame, path: str) -> int:
    """Freezes violations as one JSON file; returns their number. Rows are streamed through the driver a partition at a time, as the file is a single one."""
    spark = violations.sparkSession
    rows = violations.select("rule_id", "source_file", "target_file", "line").distinct().orderBy("rule_id", "source_file", "target_file", "line")
    now = spark.sql("select date_format(to_utc_timestamp(current_timestamp(), current_timezone()), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")").first()[0]
    p, fs = _at(spark, path)
    out, n = fs.create(p, True), 0
    put = lambda text: out.write(bytearray(text.encode()))
    put(f'{{\n  "version": 1,\n  "created": {json.dumps(now)},\n  "violations": [')
    for r in rows.toLocalIterator():
        body = json.dumps(r.asDict(), indent=2).replace("\n", "\n    ")
        put(("," if n else "") + "\n    " + body)
        n += 1
    put(("\n  " if n else "") + "]\n}\n")
    out.close()
    return n
