"""Architecture rules: each is a filter or an aggregation over edges and nodes, and yields violations."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import globs, paths
from graphloom.operators import analysis, iterate
from graphloom.operators.graph import CodeGraph
from graphloom.schema import SEVERITIES, rank
from graphloom.shared import written

COLUMNS = ["rule_id", "severity", "description", "source_file", "target_file", "imported_names", "line", "confidence", "rationale", "fix_direction"]


@dataclass(frozen=True)
class Rule:
    """One rule: ``kind`` names the operator, ``settings`` its parameters."""

    id: str
    severity: str
    description: str
    kind: str
    settings: dict
    rationale: str | None = None
    fix_direction: str | None = None


@dataclass(frozen=True)
class LintConfig:
    rules: list[Rule]
    tags: dict[str, list[str]] = field(default_factory=dict)


class Evaluation:
    """Rules over one graph; what several rules need is built once."""

    def __init__(self, g: CodeGraph, tags: dict[str, list[str]] | None = None, root: str = ""):
        rel = paths.relative(F.col("path"), root) if root else F.col("path")
        self.g, self.tags = g, tags or {}
        self.nodes = g.nodes.select("id", rel.alias("rel"))
        ends = self.nodes
        self.edges = g.edges.join(ends.select(F.col("id").alias("src"), F.col("rel").alias("s")), "src").join(ends.select(F.col("id").alias("dst"), F.col("rel").alias("t")), "dst")
        self._cycles: DataFrame | None = None

    def cycles(self) -> DataFrame:
        """All cycles, module declarations included; shared by all rules on cycles."""
        if self._cycles is None:
            self._cycles = written(iterate.components(self.g.known_edges), "cycles")
        return self._cycles

    def run(self, rule: Rule) -> DataFrame:
        """(source_file, target_file, imported_names, line) of a rule, with the rule's own columns."""
        rows = getattr(self, rule.kind)(rule.settings)
        text = lambda x: F.lit(x).cast("string")
        return rows.select(text(rule.id).alias("rule_id"), text(rule.severity).alias("severity"), text(rule.description).alias("description"), "source_file", "target_file", "imported_names", F.col("line").cast("long").alias("line"), F.lit("certain").alias("confidence"), text(rule.rationale).alias("rationale"), text(rule.fix_direction).alias("fix_direction"))

    def _edge_rows(self, condition: Column, names: Column | None = None) -> DataFrame:
        return self.edges.where(condition).select(F.col("s").alias("source_file"), F.col("t").alias("target_file"), (F.col("imported_names") if names is None else names).alias("imported_names"), "line")

    @staticmethod
    def _node_rows(df: DataFrame, path: str = "rel") -> DataFrame:
        none = F.array().cast("array<string>")
        return df.select(F.col(path).alias("source_file"), F.col(path).alias("target_file"), none.alias("imported_names"), F.lit(0).alias("line"))

    def boundary(self, c: dict) -> DataFrame:
        m = globs.file_matcher
        return self._edge_rows(m(F.col("s"), c["from"]) & m(F.col("t"), c["deny"]) & ~m(F.col("t"), c.get("except", [])))

    def layer(self, c: dict) -> DataFrame:
        """Layers from the top; a file's layer is the first that matches, and imports may only go down."""

        def place(p: Column) -> Column:
            return F.coalesce(*(F.when(globs.file_matcher(p, x["patterns"]), F.lit(i)) for i, x in enumerate(c["layers"])), F.lit(None).cast("int"))

        return self._edge_rows(place(F.col("s")) > place(F.col("t")))

    def containment(self, c: dict) -> DataFrame:
        m = globs.file_matcher
        return self._edge_rows(~m(F.col("s"), c["module"]) & m(F.col("t"), c["module"]) & ~m(F.col("t"), c["public_api"]))

    def import_restriction(self, c: dict) -> DataFrame:
        to = globs.file_matcher(F.col("t"), c["target"])
        out = []
        if c.get("require_type_only"):
            out.append(self._edge_rows(to & ~F.col("is_type_only")))
        if c.get("forbidden_names"):
            bad = F.filter("imported_names", lambda n: n.isin(c["forbidden_names"]))
            out.append(self._edge_rows(to & (F.size(bad) > 0), bad))
        if c.get("allowed_names"):
            bad = F.filter("imported_names", lambda n: ~n.isin(c["allowed_names"]))
            out.append(self._edge_rows(to & (F.size(bad) > 0), bad))
        if not out:
            return self._edge_rows(F.lit(False))
        first = out[0]
        for d in out[1:]:
            first = first.unionByName(d)
        return first

    def _fan(self, key: str, other: str, name: str) -> DataFrame:
        return self.g.edges.groupBy(F.col(key).alias("id")).agg(F.countDistinct(other).alias(name))

    def fan_limit(self, c: dict) -> DataFrame:
        own = self.nodes.where(globs.file_matcher(F.col("rel"), c["pattern"]))
        out = None
        for key, other, most in (("src", "dst", c.get("max_fan_out")), ("dst", "src", c.get("max_fan_in"))):
            if most is not None:
                rows = self._node_rows(own.join(self._fan(key, other, "n"), "id").where(F.col("n") > most))
                out = rows if out is None else out.unionByName(rows)
        return self._node_rows(own.where("false")) if out is None else out

    def cycle_policy(self, c: dict) -> DataFrame:
        """A row per too long cycle with a member that matches; the smallest such path stands for it."""
        parts = self.cycles().join(self.nodes, "id").withColumn("m", globs.file_matcher(F.col("rel"), c.get("pattern", ["**"])))
        found = parts.groupBy("component").agg(F.count("*").alias("n"), F.min(F.when(F.col("m"), F.col("rel"))).alias("rel"))
        return self._node_rows(found.where((F.col("n") > c.get("max_cycle_length", 0)) & F.col("rel").isNotNull()))

    def stability_limit(self, c: dict) -> DataFrame:
        zero = F.lit(0)
        n = self.nodes.where(globs.file_matcher(F.col("rel"), c["pattern"])).join(self._fan("src", "dst", "o"), "id", "left").join(self._fan("dst", "src", "i"), "id", "left")
        o, i = F.coalesce("o", zero), F.coalesce("i", zero)
        return self._node_rows(n.where((o + i > 0) & (o / F.nullif(o + i, zero) > c["max_instability"])))

    def naming_boundary(self, c: dict) -> DataFrame:
        re.compile(c["must_match"])
        return self._node_rows(self.nodes.where(globs.file_matcher(F.col("rel"), c["pattern"]) & ~F.col("rel").rlike(c["must_match"])))

    def restricted_consumer(self, c: dict) -> DataFrame:
        m = globs.file_matcher
        return self._edge_rows(m(F.col("t"), c["target"]) & ~m(F.col("s"), c["allowed_consumers"]))

    def export_limit(self, c: dict) -> DataFrame:
        n = self.g.exports.groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("n"))
        own = self.nodes.where(globs.file_matcher(F.col("rel"), c["pattern"])).join(n, "id", "left")
        return self._node_rows(own.where(F.coalesce("n", F.lit(0)) > c["max_exports"]))

    def coupling_weight(self, c: dict) -> DataFrame:
        return self._edge_rows(globs.file_matcher(F.col("s"), c["pattern"]) & (F.size("imported_names") > c["max_names"]))

    def cohesion(self, c: dict) -> DataFrame:
        """Per directory the share of its files' imports that leave it."""
        here = lambda p: F.when(paths.parent(p) == "", ".").otherwise(paths.parent(p))
        own = self.edges.where(globs.file_matcher(F.col("s"), c["pattern"]))
        per = own.groupBy(here(F.col("s")).alias("directory")).agg(F.count("*").alias("n"), F.count_if(here(F.col("s")) != here(F.col("t"))).alias("x"))
        return self._node_rows(per.where(F.col("x") / F.col("n") > c["max_external_ratio"]), "directory")

    def tag_boundary(self, c: dict) -> DataFrame:
        """A row per edge and denied tag of its target."""
        m = lambda p, tag: globs.file_matcher(p, self.tags.get(tag, []))
        spared = F.lit(False)
        for t in c.get("except_tags", []):
            spared = spared | m(F.col("t"), t)
        denied = F.array(*(F.when(m(F.col("t"), t), F.lit(t)) for t in c["deny_tags"]))
        hit = self.edges.where(m(F.col("s"), c["from_tag"]) & ~spared).withColumn("tag", F.explode(F.array_compact(denied)))
        return hit.select(F.col("s").alias("source_file"), F.col("t").alias("target_file"), "imported_names", "line")


def evaluate(config: LintConfig, g: CodeGraph, root: str = "", only: str | None = None, threshold: str = "info") -> DataFrame:
    """Violations of all rules, or of rule ``only``; severities below ``threshold`` are left out."""
    rules = [r for r in config.rules if only is None or r.id == only]
    if only is not None and not rules:
        raise ValueError(f"no rule {only}")
    ev = Evaluation(g, config.tags, root)
    out = None
    for r in rules:
        rows = ev.run(r)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = ev.run(Rule("", "info", "", "boundary", {"from": [], "deny": []}))
    return at_least(out, threshold)


def at_least(violations: DataFrame, threshold: str) -> DataFrame:
    return violations.where(rank(F.col("severity"), SEVERITIES) <= SEVERITIES.index(threshold))


def ordered(violations: DataFrame) -> DataFrame:
    return violations.orderBy(rank(F.col("severity"), SEVERITIES), "source_file", "line")


def summary(violations: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("severity") == s)
    return violations.agg(F.count("*").alias("total_violations"), n("error").alias("errors"), n("warning").alias("warnings"), n("info").alias("infos"), F.countDistinct("rule_id").cast("long").alias("rules_violated"))


def suppress(violations: DataFrame, baseline: DataFrame) -> DataFrame:
    """Violations that the baseline (rule_id, source_file, target_file, line) doesn't know."""
    return violations.join(baseline, ["rule_id", "source_file", "target_file", "line"], "left_anti").select(*violations.columns)
