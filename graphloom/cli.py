"""Commands over a project: ``python -m graphloom.cli COMMAND ...``; results as text, JSON or CSV."""

from __future__ import annotations

import argparse
import csv
import json
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import paths, post
from graphloom.operators import analysis, lint
from graphloom.operators.graph import CodeGraph, find_file
from graphloom.sources import configs, index, scan, store


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom")
    p.add_argument("--root", default=".")
    for flag in ("--runtime-only", "--reverse", "--count", "--no-index"):
        p.add_argument(flag, action="store_true")
    p.add_argument("--path-filter")
    p.add_argument("--format", choices=("text", "json", "compact", "csv"), default="text")
    p.add_argument("--sort")
    p.add_argument("--limit", type=int)
    p.add_argument("--jq")
    p.add_argument("--include", action="append", default=[])
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--lang", action="append", default=[])
    c = p.add_subparsers(dest="command", required=True)
    c.add_parser("index")
    d = c.add_parser("deps")
    d.add_argument("path", nargs="?")
    d.add_argument("--transitive", action="store_true")
    d.add_argument("--direction", default="both")
    d.add_argument("--max-depth", type=int)
    d.add_argument("--between", nargs=2)
    c.add_parser("exports").add_argument("path")
    c.add_parser("dead-code").add_argument("--scope", default="both")
    c.add_parser("cycles")
    i = c.add_parser("impact")
    i.add_argument("path")
    i.add_argument("--max-depth", type=int)
    c.add_parser("summary").add_argument("--by-directory", action="store_true")
    n = c.add_parser("lint")
    n.add_argument("--config")
    n.add_argument("--rule")
    n.add_argument("--severity-threshold", default="info")
    n.add_argument("--freeze", action="store_true")
    c.add_parser("diff").add_argument("--before", required=True)
    s = c.add_parser("symbols")
    s.add_argument("--file")
    s.add_argument("--kind")
    for name in ("references", "callers"):
        r = c.add_parser(name)
        r.add_argument("name")
        r.add_argument("--file")
        if name == "references":
            r.add_argument("--kind")
    return p


#: What a text line shows of each result array.
TEXT = {"imports": "{path} ({depth})", "imported_by": "{path} ({depth})", "edges": "{src_path} -> {dst_path}: {imported_names}", "exports": "{exported_name} used={is_used}", "dead_files": "{path} [{confidence}]", "dead_exports": "{path}: {exported_name} [{confidence}]", "dead_symbols": "{name} ({kind})", "cycles": "{length}: {files}", "affected": "{path} ({depth})", "directories": "{directory}: {files} files", "violations": "{severity} {rule_id}: {source_file}:{line} -> {target_file}", "changes": "{change} {path}: {exported_name}", "by_depth": "depth {depth}: {n} files", "limitations": "{description}", "symbols": "{file}:{line} {kind} {name}", "references": "{file}:{line} {source} -> {target} ({kind})", "callers": "{file}:{line} {source} -> {target}"}


def run(spark, a: argparse.Namespace) -> tuple[dict[str, DataFrame], dict]:
    """Result arrays and a summary of a command."""
    at = f"{a.root.rstrip('/')}/{index.STORE}"
    if a.command == "index":
        return {}, index.index(spark, a.root, at, include=a.include, exclude=a.exclude, langs=a.lang)
    s = store.Store(spark, at)
    if s.current() is None:
        if a.no_index:
            raise SystemExit("no index; run the index command first")
        index.index(spark, a.root, at)
    tables = s.read()
    if a.command == "symbols":
        return {"symbols": index.symbols(tables, a.file, a.kind)}, {}
    if a.command == "references":
        return {"references": index.references(tables, a.name, a.kind, a.file)}, {}
    if a.command == "callers":
        return {"callers": index.callers(tables, a.name, a.file)}, {}
    if a.command == "diff":
        before, after = index.snapshot(store.Store(spark, a.before).read()), index.snapshot(tables)
        changes = analysis.diff_exports(before, after)
        return {"changes": changes}, analysis.diff_summary(before, after, changes).first().asDict()
    g = index.file_graph(tables, a.root)
    if a.runtime_only and a.command in ("deps", "dead-code", "cycles", "impact"):
        g = g.without_type_only()
    if a.path_filter and a.command != "lint":
        g = g.filtered(a.path_filter)
    return _graph_command(a, g, tables)


def _file(g: CodeGraph, path: str) -> int:
    row = find_file(g.nodes, path).first()
    if row is None:
        raise SystemExit(f"File not found in index: {path}")
    return row["id"]


def _graph_command(a: argparse.Namespace, g: CodeGraph, tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict]:
    if a.command == "deps" and a.between:
        return {"edges": analysis.deps_between(g, *a.between)}, {}
    if a.command == "deps":
        f = _file(g, a.path)
        out = {}
        if a.direction != "in":
            out["imports"] = analysis.deps(g, f, False, a.transitive, a.max_depth)
        if a.direction != "out":
            out["imported_by"] = analysis.deps(g, f, True, a.transitive, a.max_depth)
        none = g.nodes.where("false")
        return out, analysis.deps_summary(g, f, out.get("imports", none), out.get("imported_by", none), a.transitive).first().asDict()
    if a.command == "exports":
        usage = analysis.export_usage(g, _file(g, a.path))
        return {"exports": usage}, analysis.export_usage_summary(usage).first().asDict()
    if a.command == "dead-code":
        if a.scope == "symbols":
            return {"dead_symbols": analysis.dead_symbols(index.symbol_graph(tables), g)}, {}
        out = {}
        if a.scope != "exports":
            out["dead_files"] = analysis.dead_files(g)
        if a.scope != "files":
            out["dead_exports"] = analysis.dead_exports(g)
        none = g.nodes.where("false")
        summary = analysis.dead_code_summary(g, out.get("dead_files", none), out.get("dead_exports", none)).first().asDict()
        return out | {"limitations": analysis.limitations(g)}, summary | {"confidence": analysis.overall_confidence(g).first()[0]}
    if a.command == "cycles":
        found = analysis.cycles(g)
        return {"cycles": found.orderBy("length", F.element_at("files", 1))}, analysis.cycle_summary(g, found).first().asDict()
    if a.command == "impact":
        found = analysis.impact(g, _file(g, a.path), a.max_depth)
        return {"affected": found, "by_depth": analysis.impact_by_depth(found)}, analysis.impact_summary(found).first().asDict()
    if a.command == "summary":
        rows = {"directories": analysis.directory_summary(g)} if a.by_directory else {}
        return rows, analysis.project_summary(g).first().asDict() | {"by_language": {r["language"]: r["files"] for r in analysis.by_language(g).collect()}}
    at = configs.find_rules(a.root, a.config)
    if at is None:
        raise SystemExit("no rules found")
    found = lint.evaluate(configs.parse_rules(at.read_text()), g, "", a.rule, a.severity_threshold)
    base = f"{a.root.rstrip('/')}/.graphloom/baseline.json"
    if a.freeze:
        return {}, {"frozen": configs.write_baseline(found, base)}
    known = configs.read_baseline(g.nodes.sparkSession, base)
    found = lint.suppress(found, known) if known is not None else found
    return {"violations": lint.ordered(found)}, lint.summary(found).first().asDict()


def emit(arrays: dict[str, DataFrame], summary: dict, a: argparse.Namespace, out=sys.stdout) -> int:
    """Writes a result; returns the exit status."""
    if a.count or a.jq or a.format == "csv":  # these are about the rows alone
        arrays = {n: d for n, d in arrays.items() if n not in ("by_depth", "limitations")}
    arrays = {n: post.in_order(n, paths.enrich(d, ["path", "file", "source_file", "target_file"]) if a.format != "text" else d) for n, d in arrays.items()}
    if a.count:
        n = post.count_of(arrays).first()[0] if arrays else summary.get("files_indexed", summary.get("files", 0))
        print(n, file=out)
        return int(n > 0 and a.command in ("dead-code", "cycles", "lint"))
    if a.sort or a.limit is not None:
        arrays = {n: post.sort_limit(d, a.sort.split(",") if a.sort else [], a.reverse, a.limit) for n, d in arrays.items()}
    if a.jq:
        try:
            for d in arrays.values():
                for r in post.json_rows(post.jq(d, a.jq)).toLocalIterator():
                    print(r[0], file=out)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 2
        return 0
    if a.format == "csv":
        if arrays:
            rows, lines = post.csv_rows(arrays), csv.writer(out, lineterminator="\n")
            for k, r in enumerate(rows.toLocalIterator()):
                if not k:
                    lines.writerow(rows.columns)
                lines.writerow(["" if x is None else x for x in r])
        return 0
    if a.format in ("json", "compact"):
        doc = {n: [json.loads(r[0]) for r in post.json_rows(d).toLocalIterator()] for n, d in arrays.items()} | {"summary": summary}
        print(json.dumps(doc, indent=2 if a.format == "json" else None, default=str), file=out)
    else:
        for n, d in arrays.items():
            print(f"{n}:", file=out)
            for r in post.text_rows(d, TEXT[n]).toLocalIterator():
                print(f"  {r[0]}", file=out)
        for k, v in summary.items():
            print(f"{k}: {v}", file=out)
    return int(a.command == "lint" and summary.get("errors", 0) > 0)


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    from graphloom.session import session

    return emit(*run(session(), a), a)


if __name__ == "__main__":
    sys.exit(main())
