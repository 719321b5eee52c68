"""From a source tree to the stored tables, and from these to a graph."""

from __future__ import annotations

import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph, resolve
from graphloom.shared import written
from graphloom.sources import configs, extract, scan, store

STORE = ".graphloom/index"


def refresh(old: dict[str, DataFrame], found: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables after a scan (path, mtime, language, content), and a one-row summary.

    Only new and changed files are read; a file that fails keeps its old rows. Deleted files' rows go.
    """
    state = written(store.classify(old["files"].select("id", "path", "mtime"), found), "scan")
    todo = state.where("state in ('new', 'changed')").withColumnRenamed("id", "file_id")
    parsed = written(extract.extract(todo), "extracted")
    good = parsed.where("error is null")
    new = extract.tables(good)
    gone = state.where("state = 'deleted'").select(F.col("id").alias("file_id")).unionByName(good.select("file_id"))
    kept = store.without_files(old, gone)
    done = todo.join(good.select("file_id"), "file_id", "left_semi").select(F.col("file_id").alias("id"), "path", "mtime", "language")
    out = {"files": kept["files"].select("id", "path", "mtime", "language").unionByName(done)}
    for t in store.OWNED:
        out[t] = kept[t].unionByName(new[t].select(*kept[t].columns))
    n = lambda s: F.count_if(F.col("state") == s)
    total = lambda d: d.agg(F.count("*")).scalar()
    summary = state.agg((n("new") + n("changed")).alias("files_indexed"), n("unchanged").alias("files_unchanged"), n("deleted").alias("files_deleted")).select("*", total(new["symbols"]).alias("symbols"), total(new["refs"]).alias("refs"), total(parsed.where("error is not null")).alias("errors"))
    return out, summary


def index(spark: SparkSession, root: str, at: str | None = None, **options) -> dict:
    """Brings the store of a project up to date; returns the summary with its errors."""
    began = time.time()
    s = store.Store(spark, at or f"{root.rstrip('/')}/{STORE}")
    tables, summary = refresh(s.read(), scan.discover(spark, root, **options))
    out = summary.first().asDict()
    s.write(tables)
    return out | {"duration_ms": int((time.time() - began) * 1000)}


def _setting(root: str, name: str) -> str | None:
    p = Path(root, name)
    return p.read_text() if p.is_file() else None


def imports_with_files(tables: dict[str, DataFrame]) -> DataFrame:
    f = tables["files"].select(F.col("id").alias("from_id"), F.col("path").alias("from_path"), "language")
    return tables["imports"].withColumnRenamed("id", "import_id").withColumnRenamed("file_id", "from_id").withColumnRenamed("source_path", "source").join(f, "from_id")


def file_graph(tables: dict[str, DataFrame], root: str = ".") -> graph.CodeGraph:
    """The graph of a store's tables; settings are read from the local folder ``root``."""
    patterns, annotations = configs.entry_points(_setting(root, configs.RULES[0]) or _setting(root, configs.RULES[1]))
    known = tables["files"].select("id", "path")
    all_imports = imports_with_files(tables)
    imports = all_imports.where(~F.col("source").startswith("@annotation:"))
    found = resolve.resolve_all(imports.select("import_id", "from_id", "from_path", "language", "source", "imported_name", "is_type_only", "line_start"), known, "", configs.tsconfig(_setting(root, "tsconfig.json")), configs.cargo(_setting(root, "Cargo.toml")))
    rows = found.where("status = 'resolved'").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), F.col("imported_name").alias("name"), "is_type_only", F.col("source").startswith("@mod:").alias("is_mod_declaration"), F.col("line_start").alias("line"))
    lost = found.where("status <> 'resolved'").select(F.col("from_id").alias("file_id"), F.col("source").alias("import_path"), F.when(F.col("status") == "external", "external").otherwise(F.col("detail")).alias("kind"), "detail", F.col("line_start").alias("line"))
    annotated = graph.entry_points_by_annotation(tables["imports"], annotations)
    nodes = graph.mark_entry_points(tables["files"].select("id", "path", "language"), annotated, patterns)
    exports = tables["exports"].select("file_id", "exported_name", "is_default", "is_reexport", "is_type_only", "source_path", "line")
    return graph.CodeGraph(nodes, graph.build_edges(rows), exports, lost)


def symbol_graph(tables: dict[str, DataFrame]) -> graph.SymbolGraph:
    return graph.SymbolGraph.build(tables["symbols"], tables["refs"])


def symbols(tables: dict[str, DataFrame], path: str | None = None, kind: str | None = None) -> DataFrame:
    """Symbols with their files' paths; a path wins over a kind."""
    s, f = tables["symbols"], tables["files"]
    if path is not None:
        s = s.join(graph.find_file(f, path).select(F.col("id").alias("file_id")), "file_id", "left_semi")
    elif kind is not None:
        s = s.where(F.col("kind") == kind)
    named = s.join(f.select(F.col("id").alias("file_id"), "path"), "file_id", "left")
    return named.select("id", "name", "qualified_name", "kind", F.coalesce("path", F.concat(F.lit("file:"), F.col("file_id").cast("string"))).alias("file"), F.col("line_start").alias("line"), "visibility", "signature")


def references(tables: dict[str, DataFrame], name: str, kind: str | None = None, path: str | None = None) -> DataFrame:
    """References from or to symbols called ``name``; a path that isn't found filters nothing."""
    s, f, r = tables["symbols"], tables["files"], tables["refs"]
    own = s.where((F.col("name") == name) | (F.col("qualified_name") == name)).select("id")
    hit = r.join(own, r.source_id == own.id, "left_semi").unionByName(r.join(own, r.target_id == own.id, "left_semi")).dropDuplicates(["id"])
    if kind is not None:
        hit = hit.where(F.col("kind") == kind)
    if path is not None and (at := graph.find_file(f, path).first()) is not None:
        hit = hit.where(F.col("file_id") == at["id"])
    a = s.select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    b = s.select(F.col("id").alias("target_id"), F.col("name").alias("target"))
    out = hit.join(a, "source_id", "left").join(b, "target_id", "left").join(f.select(F.col("id").alias("file_id"), F.col("path").alias("file")), "file_id", "left")
    q = F.lit("?")
    return out.select(F.coalesce("source", q).alias("source"), F.coalesce("target", q).alias("target"), "kind", F.coalesce("file", q).alias("file"), F.col("line_start").alias("line"))


def callers(tables: dict[str, DataFrame], name: str, path: str | None = None) -> DataFrame:
    s = tables["symbols"]
    own = s.where((F.col("name") == name) | (F.col("qualified_name") == name)).select(F.col("id").alias("target_id"))
    calls = dict(tables, refs=tables["refs"].where("kind = 'call'").join(own, "target_id", "left_semi").select(*tables["refs"].columns))
    return references(calls, name, "call", path)


def snapshot(tables: dict[str, DataFrame]) -> DataFrame:
    """(path, exported_name) for diffs."""
    f, e = tables["files"], tables["exports"]
    return f.join(e.select("file_id", "exported_name"), f.id == e.file_id, "left").select("path", "exported_name")
