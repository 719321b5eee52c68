"""What the commands compute: dependencies, dead code, cycles, impact, usage, summaries and diffs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import globs, paths
from graphloom.operators import iterate
from graphloom.operators.graph import CodeGraph, SymbolGraph
from graphloom.shared import written

_HIDDEN_KINDS = ("import", "export", "package")


# ------------------------------------------------------------------ confidence

def confidence(unresolved: Column, edges: Column, wildcard: Column) -> Column:
    """Overall confidence from the numbers of unresolved imports and edges, and whether any re-export is a wildcard."""
    ratio = unresolved / F.greatest(edges, F.lit(1))
    sure = F.when(wildcard, "high").otherwise("certain")
    return F.when(unresolved == 0, sure).when(ratio < 0.1, "high").when(ratio < 0.3, "medium").otherwise("low")


def overall_confidence(g: CodeGraph) -> DataFrame:
    wild = reexport_rules(g).where("name = '*'").agg(F.count("*") > 0)
    return g.unresolved.agg(F.count("*").alias("u")).select(confidence(F.col("u"), g.edges.agg(F.count("*")).scalar(), wild.scalar()).alias("confidence"))


# ------------------------------------------------------------------ dependencies

def _names(edges: DataFrame, key: str) -> DataFrame:
    return edges.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("imported_names")))).alias("imported_names"))


def direct_deps(g: CodeGraph, file_id: int, incoming: bool = False) -> DataFrame:
    """(id, path, depth 1, imported_names) of files that ``file_id`` imports, or that import it."""
    here, there = ("dst", "src") if incoming else ("src", "dst")
    near = _names(g.edges.where(F.col(here) == file_id), there)
    return near.join(g.nodes.select("id", "path"), "id").select("id", "path", F.lit(1).alias("depth"), "imported_names")


def deps(g: CodeGraph, file_id: int, incoming: bool = False, transitive: bool = False, max_depth: int | None = None) -> DataFrame:
    """(id, path, depth, imported_names) without the file itself; only direct rows of a non-transitive call carry names."""
    if not transitive:
        return direct_deps(g, file_id, incoming)
    a, b = ("dst", "src") if incoming else ("src", "dst")
    edges = g.known_edges.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    seeds = g.nodes.where(F.col("id") == file_id).select("id")
    far = iterate.depths(edges, seeds, max_depth).where("depth > 0")
    return far.join(g.nodes.select("id", "path"), "id").select("id", "path", "depth", F.array().cast("array<string>").alias("imported_names"))


def deps_summary(g: CodeGraph, file_id: int, imports: DataFrame, imported_by: DataFrame, transitive: bool) -> DataFrame:
    """One row: direct counts of both directions, and the transitive rows returned."""
    direct = g.edges.where(F.col("src") == file_id).agg(F.countDistinct("dst").cast("long").alias("direct_imports"))
    back = g.edges.where(F.col("dst") == file_id).agg(F.countDistinct("src").cast("long"))
    t = [(d.agg(F.count("*")).scalar() if transitive else F.lit(0).cast("long")) for d in (imports, imported_by)]
    return direct.select("direct_imports", back.scalar().alias("direct_imported_by"), t[0].alias("transitive_imports"), t[1].alias("transitive_imported_by"))


def edge_paths(g: CodeGraph) -> DataFrame:
    """Edges with the paths of both ends; dangling ones go."""
    n = g.nodes.select("id", "path")
    return g.edges.join(n.select(F.col("id").alias("src"), F.col("path").alias("src_path")), "src").join(n.select(F.col("id").alias("dst"), F.col("path").alias("dst_path")), "dst")


def deps_between(g: CodeGraph, from_glob: str, to_glob: str) -> DataFrame:
    e = edge_paths(g).where(globs.matches_glob(F.col("src_path"), from_glob) & globs.matches_glob(F.col("dst_path"), to_glob))
    return e.select("src_path", "dst_path", "imported_names", "is_type_only", "line")


def impact(g: CodeGraph, file_id: int, max_depth: int | None = None) -> DataFrame:
    """(id, path, depth, confidence) of files that depend on ``file_id``."""
    found = deps(g, file_id, True, True, max_depth).select("id", "path", "depth")
    sure = F.when(g.unresolved.agg(F.count("*")).scalar() == 0, "certain").otherwise("high")
    return found.withColumn("confidence", sure)


def impact_by_depth(affected: DataFrame) -> DataFrame:
    return affected.groupBy("depth").agg(F.sort_array(F.collect_list("path")).alias("files"), F.count("*").alias("n"))


def impact_summary(affected: DataFrame) -> DataFrame:
    return affected.agg(F.count_if(F.col("depth") == 1).alias("direct_dependents"), F.count("*").alias("total_affected"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"))


# ------------------------------------------------------------------ dead code

def dead_files(g: CodeGraph) -> DataFrame:
    """(id, path, confidence) of files that no entry point reaches."""
    entries = g.nodes.where("is_entry_point").select("id")
    live = iterate.reachable(g.edges, entries)
    dead = g.nodes.where("not is_entry_point").join(live, "id", "left_anti")
    own = g.unresolved.select(F.col("file_id").alias("_f")).distinct()
    some = g.unresolved.agg(F.count("*")).scalar() > 0
    sure = F.when(~some, "certain").when(F.col("_f").isNotNull(), "medium").otherwise("high")
    return dead.join(own, F.col("id") == F.col("_f"), "left").select("id", "path", sure.alias("confidence"))


def used_names(g: CodeGraph) -> DataFrame:
    """(file_id, name) imported anywhere. A Rust file imported by its own name has all its exports used."""
    named = g.edges.select(F.col("dst").alias("file_id"), F.explode("imported_names").alias("name")).distinct()
    rust = g.nodes.where("language = 'rust'").select(F.col("id").alias("file_id"), paths.stem(F.col("path")).alias("name"))
    whole = named.join(rust, ["file_id", "name"], "left_semi").select("file_id").distinct()
    return named.unionByName(g.exports.join(whole, "file_id", "left_semi").select("file_id", F.col("exported_name").alias("name"))).distinct()


def reexport_rules(g: CodeGraph) -> DataFrame:
    """(barrel, target, name): re-exports matched with the edges of the same file that import that name."""
    again = g.exports.where("is_reexport").select(F.col("file_id").alias("barrel"), F.col("exported_name").alias("name"))
    named = g.edges.select(F.col("src").alias("barrel"), F.col("dst").alias("target"), F.explode("imported_names").alias("name"))
    return again.join(named, ["barrel", "name"]).select("barrel", "target", "name").distinct()


def propagated_names(g: CodeGraph) -> DataFrame:
    """(file_id, name) that is imported anywhere, or through chains of re-exports."""
    return iterate.fixpoint_names(used_names(g), reexport_rules(g))


def dead_exports(g: CodeGraph) -> DataFrame:
    """(file_id, path, exported_name, line, confidence) of exports of non-entry files that nothing imports; re-exports aren't reported."""
    g = g if hasattr(g.edges, "_graphloom_path") else replace(g, edges=written(g.edges, "graph-edges"))  # names and re-export rules both read them
    used = propagated_names(g)
    mine = g.exports.where("not is_reexport").join(g.nodes.where("not is_entry_point").select(F.col("id").alias("file_id"), "path"), "file_id")
    open_ = mine.join(used.withColumnRenamed("name", "exported_name"), ["file_id", "exported_name"], "left_anti")
    default = used.where("name = 'default'").select("file_id", F.lit(True).alias("_d"))
    open_ = open_.join(default, "file_id", "left").where("not (is_default and coalesce(_d, false))")
    sure = F.when(g.unresolved.agg(F.count("*")).scalar() == 0, "certain").otherwise("high")
    return open_.select("file_id", "path", "exported_name", "line", sure.alias("confidence"))


def export_usage(g: CodeGraph, file_id: int) -> DataFrame:
    """(exported_name, is_default, is_reexport, is_used) of one file; re-export chains aren't followed."""
    used = used_names(g).where(F.col("file_id") == file_id).select(F.col("name").alias("exported_name"), F.lit(True).alias("_u"))
    default = used.where("exported_name = 'default'").agg(F.count("*")).scalar() > 0
    own = g.exports.where(F.col("file_id") == file_id).join(used, "exported_name", "left")
    return own.select("exported_name", "is_default", "is_reexport", (F.coalesce("_u", F.lit(False)) | (F.col("is_default") & default)).alias("is_used"))


def export_usage_summary(usage: DataFrame) -> DataFrame:
    return usage.agg(F.count("*").alias("total"), F.count_if("is_used").alias("used"), F.count_if(~F.col("is_used")).alias("unused"))


def dead_symbols(s: SymbolGraph, g: CodeGraph, seed_exports: DataFrame | None = None) -> DataFrame:
    """(id, name, kind, file_id) of symbols that no public symbol of an entry file (nor one in ``seed_exports``, (id)) reaches."""
    entries = g.nodes.where("is_entry_point").select(F.col("id").alias("file_id"))
    seeds = s.symbols.where("visibility = 'public'").join(entries, "file_id", "left_semi").select("id")
    if seed_exports is not None:
        seeds = seeds.unionByName(seed_exports.select("id"))
    live = iterate.reachable(s.edges, seeds)
    shown = s.symbols.where(~F.col("kind").isin(*_HIDDEN_KINDS))
    return shown.join(live, "id", "left_anti").select("id", "name", "kind", "file_id")


def dead_code_summary(g: CodeGraph, files: DataFrame, exports: DataFrame) -> DataFrame:
    n = lambda d: d.agg(F.count("*")).scalar()
    return g.nodes.agg(F.count("*").alias("total_files"), F.count_if("is_entry_point").alias("entry_points")).select(
        "total_files", "entry_points", n(files).alias("dead_files"), n(exports).alias("dead_exports"), n(g.exports).alias("total_exports"), n(g.with_unresolved_imports()).alias("files_with_unresolved")
    )


def limitations(g: CodeGraph) -> DataFrame:
    """(description, count) of what makes dead code uncertain: unresolved imports and the files that have any; no row where there are none."""
    of = g.unresolved.agg(F.count("*").alias("u"), F.countDistinct("file_id").alias("f"))
    text = lambda n, what: F.struct(F.concat(F.col(n).cast("string"), F.lit(what)).alias("description"), F.col(n).alias("count"))
    both = of.select(F.explode(F.array(text("u", " imports could not be resolved"), text("f", " files have unresolvable imports"))).alias("x"))
    return both.select("x.*").where("count > 0")


# ------------------------------------------------------------------ cycles

def cycles(g: CodeGraph) -> DataFrame:
    """(component, length, files): import cycles, without module declarations."""
    parts = iterate.components(g.without_mod_declarations().known_edges)
    named = parts.join(g.nodes.select("id", "path"), "id")
    return named.groupBy("component").agg(F.count("*").alias("length"), F.sort_array(F.collect_list("path")).alias("files"))


def cycle_summary(g: CodeGraph, found: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return found.agg(F.count("*").alias("cycle_count"), F.coalesce(F.sum("length"), zero).alias("files_in_cycles"), F.coalesce(F.min("length"), zero).alias("shortest"), F.coalesce(F.max("length"), zero).alias("longest")).withColumn("total_files", g.nodes.agg(F.count("*")).scalar())


# ------------------------------------------------------------------ summaries

def by_language(g: CodeGraph) -> DataFrame:
    return g.nodes.groupBy("language").agg(F.count("*").alias("files"))


def project_summary(g: CodeGraph) -> DataFrame:
    n = lambda d: d.agg(F.count("*")).scalar()
    g = g.stored()
    c = written(cycles(g).select("length"), "cycles")
    return g.nodes.agg(F.count("*").alias("files"), F.count_if("is_entry_point").alias("entry_points")).select(
        "files", "entry_points", n(g.edges).alias("imports"), n(g.unresolved).alias("unresolved"), n(dead_files(g)).alias("dead_files"), n(dead_exports(g)).alias("dead_exports"), n(g.exports).alias("exports"),
        n(c).alias("cycles"), F.coalesce(c.agg(F.sum("length")).scalar(), F.lit(0).cast("long")).alias("files_in_cycles"),
    )


def directory_summary(g: CodeGraph) -> DataFrame:
    """Per directory: files, exports, dead exports, average distinct fan-out and fan-in to two places."""
    g = g.stored()
    directory = F.when(paths.parent(F.col("path")) == "", ".").otherwise(paths.parent(F.col("path")))
    count = lambda d, key, name, what="*": d.groupBy(F.col(key).alias("id")).agg((F.count("*") if what == "*" else F.countDistinct(what)).alias(name))
    files = g.nodes.select("id", directory.alias("directory"))
    for side in (count(g.exports, "file_id", "e"), count(dead_exports(g), "file_id", "d"), count(g.edges, "src", "o", "dst"), count(g.edges, "dst", "i", "src")):
        files = files.join(side, "id", "left")
    mean = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0))), 2)
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    return files.groupBy("directory").agg(F.count("*").alias("files"), total("e").alias("exports"), total("d").alias("dead_exports"), mean("o").alias("avg_fan_out"), mean("i").alias("avg_fan_in"))


# ------------------------------------------------------------------ diff

def diff_exports(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, exported_name, change) between two snapshots (path, exported_name; files without exports have a null name).

    All exports of an added file are expanding, of a removed file breaking (each row); in files of both, the different
    names are compared.
    """
    old, new = (d.select("path").distinct() for d in (before, after))
    added = after.where("exported_name is not null").join(old, "path", "left_anti").select("path", "exported_name", F.lit("expanding").alias("change"))
    removed = before.where("exported_name is not null").join(new, "path", "left_anti").select("path", "exported_name", F.lit("breaking").alias("change"))
    b, a = (d.where("exported_name is not null").select("path", "exported_name").distinct() for d in (before, after))
    both = old.join(new, "path", "left_semi")
    more = a.join(b, ["path", "exported_name"], "left_anti").join(both, "path", "left_semi").withColumn("change", F.lit("expanding"))
    fewer = b.join(a, ["path", "exported_name"], "left_anti").join(both, "path", "left_semi").withColumn("change", F.lit("breaking"))
    return added.unionByName(removed).unionByName(more).unionByName(fewer)


def diff_summary(before: DataFrame, after: DataFrame, changes: DataFrame) -> DataFrame:
    old, new = (d.select("path").distinct() for d in (before, after))
    files = old.withColumn("_b", F.lit(True)).join(new.withColumn("_a", F.lit(True)), "path", "full_outer")
    files = files.join(changes.select("path", F.lit(True).alias("_c")).distinct(), "path", "left")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    counts = changes.agg(F.count_if(F.col("change") == "breaking").alias("b"), F.count_if(F.col("change") == "expanding").alias("e"))
    return files.agg(F.count_if(F.col("_b").isNull()).alias("added"), F.count_if(F.col("_a").isNull()).alias("removed"), F.count_if(both & F.col("_c").isNotNull()).alias("changed"), F.count_if(both & F.col("_c").isNull()).alias("unchanged")).select(
        "*", counts.select("b").scalar().alias("breaking"), counts.select("e").scalar().alias("expanding")
    )
