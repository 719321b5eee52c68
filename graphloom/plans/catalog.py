"""The queries over the virtual code base, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import globs, paths, post
from graphloom.operators import analysis, graph, iterate, lint
from graphloom.operators.lint import Evaluation
from graphloom.plans import virtual
from graphloom.plans.virtual import SQL
from graphloom.schema import SYMBOL_KINDS, VISIBILITIES, decoded

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = SQL + sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _g(spark: SparkSession, sf_dir: str) -> graph.CodeGraph:
    return virtual.graph(spark, sf_dir)


def _names(column: str = "imported_names") -> "F.Column":
    return F.array_join(column, ",").alias("names")


# ------------------------------------------------------------------ sources and predicates

@query("select path, ext as extension, language from nodes")
def src4_language_by_extension(spark, d):
    p = F.col("path")
    return virtual.nodes(spark, d).select("path", paths.extension(p).alias("extension"), paths.language(p).alias("language"))


@query("select id, path from nodes where language in ('java', 'rust')")
def src5_language_filter(spark, d):
    return virtual.nodes(spark, d).where(F.col("language").isin("java", "rust")).select("id", "path")


@query("select file_id, name as exported_name, is_default, is_reexport from exports order by file_id, exported_name")
def src8_full_scan_ordered(spark, d):
    return virtual.export_rows(spark, d).select("file_id", "exported_name", "is_default", "is_reexport").orderBy("file_id", "exported_name")


@query("select id, path, language from nodes where id = 7")
def src9_point_lookup_id(spark, d):
    return virtual.nodes(spark, d).where("id = 7").select("id", "path", "language")


@query("select id, path from nodes where path = (select path from nodes where id = 3)")
def src10_point_lookup_path(spark, d):
    n = virtual.nodes(spark, d)
    return n.where(F.col("path") == n.where("id = 3").select("path").scalar()).select("id", "path")


@query("select id, path from nodes where path like '%/s5.rs' order by path limit 1")
def src11_lookup_by_suffix(spark, d):
    return graph.find_file(virtual.nodes(spark, d), "s5.rs").select("id", "path")


@query("select id, name from symbols where kind = 'class' and visibility = 'public'")
def prd1_symbols_by_kind(spark, d):
    return virtual.symbols(spark, d).where("kind = 'class' and visibility = 'public'").select("id", "name")


@query("select name as exported_name from exports where file_id = 4")
def prd2_exports_by_file(spark, d):
    return virtual.export_rows(spark, d).where("file_id = 4").select("exported_name")


@query("select path from nodes where (regexp_matches(path, '^src/ASIA/.*$') or regexp_matches(path, '^.*\\.rs$')) and not regexp_matches(path, '^.*/s[0-3][^/]*\\.rs$')")
def prd3_multi_glob(spark, d):
    return virtual.nodes(spark, d).where(globs.file_matcher(F.col("path"), ["src/ASIA/**", "**/*.rs", "!**/s[0-3]*.rs"])).select("path")


@query("select path from nodes where regexp_matches(path, '^src/(AFRICA|EUROPE)/.*\\.ts$')")
def prd4_single_glob(spark, d):
    return virtual.nodes(spark, d).where(globs.matches_glob(F.col("path"), "src/{AFRICA,EUROPE}/**/*.ts")).select("path")


@query("select substr(path, 5) as rel from nodes")
def prd5_relative_path(spark, d):
    return virtual.nodes(spark, d).select(paths.relative(F.col("path"), "src").alias("rel"))


@query("select path from nodes where regexp_matches(path, 's[0-9]*5\\.')")
def prd6_regex(spark, d):
    return virtual.nodes(spark, d).where(F.col("path").rlike(r"s[0-9]*5\.")).select("path")


@query("select id, case when kind = 'export' then 'export' else kind end as kind, case when visibility in ('public', 'private', 'protected') then visibility else 'private' end as visibility from symbols")
def prd9_decode_defaults(spark, d):
    return virtual.symbols(spark, d).select("id", decoded(F.col("kind"), SYMBOL_KINDS, "variable").alias("kind"), decoded(F.col("visibility"), VISIBILITIES, "private").alias("visibility"))


# ------------------------------------------------------------------ graph

@query("select src, dst, array_to_string(names, ',') as names, is_type_only, is_mod as is_mod_declaration, line from edges")
def grf1_build_edges(spark, d):
    e = graph.build_edges(virtual.edge_rows(spark, d))
    return e.select("src", "dst", _names(), "is_type_only", "is_mod_declaration", "line")


@query("select kind, count(*) as n, count(distinct file_id) as files from unresolved group by kind")
def grf2_unresolved(spark, d):
    return _g(spark, d).unresolved.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("files"))


@query("""select path, regexp_matches(stem, '^(index|main|app|server|cli)$') or (language = 'java' and regexp_matches(stem, '^Test|(Test|Tests|IT|Application)$'))
    or (language = 'rust' and stem in ('lib', 'build')) or stem = 's11' as is_entry_point from nodes""")
def grf3_grf5_entry_points(spark, d):
    n = virtual.nodes(spark, d).drop("is_entry_point")
    return graph.mark_entry_points(n, patterns=["**/s11.*"]).select("path", "is_entry_point")


@query("select id, path from nodes where id in (select file_id from unresolved where import_path in ('pkg10', 'pkg20', 'pkg30'))")
def grf4_entry_by_annotation(spark, d):
    imports = virtual.unresolved_rows(spark, d).select("file_id", F.concat(F.lit("@annotation:"), "import_path").alias("source_path"))
    marked = graph.mark_entry_points(virtual.nodes(spark, d).drop("is_entry_point"), graph.entry_points_by_annotation(imports, ["pkg10", "pkg20", "pkg30"]))
    return marked.where("is_entry_point").select("id", "path")


@query("select source_id, target_id, kind from symbol_refs")
def grf6_symbol_graph(spark, d):
    return virtual.symbol_graph(spark, d).refs.select("source_id", "target_id", "kind")


@query("select src, dst, line from edges where not is_type_only")
def grf7_runtime_only(spark, d):
    return _g(spark, d).without_type_only().edges.select("src", "dst", "line")


@query("select src, dst, line from edges where not is_mod")
def grf8_without_mod_declarations(spark, d):
    return _g(spark, d).without_mod_declarations().edges.select("src", "dst", "line")


@query("select src, dst from ends where s like 'src/A%' and t like 'src/A%'")
def grf9_path_filter(spark, d):
    return _g(spark, d).filtered("src/A**").edges.select("src", "dst")


@query("select count(*) as symbols, (select count(*) from symbol_refs where source_id // 8 <> 3 and target_id // 8 <> 3) as refs from symbols where file_id <> 3")
def grf12_remove_file(spark, d):
    s = virtual.symbol_graph(spark, d).without_file(3)
    return s.symbols.agg(F.count("*").alias("symbols")).select("symbols", s.refs.agg(F.count("*")).scalar().alias("refs"))


@query("select distinct dst as id from edges where src = 1001 order by id")
def grf13_direct_imports(spark, d):
    return _g(spark, d).imports_of(1001)


@query("select (select count(*) from nodes) as file_count, (select count(*) from edges) as import_count, (select count(*) from unresolved) as unresolved_count, (select count(*) from exports) as export_count")
def grf14_counts(spark, d):
    return _g(spark, d).counts()


@query("select distinct file_id from unresolved")
def grf15_files_with_unresolved(spark, d):
    return _g(spark, d).with_unresolved_imports()


@query("select id, path from nodes where entry")
def grf16_entry_points(spark, d):
    return _g(spark, d).entry_points().select("id", "path")


# ------------------------------------------------------------------ joins and aggregations

@query("select y.name, coalesce(n.path, 'file:' || y.file_id) as path from symbols y left join nodes n on n.id = y.file_id and n.language <> 'rust'")
def jn1_symbols_with_files(spark, d):
    n = virtual.nodes(spark, d).where("language <> 'rust'").select(F.col("id").alias("f"), "path")
    s = virtual.symbols(spark, d)
    return s.join(n, s.file_id == n.f, "left").select("name", F.coalesce("path", F.concat(F.lit("file:"), F.col("file_id").cast("string"))).alias("path"))


@query("""select r.kind, coalesce(a.name, '?') as source, coalesce(b.name, '?') as target, coalesce(n.path, '?') as path
    from refs r left join symbols a on a.id = r.source_id left join symbols b on b.id = r.target_id left join nodes n on n.id = a.file_id""")
def jn2_references_resolved(spark, d):
    s, n = virtual.symbols(spark, d), virtual.nodes(spark, d)
    a = s.select(F.col("id").alias("source_id"), F.col("name").alias("source"), "file_id")
    b = s.select(F.col("id").alias("target_id"), F.col("name").alias("target"))
    r = virtual.refs(spark, d).join(a, "source_id", "left").join(b, "target_id", "left").join(n.select(F.col("id").alias("file_id"), "path"), "file_id", "left")
    q = F.lit("?")
    return r.select("kind", F.coalesce("source", q).alias("source"), F.coalesce("target", q).alias("target"), F.coalesce("path", q).alias("path"))


@query("select source_id, target_id, kind from refs where source_id in (select id from symbols where file_id = 2) or target_id in (select id from symbols where file_id = 2)")
def jn3_references_touching_file(spark, d):
    own = F.broadcast(virtual.symbols(spark, d).where("file_id = 2").select("id"))  # of one file; else all references are shuffled and sorted to meet them
    r = virtual.refs(spark, d)
    return r.join(own, r.source_id == own.id, "left_semi").unionByName(r.join(own, r.target_id == own.id, "left_semi")).distinct()


@query("select source_id, target_id from refs where kind = 'call' and target_id in (select id from symbols where kind = 'function')")
def jn4_callers_of_functions(spark, d):
    f = virtual.symbols(spark, d).where("kind = 'function'").select(F.col("id").alias("target_id"))
    return virtual.refs(spark, d).where("kind = 'call'").join(f, "target_id", "left_semi").select("source_id", "target_id")


@query("select language, count(*) as files from nodes group by language")
def agg2_files_by_language(spark, d):
    return analysis.by_language(_g(spark, d))


@query("""select (select count(*) from nodes) as files, (select count(*) from nodes where entry) as entry_points, (select count(*) from edges) as imports, (select count(*) from unresolved) as unresolved,
    (select count(*) from dead_files) as dead_files, (select count(*) from dead_exports) as dead_exports,
    (select count(*) from exports) as exports, (select count(distinct component) from scc) as cycles, (select count(*) from scc) as files_in_cycles""")
def agg3_project_summary(spark, d):
    return analysis.project_summary(_g(spark, d))


@query("""select dir as directory, count(*) as files, sum(coalesce(e.n, 0))::bigint as exports, sum(coalesce(x.n, 0))::bigint as dead_exports, round(avg(coalesce(o.n, 0)), 2) as avg_fan_out, round(avg(coalesce(i.n, 0)), 2) as avg_fan_in
    from nodes left join (select file_id, count(*) n from exports group by 1) e on e.file_id = id left join (select file_id, count(*) n from dead_exports group by 1) x on x.file_id = id
    left join (select src, count(distinct dst) n from edges group by 1) o on o.src = id left join (select dst, count(distinct src) n from edges group by 1) i on i.dst = id group by dir""")
def agg4_directory_summary(spark, d):
    return analysis.directory_summary(_g(spark, d))


@query("select id, path, coalesce(o.n, 0) as fan_out, coalesce(i.n, 0) as fan_in, round(coalesce(o.n, 0) / nullif(coalesce(o.n, 0) + coalesce(i.n, 0), 0), 6) as instability from nodes left join (select src, count(distinct dst) n from edges group by 1) o on o.src = id left join (select dst, count(distinct src) n from edges group by 1) i on i.dst = id")
def agg5_agg6_fan_and_instability(spark, d):
    g = _g(spark, d)
    o = g.edges.groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("o"))
    i = g.edges.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("i"))
    zero = F.lit(0).cast("long")
    n = g.nodes.join(o, "id", "left").join(i, "id", "left").select("id", "path", F.coalesce("o", zero).alias("fan_out"), F.coalesce("i", zero).alias("fan_in"))
    return n.withColumn("instability", F.round(F.col("fan_out") / F.nullif(F.col("fan_out") + F.col("fan_in"), zero), 6))


@query("select n.path, coalesce(e.n, 0) as exports from nodes n left join (select file_id, count(*) n from exports group by 1) e on e.file_id = n.id")
def agg8_exports_per_file(spark, d):
    g = _g(spark, d)
    e = g.exports.groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("n"))
    return g.nodes.join(e, "id", "left").select("path", F.coalesce("n", F.lit(0).cast("long")).alias("exports"))


@query("select src, dst, len(names)::int as weight from edges")
def agg9_names_per_edge(spark, d):
    return _g(spark, d).edges.select("src", "dst", F.size("imported_names").alias("weight"))


@query("select count(distinct component) as cycle_count, (select count(*) from scc)::bigint as files_in_cycles, coalesce(min(n), 0) as shortest, coalesce(max(n), 0) as longest, (select count(*) from nodes) as total_files from (select component, count(*) n from scc group by 1)")
def agg12_cycle_summary(spark, d):
    g = _g(spark, d)
    return analysis.cycle_summary(g, analysis.cycles(g))


@query("select (select count(*) from nodes) as total_files, (select count(*) from nodes where entry) as entry_points, (select count(*) from dead_files) as dead_files, (select count(*) from dead_exports) as dead_exports, (select count(*) from exports) as total_exports, (select count(distinct file_id) from unresolved) as files_with_unresolved")
def agg15_dead_code_summary(spark, d):
    g = _g(spark, d)
    return analysis.dead_code_summary(g, analysis.dead_files(g), analysis.dead_exports(g))


@query("""select case when u = 0 and w then 'high' when u = 0 then 'certain' when u / greatest(e, 1) < 0.1 then 'high' when u / greatest(e, 1) < 0.3 then 'medium' else 'low' end as confidence
    from (select (select count(*) from unresolved) as u, (select count(*) from edges) as e, (select count(*) from rules where name = '*') > 0 as w)""")
def agg16_confidence(spark, d):
    return analysis.overall_confidence(_g(spark, d))


# ------------------------------------------------------------------ algorithms

@query("select id from live")
def alg1_reachable(spark, d):
    g = _g(spark, d)
    return iterate.reachable(g.edges, g.nodes.where("is_entry_point").select("id"))


@query("select id from live")
def alg1_jn10_reachable_by_joins(spark, d):
    """The frontier joined with the edges level by level, as for graphs beyond one task's memory."""
    g = _g(spark, d)
    return iterate.reachable(g.edges, g.nodes.where("is_entry_point").select("id"), small=0)


@query("select id, path, confidence from dead_files")
def alg2_dead_files(spark, d):
    return analysis.dead_files(_g(spark, d))


@query("select file_id, name from used_all")
def alg3_used_names(spark, d):
    return analysis.used_names(_g(spark, d))


@query("select file_id, name from spread")
def alg4_reexport_propagation(spark, d):
    return analysis.propagated_names(_g(spark, d))


@query("select file_id, name from spread")
def alg4_jn11_propagation_by_joins(spark, d):
    g = _g(spark, d)
    return iterate.fixpoint_names(analysis.used_names(g), analysis.reexport_rules(g), small=0)


@query("select file_id, path, exported_name, line, confidence from dead_exports")
def alg5_dead_exports(spark, d):
    return analysis.dead_exports(_g(spark, d))


@query(""", alive as (select y.id from symbols y join nodes n on n.id = y.file_id and n.entry where y.visibility = 'public' union select r.target_id from alive a join symbol_refs r on r.source_id = a.id)
    select id, name, kind, file_id from symbols where kind <> 'export' and id not in (select id from alive)""")
def alg6_dead_symbols(spark, d):
    return analysis.dead_symbols(virtual.symbol_graph(spark, d), _g(spark, d))


@query("select component, count(*) as length, string_agg(path, ',' order by path) as files from scc join nodes using (id) group by component")
def alg7_cycles(spark, d):
    return analysis.cycles(_g(spark, d)).select("component", "length", F.array_join("files", ",").alias("files"))


@query("select id, component from scc")
def alg7_components_by_joins(spark, d):
    """Trimming by joins, as for graphs beyond one task's memory."""
    return iterate.components(_g(spark, d).without_mod_declarations().known_edges, small=2000)


_DEPTH = """, walk as (select {s}::bigint as id, 0 as depth union select e.{b}, w.depth + 1 from walk w join edges e on e.{a} = w.id where w.depth < {m}),
    least_depth as (select id, min(depth) as depth from walk group by id) select l.id, n.path, l.depth{more} from least_depth l join nodes n using (id) where l.depth > 0"""


@query(_DEPTH.format(s=1001, a="src", b="dst", m=4, more=""))
def alg8_transitive_deps(spark, d):
    return analysis.deps(_g(spark, d), 1001, transitive=True, max_depth=4).select("id", "path", "depth")


@query("select dst as id, n.path, 1 as depth, (select string_agg(x, ',' order by x) from (select distinct unnest(names) as x)) as names from edges e join nodes n on n.id = dst where src = 1001")
def alg8_agg17_direct_deps(spark, d):
    return analysis.direct_deps(_g(spark, d), 1001).select("id", "path", "depth", _names())


@query(""", alive as (select id from symbols where file_id = 1001 union select r.target_id from alive a join symbol_refs r on r.source_id = a.id) select id from alive""")
def alg9_symbol_reachability(spark, d):
    s = virtual.symbol_graph(spark, d)
    return iterate.reachable(s.edges, s.symbols.where("file_id = 1001").select("id"))


@query(""", back as (select id from symbols where file_id = 4 union select r.source_id from back a join symbol_refs r on r.target_id = a.id) select id from back where id not in (select id from symbols where file_id = 4)""")
def alg10_symbol_dependents(spark, d):
    s = virtual.symbol_graph(spark, d)
    e = s.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    own = s.symbols.where("file_id = 4").select("id")
    return iterate.reachable(e, own).join(own, "id", "left_anti")


@query("select source_id as id from symbol_refs where target_id = (select min(target_id) from symbol_refs)")
def alg11_callers(spark, d):
    s = virtual.symbol_graph(spark, d)
    return s.callers(s.refs.agg(F.min("target_id")).first()[0])


@query(_DEPTH.format(s=1001, a="dst", b="src", m=3, more=", 'high' as confidence"))
def alg12_impact(spark, d):
    return analysis.impact(_g(spark, d), 1001, 3)


@query(_DEPTH.format(s=1001, a="dst", b="src", m=3, more="").replace("select l.id, n.path, l.depth", "select l.depth, string_agg(n.path, ',' order by n.path) as files, count(*) as n") + " group by l.depth")
def agg13_impact_by_depth(spark, d):
    by = analysis.impact_by_depth(analysis.impact(_g(spark, d), 1001, 3))
    return by.select("depth", F.array_join("files", ",").alias("files"), "n")


@query("select e.name as exported_name, is_default, is_reexport, exists (select 1 from used_all u where u.file_id = 2 and u.name = e.name) or (is_default and exists (select 1 from used_all u where u.file_id = 2 and u.name = 'default')) as is_used from exports e where file_id = 2")
def alg13_export_usage(spark, d):
    return analysis.export_usage(_g(spark, d), 2)


@query("select count(*) as total, count(*) filter (u) as used, count(*) filter (not u) as unused from (select exists (select 1 from used_all u where u.file_id = 2 and u.name = e.name) as u from exports e where file_id = 2)")
def agg18_export_usage_summary(spark, d):
    return analysis.export_usage_summary(analysis.export_usage(_g(spark, d), 2))


_SNAP = """, b as (select distinct n.path, x.name from nodes n left join (select distinct src, 'p' || own as name from items where not is_mod) x on x.src = n.id where not (language = 'rust' and path like 'src/EUROPE/%')),
    a as (select distinct n.path, x.name from nodes n left join (select distinct src, 'p' || own as name from items where not is_type_only) x on x.src = n.id where not (language = 'rust' and path like 'src/ASIA/%')),
    changes as (select a.path, a.name as exported_name, 'expanding' as change from a left join b on b.path = a.path and b.name = a.name where a.name is not null and b.path is null
      union all select b.path, b.name, 'breaking' from b left join a on b.path = a.path and b.name = a.name where b.name is not null and a.path is null)"""


@query(_SNAP + " select * from changes")
def alg14_snapshot_diff(spark, d):
    return analysis.diff_exports(virtual.snapshot(spark, d, False), virtual.snapshot(spark, d, True))


@query(_SNAP + """ select count(*) filter (not inb) as added, count(*) filter (not ina) as removed, count(*) filter (ina and inb and c) as changed, count(*) filter (ina and inb and not c) as unchanged,
    (select count(*) from changes where change = 'breaking') as breaking, (select count(*) from changes where change = 'expanding') as expanding
    from (select path, path in (select path from b) as inb, path in (select path from a) as ina, path in (select path from changes) as c from (select path from a union select path from b))""")
def agg11_diff_summary(spark, d):
    b, a = virtual.snapshot(spark, d, False), virtual.snapshot(spark, d, True)
    return analysis.diff_summary(b, a, analysis.diff_exports(b, a))


@query("select s as src_path, t as dst_path, array_to_string(names, ',') as names, is_type_only, line from ends where regexp_matches(s, '^src/ASIA/.*$') and regexp_matches(t, '^.*\\.ts$')")
def alg15_deps_between(spark, d):
    return analysis.deps_between(_g(spark, d), "src/ASIA/**", "**/*.ts").select("src_path", "dst_path", _names(), "is_type_only", "line")


# ------------------------------------------------------------------ rules

def _lint(spark, d, kind: str, settings: dict, tags: dict | None = None) -> DataFrame:
    ev = Evaluation(_g(spark, d), tags)
    return getattr(ev, kind)(settings).select("source_file", "target_file", _names(), F.col("line").cast("long").alias("line"))


_E = "select s as source_file, t as target_file, array_to_string(names, ',') as names, line from ends where "
_N = "select path as source_file, path as target_file, '' as names, 0::bigint as line from nodes "


@query(_E + "s like 'src/ASIA/%' and t like 'src/EUROPE/%' and not t like '%.rs'")
def lnt1_boundary(spark, d):
    return _lint(spark, d, "boundary", {"from": ["src/ASIA/**"], "deny": ["src/EUROPE/**"], "except": ["**/*.rs"]})


_LAYER = "case when {0} like '%.ts' then 0 when {0} like 'src/A%' then 1 when {0} like '%.rs' then 2 end"


@query(_E + _LAYER.format("s") + " > " + _LAYER.format("t"))
def lnt2_layer(spark, d):
    return _lint(spark, d, "layer", {"layers": [{"name": "ui", "patterns": ["**/*.ts"]}, {"name": "mid", "patterns": ["src/A**"]}, {"name": "core", "patterns": ["**/*.rs"]}]})


@query(_E + "not s like 'src/ASIA/%' and t like 'src/ASIA/%' and not t like '%.java'")
def lnt3_containment(spark, d):
    return _lint(spark, d, "containment", {"module": ["src/ASIA/**"], "public_api": ["src/ASIA/**/*.java"]})


@query(""", bad as (select s, t, line, is_type_only, list_filter(names, lambda x: x in ('p3', 'p7', 'default')) as f, list_filter(names, lambda x: x not in ('p3', 'p7', 'default')) as o from ends where t like '%.ts')
    select s as source_file, t as target_file, array_to_string(names, ',') as names, line from ends where t like '%.ts' and not is_type_only
    union all select s, t, array_to_string(f, ','), line from bad where len(f) > 0 union all select s, t, array_to_string(o, ','), line from bad where len(o) > 0""")
def lnt4_import_restriction(spark, d):
    some = ["p3", "p7", "default"]
    return _lint(spark, d, "import_restriction", {"target": ["**/*.ts"], "require_type_only": True, "forbidden_names": some, "allowed_names": some})


@query(_N + "where id in (select src from edges group by src having count(distinct dst) > 5) union all " + _N + "where id in (select dst from edges group by dst having count(distinct src) > 8)")
def lnt5_fan_limit(spark, d):
    return _lint(spark, d, "fan_limit", {"pattern": ["src/**"], "max_fan_out": 5, "max_fan_in": 8})


@query(", c as (select component, count(*) n, min(path) filter (path like '%.ts') as p from scc2 join nodes using (id) group by component) select p as source_file, p as target_file, '' as names, 0::bigint as line from c where n > 2 and p is not null")
def lnt6_cycle_policy(spark, d):
    return _lint(spark, d, "cycle_policy", {"pattern": ["**/*.ts"], "max_cycle_length": 2})


@query(", fo as (select src, count(distinct dst) as o from edges group by 1), fi as (select dst, count(distinct src) as i from edges group by 1), f as (select id, coalesce(o, 0) as o, coalesce(i, 0) as i from nodes left join fo on src = id left join fi on dst = id) " + _N + "where id in (select id from f where o + i > 0 and o / (o + i) > 0.6)")
def lnt7_stability_limit(spark, d):
    return _lint(spark, d, "stability_limit", {"pattern": ["**"], "max_instability": 0.6})


@query(_N + "where path like '%.rs' and not regexp_matches(path, 's[0-9]*[02468]\\.rs$')")
def lnt8_naming_boundary(spark, d):
    return _lint(spark, d, "naming_boundary", {"pattern": ["**/*.rs"], "must_match": r"s[0-9]*[02468]\.rs$"})


@query(_E + "t like 'src/AFRICA/%' and not (s like 'src/AFRICA/%' or s like '%.ts')")
def lnt9_restricted_consumer(spark, d):
    return _lint(spark, d, "restricted_consumer", {"target": ["src/AFRICA/**"], "allowed_consumers": ["src/AFRICA/**", "**/*.ts"]})


@query(_N + "where id in (select file_id from exports group by 1 having count(*) > 5)")
def lnt10_export_limit(spark, d):
    return _lint(spark, d, "export_limit", {"pattern": ["**"], "max_exports": 5})


@query(_E + "len(names) > 1")
def lnt11_coupling_weight(spark, d):
    return _lint(spark, d, "coupling_weight", {"pattern": ["**"], "max_names": 1})


@query("select sdir as source_file, sdir as target_file, '' as names, 0::bigint as line from ends group by sdir having count(*) filter (sdir <> tdir) / count(*) > 0.9")
def lnt12_cohesion(spark, d):
    return _lint(spark, d, "cohesion", {"pattern": ["**"], "max_external_ratio": 0.9})


@query("select s as source_file, t as target_file, array_to_string(names, ',') as names, line from ends where s like 'src/ASIA/%' and t like '%.ts' and not t like '%9.ts' union all " + _E + "s like 'src/ASIA/%' and t like 'src/EUROPE/%' and not t like '%9.ts'")
def lnt13_tag_boundary(spark, d):
    tags = {"asia": ["src/ASIA/**"], "ts": ["**/*.ts"], "europe": ["src/EUROPE/**"], "nine": ["**/*9.ts"]}
    return _lint(spark, d, "tag_boundary", {"from_tag": "asia", "deny_tags": ["ts", "europe", "unknown"], "except_tags": ["nine"]}, tags=tags)


def _config() -> lint.LintConfig:
    return lint.LintConfig([
        lint.Rule("asia-europe", "error", "ASIA must not import EUROPE", "boundary", {"from": ["src/ASIA/**"], "deny": ["src/EUROPE/**"]}),
        lint.Rule("exports", "warning", "too many exports", "export_limit", {"pattern": ["**"], "max_exports": 5}),
        lint.Rule("weight", "info", "too many names", "coupling_weight", {"pattern": ["**"], "max_names": 1}),
    ])


_V = """, v as (select 'asia-europe' as rule_id, 'error' as severity, s as source_file, t as target_file, line from ends where s like 'src/ASIA/%' and t like 'src/EUROPE/%'
    union all select 'exports', 'warning', path, path, 0 from nodes where id in (select file_id from exports group by 1 having count(*) > 5) union all select 'weight', 'info', s, t, line from ends where len(names) > 1)"""


@query(_V + " select count(*) as total_violations, count(*) filter (severity = 'error') as errors, count(*) filter (severity = 'warning') as warnings, count(*) filter (severity = 'info') as infos, count(distinct rule_id) as rules_violated from v")
def agg10_lint_summary(spark, d):
    return lint.summary(lint.evaluate(_config(), _g(spark, d)))


@query(_V + " select rule_id, severity, source_file, target_file, line from v where severity in ('error', 'warning')")
def prd7_severity_threshold(spark, d):
    return lint.evaluate(_config(), _g(spark, d), threshold="warning").select("rule_id", "severity", "source_file", "target_file", "line")


@query(_V + " select rule_id, severity, source_file, target_file, line from v where rule_id <> 'weight' or line > 3")
def lnt15_baseline(spark, d):
    found = lint.evaluate(_config(), _g(spark, d))
    base = found.where("rule_id = 'weight' and line <= 3").select("rule_id", "source_file", "target_file", "line")
    return lint.suppress(found, base).select("rule_id", "severity", "source_file", "target_file", "line")


# ------------------------------------------------------------------ sorts, sets, functions

@query(_V + " select rule_id, source_file, line from v order by case severity when 'error' then 0 when 'warning' then 1 else 2 end, source_file, line")
def srt4_ordered_violations(spark, d):
    return lint.ordered(lint.evaluate(_config(), _g(spark, d))).select("rule_id", "source_file", "line")


@query("select path, exported_name from dead_exports order by path desc, exported_name desc limit 25")
def srt6_srt7_sort_and_limit(spark, d):
    return post.sort_limit(analysis.dead_exports(_g(spark, d)).select("path", "exported_name"), ["path", "exported_name"], reverse=True, limit=25)


@query("select (select count(*) from dead_files) + (select count(*) from dead_exports) as count")
def srt8_count(spark, d):
    g = _g(spark, d)
    return post.count_of({"dead_files": analysis.dead_files(g), "dead_exports": analysis.dead_exports(g)})


@query("select path from nodes where entry union select path from nodes where language = 'rust'")
def set1_union(spark, d):
    n = virtual.nodes(spark, d)
    return n.where("is_entry_point").select("path").union(n.where("language = 'rust'").select("path")).distinct()


@query("(select path from nodes where entry) except (select path from nodes where language = 'rust')")
def set2_except(spark, d):
    n = virtual.nodes(spark, d)
    return n.where("is_entry_point").select("path").subtract(n.where("language = 'rust'").select("path"))


@query("select src, dst, array_to_string(list_filter(names, lambda x: x like '%7'), ',') as names from edges")
def set4_array_filter(spark, d):
    return _g(spark, d).edges.select("src", "dst", F.array_join(F.filter("imported_names", lambda x: x.endswith("7")), ",").alias("names"))


@query("select path, dir as directory, stem || '.' || regexp_extract(path, '\\.([a-z]+)$', 1) as filename, stem, regexp_extract(path, '\\.([a-z]+)$', 1) as extension from nodes")
def fn1_path_functions(spark, d):
    p = F.col("path")
    return virtual.nodes(spark, d).select("path", paths.parent(p).alias("directory"), paths.file_name(p).alias("filename"), paths.stem(p).alias("stem"), paths.extension(p).alias("extension"))


@query("select id, path, dir as path_directory, stem || '.' || regexp_extract(path, '\\.([a-z]+)$', 1) as path_filename, regexp_extract(path, '\\.([a-z]+)$', 1) as path_extension, language as path_language from nodes")
def fn2_enrich(spark, d):
    return paths.enrich(virtual.nodes(spark, d).select("id", "path"), ["path"])


@query("select strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as iso, count(*) as n from events group by 1")
def fn6_iso_time(spark, d):
    e = virtual.table(spark, d, "events")
    return e.groupBy(post.iso_utc(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("iso")).agg(F.count("*").alias("n"))


@query("select 'edge' as kind, src as id, null as path, array_to_string(names, ';') as names from edges union all select 'node', id, path, null from nodes")
def fn7_fn8_csv_rows(spark, d):
    g = _g(spark, d)
    return post.csv_rows({"edges": g.edges.select(F.lit("edge").alias("kind"), F.col("src").alias("id"), F.col("imported_names").alias("names")), "nodes": g.nodes.select(F.lit("node").alias("kind"), "id", "path")})


@query("select id, path from nodes where language = 'rust' and id > 5")
def fn11_jq_select(spark, d):
    return post.jq(virtual.nodes(spark, d), '.[] | select(.language == "rust" and .id > 5) | {id, path}')


# ------------------------------------------------------------------ incremental maintenance

@query("""select coalesce(o.id, 1000000 + row_number() over (partition by o.id is null order by n.path)) as id, coalesce(n.path, o.path) as path,
    case when n.path is null then 'deleted' when o.path is null then 'new' when o.mtime >= n.mtime then 'unchanged' else 'changed' end as state
    from (select path, id % 5 as mtime from nodes where path not like 'src/ASIA/%') n full join (select id, path, 2 as mtime from nodes where path not like 'src/EUROPE/%') o on n.path = o.path""")
def snk7_incremental_classification(spark, d):
    from graphloom.sources import store

    n = virtual.nodes(spark, d)
    found = n.where("path not like 'src/ASIA/%'").select("path", (F.col("id") % 5).alias("mtime"))
    old = n.where("path not like 'src/EUROPE/%'").select("id", "path", F.lit(2).cast("long").alias("mtime"))
    return store.classify(old, found, first_id=1_000_001).select("id", "path", "state")


@query("select id, path, case when entry then 9 else 1 end::bigint as mtime from nodes")
def snk1_upsert(spark, d):
    from graphloom.sources import store

    n = virtual.nodes(spark, d).select("id", "path", F.lit(1).cast("long").alias("mtime"))
    return store.upsert(n, n.join(virtual.nodes(spark, d).where("is_entry_point").select("id"), "id", "left_semi").withColumn("mtime", F.lit(9).cast("long")), ["id"])


@query("select id, file_id, name from symbols where file_id not in (select id from nodes where language = 'rust')")
def snk4_cascade_delete(spark, d):
    from graphloom.sources import store

    gone = virtual.nodes(spark, d).where("language = 'rust'").select(F.col("id").alias("file_id"))
    return store.without_files({"symbols": virtual.symbols(spark, d)}, gone)["symbols"].select("id", "file_id", "name")


# ------------------------------------------------------------------ the store, settings and output

def _stored(spark, d):
    """The virtual code base's files, symbols, references and exports as stored tables."""
    from graphloom.schema import DDL, schema

    f = virtual.nodes(spark, d).select("id", "path", F.lit(1).alias("mtime"), "language")
    s = virtual.symbols(spark, d)
    r = virtual.symbol_graph(spark, d).refs
    r = r.select(F.xxhash64("source_id", "target_id", "kind").alias("id"), "source_id", "target_id", "kind", F.floor(F.col("source_id") / 8).alias("file_id"))
    i = virtual.edge_rows(spark, d)
    i = i.select(F.xxhash64(*i.columns).alias("id"), F.col("src").alias("file_id"), F.concat(F.lit("#"), F.col("dst").cast("string")).alias("source_path"), F.col("name").alias("imported_name"), "is_type_only")
    e = virtual.export_rows(spark, d).withColumn("id", F.xxhash64("file_id", "exported_name"))
    full = lambda t, df: df.select(*(F.col(x.name).cast(x.dataType).alias(x.name) if x.name in df.columns else F.lit(None).cast(x.dataType).alias(x.name) for x in schema(t)))
    return {t: full(t, df) for t, df in zip(DDL, (f, s, r, i, e))}


def _store(spark, *versions):
    """A store in the shared folder with these versions written one after the other."""
    from graphloom.shared import new_path
    from graphloom.sources import store

    s = store.Store(spark, new_path(spark, "store"))
    for v in versions:
        s.write(v)
    return s


def _sizes(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_SIZES = "select unnest(['files', 'symbols', 'refs', 'imports', 'exports']) as name, unnest([(select count(*) from nodes), (select count(*) from symbols), (select count(*) from symbol_refs), (select count(*) from edges_rows), (select count(*) from exports)]) as n"


@query(_SIZES)
def src7_src8_snk6_store_round_trip(spark, d):
    """All five tables written as a version and read back; of the version before nothing shows."""
    t = _stored(spark, d)
    return _sizes(_store(spark, {**t, "exports": t["exports"].where("false")}, t).read())


@query(_SIZES.replace("from symbols)", "from symbols where file_id in (select id from nodes where not entry))").replace("from symbol_refs)", "from symbol_refs where source_id // 8 in (select id from nodes where not entry) and target_id // 8 in (select id from nodes where not entry))").replace("from edges_rows)", "from edges_rows where src in (select id from nodes where not entry))").replace("from exports)", "from exports where file_id in (select id from nodes where not entry))"))
def snk5_clear_file_rows(spark, d):
    """Entry points lose all rows but their own in files."""
    from graphloom.sources import store

    t = _stored(spark, d)
    cleared = store.without_files({k: v for k, v in t.items() if k != "files"}, t["files"].where("id % 10 = 1").select(F.col("id").alias("file_id")))
    return _sizes({"files": t["files"], **cleared})


@query("select id, case when kind = 'class' then 'renamed' else name end as name from symbols")
def snk2_replace_symbols(spark, d):
    from graphloom.sources import store

    s = _stored(spark, d)["symbols"]
    return store.upsert(s, s.where("kind = 'class'").withColumn("name", F.lit("renamed")), ["id"]).select("id", "name")


@query("select file_id, count(*) as n from (select src as file_id from edges_rows union all select file_id from exports) group by 1")
def snk3_append_imports_and_exports(spark, d):
    """Two appended tables of a store, counted by file."""
    s = _store(spark, _stored(spark, d)).read()
    return s["imports"].select("file_id").unionByName(s["exports"].select("file_id")).groupBy("file_id").agg(F.count("*").alias("n"))


@query("select (select count(*) from nodes where path not like 'src/ASIA/%' and entry) + (select count(*) from nodes where path like 'src/EUROPE/%' and not entry) as files_indexed, (select count(*) from nodes where path not like 'src/ASIA/%' and path not like 'src/EUROPE/%' and not entry) as files_unchanged, (select count(*) from nodes where path like 'src/ASIA/%') as files_deleted, (select count(*) from nodes where path not like 'src/ASIA/%' and entry) + (select count(*) from nodes where path like 'src/EUROPE/%' and not entry) as symbols, 0::bigint as errors")
def snk7_snk9_incremental_index(spark, d):
    """A second scan of a store: files of one region are gone, another's are new, entry points have changed; each has one function."""
    from graphloom.sources import index, store

    n = virtual.nodes(spark, d)
    text = F.when(F.col("language") == "rust", "fn a() {}").when(F.col("language") == "java", "class A {}").otherwise("function a() {}").alias("content")
    before = n.where("path not like 'src/EUROPE/%'").select("path", F.lit(5).cast("long").alias("mtime"), "language", text)
    empty = {t: spark.createDataFrame([], s) for t, s in store.DDL.items()}
    tables, _ = index.refresh(empty, before)
    s = _store(spark, tables)
    after = n.where("path not like 'src/ASIA/%'").select("path", F.when(F.col("is_entry_point"), 9).otherwise(5).cast("long").alias("mtime"), "language", text)
    _, summary = index.refresh(s.read(), after)
    return summary.select("files_indexed", "files_unchanged", "files_deleted", "symbols", "errors")


@query(_SNAP + " select path, exported_name, change from changes")
def src17_second_snapshot_from_a_store(spark, d):
    """Two stores compared: the one before opened beside the one after."""
    from graphloom.sources import index

    sides = []
    for after in (False, True):
        t = _stored(spark, d)
        snap = virtual.snapshot(spark, d, after)
        files = t["files"].join(snap.select("path").distinct(), "path", "left_semi").select(*t["files"].columns)
        own = files.select(F.col("id").alias("file_id"), "path").join(snap.where("exported_name is not null"), "path")
        rows = own.select(*(F.col(c) if c in ("file_id", "exported_name") else F.lit(None).cast(t["exports"].schema[c].dataType).alias(c) for c in t["exports"].columns))
        sides.append(index.snapshot(_store(spark, {**t, "files": files, "exports": rows}).read()))
    return analysis.diff_exports(*sides)


@query(_V + " select rule_id, source_file, target_file, line from v where rule_id <> 'weight'")
def src16_snk10_baseline_file(spark, d):
    """Violations of one rule are frozen into a baseline file, which is read back and subtracted."""
    from graphloom.shared import new_path
    from graphloom.sources import configs

    found = lint.evaluate(_config(), _g(spark, d).stored())
    at = new_path(spark, "baseline") + ".json"
    configs.write_baseline(found.where("rule_id = 'weight'"), at)
    return lint.suppress(found, configs.read_baseline(spark, at)).select("rule_id", "source_file", "target_file", "line")


@query(_V + " select rule_id, source_file, target_file, line from v where rule_id = 'exports'")
def prd8_src12_one_rule_of_a_file(spark, d):
    """Rules read from TOML, one of them asked for."""
    from graphloom.sources import configs

    rules = configs.parse_rules("""
[[rules]]
id = "asia-europe"
severity = "error"
description = "ASIA must not import EUROPE"
[rules.boundary]
from = ["src/ASIA/**"]
deny = ["src/EUROPE/**"]
[[rules]]
id = "exports"
severity = "warning"
description = "too many exports"
[rules.export_limit]
pattern = ["**"]
max_exports = 5
""")
    return lint.evaluate(rules, _g(spark, d), only="exports").select("rule_id", "source_file", "target_file", "line")


@query("select path, regexp_matches(stem, '^(index|main|app|server|cli)$') or (language = 'java' and regexp_matches(stem, '^Test|(Test|Tests|IT|Application)$')) or (language = 'rust' and stem in ('lib', 'build')) or regexp_matches(path, '^src/ASIA/.*7\\.ts$') or id in (select file_id from unresolved where import_path = 'pkg7') as is_entry_point from nodes")
def src13_entry_points_from_settings(spark, d):
    """Patterns and annotations of a settings file."""
    from graphloom.sources import configs

    patterns, annotations = configs.entry_points('rules = []\n[entry_points]\npatterns = ["src/ASIA/**/*7.ts"]\nannotations = ["pkg7"]')
    imports = virtual.unresolved_rows(spark, d).select("file_id", F.concat(F.lit("@annotation:"), "import_path").alias("source_path"))
    marked = graph.mark_entry_points(virtual.nodes(spark, d).drop("is_entry_point"), graph.entry_points_by_annotation(imports, annotations), patterns)
    return marked.select("path", "is_entry_point")


@query(", c as (select component, count(*) n, min(path) as p from scc2 join nodes using (id) group by component) select 'long' as rule_id, p as source_file from c where n > 2 union all select 'any', p from c")
def lnt14_cycles_shared_by_rules(spark, d):
    """Two rules on cycles; the components are computed once and written."""
    rules = [lint.Rule(n, "info", "", "cycle_policy", {"max_cycle_length": k}) for n, k in (("long", 2), ("any", 0))]
    return lint.evaluate(lint.LintConfig(rules), _g(spark, d)).select("rule_id", "source_file")


@query(_DEPTH.format(s=1001, a="src", b="dst", m=4, more="").replace("select l.id, n.path, l.depth from", "select (select count(distinct dst) from edges where src = 1001) as direct_imports, (select count(distinct src) from edges where dst = 1001) as direct_imported_by, count(*) as transitive_imports, 0::bigint as transitive_imported_by from"))
def agg14_deps_summary(spark, d):
    g = _g(spark, d)
    far = analysis.deps(g, 1001, transitive=True, max_depth=4)
    return analysis.deps_summary(g, 1001, far, far.where("false"), True)


@query("select unnest([(select count(*) from unresolved) || ' imports could not be resolved', (select count(distinct file_id) from unresolved) || ' files have unresolvable imports']) as description, unnest([(select count(*) from unresolved), (select count(distinct file_id) from unresolved)]) as count")
def agg15_limitations(spark, d):
    return analysis.limitations(_g(spark, d))


@query("select row_number() over (order by path, exported_name) as place, path, exported_name from dead_exports")
def srt1_dead_exports_in_order(spark, d):
    """The order that the command lists them in, as numbers."""
    rows = post.in_order("dead_exports", analysis.dead_exports(_g(spark, d)).select("path", "exported_name"))
    return _numbered(rows)


@query(_DEPTH.format(s=1001, a="dst", b="src", m=3, more="").replace("select l.id, n.path, l.depth", "select row_number() over (order by l.depth, n.path) as place, n.path, l.depth"))
def srt2_affected_in_order(spark, d):
    return _numbered(post.in_order("affected", analysis.impact(_g(spark, d), 1001, 3).select("path", "depth")))


@query(_SNAP + " select row_number() over (order by path, change, exported_name) as place, path, exported_name, change from changes")
def srt5_changes_in_order(spark, d):
    return _numbered(post.in_order("changes", analysis.diff_exports(virtual.snapshot(spark, d, False), virtual.snapshot(spark, d, True))))


def _numbered(rows: DataFrame) -> DataFrame:
    """The rows of a sorted frame with their places: the sort's ranges are counted, then numbers within them shifted."""
    from graphloom.shared import written

    own = written(rows.withColumn("_m", F.monotonically_increasing_id()), "in-order").withColumn("_b", F.shiftright("_m", 33))
    sizes = own.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b._b") < F.col("a._b"), "left").groupBy(F.col("a._b").alias("_b")).agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_before"))  # a row per range
    return own.join(F.broadcast(before), "_b").select((F.col("_m").bitwiseAND((1 << 33) - 1) + 1 + F.col("_before")).alias("place"), *rows.columns)


@query("select '{\"id\":' || id || ',\"path\":\"' || path || '\",\"tags\":null}' as json from nodes")
def fn9_json_rows(spark, d):
    return post.json_rows(virtual.nodes(spark, d).select("id", "path", F.lit(None).cast("string").alias("tags")))


@query("select t || ' <- ' || s || ' [' || array_to_string(names, ';') || ']' as line from ends")
def fn10_text_rows(spark, d):
    rows = analysis.edge_paths(_g(spark, d)).select("src_path", "dst_path", "imported_names")
    return post.text_rows(rows, "{dst_path} <- {src_path} [{imported_names}]")


@query("select dir as path, stem as name from nodes where language <> 'java'")
def fn11_jq_map_and_or(spark, d):
    rows = virtual.nodes(spark, d).select(paths.parent(F.col("path")).alias("dir"), paths.stem(F.col("path")).alias("stem"), "language")
    return post.jq(rows, '.[] | select(.language == "rust" or .language == "typescript") | {path: .dir, name: .stem}')


@query("select target_id as id from symbol_refs where source_id = (select min(source_id) from symbol_refs)")
def alg11_callees(spark, d):
    s = virtual.symbol_graph(spark, d)
    return s.callees(s.refs.agg(F.min("source_id")).first()[0])


@query("select distinct src as id from edges where dst = 1")
def grf10_direct_importers(spark, d):
    return _g(spark, d).importers_of(1)


@query("select (select count(*) from symbols where file_id in (select id from nodes where language = 'java')) as symbols, (select count(*) from symbol_refs where source_id // 8 in (select id from nodes where language = 'java') and target_id // 8 in (select id from nodes where language = 'java')) as refs")
def grf11_merged_symbol_graphs(spark, d):
    """The graph of one language's files, merged with an empty one."""
    s = virtual.symbol_graph(spark, d)
    own = s.symbols.join(virtual.nodes(spark, d).where("language = 'java'").select(F.col("id").alias("file_id")), "file_id", "left_semi").select(*s.symbols.columns)
    part = graph.SymbolGraph.build(own, s.refs).merged(own.where("false"), s.refs.where("false"))
    return part.symbols.agg(F.count("*").alias("symbols")).select("symbols", part.refs.agg(F.count("*")).scalar().alias("refs"))


# ------------------------------------------------------------------ extraction and resolution, over the virtual code base written out as text

def _extracted(spark, d, language: str, table: str) -> DataFrame:
    from graphloom.sources import extract

    return extract.tables(extract.extract(virtual.sources(spark, d, language), (table,)))[table]


def _flags(df: DataFrame) -> DataFrame:
    return df.select("file_id", "imported_name", "local_name", "is_default", "is_namespace", "is_type_only", "is_side_effect", "is_dynamic")


#: Rows that every file has, or that it has by the name it defines: (slot or None, columns).
def _per_file(columns: str, rows: list[tuple]) -> str:
    """SQL for rows of (slot, values...): one for each file, or for each file that defines the slot's name."""
    lit = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"
    values = ", ".join(f"({'null' if r[0] is None else r[0]}, {', '.join(lit(v) for v in r[1:])})" for r in rows)
    return f"""select file_id, {columns} from (select id as file_id, x.* from nodes, (values {values}) as x(slot, {columns}) where slot is null
        union all select f.file_id, x.* from (select distinct src as file_id, own from items) f join (values {values}) as x(slot, {columns}) on x.slot = f.own)"""


_TS_RE = [(None, "r1", "r1", False, False, False, False, False), (None, "r2", "r3", False, False, False, False, False), (None, "*", "", False, True, False, False, False)]
_FLAGS = "imported_name, local_name, is_default, is_namespace, is_type_only, is_side_effect, is_dynamic"
_TS_NAMED = """case when name = 'default' then 'default' when name = '*' then '*' when name like 's%' then '' when line = 7 then '*' else name end"""


@query(f"""select src as file_id, {_TS_NAMED} as imported_name,
    case when name = 'default' then 'd' || dst when name = '*' then 'n' || dst when name like 's%' or line = 7 then '' when is_mod and not is_type_only then 'q' else name end as local_name,
    name = 'default' as is_default, name = '*' or (line = 7 and name like 'p%') as is_namespace, name like 'p%' and line <> 7 and is_type_only as is_type_only, name like 's%' as is_side_effect, name like 'p%' and line = 7 as is_dynamic
    from edges_rows union all {_per_file(_FLAGS, _TS_RE)}""")
def ext3_ext4_ts_imports(spark, d):
    return _flags(_extracted(spark, d, "typescript", "imports"))


_TS_SYMBOLS = [
    (0, "p0", "p0", "function", "public"), (1, "p1", "p1", "class", "public"), (1, "run", "p1::run", "method", "public"), (1, "size", "p1::size", "variable", "public"), (2, "p2", "p2", "interface", "public"),
    (3, "p3", "p3", "enum", "public"), (3, "A", "p3::A", "enum_variant", "public"), (3, "B", "p3::B", "enum_variant", "public"), (4, "p4", "p4", "constant", "public"), (5, "p5", "p5", "type_alias", "public"),
    (6, "x6", "x6", "constant", "public"), (6, "p6", "p6", "constant", "public"), (7, "p7", "p7", "function", "public"), (None, "helper", "helper", "function", "private"), (None, "Base", "Base", "class", "private"),
    (None, "r1", "r1", "export", "public"), (None, "r3", "r3", "export", "public"), (None, "*", "*", "export", "public"),
]
_NAMED = "name, qualified_name, kind, visibility"


@query(_per_file(_NAMED, _TS_SYMBOLS))
def ext2_ts_symbols(spark, d):
    return _extracted(spark, d, "typescript", "symbols").select("file_id", "name", "qualified_name", "kind", "visibility")


@query(_per_file("exported_name, is_default, is_reexport, source_path", [*((k, n, False, False, None) for k, n in ((0, "p0"), (1, "p1"), (2, "p2"), (3, "p3"), (4, "p4"), (5, "p5"), (6, "x6"), (6, "p6"), (7, "p7"))), (None, "aid", False, False, None), (None, "r1", False, True, "./re"), (None, "r3", False, True, "./re"), (None, "*", False, True, "./star")]))
def ext5_ts_exports(spark, d):
    return _extracted(spark, d, "typescript", "exports").select("file_id", "exported_name", "is_default", "is_reexport", "source_path")


def _refs(spark, d, language: str) -> DataFrame:
    from graphloom.sources import extract

    return extract.named_refs(extract.extract(virtual.sources(spark, d, language), ("symbols", "refs")))


@query(_per_file("source, target, kind", [(0, "p0", "helper", "call"), (1, "p1", "Base", "inheritance"), (1, "p1::run", "helper", "call"), (7, "p7", "Base", "call")]))
def ext6_ext7_ts_references(spark, d):
    """Those whose target the file defines once: ``Face`` isn't defined."""
    return _refs(spark, d, "typescript")


_JAVA = [
    (None, "Holder", "a.b.Holder", "class", "public"), (None, "helper", "a.b.Holder.helper", "method", "private"), (None, "Mark", "a.b.Mark", "annotation", "private"), (0, "p0", "a.b.Holder.p0", "method", "public"), (1, "p1", "a.b.Holder.p1", "method", "public"),
    (2, "P2", "a.b.Holder.P2", "constant", "public"), (3, "p3", "a.b.Holder.p3", "variable", "private"), (4, "P4", "a.b.Holder.P4", "enum", "public"), (4, "RED", "a.b.Holder.P4.RED", "enum_variant", "public"), (4, "GREEN", "a.b.Holder.P4.GREEN", "enum_variant", "public"),
    (5, "P5", "a.b.Holder.P5", "interface", "private"), (5, "go", "a.b.Holder.P5.go", "method", "public"), (6, "P6", "a.b.Holder.P6", "class", "public"), (7, "p7", "a.b.Holder.p7", "method", "protected"),
]


@query(_per_file(_NAMED, _JAVA))
def ext8_java_symbols(spark, d):
    return _extracted(spark, d, "java", "symbols").select("file_id", "name", "qualified_name", "kind", "visibility")


@query(_per_file("exported_name", [(None, "Holder"), (4, "P4"), (6, "P6")]))
def ext9_java_exports(spark, d):
    return _extracted(spark, d, "java", "exports").select("file_id", "exported_name")


_JAVA_IMPORTS = [(None, "java.util.List", "List", False, False), (None, "a.c.Util.max", "max", False, False), (None, "a.d.*", "*", True, False), (None, "@annotation:Service", "Service", False, True), (None, "@type-ref:Base", "Base", False, True), (None, "@type-ref:Face", "Face", False, True), (1, "@annotation:Deprecated", "Deprecated", False, True)]


@query("select file_id, source_path, imported_name, is_namespace, is_type_only from (" + _per_file("source_path, imported_name, is_namespace, is_type_only", _JAVA_IMPORTS) + ") union all select distinct src, '@type-ref:String', 'String', false, true from items where own in (0, 3)")
def ext10_ext11_ext12_java_imports(spark, d):
    return _extracted(spark, d, "java", "imports").select("file_id", "source_path", "imported_name", "is_namespace", "is_type_only")


@query("with calls as (select distinct src as file_id, own from items) select file_id, 'a.b.Holder.p0' as source, 'a.b.Holder.helper' as target, 'call' as kind from calls where own = 0 union all select a.file_id, 'a.b.Holder.p7', 'a.b.Holder.p0', 'call' from calls a join calls b on b.file_id = a.file_id and b.own = 0 where a.own = 7".replace("with calls as", ", calls as"))
def ext13_java_references(spark, d):
    return _refs(spark, d, "java")


_RUST = [
    (None, "Thing", "Thing", "export", "public"), (None, "inner", "inner", "module", "private"), (None, "helper", "helper", "function", "private"), (None, "Whole", "Whole", "struct", "public"), (None, "Act", "Act", "interface", "private"), (None, "act", "Act::act", "method", "private"),
    (None, "act", "Whole::act", "method", "private"), (None, "outer", "outer", "module", "public"), (None, "deep", "outer::deep", "function", "protected"), (0, "p0", "p0", "function", "public"), (1, "P1", "P1", "struct", "public"), (1, "make", "P1::make", "method", "public"), (2, "P2", "P2", "enum", "public"),
    (2, "A", "P2::A", "enum_variant", "public"), (2, "B", "P2::B", "enum_variant", "public"), (3, "P3", "P3", "interface", "public"), (3, "go", "P3::go", "method", "private"), (4, "P4", "P4", "constant", "public"), (5, "P5", "P5", "variable", "private"), (6, "P6", "P6", "type_alias", "public"), (7, "p7", "p7", "function", "private"),
]


@query(_per_file(_NAMED, _RUST))
def ext14_rust_symbols(spark, d):
    return _extracted(spark, d, "rust", "symbols").select("file_id", "name", "qualified_name", "kind", "visibility")


_RUST_IMPORTS = [(None, "crate::a", "a", "a", False), (None, "crate::a::b", "b", "b", False), (None, "crate::a::c", "c", "d", False), (None, "super::up::*", "*", "*", False), (None, "self::low::Thing", "Thing", "Thing", False), (None, "extern::serde", "serde", "serde", False), (None, "@mod:inner", "inner", "inner", True)]


@query(_per_file("source_path, imported_name, local_name, is_side_effect", _RUST_IMPORTS))
def ext15_ext16_ext17_rust_imports(spark, d):
    return _extracted(spark, d, "rust", "imports").select("file_id", "source_path", "imported_name", "local_name", "is_side_effect")


@query(_per_file("source, target, kind", [(None, "Whole", "Act", "inheritance"), (None, "Whole::act", "helper", "call"), (0, "p0", "helper", "call"), (1, "P1::make", "P1", "call"), (1, "P1::make", "P1", "type_usage")]))
def ext18_rust_impls_and_references(spark, d):
    return _refs(spark, d, "rust")


@query("select language, count(*) as files, count(*) filter (language = 'cobol') as errors from (select language from nodes where language <> 'java' union all select 'cobol' from nodes where language = 'java') group by 1")
def ext1_snk8_dispatch_and_errors(spark, d):
    """Each file by its language; a language without a parser yields an error and no rows."""
    from graphloom.sources import extract

    files = virtual.nodes(spark, d).select(F.col("id").alias("file_id"), F.when(F.col("language") == "java", "cobol").otherwise(F.col("language")).alias("language"), F.lit("fn a() {}").alias("content"))
    got = extract.extract(files).join(files, "file_id")
    return got.groupBy("language").agg(F.count("*").alias("files"), F.count_if(F.col("error").isNotNull() & (F.size("symbols") == 0)).alias("errors"))


def _resolved(spark, d) -> DataFrame:
    from graphloom.operators import resolve

    files = virtual.nodes(spark, d).select(F.col("id").alias("from_id"), F.col("path").alias("from_path"))
    imports = _extracted(spark, d, "typescript", "imports")
    asked = imports.select(F.col("id").alias("import_id"), F.col("file_id").alias("from_id"), F.col("source_path").alias("source"), "imported_name", "is_type_only", "line_start").join(files, "from_id")
    return resolve.resolve_ts(asked, virtual.nodes(spark, d).select("id", "path"))


@query(f"select src, dst, array_to_string(list_sort(list({_TS_NAMED})), ',') as names, bool_and(name like 'p%' and line <> 7 and is_type_only) as is_type_only from edges_rows where dst % 3 = 0 and dst in (select id from nodes) group by src, dst")
def res4_grf1_round_trip(spark, d):
    """Text to rows to resolved edges: the graph that the text was written from, as far as its targets are TypeScript."""
    rows = _resolved(spark, d).where("status = 'resolved'")
    e = graph.build_edges(rows.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), F.col("imported_name").alias("name"), "is_type_only", F.lit(False).alias("is_mod_declaration"), F.col("line_start").alias("line")))
    return e.select("src", "dst", _names(), "is_type_only")


@query(f"select src as from_id, {_TS_NAMED} as imported_name, 'file_not_found' as detail from edges_rows where dst % 3 <> 0 and dst in (select id from nodes) union all select id, unnest(['r1', 'r2', '*']), 'file_not_found' from nodes")
def res4_unresolved(spark, d):
    return _resolved(spark, d).where("status = 'unresolved'").select("from_id", "imported_name", "detail")


def _asked(rows: DataFrame, source: "F.Column") -> DataFrame:
    """Imports (import_id, from_id, from_path, source) from rows (src, dst, line, p, q): the paths of both ends."""
    return rows.select(F.xxhash64("src", "dst", "name", "line", "is_type_only", "is_mod_declaration").alias("import_id"), F.col("src").alias("from_id"), F.col("p").alias("from_path"), source.alias("source"))


def _both_ends(spark, d) -> DataFrame:
    n = virtual.nodes(spark, d)
    return virtual.edge_rows(spark, d).distinct().join(n.select(F.col("id").alias("src"), F.col("path").alias("p")), "src").join(n.select(F.col("id").alias("dst"), F.col("path").alias("q")), "dst")


_PAIRS = ", pairs as (select e.*, a.path as p, b.path as q, b.stem as stem, b.region as region, b.nation as nation, b.ext as ext, a.dir as pdir, b.dir as qdir from (select distinct * from edges_rows) e join nodes a on a.id = e.src join nodes b on b.id = e.dst)"


@query(_PAIRS + """ select src as from_id, case when is_mod then '#/' || region || '/' || nation || '/' || stem else nation || '/' || stem || '/x' end as source, case when is_mod and ext = 'ts' then 'resolved' else 'external' end as status,
    case when is_mod and ext = 'ts' then dst end as to_id, case when is_mod and ext = 'ts' then 'path_alias' end as caveat, case when is_mod and ext = 'ts' then null when is_mod then '#' else nation end as detail from pairs""")
def res5_res6_path_aliases(spark, d):
    """Imports by alias, and bare ones, which no alias fits."""
    from graphloom.operators import resolve

    q = F.regexp_replace(F.regexp_replace("q", "^src/", "#/"), r"\.\w+$", "")
    bare = F.concat(F.regexp_replace(F.regexp_replace("q", "^src/[^/]*/", ""), r"\.\w+$", ""), F.lit("/x"))
    asked = _asked(_both_ends(spark, d), F.when(F.col("is_mod_declaration"), q).otherwise(bare))
    config = resolve.TsConfig.of({"paths": {"#/*": ["./lib/*", "src/*"]}})
    return resolve.resolve_ts(asked, virtual.nodes(spark, d).select("id", "path"), config).select("from_id", "source", "status", "to_id", "caveat", "detail")


def _java_files(spark, d) -> DataFrame:
    """Every file as a Java class, in a package named after its region."""
    n = virtual.nodes(spark, d)
    path = F.concat(F.lit("src/main/java/org/"), F.translate(F.split("path", "/")[1], " ", "_"), F.lit("/S"), F.col("id").cast("string"), F.lit(".java"))
    return n.select("id", path.alias("path"))


@query(_PAIRS + """, j as (select src, dst, line, is_mod, is_type_only, name, replace(region, ' ', '_') as pk, replace(split_part(p, '/', 2), ' ', '_') as mine from pairs)
    select src as from_id, case when name = '*' then 'java.util.S' || dst when line = 1 then '@type-ref:S' || dst when line = 2 then 'org.' || pk || '.S' || dst || '.Inner' else 'org.' || pk || '.S' || dst end as source,
    case when name = '*' then 'external' when line = 1 and (pk <> mine or src = dst) then 'unresolved' else 'resolved' end as status, case when name = '*' or line = 1 and (pk <> mine or src = dst) then null else dst end as to_id,
    case when name = '*' then 'java.util.S' || dst when line = 1 and (pk <> mine or src = dst) then 'file_not_found' end as detail from j""")
def res8_res9_res10_res12_java(spark, d):
    """Imports of classes, of nested ones, of other libraries, and types of the same package."""
    from graphloom.operators import resolve

    files = _java_files(spark, d)
    rows = virtual.edge_rows(spark, d).distinct().join(files.select(F.col("id").alias("src"), F.col("path").alias("p")), "src").join(files.select(F.col("id").alias("dst"), F.col("path").alias("q")), "dst")
    dst = F.col("dst").cast("string")
    full = F.regexp_replace(F.regexp_replace("q", r"^src/main/java/|\.java$", ""), "/", ".")
    source = F.when(F.col("name") == "*", F.concat(F.lit("java.util.S"), dst)).when(F.col("line") == 1, F.concat(F.lit("@type-ref:S"), dst)).when(F.col("line") == 2, F.concat(full, F.lit(".Inner"))).otherwise(full)
    return resolve.resolve_java(_asked(rows, source), files).select("from_id", "source", "status", "to_id", "detail")


@query(", j as (select id, replace(region, ' ', '_') as pk from nodes) select a.id as from_id, 'resolved' as status, b.id as to_id from j a join j b on a.pk = b.pk and a.id <> b.id union all select id, 'external', null from j")
def res11_java_wildcards(spark, d):
    """Every file imports all of its package, and a package that isn't there. The rows are the pairs of each package's files."""
    from graphloom.operators import resolve

    files = _java_files(spark, d)
    own = F.concat(F.translate(F.regexp_replace("path", r"^src/main/java/|/[^/]*$", ""), "/", "."), F.lit(".*"))
    asked = files.select(F.col("id").alias("from_id"), F.col("path").alias("from_path"), F.explode(F.array(own, F.lit("org.gone.*"))).alias("source")).withColumn("import_id", F.xxhash64("from_id", "source"))
    return resolve.resolve_java(asked, files).select("from_id", "status", "to_id")


@query("select 'x' as root, unnest(['src/main/java', 'src']) as found")
def res13_java_source_roots(spark, d):
    from graphloom.operators import resolve

    files = _java_files(spark, d)
    found = resolve.java_roots(files)
    return files.limit(1).select(F.lit("x").alias("root"), F.explode(F.array(*(F.lit(r) for r in found))).alias("found"))


def _rust_files(spark, d) -> DataFrame:
    """Every file as a Rust module: a crate per region, a folder per nation, and each crate's root."""
    n = virtual.nodes(spark, d)
    parts = F.split(F.translate("path", " ", "_"), "/")
    crate = F.concat(parts[1], F.lit("/src"))
    own = n.select("id", F.concat(crate, F.lit("/"), parts[2], F.lit("/s"), F.col("id").cast("string"), F.lit(".rs")).alias("path"))
    roots = n.select(F.concat(crate, F.lit("/lib.rs")).alias("path")).distinct().select((-F.length("path")).cast("long").alias("id"), "path")
    return own.unionByName(roots)


@query(_PAIRS + """, r as (select *, replace(nation, ' ', '_') as nt, split_part(p, '/', 2) = region as same, pdir = qdir as near from pairs), s as (select *,
      case when name = '*' then 'std::fmt::Debug' when name = 'default' then 'extern::serde' when line = 1 then 'super::' || stem || '::X' when line = 2 then '@mod:' || stem when line = 3 then 'lib_x::' || nt || '::' || stem || '::y' when line = 4 then 'serde_json::Value' else 'crate::' || nt || '::' || stem || '::y' end as source from r),
    t as (select *, case when name in ('*', 'default') or line = 4 then 'external' when line <= 2 then case when near then 'hit' else 'unresolved' end when same and src = dst then 'external' when same then 'hit' else 'root' end as st from s)
    select src as from_id, source, case when st in ('hit', 'root') then 'resolved' else st end as status, case st when 'hit' then dst when 'root' then -length(split_part(p, '/', 2)) - 11 end as to_id from t""")
def res14_res15_res16_res17_rust(spark, d):
    """Paths from the crate, by its name, from the module above, declared modules, the standard library, extern crates and dependencies. What no file of the crate has is looked for in its root."""
    from graphloom.operators import resolve

    files = _rust_files(spark, d)
    rows = virtual.edge_rows(spark, d).distinct().join(files.select(F.col("id").alias("src"), F.col("path").alias("p")), "src").join(files.select(F.col("id").alias("dst"), F.col("path").alias("q")), "dst")
    inside = F.regexp_replace(F.regexp_replace("q", r"^[^/]*/src/|\.rs$", ""), "/", "::")
    stem = F.regexp_extract("q", r"(s\d+)\.rs$", 1)
    name, line = F.col("name"), F.col("line")
    source = (
        F.when(name == "*", "std::fmt::Debug").when(name == "default", "extern::serde").when(line == 1, F.concat(F.lit("super::"), stem, F.lit("::X"))).when(line == 2, F.concat(F.lit("@mod:"), stem))
        .when(line == 3, F.concat(F.lit("lib_x::"), inside, F.lit("::y"))).when(line == 4, "serde_json::Value").otherwise(F.concat(F.lit("crate::"), inside, F.lit("::y")))
    )
    cargo = resolve.Cargo.of({"package": {"name": "lib-x"}, "dependencies": {"serde-json": "1"}})
    return resolve.resolve_rust(_asked(rows, source), files, cargo).select("from_id", "source", "status", "to_id")


_HREF = "(select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as source from pages)"


@query("select distinct page_id, source, case when source like '/%' then 'unresolved' when source like '.%' then 'unresolved' when source = '' then 'unresolved' else 'external' end as status from " + _HREF)
def res7_pages_links(spark, d):
    """Links of raw pages as imports: absolute paths that no page has, and bare names."""
    from graphloom.operators import resolve

    pages = virtual.table(spark, d, "pages")
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("source")).distinct()
    asked = links.select(F.xxhash64("page_id", "source").alias("import_id"), F.col("page_id").alias("from_id"), F.lit("page/index.ts").alias("from_path"), "source")
    found = resolve.resolve_ts(asked, pages.select(F.col("page_id").alias("id"), F.col("url").alias("path")))
    return found.select(F.col("from_id").alias("page_id"), "source", "status")
