"""A virtual code base over the star-schema tables, in Spark and, as named subqueries, in SQL.

Orders are files; every line item is an import of its order's file, an export and a symbol of it, and a reference. What
the import hits follows from the line item's own keys, so no rows are left out:

* The first two line numbers import a file of the same block of eight order keys, the others one of a lower block. So
  cycles stay within a block, and low blocks are imported by ever more files.
* A discount of 10 % makes the import unresolved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import CodeGraph, SymbolGraph, build_edges


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    third = (F.col("o_orderkey") % 3 + 1).cast("int")
    ext = F.element_at(F.array(F.lit("ts"), F.lit("java"), F.lit("rs")), third)
    lang = F.element_at(F.array(F.lit("typescript"), F.lit("java"), F.lit("rust")), third)
    path = F.concat(F.lit("src/"), "r_name", F.lit("/"), "n_name", F.lit("/s"), F.col("o_orderkey").cast("string"), F.lit("."), ext)
    homes = c.select("c_custkey", "c_nationkey").join(F.broadcast(n.join(r, n.n_regionkey == r.r_regionkey)), F.col("c_nationkey") == F.col("n_nationkey"))  # nations and regions are 30 rows at any scale
    joined = o.select("o_orderkey", "o_custkey").join(homes, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.col("o_orderkey").cast("long").alias("id"), path.alias("path"), lang.alias("language"), (F.col("o_orderkey") % 10 == 1).alias("is_entry_point"))


def _target() -> Column:
    """The file that a line item imports."""
    block = F.expr("l_orderkey div 8")
    lower = F.expr("(l_orderkey div 8) * (l_suppkey % 97) div 97")
    return (F.when(F.col("l_linenumber") <= 2, block).otherwise(lower) * 8 + F.col("l_partkey") % 8).cast("long")


def _name() -> Column:
    """The name that a line item imports: one of eight, everything, the default, or the target's own name."""
    k, j = F.expr("(l_partkey div 8) % 8"), F.expr("(l_partkey div 64) % 4")
    odd = F.when(j == 0, "*").when(j == 1, "default").when(j == 2, F.concat(F.lit("s"), F.col("dst").cast("string"))).otherwise("p7")
    return F.when(k == 7, odd).otherwise(F.concat(F.lit("p"), k.cast("string")))


def edge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports that are resolved."""
    li = table(spark, sf_dir, "lineitem").where("l_discount < 0.095").withColumn("dst", _target())
    return li.select(F.col("l_orderkey").cast("long").alias("src"), "dst", _name().alias("name"), (F.col("l_returnflag") == "R").alias("is_type_only"), (F.col("l_linestatus") == "O").alias("is_mod_declaration"), F.col("l_linenumber").cast("long").alias("line"))


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(f, k): which of eight names each file defines."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("f"), (F.col("l_suppkey") % 8).cast("long").alias("k")).distinct()


def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = (F.col("f") + F.col("k")) % 7 == 0
    name = F.when((F.col("k") == 7) & again, "*").otherwise(F.concat(F.lit("p"), F.col("k").cast("string")))
    return _slots(spark, sf_dir).select(F.col("f").alias("file_id"), name.alias("exported_name"), ((F.col("f") + F.col("k")) % 11 == 0).alias("is_default"), again.alias("is_reexport"), F.lit(False).alias("is_type_only"), F.lit(None).cast("string").alias("source_path"), F.lit(0).cast("long").alias("line"))


def unresolved_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_discount >= 0.095")
    package = F.concat(F.lit("pkg"), (F.col("l_partkey") % 100).cast("string"))
    return li.select(F.col("l_orderkey").cast("long").alias("file_id"), package.alias("import_path"), F.when(F.col("l_returnflag") == "R", "file_not_found").otherwise("external").alias("kind"), package.alias("detail"), F.col("l_linenumber").cast("long").alias("line"))


def graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    return CodeGraph(nodes(spark, sf_dir), build_edges(edge_rows(spark, sf_dir)), export_rows(spark, sf_dir), unresolved_rows(spark, sf_dir))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("f") * 8 + F.col("k")
    kind = F.when(i % 4 == 0, "function").when(i % 4 == 1, "class").when(i % 4 == 2, "method").otherwise("export")
    return _slots(spark, sf_dir).select(i.alias("id"), F.col("f").alias("file_id"), F.concat(F.lit("p"), F.col("k").cast("string")).alias("name"), kind.alias("kind"), F.when(i % 3 == 0, "public").when(i % 3 == 1, "private").otherwise("protected").alias("visibility"))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("dst", _target())
    rf = F.col("l_returnflag")
    kind = F.when(rf == "R", "type_usage").when(rf == "A", "inheritance").otherwise("call")
    return li.select((F.col("l_orderkey") * 8 + F.col("l_suppkey") % 8).cast("long").alias("source_id"), (F.col("dst") * 8 + F.expr("(l_partkey div 8) % 8")).cast("long").alias("target_id"), kind.alias("kind")).distinct()


def symbol_graph(spark: SparkSession, sf_dir: str) -> SymbolGraph:
    return SymbolGraph.build(symbols(spark, sf_dir), refs(spark, sf_dir))


def snapshot(spark: SparkSession, sf_dir: str, after: bool) -> DataFrame:
    """(path, exported_name) of a version of the code base: the earlier one lacks the exports of open line items and the files of one language in one region, the later one the exports of returned items and another region's."""
    li = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'" if after else "l_linestatus <> 'O'")
    e = li.select(F.col("l_orderkey").alias("file_id"), F.concat(F.lit("p"), (F.col("l_suppkey") % 8).cast("string")).alias("exported_name")).distinct()
    n = nodes(spark, sf_dir).where(~((F.col("language") == "rust") & F.col("path").startswith("src/ASIA/" if after else "src/EUROPE/"))).select("id", "path")
    return n.join(e, n.id == e.file_id, "left").select("path", "exported_name")


# ------------------------------------------------------------------ the same in SQL

SQL = """with recursive
    nodes as (select *, 'src/' || region || '/' || nation || '/' || stem || '.' || ext as path, 'src/' || region || '/' || nation as dir from (
        select o_orderkey as id, r_name as region, n_name as nation, 's' || o_orderkey as stem, case o_orderkey % 3 when 0 then 'ts' when 1 then 'java' else 'rs' end as ext,
            case o_orderkey % 3 when 0 then 'typescript' when 1 then 'java' else 'rust' end as language, o_orderkey % 10 = 1 as entry
        from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)),
    items as (select *, case when k <> 7 then 'p' || k when j = 0 then '*' when j = 1 then 'default' when j = 2 then 's' || dst else 'p7' end as name from (
        select l_orderkey as src, (case when l_linenumber <= 2 then l_orderkey // 8 else (l_orderkey // 8) * (l_suppkey % 97) // 97 end) * 8 + l_partkey % 8 as dst,
            (l_partkey // 8) % 8 as k, (l_partkey // 64) % 4 as j, l_suppkey % 8 as own, l_returnflag = 'R' as is_type_only, l_linestatus = 'O' as is_mod, l_linenumber::bigint as line, l_discount < 0.095 as known,
            l_returnflag as flag, l_partkey as part from lineitem)),
    edges_rows as (select src, dst, name, is_type_only, is_mod, line from items where known),
    edges as (select src, dst, list_sort(list(name)) as names, bool_and(is_type_only) as is_type_only, bool_or(is_mod) as is_mod, min(line) as line from edges_rows group by src, dst),
    exports as (select distinct src as file_id, case when own = 7 and (src + own) % 7 = 0 then '*' else 'p' || own end as name, (src + own) % 11 = 0 as is_default, (src + own) % 7 = 0 as is_reexport, own as k from items),
    unresolved as (select src as file_id, 'pkg' || part % 100 as import_path, case when is_type_only then 'file_not_found' else 'external' end as kind, line from items where not known),
    symbols as (select id, id // 8 as file_id, 'p' || id % 8 as name, case id % 4 when 0 then 'function' when 1 then 'class' when 2 then 'method' else 'export' end as kind,
        case id % 3 when 0 then 'public' when 1 then 'private' else 'protected' end as visibility from (select distinct src * 8 + own as id from items)),
    refs as (select distinct src * 8 + own as source_id, dst * 8 + k as target_id, case flag when 'R' then 'type_usage' when 'A' then 'inheritance' else 'call' end as kind from items),
    symbol_refs as (select * from refs where source_id in (select id from symbols) and target_id in (select id from symbols)),
    used as (select distinct dst as file_id, name from edges_rows),
    used_all as (select * from used union select e.file_id, e.name from exports e join nodes n on n.id = e.file_id join used u on u.file_id = n.id and u.name = n.stem where n.language = 'rust'),
    rules as (select distinct e.file_id as barrel, x.dst as target, e.name from exports e join edges_rows x on x.src = e.file_id and x.name = e.name where e.is_reexport),
    spread as (select file_id, name from used_all union select r.target, s.name from spread s join rules r on r.barrel = s.file_id and (r.name = '*' or r.name = s.name)),
    live as (select id from nodes where entry union select e.dst from live l join edges e on e.src = l.id),
    dead_files as (select n.id, n.path, case when n.id in (select file_id from unresolved) then 'medium' when (select count(*) from unresolved) > 0 then 'high' else 'certain' end as confidence
        from nodes n where not entry and id not in (select id from live)),
    dead_exports as (select e.file_id, n.path, e.name as exported_name, 0::bigint as line, case when (select count(*) from unresolved) = 0 then 'certain' else 'high' end as confidence
        from exports e join nodes n on n.id = e.file_id and not n.entry left join spread s on s.file_id = e.file_id and s.name = e.name left join spread d on d.file_id = e.file_id and d.name = 'default' and e.is_default
        where not e.is_reexport and s.name is null and d.name is null),
    ends as (select e.*, a.path as s, b.path as t, a.dir as sdir, b.dir as tdir from edges e join nodes a on a.id = e.src join nodes b on b.id = e.dst),
    known_edges as (select e.src, e.dst, e.is_mod from ends e where e.src <> e.dst),
    runtime as (select src, dst from known_edges where not is_mod and src // 8 = dst // 8),
    closure as (select src, dst from runtime union select c.src, r.dst from closure c join runtime r on r.src = c.dst),
    scc as (select a.src as id, least(a.src, min(a.dst)) as component from closure a join closure b on a.src = b.dst and a.dst = b.src where a.src <> a.dst group by a.src),
    near as (select src, dst from known_edges where src // 8 = dst // 8),
    closure2 as (select src, dst from near union select c.src, r.dst from closure2 c join near r on r.src = c.dst),
    scc2 as (select a.src as id, least(a.src, min(a.dst)) as component from closure2 a join closure2 b on a.src = b.dst and a.dst = b.src where a.src <> a.dst group by a.src)
"""


# ------------------------------------------------------------------ as source text

def _text(head: str, lines: DataFrame, tail: str, files: DataFrame, language: str) -> DataFrame:
    body = lines.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("body"))
    text = F.concat(F.lit(head), F.coalesce("body", F.lit("")), F.lit(tail))
    return files.join(body, "id", "left").select(F.col("id").alias("file_id"), "path", F.lit(language).alias("language"), text.alias("content"))


def _spec(files: DataFrame) -> DataFrame:
    """(dst, spec): what a file of any folder writes to import ``dst``."""
    return files.select(F.col("id").alias("dst"), F.regexp_replace(F.regexp_replace("path", "^src/", "../../"), r"\.\w+$", "").alias("spec"))


#: How each of eight names is defined, by language.
TS_EXPORTS = ("export function p0(a: number): void { helper(`${a}`); }", "export class p1 extends Base implements Face { run(): void { helper(''); } size = 1; }", "export interface p2 extends Face { x: number; }", "export enum p3 { A, B }", "export const p4 = 5;", "export type p5 = string;", "export const { x6, y: p6 } = obj;", "export default function p7() { return new Base(); }")
JAVA_MEMBERS = ("    public static void p0(List<String> a) { helper(); }", "    @Deprecated public Base p1() { return new Base(); }", "    public static final int P2 = 1;", "    private String p3;", "    public enum P4 { RED, GREEN }", "    interface P5 { void go(); }", "    public record P6(int x) {}", "    protected void p7() { p0(null); }")
RUST_ITEMS = ("pub fn p0(a: &'static str) -> usize { helper(a) }", "pub struct P1 { pub x: i32 }\nimpl P1 { pub fn make() -> P1 { P1 { x: 1 } } }", "pub enum P2 { A, B(i32) }", "pub trait P3 { fn go(&self); }", "pub const P4: i32 = 1;", "static P5: i32 = 2;", "pub type P6 = i32;", "macro_rules! p7 { () => {} }")


def sources(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    """(file_id, path, language, content): every file written out in one language, with its imports and what it defines."""
    files = nodes(spark, sf_dir).select("id", "path")
    own = _slots(spark, sf_dir)
    pick = lambda lines: own.select(F.col("f").alias("id"), F.element_at(F.array(*(F.lit(x) for x in lines)), (F.col("k") + 1).cast("int")).alias("line"))
    if language == "typescript":
        rows = edge_rows(spark, sf_dir).join(_spec(files), "dst")
        name, dst = F.col("name"), F.col("dst").cast("string")
        clause = (
            F.when(name == "default", F.concat(F.lit("import d"), dst, F.lit(" from '"), "spec", F.lit("';")))
            .when(name == "*", F.concat(F.lit("import * as n"), dst, F.lit(" from '"), "spec", F.lit("';")))
            .when(name.startswith("s"), F.concat(F.lit("import '"), "spec", F.lit("';")))
            .when(F.col("line") == 7, F.concat(F.lit("load(import('"), "spec", F.lit("'));")))
            .when(F.col("is_type_only"), F.concat(F.lit("import type { "), name, F.lit(" } from '"), "spec", F.lit("';")))
            .when(F.col("is_mod_declaration"), F.concat(F.lit("import { "), name, F.lit(" as q } from '"), "spec", F.lit("';")))
            .otherwise(F.concat(F.lit("import { "), name, F.lit(" } from '"), "spec", F.lit("';")))
        )
        lines = rows.select(F.col("src").alias("id"), clause.alias("line")).unionByName(pick(TS_EXPORTS))
        return _text("// written out\n", lines, "\nfunction helper(x: string) {}\nclass Base {}\nexport { helper as aid };\nexport { r1, r2 as r3 } from './re';\nexport * from './star';\n", files, language)
    if language == "java":
        head = "package a.b;\nimport java.util.List;\nimport static a.c.Util.max;\nimport a.d.*;\n/* class */\n@Service\npublic class Holder extends Base implements Face {\n"
        return _text(head, pick(JAVA_MEMBERS), "\n    private static void helper() {}\n}\n@interface Mark {}\n", files, language)
    head = "use crate::a::{self, b, c as d};\nuse super::up::*;\npub use self::low::Thing;\nextern crate serde;\nmod inner;\n"
    return _text(head, pick(RUST_ITEMS), "\nfn helper(a: &str) -> usize { 0 }\npub struct Whole { pub x: i32 }\ntrait Act { fn act(&self); }\nimpl Act for Whole { fn act(&self) { helper(\"\"); } }\npub mod outer { pub(crate) fn deep() {} }\n", files, language)
