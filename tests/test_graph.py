"""Golden cases of the graph operators on small hand-built graphs."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import analysis, graph, iterate, lint
from graphloom.operators.graph import CodeGraph, SymbolGraph


def make(spark, nodes, edges=(), exports=(), unresolved=()):
    """nodes: id -> (path, entry); edges: (src, dst, names[, type_only, mod])."""
    lang = lambda p: {"ts": "typescript", "rs": "rust", "java": "java"}[p.rsplit(".", 1)[1]]
    n = [(i, p, lang(p), e) for i, (p, e) in nodes.items()]
    e = [(x[0], x[1], list(x[2]), x[3] if len(x) > 3 else False, x[4] if len(x) > 4 else False, 1) for x in edges]
    x = [(f, name, *(flags or (False, False)), False, None, 0) for f, name, *flags in [(a, b, *c) for a, b, *c in exports]]
    u = [(f, s, "external", s, 1) for f, s in unresolved]
    make_ = spark.createDataFrame
    return CodeGraph(make_(n, graph.NODES), make_(e, graph.EDGES), make_(x, graph.EXPORTS), make_(u, graph.UNRESOLVED))


def paths_of(df):
    return sorted(r["path"] for r in df.collect())


CHAIN = {1: ("src/index.ts", True), 2: ("src/a.ts", False), 3: ("src/b.ts", False), 4: ("src/c.ts", False)}


def test_dead_files(spark):
    g = make(spark, CHAIN, [(1, 2, ["x"]), (2, 3, ["y"])])
    assert [(r["path"], r["confidence"]) for r in analysis.dead_files(g).collect()] == [("src/c.ts", "certain")]
    g = make(spark, CHAIN, [(1, 2, ["x"]), (2, 3, ["y"]), (3, 4, ["z"])])
    assert analysis.dead_files(g).count() == 0
    g = make(spark, CHAIN, [(1, 2, []), (2, 3, []), (3, 2, [])])
    assert paths_of(analysis.dead_files(g)) == ["src/c.ts"]
    g = make(spark, CHAIN, [], (), [(3, "lib")])
    assert {r["path"]: r["confidence"] for r in analysis.dead_files(g).collect()} == {"src/a.ts": "high", "src/b.ts": "medium", "src/c.ts": "high"}


def test_dead_exports(spark):
    g = make(spark, CHAIN, [(1, 2, ["used"])], [(1, "main"), (2, "used"), (2, "unused"), (3, "again", False, True)])
    assert [(r["path"], r["exported_name"]) for r in analysis.dead_exports(g).collect()] == [("src/a.ts", "unused")]
    g = make(spark, CHAIN, [(1, 2, ["default"])], [(2, "thing", True, False)])
    assert analysis.dead_exports(g).count() == 0


@pytest.mark.parametrize("names, dead", [(["*"], set()), (["helper"], {"other"})])
def test_names_pass_through_reexports(spark, names, dead):
    edges = [(1, 2, ["helper", "other"] if names == ["*"] else ["helper"]), (2, 3, names)]
    g = make(spark, CHAIN, edges, [(2, names[0], False, True), (3, "helper"), (3, "other")])
    assert {r["exported_name"] for r in analysis.dead_exports(g).collect()} == dead


def test_chained_reexports(spark):
    g = make(spark, CHAIN, [(1, 2, ["f"]), (2, 3, ["*"]), (3, 4, ["*"])], [(2, "*", False, True), (3, "*", False, True), (4, "f"), (4, "g")])
    assert {r["exported_name"] for r in analysis.dead_exports(g).collect()} == {"g"}
    assert analysis.overall_confidence(g).first()[0] == "high"


def test_rust_file_imported_by_its_own_name(spark):
    nodes = {1: ("src/main.rs", True), 2: ("src/util.rs", False)}
    g = make(spark, nodes, [(1, 2, ["util"])], [(2, "a"), (2, "b")])
    assert analysis.dead_exports(g).count() == 0
    nodes = {1: ("src/main.ts", True), 2: ("src/util.ts", False)}
    assert analysis.dead_exports(make(spark, nodes, [(1, 2, ["util"])], [(2, "a")])).count() == 1


def test_summary(spark):
    g = make(spark, {1: ("src/index.ts", True), 2: ("src/a.ts", False), 3: ("b.ts", False)}, [(1, 2, ["foo"])], [(1, "main"), (2, "foo"), (2, "bar")])
    row = analysis.dead_code_summary(g, analysis.dead_files(g), analysis.dead_exports(g)).first()
    assert (row["total_files"], row["dead_files"], row["total_exports"], row["dead_exports"], row["entry_points"]) == (3, 1, 3, 1, 1)
    d = {r["directory"]: r for r in analysis.directory_summary(g).collect()}
    assert (d["src"]["files"], d["src"]["exports"], d["src"]["dead_exports"], d["src"]["avg_fan_out"]) == (2, 3, 1, 0.5)
    assert d["."]["files"] == 1


def cycles(spark, edges, small=iterate.SMALL):
    df = spark.createDataFrame([(a, b) for a, b in edges] or [(1, 2)], "src long, dst long")
    out = {}
    for r in iterate.components(df, small).collect():
        out.setdefault(r["component"], set()).add(r["id"])
    return out


@pytest.mark.parametrize("small", [0, 4, 1000])
def test_cycles(spark, small):
    assert cycles(spark, [(1, 2), (2, 3)], small) == {}
    assert cycles(spark, [(1, 1)], small) == {}
    assert cycles(spark, [(1, 2), (2, 1), (3, 4), (4, 5), (5, 3), (2, 3), (5, 6), (6, 6)], small) == {1: {1, 2}, 3: {3, 4, 5}}


def test_cycles_against_mutual_reachability(spark):
    rnd = random.Random(1)
    for k in range(3):
        edges = [(rnd.randrange(14), rnd.randrange(14)) for _ in range(22)]
        reach = {i: {i} for i in range(14)}
        for _ in range(14):
            for a, b in edges:
                for i in reach:
                    if a in reach[i]:
                        reach[i] |= reach[b]
        want = {}
        for i in range(14):
            part = {j for j in range(14) if j in reach[i] and i in reach[j]}
            if len(part) > 1:
                want[min(part)] = part
        assert cycles(spark, edges, 0 if k == 0 else 100) == want


def test_module_declarations_are_no_cycle(spark):
    g = make(spark, CHAIN, [(1, 2, [], False, True), (2, 1, [])])
    assert analysis.cycles(g).count() == 0
    assert [r["length"] for r in analysis.cycles(make(spark, CHAIN, [(1, 2, []), (2, 1, [])])).collect()] == [2]


@pytest.mark.parametrize("small", [0, 1000])
def test_depths(spark, small):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 3), (4, 1), (9, 9)], "src long, dst long")
    seeds = spark.createDataFrame([(1,)], "id long")
    got = {r["id"]: r["depth"] for r in iterate.depths(edges, seeds, None, small).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2}
    got = {r["id"]: r["depth"] for r in iterate.depths(edges, seeds, 1, small).collect()}
    assert got == {1: 0, 2: 1, 3: 1}


def test_deps_and_impact(spark):
    g = make(spark, CHAIN, [(1, 2, ["b", "a", "a"]), (2, 3, ["c"]), (3, 4, []), (1, 3, [])])
    assert [(r["path"], r["imported_names"]) for r in analysis.deps(g, 1).orderBy("path").collect()] == [("src/a.ts", ["a", "b"]), ("src/b.ts", [])]
    assert {r["path"]: r["depth"] for r in analysis.deps(g, 1, transitive=True).collect()} == {"src/a.ts": 1, "src/b.ts": 1, "src/c.ts": 2}
    assert paths_of(analysis.deps(g, 1, transitive=True, max_depth=1)) == ["src/a.ts", "src/b.ts"]
    found = analysis.impact(g, 4)
    assert {r["path"]: r["depth"] for r in found.collect()} == {"src/b.ts": 1, "src/a.ts": 2, "src/index.ts": 2}
    assert tuple(analysis.impact_summary(found).first()) == (1, 3, 2)
    assert paths_of(analysis.impact(g, 4, 1)) == ["src/b.ts"]


def test_filters(spark):
    g = make(spark, CHAIN, [(1, 2, [], True), (2, 3, [], False, True), (3, 4, [])], [(2, "x"), (4, "y")], [(1, "a"), (4, "b")])
    assert g.without_type_only().edges.count() == 2
    assert g.without_mod_declarations().edges.count() == 2
    f = g.filtered("src/{b,c}.ts")
    assert (f.nodes.count(), f.edges.count(), f.exports.count(), f.unresolved.count()) == (2, 1, 1, 1)
    assert tuple(g.counts().first()) == (4, 3, 2, 2)


def test_build_edges(spark):
    rows = spark.createDataFrame([(1, 2, "a", True, False, 9), (1, 2, "b", False, True, 3), (1, 2, "a", True, False, 5)], "src long, dst long, name string, is_type_only boolean, is_mod_declaration boolean, line long")
    assert tuple(graph.build_edges(rows).first()) == (1, 2, ["a", "a", "b"], False, True, 3)


def test_symbols(spark):
    g = make(spark, CHAIN)
    s = SymbolGraph.build(
        spark.createDataFrame([(10, 1, "main", "function", "public"), (11, 2, "used", "function", "private"), (12, 2, "lost", "class", "public"), (13, 3, "x", "export", "public")], "id long, file_id long, name string, kind string, visibility string"),
        spark.createDataFrame([(10, 11, "call"), (12, 99, "call")], "source_id long, target_id long, kind string"),
    )
    assert s.refs.count() == 1
    assert {r["name"] for r in analysis.dead_symbols(s, g).collect()} == {"lost"}
    assert analysis.dead_symbols(s, g, spark.createDataFrame([(12,)], "id long")).count() == 0
    assert s.without_file(2).refs.count() == 0


def test_diff(spark):
    b = spark.createDataFrame([("a", "x"), ("a", "y"), ("gone", "q"), ("gone", "q"), ("same", "s"), ("bare", None)], "path string, exported_name string")
    a = spark.createDataFrame([("a", "x"), ("a", "z"), ("new", "n"), ("same", "s"), ("bare", None)], "path string, exported_name string")
    changes = analysis.diff_exports(b, a)
    assert sorted(map(tuple, changes.collect())) == [("a", "y", "breaking"), ("a", "z", "expanding"), ("gone", "q", "breaking"), ("gone", "q", "breaking"), ("new", "n", "expanding")]
    assert tuple(analysis.diff_summary(b, a, changes).first()) == (1, 1, 1, 2, 3, 2)


def test_confidence(spark):
    one = lambda u, e, w: spark.range(1).select(analysis.confidence(F.lit(u), F.lit(e), F.lit(w))).first()[0]
    assert [one(0, 5, False), one(0, 5, True), one(1, 20, False), one(2, 10, False), one(5, 10, False), one(1, 0, False)] == ["certain", "high", "high", "medium", "low", "low"]


# ------------------------------------------------------------------ rules

RULES = {1: ("src/api/a.ts", True), 2: ("src/ui/b.ts", False), 3: ("src/ui/index.ts", False), 4: ("src/db/c.ts", False)}


def run(spark, kind, settings, edges=(), exports=(), tags=None):
    ev = lint.Evaluation(make(spark, RULES, edges, exports), tags)
    return sorted((r["source_file"], r["target_file"], tuple(r["imported_names"])) for r in getattr(ev, kind)(settings).collect())


def test_edge_rules(spark):
    e = [(1, 2, ["x"]), (1, 3, ["y"]), (2, 4, ["z", "w"]), (2, 1, ["t"], True)]
    api, ui, db = ["src/api/**"], ["src/ui/**"], ["src/db/**"]
    assert run(spark, "boundary", {"from": api, "deny": ui, "except": ["**/index.ts"]}, e) == [("src/api/a.ts", "src/ui/b.ts", ("x",))]
    assert run(spark, "layer", {"layers": [{"name": "ui", "patterns": ui}, {"name": "api", "patterns": api}]}, e) == [("src/api/a.ts", "src/ui/b.ts", ("x",)), ("src/api/a.ts", "src/ui/index.ts", ("y",))]
    assert run(spark, "containment", {"module": ui, "public_api": ["**/index.ts"]}, e) == [("src/api/a.ts", "src/ui/b.ts", ("x",))]
    assert run(spark, "import_restriction", {"target": db, "require_type_only": True, "forbidden_names": ["w"], "allowed_names": ["w"]}, e) == [("src/ui/b.ts", "src/db/c.ts", n) for n in (("w",), ("z",), ("z", "w"))]
    assert run(spark, "restricted_consumer", {"target": db, "allowed_consumers": api}, e) == [("src/ui/b.ts", "src/db/c.ts", ("z", "w"))]
    assert run(spark, "coupling_weight", {"pattern": ["**"], "max_names": 1}, e) == [("src/ui/b.ts", "src/db/c.ts", ("z", "w"))]
    tags = {"a": api, "u": ui, "i": ["**/index.ts"]}
    assert len(run(spark, "tag_boundary", {"from_tag": "a", "deny_tags": ["u", "i", "none"]}, e, tags=tags)) == 3
    assert len(run(spark, "tag_boundary", {"from_tag": "a", "deny_tags": ["u"], "except_tags": ["i"]}, e, tags=tags)) == 1


def test_node_rules(spark):
    e = [(1, 2, ["x"]), (1, 3, ["y"]), (2, 1, ["t"]), (4, 4, [])]
    names = lambda rows: [r[0] for r in rows]
    assert names(run(spark, "fan_limit", {"pattern": ["**"], "max_fan_out": 1}, e)) == ["src/api/a.ts"]
    assert names(run(spark, "stability_limit", {"pattern": ["**"], "max_instability": 0.6}, e)) == ["src/api/a.ts"]
    assert names(run(spark, "naming_boundary", {"pattern": ["src/ui/**"], "must_match": r"index\.ts$"}, e)) == ["src/ui/b.ts"]
    assert names(run(spark, "export_limit", {"pattern": ["**"], "max_exports": 1}, e, [(2, "a"), (2, "b"), (3, "c")])) == ["src/ui/b.ts"]
    assert names(run(spark, "cohesion", {"pattern": ["**"], "max_external_ratio": 0.5}, e)) == ["src/api", "src/ui"]
    assert names(run(spark, "cycle_policy", {"pattern": ["src/api/**"]}, e)) == ["src/api/a.ts"]
    assert run(spark, "cycle_policy", {"pattern": ["src/db/**"]}, e) == []
    with pytest.raises(Exception):
        run(spark, "naming_boundary", {"pattern": ["**"], "must_match": "("}, e)


def test_evaluate_and_baseline(spark, tmp_path):
    from graphloom.sources import configs

    config = configs.parse_rules("""
[tags]
ui = ["src/ui/**"]
[[rules]]
id = "no-ui"
severity = "error"
description = "api must not import ui"
[rules.boundary]
from = ["src/api/**"]
deny = ["src/ui/**"]
[[rules]]
id = "names"
severity = "info"
description = "few names"
[rules.coupling_weight]
pattern = ["**"]
max_names = 0
""")
    g = make(spark, RULES, [(1, 2, ["x"]), (2, 4, ["z"])])
    found = lint.evaluate(config, g)
    assert tuple(lint.summary(found).first()) == (3, 1, 0, 2, 2)
    assert lint.evaluate(config, g, threshold="error").count() == 1
    assert lint.evaluate(config, g, only="names").count() == 2
    with pytest.raises(ValueError):
        lint.evaluate(config, g, only="none")
    at = str(tmp_path / "x/baseline.json")
    assert configs.read_baseline(spark, at) is None
    assert configs.write_baseline(lint.at_least(found, "error"), at) == 1
    assert lint.suppress(found, configs.read_baseline(spark, at)).count() == 2
    for bad in ('x = 1', '[[rules]]\nid="a"\nseverity="error"\ndescription=""', '[[rules]]\nid="a"\nseverity="bad"\ndescription=""\n[rules.cycle_policy]'):
        with pytest.raises(ValueError):
            configs.parse_rules(bad)


@pytest.mark.parametrize("small", [0, 1000])
def test_names_spread_alike(spark, small):
    used = spark.createDataFrame([(1, "a"), (1, "b"), (5, "z")], "file_id long, name string")
    rules = spark.createDataFrame([(1, 2, "a"), (2, 3, "*"), (3, 2, "*"), (3, 4, "b")], "barrel long, target long, name string")
    want = {(1, "a"), (1, "b"), (5, "z"), (2, "a"), (3, "a")}
    assert {tuple(r) for r in iterate.fixpoint_names(used, rules, small).collect()} == want
    assert {tuple(r) for r in iterate.fixpoint_names(used, rules.where("false"), small).collect()} == {(1, "a"), (1, "b"), (5, "z")}


def test_limitations(spark):
    g = make(spark, CHAIN, [], (), [(3, "lib"), (3, "lib2")])
    assert {tuple(r) for r in analysis.limitations(g).collect()} == {("2 imports could not be resolved", 2), ("1 files have unresolvable imports", 1)}
    assert analysis.limitations(make(spark, CHAIN)).count() == 0


def test_times_in_utc_whatever_the_zone(spark):
    from graphloom.functions import post

    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        got = spark.createDataFrame([(0,), (1700000001,), (-1,)], "s long").select(post.iso_utc(F.col("s"))).collect()
        assert [r[0] for r in got] == ["1970-01-01T00:00:00Z", "2023-11-14T22:13:21Z", "1969-12-31T23:59:59Z"]
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_cycles_between_cuts(spark, monkeypatch):
    """Cycles within ranges of ids, and edges between ranges, of which the far larger part is dropped before any walk; no rounds of joins."""
    edges = [(8 * b + i, 8 * b + (i + 1) % 5) for b in range(60) for i in range(5)] + [(8 * b + 6, 8 * (b // 2) + 1) for b in range(60)] + [(8 * b + 1, 8 * (b // 3) + 7) for b in range(60)]
    monkeypatch.setattr(iterate, "_colour", None)
    got = iterate.components(spark.createDataFrame(edges, "src long, dst long"), 40).collect()
    assert sorted(map(tuple, got)) == [(8 * b + i, 8 * b) for b in range(60) for i in range(5)]
    up = [(v, u) for u, v in edges]
    assert sorted(map(tuple, iterate.components(spark.createDataFrame(up, "src long, dst long"), 40).collect())) == sorted(map(tuple, got))


def test_references_of_one_file_are_filtered_where_they_are_read(spark, sf):
    from graphloom.plans import catalog

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the tables were large
    try:
        plan = catalog.queries()["jn3_references_touching_file"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
