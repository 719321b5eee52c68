"""Recursion over edges: reachability, depths, fix-points and strongly connected components.

The edges are written once; their number then comes from the files' footers. As many as fit one task's memory are
walked inside a single task, in one job; beyond that bound a driver loop joins the frontier with the edges round by
round. Each round is written to the shared folder, so plans stay short and a lost executor costs a reread. Both ways
give the same rows.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.shared import drop_written, written

#: Edges that one task walks in memory (about 100 bytes each).
SMALL = 1_000_000
#: Rounds after which what was found so far becomes one table.
COMPACT = 8


def _columns(batches, *kinds: pa.DataType) -> list[pa.Array]:
    """The columns of all batches of a task, which may have none."""
    got = list(batches)
    return [pa.chunked_array([b.column(i) for b in got], k).combine_chunks() for i, k in enumerate(kinds)]


def _walk(src: np.ndarray, dst: np.ndarray, seeds: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids reached and their depths, level by level over sorted edges."""
    ids, at = np.unique(np.concatenate([src, dst, seeds]), return_inverse=True)
    s, d, frontier = at[: len(src)], at[len(src) : 2 * len(src)], np.unique(at[2 * len(src) :])
    order = np.argsort(s, kind="stable")
    d, start = d[order], np.searchsorted(s[order], np.arange(len(ids) + 1))
    depth, level = np.full(len(ids), -1, np.int32), 0
    depth[frontier] = 0
    while len(frontier) and (most is None or level < most):
        level += 1
        n = start[frontier + 1] - start[frontier]
        pick = np.repeat(start[frontier] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        frontier = np.unique(d[pick])
        frontier = frontier[depth[frontier] < 0]
        depth[frontier] = level
    return ids[depth >= 0], depth[depth >= 0]


def depths(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, small: int = SMALL) -> DataFrame:
    """(id, depth): the fewest hops from any of ``seeds`` (id) over edges (src, dst); seeds have depth 0."""
    edges = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src is not null and dst is not null and src <> dst")
    seeds = seeds.select(F.lit(None).cast("long").alias("src"), F.col("id").cast("long").alias("dst")).where("dst is not null").distinct()
    both = written(edges.unionByName(seeds), "edges")
    if both.count() <= small:

        def walk(batches):
            src, dst = _columns(batches, pa.int64(), pa.int64())
            is_seed, dst = np.asarray(src.is_null()), dst.to_numpy(zero_copy_only=False)
            ids, depth = _walk(src.drop_null().to_numpy(), dst[~is_seed], dst[is_seed], max_depth)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(depth, pa.int32())], names=["id", "depth"])

        return both.coalesce(1).mapInArrow(walk, "id long, depth int")
    pairs = both.where("src is not null")
    seen = written(both.where("src is null").select(F.col("dst").alias("id"), F.lit(0).alias("depth")), "seen")
    frontier, level, parts = seen, 0, [seen]
    while max_depth is None or level < max_depth:
        level += 1
        step = pairs.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        frontier = written(step.withColumn("depth", F.lit(level)), "frontier")
        if not frontier.take(1):
            break
        seen = seen.unionByName(frontier)
        parts.append(frontier)
        if level % COMPACT == 0:
            seen = written(seen, "seen")
            drop_written(*parts[:-1])
            parts = [frontier, seen]
    return seen


def reachable(edges: DataFrame, seeds: DataFrame, small: int = SMALL) -> DataFrame:
    """(id) of all that ``seeds`` reach, themselves included."""
    return depths(edges, seeds, None, small).select("id")


def _tarjan(adjacent: dict[int, list[int]]) -> list[list[int]]:
    index, low, on, stack, out = {}, {}, set(), [], []
    for root in list(adjacent):
        if root in index:
            continue
        work = [(root, iter(adjacent[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            u, it = work[-1]
            for v in it:
                if v not in index:
                    index[v] = low[v] = len(index)
                    stack.append(v)
                    on.add(v)
                    work.append((v, iter(adjacent.get(v, ()))))
                    break
                if v in on:
                    low[u] = min(low[u], index[v])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[u])
                if low[u] == index[u]:
                    part = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        part.append(w)
                        if w == u:
                            break
                    out.append(part)
    return out


def _parts(src: np.ndarray, dst: np.ndarray) -> tuple[list[int], list[int]]:
    """Ids on cycles, and the smallest member of each one's component."""
    for _ in range(20):  # most nodes of a code base are on no cycle
        keep = np.isin(src, dst) & np.isin(dst, src)
        if keep.all():
            break
        src, dst = src[keep], dst[keep]
    adjacent = defaultdict(list)
    for u, v in zip(src.tolist(), dst.tolist()):
        adjacent[u].append(v)
    found = [(i, low) for part in _tarjan(adjacent) if len(part) > 1 for low in (min(part),) for i in part]
    return [x[0] for x in found], [x[1] for x in found]


_COMPONENT = pa.schema([("id", pa.int64()), ("component", pa.int64())])


def _in_one_task(edges: DataFrame) -> DataFrame:
    """``components`` of a written table (src, dst) by one walk."""

    def tarjan(batches):
        src, dst = (c.to_numpy() for c in _columns(batches, pa.int64(), pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _parts(src, dst)], schema=_COMPONENT)

    return edges.coalesce(1).mapInArrow(tarjan, "id long, component long")


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(id, component): strongly connected components of two nodes or more, named by their smallest member."""
    edges = written(edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src is not null and dst is not null and src <> dst"), "scc-edges")
    n = edges.count()
    return _in_one_task(edges) if n <= small else _by_ranges(edges, n, small)


def _cuts(edges: DataFrame, n: int, small: int) -> np.ndarray:
    """Ids c such that no edge leads from below c to c or above (or none the other way): no cycle has ids on both sides.

    Ids are dealt to equal ranges, some for each ``small`` edges. Each range yields how far its edges reach, and the first, middle
    and last id that none of them spans; the driver drops those that edges of ranges before span. It gets a row a range.
    """
    low, high, up, down = edges.agg(F.min(F.least("src", "dst")), F.max(F.greatest("src", "dst")), F.sum(F.when(F.col("src") < F.col("dst"), (F.col("dst") - F.col("src")).cast("double"))), F.sum(F.when(F.col("src") > F.col("dst"), (F.col("src") - F.col("dst")).cast("double")))).first()
    ranges = min(max(8 * n // max(small, 1), 64), 1 << 17)
    bits = max(((high - low) // ranges).bit_length(), 0)
    a, b = ("src", "dst") if (up or 0) <= (down or 0) else ("dst", "src")  # the direction that spans less
    own = edges.where(F.col(a) < F.col(b)).select(F.shiftright(a, bits).alias("range"), F.col(a).alias("a"), F.col(b).alias("b"))
    # of the edges of one id only the longest matters, so hot ids are no burden
    own = own.groupBy("range", "a").agg(F.max("b").alias("b"))

    def gaps(t: pa.Table) -> pa.Table:
        order = np.argsort(x := t["a"].to_numpy())
        x, reach = x[order], np.maximum.accumulate(t["b"].to_numpy()[order])
        free = np.concatenate([x[:1], x[1:][x[1:] > reach[:-1]], reach[-1:] + 1])
        cuts = np.unique(free[[0, len(free) // 2, -1]])
        return pa.table({"range": t["range"][:1], "reach": reach[-1:], "cuts": pa.array([cuts.tolist()], pa.list_(pa.int64()))})

    rows = sorted(own.groupBy("range").applyInArrow(gaps, "range long, reach long, cuts array<long>").collect())
    out, reach = [], low
    for k, (_, far, cuts) in enumerate(rows):
        after = rows[k + 1][0] << bits if k + 1 < len(rows) else None  # where the next range begins
        out += [c for c in cuts if c > reach and (after is None or c <= after)]
        reach = max(reach, far)
    return np.unique(np.array(out, np.int64))


def _by_ranges(edges: DataFrame, n: int, small: int) -> DataFrame:
    """Components of a graph beyond one task: edges that cross a cut are on no cycle; between cuts each part is walked by itself, and parts of more than ``small`` edges by ``_colour``."""
    cuts = _cuts(edges, n, small)

    def inside(batches):
        for t in batches:
            src, dst = (c.to_numpy() for c in t.columns)
            at = np.searchsorted(cuts, src, "right")
            keep = at == np.searchsorted(cuts, dst, "right")
            yield pa.RecordBatch.from_arrays([pa.array(x[keep], pa.int64()) for x in (at, src, dst)], names=["part", "src", "dst"])

    near = written(edges.mapInArrow(inside, "part long, src long, dst long"), "scc-near")
    drop_written(edges)
    large = [r[0] for r in near.groupBy("part").count().where(F.col("count") > small).select("part").collect()]  # fewer than the edges by ``small``, and than the ranges

    def walk(t: pa.Table) -> pa.Table:
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in _parts(t["src"].to_numpy(), t["dst"].to_numpy())], schema=_COMPONENT)

    is_large = F.col("part").isin(large) if large else F.lit(False)
    found = near.where(~is_large).groupBy("part").applyInArrow(walk, "id long, component long")
    return found.unionByName(_colour(near.where(is_large).select("src", "dst"), small)) if large else found


def _colour(edges: DataFrame, small: int) -> DataFrame:
    """Components by trimming and colouring, until what is left fits one task: nodes without an edge in or out go; the largest id that reaches a node is its colour; the nodes that reach their colour's root within the colour are its component."""
    spark, found = edges.sparkSession, None
    rest = written(edges.distinct(), "scc-edges")
    drop_written(edges)
    while True:
        while True:  # trim
            trimmed = rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(rest.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            trimmed = written(trimmed.select("src", "dst"), "scc-edges")
            before, after = rest.count(), trimmed.count()
            drop_written(rest)
            rest = trimmed
            if before == after or after <= small:
                break
        if after <= small:
            break
        colour = written(rest.select(F.col("src").alias("id")).distinct().withColumn("c", F.col("id")), "scc-colour")
        while True:
            pulled = rest.join(colour.select(F.col("id").alias("src"), "c"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("c").alias("p"))
            new = written(colour.join(pulled, "id", "left").select("id", F.greatest("c", F.coalesce("p", "c")).alias("c"), (F.coalesce("p", "c") > F.col("c")).alias("up")), "scc-colour")
            moved = bool(new.where("up").take(1))
            drop_written(colour)
            colour = new.select("id", "c")
            colour._graphloom_path = new._graphloom_path
            if not moved:
                break
        inside = rest.join(colour.select(F.col("id").alias("src"), F.col("c").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst").where("a = b")
        back = reachable(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), colour.where("id = c").select("id"), 0)
        done = written(colour.join(back, "id").select("id", F.col("c").alias("root")), "scc-done")
        found = done if found is None else found.unionByName(done)
        rest_new = written(rest.join(done.select(F.col("id").alias("src")), "src", "left_anti").join(done.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"), "scc-edges")
        drop_written(rest)
        rest = rest_new
    left = _in_one_task(rest) if after else spark.createDataFrame([], "id long, component long")
    if found is None:
        return left
    sized = found.groupBy("root").agg(F.min("id").alias("component"), F.count("*").alias("n")).where("n > 1")
    return found.join(sized, "root").select("id", "component").unionByName(left)


def fixpoint_names(used: DataFrame, rules: DataFrame, small: int = SMALL) -> DataFrame:
    """Closes ``used`` (file_id, name) under ``rules`` (barrel, target, name): a used name of a barrel is used of the target if the rule's name is it or ``*``.

    Only names of barrels can spread. Where these and the rules are few they are followed in one task, else by joins
    until a round finds nothing new.
    """
    seen = written(used.select("file_id", "name").distinct(), "used")
    rules = written(rules.select("barrel", "target", F.col("name").alias("rule")).distinct(), "rules")
    n = rules.count()
    if not n:
        return seen
    start = written(seen.join(rules.select(F.col("barrel").alias("file_id")).distinct(), "file_id", "left_semi"), "barrels")
    if n + start.count() <= small:
        both = rules.unionByName(start.select("file_id", F.lit(None).cast("long"), "name").toDF("barrel", "target", "rule"))

        def spread(batches):
            follow, todo = defaultdict(list), []
            for barrel, target, name in zip(*(c.to_pylist() for c in _columns(batches, pa.int64(), pa.int64(), pa.string()))):
                todo.append((barrel, name)) if target is None else follow[barrel].append((target, name))
            new = set(todo)
            while todo:
                barrel, name = todo.pop()
                for target, rule in follow.get(barrel, ()):
                    if (rule == "*" or rule == name) and (target, name) not in new:
                        new.add((target, name))
                        todo.append((target, name))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in new], pa.int64()), pa.array([x[1] for x in new], pa.string())], names=["file_id", "name"])

        return seen.unionByName(both.coalesce(1).mapInArrow(spread, "file_id long, name string")).distinct()
    fresh, level, parts = start, 0, [seen]
    while True:
        level += 1
        step = fresh.join(rules, F.col("file_id") == F.col("barrel")).where("rule = '*' or rule = name")
        fresh = written(step.select(F.col("target").alias("file_id"), "name").distinct().join(seen, ["file_id", "name"], "left_anti"), "used-new")
        if not fresh.take(1):
            return seen
        seen = seen.unionByName(fresh)
        parts.append(fresh)
        if level % COMPACT == 0:
            seen = written(seen, "used")
            drop_written(*parts[:-1])
            parts = [fresh, seen]
