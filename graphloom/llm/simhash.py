"""Operator 4: near duplicates by SimHash and a Gray-order hierarchical index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, U64, batch, blocks, drop_written, flat, hot_join, map_batches, runs, written, xxh64

_FAN = 8
_PAIR = 1 << 21  # pairs of a query and a node looked at in one step: bounds memory only


def fingerprints(buf: np.ndarray, offsets: np.ndarray, shingle: int = 3) -> np.ndarray:
    """A 64-bit fingerprint per text; see ``near_duplicates``."""
    out = np.zeros(len(offsets) - 1, U64)
    for i, j in blocks(offsets, 2 << 20):
        part, rel = LOWER[buf[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        s, e, upto = runs(~SPACE[part], rel)
        if not len(s):
            continue
        # words joined by single spaces, each followed by one
        width = e - s
        at = np.cumsum(width + 1) - (width + 1)
        keep = ~SPACE[part]
        place = np.arange(len(part))[keep] + np.repeat(at - s, width)
        joined = np.full(int(at[-1] + width[-1] + 1), 32, np.uint8)
        joined[place] = part[keep]
        words = np.diff(upto)
        per = np.where(words == 0, 0, np.maximum(words - shingle + 1, 1))
        doc = np.repeat(np.arange(len(words)), per)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        first = upto[:-1][doc] + nth
        last = np.minimum(first + shingle, upto[1:][doc]) - 1
        h = xxh64(joined, at[first], at[last] + width[last] - at[first])
        some = np.flatnonzero(per)
        begin = (np.cumsum(per) - per)[some]
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
        set_ = (2 * ones > per[some][:, None]).astype(np.uint8)
        out[i + some] = np.packbits(set_, axis=1, bitorder="little").view("<u8").ravel()
    return out


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of ``x`` in the Gray order; neighbours in that order differ in one bit."""
    r = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        r ^= r >> U64(k)
    return r


class GrayIndex:
    """Fingerprints by Gray rank under a tree of groups.

    A node holds the bits that all fingerprints below it share (``mask``, ``bits``), less those that its parent has
    already. A search adds up differences on the way down and leaves a node once there are too many, with all below.
    """

    def __init__(self, prints: np.ndarray):
        self.prints = prints[np.argsort(gray_rank(prints), kind="stable")]
        lo = hi = self.prints
        levels = []
        while True:
            begin = np.arange(0, len(lo), _FAN)
            lo, hi = np.bitwise_and.reduceat(lo, begin), np.bitwise_or.reduceat(hi, begin)
            levels.append((~(lo ^ hi), lo))
            if len(lo) <= _FAN:
                break
        levels.reverse()
        self.levels = []
        for k, (mask, bits) in enumerate(levels):
            own = mask if k == 0 else mask & ~np.repeat(levels[k - 1][0], _FAN)[: len(mask)]
            self.levels.append((own, bits & own))

    def search(self, queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """All (query, place in ``prints``) with at most ``most`` differing bits."""
        qs, ps = [], []
        for a in range(0, len(queries), 2048):
            for q, p in self._down(queries[a : a + 2048], most):
                qs.append(q + a)
                ps.append(p)
        return (np.concatenate(qs), np.concatenate(ps)) if qs else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _down(self, queries: np.ndarray, most: int):
        top = len(self.levels[0][0])
        stack = [(0, np.repeat(np.arange(len(queries)), top), np.tile(np.arange(top), len(queries)), np.zeros(len(queries) * top, np.uint8))]
        while stack:
            level, q, node, acc = stack.pop()
            if len(q) > _PAIR:
                h = len(q) // 2
                stack += [(level, q[:h], node[:h], acc[:h]), (level, q[h:], node[h:], acc[h:])]
                continue
            if level == len(self.levels):
                ok = np.bitwise_count(queries[q] ^ self.prints[node]) <= most
                if ok.any():
                    yield q[ok], node[ok]
                continue
            mask, bits = self.levels[level]
            acc = acc + np.bitwise_count((queries[q] & mask[node]) ^ bits[node])
            ok = acc <= most
            q, node, acc = q[ok], node[ok], acc[ok]
            below = len(self.prints) if level + 1 == len(self.levels) else len(self.levels[level + 1][0])
            kid = (node[:, None] * _FAN + np.arange(_FAN)).ravel()
            q, acc = np.repeat(q, _FAN), np.repeat(acc, _FAN)
            if len(kid) and kid[-1] >= below or (kid >= below).any():
                inside = kid < below
                q, kid, acc = q[inside], kid[inside], acc[inside]
            if len(q):
                stack.append((level + 1, q, kid, acc))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (a, b), as (smallest of its tree, node)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = np.minimum(new, label)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[other]], nodes[other]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of the links: the smallest node that it reaches.

    Each round every node links its larger neighbours to its smallest one, then its others likewise, until nothing
    changes; trees halve, so rounds grow with the logarithm of the longest path. Each round is written to the shared
    folder. A node's neighbours are only aggregated, never gathered.
    """
    def state(df: DataFrame) -> tuple:
        r = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["x"], r["s"]

    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    seen = state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        joined = large.join(low2, F.col("u") == F.col("k"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        last, now = now, written(small, "links")
        drop_written(last)
        before, seen = seen, state(now)
        if before == seen:
            break
    return now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


def near_links(classes: DataFrame, most: int = 3, block_rows: int = 32_768, max_blocks: int = 64, large_block: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """From one row (f, n) per different fingerprint: (f, near), the rows of other fingerprints that are linked, and the links' spanning forests (a, b).

    Fingerprints are cut into blocks along the Gray order. A block pair is searched unless the bits that each block
    shares differ too often. Per pair only sums and spanning forests leave the task, so even a class of mutual near
    copies yields rows in proportion to its members.
    """
    spark = classes.sparkSession
    n = classes.count()
    count = max(1, min(max_blocks, -(-n // block_rows)))
    count = max(count, -(-n // large_block))
    rank = F.col("f")
    for k in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, k))
    ranked = classes.select("f", "n", rank.bitwiseXOR(F.lit(-(1 << 63))).alias("r"))  # top bit turned: unsigned order

    def gather(batches):
        f, w = [], []
        for b in batches:
            f.append(b.column(0).to_numpy())
            w.append(b.column(1).to_numpy())
        if f:
            prints, weight = np.concatenate(f), np.concatenate(w)
            if len(prints):
                u = prints.view(U64)
                mask, bits = ~(np.bitwise_and.reduce(u) ^ np.bitwise_or.reduce(u)), np.bitwise_and.reduce(u)
                yield pa.RecordBatch.from_arrays([pa.array([int(u.view(np.int64).min())]), pa.array([len(u)]), pa.array(np.array([mask]).view(np.int64)), pa.array(np.array([bits]).view(np.int64)), pa.array([prints.tobytes()], pa.binary()), pa.array([weight.tobytes()], pa.binary())], names=["id", "rows", "mask", "bits", "prints", "weights"])

    packed = written(ranked.repartitionByRange(count, "r").select("f", "n").mapInArrow(gather, "id long, rows long, mask long, bits long, prints binary, weights binary"), "blocks")
    meta = packed.select("id", "rows", "mask", "bits").collect()  # one small row per block; their number is bounded through the block size
    mask = np.array([m["mask"] for m in meta], np.int64).view(U64)
    bits = np.array([m["bits"] for m in meta], np.int64).view(U64)
    pairs = []
    for i in range(len(meta)):
        j = np.flatnonzero(np.bitwise_count((bits[i] ^ bits[i:]) & mask[i] & mask[i:]) <= most) + i
        pairs += [(meta[i]["id"], meta[k]["id"]) for k in j.tolist()]
    pair_df = spark.createDataFrame(pairs or [], "x long, y long")
    left = packed.select(F.col("id").alias("x"), F.col("prints").alias("px"), F.col("weights").alias("wx"))
    right = packed.select(F.col("id").alias("y"), F.col("prints").alias("py"), F.col("weights").alias("wy"))
    jobs = pair_df.join(left, "x").join(right, "y").repartition(max(1, len(pairs)))

    def search(b: pa.RecordBatch) -> list[pa.RecordBatch]:
        out = []
        for r in b.to_pylist():
            px, py = np.frombuffer(r["px"], U64), np.frombuffer(r["py"], U64)
            wx, wy = np.frombuffer(r["wx"], np.int64), np.frombuffer(r["wy"], np.int64)
            order = np.argsort(gray_rank(py), kind="stable")
            q, p = GrayIndex(py).search(px, most)
            p = order[p]
            if r["x"] == r["y"]:
                differ = q != p
                q, p = q[differ], p[differ]
                near = np.bincount(q, weights=wy[p], minlength=len(px)).astype(np.int64)
                add = [(px, near)]
                q, p = q[q < p], p[q < p]
            else:
                add = [(px, np.bincount(q, weights=wy[p], minlength=len(px)).astype(np.int64)), (py, np.bincount(p, weights=wx[q], minlength=len(py)).astype(np.int64))]
            for prints, near in add:
                some = np.flatnonzero(near)
                out.append(_links(prints[some].view(np.int64), near[some], None))
            a, c = forest(px[q].view(np.int64), py[p].view(np.int64))
            out.append(_links(a, None, c))
        return out

    found = written(map_batches(jobs, search, "a long, near long, b long"), "found")
    drop_written(packed)
    near = found.where("b is null").groupBy(F.col("a").alias("f")).agg(F.sum("near").alias("near"))
    return near, found.where("b is not null").select("a", "b")


def _links(a: np.ndarray, near: np.ndarray | None, b: np.ndarray | None) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), none if near is None else pa.array(near, pa.int64()), none if b is None else pa.array(b, pa.int64())], names=["a", "near", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 3) -> DataFrame:
    """Row per document: (doc_id, fingerprint, n_near, component_id).

    A-Z are lower-cased; words are runs of what isn't ASCII white space; shingles are ``shingle`` words joined by a
    space, repeats included (fewer words: all of them; none, or a null text: fingerprint zero, linked like any other).
    A fingerprint bit is set if over half the shingles' XXH64 (seed 42) have it. Fingerprints link at ``most`` or fewer
    differing bits. ``n_near``: other rows linked directly; ``component_id``: the smallest doc_id reachable. Repeated
    rows count one by one; null ids are allowed and never become a component's id unless all are null; an empty table
    gives none. Rows of one fingerprint are one class throughout, so a class of any size costs one row.
    """
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))

    def prints(b: pa.RecordBatch) -> pa.RecordBatch:
        buf, offsets = flat(b.column(1))
        return batch([("doc_id", pa.int64()), ("f", pa.int64())], b.column(0), fingerprints(buf, offsets, shingle).view(np.int64))

    rows = written(map_batches(src, prints, "doc_id long, f long"), "fingerprints")
    return hot_join(rows, _classes(rows, most), "f", "n").select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "n_near", "component_id")


def _classes(rows: DataFrame, most: int) -> DataFrame:
    """From (doc_id, f): a row per fingerprint (f, n, n_near, component_id, root, size); ``size`` rows have the ``root``."""
    classes = written(rows.groupBy("f").agg(F.count("*").alias("n"), F.min("doc_id").alias("low")), "classes")
    near, links = near_links(classes.select("f", "n"), most)
    roots = components(links)
    with_root = classes.join(roots, F.col("f") == F.col("node"), "left").select("f", "n", "low", F.coalesce("root", "f").alias("root"))
    least = with_root.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("n").alias("size"))
    info = with_root.join(least, "root").join(near, "f", "left").select("f", "n", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_near"), "component_id", "root", "size")
    return written(info, "classes-linked")


def one_of_each(docs: DataFrame, shingle: int = 3, most: int = 3) -> DataFrame:
    """Exactly one row (all columns) per component of ``near_duplicates``: the first by (doc_id, text, other columns), null ids last.

    Components are told by their fingerprints, so ids may be null or repeated. The columns must have an order. Rows alone
    in their component aren't shuffled by it; of the others each task passes on one a component.
    """
    at, names = docs.columns.index("text"), docs.columns

    def prints(b: pa.RecordBatch) -> pa.RecordBatch:
        buf, offsets = flat(b.column(at))
        f = fingerprints(buf, offsets, shingle).view(np.int64)
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(f, pa.int64())], names=[*names, "_f"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    rows = written(map_batches(docs, prints, f"{kinds}, _f long"), "fingerprinted")
    info = _classes(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_f").alias("f")), most)
    info = info.select(F.col("f").alias("_f"), F.col("n").alias("_n"), F.col("root").alias("_root"), F.col("size").alias("_size"))
    linked = hot_join(rows, info, "_f", "_n")
    order = F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "text", *(n for n in names if n not in ("doc_id", "text")))
    first = linked.where("_size > 1").groupBy("_root").agg(F.min(order).alias("_first"))
    return linked.where("_size = 1").select(*names).unionByName(first.select(*(F.col("_first")[n].alias(n) for n in names)))
