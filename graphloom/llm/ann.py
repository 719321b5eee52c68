"""Operator 3: nearest neighbours by adaptive dimension scan within probed lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, written

#: Vectors that the lists' centres are fitted on, and vectors of a list that one task scans.
SAMPLE, LIST_ROWS = 20_000, 4096
BLOCK_DIMS = 16
#: Probability scale of the test that leaves a candidate early: larger leaves fewer by mistake.
EPSILON = 1.6
#: Vectors of the sample whose k-th nearest bounds a query's search, and queries that one task takes for a list.
ANCHORS, LIST_QUERIES = 2048, 20_000


def clean(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v array<double>) of usable vectors: not null, not zero, no null or non-finite component."""
    v = F.transform(df[vec_col], lambda x: x.cast("double"))
    d = df.select(df[id_col].cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return d.where(~bad).where(F.exists("v", lambda x: x != 0.0))


def rotation(dim: int, seed: int = 17) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def centres(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = _closest(x, c, 1)[:, 0]
        n = np.bincount(own, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, own, x)
        c[n > 0] = s[n > 0] / n[n > 0][:, None]
    return c


def _closest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    d = (c * c).sum(1)[None, :] - 2 * (x @ c.T)
    return np.argsort(d, axis=1, kind="stable")[:, :k] if k < len(c) else np.tile(np.arange(len(c)), (len(x), 1))


def tuned_probes(x: np.ndarray, asks: np.ndarray, c: np.ndarray, k: int, recall: float, queries: int = 256) -> int:
    """The fewest probes with which, among the sample's vectors, ``queries`` of them find ``recall`` of their brute-force neighbours."""
    some = np.random.default_rng(9).permutation(len(x))[:queries]
    own = _closest(x, c, 1)[:, 0]
    d = (x * x).sum(1)[None, :] - 2 * (asks[some] @ x.T)
    d[np.arange(len(some)), some] = np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return len(c)
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    order = np.argsort((c * c).sum(1)[None, :] - 2 * (asks[some] @ c.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(c))[None, :].repeat(len(some), 0), 1)
    at = np.sort(np.take_along_axis(place, own[near], 1).ravel())
    return int(at[min(len(at) - 1, int(np.ceil(recall * len(at))) - 1)]) + 1


class ColumnScan:
    """A list's vectors in column blocks, scanned for many queries at once.

    Distances grow block by block; a random rotation makes the part seen so far a sample of the whole, so a candidate
    whose scaled part exceeds the query's limit by more than the test allows is left. While most pairs are alive a block
    is one matrix product; later only the pairs that are left are looked at.
    """

    def __init__(self, x: np.ndarray):
        self.n, self.dim = x.shape
        self.parts = [np.ascontiguousarray(x[:, a : a + BLOCK_DIMS]) for a in range(0, self.dim, BLOCK_DIMS)]

    def within(self, q: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, place) of the vectors whose squared distance is at most the query's ``limit``; a few may be missed."""
        far, alive, seen = np.zeros((len(q), self.n)), None, 0
        for part in self.parts:
            own = q[:, seen : seen + part.shape[1]]
            seen += part.shape[1]
            ratio = 1.0 + 1e-9 if seen == self.dim else seen / self.dim * (1 + EPSILON / np.sqrt(seen)) ** 2
            if alive is None:
                far += (own * own).sum(1)[:, None] + (part * part).sum(1)[None, :] - 2 * (own @ part.T)
                ok = far <= (limit * ratio)[:, None]
                if seen == self.dim or np.count_nonzero(ok) < 0.3 * ok.size:
                    alive = np.nonzero(ok)
                    d = far[alive]
            else:
                a, v = alive
                d = d + ((own[a] - part[v]) ** 2).sum(1)
                ok = d <= limit[a] * ratio
                alive, d = (a[ok], v[ok]), d[ok]
        return alive


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, probes: int | None = None, recall: float = 0.97, rows_per_list: int = 512, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Row per query and neighbour: (query_id, rank, vec_id, score); queries are the vectors whose id ``every`` divides.

    Nearness is the largest inner product, in double precision over the original vectors; ties go to the smaller id. The
    candidates are all other vectors. Adding the coordinate that lifts every vector to the largest norm turns it into
    nearest by distance, where the index works: lists around centres fitted on at most ``SAMPLE`` vectors hold every
    vector, a query probes the ``probes`` closest lists; by default as many as the sample needs for ``recall`` against brute
    force. The k-th nearest of a query among ``ANCHORS`` vectors bounds its search in every list. A list with more than
    ``LIST_ROWS`` vectors or ``LIST_QUERIES`` queries is split over tasks by a hash. A query that finds fewer than ``k``
    this way is run against all vectors.

    Vectors that are null, zero or hold null or non-finite components take no part. All vectors must be of one size
    (others than the most frequent size take no part). Rows of a repeated id are candidates each, and
    queries each, with results of their own; a query's own id is no candidate of it. Fewer candidates than ``k`` give fewer
    rows; an empty table gives none. Other columns are left out, whatever their names.
    """
    spark = vectors.sparkSession
    good = clean(vectors, id_col, vec_col)
    sizes = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return good.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    dim, n, top = sizes["d"], sizes["n"], sizes["m"]
    good = good.where(F.size("v") == dim)
    lists = int(max(1, min(4096, n // rows_per_list)))
    turn = rotation(dim + 1)

    def lift(v: np.ndarray, query: bool) -> np.ndarray:
        extra = np.zeros(len(v)) if query else np.sqrt(np.maximum(top - (v * v).sum(1), 0))
        return np.column_stack([v, extra]) @ turn

    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec_id", "v").toArrow()
    raw = np.array(sample.column("v").combine_chunks().flatten()).reshape(-1, dim)
    x = lift(raw, False)
    c = centres(x, min(lists, len(x)))
    if probes is None:
        probes = tuned_probes(x, lift(raw, True), c, k, recall)
    probes = min(probes, len(c))
    anchors = np.unique(sample.column("vec_id").to_numpy()[:ANCHORS], return_index=True)[1]
    shared = spark.sparkContext.broadcast((c, x[anchors], sample.column("vec_id").to_numpy()[anchors]))  # at most 4,096 centres and ANCHORS vectors

    def assign(b: pa.RecordBatch) -> pa.RecordBatch:
        v = np.asarray(b.column(1).flatten()).reshape(-1, dim)
        own = _closest(lift(v, False), shared.value[0], 1)[:, 0]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.int32())], names=["vec_id", "v", "list"])

    def seek(b: pa.RecordBatch) -> list[pa.RecordBatch]:
        out = []
        for lo in range(0, b.num_rows, 1024):
            part = b.slice(lo, 1024)
            ids, v = part.column(1).to_numpy(), np.asarray(part.column(2).flatten()).reshape(-1, dim)
            q = lift(v, True)
            c, anchor, anchor_ids = shared.value
            near = _closest(q, c, probes)
            limit = np.full(len(q), np.inf)
            if len(anchor) > k:
                d = (q * q).sum(1)[:, None] + (anchor * anchor).sum(1)[None, :] - 2 * (q @ anchor.T)
                d[ids[:, None] == anchor_ids[None, :]] = np.inf
                limit = np.partition(d, k - 1, axis=1)[:, k - 1] * (1 + 1e-9) + 1e-9
            take = pa.array(np.repeat(np.arange(len(v)), probes))
            out.append(pa.RecordBatch.from_arrays([*(part.column(i).take(take) for i in range(3)), pa.array(np.repeat(limit, probes)), pa.array(near.ravel(), pa.int32())], names=["no", "query_id", "q", "bound", "list"]))
        return out

    member = written(map_batches(good, assign, "vec_id long, v array<double>, list int"), "vectors")
    # each query row has a number: rows of one id are queries of their own
    queries = written(good.where(F.pmod(F.col("vec_id"), F.lit(every)) == 0).select(F.monotonically_increasing_id().alias("no"), F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "queries")
    asking = map_batches(queries, seek, "no long, query_id long, q array<double>, bound double, list int")

    def splits(df: DataFrame, most: int) -> F.Column:
        """Parts of each list by its rows in ``df``; one unless it is long."""
        many = {r["list"]: -(-r["n"] // most) for r in df.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row per list
        some = {i: m for i, m in many.items() if m > 1}
        if not some:
            return F.lit(1)
        return F.coalesce(F.create_map(*(F.lit(y) for p in some.items() for y in p))[F.col("list")], F.lit(1)).cast("int")

    rows, asks = splits(member, LIST_ROWS), splits(asking, LIST_QUERIES)
    base = member.withColumn("part", F.pmod(F.xxhash64("vec_id"), rows).cast("int")).select("*", F.explode(F.sequence(F.lit(0), asks - 1)).alias("turn"))

    def scan(key, left, right):
        out = [pa.table({"no": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})]
        if left.num_rows and right.num_rows:
            ids = left.column("vec_id").to_numpy()
            v = np.asarray(left.column("v").combine_chunks().flatten()).reshape(-1, dim)
            no, qid, bound = (right.column(c).to_numpy() for c in ("no", "query_id", "bound"))
            q = np.asarray(right.column("q").combine_chunks().flatten()).reshape(-1, dim)
            index = ColumnScan(lift(v, False))
            for lo in range(0, len(q), 512):
                hi = lo + 512
                a, at = index.within(lift(q[lo:hi], True), bound[lo:hi])
                own = ids[at] != qid[lo:hi][a]
                a, at = a[own], at[own]
                score = inner(v[at], q[lo:hi][a])
                order = np.lexsort((ids[at], -score, a))
                a, at, score = a[order], at[order], score[order]
                place = np.arange(len(a)) - np.searchsorted(a, a)
                top = place < k
                out.append(pa.table({"no": no[lo:hi][a[top]], "query_id": qid[lo:hi][a[top]], "vec_id": ids[at[top]], "score": score[top]}))
        return pa.concat_tables(out)

    def best(asked: DataFrame) -> DataFrame:
        asked = asked.withColumn("turn", F.pmod(F.xxhash64("no"), asks).cast("int")).select("*", F.explode(F.sequence(F.lit(0), rows - 1)).alias("part"))
        found = base.groupBy("list", "part", "turn").cogroup(asked.groupBy("list", "part", "turn")).applyInArrow(scan, "no long, query_id long, vec_id long, score double")
        w = Window.partitionBy("no").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("no", "query_id", "rank", "vec_id", "score")

    shown = ["query_id", "rank", "vec_id", "score"]
    out = best(asking)
    if n <= k:
        return out.select(*shown)
    # queries that found too few in their lists within their bound are asked of all lists without one
    out = written(out, "neighbours")
    enough = out.where(F.col("rank") == k).select("no")
    short = written(queries.join(enough, "no", "left_anti"), "short-queries")
    if not short.take(1):
        return out.select(*shown)
    again = short.select("no", "query_id", "q", F.lit(float("inf")).alias("bound"), F.explode(F.sequence(F.lit(0), F.lit(len(c) - 1))).alias("list"))
    return out.join(enough, "no", "left_semi").unionByName(best(again)).select(*shown)


def inner(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, summed in the order of the components."""
    return np.add.accumulate(v * q, axis=1)[:, -1] if len(v) else np.zeros(0)
