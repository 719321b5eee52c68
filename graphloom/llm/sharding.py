"""Operator 10: balanced label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, hot_join, written


def grants(asked: dict[tuple[int, int], int], free: dict[int, int]) -> dict[tuple[int, int], int]:
    """Of the rows that want to go from shard to shard, how many may, so that no shard gets more than its free room and what leaves it at once."""
    x = {p: float(n) for p, n in asked.items()}
    for _ in range(100):
        out, into = {}, {}
        for (a, b), n in x.items():
            out[a], into[b] = out.get(a, 0) + n, into.get(b, 0) + n
        over = {b: max(0.0, free[b] + out.get(b, 0)) / n for b, n in into.items() if n > free[b] + out.get(b, 0) + 1e-9}
        if not over:
            break
        x = {(a, b): n * over.get(b, 1.0) for (a, b), n in x.items()}
    y = {p: int(n) for p, n in x.items()}
    out, into = {}, {}
    for (a, b), n in y.items():
        out[a], into[b] = out.get(a, 0) + n, into.get(b, 0) + n
    for p in sorted(y, key=lambda p: (y[p] - x[p], p)):  # room left by rounding down
        more = min(asked[p] - y[p], max(0, free[p[1]] + out.get(p[1], 0)) - into[p[1]])
        if more > 0:
            y[p] += more
            into[p[1]] += more
    while True:
        out, into = {}, {}
        for (a, b), n in y.items():
            out[a], into[b] = out.get(a, 0) + n, into.get(b, 0) + n
        bad = [b for b, n in into.items() if n > max(0, free[b] + out.get(b, 0))]
        if not bad:
            return {p: n for p, n in y.items() if n > 0}
        for b in bad:
            less = into[b] - max(0, free[b] + out.get(b, 0))
            for p in sorted((p for p in y if p[1] == b), key=lambda p: -y[p]):
                cut = min(less, y[p])
                y[p] -= cut
                less -= cut


def move(state: DataFrame, want: DataFrame, allowed: dict[tuple[int, int], int], shards: int) -> DataFrame:
    """``state`` after as many rows of ``want`` (g, shard, home, n) moved as ``allowed`` has for each (shard, home).

    Groups move in the order of a hash, whole until the number is reached. The order's running sums are taken in buckets
    and the buckets' sums added, so no task gets all of a shard's groups.
    """
    most = F.create_map(*(F.lit(y) for (a, b), x in allowed.items() for y in (a * shards + b, x)))[F.col("shard") * shards + F.col("home")]
    want = want.withColumn("bucket", F.pmod(F.xxhash64("g", F.lit(7)), F.lit(64)).cast("int"))
    first = Window.unboundedPreceding
    per = want.groupBy("shard", "home", "bucket").agg(F.sum("n").alias("b"))
    per = per.withColumn("before", F.coalesce(F.sum("b").over(Window.partitionBy("shard", "home").orderBy("bucket").rowsBetween(first, -1)), F.lit(0))).drop("b")
    upto = F.sum("n").over(Window.partitionBy("shard", "home", "bucket").orderBy("g").rowsBetween(first, 0))
    run = want.withColumn("upto", upto).join(per, ["shard", "home", "bucket"])
    left = F.coalesce(most, F.lit(0)) - (F.col("before") + F.col("upto") - F.col("n"))
    moves = run.withColumn("m", F.greatest(F.lit(0), F.least(F.col("n"), left))).where("m > 0")
    delta = moves.select("g", F.col("home").alias("shard"), F.col("m").alias("n")).unionByName(moves.select("g", "shard", (-F.col("m")).alias("n")))
    new = written(state.select("g", "shard", "n").unionByName(delta).groupBy("g", "shard").agg(F.sum("n").cast("long").alias("n")).where("n > 0"), "labels")
    drop_written(state)
    return new


def loads(state: DataFrame) -> dict[int, int]:
    return {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}


def propagate(state: DataFrame, shards: int, quota: list[int], rounds: int) -> DataFrame:
    """Balanced label propagation over rows (g, shard, n): ``n`` linked rows of group ``g`` are in ``shard``.

    Each round, a group's rows want to go where most of their group is among shards with room (ties by a hash), be it
    from larger parts in full shards if the group is small; the wishes are summed into a table of shards x shards, on which ``grants`` decides. Ends when nothing may move.
    """
    for _ in range(rounds):
        load = loads(state)
        free = {s: quota[s] - load.get(s, 0) for s in range(shards)}
        open_ = [s for s in free if free[s] > 0] or list(free)
        is_open = F.col("shard").isin(open_)
        sized = state.withColumn("size", F.struct("n", F.pmod(F.xxhash64("g", "shard"), F.lit(1 << 30)).alias("h"), F.col("shard").alias("s")))
        best = sized.groupBy("g").agg(F.max(F.when(is_open, F.col("size"))).alias("top"), F.sum("n").alias("all"))
        stuck = ~is_open & (F.col("all") <= min(quota) // 2)
        want = sized.join(best, "g").where((F.col("shard") != F.col("top.s")) & ((F.col("size") < F.col("top")) | stuck))
        want = written(want.select("g", "shard", F.col("top.s").alias("home"), "n"), "wishes")
        asked = {(r["shard"], r["home"]): r["n"] for r in want.groupBy("shard", "home").agg(F.sum("n").alias("n")).collect()}
        allowed = grants(asked, free)
        if not allowed:
            drop_written(want)
            break
        state = move(state, want, allowed, shards)
        drop_written(want)
    return state


def relieve(state: DataFrame, shards: int, quota: list[int]) -> DataFrame:
    """Moves what exceeds a shard's quota to shards with room."""
    while True:
        load = loads(state)
        over = sorted(((n - quota[s], s) for s, n in load.items() if n > quota[s]), reverse=True)
        if not over:
            return state
        room = sorted(((quota[s] - load.get(s, 0), s) for s in range(shards) if load.get(s, 0) < quota[s]), reverse=True)
        pairs = {s: (t, min(n, r)) for (n, s), (r, t) in zip(over, room)}
        home = F.create_map(*(F.lit(y) for s, (t, _) in pairs.items() for y in (s, t)))[F.col("shard")]
        want = state.where(F.col("shard").isin(list(pairs))).withColumn("home", home)
        state = move(state, want, {(s, t): n for s, (t, n) in pairs.items()}, shards)


def shard_rows(rows: DataFrame, shards: int = 40, rounds: int = 16) -> DataFrame:
    """Places rows of (doc_id, size, text_crc32, g); rows of one ``g`` are linked.

    Law ``rows``: shards differ by at most one row. Linked rows start where a hash puts them and move by label
    propagation under the quotas; rows without links then fill up each shard exactly. Rows of one group and shard are
    alike, so the propagation handles (group, shard, count) only: a group of a third of all rows is at most ``shards``
    rows.
    """
    total = rows.count()
    quota = [total // shards + (1 if s < total % shards else 0) for s in range(shards)]
    linked = written(rows.groupBy("g").agg(F.count("*").alias("c")).where("c > 1"), "linked")
    marked = written(hot_join(rows, linked, "g", "c").withColumn("part", F.when(F.col("c").isNotNull(), F.col("g"))), "marked")
    begin = F.pmod(F.xxhash64("doc_id", "g"), F.lit(shards)).cast("int").alias("shard")
    state = written(marked.where("part is not null").select("g", begin).groupBy("g", "shard").agg(F.count("*").alias("n")), "labels")
    state = propagate(relieve(state, shards, quota), shards, quota, rounds)
    load = loads(state)
    w = Window.partitionBy("g").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    spans = state.withColumn("lo", F.coalesce(F.sum("n").over(w), F.lit(0)))
    spans = spans.groupBy("g").agg(F.sum("n").alias("w"), F.collect_list(F.struct("lo", (F.col("lo") + F.col("n")).alias("hi"), "shard")).alias("spans"))  # at most one per shard
    rest, at = [], 0
    for s in range(shards):
        room = quota[s] - load.get(s, 0)
        rest.append(F.struct(F.lit(at).cast("long").alias("lo"), F.lit(at + room).cast("long").alias("hi"), F.lit(s).alias("shard")))
        at += room
    numbered = number(marked, ["part"], ["doc_id", "size", "text_crc32"], total)
    placed = hot_join(numbered, written(spans.withColumnRenamed("g", "part"), "spans"), "part", "w")
    fit = F.filter(F.coalesce("spans", F.array(*rest)), lambda x: (x["lo"] <= F.col("k")) & (F.col("k") < x["hi"]))
    placed = written(placed.select("doc_id", "size", "text_crc32", fit[0]["shard"].alias("shard")), "placed")
    out = number(placed, ["shard"], ["doc_id", "size", "text_crc32"], total)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("k").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def number(df: DataFrame, by: list[str], order: list[str], total: int, rows_per_bucket: int = 200_000) -> DataFrame:
    """Adds ``k``, numbering each group of ``by`` from 0 without gaps.

    Rows are numbered inside (group, bucket), buckets being of bounded size, then the counts of the buckets before are
    added: a group of any size is never one task's work.
    """
    buckets = max(1, min(65_536, total // rows_per_bucket))
    b = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    inside = b.withColumn("_k", F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*order)).cast("long") - 1)
    if buckets == 1:
        return inside.withColumn("k", F.col("_k")).drop("_b", "_k")
    sums = b.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    right = sums.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_b").alias("__b"), "_before")
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] + [F.col("_b") == F.col("__b")]
    return inside.join(right, on).withColumn("k", F.col("_k") + F.col("_before")).drop("_b", "__b", "_k", "_before", *(f"_{c}" for c in by))


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row per document: (doc_id, size, text_crc32, law, shard, slot, grown_shard); equal texts are linked.

    ``size`` is the text's UTF-8 bytes (null: none) plus 16. The law is ``rows``: counts differ by at most one. Null
    texts are linked with each other and with empty ones. Repeated rows are placed one by one; an empty table gives none.
    Groups go by a 128-bit digest and the size.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("g"))
    return shard_rows(written(rows, "sharding-rows"), shards)
