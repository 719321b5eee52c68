"""Operator 7: best-fit packing with large-item matching."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import transducer
from .common import batch, blocks, flat, map_batches, written

_PIECES = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row per piece of each text's ids, then ``end_id``: (doc_id, piece, start, length, ids_crc32).

    Texts of more than ``capacity`` ids are cut; the first piece takes the remainder. A null text is just ``end_id``.
    """
    classes = transducer.char_classes()

    def cut(b: pa.RecordBatch) -> list[pa.RecordBatch]:
        buf, offsets = flat(b.column(1))
        return [_cut(vocabulary, classes, b.column(0).slice(i, j - i), buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], capacity, end_id) for i, j in blocks(offsets, 2 << 20)]

    return map_batches(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _cut(vocabulary: str, classes: bytes, doc_ids: pa.Array, buf: np.ndarray, offsets: np.ndarray, capacity: int, end_id: int) -> pa.RecordBatch:
    n, ids = transducer.encode(vocabulary, classes, buf, offsets, ids=True)
    at = np.concatenate([[0], np.cumsum(n)])
    size = n + 1
    per = -(-size // capacity)
    doc = np.repeat(np.arange(len(n)), per)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    first = size - (per - 1) * capacity
    start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
    length = np.where(piece == 0, first[doc], capacity)
    tail = np.array([end_id], "<u4").tobytes()
    raw = memoryview(ids.astype("<u4").tobytes())
    crc = np.empty(len(doc), np.int64)
    for i, (lo, k, last) in enumerate(zip((at[doc] + start).tolist(), length.tolist(), (piece == per[doc] - 1).tolist())):
        crc[i] = zlib.crc32(tail, zlib.crc32(raw[4 * lo : 4 * (lo + k - 1)])) if last else zlib.crc32(raw[4 * lo : 4 * (lo + k)])
    return batch(_PIECES, doc_ids.take(pa.array(doc)), piece, start, length, crc)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Bins for ``histogram`` (length: pieces): rows (length, first, count, sequence, offset).

    Pieces number first..first+count-1 of that length go to the sequences from ``sequence`` on, one each, at ``offset``.
    Of pieces above a third of the capacity at most two fit a bin: taken longest first, each is matched with the longest
    other that still fits. Smaller ones, longest first, go where the least room is left. Bins with like contents are
    handled as one group, so the work depends on the number of different lengths, not of pieces.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by room: contents, number of bins
    third = capacity // 3
    large = sorted(s for s in left if s > third)
    while large:
        s = large[-1]
        n = left[s]
        i = bisect_left(large, capacity - s + 1) - 1  # longest partner that fits
        if i < 0:
            groups[capacity - s].append(((s,), n))
            large.pop()
            continue
        t = large[i]
        if t == s:
            pairs = n // 2
            if pairs:
                groups[capacity - 2 * s].append(((s, s), pairs))
            if n % 2:
                left[s] = 1
                if i > 0:
                    groups[capacity - s - large[i - 1]].append(((s, large[i - 1]), 1))
                    left[large[i - 1]] -= 1
                    large.pop()
                    if left[large[i - 1]] == 0:
                        large.pop(i - 1)
                else:
                    groups[capacity - s].append(((s,), 1))
                    large.pop()
            else:
                large.pop()
            continue
        pairs = min(n, left[t])
        groups[capacity - s - t].append(((s, t), pairs))
        left[s] -= pairs
        left[t] -= pairs
        if left[t] == 0:
            large.pop(i)
        if left[s] == 0:
            large.pop()
    rooms = sorted(groups)
    for s in sorted((s for s in left if s <= third), reverse=True):
        n = left[s]
        while n:
            i = bisect_left(rooms, s)
            if i == len(rooms):
                whole, rest = divmod(n, capacity // s)
                for k, bins in ((capacity // s, whole), (rest, 1 if rest else 0)):
                    if bins:
                        room = capacity - k * s
                        if room not in groups or not groups[room]:
                            insort(rooms, room)
                        groups[room].append(((s,) * k, bins))
                break
            room = rooms[i]
            k = room // s
            content, bins = groups[room].pop()
            if not groups[room]:
                rooms.pop(i)
            full = min(bins, n // k)
            if full:
                moved, now = full, room - k * s
                _add(groups, rooms, now, content + (s,) * k, moved)
                n -= full * k
            if full < bins and n and n < k:
                _add(groups, rooms, room - n * s, content + (s,) * n, 1)
                full, n = full + 1, 0
            if full < bins:
                _add(groups, rooms, room, content, bins - full)
    rows, taken, sequence = [], defaultdict(int), 0
    for room in sorted(groups):
        for content, bins in groups[room]:
            offset = 0
            for s in content:
                rows.append((s, taken[s], bins, sequence, offset))
                taken[s] += bins
                offset += s
            sequence += bins
    return rows


def _add(groups: dict, rooms: list[int], room: int, content: tuple[int, ...], bins: int) -> None:
    if room not in groups or not groups[room]:
        insort(rooms, room)
    groups[room].append((content, bins))


def pack(pieces: DataFrame, capacity: int = 2048, rows_per_bucket: int = 200_000) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows of (doc_id, piece, start, length, ...), each length from 1 to ``capacity``.

    Only the counts by length (``capacity`` rows at most) reach the driver, where the bins are planned. Each piece then
    needs its number among those of its length: rows are numbered inside (length, bucket) groups of bounded size, and the
    groups' counts are summed up, so that a length which most pieces have is no one task's work. An empty table gives none.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    rows = plan(counts, capacity)
    buckets = max(1, min(4096, total // rows_per_bucket))
    shift = 40
    table = np.array(rows, np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    keys = (table[:, 0] << shift) + table[:, 1]
    spark = pieces.sparkSession
    shared = spark.sparkContext.broadcast((keys, table[:, 1], table[:, 3], table[:, 4]))  # rows of the plan, bounded by the number of different lengths
    b = pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    w = Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "start")
    inside = b.withColumn("_k", F.row_number().over(w).cast("long") - 1)
    before = b.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
    numbered = inside.join(before.select("length", "_b", F.coalesce("_before", F.lit(0)).alias("_before")), ["length", "_b"]).withColumn("_k", F.col("_k") + F.col("_before")).drop("_b", "_before")
    columns = [c for c in pieces.columns]

    def place(x: pa.RecordBatch) -> pa.RecordBatch:
        key, first, sequence, offset = shared.value
        k = x.column("_k").to_numpy()
        i = np.searchsorted(key, (x.column("length").to_numpy() << shift) + k, "right") - 1
        return pa.RecordBatch.from_arrays([*(x.column(c) for c in columns), pa.array(sequence[i] + k - first[i]), pa.array(offset[i])], names=[*columns, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return map_batches(numbered.select(*columns, "_k"), place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``cut_pieces`` and ``pack``; the pieces are written between the two, so that no text is read twice."""
    pieces = written(cut_pieces(docs, vocabulary, capacity, end_id, id_col, text_col), "pieces")
    return pack(pieces, capacity)
