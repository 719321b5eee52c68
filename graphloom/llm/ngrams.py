"""Character n-gram models with interpolated modified Kneser-Ney smoothing; operators 2 and 5 share them.

A character has a 12-bit number in a vocabulary, 0 being the text's border and 1 any character outside it. An n-gram is
one long: its last character in the lowest bits, the earlier ones above. So the lower-order n-gram is the key's low bits,
and the history is the key without its lowest 12 bits; both are exact.
"""

from __future__ import annotations

import mmap
import os
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, U64, batch, blocks, flat, map_batches, release, written
from .transducer import _code_points

BITS = 12
MOST_CHARS = (1 << BITS) - 2
_TAG = 60  # keys hold at most 5 characters; the order goes above


def char_counts(docs: DataFrame, text_col: str = "text", block: int = BLOCK_BYTES) -> DataFrame:
    """(cp, n): how often each code point occurs. Texts are read by blocks of ``block`` bytes."""

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        buf, offsets = flat(b.column(0))
        total = np.zeros(0x110000, np.int64)
        for i, j in blocks(offsets, block):
            cp, _ = _code_points(buf[offsets[i] : offsets[j]])
            n = np.bincount(cp)
            total[: len(n)] += n
        cp = np.flatnonzero(total)
        return batch([("cp", pa.int32()), ("n", pa.int64())], cp, total[cp])

    return map_batches(docs.select(docs[text_col].alias("text")), count, "cp int, n long").groupBy("cp").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, least: int = 2) -> np.ndarray:
    """Code points numbered from 2: the most frequent (ties: smaller first), at most 4,094, each seen ``least`` times."""
    rows = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "cp").limit(MOST_CHARS - 1).collect()
    return np.array([r["cp"] for r in rows], np.int32)


def numbers(vocab: np.ndarray) -> np.ndarray:
    t = np.ones(0x110000, np.uint16)
    t[vocab] = np.arange(2, 2 + len(vocab))
    return t


def keys_of(table: np.ndarray, buf: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """N-gram keys of each text's characters and its end, and where each text's keys begin."""
    cp, at = _code_points(buf)
    where = offsets if at is None else np.searchsorted(at, offsets)
    n, pad = len(where) - 1, order - 1
    size = np.diff(where)
    out = np.zeros(len(cp) + n * order, np.int64)  # per text: borders, characters, border
    begin = where[:-1] + np.arange(n) * order + pad
    out[np.arange(len(cp)) + np.repeat(np.arange(n) * order + pad, size)] = table[cp]
    key = out.copy()
    for k in range(1, order):
        key[k:] |= out[:-k] << (BITS * k)
    starts = np.concatenate([[0], np.cumsum(size + 1)])
    pick = np.arange(starts[-1]) + np.repeat(begin - starts[:-1], size + 1)
    return key[pick], starts


def gram_counts(docs: DataFrame, vocab: np.ndarray, order: int, flags: list[str] = (), text_col: str = "text", block: int = 1 << 20, most: int = 2_000_000) -> DataFrame:
    """(key, c, c_<flag> for each boolean column in ``flags``), summed per task before the shuffle.

    A task reads texts by blocks of ``block`` bytes and holds the counts of at most about ``most`` keys.
    """
    names = ["c", *(f"c_{f}" for f in flags)]
    fields = [("key", pa.int64()), *((x, pa.int64()) for x in names)]

    def merge(parts):
        key = np.concatenate([p[0] for p in parts])
        u, inv = np.unique(key, return_inverse=True)
        return u, [np.bincount(inv, weights=np.concatenate([p[1][k] for p in parts]), minlength=len(u)).astype(np.int64) for k in range(len(names))]

    def count(batches):
        table, parts = numbers(vocab), []
        for b in batches:
            buf, offsets = flat(b.column(0))
            marks = [np.asarray(b.column(1 + k).fill_null(False)) for k in range(len(flags))]
            for i, j in blocks(offsets, block):
                key, starts = keys_of(table, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], order)
                u, inv = np.unique(key, return_inverse=True)
                own = [np.bincount(inv, minlength=len(u))]
                for m in marks:
                    own.append(np.bincount(inv, weights=np.repeat(m[i:j], np.diff(starts)), minlength=len(u)).astype(np.int64))
                parts.append((u, own))
                if sum(len(p[0]) for p in parts) > most:
                    parts = [merge(parts)]
                    if len(parts[0][0]) > most * 3 // 4:
                        yield batch(fields, parts[0][0], *parts[0][1])
                        parts = []
        if parts:
            u, own = merge(parts)
            yield batch(fields, u, *own)
        release()

    src = docs.select(docs[text_col].alias("text"), *(docs[f].cast("boolean").alias(f) for f in flags))
    parts = src.mapInArrow(count, ", ".join(f"{n} long" for n, _ in fields))
    return parts.groupBy("key").agg(*(F.sum(x).alias(x) for x in names))


def kneser_ney(grams: DataFrame, order: int, vocab_size: int) -> DataFrame:
    """Model rows (n, key, p, g) from highest-order counts (key, c): ``p`` is the interpolated probability of n-gram ``key``, ``g`` the weight left to lower orders after the history ``key`` (rows with a null p).

    Lower orders count in how many different n-grams one order above a gram ends. All steps are group-bys and joins on
    the keys, so each is spread over the shuffle's partitions.
    """
    mask = {n: (1 << (BITS * n)) - 1 for n in range(1, order + 1)}
    level = grams.where("c > 0").select(F.lit(order).alias("n"), "key", "c")
    every = level
    for n in range(order - 1, 0, -1):
        level = level.groupBy(F.col("key").bitwiseAND(mask[n]).alias("key")).agg(F.count("*").alias("c")).select(F.lit(n).alias("n"), "key", "c")
        every = every.unionByName(level)
    every = written(every, "grams")
    few = {(r["n"], r["c"]): r["k"] for r in every.where("c <= 4").groupBy("n", "c").agg(F.count("*").alias("k")).collect()}
    less = F.lit(0.0)
    for n in range(1, order + 1):
        t = [few.get((n, k), 0) for k in (1, 2, 3, 4)]
        y = t[0] / (t[0] + 2 * t[1]) if t[0] + t[1] else 0.5
        d = [min(max(k - (k + 1) * y * t[k] / t[k - 1], 0.05), k - 0.05) if t[k - 1] else 0.5 for k in (1, 2, 3)]
        less = F.when(F.col("n") == n, F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])).otherwise(less)
    own = every.withColumn("d", less).withColumn("h", F.shiftrightunsigned("key", BITS))
    history = own.groupBy("n", "h").agg(F.sum("c").alias("t"), F.sum("d").alias("d")).select("n", "h", "t", (F.col("d") / F.col("t")).alias("g"))
    own = written(own.join(history, ["n", "h"]).select("n", "key", ((F.col("c") - F.col("d")) / F.col("t")).alias("a"), "g"), "grams-own")
    lower = own.where("n = 1").select("n", "key", (F.col("a") + F.col("g") / F.lit(float(vocab_size))).alias("p"))
    out = lower
    for n in range(2, order + 1):
        below = lower.select(F.col("key").alias("k1"), F.col("p").alias("q"))
        lower = own.where(f"n = {n}").join(below, F.col("key").bitwiseAND(mask[n - 1]) == F.col("k1")).select("n", "key", (F.col("a") + F.col("g") * F.col("q")).alias("p"))
        lower = written(lower, "probabilities")
        out = out.unionByName(lower)
    return out.select("n", "key", "p", F.lit(None).cast("double").alias("g")).unionByName(history.select("n", F.col("h").alias("key"), F.lit(None).cast("double").alias("p"), "g"))


class Table:
    """Open hash table from int64 keys to float32 values, probed in bulk."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self._make(len(keys))
        self.add(keys, values)

    def _make(self, rows: int) -> None:
        self.bits = max(8, int(np.ceil(np.log2(max(rows, 1) * 2))))
        size = 1 << self.bits
        self.keys, self.values = self._arrays(size)
        self.keys.fill(-1)

    def _arrays(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        return np.empty(size, np.int64), np.zeros(size, np.float32)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Further keys, none of which is there yet."""
        size = len(self.keys)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] < 0]
            self.keys[slot[free]] = keys[free]
            won = self.keys[slot[todo]] == keys[todo]
            self.values[slot[todo[won]]] = values[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray, default: float = np.nan) -> np.ndarray:
        slot = self._slot(keys)
        seen = self.keys[slot]
        out = self.values[slot]
        off = np.flatnonzero(seen != keys)
        while len(off):
            gone = seen[off] < 0
            out[off[gone]] = default
            off = off[~gone]
            slot[off] = (slot[off] + 1) & (len(self.keys) - 1)
            seen[off] = self.keys[slot[off]]
            out[off] = self.values[slot[off]]
            off = off[seen[off] != keys[off]]
        return out


class MappedTable(Table):
    """A table for ``rows`` keys, to be added, in a file without a name on the local disk.

    Its pages are the system's, which may write them back and drop them, so that a worker's own memory doesn't grow with
    the table. The disk is reserved first, where the system can: if it is full there is an error, not a signal at some later write.
    """

    def __init__(self, rows: int):
        self._make(rows)

    def _arrays(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        at = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]  # Spark sets it for its Python workers
        with tempfile.TemporaryFile(dir=at if os.path.isdir(at) else None) as f:
            f.truncate(size * 12)
            if hasattr(os, "posix_fallocate"):
                os.posix_fallocate(f.fileno(), 0, size * 12)
            whole = mmap.mmap(f.fileno(), size * 12)
        return np.frombuffer(whole, np.int64, size), np.frombuffer(whole, np.float32, size, size * 8)


class Model:
    """Log-probabilities from model rows as arrays (n, key, p, g)."""

    def __init__(self, n: np.ndarray, key: np.ndarray, p: np.ndarray, g: np.ndarray, order: int, vocab_size: int):
        self.order, self.floor = order, -np.log(vocab_size)
        own, rest = self._logs(n, key, p, g)
        self.p, self.g = Table(*own), Table(*rest)

    @staticmethod
    def _logs(n: np.ndarray, key: np.ndarray, p: np.ndarray, g: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Keys and values of the table of probabilities and of that of weights."""
        is_p = ~np.isnan(p)
        tag = key | (n.astype(np.int64) << _TAG)
        return (tag[is_p], np.log(p[is_p]).astype(np.float32)), (tag[~is_p], np.log(np.maximum(g[~is_p], 1e-9)).astype(np.float32))

    def score(self, keys: np.ndarray) -> np.ndarray:
        """Natural-log probability of each key's last character after the others."""
        out = self.p.get(keys | (self.order << _TAG))
        rest = np.flatnonzero(np.isnan(out))
        back = np.zeros(len(rest), np.float32)
        for n in range(self.order, 0, -1):
            if not len(rest):
                return out
            k = keys[rest] & ((1 << (BITS * n)) - 1)
            back = back + self.g.get((k >> BITS) | (n << _TAG), 0.0)
            if n == 1:
                out[rest] = back + self.floor
                return out
            got = self.p.get((k & ((1 << (BITS * (n - 1))) - 1)) | ((n - 1) << _TAG))
            hit = ~np.isnan(got)
            out[rest[hit]] = back[hit] + got[hit]
            rest, back = rest[~hit], back[~hit]
        return out


class MappedModel(Model):
    """A model read from its written rows by pieces of at most 65,536 into mapped tables: of any size, a worker's own memory holds a piece."""

    def __init__(self, path: str, order: int, vocab_size: int):
        f, root = fs.FileSystem.from_uri(path)
        rows = pads.dataset(root, filesystem=f, format="parquet")
        pieces = lambda *columns: rows.to_batches(columns=list(columns), batch_size=1 << 16, batch_readahead=1, fragment_readahead=1, use_threads=False)
        weights = sum(b.column(0).null_count for b in pieces("p"))
        self.order, self.floor = order, -np.log(vocab_size)
        self.p, self.g = MappedTable(rows.count_rows() - weights), MappedTable(weights)
        for b in pieces("n", "key", "p", "g"):
            own, rest = self._logs(*(x.to_numpy(zero_copy_only=False) for x in b.columns))
            self.p.add(*own)
            self.g.add(*rest)


def mean_loss(model: Model, table: np.ndarray, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's mean loss per character (nats, the end counted as one) and number of characters."""
    loss, size = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1, np.int64)
    for i, j in blocks(offsets, 1 << 17):
        key, starts = keys_of(table, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], model.order)
        loss[i:j] = -np.add.reduceat(model.score(key).astype(np.float64), starts[:-1]) / np.diff(starts)
        size[i:j] = np.diff(starts) - 1
    return loss, size


#: Signs of a word that are looked at together; a longer run, as in scripts without spaces, is cut.
WINDOW = 24


def read_model(path: str, order: int, size: int) -> Model:
    """A model from its written rows in the shared folder."""
    f, root = fs.FileSystem.from_uri(path)
    t = pq.read_table(root, filesystem=f, columns=["n", "key", "p", "g"])
    return Model(*(t.column(c).to_numpy() for c in ("n", "key", "p", "g")), order, size)


def spaces(table: np.ndarray) -> np.ndarray:
    """By character number: whether it ends a word. The border (0) does."""
    out = np.zeros(1 << BITS, bool)
    out[0] = True
    for c in (0x20, 9, 10, 11, 12, 13):
        if table[c] > 1:
            out[table[c]] = True
    return out


def word_windows(numbers_: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where windows begin: at each word, with the sign that ends it, and every ``WINDOW`` signs of a longer one."""
    end = ends[numbers_]
    first = np.concatenate([[True], end[:-1]])
    start = np.maximum.accumulate(np.where(first, np.arange(len(end)), 0))
    return np.flatnonzero((np.arange(len(end)) - start) % WINDOW == 0)


def worst_mean(value: np.ndarray, owner: np.ndarray, texts: int, share: float) -> np.ndarray:
    """Per text the mean of the largest ``share`` of its values, one at least; nan without any."""
    order = np.lexsort((-value, owner))
    value, owner = value[order], owner[order]
    n = np.bincount(owner, minlength=texts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    top = place < np.maximum(1, np.ceil(share * n))[owner]
    k = np.bincount(owner[top], minlength=texts)
    return np.where(k > 0, np.bincount(owner[top], weights=value[top], minlength=texts) / np.maximum(k, 1), np.nan)


def text_scores(model: Model, other: Model | None, table: np.ndarray, buf: np.ndarray, offsets: np.ndarray, worst: float, alike: float) -> tuple[np.ndarray, ...]:
    """Per text: mean loss and number of characters as ``mean_loss``; the mean loss per character of its ``worst`` share of words; the mean of the ``alike`` share of words for which ``other`` is surest against ``model``, in nats a word."""
    n = len(offsets) - 1
    loss, size, odd, like = np.zeros(n), np.zeros(n, np.int64), np.full(n, np.nan), np.full(n, np.nan)
    ends = spaces(table)
    for i, j in blocks(offsets, 1 << 19):
        key, starts = keys_of(table, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], model.order)
        own = -model.score(key).astype(np.float64)
        loss[i:j] = np.add.reduceat(own, starts[:-1]) / np.diff(starts)
        size[i:j] = np.diff(starts) - 1
        number = key & ((1 << BITS) - 1)
        at = word_windows(number, ends)
        width = np.diff(np.concatenate([at, [len(key)]]))
        word = ~(ends[number[at]] & (width == 1))  # not the space after another space
        owner = np.searchsorted(starts, at, "right") - 1
        odd[i:j] = worst_mean((np.add.reduceat(own, at) / width)[word], owner[word], j - i, worst)
        if other is not None:
            gain = own + other.score(key)
            like[i:j] = worst_mean(np.add.reduceat(gain, at)[word], owner[word], j - i, alike)
    return loss, size, odd, like
