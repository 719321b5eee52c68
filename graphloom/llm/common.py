"""What the corpus operators share: flat text batches, vectorised hashes and skew-safe joins."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.shared import drop_written, new_path, shared_dir, written  # noqa: F401

U64 = np.uint64
#: Python-side work goes over flat buffers of about so many bytes, to bound a task's memory.
BLOCK_BYTES = 4 << 20


# ------------------------------------------------------------------ text batches

def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary Arrow array; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if len(col) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[o[0] : o[-1]], o - o[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows, each of at most ``most`` bytes unless one row alone is longer."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


_held: dict[object, object] = {}


def held(key: object, make: Callable[[], object]) -> object:
    """What a Python worker keeps between tasks: one large object (a model, an index), the last that was asked for."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Gives freed memory back to the system: workers are reused, and many share a machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | list | None], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got = f(b)
                if got is None:
                    continue
                yield from got if isinstance(got, list) else [got]
                del got
        release()

    return df.mapInArrow(run, schema)


def batch(schema: list[tuple[str, pa.DataType]], *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(cols, schema)], names=[n for n, _ in schema])


# ------------------------------------------------------------------ words and hashes

#: ASCII white space [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Lower case for A-Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of the runs of ``mask`` that don't cross a row's border, and the number of runs up to each offset."""
    n = len(mask)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    at = offsets[:-1][np.diff(offsets) > 0]
    first[at] = mask[at]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    at = at[at > 0] - 1
    last[at] = mask[at]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, offsets)


_R = 0x9E3779B97F4A7C15
_powers = {"fwd": np.ones(1, U64), "inv": np.ones(1, U64)}
_byte_values = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        step = U64(_R if kind == "fwd" else pow(_R, -1, 1 << 64))
        more = np.full(max(n, 2 * len(have)), step, U64)
        more[0] = 1
        have = _powers[kind] = np.multiply.accumulate(more)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; spreads what a linear hash leaves regular."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes, by prefix sums of a polynomial with random byte values, in time linear in ``buf``."""
    if not len(starts):
        return np.zeros(0, U64)
    n = len(buf)
    sums = np.zeros(n + 1, U64)
    np.cumsum(_byte_values[buf] * _power("fwd", n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power("inv", n + 1)[starts] + (ends - starts).astype(U64))


_P1, _P2, _P3, _P4, _P5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def xxh64(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each span of ``buf``, all spans in lockstep."""
    n = len(starts)
    if n == 0:
        return np.zeros(0, U64)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    u64 = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    u32 = np.ndarray((len(buf) + 1,), "<u4", padded, strides=(1,))
    seed_ = U64(seed)
    one = np.full(1, seed, U64)  # arrays wrap around without a warning
    h = np.full(n, (one + _P5)[0], U64)
    pos = starts.astype(np.int64).copy()
    end = pos + lens
    big = np.flatnonzero(lens >= 32)
    if len(big):
        p, stripes = pos[big], lens[big] // 32
        order = np.argsort(-stripes, kind="stable")
        big, p, stripes = big[order], p[order], stripes[order]
        v = [np.full(len(big), x, U64) for x in ((one + _P1 + _P2)[0], (one + _P2)[0], seed_, (one - _P1)[0])]
        for k in range(int(stripes[0])):
            m = int(np.searchsorted(-stripes, -k, "left"))  # those with more than k stripes
            for j in range(4):
                v[j][:m] = _rot(v[j][:m] + u64[p[:m] + (32 * k + 8 * j)] * _P2, 31) * _P1
        a = _rot(v[0], 1) + _rot(v[1], 7) + _rot(v[2], 12) + _rot(v[3], 18)
        for j in range(4):
            a = (a ^ (_rot(v[j] * _P2, 31) * _P1)) * _P1 + _P4
        h[big] = a
        pos[big] = p + 32 * stripes
    h += lens.astype(U64)
    for _ in range(3):
        i = np.flatnonzero(end - pos >= 8)
        if not len(i):
            break
        h[i] = _rot(h[i] ^ (_rot(u64[pos[i]] * _P2, 31) * _P1), 27) * _P1 + _P4
        pos[i] += 8
    i = np.flatnonzero(end - pos >= 4)
    if len(i):
        h[i] = _rot(h[i] ^ (u32[pos[i]].astype(U64) * _P1), 23) * _P2 + _P3
        pos[i] += 4
    for _ in range(3):
        i = np.flatnonzero(end > pos)
        if not len(i):
            break
        h[i] = _rot(h[i] ^ (padded[pos[i]].astype(U64) * _P5), 11) * _P1
        pos[i] += 1
    h = (h ^ (h >> U64(33))) * _P2
    h = (h ^ (h >> U64(29))) * _P3
    return h ^ (h >> U64(32))


# ------------------------------------------------------------------ joins with hot keys

def hot_join(left: DataFrame, right: DataFrame, key: str, weight: str, share: int = 2000) -> DataFrame:
    """Left join on ``key`` where ``weight`` of ``right`` (one row per key) says how many rows of ``left`` have it.

    Keys with over 1/``share`` of all rows, hence fewer than ``share`` keys, are joined by broadcast, so that no task
    gets a hot key's rows; the rest is shuffled.
    """
    total = right.agg(F.sum(weight).alias("t")).first()["t"] or 0
    least = max(total // share, 1000)
    hot = right.where(F.col(weight) > least)
    keys = [r[0] for r in hot.select(key).collect()]  # fewer than share
    if not keys:
        return left.join(right, key, "left")
    is_hot = F.col(key).isin(keys)
    return left.where(is_hot).join(F.broadcast(hot), key, "left").unionByName(left.where(~is_hot | F.col(key).isNull()).join(right.where(F.col(weight) <= least), key, "left"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
