"""Operator 9: line dedup with sharded minimal perfect hashes."""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, batch, drop_written, held, map_batches, mix, written

_LEVEL_SALTS = [U64(x | 1) for x in np.random.default_rng(7).integers(1, 1 << 62, 64).tolist()]
_SHARD = "shard int, levels binary, bits binary, ranks binary, prints binary, counts binary"


def _at(h: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(h * _LEVEL_SALTS[level % 64] + U64(level)) % U64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash: per level a bit for each place that just one remaining key takes; the rest go on to the next level."""

    def __init__(self, levels: np.ndarray, bits: np.ndarray, ranks: np.ndarray):
        self.levels, self.bits, self.ranks = levels, bits, ranks
        self.base = np.concatenate([[0], np.cumsum(levels)])

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 1.5) -> "PerfectHash":
        """``keys``: different uint64."""
        levels, bits, rest = [], [], keys
        while len(rest):
            size = max(64, -(-int(gamma * len(rest)) // 64) * 64)
            at = _at(rest, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(size)
            bits.append(alone)
            rest = rest[~alone[at]]
        flat = np.packbits(np.concatenate(bits) if bits else np.zeros(0, bool), bitorder="little").view(U64)
        ones = np.bitwise_count(flat).astype(np.int64)
        return cls(np.array(levels, np.int64), flat, np.concatenate([[0], np.cumsum(ones)]).astype(np.int64))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """A key's number from 0; for keys that weren't built in some number or -1."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, size in enumerate(self.levels.tolist()):
            if not len(todo):
                break
            at = _at(keys[todo], level, size) + self.base[level]
            word, bit = self.bits[at >> 6], (at & 63).astype(U64)
            hit = ((word >> bit) & U64(1)).astype(bool)
            i = todo[hit]
            below = np.bitwise_count(word[hit] & ((U64(1) << bit[hit]) - U64(1))).astype(np.int64)
            out[i] = self.ranks[at[hit] >> 6] + below
            todo = todo[~hit]
        return out


def line_keys(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """Lines, and their keys: ASCII white space stripped at both ends, A-Z lower-cased."""
    lines = text.split(b"\n")
    return lines, [x.strip().lower() for x in lines]


def _hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key, 1)


def line_counts(docs: DataFrame, text_col: str = "text", least_chars: int = 1) -> DataFrame:
    """Row per different line key: its 128-bit hash as (h1, h2) and the number of documents with it.

    Keys repeated in a document count once; counts are summed per batch before the shuffle, so a line that a third of
    the corpus has costs a row per batch.
    """

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        digests: list[bytes] = []
        for text in b.column(0).to_pylist():
            keys = {x.strip().lower() for x in (text or "").encode().split(b"\n")}
            digests.extend(_hash(k) for k in keys if len(k) >= least_chars and (least_chars <= 1 or len(k.decode()) >= least_chars))
        h = np.frombuffer(b"".join(digests), [("a", "<i8"), ("b", "<i8")])
        u, n = np.unique(h, return_counts=True) if len(h) else (h, np.zeros(0, np.int64))
        return batch([("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64())], u["a"].copy(), u["b"].copy(), n)

    parts = map_batches(docs.select(docs[text_col].alias("text")), count, "h1 long, h2 long, n long")
    return parts.groupBy("h1", "h2").agg(F.sum("n").alias("n_docs"))


def build_shards(counts: DataFrame, keys_per_shard: int = 1_000_000, least: int = 2) -> tuple[DataFrame, int]:
    """Writes one row per shard: a perfect hash over the shard's line hashes, with arrays of 64-bit fingerprints and counts.

    Only lines of ``least`` documents or more are stored: that others aren't found is all that a probe needs of them. The
    fingerprint tells that a line isn't there (the chance to mistake one is 2**-64).
    """
    some = written(counts.where(F.col("n_docs") >= max(2, least)), "lines")
    n = some.count()
    shards = max(1, -(-n // keys_per_shard))

    def build(frames):
        for pdf in frames:
            h1, h2 = pdf["h1"].to_numpy().astype(U64), pdf["h2"].to_numpy().astype(U64)
            keys, first, inverse = np.unique(h1, return_index=True, return_inverse=True)  # equal h1: a 2**-64 chance, the larger count stays
            size = np.zeros(len(keys), np.int64)
            np.maximum.at(size, inverse, pdf["n_docs"].to_numpy())
            ph = PerfectHash.build(keys)
            at = ph.find(keys)
            prints, counts_ = np.zeros(len(keys), U64), np.zeros(len(keys), np.int64)
            prints[at], counts_[at] = h2[first], size
            yield int(pdf["shard"].iloc[0]), ph, prints, counts_

    def group(key, t):
        ((shard, ph, prints, n_),) = build([t.to_pandas()])
        return pa.table({"shard": pa.array([shard], pa.int32()), **{k: pa.array([v.tobytes()], pa.binary()) for k, v in (("levels", ph.levels), ("bits", ph.bits), ("ranks", ph.ranks), ("prints", prints), ("counts", n_))}})

    keyed = some.withColumn("shard", F.pmod(F.col("h2"), F.lit(shards)).cast("int"))
    out = written(keyed.groupBy("shard").applyInArrow(group, _SHARD), "line-shards", partition_by="shard")
    drop_written(some)
    return out, shards


class ShardReader:
    """Shards from the shared folder; as many stay in a worker's memory as ``most`` bytes hold."""

    def __init__(self, path: str, most: int = 128 << 20):
        self.fs, self.root = fs.FileSystem.from_uri(path)
        self.most, self.held = most, OrderedDict()

    def get(self, shard: int):
        if shard in self.held:
            self.held.move_to_end(shard)
            return self.held[shard]
        at = f"{self.root}/shard={shard}"
        if self.fs.get_file_info(at).type == fs.FileType.NotFound:
            return None
        files = [f.path for f in self.fs.get_file_info(fs.FileSelector(at)) if f.path.endswith(".parquet")]
        row = pq.ParquetFile(self.fs.open_input_file(files[0])).read().to_pylist()[0]
        got = PerfectHash(np.frombuffer(row["levels"], np.int64), np.frombuffer(row["bits"], U64), np.frombuffer(row["ranks"], np.int64)), np.frombuffer(row["prints"], U64), np.frombuffer(row["counts"], np.int64)
        self.held[shard] = got
        while len(self.held) > 1 and sum(g[1].nbytes * 3 for g in self.held.values()) > self.most:
            self.held.popitem(last=False)
        return got


def probe(path: str, shards: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Documents with each line, from the arrays; 1 where the line isn't stored."""
    reader = held(path, lambda: ShardReader(path))
    out = np.ones(len(h1), np.int64)
    which = h2.astype(np.int64) % shards
    for s in np.unique(which).tolist():
        got = reader.get(s)
        if got is None:
            continue
        ph, prints, counts = got
        i = np.flatnonzero(which == s)
        at = ph.find(h1[i].astype(U64))
        ok = (at >= 0) & (at < len(prints))
        i, at = i[ok], at[ok]
        same = prints[at] == h2[i].astype(U64)
        out[i[same]] = counts[at[same]]
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, least_chars: int = 1, carry: list[str] = ()) -> DataFrame:
    """Row per document: (doc_id, n_lines, n_dropped, kept) and the columns in ``carry``: ``kept`` are the lines whose key fewer than ``min_docs`` documents have.

    Keys of fewer than ``least_chars`` code points are always kept. A null or empty text is one empty line. Each
    row is a document of its own, whatever its id: repeated rows count one by one and give a row each; null ids stay null; an
    empty table gives none. Other columns than those carried are left out. A text of any length is split whole. Beyond one shuffle of line
    hashes with counts, documents probe the written arrays where they are: no line is joined.
    """
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), *carry)
    shards, n = build_shards(line_counts(src, least_chars=least_chars), least=min_docs)
    path = shards._graphloom_path

    def keep(b: pa.RecordBatch) -> pa.RecordBatch:
        all_lines, digests, size = [], [], []
        for text in b.column(1).to_pylist():
            lines, keys = line_keys((text or "").encode())
            all_lines.append(lines)
            size.append(len(lines))
            digests.extend(_hash(k) if len(k) >= least_chars and (least_chars <= 1 or len(k.decode()) >= least_chars) else b"\0" * 16 for k in keys)
        h = np.frombuffer(b"".join(digests), [("a", "<i8"), ("b", "<i8")])
        drop = (probe(path, n, h["a"], h["b"]) >= min_docs) & ((h["a"] != 0) | (h["b"] != 0))
        kept, dropped, at = [], [], 0
        for lines in all_lines:
            d = drop[at : at + len(lines)]
            at += len(lines)
            gone = int(d.sum())
            dropped.append(gone)
            kept.append(b"\n".join(x for x, g in zip(lines, d.tolist()) if not g) if gone else b"\n".join(lines))
        own = [b.column(0), pa.array(size, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays([*own, *b.columns[2:]], names=["doc_id", "n_lines", "n_dropped", "kept", *b.schema.names[2:]])

    kinds = "".join(f", `{c}` {src.schema[c].dataType.simpleString()}" for c in carry)
    return map_batches(src, keep, "doc_id long, n_lines long, n_dropped long, kept string" + kinds)


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
