"""Operator 6: benchmark decontamination by pairs of words."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, batch, blocks, flat, held, map_batches, mix
from .words import Sieve, word_hashes, word_spans

#: Pairs on one alignment from which its best stretch is joined with those of others: four words in a row have so many.
JOINED = 5
#: Pairs of a text and the items that are compared at a time.
ROWS = 1 << 20
#: Pairs of one word pair's places from which they are counted by a transform.
DENSE = 1 << 16
#: Bytes of test text that are held, and broadcast, at a time.
BLOCK = 32 << 20
_SCHEMA = [("doc_id", pa.int64()), ("item_id", pa.int64()), ("matched", pa.int64()), ("item_words", pa.int64()), ("overlap", pa.float64()), ("start_word", pa.int64()), ("end_word", pa.int64())]


def pair_hashes(words: np.ndarray, gap: int) -> np.ndarray:
    """Hash of each word and the one ``gap`` places on; with no gap, of each word."""
    if gap == 0:
        return mix(words)
    n = len(words) - gap
    return mix(words[:n] * U64(0x9E3779B97F4A7C15) + words[gap:] + U64(gap)) if n > 0 else np.zeros(0, U64)


def pairs_needed(n: int, least: float, run: int) -> tuple[int, int]:
    """(gap, pairs): an alignment that counts has at least so many pairs of matching words at most ``gap`` places apart.

    ``h`` matches within ``n`` words lie (n - 1) / (h - 1) places apart at the least, and each gap wider than that takes
    more of the words that don't match. A stretch that scores ``run`` has ``run`` - 1 neighbouring pairs.
    """
    h = max(1, int(np.ceil(least * n - 1e-9)))
    if h == 1 or run <= 1:
        return 0, 1
    gap = (n - 1) // (h - 1)
    return gap, min(h - 1 - (n - h) // gap, run - 1)


class Items:
    """Test items by the hashes of their word pairs."""

    def __init__(self, ids: list[int], buf: np.ndarray, offsets: np.ndarray, least_words: int, least: float, run: int, least_bytes: int = 12):
        words, upto = word_hashes(buf, offsets)
        self.ids, self.words, self.upto = ids, words, upto
        size = np.diff(upto)
        start, end, alone, _ = word_spans(buf, offsets)
        sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[upto])
        part = sums(np.where(alone, 1, 2)) >= 2 * least_words
        whole = (size > 1) & (sums(end - start) >= least_bytes)
        self.part = part  # the others are searched whole
        share = np.where(part, least, 1.0)
        known = {(n, x): pairs_needed(n, x, run) for n, x in set(zip(size.tolist(), share.tolist())) if n}
        both = [known[n, x] if ok and n else (-1, 0) for n, x, ok in zip(size.tolist(), share.tolist(), (part | whole).tolist())]
        gaps, self.needed = (np.array([x[k] for x in both], np.int64) for k in (0, 1))
        owner = np.repeat(np.arange(len(size)), size)
        self.pairs = []
        for gap in range(int(gaps.max(initial=-1)) + 1):
            h = pair_hashes(words, gap)
            at = np.arange(len(h))
            item = owner[: len(h)]
            of = gaps[item]
            ok = (owner[gap:] == item) & ((of >= gap) if gap else (of == 0))
            h, at, item = h[ok], at[ok], item[ok]
            if not len(h):
                continue
            order = np.argsort(h, kind="stable")
            h, item, at = h[order], item[order], at[order]
            sieve = Sieve(h)
            self.pairs.append((gap, sieve, np.searchsorted(h, sieve.keys, "left"), np.searchsorted(h, sieve.keys, "right"), item, at - upto[item]))

    def search(self, words: np.ndarray, upto: np.ndarray, least: float, run: int) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, matched, item's words, first, last word) of the overlaps that count."""
        hits = []
        weight = np.zeros(len(upto), np.int64)
        for gap, sieve, lo, hi, item, at in self.pairs:
            p, k = sieve.find(pair_hashes(words, gap))
            doc = np.searchsorted(upto, p, "right") - 1
            ok = p + gap < upto[doc + 1]
            p, k, doc = p[ok], k[ok], doc[ok]
            hits.append((p, doc, lo[k], hi[k] - lo[k], item, at))
            weight += np.bincount(doc, weights=hi[k] - lo[k], minlength=len(upto)).astype(np.int64)
        out = []
        total = np.concatenate([[0], np.cumsum(weight)])
        i, end = 0, len(upto) - 1
        while i < end:  # texts with about ROWS pairs together
            j = max(i + 1, int(np.searchsorted(total, total[i] + ROWS, "right")) - 1)
            j = min(j, end)
            if total[j] > total[i]:
                out += self._compare(hits, i, j, words, upto, least, run)
            i = j
        return out

    def _merge(self, docs: list, items: list, shifts: list, counts: list) -> None:
        """Sums the pairs of each alignment, which bounds what is held by their number."""
        doc, item, shift, n = (np.concatenate(x) for x in (docs, items, shifts, counts))
        if len(doc):
            order = np.lexsort((shift, item, doc))
            doc, item, shift, n = doc[order], item[order], shift[order], n[order]
            new = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(shift) != 0)]))
            doc, item, shift, n = doc[new], item[new], shift[new], np.add.reduceat(n, new)
        docs[:], items[:], shifts[:], counts[:] = [doc], [item], [shift], [n]

    def _compare(self, hits: list, i: int, j: int, words: np.ndarray, upto: np.ndarray, least: float, run: int) -> list[tuple[int, int, int, int, int, int]]:
        """Alignments of texts ``i`` to ``j``, each compared word by word if it has enough pairs."""
        docs, items, shifts, counts = [], [], [], []

        def expand(p, doc, lo, n, item, at):
            row = np.repeat(np.arange(len(p)), n)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            docs.append(doc[row] - i)
            items.append(item[k])
            shifts.append(p[row] - at[k])
            counts.append(np.ones(len(row), np.int64))

        for p, doc, lo, n, item, at in hits:
            a, b = np.searchsorted(doc, [i, j])
            p, doc, lo, n = p[a:b], doc[a:b], lo[a:b], n[a:b]
            if j > i + 1 or n.sum() <= ROWS:
                expand(p, doc, lo, n, item, at)
                continue
            # one text that repeats what items repeat: such pairs are counted for all alignments at once
            seed, of, times = np.unique(lo, return_inverse=True, return_counts=True)
            dense = times * n[np.unique(lo, return_index=True)[1]] > DENSE
            for s in np.flatnonzero(dense).tolist():
                own = np.flatnonzero(of == s)
                place = p[own]
                k = np.arange(lo[own[0]], lo[own[0]] + n[own[0]])
                for t in np.unique(item[k]).tolist():
                    there = at[k[item[k] == t]]
                    shift, many = _correlate(place, there)
                    docs.append(np.zeros(len(shift), np.int64))
                    items.append(np.full(len(shift), t))
                    shifts.append(shift)
                    counts.append(many)
            rest = np.flatnonzero(~dense[of])
            ends = np.concatenate([[0], np.cumsum(n[rest])])
            lo_ = 0
            while lo_ < len(rest):
                hi_ = max(lo_ + 1, int(np.searchsorted(ends, ends[lo_] + ROWS, "right")) - 1)
                some = rest[lo_:hi_]
                expand(p[some], doc[some], lo[some], n[some], item, at)
                self._merge(docs, items, shifts, counts)
                lo_ = hi_
        if not docs or not sum(map(len, docs)):
            return []
        self._merge(docs, items, shifts, counts)
        (doc,), (item,), (shift,), (pairs,) = docs, items, shifts, counts
        back = int(shift.min())
        reach = int(shift.max()) - back + 1
        key = (doc * len(self.ids) + item) * reach + (shift - back)
        of, shift = key // reach, key % reach + back
        item = of % len(self.ids)
        ok = pairs >= np.minimum(self.needed[item], JOINED)
        of, shift, item, pairs = of[ok], shift[ok], item[ok], pairs[ok]
        out = []
        cut = np.flatnonzero(np.diff(of)) + 1
        starts = np.concatenate([[0], cut]) if len(of) else cut
        for s, e in zip(starts.tolist(), [*cut.tolist(), len(of)]):
            d, t = int(of[s]) // len(self.ids) + i, int(item[s])
            if pairs[s:e].max() < min(JOINED, self.needed[t]):
                continue
            own = self.words[self.upto[t] : self.upto[t + 1]]
            share = least if self.part[t] else 1.0
            hit = np.zeros(len(own), bool)
            longest, first, last = 0, 1 << 60, -1
            for diag, n in zip(shift[s:e].tolist(), pairs[s:e].tolist()):
                a = max(0, int(upto[d]) - diag)
                b = min(len(own), int(upto[d + 1]) - diag)
                same = own[a:b] == words[diag + a : diag + b]
                best, x, y = _segment(same)
                longest = max(longest, best)
                if same.sum() >= share * len(own):  # all stretches of this alignment
                    on = np.flatnonzero(same)
                    x, y = int(on[0]), int(on[-1]) + 1
                elif n < JOINED and best < run:
                    continue
                hit[a + x : a + y] |= same[x:y]
                first, last = min(first, diag + a + x), max(last, diag + a + y - 1)
            n = int(hit.sum())
            if n >= share * len(own) or longest >= run:
                out.append((d, t, n, len(own), first - int(upto[d]), last - int(upto[d])))
        return out


def _correlate(place: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shift, pairs) of all pairs of a place in a text and one in an item, by a product of Fourier transforms."""
    low, size, own = int(place.min()), int(place.max() - place.min()) + 1, int(there.max()) + 1
    x, y = np.zeros(size), np.zeros(own)
    x[place - low] = 1
    y[own - 1 - there] = 1
    n = 1 << int(size + own - 1).bit_length()
    many = np.rint(np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(y, n), n)[: size + own - 1]).astype(np.int64)
    on = np.flatnonzero(many)
    return on - (own - 1) + low, many[on]


def _segment(same: np.ndarray) -> tuple[int, int, int]:
    """The stretch with the best score, a match counting 1 and a substitution -2: it bridges single differences."""
    if not len(same):
        return 0, 0, 0
    c = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
    low = np.minimum.accumulate(c[:-1])
    gain = c[1:] - low
    e = int(gain.argmax())
    s = int(np.flatnonzero(c[: e + 1] == low[e])[-1])
    return int(gain[e]), s, e + 1


def contaminated(docs: DataFrame, items: DataFrame, least: float = 0.5, run: int = 24, least_words: int = 4, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK, least_bytes: int = 12) -> DataFrame:
    """Row per document and test item that overlap: (doc_id, item_id, matched, item_words, overlap, start_word, end_word).

    Words are compared without case and punctuation. Text and item are compared word by word on each alignment that has
    enough pairs of near words in common (``pairs_needed``), so that none that counts is missed, wherever words differ. An
    overlap counts if the words matched on one alignment make up ``least`` of the item, or those of the best stretches of
    several alignments together, or one stretch scores ``run``. Words are split at Unicode punctuation
    and white space; a character of a script without spaces is a word, and counts half a one in ``least_words``. Items of
    fewer than ``least_words`` must occur whole; those of one word or whose words have fewer than ``least_bytes`` bytes
    (four Chinese characters) are too general to be searched; null texts have none, null ids of either stay null. Repeated documents give a row each; no items or no documents give no rows;
    other columns are left out. A text is searched whole, however long or repetitive.

    The items are taken in blocks of ``block_bytes``; each block is indexed and broadcast, and all documents are run past
    it, so no block outgrows its bound and documents are never shuffled.
    """
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    out = None
    for shared in _blocks(docs.sparkSession, items, item_col, item_text, block_bytes):
        find = _searcher(shared, least, run, least_words, least_bytes)

        def search(b: pa.RecordBatch, find=find) -> pa.RecordBatch | None:
            got = find(b.column(1))
            if not got:
                return None
            d, i, *rest = zip(*got)
            n, m, s, e = (np.array(x) for x in rest)
            return batch(_SCHEMA, b.column(0).take(pa.array(d)), list(i), n, m, n / m, s, e)

        rows = map_batches(src, search, "doc_id long, item_id long, matched long, item_words long, overlap double, start_word long, end_word long")
        out = rows if out is None else out.unionByName(rows)
    return out


def without_contaminated(docs: DataFrame, items: DataFrame, least: float = 0.5, run: int = 24, least_words: int = 4, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK, least_bytes: int = 12) -> DataFrame:
    """The rows (all columns) whose text overlaps no item, by the rules of ``contaminated``.

    Each row is judged by its own text where it is, so ids may be null or repeated, and nothing is shuffled or joined.
    """
    spark = docs.sparkSession
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    at, out = docs.columns.index(text_col), docs
    for shared in _blocks(spark, items, item_col, item_text, block_bytes):
        find = _searcher(shared, least, run, least_words, least_bytes)

        def clean(b: pa.RecordBatch, find=find) -> pa.RecordBatch:
            bad = np.zeros(b.num_rows, bool)
            bad[[d for d, *_ in find(b.column(at))]] = True
            return b.filter(pa.array(~bad))

        out = map_batches(out, clean, kinds)
    return out


def _blocks(spark, items: DataFrame, item_col: str, item_text: str, block_bytes: int) -> list:
    """The items' texts in broadcast blocks of about ``block_bytes``."""
    test = items.select(items[item_col].cast("long").alias("i"), F.coalesce(items[item_text], F.lit("")).alias("t"))
    total = test.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    parts = max(1, -(-2 * total // block_bytes))
    return [spark.sparkContext.broadcast(rows_of(test.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k).orderBy("i", "t").collect())) for k in range(parts)]


def rows_of(rows) -> tuple[list[int], bytes, np.ndarray]:
    texts = [r["t"].encode() for r in rows]
    return [r["i"] for r in rows], b"".join(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _searcher(shared, least: float, run: int, least_words: int, least_bytes: int):
    """A function from a text column to (row, item id, matched, item's words, first, last word)."""
    name = uuid.uuid4().hex

    def load() -> Items:
        ids, text, offs = shared.value
        return Items(ids, np.frombuffer(text, np.uint8), offs, least_words, least, run, least_bytes)

    def find(texts: pa.Array) -> list[tuple[int, int, int, int, int, int]]:
        index = held(name, load)
        buf, offsets = flat(texts)
        out = []
        for i, j in blocks(offsets, 1 << 20):
            words, upto = word_hashes(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            out += [(i + d, index.ids[t], *rest) for d, t, *rest in index.search(words, upto, least, run)]
        return out

    return find
