"""Byte-level BPE compiled to deterministic transducers.

Two machines read a text, both exact:

* the *splitter* reads code points (as 10 classes) and marks where the next piece begins. It has 12 states, so the map
  from every state before a chunk to the state after it is an array of 12; chunk maps compose, and a parallel prefix scan
  over a document's chunk maps gives each chunk its true first state. Most maps are constant after a few characters.
* the *merger* reads a piece's bytes. After each prefix, exactly one token can end the prefix's encoding, and it follows
  from the last tokens at those earlier places from which a token of the vocabulary may still be open. A state holds just
  these, so it is a finite machine; each transition is annotated with the change in the number of emitted tokens, and each
  state with the last token, from which the ids are traced back. Transitions are compiled when first taken and kept.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from tokenizers.pre_tokenizers import ByteLevel

from .common import U64, blocks, held

# ------------------------------------------------------------------ splitter

LX, LC, LRV, LE, LL, NUM, PUN, QUO, SP, WS = range(10)
START, L, N, P, A, A_RV, A_L, S1, W1, SK, WK, C = range(12)
HERE, BEFORE = 1, 2  # a piece begins at this code point, at the one before
CHUNK = 512


def _fresh(c: int) -> int:
    return L if c <= LL else {NUM: N, PUN: P, QUO: A, SP: S1, WS: W1}[c]


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    to, mark = np.zeros((12, 10), np.uint8), np.zeros((12, 10), np.uint8)
    for c in range(10):
        letter, blank = c <= LL, c in (SP, WS)
        kind = L if letter else _fresh(c)
        for s in range(12):
            go, m = _fresh(c), HERE
            if s == START:
                m = 0
            elif s == L and letter:
                go, m = L, 0
            elif s == N and c == NUM:
                go, m = N, 0
            elif s in (P, A) and c in (PUN, QUO):
                go, m = P, 0
            elif s == A and c == LC:
                go, m = C, 0
            elif s == A and c == LRV:
                go, m = A_RV, 0
            elif s == A and c == LL:
                go, m = A_L, 0
            elif (s == A_RV and c == LE) or (s == A_L and c == LL):
                go, m = C, 0
            elif s in (A_RV, A_L):  # no contraction: the apostrophe stands alone, a word began at the letter
                go, m = (L, BEFORE) if letter else (_fresh(c), BEFORE | HERE)
            elif s in (S1, W1, SK, WK) and blank:
                go, m = SK if c == SP else WK, 0
            elif s == S1:
                go, m = P if c in (PUN, QUO) else kind, 0
            elif s == SK:  # the last space joins what follows
                go, m = P if c in (PUN, QUO) else kind, BEFORE
            elif s == WK:
                m = BEFORE | HERE
            to[s, c], mark[s, c] = go, m
    return to, mark


_TO, _MARK = _splitter()
_TO_FLAT, _MARK_FLAT = _TO.ravel(), _MARK.ravel()


def char_classes() -> bytes:
    """The class of each code point, zipped: letters, numbers and white space as the tokenizers library's own splitter has them.

    Its Unicode version may differ from that of other libraries, so each candidate is tried: a letter joins "a", a number
    joins "1", other signs join "!", white space joins none.
    """
    t = np.full(0x110000, PUN, np.uint8)
    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    some = [ord(c) for m in regex.finditer(r"[\p{L}\p{N}\s]+", every) for c in m.group()]
    split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    for i in range(0, len(some), 20000):
        part = some[i : i + 20000]

        def begins(tail: str) -> np.ndarray:
            got = {o[0] for _, o in split("".join("\na" + chr(c) + tail for c in part))}
            return np.array([[4 * k + 2 in got, 4 * k + 3 in got] for k in range(len(part))])

        one, bang = begins("1"), begins("!")
        t[part] = np.where(~one[:, 0], LX, np.where(~one[:, 1], NUM, np.where(~bang[:, 1], PUN, WS)))
    for c, k in (("stmd", LC), ("rv", LRV), ("e", LE), ("l", LL), ("'", QUO), (" ", SP)):
        for x in c:
            t[ord(x)] = k
    return zlib.compress(t.tobytes())


def _code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Code points and where each begins (None: every byte)."""
    if not len(buf) or buf.max() < 0x80:
        return buf, None
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    cp = buf[at].astype(np.int32)
    pad = np.concatenate([buf, np.zeros(4, np.uint8)]).astype(np.int32)
    for low, high, n, keep in ((0xC0, 0xE0, 2, 0x1F), (0xE0, 0xF0, 3, 0x0F), (0xF0, 0x100, 4, 0x07)):
        i = np.flatnonzero((cp >= low) & (cp < high))
        if len(i):
            x = cp[i] & keep
            for k in range(1, n):
                x = (x << 6) | (pad[at[i] + k] & 0x3F)
            cp[i] = -x - 1  # negative: done, as its value may lie in a later range
    return np.where(cp < 0, -cp - 1, cp), at


def chunk_maps(cls: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Row per chunk: the state after it, for each of the 12 states before it.

    The last 24 characters mostly lead every state to one; only chunks where they don't are read whole.
    """
    out = np.tile(np.arange(12, dtype=np.uint8), (len(starts), 1))

    def read(rows: np.ndarray, begin: np.ndarray, n: np.ndarray) -> None:
        m = out[rows]
        for k in range(int(n.max(initial=0))):
            live = n > k
            m[live] = _TO_FLAT[m[live] * 10 + cls[begin[live] + k][:, None]]
        out[rows] = m

    tail = np.minimum(lens, 24)
    every = np.arange(len(starts))
    read(every, starts + lens - tail, tail)
    rest = np.flatnonzero((out != out[:, :1]).any(axis=1) & (lens > 24))
    if len(rest):
        out[rest] = np.arange(12, dtype=np.uint8)
        read(rest, starts[rest], lens[rest])
    return out


def scan(maps: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Prefix scan by doubling: row i becomes the composition of the maps of its group up to i. ``group`` is sorted."""
    maps, n, d = maps.copy(), len(maps), 1
    most = int(np.bincount(group - group[0]).max()) if n else 0
    while d < most:
        i = np.arange(d, n)
        i = i[group[i] == group[i - d]]
        maps[i] = np.take_along_axis(maps[i], maps[i - d], axis=1)  # right side reads the maps before this round
        d *= 2
    return maps


def piece_starts(cls: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points at which pieces begin; ``offsets`` bound the texts."""
    n = len(cls)
    if n == 0:
        return np.zeros(0, np.int64)
    size = np.diff(offsets)
    per = -(-size // CHUNK)
    doc = np.repeat(np.arange(len(size)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    start = offsets[doc] + nth * CHUNK
    length = np.minimum(offsets[doc + 1] - start, CHUNK)
    maps = scan(chunk_maps(cls, start, length), doc)
    state = np.full(len(doc), START, np.uint8)
    later = np.flatnonzero(nth > 0)
    state[later] = maps[later - 1, START]
    marks = np.zeros(n + 1, np.uint8)
    order = np.argsort(-length, kind="stable")
    start, s, sorted_len = start[order], state[order].astype(np.intp), length[order]
    for k in range(int(sorted_len[0])):
        m = int(np.searchsorted(-sorted_len, -k, "left"))
        key = s[:m] * 10 + cls[start[:m] + k]
        marks[start[:m] + k] = _MARK_FLAT[key]
        s[:m] = _TO_FLAT[key]
    begin = (marks[:-1] & HERE).astype(bool)
    begin |= (marks[1:] & BEFORE).astype(bool)
    last = np.flatnonzero(np.append(doc[1:] != doc[:-1], True))
    final = maps[last, START]
    at = offsets[doc[last] + 1] - 1
    begin[at[(final == A_RV) | (final == A_L)]] = True
    begin[offsets[:-1][size > 0]] = True
    return np.flatnonzero(begin)


# ------------------------------------------------------------------ merger

def _byte_signs() -> list[str]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + more)
            more += 1
    return out


class Merger:
    """The transducer over a piece's bytes; states and transitions are added when first needed."""

    LONG = 192  # longer pieces are read one by one
    MOST = 1_500_000  # transitions kept before starting anew: a bound of a worker's memory

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        if spec["model"]["type"] != "BPE" or (spec.get("normalizer") is not None) or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError("only byte-level BPE without a normalizer can be compiled")
        back = {c: b for b, c in enumerate(_byte_signs())}
        self.special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of: dict[int, bytes] = {}
        self.kids: list[dict[int, int]] = [{}]
        self.tok, self.depth = [-1], [0]
        for t, i in spec["model"]["vocab"].items():
            if t.encode() in self.special or not all(c in back for c in t):
                continue
            b = bytes(back[c] for c in t)
            self.bytes_of[i] = b
            n = 0
            for x in b:
                m = self.kids[n].get(x)
                if m is None:
                    m = self.kids[n][x] = len(self.kids)
                    self.kids.append({})
                    self.tok.append(-1)
                    self.depth.append(self.depth[n] + 1)
                n = m
            self.tok[n] = i
        rank = {b: 0 for b in self.bytes_of.values() if len(b) == 1}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            rank.setdefault(bytes(back[c] for c in a + b), r + 1)
        if len(rank) < len(self.bytes_of):
            raise ValueError("tokens that no merge makes can't be compiled")
        self.token_len = np.zeros(max(self.bytes_of) + 1, np.int32)
        for i, b in self.bytes_of.items():
            self.token_len[i] = len(b)
        self._links()
        order = sorted(self.bytes_of, key=lambda i: rank[self.bytes_of[i]])
        pieces = tiktoken.Encoding("merges", pat_str=".", mergeable_ranks={self.bytes_of[i]: r for r, i in enumerate(order)}, special_tokens={})
        self.as_ids, self.one_piece = order, pieces._core_bpe.encode_single_piece
        self.open: dict[int, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reset()

    def _links(self) -> None:
        """Failure links, and the tokens that end at each node, longest first."""
        kids, n = self.kids, len(self.kids)
        self.fail, self.ends = [0] * n, [()] * n
        queue = list(kids[0].values())
        for m in queue:
            self.ends[m] = ((self.tok[m], 1),) if self.tok[m] >= 0 else ()
        for node in queue:
            for x, m in kids[node].items():
                f = self.fail[node]
                while f and x not in kids[f]:
                    f = self.fail[f]
                self.fail[m] = kids[f].get(x, 0)
                own = ((self.tok[m], self.depth[m]),) if self.tok[m] >= 0 else ()
                self.ends[m] = own + self.ends[self.fail[m]]
                queue.append(m)

    def reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.reps: list[tuple] = []
        self.memo: dict[int, tuple[int, int]] = {}  # for pieces that are read one by one
        self.last = np.full(1 << 12, -1, np.int32)
        self.bits = 14
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.next = np.zeros(1 << self.bits, np.int32)
        self.delta = np.zeros(1 << self.bits, np.int16)
        self.used = 0
        self._state((0, 512))

    def _valid(self, a: int, b: int) -> bool:
        """Whether the model leaves tokens a, b (a = -1: b alone) as they are."""
        got = self.pairs.get((a, b))
        if got is None:
            text = (self.bytes_of[a] if a >= 0 else b"") + self.bytes_of[b]
            ids = [self.as_ids[r] for r in self.one_piece(text)]
            got = self.pairs[a, b] = ids == ([a, b] if a >= 0 else [b])
        return got

    def _open(self, node: int) -> tuple[int, ...]:
        """Lengths of the suffixes read that some longer token begins with, 0 last."""
        got = self.open.get(node)
        if got is None:
            n, out = node, []
            while n:
                if self.kids[n]:
                    out.append(self.depth[n])
                n = self.fail[n]
            got = self.open[node] = (*out, 0)
        return got

    def _state(self, k: tuple[int, ...]) -> int:
        """Number of the state (node, then (last token + 1) * 1024 + (its count relative to now) + 512 for each open suffix)."""
        s = self.states.get(k)
        if s is None:
            s = self.states[k] = len(self.reps)
            self.reps.append(k)
            if s >= len(self.last):
                self.last = np.concatenate([self.last, np.full(len(self.last), -1, np.int32)])
            self.last[s] = (k[-1] >> 10) - 1  # that of suffix length 0: all that was read
        return s

    def step(self, key: int) -> tuple[int, int]:
        """Next state and change of the token count, for ``state * 256 + byte``."""
        (was, *window), x = self.reps[key >> 8], key & 255
        kids, fail, node = self.kids, self.fail, was
        while node and x not in kids[node]:
            node = fail[node]
        node = kids[node].get(x, 0)
        back = dict(zip(self._open(was), window))
        for t, n in self.ends[node]:
            at = back[n - 1]
            if self._valid((at >> 10) - 1, t):
                d = (at & 1023) - 511
                break
        else:
            raise AssertionError("the vocabulary lacks a byte")
        while node and not kids[node]:
            node = fail[node]
        new = self._state((node, *(back[n - 1] - d for n in self._open(node)[:-1]), (t + 1) * 1024 + 512))
        return new, d

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def _insert(self, keys: np.ndarray, to: np.ndarray, delta: np.ndarray) -> None:
        if (self.used + len(keys)) * 3 > len(self.keys):
            old = self.keys >= 0
            keys, to, delta = (np.concatenate(p) for p in ((self.keys[old], keys), (self.next[old], to), (self.delta[old], delta)))
            self.used = 0
            while len(keys) * 4 > 1 << self.bits:
                self.bits += 1
            self.keys = np.full(1 << self.bits, -1, np.int64)
            self.next, self.delta = np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.int16)
        self.used += len(keys)
        slot, todo, mask = self._slot(keys), np.arange(len(keys)), (1 << self.bits) - 1
        while len(todo):
            free = todo[self.keys[slot[todo]] < 0]
            self.keys[slot[free]] = keys[free]
            won = self.keys[slot[todo]] == keys[todo]
            self.next[slot[todo[won]]], self.delta[slot[todo[won]]] = to[todo[won]], delta[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & mask

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of ``keys``, compiling those that are new."""
        while True:
            slot, mask = self._slot(keys), (1 << self.bits) - 1
            seen = self.keys[slot]
            off = np.flatnonzero(seen != keys)
            miss = []
            while len(off):
                empty = seen[off] < 0
                miss.append(off[empty])
                off = off[~empty]
                slot[off] = (slot[off] + 1) & mask
                seen[off] = self.keys[slot[off]]
                off = off[seen[off] != keys[off]]
            bad = np.unique(keys[np.concatenate(miss)]) if miss else ()
            if not len(bad):
                return slot
            a = np.array([(k, *self.step(k)) for k in bad.tolist()], np.int64)
            self._insert(a[:, 0], a[:, 1], a[:, 2])

    def read(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, ids: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Tokens of each piece; with ``ids`` also, for each byte, the id of the token that ends there or -1."""
        if self.used > self.MOST:
            self.reset()
        lens = ends - starts
        count = np.zeros(len(starts), np.int64)
        last = np.full(len(buf), -1, np.int32) if ids else None
        short = np.flatnonzero(lens <= self.LONG)
        order = short[np.argsort((self.LONG - lens[short]).astype(np.uint16), kind="stable")]
        at = starts[order]
        alive = np.bincount(lens[order], minlength=self.LONG + 1)[::-1].cumsum()[::-1]
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order), np.int32)
        for k in range(self.LONG):
            n = int(alive[k + 1])
            if n == 0:
                break
            where = at[:n] + k
            slot = self._find((state[:n] << 8) | buf[where])
            state[:n] = self.next[slot]
            total[:n] += self.delta[slot]
            if ids:
                last[where] = self.last[state[:n]]
        count[order] = total
        for i in np.flatnonzero(lens > self.LONG).tolist():
            s = c = 0
            a = int(starts[i])
            if len(self.memo) > 200_000:
                self.memo.clear()
            for j, x in enumerate(buf[a : int(ends[i])].tolist()):
                key = s << 8 | x
                got = self.memo.get(key)
                if got is None:
                    got = self.memo[key] = self.step(key)
                s = got[0]
                c += got[1]
                if ids:
                    last[a + j] = self.last[s]
            count[i] = c
        if not ids:
            return count, None
        end = np.zeros(len(buf), bool)
        cur, low = ends[lens > 0] - 1, starts[lens > 0]
        while len(cur):
            end[cur] = True
            cur = cur - self.token_len[last[cur]]
            on = cur >= low
            cur, low = cur[on], low[on]
        return count, np.where(end, last, -1)


def merger(path: str) -> Merger:
    return held(("merger", path), lambda: Merger(path))


@lru_cache(maxsize=2)
def _classes(zipped: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(zipped), np.uint8)


def _block(m: Merger, classes: np.ndarray, buf: np.ndarray, offsets: np.ndarray, ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
    cp, at = _code_points(buf)
    cls = classes[cp]
    where = offsets if at is None else np.searchsorted(at, offsets)
    begin = piece_starts(cls, where)
    starts = begin if at is None else at[begin]
    ends = np.append(starts[1:], len(buf))
    count, last = m.read(buf, starts, ends, ids)
    sums = np.concatenate([[0], np.cumsum(count)])
    return np.diff(sums[np.searchsorted(starts, offsets)]), None if last is None else last[last >= 0]


def encode(path: str, classes: bytes, buf: np.ndarray, offsets: np.ndarray, ids: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Tokens of each text, and with ``ids`` all texts' ids in one array; strings of special tokens count as these."""
    m, table = merger(path), _classes(classes)
    whole = buf.tobytes()
    if any(s in whole for s in m.special):
        return _with_specials(m, path, classes, whole, offsets, ids)
    counts, parts = [], []
    for i, j in blocks(offsets, 2 << 20):
        a, b = int(offsets[i]), int(offsets[j])
        for lo, hi, rel in _spans(table, buf, a, b, offsets[i : j + 1]):
            n, got = _block(m, table, buf[lo:hi], rel, ids)
            counts.append((i, j, n))
            if ids:
                parts.append(got)
    out = np.zeros(len(offsets) - 1, np.int64)
    for i, j, n in counts:
        out[i:j] += n
    return out, (np.concatenate(parts) if parts else np.zeros(0, np.int32)) if ids else None


def _spans(table: np.ndarray, buf: np.ndarray, a: int, b: int, offsets: np.ndarray, most: int = 4 << 20):
    """One span, or, for a single text that is longer than ``most``, several that are cut before a space after an ASCII letter: there a piece begins, whatever came before."""
    if b - a <= most or len(offsets) > 2:
        yield a, b, offsets - a
        return
    lo = a
    while lo < b:
        hi = min(lo + most // 2, b)
        while hi < b:
            part = buf[hi : hi + 65536]
            ok = np.flatnonzero((part[1:] == 32) & (part[:-1] < 128) & (table[part[:-1]] <= LL))
            if len(ok):
                hi += int(ok[0]) + 1
                break
            hi = min(hi + 65535, b) if len(part) > 1 else b
        yield lo, hi, np.array([0, hi - lo], np.int64)
        lo = hi


def _with_specials(m: Merger, path: str, classes: bytes, whole: bytes, offsets: np.ndarray, ids: bool):
    cut = regex.compile(b"(" + b"|".join(regex.escape(s) for s in sorted(m.special, key=len, reverse=True)) + b")")
    pieces: list[bytes] = []
    plan: list[list[int]] = []  # of each text: indexes of pieces (even places), special ids (odd places)
    for i in range(len(offsets) - 1):
        row = []
        for k, part in enumerate(cut.split(whole[offsets[i] : offsets[i + 1]])):
            row.append(len(pieces) if k % 2 == 0 else m.special[part])
            if k % 2 == 0:
                pieces.append(part)
        plan.append(row)
    joined = np.frombuffer(b"".join(pieces), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
    clean = np.zeros(len(pieces), np.int64)
    got_ids = []
    # the joined pieces may hold a special string across a border, so blocks are read without looking for them
    for i, j in blocks(offs, 2 << 20):
        n, got = _block(m, _classes(classes), joined[offs[i] : offs[j]], offs[i : j + 1] - offs[i], ids)
        clean[i:j] = n
        if ids:
            got_ids.append(got)
    counts = np.array([sum(int(clean[x]) if k % 2 == 0 else 1 for k, x in enumerate(row)) for row in plan], np.int64)
    if not ids:
        return counts, None
    flat_ids = np.concatenate(got_ids) if got_ids else np.zeros(0, np.int32)
    at = np.concatenate([[0], np.cumsum(clean)])
    out = [flat_ids[at[x] : at[x + 1]] if k % 2 == 0 else np.array([x], np.int32) for row in plan for k, x in enumerate(row)]
    return counts, np.concatenate(out) if out else np.zeros(0, np.int32)
