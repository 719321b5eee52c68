"""Words of flat text as 64-bit hashes."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

from .common import LOWER, runs, span_hash

#: Parts of words: ASCII letters and digits, and what is beyond ASCII unless ``_kinds`` says otherwise.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Scripts written without spaces: Thai to Tibetan, Burmese, Khmer, Tai, Balinese, Javanese, Han, Kana, Bopomofo, Yi.
ALONE = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x30FF), (0x3100, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xA980, 0xA9DF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF))


@cache
def _kinds() -> np.ndarray:
    """By code point: 0 part of a word, 1 punctuation, white space, control or format sign but a joiner, 2 a word by itself."""
    kind = np.zeros(0x110000, np.uint8)
    for a, b in ALONE:
        kind[a : b + 1] = 2
    for c in range(0x80, 0xE0080):
        if unicodedata.category(chr(c)) in ("Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po", "Zs", "Zl", "Zp", "Cc", "Cf") and c not in (0x200C, 0x200D):
            kind[c] = 1
    return kind


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, whether it is a character of a script without spaces, and the number of words before each text."""
    mask = WORD[buf]
    lead = np.flatnonzero(buf >= 0xC2)
    alone = np.zeros(0, np.int64)
    if len(lead):
        first = buf[lead].astype(np.int64)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        at = lambda k: buf[np.minimum(lead + k, len(buf) - 1)].astype(np.int64) & 0x3F
        code = (first & 0x1F) << 6 | at(1)
        long = np.flatnonzero(size > 2)
        if len(long):
            second, third, fourth = at(1)[long], at(2)[long], at(3)[long]
            three = (first[long] & 0x0F) << 12 | second << 6 | third
            code[long] = np.where(size[long] == 3, three, (first[long] & 0x07) << 18 | second << 12 | third << 6 | fourth)
        kind = _kinds()[np.minimum(code, 0x10FFFF)]
        for k in range(4):
            on = (kind == 1) & (size > k)
            mask[np.minimum(lead[on] + k, len(buf) - 1)] = False
        alone, size = lead[kind == 2], size[kind == 2]
    if not len(alone):
        s, e, upto = runs(mask, offsets)
        return s, e, np.zeros(len(s), bool), upto
    s, e, _ = runs(mask, np.unique(np.concatenate([offsets, alone, np.minimum(alone + size, len(buf))])))
    single = np.zeros(len(buf), bool)
    single[alone] = True
    return s, e, single[s], np.searchsorted(s, offsets)


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and the number of words before each text."""
    s, e, _, upto = word_spans(buf, offsets)
    return span_hash(LOWER[buf], s, e), upto


class Sieve:
    """Says of many hashes quickly which may be in a set: one bit per slot, then the exact search."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.bits = int(min(22, max(10, np.ceil(np.log2(max(len(self.keys), 1) * 32)))))
        self.on = np.zeros(1 << self.bits, bool)
        self.on[(self.keys >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``h`` that are in the set, and their number in ``keys``."""
        if not len(self.keys):
            z = np.zeros(0, np.int64)
            return z, z
        at = np.flatnonzero(self.on[(h >> np.uint64(64 - self.bits)).view(np.int64)])
        k = np.searchsorted(self.keys, h[at])
        ok = k < len(self.keys)
        at, k = at[ok], k[ok]
        ok = self.keys[k] == h[at]
        return at[ok], k[ok]
