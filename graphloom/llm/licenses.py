"""Operator 8: license scans by MinHash bands over text windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U64, batch, blocks, flat, map_batches, mix
from .words import Sieve, word_hashes

#: Short public notices and the opening clauses of common licenses.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "mit-notice": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense-text": "This is free and unencumbered software released into the public domain.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
}
#: Two rows a band, eight bands: a window of similarity 0.7 is retrieved with probability 1 - (1 - 0.49)**8 = 0.995.
BANDS, ROWS = 8, 2
_A = np.random.default_rng(4).integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = np.random.default_rng(5).integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32)
_SCHEMA = [("doc_id", pa.int64()), ("license", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("containment", pa.float64())]


def shingles(words: np.ndarray) -> np.ndarray:
    """Pairs of neighbouring words as hashes."""
    return mix(words[:-1] * U64(0x9E3779B97F4A7C15) + words[1:]) if len(words) > 1 else np.zeros(0, U64)


def _permute(h: np.ndarray, k: int) -> np.ndarray:
    x = (h ^ (h >> U64(32))).astype(np.uint32)
    x = (x ^ (x >> np.uint32(15))) * _A[k] + _B[k]
    return x ^ (x >> np.uint32(13))


def _band(rows: list[np.ndarray], band: int) -> np.ndarray:
    h = np.full(len(rows[0]), band + 1, U64)
    for r in rows:
        h = (h ^ r) * U64(0xC4CEB9FE1A85EC53)
        h ^= h >> U64(29)
    return mix(h)


class Scanner:
    """Templates by size: for each number of shingles, windows of that size are looked up by their bands."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.sets, self.words, by_size = [], [], {}
        for t, name in enumerate(self.names):
            b = templates[name].encode()
            w, _ = word_hashes(np.frombuffer(b, np.uint8), np.array([0, len(b)]))
            s = shingles(w)
            if not len(s):
                raise ValueError(f"template {name} needs two words")
            if len(s) > 200:
                raise ValueError(f"template {name} is longer than 200 words; give its opening")
            self.sets.append(np.unique(s))
            self.words.append(len(w))
            by_size.setdefault(len(s), []).append((t, s))
        self.sizes = {}
        for m, own in by_size.items():
            low = [np.array([_permute(s, k).min() for _, s in own]) for k in range(BANDS * ROWS)]
            bands = []
            for b in range(BANDS):
                h = _band(low[b * ROWS : (b + 1) * ROWS], b)
                order = np.argsort(h, kind="stable")
                sieve = Sieve(h)
                bands.append((sieve, np.searchsorted(h[order], sieve.keys, "left"), np.searchsorted(h[order], sieve.keys, "right"), np.array([own[i][0] for i in order])))
            self.sizes[m] = bands

    def candidates(self, s: np.ndarray) -> np.ndarray:
        """(first shingle, template) of windows that share a band with a template."""
        if not len(s):
            return np.zeros((0, 2), np.int64)
        found = []
        for b in range(BANDS):
            powers = []
            for k in range(b * ROWS, (b + 1) * ROWS):
                level, width = [_permute(s, k)], 1
                while width * 2 <= max(self.sizes) and len(level[-1]) > width:
                    level.append(np.minimum(level[-1][:-width], level[-1][width:]))
                    width *= 2
                powers.append(level)
            for m, bands in self.sizes.items():
                p = m.bit_length() - 1
                if len(s) < m:
                    continue
                step = max(1, m // 8)
                n = len(s) - m + 1
                rows = []
                for level in powers:
                    a = level[p]
                    low = np.minimum(a[:n], a[m - (1 << p) : m - (1 << p) + n])
                    rows.append(low[::step])
                sieve, lo, hi, own = bands[b]
                at, k = sieve.find(_band(rows, b))
                for i in range(int((hi - lo).max(initial=0))):
                    on = lo[k] + i < hi[k]
                    found.append(np.stack([at[on] * step, own[lo[k[on]] + i]], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def scan(self, words: np.ndarray, upto: np.ndarray, least: float) -> list[tuple[int, int, int, int, float]]:
        """(text, template, first word, last word, containment), one per place of a template."""
        s = shingles(words)
        out = []
        cand = self.candidates(s)
        cand = cand[np.lexsort((cand[:, 0], cand[:, 1]))]
        best: tuple | None = None
        for at, t in cand.tolist():
            m = self.words[t] - 1
            d = int(np.searchsorted(upto, at, "right")) - 1
            slack = max(1, m // 4)
            lo, hi = max(int(upto[d]), at - slack), min(int(upto[d + 1]) - 1, at + m + slack)
            if hi <= lo:
                continue
            inside = np.isin(s[lo:hi], self.sets[t])
            share = len(np.unique(s[lo:hi][inside])) / len(self.sets[t])
            if share < least:
                continue
            hit = np.flatnonzero(inside)
            row = (d, t, lo + int(hit[0]), lo + int(hit[-1]) + 1, share)
            if best is not None and best[:2] == row[:2] and row[2] <= best[3]:
                best = max(best, row, key=lambda r: (r[4], -r[2]))
                continue
            if best is not None:
                out.append(best)
            best = row
        if best is not None:
            out.append(best)
        # where templates overlap, one that is contained less than another there isn't what the text has
        out.sort(key=lambda r: (r[0], r[2]))
        kept = []
        for i, r in enumerate(out):
            near = [o for step in (range(i - 1, -1, -1), range(i + 1, len(out))) for o in self._overlapping(out, r, step)]
            if all(o[4] <= r[4] for o in near):
                kept.append(r)
        return [(d, t, a - int(upto[d]), e - int(upto[d]), c) for d, t, a, e, c in kept]

    @staticmethod
    def _overlapping(rows: list, r: tuple, places: range):
        reach = 256  # words; no template is longer
        for j in places:
            o = rows[j]
            if o[0] != r[0] or abs(o[2] - r[2]) > reach:
                return
            if o[2] <= r[3] and r[2] <= o[3]:
                yield o


_scanners: dict[tuple, Scanner] = {}


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row per place where a text holds a template: (doc_id, license, start_word, end_word, containment).

    Words are compared without case and punctuation; a shingle is two neighbouring words. For each template size windows
    of that many shingles overlap by at least 7/8 and are looked up by MinHash bands; around a candidate the exact share
    of the template's shingles is taken, and counts from ``least`` on. Of overlapping templates those that others there surpass
    in this share are left out. Templates are a parameter of bounded size. Null
    and empty texts hold none; repeated rows are reported each; an empty table gives none. No shuffle.
    """
    templates = dict(templates or TEMPLATES)
    key = tuple(sorted(templates.items()))

    def scan(b: pa.RecordBatch) -> pa.RecordBatch | None:
        if key not in _scanners:
            _scanners[key] = Scanner(templates)
        scanner = _scanners[key]
        buf, offsets = flat(b.column(1))
        out = []
        for i, j in blocks(offsets, 1 << 20):
            words, upto = word_hashes(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            out += [(i + d, scanner.names[t], s, e, c) for d, t, s, e, c in scanner.scan(words, upto, least)]
        if not out:
            return None
        d, name, s, e, c = zip(*out)
        return batch(_SCHEMA, b.column(0).take(pa.array(d)), list(name), list(s), list(e), list(c))

    return map_batches(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), scan, "doc_id long, license string, start_word long, end_word long, containment double")
