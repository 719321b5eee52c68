"""The corpus operators against brute force on small fixtures."""

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from tokenizers import Tokenizer

from graphloom.llm import ann, decontamination, licenses, line_dedup, lm_scoring, ngrams, packing, quality, sharding, simhash, token_counts, transducer
from graphloom.llm.common import flat, span_hash, xxh64
from graphloom.llm.words import word_hashes, word_spans

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(VOCABULARY)

ODD = [None, "", " ", "\n\n", "a", "I'll say 'tis we've 're  \t x\n\n y", "é" * 300, "x" * 3000, " " * 900 + "end", "a<|endoftext|>b <|endoftext|>", "中文字 ½ ² 🙂🙂", "the same text\nline two", "the same text\nline two", "'" * 300 + "s", "word " * 4000]


def docs_of(spark, texts, lang="en"):
    rows = [(i, t, lang, "s", len(t or ""), "clash", -i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, shard long")


def ids_of(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


def random_text(rnd, n):
    sign = list("abestmdrvl'' \n\t .,!09Éßñ中🙂½ ") + ["'re", "'ll", "  ", "<|endoftext|>"]
    return "".join(rnd.choice(sign) for _ in range(n))


# ------------------------------------------------------------------ 1

def test_transducer_gives_the_librarys_ids():
    rnd = random.Random(1)
    texts = [t or "" for t in ODD] + [random_text(rnd, rnd.randint(0, 80)) for _ in range(4000)] + ["".join(rnd.choice("ab' \n'lre") for _ in range(3000)) for _ in range(5)]
    buf, offsets = flat(pa.array(texts))
    classes = transducer.char_classes()
    n, ids = transducer.encode(VOCABULARY, classes, buf, offsets, ids=True)
    at = np.concatenate([[0], np.cumsum(n)])
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == ids_of(t), t
    assert (transducer.encode(VOCABULARY, classes, buf, offsets)[0] == n).all()


def test_long_texts_are_cut_at_safe_places(monkeypatch):
    rnd = random.Random(2)
    text = " ".join("".join(rnd.choice("abcdefé") for _ in range(rnd.randint(1, 9))) for _ in range(30_000))
    buf, offsets = flat(pa.array([text]))
    classes = transducer.char_classes()
    whole = transducer._spans
    monkeypatch.setattr(transducer, "_spans", lambda *a, **k: whole(*a, most=20_000))
    n, ids = transducer.encode(VOCABULARY, classes, buf, offsets, ids=True)
    assert ids.tolist() == ids_of(text)


def test_prefix_scan_composes_maps():
    rnd = np.random.default_rng(0)
    maps = rnd.integers(0, 12, (50, 12)).astype(np.uint8)
    group = np.sort(rnd.integers(0, 4, 50))
    got = transducer.scan(maps, group)
    for i in range(50):
        want = np.arange(12)
        for j in range(i + 1):
            if group[j] == group[i]:
                want = maps[j][want]
        assert (got[i] == want).all()


def test_merger_starts_anew_when_full(monkeypatch):
    monkeypatch.setattr(transducer.Merger, "MOST", 50)
    texts = ["several different words are read", "and others follow them", "again"] * 3
    m = transducer.Merger(VOCABULARY)
    for t in texts:
        b = np.frombuffer(t.replace(" ", "").encode(), np.uint8)
        n, _ = m.read(b, np.array([0]), np.array([len(b)]))
        assert n[0] == len(ids_of(t.replace(" ", "")))


def test_token_counts(spark):
    got = {r["doc_id"]: r for r in token_counts.token_counts(docs_of(spark, ODD), VOCABULARY).collect()}
    assert len(got) == len(ODD)
    for i, t in enumerate(ODD):
        n = len(ids_of(t))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 1024)


def test_empty_tables(spark):
    none = docs_of(spark, ["x"]).where("false")
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert token_counts.token_counts(none, VOCABULARY).count() == 0
    assert packing.pack_documents(none, VOCABULARY).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert quality.classify(none, labels).count() == 0
    assert decontamination.contaminated(none, items).count() == 0
    assert decontamination.contaminated(docs_of(spark, ODD), items).count() == 0
    assert licenses.scan_licenses(none).count() == 0
    assert lm_scoring.cross_entropy_difference(none, labels).count() == 0
    assert sharding.shard_documents(none).count() == 0
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# ------------------------------------------------------------------ 2 and 5

def brute_kneser_ney(texts, order, vocab):
    """Straight from the formulas, over tuples of character numbers."""
    number = {c: i + 2 for i, c in enumerate(vocab)}
    counts = [None] * (order + 1)
    counts[order] = Counter()
    for t in texts:
        s = [0] * (order - 1) + [number.get(ord(c), 1) for c in t] + [0]
        for i in range(order - 1, len(s)):
            counts[order][tuple(s[i - order + 1 : i + 1])] += 1
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discount = {}
    for n in range(1, order + 1):
        t = [sum(1 for c in counts[n].values() if c == k) for k in (1, 2, 3, 4)]
        y = t[0] / (t[0] + 2 * t[1]) if t[0] + t[1] else 0.5
        discount[n] = [min(max(k - (k + 1) * y * t[k] / t[k - 1], 0.05), k - 0.05) if t[k - 1] else 0.5 for k in (1, 2, 3)]
    total, left = defaultdict(int), defaultdict(float)
    for n in range(1, order + 1):
        for g, c in counts[n].items():
            total[n, g[:-1]] += c
            left[n, g[:-1]] += discount[n][min(c, 3) - 1]
    size = len(vocab) + 2

    def p(g):
        n = len(g)
        below = 1 / size if n == 1 else p(g[1:])
        if (n, g[:-1]) not in total:
            return below
        c = counts[n].get(g, 0)
        own = (c - discount[n][min(c, 3) - 1]) if c else 0.0
        return (own + left[n, g[:-1]] * below) / total[n, g[:-1]]

    def loss(t):
        return sum(signs(t)) / (len(t) + 1)

    def signs(t):
        s = [0] * (order - 1) + [number.get(ord(c), 1) for c in t] + [0]
        return [-math.log(p(tuple(s[i - order + 1 : i + 1]))) for i in range(order - 1, len(s))]

    loss.signs = signs
    return loss


TEXTS = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "", "zzz qqq", "the cat sat on the mat", "éàü the"]


@pytest.mark.parametrize("order", [2, 4])
def test_kneser_ney_follows_the_formulas(spark, order):
    docs = docs_of(spark, TEXTS)
    vocab = ngrams.vocabulary(ngrams.char_counts(docs), 2)
    rows = ngrams.kneser_ney(ngrams.gram_counts(docs, vocab, order), order, len(vocab) + 2).toArrow()
    model = ngrams.Model(*(rows.column(c).to_numpy() for c in ("n", "key", "p", "g")), order, len(vocab) + 2)
    loss = brute_kneser_ney(TEXTS, order, vocab.tolist())
    test = [*TEXTS, "unseen ☃ text", "x"]
    buf, offsets = flat(pa.array(test))
    got, n = ngrams.mean_loss(model, ngrams.numbers(vocab), buf, offsets)
    assert n.tolist() == [len(t) for t in test]
    assert np.allclose(got, [loss(t) for t in test], rtol=1e-4)


def test_cross_entropy_difference(spark):
    texts = [*TEXTS, None]
    target = spark.createDataFrame([(0,), (1,), (None,)], "doc_id long")
    got = {r["doc_id"]: r for r in lm_scoring.cross_entropy_difference(docs_of(spark, texts), target, order=3).collect()}
    count = Counter(c for t in TEXTS for c in t)
    vocab = [ord(c) for c, n in sorted(count.items(), key=lambda x: (-x[1], ord(x[0]))) if n >= 2]
    back, aim = brute_kneser_ney([*TEXTS, ""], 3, vocab), brute_kneser_ney(TEXTS[:2], 3, vocab)
    for i, t in enumerate(texts):
        assert got[i]["n_tokens"] == len(t or "")
        assert got[i]["ce_background"] == pytest.approx(back(t or ""), rel=1e-4)
        assert got[i]["ce_target"] == pytest.approx(aim(t or ""), rel=1e-4)
        assert got[i]["ce_diff"] == pytest.approx(got[i]["ce_target"] - got[i]["ce_background"])


def test_scores_without_target_rows(spark):
    got = lm_scoring.cross_entropy_difference(docs_of(spark, TEXTS), spark.createDataFrame([], "doc_id long"), order=3).collect()
    assert len(got) == len(TEXTS) and all(math.isfinite(r["ce_target"]) for r in got)


def test_models_of_any_size_are_no_memory_of_a_worker(tmp_path):
    """Both models of 600,000 rows, in several files, are scored as when held; arrays of the worker's own stay small meanwhile (held, they take 30 MB)."""
    rnd = np.random.default_rng(5)
    rows, order = 600_000, 4
    key = np.unique(rnd.integers(0, 1 << 48, rows + 9))[:rows]
    n, is_p = rnd.integers(1, order + 1, rows).astype(np.int32), rnd.random(rows) < 0.7
    key &= (1 << (12 * n.astype(np.int64))) - 1
    first = np.unique(key | (n.astype(np.int64) << 50), return_index=True)[1]
    p, g = np.where(is_p, rnd.random(rows), np.nan), np.where(is_p, np.nan, rnd.random(rows))
    for k, at in enumerate(np.array_split(first, 3)):
        cols = (n[at], key[at], *(pa.array(x[at], from_pandas=True) for x in (p, g)))
        pq.write_table(pa.table(dict(zip(("n", "key", "p", "g"), cols))), tmp_path / f"part-{k}.parquet")
    (tmp_path / "_SUCCESS").touch()
    path = f"file://{tmp_path}"
    want = ngrams.read_model(path, order, 4096)
    tracemalloc.start()
    one, other = lm_scoring._pair((path, path), order, 4096)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 2 << 20 and peak < 12 << 20
    asked = np.concatenate([key[(n == order) & is_p][:5000], key[n < order][:5000], rnd.integers(0, 1 << 48, 5000)])
    assert (one.score(asked) == want.score(asked)).all() and (other.score(asked) == want.score(asked)).all()


def test_texts_are_scored_by_small_blocks(spark):
    docs = docs_of(spark, TEXTS)
    vocab = ngrams.vocabulary(ngrams.char_counts(docs), 2)
    rows = ngrams.kneser_ney(ngrams.gram_counts(docs, vocab, 4), 4, len(vocab) + 2).toArrow()
    model = ngrams.Model(*(rows.column(c).to_numpy() for c in ("n", "key", "p", "g")), 4, len(vocab) + 2)
    texts = [TEXTS[i % len(TEXTS)] * (150 + i % 7) for i in range(1000)]
    table, (buf, offsets) = ngrams.numbers(vocab), flat(pa.array(texts))
    tracemalloc.start()
    got, n = ngrams.mean_loss(model, table, buf, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(buf) > 1 << 20 and peak < 24 << 20
    for i in range(0, 1000, 97):
        alone, m = ngrams.mean_loss(model, table, *flat(pa.array([texts[i]])))
        assert (got[i], n[i]) == (pytest.approx(alone[0]), m[0])


def test_counts_are_the_same_by_small_pieces(spark):
    docs = docs_of(spark, [random_text(random.Random(i), 200) for i in range(300)]).selectExpr("text", "doc_id % 3 = 0 as hit")
    vocab = ngrams.vocabulary(ngrams.char_counts(docs), 2)
    assert (ngrams.vocabulary(ngrams.char_counts(docs, block=100), 2) == vocab).all()
    whole, pieces = ({tuple(r) for r in ngrams.gram_counts(docs, vocab, 4, ["hit"], **more).collect()} for more in ({}, {"block": 500, "most": 2000}))
    assert whole == pieces and len(whole) > 2000


def test_quality_on_held_out_documents(spark):
    """Trained on labels of even ids, tested on odd ids; toxic documents of good quality apart from clean ones. (Of the few toxic ones of a smaller table too little can be learnt.)"""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.classify(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    share = lambda q, t, lang=None: (lambda x: sum(x) / len(x))([r["keep"] for r in judged if (r["quality"], r["toxic"]) == (q, t) and lang in (None, r["lang"])])
    assert share(1, 0) > 0.97
    assert share(0, 0) < 0.2
    assert share(1, 1, "en") < 0.2


def test_quality_by_words_against_brute_force(spark):
    """The measures of words, from per-sign losses of both models."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice(("la", "mo", "ti", "re", "su")) for _ in range(rnd.randint(1, 4)))
    clean = [" ".join(word() for _ in range(rnd.randint(5, 60))) for _ in range(60)]
    toxic = [" ".join("zonk" if rnd.random() < 0.2 else word() for _ in range(40)) for _ in range(12)]
    odd = ["", "x", "  two  spaces \n\n and lines\n", "長" * 60 + " end", "zonk " * 30]
    texts = [*clean, *toxic, *odd]
    labels = spark.createDataFrame([(i, 1, int(i >= 60)) for i in range(72)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(docs_of(spark, texts), labels).collect()}
    order = sorted(range(60), key=lambda i: (lambda h: h - (h >> 63 << 64))(xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 42)))
    train, rest = [texts[i] for i in order[::2]], order[1::2]
    count = Counter(c for t in train for c in t)
    vocab = [ord(c) for c, n in sorted(count.items(), key=lambda x: (-x[1], ord(x[0]))) if n >= 2]
    a, b = (brute_kneser_ney(x, 5, vocab).signs for x in (train, toxic))

    def measures(t):
        own, other, signs = a(t), b(t), [*t, " "]
        parts, start = [], 0
        for i, c in enumerate(signs):
            end = i == len(t) or (c in " \t\n\v\f\r" and ord(c) in vocab)
            if end or i + 1 - start == ngrams.WINDOW:
                if not (end and i == start and (i == 0 or signs[i - 1] in " \t\n\v\f\r" and ord(signs[i - 1]) in vocab)):
                    parts.append((sum(own[start : i + 1]) / (i + 1 - start), sum(own[start : i + 1]) - sum(other[start : i + 1])))
                start = i + 1
        top = lambda k, share: sum(sorted((p[k] for p in parts), reverse=True)[: max(1, math.ceil(share * len(parts)))]) / max(1, math.ceil(share * len(parts)))
        return (top(0, 0.01), top(1, 0.03)) if parts else (None, None)

    want = [measures(t) for t in texts]
    for i, t in enumerate(texts):
        if t:
            assert got[i]["worst"] == pytest.approx(want[i][0], rel=1e-3, abs=1e-3), t
            assert got[i]["alike"] == pytest.approx(want[i][1], rel=1e-3, abs=2e-3), t
    limit = []
    for k in (0, 1):
        own = [want[i][k] for i in rest]
        q = np.quantile(own, 0.995)
        limit.append(q + 0.35 * (1 + 20 / len(own)) * (q - np.median(own)))
    for i, t in enumerate(texts):
        ok = bool(t) and got[i]["perplexity"] <= got[i]["threshold"] and want[i][0] <= limit[0] and want[i][1] <= limit[1]
        assert got[i]["keep"] == ok, t
    assert not any(got[i]["keep"] for i in range(60, 72)) and sum(got[i]["keep"] for i in range(60)) >= 57


def test_quality_sample_of_a_hot_language(spark):
    rows = spark.range(5000).selectExpr("id as doc_id", "if(id % 10 = 0, 'fr', 'en') as lang")
    got = quality._first(rows, 40).collect()
    h = lambda i: (lambda x: x - (x >> 63 << 64))(xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 42))
    for lang in ("fr", "en"):
        want = sorted((i for i in range(5000) if (i % 10 == 0) == (lang == "fr")), key=h)[:40]
        assert [r["doc_id"] for r in sorted((r for r in got if r["lang"] == lang), key=lambda r: r["k"])] == want


def test_quality_counts_every_labelled_document(spark):
    """Over 3,000 trusted and 500 toxic documents of a language, and over 500 languages; the late ones have words and signs of their own."""
    h = lambda i: (lambda x: x - (x >> 63 << 64))(xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 42))
    rnd = random.Random(6)
    say = lambda *words: " ".join(rnd.choice(words) for _ in range(4))
    good, bad = sorted(range(3200), key=h), sorted(range(4000, 4600), key=h)
    rows = [(i, "en", say("la", "mo", "ti") if k < 3000 else say("zebu", "gnu")) for k, i in enumerate(good)]
    rows += [(i, "en", say("zonk", "ti") if k < 500 else say("blarg", "mo")) for k, i in enumerate(bad)]
    rows += [(5000 + k, f"l{k:03}", "la mo" if k < 490 else "жжж эээ") for k in range(505)]
    asked = ["la mo ti", "zebu", "blarg", "жжж", "zonk"]
    rows += [(6000 + k, "en", t) for k, t in enumerate(asked)]
    labels = spark.createDataFrame([(i, 1, int(4000 <= i < 5000)) for i, _, _ in rows if i < 6000], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(spark.createDataFrame(rows, "doc_id long, lang string, text string"), labels).collect()}
    text = {i: t for i, _, t in rows}
    train, held = [text[i] for i in (*good[::2], *range(5000, 5505))], [text[i] for i in good[1::2]]
    count = Counter(c for t in train for c in t)
    vocab = [ord(c) for c, n in sorted(count.items(), key=lambda x: (-x[1], ord(x[0]))) if n >= 2]
    a, b = brute_kneser_ney(train, 5, vocab), brute_kneser_ney([text[i] for i in bad], 5, vocab)
    for k, t in enumerate(asked):
        assert math.log(got[6000 + k]["perplexity"]) == pytest.approx(a(t), rel=1e-3), t
        if " " not in t:
            assert got[6000 + k]["alike"] == pytest.approx(sum(a.signs(t)) - sum(b.signs(t)), rel=1e-3, abs=2e-3), t
    assert math.log(got[6000]["threshold"]) == pytest.approx(np.quantile([a(t) for t in held], 0.995) + math.log(1.05), rel=1e-3)


@pytest.mark.parametrize("n", [1, 2, 7, 400])
def test_quality_thresholds_are_exact_quantiles(spark, n):
    rnd = random.Random(n)
    rows = [(lang, *(rnd.choice((rnd.random() * 9 - 3, 0.25)) for _ in range(2)), None if lang == "de" else rnd.random()) for lang in ("en", "de", "") for _ in range(n)]
    got = {(r["lang"], r["measure"]): r for r in quality._quantiles(spark.createDataFrame(rows, "lang string, loss double, worst double, alike double"), 0.995).collect()}
    want = {(lang, m): [r[1 + k] for r in rows if r[0] == lang] for k, m in enumerate(quality.MEASURES) for lang in ("en", "de", "") if (lang, m) != ("de", "alike")}
    want["", "every"] = [r[1] for r in rows]
    assert got.keys() == want.keys()
    for key, values in want.items():
        assert got[key]["n"] == len(values)
        assert (got[key]["high"], got[key]["middle"]) == pytest.approx((np.quantile(values, 0.995), np.median(values)))


def test_quality_of_odd_rows(spark):
    texts = [None, "", *["the usual words of the usual text " * 3] * 60, "###$$$%%%" * 20]
    docs = docs_of(spark, texts, lang=None)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(2, 60)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == len(texts)
    assert not got[0]["keep"] and got[0]["perplexity"] is None and not got[1]["keep"]
    assert got[5]["keep"] and got[61]["keep"] and not got[len(texts) - 1]["keep"]
    unlabelled = quality.classify(docs, labels.where("false")).collect()
    assert sum(r["keep"] for r in unlabelled) == len(texts) - 2


# ------------------------------------------------------------------ 3

def brute_nearest(rows, k=20, every=20):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = set()
    for i, q in good:
        if i % every == 0:
            near = sorted((-float(np.add.accumulate(v * q)[-1]), j) for j, v in good if j != i)[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(near)}
    return out


def test_neighbours_of_odd_vectors(spark):
    rnd = np.random.default_rng(0)
    rows = [(i, rnd.standard_normal(24).astype(np.float32).tolist()) for i in range(150)]
    rows[20] = (20, None)
    rows[40] = (40, [0.0] * 24)
    rows[41] = (41, [float("nan")] + [1.0] * 23)
    rows[42] = (42, [None] + [1.0] * 23)
    rows[43] = (43, [float("inf")] + [1.0] * 23)
    for i in range(100, 110):
        rows[i] = (i, rows[99][1])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {tuple(r) for r in ann.nearest(df, 20, 20).collect()} == brute_nearest(rows)
    few = df.where("vec_id < 5")
    assert {tuple(r) for r in ann.nearest(few, 20, 20).collect()} == brute_nearest(rows[:5])


def test_neighbours_recall_and_split_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_ROWS", 20)
    monkeypatch.setattr(ann, "LIST_QUERIES", 15)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = {(q, v) for q, _, v, _ in brute_nearest(rows)}
    got = {(r["query_id"], r["vec_id"]) for r in ann.nearest(df, rows_per_list=32).collect()}
    assert len(got & want) / len(want) > 0.9


# ------------------------------------------------------------------ 4

def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    sh = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    n = [0] * 64
    for s in sh:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            n[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * n[b] > len(sh))


def brute_components(prints):
    n = len(prints)
    near = [[j for j in range(n) if j != i and bin(prints[i] ^ prints[j]).count("1") <= 3] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        new = [min([root[i], *(root[j] for j in near[i])]) for i in range(n)]
        if new == root:
            break
        root = new
    return [len(x) for x in near], root


def test_near_duplicates(spark):
    rnd = random.Random(3)
    words = ["w%d" % i for i in range(60)] + ["Äpfel", "THE", "of"]
    base = [" ".join(rnd.choice(words) for _ in range(120)) for _ in range(12)]
    texts = list(ODD)
    for b in base:
        for _ in range(5):
            w = b.split()
            for _ in range(rnd.randint(0, 2)):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            texts.append((" " if rnd.random() < 0.5 else "\n").join(w))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    prints = [brute_fingerprint(t) for t in texts]
    near, root = brute_components(prints)
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got[i]["fingerprint"], got[i]["n_near"], got[i]["component_id"]) == (f"{prints[i]:016x}", near[i], root[i])


def test_gray_index_finds_all():
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 1 << 63, 300, dtype=np.uint64) << np.uint64(1)
    near = np.concatenate([base ^ (np.uint64(1) << rnd.integers(0, 64, 300).astype(np.uint64)) for _ in range(4)])
    x = np.unique(np.concatenate([base, near]))
    index = simhash.GrayIndex(x)
    q, p = index.search(x, 3)
    got = {(int(x[a]), int(index.prints[b])) for a, b in zip(q, p)}
    want = {(int(a), int(b)) for a in x for b in x[np.bitwise_count(x ^ a) <= 3]}
    assert got == want


def test_links_over_several_blocks(spark):
    rnd = np.random.default_rng(2)
    base = rnd.integers(0, 1 << 62, 40, dtype=np.int64)
    x = np.unique(np.concatenate([base] + [base ^ (np.int64(1) << rnd.integers(0, 63, 40)) for _ in range(6)]))
    df = spark.createDataFrame([(int(v), int(i % 3 + 1)) for i, v in enumerate(x)], "f long, n long")
    near, links = simhash.near_links(df, 3, block_rows=30)
    weight = {int(v): i % 3 + 1 for i, v in enumerate(x)}
    want = {int(a): sum(weight[int(b)] for b in x if b != a and bin(int(a) ^ int(b)).count("1") <= 3) for a in x}
    assert {r["f"]: r["near"] for r in near.collect()} == {k: v for k, v in want.items() if v}
    roots = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    prints = [int(v) for v in x]
    _, root = brute_components(prints)
    assert {v: roots.get(v, v) for v in prints} == {v: prints[root[i]] for i, v in enumerate(prints)}


def test_components_of_a_long_path(spark):
    order = list(range(200))
    random.Random(4).shuffle(order)
    links = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    assert {(r["node"], r["root"]) for r in simhash.components(links).collect()} >= {(i, 0) for i in range(1, 200)}


def test_vectorised_xxh64():
    rnd = random.Random(5)
    w = [bytes(rnd.randrange(256) for _ in range(rnd.randint(0, 140))) for _ in range(2000)]
    n = np.array([len(x) for x in w])
    got = xxh64(np.frombuffer(b"".join(w), np.uint8), np.cumsum(n) - n, n)
    assert got.tolist() == [xxhash.xxh64_intdigest(x, 42) for x in w]


# ------------------------------------------------------------------ 6

ITEM = "the quick brown fox jumps over the lazy dog while seven wizards brew strange potions under a pale moon"


def test_contaminated(spark):
    rnd = random.Random(6)
    filler = lambda n: " ".join("f%d" % rnd.randrange(5000) for _ in range(n))
    changed = ITEM.split()
    changed[4] = changed[13] = "changed"
    texts = [
        f"{filler(40)} {ITEM} {filler(30)}",  # whole
        f"{filler(9)} {' '.join(changed).upper()}, {filler(5)}",  # words changed, other case
        f"{filler(50)} {' '.join(ITEM.split()[:5])} {filler(50)}",  # a few words only
        filler(200), None, "", ITEM.replace(" ", "\n"), f"{ITEM} {ITEM}", "one two three four five", "Short item, of five",
    ]
    items = spark.createDataFrame([(7, ITEM), (8, None), (9, ""), (10, "short item of five"), (11, "one two")], "item_id long, text string")
    got = decontamination.contaminated(docs_of(spark, texts), items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(0, 7), (1, 7), (6, 7), (7, 7), (9, 10)}
    first = next(r for r in got if r["doc_id"] == 0)
    assert (first["matched"], first["start_word"], first["end_word"], first["overlap"]) == (19, 40, 58, 1.0)
    assert next(r for r in got if r["doc_id"] == 1)["matched"] == 17
    blocks = decontamination.contaminated(docs_of(spark, texts), items, block_bytes=40).collect()
    assert sorted(map(tuple, blocks)) == sorted(map(tuple, got))
    left = decontamination.without_contaminated(docs_of(spark, texts), items).collect()
    assert {r["doc_id"] for r in left} == {2, 3, 4, 5, 8}


def test_decontamination_finds_every_whole_passage(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    words = lambda t: " " + " ".join("".join(c.lower() if c.isalnum() and c.isascii() or ord(c) > 127 else " " for c in t).split()) + " "
    test = [(r["item_id"], words(r["text"])) for r in items.collect()]
    want = {(r["doc_id"], i) for r in docs.collect() for i, t in test if t in words(r["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, items).collect()}
    assert want and want <= got


def test_decontamination_finds_every_half_overlap():
    """Random substitutions and fragments against the number of words left; half the items of a length have one word too few."""
    rnd = random.Random(66)
    new = lambda: "w%d" % rnd.randrange(10**9)
    for m in range(4, 61):
        tests = [[new() for _ in range(m)] for _ in range(24)]
        texts, want = [], {}
        for k, item in enumerate(tests):
            n = -(-m // 2) - (k % 4 >= 2)
            a = rnd.randrange(m - n + 1)
            left = set(rnd.sample(range(m), n) if k % 2 else range(a, a + n))
            texts.append([*(new() for _ in range(rnd.randrange(20))), *(x if i in left else new() for i, x in enumerate(item)), new()])
            if 2 * n >= m:
                want[k, k] = n
        rows = [(0, *(x.encode() for x in (" ".join(t) + "\n" for t in rows))) for rows in (tests, texts)]
        (test, test_at), (text, text_at) = ((np.frombuffer(b"".join(r[1:]), np.uint8), np.cumsum([0, *map(len, r[1:])])) for r in rows)
        index = decontamination.Items(list(range(24)), test, test_at, 4, 0.5, 100)
        assert {(d, i): n for d, i, n, *_ in index.search(*word_hashes(text, text_at), 0.5, 100)} == want, m


def test_decontamination_of_many_alignments(monkeypatch):
    """An item cut up by insertions is found from its stretches together, also if texts are compared a few pairs at a time."""
    item = ["i%d" % k for k in range(60)]
    cut = [w for k in range(0, 60, 10) for w in [*item[k : k + 10], "more"]]
    texts = [" ".join(x).encode() for x in (cut, item[:20], item * 3, ["none"] * 9)]
    text, text_at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    own = " ".join(item).encode()
    index = decontamination.Items([5], np.frombuffer(own, np.uint8), np.array([0, len(own)]), 4, 0.5, 24)
    got = index.search(*word_hashes(text, text_at), 0.5, 24)
    assert [(d, n) for d, _, n, *_ in got] == [(0, 60), (2, 60)]
    monkeypatch.setattr(decontamination, "ROWS", 1)
    assert index.search(*word_hashes(text, text_at), 0.5, 24) == got


def test_words_of_scripts_without_spaces():
    texts = ["Don’t “stop” —\u00a0now… ÄPFEL", "Don't \"stop\" - now ÄPFEL", "他说：你好。abcカナ", "ไทย", "", "🙂🙂 é…"]
    raw = [t.encode() for t in texts]
    buf, at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    s, e, alone, upto = word_spans(buf, at)
    words = [bytes(buf[a:b]).decode() for a, b in zip(s, e)]
    own = [words[a:b] for a, b in zip(upto, upto[1:])]
    assert own == [["Don", "t", "stop", "now", "ÄPFEL"]] * 2 + [["他", "说", "你", "好", "abc", "カ", "ナ"], list("ไทย"), [], ["🙂🙂", "é"]]
    assert alone[upto[2] : upto[3]].tolist() == [True] * 4 + [False, True, True]
    h, n = word_hashes(buf, at)
    assert n.tolist() == upto.tolist() and h[:5].tolist() == h[5:10].tolist()


def test_decontamination_of_other_scripts(spark):
    long, short = "水在标准大气压下的沸点是多少摄氏度", "光合作用"
    items = spark.createDataFrame([(1, long), (2, short), (3, "“Isn’t it — really — so?”"), (4, "the moon landing"), (5, "on it"), (6, "沸点")], "item_id long, text string")
    texts = [f"请回答下面的问题：{long}？谢谢大家", f"我们学习了{short}的过程", "光和作用", f"前{long[:9]}后", f"前{long[:8]}后", 'isn\'t it-really-so', "he saw the moon landing on it", "the moon, a landing", "沸点"]
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs_of(spark, texts), items).collect()}
    assert got == {(0, 1), (1, 2), (3, 1), (5, 3), (6, 4)}


# ------------------------------------------------------------------ 7

def test_packing_round_trip(spark):
    cap = 128
    got = packing.pack_documents(docs_of(spark, ODD), VOCABULARY, cap).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for i, t in enumerate(ODD):
        ids = [*ids_of(t), 0]
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        at = 0
        for k, r in enumerate(pieces):
            assert r["start"] == at and 0 < r["length"] <= cap and (k == 0 or r["length"] == cap)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids) and len(pieces) == -(-len(ids) // cap)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= cap


def test_plan_places_every_piece():
    rnd = random.Random(7)
    for _ in range(60):
        cap = rnd.choice([10, 100, 2048])
        h = Counter(min(cap, max(1, int(rnd.expovariate(3 / cap)))) for _ in range(rnd.randint(1, 3000)))
        rows = packing.plan(h, cap)
        bins, numbers = defaultdict(list), defaultdict(list)
        for s, first, n, seq, off in rows:
            numbers[s] += range(first, first + n)
            for k in range(n):
                bins[seq + k].append((off, s))
        assert all(sorted(numbers[s]) == list(range(n)) for s, n in h.items()) and set(numbers) == set(h)
        for content in bins.values():
            at = 0
            for off, s in sorted(content):
                assert off == at
                at += s
            assert at <= cap
        low = max(-(-sum(s * n for s, n in h.items()) // cap), sum(n for s, n in h.items() if 2 * s > cap))
        assert len(bins) <= 1.25 * low + 1


def test_packing_numbers_hot_lengths_over_buckets(spark):
    pieces = spark.range(5000).selectExpr("id as doc_id", "0 as piece", "0L as start", "cast(if(id % 3 = 0, 100, id % 97 + 1) as long) as length", "id as ids_crc32")
    got = packing.pack(pieces, 100, rows_per_bucket=300).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 5000
    end = defaultdict(int)
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == end[r["sequence_id"]]
        end[r["sequence_id"]] += r["length"]
    assert max(end.values()) <= 100


# ------------------------------------------------------------------ 8

def test_licenses(spark):
    t = licenses.TEMPLATES
    rnd = random.Random(8)
    filler = lambda n: " ".join("f%d" % rnd.randrange(9000) for _ in range(n))
    edited = t["bsd-text"].replace("permitted", "allowed")
    texts = [f"{filler(30)}\n{t['mit-notice']}\n{filler(20)}", t["apache-2.0-header"], f"{filler(5)} {edited} {filler(9)}", filler(300), None, "", f"ALL RIGHTS RESERVED {filler(40)} all rights, reserved", "the license of the public", t["gpl-3.0-notice"]]
    got = defaultdict(list)
    for r in licenses.scan_licenses(docs_of(spark, texts)).collect():
        got[r["doc_id"]].append(r)
    names = lambda i: sorted(r["license"] for r in got[i])
    assert names(0) == ["mit-notice"] and (got[0][0]["start_word"], got[0][0]["end_word"], got[0][0]["containment"]) == (30, 34, 1.0)
    assert names(1) == ["apache-2.0-header", "apache-2.0-notice"]
    assert names(2) == ["bsd-text"] and 0.8 <= got[2][0]["containment"] < 1
    assert names(6) == ["all-rights-reserved"] * 2
    assert names(8) == ["gpl-3.0-notice"]
    assert not got[3] and not got[4] and not got[5] and not got[7]


def test_licenses_finds_every_exact_notice(spark):
    """Whole templates found by brute force in the test documents."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = lambda t: " " + " ".join("".join(c.lower() if c.isalnum() and c.isascii() or ord(c) > 127 else " " for c in t).split()) + " "
    own = [(n, words(t)) for n, t in licenses.TEMPLATES.items()]
    want = Counter((r["doc_id"], n) for r in docs.collect() for n, t in own if t in words(r["text"]))
    got = Counter((r["doc_id"], r["license"]) for r in licenses.scan_licenses(docs).collect() if r["containment"] == 1)
    assert want and set(want) <= set(got)


# ------------------------------------------------------------------ 9

def brute_lines(texts, least=10, chars=1):
    key = lambda x: x.encode().strip(b" \t\n\v\f\r").lower()
    count = Counter()
    for t in texts:
        count.update({key(x) for x in (t or "").split("\n")})
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x).decode()) < chars or count[key(x)] < least]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("chars", [1, 5])
def test_line_dedup(spark, chars):
    rnd = random.Random(9)
    shared = ["Common  Line", "\tcommon  line ", "", "ÉTÉ", "été", "x\r", "once"]
    texts = [*ODD, *("\n".join(rnd.choice(shared) if rnd.random() < 0.6 else "own%d" % rnd.randrange(999) for _ in range(6)) for _ in range(80))]
    got = {r["doc_id"]: r for r in line_dedup.digest(line_dedup.dedup_lines(docs_of(spark, texts), least_chars=chars)).collect()}
    assert len(got) == len(texts)
    for i, (n, gone, kept) in enumerate(brute_lines(texts, chars=chars)):
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["kept_sha256"]) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 20_000, dtype=np.uint64))
    ph = line_dedup.PerfectHash.build(keys)
    assert sorted(ph.find(keys).tolist()) == list(range(len(keys)))
    assert line_dedup.PerfectHash.build(keys[:0]).find(keys[:3]).tolist() == [-1] * 3
    assert 64 * len(ph.bits) / len(keys) < 6


def test_line_shards(spark):
    rows = [(i * 7919 - 3_000_000, i * 104729 - 5_000_000, i % 9 + 1) for i in range(2000)]
    counts = spark.createDataFrame(rows, "h1 long, h2 long, n_docs long")
    df, shards = line_dedup.build_shards(counts, keys_per_shard=300)
    assert shards > 3 and df.count() == shards
    a = np.array(rows)
    assert line_dedup.probe(df._graphloom_path, shards, a[:, 0].copy(), a[:, 1].copy()).tolist() == a[:, 2].tolist()
    assert (line_dedup.probe(df._graphloom_path, shards, a[:, 0] + 1, a[:, 1] + 1) == 1).all()


# ------------------------------------------------------------------ 10

def check_shards(rows, texts, shards):
    by_shard, at = defaultdict(list), Counter()
    for r in rows:
        by_shard[r["shard"]].append(r["slot"])
        at[texts[r["doc_id"]] or "", r["shard"]] += 1
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "rows", None)
    size = [len(by_shard[s]) for s in range(shards)]
    assert sum(size) == len(texts) and max(size) - min(size) <= 1 and set(by_shard) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    return at


def test_sharding(spark):
    texts = [*ODD, *["copy of five"] * 5, *["hot"] * 150, *("own %d" % i for i in range(300)), *("twin %d" % (i // 2) for i in range(60))]
    got = sharding.shard_documents(docs_of(spark, texts), 8).collect()
    at = check_shards(got, texts, 8)
    groups = Counter(t or "" for t in texts)
    parts = Counter(t for t, _ in at)
    assert sum(parts[t] > 1 for t, n in groups.items() if n > 1 and t != "hot") <= 2
    assert parts["hot"] <= 5


def test_sharding_of_copies_alone(spark):
    texts = ["same"] * 97
    check_shards(sharding.shard_documents(docs_of(spark, texts), 8).collect(), texts, 8)
    texts = ["g%d" % (i % 20) for i in range(103)]
    check_shards(sharding.shard_documents(docs_of(spark, texts), 8).collect(), texts, 8)


def test_grants_respect_room():
    rnd = random.Random(10)
    for _ in range(200):
        n = rnd.randint(2, 6)
        asked = {(a, b): rnd.randint(1, 50) for a in range(n) for b in range(n) if a != b and rnd.random() < 0.6}
        free = {s: rnd.choice([0, 0, rnd.randint(0, 40)]) for s in range(n)}
        got = sharding.grants(asked, free)
        for s in range(n):
            assert sum(x for (a, b), x in got.items() if b == s) <= free[s] + sum(x for (a, b), x in got.items() if a == s)
        assert all(0 < x <= asked[p] for p, x in got.items())


# ------------------------------------------------------------------ rows, nulls, hashes

def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "1L as n_chars")
    assert token_counts.token_counts(df, VOCABULARY).count() == 4
    assert line_dedup.dedup_lines(df).count() == 4
    assert {r["n_near"] for r in simhash.near_duplicates(df).where("doc_id = 1").collect()} == {2}
    assert packing.pack_documents(df, VOCABULARY).count() == 4
    assert sharding.shard_documents(df, 4).count() == 4


def test_neighbours_of_repeated_ids(spark):
    rnd = np.random.default_rng(8)
    rows = [(i, rnd.normal(size=8).tolist(), "clash", 1) for i in range(60)] + [(20, rnd.normal(size=8).tolist(), "clash", 1), (7, None, "x", 2)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, query_id string, no int"), 20, 20, probes=1000).collect()
    per = Counter(r["query_id"] for r in got)
    assert per == {0: 20, 20: 40, 40: 20}
    twice = Counter((r["query_id"], r["rank"]) for r in got if r["query_id"] == 20)
    assert all(twice[20, k] == 2 for k in range(1, 21))
    f32 = lambda v: np.array(v, np.float32).astype(float)
    own = {tuple(sorted(((-float(f32(v) @ f32(q)), i) for i, v, *_ in rows if v is not None and i != 20), reverse=False)[:20][k][1] for k in range(20)) for j, q, *_ in rows if j == 20}
    ranked = defaultdict(list)
    for r in got:
        if r["query_id"] == 20:
            ranked[r["rank"]].append(r["vec_id"])
    assert all(sorted(ranked[k + 1]) == sorted(x[k] for x in own) for k in range(20))


TABLES = "doc_id long, text string, lang string, source string, n_chars long, _id long, trains boolean, h1 long, f long, no long, k int, i long, t string, list int, kept string, n_docs long, item_id long, shard int, size long, perplexity double, loss double, worst double, _f long, _root long"


def _operators(docs, labels, items):
    """Every operator on documents, by number, with how many rows it gives per document (None: any)."""
    return {
        1: (token_counts.token_counts(docs, VOCABULARY), 1),
        2: (lm_scoring.cross_entropy_difference(docs, labels.select("doc_id"), order=3), 1),
        4: (simhash.near_duplicates(docs), 1),
        5: (quality.classify(docs, labels), 1),
        6: (decontamination.contaminated(docs, items), None),
        7: (packing.pack_documents(docs, VOCABULARY), None),
        8: (licenses.scan_licenses(docs), None),
        9: (line_dedup.dedup_lines(docs), 1),
        10: (sharding.shard_documents(docs, 4), 1),
    }


@pytest.mark.parametrize("n", [1, 2, 4, 5, 6, 7, 8, 9, 10])
def test_every_operator_on_odd_tables(spark, n):
    """Null ids and texts, repeated rows, columns with the names used inside, ties, a very long repetitive text, and empty tables."""
    own = [(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, None), (3, ""), (None, None), (4, "word " * 20_000), (4, "other words of the same id"), (5, "Licensed under the MIT License.")]
    rows = [(i, t, "en" if i != 2 else None, "s", len(t or ""), *([None] * 19)) for i, t in own]
    docs = spark.createDataFrame(rows, TABLES)
    labels = spark.createDataFrame([(1, 1, 0, 7), (4, 1, 0, 7), (None, 1, 0, 7), (3, 0, 1, 7), (1, 1, 0, 7)], "doc_id long, quality int, toxic int, _id long")
    items = spark.createDataFrame([(1, "word " * 300, "x"), (None, None, "x"), (2, "", None), (2, "the same words are elsewhere", None)], "item_id long, text string, doc_id string")
    got, per = _operators(docs, labels, items)[n]
    found = got.collect()
    if per:
        assert Counter(r["doc_id"] for r in found) == Counter(i for i, _ in own)
    elif n == 6:
        assert {(r["doc_id"], r["item_id"], r["matched"]) for r in found} == {(4, 1, 300)}
        left = decontamination.without_contaminated(docs, items)
        assert left.columns == docs.columns and Counter(r["doc_id"] for r in left.collect()) == Counter(i for i, t in own if (t or "").split() != ["word"] * 20_000)
    elif n == 7:
        assert {(r["doc_id"]) for r in found} == {i for i, _ in own} and sum(r["length"] for r in found) == sum(len(ids_of(t)) + 1 for _, t in own)
    none = docs.where("false")
    assert _operators(none, labels.where("false"), items.where("false"))[n][0].count() == 0
    if n in (5, 6):  # documents, but nothing to go by
        assert _operators(docs, labels.where("false"), items.where("false"))[n][0].count() == (len(own) if n == 5 else 0)


def test_span_hash_depends_on_content_alone():
    b = np.frombuffer(b"xxabcdyyabcd abc", np.uint8)
    h = span_hash(b, np.array([2, 8, 13]), np.array([6, 12, 16]))
    assert h[0] == h[1] != h[2]
