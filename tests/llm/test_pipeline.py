"""The pipeline against a brute-force version of its five stages."""

import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import xxhash
from test_llm import brute_components, brute_fingerprint, brute_kneser_ney, brute_lines, ids_of

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def words_of(text):
    return "".join(c.lower() if (c.isascii() and c.isalnum()) or ord(c) > 127 else " " for c in text).split()


def measures(own, other, text, vocab):
    """Mean loss of the most unusual hundredth of words, and how much likelier the toxic model finds its three hundredths."""
    space = lambda c: c in " \t\n\v\f\r" and ord(c) in vocab
    parts, start = [], 0
    for i in range(len(text) + 1):
        end = i == len(text) or space(text[i])
        if end or i + 1 - start == 24:
            if not (end and i == start and (i == 0 or space(text[i - 1]))):
                parts.append((sum(own[start : i + 1]) / (i + 1 - start), sum(own[start : i + 1]) - sum(other[start : i + 1])))
            start = i + 1
    out = []
    for k, share in ((0, 0.01), (1, 0.03)):
        n = max(1, math.ceil(share * len(parts)))
        out.append(sum(sorted((p[k] for p in parts), reverse=True)[:n]) / n if parts else -math.inf)
    return out


def keep_quality(docs, labels):
    trusted = {r["doc_id"] for r in labels if r["quality"] == 1 and r["toxic"] == 0}
    toxic = {r["doc_id"] for r in labels if r["toxic"] == 1}
    by_lang = defaultdict(list)
    for d in docs:
        if d["doc_id"] in trusted:
            h = xxhash.xxh64_intdigest(struct.pack("<q", d["doc_id"]), 42)
            by_lang[d["lang"]].append((h - (h >> 63 << 64), d["doc_id"], d["text"]))
    train, held = [], []
    for lang, rows in by_lang.items():
        for k, (_, _, text) in enumerate(sorted(rows)):
            train.append(text) if k % 2 == 0 else held.append((lang, text))
    count = Counter(c for t in train for c in t)
    vocab = [ord(c) for c, n in sorted(count.items(), key=lambda x: (-x[1], ord(x[0]))) if n >= 2]
    known = set(vocab)
    loss = brute_kneser_ney(train, 5, vocab)
    bad = [d["text"] for d in docs if d["doc_id"] in toxic and d["lang"] in by_lang]
    second = brute_kneser_ney(bad, 5, vocab) if bad else None

    def score(t):
        own = loss.signs(t)
        a, b = measures(own, second.signs(t) if second else own, t, known)
        return sum(own) / len(own), a, b if second else -math.inf

    limit = {}
    for lang in by_lang:
        own = [score(t) for x, t in held if x == lang]
        if len(own) >= 20:
            at = [np.quantile([x[k] for x in own], 0.995) for k in range(3)]
            wide = 0.35 * (1 + 20 / len(own))
            limit[lang] = [at[0] + math.log(1.05), *(at[k] + wide * (at[k] - np.median([x[k] for x in own])) if k == 1 or second else math.inf for k in (1, 2))]
    every = [np.quantile([loss(t) for _, t in held], 0.995) + math.log(1.05), math.inf, math.inf]
    return [d for d in docs if d["text"] and all(x <= y for x, y in zip(score(d["text"]), limit.get(d["lang"], every)))]


def drop_lines(docs):
    out = []
    for d, (_, gone, kept) in zip(docs, brute_lines([d["text"] for d in docs])):
        if not gone or kept.strip(" "):
            out.append(d | {"text": kept})
    return out


def drop_near(docs):
    docs = sorted(docs, key=lambda d: d["doc_id"])
    _, root = brute_components([brute_fingerprint(d["text"]) for d in docs])
    return [d for i, d in enumerate(docs) if root[i] == i]


def drop_leaks(docs, items):
    own = [words_of(r["text"]) for r in items]
    kept = []
    for d in docs:
        w = words_of(d["text"])
        have, hit = set(w), False
        for item in own:
            if sum(x in have for x in item) * 2 < len(item):
                continue
            hit = hit or any(2 * sum(w[a + i] == x for i, x in enumerate(item) if 0 <= a + i < len(w)) >= len(item) for a in range(-len(item), len(w)))
        if not hit:
            kept.append(d)
    return kept


def test_pipeline(spark):
    got = [r.asDict() for r in corpus_pipeline.run(spark, SF).collect()]
    docs, labels, items = (pq.read_table(f"{SF}/{t}.parquet").to_pylist() for t in ("documents", "labels", "benchmark"))
    left = drop_leaks(drop_near(drop_lines(keep_quality(docs, labels))), items)
    want = set()
    for d in left:
        ids = [*ids_of(d["text"]), 0]
        at, piece = 0, 0
        for size in [len(ids) % 2048] * (len(ids) % 2048 > 0) + [2048] * (len(ids) // 2048):
            want.add((d["doc_id"], piece, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())))
            at, piece = at + size, piece + 1
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    room = defaultdict(int)
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == room[r["sequence_id"]]
        room[r["sequence_id"]] += r["length"]
    assert max(room.values()) <= 2048
    assert len(docs) > len(left) > 0.5 * len(docs)


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]


def test_near_dedup_of_null_and_repeated_ids(spark):
    rnd = random.Random(34)
    text = lambda: " ".join("w%d" % rnd.randrange(10_000) for _ in range(300))
    a, b, c, d, e = (text() for _ in range(5))
    others = (f"{a.rsplit(' ', 1)[0]} end{k}" for k in range(100))
    near = next(t for t in others if 0 < (brute_fingerprint(a) ^ brute_fingerprint(t)).bit_count() <= 3)
    rows = [(3, a), (5, near), (5, b), (None, c), (None, c), (None, d), (None, near), (7, d), (8, e), (8, e), (9, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    assert Counter(got) == Counter([(3, a), (5, b), (None, c), (7, d), (8, e), (9, None)])


def test_quality_stage_learns_from_every_trusted_document(spark, tmp_path):
    """Of 3,200 trusted documents of a language those last by the hash of their id are of a subject of their own; they stay, junk goes."""
    h = lambda i: (lambda x: x - (x >> 63 << 64))(xxhash.xxh64_intdigest(struct.pack("<q", i), 42))
    rnd = random.Random(9)
    say = lambda *words: " ".join(rnd.choice(words) for _ in range(6))
    last = set(sorted(range(3200), key=h)[3000:])
    rows = [(i, say("zebu", "gnu", "kudu") if i in last else say("la", "mo", "ti")) for i in range(3200)] + [(3200 + i, "#$%&" * 9) for i in range(5)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, 1, 0) for i in range(3200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.keep_quality(spark, docs, str(tmp_path)).collect()}
    assert len(kept & last) >= 190 and len(kept) >= 3150 and max(kept) < 3200


def test_stages_on_odd_tables(spark, tmp_path):
    """Null ids and texts, repeated rows and ids, a long repetitive text, extra columns in labels and benchmark, and empty documents."""
    labels = spark.createDataFrame([(1, 1, 0, 7)], "doc_id long, quality int, toxic int, _id long")
    items = spark.createDataFrame([(1, "some passage of a benchmark that nobody should train on", "x")], "item_id long, text string, lang string")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, "one text"), (None, "another one here"), (1, "a b c d"), (1, "something else altogether"), (2, None), (4, "word " * 20_000), (5, "here is some passage of a benchmark that nobody should train on, indeed")]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    of = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    assert of(stages["line dedup"](spark, docs, str(tmp_path))) == Counter((i, t or "") for i, t in rows)
    assert of(stages["SimHash near-dedup"](spark, docs, str(tmp_path))) == Counter(rows)
    assert of(stages["benchmark decontamination"](spark, docs, str(tmp_path))) == Counter(rows[:-1])
    assert set(of(stages["quality classifier"](spark, docs, str(tmp_path)))) <= {(i, t) for i, t in rows if t}
    assert {r["doc_id"] for r in stages["best-fit packing"](spark, docs, str(tmp_path)).collect()} == {i for i, _ in rows}
    for stage in stages.values():
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
