"""Operator 5: quality classifier by Kneser-Ney perplexity."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ngrams
from .common import drop_written, flat, held, map_batches, written
from .lm_scoring import BROADCAST_IDS

ORDER = 5
#: Shares of a document's words that are looked at: the most unusual ones, and those most like toxic text.
WORST, ALIKE = 0.01, 0.03
#: Held-out trusted documents of a language from which it has thresholds of its own.
OWN_DOCS = 20
MEASURES = ("loss", "worst", "alike")


@dataclass(frozen=True)
class Trained:
    """Models as paths in the shared folder, thresholds (_lang, and one per measure) and that of perplexity for all languages together."""

    trusted: str
    toxic: str | None
    vocab: np.ndarray
    limits: DataFrame | None
    every: float | None


def _places(rows: DataFrame, by: list[str], piece: F.Column, order: list[str], weight: F.Column) -> DataFrame:
    """``rows`` with ``k``, the weight up to and with each in the order of its group, and ``n``, that of the group.

    ``piece`` doesn't fall along the order. A task sorts one piece of a group and adds what the earlier ones weigh, so
    none gets all rows of a language, whatever their number.
    """
    parts = rows.withColumn("_piece", piece).withColumn("_w", weight.cast("long"))
    group = Window.partitionBy(*by)
    counts = parts.groupBy(*by, "_piece").agg(F.sum("_w").alias("_s"))
    before = F.sum("_s").over(group.orderBy("_piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_s")
    counts = counts.select(*by, "_piece", before.alias("_before"), F.sum("_s").over(group).alias("n"))
    own = Window.partitionBy(*by, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = parts.withColumn("k", F.sum("_w").over(own)).join(counts, [*by, "_piece"])
    return out.select(*rows.columns, (F.col("k") + F.col("_before")).alias("k"), "n")


def _first(rows: DataFrame, n: int | None = None) -> DataFrame:
    """(doc_id, lang, k): the rows of each language numbered from 1 by a hash of their id; the first ``n``, or all."""
    hashed = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("_h"))
    every = _places(hashed, ["lang"], F.shiftright("_h", 52), ["_h", "doc_id"], F.lit(1))
    return (every if n is None else every.where(F.col("k") <= n)).select("doc_id", "lang", "k")


def _quantiles(scored: DataFrame, quantile: float) -> DataFrame:
    """(lang, measure, n, high, middle): the exact ``quantile`` and median of each measure's values, interpolated; as the measure "every" (language "") the loss of all."""
    one = lambda measure, col, lang: F.struct(F.lit(measure).alias("measure"), lang.alias("lang"), F.col(col).alias("value"))
    each = F.array(*(one(m, m, F.col("lang")) for m in MEASURES), one("every", "loss", F.lit("")))
    values = scored.select(F.inline(each)).where("value is not null").groupBy("measure", "lang", "value").agg(F.count("*").alias("c"))
    placed = _places(values, ["measure", "lang"], F.floor(F.col("value") * 256), ["value"], F.col("c"))

    def at(share: float) -> F.Column:
        place = (F.max("n") - 1) * F.lit(share)
        low, high = (F.min(F.when(F.col("k") > f((F.col("n") - 1) * F.lit(share)), F.col("value"))) for f in (F.floor, F.ceil))
        return low + (high - low) * (place - F.floor(place))

    return placed.groupBy("lang", "measure").agg(F.max("n").alias("n"), at(quantile).alias("high"), at(0.5).alias("middle"))


def _fitted(docs: DataFrame, vocab: np.ndarray, order: int, name: str) -> str:
    """Path of the model that is trained on all of ``docs``."""
    grams = written(ngrams.gram_counts(docs, vocab, order), "gram-counts")
    model = written(ngrams.kneser_ney(grams, order, len(vocab) + 2).select(F.col("n").cast("byte"), "key", F.col("p").cast("float"), F.col("g").cast("float")), name)
    drop_written(grams)
    return model._graphloom_path


def train(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = 0.995, slack: float = 1.05, margin: float = 0.35) -> Trained | None:
    """Fits the models on all labelled text; None without trusted documents (quality 1 and toxic 0).

    The trusted documents of each language are numbered by a hash of the id; every other one trains the model, all the
    rest set the thresholds: ``slack`` times the ``quantile`` of their perplexities, and for the two measures of words the
    ``quantile`` and ``margin`` of its distance from the median beyond it (more with few documents). Languages with fewer
    than ``OWN_DOCS`` held-out documents have the perplexity threshold of all together and none for words. All toxic
    documents of languages with trusted ones train the second model, over the same characters. Nothing is left out, so
    the models grow with the number of different n-grams, which levels off but has no fixed bound; they are written to the
    shared folder, from which each worker reads them once.
    """
    is_ = lambda condition: F.coalesce(F.max(F.expr(condition)), F.lit(False))
    roles = labels.groupBy(F.col("doc_id").alias("_id")).agg(is_("quality = 1 and toxic = 0").alias("trusted"), is_("toxic = 1").alias("toxic")).where("trusted or toxic")
    ids = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang")).distinct()
    known = written(ids.join(roles, F.col("doc_id") == F.col("_id")).select("doc_id", "lang", "trusted", "toxic"), "labelled-ids")
    good = written(_first(known.where("trusted")), "trusted-ids")
    if not good.take(1):
        return None
    bad = known.where("toxic").join(good.select("lang").distinct(), "lang", "left_semi").select("doc_id", "lang", F.lit(True).alias("bad"))
    picked = written(good.join(bad, ["doc_id", "lang"], "full").select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), "k", "bad"), "picked-ids")
    side = F.broadcast(picked) if picked.count() <= BROADCAST_IDS else picked
    own = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text")
    texts = written(own.join(side, (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang"))).select("lang", "text", "k", "bad"), "labelled-texts")
    base, rest, toxic = texts.where("k % 2 = 1"), texts.where("k % 2 = 0"), texts.where("bad")
    vocab = ngrams.vocabulary(ngrams.char_counts(base))
    second = _fitted(toxic, vocab, order, "toxic-model") if toxic.take(1) else None
    half = Trained(_fitted(base, vocab, order, "quality-model"), second, vocab, None, None)
    scored = written(_scored(rest.select("lang", "text"), half, order).where("n_chars > 0").select("lang", *MEASURES), "held-out")
    found = written(_quantiles(scored, quantile), "quantiles")
    drop_written(known, good, picked, texts, scored)

    of = lambda measure, col: F.max(F.when(F.col("measure") == measure, F.col(col)))
    wide = margin * (1 + 20 / of("loss", "n"))  # a quantile of few documents lies too low
    words = [(of(m, "high") + wide * (of(m, "high") - of(m, "middle"))).alias(m) for m in MEASURES[1:]]
    loss = (of("loss", "high") + float(np.log(slack))).alias("loss")
    limits = found.groupBy(F.col("lang").alias("_lang")).agg(of("loss", "n").alias("n"), loss, *words).where(F.col("n") >= OWN_DOCS).drop("n")
    every = found.where("measure = 'every'").first()
    return Trained(half.trusted, half.toxic, vocab, written(limits, "thresholds"), None if every is None else every["high"] + float(np.log(slack)))


def _scored(docs: DataFrame, trained: Trained, order: int) -> DataFrame:
    """``docs`` with loss, n_chars, worst and alike."""
    vocab, paths = trained.vocab, (trained.trusted, trained.toxic)

    def load() -> tuple:
        return (*(None if p is None else ngrams.read_model(p, order, len(vocab) + 2) for p in paths), ngrams.numbers(vocab))

    def score(b: pa.RecordBatch) -> pa.RecordBatch:
        model, other, table = held(paths, load)
        buf, offsets = flat(b.column(b.schema.get_field_index("text")))
        loss, size, worst, alike = ngrams.text_scores(model, other, table, buf, offsets, WORST, ALIKE)
        keep = [b.column(c) for c in range(b.num_columns)]
        return pa.RecordBatch.from_arrays([*keep, pa.array(loss), pa.array(size, pa.int64()), pa.array(worst, from_pandas=True), pa.array(alike, pa.float64(), from_pandas=True)], names=[*b.schema.names, "loss", "n_chars", "worst", "alike"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(docs, score, f"{kinds}, loss double, n_chars long, worst double, alike double")


def classify(docs: DataFrame, labels: DataFrame, carry: list = (), order: int = ORDER, **settings) -> DataFrame:
    """Row per document: (doc_id, lang, text, n_chars, perplexity, threshold, worst, alike, keep), and the columns in ``carry``.

    ``keep``: three measures are each at most the language's threshold, set on held-out trusted documents. The perplexity
    per character; ``worst``, the mean loss of the 1 % of words that are most unusual in trusted text; ``alike``, how much
    more likely a second model of the same kind, trained on toxic documents, finds the 3 % of words it is surest of. A few
    insults in a long text hardly move its perplexity but stand out among its words.

    A null language is "", and a language without trusted text has the thresholds of all. An empty or null text has no
    perplexity (null) and isn't kept. Without any trusted document nothing can be told, and all but empty texts are kept;
    without toxic ones ``alike`` is null and ignored. Rows with a null id are judged like others but are never trained on.
    Repeated rows are judged alike; an empty table gives none. Other columns of either table are left out, whatever
    their names. A text of any length is scored whole, in time linear in it. Documents are scored where they are;
    only labels and counts are shuffled, and beyond ``BROADCAST_IDS`` labelled ids once the texts to pick those.
    """
    only = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    trained = train(only, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic"), order=order, **settings)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), "text", *carry)
    more = [c for c in src.columns if c not in ("doc_id", "lang", "text")]
    if trained is None:
        n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
        none = F.lit(None).cast("double")
        return src.select("doc_id", "lang", "text", *more, n.alias("n_chars"), none.alias("perplexity"), none.alias("threshold"), none.alias("worst"), none.alias("alike"), (n > 0).alias("keep"))

    def limit(measure: str) -> F.Column:
        return F.coalesce(F.col(f"_at_{measure}"), F.lit(trained.every if measure == "loss" else None).cast("double"))

    at = trained.limits.select(F.col("_lang").alias("_at_lang"), *(F.col(m).alias(f"_at_{m}") for m in MEASURES))  # a row per language
    out = _scored(src, trained, order).join(F.broadcast(at), F.col("lang") == F.col("_at_lang"), "left")
    there = F.col("n_chars") > 0
    fits = there
    for m in MEASURES:
        fits = fits & F.coalesce(F.col(m) <= limit(m), F.lit(True))
    return out.select("doc_id", "lang", "text", *more, "n_chars", F.when(there, F.exp("loss")).alias("perplexity"), F.exp(limit("loss")).alias("threshold"), F.when(there, F.col("worst")).alias("worst"), F.when(there, F.col("alike")).alias("alike"), fits.alias("keep"))
