"""Operator 2: cross-entropy difference of matched target and background models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngrams
from .common import batch, drop_written, flat, held, map_batches, written

#: A join with the labels broadcasts their ids up to so many rows (16 MB); beyond, both sides are shuffled.
BROADCAST_IDS = 1_000_000
#: A worker reads texts by blocks of so many bytes and sums the counts of about so many n-grams, to bound its memory.
BLOCK, HELD_COUNTS = 1 << 18, 500_000


def _pair(paths: tuple[str, str], order: int, size: int) -> tuple:
    """Both models from the shared folder, in files that are mapped."""
    return tuple(ngrams.MappedModel(p, order, size) for p in paths)


def cross_entropy_difference(docs: DataFrame, target: DataFrame, order: int = 4, least_chars: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row per document: (doc_id, n_tokens, ce_target, ce_background, ce_diff), in nats per character.

    Both models are ``order``-gram models of characters with the same vocabulary (what occurs ``least_chars`` times in
    the whole corpus), smoothing and end symbol. The background counts all documents, the target those whose id is in
    ``target`` (doc_id). A negative difference means closer to the target. Counts come from every row; per task they are
    summed before the shuffle. The models are written to the shared folder, from which each worker reads them once, by
    pieces, into files on its local disk that are mapped: its own memory doesn't grow with them.

    A null or empty text is scored by its end symbol alone (0 tokens). Repeated rows count and are scored each. Without
    target rows the target model is uniform. An empty table gives none.
    """
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    wanted = target.select(F.col("doc_id").cast("long").alias("_id")).distinct()
    n = wanted.count()
    side = F.broadcast(wanted) if n <= BROADCAST_IDS else wanted
    flagged = src.join(side, F.col("doc_id") == F.col("_id"), "left").select("text", F.col("_id").isNotNull().alias("hit"))
    vocab = ngrams.vocabulary(ngrams.char_counts(src, block=BLOCK), least_chars)
    size = len(vocab) + 2
    grams = written(ngrams.gram_counts(flagged, vocab, order, ["hit"], block=BLOCK, most=HELD_COUNTS), "gram-counts")
    back = written(ngrams.kneser_ney(grams.select("key", "c"), order, size), "background-model")
    aim = written(ngrams.kneser_ney(grams.select("key", F.col("c_hit").alias("c")), order, size), "target-model")
    drop_written(grams)
    paths = aim._graphloom_path, back._graphloom_path

    schema = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ce_target", pa.float64()), ("ce_background", pa.float64())]

    def score(b: pa.RecordBatch) -> pa.RecordBatch:
        buf, offsets = flat(b.column(1))
        table = ngrams.numbers(vocab)
        models = held(paths, lambda: _pair(paths, order, size))
        (t, n_), (g, _) = (ngrams.mean_loss(m, table, buf, offsets) for m in models)
        return batch(schema, b.column(0), n_, t, g)

    return map_batches(src, score, "doc_id long, n_tokens long, ce_target double, ce_background double").withColumn("ce_diff", F.col("ce_target") - F.col("ce_background"))
