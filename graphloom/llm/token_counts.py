"""Operator 1: token counts by a compiled finite-state tokenizer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import transducer
from .common import batch, blocks, flat, map_batches

_SCHEMA = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of each whole text, as the tokenizers library gives them, without added special tokens.

    One pass without a shuffle: the text never leaves its task, memory is bounded by the longest text plus one block.
    A null text counts as empty (0 bytes, 0 tokens); null ids and repeated rows are kept as they are; an empty table
    gives none; extra columns are ignored.
    """
    classes = transducer.char_classes()

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        buf, offsets = flat(b.column(1))
        parts = [transducer.encode(vocabulary, classes, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[0] for i, j in blocks(offsets, 2 << 20)]
        n = np.concatenate(parts)
        return batch(_SCHEMA, b.column(0), np.diff(offsets), n, n > limit)

    return map_batches(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
