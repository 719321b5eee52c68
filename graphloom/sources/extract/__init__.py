"""Rows from source text: symbols, references, imports and exports of each file, by language.

Files are read by hand-written tokenizers inside an Arrow map; a file that can't be read yields an error and no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from graphloom.schema import STRIDE

_SPAN = "span_start BIGINT, span_end BIGINT, line_start BIGINT, col_start BIGINT, line_end BIGINT, col_end BIGINT"


def _struct(spec: str) -> str:
    return "ARRAY<STRUCT<" + ", ".join(x.strip().replace(" ", ": ", 1) for x in spec.split(",")) + ">>"


_SYMBOLS = _struct(f"n BIGINT, name STRING, qualified_name STRING, kind STRING, {_SPAN}, parent BIGINT, visibility STRING, signature STRING")
_REFS = _struct(f"n BIGINT, source BIGINT, target BIGINT, target_name STRING, kind STRING, {_SPAN}")
_IMPORTS = _struct(f"source_path STRING, imported_name STRING, local_name STRING, {_SPAN}, is_default BOOLEAN, is_namespace BOOLEAN, is_type_only BOOLEAN, is_side_effect BOOLEAN, is_dynamic BOOLEAN")
_EXPORTS = _struct("symbol BIGINT, exported_name STRING, is_default BOOLEAN, is_reexport BOOLEAN, is_type_only BOOLEAN, source_path STRING, line BIGINT")
_ARRAYS = {"symbols": _SYMBOLS, "refs": _REFS, "imports": _IMPORTS, "exports": _EXPORTS}
SCHEMA = "file_id BIGINT, error STRING, " + ", ".join(f"{k} {v}" for k, v in _ARRAYS.items())
#: Characters of texts whose rows a task keeps, for files that are copies of each other.
KEPT = 1 << 19


def parse(language: str, content: str) -> dict[str, list[dict]]:
    """The rows of one file; ValueError for a language without a parser."""
    from graphloom.sources.extract import java, rust, typescript

    known = {"typescript": typescript.Reader, "javascript": typescript.Reader, "java": java.Reader, "rust": rust.Reader}
    if language not in known:
        raise ValueError(f"no parser for language {language}")
    return known[language](content).read()


def _with_targets(rows: dict[str, list[dict]]) -> dict[str, list[dict]]:
    """References that meet the only symbol of that name in their file, with its number; others have none."""
    by_name: dict[str, int | None] = {}
    for s in rows["symbols"]:
        by_name[s["name"]] = None if s["name"] in by_name else s["n"]
    return rows | {"refs": [r | {"target": by_name.get(r["target_name"])} for r in rows["refs"]]}


def _row(language: str, content: str) -> dict:
    try:
        return {"error": None} | _with_targets(parse(language, content))
    except (ValueError, RecursionError, IndexError) as e:
        return {"error": str(e), "symbols": [], "refs": [], "imports": [], "exports": []}


def extract(files: DataFrame, only: tuple[str, ...] = tuple(_ARRAYS)) -> DataFrame:
    """One row per file (file_id, language, content): its arrays (those in ``only``), or an error.

    Reading takes far longer than a file's bytes suggest, so files are spread over all of the session's partitions,
    by a hash of the id: by the id itself the plan would reuse an earlier exchange, whose partitions are merged until
    few tasks do it all. A text that a task has just read isn't read again.
    """
    schema = "file_id BIGINT, error STRING, " + ", ".join(f"{k} {_ARRAYS[k]}" for k in only)
    kind = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches):
        read, size = {}, 0
        for b in batches:
            rows = []
            for i, *text in zip(*(c.to_pylist() for c in b.columns)):
                key = (text[0], text[1] or "")
                if (row := read.get(key)) is None:
                    row = _row(*key)
                    if size > KEPT:
                        read, size = {}, 0
                    if len(key[1]) <= KEPT >> 5:
                        read[key], size = row, size + len(key[1])
                rows.append(row | {"file_id": i})
            yield pa.RecordBatch.from_pylist(rows, kind)

    spark = files.sparkSession
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return files.select("file_id", "language", "content").repartition(wide, F.xxhash64("file_id")).mapInArrow(run, schema)


def tables(extracted: DataFrame) -> dict[str, DataFrame]:
    """The tables of the arrays that ``extracted`` has; ids are the file's times ``STRIDE`` plus a number. References whose target isn't known go."""
    base = F.col("file_id") * STRIDE + 1
    each = lambda c: extracted.select("file_id", F.explode(c).alias("x"))
    at = lambda c: extracted.select("file_id", F.posexplode(c).alias("n", "x"))
    span = [F.col(f"x.{c.split()[0]}") for c in _SPAN.split(", ")]
    number = (base + F.col("n")).alias("id")
    make = {
        "symbols": lambda: each("symbols").select((base + F.col("x.n")).alias("id"), "file_id", "x.name", "x.qualified_name", "x.kind", *span, (base + F.col("x.parent")).alias("parent_id"), "x.visibility", "x.signature"),
        "refs": lambda: each(F.filter("refs", lambda r: r.target.isNotNull())).select((base + F.col("x.n")).alias("id"), (base + F.col("x.source")).alias("source_id"), (base + F.col("x.target")).alias("target_id"), "x.kind", "file_id", *span),
        "imports": lambda: at("imports").select(number, "file_id", "x.*"),
        "exports": lambda: at("exports").select(number, "file_id", (base + F.col("x.symbol")).alias("symbol_id"), "x.exported_name", "x.is_default", "x.is_reexport", "x.is_type_only", "x.source_path", "x.line"),
    }
    return {k: f() for k, f in make.items() if k in extracted.columns}


def named_refs(extracted: DataFrame) -> DataFrame:
    """(file_id, source, target, kind): references by the qualified names of their ends, within each file's row."""
    name = lambda n: F.get("symbols", n).qualified_name
    known = F.filter("refs", lambda r: r.target.isNotNull())
    ends = F.transform(known, lambda r: F.struct(name(r.source).alias("source"), name(r.target).alias("target"), r.kind.alias("kind")))
    return extracted.select("file_id", F.explode(ends).alias("x")).select("file_id", "x.*")
