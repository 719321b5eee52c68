"""The five stored tables and their value domains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T



_SPAN = "span_start BIGINT, span_end BIGINT, line_start BIGINT, col_start BIGINT, line_end BIGINT, col_end BIGINT"
DDL = {
    "files": "id BIGINT, path STRING, mtime BIGINT, language STRING",
    "symbols": f"id BIGINT, file_id BIGINT, name STRING, qualified_name STRING, kind STRING, {_SPAN}, parent_id BIGINT, visibility STRING, signature STRING",
    "refs": f"id BIGINT, source_id BIGINT, target_id BIGINT, kind STRING, file_id BIGINT, {_SPAN}",
    "imports": f"id BIGINT, file_id BIGINT, source_path STRING, imported_name STRING, local_name STRING, {_SPAN}, is_default BOOLEAN, is_namespace BOOLEAN, is_type_only BOOLEAN, is_side_effect BOOLEAN, is_dynamic BOOLEAN",
    "exports": "id BIGINT, file_id BIGINT, symbol_id BIGINT, exported_name STRING, is_default BOOLEAN, is_reexport BOOLEAN, is_type_only BOOLEAN, source_path STRING, line BIGINT",
}
SYMBOL_KINDS = ("function", "method", "class", "struct", "enum", "enum_variant", "interface", "type_alias", "variable", "constant", "module", "import", "export", "annotation", "package")
REF_KINDS = ("call", "type_usage", "import", "export", "inheritance", "field_access", "assignment")
VISIBILITIES = ("public", "private", "protected")
CONFIDENCES = ("low", "medium", "high", "certain")
SEVERITIES = ("error", "warning", "info")
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "pyi": "python", "rs": "rust", "java": "java"}
#: Row ids are file_id * STRIDE + 1 + n: room for 2 ** 32 rows of each kind in a file (which itself is under 2 GB) and for 2 ** 31 files.
STRIDE = 1 << 32


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[table])


def decoded(value: Column, domain: tuple[str, ...], default: str) -> Column:
    """``value`` if the domain has it, else ``default``."""
    return F.when(value.isin(*domain), value).otherwise(F.lit(default))


def rank(value: Column, order: tuple[str, ...]) -> Column:
    """Place of ``value`` in an ordered domain, from 0."""
    return F.array_position(F.array(*(F.lit(x) for x in order)), value).cast("int") - 1
