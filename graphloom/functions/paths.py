"""Path functions, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.schema import LANGUAGES

_DISPLAY = {"ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "java": "java", "rs": "rust"}


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    """The directory, "" for a bare name."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """What follows the last dot of the name, "" without one; a leading dot begins no extension."""
    return F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)


def stem(path: Column) -> Column:
    name = file_name(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key]


def language(path: Column) -> Column:
    """Language by extension; null if there is none for it."""
    return _lookup(LANGUAGES, extension(path))


def display_language(path: Column) -> Column:
    return _lookup(_DISPLAY, extension(path))


def relative(path: Column, root: str) -> Column:
    """``path`` without the leading ``root``, unchanged if it isn't below."""
    head = root.rstrip("/") + "/"
    return F.when(path.startswith(head), F.substring(path, F.lit(len(head) + 1), F.length(path))).otherwise(path)


def normalize(path: Column, keep_leading: bool = False) -> Column:
    """Resolves ``.`` and ``..`` by name alone; ``..`` above the top is kept or dropped."""
    absolute = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    nothing = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        up = x == ".."
        poppable = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != "..")
        kept = F.when(F.lit(keep_leading) & ~absolute, F.concat(acc, F.array(x))).otherwise(acc)
        return F.when(up & poppable, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(up, kept).otherwise(F.concat(acc, F.array(x)))

    return F.concat(F.when(absolute, "/").otherwise(""), F.array_join(F.aggregate(parts, nothing, step), "/"))


def is_entry_point(path: Column) -> Column:
    """Whether a file is an entry point by name alone."""
    s, n, e = stem(path), file_name(path), extension(path)
    usual = s.isin("index", "main", "app", "server", "cli") | n.contains(".test.") | n.contains(".spec.") | s.rlike("(_test|_spec)$")
    java = (e == "java") & s.rlike("^Test|(Test|Tests|IT|Application)$")
    rust = (e == "rs") & (s.isin("lib", "build") | path.rlike("(^|/)(bin|tests|examples|benches)/"))
    return usual | java | rust


def enrich(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each path column adds its directory, file name, extension and (where known) language, unless such a column is there."""
    new = {}
    for c in columns:
        if c not in df.columns:
            continue
        for suffix, f in (("directory", parent), ("filename", file_name), ("extension", extension), ("language", display_language)):
            if f"{c}_{suffix}" not in df.columns:
                new[f"{c}_{suffix}"] = f(F.col(c))
    return df.withColumns(new) if new else df
