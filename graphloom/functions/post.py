"""Shaping of results: sort, limit, count, CSV and JSON, and a subset of jq as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sort_limit(df: DataFrame, by: list[str], reverse: bool = False, limit: int | None = None) -> DataFrame:
    """Sorted by columns, missing values last (first when reversed); with a limit Spark keeps only the top rows."""
    known = [c for c in by if c in df.columns]
    if known:
        df = df.orderBy(*(F.col(c).desc_nulls_first() if reverse else F.col(c).asc_nulls_last() for c in known))
    return df if limit is None else df.limit(limit)


def count_of(arrays: dict[str, DataFrame]) -> DataFrame:
    """One row: the rows of all result arrays together."""
    n = [d.agg(F.count("*").alias("n")) for d in arrays.values()]
    return n[0].select(reduce(lambda a, b: a + b, (x.scalar() for x in n[1:]), F.col("n")).alias("count"))


def iso_utc(seconds: Column) -> Column:
    """Seconds since 1970 as an ISO-8601 time in UTC, whatever the session's zone."""
    day = F.floor(seconds / 86400)
    rest = (seconds - day * 86400).cast("int")
    date = F.date_from_unix_date(day.cast("int")).cast("string")
    return F.format_string("%sT%02d:%02d:%02dZ", date, (rest / 3600).cast("int"), (rest % 3600 / 60).cast("int"), rest % 60)


#: The order in which a command lists the rows of each result array.
ORDER = {
    "imports": ("depth", "path"), "imported_by": ("depth", "path"), "edges": ("src_path", "dst_path"), "dead_files": ("path",), "dead_exports": ("path", "exported_name"), "dead_symbols": ("file_id", "name"),
    "affected": ("depth", "path"), "by_depth": ("depth",), "directories": ("directory",), "changes": ("path", "change", "exported_name"), "limitations": ("description",),
}


def in_order(name: str, df: DataFrame) -> DataFrame:
    """A result array in its usual order."""
    return df.orderBy(*ORDER[name]) if name in ORDER else df


def _cell(f: T.StructField) -> Column:
    if isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, (T.StructType, T.ArrayType)):
        return F.array_join(F.col(f.name).cast("array<string>"), ";")
    if isinstance(f.dataType, (T.StructType, T.MapType, T.ArrayType)):
        return F.to_json(f.name)
    return F.col(f.name)


def csv_rows(arrays: dict[str, DataFrame]) -> DataFrame:
    """All result arrays as one table: columns are the sorted union of theirs, arrays are joined by ``;``, nested values are JSON."""
    flat = [d.select(*(_cell(f).alias(f.name) for f in d.schema)) for d in arrays.values()]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), flat)
    return whole.select(*sorted(whole.columns))


def write_csv(arrays: dict[str, DataFrame], path: str) -> None:
    csv_rows(arrays).write.mode("overwrite").option("header", True).option("nullValue", "").option("escape", '"').csv(path)


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def text_rows(df: DataFrame, template: str) -> DataFrame:
    """One line of text per row, from a template with ``{column}``."""
    parts = re.split(r"\{(\w+)\}", template)
    cells = [F.lit(x) if i % 2 == 0 else F.coalesce(_cell(df.schema[x]).cast("string"), F.lit("")) for i, x in enumerate(parts)]
    return df.select(F.concat(*cells).alias("line"))


# ------------------------------------------------------------------ jq

_TOKEN = re.compile(r'\s*(?:(?P<str>"(?:[^"\\]|\\.)*")|(?P<num>-?\d+(?:\.\d+)?)|(?P<op>==|!=|<=|>=|[|.,(){}\[\]<>:])|(?P<word>[A-Za-z_]\w*))')


class _Jq:
    """Programs of the form ``.[] | select(...) | {a, b: .c}``, ``.[] | .a``, ``map(...)``, ``length``, ``sort_by(.a)``, ``unique``, ``first``, ``limit(n; ...)``."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"jq: can't read {text[at:]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.i = 0

    def peek(self, value: str | None = None):
        t = self.tokens[self.i] if self.i < len(self.tokens) else (None, None)
        return t if value is None else t[1] == value

    def take(self, value: str | None = None) -> str:
        kind, got = self.peek()
        if got is None or (value is not None and got != value):
            raise ValueError(f"jq: expected {value or 'more'}, got {got}")
        self.i += 1
        return got

    def path(self) -> Column:
        self.take(".")
        col = F.col(self.take())
        while self.peek("."):
            self.take(".")
            col = col[self.take()]
        return col

    def value(self) -> Column:
        kind, got = self.peek()
        if got == ".":
            return self.path()
        if got == "(":
            self.take()
            out = self.condition()
            self.take(")")
            return out
        self.take()
        if kind == "str":
            return F.lit(got[1:-1].replace('\\"', '"'))
        if kind == "num":
            return F.lit(float(got) if "." in got else int(got))
        if got in ("true", "false"):
            return F.lit(got == "true")
        if got == "null":
            return F.lit(None)
        raise ValueError(f"jq: {got} isn't supported")

    def term(self) -> Column:
        left = self.value()
        while self.peek("|"):
            self.take()
            name = self.take()
            if name == "length":
                left = F.length(left)
            elif name == "not":
                left = ~left
            elif name in ("startswith", "endswith", "contains", "test"):
                self.take("(")
                arg = self.take()[1:-1]
                self.take(")")
                left = {"startswith": left.startswith, "endswith": left.endswith, "contains": left.contains, "test": left.rlike}[name](arg)
            else:
                raise ValueError(f"jq: {name} isn't supported here")
        op = self.peek()[1]
        if op in ("==", "!=", "<", "<=", ">", ">="):
            self.take()
            right = self.value()
            return {"==": left.eqNullSafe(right), "!=": ~left.eqNullSafe(right), "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]
        return left

    def condition(self) -> Column:
        out = self.term()
        while self.peek()[1] in ("and", "or"):
            op, right = self.take(), self.term()
            out = (out & right) if op == "and" else (out | right)
        return out

    def stage(self, df: DataFrame) -> DataFrame:
        kind, got = self.peek()
        if got == ".":
            nxt = self.tokens[self.i + 1 : self.i + 3]
            if [t[1] for t in nxt] == ["[", "]"]:
                self.i += 3
                return df
            if not nxt or nxt[0][1] in ("|", None):
                self.take()
                return df
            name = nxt[0][1]
            return df.select(self.path().alias(name))
        if got == "{":
            self.take()
            out = []
            while not self.peek("}"):
                name = self.take().strip('"')
                if self.peek(":"):
                    self.take()
                    out.append(self.condition().alias(name))
                else:
                    out.append(F.col(name))
                if self.peek(","):
                    self.take()
            self.take("}")
            return df.select(*out)
        word = self.take()
        if word == "length":
            return df.agg(F.count("*").alias("length"))
        if word == "unique":
            return df.distinct()
        if word == "first":
            return df.limit(1)
        self.take("(")
        if word == "select":
            df = df.where(self.condition())
        elif word == "map":
            while not self.peek(")"):
                df = self.stage(df)
                if self.peek("|"):
                    self.take()
        elif word == "sort_by":
            df = df.orderBy(self.path().asc_nulls_first())
        else:
            raise ValueError(f"jq: {word} isn't supported")
        self.take(")")
        return df

    def run(self, df: DataFrame) -> DataFrame:
        df = self.stage(df)
        while self.i < len(self.tokens):
            self.take("|")
            df = self.stage(df)
        return df


def jq(df: DataFrame, program: str) -> DataFrame:
    """The rows of ``df`` (a result array) run through a jq program; what isn't supported raises ValueError."""
    return _Jq(program).run(df)
