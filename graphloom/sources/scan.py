"""Discovery of source files."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import globs, paths
from graphloom.schema import LANGUAGES

#: Never scanned.
SKIPPED = ("target/", "build/", ".gradle/", ".idea/", "*.class")
_SHORT = {"ts": "typescript", "js": "javascript", "py": "python", "rs": "rust", "java": "java"}


def languages(names: list[str]) -> list[str]:
    """Names or short forms as languages; unknown ones are left out."""
    known = set(LANGUAGES.values())
    return [x for x in (_SHORT.get(n, n) for n in names) if x in known]


#: Files of ignore rules in a folder, the later ones winning.
IGNORES = (".gitignore", ".ignore")


def _global_ignore() -> Path:
    return Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config", "git/ignore")


def ignore_lines(root: str) -> list[tuple[str, list[str]]]:
    """(folder below root, lines) of the ignore files of a local project: the user's, the repository's, those of folders above the root up to the repository's top, then the root's own from the outside in.

    Rules of folders above hold for the paths below; a rule anchored there loses the part of the path up to the root.
    """
    out, top = [], Path(root).resolve()
    for p in (_global_ignore(), Path(root, ".git/info/exclude")):
        if p.is_file():
            out.append(("", p.read_text().splitlines()))
    above = []
    while not (top / ".git").exists() and top.parent != top:
        top = top.parent
        above.append(top)
    if (top / ".git").exists():  # else the root is in no repository
        for folder in reversed(above):
            inner = Path(root).resolve().relative_to(folder).as_posix() + "/"
            for name in IGNORES:
                if (folder / name).is_file():
                    out.append(("", [x for line in (folder / name).read_text().splitlines() if (x := _below(line, inner)) is not None]))
    for p in sorted((x for name in IGNORES for x in Path(root).rglob(name)), key=lambda p: (len(p.parts), IGNORES.index(p.name))):
        rel = p.parent.relative_to(root).as_posix()
        out.append(("" if rel == "." else rel + "/", p.read_text().splitlines()))
    return out


def _below(line: str, inner: str) -> str | None:
    """A rule of a folder above as one of the folder ``inner`` below it; None where it can't hold there."""
    mark, body = ("!", line[1:]) if line.startswith("!") else ("", line)
    if "/" not in body.rstrip("/").lstrip("/") and not body.startswith("/"):
        return line
    body = body.lstrip("/")
    if inner.startswith(body.rstrip("/") + "/"):
        return mark + "**"  # the rule is about a folder that holds the root
    if body.startswith("**/"):
        return line
    return mark + "/" + body[len(inner) :] if body.startswith(inner) else None


def discover(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = (), langs: list[str] = (), ignores: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """(path, mtime, language, content) of the source files below ``root``; ``path`` is relative to it.

    Only files with the extension of a known language are listed and read. Overrides come before ignore files: of the
    skipped folders, the excludes and the includes, in this order, the last that matches decides. With any ``include``
    files that no override matches are left out; without one the last matching line of the ignore files decides.
    """
    suffixes = "*.{" + ",".join(LANGUAGES) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", suffixes).load(root)
    head = (root if "://" in root else "file:" + str(Path(root).resolve())).rstrip("/") + "/"
    full = F.regexp_replace("path", "^file:/+", "file:/")
    df = raw.withColumn("path", F.substring(full, F.lit(len(head) + 1), F.length(full)))
    p = F.col("path")
    gone = F.lit(bool(include))  # what no override matches
    if not include:
        for folder, lines in ignore_lines(root) if ignores is None and "://" not in root else ignores or []:
            inside = p.startswith(folder) if folder else F.lit(True)
            rest = F.substring(p, F.lit(len(folder) + 1), F.length(p))
            for line in lines:
                got = globs.ignore_regex(line)
                if got:
                    gone = F.when(inside & rest.rlike(got[0]), F.lit(not got[1])).otherwise(gone)
    for pattern, drop in [*((x, True) for x in (*SKIPPED, *exclude)), *((x, False) for x in include)]:
        got = globs.ignore_regex(pattern)
        if got:
            gone = F.when(p.rlike(got[0]), F.lit(drop != got[1])).otherwise(gone)
    df = df.where(~gone & ~p.startswith(".git/")).withColumn("language", paths.language(p)).where("language is not null")
    wanted = languages(list(langs))
    if wanted:
        df = df.where(F.col("language").isin(wanted))
    return df.select("path", F.unix_seconds("modificationTime").alias("mtime"), "language", F.col("content").cast("string").alias("content"))
