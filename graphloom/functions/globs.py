"""Glob patterns as regular expressions, and matchers with negation as column predicates.

In path globs ``*`` and ``?`` also match ``/``; ``**/`` matches any number of directories; ``[...]``, ``[!...]`` and
``{a,b}`` work as usual. Ignore files have other rules (``*`` stays inside a directory); see ``ignore_regex``.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """Anchored regular expression, good for Java and Python."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if pattern.startswith("/**", i) and i + 3 == len(pattern):
            out.append("/.*")
            i += 3
            continue
        if c == "*":
            while i + 1 < len(pattern) and pattern[i + 1] == "*":
                i += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                raise ValueError(f"unclosed [ in {pattern}")
            body = pattern[i + 1 : end]
            neg = body[0] in "!^"
            out.append("[" + ("^" if neg else "") + re.sub(r"([\\\[\]&^])", r"\\\1", body[neg:]) + "]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    if depth:
        raise ValueError(f"unclosed {{ in {pattern}")
    return "^" + "".join(out) + "$"


def matches_glob(path: Column, pattern: str) -> Column:
    return path.rlike("(?s)" + glob_regex(pattern))


def _any(path: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (matches_glob(path, p) for p in patterns), F.lit(False))


def file_matcher(path: Column, patterns: list[str]) -> Column:
    """True where any pattern matches and no pattern that begins with ``!`` does; without including patterns nothing matches."""
    take = [p for p in patterns if not p.startswith("!")]
    leave = [p[1:] for p in patterns if p.startswith("!")]
    return _any(path, take) & ~_any(path, leave)


def ignore_regex(line: str) -> tuple[str, bool] | None:
    """(regex, negated) of a line of an ignore file, for paths relative to its folder; None for blanks and comments."""
    line = line.rstrip("\n")
    if not line.strip() or line.startswith("#"):
        return None
    negated = line.startswith("!")
    pat = line[negated:].rstrip()
    only_dirs = pat.endswith("/")
    pat = pat.rstrip("/")
    anchored = "/" in pat
    pat = pat.lstrip("/")
    out, i = [], 0
    while i < len(pat):
        if pat.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif pat.startswith("/**", i) and i + 3 == len(pat):
            out.append("/.*")
            i += 3
        elif pat[i] == "*":
            out.append("[^/]*")
            i += 1
        elif pat[i] == "?":
            out.append("[^/]")
            i += 1
        elif pat[i] == "[" and "]" in pat[i + 2 :]:
            end = pat.index("]", i + 2)
            body = pat[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = end + 1
        else:
            out.append(re.escape(pat[i]))
            i += 1
    head = "^" if anchored else "^(?:.*/)?"
    return head + "".join(out) + ("/.*$" if only_dirs else "(?:/.*)?$"), negated


def ignored(path: Column, lines: list[str]) -> Column:
    """Whether an ignore file's lines leave out ``path``; the last line that matches decides."""
    out = F.lit(False)
    for line in lines:
        got = ignore_regex(line)
        if got:
            out = F.when(path.rlike(got[0]), F.lit(not got[1])).otherwise(out)
    return out
