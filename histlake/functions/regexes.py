"""Regexes: the pattern dialect of history queries on Spark's engine.

Patterns follow the RE2 family: no look-around, no back-references, ``$`` only
at the very end, ``.`` stops at line feeds only, classes are Unicode-aware.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

FLAGS = "(?dU)"
_REFUSED = (
    (re.compile(r"\(\?<?[=!]"), "look-around"),
    (re.compile(r"\\[1-9]"), "back-references"),
    (re.compile(r"\\k<|\(\?P=|\(\?>|[*+?}]\+"), "back-references, atomic groups or possessive repeats"),
)


def _plain(pattern: str) -> str:
    """The pattern with escaped characters and classes blanked, for looking at its syntax."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append("  " if inside or not pattern[i + 1].isalnum() else pattern[i : i + 2])
            i += 2
            continue
        if inside:
            inside = c != "]"
            out.append(" ")
        else:
            inside = c == "["
            out.append(" " if inside else c)
        i += 1
    return "".join(out)


def exact(pattern: str) -> str:
    """The pattern as a whole word."""
    return rf"\b(?:{pattern})\b"


def compile(spark: SparkSession, pattern: str, whole_word: bool = False) -> str:
    """The pattern as Spark takes it; a ValueError if it is not valid here."""
    wanted = exact(pattern) if whole_word else pattern
    seen = _plain(wanted)
    for refused, what in _REFUSED:
        if refused.search(seen):
            raise ValueError(f"invalid regex: {what} are not supported")
    if not re.search(r"\(\?[a-zA-Z]*m", seen):
        wanted = "".join(r"\z" if s == "$" else c for c, s in zip(wanted, seen, strict=True))
    wanted = wanted.replace("(?P<", "(?<")
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(FLAGS + wanted)
    except Exception as e:
        raise ValueError(f"invalid regex: {str(e).splitlines()[0]}") from None
    return FLAGS + wanted
