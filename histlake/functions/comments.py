"""Comment stripping for duplicate search: one rule for all languages.

A line marker cuts the rest of its line; a block marker hides text up to its
closing one, over lines if need be.  The leftmost marker counts, a line marker
before a block marker at the same place.  Strings are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The markers.
LINE_MARKERS = ("//", "#", "--", ";", "%")
BLOCK_MARKERS = {"/*": "*/", "<!--": "-->", "--[[": "]]", "{-": "-}", '"""': '"""', "'''": "'''"}

_MARKER = re.compile("|".join(f"({group})" for group in ("|".join(map(re.escape, LINE_MARKERS)), "|".join(map(re.escape, BLOCK_MARKERS)))))


def strip_comments(lines: list[str]) -> list[str]:
    out, closing = [], None
    for line in lines:
        if closing is not None:
            _, found, line = line.partition(closing)
            if not found:
                out.append("")
                continue
            closing = None
        while mark := _MARKER.search(line):
            head = line[: mark.start()]
            if mark[1]:
                line = head
                break
            _, found, tail = line[mark.end() :].partition(BLOCK_MARKERS[mark[2]])
            if not found:
                closing, line = BLOCK_MARKERS[mark[2]], head
                break
            line = head + tail  # what comes together may be a marker again
        out.append(line)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def stripped(lines: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in lines:
        yield batch.map(lambda x: None if x is None else strip_comments(list(x)))
