"""Secret scans with multipart credential linking.

Base rules find whole-text matches of three kinds.  The linking step also
collects weak parts (short keys, user names, bare tokens, endpoints) that mean
nothing alone; an interval join within a scope reports a weak part only when
its complement lies within ``reach`` code points: a key identifier needs a
secret, a secret needs an identifier or an endpoint, an endpoint needs both a
secret and an identifier.  Scopes are blocks between blank lines.
A weak part that overlaps a base match adds nothing.

The join runs over the sorted parts of one document (binary search for the
nearest complement), so no pairs are emitted and no row is shuffled.

Defined cases: null text is empty text; a null id stays null; repeated rows
give repeated results; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ids_and_texts, table

# The base rules, in the order in which kinds sort.
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS = 12, 18
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Weak parts.
WEAK_ID = re.compile(r"""\b(?:access_?key(?:_?id)?|client_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", re.I | re.A)
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/=])(?=[A-Za-z0-9+/]*[0-9+/])[A-Za-z0-9+/]{40}={0,2}(?![A-Za-z0-9+/=])")
ENDPOINT = re.compile(r"""https?://[^\s"'<>]+|(?<![a-z0-9.-])[a-z0-9-]+(?:\.[a-z0-9-]+)+:[0-9]{2,5}\b""")
BLANK_LINE = re.compile(r"\n[ \t\r]*\n")

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def _base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches."""
    found = []
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def _weak(text: str) -> list[tuple[int, int, int]]:
    lower = text.lower()
    found = []
    if any(w in lower for w in ASSIGN_WORDS):
        found += [(m.start(), 4, m.end()) for m in ASSIGN.finditer(text) if 6 <= len(m[2]) < MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 3, m.end()) for m in ACCESS.finditer(text) if 10 <= len(m[0]) < MIN_ACCESS]
    if any(w in lower for w in ("access", "client", "user", "login")):
        found += [(m.start(), 3, m.end()) for m in WEAK_ID.finditer(text)]
    if "://" in text or ":" in text:
        found += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    return found


class _Spans:
    """Spans by start, and how far those up to each reach."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.spans = sorted(spans)
        self.most = list(accumulate((e for _, e in self.spans), max))

    def overlap(self, start: int, end: int) -> bool:
        i = bisect_left(self.spans, (end, -1))
        return i > 0 and self.most[i - 1] > start

    def near(self, start: int, end: int, low: int, high: int, reach: int) -> bool:
        """Whether a span inside [low, high) begins or ends within reach of [start, end), or holds it."""
        i = bisect_left(self.spans, (max(low, start - reach), -1))
        j = bisect_right(self.spans, (min(high - 1, end + reach), 1 << 60))
        # no span crosses a line's end, so those of earlier blocks end at low or before
        return i < j or i > 0 and self.most[i - 1] >= max(low + 1, start - reach)


def find_spans(text: str, reach: int) -> list[tuple[int, int, int]]:
    """(start, kind index, end), sorted: base matches and the weak parts that are linked."""
    base = _base(text)
    weak = _weak(text)
    if base or weak:
        weak += [(m.start(), 4, m.end()) for m in WEAK_SECRET.finditer(text)]
    if not weak:
        return sorted(base)
    # a weak part inside a base match adds nothing
    taken = _Spans((s, e) for s, _, e in base)
    weak = sorted({w for w in weak if not taken.overlap(w[0], w[2])})
    secrets = _Spans([(s, e) for s, k, e in base if k in (0, 2)] + [(s, e) for s, k, e in weak if k == 4])
    idents = _Spans([(s, e) for s, k, e in base if k == 1] + [(s, e) for s, k, e in weak if k == 3])
    ends = _Spans((s, e) for s, k, e in weak if k == 5)
    breaks = [m.start() for m in BLANK_LINE.finditer(text)]
    linked = []
    for s, k, e in weak:
        at = bisect_right(breaks, s)
        low, high = breaks[at - 1] if at else 0, breaks[at] if at < len(breaks) else len(text)
        has_secret = secrets.near(s, e, low, high, reach)
        if k == 3 and has_secret or k == 4 and (idents.near(s, e, low, high, reach) or ends.near(s, e, low, high, reach)) or k == 5 and has_secret and idents.near(s, e, low, high, reach):
            linked.append((s, k, e))
    return sorted(base + linked)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200) -> DataFrame:
    """doc_id and spans array<struct<kind, start, end>> by start, then kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find_spans(t or "", reach)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, type=pa.list_(SPAN))], names=["doc_id", "spans"])

    docs = ids_and_texts(docs, id_col, text_col)
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int>>")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op1_secret_scans(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
