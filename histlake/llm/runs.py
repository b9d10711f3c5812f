"""Periodic runs of words: heavy and light lag counting, then scans of the lags that can hold a run.

A run is a longest stretch of consecutive words whose words ``q`` apart are
identical, ``q`` its smallest period, of ``max(shortest, 2 * q)`` words or
more.  A run of period q needs ``max(shortest - q, q)`` matches at lag q, so
the matches of every lag are counted first.  Words that occur often in their
document are counted by FFT, as the autocorrelation of where they are; the
others by the differences of their places.  What is often follows the length of
the document (about the square root of n log n), so a document costs about
n ** 1.5 at most, whatever its words.

Lags with enough matches are scanned for islands, the stretches of matches.  An
island of m places holds a whole block of half as many at a multiple of that,
so blocks are probed place by place and only full ones are grown.  Blocks inside
a run whose period divides the lag are that run again and are passed over; a
run has at most its length over its period such lags, so a document of one
repeated word costs no more than another.

Counting and probing go over all documents of a batch at once.  Words are
compared as numbers that are the same only for the same bytes of one document.

Row-local: nothing is shuffled, memory is bounded by the batch (CHUNK_WORDS)
or, beyond it, by one document.

Defined cases: null and empty texts have no words and no run; a null id is no
id whose words are replaced; repeated rows give repeated results; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ids_and_texts, table

SHORTEST = 12
#: Words that are handled at once, unless one document has more.
CHUNK_WORDS = 1 << 17
#: Pairs of places that are counted at once.
COUNTED = 1 << 20
#: Places that are compared word by word before blocks are compared whole.
PROBED = 8

Run = tuple[int, int, int]


def heavy_count(n: int) -> int:
    """Words that occur more often than this in a document of n words are counted by FFT."""
    return max(16, int((n * max(1, n.bit_length())) ** 0.5))


def lag_counts(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matches at lags 1 to n // 2 of each document, and where each document's lags begin (len + 1).

    words: numbers, those of different documents different; bounds: where documents begin (len + 1).
    """
    sizes = np.diff(bounds)
    half = sizes // 2
    begins = np.concatenate([[0], np.cumsum(half)])
    counts = np.zeros(begins[-1], dtype=np.int64)
    if not len(words):
        return counts, begins
    order = np.argsort(words, kind="stable")
    ordered = words[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    often = np.diff(np.append(first, len(ordered)))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    most = np.array([heavy_count(n) for n in sizes.tolist()], dtype=np.int64)
    heavy = often > most[doc[order[first]]]
    # light: the step-th next place of the same word, for growing steps
    later = np.repeat(first + often, often) - 1 - np.arange(len(ordered))
    later[np.repeat(heavy, often)] = 0
    at, step = np.flatnonzero(later), 1
    held: list[np.ndarray] = []
    total = 0
    while len(at):
        places = order[at]
        lags = order[at + step] - places
        of = doc[places]
        near = lags <= half[of]
        held.append(begins[of[near]] + lags[near] - 1)
        total += len(held[-1])
        step += 1
        # places of a word ascend, so farther ones are farther
        at = at[near & (later[at] >= step)]
        if total > COUNTED or not len(at):
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
            held, total = [], 0
    by_doc = defaultdict(list)
    for g in np.flatnonzero(heavy).tolist():
        by_doc[int(doc[order[first[g]]])].append(order[first[g] : first[g] + often[g]])
    for d, groups in by_doc.items():
        n, lags = int(sizes[d]), int(half[d])
        width = 1 << (n + lags).bit_length()
        power = np.zeros(width // 2 + 1)
        for places in groups:
            there = np.zeros(width)
            there[places - bounds[d]] = 1
            spectrum = np.fft.rfft(there)
            power += spectrum.real**2 + spectrum.imag**2
        counts[begins[d] : begins[d + 1]] += np.rint(np.fft.irfft(power, width)[1 : lags + 1]).astype(np.int64)
    return counts, begins


def _same(words: np.ndarray, a: int, b: int, most: int) -> int:
    """How many words from a on equal those from b on, most at most."""
    done, size = 0, 64
    while done < most:
        size = min(size, most - done)
        differ = words[a + done : a + done + size] != words[b + done : b + done + size]
        if differ.any():
            return done + int(differ.argmax())
        done += size
        size *= 2
    return done


def _same_before(words: np.ndarray, a: int, b: int, most: int) -> int:
    """How many words before a equal those before b, most at most."""
    done, size = 0, 64
    while done < most:
        size = min(size, most - done)
        differ = words[a - done - size : a - done][::-1] != words[b - done - size : b - done][::-1]
        if differ.any():
            return done + int(differ.argmax())
        done += size
        size *= 2
    return done


def find_runs(words: np.ndarray, bounds: np.ndarray, shortest: int = SHORTEST) -> list[list[Run]]:
    """(start, length, period) of the runs of each document, by start, then period; arguments as for lag_counts."""
    sizes = np.diff(bounds)
    counts, begins = lag_counts(words, bounds)
    doc = np.repeat(np.arange(len(sizes)), np.diff(begins))
    lag = np.arange(len(counts)) - begins[doc] + 1
    enough = np.flatnonzero(counts >= np.maximum(shortest - lag, lag))
    enough = enough[np.argsort(lag[enough], kind="stable")]
    lags, docs = lag[enough], doc[enough]
    cuts = np.flatnonzero(np.diff(lags, prepend=0))  # the first lag is 1 or more
    ends = np.append(cuts, len(lags))[1:]
    runs: list[list[Run]] = [[] for _ in sizes]
    inside: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by multiples of their periods: the runs
    for i, j in zip(cuts.tolist(), ends.tolist(), strict=True):
        q = int(lags[i])
        need = max(shortest - q, q)
        block = (need + 1) // 2
        held = docs[i:j]
        probes = np.maximum((sizes[held] - q - block) // block + 1, 0)
        before = np.cumsum(probes) - probes
        at = np.repeat(bounds[held] - before * block, probes) + np.arange(int(probes.sum())) * block
        known = inside.pop(q, ())
        if known:
            keep = np.ones(len(at), dtype=bool)
            for a, b in known:
                keep[np.searchsorted(at, a) : np.searchsorted(at, b - block - q, side="right")] = False
            at = at[keep]
        for k in range(min(block, PROBED)):
            if not len(at):
                break
            at = at[words[at + k] == words[at + k + q]]
        done = -1
        for a in at.tolist():
            if a < done or block > PROBED and _same(words, a + PROBED, a + PROBED + q, block - PROBED) < block - PROBED:
                continue
            d = int(np.searchsorted(bounds, a, side="right")) - 1
            low, high = int(bounds[d]), int(bounds[d + 1])
            start = a - _same_before(words, a, a + q, a - low)
            done = a + block + _same(words, a + block, a + block + q, high - q - a - block)
            if done - start >= need:
                runs[d].append((start - low, done - start + q, q))
                for multiple in range(2 * q, done - start + q, q):
                    inside[multiple].append((start, done + q))
    for found in runs:
        found.sort(key=lambda r: (r[0], r[2]))
    return runs


def collapsed(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words stay: those of no run, and of each run the first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return np.flatnonzero(np.cumsum(change[:n]) == 0)


Places = Callable[[object, int], np.ndarray | None]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, places: Places | None = None) -> DataFrame:
    """doc_id, runs array<struct<start, length, period>> by start, then period, and text, what stays of it: words joined by one space.

    places(id, n) may name, for each of a document's n words, the original word that stands there.
    """

    def finished(ids: list, id_type: pa.DataType, texts: list[list[bytes]], numbers: list[np.ndarray], at: list[np.ndarray | None]) -> pa.RecordBatch:
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in numbers])]).astype(np.int64)
        above = np.concatenate([[0], np.cumsum([len(x) and int(x.max()) + 1 for x in numbers])])
        words = np.concatenate([x + k for x, k in zip(numbers, above[:-1], strict=True)]) if numbers else np.empty(0, dtype=np.int64)
        found = find_runs(words, bounds, shortest)
        kept = []
        for text, where, runs in zip(texts, at, found, strict=True):
            if runs or where is not None:
                stay = collapsed(len(text), runs)
                text = [text[i] for i in (stay if where is None else where[stay]).tolist()]
            kept.append(b" ".join(text).decode())
        told = [[{"start": a, "length": n, "period": q} for a, n, q in runs] for runs in found]
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(told, runs_type), pa.array(kept, pa.large_string()).cast(pa.string())], names=["doc_id", "runs", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, numbers, at, total = [], [], [], [], 0
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                split = (text.as_py() or "").encode().split()
                known: dict[bytes, int] = {}
                number = np.array([known.setdefault(w, len(known)) for w in split], dtype=np.int64)
                where = places(key, len(split)) if places and split and key is not None else None
                ids.append(key)
                texts.append(split)
                numbers.append(number if where is None else number[where])
                at.append(where)
                total += len(split)
                if total >= CHUNK_WORDS:
                    yield finished(ids, id_type, texts, numbers, at)
                    ids, texts, numbers, at, total = [], [], [], [], 0
        if ids:
            yield finished(ids, id_type, texts, numbers, at)

    runs_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    docs = ids_and_texts(docs, id_col, text_col)
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, runs array<struct<start:long,length:long,period:long>>, text string")


def planted_period(doc_id: int, n: int) -> np.ndarray | None:
    """The words of one document in ten, by the checksum of its id: from a place on, a stretch of the original words again and again."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), places=planted_period)
    # greatest length, then smallest start, then smallest period
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    out = found.select("doc_id", "runs", "text", F.when(F.size("runs") > 0, best).alias("best"))
    start, length, period = F.col("best.start"), -F.col("best.n"), F.col("best.period")
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("(1000 * -best.n) div best.period").alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )
