"""Quality rules: word statistics and tokeniser fertility.

The base rules count words, symbols, repeated lines and words in repeated
3-word windows.  The fertility rule encodes the text with two public
vocabularies, one of pieces and one of bytes, and measures for each the
characters per token, the share of fallback tokens (single bytes of characters
that have no token) and the entropy of the tokens.

A language has a band for each measure, and so has a script.  Bands are fitted
on all documents that pass the base rules: the median and ``WIDTH`` times the
distance of the quartiles to either side, so that a band is as wide as the
language's own texts vary.  A text outside a band of its language is rejected;
a language of fewer than ``LEAST_DOCS`` such documents, or none, takes its
script's bands, and a script of fewer the wide ones of ``LIMITS``.

Measures are local to a row.  Quartiles come from counts of rounded values, one
row for each language, measure and value, summed before they are shuffled; no
texts are.

Defined cases: null or empty text has no words, fails the base rules and is not
kept; an unknown or null language takes its script's bands; a null id is a
document like others; repeated rows count each and give repeated results; an
empty table gives an empty result; other columns, whatever their names, are not
read (``keep`` keeps them).  Long runs of white space in long texts
are cut into parts of ``SPACE_RUN`` characters for the byte vocabulary, whose
pattern cannot take very long ones.  Texts that fail the base rules are not
encoded: their measures are null.
"""

from __future__ import annotations

import base64
import math
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TextBatch, gram_valid, grams, materialise, span_hashes, table, text_chunks, work_dir
from .pieces import MAX_MODEL_BYTES, Vocabulary, default_model

# Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Different tokens that a text's entropy is set against, at most.
MOST_DIFFERENT = 256
#: Distances of the quartiles that a band reaches to either side of the median.
WIDTH = 4.0
#: Documents of a language or script that bands are fitted on, at least.
LEAST_DOCS = 200
#: Languages whose bands are sent to all executors, at most; more meet the documents by a join.
MOST_SENT = 5_000
#: Longest run of white space that the byte vocabulary gets at once, of a text that is long enough to hold one it cannot take.
SPACE_RUN = 256
LONG_TEXT = 10_000

MEASURES = ("chars_per_token", "fallback_share", "token_entropy")
VOCABULARIES = ("piece", "byte")
#: Columns of the measures, in order.
MEASURED = tuple(f"{v}_{m}" for v in VOCABULARIES for m in MEASURES)
#: Least distance of the quartiles that a band is fitted to: 2 hundredths of the median, and this.
LEAST_SPREAD = {"chars_per_token": 0.02, "fallback_share": 0.02, "token_entropy": 0.01}

# Bands of scripts that too few documents have.  Characters per token:
# lowest and highest; fallback share: highest; token entropy, as a share of that of as
# many different tokens, MOST_DIFFERENT at most: lowest.
LIMITS = {
    "latin": (1.3, 6.5, 0.10, 0.45),
    "cyrillic": (0.8, 5.5, 0.40, 0.40),
    "greek": (0.8, 4.0, 0.60, 0.40),
    "han": (0.4, 2.5, 0.90, 0.40),
    "other": (0.2, 6.5, 1.00, 0.30),
}

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(SYMBOLS)] = 1


# The blocks of the scripts that have bands; letters elsewhere are of "other" scripts.
SCRIPTS = ("latin", "greek", "cyrillic", "han", "other")
BLOCKS = {
    "latin": ((0x41, 0x2AF), (0x1D00, 0x1D25), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA722, 0xA7FF), (0xAB30, 0xAB6F), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "han": ((0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF)),
}


@cache
def _scripts() -> np.ndarray:
    """For each code point, the place of its script in SCRIPTS; one more for what is no letter."""
    place = np.full(0x110000, SCRIPTS.index("other"), dtype=np.uint8)
    for name, blocks in BLOCKS.items():
        for low, high in blocks:
            place[low : high + 1] = SCRIPTS.index(name)
    place[[not chr(i).isalpha() for i in range(0x110000)]] = len(SCRIPTS)
    return place


def script(text: str) -> str:
    """The script of most letters, by Unicode block; scripts without a band count together, as "other"."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = np.bincount(_scripts()[codes], minlength=len(SCRIPTS))[: len(SCRIPTS)]
    return SCRIPTS[int(n.argmax())] if n.any() else "other"


def fertility(ids: np.ndarray, is_byte: np.ndarray, n_chars: int) -> tuple[float, float, float]:
    """Characters per token, byte share and relative entropy of the tokens."""
    if not len(ids):
        return 0.0, 0.0, 0.0
    ordered = np.sort(ids)
    edges = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True])))
    p = np.diff(edges) / len(ids)
    entropy = float(-(p * np.log2(p)).sum())
    return n_chars / len(ids), float(is_byte[ids].mean()), entropy / max(1.0, math.log2(min(len(ids), MOST_DIFFERENT)))


def base_counts(batch: TextBatch) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each document."""
    data, offsets = batch.data, batch.offsets
    starts, ends, bounds, hashes = batch.word_hashes()
    n_words = np.diff(bounds)
    doc = np.repeat(np.arange(len(batch)), n_words)
    per_byte = lambda marks: np.diff(np.concatenate(([0], np.cumsum(marks)))[offsets])
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[starts] = 1
    np.add.at(inside, ends, -1)
    in_word = np.cumsum(inside[:-1]).astype(bool)
    chars = per_byte(in_word & ((data & 0xC0) != 0x80))

    # words in 3-word windows that the document holds twice or more
    windows = grams(hashes, 3)
    ok = np.flatnonzero(gram_valid(bounds, len(starts), 3))
    covered = np.zeros(len(starts), dtype=bool)
    if len(ok):
        key = windows[ok] ^ (doc[ok].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        order = np.argsort(key, kind="stable")
        sorted_keys = key[order]
        same = sorted_keys[1:] == sorted_keys[:-1]
        twice = np.zeros(len(ok), dtype=bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        at = ok[twice]
        for j in range(3):
            covered[at + j] = True
    repeat = np.bincount(doc[covered], minlength=len(batch))

    # lines with a word, equal to an earlier line of the document
    newline = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate((offsets[:-1], newline + 1)))
    line_starts = line_starts[line_starts < len(data)]
    line_doc = np.searchsorted(offsets, line_starts, side="right") - 1
    line_ends = np.minimum(np.append(newline, len(data))[np.searchsorted(newline, line_starts)], offsets[line_doc + 1])
    full = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, line_doc = line_starts[full], line_ends[full], line_doc[full]
    key = span_hashes(data, line_starts, line_ends) ^ (line_doc.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    order = np.argsort(key, kind="stable")
    again = order[1:][key[order][1:] == key[order][:-1]] if len(order) else order
    dup_lines = np.bincount(line_doc[again], minlength=len(batch))
    return {"n_words": n_words, "word_chars": chars, "n_symbols": per_byte(_SYMBOL[data]), "n_dup_lines": dup_lines, "n_repeat_words": repeat}


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class ByteVocabulary:
    """A byte-level vocabulary as ranks; sent as its file's bytes, made once in a worker."""

    def __init__(self, data: bytes, pattern: str):
        self.data, self.pattern = data, pattern
        self._coder = None

    @classmethod
    def load(cls, path: str, pattern: str | None = None) -> ByteVocabulary:
        import public_tokenizers

        if os.path.getsize(path) > MAX_MODEL_BYTES:
            raise ValueError(f"{path} has more than {MAX_MODEL_BYTES} bytes")
        with open(path, "rb") as f:
            return cls(f.read(), pattern or public_tokenizers.PATTERN)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_coder": None}

    def _made(self):
        if self._coder is None:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.data.splitlines())}
            fallback = np.zeros(max(ranks.values()) + 1, dtype=bool)
            fallback[[i for t, i in ranks.items() if len(t) == 1 and t[0] >= 128]] = True
            self._coder = tiktoken.Encoding("byte", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={}), fallback
        return self._coder

    @property
    def is_fallback(self) -> np.ndarray:
        return self._made()[1]

    def encode(self, text: str | None) -> np.ndarray:
        coder = self._made()[0]
        if not text:
            return np.empty(0, dtype=np.int64)
        parts = LONG_SPACE.split(text) if len(text) >= LONG_TEXT and LONG_SPACE.search(text) else [text]
        return np.array([i for p in parts if p for i in coder.encode_ordinary(p)] if len(parts) > 1 else coder.encode_ordinary(text), dtype=np.int32)


LONG_SPACE = re.compile(rf"(\s{{{SPACE_RUN}}})")


def default_vocabularies() -> tuple[Vocabulary, ByteVocabulary]:
    """The 32k BPE model with byte fallback and the byte-level vocabulary for many languages."""
    import public_tokenizers

    return Vocabulary.load(default_model()), ByteVocabulary.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


class _Meter:
    """The measures of texts, by both vocabularies; the model's own library encodes them, as they are only measured."""

    def __init__(self, vocabularies: tuple[Vocabulary, ByteVocabulary]):
        import sentencepiece

        pieces, self.bytes = vocabularies
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=pieces.model)
        self.fallbacks = pieces.is_fallback, self.bytes.is_fallback

    def measure(self, texts: list[str]) -> list[tuple[float, ...]]:
        """MEASURED of each text, to three decimals."""
        out = []
        for text in texts:
            ids = np.array(self.pieces.encode(text), dtype=np.int32)
            both = *fertility(ids, self.fallbacks[0], len(text)), *fertility(self.bytes.encode(text), self.fallbacks[1], len(text))
            out.append(tuple(round(x, 3) for x in both))
        return out


def _failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])


_MEASURED_SCHEMA = f"base_failed boolean, script string, {', '.join(f'{m} double' for m in MEASURED)}"


def _measured(measures: list[tuple[float, ...]]) -> list[pa.Array]:
    return [pa.array([m[i] for m in measures], pa.float64()) for i in range(len(MEASURED))]


def measure(docs: DataFrame, vocabularies: tuple[Vocabulary, ByteVocabulary], id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """doc_id, lang, the base counts, base_failed, script and MEASURED of each document."""
    lang = F.col(f"`{lang_col}`").cast("string") if lang_col else F.lit(None).cast("string")
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), lang.alias("lang"))
    sent = docs.sparkSession.sparkContext.broadcast(vocabularies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = _Meter(sent.value)
        for chunk, part in text_chunks(batches):
            counts = base_counts(chunk)
            failed = _failed(counts)
            texts = [t or "" for t in part.column("text").to_pylist()]
            passing = iter(meter.measure([t for t, bad in zip(texts, failed, strict=True) if not bad]))
            measures = [(None,) * len(MEASURED) if bad else next(passing) for bad in failed]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("lang"), *(pa.array(counts[c].astype(np.int64)) for c in COUNTS), pa.array(failed), pa.array([script(t) for t in texts]), *_measured(measures)],
                names=["doc_id", "lang", *COUNTS, "base_failed", "script", *MEASURED],
            )

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, {', '.join(f'{c} long' for c in COUNTS)}, {_MEASURED_SCHEMA}")


def fit_bands(measured: DataFrame, width: float = WIDTH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """kind (lang or script), name, bands array<struct<low, high>> by MEASURED; measured(lang, script, base_failed, MEASURED...)."""
    values = F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("name"), F.lit(i).alias("i"), F.col(m).alias("value")) for kind in ("lang", "script") for i, m in enumerate(MEASURED)))
    counts = measured.where("NOT base_failed").select(F.inline(values)).where("name IS NOT NULL").groupBy("kind", "name", "i", "value").agg(F.count("*").alias("n"))
    fitted = counts.groupBy("kind", "name", "i").agg(F.sum("n").alias("docs"), F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n")).alias("q")).where(F.col("docs") >= least_docs)
    least = F.element_at(F.array(*(F.lit(LEAST_SPREAD[m]) for _ in VOCABULARIES for m in MEASURES)), F.col("i") + 1)
    middle = F.element_at("q", 2)
    spread = F.greatest(F.element_at("q", 3) - F.element_at("q", 1), middle * 0.02, least) * width
    which = F.col("i") % len(MEASURES)
    low = F.when(which == MEASURES.index("fallback_share"), -1.0).otherwise(middle - spread)
    high = F.when(which == MEASURES.index("token_entropy"), 9.0).otherwise(middle + spread)
    rows = fitted.select("kind", "name", F.struct("i", F.round(low, 4).alias("low"), F.round(high, 4).alias("high")).alias("band"))
    return rows.groupBy("kind", "name").agg(F.array_sort(F.collect_list("band")).alias("bands"))


def limits(script: Column) -> Column:
    """The bands of LIMITS of a script, in the form of fit_bands."""

    def bands(low: float, high: float, most: float, least: float) -> Column:
        pairs = ((low, high), (-1.0, most), (least, 9.0)) * len(VOCABULARIES)
        return F.array(*(F.struct(F.lit(i).alias("i"), F.lit(a).alias("low"), F.lit(b).alias("high")) for i, (a, b) in enumerate(pairs)))

    out = bands(*LIMITS["other"])
    for name, values in LIMITS.items():
        out = F.when(script == name, bands(*values)).otherwise(out)
    return out


def judged(measured: DataFrame, folder: str, width: float = WIDTH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """measured with ``kept``: whether the base rules and the bands of the language, or else of the script, let a document pass.

    measured is read twice: it should be a table.
    """
    bands = materialise(fit_bands(measured, width, least_docs), folder, "bands")
    sent = F.broadcast if bands.count() <= MOST_SENT else lambda x: x
    of = lambda kind: sent(bands.where(F.col("kind") == kind).select(F.col("name").alias(kind), F.col("bands").alias(f"__{kind}_bands")))
    told = measured.join(of("lang"), "lang", "left").join(of("script"), "script", "left")
    band = F.coalesce("__lang_bands", "__script_bands", limits(F.col("script")))
    inside = lambda i, m: F.col(m).between(F.element_at(F.col("__band"), i + 1)["low"], F.element_at(F.col("__band"), i + 1)["high"])
    ok = ~F.col("base_failed")
    for i, m in enumerate(MEASURED):
        ok = ok & inside(i, m)
    return told.withColumn("__band", band).withColumn("kept", F.coalesce(ok, F.lit(False))).drop("__band", "__lang_bands", "__script_bands")


def score(docs: DataFrame, vocabularies: tuple[Vocabulary, ByteVocabulary], folder: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", width: float = WIDTH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """One row for each document: the base counts, base_failed, script, MEASURED and kept.  Work tables go to ``folder``, which executors share."""
    found = judged(materialise(measure(docs, vocabularies, id_col, text_col, lang_col), folder, "measured"), folder, width, least_docs)
    return found.select("doc_id", *COUNTS, "base_failed", "script", *MEASURED, "kept")


def keep(docs: DataFrame, vocabularies: tuple[Vocabulary, ByteVocabulary], folder: str, text_col: str = "text", lang_col: str | None = "lang", width: float = WIDTH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """The documents that pass, in all their columns.

    Those that pass the base rules are written with their measures, so that
    texts are encoded once and never shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabularies)
    names = [f"__c{i}" for i in range(len(docs.columns))]
    text, lang = names[docs.columns.index(text_col)], names[docs.columns.index(lang_col)] if lang_col else None
    source = docs.toDF(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = _Meter(sent.value)
        for chunk, part in text_chunks(batches, text, text):
            left = part.filter(pa.array(~_failed(base_counts(chunk))))
            texts = left.column(text).to_pylist()
            columns = [pa.array(np.zeros(len(texts), dtype=bool)), pa.array([script(t) for t in texts], pa.string()), *_measured(meter.measure(texts))]
            yield pa.RecordBatch.from_arrays([*left.columns, *columns], names=[*names, "base_failed", "script", *MEASURED])

    schema = T.StructType([*source.schema.fields, *T.StructType.fromDDL(_MEASURED_SCHEMA).fields])
    measured = materialise(source.mapInArrow(run, schema), folder, "measured")
    measured = measured.withColumn("lang", F.col(lang).cast("string") if lang else F.lit(None).cast("string"))
    return judged(measured, folder, width, least_docs).where("kept").select(*names).toDF(*docs.columns)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), default_vocabularies(), work_dir(spark))
