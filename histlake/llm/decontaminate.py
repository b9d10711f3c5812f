"""Benchmark decontamination: a BM25 index of the test items, queried by every training passage.

Each item's impacts (BM25 weights of its terms) are divided by their sum, so an
item's whole text scores 1 and one threshold serves all items.  The index is
made as tables: terms and grams of each item, the number of items of each term,
impacts.  It is laid out for block-max WAND: of each item the terms of least
impact, REST of its score at most, are left out of the inverted lists, so a
passage that reaches the threshold must meet it in the others; lists are cut
into blocks of BLOCK postings, of which only the largest impact is kept.

Each passage of a document (overlapping spans of words, so that an item lies
whole in one) sums the block maxima of its terms for each item it meets; only
items whose bound, with what the left-out terms can add, reaches the threshold
are scored from their own impacts, and all at or above the threshold are
retrieved.  A retrieved item counts as leaked when the passage holds enough of
the 3-grams of its question and of its answer.

Items are parted by length, and passages are as long as a class of items needs:
so how much of a document an item is looked for in at once depends on its own
length and on no other item's.

Bounds and scores are numpy over a whole batch of passages; documents are not
shuffled.  The index is broadcast in parts of ``INDEX_BYTES``, which are counted
first; a benchmark of several parts takes as many passes over the documents.

Defined cases: null or empty text has no passage and is clean; items of null or
empty text leak nothing; items whose id is null leak like others, each with its
own row and a null item_id; repeated rows give repeated results; equal items are
reported each; an empty table or benchmark gives an empty result; other columns
are not read (``clean`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_LETTER, TextBatch, grams, ids_and_texts, materialise, table, text_chunks, work_dir

K1, B = 1.2, 0.75
#: Postings of a block.
BLOCK = 16
#: The share of an item's score that the terms outside the lists may hold.
REST = 0.3
#: Bytes of the index that one pass broadcasts, at most (a single larger item makes a pass of its own).
INDEX_BYTES = 128 << 20
LEAST_SCORE = 0.5
LEAST_OVERLAP = 0.5
GRAM = 3
#: Words of a passage step at least; a passage is two steps, and a step holds the longest item of its class.
STEP_WORDS = 64
#: Postings, and terms of items, that are looked at at once.
ROUND = 1 << 20
SLACK = 1e-6


def _folded(texts: Iterable[str]) -> TextBatch:
    """Items in lower case, as documents are."""
    return TextBatch(None, pc.utf8_lower(pa.array(list(texts), pa.large_string())))


def _grams_of(words: np.ndarray) -> tuple[np.ndarray, int]:
    """The distinct grams of a part of an item, and their size: shorter where the part is."""
    size = min(GRAM, len(words))
    return (np.unique(grams(words, size)), size) if size else (np.empty(0, dtype=np.uint64), 0)


def _cut(text: str, n: int) -> int:
    """The words of an item's question: up to the last question mark inside, else two thirds."""
    if "?" in text.strip()[:-1]:
        return len(_folded([text[: text.rstrip().rindex("?", 0, len(text.rstrip()) - 1)]]).words(NOT_LETTER)[0])
    return n - max(n // 3, min(n, GRAM))


def step_of(n: int) -> int:
    """The step of the passages that an item of n words is looked for in: STEP_WORDS, doubled until it holds the item."""
    return STEP_WORDS << (max(1, -(-n // STEP_WORDS)) - 1).bit_length()


ITEMS = "uid long, item long, n long, step long, terms array<long>, times array<int>, question array<long>, question_size int, answer array<long>, answer_size int"


def _items(benchmark: DataFrame) -> DataFrame:
    """ITEMS: the distinct terms of each item and how often it has them, the grams of its parts; benchmark(uid, item, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            _, _, bounds, words = _folded(texts).word_hashes(NOT_LETTER)
            out: list[list] = [[] for _ in range(8)]
            for text, a, b in zip(texts, bounds, bounds[1:], strict=False):
                mine, cut = words[a:b], _cut(text, int(b - a))
                terms, times = np.unique(mine, return_counts=True)
                (one, n_one), (two, n_two) = _grams_of(mine[:cut]), _grams_of(mine[cut:])
                for column, value in zip(out, (len(mine), step_of(len(mine)), terms.view(np.int64), times, one.view(np.int64), n_one, two.view(np.int64), n_two), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int64()), pa.int32())
            names = ["n", "step", "terms", "times", "question", "question_size", "answer", "answer_size"]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("item"), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names=["uid", "item", *names])

    return benchmark.mapInArrow(run, ITEMS)


def index_table(benchmark: DataFrame, folder: str, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The index as a table: ITEMS and impacts array<double>, in the order of terms, which sum to 1."""
    source = benchmark.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").cast("long").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))
    items = materialise(_items(source.where("text IS NOT NULL")), folder, "items").where("n > 0")
    n, mean = items.agg(F.count("*"), F.avg("n")).first()
    postings = items.select("uid", "n", F.explode(F.arrays_zip("terms", "times")).alias("p")).select("uid", "n", "p.terms", "p.times")
    frequency = postings.groupBy("terms").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("times")
    weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n") / F.lit(mean or 1.0)))
    weighted = postings.join(frequency, "terms").select("uid", F.struct(F.col("terms").alias("term"), weight.alias("weight")).alias("p")).groupBy("uid").agg(F.array_sort(F.collect_list("p")).alias("p"))
    # terms are sorted as unsigned in an item, as signed by array_sort: take them from here
    total = F.aggregate("p", F.lit(0.0).cast("double"), lambda s, x: s + x["weight"])
    impacts = F.transform("p", lambda x: x["weight"] / total)
    held = items.drop("terms", "times").join(weighted.select("uid", F.transform("p", lambda x: x["term"]).alias("terms"), impacts.alias("impacts")), "uid")
    return materialise(held, folder, "index")


class Grams:
    """The grams of passages, the words [first, end) of a batch's words, looked up by size, passage and gram."""

    def __init__(self, words: np.ndarray, first: np.ndarray, end: np.ndarray):
        self._words, self._first, self._end = words, first, end
        self._all: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._own: dict[int, np.ndarray] = {}
        self._asked = first[:0]

    def ask(self, passages: np.ndarray) -> Grams:
        """From here on these passages are looked up."""
        self._asked, self._own = np.unique(passages), {}
        return self

    def have(self, size: int, passages: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Whether each passage has the gram beside it."""
        if size not in self._all:
            self._all[size] = np.unique(grams(self._words, size), return_inverse=True)
        values, place = self._all[size]
        if size not in self._own:
            begin = self._first[self._asked]
            n = np.maximum(self._end[self._asked] - begin - size + 1, 0)
            at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            self._own[size] = np.unique(np.repeat(self._asked, n) * max(1, len(values)) + place[at])
        keys = self._own[size]
        if not len(keys):
            return np.zeros(len(wanted), dtype=bool)
        at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
        key = passages * len(values) + at
        return (values[at] == wanted) & (keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key)


class ItemIndex:
    """Lists of postings with block maxima, and the items' own terms, impacts and grams, as arrays."""

    def __init__(self, rows: pa.Table):
        column = lambda c: rows.column(c).combine_chunks()
        lists = lambda c, kind: (np.asarray(column(c).flatten()).astype(kind, copy=False), np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(column(c))).astype(np.int64)))))
        self.ids = column("item").to_pylist()
        terms, self.item_bounds = lists("terms", np.int64)
        self.impacts, _ = lists("impacts", np.float64)
        self.terms, self.item_terms = np.unique(terms.view(np.uint64), return_inverse=True)
        self.parts = [(*lists(c, np.int64), np.asarray(column(f"{c}_size"))) for c in ("question", "answer")]
        item = np.repeat(np.arange(rows.num_rows), np.diff(self.item_bounds))
        # each item's terms by impact, least first: those that hold REST together stay out of the lists
        order = np.lexsort((self.impacts, item))
        upto = np.cumsum(self.impacts[order])
        upto -= np.concatenate(([0.0], upto))[self.item_bounds[:-1]][item[order]]
        out = np.zeros(len(item), dtype=bool)
        out[order] = upto <= REST
        self.rest = np.bincount(item[out], weights=self.impacts[out], minlength=rows.num_rows)
        listed = np.flatnonzero(~out)
        listed = listed[np.lexsort((item[listed], self.item_terms[listed]))]
        self.postings = item[listed].astype(np.int32)
        self.begins = np.searchsorted(self.item_terms[listed], np.arange(len(self.terms) + 1))
        cuts = np.arange(0, len(listed), BLOCK)
        self.most = np.maximum.reduceat(self.impacts[listed], cuts) if len(listed) else np.empty(0)

    def overlaps(self, held: Grams, passages: np.ndarray, items: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the pairs reach least in both parts, and the shares of the items' question and answer grams that their passages hold.

        A part that is empty agrees with the other.  The answers are looked at
        only where the questions suffice.
        """
        left, shares = np.arange(len(items)), []
        for values, bounds, sizes in self.parts:
            item, passage = items[left], passages[left]
            n = bounds[item + 1] - bounds[item]
            each = np.repeat(np.arange(len(item)), n)
            own = np.repeat(bounds[item] - (np.cumsum(n) - n), n) + np.arange(len(each))
            hit = np.zeros(len(each), dtype=bool)
            size = sizes[item][each]
            for k in np.unique(size).tolist():
                mine = np.flatnonzero(size == k)
                hit[mine] = held.have(k, passage[each[mine]], values[own[mine]].view(np.uint64))
            share = np.bincount(each, weights=hit, minlength=len(item)) / np.maximum(n, 1)
            share[n == 0] = np.nan
            enough = np.isnan(share) | (share >= least)
            shares = [x[enough] for x in shares] + [share[enough]]
            left = left[enough]
        known = np.fmax(*shares)  # nan where both are empty: never enough
        question, answer = (np.where(np.isnan(x), known, x) for x in shares)
        enough = (question >= least) & (answer >= least)
        return left[enough], question[enough], answer[enough]

    def retrieve(self, passage: np.ndarray, term: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(passage, item, score) of all that reach least; the distinct terms of passages, sorted by passage, then term."""
        key = passage * len(self.terms) + term
        counts = self.begins[term + 1] - self.begins[term]
        edges = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
        load = np.add.reduceat(counts, edges)
        low = 0
        while low < len(edges):  # whole passages, as many as have ROUND postings
            high = max(low + 1, low + int(np.searchsorted(np.cumsum(load[low:]), ROUND, side="right")))
            a, b = edges[low], edges[high] if high < len(edges) else len(passage)
            low = high
            n = counts[a:b]
            row = np.repeat(np.arange(a, b), n)
            if not len(row):
                continue
            at = np.repeat(self.begins[term[a:b]] - (np.cumsum(n) - n), n) + np.arange(len(row))
            pair = passage[row] * len(self.ids) + self.postings[at]
            order = np.argsort(pair, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], pair[order][1:] != pair[order][:-1])))
            bound = np.add.reduceat(self.most[at[order] // BLOCK], first)
            pairs = pair[order[first]]
            pairs = pairs[bound + self.rest[pairs % len(self.ids)] >= least - SLACK]
            for begin in range(0, len(pairs), max(1, ROUND // 64)):
                part = pairs[begin : begin + max(1, ROUND // 64)]
                found, item = part // len(self.ids), part % len(self.ids)
                n = self.item_bounds[item + 1] - self.item_bounds[item]
                each = np.repeat(np.arange(len(part)), n)
                own = np.repeat(self.item_bounds[item] - (np.cumsum(n) - n), n) + np.arange(len(each))
                wanted = found[each] * len(self.terms) + self.item_terms[own]
                place = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
                score = np.bincount(each, weights=np.where(key[place] == wanted, self.impacts[own], 0.0), minlength=len(part))
                hit = score >= least - SLACK
                yield found[hit], item[hit], score[hit]


def _cells(bounds: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, last word (exclusive) and document of the steps that documents are cut into."""
    n = np.diff(bounds)
    counts = -(-n // step)
    doc = np.repeat(np.arange(len(n)), counts)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = bounds[doc] + within * step
    return first, np.minimum(first + step, bounds[doc + 1]), doc


Leaks = dict[tuple[int, int, int], tuple[float, float, float]]


def find(batch: TextBatch, indexes: list[tuple[ItemIndex, int]], least_score: float, least_overlap: float) -> Leaks:
    """(document's place in the batch, index's place, item's place in it) -> best (score, question overlap, answer overlap) of the leaked items; indexes have their steps."""
    _, _, bounds, words = batch.word_hashes(NOT_LETTER)
    out: Leaks = {}
    for k, (index, step) in enumerate(indexes):
        out |= {(d, k, i): best for (d, i), best in _find(words, bounds, index, step, least_score, least_overlap).items()}
    return out


def _find(words: np.ndarray, bounds: np.ndarray, index: ItemIndex, step: int, least_score: float, least_overlap: float) -> dict[tuple[int, int], tuple[float, float, float]]:
    first, last, doc = _cells(bounds, step)
    out: dict[tuple[int, int], tuple[float, float, float]] = {}
    if not len(first) or not len(index.terms):
        return out
    # a passage is a cell and the next one of the same document
    joined = np.zeros(len(first), dtype=bool)
    joined[:-1] = doc[1:] == doc[:-1]
    end = last.copy()
    end[:-1] = np.where(joined[:-1], last[1:], last[:-1])
    place = np.searchsorted(index.terms, words)
    place[place == len(index.terms)] = 0
    at = np.flatnonzero(index.terms[place] == words)
    # the distinct terms of each passage: a word lies in its cell's passage and in the one before
    cell = np.searchsorted(first, at, side="right") - 1
    before = (cell > 0) & joined[np.maximum(cell - 1, 0)]
    key = np.unique(np.concatenate((cell, cell[before] - 1)) * len(index.terms) + np.concatenate((place[at], place[at][before])))
    if not len(key):
        return out
    held = Grams(words, first, end)
    for passages, items, scores in index.retrieve(key // len(index.terms), key % len(index.terms), least_score):
        found, question, answer = index.overlaps(held.ask(passages), passages, items, least_overlap)
        for p, item, *best in zip(passages[found].tolist(), items[found].tolist(), scores[found].tolist(), question.tolist(), answer.tolist(), strict=True):
            name = int(doc[p]), item
            out[name] = max(out.get(name, (0.0, 0.0, 0.0)), tuple(best))
    return out


def _passes(spark: SparkSession, benchmark: DataFrame, folder: str, id_col: str, text_col: str) -> Iterator:
    """Broadcasts of the parts of the index, one for each pass: an ItemIndex and its step for each class of length."""
    items = index_table(benchmark, folder, id_col, text_col)
    size = (F.size("terms") * 32 + F.size("question") * 8 + F.size("answer") * 8 + 64).cast("long")
    total = items.agg(F.sum(size)).first()[0] or 0
    n = -(-total // INDEX_BYTES)
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("uid"), F.lit(n)) == k) if n > 1 else items
        rows = part.orderBy("step", "uid").toArrow()
        steps = pc.unique(rows.column("step")).to_pylist()
        yield spark.sparkContext.broadcast([(ItemIndex(rows.filter(pc.equal(rows.column("step"), step))), step) for step in steps])


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least_score: float = LEAST_SCORE, least_overlap: float = LEAST_OVERLAP, folder: str | None = None) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every leak: the best passage for each document and item.  The index goes to ``folder``, which executors share."""
    spark = docs.sparkSession
    docs = ids_and_texts(docs, id_col, text_col)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id long, score double, question_overlap double, answer_overlap double"
    result = None
    for sent in _passes(spark, benchmark, folder or work_dir(spark), item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            indexes = sent.value
            for chunk, _ in text_chunks(batches, fold=True):
                found = sorted(find(chunk, indexes, least_score, least_overlap).items())
                if found:
                    yield pa.RecordBatch.from_arrays([chunk.ids.take(pa.array([d for (d, _, _), _ in found])), pa.array([indexes[k][0].ids[i] for (_, k, i), _ in found], pa.int64()), *(pa.array([v[k] for _, v in found], pa.float64()) for k in range(3))], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        part = docs.mapInArrow(run, schema)
        result = part if result is None else result.union(part)
    return result if result is not None else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least_score: float = LEAST_SCORE, least_overlap: float = LEAST_OVERLAP, folder: str | None = None) -> DataFrame:
    """The documents without leaks, in all their columns; decided in the same pass over the rows."""
    spark = docs.sparkSession
    for sent in _passes(spark, benchmark, folder or work_dir(spark), item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for chunk, part in text_chunks(batches, text_col, text_col, fold=True):
                keep = np.ones(part.num_rows, dtype=bool)
                keep[[d for d, _, _ in find(chunk, sent.value, least_score, least_overlap)]] = False
                yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
