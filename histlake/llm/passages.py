"""Substring dedup: words covered by passages that an earlier document holds.

Two operators share the definition of a match, ``length`` consecutive equal
words, and the suffix automata of reference shards, through which documents are
streamed for their matching statistics (the longest match that ends at each
word); words inside matches of the threshold or more go.

``remove_reference_spans`` removes what a bounded reference holds: the automata
of its shards are broadcast.

``remove_repeats`` takes the table itself as the reference: a word goes when a
window of ``length`` words over it also starts in a document with a smaller id.
A broadcast of every shard to every document would cost the square of the table
(figures in the README), so each document meets only the shards that can match:

1. Fingerprints of all windows go, in blocks, to the shard of their hash, which
   names the smallest document of each window that several documents hold.
2. Documents that hold such windows later, and requests for the passages of the
   first holders, go to the documents' homes, where the texts come too.
3. The first holders' passages go to the homes that asked for them.  A home
   builds the automata of these passages, in shards of bounded size, and streams
   its documents through them; a state knows the smallest document that holds
   its words, so only matches with smaller ids count.

* A batch sends a window once, for its smallest document (a map-side combine),
  so a passage in a third of all documents is one entry for each batch, and its
  text goes once to each home.
* Documents without repeats travel once; the others twice, compressed.
* Fingerprints have 64 bits.  What goes is always checked word by word, so equal
  fingerprints of different windows remove nothing wrongly; but a repeat stays
  where another window of a smaller document has its fingerprint (and no
  neighbouring window covers it).  Two of n different windows share a
  fingerprint with probability about n * n / 2**65: 5e-4 for the 1.35e8 windows
  of 0.5 GB; at 30 GB (8e9) 1.7 such pairs are expected in the whole table, and
  only one whose window repeats later changes a row.

Defined cases: null or empty text has no words; repeated rows of one id are one
document (ids must not stand for different texts); a null id is never a
reference and loses nothing; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TextBatch, gathered, gram_valid, grams, ids_and_texts, mix, parts_for, shuffle_partitions, table, text_chunks, unpack

LENGTH = 13
#: Words of a reference shard; the automaton of one takes about 60 MB.
SHARD_WORDS = 100_000
#: Bytes of text whose windows are combined before they are sent.
BLOCK_BYTES = 8 << 20
#: Returned windows gathered before they are sent on.
FLUSH = 1 << 20
#: Bytes of the table's files whose windows make one shard, and whose texts one home.
PART_BYTES = 4 << 20
#: Larger than any id.
NEVER = 1 << 63


class SuffixAutomaton:
    """Of sequences of words, each of a document; no match crosses their ends."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [NEVER]
        self.last = 0

    def begin(self) -> None:
        self.last = 0

    def extend(self, word: bytes, doc: int = 0) -> None:
        now = self.next[self.last].get(word)
        if now is not None:  # the passage is there already
            if self.length[now] != self.length[self.last] + 1:
                now = self._clone(self.last, word, now)
            self.least[now] = min(self.least[now], doc)
            self.last = now
            return
        new = self._state({}, self.length[self.last] + 1, 0, doc)
        p = self.last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q)
        self.last = new

    def _state(self, edges: dict[bytes, int], length: int, link: int, least: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.least.append(least)
        return len(self.length) - 1

    def _clone(self, p: int, word: bytes, q: int) -> int:
        copy = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q], self.least[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def first_documents(self, length: int) -> list[int]:
        """For each state, the smallest document that holds the last `length` words of its matches."""
        least, order = self.least.copy(), np.argsort(np.array(self.length), kind="stable").tolist()
        for s in reversed(order[1:]):
            up = self.link[s]
            if least[s] < least[up]:
                least[up] = least[s]
        out = [NEVER] * len(least)
        for s in order[1:]:
            if self.length[s] >= length:
                up = self.link[s]
                out[s] = least[s] if self.length[up] < length else out[up]
        return out

    def statistics(self, words: list[bytes]) -> np.ndarray:
        """The length of the longest match that ends at each word."""
        return np.array([size for _, size in self._stream(words)], dtype=np.int64)

    def _stream(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """State and length of the longest match that ends at each word."""
        state, size = 0, 0
        follow, link, length = self.next, self.link, self.length
        for w in words:
            to = follow[state].get(w)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = follow[state].get(w)
            if to is not None:
                state = to
                size += 1
            yield state, size


def covered(statistics: np.ndarray, threshold: int) -> np.ndarray:
    """Which words lie in a match of the threshold or more, from the matches' ends."""
    n = len(statistics)
    marks = np.zeros(n + 1, dtype=np.int64)
    ends = np.flatnonzero(statistics >= threshold)
    np.add.at(marks, ends - statistics[ends] + 1, 1)
    np.add.at(marks, ends + 1, -1)
    return np.cumsum(marks[:n]) > 0


def reference_shards(texts: Iterator[str | None], size: int = SHARD_WORDS) -> Iterator[SuffixAutomaton]:
    """Automata over whole texts, of about `size` words each."""
    automaton, n = SuffixAutomaton(), 0
    for text in texts:
        automaton.begin()
        for word in _split(text):
            automaton.extend(word)
            n += 1
        if n >= size:
            yield automaton
            automaton, n = SuffixAutomaton(), 0
    if n:
        yield automaton


def remove_reference_spans(docs: DataFrame, reference: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", max_words: int = 5 * SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, text: without the words that the reference's passages cover.

    reference(text) is bounded: its words are counted first, and more than
    ``max_words`` (300 MB of automata) raise a ValueError.  Texts come to the driver one by one, as
    shards are built; each is one broadcast.
    """
    docs = ids_and_texts(docs, id_col, text_col)
    texts = reference.select(F.col("text").cast("string").alias("text"))
    n = texts.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"[ \t-\r]+")))).first()[0] or 0
    if n > max_words:
        raise ValueError(f"a reference of {n} words; at most {max_words} are broadcast: use remove_repeats")
    context = docs.sparkSession.sparkContext
    shards = [context.broadcast(a) for a in reference_shards(r["text"] for r in texts.toLocalIterator())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_split(t) for t in batch.column("text").to_pylist()]
            gone = [np.zeros(len(t), dtype=bool) for t in texts]
            for shard in shards:
                for i, words in enumerate(texts):
                    gone[i] |= covered(shard.value.statistics(words), length)
            kept = [b" ".join(w for w, g in zip(t, x, strict=True) if not g).decode() for t, x in zip(texts, gone, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([int(g.sum()) for g in gone], pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "text"])

    return docs.mapInArrow(run, "doc_id long, n_words long, n_removed long, text string")


def _split(text: str | None) -> list[bytes]:
    """bytes.split() parts at exactly the six characters of SPACES."""
    return (text or "").encode().split()


def _press(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 1)


def _open(data: bytes, kind: type) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(data), dtype=kind)


def _block(docs: np.ndarray, at: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted by document and position, both are small differences."""
    return _press(np.diff(docs, prepend=0)), _press(at.astype(np.uint32))


def _pieces(target: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each target in use and the entries for it, in their order."""
    order = np.argsort(target, kind="stable")
    edges = np.searchsorted(target[order], np.arange(n + 1))
    for t in np.flatnonzero(np.diff(edges)):
        yield int(t), order[edges[t] : edges[t + 1]]


BLOCKS = "target int, kind int, doc_id long, docs binary, at binary, keys binary"
_NAMES = ["target", "kind", "doc_id", "docs", "at", "keys"]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


def _home(docs: np.ndarray, n: int) -> np.ndarray:
    return (mix(docs.view(np.uint64)) % np.uint64(n)).astype(np.int64)


def window_hashes(batch: TextBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first word (in the batch), document and position of all windows."""
    _, _, bounds, words = batch.word_hashes()
    first = np.flatnonzero(gram_valid(bounds, len(words), length))
    doc = np.searchsorted(bounds, first, side="right") - 1
    return grams(words, length)[first], first, doc, first - bounds[doc]


def _send_windows(docs: DataFrame, length: int, n_shards: int, n_homes: int) -> DataFrame:
    """kind 0: windows for their shard, keys are fingerprints; kinds 1 and 2, for homes, as in _find_later, of windows that a block holds several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _ in text_chunks(gathered(batches, BLOCK_BYTES), size=BLOCK_BYTES):
            ids = np.asarray(chunk.ids.cast(pa.int64()))
            h, _, doc, at = window_hashes(chunk, length)
            if not len(h):
                continue
            doc = ids[doc]
            order = np.argsort(h, kind="stable") if (np.diff(ids) > 0).all() else np.lexsort((at, doc, h))
            h, doc, at = h[order], doc[order], at[order]
            fresh = np.ones(len(h), dtype=bool)
            fresh[1:] = h[1:] != h[:-1]
            own = fresh.copy()  # the first place of each window in each document
            own[1:] |= doc[1:] != doc[:-1]
            sent = np.flatnonzero(fresh)
            sent = sent[np.lexsort((at[sent], doc[sent]))]
            rows = []
            for t, x in _pieces((h[sent] >> np.uint64(40)).astype(np.int64) % n_shards, n_shards):
                x = sent[x]
                rows.append((t, 0, None, *_block(doc[x], at[x]), h[x].tobytes()))
            late = np.flatnonzero(own & ~fresh)
            first = np.flatnonzero(fresh)[np.cumsum(fresh)[late] - 1]
            rows += _requests(doc[late], doc[first], at[first], n_homes)
            yield _rows(rows)

    return docs.where(F.col("doc_id").isNotNull()).mapInArrow(run, BLOCKS)


def _requests(later: np.ndarray, doc: np.ndarray, at: np.ndarray, n_homes: int) -> list[tuple]:
    """kind 1: later documents, for their homes; kind 2: windows (doc, at) of first holders, for theirs, keys are the homes that ask."""
    rows = []
    if len(later):
        asking = _home(later, n_homes)
        names = np.unique(later)
        for t, x in _pieces(_home(names, n_homes), n_homes):
            rows.append((t, 1, None, *_block(names[x], np.empty(0)), None))
        order = np.lexsort((asking, at, doc))
        doc, at, asking = doc[order], at[order], asking[order]
        once = np.ones(len(doc), dtype=bool)
        once[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1]) | (asking[1:] != asking[:-1])
        doc, at, asking = doc[once], at[once], asking[once]
        for t, x in _pieces(_home(doc, n_homes), n_homes):
            rows.append((t, 2, None, *_block(doc[x], at[x]), _press(asking[x].astype(np.uint32))))
    return rows


def _find_later(blocks: DataFrame, n_homes: int) -> DataFrame:
    """Later documents and requests for the passages of first holders; blocks come shard by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        shard, parts = -1, []

        def close() -> None:
            if len(parts) > 1:  # a window is once in a block
                h, doc, at = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.lexsort((doc, h))
                h, doc, at = h[order], doc[order], at[order]
                first = np.ones(len(h), dtype=bool)
                first[1:] = h[1:] != h[:-1]
                least = np.flatnonzero(first)[np.cumsum(first) - 1]
                later = np.flatnonzero(doc > doc[least])
                found.append((doc[later], doc[least[later]], at[least[later]]))
            parts.clear()

        def flush() -> pa.RecordBatch | None:
            rows = _requests(*(np.concatenate(x) for x in zip(*found, strict=True)), n_homes)
            found.clear()
            return _rows(rows) if rows else None

        for batch in batches:
            for target, kind, docs, at, keys in zip(*(batch.column(c).to_pylist() for c in ("target", "kind", "docs", "at", "keys")), strict=True):
                if kind:
                    yield _rows([(target, kind, None, docs, at, keys)])
                    continue
                if target != shard:
                    close()
                    shard = target
                doc = np.cumsum(_open(docs, np.int64))
                parts.append((np.frombuffer(keys, dtype=np.uint64), doc, _open(at, np.uint32).astype(np.int64)))
                if sum(len(x[0]) for x in found) >= FLUSH and (out := flush()) is not None:
                    yield out
        close()
        if found and (out := flush()) is not None:
            yield out

    return blocks.mapInArrow(run, BLOCKS)


def _send_texts(docs: DataFrame, n_homes: int) -> DataFrame:
    """kind 3: the texts, packed, for their home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            ids = np.asarray(batch.column("doc_id").fill_null(0).cast(pa.int64()))
            packed = [press((t or "").encode()) for t in batch.column("text").to_pylist()]
            n, none = batch.num_rows, pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(_home(ids, n_homes), pa.int32()), pa.array(np.full(n, 3), pa.int32()), batch.column("doc_id"), none, none, pa.array(packed, pa.binary())], names=_NAMES)

    return docs.mapInArrow(run, BLOCKS)


def _by_home(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple], Iterator[tuple[int | None, bytes]]]]:
    """Home by home: its blocks (kind, doc_id, docs, at, keys), then its texts (doc_id, packed) one by one."""
    rows = ((t, row) for batch in batches for t, *row in zip(*(batch.column(c).to_pylist() for c in _NAMES), strict=True))
    for home, group in groupby(rows, key=lambda x: x[0]):
        blocks: list[tuple] = []
        first: list[tuple[int | None, bytes]] = []
        for _, row in group:
            if row[0] == 3:
                first.append((row[1], row[4]))
                break
            blocks.append(tuple(row))
        yield home, blocks, chain(first, ((row[1], row[4]) for _, row in group))


def _later(blocks: list[tuple]) -> set[int]:
    out: set[int] = set()
    for kind, _, docs, _, _ in blocks:
        if kind == 1:
            out.update(np.cumsum(_open(docs, np.int64)).tolist())
    return out


def _untouched(mixed: DataFrame) -> DataFrame:
    """The results of documents that no smaller document shares a window with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blocks, texts in _by_home(batches):
            later = _later(blocks)
            mine = (x for x in texts if x[0] is None or x[0] not in later)
            while part := list(islice(mine, 256)):
                words = [x.split() for x in unpack(pa.array([p for _, p in part], pa.binary()))]
                yield _result([(i, len(w), 0, b" ".join(w)) for (i, _), w in zip(part, words, strict=True)])

    return mixed.mapInArrow(run, RESULT)


RESULT = "doc_id long, n_words long, n_removed long, text string"


def _result(rows: list[tuple]) -> pa.RecordBatch:
    ids, n, removed, kept = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([x.decode() for x in kept], pa.string())], names=["doc_id", "n_words", "n_removed", "text"])


def _passages_and_later(mixed: DataFrame, length: int) -> DataFrame:
    """For homes: kind 0, passages of first holders (keys: words by space, passages by line); kind 3, texts of later documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for home, blocks, texts in _by_home(batches):
            later = _later(blocks)
            asked = [(np.cumsum(_open(d, np.int64)), _open(at, np.uint32).astype(np.int64), _open(keys, np.uint32).astype(np.int64)) for kind, _, d, at, keys in blocks if kind == 2]
            doc, at, asking = (np.concatenate(x) for x in zip(*asked, strict=True)) if asked else (np.empty(0, np.int64),) * 3
            order = np.lexsort((at, asking, doc))
            doc, at, asking = doc[order], at[order], asking[order]
            seen: set[int] = set()
            rows: list[tuple] = []
            for name, packed in texts:
                if name is None:
                    continue
                if name in later:
                    rows.append((home, 3, name, None, None, packed))
                low, high = np.searchsorted(doc, name), np.searchsorted(doc, name, side="right")
                if low < high and name not in seen:
                    seen.add(name)
                    words = unpack(pa.array([packed], pa.binary()))[0].split()
                    for to in np.unique(asking[low:high]):
                        mine = slice(low + np.searchsorted(asking[low:high], to), low + np.searchsorted(asking[low:high], to, side="right"))
                        starts = np.unique(at[mine])
                        cut = np.flatnonzero(np.diff(starts) > length - 1)
                        spans = zip(starts[np.concatenate(([0], cut + 1))].tolist(), (starts[np.concatenate((cut, [len(starts) - 1]))] + length).tolist(), strict=True)
                        rows.append((int(to), 0, name, None, None, _press_bytes(b"\n".join(b" ".join(words[a:b]) for a, b in spans))))
                if len(rows) >= 256:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)

    return mixed.mapInArrow(run, BLOCKS)


def _press_bytes(data: bytes) -> bytes:
    import zstandard

    return zstandard.compress(data, 1)


def _passage_shards(blocks: list[tuple]) -> Iterator[SuffixAutomaton]:
    """Automata of a home's passages, of about SHARD_WORDS words each."""
    automaton, n = SuffixAutomaton(), 0
    for _, doc, _, _, packed in blocks:
        for passage in unpack(pa.array([packed], pa.binary()))[0].split(b"\n"):
            automaton.begin()
            for word in passage.split():
                automaton.extend(word, doc)
                n += 1
        if n >= SHARD_WORDS:
            yield automaton
            automaton, n = SuffixAutomaton(), 0
    if n:
        yield automaton


def _stream_through(passages: DataFrame, length: int) -> DataFrame:
    """Later documents without what a smaller document's passages cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blocks, texts in _by_home(batches):
            held = list(texts)  # compressed; a home is a small part of the table
            ends: list[np.ndarray | None] = [None] * len(held)
            for automaton in _passage_shards(blocks):
                first = automaton.first_documents(length)
                for k, (doc, packed) in enumerate(held):
                    words = unpack(pa.array([packed], pa.binary()))[0].split()
                    hit = np.fromiter((size >= length and first[state] < doc for state, size in automaton._stream(words)), dtype=bool, count=len(words))
                    ends[k] = hit if ends[k] is None else ends[k] | hit
            for k, (doc, packed) in enumerate(held):
                words = unpack(pa.array([packed], pa.binary()))[0].split()
                gone = covered(np.where(ends[k], length, 0), length) if ends[k] is not None else np.zeros(len(words), dtype=bool)
                yield _result([(doc, len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g))])

    return passages.mapInArrow(run, RESULT)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, text (kept words joined by one space), for each row."""
    docs = ids_and_texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    parts = shuffle_partitions(docs.sparkSession)
    # a task takes shard after shard and home after home, so what it holds is bounded, whatever the table and the partitions
    n_shards, n_homes = parts_for(docs, PART_BYTES, 8 * parts), parts_for(docs, PART_BYTES, 4 * parts)
    blocks = _send_windows(docs, length, n_shards, n_homes).repartition(parts, "target").sortWithinPartitions("kind", "target")
    mixed = _find_later(blocks, n_homes).union(_send_texts(docs, n_homes)).repartition(parts, "target").sortWithinPartitions("target", "kind")
    passages = _passages_and_later(mixed, length).repartition(parts, "target").sortWithinPartitions("target", "kind")
    return _untouched(mixed).union(_stream_through(passages, length))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS i,
         unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS g
  FROM words WHERE len(w) >= 13),
firsts AS (SELECT g, min(doc_id) AS first_doc FROM windows GROUP BY g),
gone AS (
  SELECT DISTINCT doc_id, i + j AS i
  FROM windows JOIN firsts USING (g), (SELECT unnest(range(13)) AS j) WHERE doc_id > first_doc),
placed AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words),
marked AS (
  SELECT placed.doc_id, word, placed.i, gone.i IS NOT NULL AS out FROM placed LEFT JOIN gone ON placed.doc_id = gone.doc_id AND placed.i = gone.i),
counted AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE out) AS r,
         string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT out) AS kept
  FROM marked GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(r, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN counted ON documents.doc_id = counted.doc_id
"""
