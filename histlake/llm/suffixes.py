"""Suffix-array dedup with a logarithmic family of indexes.

Texts are UTF-8 bytes.  A batch of documents gets a table in place of a suffix
array: the suffixes at content-chosen places (the least hash among the
``WINDOW`` anchors of each stretch of ``length`` bytes, so equal stretches
choose equal places), ordered by the hash of their first ``ANCHOR`` bytes, not
by suffix.  A new table meets itself and the existing levels by hash joins (no
merge scan) for suffixes that agree; levels of equal size are merged, so an entry is rewritten at most log2(batches)
times.

Suffixes that agree anywhere are then compared over their whole reach, all
stretches of ``length`` bytes that contain the anchor:

* entries whose whole reach has the same fingerprint repeat all of it;
* the others send the bytes of their reach, one for each class of equal
  reaches, to the place of their anchor, where stretches found twice are marked.
  The reaches of a frequent anchor come in chunks.  Chunks tell each other, by
  hash, first the cores that neighbouring stretches have in common, then the
  stretches around shared cores; those that another chunk holds are marked too.

Marked stretches meet the texts by document; bytes inside them go.  Repeats that
are too short to go show too: ``n_shared`` counts a document's anchors that are
anchors elsewhere as well, so it tells of most repeats of some hundred bytes.  What is
shuffled is one entry for about 150 bytes of text, the reaches of the few
entries at the ends of matches, and the texts, compressed, for each of the two
times that bytes are read by document.

Defined cases: null text is empty; a repeated row of one id is the same
document and counts once (ids must not stand for different texts); a null id
is never compared and keeps all; an empty table gives an empty result; other
columns are not read.  Removing bytes can leave invalid UTF-8: the kept bytes
are binary.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt, delete, ids_and_texts, materialise, mix, packed_texts, rolling_hashes, shuffle_partitions, table, text_chunks, unpack, work_dir

LENGTH = 400
ANCHOR = 96
#: Batches of a whole table that arrives at once.
BATCHES = 3
#: A longer document is indexed in parts of about so many bytes, to bound memory.
SEGMENT = 1 << 20
#: Parts that the entries of a key are dealt over where they are looked up.
SALTS = 16
#: Different reaches of an anchor that one group holds; those of a frequent anchor are dealt over so large chunks.
CHUNK_ROWS = 400
#: Cores of a reach: runs of bytes that so many parts of its stretches have in common.
CORES = 16
#: Reaches of whole groups that are marked at once.
BLOCK_ROWS = 1_000

ENTRIES = "key long, reach long, doc_id long, at int"


def sliding_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """The distinct places of the (leftmost) least value of each w consecutive ones."""
    n = len(values)
    if n < w:
        return np.empty(0, dtype=np.int64)
    # the low bits hold the place, so that equal values are told apart, leftmost first
    bits = np.uint64(max(1, int(n).bit_length()))
    x = (values >> bits << bits) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = x
    grid = padded.reshape(blocks, w)
    right = np.minimum.accumulate(grid, axis=1).ravel()
    left = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(left[: n - w + 1], right[w - 1 : n])
    changed = np.ones(len(low), dtype=bool)
    changed[1:] = low[1:] != low[:-1]
    return (low[changed] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def chosen(data: np.ndarray, begin: int, end: int, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and anchor hashes that the stretches of `length` bytes inside [begin, end) choose.

    Places break ties only between hashes masked to fixed bits, so a stretch's
    choice depends on its bytes alone.
    """
    h = rolling_hashes(data[begin:end], anchor)
    at = sliding_argmin(h & ~np.uint64((1 << 31) - 1), length - anchor + 1)
    return at + begin, h[at]


def entries(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """The sparse suffix array of docs, unsorted: key (first bytes), reach (all bytes that a match may use), doc_id, at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _ in text_chunks(batches):
            ids = chunk.ids.to_pylist()
            out: list[tuple[np.ndarray, ...]] = []
            for i in np.flatnonzero(np.diff(chunk.offsets) >= length):
                data = chunk.data[chunk.offsets[i] : chunk.offsets[i + 1]]
                for begin in range(0, len(data) - length + 1, SEGMENT):
                    # stretches that start in this segment, with room for the reaches of their anchors
                    low = max(0, begin - length)
                    piece = data[low : begin + SEGMENT + 2 * length]
                    at, key = chosen(piece, begin - low, min(begin + SEGMENT + length - 1, len(data)) - low, length, anchor)
                    first, last = np.maximum(at - (length - anchor), 0), np.minimum(at + length, len(piece))
                    whole = piece.tobytes()
                    hashes = [xxhash.xxh3_64_intdigest(whole[i:j]) for i, j in zip(first.tolist(), last.tolist(), strict=True)]
                    reach = np.array(hashes, dtype=np.uint64) ^ mix((at - first).astype(np.uint64))
                    out.append((key, reach, np.full(len(at), ids[i]), at + low))
            if out:
                key, reach, doc, at = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(reach.view(np.int64)), pa.array(doc.astype(np.int64)), pa.array(at.astype(np.int32))], names=["key", "reach", "doc_id", "at"])

    return docs.where(F.col("doc_id").isNotNull()).mapInArrow(run, ENTRIES)


def _semi(entries: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """The entries with a row in found; frequent keys are dealt over SALTS parts, and further by AQE."""
    salted = entries.withColumn("salt", F.pmod(F.xxhash64("doc_id", "at"), F.lit(SALTS)).cast("int"))
    return salted.join(dealt(found.select(*on), SALTS), [*on, "salt"], "left_semi").select(*entries.columns)


class SuffixIndex:
    """Levels of sorted entries in a shared folder; level i holds 2**i batches or nothing."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.levels: list[tuple[str, DataFrame] | None] = []
        self.found: list[DataFrame] = []
        self.n = 0

    def _keep(self, df: DataFrame, name: str) -> tuple[str, DataFrame]:
        parts = shuffle_partitions(self.spark)
        return name, materialise(df.repartition(parts, "key", "doc_id").distinct().sortWithinPartitions("key", "reach"), self.folder, name)

    def add(self, new: DataFrame) -> None:
        """Scan a batch's array against itself and all levels, then let equal levels merge."""
        self.n += 1
        name, array = self._keep(new, f"array-{self.n}")
        found = array.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        keys = array.select("key").distinct()
        for level in filter(None, self.levels):
            found = found.union(keys.join(level[1].select("key").distinct(), "key", "left_semi"))
        self.found.append(materialise(found.distinct(), self.folder, f"found-{self.n}"))
        at = 0
        while at < len(self.levels) and self.levels[at]:
            old_name, old = self.levels[at]
            merged_name, merged = self._keep(old.union(array), f"level-{self.n}-{at + 1}")
            delete(self.spark, f"{self.folder}/{old_name}")
            delete(self.spark, f"{self.folder}/{name}")
            self.levels[at] = None
            name, array = merged_name, merged
            at += 1
        if at == len(self.levels):
            self.levels.append(None)
        self.levels[at] = (name, array)

    def repeated(self) -> DataFrame:
        """The entries of all levels whose key was found more than once."""
        everything = None
        for level in self.levels:
            if level:
                everything = level[1] if everything is None else everything.union(level[1])
        keys = self.found[0]
        for more in self.found[1:]:
            keys = keys.union(more)
        return _semi(everything, keys.distinct(), ["key"])


#: A span (context is null), or a reach of a chunk, as it came.
MARKS = "doc_id long, start int, end int, key long, chunk int, at int, left int, context binary"
REACH = ("key", "chunk", "doc_id", "at", "left", "context")


class _Reaches:
    """The stretches of reaches (key, chunk, doc_id, at, left, context), as arrays: the reach of each, its place and its hash under its key."""

    def __init__(self, rows: list[tuple], length: int, anchor: int):
        keys, chunks, docs, at, left, contexts = zip(*rows, strict=True)
        self.length = length
        self.data = np.frombuffer(b"".join(contexts), dtype=np.uint8)
        self.bounds = np.cumsum([0] + [len(c) for c in contexts])
        self.keys = mix(np.array(keys, dtype=np.int64).view(np.uint64))
        self.chunks = np.array(chunks, dtype=np.uint64)
        self.docs, self.left = np.array(docs, dtype=np.int64), np.array(left)
        self.first = np.array(at) - self.left
        n = np.maximum(np.diff(self.bounds) - (length - 1), 0)
        self.row = np.repeat(np.arange(len(n)), n)
        self.within = np.arange(len(self.row)) - np.repeat(np.cumsum(n) - n, n)
        # stretches by where they begin before the anchor, in CORES parts
        self.lead = length - anchor
        self.step = -(-(self.lead + 1) // CORES)
        self.core = (self.within - self.left[self.row] + self.lead) // self.step

    def hashes(self) -> np.ndarray:
        return rolling_hashes(self.data, self.length)[self.bounds[self.row] + self.within] ^ self.keys[self.row]

    def names(self) -> np.ndarray:
        """A hash of each place: reaches of one document may overlap, and the same place is no repeat."""
        return mix(self.docs.view(np.uint64))[self.row] + (self.first[self.row] + self.within).astype(np.uint64)

    def cores(self) -> tuple[np.ndarray, np.ndarray]:
        """For each stretch, the hash of the bytes that all stretches of its part have in common, and a hash of their place."""
        size = self.length - self.step + 1
        begin = self.left[self.row] - self.lead + (self.core + 1) * self.step - 1
        begin = np.minimum(begin, self.left[self.row])  # the last part may be shorter: the anchor's own stretch
        hashes = rolling_hashes(self.data, size)[self.bounds[self.row] + begin] ^ mix(self.keys[self.row] + self.core.astype(np.uint64))
        return hashes, mix(self.docs.view(np.uint64))[self.row] + (self.first[self.row] + begin).astype(np.uint64)

    def spans(self, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """doc_id, start, end of what the marked stretches cover."""
        hit = np.flatnonzero(marked)
        if not len(hit):
            return hit, hit, hit
        row, place = self.row[hit], self.first[self.row[hit]] + self.within[hit]
        fresh = np.ones(len(hit), dtype=bool)
        fresh[1:] = (row[1:] != row[:-1]) | (np.diff(place) > self.length)
        begins = np.flatnonzero(fresh)
        ends = np.append(begins[1:] - 1, len(hit) - 1)
        return self.docs[row[begins]], place[begins], place[ends] + self.length


def _least_most(h: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values of h, where each value stands among them, and its least low and largest high."""
    values, which = np.unique(h, return_inverse=True)
    order = np.argsort(which, kind="stable")
    edges = np.searchsorted(which[order], np.arange(len(values)))
    return values, which, np.minimum.reduceat(low[order], edges) if len(h) else low, np.maximum.reduceat(high[order], edges) if len(h) else high


def _repeated_in(h: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which of h stand at several places."""
    _, which, low, high = _least_most(h, names, names)
    return (low != high)[which]


def _span_batch(docs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["doc_id", "start", "end"])


def _marked(groups: DataFrame, length: int, anchor: int) -> DataFrame:
    """MARKS of whole groups of reaches (with chunks, how many its key has), which come sorted by key and chunk: what a group's reaches share, and the reaches of chunks."""

    def marks(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        found = _Reaches([r[:6] for r in rows], length, anchor)
        h = found.hashes() ^ mix(found.chunks)[found.row]
        spans = found.spans(_repeated_in(h, found.names()))
        later = [r for r in rows if r[6] > 1]
        none = lambda kind, n: pa.nulls(n, kind)
        n, m = len(spans[0]), len(later)
        columns = [pa.concat_arrays([pa.array(x, t), none(t, m)]) for x, t in zip(spans, (pa.int64(), pa.int32(), pa.int32()), strict=True)]
        columns[0] = pa.concat_arrays([pa.array(spans[0], pa.int64()), pa.array([r[2] for r in later], pa.int64())])
        for i, t in ((0, pa.int64()), (1, pa.int32()), (3, pa.int32()), (4, pa.int32()), (5, pa.binary())):
            columns.append(pa.concat_arrays([none(t, n), pa.array([r[i] for r in later], t)]))
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "end", "key", "chunk", "at", "left", "context"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*REACH, "chunks")), strict=True):
                if len(held) >= BLOCK_ROWS and row[:2] != held[-1][:2]:
                    yield from marks(held)
                    held = []
                held.append(row)
        if held:
            yield from marks(held)

    return groups.select(*REACH, "chunks").mapInArrow(run, MARKS)


TOLD = "part int, key long, chunk int, h binary, low binary, high binary"


def _telling(groups: DataFrame, told: DataFrame | None, length: int, anchor: int, n_parts: int) -> DataFrame:
    """TOLD: what chunks tell, each value once, in blocks by value; cores, or with told (their shared cores) the stretches around them."""
    only_cores = told is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, chunk, found, cores, _ in _chunks(batches, length, anchor):
            h, names = found.cores()
            if not only_cores:
                near = np.flatnonzero(_repeated_in(h, names) | np.isin(h, cores))
                h, names = found.hashes()[near], found.names()[near]
            values, _, low, high = _least_most(h, names, names)
            part = ((values >> np.uint64(40)) % np.uint64(n_parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
            rows = [(int(part[x[0]]), key, chunk, values[x].tobytes(), low[x].tobytes(), high[x].tobytes()) for x in np.split(order, cuts[1:])] if len(order) else []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["part", "key", "chunk", "h", "low", "high"])

    return _with_told(groups, told).mapInArrow(run, TOLD)


def _shared(told: DataFrame, kind: int) -> DataFrame:
    """key, chunk, kind, h: the values that a chunk told once and that stand elsewhere too, for that chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                h, low, high = (np.concatenate([np.frombuffer(r[i], dtype=np.uint64) for r in held]) for i in (2, 3, 4))
                _, which, least, most = _least_most(h, low, high)
                mine = (least != most)[which] & (low == high)
                ends = np.cumsum([len(r[2]) // 8 for r in held])
                rows = [(r[0], r[1], kind, h[a:b][mine[a:b]].tobytes()) for r, a, b in zip(held, [0, *ends], ends, strict=False) if mine[a:b].any()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["key", "chunk", "kind", "h"])

        for batch in batches:
            for p, *row in zip(*(batch.column(c).to_pylist() for c in ("part", "key", "chunk", "h", "low", "high")), strict=True):
                if p != part:
                    yield from close()
                    part, held = p, []
                held.append(row)
        yield from close()

    return told.mapInArrow(run, "key long, chunk int, kind int, h binary")


def _with_told(groups: DataFrame, told: DataFrame | None) -> DataFrame:
    """Chunks' reaches (kind 0) and what they were told (kinds 1 and 2), chunk by chunk."""
    rows = groups.select("key", "chunk", F.lit(0).alias("kind"), "doc_id", "at", "left", "context")
    if told is not None:
        rows = rows.union(told.select("key", "chunk", "kind", F.lit(None).cast("long"), F.lit(None).cast("int"), F.lit(None).cast("int"), "h"))
    return rows.repartition(shuffle_partitions(rows.sparkSession), "key", "chunk").sortWithinPartitions("key", "chunk", "kind")


def _chunks(batches: Iterator[pa.RecordBatch], length: int, anchor: int) -> Iterator[tuple[int, int, _Reaches, np.ndarray, np.ndarray]]:
    """key, chunk, its reaches, and the cores and stretches that other chunks hold."""
    names = ("key", "chunk", "kind", "doc_id", "at", "left", "context")
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in names), strict=True))
    values = lambda found, kind: np.concatenate([np.empty(0, dtype=np.uint64), *(np.frombuffer(r[6], dtype=np.uint64) for r in found if r[2] == kind)])
    for (key, chunk), group in groupby(rows, key=lambda r: r[:2]):
        found = list(group)
        yield key, chunk, _Reaches([(r[0], r[1], *r[3:]) for r in found if r[2] == 0], length, anchor), values(found, 1), values(found, 2)


def _across_chunks(reaches: DataFrame, length: int, anchor: int) -> DataFrame:
    """doc_id, start, end of the stretches that stand alone in their chunk but also in another.

    Two rounds: only stretches around shared cores are told, so a reach tells
    its CORES cores and the stretches where it leaves what it shares.
    """
    parts = shuffle_partitions(reaches.sparkSession)
    n_parts = 4 * parts
    deal = lambda told: told.repartition(parts, "part").sortWithinPartitions("part")
    cores = _shared(deal(_telling(reaches, None, length, anchor, n_parts)), 1)
    stretches = _shared(deal(_telling(reaches, cores, length, anchor, n_parts)), 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, found, _, mine in _chunks(batches, length, anchor):
            if len(mine):
                yield _span_batch(*found.spans(np.isin(found.hashes(), mine)))

    return _with_told(reaches, stretches).mapInArrow(run, "doc_id long, start int, end int")


def _contexts(wanted: DataFrame, texts: DataFrame, length: int, anchor: int) -> DataFrame:
    """key, chunks, doc_id, at, left, context: the bytes of the reaches of wanted entries."""
    places = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("key", "at", "chunks")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                text = unpack(batch.column("packed").slice(row, 1))[0]
                doc = batch.column("doc_id")[row].as_py()
                rows = []
                for p in batch.column("places")[row].as_py():
                    low = max(0, p["at"] - (length - anchor))
                    rows.append((p["key"], p["chunks"], doc, p["at"], p["at"] - low, text[low : p["at"] + length]))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["key", "chunks", "doc_id", "at", "left", "context"])

    return places.join(texts, "doc_id").select("doc_id", "packed", "places").mapInArrow(run, "key long, chunks int, doc_id long, at int, left int, context binary")


def _cut(texts: DataFrame, spans: DataFrame, shared: DataFrame, length: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, n_shared, kept: the texts without their spans; shared: doc_id, n_shared."""
    by_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans")).join(shared, "doc_id", "full")
    joined = texts.join(by_doc, "doc_id", "left").select("doc_id", "packed", "spans", F.coalesce("n_shared", F.lit(0).cast("long")).alias("n_shared"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                out = []
                for doc, text, spans, shared in zip(part.column("doc_id").to_pylist(), unpack(part.column("packed")), part.column("spans").to_pylist(), part.column("n_shared").to_pylist(), strict=True):
                    kept, at, removed, runs = [], 0, 0, 0
                    end = -1
                    for s, e in sorted((x["start"], min(x["end"], len(text))) for x in spans or ()):
                        if s > end:
                            kept.append(text[at:s])
                            runs += 1
                            end, at = e, e
                            removed += e - s
                        elif e > end:
                            removed += e - end
                            end, at = e, e
                    kept.append(text[at:])
                    out.append((doc, len(text), removed, runs, shared, b"".join(kept)))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (*[pa.int64()] * 5, pa.binary()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "n_shared", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, n_shared long, kept binary")


def remove_repeated_bytes(docs: DataFrame, folder: str, length: int = LENGTH, anchor: int = ANCHOR, batches: int = BATCHES, chunk_rows: int = CHUNK_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, n_shared, kept (binary), for each row.

    The table is indexed in ``batches`` batches, dealt by a hash of the id; work
    tables go to ``folder``, which executors share.
    """
    spark = docs.sparkSession
    docs = ids_and_texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    index = SuffixIndex(spark, folder)
    for i in range(batches):
        index.add(entries(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == i), length, anchor))
    repeated = materialise(index.repeated(), folder, "repeated")
    shared = materialise(repeated.groupBy("doc_id").agg(F.count("*").alias("n_shared")), folder, "shared")
    classes = materialise(repeated.groupBy("key", "reach").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "at")).alias("one")), folder, "classes")

    # entries with twins repeat their whole reach
    twins = _semi(repeated, classes.where("n > 1"), ["key", "reach"])
    whole = twins.select("doc_id", F.greatest(F.col("at") - (length - anchor), F.lit(0)).alias("start"), (F.col("at") + length).alias("end"))
    # anchors with several reaches are compared in full, one entry for each reach, in chunks
    several = classes.groupBy("key").agg(F.count("*").alias("c"), F.min("n").alias("least")).where("c > 1 AND least = 1").select("key", F.ceil(F.col("c") / chunk_rows).cast("int").alias("chunks"))
    salted = classes.select("key", "one.doc_id", "one.at", F.pmod(F.xxhash64("reach"), F.lit(SALTS)).cast("int").alias("salt"))
    wanted = salted.join(dealt(several, SALTS), ["key", "salt"]).select("key", "chunks", "doc_id", "at")
    texts = packed_texts(docs)
    chunk = F.when(F.col("chunks") > 1, F.pmod(F.xxhash64("doc_id", "at"), F.col("chunks"))).otherwise(0).cast("int")
    groups = _contexts(wanted, texts, length, anchor).withColumn("chunk", chunk).repartition(shuffle_partitions(spark), "key", "chunk").sortWithinPartitions("key", "chunk")
    marks = materialise(_marked(groups, length, anchor), folder, "marks")
    spans = marks.where("context IS NULL").select("doc_id", "start", "end").union(whole)
    frequent = marks.where("context IS NOT NULL")
    if not frequent.isEmpty():
        spans = spans.union(_across_chunks(frequent, length, anchor))
    spans = materialise(spans, folder, "spans")
    for name in ("repeated", "classes", "marks", *(x[0] for x in index.levels if x), *(f"found-{i + 1}" for i in range(index.n))):
        delete(spark, f"{folder}/{name}")
    text = F.coalesce("text", F.lit(""))
    none = docs.where(F.col("doc_id").isNull()).select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.lit(0).cast("long").alias("n_shared"), F.encode(text, "UTF-8").alias("kept"))
    return _cut(texts, spans, shared, length).union(none)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_bytes(table(spark, sf_dir, "documents"), work_dir(spark))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_shared")
