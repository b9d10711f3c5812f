"""MinHash near-dedup: universal hash minima, banding, verification, components.

A document's set is its distinct 5-word shingles (A-Z in lower case).  Equal
sets are one class, found by a 128-bit fingerprint; only class representatives
go on.  Bands of three minima name buckets.  A bucket of up to ``SMALL``
members is used as it is; larger ones hold many documents that share a passage
but little else, so their members are dealt anew by longer bands (five minima,
drawn from the whole signature), which only similar documents share.

In each bucket the smallest representative is paired with the others (a star,
never all pairs; in the long bands' buckets batch by batch, then among the
smallest of the batches).  Pairs are filtered by their signatures, then confirmed on
their full sets; confirmed links give components by alternating large-star and
small-star.  Where a bucket still holds several components, its members are
compared anew, exactly: pairs must share one of their rarest shingles (a prefix
filter), and what does is confirmed alike, so a link between two members that
are no leaders is not lost.

A pair at exactly 0.75 shares no short band with probability 2e-7, no long band
with about 1e-6, and fails the signature filter with about 1e-6.

Defined cases: null or empty text has an empty set and no links; repeated rows
of one id are one document (ids must not stand for different texts); a null id
is linked with nothing, has a null component and is kept; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import TextBatch, byte_batch, dealt, delete, gram_valid, grams, ids_and_texts, materialise, mix, packed_texts, parts_for, settle, shuffle_partitions, table, text_chunks, unpack, work_dir
from .components import connected_components

SHINGLE_WORDS = 5
MINIMA = 256
BANDS, ROWS = 28, 3
LONG_BANDS, LONG_ROWS = 64, 5
PERCENT = 75
#: Members of a bucket above which it is dealt anew by the long bands.
SMALL = 64
#: Bytes of signatures whose long bands' keys make one part.
PART_BYTES = 4 << 20
#: Parts that a group of copies is dealt over where its class is looked up.
SALTS = 8
#: Agreeing minima of all below which a pair is not compared: 4.8 deviations below 0.75.
LEAST_AGREEING = 159

_DRAW = np.random.default_rng(20240607)
_FACTORS = _DRAW.integers(1, 1 << 32, size=MINIMA, dtype=np.uint32) | np.uint32(1)
_TERMS = _DRAW.integers(0, 1 << 32, size=MINIMA, dtype=np.uint32)
_LONG = np.array([_DRAW.choice(MINIMA, LONG_ROWS, replace=False) for _ in range(LONG_BANDS)])


def shingle_sets(batch: TextBatch, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """All documents' distinct shingle hashes, in order of document and hash, and their bounds (len + 1)."""
    _, _, bounds, hashes = batch.word_hashes()
    n_words = np.diff(bounds)
    doc = np.repeat(np.arange(len(batch), dtype=np.int64), n_words)
    ok = np.flatnonzero(gram_valid(bounds, len(hashes), k))
    found, owner = grams(hashes, k)[ok], doc[ok]
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):  # the whole sequence is one shingle
        whole = np.array([mix(grams(hashes[bounds[d] : bounds[d + 1]], int(n_words[d])) + np.uint64(n_words[d]))[0] for d in short], dtype=np.uint64)
        found, owner = np.concatenate((found, whole)), np.concatenate((owner, short))
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    first = np.ones(len(found), dtype=bool)
    first[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    found, owner = found[first], owner[first]
    return found, np.searchsorted(owner, np.arange(len(batch) + 1))


def minima(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(documents with a set) x MINIMA minima of the universal hashes a * x + b of the sets' high 32 bits."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(starts), MINIMA), dtype=np.uint32)
    if len(starts):
        high = (sets >> np.uint64(32)).astype(np.uint32)
        scratch = np.empty_like(high)
        for i in range(MINIMA):
            np.multiply(high, _FACTORS[i], out=scratch)
            scratch += _TERMS[i]
            out[:, i] = np.minimum.reduceat(scratch, starts)
    return out


def signatures(low: np.ndarray) -> np.ndarray:
    """A byte of each minimum."""
    return np.ascontiguousarray((mix(low) >> np.uint64(56)).astype(np.uint8))


def _keys(values: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """A key for each band, which is a row of places in the values."""
    keys = np.empty((len(values), len(bands)), dtype=np.uint64)
    for b, places in enumerate(bands):
        key = np.full(len(values), b + 1, dtype=np.uint64)
        for r in places:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + values[:, r])
        keys[:, b] = key
    return keys.view(np.int64)


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (fingerprint of the set), signature (a byte of each minimum), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _ in text_chunks(batches, lower=True):
            sets, bounds = shingle_sets(chunk)
            n = np.diff(bounds)
            prefix = lambda x: np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(x, dtype=np.uint64)))
            one, two = prefix(mix(sets)), prefix(mix(sets ^ np.uint64(0x5851F42D4C957F2D)))
            f1, f2 = (one[bounds[1:]] - one[bounds[:-1]]).view(np.int64), (two[bounds[1:]] - two[bounds[:-1]]).view(np.int64)
            low = minima(sets, bounds)
            keys = _keys(low, np.arange(BANDS * ROWS).reshape(BANDS, ROWS))
            signs = signatures(low)
            has = n > 0
            at = np.cumsum(has) - 1
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(has * BANDS))), pa.int32()), pa.array(keys.ravel()))
            signature = pa.array([signs[i].tobytes() if h else None for i, h in zip(at, has, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([chunk.ids, pa.array(n.astype(np.int64)), pa.array(f1), pa.array(f2), signature, bands], names=["doc_id", "n_shingles", "f1", "f2", "signature", "bands"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, signature binary, bands array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    Both texts come by a join on the id; sets are made and compared in the task.
    """
    one = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("packed").alias("text_a")), "a")
    two = one.join(texts.select(F.col("doc_id").alias("b"), F.col("packed").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                left, bounds_a = shingle_sets(byte_batch(part.column("a"), unpack(part.column("text_a")), lower=True))
                right, bounds_b = shingle_sets(byte_batch(part.column("b"), unpack(part.column("text_b")), lower=True))
                n_a, n_b = np.diff(bounds_a), np.diff(bounds_b)
                pair = np.concatenate((np.repeat(np.arange(part.num_rows), n_a), np.repeat(np.arange(part.num_rows), n_b)))
                value = np.concatenate((left, right))
                order = np.lexsort((value, pair))
                value, pair = value[order], pair[order]
                both = np.bincount(pair[1:][(value[1:] == value[:-1]) & (pair[1:] == pair[:-1])], minlength=part.num_rows)
                ok = (100 * both >= percent * (n_a + n_b - both)) & (n_a > 0)
                yield part.select(["a", "b"]).filter(pa.array(ok))

    return two.mapInArrow(run, "a long, b long")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


def _agreeing(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree often enough."""
    signed = pairs.join(signs.select(F.col("doc_id").alias("a"), F.col("signature").alias("sign_a")), "a").join(signs.select(F.col("doc_id").alias("b"), F.col("signature").alias("sign_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = (_matrix(batch.column("sign_a")) == _matrix(batch.column("sign_b"))).sum(axis=1)
                yield batch.select(["a", "b"]).filter(pa.array(same >= LEAST_AGREEING))

    return signed.select("a", "b", "sign_a", "sign_b").mapInArrow(run, "a long, b long")


BLOCKS = "part int, kind int, a binary, b binary, n binary"


def _blocks(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "kind", "a", "b", "n"])


def _dealt(keys: np.ndarray, values: np.ndarray, counts: np.ndarray, n_parts: int) -> list[tuple]:
    """Blocks of entries (kind 0), by key."""
    part = ((keys.view(np.uint64) >> np.uint64(40)) % np.uint64(n_parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
    return [(int(part[x[0]]), 0, keys[x].tobytes(), values[x].tobytes(), counts[x].tobytes()) for x in np.split(order, cuts[1:])] if len(order) else []


def _ordered(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by key and value, and where a new key begins in it."""
    order = np.lexsort((values, keys))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = keys[order][1:] != keys[order][:-1]
    return order, fresh


def _pairs(keys: np.ndarray, reps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys and their smallest members, and the distinct pairs of these with the others."""
    order, fresh = _ordered(keys, reps)
    k, r = keys[order], reps[order]
    low = r[fresh][np.cumsum(fresh) - 1]
    pairs = np.unique(np.stack((low, r), axis=1)[low != r], axis=0)
    return k[fresh], r[fresh], pairs[:, 0], pairs[:, 1]


def _signed_keys(batches: Iterator[pa.RecordBatch], value: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The long bands' keys of the rows, and a value of each row, once for each key."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            yield _keys(_matrix(part.column("signature")), _LONG).ravel(), np.repeat(np.asarray(part.column(value)), LONG_BANDS)


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], list[tuple]]]:
    """Part by part: its entries and what only passes through."""
    rows = (r for x in batches for r in zip(*(x.column(c).to_pylist() for c in ("part", "kind", "a", "b", "n")), strict=True))
    for _, group in groupby(rows, key=lambda r: r[0]):
        found = list(group)
        yield [r[2:] for r in found if r[1] == 0], [r[2:] for r in found if r[1] == 1]


def _joined(rows: list[tuple], i: int) -> np.ndarray:
    return np.frombuffer(b"".join(r[i] for r in rows), dtype=np.int64)


def _long_stars(reps: DataFrame, n_parts: int) -> DataFrame:
    """Pairs (a, b): in each bucket of the long bands the members of a batch with the smallest of them, and these with the smallest of all.

    reps(doc_id, signature).  A batch sends a key once, so a bucket of very many
    members is one entry for each batch.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, names in _signed_keys(batches, "doc_id"):
            k, low, a, b = _pairs(keys, names)
            rows = _dealt(k, low, np.ones(len(k), dtype=np.int64), n_parts)
            yield _blocks([*rows, (rows[0][0], 1, a.tobytes(), b.tobytes(), b"")])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for entries, told in _by_part(batches):
            _, _, a, b = _pairs(_joined(entries, 0), _joined(entries, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((a, _joined(told, 0)))), pa.array(np.concatenate((b, _joined(told, 1))))], names=["a", "b"])

    return _gathered(reps.mapInArrow(send, BLOCKS)).mapInArrow(meet, "a long, b long").distinct()


def _long_parts(reps: DataFrame, n_parts: int) -> DataFrame:
    """key, component, n: the components of the long bands' buckets that hold several; reps(signature, component)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, values in _signed_keys(batches, "component"):
            yield _blocks(_dealt(*_counted(keys, values, np.ones(len(keys), dtype=np.int64)), n_parts))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for entries, _ in _by_part(batches):
            k, c, n = _counted(_joined(entries, 0), _joined(entries, 1), _joined(entries, 2))
            _, which, times = np.unique(k, return_inverse=True, return_counts=True)
            mixed = times[which] > 1
            yield pa.RecordBatch.from_arrays([pa.array(k[mixed]), pa.array(c[mixed]), pa.array(n[mixed])], names=["key", "component", "n"])

    return _gathered(reps.mapInArrow(send, BLOCKS)).mapInArrow(meet, "key long, component long, n long")


def _counted(keys: np.ndarray, values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (key, value) and the sums of their counts."""
    order, fresh = _ordered(keys, values)
    k, v = keys[order], values[order]
    fresh[1:] |= v[1:] != v[:-1]
    return k[fresh], v[fresh], np.add.reduceat(counts[order], np.flatnonzero(fresh))


def _gathered(blocks: DataFrame) -> DataFrame:
    return blocks.repartition(shuffle_partitions(blocks.sparkSession), "part").sortWithinPartitions("part")


def _mixed(placed: DataFrame, long_parts: DataFrame, crowded: DataFrame) -> DataFrame:
    """rep, component, outside: the members of components that meet others in a bucket; outside: one of them is larger there.

    placed(key, rep, component) are the members of short bands' buckets, crowded(rep, component) those of the long ones'.
    """
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("n")).union(long_parts)
    mixed = parts.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("n", "component")).alias("largest")).where("parts > 1").select("key", F.col("largest.component").alias("largest"))
    meets = parts.join(mixed, "key").groupBy("component").agg(F.max(F.col("component") != F.col("largest")).alias("outside"))
    return placed.select("rep", "component").union(crowded.select("rep", "component")).distinct().join(meets, "component").select("rep", "component", "outside")


def _shingles(members: DataFrame, texts: DataFrame) -> DataFrame:
    """rep, n, h: the sets of members, a row for each shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                sets, bounds = shingle_sets(byte_batch(part.column("rep"), unpack(part.column("packed")), lower=True))
                n = np.diff(bounds)
                which = pa.array(np.repeat(np.arange(part.num_rows), n))
                yield pa.RecordBatch.from_arrays([part.column("rep").take(which), pa.array(np.repeat(n, n).astype(np.int64)), pa.array(sets.view(np.int64))], names=["rep", "n", "h"])

    joined = members.select("rep").join(texts.select(F.col("doc_id").alias("rep"), "packed").dropDuplicates(["rep"]), "rep")
    return joined.select("rep", "packed").mapInArrow(run, "rep long, n long, h long")


def sharing_rare_shingles(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components, one of them outside, that can reach PERCENT.

    Exact: with shingles from rare to common, such a pair shares one among the
    first n - ceil(3 n / 4) + 1 of the larger set and the first
    n - ceil(6 n / 7) + 1 of the smaller (for 75 percent), early enough that the
    rest of both sets can hold the overlap that is still needed.  A passage that many
    members share is common, so it makes no pairs; only members that differ in
    little else meet, and those are linked already but for a few.
    """
    rows = _shingles(members, texts)
    shared = rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    mine = W.partitionBy("rep")
    placed = rows.join(shared, "h").select("*", F.row_number().over(mine.orderBy("df", "h")).alias("r"), F.count("*").over(mine).alias("held"))
    place = F.col("n") - F.col("held") + F.col("r")  # those that no other member holds come first
    n = F.col("n")
    probe = n - F.ceil(n * PERCENT / 100) + 1
    index = n - F.ceil(n * (2 * PERCENT) / (100 + PERCENT)) + 1
    heads = placed.where(place <= probe).select("rep", "n", "h", place.alias("place"), (place <= index).alias("first")).join(members, "rep")
    x, y = heads.where("outside").alias("x"), heads.alias("y")
    smaller = (F.col("x.n") < F.col("y.n")) | (F.col("x.n") == F.col("y.n")) & (F.col("x.rep") < F.col("y.rep"))
    meets = F.when(smaller, F.col("x.first")).otherwise(F.col("y.first"))
    # before a first common shingle nothing is common, so what follows must be enough
    enough = 1 + F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) >= F.ceil((F.col("x.n") + F.col("y.n")) * PERCENT / (100 + PERCENT))
    pairs = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.component") != F.col("y.component")) & enough & meets)
    return pairs.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row.  Work tables go to ``folder``, which executors share."""
    spark = docs.sparkSession
    docs = ids_and_texts(docs, id_col, text_col)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    whole = materialise(profiles(docs), folder, "profiles")
    found = materialise(whole.select("doc_id", "n_shingles", "f1", "f2"), folder, "sets")
    linked = "doc_id IS NOT NULL AND n_shingles > 0"
    classes = found.where(linked).groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    reps = whole.where(linked).join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    signs = settle(reps.select("doc_id", "n_shingles", "signature", "bands"), folder, "signatures")
    delete(spark, f"{folder}/profiles")

    short = signs.select(F.explode("bands").alias("key"), F.col("doc_id").alias("rep"))
    sizes = short.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("low")).where("n > 1")
    met = settle(short.join(sizes, "key"), folder, "met")
    hot = met.where(F.col("n") > SMALL).select(F.col("rep").alias("doc_id")).distinct()
    crowded = settle(signs.join(hot, "doc_id", "left_semi").select("doc_id", "signature"), folder, "crowded")
    n_parts = parts_for(crowded, PART_BYTES, 4 * shuffle_partitions(spark))
    buckets = met.where(F.col("n") <= SMALL)

    star = buckets.where("rep <> low").select(F.col("low").alias("a"), F.col("rep").alias("b")).union(_long_stars(crowded, n_parts)).distinct()
    tried = settle(_agreeing(star, signs), folder, "tried")
    delete(spark, f"{folder}/signatures")
    texts = packed_texts(docs)
    links = settle(confirmed(tried, texts), folder, "links")
    components = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), f"{folder}/components", "first")

    # buckets that still hold several components
    known = components.withColumnRenamed("node", "rep")
    placed = buckets.where("n > 2").join(known, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    met_anew = crowded.withColumnRenamed("doc_id", "rep").join(known, "rep", "left").select("rep", "signature", F.coalesce("component", "rep").alias("component"))
    members = settle(_mixed(placed, _long_parts(met_anew.select("signature", "component"), n_parts), met_anew), folder, "members")
    for name in ("met", "crowded"):
        delete(spark, f"{folder}/{name}")
    more = settle(sharing_rare_shingles(members, texts).join(tried, ["a", "b"], "left_anti"), folder, "more")
    if not more.isEmpty():
        new = settle(confirmed(more, texts), folder, "more-links")
        if not new.isEmpty():
            components = connected_components(links.union(new).select(F.col("a").alias("u"), F.col("b").alias("v")), f"{folder}/components", "second")

    # documents look their class up in parts, so that a large group of copies is no single task's
    moved = components.where("node <> component").select(F.col("node").alias("rep"), "component")
    told = classes.join(moved, "rep", "left").where("copies > 1 OR component IS NOT NULL")
    told = told.select("f1", "f2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    salted = found.select("doc_id", "n_shingles", "f1", "f2", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    final = salted.join(dealt(told, SALTS), ["f1", "f2", "n_shingles", "salt"], "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), own)
    return final.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are kept, in all their columns: the smallest id of each component."""
    result = settle(near_duplicates(docs, folder, id_col, text_col), folder, "result")
    _tidy(docs.sparkSession, folder)
    gone = result.where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col(f"`{id_col}`") == F.col("__gone"), "left_anti")


def keep_first_of(docs: DataFrame, known: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of docs, of each group of near-duplicates among ``known`` the smallest id that docs has.

    known has the texts that are compared, under the same ids, and may hold
    more documents; docs that it lacks, or without an id, stay.
    """
    groups = settle(near_duplicates(known, folder, id_col, text_col), folder, "groups")
    _tidy(docs.sparkSession, folder)
    members = groups.where("doc_id IS NOT NULL").select("doc_id", "component_id").distinct()
    here = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id")).distinct().join(members, "doc_id")
    first = here.groupBy("component_id").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = here.join(first, "component_id").where("doc_id > first").select(F.col("doc_id").alias("__gone"))
    gone = settle(gone, folder, "gone")
    delete(docs.sparkSession, f"{folder}/groups")
    return docs.join(gone, F.col(f"`{id_col}`") == F.col("__gone"), "left_anti")


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those whose text a smaller id has; those without an id or a text stay.  Texts are known by 256 bits, counted partially before their shuffle."""
    told = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.unhex(F.sha2(F.col(f"`{text_col}`"), 256)).alias("digest")).where("__id IS NOT NULL AND digest IS NOT NULL")
    first = told.groupBy("digest").agg(F.min("__id").alias("first"), F.max("__id").alias("last")).where("first < last")
    gone = told.join(first, "digest").where("__id > first").select(F.col("__id").alias("__gone")).distinct()
    return docs.join(gone, F.col(f"`{id_col}`") == F.col("__gone"), "left_anti")


def _tidy(spark: SparkSession, folder: str) -> None:
    for name in ("sets", "tried", "links", "components", "members", "more", "more-links"):
        delete(spark, f"{folder}/{name}")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark)
    result = settle(near_duplicates(table(spark, sf_dir, "documents"), folder), folder, "result")
    _tidy(spark, folder)
    return result


#: All pairs that share a shingle: for small tables.
OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, x.b FROM reached r JOIN both_ x ON x.a = r.b),
roots AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT d.doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN roots ON roots.doc_id = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id
"""
