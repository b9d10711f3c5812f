"""Shared helpers: tables, the shared work folder, and vectorised text batches.

Texts reach Python in Arrow batches.  ``TextBatch`` keeps a batch as one byte
buffer with offsets and finds words and fingerprints with numpy over the whole
buffer, so that no Python code runs for each word.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space and \t \n \v \f \r; words are the runs of other bytes.
SPACES = b" \t\n\x0b\x0c\r"
SPACE_CHARS = SPACES.decode()

#: Bytes of text handled at once inside a worker; a longer document is handled alone.
CHUNK_BYTES = 2 << 20

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
#: Letters and digits make words here; bytes of other scripts are letters.
NOT_LETTER = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Places whose hashes are made at once.
ROLLED = 1 << 14
#: Bytes of a span that is hashed by sums of powers.
SUMMED = 48

BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a registered query."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch: with Spark's 10,000, long texts would make batches of many GB.
BATCH_ROWS = 1_000


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's rows of an Arrow batch to BATCH_ROWS, unless they are fewer already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def work_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir; it goes when the application ends.

    A cluster names that folder; only a local session, all of which runs on one
    machine, may lack it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        base = f"file://{tempfile.gettempdir()}/histlake-checkpoints"
    path = f"{base.rstrip('/')}/histlake-{uuid.uuid4().hex}"
    where, files = _hadoop(spark, path)
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialise(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write df below the shared folder and read it again: short lineage, no local copies."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, folder: str, name: str) -> DataFrame:
    """materialise, after which the shuffle files that it took may go.

    Spark removes them once the driver has collected the plan as garbage; left
    alone, a driver that allocates little keeps those of many steps.
    """
    out = materialise(df, folder, name)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def delete(spark: SparkSession, path: str) -> None:
    where, files = _hadoop(spark, path)
    files.delete(where, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(df: DataFrame, size: int, least: int) -> int:
    """Into how many parts of about `size` bytes a table is dealt, by the size that the optimiser knows of its files; `least` at least."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # where nothing is known, the optimiser says more than any table has
    return max(least, min(-(-known // size), MOST_PARTS)) if known < 1 << 60 else least


def dealt(df: DataFrame, salts: int) -> DataFrame:
    """df once for each of `salts` parts, which column salt names, for a join that is no broadcast: Spark takes such a table to be as small as df, and the driver would gather all its copies."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")


#: Parts that a table is dealt into at most: numbers of parts travel in 20 bits.
MOST_PARTS = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place on a fresh array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base ** (0..n-1) modulo 2**64, kept and lengthened when needed."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(1 << max(16, (n - 1).bit_length()), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; spans are sorted by start and by end.

    Prefix sums of a polynomial hash, in segments so that the tables of powers
    stay small beside any text.  Such sums modulo 2**64 can cancel in long spans
    of a certain build, so spans of over SUMMED bytes are hashed one by one.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    long_ = np.flatnonzero(ends - starts > SUMMED)
    if len(long_):
        short = np.flatnonzero(ends - starts <= SUMMED)
        whole = data[starts[long_[0]] : ends[long_[-1]]].tobytes()
        base = int(starts[long_[0]])
        out[long_] = [xxhash.xxh3_64_intdigest(whole[a:b]) for a, b in zip((starts[long_] - base).tolist(), (ends[long_] - base).tolist(), strict=True)]
        out[short] = span_hashes(data, starts[short], ends[short])
        return out
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + CHUNK_BYTES, side="right")))
        a, b = starts[i:j] - base, ends[i:j] - base
        piece = data[base : int(ends[j - 1])].astype(np.uint64)
        piece += np.uint64(1)
        piece *= powers(BASE, len(piece))
        sums = np.empty(len(piece) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(piece, out=sums[1:])
        h = sums[b] - sums[a]
        h *= powers(BASE_INVERSE, len(piece))[a] if len(piece) else np.uint64(1)
        h ^= (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        out[i:j] = mix(h)
        i = j
    return out


def rolling_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the `size` (8 or more) bytes at each place of data.

    Built by doubling: halves are mixed before they are joined, so no sum of
    powers can cancel, whatever the bytes.
    """
    n = len(data) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    if n > ROLLED:  # parts that stay in the processor's cache
        return np.concatenate([rolling_hashes(data[i : i + ROLLED + size - 1], size) for i in range(0, n, ROLLED)])
    level = mix(_eights(data))
    width, done, out = 8, 0, None
    while True:
        if size & width or width * 2 > size:
            # the places that are still to be joined begin after what is done
            rest = level[done : done + n]
            out = rest.copy() if out is None else _joined(out, rest)
            done += width
        if width * 2 > size:
            break
        level = _joined(level[: len(level) - width], level[width:])
        width *= 2
    if done < size:  # the last bytes, by an overlapping part of 8
        out = _joined(out, mix(_eights(data))[size - 8 : size - 8 + n])
    return out


def _eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place as a number."""
    out = np.empty(len(data) - 7, dtype=np.uint64)
    for r in range(min(8, len(out))):
        count = (len(data) - r) // 8
        out[r::8] = np.frombuffer(data[r : r + 8 * count].tobytes(), dtype=np.uint64)
    return out


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(32)
    out += b
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    g = words[:n].copy()
    for j in range(1, k):
        g *= np.uint64(0xFF51AFD7ED558CCD)
        g += words[j : n + j]
    return mix(g)


class TextBatch:
    """Documents of a batch: ids, one byte buffer, offsets (len + 1)."""

    def __init__(self, ids: pa.Array, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        self.ids = ids
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
        raw = raw[offsets[0] : offsets[-1]]
        self.data = _LOWER[raw] if lower else raw
        self.offsets = offsets - offsets[0]

    def __len__(self) -> int:
        return len(self.ids)

    def words(self, breaks: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and where each document's words begin (len + 1).

        ``breaks`` says of each byte value whether it parts words.
        """
        n = len(self.data)
        inside = np.zeros(n + 1, dtype=bool)
        inside[:n] = ~breaks[self.data]
        first = np.zeros(n + 1, dtype=bool)
        first[self.offsets] = True
        before = np.empty(n, dtype=bool)
        before[:1] = True
        before[1:] = ~inside[: n - 1] if n else False
        starts = np.flatnonzero(inside[:n] & (before | first[:n]))
        ends = np.flatnonzero(inside[:n] & (~inside[1:] | first[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def word_hashes(self, breaks: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        starts, ends, bounds = self.words(breaks)
        return starts, ends, bounds, span_hashes(self.data, starts, ends)


def text_chunks(batches: Iterator[pa.RecordBatch], id_col: str = "doc_id", text_col: str = "text", lower: bool = False, size: int = CHUNK_BYTES, fold: bool = False) -> Iterator[tuple[TextBatch, pa.RecordBatch]]:
    """The batches, cut into parts of about `size` bytes of text, whole documents each.

    ``lower`` makes A-Z lower case, ``fold`` the letters of all scripts.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(text_col)), 0).cast(pa.int64()))
        totals = np.cumsum(lengths)
        i = 0
        while i < batch.num_rows:
            done = int(totals[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(totals, done + size, side="right")))
            part = batch.slice(i, j - i)
            text = pc.utf8_lower(part.column(text_col)) if fold else part.column(text_col)
            yield TextBatch(part.column(id_col), text, lower), part
            i = j


def gathered(batches: Iterator[pa.RecordBatch], size: int, text_col: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches, joined until they hold about `size` bytes of text."""
    held, total = [], 0

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            total += batch.column(text_col).nbytes
            if total >= size:
                yield joined()
                held, total = [], 0
    if held:
        yield joined()


def gram_valid(bounds: np.ndarray, n_words: int, k: int) -> np.ndarray:
    """Which starts of k-grams stay inside one document."""
    n = n_words - k + 1
    if n <= 0:
        return np.empty(0, dtype=bool)
    ok = np.ones(n, dtype=bool)
    inner = bounds[1:-1]
    for j in range(1, k):
        at = inner - j
        ok[at[(at >= 0) & (at < n)]] = False
    return ok


def ids_and_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under fixed names."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def packed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, packed: each text as zstd, a third of its size in a shuffle; null ids are left out.

    Compressed again and again with one context; the text is UTF-8.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1, write_content_size=True).compress
        for batch in batches:
            packed = [press((t or "").encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary())], names=["doc_id", "packed"])

    return docs.where(F.col("doc_id").isNotNull()).mapInArrow(run, "doc_id long, packed binary")


def unpack(packed: pa.Array) -> list[bytes]:
    import zstandard

    open_ = zstandard.ZstdDecompressor().decompress
    return [b"" if x is None else open_(x) for x in packed.to_pylist()]


def byte_batch(ids: pa.Array, texts: list[bytes], lower: bool = False) -> TextBatch:
    """A TextBatch over texts that are bytes already."""
    batch = TextBatch.__new__(TextBatch)
    batch.ids = ids
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    batch.data = _LOWER[data] if lower else data
    batch.offsets = np.cumsum([0] + [len(t) for t in texts])
    return batch
