"""The data source "git_objects": the objects of repositories as rows.

    spark.dataSource.register(GitObjects)
    spark.read.format("git_objects").option("path", "/repo").option("kinds", "commit,tag").load()

Options: path (a repository, or a .pack file), repo (its name, by default the
path), kinds (all by default), sha and offset (only these, comma-separated), pushdown ("true" takes kinds, ids and offsets from filters as
well, where spark.sql.python.filterPushdown.enabled is set), content ("false" leaves bodies null, and with an
index reads headers only), loose ("false" leaves loose objects out), partition_bytes, parts ("a:b", some of the partitions).

Partitions are in storage order: packs by their ids, their parts by the first
offset, then loose files.  Ids are looked up in the indexes, and then only the
delta chains below them are inflated; ``read_ids`` does so for a table of ids.
Deltas whose bases a pack does not hold have no row here: the data source
"git_open_deltas" lists them, ``deltas.resolve`` joins them to their bases.

A pack of more than partition_bytes becomes partitions along its delta families, so that no base is read
twice and packs of any size spread over many tasks.  Planning reads its index
and all headers as arrays; a partition carries the offsets and ids of its own
objects.  Other packs are read whole, by a task that reads their indexes, so that planning
touches no object of them; small ones that follow each other share a task.  Where a pack without an index has its
objects only a walk from front to back tells: a small one is walked by its task.  Executors read the path
themselves: it must be on storage that all of them mount.  ``from_binary_files``
reads repositories in stores that only Spark can reach.
"""

from __future__ import annotations

import mmap
import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from histlake.schema import KIND_NAMES, OBJECTS
from histlake.sources import packfmt
from histlake.sources.refs import git_dir

PARTITION_BYTES = 64 << 20
#: Tasks that whole packs make at least, where there are as many packs.
LEAST_PARTS = 64
LOOSE_FILES = 5_000
POINTS = 1_000
BATCH_BYTES = 8 << 20
#: Rows of an index that are listed at once, bytes of indexes that a task lists, and such tasks at least (where there are as many packs) and at most.
INDEX_ROWS, INDEX_BYTES, LEAST_INDEX_PARTS, INDEX_PARTS = 10_000, 4 << 20, 24, 1_000

ARROW = pa.schema([("repo", pa.string()), ("storage", pa.string()), ("pack_id", pa.string()), ("offset", pa.int64()), ("sha", pa.string()), ("kind", pa.string()), ("size", pa.int64()), ("content", pa.binary())])


@dataclass
class Part(InputPartition):
    """Offsets of a pack (int64) and their ids (20 bytes each), whole packs (offsets is None), or loose files.

    points: of the pack only these objects are wanted; their bases are elsewhere in it.
    more: the packs that follow, whole as the first.
    """

    pack: str | None
    offsets: bytes | None = None
    ids: bytes = b""
    files: tuple[str, ...] = ()
    points: bool = False
    more: tuple[str, ...] = ()

    def first(self) -> int:
        return int(np.frombuffer(self.offsets, dtype=np.int64)[0]) if self.offsets else 12


def mapped(path: str):
    with open(path, "rb") as f:
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


def _index(path: str) -> list[tuple[str, int]] | None:
    name = path.removesuffix(".pack") + ".idx"
    if not os.path.isfile(name):
        return None
    with open(name, "rb") as f:
        return packfmt.parse_index(f.read())


def _planned(path: str, budget: int) -> list[Part]:
    if os.path.getsize(path) <= budget:
        return [Part(path)]
    name = path.removesuffix(".pack") + ".idx"
    data = np.frombuffer(mapped(path), dtype=np.uint8)
    if not os.path.isfile(name):
        # only a walk tells where objects begin; reading them is then spread
        ordered = np.array(packfmt.PackReader(mapped(path)).offsets_forward(), dtype=np.int64)
        return [Part(path, x.tobytes()) for x in packfmt.families(ordered, packfmt.bases(data, ordered), len(data), budget)]
    with open(name, "rb") as f:
        ids, at_ids = packfmt.read_index(f.read())
    order = np.argsort(at_ids)
    ordered = at_ids[order]
    parts = packfmt.families(ordered, packfmt.bases(data, ordered, ids, at_ids), len(data), budget)
    return [Part(path, x.tobytes(), ids[order[np.searchsorted(ordered, x)]].tobytes()) for x in parts]


def _joined(parts: list[Part], most: int) -> list[Part]:
    """Whole packs that follow each other in one part, up to so many bytes."""
    out, size = [], 0
    for part in parts:
        own = os.path.getsize(part.pack)
        if out and part.offsets is None and out[-1].offsets is None and size + own <= most:
            out[-1].more += (part.pack,)
            size += own
        else:
            out.append(part)
            size = own
    return out


def _listed(path: str) -> tuple[list[int], bytes] | None:
    """Offsets of a pack in order and their ids (20 bytes each), by its index; None without one."""
    if not has_index(path):
        return None
    ids, at_ids = packfmt.read_index(mapped(path.removesuffix(".pack") + ".idx"))
    order = np.argsort(at_ids)
    return at_ids[order].tolist(), ids[order].tobytes()


def _ids_at(offsets: list[int], ids: bytes) -> dict[int, str]:
    names = ids.hex()
    return {o: names[40 * i : 40 * i + 40] for i, o in enumerate(offsets)} if ids else {}


def pack_files(path: str) -> list[str]:
    if path.endswith(".pack"):
        return [path]
    folder = os.path.join(git_dir(path), "objects", "pack")
    return sorted(os.path.join(folder, n) for n in os.listdir(folder) if n.endswith(".pack")) if os.path.isdir(folder) else []


def has_index(pack: str) -> bool:
    return os.path.isfile(pack.removesuffix(".pack") + ".idx")


def mapped_index(pack: str) -> packfmt.PackIndex | None:
    return packfmt.PackIndex(mapped(pack.removesuffix(".pack") + ".idx")) if has_index(pack) else None


def loose_file(path: str, sha: str) -> str | None:
    name = None if path.endswith(".pack") else os.path.join(git_dir(path), "objects", sha[:2], sha[2:])
    return name if name and os.path.isfile(name) else None


def loose_files(path: str) -> list[str]:
    if path.endswith(".pack"):
        return []
    top = os.path.join(git_dir(path), "objects")
    folders = [d for d in sorted(os.listdir(top)) if len(d) == 2 and all(c in "0123456789abcdef" for c in d)]
    return [os.path.join(top, d, n) for d in folders for n in sorted(os.listdir(os.path.join(top, d))) if len(n) == 38]


def has_loose(path: str) -> bool:
    return not path.endswith(".pack") and any(len(d) == 2 for d in os.listdir(os.path.join(git_dir(path), "objects")))


class GitObjectsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.repo = options.get("repo", self.path)
        kinds = [k.strip() for k in options.get("kinds", "").split(",") if k.strip()]
        self.kinds = set(kinds) or set(KIND_NAMES)
        self.content = options.get("content", "true").lower() != "false"
        self.loose = options.get("loose", "true").lower() != "false"
        self.budget = int(options.get("partition_bytes", PARTITION_BYTES))
        listed = lambda name: {x.strip() for x in options[name].split(",") if x.strip()} if name in options else None
        self.ids = listed("sha")
        self.offsets = None if listed("offset") is None else {int(x) for x in listed("offset")}
        self.packs = {"indexed": has_index, "unindexed": lambda p: not has_index(p)}.get(options.get("packs", ""), lambda p: True)
        self.parts = tuple(int(x) for x in options["parts"].split(":")) if "parts" in options else None

    def partitions(self):
        parts = self.stored()
        if self.parts:
            parts = parts[self.parts[0] : self.parts[1]]
        return parts or [Part(None)]

    def stored(self) -> list[Part]:
        """All partitions, in storage order."""
        parts, packs = [], sorted(filter(self.packs, pack_files(self.path)), key=lambda p: packfmt.pack_id(mapped(p)))
        for path in packs:
            parts += self._points(path) if self.offsets is not None or self.ids is not None and has_index(path) else _planned(path, self.budget)
        parts = _joined(parts, min(self.budget, sum(map(os.path.getsize, packs)) // LEAST_PARTS))
        if self.loose and self.offsets is None:
            files = loose_files(self.path) if self.ids is None else sorted(f for x in self.ids if (f := loose_file(self.path, x)))
            parts += [Part(None, files=tuple(files[i : i + LOOSE_FILES])) for i in range(0, len(files), LOOSE_FILES)]
        return parts

    def _points(self, path: str) -> list[Part]:
        """The wanted objects of a pack: ids by its index, offsets as they are."""
        if self.ids is None:
            offsets = sorted(o for o in self.offsets if 12 <= o < os.path.getsize(path) - packfmt.ID_BYTES)
            if offsets:  # any number may be asked for: only places of objects are read
                known = _index(path)
                places = {o for _, o in known} if known is not None else set(packfmt.PackReader(mapped(path)).offsets_forward())
                offsets = [o for o in offsets if o in places]
            found = [(o, b"") for o in offsets]
        else:
            index = mapped_index(path)
            found = sorted((o, bytes.fromhex(x)) for x in self.ids if len(x) == 40 and (o := index.get(x)) is not None and (self.offsets is None or o in self.offsets))
        cut = lambda i: found[i : i + POINTS]
        return [Part(path, np.array([o for o, _ in cut(i)], dtype=np.int64).tobytes(), b"".join(x for _, x in cut(i)), points=True) for i in range(0, len(found), POINTS)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in chain.from_iterable(self._packed(p, part) for p in (part.pack, *part.more)) if part.pack else self._loose(part):
            rows.append(row)
            size += row[6] if self.content else 200
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _packed(self, path: str, part: Part) -> Iterator[tuple]:
        data = mapped(path)
        pack = packfmt.pack_id(data)
        if part.points:
            offsets = np.frombuffer(part.offsets, dtype=np.int64).tolist()
            for offset, kind, content in packfmt.PackReader(data, mapped_index(path)).points(offsets, self.kinds):
                sha = packfmt.object_id(kind, content)
                if self.ids is None or sha in self.ids:
                    yield self.repo, "pack", pack, offset, sha, kind, len(content), content if self.content else None
            return
        listed = (np.frombuffer(part.offsets, dtype=np.int64).tolist(), part.ids) if part.offsets is not None else _listed(path)
        if listed is None:
            sha_of, reader = {}, packfmt.PackReader(data)
            offsets = reader.offsets_forward()
        else:
            offsets, sha_of = listed[0], _ids_at(*listed)
            reader = packfmt.PackReader(data, {s: o for o, s in sha_of.items()})  # bases by id are in the same part
        if not self.content and sha_of:  # ids and kinds need no inflating; sizes of deltas would
            for offset in offsets:
                if (kind := reader.kind_of(offset)) in self.kinds:
                    yield self.repo, "pack", pack, offset, sha_of[offset], kind, None, None
            return
        read = reader.named if listed is None else reader.read
        for offset, kind, content in read(offsets, self.kinds):
            sha = sha_of.get(offset) or packfmt.object_id(kind, content)
            if self.ids is not None and sha not in self.ids:
                continue
            yield self.repo, "pack", pack, offset, sha, kind, len(content), content if self.content else None

    def _loose(self, part: Part) -> Iterator[tuple]:
        for path in part.files:
            try:
                with open(path, "rb") as f:
                    kind, content = packfmt.parse_loose(f.read())
            except (OSError, packfmt.FormatError):
                continue  # an object that is being written, or broken, is no object
            if kind in self.kinds:
                folder, name = os.path.split(path)
                yield self.repo, "loose", None, None, os.path.basename(folder) + name, kind, len(content), content if self.content else None


class PushingReader(GitObjectsReader):
    def pushFilters(self, filters):
        """What a filter on kinds, ids or offsets leaves out is not inflated; Spark applies the filter all the same."""
        meet = lambda old, new: new if old is None else old & new
        for f in filters:
            if isinstance(f, EqualTo | In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                if f.attribute == ("kind",):
                    self.kinds &= values
                elif f.attribute == ("sha",):
                    self.ids = meet(self.ids, values)
                elif f.attribute == ("offset",):
                    self.offsets = meet(self.offsets, values)
            yield f


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


class GitObjects(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_objects"

    def schema(self) -> str:
        return OBJECTS

    def reader(self, schema) -> GitObjectsReader:
        pushing = self.options.get("pushdown", "false").lower() == "true"
        return PushingReader(self.options) if pushing else GitObjectsReader(self.options)


class OpenDeltasReader(GitObjectsReader):
    """Deltas that end at an id which their pack does not hold."""

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for path in (part.pack, *part.more) if part.pack else ():
            data = mapped(path)
            reader = packfmt.PackReader(data)
            listed = (np.frombuffer(part.offsets, dtype=np.int64).tolist(), part.ids) if part.offsets is not None else _listed(path)
            if listed is None:
                offsets = reader.offsets_forward()
                for _ in reader.named(offsets, set()):  # names what the pack itself can resolve
                    pass
            else:
                offsets = listed[0]
                reader.offset_of = {s: o for o, s in _ids_at(*listed).items()}
            pack = packfmt.pack_id(data)
            for offset, root, level, base_sha, base_offset in reader.open_deltas(offsets):
                change = reader.delta(offset)
                rows.append((self.repo, pack, offset, root, level, base_sha, base_offset, change))
                size += len(change)
                if size >= BATCH_BYTES:
                    yield _open_batch(rows)
                    rows, size = [], 0
        if rows:
            yield _open_batch(rows)


OPEN_DELTAS = "repo string, pack_id string, offset long, root long, level int, base_sha string, base_offset long, delta binary"
_OPEN = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.binary())


def _open_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _OPEN, strict=True)], names=["repo", "pack_id", "offset", "root", "level", "base_sha", "base_offset", "delta"])


class GitOpenDeltas(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_open_deltas"

    def schema(self) -> str:
        return OPEN_DELTAS

    def reader(self, schema) -> OpenDeltasReader:
        return OpenDeltasReader(self.options)


def read_ids(ids: DataFrame, path: str, repo: str | None = None, kinds: list[str] | None = None) -> DataFrame:
    """The objects of a table of ids (sha), one row each, with chain, the streams inflated for it and the objects read with it.

    The ids are joined to those of the indexes, an id to the first pack that has
    it; then each pack's are read in order of place, and only their delta
    chains.  Loose files are asked where no pack has an id.  Packs without an
    index are scanned.
    """
    spark = ids.sparkSession
    name, wanted = repo or path, set(kinds or KIND_NAMES)
    packs = sorted(filter(has_index, pack_files(path)), key=lambda p: packfmt.pack_id(mapped(p)))
    columns = [f.name for f in ARROW]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rank in batch.column("rank").to_pylist():
                with open(packs[rank].removesuffix(".pack") + ".idx", "rb") as f:
                    names, offsets = packfmt.read_index(f.read())
                for i in range(0, len(offsets), INDEX_ROWS):
                    part = names[i : i + INDEX_ROWS]
                    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(packfmt.ID_BYTES), len(part), [None, pa.py_buffer(part.tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array([rank] * len(part), pa.int32()), raw.cast(pa.binary()), pa.array(offsets[i : i + INDEX_ROWS])], names=["rank", "name", "offset"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks, places, shas = (batch.column(c).to_pylist() for c in ("rank", "offset", "sha"))
            for rank in dict.fromkeys(ranks):
                at = {o: x for r, o, x in zip(ranks, places, shas, strict=True) if r == rank}
                data = mapped(packs[rank])
                reader, rows, size = packfmt.PackReader(data, mapped_index(packs[rank])), [], 0
                for offset, kind, content in reader.points(sorted(at), wanted):
                    rows.append((name, "pack", packfmt.pack_id(data), offset, at[offset], kind, len(content), content))
                    size += len(content)
                    if size >= BATCH_BYTES:
                        yield _batch(rows).append_column("chain", pa.array([reader.inflated] * len(rows), pa.int64()))
                        rows, size = [], 0
                if rows:
                    yield _batch(rows).append_column("chain", pa.array([reader.inflated] * len(rows), pa.int64()))

    def loose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for sha in batch.column("sha").to_pylist():
                if file := loose_file(path, sha):
                    try:
                        with open(file, "rb") as f:
                            kind, content = packfmt.parse_loose(f.read())
                    except packfmt.FormatError:
                        continue
                    if kind in wanted:
                        rows.append((name, "loose", None, None, sha, kind, len(content), content))
                        size += len(content)
                if size >= BATCH_BYTES:
                    yield _batch(rows).append_column("chain", pa.array([1] * len(rows), pa.int64()))
                    rows, size = [], 0
            if rows:
                yield _batch(rows).append_column("chain", pa.array([1] * len(rows), pa.int64()))

    asked = ids.select(F.lower("sha").alias("sha")).where("length(sha) = 40").distinct()
    schema = f"{OBJECTS}, chain long"
    if packs:
        tasks = max(LEAST_INDEX_PARTS, -(-sum(os.path.getsize(p.removesuffix(".pack") + ".idx") for p in packs) // INDEX_BYTES))
        each = spark.range(0, len(packs), 1, min(len(packs), tasks, INDEX_PARTS)).select(F.col("id").cast("int").alias("rank")).mapInArrow(listed, "rank int, name binary, offset long")
        places = each.select(F.lower(F.hex("name")).alias("sha"), F.struct("rank", "offset").alias("place"))
        first = asked.join(places, "sha").groupBy("sha").agg(F.min("place").alias("place")).select("sha", "place.rank", "place.offset")
        # so many tasks by the packs' bytes: ids and places are too few for their own to tell
        readers = max(LEAST_INDEX_PARTS, -(-sum(map(os.path.getsize, packs)) // PARTITION_BYTES))
        found = first.repartition(min(len(packs), readers), "rank").sortWithinPartitions("rank", "offset").mapInArrow(run, schema)
        left = asked.join(first, "sha", "left_anti")
    else:
        found, left = None, asked
    if found is None or has_loose(path):
        more = left.mapInArrow(loose, schema)
        found = more if found is None else found.union(more)
    if len(packs) < len(pack_files(path)):
        spark.dataSource.register(GitObjects)
        scanned = spark.read.format("git_objects").option("path", path).option("repo", name).option("packs", "unindexed").option("loose", "false").option("kinds", ",".join(wanted)).load()
        found = found.unionByName(scanned.join(asked, "sha", "left_semi").withColumn("chain", F.lit(None).cast("long")))
        order = F.struct((F.col("storage") != "pack").alias("loose"), "pack_id", "offset")
        found = found.groupBy("sha").agg(F.min_by(F.struct(*columns, "chain"), order).alias("o")).select("o.*")
    return found


def pack_index(spark: SparkSession, path: str, repo: str | None = None) -> DataFrame:
    """repo, pack_id, sha, offset of a repository's indexes: no object is read."""
    packs = spark.createDataFrame([(p,) for p in pack_files(path) if _index(p) is not None] or [], "path string")

    def run(batches):
        for batch in batches:
            for p in batch.column("path").to_pylist():
                index, pack = _index(p), packfmt.pack_id(mapped(p))
                yield pa.RecordBatch.from_arrays([pa.array([repo or path] * len(index)), pa.array([pack] * len(index)), pa.array([s for s, _ in index], pa.string()), pa.array([o for _, o in index], pa.int64())], names=["repo", "pack_id", "sha", "offset"])

    return packs.mapInArrow(run, "repo string, pack_id string, sha string, offset long")


SLICES = "pack_id string, offsets binary, ids binary, ends binary, bases binary, body binary"


def _slices(packs: DataFrame, budget: int) -> DataFrame:
    """Packs (pack, index) cut along their delta families; ends are the objects' ends in body, bases their bases' places among them, or -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, index in zip(batch.column("pack").to_pylist(), batch.column("index").to_pylist(), strict=True):
                data = np.frombuffer(pack, dtype=np.uint8)
                ids, at_ids = packfmt.read_index(index) if index else (None, np.array(packfmt.PackReader(pack).offsets_forward(), dtype=np.int64))
                order = np.argsort(at_ids)
                ordered = at_ids[order]
                base = packfmt.bases(data, ordered, ids, at_ids)
                stops = np.append(ordered[1:], len(pack) - packfmt.ID_BYTES)
                for part in packfmt.families(ordered, base, len(pack), budget):
                    at = np.searchsorted(ordered, part)
                    place = np.searchsorted(part, base[at])
                    place[(base[at] < 0) | (part[np.minimum(place, len(part) - 1)] != base[at])] = -1
                    body = b"".join(pack[a:b] for a, b in zip(part.tolist(), stops[at].tolist(), strict=True))
                    own = ids[order[at]].tobytes() if ids is not None else b""
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((packfmt.pack_id(pack), pa.string()), (part.tobytes(), pa.binary()), (own, pa.binary()), (np.cumsum(stops[at] - part).tobytes(), pa.binary()), (place.tobytes(), pa.binary()), (body, pa.binary()))], names=["pack_id", "offsets", "ids", "ends", "bases", "body"])

    return packs.mapInArrow(run, SLICES)


def from_binary_files(spark: SparkSession, path: str, repo: str | None = None, kinds: list[str] | None = None, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """The same rows through Spark's own file reader, from any store.

    One task cuts a pack (of 2 GB at most, which is what the reader takes) along
    its delta families; inflating is spread over as many tasks as there are
    parts.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path.rstrip('/')}/objects").select("path", "content")
    wanted = set(kinds or KIND_NAMES)
    name = repo or path
    of = lambda kind, column: files.where(F.col("path").endswith(kind)).select(F.regexp_replace("path", r"\.[a-z]+$", "").alias("stem"), F.col("content").alias(column))
    slices = _slices(of(".pack", "pack").join(of(".idx", "index"), "stem", "left").select("pack", "index"), partition_bytes)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, offsets, ids, ends, base, body in zip(*(batch.column(c).to_pylist() for c in ("pack_id", "offsets", "ids", "ends", "bases", "body")), strict=True):
                begins = [0, *np.frombuffer(ends, dtype=np.int64).tolist()[:-1]]
                named = {b: (o, i) for i, (b, o) in enumerate(zip(begins, np.frombuffer(offsets, dtype=np.int64).tolist(), strict=True))}
                reader = packfmt.SlicedReader(body, {b: begins[k] for b, k in zip(begins, np.frombuffer(base, dtype=np.int64).tolist(), strict=True) if k >= 0})
                rows, size = [], 0
                for at, kind, content in reader.read(begins, wanted):
                    offset, i = named[at]
                    sha = ids[20 * i : 20 * i + 20].hex() if ids else packfmt.object_id(kind, content)
                    rows.append((name, "pack", pack, offset, sha, kind, len(content), content))
                    size += len(content)
                    if size >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    def loose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    kind, content = packfmt.parse_loose(data)
                except packfmt.FormatError:
                    continue
                if kind in wanted:
                    folder, leaf = os.path.split(p)
                    rows.append((name, "loose", None, None, os.path.basename(folder) + leaf, kind, len(content), content))
            if rows:
                yield _batch(rows)

    # dealt by chance: parts are of one size
    found = slices.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(packed, OBJECTS)
    return found.union(files.where(F.col("path").rlike(r"/[0-9a-f]{2}/[0-9a-f]{38}$")).mapInArrow(loose, OBJECTS))
