"""Writers of the byte formats: packs with their indexes, loose objects, trees, commits.  No Spark but in ``write_packs``.

A packed object may be a delta on the object before it, if that is of the same
kind: a copy of what both begin with, and the rest.  A delta names its base by
distance or by id; packs of deltas by id may lack bases, which another pack has
then.  Tests and the registered queries write repositories with this.
"""

from __future__ import annotations

import functools
import hashlib
import os
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from histlake.sources import packfmt

KIND_NUMBERS = {name: number for number, name in packfmt.NAMES.items()}
#: Bytes that a delta's one copy takes at most.
MOST_COPIED = 0xFFFF
#: Bytes of objects after which a pack is closed.
PACK_BYTES = 32 << 20


@functools.lru_cache(1 << 14)
def header(kind: int, size: int) -> bytes:
    out, byte, size = bytearray(), kind << 4 | size & 15, size >> 4
    while size:
        out.append(byte | 128)
        byte, size = size & 127, size >> 7
    return bytes(out) + bytes([byte])


def distance(value: int) -> bytes:
    out = [value & 127]
    while value := value >> 7:
        value -= 1
        out.append(value & 127 | 128)
    return bytes(out[::-1])


def size_bytes(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes(out) + bytes([value])


def _same(a: bytes, b: bytes, most: int) -> int:
    """How many bytes both begin with, most at most."""
    if a[:most] == b[:most]:
        return most
    same = 0
    while most - same > 1:  # the first byte that differs is among these
        half = (same + most) // 2
        if a[same:half] == b[same:half]:
            same = half
        else:
            most = half
    return same


def delta(base: bytes, target: bytes) -> bytes:
    """The instructions that make target of base."""
    same = _same(base, target, min(len(base), len(target), MOST_COPIED))
    out = [size_bytes(len(base)), size_bytes(len(target))]
    if same:
        low, high = same & 255, same >> 8
        out.append(bytes([128 | 16 * bool(low) | 32 * bool(high)]) + bytes([low] * bool(low) + [high] * bool(high)))
    for at in range(same, len(target), 127):
        part = target[at : at + 127]
        out.append(bytes([len(part)]) + part)
    return b"".join(out)


def pack(objects: Iterable[tuple[str, bytes]], deltas: bool = True, by_id: bool = False) -> tuple[bytes, bytes]:
    """A pack of (kind, content) and its version-2 index; with deltas, an object that begins like the one before is one."""
    parts, at, entries, before = [], 12, {}, None
    for kind, content in objects:
        name = packfmt.object_name(kind, content)
        if name in entries:
            continue
        if deltas and before and _alike(before, (kind, content)):
            change = delta(before[1], content)
            base = _delta_by_id(before[3], change) if by_id else header(packfmt.OFFSET_DELTA, len(change)) + distance(at - before[2])
            data = base + zlib.compress(change, 1)
        else:
            data = header(KIND_NUMBERS[kind], len(content)) + zlib.compress(content, 1)
        entries[name] = zlib.crc32(data), at
        before = kind, content, at, name
        parts.append(data)
        at += len(data)
    return _closed(parts, entries)


def thin_packs(objects: Iterable[tuple[str, bytes]]) -> list[tuple[bytes, bytes]]:
    """Two packs with their indexes: the whole objects, and the deltas, by id, whose bases are in either pack."""
    found: tuple[list, list] = ([], [])
    entries: tuple[dict, dict] = ({}, {})
    at, before = [12, 12], None
    for kind, content in objects:
        name = packfmt.object_name(kind, content)
        if name in entries[0] or name in entries[1]:
            continue
        if before and _alike(before, (kind, content)):
            change = delta(before[1], content)
            which, data = 1, _delta_by_id(before[2], change) + zlib.compress(change, 1)
        else:
            which, data = 0, header(KIND_NUMBERS[kind], len(content)) + zlib.compress(content, 1)
        entries[which][name] = zlib.crc32(data), at[which]
        found[which].append(data)
        at[which] += len(data)
        before = kind, content, name
    return [_closed(parts, names) for parts, names in zip(found, entries, strict=True)]


def _alike(before: tuple, now: tuple[str, bytes]) -> bool:
    return before[0] == now[0] and now[1][:16] == before[1][:16] and bool(now[1])


def _delta_by_id(base: bytes, change: bytes) -> bytes:
    return header(packfmt.ID_DELTA, len(change)) + base


def _closed(parts: list[bytes], entries: dict[bytes, tuple[int, int]]) -> tuple[bytes, bytes]:
    body = struct.pack(">4sII", b"PACK", 2, len(parts)) + b"".join(parts)
    trailer = hashlib.sha1(body).digest()
    return body + trailer, _index(sorted((name, *e) for name, e in entries.items()), trailer)


def _index(entries: list[tuple[bytes, int, int]], trailer: bytes) -> bytes:
    counts = np.cumsum(np.bincount(np.array([e[0][0] for e in entries], dtype=np.int64), minlength=256))
    far = [o for _, _, o in entries if o >= 1 << 31]
    small = [o if o < 1 << 31 else 1 << 31 | far.index(o) for _, _, o in entries]
    data = b"\xfftOc\0\0\0\2" + counts.astype(">u4").tobytes() + b"".join(e[0] for e in entries)
    data += np.array([e[1] for e in entries], dtype=">u4").tobytes() + np.array(small, dtype=">u4").tobytes() + np.array(far, dtype=">u8").tobytes() + trailer
    return data + hashlib.sha1(data).digest()


def loose(kind: str, content: bytes) -> bytes:
    return zlib.compress(b"%s %d\0" % (kind.encode(), len(content)) + content, 1)


def tree(entries: Iterable[tuple[str, str, str]]) -> bytes:
    """A tree of (mode, name, id)."""
    return b"".join(f"{mode} {name}".encode() + b"\0" + bytes.fromhex(sha) for mode, name, sha in entries)


def write_packs(objects: DataFrame, path: str, index: bool = True, as_loose: bool = False, by_id: bool = False, thin: bool = False, pack_bytes: int = PACK_BYTES) -> None:
    """A repository of objects (kind, content) at a mounted path: a pack for each pack_bytes of a partition's contents (two where thin), or loose files."""

    def parts(rows: Iterator[tuple[str, bytes]]) -> Iterator[list[tuple[str, bytes]]]:
        held, size = [], 0
        for row in rows:
            held.append(row)
            size += len(row[1])
            if size >= pack_bytes:
                yield held
                held, size = [], 0
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((k, c) for b in batches for k, c in zip(b.column("kind").to_pylist(), b.column("content").to_pylist(), strict=True))
        if as_loose:
            for kind, content in rows:
                name = packfmt.object_id(kind, content)
                _put(f"{path}/objects/{name[:2]}/{name[2:]}", loose(kind, content))
            return
        for held in parts(rows):
            for data, names in thin_packs(held) if thin else [pack(held, by_id=by_id)]:
                top = f"{path}/objects/pack/pack-{packfmt.pack_id(data)}"
                if index:
                    _put(f"{top}.idx", names)
                _put(f"{top}.pack", data)
        yield from ()

    os.makedirs(f"{path}/objects/pack", exist_ok=True)
    os.makedirs(f"{path}/refs", exist_ok=True)
    _put(f"{path}/HEAD", b"ref: refs/heads/main\n")
    objects.select("kind", "content").mapInArrow(run, "done boolean").write.format("noop").mode("overwrite").save()


def _put(path: str, data: bytes) -> None:
    """Whole or not at all: a task that runs twice writes the same file."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{os.getpid()}"
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, path)
