"""Byte formats: packs, pack indexes, deltas, loose objects, packet lines.  No Spark here."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np

# Object kinds and delta kinds by number.
NAMES = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
OFFSET_DELTA, ID_DELTA = 6, 7
ID_BYTES = 20


class FormatError(ValueError):
    pass


def object_id(kind: str, content: bytes) -> str:
    return object_name(kind, content).hex()


def object_name(kind: str, content: bytes) -> bytes:
    """The id as its 20 bytes."""
    return hashlib.sha1(b"%s %d\0" % (kind.encode(), len(content)) + content).digest()


def read_header(data: bytes, at: int) -> tuple[int, int, int]:
    """(kind number, size, place of what follows) of a packed object."""
    try:
        byte = data[at]
        kind, size, shift = byte >> 4 & 7, byte & 15, 4
        while byte & 128:
            at += 1
            byte = data[at]
            size |= (byte & 127) << shift
            shift += 7
    except IndexError:
        raise FormatError("truncated object header") from None
    return kind, size, at + 1


def read_distance(data: bytes, at: int) -> tuple[int, int]:
    """How far back a delta's base lies: big-endian, each continuation adds one."""
    try:
        byte = data[at]
        value = byte & 127
        while byte & 128:
            at += 1
            byte = data[at]
            value = (value + 1 << 7) | byte & 127
    except IndexError:
        raise FormatError("truncated base distance") from None
    return value, at + 1


def read_size(data: bytes, at: int) -> tuple[int, int]:
    """A little-endian size inside a delta."""
    value, shift = 0, 0
    while True:
        if at >= len(data):
            raise FormatError("truncated delta size")
        byte = data[at]
        value |= (byte & 127) << shift
        shift += 7
        at += 1
        if not byte & 128:
            return value, at


def apply_delta(base: bytes, delta: bytes) -> bytes:
    """Copies from the base and inserts from the delta, as its instructions say."""
    expected, at = read_size(delta, 0)
    if expected != len(base):
        raise FormatError("delta is for a base of another size")
    size, at = read_size(delta, at)
    out = bytearray()
    while at < len(delta):
        code = delta[at]
        at += 1
        if code & 128:
            start = length = 0
            try:
                if code & 15:
                    for shift in (0, 8, 16, 24):
                        if code >> shift // 8 & 1:
                            start |= delta[at] << shift
                            at += 1
                for shift in (0, 8, 16):
                    if code >> 4 + shift // 8 & 1:
                        length |= delta[at] << shift
                        at += 1
            except IndexError:
                raise FormatError("truncated copy") from None
            length = length or 0x10000
            if start + length > len(base):
                raise FormatError("copy beyond the base")
            out += base[start : start + length]
        elif code:
            if at + code > len(delta):
                raise FormatError("truncated insert")
            out += delta[at : at + code]
            at += code
        else:
            raise FormatError("reserved instruction")
    if len(out) != size:
        raise FormatError("delta gives another size than it says")
    return bytes(out)


def inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """The bytes of a zlib stream and the place after it; it is taken up in growing steps, as what a step has beyond the end is copied."""
    stream, step = zlib.decompressobj(), 1 << 9
    piece = data[at : at + step]
    try:
        out = [stream.decompress(piece)]
    except zlib.error as e:
        raise FormatError(str(e)) from None
    at += len(piece)
    if stream.eof:
        return out[0], at - len(stream.unused_data)
    view = memoryview(data)
    while not stream.eof:
        piece = view[at : at + step]
        if not len(piece):
            raise FormatError("truncated zlib stream")
        try:
            out.append(stream.decompress(piece))
        except zlib.error as e:
            raise FormatError(str(e)) from None
        at += len(piece)
        step = min(4 * step, 1 << 16)
    return b"".join(out), at - len(stream.unused_data)


def read_index(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids (rows of 20 bytes, in order) and offsets of a version-2 index."""
    if data[:8] != b"\xfftOc\0\0\0\2":
        raise FormatError("not a version-2 pack index")
    n = struct.unpack_from(">I", data, 8 + 255 * 4)[0]
    ids = 8 + 256 * 4
    small = ids + n * (ID_BYTES + 4)
    if len(data) < small + n * 4:
        raise FormatError("truncated pack index")
    offsets = np.frombuffer(data, dtype=">u4", count=n, offset=small).astype(np.int64)
    far = np.flatnonzero(offsets & 0x80000000)
    if len(far):
        large = np.frombuffer(data, dtype=">u8", offset=small + n * 4, count=int((offsets[far] & 0x7FFFFFFF).max()) + 1).astype(np.int64)
        offsets[far] = large[offsets[far] & 0x7FFFFFFF]
    return np.frombuffer(data, dtype=np.uint8, count=n * ID_BYTES, offset=ids).reshape(n, ID_BYTES), offsets


def parse_index(data: bytes) -> list[tuple[str, int]]:
    """(id, offset) of a version-2 index, in order of id."""
    ids, offsets = read_index(data)
    return [(x.tobytes().hex(), o) for x, o in zip(ids, offsets.tolist(), strict=True)]


class PackIndex:
    """A version-2 index where it is mapped: an id is found by its first byte's range and a binary search, nothing else is read."""

    def __init__(self, data: bytes):
        if data[:8] != b"\xfftOc\0\0\0\2":
            raise FormatError("not a version-2 pack index")
        self.data = data
        self.count = self._before(256)

    def _before(self, first: int) -> int:
        """How many ids begin with a byte below this one."""
        return struct.unpack_from(">I", self.data, 8 + 4 * (first - 1))[0] if first else 0

    def find(self, name: bytes) -> int | None:
        """The offset of an id (20 bytes)."""
        low, high = self._before(name[0]), self._before(name[0] + 1)
        ids = 8 + 256 * 4
        while low < high:
            mid = (low + high) // 2
            at = ids + mid * ID_BYTES
            here = self.data[at : at + ID_BYTES]
            if here == name:
                small = ids + self.count * (ID_BYTES + 4)
                offset = struct.unpack_from(">I", self.data, small + 4 * mid)[0]
                return struct.unpack_from(">Q", self.data, small + 4 * self.count + 8 * (offset & 0x7FFFFFFF))[0] if offset & 0x80000000 else offset
            low, high = (mid + 1, high) if here < name else (low, mid)
        return None

    def get(self, sha: str) -> int | None:
        """The same for an id in hexadecimal, as PackReader asks for bases."""
        return self.find(bytes.fromhex(sha))


def pack_count(data: bytes) -> int:
    magic, version, n = struct.unpack_from(">4sII", data, 0)
    if magic != b"PACK" or version not in (2, 3):
        raise FormatError("not a pack")
    return n


def pack_id(data: bytes) -> str:
    return bytes(data[-ID_BYTES:]).hex()


class PackReader:
    """Objects of a pack by offset; bases are kept while objects that need them are to come.

    offset_of tells the offsets of bases by id: a mapping or a PackIndex.
    """

    def __init__(self, data: bytes, offset_of: dict[str, int] | PackIndex | None = None):
        self.data, self.offset_of = data, {} if offset_of is None else offset_of
        self.inflated = 0  # streams so far
        self._kinds: dict[int, str] = {}

    def base_of(self, offset: int) -> int | None:
        """The offset of the base of a delta; None for whole objects and bases outside the pack."""
        kind, _, at = read_header(self.data, offset)
        if kind == OFFSET_DELTA:
            return offset - read_distance(self.data, at)[0]
        if kind == ID_DELTA:
            return self.offset_of.get(bytes(self.data[at : at + ID_BYTES]).hex())
        return None

    def kind_of(self, offset: int) -> str | None:
        """By headers alone; of a chain each header is read once, however many of its objects are asked for."""
        path: list[int] = []
        found = None
        while offset is not None:
            if (found := self._kinds.get(offset)) is not None:
                break
            self._kinds[offset] = ""  # on the way: a chain that comes back here has no root
            path.append(offset)
            kind, _, _ = read_header(self.data, offset)
            if kind in NAMES:
                found = NAMES[kind]
                break
            offset = self.base_of(offset)
        for o in path:
            if found:
                self._kinds[o] = found
            else:  # its base may be named later
                del self._kinds[o]
        return found or None

    def read(self, offsets: list[int], kinds: set[str] | None = None) -> Iterator[tuple[int, str, bytes]]:
        """(offset, kind, content) of offsets, whose bases must be among them; objects of other kinds are not inflated."""
        base: dict[int, int | None] = {}
        kind: dict[int, str | None] = {}
        for o in offsets:
            number = self.data[o] >> 4 & 7
            base[o] = None if number in NAMES else self.base_of(o)
            kind[o] = NAMES.get(number) or kind.get(base[o]) or self.kind_of(o)
        needed: dict[int, int] = {}
        for o in offsets:
            if base[o] is not None and kind[o] is not None and (kinds is None or kind[o] in kinds):
                needed[base[o]] = needed.get(base[o], 0) + 1
        kept: dict[int, bytes] = {}
        for o in sorted(offsets):
            if kind[o] is None or kinds is not None and kind[o] not in kinds:
                continue
            content = self._content(o, base, needed, kept)
            if content is not None:
                yield o, kind[o], content

    def _content(self, offset: int, base: dict, needed: dict, kept: dict) -> bytes | None:
        """Bases come before their deltas in most packs; where not, the chain is read from its root."""
        chain, at = [], offset
        while at is not None and at not in kept:
            chain.append(at)
            at = base[at] if at in base else self.base_of(at)
        content = kept[at] if at is not None else None
        for o in reversed(chain):
            kind, size, place = read_header(self.data, o)
            if kind in NAMES:
                content = self._whole(o, size, place)
            elif content is None:
                return None
            else:
                content = apply_delta(content, self._change(kind, place))
                self.inflated += 1
            if needed.get(o):
                kept[o] = content
        source = base.get(offset)
        if source is not None:
            needed[source] = needed.get(source, 1) - 1
            if needed[source] <= 0:
                kept.pop(source, None)
        return content

    def _whole(self, offset: int, size: int, place: int) -> bytes:
        content = inflate(self.data, place)[0]
        self.inflated += 1
        if len(content) != size:
            raise FormatError("object of another size than it says")
        return content

    def chain(self, offset: int) -> list[int]:
        """The offset, its base, that one's base, and so on."""
        out = [offset]
        while (base := self.base_of(out[-1])) is not None and base not in out:
            out.append(base)
        return out

    def points(self, offsets: list[int], kinds: set[str] | None = None) -> Iterator[tuple[int, str, bytes]]:
        """(offset, kind, content) of some offsets: only they and the chains below them are inflated, each once."""
        wanted = {o for o in offsets if kinds is None or self.kind_of(o) in kinds}
        for row in self.read(sorted({b for o in wanted for b in self.chain(o)})):
            if row[0] in wanted:
                yield row

    def delta(self, offset: int) -> bytes:
        """The instructions of a delta."""
        kind, _, place = read_header(self.data, offset)
        return self._change(kind, place)

    def _change(self, kind: int, place: int) -> bytes:
        place = read_distance(self.data, place)[1] if kind == OFFSET_DELTA else place + ID_BYTES
        return inflate(self.data, place)[0]

    def named(self, offsets: list[int], kinds: set[str] | None = None) -> Iterator[tuple[int, str, bytes]]:
        """As read, for a whole pack whose ids nobody has told: objects are named as they are read, so that deltas find their bases by id.

        Deltas by id wait until their base is named, and then are made of it at
        once, depth first: each stream is inflated once, however long a chain.
        What still waits at the end has no base in this pack.
        """
        if all(self.kind_of(o) is not None for o in offsets):
            yield from self.read(offsets, kinds)
            return
        roots, by_offset, by_id = [], {}, {}
        for o in sorted(offsets):
            kind, _, at = read_header(self.data, o)
            if kind in NAMES:
                roots.append(o)
            elif (base := self.base_of(o)) is not None:
                by_offset.setdefault(base, []).append(o)
            else:
                by_id.setdefault(bytes(self.data[at : at + ID_BYTES]).hex(), []).append(o)
        for root in roots:
            number, size, place = read_header(self.data, root)
            kind = NAMES[number]
            todo: list[tuple[int, bytes | None]] = [(root, None)]
            while todo:
                o, base = todo.pop()
                if base is None:
                    content = self._whole(o, size, place)
                else:
                    content = apply_delta(base, self.delta(o))
                    self.inflated += 1
                name = object_id(kind, content)
                self.offset_of.setdefault(name, o)
                self._kinds[o] = kind
                todo += [(x, content) for x in by_offset.pop(o, [])] + [(x, content) for x in by_id.pop(name, [])]
                if kinds is None or kind in kinds:
                    yield o, kind, content

    def open_deltas(self, offsets: list[int]) -> Iterator[tuple[int, int, int, str | None, int | None]]:
        """(offset, root, level, id of the root's base, offset of the base) of deltas that end at an id outside the pack.

        The root is the delta on that id, at level 0; the others stand on it, and have their base's offset.
        """
        for o in offsets:
            if self.kind_of(o) is None:
                chain = self.chain(o)
                kind, _, at = read_header(self.data, chain[-1])
                if kind == ID_DELTA:
                    base = bytes(self.data[at : at + ID_BYTES]).hex() if len(chain) == 1 else None
                    yield o, chain[-1], len(chain) - 1, base, chain[1] if len(chain) > 1 else None

    def offsets_forward(self) -> list[int]:
        """All offsets of a pack without an index, by inflating it from front to back."""
        at, out = 12, []
        for _ in range(pack_count(self.data)):
            out.append(at)
            kind, _, place = read_header(self.data, at)
            if kind == OFFSET_DELTA:
                place = read_distance(self.data, place)[1]
            elif kind == ID_DELTA:
                place += ID_BYTES
            elif kind not in NAMES:
                raise FormatError(f"unknown object kind {kind}")
            at = inflate(self.data, place)[1]
        return out


class SlicedReader(PackReader):
    """Some objects of a pack, one after another in data, at new offsets; their bases are told, as distances no longer hold."""

    def __init__(self, data: bytes, bases_of: dict[int, int]):
        super().__init__(data)
        self._bases = bases_of

    def base_of(self, offset: int) -> int | None:
        return self._bases.get(offset)


def bases(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray | None = None, at_ids: np.ndarray | None = None) -> np.ndarray:
    """The offset of the base of each object, -1 where there is none in the pack; headers of all objects are read at once.

    ids and at_ids: the ids of an index, in order, and their offsets, for bases by id.
    """
    at = offsets.copy()
    byte = data[at]
    kind = byte >> 4 & 7
    more = np.flatnonzero(byte & 128)
    while len(more):  # the sizes' continuations
        at[more] += 1
        more = more[(data[at[more]] & 128) > 0]
    at += 1
    out = np.full(len(offsets), -1, dtype=np.int64)
    far = np.flatnonzero(kind == OFFSET_DELTA)
    if len(far):
        place, byte = at[far], data[at[far]]
        value = (byte & 127).astype(np.int64)
        more = np.flatnonzero(byte & 128)
        while len(more):
            place[more] += 1
            byte = data[place[more]]
            value[more] = (value[more] + 1 << 7) | (byte & 127)
            more = more[(byte & 128) > 0]
        out[far] = offsets[far] - value
    named = np.flatnonzero(kind == ID_DELTA)
    if len(named) and ids is not None and len(ids):
        wanted = data[at[named][:, None] + np.arange(ID_BYTES)]
        as_key = lambda x: np.ascontiguousarray(x).view(f"S{ID_BYTES}").ravel()
        keys = as_key(ids)
        found = np.minimum(np.searchsorted(keys, as_key(wanted)), len(keys) - 1)
        hit = (ids[found] == wanted).all(axis=1)
        out[named[hit]] = at_ids[found[hit]]
    return out


def families(ordered: np.ndarray, base: np.ndarray, size: int, budget: int) -> list[np.ndarray]:
    """Offsets in parts of about `budget` packed bytes; a delta and its base are in one part.

    ordered: all offsets of a pack, ascending; base: the offset of the base of
    each, or -1; size: the pack's bytes.
    """
    n = len(ordered)
    if not n:
        return []
    up = np.searchsorted(ordered, base)
    up = np.where((base >= 0) & (ordered[np.minimum(up, n - 1)] == base), up, np.arange(n))
    while True:  # each points to its base's base, until all point to the first
        further = up[up]
        if (further == up).all():
            break
        up = further
    order = np.argsort(up, kind="stable")
    weight = np.diff(np.append(ordered, size))[order]
    whole = np.cumsum(weight)
    group = up[order]
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    parts, begin = [], 0
    ends = whole[np.append(first[1:], n) - 1]
    stops = np.append(first[1:], n)
    while begin < n:
        done = whole[begin - 1] if begin else 0
        k = max(int(np.searchsorted(ends, done + budget, side="right")) - 1, int(np.searchsorted(stops, begin, side="right")))
        parts.append(np.sort(ordered[order[begin : stops[k]]]))
        begin = int(stops[k])
    return parts


def parse_loose(data: bytes) -> tuple[str, bytes]:
    """(kind, content) of a loose object's file."""
    try:
        raw = zlib.decompress(data)
    except zlib.error as e:
        raise FormatError(str(e)) from None
    head, zero, content = raw.partition(b"\0")
    kind, _, size = head.partition(b" ")
    if not zero or kind.decode("ascii", "replace") not in NAMES.values() or not size.isdigit() or int(size) != len(content):
        raise FormatError("malformed loose object")
    return kind.decode(), content


def packet(text: str | bytes) -> bytes:
    data = text.encode() if isinstance(text, str) else text
    return b"%04x" % (len(data) + 4) + data


FLUSH = b"0000"


def packets(data: bytes) -> Iterator[bytes]:
    """Payloads of packet lines; a flush is empty.  What is cut short raises."""
    at = 0
    while at < len(data):
        try:
            size = int(bytes(data[at : at + 4]), 16)
        except ValueError:
            raise FormatError(f"bad packet length at byte {at}") from None
        if size == 0:
            yield b""
            at += 4
            continue
        if size < 4 or at + size > len(data):
            raise FormatError(f"truncated packet at byte {at} of {len(data)}")
        yield data[at + 4 : at + size]
        at += size


def whole_packets(data: bytes) -> int:
    """Where the last packet line ends that is there in full."""
    at = 0
    while at + 4 <= len(data):
        size = max(4, int(bytes(data[at : at + 4]), 16))
        if at + size > len(data):
            break
        at += size
    return at


def demultiplex(data: bytes) -> bytes:
    """The pack in a side-band answer: channel 1; channel 2 is progress, channel 3 an error."""
    out = []
    for payload in packets(data):
        if payload[:1] == b"\1":
            out.append(payload[1:])
        elif payload[:1] == b"\3":
            raise FormatError(payload[1:].decode("utf-8", "replace"))
    return b"".join(out)
