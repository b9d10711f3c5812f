"""Byte formats on hand-made bytes."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from histlake.sources import packfmt as p
from histlake.sources import packwrite, refs, smart_http


def header(kind, size):
    out, byte, size = bytearray(), kind << 4 | size & 15, size >> 4
    while size:
        out.append(byte | 128)
        byte, size = size & 127, size >> 7
    return bytes(out + bytes([byte]))


def size_bytes(n):
    out = bytearray()
    while True:
        out.append(n & 127 | (128 if n > 127 else 0))
        n >>= 7
        if not n:
            return bytes(out)


def pack(objects):
    body = b"PACK" + struct.pack(">II", 2, len(objects)) + b"".join(objects)
    return body + hashlib.sha1(body).digest()


def test_headers_and_distances():
    for size in (0, 15, 16, 300, 1 << 20, 1 << 35):
        assert p.read_header(header(3, size) + b"x", 0) == (3, size, len(header(3, size)))
    assert p.read_distance(bytes([0x7F]), 0) == (127, 1)
    assert p.read_distance(bytes([0x80, 0x00]), 0) == (128, 2)
    assert p.read_distance(bytes([0xFF, 0x7F]), 0) == (16511, 2)
    for cut in (b"", b"\x90"):
        with pytest.raises(p.FormatError):
            p.read_header(cut, 0)


def delta(base, target, ops):
    return size_bytes(len(base)) + size_bytes(len(target)) + ops


def test_deltas():
    base = bytes(range(256)) * 300
    copy = bytes([0x80 | 0x01 | 0x10, 5, 10])
    assert p.apply_delta(base, delta(base, base[5:15] + b"hey", copy + b"\x03hey")) == base[5:15] + b"hey"
    assert p.apply_delta(base, delta(base, base[:0x10000], b"\x80")) == base[:0x10000]
    for ops, size in ((b"\x00", 0), (bytes([0x80 | 0x07 | 0x10, 255, 255, 255, 9]), 9), (b"\x05ab", 5), (b"\x02ab", 3), (bytes([0x91, 5]), 1)):
        with pytest.raises(p.FormatError):
            p.apply_delta(base, size_bytes(len(base)) + size_bytes(size) + ops)
    with pytest.raises(p.FormatError):
        p.apply_delta(b"other", delta(base, b"a", b"\x01a"))


def test_index_with_large_offsets():
    ids = sorted(hashlib.sha1(bytes([i])).digest() for i in range(3))
    fan = b"".join(struct.pack(">I", sum(x[0] <= b for x in ids)) for b in range(256))
    data = b"\xfftOc\0\0\0\2" + fan + b"".join(ids) + b"\0" * 12 + struct.pack(">III", 12, 0x80000000, 99) + struct.pack(">Q", 1 << 33)
    assert p.parse_index(data) == [(ids[0].hex(), 12), (ids[1].hex(), 1 << 33), (ids[2].hex(), 99)]
    with pytest.raises(p.FormatError):
        p.parse_index(b"old index")


def test_pack_with_offset_and_id_deltas():
    base = b"hello world\n" * 30
    one = header(3, len(base)) + zlib.compress(base)
    d = delta(base, base + b"!", bytes([0x80 | 0x30, len(base) & 255, len(base) >> 8]) + b"\x01!")
    two = header(p.OFFSET_DELTA, len(d)) + bytes([len(one)]) + zlib.compress(d)
    assert len(one) < 128
    three = header(p.ID_DELTA, len(d)) + bytes.fromhex(p.object_id("blob", base)) + zlib.compress(d)
    lost = header(p.ID_DELTA, len(d)) + b"\1" * 20 + zlib.compress(d)
    data = pack([one, two, three, lost])
    reader = p.PackReader(data, {p.object_id("blob", base): 12})
    offsets = reader.offsets_forward()
    got = [(k, c) for _, k, c in reader.read(offsets)]
    assert got == [("blob", base), ("blob", base + b"!"), ("blob", base + b"!")]
    assert [reader.kind_of(o) for o in offsets] == ["blob", "blob", "blob", None]
    assert list(reader.read(offsets, {"commit"})) == []
    raw, places = np.frombuffer(data, dtype=np.uint8), np.array(offsets)
    ids = np.frombuffer(bytes.fromhex(p.object_id("blob", base)), dtype=np.uint8).reshape(1, 20)
    found = p.bases(raw, places, ids, np.array([12]))
    assert found.tolist() == [-1 if (b := reader.base_of(o)) is None else b for o in offsets] == [-1, 12, 12, -1]
    assert [x.tolist() for x in p.families(places, found, len(data), 1)] == [offsets[:3], offsets[3:]]
    assert [x.tolist() for x in p.families(places, found, len(data), 1 << 20)] == [offsets]
    with pytest.raises(p.FormatError):
        list(p.PackReader(data[:20]).read([12]))


def test_loose_objects():
    assert p.parse_loose(zlib.compress(b"blob 3\0abc")) == ("blob", b"abc")
    for bad in (b"nope", zlib.compress(b"blob 4\0abc"), zlib.compress(b"thing 3\0abc"), zlib.compress(b"blob3")):
        with pytest.raises(p.FormatError):
            p.parse_loose(bad)
    assert p.object_id("blob", b"hello\n") == "ce013625030ba8dba906f756967f9e9ca394464a"


def test_packets_and_side_band():
    data = p.packet("a\n") + p.FLUSH + p.packet(b"\1PA") + p.packet(b"\2progress") + p.packet(b"\1CK")
    assert list(p.packets(data))[:2] == [b"a\n", b""]
    assert p.demultiplex(data[10:]) == b"PACK"
    with pytest.raises(p.FormatError, match="boom"):
        p.demultiplex(p.packet(b"\3boom"))
    with pytest.raises(p.FormatError):
        p.demultiplex(p.packet(b"\1PA")[:-1])
    with pytest.raises(p.FormatError):
        list(p.packets(b"zzzz"))


def test_advertisement_and_requests():
    a, b = "a" * 40, "b" * 40
    data = p.packet("# service=git-upload-pack\n") + p.FLUSH + p.packet(f"{a} HEAD\0side-band-64k filter\n") + p.packet(f"{a} refs/heads/main\n") + p.packet(f"{b} refs/tags/v1\n") + p.packet(f"{a} refs/tags/v1^{{}}\n") + p.FLUSH
    assert refs.parse_advertisement(data) == (a, "side-band-64k filter", [("refs/heads/main", a), ("refs/tags/v1", b), ("refs/tags/v1^{}", a)])
    with pytest.raises(ValueError):
        refs.parse_advertisement(p.FLUSH)
    assert [smart_http.partial_filter(k) for k in ({"commit", "tag"}, {"commit", "tree"}, {"blob"}, None)] == ["tree:0", "blob:none", None, None]
    assert list(p.packets(smart_http.pack_request(a, "tree:0"))) == [f"want {a} side-band-64k ofs-delta no-progress filter\n".encode(), b"filter tree:0\n", b"", b"done\n"]


def test_families_hold_chains_together():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randrange(1, 60)
        places = np.cumsum([12] + [rng.randrange(5, 300) for _ in range(n)])
        offsets, size = places[:-1], int(places[-1])
        base = np.array([offsets[rng.randrange(i)] if i and rng.random() < 0.6 else -1 for i in range(n)])
        budget = rng.choice([1, 200, 1000, 10**6])
        parts = [x.tolist() for x in p.families(offsets, base, size, budget)]
        assert sorted(sum(parts, [])) == offsets.tolist()
        where = {o: k for k, part in enumerate(parts) for o in part}
        assert all(b < 0 or where[o] == where[b] for o, b in zip(offsets.tolist(), base.tolist()))
        assert budget < 10**6 or len(parts) == 1
    assert p.families(np.array([], dtype=np.int64), np.array([], dtype=np.int64), 32, 10) == []


def test_written_packs_read_back():
    rng = random.Random(4)
    start = b"a common beginning of some length, "
    objects = [(rng.choice(["blob", "commit", "tag", "tree"]), rng.choice([b"", start, start * 2000]) + rng.randbytes(rng.choice([0, 1, 20, 3000]))) for _ in range(300)]
    objects += [("blob", start * 3000 + b"1"), ("blob", start * 3000 + b"2"), ("blob", start), ("blob", start + b"!")]
    data, index = packwrite.pack(objects)
    found = dict(p.parse_index(index))
    reader = p.PackReader(data, found)
    read = {o: (k, c) for o, k, c in reader.read(list(found.values()))}
    assert {s: read[o] for s, o in found.items()} == {p.object_id(k, c): (k, c) for k, c in objects}
    assert sorted(reader.offsets_forward()) == sorted(found.values())
    raw, places = np.frombuffer(data, dtype=np.uint8), np.array(sorted(found.values()))
    base = p.bases(raw, places)
    assert base.tolist() == [-1 if (b := reader.base_of(o)) is None else b for o in places.tolist()] and (base >= 0).any()
    for value in (1, 127, 128, 16511, 16512, 1 << 30):
        assert p.read_distance(packwrite.distance(value), 0) == (value, len(packwrite.distance(value)))
    assert p.parse_loose(packwrite.loose("tag", b"x")) == ("tag", b"x")
    with pytest.raises(p.FormatError):
        p.read_index(index[: 8 + 1024 + 30])


def test_chains_of_deltas_by_id_are_inflated_once(monkeypatch):
    """Without an index, names of bases come one by one; each round began all chains anew."""
    objects = [("blob", b"the same beginning of all " + b"%d " * 3 % (i, i, i)) for i in range(120)]
    data, _ = packwrite.pack(objects, by_id=True)
    streams, inflate = [], p.inflate
    monkeypatch.setattr(p, "inflate", lambda data, at: streams.append(at) or inflate(data, at))
    reader = p.PackReader(data)
    offsets = reader.offsets_forward()
    streams.clear()
    assert {(k, c) for _, k, c in reader.named(offsets)} == set(objects)
    assert len(streams) == len(objects)
    assert not list(reader.open_deltas(offsets))


def test_advertisements_in_pieces():
    lines = [p.packet("# service=git-upload-pack\n"), p.FLUSH, p.packet(f"{'ab' * 20} HEAD\0side-band-64k\n"), *(p.packet(f"{i:040x} refs/heads/b{i}\n") for i in range(9)), p.FLUSH]
    data = b"".join(lines)
    whole = refs.parse_advertisement(data)
    for size in (1, 3, 50, 1000):
        read = refs.Advertisement()
        found = [x for i in range(0, len(data), size) for x in read.feed(data[i : i + size])]
        assert (read.head, read.capabilities, found) == whole and len(found) == 9
