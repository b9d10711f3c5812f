import random

import numpy as np
import pytest

from histlake.llm import common, suffixes
from histlake.llm.common import work_dir
from tests.llm.helpers import documents, save, sentence, sha


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for i, d in enumerate(data):
        for s in range(len(d) - length + 1):
            seen.setdefault(d[s : s + length], []).append((i, s))
    gone = [bytearray(len(d)) for d in data]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                gone[i][s : s + length] = b"\x01" * length
    out = {}
    for i, d in enumerate(data):
        runs = sum(1 for k in range(len(d)) if gone[i][k] and (k == 0 or not gone[i][k - 1]))
        out[i] = (len(d), sum(gone[i]), runs, sha(bytes(b for b, g in zip(d, gone[i]) if not g)))
    return out


def texts(rng, length):
    shared = [sentence(rng, n, 3000) for n in (length // 8, length // 5, length // 3, length)]
    out = [None, "", "x", "é" * (length // 2), "ab" * length, "a" * (2 * length + 3), sentence(rng, 3, 20)]
    for _ in range(80):
        parts = [sentence(rng, rng.randrange(1, 80), 3000)]
        for _ in range(rng.randrange(4)):
            parts += [rng.choice(shared), sentence(rng, rng.randrange(1, 40), 3000)]
        out.append("\n".join(parts))
    out += [out[9]] * 12 + [out[10] + " tail é"] + [sentence(rng, 3000, 30)]
    rng.shuffle(out)
    return out


def read(frame):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"] if "kept_sha256" in r else sha(bytes(r["kept"]))) for r in frame.collect()}


def test_query_equals_brute_force(spark, tmp_path):
    data = texts(random.Random(4), 400)
    assert read(suffixes.op6_suffix_array_dedup(spark, save(spark, tmp_path, data))) == brute(data, 400)


@pytest.mark.parametrize("chunk_rows", [2, 5, 400])
def test_small_segments_many_batches(spark, monkeypatch, chunk_rows):
    monkeypatch.setattr(suffixes, "SEGMENT", 150)
    monkeypatch.setattr(suffixes, "BLOCK_ROWS", 3)
    data = texts(random.Random(5), 60)
    assert read(suffixes.remove_repeated_bytes(documents(spark, data), work_dir(spark), 60, 16, batches=5, chunk_rows=chunk_rows)) == brute(data, 60)


def test_null_ids_repeats_and_empty(spark):
    text = sentence(random.Random(1), 200, 3000)
    docs = spark.createDataFrame([(None, text, 1), (4, text, 2), (4, text, 3)], "doc_id long, text string, at int")
    out = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_removed"]) for r in suffixes.remove_repeated_bytes(docs, work_dir(spark)).collect())
    assert out == [(-1, 0), (4, 0), (4, 0)]
    assert suffixes.remove_repeated_bytes(docs.limit(0), work_dir(spark)).count() == 0


def test_levels_merge_geometrically(spark):
    index = suffixes.SuffixIndex(spark, work_dir(spark))
    for i in range(5):
        index.add(suffixes.entries(documents(spark, [sentence(random.Random(i), 300)])))
    assert [bool(x) for x in index.levels] == [True, False, True]


def test_frequent_anchor_in_chunks(spark):
    # one line in many different surroundings: its anchors have a reach for each document
    rng = random.Random(6)
    line = sentence(rng, 130, 3000)
    data = [f"{sentence(rng, 20, 3000)} {line} {sentence(rng, 20, 3000)}" for _ in range(60)] + [line[: len(line) // 2] + sentence(rng, 90, 3000)]
    data += [f"{data[0]} {data[1]}", line]
    assert read(suffixes.remove_repeated_bytes(documents(spark, data), work_dir(spark), chunk_rows=7)) == brute(data, 400)


def test_only_stretches_around_shared_cores_are_told(spark):
    rng = random.Random(7)
    line = sentence(rng, 40, 3000)
    data = [f"{sentence(rng, 80, 3000)} {line} {sentence(rng, 80, 3000)}" for _ in range(30)]  # a line of under 400 bytes
    data += [f"{sentence(rng, 80, 3000)} {line} {data[0]} {k}" for k in range(3)]
    assert read(suffixes.remove_repeated_bytes(documents(spark, data), work_dir(spark), chunk_rows=4)) == brute(data, 400)
    reaches = suffixes._Reaches([(1, 0, i, 400 + i, 304, (line * 9).encode()[i : 704 + i]) for i in range(2)], 400, 96)
    hashes, names = reaches.cores()
    assert len(set(zip(hashes.tolist(), names.tolist()))) <= 2 * suffixes.CORES + 2 and len(hashes) == 2 * 305


def test_rolling_hashes():
    rng = random.Random(2)
    data = bytes(rng.choice(b"ab") for _ in range(700)) * 3
    for size in (8, 9, 31, 96, 100, 400):
        hashes = common.rolling_hashes(np.frombuffer(data, dtype=np.uint8), size).tolist()
        cuts = [data[i : i + size] for i in range(len(data) - size + 1)]
        assert len(hashes) == len(cuts) and len(set(zip(cuts, hashes))) == len(set(cuts)) == len(set(hashes))
    assert len(common.rolling_hashes(np.frombuffer(b"short", dtype=np.uint8), 8)) == 0


def test_hashes_of_cancelling_words_differ():
    # words of this build and their complements have equal sums modulo 2**64
    for n in (1024, 2048, 8192):
        word = np.array([97 + (i.bit_count() & 1) for i in range(n)], dtype=np.uint8)
        both = np.concatenate((word, 195 - word))
        one, two = common.span_hashes(both, np.array([0, n]), np.array([n, 2 * n]))
        assert one != two
        assert len(set(common.rolling_hashes(both, n)[[0, n]].tolist())) == 2


def test_shared_anchors_show_short_repeats(spark, tmp_path):
    """n_shared equals a count over all chosen places, and tells of passages that are shorter than what goes."""
    rng = random.Random(8)
    passages = [sentence(rng, 62, 3000)[:300] for _ in range(30)]
    data = [f"{sentence(rng, 90, 3000)} {passages[i // 2 % 30]} {sentence(rng, 90, 3000)}" for i in range(60)] + [sentence(rng, 250, 3000) for _ in range(40)] + [None, "", "short"]
    found = {r["doc_id"]: (r["n_removed"], r["n_shared"]) for r in suffixes.op6_suffix_array_dedup(spark, save(spark, tmp_path, data)).collect()}
    places = {}
    for d, t in enumerate(data):
        raw = np.frombuffer((t or "").encode(), dtype=np.uint8)
        if len(raw) >= 400:
            for at in suffixes.chosen(raw, 0, len(raw), 400, 96)[0].tolist():
                places.setdefault(raw[at : at + 96].tobytes(), []).append(d)
    want = [sum(x == d for own in places.values() if len(own) > 1 for x in own) for d in range(len(data))]
    assert [found[d][1] for d in range(len(data))] == want
    assert sum(found[d][0] == 0 and found[d][1] > 0 for d in range(60)) >= 40 and not any(found[d][1] for d in range(60, len(data)))
