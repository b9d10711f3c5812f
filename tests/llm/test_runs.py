"""Periodic runs against brute force over all lags."""

import random
import zlib

import numpy as np
import pytest

from histlake.llm import runs
from tests.llm.helpers import WORD, documents, save, sha


def brute_runs(words, shortest=12):
    """All stretches at all lags; of equal stretches the one of the smallest lag."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(shortest, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_rows(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    told = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(found), *told, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def numbered(texts):
    known, words, bounds = {}, [], [0]
    for d, text in enumerate(texts):
        words += [known.setdefault((d, w), len(known)) for w in text]
        bounds.append(len(words))
    return np.array(words, dtype=np.int64), np.array(bounds)


def made(rng):
    """Words of few kinds with stretches that repeat, nested and side by side."""
    text = []
    while len(text) < rng.choice([5, 40, 150, 400]):
        unit = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.choice([1, 2, 3, 7, 20, 60]))]
        text += unit * rng.choice([1, 1, 2, 3, 8]) + unit[: rng.randrange(len(unit) + 1)]
        if rng.random() < 0.3:
            text += text[-rng.randrange(1, 80) :]
    return text


@pytest.mark.parametrize("seed", range(30))
def test_runs_equal_brute_force(seed, monkeypatch):
    rng = random.Random(seed)
    if seed % 2:  # nearly all words are counted by FFT
        monkeypatch.setattr(runs, "heavy_count", lambda n: 2)
    if seed % 3 == 0:
        monkeypatch.setattr(runs, "COUNTED", 10)
    texts = [made(rng) for _ in range(12)] + [[], [1]]
    words, bounds = numbered(texts)
    counts, begins = runs.lag_counts(words, bounds)
    for d, text in enumerate(texts):
        assert counts[begins[d] : begins[d + 1]].tolist() == [sum(a == b for a, b in zip(text, text[q:], strict=False)) for q in range(1, len(text) // 2 + 1)]
    assert runs.find_runs(words, bounds) == [brute_runs(t) for t in texts]


def test_words_without_end():
    """One word, two words and a word list, repeated 100,000 times: no more work than elsewhere."""
    n = 100_000
    texts = [[0] * n, [0, 1] * (n // 2), list(range(50)) * (n // 50), [0] * (n // 2) + [1] + [0] * (n // 2)]
    found = runs.find_runs(*numbered(texts))
    assert found[:3] == [[(0, n, 1)], [(0, n, 2)], [(0, n, 50)]]
    assert found[3] == [(0, n // 2, 1), (n // 2 + 1, n // 2, 1)]


def test_query_equals_brute_force(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    texts = [None, "", " \t\n", "one", "same " * 30, "ab cd " * 20 + "x", "é日本 😀 " * 9, "a\x0bb\x0cc\x1cd e " * 7]
    texts += [" ".join(f"w{x}" for x in made(rng)) for _ in range(150)]
    out = runs.op11_periodic_runs(spark, save(spark, tmp_path, texts))
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert out.columns == columns
    assert [t for _, t in out.dtypes] == ["bigint"] * 6 + ["string"] * 2
    got = {r["doc_id"]: tuple(r)[1:] for r in out.collect()}
    assert got == {i: brute_rows(i, t) for i, t in enumerate(texts)}
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts)))


def test_operator_and_awkward_tables(spark):
    found = runs.periodic_runs(documents(spark, ["x " + "a b " * 8 + "y"])).first()
    assert found["text"] == "x a b y" and [tuple(r) for r in found["runs"]] == [(1, 16, 2)]
    odd = spark.createDataFrame([(None, "z " * 20, "k"), (7, None, "k"), (7, "z " * 20, "k"), (7, "z " * 20, "k")], "doc_id long, text string, runs string")
    assert sorted((str(r["doc_id"]), r["text"], len(r["runs"])) for r in runs.periodic_runs(odd, places=runs.planted_period).collect()) == [("7", "", 0), ("7", "z", 1), ("7", "z", 1), ("None", "z", 1)]
    assert runs.periodic_runs(odd.limit(0)).count() == 0
    named = runs.periodic_runs(odd.selectExpr("cast(doc_id as string) AS `id.x`", "text AS `t t`", "runs"), "id.x", "t t")
    assert named.dtypes[0] == ("doc_id", "string") and named.count() == 4
