import random

import pytest

from histlake.llm import passages
from tests.llm.helpers import WORD, documents, save, sentence, sha


def brute(texts, length=13):
    words = [WORD.findall(t or "") for t in texts]
    first = {}
    for i, w in enumerate(words):
        for k in range(len(w) - length + 1):
            first.setdefault(tuple(w[k : k + length]), i)
    out = {}
    for i, w in enumerate(words):
        gone = set()
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                gone.update(range(k, k + length))
        out[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def texts(rng):
    shared = [sentence(rng, n, 3000) for n in (12, 13, 14, 40, 200)]
    out = [None, "", " \n\t", "one", sentence(rng, 12), sentence(rng, 13), "a " * 400, "a " * 30, "b a " * 50, "é ü " * 20, "é ü " * 15]
    for _ in range(120):
        parts = [sentence(rng, rng.randrange(1, 60), 3000)]
        for _ in range(rng.randrange(4)):
            parts += [rng.choice(shared), sentence(rng, rng.randrange(1, 60), 3000)]
        out.append("\n ".join(parts))
    out += [out[20]] * 15 + [sentence(rng, 6000, 50)]
    rng.shuffle(out)
    return out


def test_query_equals_brute_force(spark, tmp_path):
    data = texts(random.Random(8))
    result = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in passages.op5_substring_dedup(spark, save(spark, tmp_path, data)).collect()}
    assert result == brute(data)


def test_small_blocks_and_unsorted_ids(spark, monkeypatch):
    data = texts(random.Random(9))
    docs = documents(spark, data).orderBy("text").coalesce(3)
    monkeypatch.setattr(passages, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(passages, "FLUSH", 50)
    result = {r["doc_id"]: (r["n_words"], r["n_removed"], sha(r["text"])) for r in passages.remove_repeats(docs).collect()}
    assert result == brute(data)


def test_null_ids_repeats_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(None, text, 1), (4, text, 2), (4, text, 3), (2, text + " end", 4)], "doc_id long, text string, at int")
    out = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"]) for r in passages.remove_repeats(docs).collect())
    assert out == [(-1, 20, 0), (2, 21, 0), (4, 20, 20), (4, 20, 20)]
    assert passages.remove_repeats(docs.limit(0)).count() == 0


def test_automaton_statistics():
    rng = random.Random(1)
    for _ in range(60):
        seqs = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 25))] for _ in range(4)]
        automaton = passages.SuffixAutomaton()
        for s in seqs:
            automaton.begin()
            for w in s:
                automaton.extend(w)
        probe = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(30)]
        holds = lambda part: any(s[i : i + len(part)] == part for s in seqs for i in range(len(s)))
        want = [max(n for n in range(i + 2) if holds(probe[i + 1 - n : i + 1]) or n == 0) for i in range(len(probe))]
        assert passages.SuffixAutomaton.statistics(automaton, probe).tolist() == want


def test_reference_spans(spark):
    rng = random.Random(3)
    reference = [sentence(rng, 60, 2000), None, sentence(rng, 5, 2000)]
    data = [f"{sentence(rng, 20, 2000)} {' '.join(reference[0].split()[10:30])} {sentence(rng, 9, 2000)}", reference[0], reference[2], None, sentence(rng, 40, 2000)]
    held = {tuple(w[i : i + 13]) for w in (WORD.findall(t or "") for t in reference) for i in range(len(w) - 12)}
    out = {r["doc_id"]: r for r in passages.remove_reference_spans(documents(spark, data), spark.createDataFrame([(t,) for t in reference], "text string")).collect()}
    for i, t in enumerate(data):
        words = WORD.findall(t or "")
        gone = {j for k in range(len(words) - 12) if tuple(words[k : k + 13]) in held for j in range(k, k + 13)}
        assert (out[i]["n_words"], out[i]["n_removed"], out[i]["text"]) == (len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone))
    with pytest.raises(ValueError):
        passages.remove_reference_spans(documents(spark, data), spark.createDataFrame([(reference[0],)], "text string"), max_words=10)


def test_first_documents_of_states():
    rng = random.Random(2)
    for _ in range(60):
        seqs = [(rng.randrange(100), [rng.choice([b"a", b"b"]) for _ in range(rng.randrange(1, 20))]) for _ in range(5)]
        automaton = passages.SuffixAutomaton()
        for doc, s in seqs:
            automaton.begin()
            for w in s:
                automaton.extend(w, doc)
        first = automaton.first_documents(3)
        probe = [rng.choice([b"a", b"b", b"c"]) for _ in range(40)]
        for i, (state, size) in enumerate(automaton._stream(probe)):
            part = probe[i - 2 : i + 1] if i >= 2 else None
            holders = [doc for doc, s in seqs if part and any(s[k : k + 3] == part for k in range(len(s)))]
            assert (first[state] if size >= 3 else passages.NEVER) == min(holders, default=passages.NEVER)


def test_small_shards(spark, monkeypatch):
    data = texts(random.Random(10))
    monkeypatch.setattr(passages, "SHARD_WORDS", 100)
    result = {r["doc_id"]: (r["n_words"], r["n_removed"], sha(r["text"])) for r in passages.remove_repeats(documents(spark, data)).collect()}
    assert result == brute(data)


class Rows:
    """Stands for a DataFrame, to call what it would run."""

    def where(self, _):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        return run


@pytest.mark.parametrize("bit", [48, 52, 60])
def test_windows_whose_fingerprints_agree_in_part_are_not_confused(spark, monkeypatch, bit):
    """Document 1 holds another window than 2 and 3, equal in the low bits and of the same shard."""
    import numpy as np
    import pyarrow as pa

    shown = {1: 5, 2: 5 + (1 << bit), 3: 5 + (1 << bit)}
    one = np.zeros(1, dtype=np.int64)
    monkeypatch.setattr(passages, "window_hashes", lambda batch, length: (np.array([shown[batch.ids[0].as_py()]], dtype=np.uint64), one, one, one))
    docs = [pa.RecordBatch.from_pydict({"doc_id": pa.array([i], pa.int64()), "text": pa.array(["a b c"])}) for i in shown]
    send, find = passages._send_windows(Rows(), 2, 1, 1), passages._find_later(Rows(), 1)
    blocks = [b for d in docs for b in send(iter([d]))]
    rows = [r for b in find(iter(blocks)) for r in b.to_pylist()]
    assert [np.cumsum(passages._open(r["docs"], np.int64)).tolist() for r in rows if r["kind"] == 1] == [[3]]
    assert [np.cumsum(passages._open(r["docs"], np.int64)).tolist() for r in rows if r["kind"] == 2] == [[2]]
