import collections
import math
import random

import numpy as np

from histlake.llm import decontaminate
from histlake.llm.common import work_dir
from tests.llm.helpers import documents, sentence


def words(text):
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (text or "").lower()).split()


def brute(texts, items, least=0.5):
    """Items whose parts' 3-grams lie in some passage of twice the step that holds the item."""
    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    out = set()
    for d, t in enumerate(texts):
        w = words(t)
        for i, x in items:
            v = words(x)
            step = next(64 << k for k in range(40) if 64 << k >= len(v))
            cut = len(words(x[: x.rstrip().rindex("?", 0, len(x.rstrip()) - 1)])) if "?" in x.strip()[:-1] else len(v) - max(len(v) // 3, min(len(v), 3))
            parts = [p for p in (v[:cut], v[cut:]) if p]
            for low in range(0, len(w), step):
                held = w[low : low + 2 * step]
                if parts and all(len(grams(p, min(3, len(p))) & grams(held, min(3, len(p)))) >= least * len(grams(p, min(3, len(p)))) for p in parts):
                    out.add((d, i))
    return out


def test_leaks_equal_brute_force(spark, tmp_path):
    rng = random.Random(6)
    items = [(i, sentence(rng, rng.randrange(12, 60), 900)) for i in range(60)] + [(60, "What is the capital of France? It is Paris on the river Seine"), (61, "Ñandú ÉTÉ " + sentence(rng, 20, 900)), (62, "what is the capital of france? it is paris on the river seine")]
    texts = [None, "", sentence(rng, 5)]
    for _ in range(150):
        parts = [sentence(rng, rng.randrange(1, 200), 900)]
        if rng.random() < 0.5:
            leak = rng.choice(items)[1].split()
            for _ in range(rng.randrange(3)):
                leak[rng.randrange(len(leak))] = "changed"
            parts.append(" ".join(leak).upper() if rng.random() < 0.3 else "!! ".join(leak))
        parts.append(sentence(rng, rng.randrange(1, 300), 900))
        texts.append(" ".join(parts))
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items + [(99, None), (98, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = decontaminate.op7_decontaminate(spark, str(tmp_path)).collect()
    want = brute(texts, items)
    assert len(want) > 50
    assert {(r["doc_id"], r["item_id"]) for r in found} == want and len(found) == len(want)
    kept = decontaminate.clean(documents(spark, texts), spark.read.parquet(f"{tmp_path}/benchmark.parquet"))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_several_passes_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 6_000)
    rng = random.Random(2)
    items = [(i, sentence(rng, 20, 900)) for i in range(20)]
    texts = [t for _, t in items] + [sentence(rng, 50, 900)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(documents(spark, texts), benchmark).collect()} == {(i, i) for i in range(20)}
    assert [r["doc_id"] for r in decontaminate.clean(documents(spark, texts), benchmark).collect()] == [20]
    assert decontaminate.leaks(documents(spark, texts), benchmark.limit(0)).count() == 0
    assert decontaminate.leaks(documents(spark, []), benchmark).count() == 0


def test_items_without_an_id_leak(spark):
    rng = random.Random(8)
    a, b, c = (sentence(rng, 30, 900) for _ in range(3))
    schema = "item_id long, text string"
    items = spark.createDataFrame([(None, a), (None, b), (0, c), (None, None), (None, "")], schema)
    docs = spark.createDataFrame([(1, f"{sentence(rng, 40, 900)} {a} {b}"), (2, sentence(rng, 90, 900)), (3, a), (4, c), (5, None)], "doc_id long, text string")
    found = sorted(((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()), key=str)
    assert found == [(1, None), (1, None), (3, None), (4, 0)]
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, items).collect()) == [2, 5]


def test_retrieval_equals_all_scores(spark, monkeypatch):
    """Every item at or above the threshold for every passage, against BM25 summed term by term."""
    monkeypatch.setattr(decontaminate, "ROUND", 200)
    rng = random.Random(5)
    common = [f"c{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(common) if rng.random() < 0.4 else f"r{rng.randrange(150)}" for _ in range(rng.randrange(4, 40)))) for i in range(120)]
    items += [(120, items[3][1]), (121, "c1 c2 c3")]
    table = decontaminate.index_table(spark.createDataFrame(items, "item_id long, text string").repartition(3), work_dir(spark))
    index = decontaminate.ItemIndex(table.orderBy("uid").toArrow())
    hash_of = lambda w: int(decontaminate._folded([w]).word_hashes(decontaminate.NOT_LETTER)[3][0])
    texts = [dict(items)[i] for i in index.ids]
    df = collections.Counter(w for t in texts for w in set(t.split()))
    mean = sum(len(t.split()) for t in texts) / len(texts)
    weights = []
    for t in texts:
        own = {w: math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(t.split()) / mean)) for w, f in collections.Counter(t.split()).items()}
        weights.append({w: x / sum(own.values()) for w, x in own.items()})
    passages = [set(rng.choice(texts).split()) | {f"r{rng.randrange(150)}" for _ in range(20)} | set(rng.sample(common, 5)) for _ in range(80)]
    place = {w: int(np.searchsorted(index.terms, np.uint64(hash_of(w)))) for w in df}
    key = np.unique([p * len(index.terms) + place[w] for p, held in enumerate(passages) for w in held if w in place])
    for least in (0.35, 0.5, 0.9):
        want = {(p, i): sum(x for w, x in weights[i].items() if w in held) for p, held in enumerate(passages) for i in range(len(texts))}
        found = {(int(p), int(i)): s for ps, its, ss in index.retrieve(key // len(index.terms), key % len(index.terms), least) for p, i, s in zip(ps, its, ss)}
        sure = {k for k, s in want.items() if s >= least + 1e-5}
        assert sure <= set(found) <= {k for k, s in want.items() if s >= least - 1e-5} and len(sure) > 10
        assert all(abs(want[k] - s) < 1e-9 for k, s in found.items())


def test_awkward_tables(spark):
    rng = random.Random(9)
    item, long_item = sentence(rng, 25, 900), sentence(rng, 4_000, 50_000)
    benchmark = spark.createDataFrame([(1, item, "x"), (2, long_item, "y"), (1, item, "x")], "item_id long, text string, score string")
    texts = [(None, f"{sentence(rng, 80, 900)} {item}"), (7, item), (7, item), (8, sentence(rng, 100_000, 50_000) + " " + long_item + " " + sentence(rng, 300, 900)), (9, "x" * 300_000), (10, None)]
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in texts], "doc_id long, text string, item_id string, score int")
    found = sorted(((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, benchmark).collect()), key=str)
    assert found == sorted([(None, 1)] * 2 + [(7, 1)] * 4 + [(8, 2)], key=str)
    kept = decontaminate.clean(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [9, 10]


def test_an_item_is_looked_for_by_its_own_length(spark):
    """Parts of an item that are strewn over a document are no leak, whatever other items there are."""
    rng = random.Random(12)
    short, long_ = sentence(rng, 30, 900).split(), sentence(rng, 1_500, 50_000)
    parts = [" ".join(short[i : i + 6]) for i in range(0, 30, 6)]
    strewn = " ".join(f"{p} {sentence(rng, 60, 50_000)}" for p in parts)
    docs = documents(spark, [strewn, " ".join(short), sentence(rng, 700, 50_000) + " " + long_ + " " + sentence(rng, 900, 50_000)])
    one, two = (spark.createDataFrame(items, "item_id long, text string") for items in ([(7, " ".join(short))], [(7, " ".join(short)), (8, long_)]))
    told = lambda benchmark: sorted((r["doc_id"], r["item_id"], round(r["question_overlap"], 9), round(r["answer_overlap"], 9)) for r in decontaminate.leaks(docs, benchmark).collect())
    assert told(one) == [(1, 7, 1.0, 1.0)]
    assert told(two) == [(1, 7, 1.0, 1.0), (2, 8, 1.0, 1.0)]
    assert [decontaminate.step_of(n) for n in (0, 1, 64, 65, 128, 129, 1500)] == [64, 64, 64, 128, 128, 256, 2048]
