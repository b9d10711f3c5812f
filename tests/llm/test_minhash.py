import os
import random
import time

from histlake.llm import minhash
from histlake.llm.common import work_dir
from histlake.llm.components import connected_components
from tests.llm.helpers import WORD, documents, save, sentence


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(rng.randrange(edits)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(11)
    texts = [None, "", " \n", "one two", "One TWO", "one two three four five", "ONE two three four five", "É é x", "é é x"]
    for n, length, edits in ((40, 120, 8), (30, 200, 14), (60, 90, 5), (5, 400, 30)):
        texts += family(rng, sentence(rng, length, 5000), n, edits)
    texts += [sentence(rng, rng.randrange(5, 300)) for _ in range(60)]
    texts += [texts[-1]] * 30 + [texts[-1].upper()] * 3
    rng.shuffle(texts)
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.op8_minhash_dedup(spark, save(spark, tmp_path, texts)).collect()}
    assert out == brute(texts)


def test_null_ids_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (1, "A b c d e f")], "doc_id long, text string")
    out = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, work_dir(spark)).collect())
    assert out == [(-1, None, True), (1, 1, True), (3, 1, False), (3, 1, False)]
    assert minhash.near_duplicates(documents(spark, []), work_dir(spark)).count() == 0


def test_components_of_long_chains(spark):
    rng = random.Random(2)
    nodes = list(range(300))
    rng.shuffle(nodes)
    chain = [(nodes[i], nodes[i + 1]) for i in range(199)] + [(nodes[i], nodes[200]) for i in range(201, 300)]
    out = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "u long, v long"), work_dir(spark)).collect()}
    assert {out[n] for n in nodes[:200]} == {min(nodes[:200])}
    assert {out[n] for n in nodes[200:]} == {min(nodes[200:])}


def test_crowded_buckets_are_dealt_anew(spark, monkeypatch):
    """Many documents share a passage, and among them are groups of near copies without a common original."""
    monkeypatch.setattr(minhash, "SMALL", 4)
    rng = random.Random(21)
    passage = sentence(rng, 60, 5000)
    texts = [passage + " " + sentence(rng, rng.randrange(10, 60), 5000) for _ in range(150)]
    for base in texts[:6]:
        texts += family(rng, base, 25, 6)
    rng.shuffle(texts)
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(documents(spark, texts), work_dir(spark)).collect()}
    assert out == brute(texts)


def test_rare_shingles_find_all_links(spark):
    rng = random.Random(31)
    passage = sentence(rng, 80, 5000)
    texts = [f"{passage} {sentence(rng, rng.randrange(5, 40), 5000)}" for _ in range(60)] + family(rng, passage, 40, 12) + family(rng, sentence(rng, 7, 50), 10, 2)
    docs = documents(spark, texts)
    members = docs.selectExpr("doc_id AS rep", "doc_id AS component", "true AS outside")
    from histlake.llm.common import packed_texts

    found = {(r["a"], r["b"]) for r in minhash.sharing_rare_shingles(members, packed_texts(docs.select("doc_id", "text"))).collect()}
    sets = [shingles(t) for t in texts]
    links = {(i, j) for j in range(len(texts)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert links <= found and len(found) < 3 * len(links)


def test_very_long_texts_and_clashing_columns(spark):
    rng = random.Random(41)
    long_ = sentence(rng, 60_000, 40_000)
    words = long_.split()
    words[500] = "changed"
    near = " ".join(words)
    texts = [long_, near, "x" * 500_000, "x" * 500_000, sentence(rng, 50, 900)]
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in enumerate(texts)], "doc_id long, text string, component_id string, kept int")
    out = {r["doc_id"]: (r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, work_dir(spark)).collect()}
    assert out == {0: (0, True), 1: (0, False), 2: (2, True), 3: (2, False), 4: (4, True)}
    kept = minhash.keep_first(docs, work_dir(spark))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 4]


def test_components_of_awkward_edges(spark):
    edges = spark.createDataFrame([(1, 1), (2, 3), (3, 2), (2, 3), (-5, 3)], "u long, v long")
    out = {r["node"]: r["component"] for r in connected_components(edges, work_dir(spark)).collect()}
    assert out == {2: -5, 3: -5, -5: -5}
    assert connected_components(edges.limit(0), work_dir(spark)).count() == 0


def test_classes_are_not_broadcast_once_for_each_salt(spark, tmp_path):
    out = minhash.near_duplicates(documents(spark, [sentence(random.Random(1), 60)] * 3), f"file://{tmp_path}/work")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "salt" in plan and not any("BroadcastHashJoin" in x and "salt" in x for x in plan.splitlines())


def _shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for _, _, names in os.walk(d.getPath()) for f in names if f.startswith("shuffle_")}


def test_steps_leave_no_shuffles_and_few_tables(spark, tmp_path, monkeypatch):
    """Of what was shuffled for a step nothing stays when the next one is written, and tables go when nothing reads them any more."""
    rng = random.Random(51)
    texts = [t for _ in range(20) for t in family(rng, sentence(rng, 80), 4, 4)]
    docs, folder, seen, before = documents(spark, texts), tmp_path / "work", {}, _shuffle_files(spark)
    rare = minhash.sharing_rare_shingles

    def look(*args):
        end = time.time() + 5
        while len(found := _shuffle_files(spark) - before) >= 50 and time.time() < end:
            time.sleep(0.1)
        seen["files"] = found
        seen["tables"] = {p.name for p in folder.iterdir()}
        return rare(*args)

    monkeypatch.setattr(minhash, "sharing_rare_shingles", look)
    assert {r["doc_id"] for r in minhash.keep_first(docs, f"file://{folder}").collect()} == {i for i, r in brute(texts).items() if r[2]}
    assert len(seen["files"]) < 50
    assert seen["tables"] == {"sets", "tried", "links", "components", "members"}
    assert {p.name for p in folder.iterdir()} == {"result"}
