import random

import corpus_pipeline
import sentencepiece
from histlake.llm import pieces, quality
from tests.llm import test_decontaminate, test_minhash, test_native, test_quality
from tests.llm.helpers import documents, sentence


def test_run_equals_brute_force(spark, tmp_path):
    rng = random.Random(12)
    plain = "river stone garden letter winter summer market bridge yellow silver paper window forest mountain kitchen doctor teacher student music picture".split()
    text = lambda n: " ".join(rng.choice(plain) + rng.choice(["", "s", "ing", "ed", "ly", "er"]) for _ in range(n))
    items = [(i, text(25)) for i in range(6)]
    texts = [None, "", "too short", "same words again " * 60]
    shared = "A line that many of these documents share with others"
    for i in range(40):
        texts.append("\n".join([shared] * (i % 3 == 0) + [text(80), text(60)] + ([items[i % 6][1]] if i % 10 == 3 else [])))
    texts += test_minhash.family(rng, texts[10].replace("\n", " "), 8, 4) + [texts[11]] * 3
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = {i: t for i, t in enumerate(texts) if not (lambda c: c[0] < 50 or 100 * c[4] > 50 * c[0])(test_quality.brute_counts(t))}
    key = lambda l: l.strip(test_native.SPACES).lower()
    holders = {}
    for i, t in left.items():
        for l in t.split("\n"):
            holders.setdefault(key(l), set()).add(i)
    deduped = {i: "\n".join(l for l in t.split("\n") if len(key(l)) < 10 or i == min(holders[key(l)])) for i, t in left.items()}
    left = {i: t for i, t in deduped.items() if t == left[i] or len(t.split()) >= quality.MIN_WORDS}
    assert len(left) < len(deduped)
    came = test_minhash.brute(texts)
    firsts = {}
    for i in sorted(left):
        firsts.setdefault(came[i][1], i)
    assert len(firsts) < len(left)
    left = {i: t for i, t in left.items() if firsts[came[i][1]] == i}
    same = {}
    for i in sorted(left):
        same.setdefault(left[i], i)
    left = {i: t for i, t in left.items() if same[t] == i}
    names = sorted(left)
    dirty = {names[d] for d, _ in test_decontaminate.brute([left[i] for i in names], items)}
    left = {i: t for i, t in left.items() if i not in dirty}

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 20 < len(left) < len(texts) and dirty
    assert {i: r["ids"] for i, r in out.items()} == {i: library.encode(t) for i, t in left.items()}
    assert all(r["round_trip"] for r in out.values())


def test_near_dedup_compares_what_line_dedup_left(spark, tmp_path):
    """Two documents that are near-duplicates but for lines which others hold as well."""
    rng = random.Random(8)
    say = lambda n: sentence(rng, n, 100_000)
    own, shared = say(100).split(), [say(60) for _ in range(4)]
    near = own[:50] + ["changed"] + own[51:]
    texts = ["\n".join([*shared, say(80)]), "\n".join([*shared[:2], " ".join(own)]), "\n".join([*shared[2:], " ".join(near)]), say(90)]
    docs = documents(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = lambda d: {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, d, str(tmp_path)).collect()}
    assert kept(docs) == {0, 1, 2, 3}
    assert kept(corpus_pipeline.line_dedup(spark, docs, str(tmp_path))) == {0, 1, 3}


def test_stages_keep_the_columns(spark, tmp_path):
    docs = documents(spark, [f"text number {i} {sentence(random.Random(i), 90, 5000)}" for i in range(5)] + [None, ""])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    benchmark = spark.createDataFrame([(1, "an item about nothing at all that is here")], "item_id long, text string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if "decontamination" in name:
            from histlake.llm import decontaminate

            out = decontaminate.clean(docs, benchmark)
        else:
            out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        assert out.where("doc_id < 5").count() == 5 or name == "quality rules"


def test_no_document_is_left_with_too_few_words(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    texts = {r["doc_id"]: r["text"] for r in pieces.decode(out, pieces.Vocabulary.load(pieces.default_model())).collect()}
    assert len(texts) > 100 and all(len(t.split()) >= quality.MIN_WORDS for t in texts.values())


def test_awkward_tables(spark, tmp_path):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(test_quality.ENGLISH) + rng.choice(["", "s", "ly", "ing", "er"]) for _ in range(n))
    long_ = say(200_000)
    texts = [None, "", say(80), long_]
    rows = [(i, t, "en", "src", 0, "x") for i, t in enumerate(texts)] + [(2, texts[2], "en", "src", 0, "y"), (None, say(90), None, None, None, None), (None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    spark.createDataFrame([(None, "an item"), (1, None), (2, "another item of a few words that nothing holds")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    out = [(r["doc_id"], r["n_chars"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(out, key=str) == sorted([(2, len(texts[2])), (2, len(texts[2])), (3, len(long_)), (None, len(rows[5][1]))], key=str)
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_no_group_of_near_duplicates_keeps_two(spark):
    """The groups that op8 finds in the documents, against what the pipeline keeps."""
    folder = "/root/testdata/sf0.001"
    groups = {r["doc_id"]: r["component_id"] for r in test_minhash.minhash.op8_minhash_dedup(spark, folder).collect()}
    kept = [groups[r["doc_id"]] for r in corpus_pipeline.run(spark, folder).collect()]
    assert len(set(groups.values())) < len(groups) and len(set(kept)) == len(kept) > 100
