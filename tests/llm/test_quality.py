"""Quality rules against brute force: counts, measures, fitted bands and the verdict."""

import collections
import math
import random
import re

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece

from histlake.llm import quality
from histlake.llm.common import work_dir
from tests.llm.helpers import WORD, documents, save
from tests.llm.test_rowwise import TEXTS

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vocabularies():
    return quality.default_vocabularies()


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    times = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {j for i, g in enumerate(zip(words, words[1:], words[2:])) if times[g] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)]


def base_failed(text):
    counts = brute_counts(text)
    return counts[0] < 50 or 100 * counts[4] > 50 * counts[0]


def brute_measures(texts):
    """MEASURED of each text, with the libraries' own encoders and plain sums."""
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    single = re.compile(r"<0x([0-9A-F]{2})>")
    byte = quality.default_vocabularies()[1]
    out = []
    for text in texts:
        found = []
        tokens = [pieces.id_to_piece(i) for i in pieces.encode(text)]
        falls = [bool(m := single.fullmatch(t)) and chr(int(m[1], 16)) not in " \t\n\x0b\x0c\r" for t in tokens]
        found.append((tokens, falls))
        ids = byte._made()[0].encode_ordinary(text)
        names = [byte._made()[0].decode_single_token_bytes(i) for i in ids]
        found.append((names, [len(t) == 1 and t[0] > 127 for t in names]))
        row = []
        for tokens, falls in found:
            n = len(tokens)
            p = [c / n for c in collections.Counter(tokens).values()]
            row += [len(text) / n, sum(falls) / n, -sum(x * math.log2(x) for x in p) / max(1.0, math.log2(min(n, 256)))] if n else [0.0] * 3
        out.append([round(x, 3) for x in row])
    return out


def brute_bands(rows):
    """(kind, name) -> bands; rows (lang, script, measures) of the documents that pass the base rules."""
    groups = collections.defaultdict(list)
    for lang, script, measures in rows:
        groups["lang", lang].append(measures)
        groups["script", script].append(measures)
    out = {}
    for key, found in groups.items():
        if key[1] is None or len(found) < quality.LEAST_DOCS:
            continue
        bands = []
        for i in range(6):
            a, m, b = np.percentile([x[i] for x in found], [25, 50, 75])
            reach = 4.0 * max(b - a, 0.02 * m, (0.02, 0.02, 0.01)[i % 3])
            bands.append((-math.inf if i % 3 == 1 else m - reach, math.inf if i % 3 == 2 else m + reach))
        out[key] = bands
    return out


def brute_limits(script):
    low, high, most, least = quality.LIMITS[script]
    return [(low, high), (-math.inf, most), (least, math.inf)] * 2


def test_counts(spark, tmp_path):
    rng = random.Random(7)
    texts = TEXTS + ["\n".join(" ".join(rng.choice("ab c# d é".split(" ")) for _ in range(rng.randrange(9))) for _ in range(rng.randrange(20))) for _ in range(60)]
    out = {r["doc_id"]: r for r in quality.op10_quality_rules(spark, save(spark, tmp_path, texts)).collect()}
    for i, text in enumerate(texts):
        assert [out[i][c] for c in quality.COUNTS] == brute_counts(text)
        assert out[i]["base_failed"] == base_failed(text)
        assert not (out[i]["base_failed"] and out[i]["kept"])


def test_query_equals_brute_force_and_rejects(spark):
    docs = pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()
    quality_of = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{FOLDER}/labels.parquet").to_pylist()}
    out = {r["doc_id"]: r for r in quality.op10_quality_rules(spark, FOLDER).collect()}
    measures = brute_measures([d["text"] or "" for d in docs])
    passing = [(d, m) for d, m in zip(docs, measures, strict=True) if not base_failed(d["text"])]
    bands = brute_bands([(d["lang"], quality.script(d["text"]), m) for d, m in passing])
    assert ("lang", "en") in bands and ("script", "latin") in bands and ("lang", "es") not in bands
    rejected = collections.Counter()
    for d, m in zip(docs, measures, strict=True):
        row = out[d["doc_id"]]
        if base_failed(d["text"]):
            assert not row["kept"] and all(row[c] is None for c in quality.MEASURED)
            continue
        assert [row[c] for c in quality.MEASURED] == pytest.approx(m, abs=0.0011)
        mine = bands.get(("lang", d["lang"])) or bands.get(("script", quality.script(d["text"] or ""))) or brute_limits(quality.script(d["text"] or ""))
        edge = min(abs(x - y) for x, band in zip(m, mine, strict=True) for y in band)
        kept = all(a <= x <= b for x, (a, b) in zip(m, mine, strict=True))
        assert row["kept"] == kept or edge < 0.003
        rejected[quality_of.get(d["doc_id"]), row["kept"]] += 1
    # the bands reject a good part of the texts labelled as poor, and hardly any that is labelled as good
    assert rejected[0, False] >= 0.4 * (rejected[0, False] + rejected[0, True]) > 0
    assert rejected[1, False] <= 0.01 * rejected[1, True]


def corpus(rng, n, words, ends=("", "s", "ly", "ing", "er")):
    return [" ".join(rng.choice(words) + rng.choice(ends) for _ in range(120)) for _ in range(n)]


ENGLISH = "read apple river mountain music paper green window garden table bridge letter summer winter doctor market silver stone forest kitchen teacher student picture yellow reason window".split()
FINNISH = "yö työ äiti pöytä lähtö käsi järvi syksy hyvä kylä mäki tähti jää löytää myöhään ystävä tyttö näyttää säästö".split()


def test_scrambled_and_foreign_texts_are_rejected(spark, vocabularies):
    rng = random.Random(2)
    clean = corpus(rng, 230, ENGLISH)
    scrambled = ["".join(rng.sample(t, len(t))) for t in clean[:10]]
    foreign = corpus(rng, 10, FINNISH, ("", "ä", "ssä"))
    marked = [t.replace(" ", "%%% ") for t in clean[:10]]
    rows = [(i, t, "en") for i, t in enumerate(clean + scrambled + foreign + marked)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    kept = {r["doc_id"] for r in quality.score(docs, vocabularies, work_dir(spark)).where("kept").collect()}
    assert kept == set(range(len(clean)))
    # without bands, by the base rules alone, all of them stay
    assert quality.score(docs, vocabularies, work_dir(spark), width=1e6).where("kept").count() == len(rows)


def test_filter_keeps_columns(spark, vocabularies):
    rng = random.Random(3)
    rows = [(None if i == 4 else i, t, "x", i, "en" if i % 2 else None) for i, t in enumerate(TEXTS + corpus(rng, 9, ENGLISH) * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, script string, kept long, lang string")
    kept = quality.keep(docs, vocabularies, work_dir(spark))
    assert kept.columns == docs.columns and kept.schema.simpleString() == docs.schema.simpleString()
    assert sorted(r["kept"] for r in kept.collect()) == list(range(len(TEXTS), len(rows)))
    nested = docs.selectExpr("doc_id", "text", "lang", "named_struct('a b', array(kept), 'c', script) AS `odd name`")
    assert sorted(r["odd name"]["a b"][0] for r in quality.keep(nested, vocabularies, work_dir(spark)).collect()) == list(range(len(TEXTS), len(rows)))
    assert quality.keep(docs.limit(0), vocabularies, work_dir(spark)).count() == 0


def test_awkward_tables(spark, vocabularies):
    schema = "doc_id long, text string, lang string, n_words string, kept string"
    assert quality.score(spark.createDataFrame([], schema), vocabularies, work_dir(spark)).count() == 0
    text = corpus(random.Random(1), 1, ENGLISH)[0]
    rows = [(None, text, None, "a", "b"), (1, text, "xx", None, None), (1, text, "xx", None, None), (2, None, "en", "", "")]
    out = quality.score(spark.createDataFrame(rows, schema), vocabularies, work_dir(spark)).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["kept"]) for r in out) == [(0, 120, True), (1, 120, True), (1, 120, True), (2, 0, False)]
    assert quality.score(spark.createDataFrame(rows, schema), vocabularies, work_dir(spark), lang_col=None).where("kept").count() == 3


def test_byte_vocabulary_takes_very_long_runs(vocabularies):
    byte = vocabularies[1]
    for run in (" " * 300_000, "\n" * 300_000, "a" * 300_000, "é" * 100_000, "#" * 300_000, " \t" * 100_000):
        assert len(byte.encode(f"x {run} y"))
    text = "Plain words,  two spaces; and élan 12.\n\nNew"
    assert byte.encode(text).tolist() == byte._made()[0].encode_ordinary(text)
    assert byte.encode(None).tolist() == []


def test_scripts():
    assert [quality.script(t) for t in ("hello é", "привет", "日本語", "123", "αβγ")] == ["latin", "cyrillic", "han", "other", "greek"]
    assert all(quality.script(t + " (A)") == "other" for t in OTHER_SCRIPTS.values())
    assert quality.script("word and more words in Latin, then 한국") == "latin" and quality.script("Ệ ạ ậ ẵ") == "latin"
    assert quality.script("ἄᾳὧ an") == "greek" and quality.script("𠀀𠀁 a") == "han" and quality.script("×÷ 12 !") == "other"


OTHER_SCRIPTS = {
    "hangul": "나는 오늘 아침에 일찍 일어나서 강가를 따라 천천히 걸었다 물은 맑고 바람은 시원했으며 멀리 산 위로 해가 떠올랐다 사람들은 시장에서 과일과 생선을 팔고 아이들은 학교로 달려갔다",
    "arabic": "استيقظت هذا الصباح مبكرا ومشيت ببطء على ضفة النهر وكان الماء صافيا والريح باردة وأشرقت الشمس فوق الجبل البعيد وكان الناس يبيعون الفاكهة والسمك في السوق",
    "hebrew": "הבוקר קמתי מוקדם והלכתי לאט לאורך הנהר המים היו צלולים והרוח קרירה והשמש זרחה מעל ההר הרחוק אנשים מכרו פירות ודגים בשוק והילדים רצו לבית הספר",
    "devanagari": "आज सुबह मैं जल्दी उठा और नदी के किनारे धीरे धीरे चला पानी साफ था हवा ठंडी थी और दूर पहाड़ के ऊपर सूरज निकला लोग बाजार में फल और मछली बेच रहे थे",
    "thai": "เช้านี้ ฉัน ตื่น แต่ เช้า และ เดิน ช้า ช้า ไป ตาม แม่น้ำ น้ำ ใส ลม เย็น และ ดวงอาทิตย์ ขึ้น เหนือ ภูเขา ไกล ผู้คน ขาย ผลไม้ และ ปลา ใน ตลาด",
}


def test_other_scripts_with_a_latin_letter_are_kept(spark, vocabularies):
    # the sentence, and its words in other orders, so that no three words repeat
    texts = []
    for t in OTHER_SCRIPTS.values():
        w = t.split()
        texts.append(" ".join(w + w[::-1] + w[::2] + w[1::2] + w[::3]) + " (A)")
    rows = [(i, t, lang) for i, t in enumerate(texts) for lang in (None, "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = quality.score(docs, vocabularies, work_dir(spark)).collect()
    assert [(r["base_failed"], r["kept"]) for r in out] == [(False, True)] * len(rows)
    assert quality.keep(docs, vocabularies, work_dir(spark)).count() == len(rows)
