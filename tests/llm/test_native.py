"""Line dedup and chat formatting against brute force; both are free of Python on the executors."""

import random
import re

import pytest
from pyspark.sql import functions as F

from histlake.llm import chat, lines, suffixes
from tests.llm.helpers import documents, save, sha

SPACES = " \t\n\x0b\x0c\r"


def brute_lines(texts, least=10):
    key = lambda l: "".join(c.lower() if "A" <= c <= "Z" else c for c in l.strip(SPACES))
    holders = {}
    for i, t in enumerate(texts):
        for l in (t or "").split("\n"):
            holders.setdefault(key(l), set()).add(i)
    out = {}
    for i, t in enumerate(texts):
        all_lines = (t or "").split("\n")
        kept = [l for l in all_lines if not (len(key(l)) >= least and len(holders[key(l)]) >= 2 and i > min(holders[key(l)]))]
        out[i] = (len(all_lines), len(all_lines) - len(kept), sha("\n".join(kept)))
    return out


def test_line_dedup(spark, tmp_path):
    rng = random.Random(3)
    pool = ["A shared line of text", " a SHARED line of text\t", "short", "ÉTÉ ligne partagée", "été ligne partagée", "unique", "", "only one more line x", "same twice in one doc"]
    texts = [None, "", "\n\n", "a line with nbsp ", "a line with nbsp"] + ["\n".join(rng.choice(pool) + (str(rng.random()) if rng.random() < 0.2 else "") for _ in range(rng.randrange(8))) for _ in range(80)]
    texts.append("\n".join(["A shared line of text"] * 3000 + ["tail is here alone"]))
    out = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in lines.op9_line_dedup(spark, save(spark, tmp_path, texts)).collect()}
    assert out == brute_lines(texts)


def test_line_dedup_keeps_columns_and_nulls(spark):
    docs = spark.createDataFrame([(1, "the same long line", "a", 0), (2, "the same long line\nx", None, 1), (None, None, "c", 2)], "doc_id long, text string, pos string, dropped int")
    out = lines.drop_lines(docs)
    assert out.columns == docs.columns
    assert {(r["doc_id"], r["text"], r["pos"]) for r in out.collect()} == {(1, "the same long line", "a"), (2, "x", None), (None, None, "c")}
    assert lines.drop_lines(docs.limit(0)).count() == 0


def test_line_threshold(spark):
    docs = documents(spark, ["a repeated line"] * 3 + ["another one here"] * 2)
    gone = {r["doc_id"] for r in lines.dropped_positions(docs, min_docs=3).collect()}
    assert gone == {1, 2}


def test_documents_with_too_few_words_left_go(spark):
    docs = documents(spark, ["the same line of words\nthree own words", "the same line of words\ntwo more", "short", None, "the same line of words", "", "the same line of words\nand three others"])
    assert {r["doc_id"]: r["text"] for r in lines.drop_lines(docs, least_words=3).collect()} == {0: "the same line of words\nthree own words", 2: "short", 3: None, 5: "", 6: "and three others"}


def save_turns(spark, tmp_path, turns):
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def test_chat_round_trip(spark, tmp_path):
    rng = random.Random(5)
    nasty = ["</s>", "<s>", "<\\s>", "<\\\\/s>", "[INST]", "[/INST]", "<<SYS>>", "\\", "\n", "é", "$1", "<", "[", "%0A", "%"]
    turns = []
    for c in range(40):
        for t in range(rng.randrange(1, 30)):
            role = "system" if t == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "assistant", "to\nol", None])
            text = rng.choice([None, "", "".join(rng.choice(nasty + ["word "]) for _ in range(rng.randrange(200)))])
            turns.append((c, t, role, text))
    turns += [(7, 3, "user", "same turn"), (7, 3, "user", "same turn"), (99, 0, "assistant", "long " * 4000), (99, 1, "assistant", "after")]
    rng.shuffle(turns)
    out = {r["conv_id"]: r for r in chat.op2_chat_format(spark, save_turns(spark, tmp_path, turns)).collect()}
    turns += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert sorted(out) == sorted({t[0] for t in turns})
    for c in out:
        mine = sorted((t, r or "", x or "") for k, t, r, x in turns if k == c)
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert out[c]["n_turns"] == len(mine)
        assert out[c]["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for _, r, x in mine))
        assert (out[c]["loss_chars"], out[c]["loss_sha256"]) == (len(loss), sha(loss))


def brute_windows(turns, budget, history):
    """(first new turn, first repeated turn, system turn repeated, last turn) of each window; turns are (role, tokens), numbered from 0."""
    out, p = [], 0
    has_system = turns[0][0] == "system"
    cost = lambda a, b: sum(n for _, n in turns[a:b])
    while p < len(turns):
        system = has_system and p > 0 and turns[0][1] + turns[p][1] <= budget
        left = budget - turns[p][1] - (turns[0][1] if system else 0)
        back = p
        while back > has_system and cost(back - 1, p) <= min(history, left):
            back -= 1
        end = p + 1
        while end < len(turns) and cost(back, end + 1) + (turns[0][1] if system else 0) <= budget:
            end += 1
        out.append((p, back, system, end))
        p = end
    return out


def count_tokens(text):
    return len(re.findall(chat.TOKEN, text)) + 3


def test_windows_keep_system_and_budget(spark):
    rng = random.Random(9)
    turns = []
    for c in range(60):
        for t in range(rng.randrange(1, 40)):
            role = "system" if t == 0 and c % 2 else "assistant" if t % 2 else "user"
            turns.append((c, t, role, "word " * rng.choice([0, 1, 5, 20, 60, rng.randrange(150)]) + f"{t}!"))
    budget, history = 120, 50
    told = {}
    for r in chat.windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), budget, history).collect():
        told.setdefault(r["conv_id"], []).append(r)
    repeats = alone = 0
    for c, found in told.items():
        mine = [(r, x) for k, _, r, x in turns if k == c]
        found.sort(key=lambda r: r["window"])
        want = brute_windows([(r, count_tokens(x)) for r, x in mine], budget, history)
        assert len(found) == len(want)
        for r, (p, back, system, end) in zip(found, want, strict=True):
            held = [mine[0]] * system + mine[back:end]
            assert r["text"] == "".join(f"<s>{role}\n{text}</s>" for role, text in held)
            assert "".join(r["text"][s["start"] : s["start"] + s["length"]] for s in r["spans"]) == r["text"]
            fresh = [not s["repeated"] for s in r["spans"]]
            assert fresh == [False] * (system + p - back) + [True] * (end - p)
            assert [s["loss"] for s in r["spans"]] == [f and role == "assistant" for f, (role, _) in zip(fresh, held, strict=True)]
            # no window over the budget, but for a turn that is longer by itself
            assert sum(count_tokens(x) for _, x in held) <= budget or len(held) == 1
            repeats += p > back
            alone += len(held) == 1 and count_tokens(held[0][1]) > budget
        assert sum(s["loss"] for r in found for s in r["spans"]) == sum(r == "assistant" for r, _ in mine)
    assert repeats > 30 and alone > 10


def test_other_tokens(spark):
    turns = [(1, i, "user", "x" * 10) for i in range(6)]
    out = chat.windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), 30, 0, lambda text: F.length(text)).collect()
    assert [len(r["spans"]) for r in out] == [3, 3]


def test_null_conversation_and_clashing_columns(spark):
    rows = [(None, 0, "user", "hi", "a", 1), (None, 1, "assistant", "yo", "b", 2), (3, None, None, None, None, 3), (3, None, None, None, None, 3)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, spans string, tokens int")
    out = {r["conv_id"]: r for r in chat.windows(docs).collect()}
    assert out[None]["text"] == "<s>user\nhi</s><s>assistant\nyo</s>" and out[3]["text"] == "<s>\n</s>" * 2


def test_chat_empty(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string, window int")
    assert chat.windows(empty).count() == 0


@pytest.mark.parametrize("make", [lambda s, d: lines.op9_line_dedup(s, d), lambda s, d: chat.op2_chat_format(s, d)])
def test_no_python_in_the_plan(spark, make):
    plan = make(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_tables_dealt_over_salts_are_not_broadcast(spark):
    """Spark takes a table that stands there once for each salt to be as small as once, and gathered all of it on the driver."""
    docs = documents(spark, ["a line that two documents hold", "a line that two documents hold"])
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 10 << 20
    index = spark.createDataFrame([(1, 2, 3, 4)], suffixes.ENTRIES)
    for out in (lines.dropped_positions(docs), suffixes._semi(index, index, ["key"]), suffixes._semi(index, index, ["key", "reach"])):
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
