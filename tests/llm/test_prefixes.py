"""The prefix trie against brute force over whole prefixes."""

import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from histlake.llm import prefixes
from histlake.llm.common import work_dir
from tests.llm.helpers import sha

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def said(rows):
    """Turns of each conversation, in order."""
    out = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out[c].append((role or "", text or ""))
    return out


def borrowed(turns):
    return {c: turns.get(c - c % 100, [])[:h] + own[h:] for c, own in turns.items() for h in [0 if c % 100 == 0 else zlib.crc32(str(c).encode()) % 6]}


def brute_nodes(turns):
    members, kids, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c, own in turns.items():
        for d in range(len(own) + 1):
            members[tuple(own[:d])].append(c)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    for path, held in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += kids[path] == 0
            saved[path[:d]] += (len(held) - 1) * len(path[-1][1]) if path else 0
    ends = lambda path, held: ",".join(str(c) for c in sorted(held) if len(turns[c]) == len(path))
    return sorted((min(held), len(p), min(members[p[:-1]]) if p else -1, len(held), kids[p], leaves[p], saved[p], sha(ends(p, held))) for p, held in members.items())


def told(df):
    assert df.columns == COLUMNS and [t for _, t in df.dtypes] == ["bigint"] * 7 + ["string"]
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


def made(rng, n):
    """Conversations that share openings and end early, with nulls, ties and repeated rows."""
    texts = ["", None, "é日本", "yes", "no " * 9, "x:y"]
    rows = []
    for c in rng.sample([*range(12), *range(100, 130), *range(250, 290), 400, 1001], n):
        for i in range(rng.choice([1, 2, 3, 7, 8, 9, 20])):
            rows.append((c, rng.choice([i, i, i, None, 3]), rng.choice(["user", "assistant", None]), rng.choice(texts[: rng.choice([2, 6])])))
    rows += rng.sample(rows, 5) + [(None, 0, "user", "lost"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_query_equals_brute_force_and_sql(spark, tmp_path, seed):
    rows = made(random.Random(seed), 40)
    df = spark.createDataFrame([(*r, "k") for r in rows], SCHEMA + ", depth string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    expected = brute_nodes(borrowed(said(rows)))
    assert told(prefixes.op12_conversation_prefix_trie(spark, str(tmp_path))) == expected
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    answer = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({prefixes.OP12_SQL})").fetchall()
    assert sorted(tuple(-1 if x is None else x for x in r) for r in answer) == expected


def test_conversations_as_they_are(spark):
    """A long conversation with a snapshot at each turn, copies of it, and one that differs in its last turn."""
    full = [("user" if i % 2 else "assistant", f"t{i % 5}") for i in range(40)]
    turns = {i + 1: full[: i + 1] for i in range(40)} | {c: full for c in range(5000, 14000, 90)} | {77: [*full[:-1], ("user", "other")]}
    rows = [(c, i, *t) for c, own in turns.items() for i, t in enumerate(own)]
    folder = work_dir(spark)
    ordered = prefixes.ordered_turns(spark.createDataFrame(rows, SCHEMA), folder)
    assert told(prefixes.prefix_trie(*prefixes.as_they_are(ordered, folder), folder)) == brute_nodes(turns)


def test_empty_tables_and_turnless_conversations(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    empty.write.parquet(f"{tmp_path}/a/conversations.parquet")
    assert told(prefixes.op12_conversation_prefix_trie(spark, f"{tmp_path}/a")) == []
    # without the first of their hundred, short conversations may lose all turns
    short = [c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 1][:4]
    rows = [(c, 0, "user", "only") for c in short]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert told(prefixes.op12_conversation_prefix_trie(spark, f"{tmp_path}/b")) == [(min(short), 0, -1, 4, 0, 1, 0, sha(",".join(map(str, sorted(short)))))]


def test_digests_of_many_ids(spark):
    """Ids of a name come in many strings, negative ones too, in whatever order."""
    ids = [*range(-9000, 9000, 7)]
    rows = [(1, c) for c in ids] + [(2, 5), (3, -(1 << 62)), (3, 1 << 62)]
    random.Random(1).shuffle(rows)
    found = dict(tuple(r) for r in prefixes.ends_digests(spark.createDataFrame(rows, "name long, conv_id long")).collect())
    assert found == {1: sha(",".join(map(str, ids))), 2: sha("5"), 3: sha(f"{-(1 << 62)},{1 << 62}")}
