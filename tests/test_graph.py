import random
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from histlake.operators import graph
from histlake.plans.shared import shared_folder
from histlake.streaming import watch


def frames(spark, n=60, seed=1):
    rng = random.Random(seed)
    edges = [("r", f"c{i:02}", k, f"c{p:02}") for i in range(n) for k, p in enumerate(rng.sample(range(i), min(i, rng.randrange(3))))]
    commits = spark.createDataFrame([("r", f"c{i:02}", i) for i in range(n)] + [("lone", "x", 0)], "repo string, sha string, author_ts long")
    return commits, spark.createDataFrame(edges, "repo string, child string, ordinal int, parent string"), edges


def test_closures_are_dual(spark):
    commits, edges, raw = frames(spark)
    up = {(r["seed"], r["sha"]) for r in graph.ancestors(commits, edges, commits).collect()}
    down = {(r["sha"], r["seed"]) for r in graph.descendants(commits, edges, commits).collect()}
    assert up == down and all((c, p) in up for _, c, _, p in raw)
    g = {r["sha"]: r["generation"] for r in graph.generations(commits, edges).collect()}
    assert all(g[c] > g[p] for _, c, _, p in raw) and g["x"] == 1


def closure_of(raw, nodes):
    up = {n: {n} for n in nodes}
    for _ in nodes:
        for _, c, _, p in raw:
            up[c] |= up[p]
    return up


def test_kernels_equal_closures(spark, monkeypatch):
    monkeypatch.setattr(graph, "BIT_BYTES", 1000)  # sets of bits in several passes
    for seed in range(4):
        commits, edges, raw = frames(spark, 90, seed)
        commits = commits.where("repo = 'r'")
        names = [f"c{i:02}" for i in range(90)]
        up = closure_of(raw, names)
        counts = {r["sha"]: (r["ancestors"], r["descendants"]) for r in graph.reach_counts(commits, edges).collect()}
        assert counts == {n: (len(up[n]), sum(n in up[m] for m in names)) for n in names}
        assert {(r["seed"], r["sha"]) for r in graph.reach_by_levels(edges, commits).collect()} == {(n, m) for n in names for m in up[n]}
        assert {(r["sha"], r["seed"]) for r in graph.reach_by_levels(edges, commits, up=False).collect()} == {(n, m) for n in names for m in up[n]}

        rng = random.Random(seed)
        generation = {r["sha"]: r["generation"] for r in graph.generations(commits, edges).collect()}
        head = max(names, key=lambda n: (len(up[n]), n))
        merges = [n for n in up[head] if sum(c == n for _, c, _, _ in raw) > 1]
        landed = {r["sha"]: (r["generation"], r["merge"]) for r in graph.landings(commits, edges, commits, spark.createDataFrame([("r", head)], "repo string, sha string")).collect()}
        want = {n: min((generation[m], m) for m in merges if m != n and n in up[m]) for n in up[head] if any(m != n and n in up[m] for m in merges)}
        assert landed == want

        tags = [("r", f"v{k % 5}.{k}", rng.choice(names)) for k in range(12)] + [("r", "lost", "nobody")]
        first = {r["sha"]: (r["generation"], r["author_ts"], r["name"], r["tag_sha"]) for r in graph.earliest_tags(commits, edges, spark.createDataFrame(tags, "repo string, name string, sha string"), commits).collect()}
        found = {n: [(generation[s], int(s[1:]), t, s) for _, t, s in tags[:-1] if n in up[s]] for n in names}
        assert first == {n: min(x) for n, x in found.items() if x}


def test_heads_reach_as_far_as_their_own_rows(spark):
    """Bits of several heads over one graph, where each head lacks other rows."""
    full = (1 << 63) - 1
    for seed in range(3):
        commits, edges, raw = frames(spark, 60, seed)
        commits = commits.where("repo = 'r'")
        rng = random.Random(seed)
        names = [f"c{i:02}" for i in range(60)]
        heads = {bit: rng.choice(names) for bit in (0, 1, 2, 5, 62)}
        passing = {(c, p): full & ~(sum(1 << b for b in (1, 62) if rng.random() < 0.2)) for _, c, _, p in raw}
        held = {n: full & ~(4 if rng.random() < 0.1 else 0) for n in names}
        marked = [("r", n, held[n]) for n in names]
        kept = [("r", c, p, bits & held[c] & held[p]) for (c, p), bits in passing.items()]
        asked = [("r", s, 1 << b) for b, s in heads.items()] + [("r", "nobody", 1 << 7)]
        table = lambda rows, of: spark.createDataFrame(rows, f"repo string, {of}, bits long")
        reached = graph.heads_reached(table(marked, "sha string"), table(kept, "child string, parent string"), table(asked, "sha string"))
        own = {b: closure_of([("r", c, 0, p) for _, c, p, bits in kept if bits >> b & 1], names)[s] if held[s] >> b & 1 else set() for b, s in heads.items()}
        assert {r["sha"]: r["bits"] for r in reached.collect()} == {n: sum(1 << b for b in heads if n in own[b]) for n in names if any(n in own[b] for b in heads)}

        generation = {r["sha"]: r["generation"] for r in graph.generations(commits, edges).collect()}
        rows = graph.compare_heads(reached, graph.generations(commits, edges)).collect()
        best = lambda both: min(((-generation[n], n) for n in both), default=(None, None))
        want = {b: (len(own[b]), len(own[b] & own[0]), len(own[b] - own[0]), len(own[0] - own[b]), best(own[b] & own[0])[1]) for b in heads if b and own[b]}
        assert {r["bit"]: (r["ancestors"], r["common"], r["ahead"], r["behind"], r["lca"]) for r in rows} == want
        assert all(r["lca_generation"] == (generation[r["lca"]] if r["lca"] else None) for r in rows)


def test_one_long_history(spark):
    """A component of 200,000 commits, all of them asked for."""
    n = 200_000
    commits = spark.range(n).selectExpr("0L AS repo", "id AS sha", "id AS author_ts")
    edges = spark.range(1, n).selectExpr("0L AS repo", "id AS child", "0 AS ordinal", "id - 1 AS parent").union(spark.range(2, n, 100).selectExpr("0L AS repo", "id AS child", "1 AS ordinal", "id - 2 AS parent"))
    tags = spark.createDataFrame([(0, f"v{i}", i) for i in range(0, n, 1000)], "repo long, name string, sha long")
    began = time.time()
    first = graph.earliest_tags(commits, edges, tags, commits)
    assert first.where("tag_sha = ceil(sha / 1000) * 1000").count() == n - 999
    heads = spark.createDataFrame([(0, n - 1)], "repo long, sha long")
    assert graph.landings(commits, edges, commits, heads).where("merge = floor((sha + 98) / 100) * 100 + 2").count() > 0.9 * n
    assert time.time() - began < 60


def test_cycles_and_absent_parents(spark):
    commits = spark.createDataFrame([("r", s) for s in "abcd"], "repo string, sha string")
    edges = spark.createDataFrame([("r", "a", 0, "b"), ("r", "b", 0, "a"), ("r", "c", 0, "a"), ("r", "d", 0, "gone"), ("r", "d", 1, "c")], "repo string, child string, ordinal int, parent string")
    assert {r["sha"]: r["generation"] for r in graph.generations(commits, edges).collect()} == {"a": 0, "b": 0, "c": 0, "d": 0}
    known = graph.known_edges(commits, edges)
    assert {r["child"]: r["parent"] for r in graph.first_parents(known).collect()}["d"] == "c"
    seeds = spark.createDataFrame([("r", "nobody")], "repo string, sha string")
    assert graph.ancestors(commits, edges, seeds).count() == 0


def test_small_batches_keep_components_whole(spark, monkeypatch):
    monkeypatch.setattr(graph, "BATCH_ROWS", 7)
    commits = spark.createDataFrame([(k, i) for k in range(40) for i in range(6)], "component long, sha long")
    edges = spark.createDataFrame([(k, i, 0, i - 1) for k in range(40) for i in range(1, 6)], "component long, child long, ordinal int, parent long")
    rows = graph.generations(commits, edges, "component").collect()
    assert len(rows) == 240 and all(r["generation"] == r["sha"] + 1 for r in rows)


class Handed:
    """Stands for a table: gives the function that mapInArrow got."""

    def repartition(self, *_):
        return self

    def sortWithinPartitions(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def test_rows_of_a_long_component_are_joined_once(monkeypatch):
    monkeypatch.setattr(graph, "BATCH_ROWS", 100)
    joined, concat = [], pd.concat
    monkeypatch.setattr(pd, "concat", lambda frames, **k: joined.append(sum(map(len, frames))) or concat(frames, **k))
    for keys in ([1] * 3000, ["a"] * 30 + ["b"] * 3000 + ["c"] * 250 + ["d"], [None] * 210 + ["a"] * 10 + ["b"] * 190 + ["c"] * 500):
        joined.clear()
        held = []
        run = graph._in_components(Handed(), lambda frame: held.append(frame) or frame, "")
        batches = [pa.RecordBatch.from_pydict({"component": keys[i : i + 10], "a": list(range(i, min(i + 10, len(keys))))}) for i in range(0, len(keys), 10)]
        assert [x for b in run(iter(batches)) for x in b.column("a").to_pylist()] == list(range(len(keys)))
        seen = [set(f["component"].fillna("none")) for f in held]
        assert sum(map(len, seen)) == len(set().union(*seen))  # no component came in two pieces
        assert sum(joined) <= len(keys)


def test_streams(spark, tmp_path):
    rows = [("r", "pack", "p", i, f"{i:040}", "commit", 1, bytearray(f"author A <a> {1_700_000_000 + i * 86_400} +0000\n\ncat {i}".encode())) for i in range(4)]
    from histlake.schema import OBJECTS

    spark.createDataFrame(rows, OBJECTS).write.parquet(f"{tmp_path}/objects")
    stream = watch.object_stream(spark, f"{tmp_path}/objects")
    for name, frame, want in (("found", watch.matching(stream, "commit", "cat"), 4), ("days", watch.commits_by_day(stream), None)):
        q = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", shared_folder(spark)).start()
        q.processAllAvailable()
        q.stop()
        assert want is None or spark.table(name).count() == want


@pytest.mark.parametrize("seed", range(4))
def test_reaches_equals_closures(spark, seed):
    """All pairs of a few components; labels answer most, walks the rest."""
    rng = random.Random(seed)
    commits, edges, asked = [], [], []
    for repo in ("a", "b"):
        n = 70
        commits += [(repo, f"{i:02d}") for i in range(n)]
        for i in range(1, n):
            if rng.random() < 0.95:
                edges += [(repo, f"{i:02d}", k, f"{p:02d}") for k, p in enumerate(rng.sample(range(max(0, i - 9), i), min(i, rng.choice([1, 1, 2, 3]))))]
        asked += [(repo, f"{i:02d}", f"{j:02d}") for i in range(0, n, 3) for j in range(n)]
    asked += [("a", "00", "zz"), ("zz", "00", "00"), ("a", None, "00"), ("a", "00", None)]
    c, e, p = (spark.createDataFrame(x, y) for x, y in ((commits, "repo string, sha string"), (edges, "repo string, child string, ordinal int, parent string"), (asked, "repo string, sha string, target string")))
    inside = {tuple(r) for r in graph.ancestors(c, e, c).select("repo", "seed", "sha").collect()}
    found = {(r["repo"], r["sha"], r["target"]): r["reached"] for r in graph.reaches(c, e, p).collect()}
    assert found == {k: k in inside for k in asked}


def test_reaches_walks_no_deeper_than_it_must(monkeypatch):
    """A line of 50,000 commits with a side branch at its top: the search for it does not go down the line."""
    n = 50_000
    rows = [("r", 0, i, i) for i in range(n + 3)] + [("r", 1, i, i - 1) for i in range(1, n)]
    rows += [("r", 1, n, n - 2), ("r", 1, n + 1, n - 1), ("r", 1, n + 1, n), ("r", 1, n + 2, n - 1)]
    g = graph._Graph(pd.DataFrame(rows, columns=["component", "role", "a", "b"]))
    place, size = g.intervals
    assert sorted(place.tolist()) == list(range(g.n))
    began = time.time()
    nodes, targets = np.array([n + 1, n + 1, n + 2, n + 1] * 200), np.array([n, n - 1, n, 5] * 200)
    assert g.reaches(nodes, targets).tolist() == [True, True, False, True] * 200
    assert time.time() - began < 2
