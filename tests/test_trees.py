"""Tree differences and containing tags against plain Python."""

import os
import random
import time
from collections import Counter

import pytest

from histlake.operators import graph, trees
from histlake.plans import star

ENTRIES = "repo string, tree string, name string, sha string, is_tree boolean"


def made(rng, depth=4):
    """Trees as dictionaries, by id, of few kinds, so that directories repeat; the last layer's are roots."""
    layers = [{f"f{i}": None for i in range(6)}]
    tree_of = {}
    for level in range(depth):
        new = {}
        for i in range(6):
            below = rng.sample(sorted(layers[-1]), 2) + rng.sample(sorted(layers[0]), 2)
            new[f"t{level}-{i}"] = {rng.choice("abcdef") + ("" if rng.random() < 0.9 else "!"): (x, x.startswith("t")) for x in below}
        tree_of |= new
        layers.append(new)
    return tree_of, sorted(layers[-1])


def files(tree_of, tree, prefix=""):
    for name, (sha, is_tree) in tree_of.get(tree, {}).items():
        if is_tree:
            yield from files(tree_of, sha, f"{prefix}{name}/")
        else:
            yield prefix + name, sha


def brute(tree_of, old, new, prefix=""):
    """(path, change): equal entries are left, a file against a directory is one change."""
    a, b = tree_of.get(old, {}), tree_of.get(new, {})
    for name in sorted(a.keys() | b.keys()):
        x, y = a.get(name), b.get(name)
        if x == y:
            continue
        if (x is None or x[1]) and (y is None or y[1]):
            yield from brute(tree_of, x and x[0], y and y[0], f"{prefix}{name}/")
        else:
            yield prefix + name, "added" if x is None else "deleted" if y is None else "changed"


@pytest.mark.parametrize("repeated", [0.0, 2.0, 1e9])
def test_differences_equal_plain_python(spark, monkeypatch, repeated):
    monkeypatch.setattr(trees, "REPEATED", repeated)
    rng = random.Random(int(repeated) % 97)
    tree_of, roots = made(rng)
    entries = spark.createDataFrame([("r", t, n, s, d) for t, e in tree_of.items() for n, (s, d) in e.items()], ENTRIES)
    pairs = [(a, b) for a in [*roots, None] for b in [*roots, None]] + [(roots[0], roots[1])] * 3
    found = trees.diff(entries, spark.createDataFrame([("r", a, b) for a, b in pairs], "repo string, old string, new string"))
    got = sorted((r["old"] or "", r["new"] or "", r["path"], r["change"]) for r in found.collect())
    assert got == sorted((a or "", b or "", *c) for a, b in set(pairs) if a != b for c in brute(tree_of, a, b))
    moves = [(f"c{i}", *rng.choice(pairs)) for i in range(200)]
    counted = trees.churn(spark.createDataFrame([("r", c, b, a) for c, a, b in moves], "repo string, sha string, tree string, parent_tree string"), entries)
    expected = Counter(p for _, a, b in moves if a is not None and b is not None and a != b for p, _ in brute(tree_of, a, b))
    assert {r["path"]: r["changes"] for r in counted.collect()} == dict(expected)
    assert trees.diff(entries, spark.createDataFrame([], "repo string, old string, new string")).count() == 0


def test_a_level_compares_distinct_pairs(spark, tmp_path):
    """A deep directory that 500 roots share, changed in all of them by the same commit: one comparison a level."""
    deep = {f"d{k}{v}": {"next": (f"d{k + 1}{v}", True), f"own{k}": ("same", False)} for k in range(6) for v in "xy"} | {f"d6{v}": {"leaf": (v, False)} for v in "xy"}
    roots = {f"r{i}{v}": {"top": (f"d0{v}", True), "id": (str(i), False)} for i in range(500) for v in "xy"}
    entries = spark.createDataFrame([("r", t, n, s, d) for t, e in (deep | roots).items() for n, (s, d) in e.items()], ENTRIES)
    pairs = spark.createDataFrame([("r", f"r{i}x", f"r{i}y") for i in range(500)], "repo string, old string, new string")
    found = trees.diff(entries, pairs, f"file://{tmp_path}").collect()
    assert len(found) == 500 and {(r["path"], r["change"]) for r in found} == {("top/next/next/next/next/next/next/leaf", "changed")}
    steps = [spark.read.parquet(f"file://{tmp_path}/step-{k}").count() for k in range(1, 8)]
    assert steps == [1] * 7


@pytest.mark.parametrize("repeated", [2.0, 1e9])
def test_slices_equal_plain_python(spark, monkeypatch, tmp_path, repeated):
    """Joins made slice by slice, one column in place of old and new, entries as listings; work tables go."""
    monkeypatch.setattr(trees, "REPEATED", repeated)
    monkeypatch.setattr(trees, "SLICE_BYTES", 1)
    monkeypatch.setattr(trees, "MOST_SLICES", 3)
    tree_of, roots = made(random.Random(5))
    entries = spark.createDataFrame([("r", t, n, s, d) for t, e in tree_of.items() for n, (s, d) in e.items()], ENTRIES)
    pairs = [(a, b) for a in [*roots, None, "missing"] for b in [*roots, None]]
    frame = spark.createDataFrame([("r", a, b, i) for i, (a, b) in enumerate(pairs)], "repo string, old string, new string, n long")
    found = trees.diff(trees.listings(entries), frame, f"file://{tmp_path}", by="n")
    assert found.columns == ["repo", "n", "path", "change"]
    got = sorted((r["n"], r["path"], r["change"]) for r in found.collect())
    assert got == sorted((i, *c) for i, (a, b) in enumerate(pairs) if a != b for c in brute(tree_of, a, b))
    assert not {"lists", "start"} & {p.name for p in tmp_path.iterdir()} and not list(tmp_path.glob("*-half"))


def test_shuffle_files_go_with_their_steps(spark):
    """tree_diff leaves no shuffle files of its comparisons, which were all there at once, and none of the tables that only they read."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        names = {p for p in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in p}
        return {p: os.path.getsize(p) for p in names if os.path.exists(p)}

    before = shuffled()
    found = star.tree_diff(spark, "/root/testdata/sf0.001")
    for _ in range(50):
        left = sum(n for p, n in shuffled().items() if p not in before)
        if left < 100_000:
            break
        time.sleep(0.2)
    assert left < 100_000
    assert found.columns == ["child", "path", "change"] and not found.isEmpty()
    assert {os.path.basename(os.path.dirname(f)) for f in found.inputFiles()} == {"changes-1"}


def test_lists_of_the_tables_equal_their_entries(spark):
    flat = lambda d: sorted((r["repo"], r["tree"], sorted(map(tuple, r["list"]))) for r in d.collect())
    assert flat(star.tree_lists(spark, "/root/testdata/sf0.001")) == flat(trees.listings(star.tree_entries(spark, "/root/testdata/sf0.001")))


def test_entries_of_one_name(spark):
    """No sound tree has two entries of one name; the greater one counts."""
    entries = spark.createDataFrame([("r", "a", "n", s, False) for s in ("1", "2")] + [("r", "b", "n", "2", False), ("r", "b", "m", "3", False), ("r", "b", "m", "4", False)], ENTRIES)
    pairs = spark.createDataFrame([("r", "a", "b")], "repo string, old string, new string")
    assert {(r["path"], r["change"]) for r in trees.diff(entries, pairs).collect()} == {("m", "added"), ("n", "deleted")}


@pytest.mark.parametrize("seed", range(3))
def test_containing_tags_equal_brute_force(spark, monkeypatch, seed):
    rng = random.Random(seed)
    if seed:
        monkeypatch.setattr(graph, "BIT_BYTES", 1)  # 64 tags at a time
    commits, edges, tags = [], [], []
    for repo in ("a", "b", "c"):
        for i in range(150):
            commits.append((repo, f"{i:03d}", rng.randrange(50)))
            edges += [(repo, f"{i:03d}", k, f"{p:03d}") for k, p in enumerate(rng.sample(range(max(0, i - 6), i), min(i, rng.choice([1, 1, 2]))))]
        tags += [(repo, f"v{k}", f"{rng.randrange(160):03d}") for k in range(rng.choice([0, 70, 200]))]
    parents = {}
    for repo, child, _, parent in edges:
        parents.setdefault((repo, child), []).append((repo, parent))
    known = {(r, s): ts for r, s, ts in commits}

    def history(node):
        seen, left = {node}, [node]
        while left:
            for p in parents.get(left.pop(), ()):
                if p not in seen:
                    seen.add(p)
                    left.append(p)
        return seen

    targets = rng.sample(sorted(known, key=str), 80)
    expected = sorted((str(r), s, name, tag) for repo, name, tag in tags if (repo, tag) in known for r, s in history((repo, tag)) if (r, s) in set(targets))
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = graph.containing_tags(frame(commits, "repo string, sha string, author_ts long"), frame(edges, "repo string, child string, ordinal int, parent string"), frame(tags, "repo string, name string, sha string"), frame([*targets, ("a", "999")], "repo string, sha string"))
    rows = found.collect()
    assert sorted((str(r["repo"]), r["sha"], r["name"], r["tag_sha"]) for r in rows) == expected
    assert all(known[r["repo"], r["tag_sha"]] == r["author_ts"] and r["generation"] >= 1 for r in rows)
