"""The joins of contracted graphs against the kernels."""

import random

import pytest
from pyspark.sql import functions as F

from histlake.operators import contracted, graph
from histlake.plans import star

FOLDER = "/root/testdata/sf0.001"
C = star.C


def told(df):
    return sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns) and dict(a.dtypes) == dict(b.dtypes)
    rows = told(a)
    assert rows == told(b)
    return len(rows)


def test_star_tables_without_kernels(spark):
    d, e = star.dag_table(spark, FOLDER), star.edges(spark, FOLDER)
    targets, tags, heads = d.select(C, "sha"), star.tags(spark, FOLDER), star.heads(d)
    assert same(contracted.generations(targets, e, C), graph.generations(targets, e, C)) == d.count()
    assert same(contracted.landings(d, e, targets, heads, C), graph.landings(targets, e, targets, heads, C)) > 50
    assert same(contracted.earliest_tags(d, e, tags, targets, C), graph.earliest_tags(d.select(C, "sha", "author_ts"), e, tags, targets, C)) > 100


def made(rng, n, merges):
    edges = []
    for i in range(1, n):
        if rng.random() < 0.03:
            continue  # another root
        near = range(max(0, i - 8), i)
        parents = rng.sample(near, min(len(near), 1 if rng.random() > merges else rng.choice([2, 2, 3])))
        edges += [("r", f"{i:05d}", k, f"{p:05d}") for k, p in enumerate(parents)]
    return [("r", f"{i:05d}", rng.randrange(40)) for i in range(n)], edges


@pytest.mark.parametrize("n, merges", [(60, 0.4), (1, 0), (700, 0.0)])
def test_random_graphs(spark, n, merges):
    rng = random.Random(n)
    commits, edges = made(rng, n, merges)
    commits = spark.createDataFrame(commits, "repo string, sha string, author_ts long")
    edges = spark.createDataFrame([*edges, ("r", "00000", 0, "not there"), ("other", "00001", 0, "00000")], "repo string, child string, ordinal int, parent string")
    known = graph.known_edges(commits, edges)
    tags = spark.createDataFrame([("r", f"v{k}", f"{rng.randrange(n + 2):05d}") for k in range(n // 12 + 1)], "repo string, name string, sha string")
    d = commits.join(graph.shape(commits, known), ["repo", "sha"])
    heads = spark.createDataFrame([("r", f"{n - 1:05d}"), ("r", "not there")], "repo string, sha string").limit(1 if n % 2 else 2).where(F.col("sha") != "not there")
    same(contracted.generations(commits, edges), graph.generations(commits, known))
    same(contracted.landings(d, edges, commits, heads), graph.landings(commits, known, commits, heads))
    same(contracted.earliest_tags(d, edges, tags, commits), graph.earliest_tags(commits, known, tags, commits))


def test_cycles_end(spark, monkeypatch):
    monkeypatch.setattr(contracted, "MOST_DOUBLINGS", 5)
    commits = spark.createDataFrame([("r", x) for x in "abcde"], "repo string, sha string")
    edges = spark.createDataFrame([("r", "a", 0, "b"), ("r", "b", 0, "a"), ("r", "c", 0, "d"), ("r", "e", 0, "a"), ("r", "e", 1, "c")], "repo string, child string, ordinal int, parent string")
    found = {r["sha"]: r["generation"] for r in contracted.generations(commits, edges).collect()}
    assert found == {"a": 0, "b": 0, "c": 2, "d": 1, "e": 0}


def test_paths_longer_than_a_block(spark, monkeypatch):
    """Values come down a path over blocks of it, with and without values of their own, branches and merges beside it."""
    monkeypatch.setattr(contracted, "BLOCK", 4)
    test_random_graphs(spark, 300, 0.03)


def test_rounds_do_not_shuffle_links(spark):
    commits, edges = made(random.Random(8), 80, 0.5)
    commits = spark.createDataFrame(commits, "repo string, sha string, author_ts long")
    of = contracted.Contracted(commits, spark.createDataFrame(edges, "repo string, child string, ordinal int, parent string"))
    links = of._dealt(of.links.withColumnRenamed("from", "sha"), "sha")
    assert links.count() > 0
    plan = links.hint("merge").join(of.anchors.hint("merge"), ["repo", "sha"])._jdf.queryExecution().executedPlan().toString()
    links.unpersist()
    above = plan.split("InMemoryTableScan")[0]
    assert "SortMergeJoin" in plan and "Exchange" not in above
