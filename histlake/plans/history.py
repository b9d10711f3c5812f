"""The eleven questions to real repositories.  Each returns a DataFrame."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histlake.functions import objects as fn
from histlake.operators import contracted, duplicates, graph, trees
from histlake.operators import scan as scans
from histlake.plans.catalog import RepoCatalog
from histlake.plans.shared import shared_folder, written


class NotFound(LookupError):
    """There is no answer."""


def _id(sha: str) -> str:
    if not re.fullmatch(r"[0-9a-fA-F]{40}", sha):
        raise ValueError(f"invalid sha: {sha}")
    return sha.lower()


def _one(repo: RepoCatalog, sha: str | None) -> DataFrame:
    return repo.spark.createDataFrame([(repo.location, sha)], "repo string, sha string")


def _with_summary(repo: RepoCatalog, found: DataFrame, column: str) -> DataFrame:
    """A summary of the commits in a column; of the packs only their delta chains are read."""
    found = written(found, f"{shared_folder(repo.spark)}/found")
    bodies = commit_bodies(repo, found.select(F.col(column).alias("sha")))
    return found.join(bodies.select("repo", F.col("sha").alias(column), fn.commit_summary(F.col("body")).alias("summary")), ["repo", column], "left")


def commit_bodies(repo: RepoCatalog, ids: DataFrame) -> DataFrame:
    """repo, sha, body of the commits of a table of ids (sha)."""
    return repo.by_ids(ids, "commit").select("repo", "sha", fn.text(F.col("content")).alias("body"))


def scan(repo: RepoCatalog, kind: str, pattern: str, exact: bool = False, order: str | int | None = None, summary: bool = False) -> DataFrame:
    """Matching objects; a number of them in storage order is looked for in growing rounds over the partitions, until they are found."""
    if order in ("oldest", "newest") or isinstance(order, int) and order < 0:
        return scans.scan(repo.of_kinds(*scans.kinds(kind)), kind, pattern, exact, order, summary)
    n = scans.DEFAULT_LIMIT if order is None else order
    return first_matches(repo, kind, pattern, n, exact, summary)[0]


def first_matches(repo: RepoCatalog, kind: str, pattern: str, n: int, exact: bool = False, summary: bool = False, **options: str) -> tuple[DataFrame, int]:
    """The first n matches in storage order, and how many partitions were read for them; options are the data source's."""
    options["kinds"] = ",".join(scans.kinds(kind))
    load = lambda a, b: repo._load(parts=f"{a}:{b}", **options)
    return scans.stopping_scan(repo.parts(**options), load, kind, pattern, n, shared_folder(repo.spark), exact, summary, more=repo._late[0])


def find(repo: RepoCatalog, sha: str, n: int = 1, summary: bool = False) -> DataFrame:
    """The n oldest commits whose tree holds an object."""
    held = trees.holders(repo.tree_entries, _one(repo, _id(sha)))
    found = trees.containing_commits(repo.commits, held, n).select("repo", "sha", "author_ts")
    return (_with_summary(repo, found, "sha") if summary else found).orderBy("author_ts", "sha")


def dag_stats(repo: RepoCatalog) -> DataFrame:
    packs = repo._read(content="false", kinds="commit").agg(F.count_distinct("pack_id").alias("packs"))
    loose = repo.dag.agg(F.count_if(F.col("storage") == "loose").alias("loose"))
    return graph.stats(repo.dag).join(packs).join(loose)


def dag_commit(repo: RepoCatalog, sha: str) -> DataFrame:
    """generation, parents, children, ancestors, descendants, author_ts of a commit."""
    one = _one(repo, _id(sha))  # one seed: two walks, no counts of all commits
    up = graph.ancestors(repo.dag, repo.edges, one).agg(F.count("*").alias("ancestors"))
    down = graph.descendants(repo.dag, repo.edges, one).agg(F.count("*").alias("descendants"))
    row = repo.dag.where(F.col("sha") == _id(sha)).select("sha", "generation", F.col("n_parents").alias("parents"), F.col("n_children").alias("children"), "author_ts")
    return row.join(up).join(down)


def landed(repo: RepoCatalog, sha: str, head: str | None = None, summary: bool = False) -> DataFrame:
    """The merge that first brought a commit into the head's history; a head that is no id means HEAD."""
    top = head.lower() if head and re.fullmatch(r"[0-9a-fA-F]{40}", head) else repo.head
    search = contracted.landings if repo.large else graph.landings
    found = search(repo.dag, repo.edges, _one(repo, _id(sha)), _one(repo, top))
    return _with_summary(repo, found, "merge") if summary else found


def contains(repo: RepoCatalog, sha: str, all_tags: bool = False, summary: bool = False) -> DataFrame:
    """The earliest tag whose history holds a commit, or all of them in order."""
    search = graph.containing_tags if all_tags else contracted.earliest_tags if repo.large else graph.earliest_tags
    found = search(repo.dag, repo.edges, repo.tags, _one(repo, _id(sha))).select("repo", "name", F.col("tag_sha").alias("sha"), "generation", "author_ts")
    found = found.orderBy("generation", "author_ts", "name")
    return _with_summary(repo, found, "sha").orderBy("generation", "author_ts", "name") if summary else found


def unresolved_tags(repo: RepoCatalog) -> DataFrame:
    return repo.tags.join(repo.dag.select("repo", "sha"), ["repo", "sha"], "left_anti")


def _united(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, tables)


def comp(base: RepoCatalog, targets: list[RepoCatalog]) -> DataFrame:
    """target, head, ancestors, common, ahead, behind, lca, lca_generation: one row for each target, in their order.

    All repositories are one graph of commits by id, and one pass over it tells
    which heads reach a commit: 62 targets and the base in each block.
    """
    width = graph.HEADS - 1
    places = [(k // width, k % width + 1) for k in range(len(targets))]
    members = [(block, 0, base) for block in range(places[-1][0] + 1)] + [(*place, t) for place, t in zip(places, targets, strict=True)]
    marked = lambda df, block, bit: df.select(F.lit(block).alias("block"), "*", F.lit(1 << bit).cast("long").alias("bits"))
    commits = _united([marked(r.nodes.select("sha"), block, bit) for block, bit, r in members]).groupBy("block", "sha").agg(F.bit_or("bits").alias("bits"))
    edges = _united([marked(r.edges.select("child", "parent"), block, bit) for block, bit, r in members]).groupBy("block", "child", "parent").agg(F.bit_or("bits").alias("bits"))
    heads = base.spark.createDataFrame([(block, r.head, 1 << bit) for block, bit, r in members if r.head], "block int, sha string, bits long")
    reached = written(graph.heads_reached(commits, edges, heads, "block"), f"{shared_folder(base.spark)}/reached")
    generations = _united([base.dag.select(F.lit(block).alias("block"), "sha", "generation") for block in range(places[-1][0] + 1)])
    found = graph.compare_heads(reached, generations, "block")
    asked = base.spark.createDataFrame([(k, *place, t.location, t.head) for k, (place, t) in enumerate(zip(places, targets, strict=True))], "k int, block int, bit int, target string, head string")
    own = reached.where((F.col("block") == 0) & (F.getbit("bits", F.lit(0)) == 1)).agg(F.count("*").alias("own"))
    number = lambda name, other=F.lit(0): F.coalesce(name, other).alias(name)
    rows = asked.join(found, ["block", "bit"], "left").join(own).orderBy("k")
    return rows.select("target", "head", number("ancestors"), number("common"), number("ahead"), number("behind", F.col("own")), "lca", "lca_generation")


def comp_has(sha: str, repos: list[RepoCatalog]) -> DataFrame:
    """repo, state (no, in pack, in HEAD), generation: a row for each repository, in their order, of one plan for all."""
    each = list({r.location: r for r in repos}.values())
    dag = _united([r.dag.select("repo", "sha", "generation") for r in each])
    edges = _united([r.edges.select("repo", "child", "ordinal", "parent") for r in each])
    found = graph.presence(dag, edges, _united([r.repos for r in each]), F.lit(_id(sha)))
    asked = repos[0].spark.createDataFrame([(k, r.location) for k, r in enumerate(repos)], "k int, repo string")
    return asked.join(found, "repo").orderBy("k").select("repo", "state", "generation")


def refs(repo: RepoCatalog, pattern: str = "", exact: bool = False, n: int = 50) -> DataFrame:
    return scans.filter_refs(repo.refs, pattern, exact, n)


def churn(base: RepoCatalog, fork: RepoCatalog, n: int = 20) -> tuple[DataFrame, DataFrame]:
    """(path, changes) of the n paths changed most by the fork's own commits, and those commits (sha)."""
    own = graph.ancestors(fork.dag, fork.edges, _one(fork, fork.head)).select("repo", "sha").join(graph.ancestors(base.dag, base.edges, _one(base, base.head)).select("sha"), "sha", "left_anti")
    tree = fork.dag.select("repo", "sha", "tree")
    parent = graph.first_parents(fork.edges).select("repo", F.col("child").alias("sha"), "parent")
    moved = own.join(tree, ["repo", "sha"]).join(parent, ["repo", "sha"], "left").join(tree.select("repo", F.col("sha").alias("parent"), F.col("tree").alias("parent_tree")), ["repo", "parent"], "left")
    return trees.churn(moved, fork.tree_entries).orderBy(F.desc("changes"), "path").limit(n), own.select("sha")


def duper(repo: RepoCatalog, n: int = 15, min_lines: int = duplicates.MIN_LINES, excludes: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Groups of repeated blocks in HEAD's files, worst first, with a raw snippet; and the counts."""
    min_lines = max(2, min_lines)
    root = repo.dag.where(F.col("sha") == repo.head).select("repo", F.col("tree").alias("root"))
    files = trees.walk(repo.tree_entries, root, excludes, only_code=True)
    blobs = repo.of_kinds("blob").select("repo", "sha", "content")
    texts = files.join(blobs, ["repo", "sha"]).select("path", fn.is_binary(F.col("content")).alias("binary"), fn.text(F.col("content")).alias("text"))
    cut = duplicates.windows(texts.where("NOT binary").select("path", "text"), min_lines)
    best = duplicates.top(duplicates.groups(cut, min_lines), n)
    raw = texts.select(F.col("path").alias("first_path"), F.split("text", "\n", -1).alias("lines"))
    shown = best.join(raw, "first_path").withColumn("snippet", F.slice("lines", F.col("first_line").cast("int"), min_lines)).drop("lines")
    return shown.orderBy(F.desc("wasted"), "first_path", "first_line"), duplicates.stats(texts, cut)


def open_repo(spark: SparkSession, location: str, kinds: set[str] | None = None) -> RepoCatalog:
    return RepoCatalog(spark, location, kinds)
