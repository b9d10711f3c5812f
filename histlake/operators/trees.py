"""Trees: what contains an object, the files of a tree, differences of trees.

All of it is set at a time: a level of all trees is one join, and the number
of levels is the depth of the directories, not the length of the history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histlake.functions import regexes
from histlake.plans.shared import delete, settled, shared_folder, written

MAX_DEPTH = 200

# The files that a search for duplicates reads.
SKIPPED_STEMS = ("LICENSE", "LICENCE", "CHANGELOG", "NOTICE", "AUTHORS", "COPYING")
CODE_EXTENSIONS = (
    ".py .js .ts .jsx .tsx .java .c .cpp .h .hpp .cc .cxx .go .rs .rb .php .cs .sh .bash .zsh .fish .lua .pl .swift .kt .scala .md .rst .txt .html .xml .css .scss .sass .yaml .yml .toml .json".split()
)


def holders(entries: DataFrame, targets: DataFrame, folder: str | None = None) -> DataFrame:
    """repo, target, tree: the trees that hold each target (repo, sha), at any depth."""
    spark = entries.sparkSession
    folder = folder or shared_folder(spark)
    e = entries.select("repo", "tree", "sha", "is_tree")
    now = e.join(targets.select("repo", F.col("sha")), ["repo", "sha"]).select("repo", F.col("sha").alias("target"), "tree").distinct()
    found = now = written(now, f"{folder}/holders-0")
    up = e.where("is_tree").select("repo", F.col("tree").alias("outer"), F.col("sha").alias("tree"))
    for level in range(1, MAX_DEPTH):
        new = now.join(up, ["repo", "tree"]).select("repo", "target", F.col("outer").alias("tree")).distinct()
        now = written(new, f"{folder}/holders-{level}")
        if now.isEmpty():  # a tree may hold a target at several depths
            return found.distinct() if level > 1 else found
        found = found.union(now)
    raise RuntimeError(f"trees deeper than {MAX_DEPTH}")


def containing_commits(commits: DataFrame, held: DataFrame, n: int | None = 1) -> DataFrame:
    """repo, target, sha, author_ts: the n oldest commits whose tree holds each target."""
    from pyspark.sql import Window as W

    found = held.join(commits.select("repo", "tree", "sha", "author_ts"), ["repo", "tree"]).select("repo", "target", "sha", "author_ts")
    if n is None:
        return found
    place = F.row_number().over(W.partitionBy("repo", "target").orderBy("author_ts", "sha"))
    return found.withColumn("place", place).where(F.col("place") <= n).drop("place")


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether any of the compiled patterns matches a path."""
    return F.lit(False) if not patterns else F.greatest(*(path.rlike(p) for p in patterns), F.lit(False))


def code_file(name: Column) -> Column:
    """Whether duplicates are looked for in a file: code and text by extension, or no extension at all."""
    stem = F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    known = F.lit(False)
    for extension in CODE_EXTENSIONS:
        known = known | name.endswith(extension)
    return ~stem.isin(*SKIPPED_STEMS) & F.when(name.contains("."), known).otherwise(True)


def walk(entries: DataFrame, roots: DataFrame, excludes: list[str] | None = None, only_code: bool = False, folder: str | None = None) -> DataFrame:
    """repo, root, path, sha: the files below each root (repo, root), directory by directory.

    A directory whose path an exclude matches is not entered.
    """
    spark = entries.sparkSession
    folder = folder or shared_folder(spark)
    patterns = [regexes.compile(spark, p) for p in excludes or []]
    e = entries.select("repo", "tree", "name", "sha", "is_tree")
    open_ = roots.select("repo", "root", F.lit("").alias("prefix"), F.col("root").alias("tree"))
    files = None
    for level in range(MAX_DEPTH):
        below = open_.join(e, ["repo", "tree"]).select("repo", "root", F.concat("prefix", "name").alias("path"), "name", "sha", "is_tree").where(~excluded(F.col("path"), patterns))
        below = written(below, f"{folder}/walk-{level}")
        here = below.where("NOT is_tree")
        here = (here.where(code_file(F.col("name"))) if only_code else here).select("repo", "root", "path", "sha")
        files = here if files is None else files.union(here)
        open_ = below.where("is_tree").select("repo", "root", F.concat("path", F.lit("/")).alias("prefix"), F.col("sha").alias("tree"))
        if open_.isEmpty():
            return files
    raise RuntimeError(f"trees deeper than {MAX_DEPTH}")


def listings(entries: DataFrame) -> DataFrame:
    """repo, tree, list: the entries of each tree in one row.  Listings stay as they are, for those who have them grouped already."""
    if "list" in entries.columns:
        return entries
    return entries.groupBy("repo", "tree").agg(F.collect_list(F.struct("name", "sha", "is_tree")).alias("list"))


#: Stands for a directory that is absent on one side of a pair.
ABSENT = ""


def _by_name(entries: Column) -> Column:
    """Entries as a map by name; of entries of one name, which no sound tree has, the greatest counts."""
    named = F.transform(entries, lambda e: F.struct(e["name"].alias("key"), F.struct(e["sha"].alias("sha"), e["is_tree"].alias("is_tree")).alias("value")))
    names = F.transform(entries, lambda e: e["name"])
    last = F.filter(named, lambda e: ~F.exists(named, lambda o: (o["key"] == e["key"]) & (o["value"] > e["value"])))
    return F.map_from_entries(F.when(F.size(F.array_distinct(names)) == F.size(names), named).otherwise(F.array_distinct(last)))


#: Bytes of pairs and lists, as files, that a comparison shuffles at once, and slices that it makes of more at most: each reads the files again.
SLICE_BYTES, MOST_SLICES = 512 << 20, 8


def _slices(*tables: DataFrame) -> int:
    """In how many slices tables are joined, by what is known of their files."""
    known = sum(int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for t in tables)
    return max(1, min(-(-known // SLICE_BYTES), MOST_SLICES))


def _slice(table: DataFrame, tree: str, k: int, n: int) -> DataFrame:
    """The k-th of n slices by tree, in which all rows of a tree are together."""
    return table if n == 1 else table.where(F.pmod(F.xxhash64("repo", tree), F.lit(n)) == k)


def _compared(pairs: DataFrame, lists: DataFrame, path: str, *columns: str | Column) -> DataFrame:
    """The columns asked for, as a table at path, of pairs (repo, a, b, and more) with name, x, y, change: what differs in each, a row an entry.

    Where change is null, x and y are a pair of directories below the name.
    The two lists of a pair meet in one row, and what both hold is taken off
    there; where a side is ABSENT, the other's list is all there is.  Joins are
    made slice by slice, and of the shuffle files only a slice's are there at a
    time; lists beyond the smallest and greatest tree asked for are not shuffled.
    """
    kept = [c for c in pairs.columns if c not in ("a", "b")]
    none, a, b = F.lit(ABSENT), F.col("a"), F.col("b")
    ends = [f(F.when(c != ABSENT, c)) for c in (a, b) for f in (F.min, F.max)]
    n_both, n_one, *ends = pairs.agg(F.count_if((a != ABSENT) & (b != ABSENT)), F.count_if((a != ABSENT) != (b != ABSENT)), *ends).first()
    ends = [x for x in ends if x is not None] or [ABSENT]
    lists = lists.where(F.col("tree").between(min(ends), max(ends)) & (F.col("tree") != ABSENT))
    n = _slices(pairs, lists)

    met = pairs.where((a != ABSENT) & (b != ABSENT))
    of = {side: lists.select("repo", F.col("tree").alias(side), F.col("list").alias(f"list_{side}")) for side in "ab"}
    if n_both and n > 1:  # in one slice both joins are one job
        for k in range(n):
            half = settled(_slice(met, "a", k, n).join(_slice(of["a"], "a", k, n), ["repo", "a"], "left"), f"{path}-half", "append" if k else "overwrite")
        met = half
    else:
        met = met.join(of["a"], ["repo", "a"], "left")
    empty = F.array().cast(lists.schema["list"].dataType)
    own = lambda x, other: _by_name(F.array_except(F.coalesce(F.col(x), empty), F.coalesce(F.col(other), empty)))
    zipped = F.map_zip_with(own("list_a", "list_b"), own("list_b", "list_a"), lambda k, x, y: F.struct(x.alias("x"), y.alias("y")))

    def both(k: int) -> DataFrame:
        each = _slice(met, "b", k, n).join(_slice(of["b"], "b", k, n), ["repo", "b"], "left").select(*kept, "a", "b", F.explode(zipped).alias("name", "e"))
        x, y = F.col("e.x"), F.col("e.y")
        deeper = F.coalesce(x["is_tree"], y["is_tree"]) & F.coalesce(y["is_tree"], x["is_tree"])
        change = F.when(deeper, None).when(x.isNull(), "added").when(y.isNull(), "deleted").otherwise("changed")
        return each.select(*kept, "a", "b", "name", F.coalesce(x["sha"], none).alias("x"), F.coalesce(y["sha"], none).alias("y"), change.alias("change"))

    def one(k: int) -> DataFrame:
        gone, sha, tree = F.col("gone"), F.col("sha"), F.col("side")
        there = pairs.where((a != ABSENT) != (b != ABSENT)).select(*kept, F.when(b == ABSENT, a).otherwise(b).alias("side"), (b == ABSENT).alias("gone"))
        # the same plan as in both(), so that one shuffle of the lists does: columns named anew, and no filter that an inner generator infers
        listed = lists.select("repo", F.col("tree").alias("side"), F.col("list").alias("listed"))
        each = _slice(there, "side", k, n).join(_slice(listed, "side", k, n), ["repo", "side"])
        each = each.select(*kept, "side", "gone", F.inline_outer("listed").alias("name", "sha", "is_tree")).where("is_tree IS NOT NULL")
        side = lambda c: (F.when(gone, c).otherwise(none), F.when(gone, none).otherwise(c))
        (old, new), (x, y) = side(tree), side(sha)
        change = F.when(~F.col("is_tree"), F.when(gone, "deleted").otherwise("added"))
        return each.select(*kept, old.alias("a"), new.alias("b"), "name", x.alias("x"), y.alias("y"), change.alias("change"))

    for k in range(n):
        # in one job, so that a slice of the lists is shuffled once for both
        each = both(k) if not n_one else one(k) if not n_both else both(k).union(one(k))
        out = settled(each.select(*columns), path, "append" if k else "overwrite")
    if n_both and n > 1:
        delete(pairs.sparkSession, f"{path}-half")
    return out


def differences(lists: DataFrame, pairs: DataFrame, folder: str) -> DataFrame:
    """repo, a, b, name, x, y, change: the graph of the distinct pairs that pairs (repo, a, b) lead to, each compared once, wherever it stands."""
    todo = seen = settled(pairs.select("repo", "a", "b").distinct(), f"{folder}/pairs-0")
    out = None
    for level in range(1, MAX_DEPTH):
        step = _compared(todo, lists, f"{folder}/step-{level}", "repo", "a", "b", "name", "x", "y", "change")
        out = step if out is None else out.union(step)
        below = step.where("change IS NULL").select("repo", F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        todo = settled(below.join(seen, ["repo", "a", "b"], "left_anti"), f"{folder}/pairs-{level}")
        if todo.isEmpty():
            return out
        seen = seen.union(todo)
    raise RuntimeError(f"trees deeper than {MAX_DEPTH}")


#: Rows for each distinct pair from which on a level's pairs are compared once and their differences carried.
REPEATED = 2.0


def _changes(entries: DataFrame, start: DataFrame, folder: str, times: str | None = None) -> DataFrame:
    """Changed files (path, change) below the rows of start (repo, a, b, and more columns, which are kept).

    Rows go down level by level while most of their pairs are distinct.  Where
    a level has REPEATED rows a pair or more, the pairs from there on are made
    a graph, and paths are carried down that: so the comparisons of a level are
    at most so many times its distinct pairs, however often trees repeat.  With
    ``times``, rows of one pair at one path are one then, with the sum of that column.
    """
    keys = ["repo", "a", "b"]
    spark = start.sparkSession
    lists = settled(listings(entries), f"{folder}/lists")
    rest = [c for c in start.columns if c not in keys]
    path = F.concat("prefix", "name").alias("path")
    now = settled(start.select(*keys, *rest, F.lit("").alias("prefix")), f"{folder}/start")
    read = f"{folder}/start"  # the table that now is of
    out = steps = None
    for level in range(MAX_DEPTH):
        if steps is None:
            rows, distinct = now.agg(F.count("*"), F.approx_count_distinct(F.struct(*keys))).first()
            if not rows:
                break
            if rows >= REPEATED * distinct:
                steps = differences(lists, now, folder)
                delete(spark, f"{folder}/lists")
        elif now.isEmpty():
            break
        if steps is not None and times:
            now = now.groupBy(*keys, "prefix").agg(F.sum(times).alias(times)).select(*keys, times, "prefix")
        table = f"{folder}/changes-{level}"
        if steps is None:
            met = _compared(now, lists, table, "repo", "x", "y", *rest, path, "change")
        else:
            met = settled(now.join(steps, keys).select("repo", "x", "y", *rest, path, "change"), table)
        if read:
            delete(spark, read)
        read = table
        here = met.where("change IS NOT NULL").select("repo", *rest, "path", "change")
        if not here.isEmpty():  # else the table goes when its directories have been compared
            out, read = here if out is None else out.union(here), None
        now = met.where("change IS NULL").select("repo", F.col("x").alias("a"), F.col("y").alias("b"), *rest, F.concat("path", F.lit("/")).alias("prefix"))
    else:
        raise RuntimeError(f"trees deeper than {MAX_DEPTH}")
    if out is None:
        return spark.createDataFrame([], now.select("repo", *rest, F.col("prefix").alias("path"), F.lit("").alias("change")).schema)
    delete(spark, f"{folder}/lists")
    return out


def _pairs(pairs: DataFrame) -> DataFrame:
    side = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(ABSENT))
    return pairs.select("repo", side("old").alias("a"), side("new").alias("b"), *(c for c in pairs.columns if c != "repo")).where("a <> b")


def diff(entries: DataFrame, pairs: DataFrame, folder: str | None = None, by: str | None = None) -> DataFrame:
    """repo, old, new, path, change: the files that differ between trees (repo, old, new).

    Only unequal entries go down a level; a side that is absent gives all its
    files.  change: added, deleted or changed; a file that became a directory
    is changed, and the directory's files are not counted.  With ``by``, each
    row of pairs is compared, and that column stands for old and new: what a
    row carries from level to level is most of what is shuffled.
    """
    folder = folder or shared_folder(entries.sparkSession)
    names = [by] if by else ["old", "new"]
    start = _pairs(pairs if by else pairs.select("repo", "old", "new").distinct()).select("repo", "a", "b", *names)
    return _changes(entries, start, folder).select("repo", *names, "path", "change")


def churn(commits: DataFrame, entries: DataFrame, folder: str | None = None) -> DataFrame:
    """path, changes: how often each path differs between one of commits (repo, sha, tree, parent_tree) and its first parent.

    Equal pairs of trees are compared once and counted as often as they occur,
    on every level.
    """
    folder = folder or shared_folder(entries.sparkSession)
    moves = commits.where("parent_tree IS NOT NULL AND parent_tree <> tree").groupBy("repo", F.col("parent_tree").alias("old"), F.col("tree").alias("new")).agg(F.count("*").alias("times"))
    start = _pairs(moves).select("repo", "a", "b", "times")
    return _changes(entries, start, folder, "times").groupBy("path").agg(F.sum("times").alias("changes"))
