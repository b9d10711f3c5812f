"""Regex scans over objects and searches for the commits that contain an object."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histlake.functions import objects, regexes
from histlake.plans.shared import written
from histlake.schema import KIND_NAMES

DEFAULT_LIMIT = 10


def stored() -> list[Column]:
    """Storage order: packs by id, their objects by offset, then loose objects by id."""
    return [F.asc_nulls_last("pack_id"), F.asc("offset"), F.asc("sha")]


def kinds(name: str) -> list[str]:
    """The kinds that a word stands for: a kind, its plural, or all."""
    word = name[:-1] if name.endswith("s") else name
    if name == "all":
        return list(KIND_NAMES)
    if word not in KIND_NAMES:
        raise ValueError(f"unknown type '{name}' (use {', '.join(KIND_NAMES)} or all)")
    return [word]


def deduped(objs: DataFrame, many: bool = False) -> DataFrame:
    """One row for each object; a packed copy goes before a loose one.

    many: there may be many copies of an object, which each task then brings
    together before they are shuffled; stored objects have few, and are sorted
    once.  Bodies that are not asked for are not shuffled.
    """
    order = F.struct((F.col("storage") != "pack").alias("loose"), "pack_id", "offset")
    rest = [c for c in objs.columns if c not in ("repo", "sha", "content")]
    body = [F.min_by("content", order).alias("content")] if "content" in objs.columns else []
    dealt = objs if many else objs.repartition("repo", "sha")
    first = dealt.groupBy("repo", "sha").agg(F.min_by(F.struct(*rest), order).alias("o"), *body)
    return first.select("repo", "sha", "o.*", *(["content"] if body else [])).select(*objs.columns)


def scan(objs: DataFrame, kind: str, pattern: str, exact: bool = False, order: str | int | None = None, summary: bool = False, limit: int | None = None) -> DataFrame:
    """Objects of a kind whose bytes match: repo, sha, kind, author_ts (and summary).

    order: "oldest" or "newest" by author time, or a number of rows in storage
    order (``stopping_scan`` reads no more than it must for those).  Rows are cut before summaries are made; a negative limit keeps all,
    in no order.
    """
    n = limit if limit is not None else order if isinstance(order, int) else DEFAULT_LIMIT
    found, wanted = _matching(objs, kind, pattern, exact)
    if n < 0:
        pass
    elif order == "oldest":
        found = found.orderBy("author_ts", "sha")
    elif order == "newest":
        found = found.orderBy(F.desc("author_ts"), "sha")
    else:
        found = found.orderBy(*stored())
    found = found if n < 0 else found.limit(n)
    columns = ["repo", "sha", "kind", "author_ts"]
    if summary:
        return found.select(*columns, objects.summary(F.col("kind"), F.col("content"), wanted).alias("summary"))
    return found.select(*columns)


def _matching(objs: DataFrame, kind: str, pattern: str, exact: bool) -> tuple[DataFrame, str]:
    """The objects that match, with author_ts, and the pattern as it is searched for."""
    wanted = regexes.compile(objs.sparkSession, pattern, exact)
    found = objs.where(F.col("kind").isin(kinds(kind))).where(objects.searchable(F.col("kind"), F.col("content")).rlike(wanted))
    ts = F.when(F.col("kind") == "commit", objects.author_ts(objects.text(F.col("content")))).otherwise(F.lit(0).cast("long"))
    return found.withColumn("author_ts", ts), wanted


def stopping_scan(parts: list[tuple[str, int] | None], load: Callable[[int, int], DataFrame], kind: str, pattern: str, n: int, folder: str, exact: bool = False, summary: bool = False, more: DataFrame | None = None, first: int = 1, growth: int = 4) -> tuple[DataFrame, int]:
    """The first n objects that match, in storage order, and how many parts were read for them.

    parts: the (pack_id, first offset) of each part in storage order, None for
    loose files; load(a, b): the objects of parts a to b - 1; more: objects of
    any place that no part holds.  Parts are read in rounds, each ``growth``
    times as many as before.  A match is final once no part that is left begins
    before it; a round ends the search when n are.  Of each round at most n rows
    are kept, in the folder.
    """
    columns = ["repo", "sha", "kind", "author_ts", *(["summary"] if summary else []), "pack_id", "offset"]
    place = F.struct(F.col("pack_id").isNull().alias("loose"), "pack_id", "offset")

    def earliest(found: DataFrame) -> DataFrame:
        """Each object at its first place; the first n of them."""
        rest = [c for c in columns if c not in ("repo", "sha")]
        once = found.groupBy("repo", "sha").agg(F.min_by(F.struct(*rest), place).alias("o")).select("repo", "sha", "o.*").select(*columns)
        return once.orderBy(*stored()).limit(n)

    def matches(objs: DataFrame, name: str) -> DataFrame:
        found, wanted = _matching(objs, kind, pattern, exact)
        if summary:
            found = found.withColumn("summary", objects.summary(F.col("kind"), F.col("content"), wanted))
        return written(earliest(found.select(*columns)), f"{folder}/{name}")

    done, read = [matches(more, "more")] if more is not None else [], 0
    size = first
    while read < len(parts):
        ahead = min(read + size, len(parts))
        done.append(matches(load(read, ahead), f"round-{read}"))
        read, size = ahead, size * growth
        if read < len(parts):
            bound = parts[read]
            final = F.col("pack_id").isNotNull()
            if bound is not None:
                final &= (F.col("pack_id") < bound[0]) | (F.col("pack_id") == bound[0]) & (F.col("offset") < bound[1])
            if earliest(reduce(DataFrame.union, done)).where(final).count() >= n:
                break
    if not done:
        return matches(load(0, 0), "none").drop("pack_id", "offset"), 0
    return earliest(reduce(DataFrame.union, done)).orderBy(*stored()).drop("pack_id", "offset"), read


def filter_refs(refs: DataFrame, pattern: str = "", exact: bool = False, n: int | None = 50) -> DataFrame:
    """repo, sha, names: names of references by what they point at, smallest name first; HEAD is none."""
    found = refs.where(F.col("name") != "HEAD")
    if pattern:
        found = found.where(F.col("name").rlike(regexes.compile(refs.sparkSession, pattern, exact)))
    grouped = found.groupBy("repo", "sha").agg(F.array_sort(F.collect_list("name")).alias("all"))
    ordered = grouped.select("repo", "sha", F.array_join("all", ", ").alias("names"), F.col("all")[0].alias("first_name")).orderBy("first_name", "repo", "sha")
    return (ordered if n is None else ordered.limit(n)).select("repo", "sha", "names")


def tags(refs: DataFrame) -> DataFrame:
    """repo, name, sha: tags by what they point at in the end."""
    prefix = "refs/tags/"
    own = refs.where(F.col("name").startswith(prefix))
    name = F.regexp_replace(F.substring(F.col("name"), len(prefix) + 1, 1 << 20), r"\^\{\}$", "")
    peeled = F.coalesce("peeled", F.when(F.col("name").endswith("^{}"), F.col("sha")))
    return own.groupBy("repo", name.alias("name")).agg(F.max(peeled).alias("p"), F.max(F.when(~F.col("name").endswith("^{}"), F.col("sha"))).alias("s")).select("repo", "name", F.coalesce("p", "s").alias("sha"))
