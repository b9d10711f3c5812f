"""A repository as tables: objects, commits, edges, trees, refs, with a Parquet cache of the graph."""

from __future__ import annotations

import hashlib
import os
import tempfile
import warnings
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histlake import schema
from histlake.functions import objects as fn
from histlake.operators import contracted, graph, scan
from histlake.plans.shared import mounted, shared_folder, written
from histlake.sources import deltas, packfmt, smart_http
from histlake.sources import refs as refs_source
from histlake.sources.objects import GitObjects, GitObjectsReader, GitOpenDeltas, loose_files, mapped, pack_files, read_ids


def commits_of(objs: DataFrame) -> DataFrame:
    """repo, sha, tree, author_name, author_ts, parents, subject, storage of the commits among objects."""
    own = ["repo", "storage", "pack_id", "offset", "sha"]
    read = objs.where("kind = 'commit'").select(*own, fn.text(F.col("content")).alias("body"))
    read = read.select(*own, fn.header(F.col("body")).alias("head"), fn.author_line(F.col("body")).alias("line"), fn.subject(F.col("body")).alias("subject"))
    head, line = F.col("head"), F.col("line")
    read = read.select(*own, fn.header_tree(head).alias("tree"), fn.line_name(line).alias("author_name"), fn.line_ts(line).alias("author_ts"), fn.header_parents(head).alias("parents"), "subject")
    return scan.deduped(read).select("repo", "sha", "tree", "author_name", "author_ts", "parents", "subject", "storage")  # bodies are not shuffled


def edges_of(commits: DataFrame) -> DataFrame:
    """repo, child, ordinal, parent, for the parents that are there."""
    all_ = commits.select("repo", F.col("sha").alias("child"), F.posexplode("parents").alias("ordinal", "parent"))
    return graph.known_edges(commits, all_).select("repo", "child", "ordinal", "parent")


def tree_entries_of(objs: DataFrame) -> DataFrame:
    """repo, tree, pos, mode, name, sha, is_tree of the trees among objects."""
    trees = objs.where("kind = 'tree'").select("repo", F.col("sha").alias("tree"), "content").dropDuplicates(["repo", "tree"])
    each = trees.select("repo", "tree", F.posexplode(fn.tree_entries("content")).alias("pos", "e"))
    return each.select("repo", "tree", "pos", "e.mode", "e.name", "e.sha", "e.is_tree")


def dag_of(commits: DataFrame, edges: DataFrame, large: bool = False) -> DataFrame:
    """commits with generation, n_parents and n_children; ``large`` where no task holds them."""
    shape = contracted.generations(commits, edges).join(graph.degrees(commits, edges), ["repo", "sha"]) if large else graph.shape(commits, edges)
    return commits.join(shape, ["repo", "sha"])


def staging_folder(spark: SparkSession) -> str:
    """Where fetched packs are kept, as a mounted path: executors must see it, so it is below the shared folder."""
    top = os.environ.get("HISTLAKE_STAGING_DIR") or mounted(shared_folder(spark))
    os.makedirs(top, exist_ok=True)
    return tempfile.mkdtemp(prefix="packs-", dir=top)


class RepoCatalog:
    """One repository, local (a path) or remote (a URL, staged as a pack).

    kinds: what a remote fetch needs; the leanest filter is asked for.
    """

    def __init__(self, spark: SparkSession, location: str, kinds: set[str] | None = None, cache: str | None = None):
        self.spark, self.location = spark, location
        self.remote = smart_http.is_url(location)
        spark.dataSource.register(GitObjects)
        spark.dataSource.register(GitOpenDeltas)
        if self.remote:
            self.path, self.head, found = smart_http.fetch_pack(location, staging_folder(spark), kinds)
            self._refs = [(n, s, None) for n, s in found]
        else:
            self.path, self.head = location, refs_source.head(location)
            self._refs = refs_source.list_refs(location)
            if not pack_files(location) and not loose_files(location):
                raise FileNotFoundError(f"no objects at {location}")
        self.cache = cache or os.environ.get("HISTLAKE_CACHE_DIR")

    def _load(self, source: str = "git_objects", **options: str) -> DataFrame:
        return self.spark.read.format(source).options(path=self.path, repo=self.location, **options).load()

    def _read(self, **options: str) -> DataFrame:
        """Stored objects, and those that deltas on ids outside their packs make."""
        found, late = self._load(**options), self._late[0]
        if late is None:
            return found
        if "kinds" in options:
            late = late.where(F.col("kind").isin(options["kinds"].split(",")))
        if options.get("content") == "false":
            late = late.withColumn("content", F.lit(None).cast("binary"))
        return found.unionByName(late)

    @cached_property
    def _late(self) -> tuple[DataFrame | None, DataFrame]:
        """The objects of such deltas as a table (None where there are none), and the deltas whose bases are nowhere."""
        found, rest = deltas.resolve(self._load("git_open_deltas", loose="false"), lambda ids: read_ids(ids, self.path, self.location), f"{self._work}/deltas")
        if n := rest.count():
            warnings.warn(f"{self.location}: {n} deltas have no base here; their objects are missing", stacklevel=2)
        return found, rest

    @property
    def unresolved(self) -> DataFrame:
        """repo, pack_id, offset, base_sha, base_offset of the deltas whose bases are nowhere."""
        return self._late[1].drop("delta")

    def by_ids(self, ids: DataFrame, *kinds: str) -> DataFrame:
        """The objects of a table of ids (sha), once each: only they and the delta chains below them are inflated."""
        found, late = read_ids(ids, self.path, self.location, list(kinds) or None).drop("chain"), self._late[0]
        if late is None:
            return found
        also = late.join(ids.select("sha").distinct(), "sha", "left_semi")
        return scan.deduped(found.unionByName(also.where(F.col("kind").isin(*kinds)) if kinds else also))

    def parts(self, **options: str) -> list[tuple[str, int] | None]:
        """(pack_id, first offset) of each partition in storage order, None for loose files."""
        planned = GitObjectsReader({"path": self.path, **options}).stored()
        names = {p.pack: packfmt.pack_id(mapped(p.pack)) for p in planned if p.pack}
        return [(names[p.pack], p.first()) if p.pack else None for p in planned]

    def of_kinds(self, *kinds: str) -> DataFrame:
        """Objects of some kinds, each once; others are not inflated."""
        return scan.deduped(self._read(kinds=",".join(kinds)))

    @cached_property
    def objects(self) -> DataFrame:
        return scan.deduped(self._read())

    def key(self) -> str:
        """Of the cached graph: the place, its packs and its loose objects."""
        packs = sorted(os.path.basename(p) for p in pack_files(self.path))
        loose = sorted(loose_files(self.path))
        return hashlib.sha256(repr((os.path.abspath(self.location) if not self.remote else self.location, packs, loose)).encode()).hexdigest()

    @cached_property
    def dag(self) -> DataFrame:
        """commits with generation and degrees, from the cache if it holds this very state."""
        return self._cached("dag", lambda: dag_of(self._bodies, self.edges, self.large))

    @cached_property
    def large(self) -> bool:
        """Whether the graph is larger than a task may hold, so that joins take the kernels' place."""
        return self._bodies.count() > graph.KERNEL_COMMITS

    @cached_property
    def _bodies(self) -> DataFrame:
        """The commits as a table: packs are read once for them."""
        return written(commits_of(self._read(kinds="commit")), f"{self._work}/commits")

    @property
    def nodes(self) -> DataFrame:
        """The commits; what passes over the graph add to them only where a cache holds it."""
        return self.dag if self.cache else self._bodies

    @cached_property
    def _work(self) -> str:
        return shared_folder(self.spark)

    @cached_property
    def edges(self) -> DataFrame:
        return self._cached("edges", lambda: edges_of(self._bodies))

    def _cached(self, name: str, make) -> DataFrame:
        """A table that is written once: below the cache, where the next catalog finds it, or else in the shared folder."""
        if not self.cache:
            return written(make(), f"{self._work}/{name}")
        path = f"{self.cache}/{self.key()}/{name}"
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            df = make()
            (df.repartitionByRange("sha") if "parents" in df.columns else df).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    @property
    def commits(self) -> DataFrame:
        return self.dag

    @cached_property
    def tree_entries(self) -> DataFrame:
        return self._cached("tree_entries", lambda: tree_entries_of(self._read(kinds="tree")))

    @cached_property
    def refs(self) -> DataFrame:
        return self.spark.createDataFrame([(self.location, *r) for r in self._refs], schema.REFS)

    @cached_property
    def tags(self) -> DataFrame:
        """Peeled; annotated tags that no reference file peels are peeled through their objects, however many tags name tags."""
        found = scan.tags(self.refs)
        aims = self._read(kinds="tag").select("repo", "sha", F.regexp_extract(fn.text(F.col("content")), r"(?m)^object ([0-9a-f]{40})$", 1).alias("aim"))
        aims = written(aims.where("aim <> ''").dropDuplicates(["repo", "sha"]), f"{self._work}/aims")
        step = 0
        while not found.join(aims, ["repo", "sha"], "left_semi").isEmpty():  # ids are hashes, so there is no cycle
            step += 1
            found = written(found.join(aims, ["repo", "sha"], "left").select("repo", "name", F.coalesce("aim", "sha").alias("sha")), f"{self._work}/tags-{step}")
        return found

    @cached_property
    def repos(self) -> DataFrame:
        return self.spark.createDataFrame([(self.location, self.head, self.path)], schema.REPOS)

    def views(self) -> None:
        """The tables as temp views, for SQL."""
        for name in ("objects", "dag", "edges", "tree_entries", "refs", "tags", "repos"):
            getattr(self, name).createOrReplaceTempView(name)
