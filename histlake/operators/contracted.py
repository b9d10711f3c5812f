"""Generations, landings and earliest tags of graphs that no task holds: joins only, no kernel.

A commit of a single parent hangs below it, if it is the largest such child; so
commits make paths, each above an anchor: a merge, a root, or a branch's first
commit.  Pointers double: in as many joins as the longest path has binary
digits, every commit knows its anchor and its distance; those that know it are
not moved again.  What is left is a graph of anchors, in which an anchor leads
to the places of its parents; it is as large as there are merges and branches.
Rounds go over that graph, one join each: for generations, an anchor follows
once all its parents' are known; for the least value among a commit's
descendants, anchors whose value has become smaller send it on.  The links stay
on the executors, dealt by the anchor that sends, so a round shuffles the
anchors' values alone.  Then the values go down the paths, in order of distance: first over
blocks of a path, then within each.

Rounds are as many as merges follow one another, and each shuffles only what is
new.  ``graph`` does the same within a task, which is faster for any history
that fits one; here no row count of a component matters.

Commits on a cycle, which no real history has, have generation 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from histlake.plans.shared import shared_folder, written

#: Doublings at most: chains of 2**40 commits; pointers that go on then are on a cycle.
MOST_DOUBLINGS = 40


#: Commits of a path that are put in order at once.
BLOCK = 4_096


class Contracted:
    """The paths and the graph of anchors of commits (component, sha) and edges (component, child, parent)."""

    def __init__(self, commits: DataFrame, edges: DataFrame, component: str = "repo", folder: str | None = None):
        self.component, self.folder = component, folder or shared_folder(commits.sparkSession)
        self.steps = 0
        key = [component, "sha"]
        known = edges.select(component, "child", "parent").join(commits.select(component, F.col("sha").alias("parent")), [component, "parent"], "left_semi")
        above = known.groupBy(component, F.col("child").alias("sha")).agg(F.collect_list("parent").alias("parents"))
        # a commit's parents stay with it, so edges are not looked up again
        nodes = self._kept(commits.select(*key).distinct().join(above, key, "left"))
        mains = nodes.where("size(parents) = 1").groupBy(component, F.col("parents")[0].alias("to")).agg(F.max("sha").alias("sha"))
        going = self._kept(mains.select(*key, "to", F.lit(1).cast("long").alias("dist"), F.lit(False).alias("ended")))
        told = nodes.join(going.select(*key), key, "left_anti")
        #: component, sha, n parents, parents: what is above no other commit of its path
        self.anchors = self._kept(told.select(*key, F.greatest(F.size("parents"), F.lit(0)).cast("long").alias("n"), "parents"))
        ended = [self.anchors.select(*key, F.col("sha").alias("to"), F.lit(0).cast("long").alias("dist"))]
        for _ in range(MOST_DOUBLINGS):
            # a commit that nothing is known of is an anchor
            on = reduce(DataFrame.union, [*(x.withColumn("ended", F.lit(True)) for x in ended[1:]), going])
            on = on.select(component, F.col("sha").alias("to"), F.col("to").alias("further"), F.col("dist").alias("more"), F.col("ended").alias("all"))
            far = (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist")
            both = self._kept(going.join(on, [component, "to"], "left").select(*key, F.coalesce("further", "to").alias("to"), far, F.coalesce("all", F.lit(True)).alias("ended")))
            ended.append(both.where("ended").drop("ended"))
            going = both.where("NOT ended")
            if going.isEmpty():
                break
        #: component, sha, anchor, dist; without an anchor on a cycle
        self.places = reduce(DataFrame.union, [*ended, going.select(*key, F.lit(None).cast(commits.schema["sha"].dataType), "dist")]).withColumnRenamed("to", "anchor")
        #: from, anchor, dist: from an anchor to the place of each of its parents
        leading = self.anchors.select(component, F.col("sha").alias("child"), F.explode("parents").alias("parent"))
        ends = self.places.withColumnRenamed("sha", "parent")
        self.links = self._kept(leading.join(ends, [component, "parent"]).select(component, F.col("child").alias("from"), "anchor", "dist"))

    def _kept(self, df: DataFrame) -> DataFrame:
        self.steps += 1
        return written(df, f"{self.folder}/contracted-{self.steps}")

    def _dealt(self, df: DataFrame, column: str) -> DataFrame:
        """df on the executors, dealt by an anchor: joins by it do not move it again."""
        return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), self.component, column).persist(StorageLevel.MEMORY_AND_DISK)

    def generations(self) -> DataFrame:
        """component, sha, generation: 1 for roots, else 1 more than the largest of the parents."""
        key = [self.component, "sha"]
        zero = F.lit(0).cast("long")
        links = self._dealt(self.links, "anchor")
        new = self._kept(self.anchors.where("n = 0").select(*key, F.lit(1).cast("long").alias("g")))
        found, waiting = [new], None
        while not new.isEmpty():
            sent = links.join(new.withColumnRenamed("sha", "anchor"), [self.component, "anchor"])
            sent = sent.select(self.component, F.col("from").alias("sha"), F.lit(1).cast("long").alias("got"), (F.col("g") + F.col("dist") + 1).alias("g"))
            sent = sent if waiting is None else waiting.union(sent)
            summed = sent.groupBy(*key).agg(F.sum("got").alias("got"), F.max("g").alias("g"))
            summed = self._kept(summed.join(self.anchors.select(*key, "n"), key).select(*key, "got", "g", (F.col("got") == F.col("n")).alias("ready")))
            new, waiting = summed.where("ready").select(*key, "g"), summed.where("NOT ready").select(*key, "got", "g")
            found.append(new)
        links.unpersist()
        known = reduce(DataFrame.union, found).withColumnRenamed("sha", "anchor")
        ends = self.places.join(known, [self.component, "anchor"], "left")
        return ends.select(*key, F.coalesce(F.col("g") + F.col("dist"), zero).cast("int").alias("generation"))

    def least(self, own: DataFrame, strict: bool = False) -> DataFrame:
        """component, sha, v: the least v of each commit (but where strict) and its descendants, of own (component, sha, v); v is anything with an order."""
        key = [self.component, "sha"]
        at = self._kept(own.join(self.places.where("anchor IS NOT NULL"), key).select(self.component, "anchor", "dist", "v"))
        best = self._settled(at.groupBy(self.component, F.col("anchor").alias("sha")).agg(F.min("v").alias("v")))
        above = self.links.where("anchor IS NOT NULL").join(best.withColumnRenamed("sha", "from"), [self.component, "from"]).select(self.component, "anchor", "dist", "v")
        return self._down(at, self._kept(above), strict)

    def _settled(self, start: DataFrame) -> DataFrame:
        """component, sha, v: the least v of each anchor's path and all that leads to it, of start."""
        key = [self.component, "sha"]
        links = self._dealt(self.links.select(self.component, F.col("from").alias("sha"), F.col("anchor").alias("next")).where("next IS NOT NULL"), "sha")
        best = self._kept(start.select(*key, "v", F.lit(True).alias("new")))
        while not best.where("new").isEmpty():
            sent = links.join(best.where("new").select(*key, "v"), key).select(self.component, F.col("next").alias("sha"), "v", F.lit(False).alias("known"))
            both = best.select(*key, "v", F.lit(True).alias("known")).union(sent).groupBy(*key).agg(F.min("v").alias("v"), F.min(F.when(F.col("known"), F.col("v"))).alias("had"))
            best = self._kept(both.select(*key, "v", (F.col("had").isNull() | (F.col("v") < F.col("had"))).alias("new")))
        links.unpersist()
        return best.select(*key, "v")

    def _down(self, at: DataFrame, above: DataFrame, strict: bool) -> DataFrame:
        """component, sha, v: the least v at or beyond each commit's place; at and above: component, anchor, dist, v of commits' own values and of those that links bring."""
        path = [self.component, "anchor"]
        block = F.floor(F.col("dist") / BLOCK).alias("block")
        both = at.union(above)
        far = both.where(F.col("dist") >= BLOCK).groupBy(*path, block).agg(F.min("v").alias("v"))
        order = W.partitionBy(*path).orderBy(F.desc("block"))
        far = far.select(*path, F.min("v").over(order).alias("v"), F.sequence(F.coalesce(F.lead("block").over(order), F.lit(0).cast("long")), F.col("block") - 1).alias("blocks"))
        # from each block with values to those between it and the next one
        carried = far.select(*path, F.explode("blocks").alias("block"), "v").where("block >= 0")
        row = lambda df, dist, rank, sha, v: df.select(*path, *([block] if "block" not in df.columns else ["block"]), dist.alias("dist"), F.lit(rank).alias("rank"), sha.alias("sha"), v.alias("v"))
        places = self.places.where("anchor IS NOT NULL")
        none = lambda df, name: F.lit(None).cast(df.schema[name].dataType)
        of = none(places, "sha")
        rows = row(places, F.col("dist"), 1, F.col("sha"), none(at, "v"))
        rows = rows.union(row(at, F.col("dist"), 2 if strict else 0, of, F.col("v"))).union(row(above, F.col("dist"), 0, of, F.col("v")))
        rows = rows.union(row(carried, (F.col("block") + 1) * BLOCK, 0, of, F.col("v")))
        beyond = W.partitionBy(*path, "block").orderBy(F.desc("dist"), "rank").rowsBetween(W.unboundedPreceding, W.currentRow)
        return rows.withColumn("v", F.min("v").over(beyond)).where("sha IS NOT NULL AND v IS NOT NULL").select(self.component, "sha", "v")


def generations(commits: DataFrame, edges: DataFrame, component: str = "repo", folder: str | None = None) -> DataFrame:
    """As graph.generations."""
    return Contracted(commits, edges, component, folder).generations()


def landings(dag: DataFrame, edges: DataFrame, targets: DataFrame, heads: DataFrame, component: str = "repo", folder: str | None = None) -> DataFrame:
    """As graph.landings; dag(component, sha, generation)."""
    of = Contracted(dag, edges, component, folder)
    inside = of.least(heads.select(component, "sha", F.lit(0).alias("v")).join(dag.select(component, "sha"), [component, "sha"], "left_semi")).select(component, "sha")
    merges = of.anchors.where("n > 1").select(component, "sha").join(inside, [component, "sha"], "left_semi").join(dag.select(component, "sha", "generation"), [component, "sha"])
    own = merges.select(component, "sha", F.struct(F.col("generation").alias("generation"), F.col("sha").alias("merge")).alias("v"))
    # what a merge inside leads to is inside
    found = targets.select(component, "sha").distinct().join(of.least(own, strict=True), [component, "sha"])
    return found.select(component, "sha", "v.merge", "v.generation")


def earliest_tags(dag: DataFrame, edges: DataFrame, tags: DataFrame, targets: DataFrame, component: str = "repo", folder: str | None = None) -> DataFrame:
    """As graph.earliest_tags; dag(component, sha, generation, author_ts)."""
    of = Contracted(dag, edges, component, folder)
    at = tags.join(dag.select(component, "sha", "generation", "author_ts"), [component, "sha"])
    own = at.groupBy(component, "sha").agg(F.min(F.struct("generation", "author_ts", "name", F.col("sha").alias("tag_sha"))).alias("v"))
    found = targets.select(component, "sha").distinct().join(of.least(own), [component, "sha"])
    return found.select(component, "sha", "v.name", "v.tag_sha", "v.generation", "v.author_ts")
