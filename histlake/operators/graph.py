"""Commit graphs: generations, closures, landings, containing tags, comparisons.

Histories are deep, so a Spark job for each level is out of the question.  The
kernels below take whole components: the rows of a component (any key that no
edge leaves) go to one task, and a task takes as many components as fill a
batch.  Components run in parallel.  In a component, generations, landings and
earliest tags are one pass over the edges in topological order; numbers of
ancestors and descendants are passes over sets of bits; only closures that are
asked for as pairs are as large as their output.  For components that exceed a
worker's memory (KERNEL_COMMITS) generations, landings and earliest tags are
joins over contracted graphs (``contracted``), and ``reach_by_levels`` is a join
for each level.

Commits on a cycle, which no real history has, have generation 0 and no
landing or earliest tag.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histlake.plans.shared import shared_folder, written

#: Larger than the place of anything.
NEVER = (1 << 63) - 1
#: Bytes of the sets of bits that are held at once.
BIT_BYTES = 256 << 20
#: Commits of a component that a kernel is given at most; about 300 bytes each.
KERNEL_COMMITS = 5_000_000
#: Heads that the bits of a long stand for.
HEADS = 63
#: Rows of whole components that a kernel takes at once.
BATCH_ROWS = 200_000


def _in_components(rows: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run kernel over batches of whole components of rows(component, role, a, b)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of components that have ended, and of the one that has not; each row is joined to others once
        whole: list[pd.DataFrame] = []
        going: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            frame = batch.to_pandas()
            if not len(frame):
                continue
            size += len(frame)
            column, last = frame["component"], frame["component"].iloc[-1]
            begin = int(_equal(column, last).to_numpy().argmax())
            if begin:
                whole += [*going, frame[:begin]]
                going = []
            elif going and not _equal(going[-1]["component"], last).iloc[-1]:
                whole += going
                going = []
            going.append(frame[begin:])
            if size >= BATCH_ROWS and whole:
                yield from _batches(kernel(pd.concat(whole, ignore_index=True)))
                whole, size = [], sum(map(len, going))
        if whole or going:
            yield from _batches(kernel(pd.concat(whole + going, ignore_index=True)))

    def _equal(column: pd.Series, value) -> pd.Series:
        return column.isna() if pd.isna(value) else column == value

    def _batches(frame: pd.DataFrame) -> Iterator[pa.RecordBatch]:
        if len(frame):
            yield from pa.Table.from_pandas(frame, preserve_index=False).to_batches(max_chunksize=50_000)

    return rows.repartition("component").sortWithinPartitions("component").mapInArrow(run, schema)


class _Graph:
    """Nodes numbered from 0, component by component; edges by number."""

    def __init__(self, frame: pd.DataFrame):
        self.role = frame["role"].to_numpy()
        is_commit, is_edge = self.role == 0, self.role == 1
        part, _ = pd.factorize(frame["component"], use_na_sentinel=False)
        a, b = frame["a"].to_numpy(), frame["b"].to_numpy()[is_edge]
        code, names = pd.factorize(np.concatenate((a, b)), sort=True)
        self._keys = part.astype(np.int64) * max(1, len(names)) + code[: len(a)]
        self._nodes, first = np.unique(self._keys[is_commit], return_index=True)
        self.n = len(self._nodes)
        self.rows_of = np.flatnonzero(is_commit)[first]
        self.component = frame["component"].to_numpy()[self.rows_of]
        self.part = part[self.rows_of]
        self.name = a[self.rows_of]
        #: Names in order, as numbers.
        self.order = code[self.rows_of]
        child = self._at(self._keys[is_edge])
        parent = self._at(part[is_edge].astype(np.int64) * max(1, len(names)) + code[len(a) :])
        self.n_parents = np.bincount(child[child >= 0], minlength=self.n)
        self.n_children = np.bincount(parent[parent >= 0], minlength=self.n)
        #: Which edges join two commits.
        self.known = (child >= 0) & (parent >= 0)
        self.child, self.parent = child[self.known], parent[self.known]

    def _at(self, keys: np.ndarray) -> np.ndarray:
        """The nodes of keys, -1 for what is no commit."""
        if not self.n:
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self._nodes, keys), self.n - 1)
        return np.where(self._nodes[at] == keys, at, -1)

    def of_role(self, role: int) -> np.ndarray:
        """The nodes that rows of a role name, row by row."""
        return self._at(self._keys[self.role == role])

    @staticmethod
    def rows(source: np.ndarray, target: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(source, kind="stable")
        return np.searchsorted(source[order], np.arange(n + 1)), target[order]

    @cached_property
    def generation(self) -> np.ndarray:
        """1 for roots, else 1 more than the largest of the parents; 0 on cycles and behind them."""
        left = np.bincount(self.child, minlength=self.n).tolist()
        bounds, children = self.rows(self.parent, self.child, self.n)
        bounds, children = bounds.tolist(), children.tolist()
        out = [0] * self.n
        ready = deque(i for i in range(self.n) if not left[i])
        for i in ready:
            out[i] = 1
        highest = out.copy()
        while ready:  # histories are long lines more often than not, so levels are too small for arrays
            i = ready.popleft()
            out[i] = now = highest[i] or 1
            for k in children[bounds[i] : bounds[i + 1]]:
                if highest[k] <= now:
                    highest[k] = now + 1
                left[k] -= 1
                if not left[k]:
                    ready.append(k)
        return np.array(out, dtype=np.int32)

    def waves(self, up: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Edges in topological order, a level at a time: sources, where those of each target begin, targets.

        With up, from children to parents, youngest first; else from parents to children, oldest first.
        """
        source, target = (self.child, self.parent) if up else (self.parent, self.child)
        level = -self.generation[self.child] if up else self.generation[self.child]
        fit = (self.generation[self.child] > 0) & (self.generation[self.parent] > 0)
        source, target, level = source[fit], target[fit], level[fit]
        order = np.lexsort((source, target, level))
        source, target, level = source[order], target[order], level[order]
        cuts = np.flatnonzero(np.diff(level)) + 1
        fresh = np.ones(len(target), dtype=bool)
        fresh[1:] = target[1:] != target[:-1]
        fresh[cuts] = True
        begins = np.flatnonzero(fresh)
        bounds = np.concatenate(([0], cuts, [len(target)])) if len(target) else np.zeros(1, dtype=np.int64)
        where = np.searchsorted(begins, bounds)
        return [(source[x:y], begins[i:j] - x, target[begins[i:j]]) for x, y, i, j in zip(bounds, bounds[1:], where, where[1:], strict=False)]

    def spread_least(self, own: np.ndarray, passed: np.ndarray | None = None) -> np.ndarray:
        """For each node, the least value of its descendants: own[d], only along nodes that ``passed`` marks; not its own value."""
        generation = self.generation
        fit = (generation[self.child] > 0) & (generation[self.parent] > 0)
        if passed is not None:
            fit &= passed[self.child]
        edges = np.flatnonzero(fit)
        edges = edges[np.argsort(-generation[self.child[edges]], kind="stable")]
        out, values = [NEVER] * self.n, own.tolist()
        for child, parent in zip(self.child[edges].tolist(), self.parent[edges].tolist(), strict=True):
            value = min(out[child], values[child])
            if value < out[parent]:
                out[parent] = value
        return np.array(out, dtype=np.int64)

    def spread_bits(self, own: np.ndarray, passing: np.ndarray) -> np.ndarray:
        """For each node, its own bits and those of its descendants, along edges only the bits that pass them."""
        generation = self.generation
        edges = np.flatnonzero((generation[self.child] > 0) & (generation[self.parent] > 0))
        edges = edges[np.argsort(-generation[self.child[edges]], kind="stable")]
        out = own.tolist()
        for child, parent, bits in zip(self.child[edges].tolist(), self.parent[edges].tolist(), passing[edges].tolist(), strict=True):
            out[parent] |= out[child] & bits
        return np.array(out, dtype=np.int64)

    def inside(self, seeds: np.ndarray) -> np.ndarray:
        """Which nodes are the seeds or their ancestors."""
        own = np.full(self.n, NEVER)
        own[seeds[seeds >= 0]] = 0
        return np.minimum(own, self.spread_least(own)) == 0

    def counts(self, up: bool) -> np.ndarray:
        """For each node, how many nodes reach it when edges are followed from children to parents (up) or from parents to children, itself included."""
        first = np.searchsorted(self.part, self.part)
        local = np.arange(self.n) - first
        most = int(local.max(initial=-1)) + 1
        words = max(1, min(-(-most // 64), BIT_BYTES // (8 * max(1, self.n))))
        waves, out = self.waves(up), np.zeros(self.n, dtype=np.int64)
        for low in range(0, most, 64 * words):
            bits = np.zeros((self.n, words), dtype=np.uint64)
            mine = np.flatnonzero((local >= low) & (local < low + 64 * words))
            bits[mine, (local[mine] - low) // 64] = np.uint64(1) << ((local[mine] - low) % 64).astype(np.uint64)
            for source, begins, target in waves:
                bits[target] |= np.bitwise_or.reduceat(bits[source], begins, axis=0) if len(begins) < len(source) else bits[source]
            out += np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        return out

    @cached_property
    def intervals(self) -> tuple[np.ndarray, np.ndarray]:
        """Place and size of each node's part of a spanning forest, in which a commit hangs below one of its parents: what hangs below a node lies in [place, place + size)."""
        fit = (self.generation[self.child] > 0) & (self.generation[self.parent] > 0)
        up = np.full(self.n, -1)
        up[self.child[fit]] = self.parent[fit]
        order = np.argsort(self.generation, kind="stable").tolist()
        above, size, place = up.tolist(), [1] * self.n, [0] * self.n
        for i in reversed(order):
            if above[i] >= 0:
                size[above[i]] += size[i]
        free, roots = [0] * self.n, 0
        for i in order:
            if above[i] < 0:
                place[i], roots = roots, roots + size[i]
            else:
                place[i] = free[above[i]]
                free[above[i]] += size[i]
            free[i] = place[i] + 1
        return np.array(place, dtype=np.int64), np.array(size, dtype=np.int64)

    def reaches(self, nodes: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Whether each target is the node beside it or one of its ancestors.

        Generations and the spanning forest answer most; for the rest of a
        node's targets there is one walk, no deeper than the least generation
        among them.
        """
        place, size = self.intervals
        out = (place[targets] <= place[nodes]) & (place[nodes] < place[targets] + size[targets])
        open_ = np.flatnonzero(~out & (self.generation[nodes] > self.generation[targets]) & (self.generation[targets] > 0))
        if not len(open_):
            return out
        bounds, parents = self.rows(self.child, self.parent, self.n)
        bounds, parents, generation = bounds.tolist(), parents.tolist(), self.generation.tolist()
        open_ = open_[np.argsort(nodes[open_], kind="stable")]
        for asked in np.split(open_, np.flatnonzero(np.diff(nodes[open_])) + 1):
            least = int(self.generation[targets[asked]].min())
            start = int(nodes[asked[0]])
            seen, waiting = {start}, [start]
            while waiting:
                i = waiting.pop()
                for k in parents[bounds[i] : bounds[i + 1]]:
                    if generation[k] >= least and k not in seen:
                        seen.add(k)
                        waiting.append(k)
            out[asked] = [t in seen for t in targets[asked].tolist()]
        return out

    def reached(self, seeds: np.ndarray, up: bool) -> tuple[np.ndarray, np.ndarray]:
        """(seed, node) for all nodes that each seed reaches, itself included."""
        bounds, targets = self.rows(self.child, self.parent, self.n) if up else self.rows(self.parent, self.child, self.n)
        lists = [targets[bounds[i] : bounds[i + 1]].tolist() for i in range(self.n)]
        ends, nodes = [], []
        for seed in seeds.tolist():
            seen, waiting = {seed}, deque((seed,))
            while waiting:
                for t in lists[waiting.popleft()]:
                    if t not in seen:
                        seen.add(t)
                        waiting.append(t)
            nodes.append(np.fromiter(seen, dtype=np.int64, count=len(seen)))
            ends.append(len(seen))
        return np.repeat(seeds, ends) if ends else seeds[:0], np.concatenate(nodes) if nodes else np.array([], dtype=int)


def _rows(commits: DataFrame, edges: DataFrame, component: str, **others: DataFrame) -> DataFrame:
    """Commits (role 0), edges (1) and more commits that are named (roles from 2 on) as one table; b repeats a where there is no second node."""
    rows = commits.select(F.col(component).alias("component"), F.lit(0).alias("role"), F.col("sha").alias("a"), F.col("sha").alias("b"))
    rows = rows.union(edges.select(F.col(component), F.lit(1), F.col("child"), F.col("parent")))
    for role, named in enumerate(others.values(), 2):
        rows = rows.union(named.select(F.col(component), F.lit(role), F.col("sha"), F.col("sha")))
    return rows


def _types(commits: DataFrame, component: str) -> tuple[str, str]:
    return commits.schema["sha"].dataType.simpleString(), f"`{component}` {commits.schema[component].dataType.simpleString()}"


def generations(commits: DataFrame, edges: DataFrame, component: str = "repo") -> DataFrame:
    """component, sha, generation of every commit."""
    return shape(commits, edges, component).select(component, "sha", "generation")


def shape(commits: DataFrame, edges: DataFrame, component: str = "repo") -> DataFrame:
    """component, sha, generation, n_parents, n_children of every commit, in one pass."""
    kind, key = _types(commits, component)

    def kernel(frame: pd.DataFrame) -> pd.DataFrame:
        g = _Graph(frame)
        return pd.DataFrame({component: g.component, "sha": g.name, "generation": g.generation, "n_parents": g.n_parents, "n_children": g.n_children})

    return _in_components(_rows(commits, edges, component), kernel, f"{key}, sha {kind}, generation int, n_parents long, n_children long")


def reach(commits: DataFrame, edges: DataFrame, seeds: DataFrame, up: bool = True, component: str = "repo") -> DataFrame:
    """component, seed, sha: what each seed reaches by parents (up) or by children, itself included; unknown seeds reach nothing."""
    kind, key = _types(commits, component)

    def kernel(frame: pd.DataFrame) -> pd.DataFrame:
        g = _Graph(frame)
        at = g.of_role(2)
        seed, node = g.reached(np.unique(at[at >= 0]), up)
        return pd.DataFrame({component: g.component[seed], "seed": g.name[seed], "sha": g.name[node]})

    return _in_components(_rows(commits, edges, component, seeds=seeds), kernel, f"{key}, seed {kind}, sha {kind}")


def reaches(commits: DataFrame, edges: DataFrame, pairs: DataFrame, component: str = "repo") -> DataFrame:
    """component, sha, target, reached of distinct pairs (component, sha, target): whether the target is the commit or one of its ancestors; false for unknown commits."""
    kind, key = _types(commits, component)
    rows = _rows(commits, edges, component).union(pairs.select(F.col(component), F.lit(2), F.col("sha"), F.col("target")).distinct())

    def kernel(frame: pd.DataFrame) -> pd.DataFrame:
        g = _Graph(frame)
        asked = frame[frame["role"] == 2].reset_index(drop=True)
        nodes = pd.DataFrame({"component": g.component, "name": g.name, "node": np.arange(g.n)})
        at = lambda column: asked[["component", column]].merge(nodes, how="left", left_on=["component", column], right_on=["component", "name"])["node"].fillna(-1).to_numpy(dtype=np.int64)
        a, b = at("a"), at("b")
        known = np.flatnonzero((a >= 0) & (b >= 0))
        reached = np.zeros(len(asked), dtype=bool)
        reached[known] = g.reaches(a[known], b[known])
        return pd.DataFrame({component: asked["component"], "sha": asked["a"], "target": asked["b"], "reached": reached})

    return _in_components(rows, kernel, f"{key}, sha {kind}, target {kind}, reached boolean")


def reach_by_levels(edges: DataFrame, seeds: DataFrame, up: bool = True, component: str = "repo", folder: str | None = None) -> DataFrame:
    """The same by one join for each level, without a kernel: for shallow graphs, or components too large for a worker.  Seeds must be commits."""
    folder = folder or shared_folder(edges.sparkSession)
    near, far = ("child", "parent") if up else ("parent", "child")
    steps = edges.select(component, F.col(near).alias("sha"), F.col(far).alias("next"))
    found = now = written(seeds.select(component, F.col("sha").alias("seed"), "sha").distinct(), f"{folder}/reach-0")
    level = 0
    while not now.isEmpty():
        level += 1
        new = now.join(steps, [component, "sha"]).select(component, "seed", F.col("next").alias("sha")).distinct()
        now = written(new.join(found, [component, "seed", "sha"], "left_anti"), f"{folder}/reach-{level}")
        found = found.union(now)
    return found


def reach_counts(commits: DataFrame, edges: DataFrame, component: str = "repo") -> DataFrame:
    """component, sha, ancestors, descendants: how many each commit has, itself included."""
    kind, key = _types(commits, component)

    def kernel(frame: pd.DataFrame) -> pd.DataFrame:
        g = _Graph(frame)
        return pd.DataFrame({component: g.component, "sha": g.name, "ancestors": g.counts(up=False), "descendants": g.counts(up=True)})

    return _in_components(_rows(commits, edges, component), kernel, f"{key}, sha {kind}, ancestors long, descendants long")


def ancestors(commits: DataFrame, edges: DataFrame, seeds: DataFrame, component: str = "repo") -> DataFrame:
    return reach(commits, edges, seeds, True, component)


def descendants(commits: DataFrame, edges: DataFrame, seeds: DataFrame, component: str = "repo") -> DataFrame:
    return reach(commits, edges, seeds, False, component)


def known_edges(commits: DataFrame, edges: DataFrame, component: str = "repo") -> DataFrame:
    """Edges whose parent is there; where it is not, the history is cut and the child is a root."""
    return edges.join(commits.select(component, F.col("sha").alias("parent")), [component, "parent"], "left_semi").select(*edges.columns)


def degrees(commits: DataFrame, edges: DataFrame, component: str = "repo") -> DataFrame:
    """component, sha, n_parents, n_children."""
    up = edges.groupBy(component, F.col("child").alias("sha")).agg(F.count("*").alias("n_parents"))
    down = edges.groupBy(component, F.col("parent").alias("sha")).agg(F.count("*").alias("n_children"))
    joined = commits.select(component, "sha").join(up, [component, "sha"], "left").join(down, [component, "sha"], "left")
    return joined.select(component, "sha", F.coalesce("n_parents", F.lit(0)).cast("long").alias("n_parents"), F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"))


def first_parents(edges: DataFrame, component: str = "repo") -> DataFrame:
    """component, child, parent: the first of the parents that are there."""
    return edges.groupBy(component, "child").agg(F.min_by("parent", "ordinal").alias("parent"))


def stats(dag: DataFrame) -> DataFrame:
    """One row: commits, roots, leaves, merges, max_generation."""
    return dag.agg(F.count("*").alias("commits"), F.count_if(F.col("n_parents") == 0).alias("roots"), F.count_if(F.col("n_children") == 0).alias("leaves"), F.count_if(F.col("n_parents") > 1).alias("merges"), F.coalesce(F.max("generation"), F.lit(0)).cast("int").alias("max_generation"))


def landings(commits: DataFrame, edges: DataFrame, targets: DataFrame, heads: DataFrame, component: str = "repo") -> DataFrame:
    """component, sha, merge, generation: the merge that first brought each target into its component's head.

    targets and heads (component, sha).  Of the merges between target and head
    the one of lowest generation, then id.  Targets outside the head's history
    have no row.
    """
    kind, key = _types(commits, component)

    def kernel(frame: pd.DataFrame) -> pd.DataFrame:
        g = _Graph(frame)
        inside = g.inside(g.of_role(3))
        merges = np.flatnonzero(inside & (g.n_parents > 1))
        merges = merges[np.lexsort((g.order[merges], g.generation[merges]))]
        own = np.full(g.n, NEVER)
        own[merges] = np.arange(len(merges))
        first = g.spread_least(own, inside)
        at = np.unique(g.of_role(2))
        at = at[at >= 0]
        at = at[inside[at] & (first[at] < NEVER)]
        merge = merges[first[at]] if len(at) else at
        return pd.DataFrame({component: g.component[at], "sha": g.name[at], "merge": g.name[merge], "generation": g.generation[merge]})

    return _in_components(_rows(commits, edges, component, targets=targets, heads=heads), kernel, f"{key}, sha {kind}, merge {kind}, generation int")


def containing_tags(commits: DataFrame, edges: DataFrame, tags: DataFrame, targets: DataFrame, component: str = "repo") -> DataFrame:
    """component, sha, name, tag_sha, generation, author_ts: the tags whose history holds each target.

    commits(component, sha, author_ts), tags(component, name, sha).  Sets of
    tags are pushed as bits from the tags to their ancestors, as many tags at a
    time as BIT_BYTES hold, so the only pairs that are made are those returned.
    """
    kind, key = _types(commits, component)

    def kernel(frame: pd.DataFrame) -> pd.DataFrame:
        g = _Graph(frame)
        node, ts, label = _tagged(g, frame)
        at = np.unique(g.of_role(2))
        at = at[at >= 0]
        # tags are numbered component by component, so that components share bits
        part = g.part[node]
        order = np.argsort(part, kind="stable")
        begin = np.searchsorted(part[order], np.arange(part.max(initial=-1) + 2))
        local = np.arange(len(order)) - begin[part[order]]
        most = int(local.max(initial=-1)) + 1
        words = max(1, min(-(-most // 64), BIT_BYTES // (8 * max(1, g.n))))
        waves = g.waves(up=True) if most else []
        targets, found = [at[:0]], [order[:0]]
        for low in range(0, most, 64 * words):
            bits = np.zeros((g.n, words), dtype=np.uint64)
            mine = np.flatnonzero((local >= low) & (local < low + 64 * words))
            np.bitwise_or.at(bits, (node[order[mine]], (local[mine] - low) // 64), np.uint64(1) << ((local[mine] - low) % 64).astype(np.uint64))
            for source, begins, target in waves:
                bits[target] |= np.bitwise_or.reduceat(bits[source], begins, axis=0) if len(begins) < len(source) else bits[source]
            which, bit = np.nonzero(np.unpackbits(bits[at].view(np.uint8), axis=1, bitorder="little"))
            targets.append(at[which])
            found.append(order[begin[g.part[at[which]]] + low + bit])
        at, tag = np.concatenate(targets), np.concatenate(found)
        return _tag_rows(g, component, at, tag, node, ts, label)

    return _in_components(_tag_table(commits, edges, tags, targets, component), kernel, f"{key}, sha {kind}, name string, tag_sha {kind}, generation int, author_ts long")


def _tag_table(commits: DataFrame, edges: DataFrame, tags: DataFrame, targets: DataFrame, component: str) -> DataFrame:
    """Commits, edges, targets (role 2) and tags (role 3, with author time and name)."""
    rows = _rows(commits.select(component, "sha"), edges, component, targets=targets).select("*", F.lit(None).cast("long").alias("ts"), F.lit(None).cast("string").alias("label"))
    at = tags.join(commits.select(component, "sha", "author_ts"), [component, "sha"])
    return rows.union(at.select(F.col(component), F.lit(3), F.col("sha"), F.col("sha"), F.col("author_ts"), F.col("name")))


def _tagged(g: _Graph, frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node, author time and name of each tag."""
    rows = frame[frame["role"] == 3]
    return g.of_role(3), rows["ts"].fillna(0).to_numpy(dtype=np.int64), rows["label"].to_numpy()


def _tag_rows(g: _Graph, component: str, at: np.ndarray, tag: np.ndarray, node: np.ndarray, ts: np.ndarray, label: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({component: g.component[at], "sha": g.name[at], "name": label[tag], "tag_sha": g.name[node[tag]], "generation": g.generation[node[tag]], "author_ts": ts[tag]})


def earliest_tags(commits: DataFrame, edges: DataFrame, tags: DataFrame, targets: DataFrame, component: str = "repo") -> DataFrame:
    """component, sha, name, tag_sha, generation, author_ts: the first tag whose history holds each target, by generation, author time, name.

    commits(component, sha, author_ts), tags(component, name, sha).  Pushed from
    the tags to their ancestors, so no pair of tag and commit is made.
    """
    kind, key = _types(commits, component)

    def kernel(frame: pd.DataFrame) -> pd.DataFrame:
        g = _Graph(frame)
        node, ts, label = _tagged(g, frame)
        by_name, _ = pd.factorize(label, sort=True)
        order = np.lexsort((by_name, ts, g.generation[node]))
        own = np.full(g.n, NEVER)
        np.minimum.at(own, node[order], np.arange(len(order)))
        first = np.minimum(own, g.spread_least(own))
        at = np.unique(g.of_role(2))
        at = at[at >= 0]
        at = at[first[at] < NEVER]
        tag = order[first[at]] if len(at) else at
        return _tag_rows(g, component, at, tag, node, ts, label)

    return _in_components(_tag_table(commits, edges, tags, targets, component), kernel, f"{key}, sha {kind}, name string, tag_sha {kind}, generation int, author_ts long")


def compare(base: DataFrame, target: DataFrame, by: list[str] | None = None) -> DataFrame:
    """common, ahead, behind, lca, lca_generation of two ancestor sets, for each group of ``by``.

    base(by..., sha, generation), target(by..., sha).  The last common ancestor
    is a common one of highest generation, then smallest id.
    """
    by = by or []
    b = base.select(*by, "sha", F.col("generation").alias("g"), F.lit(True).alias("in_base"))
    t = target.select(*by, "sha", F.lit(True).alias("in_target"))
    both = b.join(t, [*by, "sha"], "full")
    common = F.col("in_base") & F.col("in_target")
    lowest = F.min(F.when(common, F.struct((-F.col("g")).alias("up"), F.col("sha").alias("lca")))).alias("l")
    grouped = both.groupBy(*by).agg(F.count_if(common).alias("common"), F.count_if(F.col("in_base").isNull()).alias("ahead"), F.count_if(F.col("in_target").isNull()).alias("behind"), lowest)
    return grouped.select(*by, "common", "ahead", "behind", F.col("l.lca").alias("lca"), (-F.col("l.up")).alias("lca_generation"))


def heads_reached(commits: DataFrame, edges: DataFrame, heads: DataFrame, component: str = "repo") -> DataFrame:
    """component, sha, bits: the heads whose history holds each commit, as the bits of a long; commits that no head reaches have no row.

    heads(component, sha, bits); commits(component, sha, bits), each once, and
    edges(component, child, parent, bits): the heads for which a row is there, so
    that histories cut at different places are one graph and still end where
    each of them does.
    """
    kind, key = _types(commits, component)
    rows = commits.select(F.col(component).alias("component"), F.lit(0).alias("role"), F.col("sha").alias("a"), F.col("sha").alias("b"), "bits")
    rows = rows.union(edges.select(component, F.lit(1), "child", "parent", "bits")).union(heads.select(component, F.lit(2), "sha", "sha", "bits"))

    def kernel(frame: pd.DataFrame) -> pd.DataFrame:
        g = _Graph(frame)
        bits, own, at = frame["bits"].to_numpy(dtype=np.int64), np.zeros(g.n, dtype=np.int64), g.of_role(2)
        np.bitwise_or.at(own, at[at >= 0], bits[g.role == 2][at >= 0])
        found = g.spread_bits(own & bits[g.rows_of], bits[g.role == 1][g.known])
        some = np.flatnonzero(found)
        return pd.DataFrame({component: g.component[some], "sha": g.name[some], "bits": found[some]})

    return _in_components(rows, kernel, f"{key}, sha {kind}, bits long")


def compare_heads(reached: DataFrame, generations: DataFrame, component: str = "repo") -> DataFrame:
    """component, bit, ancestors, common, ahead, behind, lca, lca_generation: the histories of heads 1 to 62 beside that of head 0.

    reached is of heads_reached, generations(component, sha, generation) of head
    0.  Commits that the same heads reach are counted together first.  Heads
    that reach nothing have no row.
    """
    ours = F.col("bits").bitwiseAND(F.lit(1)) == 1
    lowest = F.min(F.when(ours, F.struct((-F.col("generation")).alias("up"), "sha"))).alias("lowest")
    alike = reached.join(generations.select(component, "sha", "generation"), [component, "sha"], "left").groupBy(component, "bits").agg(F.count("*").alias("n"), lowest)
    bit = F.explode(F.filter(F.sequence(F.lit(1), F.lit(HEADS - 1)), lambda k: F.getbit("bits", k) == 1)).alias("bit")
    common = F.sum(F.when(ours, F.col("n")).otherwise(0)).alias("common")
    each = alike.select("*", bit).groupBy(component, "bit").agg(F.sum("n").alias("ancestors"), common, F.min("lowest").alias("lowest"))
    base = alike.where(ours).groupBy(component).agg(F.sum("n").alias("own"))
    ahead, behind = F.col("ancestors") - F.col("common"), F.coalesce("own", F.lit(0)) - F.col("common")
    return each.join(base, component, "left").select(component, "bit", "ancestors", "common", ahead.alias("ahead"), behind.alias("behind"), F.col("lowest.sha").alias("lca"), (-F.col("lowest.up")).alias("lca_generation"))


def presence(dag: DataFrame, edges: DataFrame, repos: DataFrame, sha: Column) -> DataFrame:
    """repo, state, generation: whether each repository holds a commit, and in its head's history."""
    there = dag.where(F.col("sha") == sha).select("repo", "generation")
    asked = repos.join(there, "repo", "left_semi").where("head IS NOT NULL").select("repo", F.col("head").alias("sha"), sha.alias("target"))
    inside = reaches(dag, edges, asked).where("reached").select("repo", F.lit(True).alias("inside"))
    state = F.when(F.col("generation").isNull(), "no").when(F.col("inside"), "in HEAD").otherwise("in pack")
    return repos.select("repo").join(there, "repo", "left").join(inside, "repo", "left").select("repo", state.alias("state"), "generation")
