"""Deltas that end at an id which their pack does not hold or cannot tell: a fixpoint of joins with their bases.

A thin pack lacks bases, and a large pack without an index, read in parts, knows
no ids; what they leave open is listed by the data source "git_open_deltas".  A
delta on an id is a root; the deltas that stand on it in its pack are its
family, which its part held together already.  Each round joins the roots to
their bases by id, makes whole families of them, and names the results, which
may be bases of other families.  So there are as many rounds as a chain goes
from one pack to another, not as it has deltas.  What then has no base is
returned too: it is told, not dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histlake.plans.shared import written
from histlake.schema import OBJECTS
from histlake.sources import packfmt

FAMILY = ["repo", "pack_id", "root"]
TYPES = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
NAMES = ["repo", "storage", "pack_id", "offset", "sha", "kind", "size", "content"]
#: Bytes of objects in a batch.
BATCH_BYTES = 8 << 20


def _made(ready: DataFrame) -> DataFrame:
    """The objects of whole families; a root has its base's kind and content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, kind, held = None, None, {}
        out, size = [], 0
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in (*FAMILY, "offset", "base_offset", "delta", "kind", "content"))
            for repo, pack, root, offset, base, delta, root_kind, content in zip(*columns, strict=True):
                if family != (repo, pack, root):
                    family, kind, held = (repo, pack, root), root_kind, {}
                made = packfmt.apply_delta(content if base is None else held[base], delta)
                held[offset] = made
                out.append((repo, "pack", pack, offset, packfmt.object_id(kind, made), kind, len(made), made))
                size += len(made)
                if size >= BATCH_BYTES:
                    yield _batch(out)
                    out, size = [], 0
        if out:
            yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES)

    ordered = ready.repartition(*FAMILY).sortWithinPartitions(*FAMILY, "level", "offset")
    return ordered.select(*FAMILY, "offset", "base_offset", "delta", "kind", "content").mapInArrow(run, OBJECTS)


def resolve(open_: DataFrame, bases: Callable[[DataFrame], DataFrame], folder: str) -> tuple[DataFrame | None, DataFrame]:
    """The objects that open deltas make (None where there are none), and the deltas that stay open.

    bases(ids): the objects of a table of ids (sha) that are known without
    these deltas, once each.
    """
    rest = written(open_, f"{folder}/open-0")
    made: list[DataFrame] = []
    if rest.isEmpty():
        return None, rest
    known = bases(rest.where("level = 0").select(F.col("base_sha").alias("sha")).distinct())
    while True:
        step = len(made) + 1
        known = known.select(F.col("sha").alias("base_sha"), "kind", "content")
        roots = written(rest.where("level = 0").join(known, "base_sha").select(*FAMILY, F.lit(0).alias("level"), "kind", "content"), f"{folder}/roots-{step}")
        if roots.isEmpty():
            break
        ready = rest.join(roots.select(*FAMILY), FAMILY, "left_semi").join(roots, [*FAMILY, "level"], "left")
        made.append(written(_made(ready), f"{folder}/made-{step}"))
        rest = written(rest.join(roots.select(*FAMILY), FAMILY, "left_anti"), f"{folder}/open-{step}")
        if rest.isEmpty():
            break
        known = made[-1].join(rest.select(F.col("base_sha").alias("sha")), "sha", "left_semi").dropDuplicates(["sha"])
    return (reduce(DataFrame.union, made) if made else None), rest
