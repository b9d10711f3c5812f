"""The trie of conversation prefixes, by prefix doubling.

Turns get dense names, one for each distinct (role, text).  In each round the
names of two neighbouring blocks of 2**k turns make the name of the block of
2**(k+1) turns that holds both, so the blocks are named in as many rounds as
the longest conversation has binary digits.  A prefix of d turns is composed of
blocks by the binary digits of d: the prefix without the lowest digit, then a
block; from the highest digit to the lowest, one join a round.  Names are
consecutive numbers and equal exactly where the sequences are equal, so a node
of the trie is a group of prefixes of one name.

A round joins half as many rows as the one before, so all rounds together
handle each turn a few times.  Numbers of turns are places in one sorted table,
without a window over a conversation, and what a subtree sums up is a sum over
the prefixes in its top node: each distinct text is counted by the smallest
conversation that holds its node, so no walk through the trie is needed, and
neither a hot node nor a long conversation is one task.

Defined cases: null role or text is empty; turns of equal number are ordered by
role, then text (null numbers first); repeated rows are repeated turns; rows of
a null conv_id belong to no conversation and are left out; an empty table gives
no node, not even the root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, materialise, table, work_dir

#: Conversations lend their opening turns to the others of their hundred; at most five are taken.
CENTURY, MOST_BORROWED = 100, 6
#: Ids of conversations that end at a node travel in strings of 2**ENDS_BITS of them at most.
ENDS_BITS = 12

_PART_BITS = 33


def numbered(df: DataFrame, folder: str, name: str, column: str, after: int = 0) -> tuple[DataFrame, int]:
    """df, written below the folder, with a column of consecutive numbers from after + 1 on, in the order of its partitions; and the last number.

    Only the number of rows of each partition passes through the driver.
    """
    spark = df.sparkSession
    raw = materialise(df.withColumn("__id", F.monotonically_increasing_id()), folder, name)
    part = F.shiftright("__id", _PART_BITS)
    counts = sorted(tuple(r) for r in raw.groupBy(part.alias("p")).count().collect())
    firsts = ["(-1L, 0L)"]
    for p, n in counts:
        firsts.append(f"({p}L, {after + 1}L)")
        after += n
    # a row a partition: no more than there are tasks
    begun = F.broadcast(spark.sql(f"SELECT * FROM VALUES {', '.join(firsts)} AS t(__part, __first)"))
    number = F.col("__id").bitwiseAND((1 << _PART_BITS) - 1) + F.col("__first")
    return raw.join(begun, part == F.col("__part")).select(*df.columns, number.alias(column)), after


def ordered_turns(conversations: DataFrame, folder: str) -> DataFrame:
    """conv_id, place, key, chars: a turn's place among all turns of all conversations, sorted; its key is a digest of role and text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("text")).where("conv_id IS NOT NULL")
    order = ("conv_id", "turn", "role", "text")
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return numbered(rows.select("conv_id", key.alias("key"), F.char_length("text").cast("long").alias("chars")), folder, "turns", "place")[0]


def lengths(turns: DataFrame) -> DataFrame:
    """conv_id, begin, n: where the turns of each conversation begin, and how many there are."""
    return turns.groupBy("conv_id").agg(F.min("place").alias("begin"), F.count("*").alias("n"))


def as_they_are(turns: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """prefix_trie's arguments for conversations as they stand."""
    convs = materialise(lengths(turns), folder, "conversations")
    rows = turns.join(convs, "conv_id").select("conv_id", (F.col("place") - F.col("begin")).alias("j"), "key", "chars")
    return rows, convs.select("conv_id", F.col("n").alias("length"))


def with_borrowed_openings(turns: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """prefix_trie's arguments for conversations whose first h turns are replaced by those of the first of their hundred.

    h is the id's checksum modulo 6; the first of a hundred keeps its own turns.
    """
    known = materialise(lengths(turns), folder, "lengths")
    donor = F.col("conv_id") - F.col("conv_id") % CENTURY
    h = F.when(donor == F.col("conv_id"), F.lit(0)).otherwise(F.crc32(F.col("conv_id").cast("string")) % MOST_BORROWED).cast("long")
    lent = known.select(F.col("conv_id").alias("donor"), F.col("n").alias("lent")).where(f"donor % {CENTURY} = 0")
    convs = known.select("*", donor.alias("donor"), h.alias("h")).join(lent, "donor", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("lent", F.lit(0).cast("long"))))
    convs = materialise(convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long"))), folder, "conversations")
    rows = turns.join(convs.select("conv_id", "begin", "h", "taken"), "conv_id").withColumn("at", F.col("place") - F.col("begin"))
    own = rows.where("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("j"), "key", "chars")
    openings = rows.where(f"conv_id % {CENTURY} = 0 AND at < {MOST_BORROWED - 1}").select(F.col("conv_id").alias("donor"), F.col("at").alias("j"), "key", "chars")
    asked = convs.where("taken > 0").select("conv_id", "donor", F.explode(F.sequence(F.lit(0).cast("long"), F.col("taken") - 1)).alias("j"))
    borrowed = asked.join(openings, ["donor", "j"]).select("conv_id", "j", "key", "chars")
    return own.unionByName(borrowed), convs.select("conv_id", "length")


def _named(pairs: DataFrame, keys: list[str], folder: str, name: str, after: int = 0) -> tuple[DataFrame, int]:
    """The rows with a dense name for each distinct value of the keys in their place, written; and the last name."""
    names, last = numbered(pairs.select(*keys).distinct(), folder, f"{name}_names", "name", after)
    rest = [c for c in pairs.columns if c not in keys]
    return materialise(pairs.join(names, keys).select(*rest, "name"), folder, name), last


def block_names(turns: DataFrame, folder: str) -> list[DataFrame]:
    """For k = 0, 1, ...: conv_id, j, name, chars, last of the blocks of 2**k turns that begin at turn j * 2**k.

    chars counts the whole block, last its last turn.
    """
    first = materialise(turns.select("conv_id", "j", "key", "chars", F.col("chars").alias("last")), folder, "rows")
    if first.isEmpty():
        return []
    levels = [_named(first, ["key"], folder, "blocks0")[0]]
    while True:
        k = len(levels)
        odd = F.col("j").bitwiseAND(1) == 1
        halves = (F.max(F.when(~odd, F.col("name"))).alias("a"), F.max(F.when(odd, F.col("name"))).alias("b"))
        joined = levels[-1].groupBy("conv_id", F.shiftright("j", 1).alias("j")).agg(*halves, F.sum("chars").alias("chars"), F.max(F.when(odd, F.col("last"))).alias("last"))
        pairs = materialise(joined.where("a IS NOT NULL AND b IS NOT NULL"), folder, f"pairs{k}")
        if pairs.isEmpty():
            return levels
        levels.append(_named(pairs, ["a", "b"], folder, f"blocks{k}")[0])


def prefix_names(levels: list[DataFrame], folder: str) -> DataFrame | None:
    """conv_id, depth, name, upto, last of all prefixes of a turn or more; upto counts the characters of a prefix, last those of its last turn."""
    done: list[DataFrame] = []
    after = 0
    for k in reversed(range(len(levels))):
        # the prefixes whose number of turns has 2**k as its lowest digit
        ends = levels[k].where(F.col("j").bitwiseAND(1) == 0).select("conv_id", F.shiftleft("j", k).alias("before"), F.col("name").alias("b"), "chars", "last")
        depth = (F.col("before") + (1 << k)).alias("depth")
        if done:
            shorter = reduce(DataFrame.unionByName, done).select("conv_id", F.col("depth").alias("before"), F.col("name").alias("a"), "upto")
            zero = F.lit(0).cast("long")
            pairs = ends.join(shorter, ["conv_id", "before"], "left").select("conv_id", depth, F.coalesce("a", zero).alias("a"), "b", (F.coalesce("upto", zero) + F.col("chars")).alias("upto"), "last")
        else:
            pairs = ends.select("conv_id", depth, F.lit(0).cast("long").alias("a"), "b", F.col("chars").alias("upto"), "last")
        named, after = _named(materialise(pairs, folder, f"composed{k}"), ["a", "b"], folder, f"prefixes{k}", after)
        done.append(named)
    return reduce(DataFrame.unionByName, done) if done else None


def ends_digests(ends: DataFrame) -> DataFrame:
    """name, ends_sha256 of rows (name, conv_id): the digest of a name's ids, ascending, joined by commas.

    Ids are packed into strings in many tasks; a task reads the strings of a
    name one by one, in order, and keeps only the digest's state.
    """
    chunk = F.shiftright("conv_id", ENDS_BITS)
    packed = ends.groupBy("name", chunk.alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            names, digests = [], []
            for name, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if name == now:
                    state.update(b"," + ids.encode())
                    continue
                if state is not None:
                    names.append(now)
                    digests.append(state.hexdigest())
                now, state = name, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(digests, pa.string())], names=["name", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["name", "ends_sha256"])

    return packed.repartition("name").sortWithinPartitions("name", "chunk").select("name", "ids").mapInArrow(run, "name long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, folder: str) -> DataFrame:
    """The nodes of the trie: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, j (from 0, without gaps), key, chars; convs: conv_id and
    length of every conversation, the empty ones too.
    """
    spark = turns.sparkSession
    least = convs.agg(F.min("conv_id")).first()[0]
    schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if least is None:
        return spark.createDataFrame([], schema)
    prefixes = prefix_names(block_names(turns, folder), folder)
    if prefixes is None:
        prefixes = spark.createDataFrame([], "conv_id long, depth long, name long, upto long, last long")
    nodes = materialise(prefixes.groupBy("name").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.count("*").alias("n_convs")), folder, "nodes")
    # a conversation is the smallest member of its prefixes from one depth on; above, they belong to smaller ones
    tops = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"))
    at_top = tops.join(prefixes.select("conv_id", F.col("depth").alias("top"), (F.col("upto") - F.col("last")).alias("before_top")), ["conv_id", "top"])
    above = tops.select("conv_id", (F.col("top") - 1).alias("depth")).join(prefixes.select("conv_id", "depth", "name"), ["conv_id", "depth"])
    parents = above.join(nodes.select("name", F.col("conv_id").alias("parent")), "name").select("conv_id", "parent")
    tops = materialise(at_top.join(parents, "conv_id", "left").withColumn("parent", F.coalesce("parent", F.lit(least))), folder, "tops")
    parent = F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("parent"))
    placed = materialise(nodes.join(tops, "conv_id").select("name", "conv_id", "depth", "n_convs", parent.alias("parent_conv_id")), folder, "placed")
    children = placed.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    children = materialise(children, folder, "children")

    totals = prefixes.groupBy("conv_id").agg(F.max("upto").alias("total"))
    zero = F.lit(0).cast("long")
    members = convs.join(totals, "conv_id", "left").join(tops, "conv_id", "left").join(children.withColumnRenamed("depth", "length"), ["conv_id", "length"], "left")
    leaf = ((F.col("top") <= F.col("length")) & F.col("n_children").isNull()).cast("long")
    # own: the characters of a conversation before the nodes of which it is the smallest member
    members = members.select("conv_id", "length", F.coalesce("before_top", "total", zero).alias("own"), F.coalesce(leaf, zero).alias("leaf"))
    members = materialise(members, folder, "members")

    each = prefixes.join(members, "conv_id").select("name", "leaf", F.greatest(F.col("own") - (F.col("upto") - F.col("last")), zero).alias("saved"))
    sums = each.groupBy("name").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ended = prefixes.join(members.select("conv_id", F.col("length").alias("depth")), ["conv_id", "depth"]).select("name", "conv_id")
    ended = ended.unionByName(members.where("length = 0").select(zero.alias("name"), "conv_id"))
    digests = materialise(ends_digests(ended), folder, "ends")

    root = members.agg(F.count("*").alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.sum("own").alias("saved_tokens"))
    root = root.select(zero.alias("name"), F.lit(least).cast("long").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_leaves", "saved_tokens")
    below = placed.join(sums, "name").select("name", "conv_id", "depth", "parent_conv_id", "n_convs", "n_leaves", "saved_tokens")
    whole = below.unionByName(root).join(children, ["conv_id", "depth"], "left").join(digests, "name", "left")
    leaves = F.when((F.col("depth") == 0) & F.col("n_children").isNull(), F.lit(1).cast("long")).otherwise(F.col("n_leaves"))
    nothing = hashlib.sha256(b"").hexdigest()
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), leaves.alias("n_leaves"), "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark)
    turns = ordered_turns(table(spark, sf_dir, "conversations"), folder)
    found = materialise(prefix_trie(*with_borrowed_openings(turns, folder), folder), work_dir(spark), "trie")
    delete(spark, folder)
    return found


#: crc32 bit by bit, as DuckDB has none: the register after all digits of the decimal id.
_CRC = """
  crc_steps AS (
    SELECT conv_id, decimal_, 0 AS i, 4294967295::BIGINT AS r FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS decimal_ FROM src)
    UNION ALL
    SELECT conv_id, decimal_, i + 1,
           CASE WHEN i % 8 = 0 THEN CASE WHEN xor(r, ascii(substr(decimal_, i // 8 + 1, 1))::BIGINT) & 1 = 1 THEN xor(xor(r, ascii(substr(decimal_, i // 8 + 1, 1))::BIGINT) >> 1, 3988292384) ELSE xor(r, ascii(substr(decimal_, i // 8 + 1, 1))::BIGINT) >> 1 END
                WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END
    FROM crc_steps WHERE i < 8 * length(decimal_))"""

#: From the definition: the text of every prefix, whole; nodes are equal texts; subtrees are the nodes whose text begins with a node's.
OP12_SQL = f"""
WITH RECURSIVE src AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
{_CRC},
borrowing AS (
  SELECT conv_id, conv_id - conv_id % {CENTURY} AS donor,
         CASE WHEN conv_id % {CENTURY} = 0 THEN 0 ELSE xor(r, 4294967295) % {MOST_BORROWED} END AS h
  FROM crc_steps WHERE i = 8 * length(decimal_)),
rebuilt AS (
  SELECT b.conv_id, s.pos AS at_, 0 AS own, s.role, s.text FROM borrowing b JOIN src s ON s.conv_id = b.donor AND s.pos < b.h
  UNION ALL
  SELECT b.conv_id, s.pos, 1, s.role, s.text FROM borrowing b JOIN src s ON s.conv_id = b.conv_id AND s.pos >= b.h),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, at_) AS d, role, text FROM rebuilt),
hashed AS (SELECT conv_id, d, length(text) AS chars, sha256(length(role) || ':' || role || text) AS h FROM turns),
prefixes AS (
  SELECT conv_id, d, chars, string_agg(h, '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM hashed
  UNION ALL SELECT conv_id, 0, 0, '' FROM borrowing),
nodes AS (
  SELECT path, min(conv_id) AS conv_id, d AS depth, count(*)::BIGINT AS n_convs, max(chars) AS chars FROM prefixes GROUP BY path, d),
kids AS (SELECT left(path, length(path) - 64) AS path, count(*)::BIGINT AS n FROM nodes WHERE depth > 0 GROUP BY 1),
full_ AS (SELECT n.*, coalesce(k.n, 0)::BIGINT AS n_children FROM nodes n LEFT JOIN kids k ON k.path = n.path),
sums AS (
  SELECT left(f.path, a.x * 64) AS path, count(*) FILTER (WHERE f.n_children = 0)::BIGINT AS n_leaves, sum((f.n_convs - 1) * f.chars)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS x FROM full_) a JOIN full_ f ON f.path = a.path GROUP BY 1),
ends AS (
  SELECT p.path, string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) AS ids
  FROM prefixes p JOIN (SELECT conv_id, max(d) AS d FROM prefixes GROUP BY conv_id) l ON l.conv_id = p.conv_id AND l.d = p.d GROUP BY p.path)
SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM full_ f JOIN sums s ON s.path = f.path LEFT JOIN ends e ON e.path = f.path
LEFT JOIN nodes p ON f.depth > 0 AND p.path = left(f.path, length(f.path) - 64)
"""
