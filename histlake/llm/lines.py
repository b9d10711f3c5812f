"""Line dedup with DataFrame operations only.

Lines are exploded with their positions, their normalised keys hashed (128
bits), and the documents of each hash counted; a hash found in several
documents loses its lines except in the smallest document that holds it.

The first aggregate is partial before its shuffle (smallest and largest
document of a hash), so a line that a third of all documents hold is one row
for each task.  Texts are shuffled once, to meet the positions they lose;
reassembly slices between those positions, so it is linear in the lines.

Defined cases: null or empty text is one empty line; a null id counts as a
document before all others; repeated rows of one id are one document and give
repeated results; an empty table gives an empty result; other columns are kept
by ``drop_lines`` as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, dealt, table

SALTS = 8
#: A run of characters that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACE_CHARS)), UPPER, LOWER)


def _hashed_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """doc_id, pos, h1, h2 of the lines whose keys are long enough."""
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`"), F.lit(-(1 << 63)).cast("long")).alias("doc_id"), F.posexplode(lines(F.col(f"`{text_col}`"))).alias("pos", "line"))
    keys = rows.select("doc_id", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select("doc_id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def dropped_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """doc_id, dropped: the sorted positions of the lines that documents lose."""
    hashed = _hashed_lines(docs, id_col, text_col, min_chars)
    if min_docs == 2:
        shared = hashed.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc < last_doc")
    else:
        held = hashed.select("h1", "h2", "doc_id").distinct()
        shared = held.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).where(F.col("n") >= min_docs)
    # lines look their hash up in parts, so that a hash of very many lines is no single task's; AQE splits them further
    salted = hashed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALTS)).cast("int"))
    lost = salted.join(dealt(shared.select("h1", "h2", "first_doc"), SALTS), ["h1", "h2", "salt"]).where("doc_id > first_doc")
    return lost.groupBy("doc_id").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def _without(all_lines: Column, dropped: Column) -> Column:
    """The lines between the dropped positions, in one pass."""
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.try_element_at(dropped, F.greatest(i, F.lit(1))))
    after = lambda i: F.coalesce(F.try_element_at(dropped, i + 1), F.size(all_lines))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(dropped)), lambda i: F.slice(all_lines, before(i) + 2, after(i) - before(i) - 1)))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2, details: bool = False, least_words: int = 0) -> DataFrame:
    """The documents with their repeated lines dropped.

    With ``details``: doc_id, n_lines, n_dropped and text only.  Documents that
    lose lines and are left with fewer than ``least_words`` words go.
    """
    lost = dropped_positions(docs, id_col, text_col, min_chars, min_docs).toDF("__doc", "__dropped")
    source = docs if not details else docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    id_col, text_col = ("doc_id", "text") if details else (id_col, text_col)
    joined = source.join(lost, F.coalesce(F.col(f"`{id_col}`"), F.lit(-(1 << 63)).cast("long")) == F.col("__doc"), "left")
    split = joined.withColumn("__lines", lines(F.col(f"`{text_col}`")))
    text = F.when(F.col("__dropped").isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(_without(F.col("__lines"), F.col("__dropped")), "\n"))
    if least_words:
        split = split.where(F.col("__dropped").isNull() | (F.regexp_count(text, F.lit(WORD)) >= least_words))
    if details:
        return split.select("doc_id", F.size("__lines").cast("long").alias("n_lines"), F.coalesce(F.size("__dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(text, F.lit("")).alias("text"))
    return split.withColumn(text_col, text).select(*docs.columns)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_lines(table(spark, sf_dir, "documents"), details=True)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
shared AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT keyed.doc_id, pos, line, coalesce(keyed.doc_id > first_doc, false) AS gone
  FROM keyed LEFT JOIN shared ON keyed.k = shared.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
