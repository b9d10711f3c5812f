"""Duplicated blocks of lines: windows of consecutive lines that occur again.

Windows are cut inside each file's array of lines.  ``groups`` goes two rounds:
windows are counted by a hash of their text, and only those whose hash repeats
are shuffled with it and grouped, by the text itself.  Of a group's places the
first ones are kept, cut down before they are shuffled; so no window gathers
more than that, however often it occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from histlake.functions import comments, objects
from histlake.plans.shared import shared_folder, written

MIN_LINES = 3
LEAST_FILLED_TENTHS = 6
LEAST_CHARS = 25
#: Places of a window that are listed.
PLACES = 100


def windows(files: DataFrame, min_lines: int = MIN_LINES, strip: bool = True, filters: bool = True) -> DataFrame:
    """path, start_line (from 1), window: min_lines consecutive lines of files (path, text).

    Lines lose comments (with strip) and white space at their ends.  With
    filters, a window begins with a filled line, is filled to six tenths at
    least and holds 25 characters or more besides white space.
    """
    n = max(2, min_lines) if strip or filters else min_lines
    lines = F.split("text", "\n", -1)
    lines = comments.stripped(lines) if strip else lines
    cut = files.select("path", lines.alias("lines")).select("path", F.transform("lines", lambda x: F.btrim(x, F.lit(objects.LINE_SPACE))).alias("lines"))
    starts = F.when(F.size("lines") >= n, F.sequence(F.lit(1), F.size("lines") - (n - 1))).otherwise(F.array().cast("array<int>"))
    if filters:
        starts = F.filter(starts, lambda i: F.element_at("lines", i) != "")
    each = cut.select("path", "lines", F.explode(starts).alias("start_line")).select("path", "start_line", F.slice("lines", F.col("start_line"), n).alias("part"))
    if filters:
        filled = F.size(F.filter("part", lambda x: x != ""))
        chars = F.char_length(F.regexp_replace(F.array_join("part", ""), r"[ \t\n\f\r]", ""))
        each = each.where((filled * 10 >= n * LEAST_FILLED_TENTHS) & (chars >= LEAST_CHARS))
    return each.select("path", F.col("start_line").cast("long").alias("start_line"), F.array_join("part", "\n").alias("window"))


def groups(cut: DataFrame, min_lines: int = MIN_LINES, most_places: int = PLACES, folder: str | None = None) -> DataFrame:
    """window, line_count, occurrences, wasted, first_path, first_line, places: windows that occur twice or more, with their first places."""
    folder = folder or shared_folder(cut.sparkSession)
    hashed = cut.select("*", F.xxhash64("window").alias("hash"))
    repeated = hashed.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    again = written(hashed.join(repeated, "hash", "left_semi").select("path", "start_line", "window"), f"{folder}/repeated")
    place = F.row_number().over(W.partitionBy("window").orderBy("path", "start_line"))
    listed = again.withColumn("place", place).where(F.col("place") <= most_places)
    listed = listed.groupBy("window").agg(F.array_sort(F.collect_list(F.struct("path", "start_line"))).alias("places"))
    return counted(again, min_lines).join(listed, "window").select("window", F.lit(min_lines).cast("long").alias("line_count"), "occurrences", "wasted", "first_path", "first_line", "places")


def counted(cut: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """The same without places: nothing is gathered, whatever the number of occurrences."""
    found = cut.groupBy("window").agg(F.count("*").alias("occurrences"), F.min(F.struct("path", "start_line")).alias("first")).where("occurrences > 1")
    return found.select("window", "occurrences", (F.lit(min_lines) * (F.col("occurrences") - 1)).cast("long").alias("wasted"), F.col("first.path").alias("first_path"), F.col("first.start_line").alias("first_line"))


def top(found: DataFrame, n: int = 15) -> DataFrame:
    return found.orderBy(F.desc("wasted"), "first_path", "first_line").limit(n)


def stats(files: DataFrame, cut: DataFrame) -> DataFrame:
    """One row: files_scanned, files_skipped, windows, unique_windows; files(path, binary)."""
    f = files.agg(F.count_if(~F.col("binary")).alias("files_scanned"), F.count_if(F.col("binary")).alias("files_skipped"))
    w = cut.groupBy("window").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("windows"), F.count("*").alias("unique_windows"))
    return f.join(w)
