"""Streams: tables of objects that grow, searched as new files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histlake.functions import objects, regexes
from histlake.operators.scan import kinds
from histlake.schema import OBJECTS


def object_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of objects below path, as a stream."""
    return spark.readStream.schema(OBJECTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def matching(stream: DataFrame, kind: str, pattern: str, exact: bool = False) -> DataFrame:
    """repo, sha, kind, author_ts of the objects that match, as they come."""
    wanted = regexes.compile(stream.sparkSession, pattern, exact)
    found = stream.where(F.col("kind").isin(kinds(kind))).where(objects.searchable(F.col("kind"), F.col("content")).rlike(wanted))
    ts = F.when(F.col("kind") == "commit", objects.author_ts(objects.text(F.col("content")))).otherwise(F.lit(0).cast("long"))
    return found.select("repo", "sha", "kind", ts.alias("author_ts"))


def commits_by_day(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """repo, day, commits: counts by author day; rows later than the watermark are left out."""
    body = objects.text(F.col("content"))
    times = stream.where("kind = 'commit'").select("repo", F.timestamp_seconds(objects.author_ts(body)).alias("at"))
    return times.withWatermark("at", late).groupBy("repo", F.window("at", "1 day").alias("w")).agg(F.count("*").alias("commits")).select("repo", F.col("w.start").alias("day"), "commits")
