"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which goes when the application ends.

    Only a local session may lack that setting: all of it runs on this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        base = f"file://{tempfile.gettempdir()}/histlake-checkpoints"
    path = f"{base.rstrip('/')}/histlake-{uuid.uuid4().hex}"
    where, files = _hadoop(spark, path)
    files.mkdirs(where)
    files.deleteOnExit(where)
    return files.makeQualified(where).toString()


def mounted(path: str) -> str:
    """The path under which a shared folder is mounted; only file: ones are."""
    if not path.startswith("file:"):
        raise ValueError(f"{path} is not mounted: set HISTLAKE_STAGING_DIR to a folder that driver and executors mount")
    return "/" + path.removeprefix("file:").lstrip("/")


def written(df: DataFrame, path: str) -> DataFrame:
    """df as a table that was written and is read again: lineage ends here."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Spark's own setting by which shuffle files go when the query that made them has ended, and not when its driver happens to collect garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """written, in less room, and the shuffle files that it took go with it."""
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLES_GO, None)
    conf.set(SHUFFLES_GO, "true")
    try:
        df.write.mode(mode).option("compression", "zstd").parquet(path)
    finally:
        conf.unset(SHUFFLES_GO) if before is None else conf.set(SHUFFLES_GO, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """A work table that nothing reads any more goes before the application ends."""
    where, files = _hadoop(spark, path)
    files.delete(where, True)
