"""What several operators share: written tables in the shared folder, group joins, null handling."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Batches of 4 MB between JVM and Python, where the session has Spark's own 64 MB."""
    if spark.conf.get(BATCH, "64m") in ("64m", "64MB", "67108864", "67108864b"):
        spark.conf.set(BATCH, "4m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none and all runs here."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="veriloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/veriloom/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back, so that a lost executor costs only its running tasks."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished steps now rather than at its next collection."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def parts(batches, column: int, rows: int = 256, size: int = 1 << 20):
    """Slices of Arrow batches with at most so many rows and, unless one row alone has more, so many bytes of text."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            held = ends[at - 1] if at else 0
            n = int(np.searchsorted(ends, held + size, side="right")) - at
            n = max(1, min(n, rows))
            yield batch.slice(at, n)
            at += n


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, share: int = 2000) -> DataFrame:
    """``rows`` left-joined with one row a group, without one task getting a hot group.

    A group with more than total/share rows is joined by broadcast: fewer than ``share`` groups can be that
    large, whatever the input. The rest meets in a shuffle join; rows already served get spread keys there.
    ``key`` is binary and never null.
    """
    values = [c for c in groups.columns if c != key]
    is_hot = F.col(size) * F.lit(share) > F.lit(total)
    hot = groups.where(is_hot).select(F.col(key).alias("__key"), F.struct(*values).alias("__hot"))
    cold = groups.where(~is_hot).select(F.col(key).alias("__spread"), F.struct(*values).alias("__cold"))
    spread = F.encode(F.concat(F.lit("~"), F.monotonically_increasing_id().cast("string")), "utf-8")
    served = rows.join(F.broadcast(hot), F.col(key) == F.col("__key"), "left").drop("__key")
    served = served.withColumn("__spread", F.when(F.col("__hot").isNotNull(), spread).otherwise(F.col(key)))
    both = served.join(cold, "__spread", "left").withColumn("__group", F.coalesce("__hot", "__cold"))
    return both.select(*rows.columns, *[F.col("__group")[v].alias(v) for v in values])
