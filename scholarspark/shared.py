"""Tables kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: About how many bytes of a table are broadcast by sent.
MOST_SENT = 1 << 24
#: Bits of the filter of may_be_in, which is broadcast in words of 64, 16 MB and what Spark adds to them.
FILTER_BITS = 1 << 25

_scratch: ContextVar[tuple[str, ...]] = ContextVar("scratch", default=())  # folders of the scratch blocks that are open in this thread


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set, a temporary one serves a local session; on a cluster that is an error, for executors couldn't see it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, in a scratch block as Parquet that goes with it; for narrow tables. A lost executor costs nothing but its running tasks."""
    if _scratch.get():
        return written(df)
    shared_dir(df.sparkSession)
    return df.checkpoint()


def settle_in_order(df: DataFrame) -> DataFrame:
    """df kept as settle does, with its partitions and the order of their rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def new_path(spark: SparkSession) -> str:
    """A path for a table in the shared folder, or in that of the innermost scratch block."""
    return f"{blocks[-1] if (blocks := _scratch.get()) else shared_dir(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df, written as Parquet in the shared folder and read again; for wide tables of which later steps read some columns."""
    path = path or new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join by shuffle, whatever the planner expects of its size: rows that come of few compressed bytes, as by explode, would pass for small and be broadcast, all of them through the driver."""
    return df.hint("merge")


def stored(df: DataFrame) -> DataFrame:
    """df, written as written does, and shuffled in joins: for large tables of texts that repeat, which a checkpoint would hold uncompressed."""
    return shuffled(written(df))


def sent(df: DataFrame) -> DataFrame:
    """df, a kept table, for a join: broadcast up to about MOST_SENT bytes by its values, else by shuffle."""
    size = df.agg(F.sum(100 + 2 * F.octet_length(F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns])).cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= MOST_SENT else shuffled(df)


def may_be_in(rows: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """rows without most of those whose columns aren't among keys, for a join on equality that follows: a filter of FILTER_BITS bits, put together by the executors."""
    at = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in columns]), F.lit(FILTER_BITS))
    words = keys.select(at.alias("__at")).groupBy(F.shiftright("__at", 6).alias("__word")).agg(F.expr("bit_or(shiftleft(1L, cast(__at % 64 AS int)))").alias("__bits"))
    met = rows.withColumn("__at", at).withColumn("__word", F.shiftright("__at", 6)).join(F.broadcast(words), "__word").where(F.getbit("__bits", F.col("__at") % 64) == 1)
    return met.select(*rows.columns)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """What is kept within the block goes when it ends; write the block's result before, to a path outside. Blocks of other threads are apart."""
    folder = new_path(spark)
    opened = _scratch.set((*_scratch.get(), folder))
    try:
        yield folder
    finally:
        _scratch.reset(opened)
        removed(spark, folder)
