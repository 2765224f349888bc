"""What the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.components import components
from ..shared import new_path, shared_dir, written
from ..shared import settle as cut

__all__ = ["WS_CLASS", "WS_RUN", "among", "components", "cut", "dealt", "documents", "fresh", "let", "model_path", "n_words", "positions", "shared_dir", "written"]

#: The white space of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
WS_CLASS = r"\x20\x09-\x0D"
WS_RUN = rf"[{WS_CLASS}]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """The vocabulary file `name` of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df, written as Parquet in the shared folder in buckets by keys: joins on them don't shuffle it again."""
    spark, name = df.sparkSession, f"dealt_{uuid.uuid4().hex}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortBy(*keys).option("path", new_path(spark)).saveAsTable(name)
    return spark.table(name)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def n_words(text: Column) -> Column:
    """How many maximal runs of other characters than white space; null has none. Makes one short string, no array."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), rf"[{WS_CLASS}]+|([^{WS_CLASS}])[^{WS_CLASS}]*", "$1")).cast("long")


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def among(values: Column, x: Column) -> Column:
    """Whether x is in a sorted array, by halving: so looking up as many x as there are values costs little more than their number."""
    halves = F.transform(F.sequence(F.ceil(F.log2(F.size(values) + 1)).cast("int"), F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2), k).cast("int"))
    last = let(x, lambda h: F.struct(h.alias("h"), F.aggregate(halves, F.lit(-1), lambda at, half: F.when(F.get(values, at + half) <= h, at + half).otherwise(at)).alias("at")))
    return let(last, lambda found: F.coalesce(F.get(values, found["at"]) == found["h"], F.lit(False)))


def positions(df: DataFrame, *order: Column) -> DataFrame:
    """df with `position`, its rank from 0 in a total order, without sending all rows to one task: sorted in ranges, each range adding the sizes of those before it."""
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("__range"), F.monotonically_increasing_id().alias("__at")))
    sizes = placed.groupBy("__range").agg(F.count("*").alias("__n"))
    # One row for each range, so one task may hold them.
    so_far = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("__range", F.coalesce(F.sum("__n").over(so_far), F.lit(0)).alias("__before"))
    in_range = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(before, "__range").select(*df.columns, (F.col("__before") + in_range).alias("position"))
