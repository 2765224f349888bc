"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, n_words, positions

#: Sources up to this number are broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 100_000


def source_rates(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """From sizes(source, size): source, source_size, target, rate for each source.

    Sources in code point order (null last) get the weights in turn and share the sum of all sizes by weight. Where
    a share is over `cap` times its source's size it stops there, and what is over is shared again until none is
    above. Sources without words have target and rate 0.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    at = (F.col("position") % len(weights)).cast("int")
    table = cut(positions(per_source, F.col("source").asc_nulls_last()).withColumn("w", F.get(F.array(*map(F.lit, weights)), at)))
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    total, weight = (int(x or 0) for x in table.agg(F.sum("source_size"), F.sum("w")).first())
    full, full_weight = 0, 0  # what the capped sources take, and their weight
    while True:
        above = exact("source_size") * (cap * (weight - full_weight)) < exact("w") * (total - full)
        size, w = (int(x or 0) for x in table.agg(F.sum(F.when(above, F.col("source_size"))), F.sum(F.when(above, F.col("w")))).first())
        if w == full_weight:
            break
        full, full_weight = cap * size, w
    share = F.lit(float(total - full)) * F.col("w") / F.lit(float(max(1, weight - full_weight)))
    target = F.when(above, F.col("source_size") * float(cap)).otherwise(share)
    return table.select("source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


def mix_counts(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: int = 42) -> DataFrame:
    """docs(doc_id, text, source, ...) with the columns size, source_size, target, copies under names that docs lacks (see the last four columns).

    copies is floor(rate) plus one if a number in [0, 1) hashed from seed and doc_id (where it is null: from the text)
    is under the rate's fraction; so reruns agree, and rows with one id get one decision. A text without words
    counts 0 and changes nothing whatever its copies. An empty table gives an empty one.
    """
    size, key = fresh(docs, "size"), fresh(docs, "source_key")
    sized = docs.withColumn(size, n_words(F.col("text")))
    rates = source_rates(sized.select("source", F.col(size).alias("size")), weights, cap)
    rates = cut(rates.withColumnsRenamed({"source": key, "rate": fresh(docs, "rate"), "target": fresh(docs, "target"), "source_size": fresh(docs, "source_size")}))
    rate = F.col(fresh(docs, "rate"))
    small = rates.count() <= BROADCAST_SOURCES
    joined = sized.join(F.broadcast(rates) if small else rates, F.col("source").eqNullSafe(F.col(key)))
    seeded = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col("text"), F.lit(""))))))
    unit = F.conv(F.substring(F.sha2(seeded, 256), 1, 13), 16, 10).cast("double") / float(1 << 52)
    copies = (F.floor(rate) + (unit < rate - F.floor(rate)).cast("long")).cast("long")
    return joined.select(*docs.columns, size, fresh(docs, "source_size"), fresh(docs, "target"), copies.alias(fresh(docs, "copies")))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: int = 42) -> DataFrame:
    """The mixed corpus: every row of docs as often as mix_counts says, with the columns of docs."""
    counted = mix_counts(docs, weights, cap, seed)
    copies = F.col(counted.columns[-1])
    return counted.where(copies > 0).withColumn(fresh(counted, "copy"), F.explode(F.sequence(F.lit(1), copies))).select(docs.columns)
