"""Exact duplicates by digest, with the heavy digests taken out before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WS_RUN, cut


def exact_dedup(docs: DataFrame, tracked: int = 8192, winners: int = 2048) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are after every run of white space becomes one blank; null counts as empty. The row with
    the smallest doc_id stays; null ids come last, and of rows with one id the one read first stays, so that exactly
    one row of a group is kept. keep_id is null only if all ids of the group are. Other columns are ignored.

    Misra-Gries sketches (`tracked` counters each) find digests that may be frequent; at most `winners` of them are
    counted exactly, and the verified ones are broadcast, so that their rows are settled where they are read. With
    `winners` a quarter of `tracked`, any digest with over some 4/`tracked` of all rows is among them. Sketches are
    combined in three steps, of 64, of 64, and of the rest. The other digests meet in an ordinary shuffle,
    whose groups are bounded by that share.
    """
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), WS_RUN, " ")
    rows = cut(docs.select("doc_id", F.sha2(text, 256).alias("digest")).withColumn("row", F.monotonically_increasing_id()))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")

    sketches = rows.groupBy(F.floor(F.spark_partition_id() / 64).alias("g")).agg(F.expr(f"approx_top_k_accumulate(digest, {tracked})").alias("s"))
    sketches = sketches.groupBy(F.floor(F.col("g") / 64).alias("g")).agg(F.expr(f"approx_top_k_combine(s, {tracked})").alias("s"))
    # Grouped by a constant, for combining fails in partitions without a sketch.
    top = sketches.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(s, {tracked}), {winners})").alias("top"))
    likely = top.select(F.inline("top")).where("count > 1").select(F.col("item").alias("digest"))
    heavy = cut(rows.join(F.broadcast(likely), "digest").groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1"))

    marked = rows.join(F.broadcast(heavy), "digest", "left")
    same = Window.partitionBy("digest")
    rest = marked.where("n is null").withColumn("first", F.min(rank).over(same)).withColumn("n", F.count("*").over(same))
    return marked.where("n is not null").unionAll(rest.select(marked.columns)).select("doc_id", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("first.row")).alias("kept"), F.col("digest").alias("text_sha256"))
