"""Quality rules: counts within a document, and lines that a host repeats across its documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CLASS, WS_RUN, among, cut, fresh, let, n_words

#: A line is repeated by its host if over MIN_DOCS of the host's documents have it, and over MAX_SHARE of them or over MAX_DOCS, which doesn't grow with the host.
MIN_DOCS = 20
MAX_SHARE = 0.1
MAX_DOCS = 1_000
#: A document is depleted if repeated lines hold over this share of its words.
MAX_LOST = 0.5
#: Repeated lines up to this number are broadcast; more are joined by shuffle.
BROADCAST_LINES = 200_000


def line_table(text: Column) -> Column:
    """array of (h, w) for the lines with a word: a hash of the line in lower case with single blanks, and its words."""
    blanks = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09\x0B-\x0D]+", " ")
    lines = F.filter(F.transform(F.split(blanks, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("w")))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(rf"[^{WS_CLASS}]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(text: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more, the first included. Windows are compared by 64-bit hash."""
    words = F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WS_RUN, " ")), " ", -1)
    at = lambda a, i: F.get(a, i)

    def covered(starts: Column) -> Column:
        """Each window covers three words, or as many as lie before the next one."""
        gaps = F.transform(starts, lambda x, j: F.least(F.lit(3), F.coalesce(at(starts, j + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def of_sorted(s: Column) -> Column:
        again = F.filter(s, lambda x, j: (F.coalesce(at(s, j - 1)["h"] == x["h"], F.lit(False)) & (j > 0)) | F.coalesce(at(s, j + 1)["h"] == x["h"], F.lit(False)))
        return let(F.array_sort(F.transform(again, lambda x: x["i"])), covered)

    def of_hashes(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(pairs, of_sorted))

    def of_words(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(at(w, i), at(w, i + 1), at(w, i + 2)))
        return F.when(F.size(w) < 3, 0).otherwise(let(hashes, of_hashes))

    return let(words, of_words).cast("long")


def quality_rules(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_lost: float = MAX_LOST, max_docs: int = MAX_DOCS, copies: bool = True) -> DataFrame:
    """One row for each row of docs(doc_id, text, source): doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, then lost_words, repeated (hashes of its lines that its host repeats) and text_hash.

    base_failed: under 50 words, or over half of them in 3-word windows that occur twice. A line is removed if over
    `min_docs` documents of the host (source; null is a host too) have it and they are over `max_share` of the
    host's documents, or more than `max_docs`. Every row is a document; without `copies`, rows of a host with equal
    texts count as one, so that copying a document doesn't condemn its lines. A document is kept if it hasn't failed
    and removed lines hold at most `max_lost` of its words. null counts as empty; rows without or with one doc_id
    are judged each for itself. Other columns are ignored.

    Texts are read once. What goes on is a narrow table in the shared folder: counts, and hash and words of each
    line. Lines are counted by (host, line) with partial sums, so no frequent line gathers.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    base = cut(
        docs.select(
            "doc_id", F.col("source").alias("host"), n_words(t).alias("n_words"), F.length(F.regexp_replace(t, WS_RUN, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"), n_dup_lines(t).alias("n_dup_lines"), n_repeat_words(t).alias("n_repeat_words"),
            F.xxhash64(t).alias("text_hash"), line_table(t).alias("lines"),
        ).withColumn("uid", F.monotonically_increasing_id())
    )
    each = base.select("host", "text_hash", F.explode(F.array_distinct("lines.h")).alias("h"))
    if copies:
        per_host = base.groupBy("host")
    else:
        per_host = base.groupBy("host", "text_hash").agg(F.lit(1).alias("one")).groupBy("host")
        each = each.groupBy("host", "h", "text_hash").agg(F.lit(1).alias("one"))
    # Kept before the join, which can then split the lines of a large host.
    per_host = cut(per_host.agg(F.count("*").alias("n_docs")).withColumnRenamed("host", "host_"))
    counted = each.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > min_docs)
    over = (F.col("n") > F.col("n_docs") * max_share) | (F.col("n") > max_docs)
    often = cut(counted.join(per_host, F.col("host").eqNullSafe(F.col("host_"))).where(over).select(F.col("host").alias("often_host"), F.col("h").alias("often_h")))
    often = F.broadcast(often) if often.count() <= BROADCAST_LINES else often
    lost = (
        base.select("uid", "host", F.inline("lines"))
        .join(often, F.col("host").eqNullSafe(F.col("often_host")) & (F.col("h") == F.col("often_h")))
        .groupBy("uid").agg(F.sum("w").alias("lost_words"), F.collect_set("h").alias("repeated"))
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    lost_words = F.coalesce("lost_words", F.lit(0))
    return base.join(lost, "uid", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (lost_words <= F.col("n_words") * max_lost)).alias("kept"),
        lost_words.cast("long").alias("lost_words"), F.coalesce("repeated", F.array().cast("array<bigint>")).alias("repeated"), "text_hash",
    )


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The rows of docs that quality_rules keeps, without the lines that their hosts repeat; columns as in docs."""
    key, id_, gone = fresh(docs, "__text_hash"), fresh(docs, "__id"), fresh(docs, "__repeated")
    verdicts = quality_rules(docs, **limits).where("kept")
    # Rows with one doc_id and one text but different hosts may differ; any of their verdicts may serve, so take the mildest.
    verdicts = verdicts.groupBy(F.col("doc_id").alias(id_), F.col("text_hash").alias(key)).agg(F.array_sort(F.min_by("repeated", F.size("repeated"))).alias(gone))
    text = F.array_join(F.filter(F.split("text", "\n", -1), lambda x: ~among(F.col(gone), F.xxhash64(F.trim(F.regexp_replace(F.lower(x), r"[\x20\x09\x0B-\x0D]+", " "))))), "\n")
    joined = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit("")))).join(verdicts.withColumnRenamed(key, key + "v"), F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(key + "v")))
    return joined.select([F.when(F.size(gone) > 0, text).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in docs.columns])
