"""Importance resampling towards a target distribution: array-scored weights, exact ranks by regular sampling."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, written

#: A-Z become lower case; what isn't a digit, a letter or a byte beyond ASCII becomes a blank.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
SLICE = 1 << 20  # bytes of a text that are split into words at once
MEMO = 1_000_000  # words whose bucket a task remembers
#: Segments are so many at most, and each gives so many samples on average: that bounds what reaches the driver.
MOST_SEGMENTS, SAMPLES = 10_000, 16


def _slices(text: bytes):
    """text in pieces of about SLICE bytes, cut where no word is."""
    at = 0
    while len(text) - at > SLICE:
        stop = re.compile(rb"(?s).[\x00-\x2f:-@\[-`{-\x7f]").search(text, at + SLICE - 1)
        if stop is None:
            break
        yield text[at : stop.end()]
        at = stop.end()
    yield text[at:] if at else text


class _Buckets(dict):
    """word -> its bucket."""

    def __init__(self, n: int):
        self.n = n

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        found = self[word] = zlib.crc32(word) % self.n
        return found

    def of(self, text: bytes, longest: int) -> tuple[int, list[np.ndarray]]:
        """The number of words, and the buckets of all runs of 1 to `longest` words."""
        n, found, tail = 0, [], []
        for piece in _slices(text):
            words = piece.translate(LOWER).split()
            n += len(words)
            found.append(np.fromiter(map(self.__getitem__, words), np.int32, len(words)))
            if longest > 1:
                tail += words
                for size in range(2, longest + 1):
                    # Runs that end in this piece: those within what was left of earlier pieces are counted already.
                    first = max(0, len(tail) - len(words) - size + 1)
                    found.append(np.array([zlib.crc32(b" ".join(tail[i : i + size])) % self.n for i in range(first, len(tail) - size + 1)], np.int32))
                tail = tail[-(longest - 1) :]
        return n, found


def features(df: DataFrame, n_buckets: int, longest: int) -> DataFrame:
    """df(doc_id, text) as doc_id, n_words, n_features and buckets, the features' buckets as packed unsigned integers."""
    kind = np.uint16 if n_buckets <= 1 << 16 else np.uint32

    def run(batches):
        memo = _Buckets(n_buckets)
        for batch in batches:
            words, sizes, packed = [], [], []
            for text in batch.column(1).cast(pa.large_binary()):
                n, found = memo.of(text.as_py() or b"", longest)
                words.append(n)
                sizes.append(sum(map(len, found)))
                packed.append(np.concatenate(found).astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "n_words", "n_features", "buckets"])

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, buckets binary")


def _packed(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """All integers of a column of packed arrays, and where each row's begin."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind), np.cumsum([0, *map(len, rows)]) // np.dtype(kind).itemsize


def bucket_counts(table: DataFrame, n_buckets: int) -> np.ndarray:
    """How many features fall in each bucket. Every task counts in an array and sends a row for each bucket; n_buckets sums reach the driver."""
    kind = np.uint16 if n_buckets <= 1 << 16 else np.uint32

    def run(batches):
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            total += np.bincount(_packed(batch.column(0), kind)[0], minlength=n_buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["bucket", "n"])

    found = np.zeros(n_buckets, np.int64)
    for r in table.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        found[r.bucket] = r.n
    return found


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a weight: thousandths of the log of target frequency over corpus frequency, both with one more feature in each bucket."""
    n, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def _noise(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(table: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """features() with weight and score in place of the buckets: gains are looked up for a whole batch at once and added up by document."""
    kind = np.uint16 if len(gain) <= 1 << 16 else np.uint32

    def run(batches):
        for batch in batches:
            buckets, at = _packed(batch.column(3), kind)
            so_far = np.concatenate([[0], np.cumsum(gain[buckets])])
            weight = so_far[at[1:]] - so_far[at[:-1]]
            score = weight + np.array([_noise(d, seed) for d in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64()), pa.array(score, pa.int64())], ["doc_id", "n_words", "n_features", "weight", "score"])

    return table.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


ORDER = ["__down", "doc_id", "n_features", "__row"]


def _key(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The columns of ORDER; a null id is the last."""
    column = lambda c: batch.column(batch.schema.get_field_index(c))
    return [column(c).fill_null((1 << 63) - 1).to_numpy(zero_copy_only=False) for c in ORDER]


def _samples(runs: DataFrame, step: int) -> list[tuple]:
    """Every step-th key of each sorted run."""

    def run(batches):
        seen = 0
        for batch in batches:
            at = np.arange((step // 2 - seen) % step, batch.num_rows, step)
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(k[at]) for k in _key(batch)], list("abcd"))

    return sorted(map(tuple, runs.mapInArrow(run, "a long, b long, c long, d long").collect()))


def _in_segments(runs: DataFrame, splitters: list[tuple]) -> DataFrame:
    """runs with __segment, the number of splitters up to the row's key."""
    first = np.array([s[0] for s in splitters], np.int64)

    def run(batches):
        for batch in batches:
            key = _key(batch)
            low, high = np.searchsorted(first, key[0], "left"), np.searchsorted(first, key[0], "right")
            segment = low.astype(np.int64)
            for i in np.flatnonzero(low < high):
                segment[i] = bisect_right(splitters, tuple(int(k[i]) for k in key), int(low[i]), int(high[i]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment)], [*batch.schema.names, "__segment"])

    schema = ", ".join(f"{c} {t}" for c, t in runs.dtypes)
    return runs.mapInArrow(run, f"{schema}, __segment long")


def top_ranks(rows: DataFrame, percent: int) -> DataFrame:
    """rows(doc_id, n_features, weight, score) with rank from 1 for the floor(percent * N / 100) highest scores, ties to smaller doc_id, and null for the others.

    Parallel sorting by regular sampling. Each partition is sorted where it is; every so-many-th key of each run goes
    to the driver (MOST_SEGMENTS * SAMPLES keys or so at most) and gives regular splitters; segments between them are counted;
    those that hold ranks to give are exchanged, one a partition, and merged there; the counts of the segments
    before make local places exact ranks. Segments beyond the last rank are not exchanged. Of equal ids with equal
    scores the fewer features come first, and rows that agree in all that are told apart by their place, so no group
    of equal rows falls into one segment.
    """
    spark, columns = rows.sparkSession, rows.columns
    runs = cut(rows.withColumns({"__down": -F.col("score"), "__row": F.monotonically_increasing_id()}).sortWithinPartitions(F.col("__down"), F.col("doc_id").asc_nulls_last(), "n_features", "__row"))
    n = runs.count()
    drawn = percent * n // 100
    n_segments = min(MOST_SEGMENTS, int(spark.conf.get("spark.sql.shuffle.partitions")) * max(1, 100 // max(1, percent)))
    samples = _samples(runs, max(1, n // (n_segments * SAMPLES)))
    splitters = sorted({samples[len(samples) * i // n_segments] for i in range(1, n_segments)}) if samples else []
    placed = _in_segments(runs, splitters)
    sizes = dict(placed.groupBy("__segment").count().collect())
    before, total = {}, 0
    for s in sorted(sizes):
        if total >= drawn:
            break
        before[s], total = total, total + sizes[s]
    last = max(before, default=-1)

    def run(batches):
        segment = place = None
        for batch in batches:
            own, ranks = batch.column(batch.schema.get_field_index("__segment")).to_pylist(), []
            for s in own:
                if s != segment:
                    segment, place = s, before[s]
                place += 1
                ranks.append(place if place <= drawn else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(ranks, pa.int64())], [*columns, "rank"])

    first = placed.where(F.col("__segment") <= last).repartitionById(max(1, last + 1), F.col("__segment").cast("int"))
    merged = first.sortWithinPartitions("__segment", "__down", F.col("doc_id").asc_nulls_last(), "n_features", "__row")
    ranked = merged.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", rank long")
    return ranked.unionByName(placed.where(F.col("__segment") > last).select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, n_buckets: int = 10_000, longest: int = 1, seed: int = 2024, least_words: int = 20, percent: int = 10) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_features, weight, score, rank, all long.

    Words are runs of letters and digits of ASCII (A-Z lower-cased) and of all other characters beyond ASCII;
    features are the runs of 1 to `longest` words, hashed into n_buckets. A document's weight is how much likelier
    its features are in target(text) than in docs (see gains); score adds Gumbel noise drawn from seed and doc_id,
    so that the highest scores are a sample without replacement by weight. Of the documents with `least_words` words
    the highest `percent` % have a rank (see top_ranks).

    null texts and texts without words have no features and weight 0. A null doc_id is hashed as the empty text and
    is the last of a tie; repeated rows are ranked one by one. Empty tables give empty ones, an empty target weighs by
    how rare a document's features are. Other columns of docs and target are ignored.

    Texts are read once, in slices; their features are kept in the shared folder as packed buckets, a third of the
    text's size, from which counts, weights and scores come. n_buckets sums are all that the driver holds of them.
    """
    table = written(features(docs.select("doc_id", "text"), n_buckets, longest))
    wanted = features(target.select(F.lit(0).alias("doc_id"), "text"), n_buckets, longest)
    gain = gains(bucket_counts(table, n_buckets), bucket_counts(wanted, n_buckets))
    rows = written(scored(table, gain, seed))
    columns = ["doc_id", "n_features", "weight", "score"]
    few = rows.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    return top_ranks(rows.where(F.col("n_words") >= least_words).select(columns), percent).unionByName(few)
