"""Repeated lines, found by two Bloom filters before anything is shuffled."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import among, cut, fresh, written

WHITE = " \t\n\v\f\r"
HASHES = 3
SHARD = 1 << 20  # cells of a shard of the filters
#: Repeated keys up to this number are broadcast; more are joined by shuffle, whose hot keys can be split.
BROADCAST_KEYS = 200_000
FLUSH = 2_000_000  # cells that a task holds before it hands them on
#: Cells for each line, and cells of filters that are broadcast: so many bits, 256 MB here. Larger filters stay in their shards.
CELLS, MAX_CELLS = 16, 1 << 31
MET = 500_000  # hashes that a task remembers
SLICE = 8 << 20  # bytes of text whose lines a task lays out at once
FAN = 64  # groups in which the parts of a shard are merged before they meet


def _cells(keys: np.ndarray, size: int) -> np.ndarray:
    """The cells, HASHES for each 64-bit key, of filters with `size` cells (a power of two)."""
    step = (keys >> np.uint64(32)) | np.uint64(1)
    return np.concatenate([(keys + np.uint64(i) * step) & np.uint64(size - 1) for i in range(HASHES)]).astype(np.uint32) if len(keys) else np.empty(0, np.uint32)


def _long_keys(text: str | None, least: int) -> list[tuple[int, str]]:
    """(line number, line without white space at its ends) of the lines that then have `least` code points."""
    return [(i, k) for i, x in enumerate((text or "").split("\n")) if len(k := x.strip(WHITE)) >= least]


def _seen(size: int, least: int):
    """For mapInArrow over (text): rows (shard, once, twice) with the cells that documents of the task hit once or more, and twice or more."""

    def rows(cells: list[np.ndarray]):
        once, n = np.unique(np.concatenate(cells), return_counts=True)
        twice = once[n > 1]
        shards = np.unique(once // SHARD)
        begin = shards.astype(np.int64) * SHARD
        at = lambda x: (np.searchsorted(x, begin), np.searchsorted(x, begin + SHARD))
        pack = lambda x: zlib.compress(np.diff(x, prepend=x[:1] * 0).astype("<u4").tobytes(), 1)
        (a, b), (c, d) = at(once), at(twice)
        yield pa.RecordBatch.from_pydict({"shard": pa.array(shards.astype(np.int32)), "once": pa.array([pack(once[i:j] % SHARD) for i, j in zip(a, b)], pa.binary()), "twice": pa.array([pack(twice[i:j] % SHARD) for i, j in zip(c, d)], pa.binary())})

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for text in batch.column(0):
                keys = np.array(list({xxhash.xxh64_intdigest(k.encode().lower()) for _, k in _long_keys(text.as_py(), least)}), np.uint64)
                if len(keys):
                    held.append(np.unique(_cells(keys, size)))
                    n += len(held[-1])
                if n >= FLUSH:
                    yield from rows(held)
                    held, n = [], 0
        if held:
            yield from rows(held)

    return run


def _places(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(packed), "<u4"), dtype=np.int64)


def _bits(packed: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), bitorder="little").astype(bool)


def _merge_some(group: pd.DataFrame) -> pd.DataFrame:
    """One shard from some of its parts: a cell is twice-seen if a part says so or two parts have it."""
    once, twice = np.zeros(SHARD, bool), np.zeros(SHARD, bool)
    for a, b in zip(group["once"], group["twice"]):
        x = _places(a)
        twice[x[once[x]]] = True
        twice[_places(b)] = True
        once[x] = True
    pack = lambda x: zlib.compress(np.packbits(x, bitorder="little").tobytes(), 1)
    return pd.DataFrame({"shard": [int(group["shard"].iloc[0])], "once": [pack(once)], "twice": [pack(twice)]})


def _merge_all(group: pd.DataFrame) -> pd.DataFrame:
    """The bits of the twice-seen cells of one shard from what _merge_some has made of its parts."""
    once, twice = np.zeros(SHARD, bool), np.zeros(SHARD, bool)
    for a, b in zip(group["once"], group["twice"]):
        x = _bits(a)
        twice |= _bits(b) | (once & x)
        once |= x
    return pd.DataFrame({"shard": [int(group["shard"].iloc[0])], "bits": [np.packbits(twice, bitorder="little").tobytes()]})


def _slices(batch: pa.RecordBatch, text_at: int):
    """A batch in parts of about SLICE bytes of text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE, "right")))
        yield batch.slice(at, end - at)
        at = end


def _suspects(filters, size: int, least: int, schema: pa.Schema, text_at: int):
    """For mapInArrow: each batch with n_lines and the (line, key) that may be repeated: array of (line, 128-bit hash of the key)."""

    def run(batches):
        bits = filters.value
        for batch in (part for whole in batches for part in _slices(whole, text_at)):
            n_lines, docs, hashes = [], [], []
            for row, text in enumerate(batch.column(text_at)):
                text = text.as_py() or ""
                n_lines.append(text.count("\n") + 1)
                for i, k in _long_keys(text, least):
                    k = k.encode().lower()
                    docs.append((row, i, k))
                    hashes.append(xxhash.xxh64_intdigest(k))
            found: list[list[dict]] = [[] for _ in n_lines]
            if hashes:
                cells = _cells(np.array(hashes, np.uint64), size)
                hit = (bits[cells >> 3] >> (cells & 7).astype(np.uint8) & 1).reshape(HASHES, -1).all(axis=0)
                for j in np.flatnonzero(hit):
                    row, i, k = docs[j]
                    found[row].append({"line": i, "key": xxhash.xxh3_128_digest(k)})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_lines, pa.int64()), pa.array(found, schema.field(schema.names[-1]).type)], schema=schema)

    return run


def _line_rows(shards: int, least: int):
    """For mapInArrow over (uid, doc_id, text): (shard, hash, sure, uid, doc_id, key, lines), one row for each different long line of a text. A line that the task has met in two texts before is sure to be seen twice, so of a frequent one a task sends two rows to its shard."""
    names = ["shard", "hash", "sure", "uid", "doc_id", "key", "lines"]

    def run(batches):
        met: dict[int, int] = {}
        for batch in (part for whole in batches for part in _slices(whole, 2)):
            row, hashes, sure, keys, lines = [], [], [], [], []
            for i, text in enumerate(batch.column(2)):
                here: dict[bytes, list[int]] = {}
                for line, k in _long_keys(text.as_py(), least):
                    here.setdefault(k.encode().lower(), []).append(line)
                for k, at in here.items():
                    h = xxhash.xxh64_intdigest(k)
                    times = met.get(h, 0)
                    met[h] = times + 1
                    row.append(i)
                    hashes.append(h)
                    sure.append(times >= 2)
                    keys.append(xxhash.xxh3_128_digest(k))
                    lines.append(at)
            shard = [h * shards >> 64 for h in hashes]
            uid, doc_id = (batch.column(i).take(pa.array(row, pa.int64())) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(sure, pa.bool_()), uid, doc_id, pa.array(keys, pa.binary()), pa.array(lines, pa.list_(pa.int32()))], names=names)
            met = {} if len(met) > MET else met

    return run


def _seen_twice(batches):
    """For mapInArrow over rows of _line_rows sorted by shard: those whose cells in the shard's filter are all seen twice. A task holds the rows of one shard, about SHARD / CELLS."""
    held, shard = [], None
    once, twice = np.zeros(SHARD, bool), np.zeros(SHARD, bool)
    cells = lambda rows: _cells(rows.column(1).to_numpy().view(np.uint64), SHARD)
    passed = lambda: (rows.filter(pa.array(twice[cells(rows)].reshape(HASHES, -1).all(axis=0))) for rows in held)
    for batch in batches:
        shards = batch.column(0).to_numpy()
        edges = [*np.flatnonzero(np.diff(shards, prepend=-1)), len(shards)]
        for a, b in zip(edges, edges[1:]):
            if shards[a] != shard:
                yield from passed()
                held, shard = [], shards[a]
                once[:], twice[:] = False, False
            held.append(batch.slice(a, b - a))
            hit, n = np.unique(cells(held[-1]), return_counts=True)
            twice[hit[(n > 1) | once[hit]]] = True
            once[hit] = True
    yield from passed()


def _sharded(docs: DataFrame, n_cells: int, least: int, n_lines: str, uid: str) -> tuple[DataFrame, DataFrame]:
    """docs with n_lines and uid, and (uid, doc_id, line, key) of their suspected lines, where filters are too large for one executor: hashes go to the filters' shards."""
    shards = -(-n_cells // SHARD)
    text = F.coalesce("text", F.lit(""))
    counted = (F.length(text) - F.length(F.translate(text, "\n", "")) + 1).cast("long")
    found = written(docs.withColumn(n_lines, counted).withColumn(uid, F.monotonically_increasing_id()))
    ddl = f"shard bigint, hash bigint, sure boolean, uid bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, key binary, lines array<int>"
    rows = written(found.select(F.col(uid).alias("uid"), "doc_id", "text").mapInArrow(_line_rows(shards, least), ddl))
    tested = rows.where("not sure").repartition("shard").sortWithinPartitions("shard").mapInArrow(_seen_twice, ddl)
    return found, written(rows.where("sure").unionAll(tested).select("uid", "doc_id", F.explode("lines").alias("line"), "key"))


def _broadcast(docs: DataFrame, size: int, least: int, n_lines: str, uid: str, suspects: str) -> tuple[DataFrame, DataFrame]:
    """docs with n_lines, suspects (array of line and key) and uid, and (uid, doc_id, line, key) of the suspected lines, by filters of `size` cells that every executor has."""
    spark = docs.sparkSession
    parts = docs.select("text").mapInArrow(_seen(size, least), "shard int, once binary, twice binary")
    bits = np.zeros(size // 8, np.uint8)
    some = parts.groupBy("shard", F.pmod(F.spark_partition_id(), F.lit(FAN)).alias("k")).applyInPandas(_merge_some, "shard int, once binary, twice binary")
    for row in some.groupBy("shard").applyInPandas(_merge_all, "shard int, bits binary").toLocalIterator():
        bits[row.shard * SHARD // 8 : (row.shard + 1) * SHARD // 8] = np.frombuffer(row.bits, np.uint8)

    schema = T.StructType([*docs.schema.fields, T.StructField(n_lines, T.LongType()), T.StructField(suspects, T.ArrayType(T.StructType([T.StructField("line", T.IntegerType()), T.StructField("key", T.BinaryType())])))])
    found = docs.mapInArrow(_suspects(spark.sparkContext.broadcast(bits), size, least, to_arrow_schema(schema), docs.columns.index("text")), schema)
    found = written(found.withColumn(uid, F.monotonically_increasing_id()))

    each = written(found.where(F.size(suspects) > 0).select(uid, F.col("doc_id").alias("doc_id"), F.inline(suspects)).select(F.col(uid).alias("uid"), "doc_id", "line", "key"))
    return found, each


def line_dedup(docs: DataFrame, least: int = 20, copies: int = 3, max_cells: int = MAX_CELLS) -> DataFrame:
    """docs(doc_id, text, ...) with the lines of text that repeat in other documents taken out, and n_lines and n_dropped as the last two columns.

    Lines are what \\n separates (null and empty texts: one empty line). A key of `least` code points or more that
    `copies` documents have loses all its lines but those of the largest doc_id that has it. Rows without doc_id
    count as one document, and as the smallest. Rows with one doc_id count as one document. Other columns stay as
    they are, whatever their names; n_lines and n_dropped get a trailing _ where docs has them.

    First pass: each task notes cells of two Bloom filters, hashes seen once and seen twice, and the parts are
    merged shard by shard, in two steps. The filters grow with the lines, CELLS for each. Up to `max_cells`, whose bits are
    what an executor can hold, they are broadcast, and the second pass tests each line in its place. Larger filters
    stay where their shards are: each different line of a text goes there as one row of hashes (a line that a task has
    met twice needs no test), and those that pass are suspected as well. Then only lines whose cells are all seen twice
    are shuffled, by 128-bit hash, to count their documents and choose the one that keeps them. With broadcast
    filters only documents with such lines are joined with what was found.
    """
    n_lines, n_dropped, suspects, uid, drops = (fresh(docs, x) for x in ("n_lines", "n_dropped", "__suspects", "__uid", "__drops"))
    lines = docs.agg(F.sum(F.length("text") - F.length(F.translate("text", "\n", "")) + 1)).first()[0] or 0
    size = max(SHARD, 1 << (CELLS * int(lines)).bit_length())
    if size <= max_cells:
        found, each = _broadcast(docs, size, least, n_lines, uid, suspects)
        held, free = found.where(F.size(suspects) > 0), found.where(F.size(suspects) == 0)
    else:
        found, each = _sharded(docs, CELLS * int(lines), least, n_lines, uid)
        held, free = found, found.where(F.lit(False))
    keepers = each.groupBy("key", "doc_id").agg(F.lit(1).alias("x")).groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep")).where(F.col("n") >= copies).select("key", "keep")
    keepers = cut(keepers)  # joined straight after the sums, a hot key's lines would stay in one task
    keepers = F.broadcast(keepers) if keepers.count() <= BROADCAST_KEYS else keepers
    lost = each.join(keepers, "key").where(~F.col("doc_id").eqNullSafe(F.col("keep"))).groupBy("uid").agg(F.array_sort(F.collect_list("line")).alias(drops)).withColumnRenamed("uid", uid)
    joined = held.join(lost, uid, "left")
    gone = F.col(drops).isNotNull()
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, i: ~among(F.col(drops), i)), "\n")
    out = lambda df, text, n: df.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns], n_lines, n.cast("long").alias(n_dropped))
    return out(free, F.col("text"), F.lit(0)).unionAll(out(joined, F.when(gone, kept).otherwise(F.col("text")), F.when(gone, F.size(drops)).otherwise(0)))
