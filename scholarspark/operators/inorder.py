"""Rows of a group in order: ranks that no task gives a whole group, and folds that keep a state and no list."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from ..shared import settle_in_order


def _starts(keys: list[pa.Array]) -> np.ndarray:
    """Which rows of a batch begin a group: those that differ from the row before in a key (null equals null). The first one may or may not."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    for k in keys:
        codes = k.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return new


def _ends(batches):
    """For mapInArrow over (keys, range) of sorted rows: the first and the last group of a range, and how many rows the last has there."""
    first = last = place = None
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held, new = batch.columns[:-1], np.flatnonzero(_starts(batch.columns[:-1]))
        begins = repr([k[0].as_py() for k in held])
        if first is None:
            first, place = begins, batch.column(batch.num_columns - 1)[0].as_py()
        ends = repr([k[-1].as_py() for k in held])
        whole = begins == last and not len(new)
        n = n + batch.num_rows if whole else batch.num_rows - (int(new[-1]) if len(new) else 0)
        last = ends
    if first is not None:
        yield pa.RecordBatch.from_pydict({"range": pa.array([place], pa.int32()), "first": [first], "last": [last], "n": [n]})


def ranked(rows: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """rows with `name`, the rank from 1 of each row in its group `by`, in `order`, which should leave no ties.

    Rows are sorted in ranges of (by, order) and kept, so a group of any size lies in as many ranges as it fills. Each range
    ranks its own; only the first group of a range can have begun before, so what is added comes from one number for each range.
    """
    spark = rows.sparkSession
    keys = [F.col(c) for c in by]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = settle_in_order(rows.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("__range", F.spark_partition_id()))
    ends = placed.select(*by, "__range").mapInArrow(_ends, "range int, first string, last string, n long").collect()
    before, key, held = {}, None, 0
    for r in sorted(ends):
        before[r.range] = held if r.first == key else 0
        held = r.n + (before[r.range] if r.first == r.last else 0)
        key = r.last
    begun = spark.sparkContext.broadcast({k: n for k, n in before.items() if n})
    columns = rows.columns
    at = [columns.index(c) for c in by]
    schema = StructType([*rows.schema.fields, StructField(name, LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        last, count = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = [batch.column(i) for i in at]
            new = _starts(held)
            first = tuple(k[0].as_py() for k in held)
            if count is None:
                count = begun.value.get(batch.column(len(columns))[0].as_py(), 0)
            elif first != last:
                count = 0
            place = np.arange(batch.num_rows)
            begin = np.maximum.accumulate(np.where(new, place, -1))
            rank = np.where(begin < 0, place + count, place - begin) + 1
            last, count = tuple(k[-1].as_py() for k in held), int(rank[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(rank, pa.int64())], schema=arrow)

    return placed.mapInArrow(run, schema)


def folded(rows: DataFrame, by: list[str], order: list[Column], inputs: list[str], start: tuple, step: Callable[[tuple, tuple], tuple[tuple, object]], name: str, kind: str) -> DataFrame:
    """rows with `name` of type `kind`, what step gives for each row of a group, in order: step(state, values of inputs) is (next state, value), from `start` on.

    A group is read once as a stream of sorted rows, and only its state is held, so groups may be of any length; a group is one task's work.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartition(n, *by).sortWithinPartitions(*by, *order)
    columns = rows.columns
    at, of = [columns.index(c) for c in by], [columns.index(c) for c in inputs]
    schema = StructType([*rows.schema.fields, *StructType.fromDDL(f"{name} {kind}").fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        last, state = None, start
        for batch in batches:
            if not batch.num_rows:
                continue
            held = [batch.column(i) for i in at]
            new = _starts(held)
            new[0] = last is None or tuple(k[0].as_py() for k in held) != last
            out = []
            for begins, values in zip(new.tolist(), zip(*(batch.column(i).to_pylist() for i in of))):
                state, value = step(start if begins else state, values)
                out.append(value)
            last = tuple(k[-1].as_py() for k in held)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow.field(len(columns)).type)], schema=arrow)

    return sorted_.mapInArrow(run, schema)
