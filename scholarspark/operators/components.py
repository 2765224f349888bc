"""Connected components of graphs that no task can hold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import settle

#: Rows of groups that are laid out at once by connected_within.
TOGETHER = 1 << 17


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph: one row (node, label) for each node of `edges` (a, b of one type that has an order); label is the smallest node of its component.

    Large-star and small-star rounds: every node hands its neighbours to the smallest node that it knows, which
    halves the distances each time. Stops when a round changes nothing. Only a count and a sum reach the driver.
    Null ends and loops are ignored; an empty table gives an empty one.
    """
    now = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima are kept before they are joined: straight after the sums, a hub's neighbours would stay in one task.
        least = settle(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        large = settle(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        down = settle(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = settle(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    leaves = now.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")
    return leaves.unionAll(leaves.select(F.col("label").alias("node"), "label").distinct())


def _least_reached(node: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each node, numbered from 0, the least node that it reaches by keys; node and key are what each row joins."""
    order = np.argsort(key, kind="stable")
    first = np.append(True, np.diff(key[order]) != 0)
    a = node[order]
    b = a[np.flatnonzero(first)][np.cumsum(first) - 1]
    up = np.arange(node.max(initial=-1) + 1)
    while True:
        a, b = up[a], up[b]
        open_ = a != b
        if not open_.any():
            return up
        a, b = a[open_], b[open_]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]


def _numbered(column: pa.Array) -> np.ndarray:
    """A number for each value of a column, equal for equal ones."""
    return pc.fill_null(column.dictionary_encode(null_encoding="encode").indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _within(batches):
    """For mapInArrow over (paper_id, node, key), in order of paper_id and node, papers whole: (paper_id, node, label)."""

    def labelled(rows: pa.Table):
        rows = rows.combine_chunks()
        paper, node, key = (_numbered(rows.column(k).combine_chunks()) if rows.num_rows else np.empty(0, np.int64) for k in range(3))
        new = np.append(True, (np.diff(paper) != 0) | (np.diff(node) != 0))[: len(paper)]
        at = np.flatnonzero(new)
        label = _least_reached(np.cumsum(new) - 1, paper * (key.max(initial=0) + 1) + key)
        nodes = rows.column("node")
        yield from pa.table([rows.column("paper_id").take(pa.array(at)), nodes.take(pa.array(at)), nodes.take(pa.array(at[label]))], ["paper_id", "node", "label"]).combine_chunks().to_batches()

    held, n, enough = [], 0, TOGETHER
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < enough:
            continue
        rows = pa.Table.from_batches(held)
        paper = rows.column("paper_id")
        # What the last paper has goes on, for more of it may follow.
        whole = pc.index(pc.equal(paper, paper[-1]), True).as_py()
        if whole:
            yield from labelled(rows.slice(0, whole))
            held = rows.slice(whole).combine_chunks().to_batches()
            n = rows.num_rows - whole
        enough = max(TOGETHER, 2 * n)
    if held:
        yield from labelled(pa.Table.from_batches(held))


def connected_within(pairs: DataFrame) -> DataFrame:
    """(paper_id, node, label) of pairs(paper_id, node, key) without nulls, for papers of few rows: each is one task's work, with many others."""
    node = pairs.schema["node"].dataType.simpleString()
    ordered = pairs.repartition("paper_id").sortWithinPartitions("paper_id", "node")
    return ordered.mapInArrow(_within, f"paper_id {pairs.schema['paper_id'].dataType.simpleString()}, node {node}, label {node}")
