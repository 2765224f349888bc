"""Substring search for many terms at once: few terms go to the texts; for more there is a posting index of runs of three characters, intersection, verification."""

from __future__ import annotations

from functools import cached_property

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from ..functions.text import runs_of
from ..shared import settle, written
from .lookup import look_up

GRAM = 3
#: Of a term's runs so many, the rarest, are intersected; the texts that are left are read.
RAREST = 4
#: Characters of all terms that go to every task, some 60 bytes each in a Python worker, fewer where beginnings are shared; more meet the texts by the index.
MOST_ASKED = 1 << 23
#: Pairs that are given out together, or a text's if it has more.
TOGETHER = 1 << 16


class _Asked:
    """Queries with the terms that they need, and an automaton of each one's longest term, made where it is used."""

    def __init__(self, queries: pa.Array, terms: list[list[str]]):
        self.queries, self.terms = queries, [sorted(ts, key=lambda t: (-len(t), t)) for ts in terms]

    @cached_property
    def _by_longest(self):
        by: dict[str, list[tuple[int, list[str]]]] = {}
        for i, (longest, *rest) in enumerate(self.terms):
            by.setdefault(longest, []).append((i, rest))
        automaton = ahocorasick.Automaton()
        for longest in by:
            if len(longest) >= GRAM:
                automaton.add_word(longest, longest)
        automaton.make_automaton()
        return by, automaton, [t for t in by if len(t) < GRAM]

    def of(self, low: str) -> list[int]:
        """Places of the queries all of whose terms the text has."""
        by, automaton, short = self._by_longest
        met = {t for _, t in automaton.iter(low)} if len(automaton) else set()
        met.update(t for t in short if t in low)
        return [i for t in met for i, rest in by[t] if all(r in low for r in rest)]


def _told(known, schema: pa.Schema):
    """For mapInArrow over (key, low): (query, key) for the queries of the broadcast `known`."""

    def pairs(query: list[int], key: pa.Array, at: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([known.value.queries.take(pa.array(query, pa.int64())), key.take(pa.array(at, pa.int64()))], schema=schema)

    def run(batches):
        for batch in batches:
            query, at = [], []
            for i, low in enumerate(batch.column(1)):
                if (low := low.as_py()) is not None:
                    query += (found := known.value.of(low))
                    at += [i] * len(found)
                    if len(at) >= TOGETHER:
                        yield pairs(query, batch.column(0), at)
                        query, at = [], []
            if at:
                yield pairs(query, batch.column(0), at)

    return run


def _read_for(asked: DataFrame, rows: DataFrame, key: str, text: Column) -> DataFrame | None:
    """(query, key): which of rows have all terms of which of asked(query, terms array of lower-cased strings, none of them empty), by reading every text once; None where the terms are more than MOST_ASKED characters."""
    asked = settle(asked)
    size = asked.agg(F.sum(F.length(F.array_join("terms", " ")).cast("long") + 1)).first()[0] or 0
    if size > MOST_ASKED:
        return None
    read = rows.select(F.col(key), F.lower(text).alias("low"))
    schema = StructType([StructField("query", asked.schema["query"].dataType), StructField(key, read.schema[key].dataType)])
    arrow = to_arrow_schema(schema)
    few = asked.toArrow()
    known = rows.sparkSession.sparkContext.broadcast(_Asked(few["query"].combine_chunks().cast(arrow.field("query").type), few["terms"].to_pylist()))
    return read.mapInArrow(_told(known, arrow), schema)


def gram_index(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """(gram, key): the distinct runs of three characters of each lower-cased text, or the whole text where it is shorter; sorted by gram and written to the shared folder, so that a lookup reads few row groups. Null and empty texts have none."""
    low = F.lower(text)
    grams = F.when(F.length(low) < GRAM, F.filter(F.array(low), lambda t: t != "")).otherwise(F.array_distinct(runs_of(low, GRAM)))
    each = rows.select(F.col(key).alias("key"), F.explode(grams).alias("gram")).distinct()
    return written(each.repartitionByRange("gram", "key").sortWithinPartitions("gram", "key"))


def containing(terms: DataFrame, rows: DataFrame, key: str, text: Column, index: DataFrame | None = None) -> DataFrame:
    """(term, key): which of rows(`key`, ...) have which of terms(term) in their text, whatever the case; key is unique.

    Terms of up to MOST_ASKED characters in all go to every task, which reads its texts once for all of them; for more, or with `index`, the index serves.
    A text that has a term of three characters or more has all of its runs of three: the postings of the RAREST of them are
    counted by (term, key), and texts that have all are read, once each for all of their terms, to see whether they do have them.
    A term of one or two characters is in a text if it is in one of its runs, which needs no reading: runs meet it on
    their parts. Empty and null terms find nothing.
    """
    asked = settle(terms.select(F.lower("term").alias("low"), F.col("term").alias("asked")).where("low <> ''").distinct())
    if index is None:
        told = _read_for(asked.select(F.col("asked").alias("query"), F.array("low").alias("terms")), rows, key, text)
        if told is not None:
            return told.withColumnRenamed("query", "term")
        rows, text = written(rows.select(key, text.alias("__text"))), F.col("__text")
        index = gram_index(rows, key, text)
    low = asked.select("low").distinct()
    sizes = settle(index.groupBy("gram").agg(F.count("*").alias("df")))
    # Long terms.
    grams = low.where(F.length("low") >= GRAM).select("low", F.explode(F.array_distinct(runs_of(F.col("low"), GRAM))).alias("gram"))
    rank = F.row_number().over(Window.partitionBy("low").orderBy(F.coalesce("df", F.lit(0)), "gram"))
    chosen = grams.join(sizes, "gram", "left").withColumn("r", rank).where(F.col("r") <= RAREST).select("low", "gram")
    chosen = settle(chosen)
    needed = chosen.groupBy("low").agg(F.count("*").alias("needed"))
    met = chosen.join(index, "gram").groupBy("low", "key").agg(F.count("*").alias("n")).join(needed, "low").where("n = needed").select("key", "low")
    told = look_up(met, F.array("low"), rows.withColumn("__low", F.lower(text)).select(F.col(key).alias("key"), "__low"), "key", F.col("__low"))
    long = told.where(F.col("found")[0].isNotNull()).select("low", "key")
    # Short ones.
    parts = F.array_distinct(F.flatten(F.array(runs_of(F.col("gram"), 1), runs_of(F.col("gram"), 2))))
    holders = sizes.select("gram", F.explode(parts).alias("low")).join(low.where(F.length("low") < GRAM), "low")
    short = holders.join(index, "gram").select("low", "key").distinct()
    return long.unionByName(short).join(asked, "low").select(F.col("asked").alias("term"), F.col("key").alias(key))


def having_all(queries: DataFrame, rows: DataFrame, key: str, text: Column, index: DataFrame | None = None) -> DataFrame:
    """(query, key): which of rows have all terms of which of queries(query, terms array of strings); a query without terms, or with an empty one, finds nothing. Terms are sought as by containing."""
    each = settle(queries.select("query", F.explode(F.array_distinct("terms")).alias("term")))
    if index is None:
        whole = each.where("query is not null").groupBy("query").agg(F.collect_set(F.lower("term")).alias("terms"), F.bool_or(F.coalesce("term", F.lit("")) == "").alias("gap")).where("not gap")
        told = _read_for(whole.drop("gap"), rows, key, text)
        if told is not None:
            return told
    needed = each.groupBy("query").agg(F.count("*").alias("needed"))
    met = containing(each.select("term").distinct(), rows, key, text, index).join(each, "term").groupBy("query", key).agg(F.count("*").alias("n"))
    return met.join(needed, "query").where("n = needed").select("query", key)
