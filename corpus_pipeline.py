"""From documents to token ids: five stages, each over all that the one before it kept.

All take any table that has the columns of documents; others are left out, whatever their names. Nulls are kept where
a row stays: a null text counts as an empty one, a null source or doc_id as one of its own. Repeated rows are
documents of their own until near copies go. Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarspark.llm import line_dedup, mixing, quality, sentencepieces, simhash
from scholarspark.llm.common import documents, model_path
from scholarspark.shared import new_path, removed, scratch, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _sized(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars being the code points of the text as it now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that their hosts repeat. Null and empty texts have under 50
    words, so they go; equal texts of a host count once for its lines, and are kept or go together."""
    return _sized(quality.keep_good(docs.select(COLUMNS), copies=False))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stay in another one: of each repeated line those of the largest doc_id stay (null is the smallest), all of them if it has several."""
    return _sized(line_dedup.line_dedup(docs.select(COLUMNS)))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id (null is the largest), of equal ids the row read first. Near are, as for op7_simhash, fingerprints with up to 4 differing bits, directly or by others."""
    return _sized(simhash.keep_one(docs.select(COLUMNS)))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in their target proportions: each document as often as its source's rate asks, perhaps not at all. A null source is one of its own; equal ids are drawn alike."""
    return _sized(mixing.mix(docs.select(COLUMNS)))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text decoded from them; a null or empty text has the begin and end ids only."""
    return sentencepieces.encode_decode(docs, model_path(), keep_ids=True)


STAGES = [
    ("quality rules", good_documents),
    ("line dedup", without_repeated_lines),
    ("simhash near-dedup", without_near_copies),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

#: SimHash components and merges by score go beyond what SQL says plainly; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage; each stage before it is written to the shared folder and read again. What they write besides goes at once, and a stage's table when the next is written."""
    docs, last = documents(spark, sf_dir), None
    for _, stage in STAGES[:-1]:
        path = new_path(spark)
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), path)
        if last is not None:
            removed(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
