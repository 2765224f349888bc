"""The given tables and the views over them that queries use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper_id, doc_id, line_no, text): each document's lines from 0; paper is the source."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("paper_id"), "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, title) of web pages."""
    return table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
