"""Readers and writers of corpora, artifacts, activity, logs and stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SECTION = "raw_id string, section_no int, heading string, level int, text string, page_start int, page_end int"
PAPER = f"paper_id string, source string, sha256 string, title string, first_page_text string, n_pages int, arxiv_id string, sections array<struct<{SECTION.replace(' ', ': ').replace(',:', ',')}>>"
ARTIFACT = "paper struct<id: string, title: string, sha256: string>, graph struct<nodes: array<struct<id: string>>, edges: array<struct<source: string>>>, quiz struct<questions: array<struct<id: string>>>, sections array<struct<id: string>>"
USAGE = "run string, state string, lane string, usage array<struct<provider: string, model: string, calls: bigint, cached: bigint, input_tokens: bigint, output_tokens: bigint, seconds: double>>"
# Names of folders that are pages, and lines of a run's log.
FOLDER = r"^[A-Za-z0-9_-][A-Za-z0-9._-]{0,119}$"
LOG_LINE = r"^\d\d:\d\d:\d\d\s+(DEBUG|INFO|WARNING|ERROR)\s+(\S+?):?\s+(.*)$"


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(papers, sections) from JSON, a nested paper in each row; rows that aren't JSON are left out."""
    raw = spark.read.schema(PAPER).json(path).where("paper_id is not null")
    return raw.drop("sections"), raw.select("paper_id", F.inline("sections"))


def read_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """(page, paper_id, title, counts) of every finished page under root/<page>/experience.json, a file or a folder of files; pages with other names are skipped, unreadable files give an empty row."""
    raw = spark.read.schema(ARTIFACT).option("multiLine", True).option("mode", "PERMISSIVE").json(f"{root}/*/experience.json").select("*", F.col("_metadata.file_path").alias("file"))
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))
    page = F.regexp_extract("file", r"([^/]+)/experience\.json(?:/[^/]+)?$", 1)
    return raw.where(page.rlike(FOLDER)).select(page.alias("page"), F.col("paper.id").alias("paper_id"), F.col("paper.title").alias("title"), size("sections").alias("n_sections"), size("graph.nodes").alias("n_nodes"), size("graph.edges").alias("n_edges"), size("quiz.questions").alias("n_questions"))


def read_activity(spark: SparkSession, path: str) -> DataFrame:
    """Quiz attempts and reading states, one JSON object a line; see streaming.activity for their form."""
    from ..streaming.activity import ACTIVITY

    return spark.read.schema(ACTIVITY).json(path).where("page is not null")


def read_run_logs(spark: SparkSession, path: str, n: int = 200, run: Column | None = None) -> DataFrame:
    """(run, line_no, level, stage, message): the last n lines of each log that have the form of one and aren't DEBUG.

    A log is a file, or with `run`, an expression over `file`, the files that it gives one value, in the order of their names. Lines
    are read as such, so a long log is read in parts; its line numbers are those before a part and the place in it.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value")
    raw = raw.select((F.regexp_extract("file", r"([^/]+?)(?:\.log)?$", 1) if run is None else run).alias("run"), "*")
    parts = raw.groupBy("run", "file", "start").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    # A row for each part of a log.
    before = F.sum("size").over(Window.partitionBy("run").orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("file", "start", "first", F.coalesce(before, F.lit(0)).alias("before"))
    part = lambda i: F.regexp_extract("value", LOG_LINE, i)
    said = raw.select("run", "file", "start", "at", part(1).alias("level"), part(2).alias("stage"), part(3).alias("message")).where("level <> '' and level <> 'DEBUG'")
    lines = said.join(parts, ["file", "start"]).select("run", (F.col("before") + F.col("at") - F.col("first")).alias("line_no"), "level", "stage", "message")
    return lines.withColumn("__r", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("line_no")))).where(F.col("__r") <= n).drop("__r")


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """One row for each usage counter of each run's status file."""
    return spark.read.schema(USAGE).option("multiLine", True).json(path).select("run", "state", "lane", F.inline("usage"))


def read_cache_files(spark: SparkSession, root: str) -> DataFrame:
    """(file, kind, bytes) of the files under root; the kind is the first folder. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    inside = F.regexp_extract("path", rf"\Q{root.rstrip('/')}\E/(.*)$", 1)
    return files.select(inside.alias("file"), F.element_at(F.split(inside, "/"), 1).alias("kind"), F.col("length").alias("bytes"))


def write_artifacts(pages: DataFrame, path: str, buckets: int = 16) -> None:
    """Nested JSON, one row a page, in folders by a hash of paper_id."""
    pages.withColumn("bucket", F.pmod(F.hash("paper_id"), F.lit(buckets))).write.mode("overwrite").partitionBy("bucket").json(path)


def write_index(chunks: DataFrame, path: str) -> None:
    """Chunks as Parquet, those of a paper together and in order."""
    chunks.repartition("paper_id").sortWithinPartitions("paper_id", "chunk_no").write.mode("overwrite").parquet(path)


def write_stage(df: DataFrame, name: str, root: str) -> DataFrame:
    """df written as the output table of a stage, and read again."""
    df.write.mode("overwrite").parquet(f"{root}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{root}/{name}")


def append_responses(replies: DataFrame, path: str) -> None:
    """replies(request_key, reply) added to a store, in folders by the first two characters of the key."""
    replies.withColumn("prefix", F.substring("request_key", 1, 2)).write.mode("append").partitionBy("prefix").parquet(path)
