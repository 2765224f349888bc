"""Queries that write the given tables in the forms of sources and sinks and read them again, and that stream them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import new_path, written
from ..sources import io
from ..sources.tables import table
from ..streaming import activity


def _corpus(spark, d):
    """Every document as a nested paper with a section for each line."""
    path = new_path(spark)
    docs = table(spark, d, "documents")
    section = lambda x, i: F.struct(F.concat(F.lit("r"), i).alias("raw_id"), i.alias("section_no"), F.lit("h").alias("heading"), F.lit(1).alias("level"), x.alias("text"), F.floor(i / 40).cast("int").alias("page_start"), F.floor(i / 40).cast("int").alias("page_end"))
    papers = docs.select(F.col("doc_id").cast("string").alias("paper_id"), "source", F.transform(F.split("text", "\n", -1), section).alias("sections"))
    papers.write.json(path)
    return io.read_corpus(spark, path)[1].select("paper_id", "section_no", F.md5("text").alias("md5"), "page_start")


def _corpus_papers(spark, d):
    path = new_path(spark)
    table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), "source", F.sha2("text", 256).alias("sha256"), F.lit([]).cast(f"array<struct<{io.SECTION.replace(' ', ': ').replace(',:', ',')}>>").alias("sections")).write.json(path)
    return io.read_corpus(spark, path)[0].select("paper_id", "source", "sha256")


def _events(spark, d):
    """Events as activity of readers: purchases are quizzes, errors are of no kind that is known, the rest is reading."""
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "purchase", "quiz").when(F.col("event_type") == "error", "noise").otherwise("progress")
    total = F.when(F.col("event_id") % 10 == 0, 0).otherwise(1000).cast("long")
    return e.select(
        F.concat(F.lit("u"), "user_id").alias("page"), kind.alias("kind"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("at"), F.floor("value").alias("correct"), total.alias("total"),
        F.array().cast("array<struct<id: string, section_id: string, question: string>>").alias("missed"), F.array(F.concat(F.lit("s"), "event_id"), "event_type").alias("read"),
    )


def _read_activity(spark, d):
    path = new_path(spark)
    _events(spark, d).write.json(path)
    return io.read_activity(spark, path).select("page", "kind", F.col("at").cast("timestamp_ntz").alias("at"), "correct", "total", F.array_join("read", ",").alias("read"))


def _run_logs(spark, d):
    """A log for each type of event, in files by the order of events: a line for each event in the form of a log, and some that have another; the last 40 of each."""
    path = new_path(spark)
    level = F.element_at(F.array(*map(F.lit, ["DEBUG", "INFO", "WARNING", "ERROR"])), (F.col("event_id") % 4 + 1).cast("int"))
    line = F.concat(F.date_format("ts", "HH:mm:ss"), F.lit(" "), level, F.lit(" "), "event_type", F.lit(": value "), "event_id")
    said = table(spark, d, "events").select("event_id", F.col("event_type").alias("log"), F.when(F.col("event_id") % 9 == 0, "no log line").otherwise(line).alias("value"))
    said.repartitionByRange(8, "log", "event_id").sortWithinPartitions("log", "event_id").select("log", "value").write.partitionBy("log").text(path)
    return io.read_run_logs(spark, path, n=40, run=F.regexp_extract("file", "log=([^/]+)/", 1)).select("run", "line_no", "level", "stage", "message")


def _cache_files(spark, d):
    """Texts in folders by language: how many bytes each holds."""
    path = new_path(spark)
    table(spark, d, "documents").select(F.coalesce("text", F.lit("")).alias("text"), "lang").write.partitionBy("lang").text(path)
    return io.read_cache_files(spark, path).where("file like '%.txt'").groupBy("kind").agg(F.sum("bytes").alias("bytes"))


def _read_artifacts(spark, d):
    """A page for each region: suppliers as sections, nations as nodes with an edge to the next, customers' segments as questions."""
    root = new_path(spark)
    of = lambda df, nation: df.join(table(spark, d, "nation"), F.col(nation) == F.col("n_nationkey"))
    ids = lambda c: F.array_sort(F.collect_set(F.col(c).cast("string")))
    named = lambda c: F.transform(c, lambda x: F.struct(x.alias("id")))
    s = of(table(spark, d, "supplier"), "s_nationkey").groupBy("n_regionkey").agg(ids("s_suppkey").alias("sections"))
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(ids("n_name").alias("nodes"))
    q = of(table(spark, d, "customer"), "c_nationkey").groupBy("n_regionkey").agg(ids("c_mktsegment").alias("questions"))
    pages = table(spark, d, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey")).drop("n_regionkey").join(s, F.col("r_regionkey") == F.col("n_regionkey"), "left").drop("n_regionkey").join(q, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    rows = written(pages.select("r_regionkey", F.struct(F.concat(F.lit("p"), "r_regionkey").alias("id"), F.col("r_name").alias("title")).alias("paper"), named("sections").alias("sections"), F.struct(named("nodes").alias("nodes"), F.transform(F.slice("nodes", F.lit(2), F.size("nodes")), lambda x: F.struct(x.alias("source"))).alias("edges")).alias("graph"), F.struct(named("questions").alias("questions")).alias("quiz")))
    for region in range(5):  # the region keys
        rows.where(F.col("r_regionkey") == region).drop("r_regionkey").write.json(f"{root}/{'.hidden' if region == 3 else f'page-{region}'}/experience.json")
    return io.read_artifacts(spark, root)


def _read_usage(spark, d):
    """A status file for each priority of orders, with a counter for each of their states."""
    path = new_path(spark)
    o = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("calls"), F.sum(F.floor("o_totalprice")).alias("input_tokens"))
    counter = F.struct(F.lit("v").alias("provider"), F.col("o_orderstatus").alias("model"), "calls", F.lit(0).cast("long").alias("cached"), "input_tokens", F.lit(None).cast("long").alias("output_tokens"), F.lit(0.5).alias("seconds"))
    runs = o.groupBy(F.col("o_orderpriority").alias("run")).agg(F.collect_list(counter).alias("usage"))
    runs.select("run", F.lit("done").alias("state"), F.lit("fast").alias("lane"), "usage").write.option("maxRecordsPerFile", 1).json(path)
    return io.read_usage(spark, path).select("run", "state", "lane", "model", "calls", "input_tokens", "output_tokens", "seconds")


def _artifacts(spark, d):
    path = new_path(spark)
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), F.struct(F.col("source").alias("title"), F.length("text").alias("size")).alias("paper"))
    io.write_artifacts(docs, path)
    return spark.read.schema("paper_id string, paper struct<title: string, size: long>, bucket int").json(path).select("paper_id", "paper.title", "paper.size", (F.col("bucket") == F.pmod(F.hash("paper_id"), F.lit(16))).alias("placed"))


def _index(spark, d):
    path = new_path(spark)
    docs = table(spark, d, "documents").select(F.col("source").alias("paper_id"), F.col("doc_id").alias("chunk_no"), "text")
    io.write_index(docs, path)
    return spark.read.parquet(path).select("paper_id", "chunk_no", F.md5("text").alias("md5"))


def _stage(spark, d):
    return io.write_stage(table(spark, d, "events").where("event_type <> 'error'"), "activity", new_path(spark)).select("event_id", "user_id", "event_type")


def _responses(spark, d):
    """Replies stored in two turns, and read as one store."""
    path = new_path(spark)
    c = table(spark, d, "conversations").select(F.sha2(F.concat_ws("|", "conv_id", "turn"), 256).alias("request_key"), F.col("text").alias("reply"), "turn")
    io.append_responses(c.where("turn % 2 = 0").drop("turn"), path)
    io.append_responses(c.where("turn % 2 = 1").drop("turn"), path)
    return spark.read.parquet(path).select("request_key", F.md5("reply").alias("md5"))


def _streamed(spark, stream: DataFrame, mode: str, schema) -> DataFrame:
    """All rows that a stream has given by the end of the input, with the number of their batch."""
    path = new_path(spark)
    keep = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{path}/rows")
    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(f"{schema}, batch long").parquet(f"{path}/rows")


SLICES = 4  # in which rows arrive, each a batch


def _files(spark) -> int:
    """Files of a slice, and of a batch: so batches are as many as slices, however large the table, but where a slice has too few rows to fill them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _arriving(spark, rows: DataFrame, put) -> tuple[str, int]:
    """A folder and a slice's length in microseconds: a folder that rows(at, ...) reach in SLICES by their time of arrival, up to a slice's length after `at`; put(rows, folder) writes one. Batches then cut through pages, and rows come in disorder."""
    path = new_path(spark)
    first, last = rows.agg(F.min("at"), F.max("at")).select(*[F.unix_micros(c) for c in ("min(at)", "max(at)")]).first()
    length = max(1, ((last or 0) - (first or 0)) // (SLICES - 1) + 1)
    late = F.pmod(F.xxhash64(*rows.columns), F.lit(length))
    arrival = ((F.unix_micros("at") - F.lit(first or 0) + late) / length).cast("int")
    for k in range(SLICES):
        put(rows.where(arrival == k).repartition(_files(spark)), path)
    return path, length


def _raw(spark, d):
    """The events as a stream of JSON lines that arrive in disorder, about a slice at a time."""
    e = _events(spark, d)
    line = F.when(F.substring("page", -1, 1) == "7", F.lit("{broken")).otherwise(F.to_json(F.struct(*[F.col(c) if c != "at" else F.col("said").alias("at") for c in e.columns]))).alias("value")
    path, _ = _arriving(spark, e.withColumn("said", F.col("at")).withColumn("at", F.to_timestamp("at")), lambda rows, folder: rows.select(line).write.mode("append").text(folder))
    return spark.readStream.option("maxFilesPerTrigger", _files(spark)).text(path)


def _parsed(spark, d):
    return _streamed(spark, activity.parse_activity(_raw(spark, d))[0], "append", "page string, kind string, at timestamp, correct long, total long").select("page", "kind", F.col("at").cast("timestamp_ntz").alias("at"), "correct", "total")


def _rejected(spark, d):
    found = _streamed(spark, activity.parse_activity(_raw(spark, d))[1], "append", "value string")
    return found.groupBy((F.col("value") == "{broken").alias("broken")).agg(F.count("*").alias("n"))


def _last_batch(rows: DataFrame) -> DataFrame:
    """Of each page the rows of its last batch, which stand for all before."""
    last = rows.groupBy("page").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["page", "batch"]).drop("batch")


def _attempts(spark, d):
    found = _streamed(spark, activity.attempts_stream(activity.parse_activity(_raw(spark, d))[0], 20), "update", "page string, at timestamp, correct long, total long")
    return _last_batch(found).select("page", F.col("at").cast("timestamp_ntz").alias("at"), "correct", "total")


def _progress(spark, d):
    found = _streamed(spark, activity.progress_stream(activity.parse_activity(_raw(spark, d))[0]), "update", "page string, at timestamp, read array<string>")
    return _last_batch(found).select("page", F.col("at").cast("timestamp_ntz").alias("at"), F.array_join("read", ",").alias("read"))


def _changes(spark, d):
    """Events as states of runs, in disorder by up to a slice's length: they wait for the watermark, which a last row far ahead lets pass them all."""
    e = table(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("run"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("ordinal"), F.col("event_type").alias("state"))
    path, length = _arriving(spark, e, lambda rows, folder: rows.write.mode("append").parquet(folder))
    e.agg(F.lit("").alias("run"), (F.max("at") + F.expr("interval 1000 days")).alias("at"), F.lit(0).cast("long").alias("ordinal"), F.lit("end").alias("state")).write.mode("append").parquet(path)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", _files(spark)).parquet(path)
    return _streamed(spark, activity.transition_stream(stream, ("click",), ("error", "purchase"), late=f"{2 * length // 1_000_000 + 60} seconds"), "append", "run string, ordinal long, before string, state string").drop("batch")


QUERIES = {
    "s1_read_corpus_sections": _corpus,
    "s1_read_corpus_papers": _corpus_papers,
    "s2_read_artifacts": _read_artifacts,
    "s3_read_activity": _read_activity,
    "s5_read_usage": _read_usage,
    "s4_read_run_logs": _run_logs,
    "s6_read_cache_files": _cache_files,
    "s7_write_artifacts": _artifacts,
    "s8_write_index": _index,
    "s9_write_stage": _stage,
    "s10_append_responses": _responses,
    "r1_parse_activity": _parsed,
    "r1_rejected_activity": _rejected,
    "r2_attempts_stream": _attempts,
    "r3_progress_stream": _progress,
    "r4_transition_stream": _changes,
}

_A = """a AS (SELECT 'u' || user_id AS page, CASE event_type WHEN 'purchase' THEN 'quiz' WHEN 'error' THEN 'noise' ELSE 'progress' END AS kind, ts AS "at", CAST(floor(value) AS BIGINT) AS correct, CAST(CASE WHEN event_id % 10 = 0 THEN 0 ELSE 1000 END AS BIGINT) AS total,
    's' || event_id || ',' || event_type AS read FROM events)"""
_GOOD = "page[-1] <> '7' AND (kind = 'progress' OR (kind = 'quiz' AND total > 0 AND correct BETWEEN 0 AND total))"

ORACLES = {
    "s1_read_corpus_sections": "SELECT CAST(doc_id AS VARCHAR) AS paper_id, CAST(i - 1 AS INT) AS section_no, md5(ls[i]) AS md5, CAST((i - 1) // 40 AS INT) AS page_start FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))",
    "s1_read_corpus_papers": "SELECT CAST(doc_id AS VARCHAR) AS paper_id, source, sha256(text) AS sha256 FROM documents",
    "s3_read_activity": f"WITH {_A} SELECT * FROM a",
    "s2_read_artifacts": """WITH n AS (SELECT n_regionkey AS k, count(DISTINCT n_name) AS n FROM nation GROUP BY 1), s AS (SELECT n_regionkey AS k, count(DISTINCT s_suppkey) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
        q AS (SELECT n_regionkey AS k, count(DISTINCT c_mktsegment) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
        SELECT 'page-' || r_regionkey AS page, 'p' || r_regionkey AS paper_id, r_name AS title, CAST(coalesce(s.n, 0) AS INT) AS n_sections, CAST(n.n AS INT) AS n_nodes, CAST(n.n - 1 AS INT) AS n_edges, CAST(coalesce(q.n, 0) AS INT) AS n_questions
        FROM region JOIN n ON n.k = r_regionkey LEFT JOIN s ON s.k = r_regionkey LEFT JOIN q ON q.k = r_regionkey WHERE r_regionkey <> 3""",
    "s4_read_run_logs": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS line_no FROM events),
        g AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM e WHERE event_id % 9 <> 0 AND event_id % 4 <> 0)
        SELECT event_type AS run, line_no, ['DEBUG', 'INFO', 'WARNING', 'ERROR'][event_id % 4 + 1] AS level, event_type AS stage, 'value ' || event_id AS message FROM g WHERE r <= 40""",
    "s5_read_usage": "SELECT o_orderpriority AS run, 'done' AS state, 'fast' AS lane, o_orderstatus AS model, count(*) AS calls, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS input_tokens, CAST(NULL AS BIGINT) AS output_tokens, 0.5::DOUBLE AS seconds FROM orders GROUP BY 1, 4",
    "s6_read_cache_files": "SELECT 'lang=' || coalesce(lang, '__HIVE_DEFAULT_PARTITION__') AS kind, CAST(sum(octet_length(encode(coalesce(text, ''))) + 1) AS BIGINT) AS bytes FROM documents GROUP BY 1",
    "s7_write_artifacts": "SELECT CAST(doc_id AS VARCHAR) AS paper_id, source AS title, length(text) AS size, true AS placed FROM documents",
    "s8_write_index": "SELECT source AS paper_id, doc_id AS chunk_no, md5(text) AS md5 FROM documents",
    "s9_write_stage": "SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'error'",
    "s10_append_responses": "SELECT sha256(conv_id || '|' || turn) AS request_key, md5(text) AS md5 FROM conversations",
    "r1_parse_activity": f"""WITH {_A} SELECT page, kind, "at", correct, total FROM a WHERE {_GOOD}""",
    "r1_rejected_activity": f"WITH {_A} SELECT page[-1] = '7' AS broken, count(*) AS n FROM a WHERE NOT ({_GOOD}) GROUP BY 1",
    "r2_attempts_stream": f"""WITH {_A} SELECT page, "at", correct, total FROM a WHERE kind = 'quiz' AND {_GOOD} QUALIFY row_number() OVER (PARTITION BY page ORDER BY "at" DESC, correct DESC) <= 20""",
    "r3_progress_stream": f"""WITH {_A} SELECT page, max("at") AS "at", arg_max(read, "at") AS read FROM a WHERE kind = 'progress' AND {_GOOD} GROUP BY page""",
    "r4_transition_stream": """WITH l AS (SELECT 'u' || user_id AS run, event_id AS ordinal, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before, event_type AS state FROM events)
        SELECT * FROM l WHERE before = 'click' AND state IN ('error', 'purchase')""",
}
