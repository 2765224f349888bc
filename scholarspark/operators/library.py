"""Analytics over a library: reading, quizzes, storage, cost, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import title_key
from ..shared import settle, written
from .substrings import having_all


def quiz_summary(attempts: DataFrame) -> DataFrame:
    """attempts(page, attempt_no, correct, total, at): attempts, the last one, and the best (the first of equals) of each page."""
    last = F.max_by(F.struct("correct", "total", "at"), "attempt_no")
    best = F.max_by(F.struct("correct", "total"), F.struct("correct", (-F.col("attempt_no")).alias("first")))
    out = attempts.groupBy("page").agg(F.count("*").alias("attempts"), last.alias("last"), best.alias("best"))
    return out.select("page", "attempts", F.col("last.correct").alias("last_correct"), F.col("last.total").alias("last_total"), F.col("last.at").alias("last_at"), F.col("best.correct").alias("best_correct"), F.col("best.total").alias("best_total"))


def reading_summary(state: DataFrame, pages: DataFrame) -> DataFrame:
    """pages(page, n_sections) with how many sections were read, of how many (what the state says, else the page), and when last; state(page, read array, total, at)."""
    return pages.join(state, "page", "left").select("page", F.coalesce(F.size(F.when(F.col("read").isNotNull(), F.col("read"))), F.lit(0)).alias("n_read"), F.coalesce("total", "n_sections").alias("n_total"), "at")


def library_totals(summaries: DataFrame) -> DataFrame:
    """One row from summaries(n_read, n_total, attempts, last_correct, last_total): pages, read to the end, quizzes taken, mean last score in whole percent or null."""
    score = F.when(F.col("last_total") > 0, F.col("last_correct") / F.col("last_total"))
    return summaries.agg(F.count("*").alias("ready"), F.count_if((F.col("n_total") > 0) & (F.col("n_read") >= F.col("n_total"))).alias("read_to_end"), F.count_if(F.col("attempts") > 0).alias("quizzes"), F.round(100 * F.avg(score)).cast("long").alias("mean_score"))


def score_by_section(answers: DataFrame) -> DataFrame:
    """answers(section, given, answer): right and total of each section."""
    return answers.groupBy("section").agg(F.count_if(F.col("given") == F.col("answer")).alias("right"), F.count("*").alias("total"))


def completed_readers(reads: DataFrame, sections: DataFrame) -> DataFrame:
    """Readers that have read every section: reads(reader, section, beat), sections(section, last_beat); a section counts once its last beat is reached. The number of sections is one row."""
    reached = reads.groupBy("reader", "section").agg(F.max("beat").alias("beat")).join(sections, "section").where(F.col("beat") >= F.col("last_beat"))
    total = sections.agg(F.count_distinct("section").alias("n_sections"))
    return reached.groupBy("reader").agg(F.count("*").alias("n")).join(F.broadcast(total), F.col("n") == F.col("n_sections")).select("reader", "n")


def connections(pages: DataFrame, concepts: DataFrame, min_papers: int = 2) -> DataFrame:
    """concepts(page, key, label) that `min_papers` papers share: key, label, papers. Pages(page, paper_id, title) of one paper, by id or else by title, count once."""
    paper = F.coalesce("paper_id", title_key(F.col("title")))
    each = concepts.join(pages.select("page", paper.alias("paper")), "page")
    return each.groupBy("key").agg(F.min("label").alias("label"), F.count_distinct("paper").alias("papers")).where(F.col("papers") >= min_papers)


def search_library(pages: DataFrame, concepts: DataFrame, query: str, limit: int = 12) -> DataFrame:
    """Pages(page, meta) whose meta text has all terms, or one of whose concepts(page, label, text) has: page, in_meta, and up to `limit` matched labels. Metadata hits rank first, then by number of labels."""
    terms = query.lower().split()
    has = lambda c: F.forall(F.array(*map(F.lit, terms)), lambda t: F.lower(c).contains(t))
    hit = concepts.where(has(F.col("text"))).groupBy("page").agg(F.slice(F.array_sort(F.collect_set("label")), 1, limit).alias("matched"))
    found = pages.withColumn("in_meta", has(F.col("meta"))).join(hit, "page", "left").where(F.col("in_meta") | F.col("matched").isNotNull())
    return found.select("page", "in_meta", F.coalesce(F.size(F.when(F.col("matched").isNotNull(), F.col("matched"))), F.lit(0)).alias("n_matched"), "matched")


def search_library_all(pages: DataFrame, concepts: DataFrame, queries: DataFrame, limit: int = 12) -> DataFrame:
    """search_library for each of queries(query, text), whose terms meet all texts together: query, page, in_meta, n_matched, matched. Queries without terms find nothing.

    Of a page's labels the first go on from each task, so that none gathers all that a query finds."""
    asked = settle(queries.select("query", F.filter(F.split(F.lower("text"), r"\s+"), lambda t: t != "").alias("terms")))
    meta = having_all(asked, pages.select("page", "meta"), "page", F.col("meta")).withColumn("in_meta", F.lit(True))
    each = concepts.select(F.struct("page", "label", F.monotonically_increasing_id().alias("concept")).alias("concept"), "text")
    hit = having_all(asked, each, "concept", F.col("text")).select("query", "concept.page", "concept.label")
    nth = F.dense_rank().over(Window.partitionBy("query", "page").orderBy(F.col("label").asc_nulls_last()))
    first = hit.withColumn("__r", nth).where(F.col("__r") <= limit)
    matched = first.groupBy("query", "page").agg(F.array_sort(F.collect_set("label")).alias("matched")).join(pages.select("page"), "page", "left_semi")
    both = meta.join(matched, ["query", "page"], "full")
    return both.select("query", "page", F.coalesce("in_meta", F.lit(False)).alias("in_meta"), F.coalesce(F.size(F.when(F.col("matched").isNotNull(), F.col("matched"))), F.lit(0)).alias("n_matched"), "matched")


def filter_pages(pages: DataFrame, hits: DataFrame, query: str) -> DataFrame:
    """Pages that are search hits or have the query in their title or name."""
    named = pages.where(F.lower("title").contains(query.lower()) | F.lower("name").contains(query.lower()))
    return named.select("page").unionAll(pages.join(hits, "page", "left_semi").select("page")).distinct()


def filter_pages_all(pages: DataFrame, hits: DataFrame, queries: DataFrame) -> DataFrame:
    """filter_pages for each of queries(query, text) with its hits(query, page), by an index of runs of characters: (query, page). Empty queries find their hits only."""
    said = pages.select("page", F.explode(F.array("title", "name")).alias("text")).where("text is not null")
    said = written(said.withColumn("at", F.monotonically_increasing_id()))
    named = having_all(queries.select("query", F.array(F.lower("text")).alias("terms")), said, "at", F.col("text")).join(said, "at").select("query", "page")
    return named.unionAll(hits.select("query", "page").join(pages.select("page"), "page", "left_semi").select("query", "page")).distinct()


def cache_by_kind(files: DataFrame) -> DataFrame:
    """files(kind, bytes): files and bytes of each kind."""
    return files.groupBy("kind").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def cache_by_project(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """manifests(project, file), files(file, bytes): files, bytes, and bytes that no other project lists."""
    listed = manifests.distinct()
    owners = listed.groupBy("file").agg(F.count("*").alias("owners"))
    each = listed.join(owners, "file").join(files.groupBy("file").agg(F.max("bytes").alias("bytes")), "file")
    return each.groupBy("project").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sum(F.when(F.col("owners") == 1, F.col("bytes")).otherwise(0)).alias("own_bytes"))


def exclusive_files(manifests: DataFrame, project: str) -> DataFrame:
    """Files of one project that no other lists."""
    return manifests.where(F.col("project") == project).select("file").distinct().join(manifests.where(F.col("project") != project).select("file"), "file", "left_anti")


def merge_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """The distinct files of both."""
    return old.unionAll(new).distinct()


def price_usage(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage(..., model) with price: of the longest known name that the model is or begins with and a hyphen; what stands before a slash is cut; null if unknown.

    Every prefix of a model's name that ends before a hyphen is looked up, so the join is on equality.
    """
    name = F.element_at(F.split(F.lower("model"), "/"), -1)
    parts = F.split(name, "-")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "-"))
    models = usage.select("model").distinct()
    known = models.select("model", F.explode(prefixes).alias("name")).join(prices, "name").groupBy("model").agg(F.max_by("price", F.length("name")).alias("price"))
    return usage.join(known, "model", "left")


def run_costs(usage: DataFrame) -> DataFrame:
    """usage(run, calls, tokens, cost): sums of each run; the cost is null if any part is."""
    return usage.groupBy("run").agg(F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"), F.when(F.count("*") == F.count("cost"), F.round(F.sum("cost"), 4)).alias("cost"))


def estimate(papers: DataFrame, models: DataFrame) -> DataFrame:
    """papers(paper, pages), models(model, price_in, price_out): for each model tokens and cost over all papers at 16,000 tokens in and 2,100 out a page (15 pages where unknown), and whether any page count was guessed.

    Papers are summed first, and the sum, one row, goes to every model."""
    total = papers.agg(F.sum(F.coalesce("pages", F.lit(15))).alias("n_pages"), F.bool_or(F.col("pages").isNull()).alias("guessed"))
    cost = F.round(F.col("n_pages") * (16000 * F.col("price_in") + 2100 * F.col("price_out")) / 1e6, 4)
    return models.join(F.broadcast(total)).select("model", "n_pages", (F.col("n_pages") * 16000).alias("tokens_in"), (F.col("n_pages") * 2100).alias("tokens_out"), cost.alias("cost"), F.col("price_in").isNull().alias("unknown"), "guessed")


def recent_attempts(attempts: DataFrame, n: int = 200) -> DataFrame:
    """The newest n attempts of each page."""
    newest = Window.partitionBy("page").orderBy(F.desc("attempt_no"))
    return attempts.withColumn("__r", F.row_number().over(newest)).where(F.col("__r") <= n).drop("__r")


def queue_positions(runs: DataFrame) -> DataFrame:
    """runs(run, lane, state, ordinal): place of each queued run in its lane."""
    return runs.where("state = 'queued'").withColumn("position", F.row_number().over(Window.partitionBy("lane").orderBy("ordinal")))


def transitions(status: DataFrame, sources: tuple[str, ...] = ("running",), ends: tuple[str, ...] = ("done", "failed")) -> DataFrame:
    """status(run, ordinal, state): where a run goes from one of `sources` to one of `ends`."""
    before = F.lag("state").over(Window.partitionBy("run").orderBy("ordinal"))
    return status.withColumn("before", before).where(F.col("before").isin(*sources) & F.col("state").isin(*ends))


def order_runs(runs: DataFrame) -> DataFrame:
    """Running, then queued, then the rest, newest first."""
    rank = F.when(F.col("state") == "running", 0).when(F.col("state") == "queued", 1).otherwise(2)
    return runs.orderBy(rank, F.desc("created"), "run")


def view_stats(beats: DataFrame) -> DataFrame:
    """beats(view, narration, wants_diagram): beats, words, minutes at 150 words a minute, diagrams asked for."""
    words = F.size(F.filter(F.split("narration", r"\s+"), lambda w: w != ""))
    return beats.groupBy("view").agg(F.count("*").alias("beats"), F.sum(words).alias("words"), F.round(F.sum(words) / 150, 1).alias("minutes"), F.count_if("wants_diagram").alias("diagrams"))


def artifact_counts(diagrams: DataFrame, issues: DataFrame) -> DataFrame:
    """(what, n): diagrams(type) by type, issues(beat_id, applied), and corrected beats."""
    kinds = diagrams.groupBy(F.concat(F.lit("diagram "), "type").alias("what")).agg(F.count("*").alias("n"))
    rest = issues.agg(F.count("*").alias("issues"), F.count_distinct(F.when(F.col("applied"), F.col("beat_id"))).alias("corrected"))
    return kinds.unionAll(rest.select(F.inline(F.array(F.struct(F.lit("issues").alias("what"), F.col("issues").alias("n")), F.struct(F.lit("corrected beats").alias("what"), F.col("corrected").alias("n"))))))


def best_per_series(values: DataFrame, lower_is_better: Column | bool = False) -> DataFrame:
    """values(series, ordinal, category, value): the best value of each series and the first category that has it; nulls don't count."""
    sign = F.when(F.lit(lower_is_better) if isinstance(lower_is_better, bool) else lower_is_better, -F.col("value")).otherwise(F.col("value"))
    best = F.max_by(F.struct("category", "value"), F.struct(sign.alias("v"), (-F.col("ordinal")).alias("first")))
    return values.where("value is not null").groupBy("series").agg(best.alias("b")).select("series", F.col("b.category").alias("category"), F.col("b.value").alias("value"))
