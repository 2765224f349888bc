"""Model replies behind a store, and extraction that needs no model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import capitalised, let, sentences
from ..shared import settle

Provider = Callable[[list[str]], list[str]]


def request_keys(requests: DataFrame, provider: str) -> DataFrame:
    """requests(request, ...) with request_key, a hash of who is asked and what."""
    return requests.withColumn("request_key", F.sha2(F.concat_ws("|", F.lit(provider), F.col("request")), 256))


def reverse_provider(requests: list[str]) -> list[str]:
    """A provider for tests: each request backwards."""
    return [r[::-1] for r in requests]


def enrich(requests: DataFrame, store: DataFrame, name: str, provider: Provider) -> tuple[DataFrame, DataFrame]:
    """(requests with reply, new rows for the store): replies of store(request_key, reply) are used again; what it lacks is asked once for each distinct request, in batches, and kept before it is joined."""
    keyed = request_keys(requests, name)
    missing = keyed.select("request_key", "request").distinct().join(store.select("request_key"), "request_key", "left_anti")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"request_key": batch["request_key"], "reply": provider(batch["request"].tolist())})

    new = settle(missing.mapInPandas(ask, "request_key string, reply string"))
    return keyed.join(store.select("request_key", "reply").unionAll(new), "request_key", "left"), new


def enrich_checked(requests: DataFrame, name: str, provider: Provider, problem: Column, retries: int = 2) -> DataFrame:
    """requests with reply, problem and rounds: replies with a problem are asked for again, the problem put after the request, up to `retries` times; what still has one keeps it."""
    store = requests.sparkSession.createDataFrame([], "request_key string, reply string")
    ask, done = requests, None
    for round_ in range(retries + 1):
        replied = enrich(ask, store, f"{name}/{round_}", provider)[0].withColumn("problem", problem).withColumn("rounds", F.lit(round_)).drop("request_key")
        replied = settle(replied)
        part = replied if round_ == retries else replied.where("problem is null")
        done = part if done is None else done.unionByName(part)
        ask = replied.where("problem is not null").withColumn("request", F.concat("request", F.lit("\nProblem: "), "problem")).drop("reply", "problem", "rounds")
    return done


def extractive_analysis(sections: DataFrame) -> DataFrame:
    """sections(doc_id, text) with summary (two sentences), key points (four), quotes (two), concepts and prior work (three and three of the first six capitalised words in order)."""
    said = F.when(F.size(sentences(F.col("text"))) > 0, sentences(F.col("text"))).otherwise(F.array(F.when(F.col("text") == "", "This section has little text.").otherwise(F.substring("text", 1, 200))))
    caps = F.slice(F.array_sort(F.array_distinct(capitalised(F.col("text"), 3))), 1, 6)
    out = sections.withColumn("__s", said).withColumn("__c", caps)
    return out.select("*", F.array_join(F.slice("__s", 1, 2), " ").alias("summary"), F.slice("__s", 1, 4).alias("key_points"), F.slice("__s", 1, 2).alias("key_quotes"), F.slice("__c", 1, 3).alias("concepts"), F.slice("__c", 4, 3).alias("prior_work")).drop("__s", "__c")


def extractive_quiz(sections: DataFrame) -> DataFrame:
    """(doc_id, question_no, question, correct, quote): a question for every sentence, on its third to sixth word; the answer is its first 18 words."""
    each = sections.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("n", "quote"))
    words = F.split("quote", r"\s+")
    about = F.array_join(F.transform(F.slice(words, 3, 4), lambda w: F.regexp_replace(w, "^[.,;:]+|[.,;:]+$", "")), " ")
    return each.select("doc_id", (F.col("n") + 1).alias("question_no"), F.concat(F.lit("What does the paper say about "), about, F.lit("?")).alias("question"), F.array_join(F.slice(words, 1, 18), " ").alias("correct"), "quote")


def check_answers(questions: DataFrame, sections: DataFrame) -> DataFrame:
    """questions(doc_id, question_no, options) with found: the place of the one option that the text has, -1 if none or several are there."""
    flat = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    both = questions.join(sections.select("doc_id", flat(F.col("text")).alias("__t")), "doc_id")
    hits = F.filter(F.transform("options", lambda o, i: F.when(F.col("__t").contains(flat(o)), i)), lambda i: i.isNotNull())
    return both.withColumn("found", let(hits, lambda h: F.when(F.size(h) == 1, h[0]).otherwise(-1))).drop("__t")


def frequent_terms(sections: DataFrame, k: int = 6) -> DataFrame:
    """(doc_id, term, n, rank): capitalised words that a section has twice or more, the k most frequent."""
    counts = sections.select("doc_id", F.explode(capitalised(F.col("text"), 2)).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n")).where("n >= 2")
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "term"))).where(F.col("rank") <= k)


def extractive_graph(sections: DataFrame) -> DataFrame:
    """(doc_id, source, relation, target): the section "uses" its four most frequent terms."""
    return frequent_terms(sections).where("rank <= 4").select("doc_id", F.lit("this work").alias("source"), F.lit("uses").alias("relation"), F.col("term").alias("target"))
