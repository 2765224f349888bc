"""Queries over library analytics and question sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import QUESTION_STOP
from ..operators import assessment as Q
from ..operators import library as L
from ..sources.tables import table, titles

TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


def _attempts(spark, d):
    """events as quiz attempts: a page for each user, attempts numbered by event."""
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("page"), F.col("event_id").alias("attempt_no"), F.col("value").cast("long").alias("correct"), F.lit(100).cast("long").alias("total"), F.col("ts").alias("at"))


def _reading(spark, d):
    e = table(spark, d, "events").where("event_type <> 'error'")
    state = e.groupBy(F.col("user_id").alias("page")).agg(F.collect_set("event_type").alias("read"), F.lit(None).cast("long").alias("total"), F.max("ts").alias("at"))
    pages = table(spark, d, "events").select(F.col("user_id").alias("page")).distinct().withColumn("n_sections", F.col("page") % 5 + 1)
    return L.reading_summary(state, pages)


def _totals(spark, d):
    return L.library_totals(_reading(spark, d).join(L.quiz_summary(_attempts(spark, d).where("page % 3 > 0")), "page", "left"))


def _answers(spark, d):
    a = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return a.select(F.col("source").alias("section"), F.col("quality").alias("given"), (F.col("toxic") == 0).cast("int").alias("answer"), "doc_id")


def _completed(spark, d):
    e = table(spark, d, "events")
    reads = e.select(F.col("user_id").alias("reader"), F.col("event_type").alias("section"), (F.col("value") % 7).cast("long").alias("beat"))
    sections = e.groupBy(F.col("event_type").alias("section")).agg(F.lit(4).cast("long").alias("last_beat"))
    return L.completed_readers(reads, sections)


def _connections(spark, d):
    docs = table(spark, d, "documents")
    pages = docs.select(F.col("doc_id").alias("page"), F.col("source").alias("paper_id"), F.lit("").alias("title"))
    words = docs.select(F.col("doc_id").alias("page"), F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{5,}"), F.lit(0))).alias("label"))
    return L.connections(pages, words.withColumn("key", F.lower("label")), 3)


def _search(spark, d):
    docs = table(spark, d, "documents")
    pages = docs.groupBy(F.col("source").alias("page")).agg(F.array_join(F.array_sort(F.collect_set("lang")), " ").alias("meta"))
    concepts = docs.select(F.col("source").alias("page"), F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 6, "0")).alias("label"), "text")
    return L.search_library(pages, concepts, "license apache").select("page", "in_meta", "n_matched", F.array_join("matched", ",").alias("matched"))


def _search_many(spark, d):
    """Every source as a page and every document as a concept, asked for the first two words of every benchmark passage."""
    docs = table(spark, d, "documents")
    pages = docs.groupBy(F.col("source").alias("page")).agg(F.concat_ws(" ", F.col("source"), F.array_join(F.array_sort(F.collect_set("lang")), " ")).alias("meta"))
    concepts = docs.select(F.col("source").alias("page"), F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 6, "0")).alias("label"), "text")
    words = F.slice(F.split(F.trim("text"), r"\s+"), 1, 2)
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.when(F.col("item_id") % 4 == 0, F.concat(F.lit("SRC1 e"), F.substring(F.element_at(words, 1), 1, 1))).otherwise(F.array_join(words, " ")).alias("text"))
    return L.search_library_all(pages, concepts, asked).select("query", "page", "in_meta", "n_matched", F.array_join("matched", ",").alias("matched"))


def _filter_many(spark, d):
    """Pages for the beginning, of one to five characters, of every nation's name."""
    p = titles(spark, d).select(F.col("page_id").alias("page"), "title", F.col("url").alias("name"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("query"), F.expr("substring(n_name, 1, n_nationkey % 5 + 1)").alias("text"))
    return L.filter_pages_all(p, p.where("page % 10 = 0").select((F.col("page") % 25).cast("int").alias("query"), "page"), n)


def _filter_pages(spark, d):
    p = titles(spark, d).select(F.col("page_id").alias("page"), "title", F.col("url").alias("name"))
    return L.filter_pages(p, p.where("page % 10 = 0").select("page"), "the")


def _manifest(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("project"), F.md5("text").alias("file"))


def _files(spark, d):
    return table(spark, d, "documents").select(F.md5("text").alias("file"), F.col("n_chars").alias("bytes")).distinct()


def _exclusive(spark, d):
    return L.exclusive_files(_manifest(spark, d), "src3")


def _merged(spark, d):
    m = _manifest(spark, d)
    return L.merge_manifest(m.where("project < 'src3'").select("file"), m.where("project > 'src2'").select("file"))


def _usage(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    model = F.concat(F.when(F.col("o_orderkey") % 2 == 0, F.lit("vendor/")).otherwise(""), F.lower("c_mktsegment"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("-large-v2")).when(F.col("o_orderkey") % 3 == 1, F.lit("-small")).otherwise("x"))
    return o.select(F.col("o_custkey").alias("run"), model.alias("model"), F.lit(1).cast("long").alias("calls"), F.floor("o_totalprice").alias("tokens"))


def _prices(spark, d):
    seg = table(spark, d, "customer").select(F.lower("c_mktsegment").alias("name")).distinct().where("name <> 'machinery'")
    base = seg.select("name", F.length("name").cast("double").alias("price"))
    return base.unionAll(base.select(F.concat("name", F.lit("-large")).alias("name"), (F.col("price") * 10).alias("price")))


def _priced(spark, d):
    return L.price_usage(_usage(spark, d), _prices(spark, d)).groupBy("model").agg(F.count("*").alias("n"), F.max("price").alias("price"))


def _costs(spark, d):
    return L.run_costs(L.price_usage(_usage(spark, d), _prices(spark, d)).withColumn("cost", F.col("tokens") * F.col("price") / 1e6))


def _estimate(spark, d):
    papers = table(spark, d, "documents").select(F.col("doc_id").alias("paper"), F.when(F.col("doc_id") % 7 > 0, F.floor(F.col("n_chars") / 3000) + 1).alias("pages"))
    models = table(spark, d, "nation").select(F.col("n_name").alias("model"), F.when(F.col("n_nationkey") % 5 > 0, F.col("n_nationkey") * 0.25).alias("price_in"), F.col("n_regionkey").cast("double").alias("price_out"))
    return L.estimate(papers, models)


def _runs(spark, d):
    o = table(spark, d, "orders")
    state = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("done")
    return o.select(F.col("o_orderkey").alias("run"), F.col("o_orderpriority").alias("lane"), state.alias("state"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderdate").alias("created"))


def _transitions(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("ordinal"), F.col("event_type").alias("state"))
    return L.transitions(e, ("click",), ("error", "purchase")).select("run", "ordinal", "before", "state")


def _beats(spark, d):
    c = table(spark, d, "conversations")
    return L.view_stats(c.select(F.col("role").alias("view"), F.col("text").alias("narration"), (F.col("turn") == 0).alias("wants_diagram")))


def _artifact(spark, d):
    i = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("beat_id"), (F.col("l_returnflag") == "R").alias("applied"))
    return L.artifact_counts(table(spark, d, "part").select(F.lower("p_type").alias("type")), i)


def _series(spark, d):
    p = table(spark, d, "part")
    return L.best_per_series(p.select(F.col("p_brand").alias("series"), F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("category"), F.when(F.col("p_size") > 5, F.col("p_retailprice")).alias("value")))


def _sizes(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy(F.col("n_regionkey").alias("paper"), F.col("n_nationkey").alias("section")).agg((F.count("*") * (F.col("n_nationkey") % 5 + 1)).alias("size")).withColumn("section_no", F.col("section"))


def _questions(spark, d):
    o = table(spark, d, "orders")
    return o.select((F.col("o_custkey") % 50).alias("paper"), F.col("o_custkey").alias("section"), F.col("o_custkey").alias("section_no"), F.col("o_orderkey").alias("ordinal"))


def _four(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select((k % 20).alias("paper"), k.alias("id"), F.concat(F.lit("q"), k).alias("question"), F.array(*[F.concat(F.lit(x), k) for x in "abcd"]).alias("options"), (k % 4).cast("int").alias("answer"))


def _problems(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    q = p.select("p_partkey", F.when(k % 5 == 0, "").otherwise(F.col("p_name")).alias("question"), F.col("p_type").alias("correct"), F.col("p_brand").alias("explanation"), F.when(k % 3 == 0, F.array(F.lit("x"), F.lit("y"), F.lower("p_type"))).when(k % 7 == 0, F.array(F.lit("x"), F.lit(""))).otherwise(F.array(F.lit("x"), F.lit("y"), F.lit("None of the above"))).alias("distractors"))
    return Q.question_problems(q).select("p_partkey", F.array_join("problems", "; ").alias("problems"))


def _agree(spark, d):
    a = _answers(spark, d).select(F.col("doc_id").alias("question_id"), "given", "answer")
    replies = a.select("question_id", F.when(F.col("given") == 1, "Option B").otherwise("A) yes").alias("reply"))
    return Q.agree_keys(a.select("question_id", "answer"), replies).select("question_id", "answer", "agreed")


def _quiz_stats(spark, d):
    a = _answers(spark, d)
    return Q.quiz_stats(a.select("section", (F.col("doc_id") % 6 == 0).alias("malformed"), (F.col("given") == F.col("answer")).alias("agreed")))


def _best_beat(spark, d):
    b = table(spark, d, "documents").select(F.col("lang").alias("paper_id"), F.col("source").alias("section_id"), F.col("doc_id").alias("beat_id"), F.col("doc_id").alias("beat_no"), F.when(F.col("doc_id") % 2 == 0, "deep").otherwise("high").alias("view"), "text")
    q = table(spark, d, "benchmark").select(F.lit("en").alias("paper_id"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("section_id"), F.col("item_id").alias("question_id"), "text")
    return Q.best_beat(q, b)


def _drop_similar(spark, d):
    p = table(spark, d, "part")
    q = p.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", F.col("p_name"), F.lower("p_type"), F.concat(F.lit("size"), F.col("p_size")), F.concat(F.lit("word"), F.col("p_partkey") % 40)).alias("question"), F.lit("").alias("correct"))
    return Q.drop_similar(q).select("id")


def _top_up(spark, d):
    s = _sizes(spark, d)
    return Q.top_up(s, s.select("paper").distinct().withColumn("n", F.col("paper") * 3), 9)


QUERIES = {
    "a12_quiz_summary": lambda s, d: L.quiz_summary(_attempts(s, d)),
    "a13_reading_summary": _reading,
    "a14_library_totals": _totals,
    "a15_score_by_section": lambda s, d: L.score_by_section(_answers(s, d)),
    "a16_completed_readers": _completed,
    "a10_connections": _connections,
    "a11_search_library": _search,
    "p12_filter_pages": _filter_pages,
    "a11_search_many": _search_many,
    "p12_filter_many": _filter_many,
    "a17_cache_by_kind": lambda s, d: L.cache_by_kind(table(s, d, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_quantity").cast("long").alias("bytes"))),
    "a18_cache_by_project": lambda s, d: L.cache_by_project(_manifest(s, d), _files(s, d)),
    "u1_exclusive_files": _exclusive,
    "s11_merge_manifest": _merged,
    "j20_price_usage": _priced,
    "a19_run_costs": _costs,
    "a20_estimate": _estimate,
    "w12_recent_attempts": lambda s, d: L.recent_attempts(_attempts(s, d), 20),
    "w10_queue_positions": lambda s, d: L.queue_positions(_runs(s, d)).select("run", "lane", "position"),
    "w11_transitions": _transitions,
    "t9_order_runs": lambda s, d: L.order_runs(_runs(s, d)).select("run", "state"),
    "a21_view_stats": _beats,
    "a25_artifact_counts": _artifact,
    "t12_best_per_series": _series,
    "p5_question_problems": _problems,
    "t4_plan_quota": lambda s, d: Q.plan_quota(_sizes(s, d), 10),
    "t5_round_robin": lambda s, d: Q.round_robin(_questions(s, d), 12).select("paper", "section", "ordinal", "depth", "pick"),
    "t6_top_up": _top_up,
    "t7_balance_answers": lambda s, d: Q.balance_answers(_four(s, d)).select("id", F.array_join("options", ",").alias("options"), "answer"),
    "t8_shuffle_options": lambda s, d: Q.shuffle_options(_four(s, d)).select("id", F.array_join("options", ",").alias("options"), "answer"),
    "j21_agree_keys": _agree,
    "a24_quiz_stats": _quiz_stats,
    "j19_best_beat": _best_beat,
    "u3_drop_similar": _drop_similar,
    "u2_distinct_in_order": lambda s, d: Q.distinct_in_order(table(s, d, "orders").select("o_custkey", F.col("o_orderkey").alias("ordinal")), ["o_custkey"]),
}

_ATT = "a AS (SELECT user_id AS page, event_id AS attempt_no, CAST(trunc(value) AS BIGINT) AS correct, CAST(100 AS BIGINT) AS total, ts AS \"at\" FROM events)"
_SUM = "z AS (SELECT page, count(*) AS attempts, arg_max(correct, attempt_no) AS last_correct, arg_max(total, attempt_no) AS last_total, arg_max(\"at\", attempt_no) AS last_at, max(correct) AS best_correct, CAST(100 AS BIGINT) AS best_total FROM a GROUP BY page)"
_READ = "r AS (SELECT user_id AS page, count(DISTINCT event_type) FILTER (WHERE event_type <> 'error') AS n_read, user_id % 5 + 1 AS n_total, max(ts) FILTER (WHERE event_type <> 'error') AS \"at\" FROM events GROUP BY user_id)"
_ANS = "ans AS (SELECT l.doc_id, d.source AS section, l.quality AS given, CASE WHEN toxic = 0 THEN 1 ELSE 0 END AS answer FROM labels l JOIN documents d USING (doc_id))"
_SIZES = "s AS (SELECT n_regionkey AS paper, n_nationkey AS section, count(*) * (n_nationkey % 5 + 1) AS size FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey, n_nationkey)"
_PRICE = """u AS (SELECT o_custkey AS run, (CASE WHEN o_orderkey % 2 = 0 THEN 'vendor/' ELSE '' END) || lower(c_mktsegment) || (CASE o_orderkey % 3 WHEN 0 THEN '-large-v2' WHEN 1 THEN '-small' ELSE 'x' END) AS model,
        CASE WHEN c_mktsegment = 'MACHINERY' OR o_orderkey % 3 = 2 THEN NULL WHEN o_orderkey % 3 = 0 THEN length(c_mktsegment) * 10.0::DOUBLE ELSE length(c_mktsegment) * 1.0::DOUBLE END AS price, CAST(floor(o_totalprice) AS BIGINT) AS tokens
        FROM orders JOIN customer ON o_custkey = c_custkey)"""

ORACLES = {
    "a12_quiz_summary": f"WITH {_ATT}, {_SUM} SELECT * FROM z",
    "a13_reading_summary": f"WITH {_READ} SELECT page, CAST(n_read AS INT) AS n_read, n_total, \"at\" FROM r",
    "a14_library_totals": f"""WITH {_ATT}, {_SUM}, {_READ} SELECT count(*) AS ready, count(*) FILTER (WHERE n_read >= n_total) AS read_to_end, count(*) FILTER (WHERE attempts > 0) AS quizzes,
        CAST(round(100 * avg(last_correct / last_total)) AS BIGINT) AS mean_score FROM r LEFT JOIN (SELECT * FROM z WHERE page % 3 > 0) USING (page)""",
    "a15_score_by_section": f'WITH {_ANS} SELECT section, count(*) FILTER (WHERE given = answer) AS "right", count(*) AS total FROM ans GROUP BY section',
    "a16_completed_readers": """WITH r AS (SELECT user_id AS reader, event_type, max(CAST(trunc(value % 7) AS BIGINT)) AS b FROM events GROUP BY ALL HAVING b >= 4)
        SELECT reader, count(*) AS n FROM r GROUP BY reader HAVING count(*) = (SELECT count(DISTINCT event_type) FROM events)""",
    "a10_connections": r"""WITH w AS (SELECT source, unnest(regexp_extract_all(text, '[A-Z][a-z]{5,}')) AS label FROM documents)
        SELECT lower(label) AS key, min(label) AS label, count(DISTINCT source) AS papers FROM w GROUP BY lower(label) HAVING count(DISTINCT source) >= 3""",
    "a11_search_library": """WITH h AS (SELECT source AS page, 'd' || lpad(CAST(doc_id AS VARCHAR), 6, '0') AS label FROM documents WHERE contains(lower(text), 'license') AND contains(lower(text), 'apache')),
        m AS (SELECT page, list_sort(list(DISTINCT label))[1:12] AS ls FROM h GROUP BY page)
        SELECT page, false AS in_meta, CAST(len(ls) AS INT) AS n_matched, array_to_string(ls, ',') AS matched FROM m""",
    "a11_search_many": r"""WITH b AS (SELECT item_id, string_split_regex(trim(text), '\s+') AS w FROM benchmark),
        q AS (SELECT item_id AS query, lower(CASE WHEN item_id % 4 = 0 THEN 'SRC1' ELSE w[1] END) AS t1, lower(CASE WHEN item_id % 4 = 0 THEN 'e' || w[1][1] ELSE w[2] END) AS t2 FROM b),
        p AS (SELECT source AS page, lower(source || ' ' || array_to_string(list_sort(list(DISTINCT lang)), ' ')) AS meta FROM documents GROUP BY source),
        m AS (SELECT query, page FROM q, p WHERE contains(meta, t1) AND contains(meta, t2)),
        h AS (SELECT query, source AS page, list_sort(list(DISTINCT 'd' || lpad(CAST(doc_id AS VARCHAR), 6, '0')))[1:12] AS ls FROM q, documents WHERE contains(lower(text), t1) AND contains(lower(text), t2) GROUP BY ALL)
        SELECT query, page, m.query IS NOT NULL AS in_meta, CAST(coalesce(len(ls), 0) AS INT) AS n_matched, array_to_string(ls, ',') AS matched FROM m FULL JOIN h USING (query, page)""",
    "p12_filter_many": f"""WITH p AS (SELECT page_id AS page, lower({TITLE}) AS title, lower(url) AS name FROM pages)
        SELECT n_nationkey AS query, page FROM nation, p WHERE contains(title, lower(left(n_name, n_nationkey % 5 + 1))) OR contains(name, lower(left(n_name, n_nationkey % 5 + 1)))
        UNION SELECT CAST(page % 25 AS INT), page FROM p WHERE page % 10 = 0""",
    "p12_filter_pages": f"SELECT page_id AS page FROM pages WHERE page_id % 10 = 0 OR contains(lower({TITLE}), 'the') OR contains(lower(url), 'the')",
    "a17_cache_by_kind": "SELECT l_returnflag AS kind, count(*) AS files, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes FROM lineitem GROUP BY 1",
    "a18_cache_by_project": """WITH m AS (SELECT DISTINCT source AS project, md5(text) AS file, n_chars AS bytes FROM documents), o AS (SELECT file, count(*) AS n FROM m GROUP BY file)
        SELECT project, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(coalesce(sum(bytes) FILTER (WHERE n = 1), 0) AS BIGINT) AS own_bytes FROM m JOIN o USING (file) GROUP BY project""",
    "u1_exclusive_files": "SELECT DISTINCT md5(text) AS file FROM documents WHERE source = 'src3' AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE source <> 'src3')",
    "s11_merge_manifest": "SELECT md5(text) AS file FROM documents WHERE source < 'src3' UNION SELECT md5(text) FROM documents WHERE source > 'src2'",
    "j20_price_usage": f"WITH {_PRICE} SELECT model, count(*) AS n, max(price) AS price FROM u GROUP BY model",
    "a19_run_costs": f"WITH {_PRICE} SELECT run, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, CASE WHEN count(*) = count(price) THEN round(sum(tokens * price / 1e6), 4) END AS cost FROM u GROUP BY run",
    "a20_estimate": """WITH t AS (SELECT CAST(sum(CASE WHEN doc_id % 7 > 0 THEN n_chars // 3000 + 1 ELSE 15 END) AS BIGINT) AS n FROM documents)
        SELECT n_name AS model, n AS n_pages, n * 16000 AS tokens_in, n * 2100 AS tokens_out, CASE WHEN n_nationkey % 5 > 0 THEN round(n * (16000 * (n_nationkey * 0.25::DOUBLE) + 2100 * n_regionkey::DOUBLE) / 1e6, 4) END AS cost,
        n_nationkey % 5 = 0 AS unknown, true AS guessed FROM nation, t""",
    "w12_recent_attempts": f"WITH {_ATT} SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY page ORDER BY attempt_no DESC) <= 20",
    "w10_queue_positions": "SELECT o_orderkey AS run, o_orderpriority AS lane, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS position FROM orders WHERE o_orderstatus = 'O'",
    "w11_transitions": """WITH l AS (SELECT user_id AS run, event_id AS ordinal, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before, event_type AS state FROM events)
        SELECT * FROM l WHERE before = 'click' AND state IN ('error', 'purchase')""",
    "t9_order_runs": "SELECT o_orderkey AS run, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'done' END AS state FROM orders",
    "a21_view_stats": r"""WITH w AS (SELECT role, turn, len(regexp_extract_all(text, '\S+')) AS n FROM conversations)
        SELECT role AS view, count(*) AS beats, CAST(sum(n) AS BIGINT) AS words, round(sum(n) / 150.0::DOUBLE, 1) AS minutes, count(*) FILTER (WHERE turn = 0) AS diagrams FROM w GROUP BY role""",
    "a25_artifact_counts": """SELECT 'diagram ' || lower(p_type) AS what, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT 'issues', count(*) FROM lineitem
        UNION ALL SELECT 'corrected beats', count(DISTINCT l_suppkey) FROM lineitem WHERE l_returnflag = 'R'""",
    "t12_best_per_series": "SELECT p_brand AS series, arg_max(p_name, struct_pack(v := p_retailprice, f := -p_partkey)) AS category, max(p_retailprice) AS value FROM part WHERE p_size > 5 GROUP BY p_brand",
    "p5_question_problems": """SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 5 = 0 THEN 'question, correct answer and explanation are required' END,
        CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 7 = 0 THEN 'needs 3 non-empty distractors' END, CASE WHEN p_partkey % 3 = 0 THEN 'the four options must be different' END,
        CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 7 <> 0 THEN 'no "all/none of the above"' END], lambda x: x IS NOT NULL), '; ') AS problems FROM part""",
    "t4_plan_quota": f"""WITH {_SIZES}, b AS (SELECT *, greatest(15, count(*) OVER w) AS want, CAST(greatest(1, least(4, round_even(greatest(15, count(*) OVER w) * size / sum(size) OVER w, 0))) AS INT) AS base FROM s WINDOW w AS (PARTITION BY paper)),
        l AS (SELECT *, greatest(0, want - sum(base) OVER (PARTITION BY paper)) AS lft FROM b),
        m AS (SELECT paper, section, lft, row_number() OVER (PARTITION BY paper ORDER BY size / k DESC, section) AS r FROM (SELECT *, unnest(generate_series(base + 1, 4)) AS k FROM l WHERE base < 4)),
        g AS (SELECT paper, section, count(*) AS more FROM m WHERE r <= lft GROUP BY ALL)
        SELECT l.paper, l.section, CAST(base + coalesce(more, 0) AS INT) AS quota FROM l LEFT JOIN g USING (paper, section)""",
    "t5_round_robin": """WITH q AS (SELECT o_custkey % 50 AS paper, o_custkey AS section, o_orderkey AS ordinal, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS depth FROM orders),
        p AS (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY depth, section) AS pick FROM q) SELECT * FROM p WHERE pick <= 12""",
    "t6_top_up": f"""WITH {_SIZES}, p AS (SELECT *, 9 - paper * 3 AS need, row_number() OVER (PARTITION BY paper ORDER BY size DESC, section) AS pos, count(*) OVER (PARTITION BY paper) AS n FROM s),
        k AS (SELECT paper, section, pos, n, unnest(generate_series(0, need + greatest(2, need // 2) - 1)) AS k FROM p WHERE need > 0)
        SELECT paper, section, CAST(least(4, count(*)) AS INT) AS ask FROM k WHERE k % n = pos - 1 GROUP BY paper, section""",
    "t7_balance_answers": """WITH q AS (SELECT o_orderkey AS id, o_orderkey % 4 AS a, ['a' || o_orderkey, 'b' || o_orderkey, 'c' || o_orderkey, 'd' || o_orderkey] AS o,
        CAST((row_number() OVER (PARTITION BY o_orderkey % 20 ORDER BY sha256('q' || o_orderkey), 'q' || o_orderkey) - 1) % 4 AS INT) AS slot FROM orders),
        x AS (SELECT *, list_filter(o, lambda v, i: i <> a + 1) AS r FROM q) SELECT id, array_to_string(list_concat(list_concat(r[1:slot], [o[a + 1]]), r[slot + 1:3]), ',') AS options, slot AS answer FROM x""",
    "t8_shuffle_options": """WITH o AS (SELECT o_orderkey AS id, unnest(['a', 'b', 'c', 'd']) || o_orderkey AS v FROM orders), r AS (SELECT id, v, row_number() OVER (PARTITION BY id ORDER BY sha256('q' || id || '|' || v)) AS n FROM o)
        SELECT id, string_agg(v, ',' ORDER BY n) AS options, CAST(max(n) FILTER (WHERE v[1] = 'a') - 1 AS INT) AS answer FROM r GROUP BY id""",
    "j21_agree_keys": f"WITH {_ANS} SELECT doc_id AS question_id, answer, given = answer AS agreed FROM ans",
    "a24_quiz_stats": f"""WITH {_ANS} SELECT count(*) AS asked, count(*) FILTER (WHERE doc_id % 6 = 0) AS malformed, count(*) FILTER (WHERE doc_id % 6 <> 0 AND given <> answer) AS disputed,
        count(*) FILTER (WHERE doc_id % 6 <> 0 AND given = answer) AS kept, count(DISTINCT section) FILTER (WHERE doc_id % 6 <> 0 AND given = answer) AS sections FROM ans""",
    "j19_best_beat": r"""WITH b AS (SELECT source, doc_id, doc_id % 2 AS later, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]{4,}'), lambda t: t NOT IN (STOPS))) AS h FROM documents WHERE lang = 'en'),
        q AS (SELECT item_id, 'src' || (item_id % 20) AS source, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]{4,}'), lambda t: t NOT IN (STOPS))) AS g FROM benchmark),
        s AS (SELECT item_id, doc_id, later, round(len(list_intersect(g, h)) / greatest(len(list_distinct(list_concat(g, h))), 1)::DOUBLE, 6) AS score FROM q JOIN b USING (source))
        SELECT item_id AS question_id, doc_id AS beat_id, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, later, doc_id) = 1""".replace("STOPS", ", ".join(f"'{x}'" for x in QUESTION_STOP)),
    "u3_drop_similar": """WITH RECURSIVE q AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_partkey) AS n, list_distinct(list_filter(regexp_extract_all(p_name || ' ' || lower(p_type) || ' size' || p_size || ' word' || (p_partkey % 40), '[a-z0-9]{4,}'), lambda t: t NOT IN (STOPS))) AS w FROM part),
        u AS (SELECT n, len(w) AS size, unnest(w) AS word FROM q),
        c AS (SELECT a.n AS first, b.n, count(*) / (any_value(a.size) + any_value(b.size) - count(*))::DOUBLE AS share FROM u a JOIN u b ON a.word = b.word AND a.n < b.n GROUP BY ALL),
        e AS MATERIALIZED (SELECT n, list(first) AS earlier FROM c WHERE share >= 0.6 GROUP BY n),
        r AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS kept UNION ALL
              SELECT r.n + 1, CASE WHEN e.earlier IS NOT NULL AND list_has_any(e.earlier, r.kept) THEN r.kept ELSE list_append(r.kept, r.n + 1) END FROM r LEFT JOIN e ON e.n = r.n + 1 WHERE r.n < (SELECT max(n) FROM q))
        SELECT id FROM q WHERE n IN (SELECT unnest(kept) FROM r WHERE n = (SELECT max(n) FROM q))""".replace("STOPS", ", ".join(f"'{x}'" for x in QUESTION_STOP)),
    "u2_distinct_in_order": "SELECT o_custkey, min(o_orderkey) AS ordinal FROM orders GROUP BY o_custkey",
}
