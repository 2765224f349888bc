"""Queries over text functions and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from ..sources.tables import table, titles


def _words(xs):
    return ", ".join(f"'{x}'" for x in xs)


TOKENS = f"list_filter(regexp_extract_all(lower(text), '{T.TOKEN}'), lambda t: t NOT IN ({_words(T.STOP)}))"
BM25 = rf"""
    WITH d AS (SELECT doc_id, {TOKENS} AS toks FROM documents),
    p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM d) GROUP BY ALL),
    n AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avg_length FROM d),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    idx AS (SELECT p.doc_id AS doc, p.term, p.tf, f.df, ln(1 + (n_docs - f.df + 0.5::DOUBLE) / (f.df + 0.5::DOUBLE)) AS idf, len(d.toks) AS length, avg_length
            FROM p JOIN f USING (term) JOIN d USING (doc_id), n),
    q AS (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark),
    qt AS (SELECT item_id AS query, term, count(*) AS times FROM q GROUP BY ALL),
    s AS (SELECT query, doc, round(sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avg_length))), 6) AS score
          FROM qt JOIN idx USING (term) GROUP BY ALL HAVING score > 0),
    top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s)
"""


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def _scores(spark, d):
    asked = table(spark, d, "benchmark")
    return R.bm25_score(asked, R.bm25_index(_docs(spark, d), terms=R.query_terms(asked)))


def _scoped(spark, d):
    """Every source as a paper of its own, asked with every benchmark passage whose number is its last digits."""
    docs = table(spark, d, "documents").select("source", "doc_id", "text")
    asked = table(spark, d, "benchmark").select(F.concat(F.lit("src"), F.col("item_id") % 20).alias("source"), "item_id", "text")
    return R.bm25_search(asked, docs, 5, ["source"])


def _of_docs(**columns):
    """A query that gives columns of each document."""
    return lambda spark, d: _docs(spark, d).select("doc_id", *[f(F.col("text")).alias(name) for name, f in columns.items()])


def _joined(c, by=" "):
    return F.array_join(c, by)


def _tokens(spark, d):
    return _docs(spark, d).select("doc_id", F.size(T.tokenize(F.col("text"))).cast("long").alias("n"), _joined(T.tokenize(F.col("text"))).alias("tokens"))


def _parse_number(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    v = F.format_string("%.2f", "o_totalprice")
    s = F.when(k % 6 == 0, v).when(k % 6 == 1, F.concat(v, F.lit("%"))).when(k % 6 == 2, F.concat(k % 9 + 1, F.lit(" × 10^"), k % 12)).when(k % 6 == 3, F.concat(k % 9 + 1, F.lit(","), F.lpad((k % 1000).cast("string"), 3, "0"))).when(k % 6 == 4, F.lit("n/a")).otherwise(F.concat(F.lit("$"), k % 9 + 1, F.lit(r" \cdot 10^{"), k % 9, F.lit("}$")))
    return o.select("o_orderkey", T.parse_number(s).alias("number"))


def _choose(spark, d):
    e = table(spark, d, "events")
    v = F.when(F.col("event_id") % 4 == 0, "Methods").when(F.col("event_id") % 4 == 1, "prior-work").when(F.col("event_id") % 4 == 2, "data").otherwise(F.col("event_type"))
    return e.select("event_id", T.choose(v, T.NODE_TYPES, "concept").alias("kind"))


def _relation(spark, d):
    p = table(spark, d, "part")
    said = F.concat(F.col("p_name"), F.element_at(F.array(*map(F.lit, ["uses", " Outperforms it", "Measured By", "it builds on", " vs. x", "in contrast", "x"])), (F.col("p_partkey") % 7 + 1).cast("int")))
    return p.select("p_partkey", T.relation_of(said).alias("relation"))


def _cited(spark, d):
    c = table(spark, d, "conversations")
    text = F.concat(F.lit("As shown [s"), F.col("turn"), F.lit(", s"), F.col("conv_id") % 9, F.lit("] and [s2] or [x s3]"))
    return c.select("conv_id", "turn", F.array_join(T.cited_sections(text, F.array(*[F.lit(f"s{i}") for i in range(6)])), ",").alias("refs"))


def _label(spark, d):
    p = table(spark, d, "part")
    text = F.concat(F.lit("The "), F.col("p_name"), F.lit(" of "), F.col("p_type"), F.lit(" kind"))
    return p.select("p_partkey", T.label_matches(F.concat(F.col("p_type"), F.lit(" big "), F.element_at(F.split("p_name", " "), -1)), text).alias("hit"), T.label_matches(F.col("p_brand"), text).alias("miss"))


def _references(spark, d):
    text = F.concat(F.lit("[1] "), F.replace(F.col("text"), F.lit(". "), F.lit(". [2] ")))
    return _docs(spark, d).select("doc_id", F.posexplode(T.split_references(text)).alias("ref_no", "ref"))


def _json(spark, d):
    e = table(spark, d, "events")
    reply = F.concat(F.lit("<think>{no}</think>Sure:\n```json\n"), F.replace(F.col("props"), F.lit("}"), F.lit(",}")), F.lit("\n```"))
    return e.select("event_id", F.get_json_object(T.extract_json(reply), "$.k").cast("long").alias("k"), F.get_json_object(T.extract_json(F.concat(F.lit("It is "), F.col("props"), F.lit("."))), "$.k").cast("long").alias("bare"))


def _options(spark, d):
    c = table(spark, d, "labels")
    reply = F.element_at(F.array(*map(F.lit, ["C", "c)", "(B)", "Option D", "A: yes", "none", "Bad", "d."])), (F.col("doc_id") % 8 + 1).cast("int"))
    return c.select("doc_id", T.option_index(reply).alias("answer"))


def _titles(spark, d):
    return titles(spark, d).select("page_id", T.title_key(F.col("title")).alias("key"))


def _history(spark, d):
    return R.trim_history(table(spark, d, "conversations"))


def _chunk_sections(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("section"))


def _context(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("section"))
    docs = table(spark, d, "documents").select("doc_id", "text", F.col("source").alias("section"))
    return R.context_hits(R.bm25_leading(table(spark, d, "benchmark"), docs, 6, asked), _chunk_sections(spark, d), asked)


def _expand(spark, d):
    q = table(spark, d, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("query"), F.col("text").alias("question"), (F.col("conv_id") % 60).alias("section"), (F.col("turn") % 30).alias("node"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node_id"), F.col("n_name").alias("label"))
    return R.expand_query(q, titles(spark, d).select(F.col("page_id").alias("section"), "title"), n).select("query", "text")


def _build_context(spark, d):
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("section"), F.col("lang").alias("title"), "text")
    notes = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("notes"))
    facts = table(spark, d, "benchmark").where("item_id % 3 = 0").select(F.col("item_id").alias("query"), F.lit(1).alias("fact_no"), F.concat(F.col("item_id"), F.lit(" --uses--> "), F.reverse("text")).alias("fact"))
    return R.build_context(notes, R.bm25_top(R.bm25_leading(table(spark, d, "benchmark"), _docs(spark, d), 6), 6), chunks, facts).select("query", F.md5("context").alias("context_md5"))


QUERIES = {
    "f1_tokenize": _tokens,
    "f2_word_set": _of_docs(words=lambda t: _joined(F.array_sort(T.word_set(t)))),
    "f3_numbers_in": _of_docs(numbers=lambda t: _joined(T.numbers_in(t))),
    "f4_parse_number": _parse_number,
    "f5_choose": _choose,
    "f6_normalize": _of_docs(md5=lambda t: F.md5(T.normalize(F.replace(t, F.lit("er "), F.lit("-\n "))))),
    "f7_canon": _of_docs(md5=lambda t: F.md5(T.canon(t))),
    "f8_title_key": _titles,
    "f9_sentences": _of_docs(n=lambda t: F.size(T.sentences(t)).cast("long"), md5=lambda t: F.md5(_joined(T.sentences(t), "|"))),
    "f12_extract_json": _json,
    "f14_cited_sections": _cited,
    "f15_split_references": _references,
    "f18_strip_comments": _of_docs(md5=lambda t: F.md5(T.strip_comments(t))),
    "e6_relation_of": _relation,
    "j6_label_matches": _label,
    "j21_option_index": _options,
    "bm25_index": lambda spark, d: R.bm25_index(_docs(spark, d)).select("doc", "term", "tf", "df", F.round("idf", 8).alias("idf"), "length"),
    "bm25_score": _scores,
    "bm25_top": lambda spark, d: R.bm25_search(table(spark, d, "benchmark"), _docs(spark, d)),
    "bm25_scoped": _scoped,
    "t2_context_hits": _context,
    "w9_trim_history": _history,
    "x6_expand_query": _expand,
    "x7_build_context": _build_context,
}

ORACLES = {
    "f1_tokenize": f"SELECT doc_id, CAST(len({TOKENS}) AS BIGINT) AS n, array_to_string({TOKENS}, ' ') AS tokens FROM documents",
    "f2_word_set": f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]{{4,}}'), lambda t: t NOT IN ({_words(T.QUESTION_STOP)})))), ' ') AS words FROM documents",
    "f3_numbers_in": r"""SELECT doc_id, array_to_string(list_filter(regexp_extract_all(text, '(?:^|[^0-9A-Za-z_.])(\d+(?:[.,]\d+)*)', 1),
        lambda n: (contains(n, '.') OR length(regexp_replace(n, '\D', '', 'g')) >= 2) AND NOT regexp_full_match(n, '(19|20)\d\d')), ' ') AS numbers FROM documents""",
    "f4_parse_number": r"""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN round(o_totalprice, 2) WHEN 1 THEN round(o_totalprice, 2)
        WHEN 2 THEN (o_orderkey % 9 + 1) * pow(10.0, o_orderkey % 12) WHEN 3 THEN (o_orderkey % 9 + 1) * 1000.0 + o_orderkey % 1000 WHEN 4 THEN NULL
        ELSE (o_orderkey % 9 + 1) * pow(10.0, o_orderkey % 9) END::DOUBLE AS number FROM orders""",
    "f5_choose": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'method' WHEN 1 THEN 'prior_work' WHEN 2 THEN 'dataset' ELSE 'concept' END AS kind FROM events""",
    "f6_normalize": r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(translate(replace(text, 'er ', '-' || chr(10) || ' '), '‘’“”–—−' || chr(160) || chr(8201) || chr(8239) || chr(173), '''''""---   '),
        '([\p{L}\p{N}_])-\s*\n\s*([\p{L}\p{N}_])', '\1\2', 'g'), '\s+', ' ', 'g'))) AS md5 FROM documents""",
    "f7_canon": r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(lower(text), 'π', 'pi'), '[\\$_^{}]', '', 'g'), '[^a-z0-9.%]+', ' ', 'g'))) AS md5 FROM documents""",
    "f8_title_key": r"""SELECT page_id, trim(regexp_replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[^a-z0-9]+', ' ', 'g')) AS key FROM pages""",
    "f9_sentences": r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)),
        lambda x: length(x) BETWEEN 40 AND 260) AS s FROM documents) SELECT doc_id, CAST(len(s) AS BIGINT) AS n, md5(array_to_string(s, '|')) AS md5 FROM s""",
    "f12_extract_json": "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, CAST(props->>'$.k' AS BIGINT) AS bare FROM events",
    "f14_cited_sections": """SELECT conv_id, turn, array_to_string(list_filter(CASE WHEN conv_id % 9 = turn THEN CASE WHEN turn = 2 THEN ['s2', 's3'] WHEN turn = 3 THEN ['s3', 's2'] ELSE ['s' || turn, 's2', 's3'] END
        WHEN turn IN (2, 3) AND conv_id % 9 IN (2, 3) THEN ['s' || turn, 's' || (conv_id % 9)]
        WHEN turn = 2 THEN ['s2', 's' || (conv_id % 9), 's3'] WHEN turn = 3 THEN ['s3', 's' || (conv_id % 9), 's2']
        WHEN conv_id % 9 = 2 THEN ['s' || turn, 's2', 's3'] WHEN conv_id % 9 = 3 THEN ['s' || turn, 's3', 's2']
        ELSE ['s' || turn, 's' || (conv_id % 9), 's2', 's3'] END, lambda x: x IN ('s0','s1','s2','s3','s4','s5')), ',') AS refs FROM conversations""",
    "f15_split_references": r"""WITH t AS (SELECT doc_id, '[1] ' || replace(text, '. ', '. [2] ') AS t FROM documents),
        p AS (SELECT doc_id, CASE WHEN len(regexp_extract_all(t, '\[\d{1,3}\]\s')) >= 5
              THEN string_split(regexp_replace(regexp_replace(t, '\s+', ' ', 'g'), '(\[\d{1,3}\]\s)', chr(1) || '\1', 'g'), chr(1)) ELSE string_split(t, chr(10) || chr(10)) END AS ps FROM t),
        r AS (SELECT doc_id, list_filter(list_transform(ps, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) > 25)[1:400] AS rs FROM p)
        SELECT doc_id, CAST(i - 1 AS INT) AS ref_no, rs[i] AS ref FROM (SELECT doc_id, rs, unnest(generate_series(1, len(rs))) AS i FROM r)""",
    "f18_strip_comments": r"""SELECT doc_id, md5(regexp_replace(text, '(^|[^\\])%[^\n]*', '\1', 'g')) AS md5 FROM documents""",
    "e6_relation_of": """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'uses' WHEN 1 THEN 'outperforms' WHEN 2 THEN 'related_to' WHEN 3 THEN 'extends' WHEN 4 THEN 'compares_to' WHEN 5 THEN 'alternative_to' ELSE 'related_to' END AS relation FROM part""",
    "j6_label_matches": "SELECT p_partkey, true AS hit, false AS miss FROM part",
    "j21_option_index": "SELECT doc_id, [2, 2, 1, 3, 0, -1, -1, 3][doc_id % 8 + 1]::INT AS answer FROM labels",
    "bm25_index": BM25 + "SELECT doc, term, tf, df, round(idf, 8) AS idf, CAST(length AS INT) AS length FROM idx",
    "bm25_score": BM25 + "SELECT query, doc, score FROM s",
    "bm25_top": BM25 + "SELECT query, doc, score, rank FROM top WHERE rank <= 5",
    "bm25_scoped": rf"""WITH d AS (SELECT source, doc_id, {TOKENS} AS toks FROM documents),
        p AS (SELECT source, doc_id, term, count(*) AS tf FROM (SELECT source, doc_id, unnest(toks) AS term FROM d) GROUP BY ALL),
        n AS (SELECT source, count(*) AS n_docs, avg(len(toks)) AS avg_length FROM d GROUP BY source),
        f AS (SELECT source, term, count(*) AS df FROM p GROUP BY ALL),
        q AS (SELECT 'src' || (item_id % 20) AS source, item_id, unnest({TOKENS}) AS term FROM benchmark),
        qt AS (SELECT source, item_id AS query, term, count(*) AS times FROM q GROUP BY ALL),
        s AS (SELECT source, query, doc_id AS doc, round(sum(times * ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(toks) / avg_length))), 6) AS score
              FROM qt JOIN p USING (source, term) JOIN f USING (source, term) JOIN d USING (source, doc_id) JOIN n USING (source) GROUP BY ALL HAVING score > 0)
        SELECT source, query, doc, score, row_number() OVER (PARTITION BY source, query ORDER BY score DESC, doc) AS rank FROM s QUALIFY rank <= 5""",
    "t2_context_hits": BM25
    + """, hit AS (SELECT query, doc, rank FROM top WHERE rank <= 6),
        loc AS (SELECT b.item_id AS query, d.doc_id AS doc, coalesce(s.score, 0) AS score FROM benchmark b JOIN documents d ON d.source = 'src' || (b.item_id % 20) LEFT JOIN s ON s.query = b.item_id AND s.doc = d.doc_id),
        seen AS (SELECT DISTINCT hit.query FROM hit JOIN loc USING (query, doc)),
        one AS (SELECT query, doc FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS r FROM loc WHERE query NOT IN (SELECT query FROM seen)) WHERE r = 1),
        m AS (SELECT query, doc, 0 AS rank FROM one UNION ALL SELECT query, doc, rank FROM hit),
        again AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY rank) AS rank FROM m) SELECT * FROM again WHERE rank <= 6""",
    "w9_trim_history": """WITH l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations),
        s AS (SELECT conv_id, turn, role, left(text, 3000) AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM l WHERE b <= 6 AND role IN ('user', 'assistant') AND length(text) > 0),
        f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS z FROM s WHERE NOT (a = 1 AND role <> 'user'))
        SELECT conv_id, turn, role, text FROM f WHERE NOT (z = 1 AND role = 'user')""",
    "x6_expand_query": """SELECT conv_id || '-' || turn AS query, array_to_string(list_filter([c.text, regexp_extract(p.html, '<title>([^<]*)</title>', 1), n.n_name], lambda x: x IS NOT NULL AND x <> ''), ' ') AS text
        FROM conversations c LEFT JOIN pages p ON p.page_id = c.conv_id % 60 LEFT JOIN nation n ON n.n_nationkey = c.turn % 30 WHERE role = 'user'""",
    "x7_build_context": BM25
    + """SELECT b.item_id AS query, md5('SECTION NOTES:' || chr(10) || b.text || chr(10) || chr(10) || 'EXCERPTS FROM THE PAPER:' || chr(10) || coalesce(e.x, '(no matching excerpt)')
        || CASE WHEN b.item_id % 3 = 0 THEN chr(10) || chr(10) || 'KNOWLEDGE GRAPH FACTS:' || chr(10) || b.item_id || ' --uses--> ' || reverse(b.text) ELSE '' END) AS context_md5
        FROM benchmark b LEFT JOIN (SELECT query, string_agg('[' || source || '] (' || lang || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS x FROM top JOIN documents ON doc = doc_id WHERE rank <= 6 GROUP BY query) e ON e.query = b.item_id""",
}
