"""Queries over sources of papers, tables and numbered floats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import papers as P
from ..operators import tables as B
from ..sources.tables import table


def _source(spark, d):
    p = table(spark, d, "pages")
    k = F.col("page_id")
    bare = F.concat(F.lpad((k % 9000 + 1000).cast("string"), 4, "0"), F.lit("."), F.lpad(k.cast("string"), 5, "0"))
    s = F.when(k % 4 == 0, F.concat(F.lit("arXiv:"), bare)).when(k % 4 == 1, bare).when(k % 4 == 2, F.col("url")).otherwise(F.concat(F.lit("https://arxiv.org/abs/"), bare, F.lit("v2")))
    return p.select("page_id", P.normalize_source(s).alias("url"), P.extract_paper_id(s, F.concat(F.lit("arXiv:2101.0000"), k % 9)).alias("paper_id"))


def _floats(spark, d):
    li = table(spark, d, "lineitem")
    return B.number_floats(li.select(F.col("l_suppkey").alias("paper_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), F.col("l_returnflag").alias("kind"), (F.col("l_linenumber") % 3 > 0).cast("int").alias("weight"))).select("ordinal", "number")


def _heads(spark, d):
    o = table(spark, d, "orders")
    return B.number_sections(o.select((F.col("o_custkey") % 40).alias("paper_id"), F.col("o_orderkey").alias("ordinal"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("level"), (F.col("o_orderkey") % 11 == 0).alias("starred"), F.lit(False).alias("appendix"))).select("ordinal", "number")


def _markdown(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("a"), F.max("l_linestatus").alias("b"))
    return B.table_markdown(rows.select((F.col("l_orderkey") % 7).alias("paper_id"), F.col("l_orderkey").alias("number"), (F.col("l_linenumber") - 1).alias("row_no"), F.posexplode(F.array("a", "b")).alias("col_no", "text")))


QUERIES = {
    "p1_p2_normalize_source": _source,
    "w5_number_floats": _floats,
    "w4_number_sections": _heads,
    "f16_table_markdown": _markdown,
    "u6_content_key": lambda s, d: table(s, d, "documents").groupBy(P.content_key(F.col("text")).alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).select("doc_id", "n"),
    "f10_label_numbers": lambda s, d: table(s, d, "documents").select("doc_id", F.size(P.label_numbers(F.regexp_replace("text", r"(?<=\w)\. ", " 4.2 "))).alias("n")),
    "f19_join_paragraphs": lambda s, d: table(s, d, "documents").select("doc_id", F.md5(P.join_paragraphs(F.col("text"))).alias("md5")),
}

ORACLES = {
    "p1_p2_normalize_source": """WITH p AS (SELECT page_id, url, lpad(CAST(page_id % 9000 + 1000 AS VARCHAR), 4, '0') || '.' || lpad(CAST(page_id AS VARCHAR), 5, '0') AS b FROM pages)
        SELECT page_id, CASE page_id % 4 WHEN 2 THEN url WHEN 3 THEN 'https://arxiv.org/pdf/' || b || 'v2' ELSE 'https://arxiv.org/pdf/' || b END AS url,
        CASE page_id % 4 WHEN 2 THEN '2101.0000' || (page_id % 9) ELSE b END AS paper_id FROM p""",
    "w5_number_floats": """SELECT l_orderkey * 10 + l_linenumber AS ordinal, CASE WHEN l_linenumber % 3 > 0 THEN CAST(sum(CASE WHEN l_linenumber % 3 > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey * 10 + l_linenumber) AS BIGINT) END AS number FROM lineitem""",
    "w4_number_sections": """WITH h AS (SELECT o_custkey % 40 AS p, o_orderkey AS o, o_orderkey % 3 + 1 AS l, o_orderkey % 11 <> 0 AS c FROM orders),
        a AS (SELECT *, sum(CASE WHEN l = 1 AND c THEN 1 ELSE 0 END) OVER (PARTITION BY p ORDER BY o) AS n1 FROM h), b AS (SELECT *, sum(CASE WHEN l = 2 AND c THEN 1 ELSE 0 END) OVER (PARTITION BY p, n1 ORDER BY o) AS n2 FROM a),
        d AS (SELECT *, sum(CASE WHEN l = 3 AND c THEN 1 ELSE 0 END) OVER (PARTITION BY p, n1, n2 ORDER BY o) AS n3 FROM b)
        SELECT o AS ordinal, CASE WHEN NOT c THEN '' WHEN l = 1 THEN CAST(n1 AS VARCHAR) WHEN l = 2 THEN n1 || '.' || n2 ELSE n1 || '.' || n2 || '.' || n3 END AS number FROM d""",
    "f16_table_markdown": """WITH r AS (SELECT l_orderkey AS number, l_linenumber AS n, '| ' || min(l_returnflag) || ' | ' || max(l_linestatus) || ' |' || CASE WHEN l_linenumber = 1 THEN chr(10) || '| --- | --- |' ELSE '' END AS row FROM lineitem GROUP BY l_orderkey, l_linenumber)
        SELECT number % 7 AS paper_id, number, string_agg(row, chr(10) ORDER BY n) AS markdown FROM r GROUP BY number""",
    "f10_label_numbers": r"""SELECT doc_id, CAST(least(6, len(list_distinct(list_transform(regexp_extract_all(regexp_replace(text, '(\w+)\. ', '\1 4.2 ', 'g'), '([A-Za-z][A-Za-z\-]+(?: [A-Za-z][A-Za-z\-]+)?)[^\d\n]{0,12}?(\d{1,3}\.\d{1,2})', 1), lambda x: lower(trim(x)))))) AS INT) AS n FROM documents""",
    "f19_join_paragraphs": r"""SELECT doc_id, md5(array_to_string(list_transform(string_split_regex(text, '\n\s*\n'), lambda p: CASE WHEN regexp_matches(p, '(?m)^\s*(?:\\(?:begin|end|item|\[|\])|[|&-]|\$\$)') THEN p ELSE trim(regexp_replace(p, '\s*\n\s*', ' ', 'g')) END), chr(10) || chr(10))) AS md5 FROM documents""",
    "u6_content_key": "SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text",
}
