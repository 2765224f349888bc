"""Queries over TeX, citations, quotes on pages, linked titles and assembled pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tex as X
from ..operators import papers as P
from ..sources.tables import table

LISTED = "array_join(transform(array_sort(collect_list(struct(o_orderkey, {0}))), s -> s.{0}), {1})"


def _by_customer(spark, d, piece, glue="''"):
    """One text for each customer: a piece of TeX for each of its orders, in order of their keys."""
    o = table(spark, d, "orders").withColumn("piece", F.expr(piece))
    return o.groupBy("o_custkey").agg(F.expr(LISTED.format("piece", glue)).alias("tex"))


def _tabular(spark, d):
    t = _by_customer(spark, d, r"concat('\\hline \\multicolumn{2}{c}{', o_orderstatus, '} & ', o_orderkey, ' \\cite{x}')", r"'\\\\'")
    return t.select("o_custkey", F.posexplode(X.tabular_cells(F.col("tex"))).alias("row_no", "cells")).select("o_custkey", "row_no", F.array_join("cells", "|").alias("cells"))


def _bibitems(spark, d):
    t = _by_customer(spark, d, r"concat('\\bibitem', if(o_orderkey % 2 = 0, concat('[', o_orderpriority, '(', year(o_orderdate), ')x]'), ''), '{k', o_orderkey, '} ', o_orderstatus, '.')")
    return t.select("o_custkey", F.inline(X.parse_bibitems(F.col("tex"))))


def _sections(spark, d):
    t = _by_customer(spark, d, r"concat('\\', if(o_orderkey % 2 = 0, 'sub', ''), 'section', if(o_orderkey % 3 = 0, '*', ''), '{P ', o_orderkey, '} ', o_orderstatus, '\n')")
    return t.select("o_custkey", F.inline(X.split_tex_sections(F.col("tex"))))


def _replies(spark, d):
    p = table(spark, d, "part")
    r = p.select("p_partkey", F.expr("concat('{', if(p_partkey % 2 = 0, concat('\"size\": ', p_size), '\"size\": \"big\"'), if(p_partkey % 3 = 0, '', ', \"names\": [\"x\"]'), if(p_partkey % 5 = 0, '', '}'))").alias("reply"))
    return r.select("p_partkey", F.array_join(X.schema_problems(F.col("reply"), "size INT, names ARRAY<STRING>"), "; ").alias("problems"))


def _citations(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("paper_id"), F.col("o_orderkey").alias("ref_no"), F.expr("concat('Clerk', o_orderkey % 7)").alias("who"), F.year("o_orderdate").alias("y"))
    refs = o.select("paper_id", "ref_no", F.expr("concat('Ann Other, ', who, '. ', if(ref_no % 2 = 0, concat('N', ref_no, ': a study'), concat('Work ', ref_no)), '. Venue, ', y, '.')").alias("text"))
    names = o.select("paper_id", F.expr("concat(who, ' et al.', if(ref_no % 3 = 0, '', concat(', ', y)))").alias("name"))
    return P.resolve_citations(names, refs)


def _cites(spark, d):
    texts = table(spark, d, "orders").select(F.col("o_custkey").alias("paper_id"), F.col("o_orderkey").alias("text_id"), F.expr(r"concat('By \\citep{own, z', o_orderkey, '} and \\citet{own} in \\citeyear{own}.')").alias("text"))
    known = table(spark, d, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("paper_id"), F.lit("own").alias("key"), F.expr("concat(c_name, ', ', 1990 + c_custkey % 9)").alias("short"))
    return P.resolve_cites(texts, known)


def _refs(spark, d):
    texts = table(spark, d, "orders").select(F.col("o_custkey").alias("paper_id"), F.col("o_orderkey").alias("text_id"), F.expr(r"concat('See \\cref{a}, \\ref{a,b', o_orderkey % 2, '} and \\eqref{b0}')").alias("text"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("paper_id"), F.col("c_nationkey").alias("number"))
    labels = c.withColumns({"key": F.lit("a"), "kind": F.lit("Figure")}).unionByName(c.where("number % 2 = 0").withColumns({"key": F.lit("b0"), "kind": F.lit("")}))
    return P.resolve_refs(texts, labels)


def _locate(spark, d):
    pages = table(spark, d, "documents").select(F.lit(1).alias("paper_id"), F.col("doc_id").alias("page"), "text")
    b = table(spark, d, "benchmark")
    quotes = b.select(F.lit(1).alias("paper_id"), F.col("item_id").alias("quote_id"), F.col("text").alias("quote"), F.array(F.col("item_id") * 2, F.col("item_id")).alias("hints"), F.lit(-1).cast("long").alias("first_page"))
    return P.locate_quotes(quotes, pages).select("quote_id", "page")


def _links(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    a = p.select(F.col("p_partkey").alias("paper_id"), F.expr("concat('The ', p_name, ' Part ', p_partkey)").alias("title"), F.expr("if(p_partkey % 2 = 0, concat('of the ', p_name, ' part ', p_partkey, ' made'), '')").alias("first_page"))
    b = p.select(F.col("p_partkey").alias("catalog_id"), F.expr("concat(if(p_partkey % 3 = 0, 'the ', 'the (new) '), p_name, ' part, ', p_partkey)").alias("title"))
    return P.link_titles(a, b)


def _limit(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_partkey").alias("l_partkey"))
    rows = li.select((F.col("l_orderkey") % 10).alias("paper_id"), F.col("l_orderkey").alias("section_id"), F.col("l_linenumber").alias("beat_no"), F.expr("if(l_suppkey % 4 = 0, '', concat('q', l_partkey % 4))").alias("quote"))
    return P.limit_quotes(rows)


def _starts(spark, d):
    li = table(spark, d, "lineitem")
    sections = li.select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("section_no")).distinct()
    hits = li.select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("section_no"), F.explode(F.array(F.col("l_suppkey") % 12 + 1, F.col("l_partkey") % 12 + 1)).alias("page")).where("page > 4")
    return P.section_pages(sections, hits, table(spark, d, "orders").select(F.col("o_orderkey").alias("paper_id"), F.lit(12).alias("n_pages")))


def _assemble(spark, d):
    li = table(spark, d, "lineitem")
    beats = li.select(F.col("l_orderkey").alias("paper_id"), F.col("l_linestatus").alias("view"), F.col("l_returnflag").alias("section_id"), F.ascii("l_returnflag").alias("section_no"), F.col("l_linenumber").alias("beat_no"), F.expr("concat_ws('.', l_linestatus, l_returnflag, l_linenumber)").alias("beat_id"), F.col("l_shipdate").cast("string").alias("narration"))
    diagrams = beats.where("paper_id % 2 = 0").select("paper_id", "view", "section_id", F.lit("D").alias("diagram")).distinct()
    focus = beats.where("beat_no % 2 = 0").select("paper_id", "beat_id", F.array("narration").alias("focus")).dropDuplicates(["paper_id", "beat_id"])
    clips = beats.where("beat_no % 3 = 0").select("paper_id", "beat_id", F.lit("c").alias("clip")).dropDuplicates(["paper_id", "beat_id"])
    v = P.assemble(beats, diagrams, focus, clips).select("paper_id", F.explode("views").alias("v"))
    b = v.select("paper_id", F.explode("v.sections").alias("s")).select("paper_id", F.col("s.diagram").alias("diagram"), F.explode("s.beats").alias("b"))
    return b.groupBy("paper_id").agg(F.count("*").alias("n_beats"), F.count("diagram").alias("n_drawn"), F.count("b.clip").alias("n_clips"), F.sum(F.size("b.focus")).alias("n_focus"))


QUERIES = {
    "f17_tabular_cells": _tabular,
    "f21_parse_bibitems": _bibitems,
    "f22_split_tex_sections": _sections,
    "f13_schema_problems": _replies,
    "j9_resolve_citations": _citations,
    "j10_resolve_cites": _cites,
    "j11_resolve_refs": _refs,
    "j14_locate_quotes": _locate,
    "j24_link_titles": _links,
    "p13_limit_quotes": _limit,
    "w6_section_pages": _starts,
    "j17_assemble": _assemble,
}

ORACLES = {
    "j14_locate_quotes": r"""WITH p AS (SELECT doc_id, ' ' || array_to_string(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''), ' ') || ' ' AS t FROM documents),
        q AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
        s AS (SELECT item_id, unnest([w[1:9], CASE WHEN len(w) > 14 THEN w[-7:] END]) AS s FROM q),
        h AS (SELECT DISTINCT item_id, doc_id, CASE doc_id WHEN item_id * 2 THEN 1 WHEN item_id THEN 2 ELSE 0 END AS place FROM s JOIN p ON contains(t, ' ' || array_to_string(s, ' ') || ' ') WHERE len(s) >= 4),
        b AS (SELECT item_id, doc_id FROM h QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY place = 0, place, doc_id) = 1)
        SELECT item_id AS quote_id, coalesce(doc_id, -1) AS page FROM benchmark LEFT JOIN b USING (item_id)""",
    "f17_tabular_cells": """SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS row_no, o_orderstatus || '||' || o_orderkey AS cells FROM orders""",
    "f21_parse_bibitems": """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS no FROM orders)
        SELECT o_custkey, no, 'k' || o_orderkey AS key, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority || ', ' || year(o_orderdate) ELSE CAST(no AS VARCHAR) END AS short, o_orderstatus || '.' AS text FROM o""",
    "f22_split_tex_sections": """SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS no, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS level,
        o_orderkey % 3 = 0 AS starred, 'P ' || o_orderkey AS title, o_orderstatus AS body FROM orders""",
    "f13_schema_problems": """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'output was not valid JSON' ELSE
        concat_ws('; ', CASE WHEN p_partkey % 2 = 1 THEN 'size: not of type int' END, CASE WHEN p_partkey % 3 = 0 THEN 'names: field required' END) END AS problems FROM part""",
    "j9_resolve_citations": """WITH o AS (SELECT o_custkey AS paper_id, o_orderkey AS r, 'Clerk' || (o_orderkey % 7) AS who, year(o_orderdate) AS y FROM orders),
        n AS (SELECT DISTINCT paper_id, who, CASE WHEN r % 3 = 0 THEN NULL ELSE y END AS y FROM o),
        h AS (SELECT n.paper_id, n.who, n.y, count(*) AS k, min(CASE WHEN n.y IS NULL OR n.y = o.y OR contains('Work ' || o.r || 'N' || o.r, CAST(n.y AS VARCHAR)) OR contains(o.who, CAST(n.y AS VARCHAR)) THEN o.r END) AS r
              FROM n JOIN o ON n.paper_id = o.paper_id AND n.who = o.who GROUP BY ALL)
        SELECT paper_id, who || ' et al.' || coalesce(', ' || y, '') AS name, CASE WHEN r % 2 = 0 THEN 'N' || r ELSE '' END AS short,
        CASE WHEN r % 2 = 0 THEN 'N' || r || ': a study' ELSE 'Work ' || r END AS title FROM h WHERE r IS NOT NULL AND (y IS NOT NULL OR k = 1)""",
    "j10_resolve_cites": """WITH t AS (SELECT o_custkey AS paper_id, o_orderkey AS text_id, c_name AS n, CASE WHEN o_custkey % 3 > 0 THEN 1990 + o_custkey % 9 END AS y FROM orders JOIN customer ON o_custkey = c_custkey)
        SELECT paper_id, text_id, 'By [' || CASE WHEN y IS NULL THEN 'own' ELSE n || ', ' || y END || '; z' || text_id || '] and ' || CASE WHEN y IS NULL THEN 'own' ELSE n || ' (' || y || ')' END
        || ' in ' || coalesce(CAST(y AS VARCHAR), 'own') || '.' AS text FROM t""",
    "j11_resolve_refs": """WITH t AS (SELECT o_custkey AS paper_id, o_orderkey AS text_id, c_nationkey AS n, CASE WHEN c_nationkey % 2 = 0 THEN CAST(c_nationkey AS VARCHAR) ELSE '?' END AS b FROM orders JOIN customer ON o_custkey = c_custkey)
        SELECT paper_id, text_id, 'See Figure ' || n || ', ' || n || ', ' || CASE WHEN text_id % 2 = 0 THEN b ELSE '?' END || ' and (' || b || ')' AS text FROM t""",
    "p13_limit_quotes": """WITH b AS (SELECT l_orderkey % 10 AS paper_id, l_orderkey AS section_id, l_linenumber AS beat_no, CASE WHEN l_suppkey % 4 <> 0 THEN 'q' || (l_partkey % 4) END AS q,
            row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n
            FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL)),
        one AS (SELECT section_id, min(n) AS n1, arg_min(q, n) AS q1 FROM b WHERE q IS NOT NULL GROUP BY section_id),
        two AS (SELECT section_id, min(n) AS n2 FROM b JOIN one USING (section_id) WHERE n > n1 + 1 AND q <> q1 GROUP BY section_id)
        SELECT paper_id, section_id, beat_no, CASE WHEN n = n1 OR n = n2 THEN q END AS quote FROM b LEFT JOIN one USING (section_id) LEFT JOIN two USING (section_id)""",
    "w6_section_pages": """WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey AS p, l_linenumber AS s, l_suppkey % 12 + 1 AS x, l_partkey % 12 + 1 AS y FROM lineitem),
        g AS (SELECT p, s, row_number() OVER (PARTITION BY p ORDER BY s) AS k, list_filter(list_distinct(flatten(list([x, y]))), lambda v: v > 4) AS pages FROM l GROUP BY p, s),
        r(p, s, k, cur) AS (SELECT p, s, k, coalesce(list_min(pages), 0) FROM g WHERE k = 1
            UNION ALL SELECT g.p, g.s, g.k, coalesce(list_min(list_filter(g.pages, lambda v: v >= r.cur)), r.cur) FROM g JOIN r ON g.p = r.p AND g.k = r.k + 1),
        f AS (SELECT p, s, k, greatest(cur, 1) AS s0 FROM r)
        SELECT p AS paper_id, s AS section_no, s0 AS page_start, greatest(s0, coalesce(lead(s0) OVER (PARTITION BY p ORDER BY k), 12)) AS page_end FROM f""",
    "j17_assemble": """SELECT l_orderkey AS paper_id, count(*) AS n_beats, count(*) FILTER (WHERE l_orderkey % 2 = 0) AS n_drawn, count(*) FILTER (WHERE l_linenumber % 3 = 0) AS n_clips,
        CAST(count(*) FILTER (WHERE l_orderkey % 2 = 0 AND l_linenumber % 2 = 0) AS BIGINT) AS n_focus FROM lineitem GROUP BY l_orderkey""",
}
