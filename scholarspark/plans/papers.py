"""Queries over document structure, chunks and grounding."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import chunks as C
from ..operators import grounding as G
from ..operators import structure as S
from ..sources.tables import lines as doc_lines
from ..sources.tables import table, titles


def _lines(spark, d):
    """v_lines: a document is a paper, forty lines a page and five a block."""
    n = F.col("line_no").cast("long")
    return doc_lines(spark, d).select(F.col("doc_id").alias("paper_id"), F.floor(n / 40).alias("page"), F.floor(n / 5).alias("block"), n.alias("line_no"), "text")


def _marked(spark, d):
    """Lines of under four words count as headings."""
    short = (F.size(F.split(F.trim("text"), r"\s+")) < 4) & (F.trim("text") != "")
    return _lines(spark, d).withColumn("heading", F.when(short, F.col("text")))


def _sections(spark, d):
    docs = table(spark, d, "documents")
    no = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return docs.select(F.col("source").alias("paper_id"), "doc_id", no.alias("section_no"), F.concat(F.lit("r"), no).alias("raw_id"), F.concat(F.lit("Part "), F.col("doc_id")).alias("heading"), F.concat(F.lit("Part "), F.col("doc_id")).alias("title"), ((F.col("doc_id") % 3) + 1).alias("level"), "text")


def _strip(spark, d):
    pages = doc_lines(spark, d).select("paper_id", F.col("doc_id").alias("page"), (F.col("doc_id") * 1000000 + F.col("line_no")).alias("line_no"), "text")
    kept = S.strip_repeated_lines(pages.withColumn("in_margin", F.lit(True)), 0.1)
    return kept.groupBy("paper_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


def _body(spark, d):
    li = table(spark, d, "lineitem")
    return S.body_size(li.select(F.col("l_suppkey").alias("paper_id"), (F.col("l_quantity") / 4).alias("size"), F.lpad(F.lit("x"), F.col("l_linenumber"), "x").alias("text")))


def _spans(spark, d):
    return S.page_spans(_lines(spark, d).select("paper_id", (F.col("line_no") % 7).alias("section_no"), "page")).select("paper_id", "section_no", "page_start", "page_end", F.size("pages").cast("long").alias("n_pages"))


def _paragraphs(spark, d):
    return S.paragraphs(_lines(spark, d), ["paper_id"]).select("paper_id", F.length("text").cast("long").alias("n"), F.md5("text").alias("md5"))


def _sectionize(spark, d):
    return S.sectionize(_marked(spark, d)).groupBy("paper_id", "section_no").agg(F.min("section").alias("section"), F.count("*").alias("n"), F.min("line_no").alias("first"))


def _structure(spark, d):
    heads = _marked(spark, d).where("heading is not null").select("paper_id", "line_no", F.concat(F.col("line_no") % 9, F.lit(" "), "heading").alias("heading"))
    pages = _lines(spark, d).groupBy("paper_id").agg((F.max("page") + 1).alias("n_pages"))
    return S.choose_structure(heads, pages).select("paper_id", "start", "heading")


def _neighbors(spark, d):
    o = table(spark, d, "orders")
    return S.neighbors(o.select(F.col("o_custkey").alias("paper_id"), F.col("o_orderkey").alias("section_no"), F.col("o_orderpriority").alias("title")))


def _earlier(spark, d):
    c = table(spark, d, "conversations")
    return S.earlier_context(c.select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("section_no"), F.col("text").alias("summary"))).select("paper_id", "section_no", "earlier")


def _page_section(spark, d):
    p = table(spark, d, "part")
    sections = p.select(F.col("p_brand").alias("paper_id"), F.col("p_partkey").alias("section_no"), F.col("p_name").alias("title"), F.col("p_size").alias("page_start"), (F.col("p_size") + 5).alias("page_end"))
    return S.section_of_page(p.select(F.col("p_brand").alias("paper_id"), (F.col("p_size") + 2).alias("page")).distinct(), sections)


def _find_page(spark, d):
    docs = table(spark, d, "documents")
    pages = docs.select(F.lit("all").alias("paper_id"), F.col("doc_id").alias("page"), "text")
    phrases = table(spark, d, "benchmark").select(F.lit("all").alias("paper_id"), F.col("item_id").alias("phrase_id"), F.col("text").alias("phrase"), (F.col("item_id") * 10).alias("start"))
    return S.find_page(phrases, pages)


def _chunks(spark, d):
    return C.build_chunks(_sections(spark, d), 1100, "\n").select("paper_id", "chunk_no", "section_no", "part", F.length("text").alias("n"), F.md5("text").alias("md5"))


def _pack(spark, d):
    o = table(spark, d, "orders")
    return C.pack_units(o.select(F.col("o_custkey").alias("paper_id"), F.col("o_orderkey").alias("unit_no"), F.floor(F.col("o_totalprice")).alias("size")), 1_000_000)


def _label_parts(spark, d):
    li = table(spark, d, "lineitem")
    return C.label_parts(li.select((F.col("l_orderkey") % 10).alias("paper_id"), F.col("l_orderkey").alias("section_no"), (F.col("l_linenumber") - 1).alias("part"), F.lit("T").alias("title"))).select("section_no", "part", "title", "n_parts")


def _plan(spark, d):
    li = table(spark, d, "lineitem")
    return li.select((F.col("l_orderkey") % 50).alias("paper_id"), F.col("l_orderkey").alias("section_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), F.col("l_suppkey").alias("raw_id"))


def _known(spark, d):
    s = table(spark, d, "supplier").where("s_suppkey % 3 > 0")
    return s.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long"))).alias("paper_id"), F.col("s_suppkey").alias("raw_id"), F.col("s_suppkey").alias("section_no"))


def _clean_plan(spark, d):
    return C.clean_plan(_plan(spark, d), _known(spark, d)).select("paper_id", "section_id", F.array_join("raw_ids", ",").alias("raw_ids"), "first")


def _check_plan(spark, d):
    return C.check_plan(_plan(spark, d), _known(spark, d), 10, 20)


def _fallback(spark, d):
    return C.fallback_plan(_sections(spark, d)).select("paper_id", "plan_no", F.array_join("raw_ids", ",").alias("raw_ids"))


def _grounding_text(spark, d):
    s = _sections(spark, d)
    u = s.select("paper_id", F.col("section_no").alias("section_id"), F.array(F.concat(F.lit("r"), F.col("section_no") + 1), F.concat(F.lit("r"), F.col("section_no")), F.lit("r9999")).alias("raw_ids"))
    return C.grounding_text(u, s).select("paper_id", "section_id", F.md5("text").alias("md5"))


def _quotes(spark, d):
    """The middle of every document as a quote from it, in lower case and other spacing; every third with a word put in."""
    docs = table(spark, d, "documents")
    quote = F.lower(F.substring("text", 20, 60))
    return docs.select(F.col("doc_id").alias("quote_id"), F.col("doc_id").alias("source_id"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.substring(quote, 1, 20), F.lit(" ZZ "), F.substring(quote, 21, 60))).otherwise(F.replace(quote, F.lit(" "), F.lit("  "))).alias("quote"))


def _texts(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), "text")


def _fuzzy(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return G.fuzzy_match_quotes(q, _texts(spark, d)).select("quote_id", "source_id")


def _numbers(spark, d):
    """A claim for every document: its second number as it stands (kept), or one that isn't there."""
    n = F.get(F.regexp_extract_all("text", F.lit(r"(?<![\w.])\d+(?![\w.])"), F.lit(0)), F.lit(0))
    docs = table(spark, d, "documents").withColumn("n", n).where("n is not null")
    return docs.select(F.col("doc_id").alias("number_id"), F.col("doc_id").alias("source_id"), F.when(F.col("doc_id") % 2 == 0, F.col("n")).otherwise(F.lit("0.0137")).alias("value"))


def _ground(spark, d):
    return G.ground_numbers(_numbers(spark, d), _texts(spark, d)).select("number_id")


def _names(spark, d):
    docs = table(spark, d, "documents")
    first = F.element_at(F.split(F.trim("text"), r"\s+"), 1)
    return docs.select(F.col("doc_id").alias("source_id"), F.col("doc_id").alias("section_id"), F.posexplode(F.array(F.concat(F.lit("Unknownthing ("), first, F.lit(")")), F.lit("Quuxfrob"), F.col("source"))).alias("concept_no", "name"))


def _named(spark, d):
    return G.named(_names(spark, d), _texts(spark, d)).select("source_id", "concept_no", "in_text")


def _concepts(spark, d):
    return G.clean_concepts(_names(spark, d), _texts(spark, d)).select("section_id", "concept_no")


def _results(spark, d):
    li = table(spark, d, "lineitem")
    r = li.select(F.col("l_suppkey").alias("section_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("result_no"), F.col("l_partkey").alias("number_id"), F.col("l_returnflag").alias("value"))
    return G.clean_results(r, table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("number_id"))).select("section_id", "result_no", "value")


def _key_result(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("paper_id"), F.col("o_orderkey").alias("number_id"), "o_orderstatus")
    papers = table(spark, d, "customer").select(F.col("c_custkey").alias("paper_id"), F.col("c_mktsegment").alias("key_result"))
    return G.clean_key_result(papers, o.select("paper_id", "number_id"), o.where("o_orderstatus <> 'F'"))


def _drop(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return G.drop_ungrounded(o, table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")


def _beats(spark, d):
    c = table(spark, d, "conversations")
    n = c.select(F.col("conv_id").alias("section_id"), F.concat(F.col("turn"), F.lit(".5")).alias("value"), (F.col("turn") % 2 == 0).alias("grounded"))
    return G.check_beats(c.select(F.col("conv_id").alias("section_id"), F.col("turn").alias("beat_id")), n, 4).select("section_id", "n_beats", "few", F.array_join("bad", ",").alias("bad"))


def _fixes(spark, d):
    c = table(spark, d, "conversations")
    beats = c.select(F.concat(F.lit("s"), "conv_id").alias("section_id"), F.concat(F.lit("deep.s"), "conv_id", F.lit(".b"), "turn").alias("beat_id"), F.col("text").alias("narration"))
    f = c.select(F.concat(F.lit("s"), "conv_id").alias("section_id"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("b"), "turn")).otherwise(F.concat(F.lit("deep.s"), "conv_id", F.lit(".b"), "turn")).alias("beat_id"), F.col("turn").alias("fix_no"), F.when(F.col("turn") % 3 == 0, " ").otherwise(F.reverse("text")).alias("narration"), (F.col("conv_id") % 5 == 0).alias("ungrounded"))
    return G.apply_fixes(beats, f).select("beat_id", "narration", "applied")


QUERIES = {
    "a1_strip_repeated_lines": _strip,
    "a2_body_size": _body,
    "a3_page_spans": _spans,
    "a4_paragraphs": _paragraphs,
    "w1_sectionize": _sectionize,
    "w15_choose_structure": _structure,
    "w7_neighbors": _neighbors,
    "w8_earlier_context": _earlier,
    "j12_section_of_page": _page_section,
    "j13_find_page": _find_page,
    "w16_w18_build_chunks": _chunks,
    "w17_pack_units": _pack,
    "a26_label_parts": _label_parts,
    "u4_clean_plan": _clean_plan,
    "a23_check_plan": _check_plan,
    "u5_fallback_plan": _fallback,
    "j1_grounding_text": _grounding_text,
    "j2_match_quotes": lambda s, d: G.match_quotes(_quotes(s, d), _texts(s, d)).select("quote_id", "found"),
    "j3_fuzzy_match_quotes": _fuzzy,
    "j4_ground_numbers": _ground,
    "j7_name_in_text": _named,
    "p7_clean_concepts": _concepts,
    "p8_clean_results": _results,
    "p9_clean_key_result": _key_result,
    "j8_drop_ungrounded": _drop,
    "a22_check_beats": _beats,
    "j18_apply_fixes": _fixes,
}

_L = "l AS (SELECT doc_id AS paper_id, (i - 1) // 40 AS page, (i - 1) // 5 AS block, i - 1 AS line_no, ls[i] AS text FROM (SELECT source, doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM (SELECT source, doc_id, string_split(text, chr(10)) AS ls FROM documents)))"
_N = r"""trim(regexp_replace(regexp_replace(translate(X, '‘’“”–—−' || chr(160) || chr(8201) || chr(8239) || chr(173), '''''""---   '), '([\p{L}\p{N}_])-\s*\n\s*([\p{L}\p{N}_])', '\1\2', 'g'), '\s+', ' ', 'g'))"""
_CANON = rf"trim(regexp_replace(regexp_replace(replace(lower({_N}), 'π', 'pi'), '[\\$_^{{}}]', '', 'g'), '[^a-z0-9.%]+', ' ', 'g'))"
_HEAD = r"m AS (SELECT *, CASE WHEN trim(text) <> '' AND len(regexp_extract_all(trim(text, chr(32)), '\s+')) < 3 THEN text END AS heading FROM l)"
_SEC = "s AS (SELECT source AS paper_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, doc_id % 3 + 1 AS level, text FROM documents)"

ORACLES = {
    "w16_w18_build_chunks": """WITH RECURSIVE t AS (SELECT doc_id, source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS section_no FROM documents),
        p AS (SELECT doc_id, i, ps[i] AS par FROM (SELECT doc_id, ps, unnest(generate_series(1, len(ps))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM t WHERE length(text) > 1100))),
        n AS (SELECT doc_id, max(i) AS n FROM p GROUP BY doc_id),
        r(doc_id, i, n, rest, cur, k, piece) AS (
            SELECT doc_id, CAST(1 AS BIGINT), n, CAST(NULL AS VARCHAR), '', 0, CAST(NULL AS VARCHAR) FROM n
            UNION ALL
            SELECT doc_id, CASE WHEN rest IS NULL THEN i + 1 ELSE i END, n,
                   CASE WHEN length(rest) > 1100 THEN trim(substr(rest, stop + 1)) WHEN rest IS NULL AND length(par) > 1100 THEN par END,
                   CASE WHEN length(rest) > 1100 THEN '' WHEN rest IS NOT NULL THEN rest WHEN par IS NULL OR length(par) > 1100 THEN '' WHEN cur = '' OR length(cur) + length(par) + 1 > 1100 THEN par ELSE cur || chr(10) || par END,
                   k + CASE WHEN piece IS NULL THEN 0 ELSE 1 END,
                   CASE WHEN length(rest) > 1100 THEN trim(left(rest, stop)) WHEN rest IS NULL AND cur <> '' AND (par IS NULL OR length(par) > 1100 OR length(cur) + length(par) + 1 > 1100) THEN cur END
            FROM (SELECT *, CASE WHEN instr(reverse(left(rest, 1100)), ' .') > 0 AND 1100 - instr(reverse(left(rest, 1100)), ' .') > 551 THEN 1100 - instr(reverse(left(rest, 1100)), ' .') ELSE 1100 END AS stop
                  FROM (SELECT r.*, p.par FROM r LEFT JOIN p ON p.doc_id = r.doc_id AND p.i = r.i AND r.rest IS NULL) WHERE i <= n + 1)),
        parts AS (SELECT doc_id, k AS part, piece AS text FROM r WHERE piece IS NOT NULL UNION ALL SELECT doc_id, 0, text FROM t WHERE length(text) <= 1100),
        c AS (SELECT source AS paper_id, section_no, part, parts.text FROM parts JOIN t USING (doc_id) WHERE trim(parts.text) <> '')
        SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY section_no, part) AS chunk_no, section_no, part, length(text) AS n, md5(text) AS md5 FROM c""",
    "a1_strip_repeated_lines": rf"""WITH l AS (SELECT source AS paper_id, doc_id AS page, unnest(string_split(text, chr(10))) AS text FROM documents), k AS (SELECT *, regexp_replace(lower(text), '\d+', '#', 'g') AS key FROM l), p AS (SELECT paper_id, count(DISTINCT page) AS n FROM l GROUP BY 1),
        o AS (SELECT paper_id, key FROM k JOIN p USING (paper_id) GROUP BY paper_id, key, n HAVING count(*) >= greatest(2, floor(n * 0.1::DOUBLE)))
        SELECT paper_id, count(*) AS n_lines, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM k ANTI JOIN o USING (paper_id, key) WHERE NOT regexp_full_match(key, '[#\s\-–/of]*') GROUP BY paper_id""",
    "a2_body_size": """WITH s AS (SELECT l_suppkey AS paper_id, round_even(l_quantity / 4 * 2, 0) / 2 AS body, sum(l_linenumber) AS c FROM lineitem GROUP BY 1, 2)
        SELECT paper_id, arg_max(body, struct_pack(c := c, b := -body)) AS body FROM s GROUP BY paper_id""",
    "a3_page_spans": f"WITH {_L} SELECT paper_id, line_no % 7 AS section_no, min(page) AS page_start, max(page) AS page_end, count(DISTINCT page) AS n_pages FROM l GROUP BY 1, 2",
    "a4_paragraphs": rf"""WITH {_L}, b AS (SELECT paper_id, page, block, trim(string_agg(text, ' ' ORDER BY line_no)) AS t FROM l GROUP BY 1, 2, 3),
        p AS (SELECT paper_id, regexp_replace(string_agg(t, chr(10) || chr(10) ORDER BY block), '([\p{{L}}\p{{N}}_])- (\p{{Ll}})', '\1\2', 'g') AS t FROM b WHERE t <> '' GROUP BY 1)
        SELECT paper_id, length(t) AS n, md5(t) AS md5 FROM p""",
    "w1_sectionize": rf"""WITH {_L}, {_HEAD}, w AS (SELECT *, count(heading) OVER o AS section_no, last_value(heading IGNORE NULLS) OVER o AS section FROM m WINDOW o AS (PARTITION BY paper_id ORDER BY line_no))
        SELECT paper_id, section_no, min(section) AS section, count(*) AS n, min(line_no) AS first FROM w WHERE heading IS NULL GROUP BY 1, 2""",
    "w15_choose_structure": rf"""WITH {_L}, {_HEAD}, h AS (SELECT paper_id, line_no AS start, (line_no % 9) || ' ' || heading AS heading, count(*) OVER (PARTITION BY paper_id) AS n FROM m WHERE heading IS NOT NULL),
        p AS (SELECT paper_id, max(page) + 1 AS n FROM l GROUP BY 1)
        SELECT paper_id, start, heading FROM h WHERE n >= 3
        UNION ALL SELECT paper_id, x, 'Pages ' || (x + 1) || '-' || least(n, x + 2) FROM (SELECT paper_id, n, unnest(generate_series(0, n - 1, 2)) AS x FROM p WHERE paper_id NOT IN (SELECT paper_id FROM h WHERE n >= 3))""",
    "j13_find_page": f"""WITH c AS (SELECT doc_id AS page, ' ' || {_CANON.replace("X", "text")} || ' ' AS t FROM documents), k AS (SELECT item_id, ' ' || array_to_string(string_split({_CANON.replace("X", "text")}, ' ')[1:5], ' ') || ' ' AS key FROM benchmark), n AS (SELECT count(*) AS n FROM documents)
        SELECT 'all' AS paper_id, item_id AS phrase_id, arg_min(page, ((page - item_id * 10) % n + n) % n) AS page FROM k JOIN c ON contains(t, key), n GROUP BY item_id""",
    "j4_ground_numbers": r"SELECT doc_id AS number_id FROM documents WHERE doc_id % 2 = 0 AND regexp_matches(text, '(^|[^\w.])\d+($|[^\w.])')",
    "p7_clean_concepts": r"""WITH f AS (SELECT doc_id, i, CASE i WHEN 0 THEN length(w) BETWEEN 2 AND 20 AND NOT contains(w, ')') WHEN 1 THEN false ELSE contains(lower(text), source) END AS hit
        FROM (SELECT *, string_split_regex(trim(text), '\s+')[1] AS w, unnest([0, 1, 2]) AS i FROM documents))
        SELECT doc_id AS section_id, CAST(i AS INT) AS concept_no FROM (SELECT *, bool_or(hit) OVER (PARTITION BY doc_id) AS any_hit FROM f) WHERE hit OR NOT any_hit""",
    "w7_neighbors": """SELECT o_custkey AS paper_id, o_orderkey AS section_no, o_orderpriority AS title, lag(o_orderpriority) OVER w AS previous, lead(o_orderpriority) OVER w AS next,
        CAST(row_number() OVER w AS INT) AS position, count(*) OVER (PARTITION BY o_custkey) AS n_sections FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""",
    "w8_earlier_context": """SELECT conv_id AS paper_id, turn AS section_no, coalesce(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS earlier FROM conversations""",
    "j12_section_of_page": "SELECT p.b AS paper_id, p.page, max(s.p_partkey) AS section_no FROM (SELECT DISTINCT p_brand AS b, p_size + 2 AS page FROM part) p JOIN part s ON s.p_brand = p.b AND page BETWEEN s.p_size AND s.p_size + 5 GROUP BY 1, 2",
    "w17_pack_units": """WITH RECURSIVE u AS (SELECT o_custkey AS paper_id, o_orderkey AS unit_no, CAST(floor(o_totalprice) AS BIGINT) AS size, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
        r AS (SELECT paper_id, unit_no, n, 1 AS pack, size AS used FROM u WHERE n = 1 UNION ALL
              SELECT u.paper_id, u.unit_no, u.n, CASE WHEN used > 0 AND used + size > 1000000 THEN pack + 1 ELSE pack END, CASE WHEN used > 0 AND used + size > 1000000 THEN size ELSE used + size END FROM r JOIN u ON u.paper_id = r.paper_id AND u.n = r.n + 1)
        SELECT paper_id, unit_no, CAST(pack AS INT) AS pack FROM r""",
    "a26_label_parts": """WITH n AS (SELECT l_orderkey AS section_no, l_linenumber - 1 AS part, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
        SELECT section_no, part, CASE WHEN n > 1 THEN 'T (' || (part + 1) || '/' || n || ')' ELSE 'T' END AS title, n AS n_parts FROM n""",
    "u4_clean_plan": """WITH p AS (SELECT l_orderkey % 50 AS paper_id, l_orderkey AS section_id, l_orderkey * 10 + l_linenumber AS o, l_suppkey AS raw_id FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 > 0)),
        f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY paper_id, raw_id ORDER BY o) = 1)
        SELECT paper_id, section_id, string_agg(CAST(raw_id AS VARCHAR), ',' ORDER BY raw_id) AS raw_ids, min(raw_id) AS first FROM f GROUP BY 1, 2""",
    "a23_check_plan": """WITH p AS (SELECT l_orderkey % 50 AS paper_id, l_orderkey AS section_id, l_suppkey AS raw_id FROM lineitem)
        SELECT DISTINCT paper_id, 'unknown' AS problem, CAST(raw_id AS VARCHAR) AS what FROM p WHERE raw_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 > 0)
        UNION ALL SELECT paper_id, 'twice', CAST(raw_id AS VARCHAR) FROM p GROUP BY paper_id, raw_id HAVING count(*) > 1
        UNION ALL SELECT paper_id, 'count', CAST(count(DISTINCT section_id) AS VARCHAR) FROM p GROUP BY paper_id HAVING count(DISTINCT section_id) < 9 OR count(DISTINCT section_id) > 22""",
    "u5_fallback_plan": f"""WITH {_SEC}, t AS (SELECT *, greatest(1, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id ORDER BY n)) AS plan_no FROM s)
        SELECT paper_id, CAST(plan_no AS BIGINT) AS plan_no, string_agg('r' || n, ',' ORDER BY n) AS raw_ids FROM t GROUP BY 1, 2""",
    "j1_grounding_text": f"""WITH {_SEC} SELECT a.paper_id, CAST(a.n AS INT) AS section_id, md5(coalesce('## Part ' || b.doc_id || chr(10) || b.text || chr(10) || chr(10), '') || '## Part ' || a.doc_id || chr(10) || a.text) AS md5
        FROM s a LEFT JOIN s b ON b.paper_id = a.paper_id AND b.n = a.n + 1""",
    "j7_name_in_text": r"""SELECT doc_id AS source_id, CAST(i AS INT) AS concept_no, CASE i WHEN 0 THEN length(w) BETWEEN 2 AND 20 AND NOT contains(w, ')') WHEN 1 THEN false ELSE contains(lower(text), source) END AS in_text
        FROM (SELECT *, string_split_regex(trim(text), '\s+')[1] AS w, unnest([0, 1, 2]) AS i FROM documents)""",
    "p8_clean_results": """WITH r AS (SELECT l_suppkey AS section_id, l_orderkey * 10 + l_linenumber AS result_no, l_partkey, l_returnflag FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) <= 6)
        SELECT section_id, result_no, CASE WHEN p_size > 25 THEN l_returnflag ELSE '' END AS value FROM r JOIN part ON p_partkey = l_partkey""",
    "p9_clean_key_result": "SELECT c_custkey AS paper_id, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN '' ELSE c_mktsegment END AS key_result FROM customer",
    "j8_drop_ungrounded": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "a22_check_beats": """SELECT conv_id AS section_id, count(*) AS n_beats, count(*) < 4 AS few, coalesce(array_to_string(list_sort(list(DISTINCT turn || '.5') FILTER (WHERE turn % 2 = 1))[1:8], ','), '') AS bad FROM conversations GROUP BY conv_id""",
    "j18_apply_fixes": """WITH c AS (SELECT conv_id, turn, text AS t FROM conversations), f AS (SELECT *, conv_id % 5 <> 0 AND turn % 3 <> 0 AND trim(reverse(t)) <> '' AND reverse(t) <> t AS ok FROM c)
        SELECT 'deep.s' || conv_id || '.b' || turn AS beat_id, CASE WHEN ok THEN reverse(t) ELSE t END AS narration, ok AS applied FROM f""",
    "j2_match_quotes": f"""WITH q AS (SELECT doc_id, trim({_N.replace("X", "substring(text, 20, 60)")}, ' "''') AS q, {_N.replace("X", "text")} AS s FROM documents WHERE doc_id % 3 <> 0)
        SELECT doc_id AS quote_id, substring(s, strpos(lower(s), lower(q)), length(q)) AS found FROM q WHERE length(q) >= 12 AND strpos(lower(s), lower(q)) > 0""",
}
