"""Queries over entities and graphs, extraction without a model, and response stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import enrich as X
from ..operators import graph as G
from ..shared import settle
from ..sources.tables import table, titles


def _edges(spark, d):
    """v_graph: parts supplied by suppliers; a paper for each line number."""
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_linenumber").cast("string").alias("paper_id"), F.concat(F.lit("p"), "l_partkey").alias("source"), F.concat(F.lit("s"), "l_suppkey").alias("target"), F.col("l_returnflag").alias("relation"), F.col("l_linestatus").alias("description"), F.col("l_linenumber").alias("section_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("relation_no"))


def _nodes(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node_id"), F.col("p_name").alias("label"), F.when(F.col("p_partkey") == 0, "this_work").otherwise("method").alias("type"), F.array(F.lower("p_brand")).alias("aliases"), (F.col("p_size") % 5).cast("long").alias("mentions"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node_id"), F.col("s_name").alias("label"), F.lit("dataset").alias("type"), F.array().cast("array<string>").alias("aliases"), F.lit(1).cast("long").alias("mentions"))
    return p.unionAll(s).select(F.explode(F.array(*[F.lit(str(i)) for i in range(1, 8)])).alias("paper_id"), "*")


def _paper_of(order: str):
    """A paper for every ten orders."""
    return F.floor(F.col(order) / 10)


def _order_lines(spark, d):
    """(l_orderkey, l_linenumber, l_partkey): one part, the first, of each line number of an order."""
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))


def _part_name():
    return F.concat(F.initcap("p_name"), F.lit(" "), F.col("l_partkey") % 40)


def _mentions(spark, d):
    """Part names of orders as mentions, spelled in several ways."""
    li = _order_lines(spark, d).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    name = _part_name()
    spelled = F.when(k % 4 == 0, F.concat(F.lit("The "), name)).when(k % 4 == 1, F.concat(name, F.lit(" [9]"))).when(k % 4 == 2, F.concat(name, F.lit(" dataset"))).otherwise(F.concat(name, F.lit("s")))
    center = table(spark, d, "orders").select(_paper_of("o_orderkey").alias("paper_id")).distinct().select("paper_id", F.lit(-1).cast("long").alias("mention_no"), F.lit("this work").alias("name"), F.lit("").alias("alias"), F.lit("this_work").alias("type"), F.lit("").alias("description"), F.lit("").alias("evidence"), F.lit("s0").alias("section_id"))
    named = li.select(_paper_of("l_orderkey").alias("paper_id"), k.alias("mention_no"), spelled.alias("name"), F.when(k % 9 == 0, "our method").otherwise("").alias("alias"), F.when(k % 3 == 0, "concept").otherwise("dataset").alias("type"), F.when(k % 2 == 0, F.col("p_type")).otherwise("").alias("description"), F.lit("").alias("evidence"), F.concat(F.lit("s"), "l_linenumber").alias("section_id"))
    return named.unionAll(center)


def _resolved(spark, d):
    return G.resolve_entities(_mentions(spark, d))


def _components(spark, d):
    li = table(spark, d, "lineitem")
    return G.connected(li.select((F.col("l_orderkey") % 40).alias("paper_id"), F.col("l_orderkey").alias("node"), F.col("l_partkey").alias("key")))


def _papers(spark, d):
    """Each paper says the names of its own parts."""
    m = _order_lines(spark, d).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return m.groupBy(_paper_of("l_orderkey").alias("paper_id")).agg(F.array_join(F.array_sort(F.collect_set(F.lower(_part_name()))), "; ").alias("normal_lower"))


def _relations(spark, d):
    m = _mentions(spark, d)
    return m.select("paper_id", F.col("mention_no").alias("relation_no"), F.col("name").alias("source"), F.when(F.col("mention_no") % 2 == 0, "we").otherwise("Nothing Known").alias("target"), F.lit("builds on").alias("relation"), "description", "section_id")


def _graph(spark, d):
    nodes, edges = G.build_graph(_mentions(spark, d), _relations(spark, d), _papers(spark, d))
    return nodes.select("paper_id", "node_id", "label", "type", "mentions", "degree", "rank")


def _filtered(spark, d):
    nodes, edges = G.filter_graph(_nodes(spark, d), _edges(spark, d), ["dataset"])
    return nodes.select("paper_id", "node_id").unionAll(edges.select("paper_id", F.col("source").alias("node_id")))


def _implied(spark, d):
    prior = _edges(spark, d).where("relation = 'R'").select("paper_id", F.col("target").alias("source"), F.concat(F.lit("p"), F.substring("source", 2, 9).cast("long") % 100).alias("target"), F.lit("extends").alias("relation"), F.col("relation_no").alias("prior_no"))
    return G.add_implied_edges(_edges(spark, d).where("relation = 'N'"), prior)


def _hood(spark, d):
    ids = _nodes(spark, d).where("node_id in ('p1', 's1', 's3')").select("paper_id", "node_id")
    return G.neighborhood(_edges(spark, d), ids)


def _degrees(spark, d):
    return G.degrees(_nodes(spark, d), _edges(spark, d)).select("paper_id", "node_id", "degree")


def _integrity(spark, d):
    return G.check_integrity(_nodes(spark, d).where("node_id <> 's3'"), _edges(spark, d))


def _facts(spark, d):
    from ..operators.retrieval import graph_facts

    q = table(spark, d, "supplier").select((F.col("s_suppkey") % 7 + 1).cast("string").alias("paper_id"), F.col("s_suppkey").alias("query"), F.concat(F.lit("What of "), "s_name", F.lit("?")).alias("question"), F.lit(None).cast("string").alias("node"))
    nodes = _nodes(spark, d).withColumn("description", F.lit(""))
    edges = _edges(spark, d).withColumn("edge_no", F.col("relation_no"))
    return graph_facts(q, nodes, edges)


def _labels(spark, d):
    p = table(spark, d, "part")
    name = F.concat(F.lit(r"$\pi_{0}$-"), F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, " [9, 10]").otherwise(" (2015)"))
    return p.select("p_partkey", T.clean_label(name).alias("label"))


def _keys(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.array_join(F.array_sort(T.alias_keys(F.concat(F.lit("The "), F.col("p_name"), F.lit(" dataset")))), "|").alias("keys"))


def _slugs(spark, d):
    p = table(spark, d, "part").select((F.col("p_partkey") % 10).alias("paper_id"), F.col("p_partkey").alias("cluster"), F.col("p_name").alias("label"))
    return G.unique_slugs(p).select("paper_id", "cluster", "node_id")


def _sections(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def _store(spark, d):
    """Replies that a store lacks are computed once for each distinct request."""
    asks = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("request"))
    known = asks.where("turn = 0").select("request").distinct().withColumn("reply", F.lit("stored"))
    stored = X.request_keys(known, "demo").select("request_key", "reply")
    done, _ = X.enrich(asks, stored, "demo", X.reverse_provider)
    return done.select("conv_id", "turn", "request", "reply")


def _checked(spark, d):
    asks = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("request"))
    ok = F.when(F.length("reply") % 2 == 1, F.lit("odd length"))
    return X.enrich_checked(asks, "demo", X.reverse_provider, ok, 2).select("conv_id", "turn", "reply", "problem", "rounds")


def _quiz(spark, d):
    return X.extractive_quiz(_sections(spark, d)).select("doc_id", "question_no", "question", "correct")


def _key_check(spark, d):
    q = X.extractive_quiz(_sections(spark, d))
    return X.check_answers(q.withColumn("options", F.array(F.lit("zz zz"), F.col("correct"))), _sections(spark, d)).select("doc_id", "question_no", "found")


def _nodes_many(spark, d):
    """Nodes for every beginning of a part's name of one to six characters."""
    asked = table(spark, d, "part").select(F.expr("upper(substring(p_name, 1, cast(p_partkey % 6 as int) + 1))").alias("text")).distinct()
    return G.search_nodes_all(_nodes(spark, d), asked.withColumn("query", F.col("text")), ["dataset"]).select("query", "paper_id", "node_id")


QUERIES = {
    "e1_clean_label": _labels,
    "e2_alias_keys": _keys,
    "e3_connected": _components,
    "e3_resolve_entities": lambda s, d: _resolved(s, d).select("paper_id", "mention_no", "cluster"),
    "a7_rollup_entities": lambda s, d: G.rollup_entities(settle(_resolved(s, d))).select("paper_id", "cluster", "label", "type", F.array_join("aliases", "|").alias("aliases"), "description", F.array_join("sections", ",").alias("sections"), "mentions"),
    "e5_resolve_edges": lambda s, d: G.resolve_edges(_relations(s, d), settle(_resolved(s, d))),
    "e8_build_graph": _graph,
    "a8_rollup_edges": lambda s, d: G.rollup_edges(_edges(s, d)).select("paper_id", "source", "target", "relation", "description", F.array_join("sections", ",").alias("sections"), "n"),
    "e7_add_implied_edges": _implied,
    "a9_degrees": _degrees,
    "t3_prune_graph": lambda s, d: G.prune_graph(_nodes(s, d), _edges(s, d)).select("paper_id", "node_id", "rank"),
    "t10_top_nodes": lambda s, d: G.top_nodes(G.degrees(_nodes(s, d), _edges(s, d))).select("paper_id", "node_id", "rank"),
    "p10_filter_graph": _filtered,
    "p11_search_nodes": lambda s, d: G.search_nodes(_nodes(s, d), "Brand#1", ["dataset"]).select("paper_id", "node_id"),
    "p11_search_many": _nodes_many,
    "j23_neighborhood": _hood,
    "j25_check_integrity": _integrity,
    "j22_graph_facts": _facts,
    "w13_unique_slugs": _slugs,
    "x1_enrich": _store,
    "x2_enrich_checked": _checked,
    "x3_extractive_analysis": lambda s, d: X.extractive_analysis(_sections(s, d)).select("doc_id", "summary", F.size("key_points").cast("long").alias("n_points"), F.array_join("concepts", ",").alias("concepts"), F.array_join("prior_work", ",").alias("prior_work")),
    "x4_extractive_quiz": _quiz,
    "x4_check_answers": _key_check,
    "x5_t11_extractive_graph": lambda s, d: X.extractive_graph(_sections(s, d)),
}

_E = "e AS (SELECT CAST(l_linenumber AS VARCHAR) AS paper_id, 'p' || l_partkey AS source, 's' || l_suppkey AS target, l_returnflag AS relation, l_linestatus AS description, l_linenumber AS section_id, l_orderkey * 10 + l_linenumber AS relation_no FROM lineitem)"
_V = """v AS (SELECT CAST(p AS VARCHAR) AS paper_id, x.* FROM (SELECT unnest(generate_series(1, 7)) AS p), (SELECT 'p' || p_partkey AS node_id, p_name AS label, CASE WHEN p_partkey = 0 THEN 'this_work' ELSE 'method' END AS type, lower(p_brand) AS alias, p_size % 5 AS mentions FROM part
    UNION ALL SELECT 's' || s_suppkey, s_name, 'dataset', '', 1 FROM supplier) x)"""
_G = "g AS (SELECT paper_id, node_id, count(*) AS n FROM (SELECT paper_id, source AS node_id FROM e UNION ALL SELECT paper_id, target FROM e) GROUP BY ALL)"
_M = """m AS (SELECT l_orderkey // 10 AS paper_id, l_orderkey * 10 + l_linenumber AS mention_no, lower(n) AS key, 's' || l_linenumber AS section_id, p_type,
        CASE (l_orderkey * 10 + l_linenumber) % 4 WHEN 0 THEN 'The ' || n WHEN 1 THEN n || ' [9]' WHEN 2 THEN n || ' dataset' ELSE n || 's' END AS name
        FROM (SELECT l_orderkey, l_linenumber, p_type, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' ' || (l_partkey % 40) AS n
              FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL) JOIN part ON p_partkey = l_partkey)),
    g AS (SELECT paper_id, key, min(mention_no) AS c, bool_or(mention_no % 9 = 0) AS own FROM m GROUP BY ALL),
    w AS (SELECT m.*, CASE WHEN own THEN -1 ELSE c END AS cluster, CASE WHEN mention_no % 9 = 0 THEN 'our method' ELSE '' END AS alias, CASE WHEN mention_no % 3 = 0 THEN 'concept' ELSE 'dataset' END AS type, CASE WHEN mention_no % 2 = 0 THEN p_type ELSE '' END AS description FROM m JOIN g USING (paper_id, key)),
    r AS (SELECT paper_id, mention_no, name, section_id, cluster, alias, type, description FROM w UNION ALL SELECT DISTINCT o_orderkey // 10, -1, 'this work', 's0', -1, '', 'this_work', '' FROM orders)"""
_ROLLED = """nm AS (SELECT paper_id, cluster, name, count(*) AS n, min(mention_no) AS f FROM r GROUP BY ALL),
    lb AS (SELECT paper_id, cluster, arg_max(name, struct_pack(n := n, l := length(name), f := -f)) AS label FROM nm GROUP BY ALL),
    kd AS (SELECT paper_id, cluster, type, count(*) AS n, min(mention_no) AS f FROM r GROUP BY ALL),
    tp AS (SELECT paper_id, cluster, arg_max(type, struct_pack(o := type = 'this_work', r := type <> 'concept', n := n, f := -f)) AS type FROM kd GROUP BY ALL),
    re AS (SELECT paper_id, cluster, list_sort(list_distinct(list_concat(list(name), list(alias) FILTER (WHERE alias <> '')))) AS names, coalesce(arg_min(description, mention_no) FILTER (WHERE description <> ''), '') AS description,
        array_to_string(list_sort(list_distinct(list(section_id))), ',') AS sections, count(*) AS mentions FROM r GROUP BY ALL)"""
_SENT = r"""s AS (SELECT doc_id, text, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) BETWEEN 40 AND 260) AS s FROM documents)"""

ORACLES = {
    "e1_clean_label": "SELECT p_partkey, 'π0-' || p_name AS label FROM part",
    "e2_alias_keys": "SELECT p_partkey, array_to_string(list_sort(list_distinct([p_name || ' dataset', p_name])), '|') AS keys FROM part",
    "a8_rollup_edges": f"""WITH {_E}, p AS (SELECT paper_id, source, target, relation, section_id, min(relation_no) AS f, arg_min(description, struct_pack(a := relation_no, b := description)) AS d, count(*) AS n FROM e GROUP BY ALL)
        SELECT paper_id, source, target, relation, arg_min(d, f) AS description, string_agg(CAST(section_id AS VARCHAR), ',' ORDER BY f) AS sections, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY ALL""",
    "e7_add_implied_edges": f"""WITH {_E}, o AS (SELECT paper_id, source, target, relation FROM e WHERE relation = 'N'),
        p AS (SELECT paper_id, target AS source, 'p' || (CAST(substr(source, 2) AS BIGINT) % 100) AS target, relation_no FROM e WHERE relation = 'R'),
        k AS (SELECT * FROM p WHERE source <> target AND (paper_id, least(source, target), greatest(source, target)) NOT IN (SELECT (paper_id, least(source, target), greatest(source, target)) FROM o))
        SELECT * FROM o UNION ALL SELECT paper_id, source, target, 'extends' FROM k QUALIFY row_number() OVER (PARTITION BY paper_id, least(source, target), greatest(source, target) ORDER BY relation_no) = 1""",
    "a9_degrees": f"WITH {_E}, {_V}, {_G} SELECT paper_id, node_id, coalesce(n, 0) AS degree FROM v LEFT JOIN g USING (paper_id, node_id)",
    "t3_prune_graph": f"""WITH {_E}, {_V}, {_G}, r AS (SELECT paper_id, node_id, type, label, mentions, coalesce(n, 0) AS n FROM v LEFT JOIN g USING (paper_id, node_id) WHERE n > 0 OR type = 'this_work')
        SELECT paper_id, node_id, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY type <> 'this_work', 2 * n + mentions DESC, lower(label), node_id) AS INT) AS rank FROM r QUALIFY rank <= 36""",
    "t10_top_nodes": f"""WITH {_E}, {_V}, {_G} SELECT paper_id, node_id, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY coalesce(n, 0) DESC, label, node_id) AS INT) AS rank FROM v LEFT JOIN g USING (paper_id, node_id) WHERE type <> 'this_work' QUALIFY rank <= 8""",
    "p10_filter_graph": f"WITH {_V} SELECT paper_id, node_id FROM v WHERE type <> 'dataset'",
    "p11_search_many": f"""WITH {_V}, q AS (SELECT DISTINCT upper(left(p_name, CAST(p_partkey % 6 AS INT) + 1)) AS query FROM part)
        SELECT query, paper_id, node_id FROM q, v WHERE type <> 'dataset' AND (contains(lower(label), lower(query)) OR contains(alias, lower(query)))""",
    "p11_search_nodes": f"WITH {_V} SELECT paper_id, node_id FROM v WHERE type <> 'dataset' AND (contains(lower(label), 'brand#1') OR contains(alias, 'brand#1'))",
    "j23_neighborhood": f"""WITH {_E} SELECT paper_id, source AS node_id, target AS other, relation, 'out' AS direction FROM e WHERE source IN ('p1', 's1', 's3')
        UNION ALL SELECT paper_id, target, source, relation, 'in' FROM e WHERE target IN ('p1', 's1', 's3')""",
    "j25_check_integrity": f"WITH {_E} SELECT DISTINCT paper_id, 'unknown end' AS problem, 's3' AS what FROM e WHERE target = 's3'",
    "e3_connected": """WITH RECURSIVE p AS (SELECT DISTINCT l_orderkey % 40 AS paper_id, l_orderkey AS node, l_partkey AS key FROM lineitem),
        l AS (SELECT DISTINCT a.paper_id, a.node, b.node AS other FROM p a JOIN p b USING (paper_id, key)),
        r AS (SELECT DISTINCT paper_id, node, node AS label FROM p UNION SELECT l.paper_id, l.node, r.label FROM r JOIN l ON l.paper_id = r.paper_id AND l.other = r.node)
        SELECT paper_id, node, min(label) AS label FROM r GROUP BY ALL""",
    "e3_resolve_entities": f"WITH {_M} SELECT paper_id, mention_no, cluster FROM r",
    "e5_resolve_edges": f"WITH {_M} SELECT paper_id, cluster AS source, CAST(-1 AS BIGINT) AS target, 'extends' AS relation, description, section_id, mention_no AS relation_no FROM w WHERE cluster <> -1 AND mention_no % 2 = 0",
    "a7_rollup_entities": f"""WITH {_M}, {_ROLLED} SELECT paper_id, cluster, label, type, array_to_string(list_filter(names, lambda x: x <> label)[1:6], '|') AS aliases, description, sections, mentions FROM re JOIN lb USING (paper_id, cluster) JOIN tp USING (paper_id, cluster)""",
    "e8_build_graph": f"""WITH {_M.replace("n || ' [9]'", "n")}, {_ROLLED},
        sd AS (SELECT paper_id, cluster FROM r GROUP BY ALL HAVING bool_or(mention_no % 4 = 1) OR cluster = -1),
        nd AS (SELECT paper_id, cluster, label, type, mentions, trim(regexp_replace(regexp_replace(lower(label), '^the ', ''), '[^a-z0-9]+', '-', 'g'), '-')[1:40] AS slug FROM re JOIN sd USING (paper_id, cluster) JOIN lb USING (paper_id, cluster) JOIN tp USING (paper_id, cluster)),
        no AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN slug ELSE slug || '-' || row_number() OVER w END AS node_id FROM nd WINDOW w AS (PARTITION BY paper_id, slug ORDER BY cluster)),
        ed AS (SELECT DISTINCT paper_id, cluster AS source, -1 AS target FROM w JOIN sd USING (paper_id, cluster) WHERE cluster <> -1 AND mention_no % 2 = 0),
        dg AS (SELECT paper_id, cluster, count(*) AS degree FROM (SELECT paper_id, source AS cluster FROM ed UNION ALL SELECT paper_id, target FROM ed) GROUP BY ALL),
        al AS (SELECT no.*, coalesce(degree, 0) AS degree, count(*) OVER (PARTITION BY paper_id) AS n FROM no LEFT JOIN dg USING (paper_id, cluster))
        SELECT paper_id, node_id, label, type, mentions, degree, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY type <> 'this_work', 2 * degree + mentions DESC, lower(label), node_id) AS INT) AS rank
        FROM al WHERE n <= 12 OR degree > 0 OR type = 'this_work' QUALIFY rank <= 36""",
    "j22_graph_facts": f"""WITH {_E}, {_V}, q AS (SELECT CAST(s_suppkey % 7 + 1 AS VARCHAR) AS paper_id, s_suppkey AS query, 'what of ' || lower(s_name) || '?' AS question FROM supplier),
        f AS (SELECT query, paper_id, node_id FROM q JOIN v USING (paper_id) WHERE (length(label) > 2 AND contains(question, lower(label))) OR (length(alias) > 2 AND contains(question, alias))),
        t AS (SELECT DISTINCT query, e.* FROM f JOIN e ON e.paper_id = f.paper_id AND (e.source = f.node_id OR e.target = f.node_id)),
        n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY relation_no, source, target) AS fact_no FROM t QUALIFY fact_no <= 14)
        SELECT query, CAST(fact_no AS INT) AS fact_no, a.label || ' --' || relation || '--> ' || b.label || ': ' || description AS fact FROM n JOIN v a ON a.paper_id = n.paper_id AND a.node_id = n.source JOIN v b ON b.paper_id = n.paper_id AND b.node_id = n.target""",
    "x2_enrich_checked": """SELECT conv_id, turn, CASE WHEN length(text) % 2 = 0 THEN reverse(text) ELSE reverse(text || repeat(chr(10) || 'Problem: odd length', 2)) END AS reply, CASE WHEN length(text) % 2 = 1 THEN 'odd length' END AS problem, CASE WHEN length(text) % 2 = 1 THEN 2 ELSE 0 END AS rounds FROM conversations""",
    "x3_extractive_analysis": rf"""WITH {_SENT}, c AS (SELECT *, list_sort(list_distinct(list_filter(string_split_regex(text, '[^\p{{L}}\p{{N}}_-]+'), lambda w: regexp_full_match(w, '[A-Z][A-Za-z0-9-]{{3,}}'))))[1:6] AS c, CASE WHEN len(s) > 0 THEN s WHEN text = '' THEN ['This section has little text.'] ELSE [left(text, 200)] END AS p FROM s)
        SELECT doc_id, array_to_string(p[1:2], ' ') AS summary, CAST(len(p[1:4]) AS BIGINT) AS n_points, array_to_string(c[1:3], ',') AS concepts, array_to_string(c[4:6], ',') AS prior_work FROM c""",
    "x5_t11_extractive_graph": r"""WITH t AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '[^\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z][A-Za-z0-9]{2,}'))) AS term FROM documents), n AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY ALL HAVING count(*) >= 2)
        SELECT doc_id, 'this work' AS source, 'uses' AS relation, term AS target FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) <= 4""",
    "w13_unique_slugs": "SELECT p_partkey % 10 AS paper_id, p_partkey AS cluster, replace(p_name, ' ', '-') || CASE WHEN row_number() OVER w = 1 THEN '' ELSE '-' || row_number() OVER w END AS node_id FROM part WINDOW w AS (PARTITION BY p_partkey % 10, p_name ORDER BY p_partkey)",
    "x1_enrich": """WITH a AS (SELECT conv_id, turn, text AS request FROM conversations), k AS (SELECT DISTINCT request FROM a WHERE turn = 0)
        SELECT conv_id, turn, request, CASE WHEN request IN (SELECT request FROM k) THEN 'stored' ELSE reverse(request) END AS reply FROM a""",
    "x4_check_answers": rf"""WITH {_SENT} SELECT doc_id, CAST(i AS INT) AS question_no, 1 AS found FROM (SELECT doc_id, unnest(generate_series(1, len(s))) AS i FROM s)""",
    "x4_extractive_quiz": rf"""WITH {_SENT}, q AS (SELECT doc_id, i, s[i] AS s, string_split_regex(s[i], '\s+') AS w FROM (SELECT doc_id, s, unnest(generate_series(1, len(s))) AS i FROM s))
        SELECT doc_id, CAST(i AS INT) AS question_no, 'What does the paper say about ' || array_to_string(list_transform(w[3:6], lambda x: trim(x, '.,;:')), ' ') || '?' AS question, array_to_string(w[1:18], ' ') AS correct FROM q""",
}
