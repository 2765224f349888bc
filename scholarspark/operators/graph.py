"""Entities and the knowledge graph built from mentions of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import alias_keys, choose, clean_label, let, name_forms, relation_of, slug, NODE_TYPES
from ..shared import settle, shuffled, stored, written
from .components import components, connected_within
from .lookup import look_up
from .substrings import containing

#: Pairs of a paper that one task holds, some 100 bytes each.
MOST_PAIRS = 1 << 22
#: About how many bytes of names, with what is made of them, are broadcast; more meet by shuffle.
MOST_NAMES = 1 << 24
# What a paper calls itself.
CENTER_ALIASES = ["this work", "this paper", "our method", "our approach", "our model", "proposed method", "ours", "we"]


def _made_once(rows: DataFrame, columns: dict[str, str], make: Callable[[Column], Column]) -> DataFrame:
    """rows with make(column) as `out` for each {out: column}, worked out once for each different value: names repeat from paper to paper, and their patterns cost more than a join."""
    values = rows.select(F.explode(F.array(*columns.values())).alias("__value")).distinct()
    made = settle(values.select("__value", make(F.col("__value")).alias("__made")))
    size = made.agg(F.coalesce(F.sum(400 + 8 * F.coalesce(F.octet_length("__value"), F.lit(0)).cast("long")), F.lit(0))).first()[0]
    made = F.broadcast(made) if size <= MOST_NAMES else shuffled(made)
    for out, column in columns.items():
        rows = rows.join(made.withColumnRenamed("__made", out), F.col(column).eqNullSafe(F.col("__value")), "left").drop("__value")
    return rows


def connected(pairs: DataFrame) -> DataFrame:
    """(node, label) from links pairs(paper_id, node, key): nodes that share keys, directly or by others, get the smallest node of their component.

    Papers of up to MOST_PAIRS pairs are read whole, many in one task. In larger ones every node is linked with the smallest
    node that has its key; the components of these links, which are fewer than the pairs, are what keys connect. The smallest
    nodes are kept before they are joined, so that a key that many nodes have can be split.
    """
    pairs = stored(pairs.select("paper_id", "node", "key"))
    sizes = settle(pairs.groupBy("paper_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("node").isNull() | F.col("key").isNull(), 1)).alias("gaps")))
    large = settle(sizes.where(F.col("paper_id").isNull() | (F.col("n") > MOST_PAIRS) | (F.col("gaps") > 0)).select("paper_id"))
    n_large, n_all = large.count(), sizes.count()
    if not n_large:
        return connected_within(pairs)
    if n_large == n_all:
        return _connected_by_rounds(pairs)
    apart, same = large.withColumnRenamed("paper_id", "__large"), F.expr("paper_id <=> __large")
    return connected_within(pairs.join(apart, same, "left_anti")).unionByName(_connected_by_rounds(pairs.join(apart, same, "left_semi")))


def _connected_by_rounds(pairs: DataFrame) -> DataFrame:
    pairs = settle(pairs.distinct())
    least = settle(pairs.groupBy("paper_id", "key").agg(F.min("node").alias("least")))
    node = lambda c: F.struct(F.col("paper_id").alias("paper_id"), F.col(c).alias("node"))
    found = settle(components(pairs.join(least, ["paper_id", "key"]).where("node <> least").select(node("node").alias("a"), node("least").alias("b"))))
    labels = found.select("node.paper_id", "node.node", F.col("label.node").alias("label"))
    alone = pairs.select("paper_id", "node").distinct().join(labels, ["paper_id", "node"], "left_anti")
    return labels.unionAll(alone.select("paper_id", "node", F.col("node").alias("label")))


def resolve_entities(mentions: DataFrame) -> DataFrame:
    """mentions(paper_id, mention_no, name, alias, type, ...) with cluster: the smallest mention_no of all that share alias keys. The paper's own names meet with type this_work."""
    said = stored(mentions.select("paper_id", "mention_no", "name", F.when(F.col("alias") != "", F.col("alias")).alias("alias"), "type"))
    keyed = _made_once(said, {"__name": "name", "__alias": "alias"}, alias_keys)
    own = lambda ks: F.exists(ks, lambda k: k.isin(CENTER_ALIASES)) | (F.col("type") == "this_work")
    keys = let(F.concat("__name", "__alias"), lambda ks: F.when(own(ks), F.concat(ks, F.array(F.lit("__center__")))).otherwise(ks))
    pairs = keyed.select("paper_id", F.col("mention_no").alias("node"), F.explode(keys).alias("key"))
    found = connected(pairs).select("paper_id", F.col("node").alias("mention_no"), F.col("label").alias("cluster"))
    return mentions.join(found, ["paper_id", "mention_no"], "left").withColumn("cluster", F.coalesce("cluster", "mention_no"))


def rollup_entities(mentions: DataFrame) -> DataFrame:
    """One row for each (paper_id, cluster): label (most frequent, then longest, then first name), type (what most say, "concept" only if nothing else), up to 6 aliases, first evidence and description, sections, mentions."""
    names = mentions.groupBy("paper_id", "cluster", "name").agg(F.count("*").alias("n"), F.min("mention_no").alias("first"))
    label = names.groupBy("paper_id", "cluster").agg(F.max_by("name", F.struct("n", F.length("name").alias("l"), (-F.col("first")).alias("f"))).alias("label"))
    kinds = mentions.withColumn("kind", choose(F.col("type"), NODE_TYPES, "concept")).groupBy("paper_id", "cluster", "kind").agg(F.count("*").alias("n"), F.min("mention_no").alias("first"))
    vote = kinds.groupBy("paper_id", "cluster").agg(F.max_by("kind", F.struct((F.col("kind") == "this_work").alias("own"), (F.col("kind") != "concept").alias("real"), "n", (-F.col("first")).alias("f"))).alias("type"))
    first = lambda c: F.min_by(c, F.when(F.coalesce(c, F.lit("")) != "", F.col("mention_no")))
    rest = mentions.groupBy("paper_id", "cluster").agg(
        F.array_sort(F.array_distinct(F.concat(F.collect_set("name"), F.collect_set(F.when(F.col("alias") != "", F.col("alias")))))).alias("names"), first("evidence").alias("evidence"), first("description").alias("description"),
        F.array_sort(F.collect_set("section_id")).alias("sections"), F.count("*").alias("mentions"),
    )
    out = rest.join(label, ["paper_id", "cluster"]).join(vote, ["paper_id", "cluster"])
    return out.select("paper_id", "cluster", "label", "type", F.slice(F.array_remove("names", F.col("label")), 1, 6).alias("aliases"), F.coalesce("evidence", F.lit("")).alias("evidence"), F.coalesce("description", F.lit("")).alias("description"), "sections", "mentions")


def filter_clusters(nodes: DataFrame, papers: DataFrame) -> DataFrame:
    """nodes that are the paper itself, have evidence, or a name in the paper: papers(paper_id, normal_lower). Only the others' names are looked up, all of a paper in one reading of it."""
    sure = (F.col("type") == "this_work") | (F.col("evidence") != "")
    forms = F.flatten(F.transform(F.concat(F.array("label"), F.col("aliases")), name_forms))
    told = look_up(nodes.where(~F.coalesce(sure, F.lit(False))), forms, papers, "paper_id", F.col("normal_lower"))
    said = told.where(F.exists("found", lambda f: f.isNotNull())).drop("found")
    return nodes.where(sure).join(papers.select("paper_id"), "paper_id", "left_semi").unionByName(said)


def unique_slugs(nodes: DataFrame) -> DataFrame:
    """nodes(paper_id, cluster, label) with node_id: the slug of the label, with -2, -3 and so on for the later ones of equal slugs. A name that another's number would take is numbered over again."""
    ids = _made_once(nodes, {"__s": "label"}, slug)
    nth = F.row_number().over(Window.partitionBy("paper_id", "__s").orderBy("cluster"))
    once = ids.withColumn("__n", nth).withColumn("node_id", F.when(F.col("__n") == 1, F.col("__s")).otherwise(F.concat("__s", F.lit("-"), "__n")))
    clash = F.row_number().over(Window.partitionBy("paper_id", "node_id").orderBy("__n", "cluster"))
    return once.withColumn("__c", clash).withColumn("node_id", F.when(F.col("__c") == 1, F.col("node_id")).otherwise(F.concat("node_id", F.lit("-"), F.col("__c")))).drop("__s", "__n", "__c")


def resolve_edges(relations: DataFrame, mentions: DataFrame) -> DataFrame:
    """(paper_id, source, target, relation, description, section_id, relation_no) with both ends looked up by alias key in mentions that have cluster; unknown ends and loops go. Of several keys the smallest counts."""
    keys = _made_once(mentions.select("paper_id", "cluster", "name"), {"keys": "name"}, alias_keys).select("paper_id", "cluster", F.explode("keys").alias("key")).groupBy("paper_id", "key").agg(F.min("cluster").alias("cluster"))
    own = mentions.where("type = 'this_work'").groupBy("paper_id").agg(F.min("cluster").alias("cluster"))
    keys = keys.unionAll(own.select("paper_id", F.explode(F.array(*map(F.lit, CENTER_ALIASES))).alias("key"), "cluster"))
    ends = _made_once(settle(relations.select("paper_id", "relation_no", "source", "target")), {"source_keys": "source", "target_keys": "target"}, alias_keys)

    def end(name: str) -> DataFrame:
        each = ends.select("paper_id", "relation_no", F.explode(f"{name}_keys").alias("key"))
        return each.join(keys, ["paper_id", "key"]).groupBy("paper_id", "relation_no").agg(F.min_by("cluster", "key").alias(f"{name}_node"))

    both = relations.join(end("source"), ["paper_id", "relation_no"]).join(end("target"), ["paper_id", "relation_no"]).where("source_node <> target_node")
    return both.select("paper_id", F.col("source_node").alias("source"), F.col("target_node").alias("target"), relation_of(F.col("relation")).alias("relation"), "description", "section_id", "relation_no")


def rollup_edges(edges: DataFrame) -> DataFrame:
    """One row for each (paper_id, source, target, relation): first description, sections in order of their first edge, edges."""
    per = edges.groupBy("paper_id", "source", "target", "relation", "section_id").agg(F.min("relation_no").alias("first"), F.min_by("description", F.struct("relation_no", "description")).alias("said"), F.count("*").alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("first", "section_id"))), lambda s: s["section_id"])
    return per.groupBy("paper_id", "source", "target", "relation").agg(F.min_by("said", "first").alias("description"), ordered.alias("sections"), F.sum("n").alias("n"))


def add_implied_edges(edges: DataFrame, prior: DataFrame) -> DataFrame:
    """edges with those of prior(paper_id, source, target, relation) whose pair isn't linked yet in either direction; the first of a pair wins."""
    pair = lambda df: df.withColumn("__a", F.least("source", "target")).withColumn("__b", F.greatest("source", "target"))
    new = pair(prior.where("source <> target")).join(pair(edges).select("paper_id", "__a", "__b"), ["paper_id", "__a", "__b"], "left_anti")
    first = F.row_number().over(Window.partitionBy("paper_id", "__a", "__b").orderBy("prior_no"))
    return edges.select("paper_id", "source", "target", "relation").unionAll(new.withColumn("__r", first).where("__r = 1").select("paper_id", "source", "target", "relation"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(paper_id, node_id, ...) with degree over edges in both directions, 0 where there are none."""
    ends = edges.select("paper_id", F.col("source").alias("node_id")).unionAll(edges.select("paper_id", F.col("target").alias("node_id")))
    return nodes.join(ends.groupBy("paper_id", "node_id").agg(F.count("*").alias("degree")), ["paper_id", "node_id"], "left").fillna(0, ["degree"])


def prune_graph(nodes: DataFrame, edges: DataFrame, max_nodes: int = 36) -> DataFrame:
    """The nodes(paper_id, node_id, label, type, mentions) that stay: lone ones go where a paper has over 12; then the paper itself, and by twice the degree and mentions, then label."""
    many = settle(nodes.groupBy("paper_id").agg(F.count("*").alias("__n")))  # kept, so that a large paper's nodes can be split
    ranked = degrees(nodes, edges).join(many, "paper_id").where((F.col("__n") <= 12) | (F.col("degree") > 0) | (F.col("type") == "this_work"))
    order = Window.partitionBy("paper_id").orderBy(F.col("type") != "this_work", F.desc(2 * F.col("degree") + F.col("mentions")), F.lower("label"), "node_id")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_nodes).drop("__n")


def top_nodes(nodes: DataFrame, k: int = 8) -> DataFrame:
    """The k nodes of most degree beside the paper itself; nodes(paper_id, node_id, label, type, degree)."""
    order = Window.partitionBy("paper_id").orderBy(F.desc("degree"), "label", "node_id")
    return nodes.where("type <> 'this_work'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def keep_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are in nodes."""
    ids = shuffled(nodes.select("paper_id", "node_id").distinct())
    return edges.join(ids.withColumnRenamed("node_id", "source"), ["paper_id", "source"], "left_semi").join(ids.withColumnRenamed("node_id", "target"), ["paper_id", "target"], "left_semi")


def filter_graph(nodes: DataFrame, edges: DataFrame, hidden: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes whose type isn't hidden, and the edges between them."""
    shown = nodes.where(~F.col("type").isin(hidden))
    return shown, keep_edges(edges, shown)


def search_nodes(nodes: DataFrame, query: str, hidden: list[str] = ()) -> DataFrame:
    """Nodes with the query in their label or an alias, whatever the case."""
    q = query.lower()
    return nodes.where(~F.col("type").isin(list(hidden)) & (F.lower("label").contains(q) | F.exists("aliases", lambda a: F.lower(a).contains(q))))


def search_nodes_all(nodes: DataFrame, queries: DataFrame, hidden: list[str] = ()) -> DataFrame:
    """search_nodes for each of queries(query, text), by an index of runs of characters: query and the columns of nodes. Equal names are indexed once, and nodes with
    the same label and aliases are one until their queries are known, so that what is found meets the nodes in one join. It goes to the nodes, never they to it. Empty queries find nothing."""
    shown = nodes.where(~F.col("type").isin(list(hidden)))
    alike = written(shown.select(F.col("label").alias("__label"), F.col("aliases").alias("__aliases")).distinct().withColumn("__alike", F.monotonically_increasing_id()))
    every = F.concat(F.array("__label"), F.coalesce("__aliases", F.array().cast("array<string>")))
    said = alike.select("__alike", F.explode(F.array_distinct(F.transform(every, lambda n: F.lower(n)))).alias("name")).where("name is not null")
    names = written(said.select("name").distinct().withColumn("at", F.monotonically_increasing_id()))
    found = containing(queries.select(F.col("text").alias("term")), names, "at", F.col("name")).join(shuffled(names), "at").join(shuffled(said), "name").select("term", "__alike").distinct()
    told = settle(queries.select("query", F.col("text").alias("term")).join(found, "term").join(shuffled(alike), "__alike").select("query", "__label", "__aliases"))
    size = told.agg(F.coalesce(F.sum(100 + 2 * F.octet_length(F.concat_ws(" ", "__label", "__aliases")).cast("long")), F.lit(0))).first()[0]
    told = F.broadcast(told) if size <= MOST_NAMES else shuffled(told)
    return shown.join(told, F.col("label").eqNullSafe(F.col("__label")) & F.col("aliases").eqNullSafe(F.col("__aliases"))).select("query", *nodes.columns)


def neighborhood(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(node_id, other, relation, direction) for ids(paper_id, node_id): what they lead to and what leads to them."""
    out = edges.join(ids.withColumnRenamed("node_id", "source"), ["paper_id", "source"]).select("paper_id", F.col("source").alias("node_id"), F.col("target").alias("other"), "relation", F.lit("out").alias("direction"))
    back = edges.join(ids.withColumnRenamed("node_id", "target"), ["paper_id", "target"]).select("paper_id", F.col("target").alias("node_id"), F.col("source").alias("other"), "relation", F.lit("in").alias("direction"))
    return out.unionAll(back)


def check_integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(paper_id, problem, what): edge ends that aren't nodes, and node ids used twice."""
    ids = nodes.select("paper_id", "node_id").distinct()
    ends = edges.select("paper_id", F.col("source").alias("node_id")).unionAll(edges.select("paper_id", F.col("target").alias("node_id"))).distinct()
    lost = ends.join(shuffled(ids), ["paper_id", "node_id"], "left_anti").select("paper_id", F.lit("unknown end").alias("problem"), F.col("node_id").cast("string").alias("what"))
    twice = nodes.groupBy("paper_id", "node_id").agg(F.count("*").alias("n")).where("n > 1").select("paper_id", F.lit("used twice").alias("problem"), F.col("node_id").cast("string").alias("what"))
    return lost.unionAll(twice)


def build_graph(mentions: DataFrame, relations: DataFrame, papers: DataFrame, max_nodes: int = 36) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of each paper from mentions and relations: names cleaned, mentions resolved and rolled up, what the paper doesn't say dropped, edges resolved, the graph pruned."""
    cleaned = mentions.withColumn("name", clean_label(F.col("name"))).where(F.length("name") >= 2)
    resolved = stored(resolve_entities(cleaned))
    nodes = stored(unique_slugs(stored(filter_clusters(stored(rollup_entities(resolved)), papers))))
    edges = rollup_edges(resolve_edges(relations, resolved))
    id_of = nodes.select("paper_id", F.col("cluster").alias("source"), F.col("node_id").alias("source_id"))
    id_to = nodes.select("paper_id", F.col("cluster").alias("target"), F.col("node_id").alias("target_id"))
    named = edges.join(id_of, ["paper_id", "source"]).join(id_to, ["paper_id", "target"]).select("paper_id", F.col("source_id").alias("source"), F.col("target_id").alias("target"), "relation", "description", "sections")
    kept = prune_graph(nodes, named, max_nodes)
    return kept, keep_edges(named, kept)
