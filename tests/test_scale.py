"""What queries must not do where tables are large, seen on the smallest ones."""

import os
import random
import re
import time
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from scholarspark.functions import papers
from scholarspark.operators import components, graph, grounding, library, retrieval, structure, substrings
from scholarspark.plans import catalog
from scholarspark.streaming import activity

from .compare import TABLES, differences

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["j24_link_titles", "j25_check_integrity", "p10_filter_graph"])
def test_rows_are_not_broadcast_unchecked(spark, name):
    assert "BroadcastHashJoin" not in plan(catalog.QUERIES[name](spark, SMALL))


@pytest.mark.parametrize("most", [graph.MOST_NAMES, -1])
def test_nodes_are_not_broadcast(spark, tmp_path, monkeypatch, most):
    """What was found goes to the nodes by broadcast where it is small, else by shuffle; the nodes, many of few compressed bytes, never go through the driver."""
    monkeypatch.setattr(graph, "MOST_NAMES", most)
    spark.range(2000).selectExpr("'1' AS paper_id", "concat('p', id) AS node_id", "CASE WHEN id % 5 > 0 THEN concat('Ring ', id % 3) END AS label", "CASE WHEN id % 7 > 0 THEN array(concat('big', id % 2), null) END AS aliases", "'method' AS type").write.parquet(str(tmp_path / "nodes"))
    nodes = spark.read.parquet(str(tmp_path / "nodes"))
    out = graph.search_nodes_all(nodes, spark.createDataFrame([(1, "RING 2"), (2, "g1"), (3, "none")], "query int, text string"))
    assert "BuildLeft" not in plan(out) and ("BuildRight" in plan(out)) == (most > 0)
    want = [(1, f"p{i}") for i in range(2000) if i % 5 and i % 3 == 2] + [(2, f"p{i}") for i in range(2000) if i % 7 and i % 2]
    assert sorted((r.query, r.node_id) for r in out.collect()) == sorted(want)


def beside(tmp_path, name, rows):
    """A folder with the smallest tables, one of them replaced by rows."""
    rows.write.parquet(str(tmp_path / "own"))
    for t in TABLES:
        os.symlink(f"{SMALL}/{t}.parquet" if t != name else next((tmp_path / "own").glob("*.parquet")), tmp_path / f"{t}.parquet")
    return str(tmp_path)


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


def test_merge_split_headings_uses_a_line_once(spark):
    lines = [(1, i, 0, t, z, 12.0 * i) for i, (t, z) in enumerate([("A", 10.0), ("3", 12.0), ("Method", 10.0), ("1", 10.0), ("2", 10.0), ("3", 10.0), ("End", 14.0), ("4\r", 10.0), ("x", 10.0)])]
    got = structure.merge_split_headings(spark.createDataFrame(lines, "paper_id int, line_no int, page int, text string, size double, y0 double"))
    assert [(r.line_no, r.text, r.size) for r in got.orderBy("line_no").collect()] == [(0, "A 3", 12.0), (2, "Method", 10.0), (3, "1 2", 10.0), (5, "3 End", 14.0), (7, "4\r", 10.0), (8, "x", 10.0)]


def test_merge_split_headings_equals_sql(spark, tmp_path):
    text = "\n".join("A" if i in (5, 11, 12, 14, 40, 46) else "4\r" if i == 15 else f"line {i}" for i in range(60))
    d = beside(tmp_path, "documents", documents(spark, [(1, text), (2, "A\nB"), (3, "")]))
    n, m, ours, theirs, same = differences(spark, catalog.QUERIES["w2_merge_split_headings"], catalog.ORACLES["w2_merge_split_headings"], d)
    assert same, (n, m, ours, theirs)


def test_filter_clusters_equals_sql(spark, tmp_path):
    texts = ["Straße am Ort.", "Straße am Ort.", "well-\nknown facts", "“Quoted” (abc) text", "(Abc) said", "Größen-\n form", "", " \tIndent", "naïve Übung", "zzqxjw there", "a(bcd)e is", "Zzqxjv it is", "soft\u00adly"]
    d = beside(tmp_path, "documents", documents(spark, [(k, t) for i, t in enumerate(texts) for k in range(i * 36, i * 36 + 36)]))
    n, m, ours, theirs, same = differences(spark, catalog.QUERIES["e4_filter_clusters"], catalog.ORACLES["e4_filter_clusters"], d)
    assert same, (n, m, ours, theirs)


def test_graph_facts_reads_alike_questions_once(spark, monkeypatch):
    read, of = [], retrieval.containing

    def counted(terms, rows, *rest):
        read.append((terms.count(), rows.count()))
        return of(terms, rows, *rest)

    monkeypatch.setattr(retrieval, "containing", counted)
    asked = [("p", i, "What of Alpha?", None) for i in range(40)] + [("p", 90, "What of nothing?", None), ("p", 91, "What of nothing?", "n2"), ("r", 92, "What of Alpha?", None)]
    nodes = [("p", f"n{i}", "Alpha" if i < 2 else "Beta", "method", "said" if i == 2 else "", ["alpha", "of"]) if i < 2 else ("p", f"n{i}", "Beta", "method", "said" if i == 2 else "", None) for i in range(5)]
    edges = [("p", 1, "n0", "n1", "a", "x"), ("p", 1, "n0", "n1", "a", "x"), ("p", 2, "n2", "n1", "b", ""), ("p", 3, "n2", "n3", "c", None)]
    got = retrieval.graph_facts(
        spark.createDataFrame(asked, "paper_id string, query int, question string, node string"), spark.createDataFrame(nodes, "paper_id string, node_id string, label string, type string, description string, aliases array<string>"),
        spark.createDataFrame(edges, "paper_id string, edge_no int, source string, target string, relation string, description string"), 2,
    )
    rows = {}
    for r in got.collect():
        rows.setdefault(r.query, []).append((r.fact_no, r.fact))
    about = [(1, "Alpha --a--> Alpha: x"), (2, "Beta --b--> Alpha")]
    assert all(sorted(rows[i]) == about for i in range(40)) and 92 not in rows
    assert sorted(rows[91]) == [(1, "Beta --b--> Alpha"), (2, "Beta --c--> Beta"), (3, "Beta (method): said")]
    assert [n for n, _ in sorted(rows[90])] == [1, 2] and read == [(2, 2)]


class _State:
    """A state store that counts how often a list is read and a timer set."""

    def __init__(self):
        self.reads, self.timers, self.held, self.wm = 0, [], [], 0

    def getValueState(self, name, schema):
        kept = []
        return SimpleNamespace(exists=lambda: bool(kept), get=lambda: kept[0], update=lambda v: kept.__setitem__(slice(None), [v]), clear=kept.clear)

    def getListState(self, name, schema):
        def get():
            self.reads += 1
            return list(self.held)

        return SimpleNamespace(exists=lambda: bool(self.held), get=get, appendList=self.held.extend, put=lambda v: self.held.__setitem__(slice(None), v), clear=self.held.clear)

    def registerTimer(self, ms):
        self.timers.append(ms)

    def getCurrentWatermarkInMs(self):
        return self.wm


def test_moves_read_what_waits_once(spark):
    store, moves = _State(), activity._Moves(("a",), ("b",), True, None)
    moves.init(store)
    rows = [SimpleNamespace(us=1000 * n, ordinal=n, state="ab"[n % 2]) for n in range(400)]
    assert not [r for batch in (rows[200:], rows[:200]) for r in moves.handleInputRows(("r",), batch, store)]
    found = []
    for store.wm in (99, 1000):
        while due := sorted({t for t in store.timers if t <= store.wm}):
            store.timers = [t for t in store.timers if t > store.wm]
            for t in due:
                found += moves.handleExpiredTimer(("r",), store, SimpleNamespace(getExpiryTimeInMs=lambda: t))
    assert [r.ordinal for r in found] == list(range(1, 400, 2)) and store.reads < 5


def test_attribution_sends_a_value_out_few_times(spark):
    form = F.explode(F.array_distinct(F.transform(grounding.number_forms(F.col("v")), grounding._without_zeros)))
    keys = spark.createDataFrame([("5",), ("0.50",), ("1,200%",)], "v string").select("v", form.alias("key"))
    assert {(r.v, r.key) for r in keys.collect()} == {("5", "5"), ("5", "500"), ("5", ".05"), ("0.50", ".5"), ("0.50", "50"), ("0.50", ".005"), ("1,200%", "1200"), ("1,200%", "120000"), ("1,200%", "12")}


def test_label_numbers_reads_runs_once(spark):
    form, rng = r"([A-Za-z][A-Za-z\-]+(?: [A-Za-z][A-Za-z\-]+)?)[^\d\n]{0,12}?(\d{1,3}\.\d{1,2})", random.Random(5)
    texts = ["".join(rng.choice(["a", "Bc", "-", " ", " ", ".", "\n", "1", "4.2", "12.345", "é", "x" * 13]) for _ in range(40)) for _ in range(3000)]

    def first(text):
        found = {}
        for label, value in re.findall(form, text, re.ASCII):
            found.setdefault(label.lower(), (label[:24], float(value)))
        return list(found.values())[:6]

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", papers.label_numbers(F.col("t")).alias("got")).collect()
    assert all([tuple(p) for p in r.got] == first(texts[r.i]) for r in rows) and any(len(r.got) == 6 for r in rows)
    began = time.time()
    long = ["x" * 60000 + " " * 20 + "fit 4.2", "a-" * 30000 + "!" * 20, "-" * 60000, ("y" * 20000 + " ") * 3 + "!" * 20]
    got = spark.createDataFrame([(t,) for t in long], "t string").select(papers.label_numbers(F.col("t")).alias("got")).collect()
    assert [[tuple(p) for p in r.got] for r in got] == [[("fit", 4.2)], [], [], []] and time.time() - began < 20


def test_papers_of_few_mentions_take_no_rounds(spark, monkeypatch):
    rng = random.Random(7)
    pairs = [(f"p{rng.randrange(9)}", rng.randrange(-9, 40), f"k{rng.randrange(40)}") for _ in range(250)] + [("path", i, f"k{i + j}") for i in range(300) for j in (0, 1)]
    schema = "paper_id string, node long, key string"
    want = {}
    for p, n, _ in pairs:
        want[p, n] = n
    while True:
        least = {}
        for p, n, k in pairs:
            least[p, k] = min(least.get((p, k), n), want[p, n])
        now = dict(want)
        for p, n, k in pairs:
            now[p, n] = min(now[p, n], least[p, k])
        if now == want:
            break
        want = now
    rows = spark.createDataFrame([*pairs, *pairs[:50]], schema).repartition(3)
    labels = lambda df: sorted(map(tuple, graph.connected(df).collect()))
    same = sorted((p, n, label) for (p, n), label in want.items())
    with monkeypatch.context() as m:
        m.setattr(graph, "components", None)
        assert labels(rows) == same
    found = []
    for at in (1, 50):
        monkeypatch.setattr(components, "TOGETHER", at)
        batches = [b for i in range(0, len(pairs), 37) for b in pa.Table.from_pylist([dict(zip(("paper_id", "node", "key"), x)) for x in sorted(pairs)[i : i + 37]]).to_batches()]
        found.append(sorted((r["paper_id"], r["node"], r["label"]) for b in components._within(batches) for r in b.to_pylist()))
    assert found == [same, same]
    # Papers apart: one too large, one with nulls.
    monkeypatch.setattr(graph, "MOST_PAIRS", 3)
    mixed = [("a", i, "k") for i in range(5, 9)] + [("b", 2, "k"), ("b", 1, "k"), ("c", 4, None), ("c", 5, "x"), ("c", 3, "x")]
    assert labels(spark.createDataFrame(mixed, schema)) == [("a", i, 5) for i in range(5, 9)] + [("b", 1, 1), ("b", 2, 1), ("c", 3, 3), ("c", 4, 4), ("c", 5, 3)]


def test_few_terms_meet_texts_without_an_index(spark, monkeypatch):
    """Few terms are read for in each text, once; many go by the index, with the same rows, and a page's first labels come of all that were found."""
    rnd = random.Random(7)
    words = ["ab", "Abc", "abcd", "É", "bcda", "a", "İx", "xyzzy", "dab"]
    texts = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 6))) if i % 17 else None) for i in range(300)]
    rows = spark.createDataFrame(texts, "id int, text string")
    terms = spark.createDataFrame([(t,) for t in [*words, "cd ", "d a", "zzq", "", None, "ABC", "abc"]], "term string")
    queries = spark.createDataFrame([(i, rnd.choices([*words, "cd a"], k=rnd.randint(0, 3))) for i in range(60)] + [(None, ["a"]), (90, None), (91, ["a", ""]), (92, [None, "a"]), (1, ["ab"])], "query int, terms array<string>")
    pages = spark.createDataFrame([(i, f"P{i} abc" if i else None) for i in range(4)], "page int, meta string")
    concepts = spark.createDataFrame([(i % 5, f"l{i % 90:02}" if i % 11 else None, t) for i, t in texts], "page int, label string, text string")
    asked = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate([["ab"], ["A", "ab"], ["abc", "xyzzy"], ["p1"], [], ["None"]])], "query int, text string")

    def found():
        several = library.search_library_all(pages, concepts, asked, 5).collect()
        return (
            sorted((str(r.term), r.id) for r in substrings.containing(terms, rows, "id", F.col("text")).collect()),
            sorted((r.query, r.id) for r in substrings.having_all(queries, rows, "id", F.col("text")).collect()),
            sorted((r.query, r.page, r.in_meta, r.n_matched, str(r.matched)) for r in several),
        )

    with monkeypatch.context() as m:
        m.setattr(substrings, "MOST_ASKED", -1)
        by_index = found()
    monkeypatch.setattr(substrings, "gram_index", None)
    monkeypatch.setattr(substrings, "TOGETHER", 3)
    few = found()
    assert few == by_index and all(few)
    for q, p, in_meta, n, matched in few[2]:
        ts = asked.collect()[q].text.lower().split()
        want = sorted({c.label for c in concepts.collect() if c.page == p and c.label and c.text is not None and all(t in c.text.lower() for t in ts)})
        assert matched in (str(want[:5]), "None") and n == len(want[:5])


def test_filter_of_keys_loses_none(spark, monkeypatch):
    from scholarspark import shared

    for bits in (64, 1 << 25):
        monkeypatch.setattr(shared, "FILTER_BITS", bits)
        rows = spark.range(2000).selectExpr("id AS a", "cast(id % 7 AS string) AS b")
        keys = spark.range(50).selectExpr("id * 37 AS a", "cast(id * 37 % 7 AS string) AS b")
        met = {r.a for r in shared.may_be_in(rows, keys, ["a", "b"]).collect()}
        assert {i * 37 for i in range(50)} <= met and (bits == 64 or len(met) < 60)
    small, large = (shared.sent(df)._jdf.queryExecution().logical().toString() for df in (keys, spark.range(1 << 18)))
    assert "broadcast" in small and "merge" in large


def test_graph_facts_sorts_no_edge_that_none_asks_for(spark, monkeypatch):
    """Only the edges of named nodes are shuffled; those of a paper only where a question names no node. Equal edges count once, and a question keeps the first of all its nodes."""
    rnd = random.Random(5)
    n = [("1", f"n{i}", f"Node {i:03}", "method", "", [f"alias{i % 3}"] if i % 4 else None) for i in range(120)]
    nodes = spark.createDataFrame(n, "paper_id string, node_id string, label string, type string, description string, aliases array<string>")
    e = [("1", rnd.randrange(200), f"n{rnd.randrange(120)}", f"n{rnd.randrange(120)}", "uses", "x" if i % 2 else None) for i in range(600)]
    edges = spark.createDataFrame(e + e[:50], "paper_id string, edge_no long, source string, target string, relation string, description string")
    asked = [("1", 1, "Of node 005 and node 007?", None), ("1", 2, "alias1", None), ("1", 3, "who", "n9"), ("1", 4, "who", None)]
    questions = spark.createDataFrame(asked, "paper_id string, query int, question string, node string")
    label, first = {x[1]: x[2] for x in n}, lambda es: sorted(es, key=lambda x: (x[1], x[2], x[3], x[4], x[5] is not None, x[5] or ""))[:14]

    def facts(q, es):
        return {(q, k + 1, f"{label[x[2]]} --uses--> {label[x[3]]}" + (": x" if x[5] else "")) for k, x in enumerate(first(es))}

    want = set()
    for q, ids in {1: {"n5", "n7"}, 2: {x[1] for x in n if x[5] == ["alias1"]}, 3: {"n9"}}.items():
        want |= facts(q, {x for x in e if x[2] in ids or x[3] in ids})
    assert {tuple(r) for r in retrieval.graph_facts(questions, nodes, edges).collect()} == want | facts(4, e + e[:50])
    sent = []
    monkeypatch.setattr(retrieval, "may_be_in", lambda rows, keys, by, real=retrieval.may_be_in: sent.append(real(rows, keys, by).count()) or real(rows, keys, by))
    assert {tuple(r) for r in retrieval.graph_facts(questions.where("query in (1, 3)"), nodes, edges).collect()} == {w for w in want if w[0] != 2}
    assert sent[0] < 100


def test_context_hits_need_no_score_of_every_document(spark, monkeypatch):
    """Of a task's scores only the best of a query and of its sections go on; the hits are those of all scores, equal ones by doc."""
    rnd = random.Random(11)
    texts = [" ".join(rnd.choices(["cat", "dog", "emu", "fox", "gnu", "hen", "ibis"], k=rnd.randint(0, 9))) for _ in range(400)] + ["yak yak", "", None]
    docs = spark.createDataFrame([(1000 - i, t, f"s{i % 9}" if i % 10 else None) for i, t in enumerate(texts)], "doc_id long, text string, section string").repartition(3)
    queries = spark.createDataFrame([(1, "cat dog cat"), (2, "emu"), (3, "zebu"), (4, "yak hen"), (5, None), (6, "fox gnu ibis hen"), (7, "yak")], "item_id long, text string")
    asked = spark.createDataFrame([(1, "s1"), (2, "s2"), (3, "s3"), (4, "none"), (4, "s4"), (5, "s5"), (6, None), (7, "s8"), (8, "s1")], "query long, section string")
    chunks = docs.select(F.col("doc_id").alias("doc"), "section")
    every = retrieval.bm25_score(queries, retrieval.bm25_index(docs))
    hits = lambda scores: sorted(tuple(r) for r in retrieval.context_hits(scores, chunks, asked, 4).collect())
    want, top = hits(every), sorted(tuple(r) for r in retrieval.bm25_top(every, 4).collect())
    monkeypatch.setattr(retrieval, "TOKENS", 200)
    few = retrieval.bm25_leading(queries, docs, 4, asked)
    scores, plain, where, at_home = {(r.query, r.doc): r.score for r in every.collect()}, [], docs.collect(), {tuple(a) for a in asked.collect()}
    for q in range(1, 9):
        first = [d for _, d in sorted((-x, d) for (at, d), x in scores.items() if at == q)][:4]
        local = [r.doc_id for r in where if r.section and (q, r.section) in at_home]
        if local and not set(first) & set(local):
            first = [min(local, key=lambda d: (-scores.get((q, d), 0), d)), *first][:4]
        plain += [(q, d, i + 1) for i, d in enumerate(first)]
    assert hits(few) == want == sorted(plain)
    assert {tuple(r) for r in few.collect()} <= {tuple(r) for r in every.collect()} and every.count() > 600 > 200 > few.count()
    assert sorted(tuple(r) for r in retrieval.bm25_top(retrieval.bm25_leading(queries, docs, 4), 4).collect()) == top
    monkeypatch.setattr(retrieval, "MOST_TERMS", 0)
    assert hits(retrieval.bm25_leading(queries, docs, 4, asked)) == want
    assert retrieval.bm25_leading(queries.where("item_id = 5"), docs, 4).count() == 0
    monkeypatch.setattr(retrieval, "MOST_TERMS", 9)
    assert retrieval.bm25_leading(queries.where("item_id = 5"), docs.limit(0), 4, asked).count() == 0 == retrieval.bm25_leading(queries.where("item_id = 2"), docs.limit(0), 4, asked).count()


def test_numbers_that_differ_by_zeros_meet_under_one_key(spark):
    """All forms of a number have the same digits, so it goes out once; forms of a phrase are made after rows are shuffled."""
    from scholarspark.operators.lookup import look_up

    v = spark.createDataFrame([("5",), ("0.50",), ("1,200%",), ("007.070",), ("100",), (".05",)], "v string")
    keys = v.select("v", F.array_distinct(F.transform(grounding.number_forms(F.col("v")), grounding._digits)).alias("k"))
    assert {r.v: r.k for r in keys.collect()} == {"5": ["5"], "0.50": ["5"], "1,200%": ["12"], "007.070": ["707"], "100": ["1"], ".05": ["5"]}
    rows = spark.createDataFrame([(1, "a", "x"), (1, "b", None), (2, "c", "y"), (None, "d", "x"), (3, "e", None)], "k int, id string, w string")
    texts = spark.createDataFrame([(1, "an x and xx"), (2, "none"), (3, "x")], "k int, text string")
    out = look_up(rows, F.when(F.col("w").isNotNull(), F.array("w", F.concat("w", "w"))), texts, "k", F.col("text"))
    before, after = plan(out).split("REPARTITION_BY_COL")  # the plan is printed from its end
    assert "__forms" in before and "__forms" not in after
    assert {(r.id, tuple(r.found)) for r in out.collect()} == {("a", ("x", "xx")), ("c", (None, None))}


def test_stored_tables_are_compressed_and_not_broadcast(spark, monkeypatch):
    """Names that repeat take little room in the shared folder, and the small files they make don't pass for a small table; pairs of a graph are kept so."""
    from scholarspark.shared import stored

    df = stored(spark.range(100000).selectExpr("id", "concat('A long name of a part that many orders have ', id % 9) AS name"))
    assert "Broadcast" not in plan(df.where("id > 5").select("name").join(df.select("name", "id"), "name"))
    kept = []
    monkeypatch.setattr(graph, "stored", lambda df: kept.append(df.columns) or stored(df))
    graph.connected(spark.createDataFrame([(1, 1, "a"), (1, 2, "a")], "paper_id int, node int, key string")).collect()
    assert kept == [["paper_id", "node", "key"]]
