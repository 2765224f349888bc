"""Operators against fixtures, and the registered queries against DuckDB on the smallest tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from scholarspark.functions import text as T
from scholarspark.operators import assessment, chunks, enrich, graph, grounding, library, structure
from scholarspark.operators import quotes as quotes_of
from scholarspark.plans import catalog
from scholarspark.sources import io
from scholarspark.streaming import activity

from .compare import differences

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    n, m, ours, theirs, same = differences(spark, catalog.QUERIES[name], catalog.ORACLES[name], SMALL)
    assert same, (n, m, ours, theirs)


def col(spark, f, values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(f(F.col("v"))).collect()]


def test_labels(spark):
    assert col(spark, T.clean_label, [r"$\pi_0$-FAST", r"$\pi_{0.5}$", "ConvS2S [9]", "Luong et al. (2015)", None]) == ["π0-FAST", "π0.5", "ConvS2S", "Luong et al.", ""]
    assert col(spark, T.canon, [r"$\pi_0$-FAST", "π0-FAST"]) == ["pi0 fast", "pi0 fast"]
    a, b, c, d = col(spark, T.alias_keys, ["WMT 2014 En-De dataset", "WMT 2014 En-De translation task", "English-to-French", "English-French"])
    assert set(a) & set(b) and set(c) & set(d)


def test_numbers(spark):
    assert col(spark, T.parse_number, ["28.4", "28.4%", "1,024", "3.3e18", "3.3 × 10^18", r"$3.3 \cdot 10^{18}$", "n/a", "-", ""]) == [28.4, 28.4, 1024.0, 3.3e18, 3.3e18, 3.3e18, None, None, None]
    forms = col(spark, grounding.number_forms, ["0.853", "1024", "0"])
    assert {"0.853", ".853", "85.3"} <= set(forms[0]) and "1024" in forms[1] and "0" not in forms[2]
    numbers = spark.createDataFrame([(1, 1, "0.853"), (2, 1, "41"), (3, 1, "3.3e18"), (4, 1, "7.7"), (5, 2, "3.3e18"), (6, 1, "1024"), (7, 1, "9.9")], "number_id int, source_id int, value string")
    texts = spark.createDataFrame([(1, "It is 85.3 and 41.2%, 3.3 · 10^18 and 1,024 of 19.95"), (2, "flat 3.3 · 1018 here")], "source_id int, text string")
    assert sorted(r.number_id for r in grounding.ground_numbers(numbers, texts).collect()) == [1, 2, 3, 5, 6]


def test_choices(spark):
    assert col(spark, lambda c: T.choose(c, ["method", "results", "other"], "other"), ["methods", "result", "x", None]) == ["method", "results", "other", "other"]
    assert col(spark, T.option_index, ["C", "c)", "(C)", "Option C", "C: x", "Cat", ""]) == [2, 2, 2, 2, 2, -1, -1]
    assert col(spark, lambda c: T.cited_sections(c, F.array(F.lit("s2"), F.lit("s3"), F.lit("s5"))), ["a [s3] b [s2, s5] [s9]"]) == [["s3", "s2", "s5"]]
    assert col(spark, T.nfkc, ["ﬁne"]) == ["fine"]
    assert col(spark, T.plain_runs, ["one two three four $x$ a b [1] five six seven eight nine"]) == [["five six seven eight nine", "one two three four"]]


def test_quotes(spark):
    sources = spark.createDataFrame([(1, "We show that the model is better than\nall the others we have tried before."), (2, "Nothing of the kind.")], "source_id int, text string")
    quotes = spark.createDataFrame([(1, "“the model is better than all the others”"), (2, "the model is  bettr than all the others we have"), (3, "a paraphrase of how good the model is")], "quote_id int, quote string")
    got = {(r.quote_id, r.source_id): r.found for r in grounding.fuzzy_match_quotes(quotes, sources).collect()}
    assert set(got) == {(1, 1), (2, 1)} and got[1, 1] == "the model is better than all the others"
    exact = grounding.match_quotes(quotes.withColumn("source_id", F.lit(1)), sources).collect()
    assert [r.quote_id for r in exact] == [1]


def test_attribution(spark):
    values = spark.createDataFrame([(1, 1, "Base model", "28.4"), (2, 1, "Base model", "41.0"), (3, 1, "BLEU", "41.0"), (4, 1, "Big net", "77")], "value_id int, source_id int, label string, value string")
    cells = spark.createDataFrame([(1, 1, 0, 1, True, "BLEU"), (1, 1, 1, 0, False, "Base model"), (1, 1, 1, 1, False, "28.4"), (1, 1, 2, 0, False, "Large"), (1, 1, 2, 1, False, "41.0")], "source_id int, number int, row_no int, col_no int, is_header boolean, text string")
    texts = spark.createDataFrame([(1, "The big net reached 77 points." + " x" * 300)], "source_id int, text string")
    assert sorted(r.value_id for r in grounding.ground_attribution(values, cells, texts).collect()) == [1, 3, 4]


def test_split_text(spark):
    text = "\n\n".join(["a" * 30, "b" * 50, "First sentence here. " * 12, "", "c" * 250, "end"])
    parts = col(spark, lambda c: chunks.split_text(c, 100), [text, "short", ""])
    assert all(len(p) <= 100 for p in parts[0]) and "".join("".join(parts[0]).split()) == "".join(text.split()) and parts[1:] == [["short"], [""]]
    assert parts[0][0] == "a" * 30 + "\n\n" + "b" * 50


def test_headings(spark):
    heads = [(1, 0, "1 Introduction", 1), (1, 1, "73.7 MultiNLI", 1), (1, 2, "2 Method", 1), (1, 3, "2.1 Parts", 2), (1, 4, "A Notes", 1), (1, 5, "3 Results", 1), (1, 6, "References", 1), (1, 7, "A Proofs", 1)]
    kept = structure.sane_numbering(spark.createDataFrame(heads, "paper_id int, line_no int, heading string, level int"))
    assert sorted(r.line_no for r in kept.collect()) == [0, 2, 3, 5, 6, 7]
    lines = [(1, 0, 0, "3", 12.0, False, 0.0), (1, 1, 0, "Method", 12.0, False, 14.0), (1, 2, 0, "Body text here, as it is.", 10.0, False, 30.0), (1, 3, 0, "CONCLUSION", 10.0, False, 50.0)]
    merged = structure.merge_split_headings(spark.createDataFrame(lines, "paper_id int, line_no int, page int, text string, size double, bold boolean, y0 double"))
    found = structure.heading_candidates(merged.withColumn("body", F.lit(10.0)).withColumn("alone", F.lit(False))).orderBy("line_no").collect()
    assert [(r.heading, r.level) for r in found] == [("3 Method", 1), ("CONCLUSION", 1)]


def test_drop_similar_keeps_first(spark):
    rows = [(r.p_partkey, f"{r.p_name} {r.p_type.lower()} size{r.p_size % 5} word{r.p_partkey % 7}", "") for r in spark.read.parquet(f"{SMALL}/part.parquet").collect()]
    import re

    words = {i: {w for w in re.findall("[a-z0-9]{4,}", q.lower()) if w not in T.QUESTION_STOP} for i, q, _ in rows}
    kept = []
    for i, _, _ in sorted(rows):
        if not any(len(words[i] & words[j]) / (len(words[i] | words[j]) or 1) >= 0.6 for j in kept):
            kept.append(i)
    got = assessment.drop_similar(spark.createDataFrame(rows, "id long, question string, correct string"))
    assert sorted(r.id for r in got.collect()) == kept and len(kept) < len(rows)


def test_drop_similar_by_answers(spark):
    """Half the overlap is enough if the answers overlap; against the same rule one by one."""
    import random
    import re

    rnd = random.Random(1)
    vocabulary = [f"word{i}" for i in range(14)]
    rows = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 7))), " ".join(rnd.choices(vocabulary[:4], k=rnd.randint(0, 4))) if i % 5 else None) for i in range(250)]
    words = lambda x: {w for w in re.findall("[a-z0-9]{4,}", (x or "").lower()) if w not in T.QUESTION_STOP}
    over = lambda a, b: len(a & b) / (len(a | b) or 1)
    sets, kept = {i: (words(q), words(a)) for i, q, a in rows}, []
    for i, (q, a) in sets.items():
        if not any(over(q, sets[j][0]) >= 0.6 or (over(q, sets[j][0]) >= 0.3 and over(a, sets[j][1]) >= 0.6) for j in kept):
            kept.append(i)
    for group in (256, 3):
        got = assessment.drop_similar(spark.createDataFrame(rows, "id long, question string, correct string"), group=group)
        assert sorted(r.id for r in got.collect()) == kept and len(kept) < len(rows)


def test_drop_similar_families(spark, monkeypatch):
    """A family of 20,000 alike questions makes about as many links, and not their square."""
    family = [(i, f"which planet circles around star number{i % 3} name{i}xxxx the fastest when seen from afar", "") for i in range(20_000)]
    others = [(30_000 + i, f"other{i}aaaa subject{i}bbbb matter{i}cccc", "") for i in range(100)]
    pairs = []
    real = assessment._pairs
    monkeypatch.setattr(assessment, "_pairs", lambda x, y, share: pairs.append(real(x, y, share)) or pairs[-1])
    got = assessment.drop_similar(spark.createDataFrame(family + others, "id long, question string, correct string").repartition(4), group=32)
    kept = sorted(r.id for r in got.collect())
    assert kept == [0, *range(30_000, 30_100)]
    assert sum(p.count() for p in pairs) < 60_000


def test_balanced_answers(spark):
    q = spark.createDataFrame([(1, f"q{i}", ["a", "b", "c", "d"], i % 4) for i in range(11)], "paper int, question string, options array<string>, answer int")
    got = assessment.balance_answers(q).collect()
    counts = [sum(r.answer == s for r in got) for s in range(4)]
    assert max(counts) - min(counts) <= 1 and all(r.options[r.answer] == "abcd"[int(r.question[1:]) % 4] and sorted(r.options) == list("abcd") for r in got)


def test_entities(spark):
    names = ["Transformer Net model", "the Transformer Nets", "BERT (Bidirectional Encoder)", "bidirectional encoder", "our method", "We", "GPT-2"]
    rows = [(1, i, n, "", "model", "", "", "s1") for i, n in enumerate(names)]
    got = {r.mention_no: r.cluster for r in graph.resolve_entities(spark.createDataFrame(rows, "paper_id int, mention_no long, name string, alias string, type string, description string, evidence string, section_id string")).collect()}
    assert got[0] == got[1] and got[2] == got[3] and got[4] == got[5] and len(set(got.values())) == 4


def test_enrich_asks_once(spark):
    calls = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "request string")
    store = enrich.request_keys(spark.createDataFrame([("c", "old")], "request string, reply string"), "p").select("request_key", "reply")
    done, new = enrich.enrich(calls, store, "p", enrich.reverse_provider)
    assert sorted((r.request, r.reply) for r in done.collect()) == [("a", "a"), ("a", "a"), ("b", "b"), ("c", "old")] and new.count() == 2


def test_activity_streams(spark, tmp_path):
    rows = [{"page": f"p{i % 3}", "kind": "quiz", "at": f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", "correct": i % 5, "total": 5} for i in range(90)]
    rows += [{"page": "p1", "kind": "progress", "at": "2024-01-02 00:00:01", "read": ["s1"]}, {"page": "p1", "kind": "progress", "at": "2024-01-03 00:00:01", "read": ["s1", "s2"]}, {"page": "", "kind": "quiz"}, {"page": "p9", "kind": "quiz", "at": "2024-01-01 00:00:00", "correct": 9, "total": 5}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(json.dumps(r) for r in rows[:50]))
    (tmp_path / "in" / "b.txt").write_text("\n".join(json.dumps(r) for r in rows[50:]) + "\nnot json")
    raw = spark.readStream.text(str(tmp_path / "in"), wholetext=False)
    valid, bad = activity.parse_activity(raw)

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    assert run(bad, "bad", "append").count() == 3
    newest = run(activity.attempts_stream(valid, 10), "attempts", "update").where("page = 'p2'").orderBy(F.desc("at")).limit(1).collect()
    assert str(newest[0]["at"]) == "2024-01-01 00:01:29"
    assert [r.read for r in run(activity.progress_stream(valid), "progress", "update").orderBy(F.desc("at")).limit(1).collect()] == [["s1", "s2"]]
    status = spark.createDataFrame([("r1", 1, "running"), ("r1", 2, "done"), ("r2", 1, "queued"), ("r2", 2, "failed"), ("r3", 1, "running"), ("r3", 2, "running"), ("r3", 3, "failed")], "run string, ordinal long, state string")
    status.write.parquet(str(tmp_path / "status"))
    live = spark.readStream.schema(status.schema).parquet(str(tmp_path / "status"))
    got = run(activity.transition_stream(live), "moves", "append").collect()
    want = library.transitions(status).collect()
    assert sorted((r.run, r.ordinal, r.state) for r in got) == sorted((r.run, r.ordinal, r.state) for r in want) == [("r1", 2, "done"), ("r3", 3, "failed")]


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "w" / "page-1").mkdir(parents=True)
    (tmp_path / "w" / "page-1" / "experience.json").write_text(json.dumps({"paper": {"id": "x", "title": "T"}, "sections": [{"id": "s1"}], "graph": {"nodes": [{"id": "a"}, {"id": "b"}]}}, indent=1))
    (tmp_path / "w" / ".hidden").mkdir()
    (tmp_path / "w" / "bad").mkdir()
    (tmp_path / "w" / "bad" / "experience.json").write_text("{")
    got = {r.page: (r.title, r.n_sections, r.n_nodes) for r in io.read_artifacts(spark, str(tmp_path / "w")).collect()}
    assert got == {"page-1": ("T", 1, 2), "bad": (None, 0, 0)}
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "r1.log").write_text("10:00:01 INFO parse: a\n10:00:02 DEBUG x: y\nnoise\n10:00:03 WARNING quiz: b c")
    assert [(r.run, r.level, r.stage, r.message) for r in io.read_run_logs(spark, str(tmp_path / "logs"), 1).collect()] == [("r1", "WARNING", "quiz", "b c")]
    (tmp_path / "status.json").write_text(json.dumps({"run": "r", "state": "done", "usage": [{"model": "m", "calls": 3}]}))
    assert [(r.run, r.model, r.calls) for r in io.read_usage(spark, str(tmp_path / "status.json")).collect()] == [("r", "m", 3)]
    assert {(r.kind, r.bytes > 0) for r in io.read_cache_files(spark, str(tmp_path / "w")).collect()} >= {("page-1", True), ("bad", True)}
    (tmp_path / "corpus.json").write_text(json.dumps({"paper_id": "p", "sections": [{"raw_id": "r1", "section_no": 1, "text": "t"}]}) + "\nnot json\n")
    papers, sections = io.read_corpus(spark, str(tmp_path / "corpus.json"))
    assert papers.count() == 1 and sections.select("paper_id", "raw_id", "text").collect()[0] == ("p", "r1", "t")
    df = spark.createDataFrame([("p", 1, "t")], "paper_id string, chunk_no int, text string")
    io.write_index(df, str(tmp_path / "i"))
    io.write_artifacts(df, str(tmp_path / "a"))
    io.append_responses(spark.createDataFrame([("abcd", "r")], "request_key string, reply string"), str(tmp_path / "s"))
    assert io.write_stage(df, "n", str(tmp_path)).count() == spark.read.parquet(str(tmp_path / "i")).count() == spark.read.json(str(tmp_path / "a")).count() == spark.read.parquet(str(tmp_path / "s")).count() == 1


def test_quotes_with_noise(spark, monkeypatch):
    """Every near match of plain difflib is found, also one that shares no run of three words with its source."""
    import random
    from difflib import SequenceMatcher

    rnd = random.Random(4)
    words = ["".join(rnd.choice(["th", "er", "on", "an", "re", "ing", "ti"]) for _ in range(rnd.randint(1, 4))) for _ in range(60)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(5, 300))) for _ in range(25)] + ["ab" * 300, "short", None]
    quotes = []
    for i in range(40):
        text = texts[i % 25]
        quote = list(text[(at := rnd.randrange(len(text) // 2)) : at + rnd.randint(20, 200)])
        for j in rnd.sample(range(len(quote)), len(quote) * (i % 8) // 50):
            quote[j] = rnd.choice(["", "x", quote[j] + "z"])
        quotes.append("".join(quote))
    noisy = "while measuring several distant objects their average brightness appeared noticeably smaller because clouds covered parts during every second night here".split()
    texts.append(" ".join(noisy))
    quotes += [" ".join(w[:-1] + "q" if i % 3 == 2 else w for i, w in enumerate(noisy)), "abababababababab", "ab" * 20 + "c" + "ab" * 20]

    def plain(q, low):
        if q in low:
            return low[(at := low.find(q)) : at + len(q)]
        m = SequenceMatcher(None, low, q, autojunk=False).find_longest_match()
        start = max(0, m.a - m.b)
        return low[start : start + len(q)].strip() if m.size >= 8 and SequenceMatcher(None, low[start : start + len(q) + 8], q, autojunk=False).ratio() >= 0.88 else None

    bare = [q.strip(" ") for q in quotes]
    want = {(i, j): f for i, q in enumerate(bare) if len(q) >= 12 for j, t in enumerate(texts) if t is not None and (f := plain(q, t)) is not None}
    assert (40, len(texts) - 1) in want and len(want) > 30
    tables = spark.createDataFrame(list(enumerate(quotes)), "quote_id int, quote string"), spark.createDataFrame(list(enumerate(texts)), "source_id long, text string")
    assert {(r.quote_id, r.source_id): r.found for r in grounding.fuzzy_match_quotes(*tables).collect()} == want
    rolled = {t: quotes_of._rolled(quotes_of._codes(t)) for t in [*bare, *filter(None, texts)]}
    for low in filter(None, texts):
        for q in bare:
            a, b = np.nonzero(rolled[low][:, None] == rolled[q][None, :])
            got = [x.tolist() for x in quotes_of.longest_blocks(np.zeros(len(a), np.int64), a, b)]
            m = SequenceMatcher(None, low, q, autojunk=False).find_longest_match()
            assert got == ([[0], [m.a], [m.b], [m.size]] if m.size >= 8 else [[], [], [], []])
            if m.size >= 8:
                window = low[(start := max(0, m.a - m.b)) : start + len(q) + 8]
                for least in (0.5, 0.81, 0.88, 0.95):
                    near = SequenceMatcher(None, window, q, autojunk=False).ratio() >= least
                    assert quotes_of.alike(window, q, least) == near and quotes_of.may_be_near([window], [q], least)[0] >= near
    # Pairs with many hits are compared whole; a text goes out again for many quotes.
    monkeypatch.setattr(quotes_of, "MOST_HITS", 300)
    monkeypatch.setattr(quotes_of, "MOST_ASKED", 10)
    monkeypatch.setattr(quotes_of, "MOST_BITS", 64)
    assert {(r.quote_id, r.source_id): r.found for r in grounding.fuzzy_match_quotes(*tables).collect()} == want


def test_nodes_of_equal_names_are_found_together(spark):
    """Nodes with the same names meet their queries in one join with the nodes; equal nodes and queries stay, and a node is found once by label and alias."""
    rows = [("1", "a", "Big Ring", ["ring", None]), ("1", "a", "Big Ring", ["ring", None]), ("2", "b", "ring", ["Big Ring"]), ("3", "c", None, None), ("4", "d", "Bolt", []), ("5", "e", "Ring", None)]
    nodes = spark.createDataFrame([(*r, "dataset" if r[1] == "e" else "method") for r in rows], "paper_id string, node_id string, label string, aliases array<string>, type string")
    queries = spark.createDataFrame([(1, "RING"), (1, "RING"), (2, "b"), (3, ""), (4, None), (5, "big r")], "query int, text string")
    out = graph.search_nodes_all(nodes, queries, ["dataset"])
    want = [(q, r[1]) for q, t in [(1, "ring"), (1, "ring"), (2, "b"), (5, "big r")] for r in rows if r[1] != "e" and any(t in x.lower() for x in [r[2], *(r[3] or [])] if x)]
    assert sorted((r.query, r.node_id) for r in out.collect()) == sorted(want) and out.columns == ["query", *nodes.columns]
    assert "__node" not in out._jdf.queryExecution().toString()


def test_kept_tables_need_two_rows_with_text(spark):
    """Rows are counted without a row for each distinct one; blank and null texts and a row's second cell don't make another row."""
    from scholarspark.operators import tables as B

    made = {1: [(0, 0, "1"), (0, 1, "2"), (1, 0, " ")], 2: [(0, 0, "1"), (0, 1, "2"), (3, 0, "x")], 3: [(2, 0, "1"), (2, 1, "2"), (2, 2, "3")], 4: [(0, 0, "1"), (1, 1, "2"), (2, 0, None)]}
    cells = spark.createDataFrame([("p", n, n, *c) for n, cs in made.items() for c in cs], "paper_id string, found_no int, page int, row_no int, col_no int, text string")
    out = B.keep_tables(cells, spark.createDataFrame([("p", n, n) for n in made], "paper_id string, page int, number int"))
    assert {r.found_no for r in out.collect()} == {2, 4} and out.count() == 6
    assert "Expand" not in out._jdf.queryExecution().toString()


def test_terms_are_counted_where_the_text_is_read(spark, monkeypatch):
    """Postings come of one pass over the texts, in pieces of bounded size, and aren't shuffled to be counted."""
    import collections
    import random

    import pyarrow as pa

    from scholarspark.operators import retrieval

    rnd = random.Random(2)
    toks = [[f"t{rnd.randrange(9)}" for _ in range(rnd.randint(0, 12))] for _ in range(200)] + [[], ["é"] * 3]
    monkeypatch.setattr(retrieval, "TOKENS", 40)
    batch = pa.RecordBatch.from_pydict({"doc": pa.array(range(len(toks))), "toks": pa.array(toks, pa.list_(pa.string()))})
    out = list(retrieval._counted([batch, batch.slice(0, 0), batch.slice(7, 5), batch.slice(200, 1)]))
    got = [(r["doc"], r["length"], {x["term"]: x["tf"] for x in r["terms"]}) for b in out for r in b.to_pylist()]
    assert got == [(i, len(toks[i]), dict(collections.Counter(toks[i]))) for i in [*range(len(toks)), *range(7, 12), 200]]
    assert max(sum(map(len, b.column(2).to_pylist())) for b in out) < 60 and len(out) > 20
    post, _, _ = retrieval._postings(spark.createDataFrame([(1, "a cat, a cat"), (2, None)], "doc_id long, text string"), "doc_id", "text", [], None)
    assert "Exchange" not in post._jdf.queryExecution().toString() and [tuple(r) for r in post.collect()] == [(1, 2, "cat", 2)]


def test_few_quotes_meet_texts_where_they_are_read(spark, monkeypatch):
    """Few quotes need no shuffle of what they share with texts; many do, and find the same."""
    import random

    from scholarspark.operators import quotes as quotes_of

    rnd = random.Random(8)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()] + [(-1, "ab" * 3000), (-2, None), (None, "x" * 50)]
    whole = [t for _, t in docs if t and len(t) > 150]
    quotes = [(k, "".join("q" if rnd.random() < k % 8 / 100 else c for c in rnd.choice(whole)[20:140])) for k in range(60)] + [(100, "ab" * 700), (101, None), (102, "short")]
    tables = spark.createDataFrame(quotes, "quote_id int, quote string"), spark.createDataFrame(docs, "source_id long, text string")
    few = quotes_of.fuzzy_match_quotes(*tables)
    assert few._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("MapInArrow") == 1
    got = {tuple(r) for r in few.collect()}
    assert len(got) > 60 and (100, -1) in {(r[0], r[2]) for r in got}
    monkeypatch.setattr(quotes_of, "MOST_KNOWN", 0)
    assert {tuple(r) for r in quotes_of.fuzzy_match_quotes(*tables).collect()} == got
    # A text's blocks are laid out a few quotes at a time; those with too many hits aren't.
    known, codes = quotes_of._Known([5, 6, 7], ["ab" * 20, "the quick brown fox", "zzzzzzzzzzzzzzz"]), quotes_of._codes("ab" * 50 + " the quick brown fix")
    assert sorted(zip(*(x.tolist() for x in known.blocks(codes)))) == [(0, 0, 0, 40), (1, 101, 0, 17)]
    monkeypatch.setattr(quotes_of, "MOST_HITS", 100)
    assert sorted(zip(*(x.tolist() for x in known.blocks(codes)))) == [(0, 0, 0, -1), (1, 101, 0, 17)]


def test_runs_of_three_in_place():
    """No pair that reaches the ratio is lost, and pairs that only share runs elsewhere are."""
    import random
    from difflib import SequenceMatcher

    from scholarspark.operators import quotes as quotes_of

    rnd = random.Random(9)
    words = ["the", "and", "reing", "thnd", "hean", "onti", "ouer", "shwh", "tion"]
    wants = [" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 45))) for _ in range(300)]
    windows = [w + w[:8] if i % 4 == 0 else "".join(c for c in w if rnd.random() > i % 7 / 40) + "  a tail" if i % 4 < 3 else " ".join(rnd.sample(w.split(), len(w.split()))) for i, w in enumerate(wants)]
    wants, windows = [*wants, "abcdefghijkl", "a" * 3000], [*windows, "", "a" * 3008]
    for least in (0.5, 0.88, 0.95):
        near = np.array([SequenceMatcher(None, w, q, autojunk=False).ratio() >= least for w, q in zip(windows, wants)])
        may = quotes_of.may_be_near_in_place(windows, wants, least)
        assert (may >= near).all()
    assert may.sum() < quotes_of.may_be_near(windows, wants, 0.95).sum() and not len(quotes_of.may_be_near_in_place([], [], 0.9))


def test_boilerplate_quotes(spark):
    """A quote that several sources have but for its end, which stands in another one only, is found in all of them."""
    import random

    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 9)))
    common, own = " ".join(word() for _ in range(110))[:640], " ".join(word() for _ in range(30))[:72]
    texts = [" ".join(word() for _ in range(50 * i)) + common + " ".join(word() for _ in range(300)) for i in range(5)] + [f"{word()} {own} {word()}", " ".join(word() for _ in range(500))]
    quotes = spark.createDataFrame([(1, common + own), (2, common + own), (3, None), (None, common), (4, own)], "quote_id int, quote string")
    sources = spark.createDataFrame([*enumerate(texts), (None, common), (9, None)], "source_id int, text string").repartition(3)
    got = sorted((r.quote_id, r.source_id) for r in grounding.fuzzy_match_quotes(quotes, sources).collect())
    assert got == [(q, i) for q in (1, 2) for i in range(5)] + [(4, 5)]
    assert grounding.fuzzy_match_quotes(quotes.limit(0), sources).count() == grounding.fuzzy_match_quotes(quotes, sources.limit(0)).count() == 0


def test_quotes_with_typos(spark):
    """Pieces of the small table's documents with up to a typo in every ten characters: all that the comparison of every quote with every source finds."""
    import random
    import re
    from difflib import SequenceMatcher

    rnd = random.Random(3)
    docs = [(r.doc_id, re.sub(r"\s+", " ", r.text).strip()) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    docs = [(i, t) for i, t in docs if 100 < len(t) < 4000]
    quotes = []
    for k in range(120):
        text = rnd.choice(docs)[1]
        at = rnd.randrange(len(text) - 90)
        quote = list(text[at : at + rnd.randint(60, 200)])
        for j in rnd.sample(range(len(quote)), len(quote) * (k % 10) // 100):
            quote[j] = rnd.choice(["", "q", quote[j] + "z"])
        quotes.append((k, "".join(quote).strip(" \"'")))

    def near(q, low):
        if q in low:
            return True
        if not any(q[i : i + 8] in low for i in range(len(q) - 7)):
            return False
        m = SequenceMatcher(None, low, q, autojunk=False).find_longest_match()
        start = max(0, m.a - m.b)
        window = SequenceMatcher(None, low[start : start + len(q) + 8], q, autojunk=False)
        return window.real_quick_ratio() >= 0.88 and window.quick_ratio() >= 0.88 and window.ratio() >= 0.88

    want = {(k, i) for k, q in quotes for i, t in docs if near(q.lower(), t.lower())}
    tables = spark.createDataFrame(quotes, "quote_id int, quote string"), spark.createDataFrame(docs, "source_id long, text string")
    got = {(r.quote_id, r.source_id) for r in grounding.fuzzy_match_quotes(*tables).collect()}
    assert got == want and len(want) > 100


def test_scratch_is_removed(spark, tmp_path):
    import os

    from scholarspark.shared import scratch, shared_dir, written

    outside = str(tmp_path / "kept")
    with scratch(spark) as folder:
        inner = written(spark.range(5))
        kept = written(inner.where("id > 2"), outside)
        assert os.path.isdir(folder.removeprefix("file:"))
    assert not os.path.exists(folder.removeprefix("file:")) and kept.count() == 2 and shared_dir(spark)


def test_look_up(spark, monkeypatch):
    """Every phrase where it stands first, as the text spells it; overlapping and nested phrases too; a hot key's text goes out again."""
    from scholarspark.operators import lookup

    texts = {1: "Abcabx Äé 漢字 abCAB", 2: "", 3: None, 4: "the THE tHe", 5: "unasked"}
    rows = [(1, i, f) for i, f in enumerate([["abc", "bca", "ab", "zz"], ["äé 漢"], [], None, ["", "x"], ["cab"]])]
    rows += [(2, 9, ["a"]), (3, 10, ["a"]), (None, 11, ["a"]), (8, 12, ["a"])] + [(4, 100 + i, ["the", f"t{i}"]) for i in range(40)]
    table = spark.createDataFrame(rows, "k int, n int, f array<string>").repartition(3)
    read = spark.createDataFrame(list(texts.items()), "k int, t string")
    want = {n: [next((texts[k][i : i + len(f)] for i in range(len(texts[k])) if f and texts[k].lower()[i:].startswith(f)), None) for f in fs] for k, n, fs in rows if texts.get(k) is not None and fs is not None}
    for most in (50_000, 7):
        monkeypatch.setattr(lookup, "MOST_ROWS", most)
        out = lookup.look_up(table, F.col("f"), read, "k", F.lower("t"), F.col("t"))
        assert out.columns == ["k", "n", "f", "found"]
        assert {r.n: r.found for r in out.collect()} == want


def test_names_read_a_text_once(spark):
    """As many rows with a text reach the join's other side as there are texts with names."""
    names = spark.range(3000).selectExpr("if(id % 3 = 0, 1, id % 50) AS source_id", "concat('Name ', id, ' (N', id, ')') AS name")
    texts = spark.range(60).selectExpr("id AS source_id", "concat('has Name ', id, ' and n', id + 100, '.') AS text")
    got = {(r.source_id, r.name) for r in grounding.named(names, texts).where("in_text").collect()}
    plain = {(r.source_id, r.name) for r in names.join(texts, "source_id").where(T.name_in_text(F.col("name"), F.lower(F.col("text")))).collect()}
    assert got == plain and len(got) > 50
    from scholarspark.operators import lookup

    seen = spark.sparkContext.accumulator(0)
    real = lookup._looked_up

    def counting(*given):
        inner = real(*given)

        def run(batches):
            def each():
                for b in batches:
                    seen.add(b.num_rows)
                    yield b

            yield from inner(each())

        return run

    lookup._looked_up = counting
    try:
        assert grounding.named(names, texts).count() == 3000 and seen.value == names.select("source_id").distinct().count()
    finally:
        lookup._looked_up = real


def test_pruned_search(spark):
    """The k best of scoring every posting, with ties, few documents, and blocks of any size; most postings of frequent terms aren't read."""
    import random

    from scholarspark.operators import retrieval

    rnd = random.Random(8)
    frequent, rare = [f"often{i}" for i in range(6)], [f"rare{i}" for i in range(400)]
    docs = [(i, i % 3, " ".join(rnd.choices(frequent, k=rnd.randint(0, 12)) + (rnd.choices(rare, k=3) if i % 4 else []))) for i in range(4000)]
    docs += [(5000 + i, 0, "often0 rare7") for i in range(30)]
    queries = [(i, i % 3, " ".join(rnd.sample(frequent, 3) + rnd.choices(rare, k=rnd.randint(0, 3)))) for i in range(30)] + [(90, 0, "often0 rare7 rare7"), (91, 1, "nowhere"), (92, 2, "")]
    chunks = spark.createDataFrame(docs, "doc_id int, part int, text string").repartition(4)
    asked = spark.createDataFrame(queries, "item_id int, part int, text string")
    for scope in ([], ["part"]):
        every = retrieval.bm25_score(asked, retrieval.bm25_index(chunks, scope=scope), scope=scope)
        for k, first in ((5, 2), (1, 1), (40, 1), (5000, 2)):
            want = sorted(map(tuple, retrieval.bm25_top(every, k, scope).select(*scope, "query", "doc", "score", "rank").collect()))
            got = sorted(map(tuple, retrieval.bm25_search(asked, chunks, k, scope, first=first).select(*scope, "query", "doc", "score", "rank").collect()))
            assert [(r[:-2], r[-1]) for r in got] == [(r[:-2], r[-1]) for r in want] and all(abs(a[-2] - b[-2]) < 2e-6 for a, b in zip(got, want))
    work = {r["query"]: (r.postings, r.read) for r in retrieval.search_work(asked, chunks).collect()}
    assert all(read <= n for n, read in work.values()) and sum(read for _, read in work.values()) < sum(n for n, _ in work.values())
    blocks = retrieval.bm25_blocks(chunks, block=16)
    assert blocks.agg(F.max("n")).first()[0] < 64
    assert retrieval.bm25_search(asked, chunks, blocks=blocks).count() == retrieval.bm25_search(asked, chunks).count()
    assert retrieval.bm25_search(asked, chunks.limit(0)).count() == 0


def test_substrings_of_any_length(spark):
    """Terms of one character and more, in any case, equal a scan; an index that is kept gives the same."""
    import random

    from scholarspark.operators import substrings

    rnd = random.Random(9)
    texts = ["".join(rnd.choice("abcÄé漢 ") for _ in range(rnd.randint(0, 30))) for _ in range(300)] + ["", "a", "ab", None, "x" * 100_000 + "needle", "Abc" * 5]
    terms = ["a", "AB", "abc", "bca ", "é漢", "ÄÉ漢a", "zzz", "needle", "xxxxxx", "", None, "c", "ab", "abcabcabcabcabc"] + ["".join(rnd.choice("abc") for _ in range(5)) for _ in range(20)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    asked = spark.createDataFrame([(t,) for t in terms], "term string")
    want = {(t, i) for t in terms if t for i, x in enumerate(texts) if x is not None and t.lower() in x.lower()}
    index = substrings.gram_index(rows, "id", F.col("text"))
    for given in (None, index):
        got = [(r.term, r.id) for r in substrings.containing(asked, rows, "id", F.col("text"), given).collect()]
        assert set(got) == want and len(got) == len(want)
    assert substrings.containing(asked.limit(0), rows, "id", F.col("text")).count() == substrings.containing(asked, rows.limit(0), "id", F.col("text")).count() == 0


def test_numbers_in_powers(spark):
    """Large and small numbers as texts spell them: with a sign of times or none, with marks or none, rounded to two places or fewer."""
    said = {1: "3.3 · 10^18 steps", 2: r"about 3 \\cdot 10^{18}".replace("\\\\", "\\"), 3: "3.3 x 1018", 4: "3.31 × 10^{18}", 5: "13.3 · 10^18", 6: "10^{-5} and 2.5*10^(-7)", 7: "3.3 · 10^189", 8: "3,300,000,000,000,000,000", 9: "2 10^5 or 100 000"}
    texts = spark.createDataFrame(list(said.items()), "source_id int, text string")
    values = {"a": "3.3e18", "b": "0.00001", "c": "2.5e-7", "d": "200000", "e": "1e5", "f": "3.31e18"}
    numbers = spark.createDataFrame([(f"{v}{s}", s, x) for v, x in values.items() for s in said], "number_id string, source_id int, value string")
    got = {r.number_id for r in grounding.ground_numbers(numbers, texts).collect()}
    assert got == {"a1", "a2", "a3", "b6", "c6", "d9", "e9", "f2", "f4", "a8"} | ({"f1"} if "f1" in got else set()) | ({"f3"} if "f3" in got else set())
    labelled = spark.createDataFrame([(f"{v}{s}", s, label, x) for v, x in values.items() for s in said for label in ("steps", "about")], "value_id string, source_id int, label string, value string")
    none = spark.createDataFrame([], "source_id int, number int, row_no int, col_no int, is_header boolean, text string")
    near = {r.value_id for r in grounding.ground_attribution(labelled, none, texts).collect()}
    assert {"a1", "a2", "f2"} <= near <= got


def test_attribution_in_every_window(spark):
    """A label that stands beside the second of two numbers close together counts, and one beyond the window doesn't."""
    texts = spark.createDataFrame([(1, "x" * 300 + " 28.4 and then 28.4 " + "y" * 150 + " Big net " + "z" * 300 + " 28.4 128.4 28.45 " + "w" * 230 + " Far net")], "source_id int, text string")
    values = spark.createDataFrame([(1, 1, "Big net", "28.4"), (2, 1, "Far", "28.4"), (3, 1, "Big net", "8.4"), (4, 2, "Big net", "28.4")], "value_id int, source_id int, label string, value string")
    none = spark.createDataFrame([], "source_id int, number int, row_no int, col_no int, is_header boolean, text string")
    assert [r.value_id for r in grounding.ground_attribution(values, none, texts).collect()] == [1]


def _batches(spark, df_of, folder, batches, columns, mode):
    """What a stream gives for each of the batches, written one after the other, as (batch, row) pairs."""
    out = []
    source = spark.createDataFrame([], columns)
    (folder / "in").mkdir(parents=True)
    query = None
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").json(str(folder / "in"))
        stream = df_of(spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).json(str(folder / "in")))
        query = stream.writeStream.outputMode(mode).foreachBatch(lambda b, n, k=k: out.extend((k, tuple(r)) for r in b.collect())).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    return out


def test_late_rows_and_idle_state(spark, tmp_path):
    """Rows behind the watermark are dropped, and an idle page's or run's state goes, over several runs from one checkpoint."""
    import datetime

    t = lambda h, m=0: datetime.datetime(2024, 1, 1 + h // 24, h % 24, m)
    columns = "page string, kind string, at timestamp, correct long, total long, read array<string>"
    quiz = lambda page, at, correct: (page, "quiz", at, correct, 9, None)
    batches = [[quiz("p", t(1), 1), quiz("q", t(1), 2)], [quiz("p", t(3), 3), quiz("p", t(0), 4)], [quiz("p", t(2), 5), quiz("q", t(3), 6)], [quiz("z", t(30), 7)], [quiz("z", t(30, 1), 8)], [quiz("p", t(31), 9)]]
    got = _batches(spark, lambda s: activity.attempts_stream(s, 2, late="30 minutes", idle="5 hours"), tmp_path / "a", batches, columns, "update")
    of = lambda k, page: [r[2] for n, r in got if n == k and r[0] == page]
    assert of(0, "p") == [1] and of(1, "p") == [1, 3] and of(2, "p") == [] and of(2, "q") == [2, 6]  # t(0) is late at once: t(1) has moved the watermark
    assert of(4, "z") == [7, 8] and of(5, "p") == [9]  # p was idle, so what it had is gone
    reading = lambda page, at, *read: (page, "progress", at, None, None, list(read))
    batches = [[reading("p", t(1), "s1")], [reading("p", t(3), "s2")], [reading("p", t(2), "s0"), reading("p", t(2, 45), "s9")], [reading("z", t(30), "x")], [reading("z", t(30), "x")], [reading("p", t(30, 5), "new")]]
    got = _batches(spark, lambda s: activity.progress_stream(s, late="30 minutes", idle="5 hours"), tmp_path / "b", batches, columns, "update")
    assert [(k, r[0], r[2]) for k, r in got] == [(0, "p", ["s1"]), (1, "p", ["s2"]), (3, "z", ["x"]), (5, "p", ["new"])]
    columns = "run string, at timestamp, ordinal long, state string"
    batches = [[("r", t(2), 2, "done"), ("s", t(1), 1, "running")], [("r", t(1, 45), 1, "running"), ("s", t(2), 2, "failed")], [("s", t(5), 3, "running")], [("r", t(1), 0, "running"), ("s", t(9), 4, "done")], [("z", t(60), 1, "x")], [("s", t(61), 9, "done")], [("z", t(90), 2, "x")]]
    got = _batches(spark, lambda s: activity.transition_stream(s, late="30 minutes", idle="20 hours"), tmp_path / "c", batches, columns, "append")
    assert sorted(r for _, r in got) == [("r", 2, "running", "done"), ("s", 2, "running", "failed"), ("s", 4, "running", "done")]


def test_ranks_within_groups_of_any_size(spark):
    """Ranks equal a window's, for groups in one range, groups over several, null keys and empty tables."""
    from pyspark.sql.window import Window
    from scholarspark.operators import inorder

    rows = spark.range(30_000).selectExpr("case when id % 3 = 0 then 'hot' when id % 50 = 1 then null else concat('g', id % 400) end AS g", "id % 2 AS h", "pmod(xxhash64(id), 1000) AS v", "id", "array(id) AS payload").repartition(5)
    got = inorder.ranked(rows, ["g", "h"], [F.desc("v"), F.col("id")], "r")
    want = rows.withColumn("r", F.row_number().over(Window.partitionBy("g", "h").orderBy(F.desc("v"), "id")).cast("long"))
    assert got.columns == [*rows.columns, "r"] and got.exceptAll(want).count() == 0 and got.count() == 30_000
    assert inorder.ranked(rows.limit(0), ["g"], [F.col("id")], "r").count() == 0
    one = inorder.ranked(rows.withColumn("g", F.lit("x")), ["g"], [F.col("id")], "r")
    assert one.agg(F.max("r"), F.count_distinct("r"), F.lit(0)).first()[:2] == (30_000, 30_000) and one.select(F.spark_partition_id()).distinct().count() > 1


def test_folds_over_long_papers(spark):
    """A paper of a million units is packed as one by one; headings are kept by the rule, however the rows lie."""
    units = spark.range(1_000_000).selectExpr("if(id < 990000, 1, id % 100) AS paper_id", "id AS unit_no", "pmod(xxhash64(id), 400) AS size").repartition(4)
    got = {(r.paper_id, r.unit_no): r.pack for r in chunks.pack_units(units, 1000).where("unit_no % 37 = 0 or paper_id <> 1").collect()}
    sizes, packs = {}, {}
    for r in units.orderBy("unit_no").toLocalIterator():
        pack, used = packs.get(r.paper_id, (1, 0))
        pack, used = (pack + 1, r["size"]) if used > 0 and used + r["size"] > 1000 else (pack, used + r["size"])
        packs[r.paper_id] = pack, used
        sizes[r.paper_id, r.unit_no] = pack
    assert all(sizes[k] == p for k, p in got.items()) and packs[1][0] > 100_000


def test_context_in_blocks(spark):
    """What comes before any section, from blocks of any height; each summary is written once a level."""
    rows = [(p, i * 3, None if i % 11 == 5 else f"p{p} s{i}" if i % 7 else "") for p, n in ((1, 300), (2, 1), (3, 64), (4, 17)) for i in range(n)]
    table = spark.createDataFrame(rows, "paper_id int, section_no int, summary string").repartition(3)
    want = {(p, i): "\n".join(s for q, j, s in rows if q == p and j < i and s is not None) for p, i, _ in rows}
    for levels in (0, 3, 10):
        blocks, refs = structure.context_blocks(table, levels)
        assert {(r.paper_id, r.section_no): r.earlier for r in structure.expand_context(refs, blocks).collect()} == want
        assert max(len(r.refs) for r in refs.collect()) <= levels + 300 // 2**levels
        written = sum(len(r.text.split("\n")) for r in blocks.collect())
        assert written == (levels + 1) * sum(s is not None for _, _, s in rows)
    one = structure.expand_context(refs.where("paper_id = 1 and section_no = 897"), blocks).collect()
    assert [r.earlier for r in one] == [want[1, 897]]
    assert {(r.paper_id, r.section_no): (r.summary, r.earlier) for r in structure.earlier_context(table).collect()} == {(p, i): (s, want[p, i]) for p, i, s in rows}


def test_scratch_blocks_of_threads(spark, tmp_path):
    """What is settled in a block goes with it, and a block of another thread is another one."""
    import os
    import threading

    from scholarspark.shared import scratch, settle, shared_dir

    top = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(top))
    seen = {}

    def other():
        with scratch(spark) as mine:
            seen["other"] = mine
            settle(spark.range(3)).count()

    with scratch(spark) as folder:
        thread = threading.Thread(target=other)
        thread.start()
        thread.join()
        assert settle(spark.range(5).where("id > 1")).count() == 3 and seen["other"] != folder and not seen["other"].startswith(folder)
    assert set(os.listdir(top)) == before


def test_labels_piece_by_piece(spark):
    said = {
        r"$\pi_0$-FAST": "π0-FAST", r"$\pi_{0.5}$": "π0.5", "pi_0 and pi_{0.5}": "π0 and π0.5", "api_0": "api_0", "a_b {c} ^d": "a_b {c} ^d", r"\textbf{Big  Net}_2": "Big Net2",
        r"$x_{ab}^2$": "xab2", r"\foo{bar} $y_$": "bar y_", r"\alpha\beta x": "αβ x", r"\alphabet": "", r"x_\alpha + y^\foo": "xα + y^", r"$x_{ab$": "x_ab", r"\mathrm{x_1}": "x1", "": "", r"\\": r"\\", "$a$\n $b$": "a b",
    }
    assert dict(zip(said, col(spark, T.delatex, list(said)))) == said


@pytest.mark.parametrize("most", [0, graph.MOST_NAMES])
def test_alias_keys_are_worked_out_once_for_each_name(spark, monkeypatch, most):
    """Whether the keys of names are broadcast or meet by shuffle; null and empty names and aliases have none."""
    said = [(p, n, ["The Cats", "cat", "dogs", None, "we", ""][n % 6], [None, "", "our method", "cat"][n % 4], "dataset", "", "", "s0") for p in range(40) for n in range(24)]
    mentions = spark.createDataFrame(said, "paper_id long, mention_no long, name string, alias string, type string, description string, evidence string, section_id string")
    relations = mentions.select("paper_id", F.col("mention_no").alias("relation_no"), F.col("name").alias("source"), F.lit("dog").alias("target"), F.lit("uses").alias("relation"), "description", "section_id")
    plain = {r.name: r.k for r in mentions.select("name", T.alias_keys(F.col("name")).alias("k")).collect()}
    calls = spark.sparkContext.accumulator(0)

    def counted(name):
        calls.add(1)
        return plain.get(name, ["our method"] if name == "our method" else ["dog"] if name == "dog" else [])

    monkeypatch.setattr(graph, "alias_keys", F.udf(counted, "array<string>"))
    monkeypatch.setattr(graph, "MOST_NAMES", most)
    resolved = graph.resolve_entities(mentions)
    clusters = {}
    for r in resolved.collect():
        clusters.setdefault(r.paper_id, {})[r.mention_no] = r.cluster
    # "cat" is an alias of every kind of name with an odd number, "our method" of those with an even one; a name without keys and alias stays alone.
    keys = lambda n: set(plain[said[n][2]]) | ({"our method", "__center__"} if n % 4 == 2 else {"cat"} if n % 4 == 3 else set())
    keys_of = [k | ({"__center__"} if k & set(graph.CENTER_ALIASES) else set()) for k in map(keys, range(24))]
    least = list(range(24))
    for _ in range(24):
        least = [min([least[i], *(least[j] for j in range(24) if keys_of[i] & keys_of[j])]) for i in range(24)]
    assert all(clusters[p] == dict(enumerate(least)) for p in range(40))
    edges = graph.resolve_edges(relations, resolved.localCheckpoint()).collect()
    dog = min(least[n] for n in range(24) if said[n][2] == "dogs")
    assert all(r.target == dog and r.source != dog for r in edges)
    assert calls.value < 200  # 960 mentions and as many relations
