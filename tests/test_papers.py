"""Titles, tables and figures of papers."""

from pyspark.sql import functions as F
from scholarspark.functions import papers
from scholarspark.operators import structure, tables


def test_title(spark):
    rows = [(1, 0, 0, "Journal of Things", 9.0, 10.0), (1, 1, 0, "Deep Know-", 18.0, 40.0), (1, 2, 0, "ledge Graphs", 17.5, 60.0), (1, 3, 0, "A. Author", 10.0, 80.0), (1, 4, 0, "Large Quote", 18.0, 90.0), (1, 5, 1, "Page two", 20.0, 10.0)]
    lines = spark.createDataFrame(rows, "paper_id int, line_no int, page int, text string, size double, y0 double").withColumn("page_height", F.lit(800.0))
    assert [r.title for r in structure.title_lines(lines).collect()] == ["Deep Knowledge Graphs"]


def test_figures_and_tables(spark):
    sections = spark.createDataFrame([(1, "s1", ["r1"], "See Figure 2 and Fig. 9; Tables 3 too."), (1, "s2", ["r2"], "")], "paper_id int, section_id string, raw_ids array<string>, text string")
    figures = spark.createDataFrame([(1, 1, "r1", ["a"]), (1, 2, "r2", ["b"]), (1, 3, "r1", [])], "paper_id int, number int, raw_id string, files array<string>")
    assert sorted((r.section_id, r.number) for r in tables.attach_figures(sections, figures).collect()) == [("s1", 1), ("s1", 2), ("s2", 2)]
    found = spark.createDataFrame([(1, 3, "r2"), (1, 4, "r1")], "paper_id int, number int, raw_id string")
    assert sorted((r.section_id, r.number) for r in tables.attach_tables(sections, found).collect()) == [("s1", 3), ("s1", 4), ("s2", 3)]
    cells = spark.createDataFrame([(1, 0, 5, r, c, t) for r, row in enumerate([["a", "b"], ["1", "2"], ["3", ""]]) for c, t in enumerate(row)] + [(1, 1, 5, 0, 0, "x"), (1, 2, 6, 0, 0, "1"), (1, 2, 6, 1, 1, "2")], "paper_id int, found_no int, page int, row_no int, col_no int, text string")
    captions = spark.createDataFrame([(1, 5, 7)], "paper_id int, page int, number int")
    kept = tables.keep_tables(cells, captions).collect()
    assert {(r.found_no, r.number) for r in kept} == {(0, 7)} and len(kept) == 6


def test_lists_and_focus(spark):
    u = spark.createDataFrame([(list("abcdefgh"), ["q", "q", "r", "s", "t"], "kept")], "key_points array<string>, key_quotes array<string>, other string")
    got = tables.cap_lists(u).first()
    assert got.key_points == list("abcdef") and got.key_quotes == ["q", "r", "s"] and got.other == "kept"
    beats = spark.createDataFrame([(1, "s1", "b1", ["n1", "x", "n2"]), (1, "s2", "b2", ["n1"])], "paper_id int, section_id string, beat_id string, focus array<string>")
    elements = spark.createDataFrame([(1, "s1", "n1"), (1, "s1", "n2")], "paper_id int, section_id string, id string")
    assert {r.beat_id: r.focus for r in tables.clean_focus(beats, elements).collect()} == {"b1": ["n1", "n2"], "b2": []}


def test_sources(spark):
    rows = spark.createDataFrame([("arXiv:1706.03762v5", ""), ("x.pdf", "stamp arXiv:2101.00001v2 [cs]"), ("https://arxiv.org/abs/cs/0501001", ""), ("https://e.org/p.pdf", ""), (None, None)], "s string, p string")
    got = rows.select(papers.normalize_source(F.col("s")).alias("u"), papers.extract_paper_id(F.col("s"), F.col("p")).alias("i")).collect()
    assert [r.u for r in got] == ["https://arxiv.org/pdf/1706.03762v5", None, "https://arxiv.org/pdf/cs/0501001", "https://e.org/p.pdf", None]
    assert [r.i for r in got] == ["1706.03762", "2101.00001", "cs/0501001", None, None]
    text = spark.createDataFrame([("accuracy of 91.5 and BLEU score is 28.41, accuracy of 90.0",)], "t string").select(papers.label_numbers(F.col("t")).alias("n")).first().n
    assert [(x.label, x.value) for x in text] == [("accuracy of", 91.5), ("and BLEU", 28.41)]
