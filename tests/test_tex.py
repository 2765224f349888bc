"""TeX columns, citations, quotes on pages, linked titles, assembled pages."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F
from scholarspark.functions import tex, text
from scholarspark.operators import papers


def column(spark, value, *cells):
    return [r[0] for r in spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").orderBy("i").select(value(F.col("c"))).collect()]


def test_tabular(spark):
    body = r"""\toprule Model & \multicolumn{2}{c}{BLEU} \\ \cmidrule(lr){2-3}
        \multirow{2}{*}{Base \cite{x}} & 27.3 & 38.1 & R\&D \\[2pt] & & \\ \rowcolor{red} \textbf{Big} & 28.4 \\ \bottomrule"""
    got = column(spark, tex.tabular_cells, body, "", None)
    assert got == [[["Model", "BLEU", "", ""], ["Base", "27.3", "38.1", "R&D"], ["Big", "28.4", "", ""]], [], []]


def test_bibliography(spark):
    bbl = "x\\bibitem[{Black et~al.(2024)Black, Brown}]{pi0} K. Black.\n\\newblock Pi.  2024.\n\\bibitem{two} Second entry.\n\\bibitem[ABC]{} Third \\end{thebibliography} rest"
    assert [tuple(e) for e in column(spark, tex.parse_bibitems, bbl)[0]] == [(1, "pi0", "Black et al., 2024", "K. Black. Pi. 2024."), (2, "two", "2", "Second entry."), (3, "", "ABC", "Third")]
    assert column(spark, tex.parse_bibitems, "", None) == [[], []]


def test_sections(spark):
    text = "\\title{t}\\begin{document}\\maketitle\\begin{abstract}gone\\end{abstract} short % \\section{no}\n\\section{One}\n a \\subsection*[s]{Two \\emph{x}}b\\subsection{Three}\\begin{thebibliography}{9}z\\end{thebibliography}\\section*{End} c\\end{document}"
    got = [tuple(s) for s in column(spark, tex.split_tex_sections, text)[0]]
    assert got == [(1, 1, False, "One", "a"), (2, 2, True, "Two x", "b"), (3, 2, False, "Three", ""), (4, 1, True, "End", "c")]
    deep = "\\section{A {\\bf B {C {D}}} E} body \\section{open {never closed"
    assert [(s.no, s.body) for s in column(spark, tex.split_tex_sections, deep)[0]] == [(1, "body \\section{open {never closed")]
    long = "\\bibitem[{{A {B}} et~al.(2020)}]{k} Text."
    assert [tuple(e) for e in column(spark, tex.parse_bibitems, long)[0]] == [(1, "k", "A B et al., 2020", "Text.")]
    assert column(spark, tex.split_tex_sections, "y" * 201 + "\\section{A}b", None)[0][0].title == "Preamble"
    assert column(spark, tex.split_tex_sections, None, "") == [[], []]


def test_schema_problems(spark):
    get = lambda c: tex.schema_problems(c, "a INT, b ARRAY<STRING>")
    got = column(spark, get, '{"a": 1, "b": ["x"]}', '{"a": "x", "b": []}', '{"b": null}', "[1]", "nothing", None)
    assert got == [[], ["a: not of type int"], ["a: field required", "b: field required"], ["output was not valid JSON"], ["output was not valid JSON"], ["output was not valid JSON"]]
    assert column(spark, lambda c: tex.schema_problems(c, "items ARRAY<INT>"), "[1, 2]", '{"items": [3]}') == [[], []]


def test_citations(spark):
    refs = spark.createDataFrame([(1, 1, "Kevin Black, Tony Z. Zhao. π0: A vision-language model. arXiv, 2024."), (1, 2, "Black, Alan. Second paper. 2023."), (1, 3, "Vaswani et al. Attention is all you need. 2017."), (1, 4, "Vaswani 2024"), (1, 5, "Zoe Zed0. Work 11. 2001."), (2, 1, None)], "paper_id int, ref_no int, text string")
    names = spark.createDataFrame([(1, n) for n in ["Black et al., 2024", "Black (2023)", "Black et al.", "Vaswani et al.", "Vaswani, 2017", "Black", "Zed0, 2001", "lower, 2024", None]] + [(2, "Black et al., 2024")], "paper_id int, name string")
    got = {r.name: (r.short, r.title) for r in papers.resolve_citations(names, refs).collect()}
    assert got == {"Black et al., 2024": ("π0", "π0: A vision-language model"), "Black (2023)": ("", "Second paper"), "Vaswani, 2017": ("", "Attention is all you need"), "Zed0, 2001": ("", "Work 11")}


def test_cites_and_refs(spark):
    texts = spark.createDataFrame([(1, 1, r"\citep[see][p. 2]{a,b} then \citet{a, b}; \citeauthor{a} \citeyear{a,c}\cite{}."), (1, 2, "none"), (1, 3, None), (2, 1, r"\cite{a}")], "paper_id int, text_id int, text string")
    bib = spark.createDataFrame([(1, "a", "Black et al., 2024"), (1, "b", "7")], "paper_id int, key string, short string")
    got = {(r.paper_id, r.text_id): r.text for r in papers.resolve_cites(texts, bib).collect()}
    assert got == {(1, 1): "[Black et al., 2024; 7] then Black et al. (2024) and 7; Black et al. 2024, c.", (1, 2): "none", (1, 3): None, (2, 1): "[a]"}
    texts = spark.createDataFrame([(1, 1, r"\ref{f} \cref{f,g} \eqref{e}, \autoref{x}")], "paper_id int, text_id int, text string")
    labels = spark.createDataFrame([(1, "f", 2, "Figure"), (1, "g", 3, "Table"), (1, "e", 4, None)], "paper_id int, key string, number int, kind string")
    assert papers.resolve_refs(texts, labels).first().text == "2 Figure 2, Table 3 (4), ?"


def test_locate_quotes(spark):
    pages = spark.createDataFrame([(1, 1, "We train the large model on eight machines."), (1, 2, "We TRAIN the\nlarge model on eight other machines"), (1, 3, "We train the large model on eight machines.")], "paper_id int, page int, text string")
    quotes = spark.createDataFrame([(1, 1, "We train the large model on eight machines", [3, 2], 9), (1, 2, "We train the large model on eight machines", None, 9), (1, 3, "We train the large model", [2], 9), (1, 4, "never said so at all", [1], 9), (1, 5, None, [1], 9)], "paper_id int, quote_id int, quote string, hints array<int>, first_page int")
    assert {r.quote_id: r.page for r in papers.locate_quotes(quotes, pages).collect()} == {1: 3, 2: 1, 3: 2, 4: 9, 5: 9}


def test_link_titles(spark):
    rnd = random.Random(4)
    words = "deep neural graph model text learning scale data of a in attention query fast".split()
    b = [(i, " ".join(rnd.sample(words, rnd.randint(2, 9)))) for i in range(80)]
    a = [(i, t + rnd.choice(["", "!", " s", " More"]), rnd.choice([None, "Page: " + rnd.choice(b)[1].upper()])) for i, t in b] + [(900, None, "x"), (901, "a b", None)]
    plain = lambda t: " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
    want = {}
    for i, t, page in a:
        na = plain(t)
        must = [w for w in na.split() if len(w) > 2][:12]
        hits = []
        for j, u in b:
            nb, r = plain(u), SequenceMatcher(None, plain(u), na).ratio()
            if len(must) >= 3 and set(must) <= set(nb.split()) and (na == nb or r >= 0.92 or (page and nb in plain(page))):
                hits.append((-r, j))
        if hits:
            want[i] = min(hits)[1]
    got = papers.link_titles(spark.createDataFrame(a, "paper_id int, title string, first_page string"), spark.createDataFrame(b, "catalog_id int, title string"))
    assert {r.paper_id: r.catalog_id for r in got.collect()} == want and len(want) > 20


def test_limit_quotes(spark):
    rnd, rows, want = random.Random(2), [], {}
    for s in range(60):
        used, before = [], None
        for n in range(7):
            q = rnd.choice(["a", "b", "c", None, ""])
            rows.append((1, s, n, q))
            ok = q if q and q not in used and len(used) < 2 and not before else None
            used += [ok] if ok else []
            want[s, n] = before = ok
    got = papers.limit_quotes(spark.createDataFrame(rows, "paper_id int, section_id int, beat_no int, quote string"))
    assert {(r.section_id, r.beat_no): r.quote for r in got.collect()} == want and got.columns == ["paper_id", "section_id", "beat_no", "quote"]


def test_section_pages(spark):
    sections = spark.createDataFrame([(1, n) for n in range(1, 5)] + [(2, 1)], "paper_id int, section_no int")
    hits = spark.createDataFrame([(1, 1, 2), (1, 2, 5), (1, 2, 7), (1, 3, 4)], "paper_id int, section_no int, page int")
    got = papers.section_pages(sections, hits, spark.createDataFrame([(1, 9), (2, 3)], "paper_id int, n_pages int"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 2, 5), (1, 2, 5, 5), (1, 3, 5, 5), (1, 4, 5, 9), (2, 1, 1, 3)]


def test_assemble(spark):
    beats = spark.createDataFrame([(1, "deep", "s1", 1, 2, "b2", "two"), (1, "deep", "s1", 1, 1, "b1", "one"), (1, "high", "s2", 2, 1, "b3", "x")], "paper_id int, view string, section_id string, section_no int, beat_no int, beat_id string, narration string")
    diagrams = spark.createDataFrame([(1, "deep", "s1", "D")], "paper_id int, view string, section_id string, diagram string")
    focus = spark.createDataFrame([(1, "b1", ["n1"]), (1, "b3", ["n2"])], "paper_id int, beat_id string, focus array<string>")
    clips = spark.createDataFrame([(1, "b3", "c.mp3")], "paper_id int, beat_id string, clip string")
    (row,) = papers.assemble(beats, diagrams, focus, clips).collect()
    deep, high = row.views
    assert [(b.beat_id, b.focus, b.clip) for b in deep.sections[0].beats] == [("b1", ["n1"], None), ("b2", [], None)] and deep.sections[0].diagram == "D"
    assert [(b.beat_id, b.focus, b.clip) for b in high.sections[0].beats] == [("b3", [], "c.mp3")]


def test_long_labels(spark):
    """Labels, headings and numbers of any length are read without recursion."""
    label = "Smith{x}" * 25_000
    bbl = r"\bibitem[" + label + r"(2020)]{key} Some text." + "\n" + r"\bibitem[" + "b" * 200_000 + r"]{other} More."
    found = spark.createDataFrame([(bbl,)], "t string").select(tex.parse_bibitems(F.col("t")).alias("x")).first().x
    assert [(e.key, e.text) for e in found] == [("key", "Some text."), ("other", "More.")] and found[0].short == "Smithx" * 25_000 + ", 2020" and len(found[1].short) == 200_000
    assert spark.createDataFrame([("at 1" + ".23" * 50_000,)], "t string").select(F.size(text.numbers_in(F.col("t"))).alias("n")).first().n == 1
