"""Very long hosts, values and documents of very many lines: defined results, in time that grows with the length."""

import time

from pyspark.sql import functions as F
from scholarspark.llm import line_dedup, pii, quality, secrets


def test_long_hosts(spark):
    texts = ["to a@b" + ".c" * 100_000 + ".de end", "to a@b" + ".com" * 40 + " end", "bob@x.com..y and bob@x.com.123", "a" * 100_000 + "@b.com", "@" * 50_000, "a@" + "b" * 100_000]
    rows = {r.doc_id: r for r in pii.replace_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert rows[0].text.startswith("to ") and rows[0].text.endswith(".c.de end") and len(rows) == len(texts)
    assert rows[1].n_replaced == {"email": 1} and rows[1].text.endswith(" end") and "@b" not in rows[1].text
    assert rows[2].n_replaced == {"email": 2} and rows[2].text.endswith(".123") and "..y and " in rows[2].text
    assert rows[3].n_replaced == {"email": 1} and rows[4].text == texts[4] and rows[5].text == texts[5]


def test_long_values(spark):
    docs = [(i, f"the word number {i} stands here and there", "a/b") for i in range(50)]
    docs += [(100, "password=" + "aB3$" * 75_000, "x"), (101, "k" * 300_000, "x"), (102, "see token: Zx81qP07mmQ2vN5k now", "x")]
    start = time.time()
    rows = secrets.scan_secrets(spark.createDataFrame(docs, "doc_id int, text string, source string")).collect()
    assert {(r.doc_id, len(r.value)) for r in rows} == {(100, 300_000), (101, 300_000), (102, 16)} and time.time() - start < 300


def test_grams(spark):
    rows = spark.createDataFrame([("abcde",), ("ab",), ("a",), ("",), ("né漢",)], "v string").select(secrets._grams(F.col("v"), 2).alias("two"), secrets._grams(F.col("v"), 3).alias("three")).collect()
    assert [r.two for r in rows] == [["ab", "bc", "cd", "de"], ["ab"], [], [], ["né", "é漢"]]
    assert [r.three for r in rows] == [["abc", "bcd", "cde"], [], [], [], ["né漢"]]


def test_many_lines(spark):
    """300,000 lines, all of them repeated in two other documents, of which one keeps them."""
    lines = [f"this is line number {i % 100_000} of them" for i in range(300_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(lines[:100_000])), (3, "own\n" + "\n".join(lines[:100_000])), (4, "short")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)
    start = time.time()
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    assert (got[1].text, got[1].n_lines, got[1].n_dropped) == ("", 300_000, 300_000) and (got[2].text, got[2].n_dropped) == ("", 100_000)
    assert got[3].text == rows[2][1] and got[3].n_dropped == 0 and got[4].text == "short" and time.time() - start < 200


def test_many_repeated_lines_of_a_host(spark):
    """Twenty thousand lines that all documents of a host have are taken out; what is their own stays."""
    lines = [f"L{i}" for i in range(20_000)]
    own = {k: " ".join(f"w{k}x{i}" for i in range(30_000)) for k in range(4)}
    rows = [(k, "\n".join([lines[0], own[k], *lines])) for k in own] + [(9, " ".join(f"u{i}" for i in range(60)))]
    docs = spark.createDataFrame([(*r, "h") for r in rows], "doc_id int, text string, source string").repartition(4)
    start = time.time()
    got = {r.doc_id: r.text for r in quality.keep_good(docs, min_docs=2, max_share=0.5).collect()}
    assert got == {**own, 9: rows[4][1]} and time.time() - start < 200
