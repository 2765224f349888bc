"""The pipeline, stage by stage, against plain versions over a small corpus."""

import collections
import re

import pytest
from scholarspark.llm.common import model_path

from .test_docs import brute_components, brute_fingerprint
from .test_more import brute_quality

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for name, stage in pipeline.STAGES:
        rows = [tuple(r) for r in docs.select(pipeline.COLUMNS).collect()]
        out = stage(spark, docs, "/root/testdata/sf0.01")
        path = str(tmp_path / name.replace(" ", "_"))
        out.write.parquet(path)
        out = spark.read.parquet(path)
        got = collections.Counter(tuple(r) for r in out.select(pipeline.COLUMNS).collect()) if name != "sentencepiece" else None
        if got is not None:
            assert out.columns == pipeline.COLUMNS and all(r[4] == len(r[1]) for r in got)
        if name == "quality rules":
            verdict = brute_quality([(r[0], r[1], r[3]) for r in rows], copies=False)
            assert {r[0] for r in got} == {d for d, v in verdict.items() if v[-1]}
        elif name == "line dedup":
            strip = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).encode().lower().decode()
            holders = collections.defaultdict(set)
            for r in rows:
                for x in r[1].split("\n"):
                    holders[strip(x)].add(r[0])
            gone = lambda d, x: len(strip(x)) >= 20 and len(holders[strip(x)]) >= 3 and d != max(holders[strip(x)])
            assert {(r[0], r[1]) for r in got} == {(r[0], "\n".join(x for x in r[1].split("\n") if not gone(r[0], x))) for r in rows}
        elif name == "simhash near-dedup":
            groups = brute_components([(r[0], brute_fingerprint(r[1])) for r in rows])
            stay = set(groups.values())
            assert got == collections.Counter(r for r in rows if r[0] in stay)
        elif name == "mixing":
            times = {r[0]: n for r, n in got.items()}
            assert set(got) <= set(rows) and max(times.values()) <= 3
            words = collections.Counter()
            for r, n in got.items():
                words[r[3]] += n * len(r[1].split())
            assert sum(words.values()) == pytest.approx(sum(len(r[1].split()) for r in rows), rel=0.15)
        else:
            import sentencepiece

            lib = sentencepiece.SentencePieceProcessor(model_file=model_path())
            want = collections.Counter((r[0], tuple(lib.encode(r[1], add_bos=True, add_eos=True))) for r in rows)
            assert collections.Counter((r.doc_id, tuple(r.ids)) for r in out.collect()) == want
        docs = out


def test_run(spark):
    out = pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_library", "ids"]
    assert all(len(r.ids) == r.n_tokens for r in out.collect())


def test_awkward_rows(spark):
    """Nulls in every column, empty and blank texts, repeated rows, and columns with other names and clashing ones."""
    good = " ".join(f"word{i} then{i % 7} more{i * 31 % 101}" for i in range(40))
    rows = [(1, good, "en", "s", 9), (2, good, None, None, None), (None, good + " end", "en", "s", 1), (3, None, "en", "s", 0), (4, "", "en", None, 0), (5, " \n ", "de", "s", 3), (1, good, "en", "s", 9)]
    table = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, n_lines int, fp string")
    docs, kept = table, {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, "")
        kept[name] = docs.collect()
        docs = spark.createDataFrame(kept[name], docs.schema)
        if name != "sentencepiece":
            assert docs.columns == pipeline.COLUMNS
    assert sorted(repr(r.doc_id) for r in kept["quality rules"]) == ["1", "1", "2", "None"]  # the others have under 50 words
    assert len(kept["line dedup"]) == 4
    assert [r.doc_id for r in kept["simhash near-dedup"]].count(1) == 1 and len(kept["simhash near-dedup"]) <= 2
    empty = table.where("doc_id > 1000")
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, "")
        assert empty.count() == 0


def test_run_leaves_one_table(spark):
    """What the stages have written goes, but for the input of the last."""
    import os

    from scholarspark.llm.common import shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    tables = lambda: set(os.listdir(folder))
    before = tables()
    assert pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert len(tables() - before) == 1
