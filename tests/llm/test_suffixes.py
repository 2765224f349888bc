"""Suffix arrays and repeated strings against brute force."""

import collections
import random

import numpy as np
import pytest
from scholarspark.llm import suffix_dedup

from .test_docs import SCHEMA, corpus


def test_suffix_array():
    rnd = random.Random(2)
    for size, alphabet in ((50, b"ab"), (700, b"abc"), (300, b"a"), (900, bytes(range(256))), (400, b"\x00\x01\xff")):
        text = bytes(rnd.choice(alphabet) for _ in range(size))
        text += text[: size // 3]
        data = np.frombuffer(text + bytes(40) + b"\xff", np.uint8)
        for share in (1.0, 0.4):
            wanted = np.zeros(len(data), bool)
            wanted[: len(text)] = [rnd.random() < share for _ in text]
            order = suffix_dedup.suffix_array(data, wanted, 40)
            assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist()
            strings = [data[i : i + 40].tobytes() for i in order]
            assert strings == sorted(strings)
            common = suffix_dedup.common_prefixes(data, order, 40)
            for i in range(1, len(order)):
                same = next((k for k in range(40) if strings[i][k] != strings[i - 1][k]), 40)
                assert common[i] == (same if same >= 8 else 0)


def brute(texts, length):
    """(bytes, removed runs, kept) of each text."""
    data = [(t or "").encode() for t in texts]
    times = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if times[d[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        spans = [(a, b) for a, b in zip(*[iter(np.flatnonzero(np.diff(np.frombuffer(bytes(1) + gone + bytes(1), np.int8)) != 0).tolist())] * 2)]
        out.append((len(d), spans, bytes(b for b, g in zip(d, gone) if not g)))
    return out


@pytest.mark.parametrize("most", [suffix_dedup.MOST, 2000, 0])
def test_suffix_dedup(spark, most):
    """Also when keys are taken for hot, and dealt out again by longer grams, to the last with 0."""
    rnd = random.Random(4)
    rows = corpus()
    passage = " ".join(str(rnd.random()) for _ in range(30))
    edged = [f"{chr(97 + i % 26) * (i // 26)}{i}" + passage[:240] + str(rnd.random()) for i in range(60)]  # one passage between different words
    extra = edged + ["be " * 100, "be " * 200 + "x", "a" * 500, "a" * 199, "ab" * 100, passage + "é" * 30, "x" + passage, passage[:250] + "!" + passage[200:], "日本" * 120, "日本" * 121]
    texts = [(r[0], r[1]) for r in rows] + [(1000 + i, t) for i, t in enumerate(extra)] + [(None, passage), (1001, "be " * 200 + "x")]
    table = spark.createDataFrame([(*t, "en", "s", 1, "u", 2, "d", 3, 4, "f") for t in texts], SCHEMA).repartition(3)
    got = suffix_dedup.suffix_dedup(table, most=most).collect()
    want = [(d, *x) for (d, _), x in zip(texts, brute([t for _, t in texts], 200))]
    assert sorted(((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got), key=repr) == sorted(want, key=repr)
    assert suffix_dedup.suffix_dedup(spark.createDataFrame([], SCHEMA), most=most).count() == 0


def test_suffix_dedup_in_chunks(spark):
    """Documents longer than a chunk."""
    rnd = random.Random(9)
    runs = suffix_dedup._runs(200)
    import pyarrow as pa

    text = "".join(rnd.choice("abcdefgh ") for _ in range(9000))
    batch = pa.RecordBatch.from_pydict({"k1": pa.array([1, 2], pa.int64()), "k2": pa.array([1, 2], pa.int64()), "text": [text, text[:5000]]})
    whole = pa.Table.from_batches(runs([batch])).to_pydict()
    old, suffix_dedup.CHUNK = suffix_dedup.CHUNK, 1000
    try:
        parts = pa.Table.from_batches(runs([batch])).to_pydict()
    finally:
        suffix_dedup.CHUNK = old
    each = lambda t: sorted((k, p + i, h) for k, p, n, h in zip(t["k1"], t["p"], t["n"], t["h"]) for i in range(n))
    assert each(whole) == each(parts) and len(each(whole)) == 8801 + 4801


def test_suffix_dedup_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    want = [(r.doc_id, *x) for r, x in zip(rows, brute([r.text for r in rows], 200))]
    got = suffix_dedup.suffix_dedup(docs).collect()
    assert sorted((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got) == sorted(want)


def test_suffix_dedup_many_copies(spark):
    """Equal rows, and a megabyte of one character in many copies, take seconds and give each row its result."""
    rnd = random.Random(5)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(1000))
    rows = [(7, text)] * 200 + [(i, "a" * 1_000_000) for i in range(100)] + [(1000, "a" * 3_000_000), (1001, "abc" * 70_000), (1002, text[:150] + "!" + text[150:])]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows)
    for r in got:
        whole = [(0, r.n_bytes)] if r.doc_id != 1002 else [(151, 1001)]
        assert [tuple(s) for s in r.spans] == whole
        assert len(r.kept) == r.n_bytes - (whole[0][1] - whole[0][0])
