"""PPM code lengths against a plain version, and the cases that have no language."""

import collections
import math
import random
import zlib

import numpy as np
from scholarspark.llm import language

from .test_docs import SCHEMA

WORDS = {"en": "the of and that is was with from thing other".split(), "de": "der die und das ist schön über nicht mit einer".split(), "es": "el la que los niño está por más con una".split()}


def text(rnd, lang, n):
    return " ".join(rnd.choice(WORDS[lang]) for _ in range(n))


def brute_bits(lines, data, order):
    """Code length of data under one language that has met `lines`, with dictionaries."""
    follow = collections.defaultdict(collections.Counter)
    for line in lines:
        for k in range(order + 1):
            for i in range(k, len(line)):
                follow[line[i - k : i]][line[i]] += 1
    bits = 0.0
    for i in range(len(data)):
        for k in range(min(i, order), -1, -1):
            seen = follow.get(data[i - k : i])
            if seen is None:
                continue
            n, d = sum(seen.values()), len(seen)
            if data[i] in seen:
                bits -= math.log2(seen[data[i]] / (n + d))
                break
            bits -= math.log2(d / (n + d))
        else:
            bits += 8
    return bits


def test_code_lengths():
    rnd = random.Random(6)
    lines = {x: [text(rnd, x, 12).encode() for _ in range(8)] for x in WORDS}
    counts = collections.Counter()
    for lang, known in lines.items():
        for line in known:
            for k in range(1, language.ORDER + 2):
                for i in range(len(line) - k + 1):
                    counts[lang, k, int.from_bytes(line[i : i + k], "big")] += 1
    model = language.Model([(*key, n) for key, n in counts.items()])
    assert model.langs == ["de", "en", "es"]
    for data in (text(rnd, "de", 40).encode(), text(rnd, "es", 3).encode(), b"zzz qqq the", b"t", "日本語 und".encode(), bytes(rnd.randrange(256) for _ in range(99))):
        want = [brute_bits(lines[x], data, language.ORDER) for x in model.langs]
        assert np.allclose(model.lengths(np.frombuffer(data, np.uint8)), want, rtol=1e-4)


def test_identify(spark):
    rnd = random.Random(8)
    rows = [(i, text(rnd, lang := rnd.choice(list(WORDS)), rnd.randint(5, 60)), lang) for i in range(400)]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "12345 #!", "de"), (1003, text(rnd, "de", 20), None), (None, text(rnd, "es", 20), "es"), (5, rows[5][1], rows[5][2]), (1004, text(rnd, "en", 60_000), "en"), (1005, "12 " + text(rnd, "en", 9).upper(), "en")]
    table = spark.createDataFrame([(d, t, x, "s", 1, "u", 2, "h", 3, 4, "f") for d, t, x in rows], SCHEMA).repartition(3)
    got = language.identify(table).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for d, t, lang in rows:
        r = by_id[d]
        assert r.held_out == (zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 0) and 0 <= r.score <= 1
        if d in (1000, 1001, 1002):
            assert (r.lang_pred, r.score) == ("und", 0)
        elif lang:
            assert r.lang_pred == lang and r.score > 0.9
    assert by_id[1003].lang_pred == "de"
    assert language.identify(spark.createDataFrame([], SCHEMA)).count() == 0
    unlabelled = language.identify(spark.createDataFrame([(7, "the of", None, None, 1, "u", 2, "h", 3, 4, "f")], SCHEMA)).collect()
    assert [(r.lang_pred, r.score) for r in unlabelled] == [("und", 0.0)]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_sample_is_bounded(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sample = language.training_sample(docs, train_bytes=20_000, train_docs=30).collect()
    for lang in ("en", "de", "fr", "es"):
        assert 0 < sum(len(r.text.encode()) for r in sample if r.lang == lang) <= 20_000


def test_predictions_against_brute_force(spark):
    """Languages and scores of the small table, from the same sample with dictionaries."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lines = collections.defaultdict(list)
    for r in language.training_sample(docs, train_bytes=30_000).collect():
        lines[r.lang].append(r.text.encode())
    seen = docs.select("doc_id", language.letters_of(docs["text"]).alias("text")).orderBy("doc_id").limit(40).collect()
    got = {r.doc_id: r for r in language.identify(docs, train_bytes=30_000).collect()}
    for r in seen:
        if any(c.isalpha() for c in r.text) and len(r.text) < 3000:
            bits = {x: brute_bits(known, r.text.encode(), language.ORDER) for x, known in lines.items()}
            best = min(sorted(bits), key=bits.get)
            assert got[r.doc_id].lang_pred == best
            assert math.isclose(got[r.doc_id].score, 1 / sum(2 ** max(bits[best] - b, -1000) for b in bits.values()), abs_tol=1e-3)


def test_a_long_text_does_not_fill_the_sample(spark):
    rows = [(i, ("der die das " * 40_000) if i % 2 else f"der hund {i} und die katze", "de") for i in range(60)] + [(100 + i, "the cat " * 40_000, "en") for i in range(9)]
    sample = language.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sum(r.lang == "de" for r in sample) == 1 and sum(r.lang == "en" for r in sample) == 1


def test_tables_of_many_languages_stay_small():
    """200 made-up languages with words of their own: tables grow with what each has, and lengths are the plain ones."""
    rnd, lines, counts = random.Random(21), {}, collections.Counter()
    for i in range(200):
        words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
        lines[f"l{i:03}"] = [" ".join(rnd.choice(words) for _ in range(300)).encode() for _ in range(2)]
    for lang, known in lines.items():
        for line in known:
            for k in range(1, language.ORDER + 2):
                counts.update((lang, k, int.from_bytes(line[i : i + k], "big")) for i in range(len(line) - k + 1))
    model = language.Model([(*key, n) for key, n in counts.items()])
    grams = len({key[1:] for key in counts})
    assert model.nbytes() < 60 * len(counts)  # a column for each language would take more than:
    assert model.nbytes() < 4 * grams * 200 / 5
    texts = [lines["l007"][0][40:300], b"", lines["l123"][1][:3], "über 12".encode(), lines["l199"][0] * 2]
    at = np.cumsum([0, *map(len, texts)])
    got = model.lengths(np.frombuffer(b"".join(texts), np.uint8), at)
    for data, bits in zip(texts, got):
        for lang in (7, 11, 123, 199):
            assert math.isclose(bits[lang], brute_bits(lines[model.langs[lang]], data, language.ORDER), rel_tol=1e-4, abs_tol=1e-6)
    assert [model.langs[x] for x in got[[0, 4]].argmin(axis=1)] == ["l007", "l199"]
