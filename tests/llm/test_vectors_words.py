"""Importance resampling, word-end BPE and whitening against plain versions and libraries."""

import collections
import hashlib
import math
import random
import re
import zlib
from decimal import Decimal

import numpy as np
from scholarspark.llm import queries, resampling, whitening, word_bpe
from scholarspark.llm.common import model_path

WIDE = "doc_id long, text string, lang string, `__down` int, rank int, n_words int, score int"


def brute_resampling(docs, target, n_buckets, longest, seed, least_words, percent):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    runs = lambda w: [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    buckets = lambda t: [zlib.crc32(f.encode()) % n_buckets for f in runs(words(t))]
    s, t = collections.Counter(b for _, x in docs for b in buckets(x)), collections.Counter(b for x in target for b in buckets(x))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + n_buckets) / ((s[b] + 1) * (t.total() + n_buckets))))
    out = []
    for d, x in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, buckets(x)))
        out.append((d, len(buckets(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x))))
    order = sorted((r for r in out if r[4] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    first = len(order) * percent // 100
    return sorted([(*r[:4], k + 1 if k < first else None) for k, r in enumerate(order)] + [(*r[:4], None) for r in out if r[4] < least_words], key=repr)


def test_resampling(spark, monkeypatch):
    monkeypatch.setattr(resampling, "SLICE", 1000)  # so that long texts come in several pieces
    r = random.Random(5)
    docs = [(i, " ".join(r.choice(["Alpha", "beta", "x1", "ÄÖ", "né", "Ж", "gam-ma", "1"]) + str(r.randint(0, 30)) for _ in range(r.randint(0, 60)))) for i in range(300)]
    docs += [(7, docs[7][1])] * 200 + [(None, docs[9][1])] * 3 + [(None, None), (400, None), (401, ""), (402, " \n.;"), (403, "long word " * 3000), (404, "x" * 5000 + " " + "é" * 3000)]
    target = ["Alpha1 beta2 x13 " * 5, None, "", "ÄÖ3 né4"]
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    for options in ({"n_buckets": 10_000, "longest": 1, "seed": 2024, "least_words": 20, "percent": 10}, {"n_buckets": 100_000, "longest": 3, "seed": 1, "least_words": 5, "percent": 55}, {"n_buckets": 7, "longest": 2, "seed": 1, "least_words": 0, "percent": 100}):
        table = spark.createDataFrame([(d, t, "en", 1, 2, 3, 4) for d, t in docs], WIDE).repartition(5)
        out = resampling.resample(table, wanted, **options)
        assert out.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
        assert sorted(map(tuple, out.collect()), key=repr) == brute_resampling(docs, target, **options)
    none = table.limit(0)
    assert resampling.resample(none, wanted).count() == 0
    assert sorted(map(tuple, resampling.resample(table, none).collect()), key=repr) == brute_resampling(docs, [], 10_000, 1, 2024, 20, 10)


def test_ranks_in_many_segments(spark):
    """Every rank is given once, in order, however many keys are equal, and no segment holds much more than another."""
    rows = spark.range(40_000).selectExpr("if(id % 3 = 0, 5, id) AS doc_id", "id % 2 AS n_features", "id % 7 AS weight", "if(id % 3 = 0, 100, pmod(xxhash64(id), 50)) AS score").repartition(9)
    for percent in (0, 10, 50, 100):
        out = resampling.top_ranks(rows, percent).collect()
        order = sorted(map(tuple, rows.collect()), key=lambda r: (-r[3], r[0], r[1]))
        ranked = sorted((r for r in out if r.rank is not None), key=lambda r: r.rank)
        assert len(out) == 40_000 and [r.rank for r in ranked] == list(range(1, 400 * percent + 1))
        assert [(r.score, r.doc_id, r.n_features) for r in ranked] == [(r[3], r[0], r[1]) for r in order[: 400 * percent]]
    runs = rows.selectExpr("*", "-score AS __down", "monotonically_increasing_id() AS __row").sortWithinPartitions(*resampling.ORDER).checkpoint()
    samples = resampling._samples(runs, 100)
    sizes = [r["count"] for r in resampling._in_segments(runs, samples[::20]).groupBy("__segment").count().collect()]
    assert 300 < len(samples) < 500 and max(sizes) < 2 * 20 * 100


def test_word_bpe(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(model_path("word_bpe_49k.json"))
    r = random.Random(3)
    texts = [None, "", " \n\t ", "Don't I'LL we'VE y'all's ''s", "<|endoftext|>x<|startoftext|>Y<|endoftext", "a" * 5000, "ab" * 40_000 + "é́", "ſ K İ ẞ ΑΣ ΟΔΟΣ", "x\x1cy z w\u0085q r", "̀ a ̀b Å İ", "１２３ ½ Ⅷ 한국어 日本語 👩‍👩‍👧 0123456789", "\x00\x01﻿"]
    texts += ["".join(r.choice("abcdefghij 'é.1Z") for _ in range(r.randint(1, 400))) for _ in range(200)]
    texts += ["".join(chr(r.choice([r.randint(1, 0xD7FF), r.randint(0x20, 0x7F), r.randint(0xE000, 0x1FFFF)])) for _ in range(80)) for _ in range(400)]
    table = spark.createDataFrame([(None if i == 1 else i // 2, t, "en", 1, 2, 3, 4) for i, t in enumerate(texts)], WIDE).repartition(3)
    out = word_bpe.encode_decode(table, model_path("word_bpe_49k.json"), keep_ids=True).collect()
    want = collections.Counter()
    for d, t, *_ in table.collect():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[d, tuple(ids), library.decode(ids, skip_special_tokens=False), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()] += 1
    assert collections.Counter((x.doc_id, tuple(x.ids), x.decoded, x.ids_sha256) for x in out) == want
    assert all(x.n_tokens == len(x.ids) and x.n_library == 0 and x.decoded_sha256 == hashlib.sha256(x.decoded.encode()).hexdigest() for x in out)
    assert word_bpe.encode_decode(table.limit(0), model_path("word_bpe_49k.json")).count() == 0


def test_word_bpe_over_documents(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(model_path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = queries.op12_word_bpe(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(texts) and sum(r.n_library for r in rows) == 0
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_merge_rounds_with_low_new_pairs(tmp_path):
    """Where a merge makes what an earlier merge asks for, places are merged one by one, as the library does."""
    from tokenizers import Tokenizer, decoders, models, normalizers, pre_tokenizers

    chars = sorted(pre_tokenizers.ByteLevel.alphabet())
    merges = [("c", "d"), ("ab", "a"), ("a", "b"), ("b", "a"), ("a", "a"), ("ab", "ab"), ("b", "a</w>"), ("aba", "b")]
    tokens = [*chars, *(c + "</w>" for c in chars), *dict.fromkeys(a + b for a, b in merges)]
    own = Tokenizer(models.BPE({t: i for i, t in enumerate(tokens)}, merges, end_of_word_suffix="</w>"))
    own.normalizer = normalizers.Lowercase()
    own.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(False, use_regex=False)])
    own.decoder = decoders.Fuse()
    own.save(str(path := tmp_path / "own.json"))
    merges = word_bpe.Merges(str(path))
    assert not merges.at_once.all()
    r = random.Random(1)
    words = ["".join(r.choice("abcd") for _ in range(r.randint(1, 30))) for _ in range(3000)]
    for w, ids in zip(words, merges.merge([w.encode() for w in words])):
        assert ids.tolist() == own.encode(w).ids, w


def test_word_bpe_takes_the_librarys_ids(monkeypatch):
    """Ids that differ are the library's, and counted, for the piece alone."""
    merges = word_bpe.Merges(model_path("word_bpe_49k.json"))
    monkeypatch.setattr(merges, "made", np.where(np.arange(len(merges.made)) == 0, merges.made[1], merges.made))  # i + n makes "th"
    known = word_bpe._Pieces(merges)
    for _ in range(2):
        rows = known.encode_all([b"finger a mouse", b"a mouse", b"x" * 300 + b" fingers"])
        for (n, ids, tokens, other), t, k in zip(rows, ("finger a mouse", "a mouse", "x" * 300 + " fingers"), (1, 0, 1)):
            theirs = merges.library.encode(t, add_special_tokens=False)
            assert (n, ids.decode(), tokens.decode()) == (len(theirs.ids), " ".join(map(str, theirs.ids)), " ".join(theirs.tokens)) and other == k


VECTORS = "vec_id long, embedding array<float>, label int, x int, whitened int"


def brute_whitening(rows, k):
    """vec_id -> (n, deviation, whitened, explained), with covariances from the centred vectors in double precision."""
    good = [(i, [math.floor(64 * c) + 1_000_000 for c in map(float, np.float32(v))]) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[float(n * a - s) / n for a, s in zip(x, total)] for x in fit])
    v = y.T @ y / n
    e, axes = np.linalg.eigh(v)
    out = []
    for i, x in good:
        z = np.array([float(n * a - s) / n for a, s in zip(x, total)])
        for c in range(k):
            out.append((i, c + 1, n, sum((n * a - s) ** 2 for a, s in zip(x, total)), z @ axes[:, -1 - c] / math.sqrt(e[-1 - c]), e[-1 - c] / np.trace(v)))
    return out


def same_up_to_sign(got, want):
    assert collections.Counter(r[:4] for r in got) == collections.Counter(r[:4] for r in want)
    for c in {r[1] for r in want}:
        a, b = (np.array([r[4] for r in sorted(x for x in rows if x[1] == c)]) for rows in (got, want))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
        assert {r[5] for r in got if r[1] == c} == {next(r[5] for r in got if r[1] == c)} and abs(next(r[5] for r in got if r[1] == c) / next(r[5] for r in want if r[1] == c) - 1) < 1e-9


def test_whitening_over_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    out = queries.op13_whitening(spark, "/root/testdata/sf0.01")
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and dict(out.dtypes)["deviation"] == "bigint"
    got = out.collect()
    same_up_to_sign([tuple(r)[:6] for r in got], brute_whitening(rows, 16))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_whitening_of_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 7)
    r = random.Random(2)
    base = [[r.gauss(3, 2), r.gauss(-1, 0.5), r.gauss(0, 9), r.gauss(1e4, 30)] for _ in range(60)]
    rows = list(enumerate(base)) + [(100, base[0])] * 50 + [(None, base[1]), (None, None), (200, []), (201, [1.0, None, 2.0, 3.0]), (202, [float("nan"), 1.0, 1.0, 1.0]), (203, [1.0, 1.0, float("-inf"), 1.0])]
    odd = [(300, [1.0, 2.0]), (301, [1.0] * 5), (302, [1e30, 0.0, 0.0, 0.0])]
    table = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows + odd], VECTORS).repartition(4)
    got = [tuple(x)[:6] for x in whitening.whiten(table).collect()]
    fill = lambda rows: [(-1 if x[0] is None else x[0], *x[1:]) for x in rows]
    same_up_to_sign(fill(got), fill(brute_whitening(rows, 4)))
    assert whitening.whiten(table.limit(0)).count() == 0
    assert whitening.whiten(table.where("vec_id = 100")).count() == 0  # no variance
    flat = spark.createDataFrame([(i, [float(i % 5), 2.0, float(i % 5)]) for i in range(40)], "vec_id long, embedding array<double>")
    assert {x.component for x in whitening.whiten(flat).collect()} == {1}  # one direction has variance
    far = spark.createDataFrame([(i, [3e9 * ((i * 7) % 5), 2.0**33 - i]) for i in range(9)], "vec_id long, embedding array<double>")
    x = [[math.floor(64 * c) + 1_000_000 for c in v.embedding] for v in sorted(far.collect())]
    total = [sum(c) for c in zip(*x)]
    assert {v.vec_id: v.deviation for v in whitening.whiten(far).collect()} == {i: Decimal(sum((9 * a - s) ** 2 for a, s in zip(v, total))) for i, v in enumerate(x)}


def test_covariances_are_exact():
    """Polarisation in whole numbers gives what the definition gives in whole numbers."""
    r = random.Random(4)
    y = [[r.randint(-(10**6), 10**9) for _ in range(5)] for _ in range(30)]
    squares = np.zeros((5, 5), object)
    for i in range(5):
        for j in range(i, 5):
            squares[i, j] = sum((v[i] + (v[j] if i != j else 0)) ** 2 for v in y)
    rest = [sum(c) for c in zip(*y)]
    found = whitening.covariance(30, rest, squares)
    for i in range(5):
        for j in range(5):
            exact = sum((30 * v[i] - rest[i]) * (30 * v[j] - rest[j]) for v in y)
            assert found[i, j] == exact / 30**3
