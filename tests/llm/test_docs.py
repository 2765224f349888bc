"""Small tables with every awkward case, against brute force."""

import collections
import hashlib
import random
import re
from array import array

import pytest
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F
from scholarspark.llm import exact_dedup, line_dedup, mixing, sentencepieces, simhash
from scholarspark.llm.common import components, model_path, positions

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, `__uid` int, digest string, size int, n_lines int, fp string"


def corpus():
    """Copies, near copies, repeated lines, nulls, repeated rows, empty and long texts, in a fixed order."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefgéü") for _ in range(rnd.randint(1, 7)))
    texts = [" ".join(word() for _ in range(rnd.randint(1, 120))) for _ in range(40)]
    shared = ["This line is shared by very many documents.", "  Another SHARED line, with blanks \t", "short"]
    out = []
    for i in range(120):
        t = rnd.choice(texts)
        kind = i % 6
        if kind == 1:
            t = t.replace(" ", "\t\n", 3)
        elif kind == 2:
            t = t + " " + word()
        elif kind == 3:
            t = "\n".join([t, rnd.choice(shared), word(), rnd.choice(shared).upper()])
        out.append((i, t))
    out += [(200, None), (201, ""), (202, " \n "), (203, "x" * 5000 + "\n" + "ab " * 9000), (None, texts[0]), (None, None), (5, out[5][1]), (5, out[5][1]), (204, "▁▁ a▁b\x00 　日本 🙂▁"), (205, "\n\n"), (None, shared[0]), (206, "a\r\nb\x85c d")]
    return [(d, t, rnd.choice(["en", "de", None]), rnd.choice(["s1", "s2", "S", None]), None, "u", 1, "d", 2, 3, "f") for d, t in out]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_exact_dedup(docs, rows, none):
    norm = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    keep = {h: min((x for x in g if x is not None), default=None) for h, g in groups.items()}
    for tracked, winners in ((8192, 1024), (16, 2)):
        got = exact_dedup.exact_dedup(docs, tracked, winners).collect()
        want = sorted(((r[0], keep[norm(r[1])], len(groups[norm(r[1])]), norm(r[1])) for r in rows), key=repr)
        assert sorted(((g.doc_id, g.keep_id, g.group_size, g.text_sha256) for g in got), key=repr) == want
        assert collections.Counter(g.text_sha256 for g in got if g.kept) == {h: 1 for h in groups}
        assert all(g.doc_id == g.keep_id for g in got if g.kept)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_mixing(docs, rows, none):
    got = mixing.mix_counts(docs)
    size, total, target, copies = got.columns[-4:]
    assert size == "size_"
    found = got.collect()
    assert sorted((repr(r[c]) for r in found for c in ("doc_id",))) == sorted(repr(r[0]) for r in rows)
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += n(r[1])
    order = sorted((s for s in sizes if s is not None)) + [None]
    w = dict(zip(order, [5, 2, 1] * 9))
    capped, t = set(), sum(sizes.values())
    while True:
        left = t - sum(3 * sizes[s] for s in capped)
        aim = {s: 3 * sizes[s] if s in capped else left * w[s] / sum(w[x] for x in order if x not in capped) for s in order}
        new = {s for s in order if aim[s] > 3 * sizes[s]} - capped
        if not new:
            break
        capped |= new
    for r in found:
        assert r[size] == n(r["text"]) and r[total] == sizes[r["source"]] and r[target] == pytest.approx(aim[r["source"]])
        assert r[copies] in (int(aim[r["source"]] / sizes[r["source"]]), int(aim[r["source"]] / sizes[r["source"]]) + 1)
    again = mixing.mix_counts(docs.repartition(5)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))
    emitted = collections.Counter(map(repr, mixing.mix(docs).collect()))
    assert sum(emitted.values()) == sum(r[copies] for r in found)
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(none).count() == 0 and mixing.mix_counts(none).count() == 0


def test_line_dedup(docs, rows, none):
    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).encode().lower().decode()
    holders = collections.defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(r[0])
    gone = lambda d, x: len(holders.get(key(x), ())) >= 3 and d != max((y for y in holders[key(x)] if y is not None), default=None)
    want = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not gone(r[0], x)]
        want.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    for cells in (1 << 31, 1 << 20, 0):
        got = line_dedup.line_dedup(docs, max_cells=cells)
        assert got.columns == [*docs.columns, "n_lines_", "n_dropped"]
        assert sorted(((r.doc_id, r["n_lines_"], r.n_dropped, r.text or "") for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert any(x[2] for x in want)
    assert line_dedup.line_dedup(none).count() == 0


def test_sentencepieces(docs, rows, none, spark):
    import struct

    vocabulary = sentencepieces.Vocabulary(model_path())
    texts = {t for t in (r[1] for r in rows)} | {r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    lib = vocabulary.library
    got = {r.doc_id: r for r in sentencepieces.encode_decode(table, model_path(), keep_ids=True).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    assert not any(r.n_library for r in got.values())
    assert sentencepieces.encode_decode(docs, model_path()).count() == len(rows)
    assert sentencepieces.encode_decode(none, model_path()).count() == 0


def test_sentencepieces_take_the_library_where_they_differ(monkeypatch):
    """An agenda that merges nothing is found out word by word."""
    import pyarrow as pa

    monkeypatch.setattr(sentencepieces.Vocabulary, "merge", lambda self, chunk: [self.bytes[b] for b in chunk.encode()])
    sentencepieces._words.cache_clear()
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2, 3], pa.int64()), "text": ["the the cat", " two  blanks ", None]})
    out = pa.Table.from_batches(sentencepieces._code(model_path(), True)([batch])).to_pydict()
    lib = sentencepieces.Vocabulary(model_path()).library
    assert out["ids"] == [lib.encode(t or "", add_bos=True, add_eos=True) for t in batch.column(1).to_pylist()]
    assert out["n_library"] == [3, 1, 0]
    sentencepieces._words.cache_clear()


def test_sentencepieces_go_through_a_batch_in_pieces(monkeypatch):
    """A batch of Spark's has 10,000 texts of any size; what is held of it at once is bounded, and a long text is alone at most with what follows it."""
    import pyarrow as pa

    held, encode_all = [], sentencepieces._Words.encode_all
    monkeypatch.setattr(sentencepieces._Words, "encode_all", lambda self, texts: held.append(sum(map(len, texts[1:]))) or encode_all(self, texts))
    texts = ["", None, *(f"word{i} and the rest of it, " * 2000 for i in range(60)), "long text " * 300_000, None, "the end", ""]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    out = pa.Table.from_batches(sentencepieces._code(model_path(), True)([batch, batch.slice(0, 0), batch.slice(1, 1)])).to_pydict()
    lib = sentencepieces.Vocabulary(model_path()).library
    assert out["doc_id"] == [*range(len(texts)), 1] and out["ids"] == [lib.encode(t or "", add_bos=True, add_eos=True) for t in [*texts, None]]
    assert max(held) < sentencepieces.PIECE and len(held) > 5


def test_sentencepieces_keep_frequent_words(monkeypatch):
    """A word that every text has is encoded once, however often the words met lately become the old ones; the rest of the memory turns over."""
    monkeypatch.setattr(sentencepieces, "MEMO_BYTES", 40_000)
    words = sentencepieces._Words(sentencepieces.Vocabulary(model_path()))
    met, encode = [], words.vocabulary.encode
    words.vocabulary.encode = lambda text: met.append(text) or encode(text)
    texts = [" ".join(["common", *(f"w{i}x{j}" for j in range(20))]) for i in range(60)]
    ids = [words.encode_all([t])[0][0] for t in texts]
    assert ids == [array("I", words.vocabulary.library.encode(t)).tobytes() for t in texts]
    assert met.count("common") == 1 and len(words) + len(words.old) < 400


def test_short_chunks_merge_as_by_the_agenda():
    vocabulary, rnd = sentencepieces.Vocabulary(model_path()), random.Random(3)
    alphabets = ["etaoinshr", "ab", "éüß漢字a", "▁the", "0123456789.,"]
    chunks = ["".join(rnd.choice(a) for _ in range(rnd.randint(0, 24))) for a in alphabets for _ in range(400)]
    assert [vocabulary.merged_short(c) for c in chunks] == [vocabulary.merged(c) for c in chunks]


def brute_fingerprint(t, n=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs):
    fps = sorted({fp for _, fp in pairs})
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    least = {}
    for d, fp in pairs:
        if d is not None:
            least[root(fp)] = min(d, least.get(root(fp), d))
    return {fp: least.get(root(fp)) for fp in fps}


def test_simhash(docs, rows, none, spark):
    small = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for table, pairs in ((docs, [(r[0], r[1]) for r in rows]), (spark.createDataFrame(small, "doc_id long, text string"), small)):
        marked = [(d, brute_fingerprint(t)) for d, t in pairs]
        groups = brute_components(marked)
        want = sorted(((d, f"{fp:016x}", groups[fp]) for d, fp in marked), key=repr)
        assert bag(simhash.simhash_groups(table), "doc_id", "fingerprint", "component_id") == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    marked = [(r[0], brute_fingerprint(r[1])) for r in rows]
    groups = brute_components(marked)
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(d) for d in {groups[fp] for _, fp in marked})
    assert simhash.simhash_groups(none).count() == 0 and simhash.keep_one(none).count() == 0


@pytest.mark.parametrize("hot, share, broadcast", [(20_000, 64, 100_000), (40, 1, 100_000), (3, 1, 0)])
def test_simhash_finds_every_close_pair(spark, monkeypatch, hot, share, broadcast):
    """Also when keys are taken for hot and go down the levels, to the last one with 3."""
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "SHARE", share)
    monkeypatch.setattr(simhash, "HOT_BROADCAST", broadcast)
    rnd = random.Random(3)
    centre = [rnd.getrandbits(64) for _ in range(40)]
    fps = set(centre)
    for c in centre[:30]:
        for _ in range(12):
            f = c
            for b in rnd.sample(range(64), rnd.randint(1, 4)):
                f ^= 1 << b
            fps.add(f)
    crowd = rnd.getrandbits(64)  # a large group under few keys
    fps |= {crowd ^ (1 << a) ^ (1 << b) for a in range(0, 64, 2) for b in range(a)}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    pairs = list(enumerate(fps))
    got = simhash.group_fingerprints(spark.createDataFrame([(d, signed(f)) for d, f in pairs], "doc_id long, fp long"))
    want = brute_components(pairs)
    assert {r.fp: r.component_id for r in got.collect()} == {signed(f): want[f] for f in fps}


@pytest.mark.parametrize("level", range(simhash.LEVELS))
def test_level_keys(level):
    """On every level each pair with up to 4 differing bits shares a key, wherever the bits are."""
    import numpy as np

    rnd = random.Random(level)
    for k in range(300):
        x = rnd.getrandbits(64)
        y = x
        at, width = simhash.SEGMENTS[k % 3]
        for b in rnd.sample(range(64), rnd.randint(1, 4)) if k % 2 else rnd.sample(range(at, at + width), 3) + [rnd.randrange(64)]:
            y ^= 1 << b
        which, keys = simhash.level_keys(np.array([x, y], np.uint64), level)
        assert set(keys[which == 0].tolist()) & set(keys[which == 1].tolist())


def test_golay_keys():
    import numpy as np

    rnd = random.Random(5)
    for _ in range(300):
        x = rnd.getrandbits(23)
        y = x
        for b in rnd.sample(range(23), rnd.randint(0, 2)):
            y ^= 1 << b
        keys, n = simhash.golay_keys(np.array([x, y], np.uint32))
        assert set(keys[0][: n[0]].tolist()) & set(keys[1][: n[1]].tolist())


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(7, 7), (7, None)]
    got = {r.node: r.label for r in components(spark.createDataFrame([Row(a=a, b=b) for a, b in edges], "a long, b long")).collect()}
    near = collections.defaultdict(set)
    for a, b in edges:
        if b is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    seen = {}
    for s in sorted(near):
        if s not in seen:
            todo = [s]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen[x] = s
                    todo += near[x]
    assert got == seen


def test_positions(spark):
    df = spark.createDataFrame([(x,) for x in ["b", None, "a", "Z", "é"]], "s string")
    assert {r.s: r.position for r in positions(df, df["s"].asc_nulls_last()).collect()} == {"Z": 0, "a": 1, "b": 2, "é": 3, None: 4}


def test_line_dedup_with_filters_in_shards(spark):
    """Filters too large to broadcast stay in their shards: few lines but the repeated ones are suspected, and the result is the same."""
    text = F.expr("array_join(concat(transform(sequence(1, 12), i -> concat('a line of its own ', id, ' and ', i)), array('every document has this line, too'), if(id % 3 = 0, array('EVERY third one has this line  '), array()), if(id = 7, array(), array('short'))), '\n')")
    docs = spark.range(0, 20_000, numPartitions=4).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit(1).alias("N_lines")).unionAll(spark.createDataFrame([(None, None, 2), (3, "", 2)], "doc_id long, text string, N_lines int"))
    _, each = line_dedup._sharded(docs, line_dedup.CELLS * 280_000, 20, "n_lines_", "uid")
    repeated = 20_000 + 6_667
    assert repeated <= each.count() < repeated + 0.03 * 240_000
    shared, sharded = (line_dedup.line_dedup(docs, max_cells=cells) for cells in (line_dedup.MAX_CELLS, 1 << 20))
    assert sharded.columns == shared.columns == ["doc_id", "text", "N_lines", "n_lines_", "n_dropped"]
    assert sharded.exceptAll(shared).count() == shared.exceptAll(sharded).count() == 0
    assert sharded.agg(F.sum("n_dropped")).first()[0] == 19_999 + 6_666
