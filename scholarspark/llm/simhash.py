"""Near duplicates by SimHash, with the keys of a Golay code."""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import components, cut, fresh, written

#: The generator polynomial of the perfect binary [23, 12, 7] Golay code (fixed value).
GENERATOR = 0b101011100011
#: Where the three segments of a fingerprint begin, and their widths; each is read as a word of 23 bits.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
BLOCK = 1 << 15  # hashes that are counted at once
LAGS = 16  # groups up to this size are compared pair by pair
#: A key with over HOT fingerprints, as counted on one in SHARE of them, is left to the next level. Only balance depends on these values.
HOT, SHARE, LEVELS = 20_000, 64, 3
#: The second set of segments begins this many bits further, round the end.
TURN = 11
HOT_BROADCAST = 100_000  # hot keys, of 8 bytes each


def fingerprint(text: str | None, words: int = 4) -> int:
    """64 bits; a bit is 1 if over half of the shingles' hashes have it."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(tokens))
    spans = zip(starts[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist())
    digest, n = xxhash.xxh64_intdigest, len(tokens) - k + 1
    ones = np.zeros(64, np.int64)
    while len(h := np.fromiter((digest(line[a:b], 42) for a, b in itertools.islice(spans, BLOCK)), np.uint64)):
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _fingerprints(words: int, schema: pa.Schema, text_at: int, keep_text: bool):
    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column(text_at)], np.uint64).view(np.int64)
            kept = [c for i, c in enumerate(batch.columns) if keep_text or i != text_at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found)], schema=schema)

    return run


@functools.cache
def _tables():
    """(remainders of each byte at each of three places, error patterns by remainder): up to six patterns that turn a word with that remainder into a codeword, of weight up to four."""

    def remainder(word: int) -> int:
        for shift in range(11, -1, -1):
            if word >> (shift + 11) & 1:
                word ^= GENERATOR << shift
        return word

    one = [remainder(1 << i) for i in range(23)]
    by_byte = np.zeros((3, 256), np.uint32)
    for place in range(3):
        for byte in range(256):
            for bit in range(8):
                if byte >> bit & 1 and 8 * place + bit < 23:
                    by_byte[place, byte] ^= one[8 * place + bit]
    patterns: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in itertools.combinations(range(23), weight):
            patterns[functools.reduce(lambda a, b: a ^ one[b], bits, 0)].append(sum(1 << b for b in bits))
    assert max(map(len, patterns)) == 6
    table, count = np.zeros((2048, 6), np.uint32), np.array([len(p) for p in patterns])
    for i, p in enumerate(patterns):
        table[i] = (p + [p[0]] * 6)[:6]
    return by_byte, table, count


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words of 23 bits: the indices of all codewords within distance 4 (n x 6, padded) and how many there are. Words that differ in at most 2 bits share one."""
    by_byte, table, count = _tables()
    rest = by_byte[0, words & 255] ^ by_byte[1, words >> 8 & 255] ^ by_byte[2, words >> 16]
    return (words[:, None] ^ table[rest]) >> 11, count[rest]


def fingerprint_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, key) for all keys. With up to 4 differing bits in three segments, some two segments have up to 2 together; so two such fingerprints share a key of that pair."""
    keys = [golay_keys((fps >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.uint32)) for at, width in SEGMENTS]
    which, found = [], []
    for pair, (i, j) in enumerate(itertools.combinations(range(3), 2)):
        for a, b in itertools.product(range(6), range(6)):
            has = np.flatnonzero((keys[i][1] > a) & (keys[j][1] > b))
            which.append(has)
            found.append(pair << 24 | keys[i][0][has, a].astype(np.int64) << 12 | keys[j][0][has, b])
    return np.concatenate(which), np.concatenate(found)


def narrow_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, key) for keys of 33 bits and more, which split hot ones of fingerprint_keys. With up to 4
    differing bits, either no segment has over 2 of them, and all three have a common codeword; or one has 3 or 4, and of
    the two others one is equal and one has a common codeword. Different keys may meet by chance, which costs a comparison."""
    words = [(fps >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.uint32) for at, width in SEGMENTS]
    keys = [golay_keys(w) for w in words]
    which, found = [], []

    def add(has: np.ndarray, kind: int, *parts: np.ndarray) -> None:
        out = np.full(len(has), kind, np.uint64)
        for p in parts:
            out = (out ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        which.append(has)
        found.append(out.view(np.int64))

    for abc in itertools.product(range(6), repeat=3):
        has = np.flatnonzero(np.logical_and.reduce([k[1] > x for k, x in zip(keys, abc)]))
        add(has, 0, *(k[0][has, x] for k, x in zip(keys, abc)))
    for i, j in itertools.permutations(range(3), 2):
        for b in range(6):
            has = np.flatnonzero(keys[j][1] > b)
            add(has, 3 * i + j + 1, words[i][has], keys[j][0][has, b])
    return np.concatenate(which), np.concatenate(found)


def level_keys(fps: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of two segments, then narrow ones, then narrow ones of segments that begin elsewhere. On each level any two fingerprints with up to 4 differing bits share one."""
    if level == 0:
        return fingerprint_keys(fps)
    turned = fps if level == 1 else fps >> np.uint64(TURN) | fps << np.uint64(64 - TURN)
    return narrow_keys(turned)


def _spread(level: int):
    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), 5_000):
                some = fps[at : at + 5_000]
                which, keys = level_keys(some.view(np.uint64), level)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(some[which])], names=["key", "fp"])

    return run


def _tree(fps: np.ndarray, bits: int):
    """Links that connect whatever links of up to `bits` differing bits connect: each fingerprint is reached once."""
    left = np.sort(fps)
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(left ^ at) <= bits
            if near.any():
                yield from ((at, x) for x in left[near])
                front.extend(left[near])
                left = left[~near]


def _links(bits: int):
    """For mapInArrow over (key, fp) sorted by key: links (a, b) between fingerprints that share a key and differ in up to `bits` bits."""

    def linked(keys: np.ndarray, fps: np.ndarray):
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(keys)]]))
        a, b = [], []
        small = np.repeat(sizes <= LAGS, sizes)
        sk, sf = keys[small], fps[small]
        for lag in range(1, LAGS):
            same = np.flatnonzero(sk[lag:] == sk[:-lag])
            if not len(same):
                break
            near = same[np.bitwise_count(sf[same] ^ sf[same + lag]) <= bits]
            a.append(sf[near])
            b.append(sf[near + lag])
        for at, n in zip(starts[sizes > LAGS], sizes[sizes > LAGS]):
            if pairs := list(_tree(fps[at : at + n], bits)):
                x, y = np.array(pairs, np.uint64).T
                a.append(x)
                b.append(y)
        x, y = (np.concatenate(v) if v else np.empty(0, np.uint64) for v in (a, b))
        x, y = np.unique(np.stack([x.view(np.int64), y.view(np.int64)]), axis=1) if len(x) else (np.empty(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    def run(batches):
        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            whole = np.searchsorted(keys, keys[-1]) if len(keys) else 0  # the last key may go on
            if whole > 200_000:
                yield linked(keys[:whole], fps[:whole])
                keys, fps = keys[whole:], fps[whole:]
        if len(keys):
            yield linked(keys, fps)

    return run


def with_fingerprints(docs: DataFrame, name: str, words: int = 4, keep_text: bool = True) -> DataFrame:
    """docs with the fingerprint of text as last column, under `name`; without text if not asked for."""
    kept = [f for f in docs.schema.fields if keep_text or f.name != "text"]
    schema = T.StructType([*kept, T.StructField(name, T.LongType())])
    return docs.mapInArrow(_fingerprints(words, to_arrow_schema(schema), docs.columns.index("text"), keep_text), schema)


def fingerprint_links(fps: DataFrame, bits: int = 4) -> DataFrame:
    """For fps(fp), all distinct: links (a, b) that connect what all pairs with up to `bits` differing bits connect.

    Keys that a sample shows to be hot are taken out before the shuffle; their fingerprints go on to the next level.
    """
    parts = []
    for level in range(LEVELS):
        spread = lambda df: df.mapInArrow(_spread(level), "key bigint, fp bigint")  # noqa: B023, E731
        keyed, hot, n_hot = spread(fps), None, 0
        if level < LEVELS - 1:
            few = fps.where(F.pmod(F.xxhash64("fp"), F.lit(SHARE)) == 0)
            hot = cut(spread(few).groupBy("key").count().where(F.col("count") * SHARE > HOT).select("key"))
            n_hot = hot.count()
        if n_hot:
            hot = F.broadcast(hot) if n_hot <= HOT_BROADCAST else hot
            fps = cut(keyed.join(hot, "key", "left_semi").select("fp").distinct())
            keyed = keyed.join(hot, "key", "left_anti")
        parts.append(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_links(bits), "a bigint, b bigint"))
        if not n_hot:
            break
    return functools.reduce(DataFrame.unionAll, parts).distinct()


def group_fingerprints(fps: DataFrame, bits: int = 4) -> DataFrame:
    """From fps(doc_id, fp): one row (fp, component_id) for each distinct fingerprint."""
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(fingerprint_links(distinct.select("fp"), bits))
    grouped = cut(distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    ids = cut(grouped.groupBy("label").agg(F.min("least").alias("component_id")))  # kept first, so that the join can split a large component
    return grouped.join(ids, "label").select("fp", "label", "component_id")


def simhash_groups(docs: DataFrame, words: int = 4, bits: int = 4) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, fingerprint (16 lowercase hex digits), component_id.

    Fingerprints with up to `bits` (at most 4) differing bits are linked; component_id is the smallest doc_id that
    links reach. null and wordless texts have fingerprint zero, which is linked like any other. Rows without doc_id
    take part; component_id is null only if the whole component has no id. Other columns are ignored.

    Equal fingerprints are made one before any search, so copies cost nothing. Each distinct fingerprint is
    decoded to its Golay keys (some 84); under a key all links are checked, and a large group hands on only
    the links of a tree that connects the same fingerprints. The fingerprints of keys too hot for one task get longer
    keys instead, of three segments' codewords (level_keys). The links then meet in component rounds.
    """
    fps = cut(with_fingerprints(docs.select("doc_id", "text"), "fp", words, keep_text=False))
    found = group_fingerprints(fps, bits).select("fp", "component_id")
    return fps.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 4, bits: int = 4) -> DataFrame:
    """docs(doc_id, text, ...) with one row of each component: that with the smallest doc_id (null last), of several the one read first. Columns as in docs."""
    fp, uid = fresh(docs, "__fp"), fresh(docs, "__uid")
    held = written(with_fingerprints(docs, fp, words).withColumn(uid, F.monotonically_increasing_id()))
    narrow = held.select(F.col("doc_id").alias("doc_id"), F.col(fp).alias("fp"), F.col(uid).alias("uid"))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")
    per_fp = narrow.groupBy("fp").agg(F.min(first).alias("first"))
    stay = cut(per_fp).join(group_fingerprints(narrow, bits), "fp").groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.uid").alias(uid))
    return held.join(stay, uid, "left_semi").select(docs.columns)
