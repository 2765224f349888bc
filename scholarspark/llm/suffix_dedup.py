"""Repeated byte strings, by suffix arrays built with two-stage sorting."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, dealt, written

#: Bytes of the grams whose hashes deal windows out. A key that has over MOST bytes of different pieces is dealt out again by the next, longer grams; the last are whole windows.
GRAMS = (50, 150, 190)
MOST = 1 << 20
CHUNK = 1 << 19  # window starts that a task works on at once
ROWS = 1000  # texts that a task lays out at once
BLOCK = 1 << 20  # bytes of the texts that get one suffix array, unless a single key has more
LONGEST = 512  # windows of a run; longer ones, which only periodic texts have, are several
SEEN = 500_000  # digests that a task remembers
HOT_BROADCAST = 100_000  # hot keys, of 8 bytes each
_RANDOM = np.random.RandomState(11)
_BYTE = _RANDOM.randint(1, 1 << 63, 256, np.int64).astype(np.uint64)
_ODD = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < n."""
    out = np.empty(n, np.uint64)
    out[0], step, at = 1, base, 1
    while at < n:
        m = min(at, n - at)
        out[at : at + m] = out[:m] * np.uint64(step)
        at, step = at + m, step * step & (2**64 - 1)
    return out


class _Hasher:
    """Hashes of all grams of a byte array, and the least hash within each window."""

    def __init__(self, size: int, length: int, gram: int):
        self.up, self.down = _powers(_ODD, size), _powers(pow(_ODD, -1, 2**64), size)
        self.length, self.gram = length, gram
        self.grams = length - gram + 1  # grams in a window

    def hashes(self, data: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * self.up[: len(data)], out=sums[1:])
        h = (sums[self.gram :] - sums[: -self.gram]) * self.down[: len(data) - self.gram + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ h >> np.uint64(32)

    def least(self, h: np.ndarray) -> np.ndarray:
        """Sliding minimum over self.grams hashes, from minima that run forwards and backwards within blocks."""
        w, n = self.grams, len(h)
        padded = np.full(-(-n // w) * w, np.uint64(2**64 - 1))
        padded[:n] = h
        rows = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def _strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of strings without null, and where each begins and the last ends."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cut_runs(data: np.ndarray, at: np.ndarray, hasher: _Hasher):
    """For texts that lie in data from at[i] to at[i + 1]: (text, p, n, h, again) of the runs of windows with the same least hash; again if a run has that hash at two places."""
    length = hasher.length
    inside = np.zeros(len(data) + 1, np.int8)  # +1 where windows within a text begin, -1 after the last
    long = np.flatnonzero(np.diff(at) >= length)
    np.add.at(inside, at[long], 1)
    np.add.at(inside, at[long + 1] - length + 1, -1)
    ok = np.cumsum(inside, dtype=np.int8)[:-1].astype(bool)
    for c in range(0, len(data) - length + 1, CHUNK):
        h = hasher.hashes(data[c : c + CHUNK + length - 1])
        m = hasher.least(h)
        good = ok[c : c + len(m)]
        if not good.any():
            continue
        new = good.copy()
        new[1:] &= (m[1:] != m[:-1]) | ~good[:-1]
        begins = at[long] - c
        new[begins[(begins >= 0) & (begins < len(m))]] = True
        p = np.flatnonzero(new)
        stop = np.flatnonzero(good & ~np.concatenate([good[1:], [False]]))  # last windows of texts
        end = np.minimum(np.concatenate([p[1:], [len(m)]]) - 1, stop[np.searchsorted(stop, p)])
        parts = (end - p) // LONGEST + 1
        if (parts > 1).any():
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            p, end = np.repeat(p, parts) + nth * LONGEST, np.repeat(end, parts)
            end = np.minimum(end, p + LONGEST - 1)
        grams = sliding_window_view(h, hasher.grams)
        again = np.empty(len(p), bool)
        for i in range(0, len(p), 20_000):
            first = p[i : i + 20_000] + grams[p[i : i + 20_000]].argmin(axis=1)
            last = end[i : i + 20_000] + hasher.grams - 1 - grams[end[i : i + 20_000]][:, ::-1].argmin(axis=1)
            again[i : i + 20_000] = first != last
        text = np.searchsorted(at, p + c, "right") - 1
        yield text, p + c - at[text], (end - p + 1).astype(np.int32), m[p].view(np.int64), again


def _runs(length: int):
    """For mapInArrow over (k1, k2, text): (k1, k2, p, n, h, again) of the runs of each text; of equal texts of a task, of one only."""

    def run(batches):
        hasher, seen = _Hasher(CHUNK + length, length, GRAMS[0]), set()
        for batch in batches:
            new = []
            for i, k in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if k not in seen:
                    seen.add(k)
                    new.append(i)
            seen = set() if len(seen) > SEEN else seen
            for i in range(0, len(new), ROWS):
                some = batch.take(pa.array(new[i : i + ROWS], pa.int64()))
                for text, p, n, h, again in _cut_runs(*_strings(some.column(2)), hasher):
                    text = pa.array(text)
                    yield pa.RecordBatch.from_arrays([some.column(0).take(text), some.column(1).take(text), pa.array(p), pa.array(n), pa.array(h), pa.array(again)], names=["k1", "k2", "p", "n", "h", "again"])

    return run


class _Pieces:
    """Rows (key, d1, d2, k1, k2, p, n, piece): the bytes of runs, with their digest. With bytes: of equal pieces one only; without: all, and piece null."""

    SCHEMA = pa.schema([("key", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("p", pa.int64()), ("n", pa.int32()), ("piece", pa.binary())])
    DDL = "key bigint, d1 bigint, d2 bigint, k1 bigint, k2 bigint, p bigint, n int, piece binary"

    def __init__(self, with_bytes: bool):
        self.with_bytes, self.seen = with_bytes, set()
        self.rows, self.size = [], 0

    def add(self, key: int, k1: int, k2: int, p: int, n: int, piece: bytes) -> None:
        digest = xxhash.xxh3_128_digest(piece)
        if self.with_bytes:
            if digest in self.seen:
                return
            self.seen.add(digest)
        self.rows.append((key, digest, k1, k2, p, n, piece if self.with_bytes else None))
        self.size += 80 + len(piece) * self.with_bytes

    def batch(self) -> pa.RecordBatch:
        digests = np.frombuffer(b"".join(r[1] for r in self.rows), "<i8")
        key, _, k1, k2, p, n, piece = zip(*self.rows) if self.rows else ((),) * 7
        out = [key, digests[::2], digests[1::2], k1, k2, p, n, piece]
        self.rows, self.size = [], 0
        if len(self.seen) > SEEN:
            self.seen = set()
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, self.SCHEMA)], schema=self.SCHEMA)


def _pieces(length: int, with_bytes: bool):
    """For mapInArrow over (k1, k2, text, runs): the pieces of the runs; of neighbouring equal texts, of one only."""

    def run(batches):
        out, last = _Pieces(with_bytes), (None, None)
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.ones(len(k1), bool)
            new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            new[:1] = [(a, b) != last for a, b in zip(k1[:1], k2[:1])]
            last = (k1[-1], k2[-1]) if len(k1) else last
            batch = batch.filter(pa.array(new))
            for i in range(0, len(batch), ROWS):
                some = batch.slice(i, ROWS)
                for k1, k2, text, runs in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), some.column(2), some.column(3).to_pylist()):
                    data = text.as_buffer().to_pybytes()
                    for r in runs:
                        out.add(r["h"], k1, k2, r["p"], r["n"], data[r["p"] : r["p"] + r["n"] + length - 1])
                    if out.size > 1 << 23:
                        yield out.batch()
        yield out.batch()

    return run


def _slices(length: int, gram: int, with_bytes: bool):
    """For mapInArrow over pieces: pieces of them, keyed by longer grams."""

    def run(batches):
        hasher, out = _Hasher(CHUNK + length, length, gram), _Pieces(with_bytes)
        for batch in batches:
            data, at = _strings(batch.column(7))
            k1, k2, start = (batch.column(i).to_pylist() for i in (3, 4, 5))
            for text, p, n, h, _ in _cut_runs(data, at, hasher):
                for t, a, m, key in zip(text.tolist(), p.tolist(), n.tolist(), h.tolist()):
                    begin = int(at[t]) + a
                    out.add(key, k1[t], k2[t], start[t] + a, m, data[begin : begin + m + length - 1].tobytes())
                    if out.size > 1 << 24:
                        yield out.batch()
        yield out.batch()

    return run


def suffix_array(data: np.ndarray, wanted: np.ndarray, length: int) -> np.ndarray:
    """The places where `wanted`, in the order of the strings of `length` bytes there. data ends with a byte 255 after length zeros.

    A suffix is small if it is smaller than its successor, else large. Small ones are sorted directly. A large one
    follows from its successor, which stands in an earlier bucket or earlier in its own: the buckets (by first byte)
    are scanned in order, and each suffix found puts its large predecessor next into the bucket of that one's first
    byte; in a bucket the large ones stand before the small ones. Places not wanted are left out as far as no wanted
    large suffix leads to them.
    """
    n = len(data)
    step = np.sign(data[1:].astype(np.int16) - data[:-1])
    differs = np.where(step != 0, np.arange(n - 1), n)
    ahead = np.minimum.accumulate(differs[::-1])[::-1]  # where the next change is
    small = np.zeros(n, bool)
    small[:-1] = step[np.minimum(ahead, n - 2)] > 0
    next_small = np.minimum.accumulate(np.where(small, np.arange(n), n)[::-1])[::-1]

    ends = np.flatnonzero(wanted[:-1] & ~wanted[1:])
    span = np.zeros(n + 1, np.int32)
    np.add.at(span, ends + 1, 1)
    np.add.at(span, next_small[ends] + 1, -1)
    used = wanted | (np.cumsum(span)[:n] > 0)

    direct = np.flatnonzero(used & small)
    strings = sliding_window_view(data, length)[direct].view(f"S{length}").ravel()
    direct = direct[np.argsort(strings, kind="stable")]
    large = used & ~small
    arrived: dict[int, list[np.ndarray]] = {}
    found = []
    firsts = data[direct]
    for c in range(256):
        mine = direct[np.searchsorted(firsts, c) : np.searchsorted(firsts, c, "right")]
        front = np.concatenate(arrived.pop(c, [mine[:0]]))
        row = []
        while len(front):  # a run of one byte leads to itself
            row.append(front)
            before = front - 1
            front = before[(before >= 0) & large[before] & (data[before] == c)]
        row = np.concatenate([*row, mine])
        if not len(row):
            continue
        found.append(row)
        before = row - 1
        before = before[(before >= 0) & large[before]]
        first = data[before]
        before, first = before[first > c], first[first > c]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        for part in np.split(before, np.flatnonzero(np.diff(first)) + 1) if len(before) else ():
            arrived.setdefault(int(data[part[0]]), []).append(part)
    order = np.concatenate(found) if found else direct
    return order[wanted[order]]


def common_prefixes(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """How many bytes each suffix of `order` shares with the one before it, at most `length`; below 8, 0 is said."""
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    words = sliding_window_view(data, 8)
    eight = lambda x: np.ascontiguousarray(words[x]).view(np.uint64).ravel()
    heads = eight(order)
    close = np.flatnonzero(heads[1:] == heads[:-1]) + 1
    windows = sliding_window_view(data, length)
    for i in range(0, len(close), 20_000):
        at = close[i : i + 20_000]
        differ = windows[order[at]] != windows[order[at - 1]]
        out[at] = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    return out


def repeated_windows(pieces: list[bytes], sizes: list[int], length: int) -> list[np.ndarray]:
    """For each of the distinct pieces, whether each of its first sizes[i] windows also starts elsewhere in them."""
    at = np.cumsum([0, *map(len, pieces)])
    data = np.frombuffer(b"".join(pieces) + bytes(length) + b"\xff", np.uint8)
    wanted = np.zeros(len(data), bool)
    for a, n in zip(at, sizes):
        wanted[a : a + n] = True
    order = suffix_array(data, wanted, length)
    same = np.flatnonzero(common_prefixes(data, order, length) >= length)
    twice = np.zeros(len(data), bool)
    twice[order[same]] = True
    twice[order[same - 1]] = True
    return [twice[a : a + n] for a, n in zip(at, sizes)]


def _spans(length: int):
    """For mapInArrow over pieces sorted by key: (k1, k2, start, stop) of what also starts in another piece, or elsewhere in this."""

    def block(held):
        out = [[], [], [], []]
        for (k1, k2, p, _, _), twice in zip(held.values(), repeated_windows([r[4] for r in held.values()], [r[3] for r in held.values()], length)):
            edges = np.flatnonzero(np.diff(twice.astype(np.int8), prepend=0, append=0)).tolist()
            for a, b in zip(edges[::2], edges[1::2]):
                for o, v in zip(out, (k1, k2, p + a, p + b - 1 + length)):
                    o.append(v)
        return pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=["k1", "k2", "start", "stop"])

    def run(batches):
        held, size, last = {}, 0, None
        for batch in batches:
            for key, d1, d2, *row in zip(*(batch.column(i).to_pylist() for i in range(8))):
                if size > BLOCK and key != last:
                    yield block(held)
                    held, size = {}, 0
                last = key
                if (d1, d2) not in held:  # several tasks may have the same piece
                    held[d1, d2] = row
                    size += len(row[4])
        if held:
            yield block(held)

    return run


def _cut_out(batches):
    """For mapInArrow over (doc_id, text, spans): the spans merged, and the bytes outside them."""
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for batch in batches:
        n_bytes, merged, kept = [], [], []
        for text, spans in zip(batch.column(1), batch.column(2).to_pylist()):
            data = text.as_buffer().to_pybytes()
            runs: list[list[int]] = []
            for s in sorted((s["start"], s["stop"]) for s in spans or ()):
                if runs and s[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s[1])
                else:
                    runs.append(list(s))
            edges = [0, *(x for r in runs for x in r), len(data)]
            n_bytes.append(len(data))
            merged.append([{"start": a, "stop": b} for a, b in runs])
            kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(merged, spans_type), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


def repeated_spans(texts: DataFrame, length: int, most: int = MOST) -> DataFrame:
    """(k1, k2, start, stop) of what repeats in dealt texts(k1, k2, text, runs, copied).

    The bytes of a piece come from the first of its owners among the texts without copies; texts with copies, which
    lie together, give theirs besides, once for each task."""
    held = texts.where("runs is not null")
    single, several_of = held.where("not copied").select("k1", "k2", "text", "runs"), held.where("copied").select("k1", "k2", "text", "runs")
    narrow = lambda source, step: source.mapInArrow(step, _Pieces.DDL).drop("piece")
    found = written(narrow(single, _pieces(length, False)).withColumn("copied", F.lit(False)).unionAll(narrow(several_of, _pieces(length, False)).withColumn("copied", F.lit(True))))
    spans, level = [], 0
    while True:
        own = F.when(~F.col("copied"), F.struct("k1", "k2", "p", "n"))
        each = cut(found.groupBy("key", "d1", "d2").agg(F.count("*").alias("times"), (F.max("n") + length - 1).alias("size"), F.min(own).alias("own")))
        # A piece with several owners is repeated as a whole. Sums are kept before the join, so that it can split frequent pieces.
        several = found.join(each.where("times > 1").select("d1", "d2"), ["d1", "d2"])
        spans.append(several.select("k1", "k2", F.col("p").alias("start"), (F.col("p") + F.col("n") + length - 1).alias("stop")))
        if level == 0:
            first = each.where("own is not null").select("own.k1", "own.k2", F.struct("own.p", "own.n", F.col("key").alias("h")).alias("run")).groupBy("k1", "k2").agg(F.collect_list("run").alias("runs"))
            pieces = single.drop("runs").join(first, ["k1", "k2"]).select("k1", "k2", "text", "runs").unionAll(several_of).mapInArrow(_pieces(length, True), _Pieces.DDL)
        else:
            pieces = source.mapInArrow(_slices(length, gram, True), _Pieces.DDL)
        hot = cut(each.groupBy("key").agg(F.sum("size").alias("size")).where(F.col("size") > most).select("key"))
        n_hot = hot.count() if level < len(GRAMS) else 0
        if n_hot:
            hot = F.broadcast(hot) if n_hot <= HOT_BROADCAST else hot
            pieces = written(pieces)
            source, pieces = pieces.join(hot, "key", "left_semi"), pieces.join(hot, "key", "left_anti")
        spans.append(pieces.repartition("key").sortWithinPartitions("key").mapInArrow(_spans(length), "k1 bigint, k2 bigint, start bigint, stop bigint"))
        if not n_hot:
            return functools.reduce(DataFrame.unionAll, spans)
        level += 1
        gram = (*GRAMS, length)[level]
        found = written(narrow(source, _slices(length, gram, False)).withColumn("copied", F.lit(True)))


def suffix_dedup(docs: DataFrame, length: int = 200, most: int = MOST) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_bytes, spans (array of start, stop in bytes), kept (binary).

    spans are the maximal runs of bytes that lie in a string of `length` bytes which starts at another place too, in
    the same or another document, as the documents come in; kept is the rest, which need not be whole characters. null counts
    as empty. Rows with the same text are documents of their own, and so lose all if they are long enough, whatever
    their doc_id. Other columns are ignored.

    Texts go by a key of their content; equal ones are settled by counting them. Strings of `length` bytes are dealt
    out by the least hash of their grams, which equal strings share. A run of neighbouring windows with one least
    hash is one row. Hashes that occur once can't be repeats, so only the bytes of the other runs are shuffled, of
    equal runs those of one, and each task builds suffix arrays of blocks of them: small suffixes sorted,
    large ones induced, adjacent common prefixes compared. A run with several owners is repeated as a whole. A hash under
    which over `most` bytes would gather is dealt out again by the least hash of longer grams, at last of whole
    windows, of which only different ones remain. Texts are shuffled once, with their runs, and lie by their key then.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.xxhash64(F.lit(1), text).alias("k1"), F.xxhash64(F.lit(2), text, F.lit(3)).alias("k2"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    long = keyed.where(F.octet_length("text") >= length)
    runs = written(long.select("k1", "k2", "text").mapInArrow(_runs(length), "k1 bigint, k2 bigint, p bigint, n int, h bigint, again boolean"))
    often = runs.groupBy("h").agg(F.sum(F.when(F.col("again"), 2).otherwise(1)).alias("times")).where("times > 1").select("h")
    often = written(often)  # so that the join can split frequent hashes; straight after the sums it couldn't
    copied = long.groupBy("k1", "k2").agg(F.count("*").alias("times")).where("times > 1").select("k1", "k2", F.lit(None).alias("run"), F.lit(True).alias("copied"))
    found = runs.join(often, "h").select("k1", "k2", F.struct("p", "n", "h").alias("run"), F.lit(False).alias("copied")).unionAll(copied)
    marks = written(found.groupBy("k1", "k2").agg(F.collect_list("run").alias("runs"), F.max("copied").alias("copied")))
    texts = dealt(keyed.join(marks, ["k1", "k2"], "left").withColumn("copied", F.coalesce("copied", F.lit(False))), "k1", "k2")
    spans = repeated_spans(texts, length, most)
    per_doc = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    schema = "doc_id bigint, n_bytes bigint, spans array<struct<start: bigint, stop: bigint>>, kept binary"
    single = texts.where("not copied").join(per_doc, ["k1", "k2"], "left").select("doc_id", "text", "spans").mapInArrow(_cut_out, schema)
    n = F.octet_length("text").cast("long")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), n.alias("stop")))
    return single.unionAll(texts.where("copied").select("doc_id", n.alias("n_bytes"), whole.alias("spans"), F.lit(b"").alias("kept")))
