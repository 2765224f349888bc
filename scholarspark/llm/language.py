"""Language identification by prediction by partial matching (PPM)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Bytes of text from which a language is learned, and the documents they may come from. The bound of the training sample.
TRAIN_BYTES = 300_000
TRAIN_DOCS = 2_000
ORDER = 4  # bytes of the longest context
HELD_OUT = 5
#: Chosen documents up to this number (16 bytes each) are broadcast; for more, texts are shuffled to meet them.
BROADCAST_PICKED = 500_000
BROADCAST_LANGS = 10_000  # languages whose counts are broadcast


def held_out() -> Column:
    """Whether crc32 of doc_id as text leaves no remainder by HELD_OUT; a null id is as an empty text, so held out."""
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % HELD_OUT) == 0


def letters_of(text: Column) -> Column:
    """The text in lower case with one blank for each run of other characters than letters and marks: what a prediction sees."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")


def training_sample(docs: DataFrame, train_bytes: int = TRAIN_BYTES, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(lang, text): the lines of whole documents that aren't held out, in an order hashed from their ids, while the documents fit into train_bytes for each language.

    Texts over a tenth of train_bytes are passed over, so that none takes the place of many; a language that has no others is learned from the first of them. Of equal lines one is learned, and lines that several languages have are left out, for they tell nothing. A first count by language thins the rows so that about 4 * train_docs of a language meet in a window, which holds hashes and sizes only.
    """
    able = docs.where(~held_out() & F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "lang", "text")
    counts = cut(able.groupBy("lang").agg(F.count("*").alias("n")))
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_LANGS else counts  # so rows are thinned before they meet by language
    mixed = F.xxhash64(F.lit("train"), "doc_id", "text")
    unit = mixed.bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    size = F.octet_length("text")
    # Chosen by hash and size; the texts of those chosen are fetched afterwards.
    some = able.select("lang", mixed.alias("at"), size.alias("size"), unit.alias("unit")).join(counts, "lang").where(F.col("unit") < 4.0 * train_docs / F.col("n")).select("lang", "at", "size")
    order = Window.partitionBy("lang").orderBy("at", "size")
    small = some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= train_docs)
    short = small.withColumn("short", F.col("size") <= train_bytes / 10)
    sizes = F.sum(F.when(F.col("short"), F.col("size")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    picked = short.withColumn("so_far", sizes).withColumn("any", F.max("short").over(Window.partitionBy("lang"))).where((F.col("short") & (F.col("so_far") <= train_bytes)) | (~F.col("any") & (F.col("rank") == 1)))
    picked = cut(picked.select("lang", "at"))
    few = picked.count() <= BROADCAST_PICKED
    chosen = able.select("lang", "text", mixed.alias("at")).join(F.broadcast(picked) if few else picked, ["lang", "at"], "left_semi")
    lines = chosen.select("lang", F.explode(F.split("text", "\n")).alias("line")).select("lang", letters_of(F.col("line")).alias("line")).distinct()
    return lines.groupBy("line").agg(F.count("*").alias("n"), F.min("lang").alias("lang")).where("n = 1").select("lang", F.col("line").alias("text"))


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """The k bytes from each place, as one number."""
    n = len(data) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out << np.uint64(8) | data[i : i + n]
    return out


def _count(batches):
    """For mapInArrow over (lang, text): how often each context with its next byte occurs, for all orders."""
    for batch in batches:
        for lang in set(batch.column(0).to_pylist()):
            texts = [t for x, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if x == lang]
            for k in range(1, ORDER + 2):
                grams, n = np.unique(np.concatenate([_grams(np.frombuffer(t.encode(), np.uint8), k) for t in texts]), return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(grams)), "k": pa.array(np.full(len(grams), k, np.int32)), "gram": pa.array(grams.view(np.int64)), "n": pa.array(n.astype(np.int64))})


class Model:
    """Frozen context trees of all languages.

    For a language, a context that has been followed n times by d different bytes predicts a byte followed c times
    with c / (n + d) and escapes to the next shorter context with d / (n + d); contexts never met are passed over
    for nothing, and below the empty context all 256 bytes are alike. (No exclusion: the lengths are those of a
    code that may waste some room.)

    The length of a text is a sum over its grams of 1 to ORDER + 1 bytes. Without any, a byte costs 8 bits and the
    escape from the empty context. A gram that the language has gains what it is shorter than its last k - 1 bytes and
    the escape from its first k - 1; one that is followed by another byte costs the escape from itself. So a gram
    has a value for each language that has it, and for no other, and the tables grow with the sample.
    """

    def __init__(self, counts: pa.Table | list[tuple[str, int, int, int]]):
        if not isinstance(counts, pa.Table):
            schema = pa.schema([("lang", pa.string()), ("k", pa.int8()), ("gram", pa.int64()), ("n", pa.int64())])
            counts = pa.Table.from_pydict(dict(zip(schema.names, zip(*counts))) if counts else {x: [] for x in schema.names}, schema=schema)
        names = counts["lang"].combine_chunks().dictionary_encode()
        self.langs = sorted(names.dictionary.to_pylist())
        width, at = len(self.langs), {x: i for i, x in enumerate(self.langs)}
        lang_all = np.array([at[x] for x in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()]
        k_all, gram_all, n_all = counts["k"].to_numpy(), counts["gram"].to_numpy().view(np.uint64), counts["n"].to_numpy()
        self.levels: list[_Level] = []
        at_pair, own, gain = _Pairs(np.zeros(1, np.uint64), np.zeros(width, np.int64), np.arange(width)), np.full(width, 8.0), np.zeros(width)
        for k in range(1, ORDER + 2):
            mine = np.flatnonzero(k_all == k)
            order = mine[np.lexsort((lang_all[mine], gram_all[mine]))]
            gram, lang, n = gram_all[order], lang_all[order], n_all[order].astype(np.float64)
            keys, row = np.unique(gram, return_inverse=True)
            # For each gram of a language: where that language has its first and its last k - 1 bytes.
            head, tail = at_pair.find(gram >> np.uint64(8), lang), at_pair.find(gram & np.uint64((1 << (8 * (k - 1))) - 1), lang)
            total, kinds = np.bincount(head, n, len(own)), np.bincount(head, minlength=len(own))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(kinds > 0, np.log2((total + kinds) / kinds), 0.0)
            if k == 1:
                self.floor = 8 + escape  # of a byte, by language
            else:
                self.levels.append(_Level(k - 1, at_pair, width, gain + escape, escape))
            here = np.log2((total + kinds)[head] / n)
            at_pair, own, gain = _Pairs(keys, row, lang), here, here - escape[head] - own[tail]
        self.levels.append(_Level(ORDER + 1, at_pair, width, gain, None))

    def nbytes(self) -> int:
        """Bytes of the tables."""
        return sum(level.nbytes() for level in self.levels)

    def lengths(self, data: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Code lengths in bits under each language, of data, or of each of the texts that lie in data from at[i] to at[i + 1], in which case a row is a text. Many or long texts go in blocks, and a gram belongs to that in which it begins."""
        alone, width = at is None, len(self.langs)
        at = np.array([0, len(data)], np.int64) if alone else at
        total = np.diff(at)[:, None] * self.floor
        block = max(1 << 10, (1 << 18) // max(1, width))
        for c in range(0, len(data), block):
            part = data[c : c + block + ORDER]
            place = np.arange(c, min(c + block, len(data)))
            text = np.searchsorted(at, place, "right") - 1
            left = at[text + 1] - place  # bytes from there to the end of the text
            first, size = text[0], text[-1] - text[0] + 1
            for level in self.levels:
                begins = np.flatnonzero(left >= level.k)
                total[first : first + size] += level.values(_grams(part, level.k)[begins], text[begins] - first, size)
        for level in self.levels[:-1]:  # the last gram of a text isn't followed by a byte
            text = np.flatnonzero(np.diff(at) >= level.k)
            last = np.zeros(len(text), np.uint64)
            for i in range(level.k, 0, -1):
                last = last << np.uint64(8) | data[at[text + 1] - i]
            for i in range(0, len(text), block):
                some = slice(i, i + block)
                total[text[some]] -= level.values(last[some], np.arange(len(text[some])), len(text[some]), escapes=True)
        return total[0] if alone else total


class _Pairs:
    """Sorted pairs of a gram and a language that has it."""

    def __init__(self, keys: np.ndarray, row: np.ndarray, lang: np.ndarray):
        self.keys, self.row, self.lang = keys, row, lang
        self.wide = int(lang.max(initial=0)) + 1
        self.number = row * self.wide + lang

    def find(self, gram: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """Where pairs are that are there."""
        return np.searchsorted(self.number, np.searchsorted(self.keys, gram) * self.wide + lang)


class _Level:
    """Values of the grams of k bytes: a row of all languages for grams that at least one in FULL of them has, pairs of language and value for the others. So there are at most FULL times as many values as pairs."""

    FULL = 4

    def __init__(self, k: int, pairs: _Pairs, width: int, value: np.ndarray, escape: np.ndarray | None):
        self.k, self.width, self.index = k, width, _Index(pairs.keys)
        n = np.bincount(pairs.row, minlength=len(pairs.keys))
        full = n * self.FULL >= width
        self.full_at = np.where(full, np.cumsum(full) - 1, -1).astype(np.int32)
        wide = full[pairs.row] if len(pairs.row) else np.zeros(0, bool)
        self.starts = np.concatenate([[0], np.cumsum(np.where(full, 0, n))])
        self.lang = pairs.lang[~wide].astype(np.min_scalar_type(max(width, 1)))
        self.rows, self.pairs = [], []
        for v in (value, escape) if escape is not None else (value,):
            rows = np.zeros((int(full.sum()), width), np.float32)
            rows[self.full_at[pairs.row[wide]], pairs.lang[wide]] = v[wide]
            self.rows.append(rows)
            self.pairs.append(v[~wide].astype(np.float32))

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.full_at, self.starts, self.lang, *self.rows, *self.pairs, self.index.slot, self.index.keys))

    def values(self, grams: np.ndarray, text: np.ndarray, n_texts: int, escapes: bool = False) -> np.ndarray:
        """The sums of the grams' values (or escapes) for each text and language; texts ascend."""
        out = np.zeros((n_texts, self.width))
        found = self.index.find(grams)
        known = np.flatnonzero(found >= 0)
        row, text = found[known], text[known]
        at = self.full_at[row]
        wide = np.flatnonzero(at >= 0)
        if len(wide):
            mine = text[wide]
            begin = np.flatnonzero(np.diff(mine, prepend=-1))
            out[mine[begin]] += np.add.reduceat(self.rows[escapes][at[wide]], begin, axis=0, dtype=np.float64)
        if len(wide) < len(row):
            rest = at < 0
            row, text = row[rest], text[rest]
            size = self.starts[row + 1] - self.starts[row]
            pair = np.arange(size.sum()) + np.repeat(self.starts[row] - np.cumsum(size) + size, size)
            out += np.bincount(np.repeat(text, size) * self.width + self.lang[pair], self.pairs[escapes][pair], out.size).reshape(out.shape)
        return out


class _Index:
    """Sorted distinct numbers, found through an open hash table."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot = np.full(1 << bits, -1, np.int32)
        self.keys = np.concatenate([keys, [np.uint64(2**64 - 1)]]).astype(np.uint64)  # the last stands for an empty slot
        left, at = np.arange(len(keys), dtype=np.int32), self._start(keys)
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]  # of several for one slot the last stays
            lost = self.slot[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask

    def _start(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if it isn't there."""
        at = self._start(keys)
        found = self.slot[at]
        todo = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            found[todo] = self.slot[at[todo]]
            todo = todo[(found[todo] >= 0) & (self.keys[found[todo]] != keys[todo])]
        return found


def _predict(model):
    def run(batches):
        m: Model = model.value
        for batch in batches:
            letters = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            langs, scores = ["und"] * len(letters), np.zeros(len(letters))
            if m.langs and letters.any():
                texts = batch.column(2).filter(batch.column(3)).cast(pa.large_binary())
                at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
                bits = m.lengths(np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0])
                best = bits.argmin(axis=1)
                scores[letters] = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000.0)).sum(axis=1)
                for i, x in zip(np.flatnonzero(letters), best):
                    langs[i] = m.langs[x]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, train_bytes: int = TRAIN_BYTES, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """One row for each row of docs(doc_id, text, lang): doc_id, held_out, lang_pred, score.

    Learns from a bounded sample (see training_sample) of rows with text and lang that aren't held out; then whole
    texts (see letters_of) are scored under every language. lang_pred is the language with the shortest code (of
    equals the first by code point), score its probability if all languages were equally likely before. null
    texts, texts without a letter, and all texts if there is nothing to learn from, get `und` and 0. Rows
    with null or repeated doc_id are scored each for itself. Other columns are ignored.

    The counts of the sample are made by Spark tasks, and reach the driver as Arrow columns: at most ORDER + 1 for each
    byte of the sample. The tables made of them hold a value for each language that has a gram (see Model), so
    they grow with the sample and not with its square, and are broadcast. Scoring shuffles nothing.
    """
    spark = docs.sparkSession
    grams = training_sample(docs, train_bytes, train_docs).mapInArrow(_count, "lang string, k int, gram bigint, n bigint").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))
    model = Model(grams.select("lang", F.col("k").cast("byte").alias("k"), "gram", "n").toArrow())
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), letters_of(text).alias("text"), text.rlike(r"\p{L}").alias("letters"))
    return rows.mapInArrow(_predict(spark.sparkContext.broadcast(model)), "doc_id long, held_out boolean, lang_pred string, score double")
