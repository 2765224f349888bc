"""Encoding and decoding with byte-pair merges, in batched numpy rounds over many words."""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MEMO_BYTES = 256 << 20  # about what a Python worker remembers of pieces of text and their ids
LONG = 256  # bytes; longer pieces aren't remembered
CHECKED = 1000  # new pieces that the library encodes at once
#: Pieces of text: words as the vocabulary's pattern has them, where all is ASCII; around other bytes all between white space is one piece.
WORDS = rb"'(?:[stmdSTMD]|[rR][eE]|[vV][eE]|[lL][lL])|[A-Za-z]+|[0-9]|[^\sA-Za-z0-9]+"
ASCII, WIDE = re.compile(WORDS), re.compile(rb"[^\s\x80-\xff]*[\x80-\xff]\S*|" + WORDS)
FAR = np.int64(1 << 40)  # the rank of what is no pair


class Merges:
    """A vocabulary with merges and word ends, and an own encoder for it.

    Expects what such files have: special tokens found in the text as they stand; text composed, lower-cased and cut into
    words (see WORDS) that white space ends; bytes written as characters; no decoder (tokens are joined by blanks).
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model, self.vocab = held["model"], held["model"]["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"].encode(): t["id"] for t in held["added_tokens"]}
        self.at_special = re.compile(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or b"(?!)")
        self.size = 1 + max([*self.vocab.values(), *self.special.values()])
        self.digits, self.tokens = [b" %d" % i for i in range(self.size)], [b" "] * self.size
        for token, i in self.vocab.items():
            self.tokens[i] += token.encode()
        for token, i in self.special.items():
            self.tokens[i] += token
        # Bytes that are printed stand for themselves, the others, in order, for the characters from U+0100 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in set(plain))}
        self.to_byte = str.maketrans({c: chr(b) for b, c in chars.items()})
        self.inner, self.final = (np.array([self.vocab[chars[b] + end] for b in range(256)], np.int64) for end in ("", suffix))
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right = (np.array([self.vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        keys, rank = left * self.size + right, np.arange(len(pairs), dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = np.append(keys[order], np.iinfo(np.int64).max), np.append(rank[order], FAR), made
        # Where what a merge makes stands in no earlier merge, its other places in the word can be merged at once.
        first = np.full(self.size, FAR)
        np.minimum.at(first, left, rank)
        np.minimum.at(first, right, rank)
        self.at_once = first[made] > rank

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs, by binary search over the sorted keys."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], FAR)

    def split(self, piece: bytes) -> list[bytes]:
        """The words of a piece."""
        if piece.isascii():
            return [piece.lower()]
        whole = self.library.normalizer.normalize_str(piece.decode("utf-8", "replace"))
        return [w.translate(self.to_byte).encode("latin-1") for w, _ in self.library.pre_tokenizer.pre_tokenize_str(whole)]

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word, none of which is empty. All symbols lie in one flat array; each round merges every word's pair of lowest rank."""
        flat, length = np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words))
        s, o = self.inner[flat], np.repeat(np.arange(len(words)), length)
        ends = np.cumsum(length) - 1
        s[ends] = self.final[flat[ends]]
        done: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)
        rank = np.full(len(s), FAR)  # of the pair that begins here
        same = o[1:] == o[:-1]
        rank[:-1][same] = self.rank_of(s[:-1][same], s[1:][same])
        while len(s):
            start = np.flatnonzero(np.append(True, o[1:] != o[:-1]))
            least = np.minimum.reduceat(rank, start)
            sizes = np.diff(np.append(start, len(s)))
            if (over := least == FAR).any():  # these words have no pairs left
                for a, n in zip(start[over].tolist(), sizes[over].tolist()):
                    done[o[a]] = s[a : a + n]
                stay = np.repeat(~over, sizes)
                s, o, rank, least, sizes = s[stay], o[stay], rank[stay], least[~over], sizes[~over]
                if not len(s):
                    break
                start = np.cumsum(sizes) - sizes
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            word = np.searchsorted(start, at, "right") - 1
            leading = np.append(True, word[1:] != word[:-1])
            # Of places next to each other (a pair of equal symbols) every second one counts.
            run = np.append(True, np.diff(at) > 1) | leading
            begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[((np.arange(len(at)) - begin) % 2 == 0) & (leading | self.at_once[least[word]])]
            s[at] = self.made[rank[at]]
            stay = np.ones(len(s), bool)
            stay[at + 1] = False
            near = np.zeros(len(s), bool)  # symbols whose pair changes
            near[at] = near[at[at > 0] - 1] = True
            s, o, rank, near = s[stay], o[stay], rank[stay], near[stay]
            at = np.flatnonzero(near)
            follows = np.append(o[1:] == o[:-1], False)[at]
            rank[at] = FAR
            at = at[follows]
            rank[at] = self.rank_of(s[at], s[at + 1])
        return done


class _Pieces:
    """What a worker remembers: piece -> its ids in decimals, and its tokens, each with a blank before it.

    New ones are encoded together, and by the library too; where the two differ, the library's ids hold and the piece is
    noted.
    """

    def __init__(self, merges: Merges):
        self.merges, self.held = merges, 0
        self.ids: dict[bytes, bytes] = {}
        self.tokens: dict[bytes, bytes] = {}
        self.other: set[bytes] = set()

    def cut(self, text: bytes) -> list[bytes]:
        pieces = ASCII if text.isascii() else WIDE
        if not (found := self.merges.at_special.search(text)):
            return pieces.findall(text)
        out, at = [], 0
        while found:
            out += [*pieces.findall(text, at, found.start()), found[0]]
            at = found.end()
            found = self.merges.at_special.search(text, at)
        return out + pieces.findall(text, at)

    def checked(self, pieces: list[bytes], own: list[list[int]]) -> list[list[int]]:
        """own, or what the library says where it says otherwise."""
        encode = lambda x: self.merges.library.encode(b" ".join(x).decode("utf-8", "replace"), add_special_tokens=False).ids
        for at in range(0, len(pieces), CHECKED):
            some = pieces[at : at + CHECKED]
            if encode(some) != [i for ids in own[at : at + CHECKED] for i in ids]:
                for k, piece in enumerate(some, at):
                    if (theirs := encode([piece])) != own[k]:
                        own[k] = theirs
                        self.other.add(piece)
        return own

    def learn(self, new: list[bytes]) -> None:
        m = self.merges
        words = [[] if x in m.special else m.split(x) for x in new]
        each = list(dict.fromkeys(w for p in words for w in p))
        known = dict(zip(each, (ids.tolist() for ids in m.merge(each))))
        own = [[i for w in p for i in known[w]] if p else [m.special[x]] if x in m.special else [] for x, p in zip(new, words)]
        for x, ids in zip(new, self.checked(new, own)):
            self.ids[x] = digits = b"".join([m.digits[i] for i in ids])
            self.tokens[x] = tokens = b"".join([m.tokens[i] for i in ids])
            self.held += 300 + len(x) + len(digits) + len(tokens)

    def encode_all(self, texts: list[bytes]) -> list[tuple[int, bytes, bytes, int]]:
        """(number of ids, ids, tokens, pieces where the library's ids stand) for each text."""
        if self.held > MEMO_BYTES:
            self.ids, self.tokens, self.other, self.held = {}, {}, set(), 0
        cut = [self.cut(t) for t in texts]
        new = list(set().union(*cut).difference(self.ids))
        self.learn(new)
        found = []
        for pieces in cut:
            ids = b"".join(map(self.ids.__getitem__, pieces))
            found.append((ids.count(b" "), ids[1:], b"".join(map(self.tokens.__getitem__, pieces))[1:], sum(x in self.other for x in pieces) if self.other else 0))
        for x in new:
            if len(x) > LONG:
                self.held -= 300 + len(x) + len(self.ids.pop(x)) + len(self.tokens.pop(x))
                self.other.discard(x)
        return found


@functools.lru_cache(1)
def _pieces(path: str) -> _Pieces:
    """One for each Python worker, which keeps it from task to task."""
    return _Pieces(Merges(path))


def _blocks(column: pa.Array, most: int = 8 << 20):
    """The texts of a column in UTF-8, in lists of about `most` bytes."""
    block, size = [], 0
    for t in column.cast(pa.large_binary()):
        block.append(t.as_py() or b"")
        size += len(block[-1])
        if size > most:
            yield block
            block, size = [], 0
    if block:
        yield block


def _code(path: str, keep_ids: bool):
    def run(batches):
        known = _pieces(path)
        for batch in batches:
            at = 0
            for texts in _blocks(batch.column(1)):
                coded = known.encode_all(texts)
                columns = {
                    "doc_id": batch.column(0).slice(at, len(texts)),
                    "n_tokens": pa.array([c[0] for c in coded], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(c[1]).hexdigest() for c in coded]),
                    "decoded_sha256": pa.array([hashlib.sha256(c[2]).hexdigest() for c in coded]),
                    "n_library": pa.array([c[3] for c in coded], pa.int64()),
                }
                if keep_ids:
                    columns["ids"] = pa.array([np.fromstring(c[1], np.int32, sep=" ") for c in coded], pa.list_(pa.int32()))
                    columns["decoded"] = pa.array([c[2].decode() for c in coded])
                at += len(texts)
                yield pa.RecordBatch.from_pydict(columns)

    return run


def encode_decode(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_tokens, ids_sha256 (of the ids in decimals joined by blanks), decoded_sha256, n_library and, if asked for, ids and decoded.

    Whole texts are encoded, without tokens put around them, by rounds of merges over the words of many texts; each
    new piece of text is checked against the tokenizers library with the file `path`, and tokens are joined by
    blanks, as the library decodes where the file has no decoder. Special tokens that stand in a text are encoded as
    such. n_library counts the pieces that the rounds encode otherwise, for which the library's ids stand. null counts as empty
    (no ids, digests of the empty text). Other columns are ignored; null or repeated doc_id are carried through.
    Nothing is shuffled: memory is that of an Arrow batch and, for each Python worker, MEMO_BYTES of remembered
    pieces; what is longer than LONG is encoded in each block of texts anew.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_library long" + (", ids array<int>, decoded string" if keep_ids else "")
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(_code(path, keep_ids), schema)
