"""Encoding and decoding with a merge-type SentencePiece vocabulary."""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SPACE = "▁"
MEMO_BYTES = 64 << 20  # about what a Python worker remembers of words and their ids
LONG = 256  # characters; longer words aren't remembered
PIECE = 1 << 20  # bytes of text encoded together, beside the first text's
SHORT = 24  # characters; the pairs of shorter chunks are looked through, which takes less than an agenda
NO_PIECE = float("-inf")


class Vocabulary:
    """The pieces of a model with merges and byte fallback, and an own encoder for it.

    Expects what such models have: no character map, a blank put before the text, blanks kept and written as U+2581.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes = [0] * 256
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not lib.is_control(i) and not lib.is_unknown(i):
                self.ids[piece], self.score[piece] = i, lib.get_score(i)
        self.begin, self.end = lib.bos_id(), lib.eos_id()
        # Where no piece can reach across, the text is cut: before the blanks of a word, and around line feeds.
        long = [p for p in self.ids if len(p) > 1]
        self.splits = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in long)
        stops = "".join(c for c in "\n\t" if not any(c in p for p in long))
        self.chunks = re.compile(f"{SPACE}+[^{SPACE}{stops}]*|[^{SPACE}{stops}]+" + (f"|[{stops}]" if stops else "") if self.splits else "(?s).+")

    def merge(self, chunk: str) -> list[int]:
        """The ids of a chunk: of the adjacent pairs that are pieces the one with the best score, the leftmost of equals, becomes one, until none is left."""
        part, found = self.merged_short(chunk) if len(chunk) <= SHORT else self.merged(chunk), []
        try:
            return [self.ids[p] for p in part]
        except KeyError:  # some characters are written as bytes
            pass
        for p in part:
            if (i := self.ids.get(p)) is not None:
                found.append(i)
            else:
                found += [self.bytes[x] for x in p.encode()]
        return found

    def merged_short(self, chunk: str) -> list[str]:
        """The pieces of a short chunk, with the scores of all adjacent pairs beside them."""
        part, score = list(chunk), self.score.get
        scores = [score(a + b, NO_PIECE) for a, b in zip(part, part[1:])]
        while scores and (best := max(scores)) > NO_PIECE:
            i = scores.index(best)
            part[i : i + 2] = [xy := part[i] + part[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = score(part[i - 1] + xy, NO_PIECE)
            if i < len(scores):
                scores[i] = score(xy + part[i + 1], NO_PIECE)
        return part

    def merged(self, chunk: str) -> list[str]:
        """The pieces of a chunk. An agenda holds the adjacent pairs that are pieces, best score first, then leftmost."""
        part: list[str | None] = list(chunk)
        n, score = len(part), self.score.get
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(-s, i, i + 1, 2) for i in range(n - 1) if (s := score(part[i] + part[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, a, b, size = heapq.heappop(agenda)
            x, y = part[a], part[b]
            if x is None or y is None or after[a] != b or len(x) + len(y) != size:
                continue  # one of the two has been merged since
            part[a], part[b] = (xy := x + y), None
            after[a] = c = after[b]
            if c >= 0:
                before[c] = a
                if (s := score(xy + part[c])) is not None:
                    heapq.heappush(agenda, (-s, a, c, size + len(part[c])))
            if (z := before[a]) >= 0 and (s := score(part[z] + xy)) is not None:
                heapq.heappush(agenda, (-s, z, a, size + len(part[z])))
        return [p for p in part if p is not None]

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian bytes, by the agenda."""
        found = array("I")
        for chunk in self.chunks.findall((SPACE + text).replace(" ", SPACE)) if text else ():
            found.extend(self.merge(chunk))
        return found.tobytes()


class _Words(dict):
    """word -> its ids as little-endian bytes. Words don't depend on each other where no piece reaches across a blank.

    Words met for the first time are encoded by the library too (check); where the two differ, the library's ids hold
    and the word is noted. Half of MEMO_BYTES is for words met lately, and when it is full they become the old ones; an old
    word that is met again is a late one again, so frequent words stay.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.size, self.new, self.other, self.old = vocabulary, 0, [], set(), {}

    def __missing__(self, word: str) -> bytes:
        if len(word) > LONG:
            found, differs = self.checked(word)
            if differs:
                self.other.add(word)
            return found
        if (found := self.old.pop(word, None)) is None:
            found = self.vocabulary.encode(word)
            self.new.append(word)
        self[word] = found
        self.size += 200 + 2 * len(word) + len(found)
        return found

    def checked(self, text: str) -> tuple[bytes, bool]:
        own, theirs = self.vocabulary.encode(text), array("I", self.vocabulary.library.encode(text)).tobytes()
        return theirs, own != theirs

    def check(self) -> bool:
        """Compares all new words; whether some had other ids, which are right from now on."""
        wrong = [(w, f) for w, ids in zip(self.new, self.vocabulary.library.encode(self.new, num_threads=1)) if (f := array("I", ids).tobytes()) != self[w]]
        self.update(wrong)
        self.other.update(w for w, _ in wrong)
        self.new = []
        return bool(wrong)

    def encode(self, text: str) -> tuple[bytes, int]:
        """The ids of a text, and how many of its words have the library's ids against the agenda's."""
        if not text:
            return b"", 0
        if not self.vocabulary.splits or "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            found, differs = self.checked(text)  # blanks that belong together: the text counts as one word
            return found, int(differs)
        words = text.split(" ")
        found = b"".join(map(self.__getitem__, words))
        return found, sum(w in self.other for w in words) if self.other else 0

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, int]]:
        if self.size > MEMO_BYTES // 2:
            self.old = dict(self)
            self.clear()
            self.other &= self.old.keys()
            self.size = 0
        found = [self.encode(t) for t in texts]
        return [self.encode(t) for t in texts] if self.check() else found


@functools.lru_cache(1)
def _words(path: str) -> _Words:
    """One for each Python worker, which keeps it from task to task."""
    return _Words(Vocabulary(path))


def _pieces(batch: pa.RecordBatch):
    """batch(doc_id, text) in pieces of less than PIECE bytes of text after the first text: texts, ids and new words of a whole batch take ten times its size."""
    if batch.num_rows:
        piece = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // PIECE
        starts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            yield batch.slice(a, b - a)


def _code(path: str, keep_ids: bool):
    def run(batches):
        words = _words(path)
        vocabulary = words.vocabulary
        begin, end = (array("I", [i]).tobytes() for i in (vocabulary.begin, vocabulary.end))
        for batch in (piece for whole in batches for piece in _pieces(whole)):
            n, ids_sha, text_sha, other, kept = [], [], [], [], []
            for found, differ in words.encode_all([t or "" for t in batch.column(1).to_pylist()]):
                coded = begin + found + end
                ids = np.frombuffer(coded, "<u4")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(coded).hexdigest())
                text_sha.append(hashlib.sha256(vocabulary.library.decode(ids.tolist()).encode()).hexdigest())
                other.append(differ)
                if keep_ids:
                    kept.append(ids.astype(np.int32))
            columns = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string()), "n_library": pa.array(other, pa.int64())}
            if keep_ids:
                columns["ids"] = pa.array(kept, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    return run


def encode_decode(docs: DataFrame, model: str, keep_ids: bool = False) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256, n_library and, if asked for, ids.

    Whole texts are encoded with begin and end ids by the agenda, every word met is checked against the sentencepiece
    library with the file `model`, and the ids are decoded by the library. n_library counts the words of a text that
    the agenda encodes otherwise (a model of another kind), for which the library's ids stand. null counts as empty
    (begin and end only). Other columns are ignored; null or repeated doc_id are carried through. Nothing is
    shuffled: memory is that of an Arrow batch, of a piece of it with its ids and, for each Python worker, MEMO_BYTES of remembered words.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_library long" + (", ids array<int>" if keep_ids else "")
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(_code(model, keep_ids), schema)
