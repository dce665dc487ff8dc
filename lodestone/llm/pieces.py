"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

Spaces are marked (U+2581) and a text is cut before each run of marks and around line feeds,
where no piece of the vocabulary crosses. The distinct new words of a batch are sorted, which
lays them out as a trie in depth-first order; forward states are kept per character of the
current path and reused for the prefix that the next word shares with it.

The forward recursion depends on the model. For a unigram model a state is the best score of a
segmentation of the prefix and its last piece. Summing scores doesn't give what a BPE model
gives, so there a state is the last piece of the prefix's one valid BPE segmentation: a piece
may follow another only if merging the two pieces' characters by rank ends in just those two.
That holds for exactly one piece at each position, and ids equal the library's. Words that begin
with several marks (whose pieces have equal ranks) are merged pair by pair.

Characters outside the vocabulary become their bytes' pieces, or the unknown id. A worker keeps
the ids of words it met, in two generations of bounded size.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import accumulate, chain, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEEPERS, claim
from .tokens import Kept

MARK = "▁"
KEPT = 100_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, raw[at : at + n]
            at += n


class Codec:
    """Encoder and decoder of a model: ``pieces`` holds (piece, score, type) in order of ids."""

    def __init__(self, pieces: list[tuple[str, float, int]], *, bpe: bool, dummy_prefix: bool = True) -> None:
        self.bpe, self.dummy_prefix = bpe, dummy_prefix
        if any(kind == USER for _, _, kind in pieces):
            raise ValueError("user-defined pieces are not supported")
        self.names = [p for p, _, _ in pieces]
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.score = {p: s for p, s, kind in pieces if kind == NORMAL}
        self.longest = max(map(len, self.ids), default=1)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown = next((i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN), 0)
        byte_of = {i: b for b, i in self.bytes.items()}
        silent = {i for i, (_, _, kind) in enumerate(pieces) if kind == CONTROL}
        #: What each id adds to a decoded text's bytes; no piece's name begins inside a character, so bytes can be joined first.
        self.raw = [b"" if i in silent else bytes([byte_of[i]]) if i in byte_of else " ⁇ ".encode() if i == self.unknown else p.replace(MARK, " ").encode() for i, p in enumerate(self.names)]
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece crosses the start of a word")
        self.found = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.found.add_word(p, (i, len(p), self.score[p]))
        if self.ids:
            self.found.make_automaton()
        alone = not any("\n" in p for p in self.ids)
        self.words = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n+" if alone else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.penalty = min(self.score.values(), default=0.0) - 10.0
        self.kept = Kept(KEPT)
        self.joins: dict[int, bool] = {}
        self.dtype, self.code = ("<u2", "H") if len(pieces) <= 1 << 16 else ("<u4", "I")

    @classmethod
    def load(cls, path: str) -> Codec:
        pieces, bpe, dummy = [], False, True
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    got = dict(_fields(value))
                    pieces.append((got[1].decode(), float(np.frombuffer(got.get(2, b"\0\0\0\0"), "<f4")[0]), got.get(3, NORMAL)))
                elif number == 2:
                    bpe = dict(_fields(value)).get(3, 1) == 2
                elif number == 3:
                    got = dict(_fields(value))
                    dummy = bool(got.get(3, 1))
                    if got.get(2) or got.get(4, 1):
                        raise ValueError("the model's normalisation is not supported")
        return cls(pieces, bpe=bpe, dummy_prefix=dummy)

    # -- one word

    def _merged(self, word: str) -> list[str]:
        """Pieces of a word by merging the best-ranked neighbours, leftmost first; n log n in its length."""
        score = self.score
        if len(word) < 32:
            parts = list(word)
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    s = score.get(parts[i] + parts[i + 1])
                    if s is not None and (best is None or s > best):
                        best, at = s, i
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            return parts
        n = len(word)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at a place; -1: none begins there
        heap = [(-score[word[i : i + 2]], i, i + 1, i + 2) for i in range(n - 1) if word[i : i + 2] in score]
        heapify(heap)
        while heap:
            _, a, b, c = heappop(heap)
            if end[a] != b or b == n or end[b] != c:
                continue  # one of its parts has been merged meanwhile
            end[a], end[b] = c, -1
            if c < n:
                before[c] = a
                s = score.get(word[a : end[c]])
                if s is not None:
                    heappush(heap, (-s, a, c, end[c]))
            p = before[a]
            if p >= 0:
                s = score.get(word[p:c])
                if s is not None:
                    heappush(heap, (-s, p, a, c))
        out, at = [], 0
        while at < n:
            out.append(word[at : end[at]])
            at = end[at]
        return out

    def _joined(self, a: int, b: int) -> bool:
        """Whether piece b may follow piece a in a valid segmentation, or begin one (a = -1)."""
        if len(self.joins) >= KEPT:
            self.joins.clear()
        parts = [self.names[x] for x in (a, b) if x >= 0]
        known = self.joins[b if a < 0 else a + 1 << 32 | b] = self._merged("".join(parts)) == parts
        return known

    def _packed(self, parts: list[tuple[int, str]]) -> bytes:
        """Ids of pieces; -1 stands for a character that isn't in the vocabulary."""
        out = array(self.code)
        for i, p in parts:
            if i >= 0:
                out.append(i)
            elif self.bytes:
                out.extend([self.bytes[b] for b in p.encode()])
            else:
                out.append(self.unknown)
        return out.tobytes()

    def _ids(self, parts: list[str]) -> bytes:
        return self._packed([(self.ids.get(p, -1), p) for p in parts])

    def encode_words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Distinct words with their ids; sorted, they lay out a trie, which is walked depth-first.

        A state is (score, id, length) of the last piece of its prefix's segmentation. Pieces that
        end at a place are found by an automaton of the vocabulary, longest first.
        """
        bpe, joins, found, ids = self.bpe, self.joins, self.found, self.ids
        path, state = "", [(0.0, -1, 0)]
        for word in sorted(words):
            if bpe and word[:2] == MARK * 2:
                yield word, self._ids(self._merged(word))
                continue
            same, n = 0, len(word)
            for a, b in zip(path, word):  # noqa: B905  up to the shorter one's end
                if a != b:
                    break
                same += 1
            del state[same + 1 :]
            hits = list(found.iter(word, max(0, same + 1 - self.longest))) if ids else []
            k, last = 0, len(hits)
            while k < last and hits[k][0] < same:
                k += 1
            for at in range(same + 1, n + 1):
                best = None
                while k < last and hits[k][0] < at:
                    i, size, score = hits[k][1]
                    k += 1
                    before = state[at - size]
                    if not bpe:
                        if best is None or before[0] + score > best[0]:
                            best = (before[0] + score, i, size)
                    elif best is None:
                        key = i if before[1] < 0 else before[1] + 1 << 32 | i
                        ok = joins.get(key)
                        if ok if ok is not None else self._joined(before[1], i):
                            best = (0.0, i, size)
                if (best is None or not bpe) and word[at - 1] not in ids and (best is None or state[at - 1][0] + self.penalty > best[0]):
                    best = (state[at - 1][0] + self.penalty, -1, 1)
                if best is None:
                    break
                state.append(best)
            path, at = word[: len(state) - 1], n
            if len(path) < n:  # can't be for a model trained by merges
                yield word, self._ids(self._merged(word))
                continue
            parts = []
            while at:
                _, i, size = state[at]
                parts.append((i, word[at - size : at]))
                at -= size
            parts.reverse()
            yield word, self._packed(parts)

    # -- texts

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, packed."""
        cut = [self.words.findall((MARK if self.dummy_prefix else "") + x.replace(" ", MARK)) if x else [] for x in texts]
        ids = self.kept.values_of(list(chain.from_iterable(cut)), self.encode_words)
        return [b"".join(ids[a:b]) for a, b in pairwise(accumulate(map(len, cut), initial=0))]

    def decode(self, ids: bytes) -> str:
        """The text of packed ids."""
        out = b"".join(map(self.raw.__getitem__, array(self.code, ids))).decode(errors="replace")
        return out[1:] if self.dummy_prefix and out[:1] == " " else out


_codecs: dict[str, Codec] = {}
KEEPERS[__name__] = _codecs.clear


def codec(path: str) -> Codec:
    """This worker's codec of the model."""
    if path not in _codecs:
        _codecs[path] = Codec.load(path)
    return _codecs[path]


def _encode(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        c = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = [x or "" for x in part.column("text").to_pylist()]
                ids = c.encode(texts)
                same = [c.decode(x) == t for x, t in zip(ids, texts, strict=True)]
                width = np.dtype(c.dtype).itemsize
                crc = [zlib.crc32(np.frombuffer(x, c.dtype).astype("<u4").tobytes()) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(crc, pa.int64()), pa.array(same), pa.array(ids, pa.binary())], names=["row", "n_pieces", "ids_crc32", "round_trip", "ids"])

    return run


def encoded(docs: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with n_pieces, ids_crc32, round_trip (decoding gave the text back), ids (packed).

    ids_crc32 is over the ids as little-endian unsigned 32-bit integers. Null texts are empty: no
    pieces. Very long texts are encoded whole, long runs of spaces in n log n. Rows that repeat give
    rows that repeat; an empty table gives no rows. Kept columns may not have the names of the
    result's; others are ignored.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(text).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(_encode(model_path), f"row {kind}, n_pieces long, ids_crc32 long, round_trip boolean, ids binary")
    return out.select("row.*", "n_pieces", "ids_crc32", "round_trip", "ids")


def _decode(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([None if x is None else c.decode(x) for x in batch.column("ids").to_pylist()], pa.string())], names=["row", "text"])

    return run


def decoded(rows: DataFrame, model_path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns (none called text) with text, decoded from packed ids; null ids give null, rows that repeat repeat, no rows none."""
    rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(ids).alias("ids"))
    out = rows.mapInArrow(_decode(model_path), f"row {rows.schema['row'].dataType.simpleString()}, text string")
    return out.select("row.*", "text")
