"""Token ids as length-delimited binary records with a separate offset index.

A record frames one serialized sequence: its length (8 bytes), the masked checksum of those
(4), the ids as little-endian unsigned integers, and their masked checksum (4). Checksums are
CRC-32C, rotated right by 15 bits plus 0xA282EAD8. Each data file ``ids-NNNNN.rec`` has an index
``ids-NNNNN.idx`` of its own: for each record its document's id, the byte offset where it begins
and its number of ids, or the complement of that number if the document has no id (three 8-byte
little-endian integers, after a 16-byte head), so that readers can fetch records in any order.
Ids are two bytes wide if the vocabulary allows.

Files are written beside their final names and renamed, with the same content on every try, so
that a lost executor's files are simply written again. A failed try deletes what it wrote; what a
lost executor leaves goes when all files are there.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import KEEPERS, claim, shared_dir

#: Words kept with their ids in each Python worker, in either of two generations.
KEPT_WORDS = 600_000
#: Most bytes of text, and records, that a file is meant for.
FILE_BYTES, FILE_ROWS = 128 << 20, 1 << 20
_MAGIC = b"LODEIDX1"
_HEAD = "<8sII"


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (0x82F63B78 if i & 1 else 0)
        out.append(i)
    return out


class _Crc:
    """CRC-32C of many byte strings at once; numpy goes through all of them in step."""

    table = np.array(_crc_table(), np.uint32)
    step = 2048  # bytes of a block

    #: What two bytes at once do.
    first = table[np.arange(1 << 16) & 255] ^ (np.arange(1 << 16, dtype=np.uint32) >> np.uint32(8))
    pairs = table[first & 255] ^ (first >> np.uint32(8))

    def __init__(self) -> None:
        # what appending 2**k zero bytes does to a checksum, as four 256-entry tables
        one = np.arange(256, dtype=np.uint32)
        t = [self._zero(one << np.uint32(8 * i)) for i in range(4)]
        self.shift = [t]
        for _ in range(40):
            t = [self._apply(t, x) for x in t]
            self.shift.append(t)

    def _zero(self, x: np.ndarray) -> np.ndarray:
        return self.table[x & 255] ^ (x >> np.uint32(8))

    @staticmethod
    def _apply(t: list[np.ndarray], x: np.ndarray) -> np.ndarray:
        return t[0][x & 255] ^ t[1][(x >> np.uint32(8)) & 255] ^ t[2][(x >> np.uint32(16)) & 255] ^ t[3][x >> np.uint32(24)]

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        """Blocks of all texts run in step, each from zero; then they are joined by length."""
        out = np.zeros(len(texts), np.uint32)
        blocks, owner, lens = [], [], []
        for i, x in enumerate(texts):
            for at in range(0, len(x), self.step):
                blocks.append(x[at : at + self.step])
                owner.append(i)
                lens.append(min(self.step, len(x) - at))
        if blocks:
            length = np.array(lens)
            order = np.argsort(-length, kind="stable")
            grid = np.zeros((len(blocks), self.step), np.uint8)
            for row, b in enumerate(order):
                grid[row, : lens[b]] = np.frombuffer(blocks[b], np.uint8)
            words = np.ascontiguousarray(grid.view("<u2").T)
            crc = np.zeros(len(blocks), np.uint32)
            active = np.searchsorted(-length[order], -2 * np.arange(1, self.step // 2 + 1), side="right")
            for j in range(int(length.max()) // 2):
                n = active[j]
                crc[:n] = self.pairs[(crc[:n] ^ words[j, :n]) & 0xFFFF] ^ (crc[:n] >> np.uint32(16))
            odd = np.flatnonzero(length[order] & 1)
            crc[odd] = self.table[(crc[odd] ^ grid[odd, length[order][odd] - 1]) & 255] ^ (crc[odd] >> np.uint32(8))
            raw = np.empty_like(crc)
            raw[order] = crc
            full = self.shift[11]
            for b, i in enumerate(owner):
                left = int(out[i])
                if left:
                    if lens[b] == self.step:
                        left = self._one(full, left)
                    else:
                        for k in range(11):
                            if lens[b] >> k & 1:
                                left = self._one(self.shift[k], left)
                out[i] = left ^ int(raw[b])
        # the usual start and end values
        for i, x in enumerate(texts):
            init = 0xFFFFFFFF
            for k in range(len(x).bit_length()):
                if len(x) >> k & 1:
                    init = self._one(self.shift[k], init)
            out[i] ^= init ^ 0xFFFFFFFF
        return out

    @staticmethod
    def _one(t: list[np.ndarray], x: int) -> int:
        return int(t[0][x & 255]) ^ int(t[1][x >> 8 & 255]) ^ int(t[2][x >> 16 & 255]) ^ int(t[3][x >> 24])


_crc: _Crc | None = None


def masked_crc(texts: list[bytes]) -> list[int]:
    global _crc
    _crc = _crc or _Crc()
    return [(((x >> 15) | (x << 17)) + 0xA282EAD8) & 0xFFFFFFFF for x in _crc(texts).tolist()]


def frame(payloads: list[bytes]) -> list[bytes]:
    """Records of the payloads."""
    heads = [struct.pack("<Q", len(x)) for x in payloads]
    return [h + struct.pack("<I", c) + x + struct.pack("<I", d) for h, c, x, d in zip(heads, masked_crc(heads), payloads, masked_crc(payloads), strict=True)]


def unframe(raw: bytes, offsets: list[int]) -> list[bytes]:
    """Payloads of the records that begin at the offsets; a wrong checksum raises."""
    heads = [raw[o : o + 8] for o in offsets]
    sizes = [int.from_bytes(h, "little") for h in heads]
    for o, c in zip(offsets, masked_crc(heads), strict=True):
        if int.from_bytes(raw[o + 8 : o + 12], "little") != c:
            raise ValueError(f"length checksum of the record at {o}")
    out = [raw[o + 12 : o + 12 + n] for o, n in zip(offsets, sizes, strict=True)]
    for o, n, c in zip(offsets, sizes, masked_crc(out), strict=True):
        if int.from_bytes(raw[o + 12 + n : o + 16 + n], "little") != c:
            raise ValueError(f"data checksum of the record at {o}")
    return out


# -- encoding

#: Characters whose letters, case and normal form no Unicode version disputes; other words go to the library whole.
_PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]*\Z")
#: The parts of lower-cased plain words, and the spaces between words.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ a-z0-9ß-öø-ÿ]+| ")
#: White space to Python, but not to the tokenizer.
_ODD_SPACE = "\x1c\x1d\x1e\x1f"
#: The tokenizers whose words can be encoded alone: all that decides how a text is cut into words and parts.
_CUT_BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
}
_END = _CUT_BY_WORDS["model"]["end_of_word_suffix"]
#: Longer words are encoded each time, so that what is kept has a bound in bytes.
LONGEST_KEPT = 64
_JOINED = 64  # parts that go to the library as one text


class Kept(dict):
    """A bounded store: when full it becomes the older generation, whose entries still serve."""

    def __init__(self, most: int) -> None:
        self.most, self.old = most, {}

    def values_of(self, keys: list[str], make: Callable[[list[str]], Iterable[tuple[str, bytes]]]) -> list[bytes]:
        """The values of the keys; ``make`` gives those of distinct keys that neither generation has."""
        got = list(map(self.get, keys))
        at = [i for i, v in enumerate(got) if v is None]
        if at:
            lacking = {keys[i] for i in at}
            old = self.old
            found = {k: old[k] for k in lacking if k in old}
            found.update(make(list(lacking.difference(found))))
            for i in at:
                got[i] = found[keys[i]]
            if len(self) > self.most:
                self.old = dict(self)
                self.clear()
            self.update((k, v) for k, v in found.items() if len(k) <= LONGEST_KEPT)
        return got


class Encoder:
    """Ids of texts as bytes. A tokenizer that cuts texts into words first encodes its words alone, and they are kept.

    Whether it does is read from its whole definition; any other tokenizer gets whole texts.
    """

    def __init__(self, path: str, dtype: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype, self.width = dtype, np.dtype(dtype).itemsize
        self.words, self.parts = Kept(KEPT_WORDS), Kept(KEPT_WORDS)
        with open(path) as f:
            told = json.load(f)
        self.split = all(told.get(k) == v for k, v in _CUT_BY_WORDS.items() if k != "model")
        self.split &= all(told["model"].get(k) == v for k, v in _CUT_BY_WORDS["model"].items()) and not told.get("truncation") and not told.get("padding")
        added = told.get("added_tokens") or []
        self.split &= all(x["content"].startswith("<|") and not any(map(str.isspace, x["content"])) and not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]) for x in added)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(_END)]] = True

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [np.array(x.ids, self.dtype) for x in encode(texts, add_special_tokens=False)]

    def _encode_parts(self, parts: list[str]) -> Iterator[bytes]:
        """Ids of parts of plain words; many go to the library as one text, which is cut where a word's last piece stands."""
        groups = [parts[i : i + _JOINED] for i in range(0, len(parts), _JOINED)]
        for group, ids in zip(groups, self._library([" ".join(x) for x in groups]), strict=True):
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * self.width).tolist()
            raw = ids.tobytes()
            if len(ends) == len(group):
                yield from map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends))
            else:
                yield from (x.tobytes() for x in self._library(group))

    def _parts(self, parts: list[str]) -> list[bytes]:
        return self.parts.values_of(parts, lambda new: zip(new, self._encode_parts(new), strict=True))

    def _encode_words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        letters, mixed, other = [], [], []
        for w in words:
            if not (w.isascii() and w.isprintable() or _PLAIN.match(w)) or "<|" in w:
                other.append(w)
            elif w.isalpha():
                letters.append(w)
            else:
                mixed.append(w)
        yield from zip(other, (x.tobytes() for x in self._library(other)), strict=True)
        yield from zip(letters, self._parts([w.lower() for w in letters]), strict=True)
        if not mixed:
            return
        cut = _PARTS.findall(" ".join(mixed).lower())
        stops = [i for i, x in enumerate(cut) if x == " "]
        ids = self._parts([x for x in cut if x != " "])
        at = 0
        for k, (w, stop) in enumerate(zip(mixed, [*stops, len(cut)], strict=True)):
            end = stop - k  # the spaces before it have no ids
            yield w, b"".join(ids[at:end])
            at = end

    def texts(self, texts: list[str]) -> list[bytes]:
        if not self.split:
            return [x.tobytes() for x in self._library(texts)]
        whole = [i for i, x in enumerate(texts) if any(map(x.__contains__, _ODD_SPACE))]
        cut = [x.split() for x in texts]
        for i in whole:
            cut[i] = []
        ids = self.words.values_of(list(chain.from_iterable(cut)), self._encode_words)
        ends = list(accumulate(map(len, cut), initial=0))
        out = [b"".join(ids[a:b]) for a, b in pairwise(ends)]
        if whole:
            for i, x in zip(whole, self._library([texts[i] for i in whole]), strict=True):
                out[i] = x.tobytes()
        return out


_encoders: dict[tuple[str, str], Encoder] = {}
KEEPERS[__name__] = _encoders.clear


def encoder(path: str, dtype: str) -> Encoder:
    """This worker's encoder."""
    if (path, dtype) not in _encoders:
        _encoders[path, dtype] = Encoder(path, dtype)
    return _encoders[path, dtype]


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def _write(path: str, folder: str, dtype: str, end_id: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    width = np.dtype(dtype).itemsize
    end = b"" if end_id is None else np.array([end_id], dtype).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        claim(__name__)
        e = encoder(path, dtype)
        k = TaskContext.get().partitionId()
        store, at = _open(folder)
        trial = f"{at}/.trial-{k:05d}-{uuid.uuid4().hex}"
        index, offset, ids = [], 0, 0
        try:
            with store.open_output_stream(trial) as data:
                for batch in batches:
                    for lo in range(0, batch.num_rows, 1024):
                        part = batch.slice(lo, 1024)
                        payloads = [x + end for x in e.texts([x or "" for x in part.column("text").to_pylist()])]
                        for doc, x, r in zip(part.column("doc_id").to_pylist(), payloads, frame(payloads), strict=True):
                            n = len(x) // width
                            index.append((0, offset, ~n) if doc is None else (doc, offset, n))
                            data.write(r)
                            offset += len(r)
                            ids += n
        except BaseException:
            store.delete_file(trial)
            raise
        name = f"ids-{k:05d}"
        if index:
            with store.open_output_stream(f"{trial}.idx") as out:
                out.write(struct.pack(_HEAD, _MAGIC, 1, width) + np.array(index, "<i8").tobytes())
            store.move(trial, f"{at}/{name}.rec")
            store.move(f"{trial}.idx", f"{at}/{name}.idx")
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([name]), pa.array([len(index)]), pa.array([ids])], names=["part", "name", "records", "n_ids"])
        else:
            store.delete_file(trial)

    return run


def write_records(docs: DataFrame, tokenizer_path: str, folder: str, *, text: str = "text", doc_id: str = "doc_id", end_id: int | None = None, parts: int | None = None, dtype: str = "<u2") -> DataFrame:
    """Encodes whole texts and writes them in ascending doc_id order; (part, name, records, n_ids) per file.

    Null texts are empty and still get their record (and end id). A null doc_id comes first. Rows
    with equal doc_ids are ordered by a hash of their text. No rows, no files. ``dtype`` must hold
    all ids. Texts are dealt out before they are encoded, as dealing by range reads its input twice.
    Very long texts are encoded whole, each in one task. Other columns are ignored, whatever their
    names. There are as many files as shuffle partitions, or more where files would pass
    ``FILE_BYTES`` of text or ``FILE_ROWS`` records.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if not parts:
        size = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (size[0] or 0) // FILE_BYTES, size[1] // FILE_ROWS)
    rows = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    store, at = _open(folder)
    store.create_dir(at)
    return rows.mapInArrow(_write(tokenizer_path, folder, dtype, end_id), "part int, name string, records long, n_ids long")


def _read(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _open(folder)
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with store.open_input_file(f"{at}/{name}.idx") as f:
                    raw = f.read()
                magic, version, width = struct.unpack_from(_HEAD, raw)
                if magic != _MAGIC or version != 1:
                    raise ValueError(f"{name}.idx is no index of this format")
                index = np.frombuffer(raw, "<i8", offset=struct.calcsize(_HEAD)).reshape(-1, 3).copy()
                known = index[:, 2] >= 0
                index[~known, 2] = ~index[~known, 2]
                starts = base + np.cumsum(index[:, 2]) - index[:, 2]
                with store.open_input_file(f"{at}/{name}.rec") as f:
                    for lo in range(0, len(index), 512):
                        part = index[lo : lo + 512]
                        first = int(part[0, 1])
                        last = int(part[-1, 1] + part[-1, 2] * width + 16)
                        f.seek(first)
                        payloads = unframe(f.read(last - first), (part[:, 1] - first).tolist())
                        crc = [zlib.crc32(np.frombuffer(x, f"<u{width}").astype("<u4").tobytes()) for x in payloads]
                        yield pa.RecordBatch.from_arrays([pa.array(part[:, 0], mask=~known[lo : lo + 512]), pa.array(starts[lo : lo + 512]), pa.array(part[:, 2]), pa.array(crc, pa.int64()), pa.array(payloads, pa.binary())], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return run


def read_records(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """The records of the files: doc_id, start (ids before it), n_tokens, ids_crc32, ids (packed)."""
    # one row a file: the running sum is over as many rows as there are files
    base = files.withColumn("base", F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids"))
    n = max(1, files.count())
    return base.repartition(n, "part").mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def round_trip(docs: DataFrame, tokenizer_path: str, *, end_id: int | None = None, text: str = "text", doc_id: str = "doc_id", folder: str | None = None) -> DataFrame:
    """Writes the documents' records to a folder all executors share, and reads them back."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    listed = write_records(docs, tokenizer_path, folder, text=text, doc_id=doc_id, end_id=end_id).collect()  # a row a file
    store, at = _open(folder)
    for left in store.get_file_info(fs.FileSelector(at)):
        if left.base_name.startswith(".trial-"):
            store.delete_file(left.path)
    schema = T.StructType.fromDDL("part int, name string, records long, n_ids long")
    return read_records(spark, spark.createDataFrame(listed, schema), folder)
