"""Removal of repeated byte strings by an enhanced suffix array and its common-prefix interval tree.

Texts are UTF-8 bytes. A byte goes if a string of ``length`` (400) bytes that covers it also
starts anywhere else, in the same document or another; matches never cross documents.

*Sparse suffixes.* Every window of ``length`` bytes has an anchor, the leftmost of its 32-byte
strings with the least hash: equal windows have equal anchors at equal offsets, so only suffixes
that begin at anchors are sorted, about one in 185. Anchors whose 32 bytes occur once can't repeat
and go. Of anchors whose whole context (368 bytes to the left, 400 to the right, or up to the
document's ends) is equal, one stands for all: their context repeats in full.

*Interval tree.* What is left is grouped by the anchor's bytes. In a group the suffixes are sorted
by the bytes to the right; a stack scan over the common-prefix lengths of neighbours closes the
intervals from the longest prefix down. Each interval holds its members by their left extensions;
when two merge, every member of the smaller meets its neighbours in the larger, which gives the
longest common left extension of each with any other (not only with its neighbour in the array).
Members whose left extensions are all equal are no longer diverse and one stays for the others.
A suffix with common left L and common right R at some interval, L + R >= length, is removed from
L bytes before to R after the anchor, and all occurrences are found.

*Large groups.* A group of more than ``GROUP`` different contexts (30 MB) isn't collected. It is divided
first: the offsets at which a window can hold the anchor are halved, and contexts whose windows at one
half's offsets can be equal agree on the bytes that all of those windows share, which makes a smaller
group. What has come to ``GROUP`` contexts or fewer goes to the interval tree, the rest is divided again;
contexts that agree on all that a range of offsets can need are settled on the way, by hash.

*Words.* With ``words``, a string of more than so many whole words goes as well where it has fewer than
``length`` bytes; white space of any kind is alike in it. Its anchor is the leftmost of its words' first
bytes with the least hash, over all words behind which 32 bytes are sure to follow in it. The interval
tree then runs a second time, over contexts whose white space was made alike. In large groups such
strings are few a context, and are counted by hash.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _SPACE, Scratch, claim, mix, powers, prefix_hashes, utf8

LENGTH = 400
KMER = 32
GROUP = 40_000
#: Bytes of contexts that a task settles at once, when no key has more.
BUCKET_BYTES = 4 << 20
_U = np.uint64
_CHUNK = 1 << 20
_NONE = -(1 << 63)
_ALIKE = bytes(0x20 if x else i for i, x in enumerate(_SPACE))


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values."""
    n = len(v)
    full = np.full(-(-n // w) * w, np.iinfo(_U).max, _U)
    full[:n] = v
    blocks = full.reshape(-1, w)
    pre = np.minimum.accumulate(blocks, axis=1).ravel()
    suf = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suf[: n - w + 1], pre[w - 1 : n])


def anchors(texts: list[bytes], length: int = LENGTH, words: int | None = None) -> tuple[np.ndarray, ...]:
    """(text, position, key, context, left, right) of all anchors of the texts; left and right reach over whole words in texts under ``length``."""
    reach = length - KMER
    out: list[tuple[np.ndarray, ...]] = []
    if words is not None and words < KMER // 2:
        raise ValueError(f"words must be {KMER // 2} at least")  # so that an anchor's bytes lie within any string of more words

    def strings(space: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, ...]:
        """(first byte, end, anchor) of all strings of words + 1 words under ``length`` bytes, then all words' first bytes and ends."""
        before, after = np.append(True, space[:-1]), np.append(space[1:], True)
        before[starts], after[ends - 1] = True, True
        first, last = np.flatnonzero(before & ~space), np.flatnonzero(after & ~space) + 1
        n, some = len(first) - words, words + 1 - KMER // 2
        if n <= 0:
            return (np.zeros(0, np.int64),) * 3 + (first, last)
        v = np.full(len(first), np.iinfo(_U).max, _U)
        there = first < len(key)
        v[there] = key[first[there]]
        low = (_least(v, some) & _U(_CHUNK - 1)).astype(np.int64)[:n]
        a, b = first[:n], last[words:]
        good = (b - a < length) & (np.searchsorted(starts, a, "right") == np.searchsorted(starts, b - 1, "right"))
        return a[good], b[good], low[good], first, last

    def take(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, base: np.ndarray, more_left: np.ndarray, more_right: np.ndarray) -> None:
        # pieces [starts, ends) of buf; base: where a piece begins in its text; more_*: whether the text goes on
        p = prefix_hashes(buf)
        inv = powers(len(buf) + 1)[1]
        n = len(buf) - KMER + 1
        if n <= 0:
            return
        space = _SPACE[buf] if words else None
        q = prefix_hashes(np.where(space, np.uint8(0x20), buf)) if words else p
        h = mix((q[KMER:] - q[:n]) * inv[:n])
        key = (h >> _U(20) << _U(20)) | np.arange(n, dtype=_U)
        low = _least(key, reach + 1) & _U(_CHUNK - 1) if n > reach else key[:0]
        if words:
            sa, sb, sp, first, last = strings(space, starts, ends, key)
            # a window of bytes that holds such a string, and the white space on both sides, has its anchor
            held = np.zeros(len(buf) + 2, np.int32)
            np.add.at(held, np.minimum(np.maximum(sb + 1 - length, 0), sa), 1)
            np.add.at(held, sa, -1)
            free = np.cumsum(held) == 0
        for a, b, who, at, ml, mr in zip(starts.tolist(), ends.tolist(), owner.tolist(), base.tolist(), more_left.tolist(), more_right.tolist(), strict=True):
            # windows that begin in the piece's own part; a neighbouring piece has the others
            lo, hi = a + (length - 1 if ml else 0), b - length - (length - 1 if mr else 0)
            if hi < lo and not words:
                continue
            at_ = low[lo : max(lo, hi + 1)]
            if words:
                i, j = np.searchsorted(sa, [lo, hi + 1 if mr else b])
                pos = np.unique(np.append(at_[free[lo : lo + len(at_)]].astype(np.int64), sp[i:j]))
                if not len(pos):
                    continue
            else:
                pos = at_[np.append(True, at_[1:] != at_[:-1])].astype(np.int64)
            left, right = np.minimum(reach, pos - a), np.minimum(length, b - pos)
            ctx = mix((p[pos + right] - p[pos - left]) * inv[pos - left] + (left * 1024 + right).astype(_U) * _U(0x9E3779B97F4A7C15))
            if b - a < length:
                i, j = np.searchsorted(first, [a, b])
                left, right = pos - first[i], last[j - 1] - pos
            out.append((np.full(len(pos), who), pos - a + at, h[pos].view(np.int64), ctx.view(np.int64), left, right))

    held, size = [], 0

    def flush() -> None:
        nonlocal held, size
        if held:
            buf = np.frombuffer(b"".join(texts[i] for i in held), np.uint8)
            ends = np.cumsum([len(texts[i]) for i in held])
            zero = np.zeros(len(held), np.int64)
            take(buf, ends - [len(texts[i]) for i in held], ends, np.array(held), zero, zero, zero)
        held, size = [], 0

    for i, x in enumerate(texts):
        if len(x) < (2 * words + 1 if words else length):
            continue
        if len(x) > _CHUNK // 2:
            # a long text goes in pieces that overlap by a window and a context on either side
            own, one = _CHUNK // 2, np.array([0])
            for at in range(0, len(x), own):
                a, b = max(0, at - (length - 1)), min(len(x), at + own + 2 * (length - 1))
                if b - a >= length or words:
                    take(np.frombuffer(x, np.uint8, b - a, a), one, np.array([b - a]), np.array([i]), np.array([a]), np.array([a > 0]), np.array([b < len(x)]))
                if b == len(x):
                    break  # this piece has the windows up to the text's end
            continue
        if size + len(x) > _CHUNK - 1:
            flush()
        held.append(i)
        size += len(x)
    flush()
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    got = tuple(np.concatenate(c) for c in zip(*out, strict=True))
    if words:
        order = np.lexsort((got[1], got[0]))
        got = tuple(c[order] for c in got)
    # the windows on both sides of a piece's border may have the same anchor
    once = np.append(True, (got[0][1:] != got[0][:-1]) | (got[1][1:] != got[1][:-1]))
    return tuple(c[once] for c in got)


def _find(length: int, words: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        for batch in batches:
            texts = utf8(batch.column("text"))
            for at in range(0, len(texts), 1024):
                who, pos, key, ctx, left, right = anchors(texts[at : at + 1024], length, words)
                rows = pa.array(who + at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("did").take(rows), batch.column("th").take(rows), pa.array(key), pa.array(ctx), pa.array(pos.astype(np.int32)), pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32))],
                    names=["did", "th", "key", "ctx", "pos", "l", "r"],
                )

    return run


_SPOT = "did long, th long, pos int, key long, ctx long, c long"


def _contexts(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    reach = length - KMER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for did, th, text, spots in zip(batch.column("did").to_pylist(), batch.column("th").to_pylist(), utf8(batch.column("text")), batch.column("spots"), strict=True):
                spots = spots.as_py()
                lefts = [text[max(0, s["pos"] - reach) : s["pos"]][::-1] for s in spots]
                rights = [text[s["pos"] : s["pos"] + length] for s in spots]
                own = [pa.array([did] * len(spots), pa.int64()), pa.array([th] * len(spots), pa.int64()), pa.array([s["pos"] for s in spots], pa.int32())]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array([s[c] for s in spots], pa.int64()) for c in ("key", "ctx", "c")), pa.array(lefts, pa.binary()), pa.array(rights, pa.binary())], names=["did", "th", "pos", "key", "ctx", "c", "left", "right"])

    return run


def _whole_words(left: bytes, right: bytes, length: int, words: int) -> list[tuple[int, int]]:
    """Of a context with white space alike, (first byte, end) as seen from the anchor of all strings of words + 1 whole words in under ``length`` bytes that hold it."""
    text, at = np.frombuffer(left[::-1] + right, np.uint8), len(left)
    inner = text != 0x20
    edge = np.diff(inner.view(np.int8))
    # a word counts with the white space on both sides
    first, last = np.flatnonzero(edge == 1) + 1 - at, np.flatnonzero(edge == -1) + 1 - at
    last = last[last > first[0]] if len(first) else last
    first = first[: len(last)]
    a, b = first[: max(0, len(first) - words)], last[words:]
    good = (b - a < length) & (a <= 0) & (b >= 0)
    return list(zip(a[good].tolist(), b[good].tolist(), strict=True))


def _alike(lefts: list[bytes], rights: list[bytes], length: int) -> tuple[list[bytes], list[bytes]]:
    """Contexts with white space made alike; a text begins and ends as if next to some."""
    reach = length - KMER
    return [(x.translate(_ALIKE) + b" ")[:reach] for x in lefts], [(x.translate(_ALIKE) + b" ")[:length] for x in rights]


def interval_tree(lefts: list[bytes], rights: list[bytes], length: int = LENGTH, words: int | None = None) -> list[tuple[int, int]]:
    """For each context (left bytes nearest first): how far to remove to the left and right.

    With ``words`` what is common must hold a string of more whole words, and that is removed; contexts come from ``_alike``.
    """
    reach, n = length - KMER, len(lefts)
    pad_l, pad_r = b"\xff" * reach, b"\xff" * length  # no UTF-8 text has this byte, so a match ends with the text
    sa = sorted(range(n), key=lambda i: rights[i] + pad_r[len(rights[i]) :])
    li = [int.from_bytes((x + pad_l)[:reach]) for x in lefts]
    ri = [int.from_bytes((x + pad_r)[:length]) for x in rights]
    rank = {i: k for k, i in enumerate(sorted(range(n), key=li.__getitem__))}
    by_rank = sorted(rank, key=rank.__getitem__)
    best, out = [-1] * n, [(0, 0)] * n
    held: dict[int, list[tuple[int, int]]] = {}

    def common_words(o: int, left: int, common: int) -> None:
        if left + common < 2 * words:
            return
        if o not in held:
            held[o] = _whole_words(lefts[o], rights[o], length, words)
        some = [x for x in held[o] if x[0] > -left and x[1] < common]
        if some:
            out[o] = (max(out[o][0], -some[0][0]), max(out[o][1], some[-1][1]))

    def meet(x: int, y: int, common: int) -> bool:
        left = reach - ((li[x] ^ li[y]).bit_length() + 7) // 8
        for o in (x, y):
            if left > best[o]:
                best[o] = left
                if words:
                    common_words(o, left, common)
                    continue
                a, b = min(left, len(lefts[o])), min(common, len(rights[o]))
                if a + b >= length:
                    out[o] = (max(out[o][0], a), max(out[o][1], b))
        return left < reach

    def merge(a: list[int], b: list[int], common: int) -> list[int]:
        if len(a) < len(b):
            a, b = b, a
        for k in b:
            at = bisect_left(a, k)
            diverse = True
            if at:
                diverse &= meet(by_rank[k], by_rank[a[at - 1]], common)
            if at < len(a):
                diverse &= meet(by_rank[k], by_rank[a[at]], common)
            if diverse:
                a.insert(at, k)
        return a

    stack: list[tuple[int, list[int]]] = []
    for at, i in enumerate(sa):
        common = length - ((ri[i] ^ ri[sa[at - 1]]).bit_length() + 7) // 8 if at else 0
        while len(stack) > 1 and stack[-1][0] >= common:
            d, members = stack.pop()
            stack[-1] = (stack[-1][0], merge(stack[-1][1], members, d))
        stack.append((common, [rank[i]]))
    while len(stack) > 1:
        d, members = stack.pop()
        stack[-1] = (stack[-1][0], merge(stack[-1][1], members, d))
    return out


def _settle(length: int, words: int | None) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        claim(__name__)
        order = pc.sort_indices(group["key"])
        group = group.take(order)
        keys = group["key"].to_numpy()
        once = pc.less(group["c"], 2).to_pylist()
        ends = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
        rows, ls, rs = [], [], []
        for lo, hi in pairwise(ends):  # one key's contexts at a time
            both = group["left"][lo:hi].to_pylist(), group["right"][lo:hi].to_pylist()
            found = interval_tree(*both, length)
            if words:
                # strings of words lie around the anchor, as those of bytes do
                found = [(max(a, x), max(b, y)) for (a, b), (x, y) in zip(found, interval_tree(*_alike(*both, length), length, words), strict=True)]
            for i, (a, b) in enumerate(found, lo):
                if a + b > 0 and once[i]:
                    rows.append(i)
                    ls.append(a)
                    rs.append(b)
        some = group.select(["did", "th", "pos"]).take(pa.array(rows, pa.int64()))
        return some.append_column("l", pa.array(ls, pa.int32())).append_column("r", pa.array(rs, pa.int32()))

    return run


def _settled(rows: DataFrame, n: int, length: int, words: int | None = None) -> DataFrame:
    """(did, th, pos, l, r) of n contexts by the interval tree, each key in one task with others."""
    buckets = n * 2 * length // BUCKET_BYTES + 4
    dealt = rows.select("did", "th", "pos", "key", "c", "left", "right", F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))
    return dealt.groupBy("bucket").applyInArrow(_settle(length, words), "did long, th long, pos int, l int, r int")


def _halve(scratch: Scratch, contexts: DataFrame, length: int, group: int) -> DataFrame:
    """What ``_settle`` finds, for groups of any size: (did, th, pos, l, r); a null ``did`` marks settled contexts that stay as partners."""
    part = lambda c, n: F.expr(f"substring({c}, 1, {n})")

    def marked(rows: DataFrame) -> DataFrame:
        rows = rows.where(f"length(left) >= lo and length(right) >= {length} - hi")
        return scratch.keep(
            rows.withColumns(
                {
                    "a": F.xxhash64("key", "lo", "hi", part("left", "lo"), part("right", f"{length} - hi")),
                    "b": F.xxhash64("key", "lo", "hi", part("left", "hi"), F.length(part("left", "hi")), part("right", f"{length} - lo")),
                }
            )
        )

    rows = marked(contexts.select("did", "th", "pos", "key", "c", "left", "right", F.lit(0).alias("lo"), F.lit(length - KMER).alias("hi")))
    found: list[DataFrame] = []
    while True:
        sizes = scratch.keep(rows.groupBy("a").agg(F.count("*").alias("n")).where("n > 1"))
        little, large = (sizes.where(t).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for t in (f"n <= {group}", f"n > {group}"))
        if little:
            own = rows.join(sizes.where(F.col("n") <= group).select("a"), "a", "left_semi").withColumn("key", F.col("a"))
            found.append(scratch.keep(_settled(own, little, length)))
        if not large:
            break
        rows = rows.join(sizes.where(F.col("n") > group).select("a"), "a", "left_semi")
        same = rows.groupBy("a", "b").agg(F.sum("c").alias("all"))
        near = same.groupBy("a").agg(F.sum("all").alias("near"), F.count_if(F.col("all") < 2).alias("open")).where("near > 1 and open > 0").select("a")
        met = rows.join(same.where("all > 1").select("b", "all"), "b", "left")
        done = met.where("all > 1 and pos is not null and c < 2").select("did", "th", "pos", F.least("hi", F.length("left")).alias("l"), F.least(F.lit(length) - F.col("lo"), F.length("right")).alias("r"))
        found.append(scratch.keep(done.where(F.col("l") + F.col("r") >= length)))
        # settled contexts stay as one, as partners of those still open
        none = [F.lit(None).cast(t).alias(c) for c, t in (("did", "long"), ("th", "long"), ("pos", "int"))]
        settled = met.where("all > 1").groupBy("a", "b").agg(F.first("key").alias("key"), F.first("left").alias("left"), F.first("right").alias("right"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.lit(2).cast("long").alias("c"))
        cols = ["a", "did", "th", "pos", "key", "c", "left", "right", "lo", "hi"]
        left = met.where("all is null").select(cols).unionByName(settled.select("*", *none).select(cols)).join(near, "a", "left_semi").where("lo < hi")
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        left = left.withColumn("x", F.explode(F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct((mid + 1).alias("lo"), F.col("hi").alias("hi")))))
        after = marked(left.select("did", "th", "pos", "key", "c", "left", "right", "x.lo", "x.hi"))
        scratch.collect_garbage()
        rows = after
    out = contexts.select("did", "th", "pos", F.lit(0).alias("l"), F.lit(0).alias("r")).limit(0)
    for part_ in found:
        out = out.unionByName(part_)
    return out


def _strings(length: int, words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, ls, rs, what = [], [], [], []
                for i, (left, right) in enumerate(zip(*_alike(part.column("left").to_pylist(), part.column("right").to_pylist(), length), strict=True)):
                    whole = left[::-1] + right
                    for a, b in _whole_words(left, right, length, words):
                        rows.append(i)
                        ls.append(-a)
                        rs.append(b)
                        what.append(hashlib.blake2b(whole[len(left) + a : len(left) + b], digest_size=16).digest())
                own = part.select(["did", "th", "pos", "c"]).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(ls, pa.int32()), pa.array(rs, pa.int32()), pa.array(what, pa.binary())], names=["did", "th", "pos", "c", "l", "r", "what"])

    return run


def _counted(scratch: Scratch, contexts: DataFrame, length: int, words: int) -> DataFrame:
    """(did, th, pos, l, r) of repeated strings of words in groups of any size; l is a string's place from its anchor, so equal strings have equal ones."""
    kept = scratch.keep(contexts.mapInArrow(_strings(length, words), "did long, th long, pos int, c long, l int, r int, what binary"))
    many = kept.groupBy("what", "l").agg(F.sum("c").alias("n")).where("n > 1").select("what", "l")
    # all strings of a context hold its anchor, so their union is one run
    return kept.where("c < 2").join(many, ["what", "l"]).groupBy("did", "th", "pos").agg(F.max("l").alias("l"), F.max("r").alias("r"))


def runs(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            size, gone, spans, sha, kept = [], [], [], [], []
            for text, some in zip(utf8(part.column("text")), part.column("spans").to_pylist(), strict=True):
                cuts = runs([(x["a"], x["b"]) for x in some or ()])
                rest, at_ = [], 0
                for a, b in cuts:
                    rest.append(text[at_:a])
                    at_ = b
                rest.append(text[at_:])
                left = b"".join(rest)
                size.append(len(text))
                gone.append(len(text) - len(left))
                spans.append(cuts)
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode(errors="ignore"))
            cuts_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array([len(x) for x in spans], pa.int64()), pa.array(sha), pa.array([[{"a": a, "b": b} for a, b in x] for x in spans], cuts_type), pa.array(kept, pa.string())],
                names=["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept_text"],
            )


def _keyed(docs: DataFrame, text: str, doc_id: str, keep: tuple[str, ...]) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.coalesce(F.col(doc_id).cast("long"), F.lit(_NONE)).alias("did"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))


def repeated_spans(scratch: Scratch, rows: DataFrame, length: int = LENGTH, group: int = GROUP, words: int | None = None) -> DataFrame:
    """(did, th, spans): byte ranges to remove, overlapping as found, of texts keyed by did and th."""
    occ = scratch.keep(rows.select("did", "th", "text").mapInArrow(_find(length, words), "did long, th long, key long, ctx long, pos int, l int, r int"))
    same = scratch.keep(occ.groupBy("key", "ctx").agg(F.count("*").alias("c"), F.min(F.struct("did", "th", "pos", "l", "r")).alias("x")).select("key", "ctx", "c", "x.*"))
    # both sides of this join are dealt as they are kept, so that a context with a large part of all occurrences can be split
    whole = occ.join(same.where("c > 1").select("key", "ctx"), ["key", "ctx"]).select("did", "th", "pos", "l", "r")
    kinds = scratch.keep(same.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    need = scratch.keep(same.join(kinds, "key").select("did", "th", "pos", "key", "ctx", "c", "kinds"))
    scratch.drop(kinds)

    def fetch(part: DataFrame) -> DataFrame:
        spots = part.groupBy("did", "th").agg(F.collect_list(F.struct("pos", "key", "ctx", "c")).alias("spots"))  # a text's own anchors
        # all columns are asked for, so that this exchange of the texts is the one that the caller's join uses again
        return rows.join(spots, ["did", "th"]).select("did", "th", "text", "row", "spots").mapInArrow(_contexts(length), f"{_SPOT}, left binary, right binary")

    size = need.agg(F.count("*"), F.max("kinds")).first()
    # repeats of contexts that occur once; those of the others are whole
    found = whole.unionByName(_settled(fetch(need.where(F.col("kinds") <= group)), size[0], length, words))
    if (size[1] or 0) > group:
        large = fetch(need.where(F.col("kinds") > group))
        found = found.unionByName(_halve(scratch, large, length, group))
        if words:
            found = found.unionByName(_counted(scratch, large, length, words))
    spans = found.select("did", "th", F.struct((F.col("pos") - F.col("l")).alias("a"), (F.col("pos") + F.col("r")).alias("b")).alias("s"))
    return spans.groupBy("did", "th").agg(F.collect_set("s").alias("spans"))  # a text's own spans


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), length: int = LENGTH, group: int = GROUP, words: int | None = None) -> DataFrame:
    """The kept columns with n_bytes, n_removed, n_spans, kept_sha256, removed (runs), kept_text
    (without characters of which a cut leaves a part).

    ``words``: bytes also go that are covered by a string of more whole words than that (of any bytes but ASCII
    white space), if it has fewer than ``length`` bytes and is found elsewhere as whole words, with white space
    of any kind alike. Null texts are empty; texts shorter than ``length`` keep all else; very long ones are read whole, in
    pieces that overlap. Rows that repeat, those of a null doc_id too, are repeats of each other like
    any two documents. Kept columns may not have the names of the result's. An empty table gives no rows; columns that aren't kept are
    ignored, whatever their names.
    """
    rows = _keyed(docs, text, doc_id, keep)
    scratch = Scratch(docs.sparkSession)
    spans = repeated_spans(scratch, rows, length, group, words)
    scratch.leave()  # the result reads it
    kind = rows.schema["row"].dataType.simpleString()
    out = rows.join(spans, ["did", "th"], "left").select("did", "th", "text", "row", "spans").mapInArrow(
        _remove, f"row {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<a:int,b:int>>, kept_text string"
    )
    return out.select("row.*", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept_text")
