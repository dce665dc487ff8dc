"""N-gram Jaccard join by universe partition and pigeonhole.

A document's set holds its distinct five-word shingles (64-bit hashes). Documents with
equal sets form a class; all later work is on classes. Two classes link when
``100 * |A & B| >= 80 * |A | B|``. The steps, none of which drops a link:

1.  *Pruning.* A class that has a partner shares at least 80 % of its shingles, so one with
    more than 20 % of shingles found in no other class has none. Shingle fingerprints are
    counted bucket by bucket; a fingerprint collision can only keep a class.
2.  *Partition.* Band ``k`` holds the sizes in ``[B_k, B_{k+1})``, ``B_{k+1} = floor(1.25 B_k) + 1``,
    so partners lie in the same or in neighbouring bands. Band ``k`` cuts the hash universe into
    ``m_k`` segments; a class signs its segments under its own scheme and the next one up. Linked
    sets of sizes r, s differ in at most ``floor((r + s) / 9)`` shingles, never more than
    ``floor(n / 4)`` for either size n, so they agree on the other segments.
3.  *Allocation.* A class with more than ``floor(n / 4)`` non-empty segments signs each of those
    once (cost one each). A class with fewer also signs their one-deletion neighbourhoods, which
    tolerate one difference more for every segment, at the cost of a signature a shingle; if even
    that falls short, its empty segments too. Both ends of a link that shares no non-empty segment
    are short, so both take the dearer allocation.
4.  *Verification.* Signatures with the same members are one group. Rounds test a group's
    centres, 1, 8, 64 ... of them, against the other members on the whole sets; members that are
    linked already, directly or through others, need no test, and centres leave the group; nor do
    two members with more than ``(r + s) / 9`` shingles that no other class has, as those are
    differences, or whose sketches (parities of counts in 1,024 bins) differ in more bins than that.
    Members with the least share of such shingles (originals rather than edited
    copies) are centres first. Rounds end when no group has members of two components left.
5.  *Components* of the verified links by repeated star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, claim, cut, mix, slices, small, utf8, word_hashes

SHINGLE = 5
PERCENT = 80
#: Bytes of text a fingerprint bucket is meant for.
BUCKET_BYTES = 12 << 20
#: Buckets that a part of the texts deals its fingerprints to at once.
COARSE = 1024
#: Longs of a set's sketch.
SKETCH = 16
_MARKS = [f"s{j}" for j in range(SKETCH)]
_U = np.uint64
_ODD = mix(np.arange(11, 11 + SHINGLE + 2, dtype=_U)) | _U(1)


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and their numbers."""
    hashes, n = word_hashes(texts)
    if not len(hashes):
        return hashes, np.zeros(len(texts), np.int64)
    first = np.cumsum(n) - n
    full = np.maximum(len(hashes) - k + 1, 0)
    rolled = np.zeros(full, _U)
    for j in range(k):
        rolled += hashes[j : j + full] * _ODD[j]
    rolled = mix(rolled)
    out, sizes = [], np.zeros(len(texts), np.int64)
    for i, (at, words) in enumerate(zip(first.tolist(), n.tolist(), strict=True)):
        if words >= k:
            x = rolled[at : at + words - k + 1]
            x.sort()
            x = x[np.append(True, x[1:] != x[:-1])]
        elif words:
            x = mix((hashes[at : at + words] * _ODD[:words]).sum(keepdims=True) + _ODD[k : k + 1] * _U(words))
        else:
            continue
        sizes[i] = len(x)
        out.append(x)
    return np.concatenate(out), sizes


def class_ids(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """16 bytes for each set, from all its members; empty sets get zeros."""
    out = np.zeros((len(sizes), 2), _U)
    full = sizes > 0
    at = (np.cumsum(sizes) - sizes)[full]
    if len(at):
        for j in range(2):
            out[full, j] = mix(np.add.reduceat(mix(sets ^ _ODD[5 + j]), at) + sizes[full].astype(_U))
    return out


def _binary(x: np.ndarray) -> list[bytes]:
    raw, w = np.ascontiguousarray(x).tobytes(), x.shape[1] * x.itemsize
    return [raw[i : i + w] for i in range(0, len(raw), w)]


def _parts(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of the batches with about ``most`` bytes of text, and their texts."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            texts = utf8(part.column("text"))
            for a, b in slices(texts, most):
                yield part.slice(a, b - a), texts[a:b]


def _payloads(values: np.ndarray, owner: np.ndarray, names: np.ndarray, bucket: np.ndarray, kind: type) -> Iterator[tuple[int, bytes]]:
    """(bucket, payload) of each bucket that occurs; a payload holds classes and their fingerprints, of ``kind``."""
    order = np.lexsort((owner, bucket))
    values, owner, bucket = values[order].astype(kind), owner[order], bucket[order]
    ends = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)] if len(bucket) else []
    for lo, hi in pairwise(ends):
        who, local = np.unique(owner[lo:hi], return_inverse=True)
        yield int(bucket[lo]), np.array([len(who), hi - lo], np.int64).tobytes() + names[who].tobytes() + np.bincount(local).astype(np.int32).tobytes() + values[lo:hi].tobytes()


def _unpacked(payloads: list[bytes], kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of payloads, and the class of each."""
    fps, who = [np.zeros(0, kind)], [np.zeros(0, _U)]
    for raw in payloads:
        n, m = np.frombuffer(raw, np.int64, 2)
        counts = np.frombuffer(raw, np.int32, n, 16 + 8 * n)
        fps.append(np.frombuffer(raw, kind, m, 16 + 12 * n))
        who.append(np.repeat(np.frombuffer(raw, _U, n, 16), counts))
    return np.concatenate(fps), np.concatenate(who)


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    return ((values >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int32)


def _fingerprints(buckets: int, coarse: int):
    """Rows of documents (bucket, doc_id, th, n, cls) and of packed fingerprints (bucket, payload).

    With more buckets than ``coarse`` fingerprints stay whole and go to coarse buckets, which
    ``_finer`` divides, so that a part of the texts has no more rows than there are coarse ones.
    """
    schema = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int32()), ("cls", pa.binary()), ("payload", pa.binary())])
    few, kind = min(buckets, coarse), np.uint32 if buckets <= coarse else _U

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        for batch, texts in _parts(batches):
            sets, sizes = shingle_sets(texts)
            cls = class_ids(sets, sizes)
            rows = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(-1 - np.arange(rows, dtype=np.int32) % buckets), batch.column("doc_id"), batch.column("th"), pa.array(sizes.astype(np.int32)), pa.array(_binary(cls), pa.binary()), pa.nulls(rows, pa.binary())],
                schema=schema,
            )
            # each class once; a fingerprint of one batch is sent once, and marked if two classes of the batch have it
            _, once = np.unique(cls[:, 0], return_index=True)
            keep = np.zeros(rows, bool)
            keep[once] = True
            keep &= sizes > 0
            owner = np.repeat(np.arange(rows, dtype=np.int32), sizes)
            held = keep[owner]
            values, owner = sets[held], owner[held]
            yield _payload_rows(_payloads(values, owner, np.ascontiguousarray(cls[:, 0]), _bucket(values, few), kind), schema)

    return run


def _payload_rows(payloads: Iterator[tuple[int, bytes]], schema: pa.Schema) -> pa.RecordBatch:
    some = list(payloads)
    n = len(some)
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in some], pa.int32()), *(pa.nulls(n, f.type) for f in list(schema)[1:-1]), pa.array([x for _, x in some], pa.binary())], schema=schema)


def _finer(buckets: int, most: int = 64):
    """Documents pass; payloads of coarse buckets are divided, about ``most`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.filter(pc.is_null(batch.column("payload")))
            if docs.num_rows:
                yield docs
            held = batch.column("payload").drop_null().to_pylist()
            for at in range(0, len(held), most):
                values, who = _unpacked(held[at : at + most], _U)
                names, owner = np.unique(who, return_inverse=True)
                yield _payload_rows(_payloads(values, owner, names, _bucket(values, buckets), np.uint32), batch.schema)

    return run


def _count_shared(group: pa.Table) -> pa.Table:
    """Documents pass; of fingerprints, how many of each class some other class has too."""
    claim(__name__)
    docs = group.filter(pc.is_null(group["payload"]))
    fp, cl = _unpacked(group["payload"].drop_null().to_pylist(), np.uint32)
    keys, shared = np.zeros(0, _U), np.zeros(0, np.int64)
    if len(fp):
        names, cl = np.unique(cl, return_inverse=True)
        pair = np.unique((fp.astype(_U) << _U(32)) | cl.astype(_U))
        fp, cl = (pair >> _U(32)).astype(np.uint32), (pair & _U(0xFFFFFFFF)).astype(np.int64)
        same = np.append(False, fp[1:] == fp[:-1])
        same |= np.append(same[1:], False)
        count = np.bincount(cl[same], minlength=len(names))
        keys, shared = names[count > 0], count[count > 0]
    n = len(keys)
    counted = pa.table([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(keys.view(np.int64)), pa.array(shared.astype(np.int64))], names=["doc_id", "th", "n", "cls", "c1", "shared"])
    d = len(docs)
    passed = pa.table([docs["doc_id"], docs["th"], docs["n"], docs["cls"], pa.nulls(d, pa.int64()), pa.nulls(d, pa.int64())], names=counted.column_names)
    return pa.concat_tables([passed, counted])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in _parts(batches):
        sets, sizes = shingle_sets(texts)
        cls = class_ids(sets, sizes)
        ends = np.cumsum(sizes)
        marks = sketches(sets, sizes)
        raw = [sets[e - s : e].tobytes() for s, e in zip(sizes, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(_binary(cls), pa.binary()), pa.array(np.ascontiguousarray(cls[:, 0]).view(np.int64)), pa.array(raw, pa.binary()), *(pa.array(np.ascontiguousarray(marks[:, j])) for j in range(SKETCH))], names=["cls", "c1", "members", *_MARKS])


def sketches(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Parities of how many members fall into each of 64 * SKETCH bins, as SKETCH longs a set.

    Each bin in which two parities differ holds a shingle that only one of the sets has.
    """
    out = np.zeros((len(sizes), SKETCH), np.int64)
    bins, ends = (sets & _U(64 * SKETCH - 1)).astype(np.int64), np.cumsum(sizes)
    for i, (n, end) in enumerate(zip(sizes.tolist(), ends.tolist(), strict=True)):
        odd = np.bincount(bins[end - n : end], minlength=64 * SKETCH) & 1
        out[i] = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
    return out


def bands(largest: int) -> list[int]:
    """Lower ends of the size bands, up to one past ``largest``."""
    out = [1]
    while out[-1] <= largest:
        out.append(out[-1] * 5 // 4 + 1)
    return out


def segments(top: int) -> int:
    """Segments of a scheme whose largest set has ``top`` shingles: above the differences it must bear."""
    return top // 4 + 4 + top // 50


def signatures(members: np.ndarray) -> np.ndarray:
    """All signatures of one set: segments, and where it is short of them the dearer ones."""
    n = len(members)
    ends = bands(n)
    own = len(ends) - 2
    ends.append(ends[-1] * 5 // 4 + 1)
    out = []
    strong = mix(members ^ _ODD[5])
    for k in (own, own + 1):
        m = segments(ends[k + 1] - 1)
        tag = mix(np.arange(m, dtype=_U) + _U(k << 40))
        seg = ((members >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)  # non-decreasing: members are sorted
        at = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
        total = np.add.reduceat(strong, at)
        out.append(mix(total ^ tag[seg[at]]))
        if len(at) <= n // 4:
            per = np.diff(np.append(at, n))
            out.append(mix((np.repeat(total, per) - strong) ^ tag[seg]))
            if 2 * len(at) <= n // 4:
                out.append(mix(np.delete(tag, seg[at])))
    return np.unique(np.concatenate(out))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            ids, own = (part.column(c).to_numpy(zero_copy_only=False) for c in ("c1", "u"))
            sets = [np.frombuffer(x, _U) for x in part.column("members").to_pylist()]
            keys, sizes = [signatures(x) for x in sets], [len(x) for x in sets]
            per = [len(x) for x in keys]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(ids, per)), pa.array(np.repeat(sizes, per), pa.int32()), pa.array(np.repeat(own, per), pa.int32())], names=["key", "c1", "n", "u"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = [], []
        for lo in range(0, batch.num_rows, 256):
            for r in batch.slice(lo, 256).to_pylist():
                p, q = np.frombuffer(r["p"], _U), np.frombuffer(r["q"], _U)
                both = len(np.intersect1d(p, q, assume_unique=True)) if min(len(p), len(q)) * 100 >= PERCENT * max(len(p), len(q)) else 0
                if 100 * both >= PERCENT * (len(p) + len(q) - both):
                    a.append(r["a"])
                    b.append(r["b"])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, comp) of (a, b) edges: each node's smallest reachable node, by alternating large and small stars.

    Every pass keeps connectivity and only shortens paths; it ends when the edges are stars. Nothing
    but two totals reaches the driver. Minima are kept before they are joined, so that
    the edges of a hub can be split among tasks.
    """
    e, before = scratch.keep(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u < v").distinct()), None
    while True:
        both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = scratch.keep(both.groupBy("v").agg(F.min("u").alias("m")).withColumn("m", F.least("m", "v")))
        large = scratch.keep(both.join(low, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u < v").distinct())
        scratch.drop(e, low)
        low = scratch.keep(large.groupBy("v").agg(F.min("u").alias("m")))
        e = scratch.keep(large.join(low, "v").select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u")).where("u < v").distinct())
        scratch.drop(large, low)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if now == before:
            break
        before = now
    out = scratch.keep(e.select(F.col("v").alias("node"), F.col("u").alias("comp")).unionByName(e.select(F.col("u").alias("node"), F.col("u").alias("comp")).distinct()))
    scratch.drop(e)
    return out


def _placed(rows: DataFrame, comps: DataFrame | None, node: str, comp: str) -> DataFrame:
    """The rows with the component of a class, which is its own where it has no link."""
    if comps is None:
        return rows.withColumn(comp, F.col(node))
    own = comps.select(F.col("node").alias(node), F.col("comp").alias(comp))
    return rows.join(own, node, "left").withColumn(comp, F.coalesce(comp, node))


def _links(scratch: Scratch, sets: DataFrame) -> DataFrame | None:
    """(node, comp): the components of all links between classes; None if nothing was linked."""
    signed = scratch.keep(sets.select("c1", "u", "members").mapInArrow(_sign, "key long, c1 long, n int, u int"))
    keys = signed.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("c1")).alias("x"), F.min("c1").alias("least"))
    keys = scratch.keep(keys.where("size > 1").groupBy("size", "x", "least").agg(F.min("key").alias("key")).select("key"))
    groups = scratch.keep(signed.join(keys, "key"))
    scratch.drop(signed, keys)
    lookup, marks = sets.select("c1", "members"), sets.select("c1", *_MARKS)
    apart = " + ".join(f"bit_count(s{j} ^ t{j})" for j in range(SKETCH))
    comps, tested, centres = None, None, 1
    while True:
        placed = scratch.keep(_placed(groups, comps, "c1", "comp"))
        scratch.drop(groups)
        mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        mixed = scratch.keep(mixed)
        todo = scratch.keep(placed.join(mixed, "key", "left_semi"))
        scratch.drop(placed, mixed)
        if todo.isEmpty():
            return comps
        # centres: of the components that have fewest members in the group, the members with fewest shingles of their own
        parts = scratch.keep(todo.groupBy("key", "comp").agg(F.count("*").alias("size")))
        order = Window.partitionBy("key").orderBy("size", F.col("u") / F.col("n"), "c1")
        chosen = todo.join(parts, ["key", "comp"]).withColumn("at", F.row_number().over(order)).where(F.col("at") <= centres)
        chosen = chosen.select("key", F.col("c1").alias("a"), F.col("comp").alias("of"), F.col("n").alias("m"), F.col("u").alias("v"))
        chosen = scratch.keep(chosen.join(marks.withColumnsRenamed({"c1": "a"} | {f"s{j}": f"t{j}" for j in range(SKETCH)}), "a"))
        near = "comp <> of and 100 * least(n, m) >= 80 * greatest(n, m) and 9 * (u + v) <= n + m"
        # both tests are part of the join, which thus gives only pairs to verify
        pairs = todo.join(marks, "c1").join(chosen, "key").where(f"{near} and 9 * ({apart}) <= n + m")
        pairs = pairs.select(F.least("a", "c1").alias("a"), F.greatest("a", "c1").alias("b")).distinct()
        pairs = scratch.keep(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        both = pairs.join(lookup.withColumnsRenamed({"c1": "b", "members": "q"}), "b").join(lookup.withColumnsRenamed({"c1": "a", "members": "p"}), "a")
        found = scratch.keep(both.mapInArrow(_verify, "a long, b long"))
        # links between components found before: only those meet again
        between = _placed(_placed(found, comps, "a", "x"), comps, "b", "y").select(F.col("x").alias("a"), F.col("y").alias("b"))
        now = components(scratch, between)
        if comps is None:
            later = now
        else:
            moved = comps.join(now.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
            later = scratch.keep(moved.unionByName(now.join(comps.select("node"), "node", "left_anti")))
            scratch.drop(now, comps)
        comps = later
        groups = scratch.keep(todo.join(chosen.select("key", F.col("a").alias("c1")), ["key", "c1"], "left_anti").select("key", "c1", "n", "u"))
        if tested is not None:
            again = scratch.keep(tested.unionByName(pairs))
            scratch.drop(tested, pairs)
            pairs = again
        tested = pairs
        scratch.drop(todo, parts, chosen, found)
        scratch.collect_garbage()
        centres *= 8


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, cls (its class, 16 bytes), th (a hash of its text).

    Very long texts are read whole, a few megabytes of words at a time. Null or wordless texts have no shingles and are their own component. Rows that repeat are
    documents of one class. A null doc_id gets the component_id of its class, the smallest other
    doc_id, or null if there is none. Other columns are ignored. An empty table gives no rows.
    """
    with Scratch(docs.sparkSession) as scratch:
        return _near_duplicates(scratch, docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))


def _near_duplicates(scratch: Scratch, base: DataFrame) -> DataFrame:
    base = base.withColumn("th", F.xxhash64("text"))
    weight = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(weight // BUCKET_BYTES) + 4
    dealt = base.mapInArrow(_fingerprints(buckets, COARSE), (schema := "bucket int, doc_id long, th long, n int, cls binary, payload binary"))
    if buckets > COARSE:
        dealt = dealt.repartition(COARSE, "bucket").mapInArrow(_finer(buckets), schema)
    counted = scratch.keep(dealt.groupBy("bucket").applyInArrow(_count_shared, "doc_id long, th long, n int, cls binary, c1 long, shared long"))
    named = counted.where("cls is not null").select("doc_id", "th", "n", "cls")
    shared = counted.where("cls is null").groupBy("c1").agg(F.sum("shared").alias("shared"))
    classes = named.where("n > 0").groupBy("cls").agg(F.first("n").alias("n"), F.min(F.struct("doc_id", "th")).alias("rep"), F.min("doc_id").alias("least"))
    # two shingles of one class may have one fingerprint, which is counted once: hence the margin
    classes = classes.withColumn("c1", _low(F.col("cls"))).join(shared, "c1", "left")
    classes = scratch.keep(classes.withColumn("shared", F.least(F.col("n"), F.col("shared") + 2 + F.expr("n div 100000"))))
    kept = classes.where(F.col("shared") * 100 >= F.col("n") * PERCENT)
    reps = scratch.keep(kept.select(F.col("rep.doc_id").alias("rid"), F.col("rep.th").alias("rth"), (F.col("n") - F.col("shared")).cast("int").alias("u"), "cls"))
    found = base.join(small(reps.select("rid", "rth")), base.doc_id.eqNullSafe(F.col("rid")) & (base.th == F.col("rth")), "left_semi")
    sets = found.select("text").mapInArrow(_sets, "cls binary, c1 long, members binary, " + ", ".join(f"{m} long" for m in _MARKS))
    sets = sets.where("length(members) > 0").groupBy("cls").agg(F.first("c1").alias("c1"), F.first("members").alias("members"), *[F.first(m).alias(m) for m in _MARKS])
    sets = scratch.keep(sets.join(reps.select("cls", "u"), "cls"))
    comps = _links(scratch, sets)
    ids = classes.select("cls", "c1", "least")
    if comps is not None:
        joined = _placed(ids, comps, "c1", "comp")
        ids = scratch.keep(joined.join(joined.groupBy("comp").agg(F.min("least").alias("lowest")), "comp").select("cls", F.col("lowest").alias("component")))
    else:
        ids = ids.select("cls", F.col("least").alias("component"))
    # copies of one class may be a third of all rows: both sides are dealt as they are, so that such a part can be split among tasks
    out = named.where("n > 0").join(ids, "cls", "left").unionByName(named.where("n = 0").withColumn("component", F.lit(None).cast("long")))
    return cut(out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), "cls", "th"))


def representatives(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents without those that some group's smallest doc_id stands for; all columns stay.

    Texts aren't shuffled while the keys of what goes are few enough to be broadcast. A group's rows
    that share its doc_id and its class are one document: one of them stays. Documents without words
    stay, as do rows with a null doc_id in groups of none other.
    """
    near = near_duplicates(docs, text, doc_id)
    gone = near.where(F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).distinct()
    again = near.where("doc_id = component_id and n_shingles > 0").groupBy("doc_id", "cls").agg(F.count("*").alias("n"), F.min("th").alias("first"), F.collect_set("th").alias("ths")).where("n > 1")
    again = cut(again.select(F.col("doc_id").alias("_d"), "first", F.explode("ths").alias("_t")))
    rows = docs.withColumn("_th", F.xxhash64(F.col(text))).withColumn("_id", F.col(doc_id).cast("long"))
    same = F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t"))
    rows = rows.join(small(cut(gone)), same, "left_anti")
    if not again.isEmpty():
        twice = rows.join(again.where("_t = first").select("_d", "_t"), same, "left_semi").dropDuplicates(["_id", "_th"])
        rows = rows.join(small(again.select("_d", "_t")), same, "left_anti").unionByName(twice)
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def _low(cls: Column) -> Column:
    """The first eight bytes of a class id as the long that Python made of them (little-endian)."""
    h = F.hex(cls)
    turned = F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(8)])
    return F.conv(turned, 16, -10).cast("long")
