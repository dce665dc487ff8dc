"""Exact top-k search by distributed histogram selection.

Vectors of whole numbers are packed into blocks as they are read; every block of queries meets
every block of candidates, and a matrix product scores all of their pairs. Round by round each
query's range of possible scores is cut into ``BINS`` bins and the pairs in it are counted, a
block's counts from its top bin down to the one that holds its own k-th score (the overall k-th is
no lower); sums over all blocks tell in which bin the k-th score lies, which is the next range,
until a bin is one score wide. The last pass emits the pairs above that score and, of those at it,
each block's k smallest ids, and a ranking breaks the ties. No round depends on how scores spread.

Queries are taken in chunks of ``CHUNK_BYTES``, a chunk being broadcast: candidates are read once
a round and chunk and never shuffled. What is shuffled are counts and the pairs of the last pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

BINS = 256
QUERY_BLOCK, BLOCK = 512, 2048
CHUNK_BYTES = 32 << 20
_EXACT = float(1 << 53)
_LAST = (1 << 63) - 1


def usable(vector: Column) -> Column:
    """Neither null nor with a component that is null, NaN or infinite."""
    inf = F.lit(float("inf"))
    return F.coalesce(~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == inf)), F.lit(False))


def _pack(rows: int, scale: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # ids, lengths, components
        count, k = 0, TaskContext.get().partitionId() << 32

        def block() -> pa.RecordBatch:
            nonlocal k
            ids, sizes, flat = (np.concatenate(x) for x in zip(*held, strict=True))
            flat = np.floor(flat * scale) + 0.0
            m = np.zeros((len(ids), int(sizes.max(initial=0))))
            at = np.cumsum(sizes) - sizes
            m[np.repeat(np.arange(len(ids)), sizes), np.arange(len(flat)) - np.repeat(at, sizes)] = flat
            norm = float((m * m).sum(axis=1).max(initial=0.0))
            k += 1
            return pa.RecordBatch.from_arrays([pa.array([k]), pa.array([len(ids)], pa.int32()), pa.array([norm]), pa.array([ids.astype("<i8").tobytes()]), pa.array([m.tobytes()])], names=["block", "rows", "norm", "ids", "matrix"])

        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                vectors = part.column("vector")
                held.append((part.column("id").to_numpy(zero_copy_only=False), pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64), vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)))
                count += part.num_rows
                if count >= rows:
                    yield block()
                    held, count = [], 0
        if count:
            yield block()

    return run


def _scores(q: bytes, nq: int, c: bytes, nc: int) -> np.ndarray:
    a, b = (np.frombuffer(x).reshape(n, -1) for x, n in ((q, nq), (c, nc)))
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    most = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * max(d, 1)
    if most < _EXACT:
        return (a @ b.T).astype(np.int64)
    a, b = (np.array([[int(v) for v in row] for row in x], object).reshape(len(x), d) for x in (a, b))  # whole numbers of any size
    exact = a.dot(b.T)
    return np.array([[min(max(int(x), -_LAST), _LAST) for x in row] for row in exact], np.int64)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(q, query ids, candidate ids, scores with the query's own marked, per-query state)."""
    for batch in batches:
        for r in batch.to_pylist():
            qids, cids = np.frombuffer(r["qids"], "<i8"), np.frombuffer(r["ids"], "<i8")
            s = _scores(r["qmatrix"], len(qids), r["matrix"], len(cids))
            state = np.array([(x["lo"], x["width"], x["need"], x["span"]) for x in r["state"]], np.int64)
            yield r["q"], qids, cids, s, state


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for q, qids, cids, s, state in _tiles(batches):
        lo, width, need, span = state.T
        off = s - lo[:, None]
        inside = (off >= 0) & (off < span[:, None]) & (qids[:, None] != cids[None, :])
        bins = off // width[:, None]
        rows = np.broadcast_to(np.arange(len(qids))[:, None], bins.shape)
        counts = np.bincount((rows * BINS + bins)[inside], minlength=len(qids) * BINS).reshape(-1, BINS)[:, ::-1]
        above = np.cumsum(counts, axis=1) - counts
        i, j = np.nonzero((counts > 0) & (above < need[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), q, np.int32)), pa.array(i.astype(np.int32)), pa.array((BINS - 1 - j).astype(np.int32)), pa.array(counts[i, j])], names=["q", "i", "bin", "n"])


def _emit(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, qids, cids, s, state in _tiles(batches):
            other = qids[:, None] != cids[None, :]
            limit = state[:, 0][:, None]
            order = np.argsort(cids, kind="stable")
            tie = ((s == limit) & other)[:, order]
            tie &= np.cumsum(tie, axis=1) <= k
            take = (s > limit) & other
            take[:, order] |= tie
            i, j = np.nonzero(take)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), q, np.int32)), pa.array(i.astype(np.int32)), pa.array(qids[i]), pa.array(cids[j]), pa.array(s[i, j])], names=["q", "i", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, *, id_col: str = "vec_id", vector: str = "embedding", scale: float = 1.0) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of the other rows by inner product.

    Components count as ``floor(scale * x)``; scores are exact whole numbers (held within 64 bits).
    Ties go to the smaller id. Rows with a null id, a null vector, or a component that is null or
    not finite take no part, on either side; of vectors that differ in length the shorter counts as
    filled up with zeros. Very long vectors make blocks as wide as they are. Columns of other names are ignored. A row is no candidate for a query of its id. Fewer candidates than k: all
    of them; none, or an empty table: no rows. A query row that repeats is answered each time, a candidate that repeats is ranked each time.
    """
    schema = "block long, rows int, norm double, ids binary, matrix binary"

    def packed(df: DataFrame, rows: int) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("vector"))
        return cut(df.where(F.col("id").isNotNull() & usable(F.col("vector"))).mapInArrow(_pack(rows, scale), schema))

    c, q = packed(vectors, BLOCK), packed(queries, QUERY_BLOCK)
    by_block = Window.orderBy("block")  # a row a block
    sizes = q.select("block", (F.row_number().over(by_block) - 1).cast("int").alias("q"), F.floor((F.sum(F.length("matrix")).over(by_block) - 1) / F.lit(CHUNK_BYTES)).cast("int").alias("chunk"))
    q = cut(q.join(sizes, "block").drop("block"))
    chunks = q.groupBy("chunk").agg(F.min("q").alias("lo"), F.max("q").alias("hi")).orderBy("chunk").collect()  # a row for CHUNK_BYTES of queries
    norm = float(np.sqrt(q.agg(F.max("norm")).first()[0] or 0.0) * np.sqrt(c.agg(F.max("norm")).first()[0] or 0.0))
    bound = min(int(norm * (1 + 1e-9)) + 1, 1 << 61)
    found = [_answered(c, q.where(F.col("chunk") == x["chunk"]), x["lo"], x["hi"], bound, k) for x in chunks] or [_answered(c, q, 0, 0, bound, k)]
    out = found[0] if len(found) == 1 else reduce(DataFrame.unionByName, map(cut, found))
    return out.select("query_id", "rank", "vec_id", "score")


def _answered(c: DataFrame, q: DataFrame, first: int, last: int, bound: int, k: int) -> DataFrame:
    """The k best of the candidates for the queries of one chunk, blocks first to last, which every task gets whole."""
    width = -(-(2 * bound + 1) // BINS)
    state = q.select("q", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i")).select("q", "i", F.lit(-bound).cast("long").alias("lo"), F.lit(width).cast("long").alias("width"), F.lit(k).cast("long").alias("need"), F.lit(width * BINS).cast("long").alias("span"))
    state = cut(state)

    def tiles() -> DataFrame:
        held = state.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("i", "lo", "width", "need", "span"))).alias("state"))
        asked = q.join(held, "q").select("q", F.col("ids").alias("qids"), F.col("matrix").alias("qmatrix"), "state")
        # each candidate block meets each query block of the chunk; candidates stay where they are
        each = c.withColumn("q", F.explode(F.sequence(F.lit(first), F.lit(last))))
        return each.join(F.broadcast(asked), "q").select("q", "qids", "qmatrix", "state", "ids", "matrix")

    while width > 0:
        counted = tiles().mapInArrow(_histogram, "q int, i int, bin int, n long").groupBy("q", "i", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("q", "i").orderBy(F.desc("bin"))
        counted = counted.join(state, ["q", "i"]).withColumn("upto", F.sum("n").over(down)).where("upto >= need")
        hit = counted.groupBy("q", "i").agg(F.max(F.struct("bin", "upto", "n")).alias("x"))
        finer = -(-width // BINS) if width > 1 else 0
        # a query with fewer candidates than k takes all: its range goes to the lowest scores
        state = cut(
            state.join(hit, ["q", "i"], "left").select(
                "q",
                "i",
                F.when(F.col("x").isNull(), F.col("lo") if width > 1 else F.lit(-_LAST)).otherwise(F.col("lo") + F.col("x.bin") * F.col("width")).cast("long").alias("lo"),
                F.lit(max(finer, 1)).cast("long").alias("width"),
                F.when(F.col("x").isNull(), F.col("need")).otherwise(F.col("need") - (F.col("x.upto") - F.col("x.n"))).alias("need"),
                F.lit(width).cast("long").alias("span"),
            )
        )
        width = finer
    found = tiles().mapInArrow(_emit(k), "q int, i int, query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q", "i").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked
