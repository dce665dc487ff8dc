"""Shared helpers of the training-data operators: staging, sizes, byte-level words."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters outside ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: A side of a join is broadcast when its counted rows have at most so many bytes.
BROADCAST_BYTES = 8 << 20

_U = np.uint64


#: What operators keep in a Python worker between tasks, by the name of the operator, as functions that let it go.
KEEPERS: dict[str, Callable[[], None]] = {}
_holder: list[str] = [""]


def claim(name: str) -> None:
    """Called as an operator's task begins: a worker that served another operator lets go of what that one kept.

    Workers outlive a stage, so stores would add up along a pipeline; freed memory goes back to the system.
    """
    if _holder[0] == name:
        return
    for other, clear in KEEPERS.items():
        if other != name:
            clear()
    _holder[0] = name
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own counsel
        pass


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of fewer rows than Spark's default, where the session hasn't another number: texts are long, and both sides hold a batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, rows)


def shrink(spark: SparkSession) -> None:
    """A full collection in each executor's JVM, which gives back heap that earlier work needed.

    A heap that has grown stays as large else, and adds up with the Python workers of the next step. One
    task an executor, spread evenly if they are idle; an executor that is missed only stays as it was.
    """
    sc = spark.sparkContext
    n = max(1, sc._jsc.sc().getExecutorMemoryStatus().size() - 1)  # the driver is among them
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc') as done").write.format("noop").mode("overwrite").save()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or in one JVM a folder of our own if that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not at and kept.isDefined():
        at = kept.get()
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    if not kept.isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder, its lineage cut.

    Its files go once it is unreachable if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, else they
    stay. What an operator needs only for itself is kept in a ``Scratch`` instead.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables that one run of an operator keeps in the shared folder, each deleted when it is superseded.

    Lineage ends at them, so a lost executor costs no more than the step at hand. They are read
    in as many partitions as their bytes ask for, and their size is known to the planner.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.at, self.paths = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.at}/{len(self.paths)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = out
        return out

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self._delete(self.at)
        self.collect_garbage()

    def leave(self) -> None:
        """For results that still read the tables: they go when the application ends."""
        fs, where = self._where(self.at)
        fs.deleteOnExit(where)

    def _where(self, path: str) -> tuple:
        jvm, jsc = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(jsc.hadoopConfiguration()), where

    def _delete(self, path: str) -> None:
        fs, where = self._where(path)
        fs.delete(where, True)

    def drop(self, *frames: DataFrame | None) -> None:
        for path, kept in list(self.paths.items()):
            if kept is not None and any(kept is x for x in frames):
                self._delete(path)
                self.paths[path] = None

    def collect_garbage(self) -> None:
        """Lets Spark's cleaner delete the shuffle files of queries that are over; else they wait for the driver's next full collection."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int | None = None, row_bytes: int = 64) -> DataFrame:
    """Hints a broadcast if the frame's counted rows, at so many bytes each, are few; else leaves the choice to AQE."""
    return F.broadcast(df) if (df.count() if rows is None else rows) * row_bytes <= BROADCAST_BYTES else df


def words(text: Column) -> Column:
    """Number of words; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8(column: pa.Array) -> list[bytes]:
    """The strings of an Arrow column as bytes, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` bytes together, one text at least."""
    at, held = 0, 0
    for i, x in enumerate(texts):
        if held and held + len(x) > most:
            yield at, i
            at, held = i, 0
        held += len(x) + 1
    if at < len(texts):
        yield at, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 20, n)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, _U)
            p[0] = 1
            with np.errstate(over="ignore"):
                np.multiply.accumulate(p, out=p)
            out.append(p)
        _powers[:] = out
    return _powers[0], _powers[1]


def prefix_hashes(buf: np.ndarray) -> np.ndarray:
    """``p`` with ``(p[j] - p[i]) * inverse[i]`` the hash of ``buf[i:j]``."""
    p = np.empty(len(buf) + 1, _U)
    p[0] = 0
    np.cumsum(_BYTES[buf] * powers(len(buf))[0][: len(buf)], out=p[1:])
    return p


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(range(256)).lower()


def _cuts(text: bytes, most: int) -> Iterator[bytes]:
    """A long text cut at white space into pieces of about ``most`` bytes."""
    at = 0
    while len(text) - at > most:
        end = at + most
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def word_hashes(texts: list[bytes], lower: bool = True, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and each text's number of words."""
    pieces, owner = [], []
    for i, x in enumerate(texts):
        for y in _cuts(x, most) if len(x) > most else (x,):
            pieces.append(y)
            owner.append(i)
    hashes, counts = [], np.zeros(len(texts), np.int64)
    for lo, hi in slices(pieces, most):
        joined = b" ".join(pieces[lo:hi]) + b" "
        buf = np.frombuffer(joined.translate(_LOWER) if lower else joined, np.uint8)
        space = _SPACE[buf]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        start, end = edge[::2], edge[1::2]
        p = prefix_hashes(buf)
        hashes.append(mix((p[end] - p[start]) * powers(len(buf))[1][start]))
        ends = np.cumsum([len(x) + 1 for x in pieces[lo:hi]])
        per = np.diff(np.searchsorted(start, ends), prepend=0)
        np.add.at(counts, owner[lo:hi], per)
    return np.concatenate(hashes) if hashes else np.zeros(0, _U), counts
