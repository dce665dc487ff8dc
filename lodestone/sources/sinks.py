"""Append-only and content-addressed writers, as plans over old and new rows, and file sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import cut

def new_rows(rows: DataFrame, existing: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows as inserted one after the other: a row goes in unless one of its keys is there already.

    A row that isn't inserted doesn't keep out others. So rounds decide: rows that are the first left by
    all of their keys go in, and what shares a key with them goes out, until none is left. ``order`` is unique.
    """
    for k in keys:
        rows = rows.join(existing.select(k), k, "left_anti")
    left, kept = cut(rows), None
    while not left.isEmpty():
        firsts = [left.groupBy(k).agg(F.min(order).alias(order)).select(order) for k in keys]
        won = left
        for first in firsts:
            won = won.join(first, order, "left_semi")
        won = cut(won)
        kept = won if kept is None else kept.unionByName(won)
        for k in keys:
            left = left.join(won.select(k), k, "left_anti")
        left = cut(left)
    return rows.limit(0) if kept is None else kept


def upserted(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows with those of the same key replaced, and new ones added; keys of ``rows`` are unique."""
    return existing.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def facts_of(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, fact_type, value) of non-empty values."""
    cast = rows.select(key, *[F.col(c).cast("string").alias(c) for c in columns])
    return cast.unpivot(key, columns, "fact_type", "value").where("value is not null and value <> ''")


def write_blobs(rows: DataFrame, path: str, text: str = "text") -> None:
    """Distinct texts by their hash, in folders of its first two digits; ones already there are not written again."""
    blobs = rows.select(F.sha2(text, 256).alias("sha256"), F.col(text).alias("text")).dropDuplicates(["sha256"]).withColumn("shard", F.substring("sha256", 1, 2))
    spark = rows.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    if hadoop.FileSystem.get(spark._jvm.java.net.URI(path), spark._jsc.hadoopConfiguration()).exists(hadoop.Path(path)):
        blobs = blobs.join(spark.read.parquet(path).select("sha256"), "sha256", "left_anti")
    blobs.write.mode("append").partitionBy("shard").option("compression", "zstd").parquet(path)


def read_blobs(rows: DataFrame, path: str) -> DataFrame:
    """Rows with their text fetched by sha256 and checked: (…, text, intact)."""
    blobs = rows.sparkSession.read.parquet(path).select("sha256", "text")
    return rows.join(blobs, "sha256", "left").withColumn("intact", F.coalesce((F.sha2("text", 256) == F.col("sha256")) & (F.length("text") == F.col("text_length")), F.lit(False)))


def write_snapshot(main: DataFrame, countries: DataFrame, path: str) -> None:
    """One JSON line for the snapshot and a folder a country; countries are swapped in before the main file."""
    countries.write.mode("overwrite").partitionBy("slug").json(f"{path}/countries.new")
    main.coalesce(1).write.mode("overwrite").json(f"{path}/main.new")
    spark = main.sparkSession
    fs_of = spark._jvm.org.apache.hadoop.fs.FileSystem
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_of.get(spark._jvm.java.net.URI(path), spark._jsc.hadoopConfiguration())
    for name in ("countries", "main"):
        fs.delete(at(f"{path}/{name}"), True)
        if not fs.rename(at(f"{path}/{name}.new"), at(f"{path}/{name}")):
            raise OSError(f"{path}/{name} could not be put in place")


def write_once(rows: DataFrame, path: str) -> None:
    """An immutable JSON artifact: the same content again is no error, other content is."""
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jvm.java.net.URI(path), spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        rows.write.mode("errorifexists").json(path)
        return
    old = spark.read.schema(rows.schema).json(path)
    if not (old.exceptAll(rows).isEmpty() and rows.exceptAll(old).isEmpty()):
        raise ValueError(f"{path} holds other content")
