"""Latest rows and generations: append-only tables seen as of their newest complete state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def live(rows: DataFrame, documents: DataFrame | None = None, key: str = "subject_id") -> DataFrame:
    """Rows not retracted, of documents not retracted."""
    rows = rows.where(~F.col("retracted"))
    if documents is None:
        return rows
    return rows.join(documents.where(~F.col("retracted")).select(F.col("id").alias(key)), key, "left_semi")


def latest(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order that must be total."""
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_at = 1").drop("_at")


def newest(rows: DataFrame, by: list[str], columns: list[str], order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """``latest`` by time and id, as an aggregate: it is combined before the shuffle."""
    top = rows.groupBy(*by).agg(F.max(F.struct(*order, *[c for c in columns if c not in order])).alias("_x"))
    return top.select(*by, *[f"_x.{c}" for c in columns])


def first_rows(rows: DataFrame, n: int, order: list[Column]) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def current_generation(latest_facts: DataFrame, version: str) -> DataFrame:
    """(subject_id, topic, escalation, country) of subjects whose latest topic and escalation are of the version.

    The country is optional, and counts only if it is of that version too.
    """
    own = F.col("version") == version
    wide = latest_facts.groupBy("subject_id").agg(
        *[F.max(F.when((F.col("fact_type") == t) & own, F.col("value"))).alias(t) for t in ("topic", "escalation", "country")],
        F.count_if(F.col("fact_type").isin("topic", "escalation") & own).alias("_n"),
    )
    return wide.where("_n = 2").drop("_n")


def pending(documents: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Documents without a marker of the current version."""
    return documents.join(done.select(F.col("subject_id").alias(key)), key, "left_anti")


def heads(rows: DataFrame, key: str = "id", supersedes: str = "supersedes_id") -> DataFrame:
    """Rows that no other row supersedes."""
    return rows.join(rows.where(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias(key)), key, "left_anti")
