"""All registered queries, each a (spark, sf_dir) function beside the ANSI SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Adds a query under its name, with its SQL if that can express it."""

    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register(
    "snapshot_stats",
    """SELECT source, count(*) AS n_docs, count(*) FILTER (WHERE text LIKE '%the%') AS n_hits, sum(n_chars)::BIGINT AS n_chars
       FROM documents WHERE n_chars > 0 GROUP BY source ORDER BY n_docs DESC, source""",
)
def snapshot_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").where("n_chars > 0")
    return (
        d.groupBy("source")
        .agg(F.count("*").alias("n_docs"), F.count_if(F.col("text").contains("the")).alias("n_hits"), F.sum("n_chars").alias("n_chars"))
        .orderBy(F.desc("n_docs"), "source")
    )
