"""Publication contract: each rule is a query whose rows are violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_violations(rules: dict[str, DataFrame]) -> DataFrame:
    """(rule, n) with a row for every rule."""
    out = None
    for name, rows in rules.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def snapshot_rules(documents: DataFrame, current: DataFrame, pairs: DataFrame) -> dict[str, DataFrame]:
    """Rules across the snapshot's parts: documents (id, source), current (subject_id, topic, …), pairs (a, b, score)."""
    return {
        "classified_document_exists": current.join(documents.select(F.col("id").alias("subject_id")), "subject_id", "left_anti"),
        "one_row_a_document": current.groupBy("subject_id").count().where("count > 1"),
        "escalation_is_known": current.where(~F.col("escalation").isin("high", "medium", "low") | F.col("escalation").isNull()),
        "topic_is_named": current.where("topic is null or trim(topic) = ''"),
        "source_is_named": documents.where("source is null or trim(source) = ''"),
        "pair_is_ordered": pairs.where("a >= b"),
        "score_is_a_probability": pairs.where("score < 0 or score > 1"),
    }
