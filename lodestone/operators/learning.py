"""Evaluation and sampling for the pair scorer and the extractor."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import cut


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty).cast("double"))


def span_scores(predicted: DataFrame, gold: DataFrame, keys: list[str], by: list[str] | None = None, empty: float | None = 0.0) -> DataFrame:
    """tp, fp, fn and precision, recall, f1 of exact matches, overall or by columns."""
    p = predicted.select(*keys).distinct().withColumn("_p", F.lit(1))
    g = gold.select(*keys).distinct().withColumn("_g", F.lit(1))
    both = p.join(g, keys, "full")
    n = both.groupBy(*(by or [])).agg(F.count_if(F.col("_p").isNotNull() & F.col("_g").isNotNull()).alias("tp"), F.count_if(F.col("_g").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.withColumns({"precision": ratio(tp, tp + fp, empty), "recall": ratio(tp, tp + fn, empty), "f1": ratio(2 * tp, 2 * tp + fp + fn, empty)})


def span_errors(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    p, g = predicted.select(*keys).distinct(), gold.select(*keys).distinct()
    return p.join(g, keys, "left_anti").withColumn("kind", F.lit("spurious")).unionByName(g.join(p, keys, "left_anti").withColumn("kind", F.lit("missed")))


def binary_metrics(rows: DataFrame, threshold: float) -> DataFrame:
    """Counts, precision, recall, f1 (null where undefined) and the Brier score of (score, label) rows."""
    hit, yes = F.col("score") >= threshold, F.col("label") == 1
    n = rows.agg(F.count_if(hit & yes).alias("tp"), F.count_if(hit & ~yes).alias("fp"), F.count_if(~hit & yes).alias("fn"), F.count_if(~hit & ~yes).alias("tn"), F.avg(F.pow(F.col("score") - F.col("label"), 2)).alias("brier"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.withColumns({"precision": ratio(tp, tp + fp, None), "recall": ratio(tp, tp + fn, None), "f1": ratio(2 * tp, 2 * tp + fp + fn, None)})


def average_precision(rows: DataFrame) -> DataFrame:
    """Mean of precision at each positive, rows by falling score, then id.

    Ranks are added up from counts by score: within ranges of scores, and over the ranges, of which there
    are as many as partitions.
    """
    by = rows.groupBy("score").agg(F.count("*").alias("n"), F.sum("label").alias("hits"))
    by = cut(by.repartitionByRange(F.desc("score")).withColumn("part", F.spark_partition_id()))
    parts = by.groupBy("part").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("hits").over(earlier), F.lit(0)).alias("hits0"))
    down = Window.partitionBy("part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    by = by.join(F.broadcast(parts), "part").withColumns({"before": F.col("n0") + F.coalesce(F.sum("n").over(down), F.lit(0)), "hits_before": F.col("hits0") + F.coalesce(F.sum("hits").over(down), F.lit(0))})
    within = Window.partitionBy("score").orderBy("id")
    r = rows.join(by.select("score", "before", "hits_before"), "score").withColumns({"rank": F.col("before") + F.row_number().over(within), "found": F.col("hits_before") + F.sum("label").over(within)})
    return r.agg(ratio(F.sum(F.when(F.col("label") == 1, F.col("found") / F.col("rank"))), F.sum("label"), None).alias("average_precision"))


def calibration(rows: DataFrame, bins: int = 5) -> DataFrame:
    return rows.groupBy(F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg("label").alias("rate"))


def wilson_lower(hits: Column, n: Column, z: float = 1.645) -> Column:
    p = hits / n
    return F.when(n > 0, (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))


def stratum(score: Column, similar: Column, threshold: float = 0.6, margin: float = 0.1, high: float = 0.8, low: float = 0.2) -> Column:
    return F.when(F.abs(score - threshold) <= margin, "uncertain").when(score >= high, "high").when(score <= low, "low").when(~similar, "diverse_name").otherwise("other")


def seeded_order(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256)


def grouped_split(rows: DataFrame, group: str, seed: str, share: float) -> DataFrame:
    """Adds split: whole groups by seeded hash, the test share rounded half to even, between 1 and all but 1."""
    groups = rows.select(group).distinct()
    n = groups.count()
    test = min(max(round(n * share), 1), max(n - 1, 0))
    chosen = groups.orderBy(seeded_order(F.lit(seed), F.col(group)), group).limit(test).withColumn("split", F.lit("test"))
    return rows.join(F.broadcast(chosen) if test <= 100_000 else chosen, group, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def _draws(ids: np.ndarray, samples: int, seed: int) -> np.ndarray:
    """How often each id (row) is in each resample (column): Poisson counts of mean 1, from a hash."""
    u = np.uint64
    with np.errstate(over="ignore"):
        x = ids.astype(np.int64).view(u)[:, None] * u(0x9E3779B97F4A7C15) + (np.arange(1, samples + 1, dtype=u) * u(0xD6E8FEB86659FD93) + u(seed))[None, :]
        for a, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> u(a))) * u(m)
        x ^= x >> u(31)
    term, ends = math.exp(-1), []
    for k in range(1, 12):
        ends.append(term + (ends[-1] if ends else 0.0))
        term /= k
    return np.searchsorted(np.array(ends), (x >> u(11)).astype(np.float64) / float(1 << 53), side="right")


def bootstrap(rows: DataFrame, samples: int = 2000, seed: int = 7) -> DataFrame:
    """(low, high): 2.5 and 97.5 percentiles of the mean difference over Poisson resamples of (id, difference) rows.

    ``difference`` is that of two scorers on one row, so pairs stay together. Resamples are summed
    where the rows are: a partition passes on one total a resample.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = np.zeros(samples), np.zeros(samples)
        for batch in batches:
            ids, difference = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "difference"))
            for at in range(0, len(ids), 256):
                k = _draws(ids[at : at + 256], samples, seed)
                total += difference[at : at + 256] @ k
                weight += k.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, samples + 1)), pa.array(total), pa.array(weight)], names=["sample", "total", "weight"])

    sums = rows.select(F.col("id").cast("long"), F.col("difference").cast("double")).mapInArrow(run, "sample long, total double, weight double")
    means = sums.groupBy("sample").agg((F.sum("total") / F.sum("weight")).alias("mean"))
    return means.agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))


#: Fixed: the order in which strata are filled.
STRATA = ("uncertain", "high", "low", "diverse_name")


def sample_pairs(rows: DataFrame, quotas: dict[str, int], seed: str, universe: str = "survivors", per_name: int = 2, per_source: int = 3) -> DataFrame:
    """(pair_id, stratum, place): pairs picked stratum by stratum in seeded order, under caps that all strata share.

    Rows have pair_id, stratum, left_group, right_group, left_source, right_source. Pairs alike in
    groups and sources meet the same caps, so only the first few of each kind can be picked, and
    only these come together for the picking, which goes through them one by one.
    """
    most = min(per_name, per_source)
    order = seeded_order(F.lit(seed), F.lit(universe), F.col("stratum"), F.col("pair_id"))
    sides = [F.least("left_group", "right_group"), F.greatest("left_group", "right_group"), F.least("left_source", "right_source"), F.greatest("left_source", "right_source")]
    ranked = rows.where(F.col("stratum").isin(*quotas)).select("pair_id", "stratum", order.alias("rank"), *[c.alias(n) for c, n in zip(sides, ("g1", "g2", "s1", "s2"), strict=True)])
    kind = Window.partitionBy("stratum", "g1", "g2", "s1", "s2").orderBy("rank", "pair_id")
    few = ranked.withColumn("_n", F.row_number().over(kind)).where(F.col("_n") <= most)

    def run(frames):
        import pandas as pd

        pdf = pd.concat([pd.DataFrame(columns=["pair_id", "stratum", "rank", "g1", "g2", "s1", "s2"]), *frames])
        names, sources, out = Counter(), Counter(), []
        for stratum in [x for x in STRATA if x in quotas]:
            some = pdf[pdf.stratum == stratum].sort_values(["rank", "pair_id"])
            place = 0
            for r in some.itertuples():
                if place >= quotas[stratum]:
                    break
                if any(names[g] >= per_name for g in {r.g1, r.g2}) or any(sources[x] >= per_source for x in {r.s1, r.s2}):
                    continue
                names.update({r.g1, r.g2})
                sources.update({r.s1, r.s2})
                place += 1
                out.append((r.pair_id, stratum, place))
        yield pd.DataFrame(out, columns=["pair_id", "stratum", "place"])

    return few.drop("_n").repartition(1).mapInPandas(run, f"pair_id {dict(rows.dtypes)['pair_id']}, stratum string, place int")
