"""Entity resolution: blocking, pair features, scoring, matching, constrained clustering."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .graph import components


def blocks(records: DataFrame, cap: int = 100) -> tuple[DataFrame, DataFrame]:
    """(exploded keys of blocks within the cap, all block sizes); records have id, keys."""
    keys = records.select("id", F.explode("keys").alias("key"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("size"))
    return keys.join(sizes.where(F.col("size").between(2, cap)).select("key"), "key"), sizes


def candidate_pairs(records: DataFrame, cap: int = 100) -> DataFrame:
    """Distinct (a, b), a < b, of records that share a key of a block within the cap.

    The cap comes before the self-join, so that its output is bounded by cap times the keys.
    """
    kept, _ = blocks(records, cap)
    left = kept.select("key", F.col("id").alias("a"))
    return left.join(kept.select("key", F.col("id").alias("b")), "key").where("a < b").select("a", "b").distinct()


def jaccard(a: Column, b: Column) -> Column:
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(0.0)


def pair_features(pairs: DataFrame, records: DataFrame, similarity=None) -> DataFrame:
    """Six features of each pair; records have id, name, object_type, source, published_at, keys, co_mentions.

    ``similarity`` scores names; distinct pairs of names are scored once.
    """
    cols = ("name", "object_type", "source", "published_at", "keys", "co_mentions")
    side = lambda s: records.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in cols])
    p = pairs.join(side("a"), "a").join(side("b"), "b")
    gap = F.abs(F.timestamp_diff("SECOND", F.col("published_at_a"), F.col("published_at_b"))) / 86400.0
    out = p.select(
        "a",
        "b",
        "name_a",
        "name_b",
        jaccard(F.col("keys_a"), F.col("keys_b")).alias("key_overlap"),
        jaccard(F.col("co_mentions_a"), F.col("co_mentions_b")).alias("co_mention_overlap"),
        F.coalesce(F.greatest(F.lit(0.0), 1 - gap / 30), F.lit(0.5)).alias("temporal_proximity"),
        (F.col("source_a") == F.col("source_b")).cast("double").alias("same_source"),
        (F.col("object_type_a") == F.col("object_type_b")).cast("double").alias("same_type"),
    )
    if similarity is None:
        return out
    names = out.select("name_a", "name_b").distinct()
    return out.join(names.withColumn("name_similarity", similarity("name_a", "name_b")), ["name_a", "name_b"])


def probability(weights=fixed.PAIR_WEIGHTS, intercept: float = fixed.PAIR_INTERCEPT, features=fixed.PAIR_FEATURES) -> Column:
    total = F.lit(intercept)
    for w, f in zip(weights, features, strict=True):
        total = total + F.lit(w) * F.col(f)
    return 1 / (1 + F.exp(-total))


def explain(scored: DataFrame, weights=fixed.PAIR_WEIGHTS, features=fixed.PAIR_FEATURES) -> DataFrame:
    """(a, b, feature, value, contribution) rows."""
    parts = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), (F.lit(w) * F.col(f)).alias("contribution")) for w, f in zip(weights, features, strict=True)]
    return scored.select("a", "b", F.explode(F.array(*parts)).alias("x")).select("a", "b", "x.*")


def matches(scored: DataFrame, accepted: DataFrame, rejected: DataFrame, threshold: float = fixed.PAIR_THRESHOLD) -> DataFrame:
    """(a, b, similarity): pairs at the threshold that no one rejected, and those someone accepted."""
    good = scored.where(F.col("p") >= threshold).select("a", "b", F.col("p").alias("similarity")).join(rejected, ["a", "b"], "left_anti")
    return good.join(accepted, ["a", "b"], "left_anti").unionByName(accepted.select("a", "b", F.lit(1.0).alias("similarity")))


def _linked_completely(members: list[int], score: dict[tuple[int, int], float], threshold: float) -> list[set[int]]:
    """Groups of sorted members: the two whose worst pair is best are merged while that pair reaches the threshold.

    Pairs without a score never reach it, so only groups whose members all meet are kept in the heap. Of equal ones
    the later in order goes first; a group has the place of its least member.
    """
    groups = {x: {x} for x in members}
    near: dict[int, dict[int, float]] = {x: {} for x in members}
    for (x, y), v in score.items():
        if v >= threshold and x in near and y in near:
            near[x][y] = near[y][x] = v
    heap = [(-v, -x, -y) for x, row in near.items() for y, v in row.items() if x < y]
    heapify(heap)
    while heap:
        v, x, y = (-k for k in heappop(heap))
        if near[x].get(y) != v:
            continue  # one of them has been merged meanwhile
        a, b = near[x], near[y]
        for own, row in ((x, a), (y, b)):
            for k in row:
                near[k].pop(own, None)
        near[x], near[y] = {k: min(a[k], b[k]) for k in a.keys() & b.keys()}, {}
        for k, w in near[x].items():
            near[k][x] = w
            heappush(heap, (-w, -min(x, k), -max(x, k)))
        groups[x] |= groups.pop(y)
    return list(groups.values())


def _cluster(edges: list[tuple[float, int, int]], apart: set[tuple[int, int]], most: int, threshold: float) -> dict[int, int]:
    """Union by falling similarity unless that joins two that must stay apart; large clusters split by complete linkage."""
    members = {x: {x} for _, a, b in edges for x in (a, b)}
    root = {x: x for x in members}
    forbidden: dict[int, set[int]] = {x: set() for x in members}  # roots that a root must not join
    for x, y in apart:
        if x in members and y in members:
            forbidden[x].add(y)
            forbidden[y].add(x)
    for _, a, b in sorted(edges, key=lambda e: (-e[0], e[1], e[2])):
        p, q = root[a], root[b]
        if p == q or q in forbidden[p]:
            continue
        if len(members[p]) < len(members[q]):
            p, q = q, p
        for x in members[q]:
            root[x] = p
        members[p] |= members.pop(q)
        for x in forbidden.pop(q):
            forbidden[x].discard(q)
            forbidden[x].add(p)
            forbidden[p].add(x)
    score = {(min(a, b), max(a, b)): s for s, a, b in edges}
    of = {x: [] for x in members}
    for pair, s in score.items():
        if root[pair[0]] == root[pair[1]]:
            of[root[pair[0]]].append((pair, s))
    out = {}
    for r, group in members.items():
        for p in _linked_completely(sorted(group), dict(of[r]), threshold) if len(group) > most else [group]:
            out |= {x: min(p) for x in p}
    return out


def clusters(edges: DataFrame, apart: DataFrame, most: int = 25, threshold: float = fixed.PAIR_THRESHOLD) -> DataFrame:
    """(id, cluster): constrained clusters of (a, b, similarity) edges, named by their least member.

    Both ends of an edge, and of every constraint that matters, lie in one connected component, so
    components are clustered apart, each by itself.
    """
    comp = components(edges.select("a", "b"))
    e = edges.join(comp, edges.a == comp.node).select("comp", "a", "b", "similarity", F.lit(False).alias("apart"))
    c = apart.join(comp, apart.a == comp.node).select("comp", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(0.0).alias("similarity"), F.lit(True).alias("apart"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf[["similarity", "a", "b", "apart"]].itertuples(index=False, name=None))
        got = _cluster([(s, a, b) for s, a, b, x in rows if not x], {(a, b) for _, a, b, x in rows if x}, most, threshold)
        return pd.DataFrame({"id": list(got), "cluster": list(got.values())}, dtype="int64")

    return e.unionByName(c).groupBy("comp").applyInPandas(run, "id long, cluster long")
