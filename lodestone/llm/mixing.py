"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree.

A block is one copy of one document. ``plan`` finds, for each source, its target in words, how
many whole passes over it that takes, and where in the source's permutation (documents by a
keyed hash) the last, partial pass ends. The quota of blocks of every source is then halved
again and again among the output shards: each part gets blocks in proportion to its shards (within
one) and draws its count of each source from the hypergeometric law of what the node holds, so
quotas are exact in every node, for any number of shards. A shard's blocks are the next unused stretch of each source's
permutation, and are ordered by another hash within the shard.

Everything is DataFrame functions. Text is read where it lies and never shuffled: what decides
about a row is its source and hash and one small row a source. Per-source sums run over 4,096
hash buckets, then 4,096 within the one that holds the border, so no source meets in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, small, words

_FINE, _COARSE = 39, 51  # h has 63 bits: 4,096 buckets of 4,096


def _with_hash(docs: DataFrame, text: str, doc_id: str, source: str, seed: int) -> DataFrame:
    """key: the source as a string that is never null. h: the row's place in the permutation."""
    return docs.withColumns(
        {
            "_key": F.coalesce(F.concat(F.lit("+"), F.col(source).cast("string")), F.lit("-")),
            "_h": F.shiftright(F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)), 1),
        }
    )


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Adds target to (source, source_size, ...): shares of ``share`` of all words by weight, capped.

    Sources in code-point order, null last, take the weights in turn. A target stops at ``cap``
    times its source; what is left over goes to the others by weight, until none is above its
    cap. Sorted by cap over weight, the capped sources are a prefix, so one running sum finds it.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("_at") - 1, F.lit(len(weights))) + 1).cast("int"))
    out = sizes.withColumn("_at", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("_w", w)
    out = out.withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_at")
    whole = Window.partitionBy()
    out = out.withColumns(
        {
            "_level": (F.sum("source_size").over(whole) * F.lit(float(share)) - (F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_cap")))
            / F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    out = out.withColumn("_level", F.min(F.when(F.col("_level") * F.col("_w") < F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), F.col("_at"), F.col("_level").alias("level")))).over(whole)["level"])
    out = out.withColumn("target", F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_level") * F.col("_w"))))
    return out.drop("_at", "_w", "_cap", "_level")


def _border(rows: DataFrame, bits: int, base: Column) -> DataFrame:
    """The hash bucket in which the running words first pass the rest: (_key, b, base)."""
    by = rows.groupBy("_key", F.shiftright("_h", bits).alias("b")).agg(F.sum("size").alias("w"), F.first("rest").alias("rest"), F.first(base).alias("base"))
    by = by.withColumn("to", F.col("base") + F.sum("w").over(Window.partitionBy("_key").orderBy("b")))
    low = by.where("to > rest").groupBy("_key").agg(F.min(F.struct("b", (F.col("to") - F.col("w")).alias("base"))).alias("x"))
    return low.select("_key", "x.b", "x.base")


def plan(units: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, shards: int = 16, seed: int = 0) -> DataFrame:
    """One row per source of (_key, _h, source, size, doc_id) units: what decides about its rows.

    source, source_size, target, passes (whole ones), cutoff (hashes below it are in the partial
    pass too), filler (hash of the one more row whose size comes nearest to what then lacks), and
    bounds: where in (pass, hash) order each shard's stretch begins.
    """
    sizes = units.groupBy("_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goal = targets(sizes, weights, share, cap)
    goal = goal.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    goal = goal.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    goal = cut(goal)
    n = goal.count()
    of = units.join(small(goal.where("rest > 0").select("_key", "rest"), n), "_key")
    first = cut(_border(of, _COARSE, F.lit(0)))
    inside = of.withColumn("b", F.shiftright("_h", _COARSE)).join(small(first, n), ["_key", "b"]).drop("b")
    second = cut(_border(inside, _FINE, F.col("base")))
    inside = of.withColumn("b", F.shiftright("_h", _FINE)).join(small(second, n), ["_key", "b"])
    inside = inside.withColumn("to", F.col("base") + F.sum("size").over(Window.partitionBy("_key").orderBy("_h")))
    ended = inside.groupBy("_key").agg(F.coalesce(F.max(F.when(F.col("to") <= F.col("rest"), F.col("_h") + 1)), F.first(F.shiftleft("b", _FINE))).alias("cutoff"), F.coalesce(F.max(F.when(F.col("to") <= F.col("rest"), F.col("to"))), F.first("base")).alias("got"))
    ended = cut(ended)
    lack = of.join(small(ended, n), "_key").where((F.col("_h") >= F.col("cutoff")) & (F.col("size") > 0))
    lack = lack.withColumn("off", F.abs(F.col("size") - (F.col("rest") - F.col("got")))).where(F.col("off") < F.col("rest") - F.col("got"))
    filler = lack.groupBy("_key").agg(F.min(F.struct("off", "_h"))["_h"].alias("filler"))
    goal = cut(goal.join(ended.drop("got"), "_key", "left").join(filler, "_key", "left").drop("rest"))
    return cut(goal.join(_bounds(units, goal, n, shards, seed), "_key", "left"))


def _copies(h: Column) -> Column:
    """Passes in which a row is drawn; the filler comes after the partial pass."""
    whole = F.when(F.col("passes") > 0, F.sequence(F.lit(0), F.col("passes") - 1)).otherwise(F.array().cast("array<int>"))
    return F.concat(
        whole,
        F.when(h < F.col("cutoff"), F.array(F.col("passes"))).otherwise(F.array().cast("array<int>")),
        F.when(h == F.col("filler"), F.array(F.col("passes") + 1)).otherwise(F.array().cast("array<int>")),
    )


def _bounds(units: DataFrame, goal: DataFrame, n: int, shards: int, seed: int) -> DataFrame:
    drawn = units.join(small(goal.select("_key", "passes", "cutoff", "filler"), n), "_key").withColumn("pass", F.explode(_copies(F.col("_h"))))
    drawn = drawn.select("_key", "pass", "_h", "doc_id").withColumn("b", F.shiftright("_h", _COARSE))
    by = drawn.groupBy("_key", "pass", "b").agg(F.count("*").alias("n"))
    by = cut(by.withColumn("base", F.sum("n").over(Window.partitionBy("_key").orderBy("pass", "b")) - F.col("n")))
    quota = by.groupBy("_key").agg(F.sum("n").alias("q"))
    leaves = quota.agg(F.array_sort(F.collect_list(F.struct("_key", "q"))).alias("held")).select("held", F.lit(0).alias("node"), F.lit(max(1, shards)).alias("shards"))
    for _ in range(max(0, math.ceil(math.log2(max(1, shards))))):
        # a node of s shards gives its first half, s div 2 of them, that share of its blocks
        leaves = leaves.withColumn("left", F.when(F.col("shards") > 1, F.expr(_SPLIT.format(seed=int(seed)))).otherwise(F.col("held")))
        right = F.transform("held", lambda x, i: F.struct(x["_key"].alias("_key"), (x["q"] - F.element_at(F.col("left"), (i + 1).cast("int"))["q"]).alias("q")))
        half = F.expr("shards div 2").cast("int")
        first = F.struct(F.col("node"), F.greatest(half, F.lit(1)).alias("shards"), F.col("left").alias("held"))
        second = F.struct((F.col("node") + half).alias("node"), (F.col("shards") - half).alias("shards"), right.alias("held"))
        leaves = leaves.select(F.explode(F.when(F.col("shards") > 1, F.array(first, second)).otherwise(F.array(first))).alias("x")).select("x.*")
        leaves = cut(leaves)
    stretch = leaves.select(F.col("node").alias("shard"), F.explode("held").alias("x")).select("shard", "x.*")
    stretch = stretch.withColumn("at", F.sum("q").over(Window.partitionBy("_key").orderBy("shard")) - F.col("q")).where("q > 0")
    # the block with which each stretch begins: rank = blocks of earlier buckets + place in its own
    edge = cut(stretch.select("_key", "at", "shard"))
    hit = by.join(small(edge), "_key").where("at >= base and at < base + n").select("_key", "pass", "b", "base", "at", "shard")
    hit = hit.groupBy("_key", "pass", "b").agg(F.first("base").alias("base"), F.collect_list(F.struct("at", "shard")).alias("ats"))
    inside = drawn.join(small(cut(hit)), ["_key", "pass", "b"])
    inside = inside.withColumn("rank", F.col("base") + F.row_number().over(Window.partitionBy("_key", "pass", "b").orderBy("_h", "doc_id")) - 1)
    found = inside.withColumn("a", F.explode("ats")).where("a.at = rank").select("_key", F.struct("pass", "_h", "a.shard").alias("x"))
    return found.groupBy("_key").agg(F.sort_array(F.collect_list("x")).alias("bounds"))


#: Splits a node: sources in order draw from what is left of the first half's blocks. Of ``n`` blocks left, of which
#: ``l`` are the half's, a source's ``q`` give a hypergeometric number ``d``. Where its deviation is at most 10, the
#: draw inverts the law itself, summed from the mode outwards over all values up to 100 from it, which leaves less than
#: 1e-20 of it out; elsewhere it is the mean plus a normal deviate, rounded into the support.
_WIDE = 100
_TERMS = """aggregate(sequence(1, {wide}), struct(1D as w, {start} as acc, {at} as k),
      (t, i) -> struct(t.w * {ratio} as w, {step} as acc, t.k {sign} 1 as k), t -> t.acc)"""


def _law() -> str:
    up = "greatest(0D, cast((s.l - t.k) * cast(x.q - t.k as double) as double) / ((t.k + 1D) * greatest(1, s.n - s.l - x.q + t.k + 1)))"
    down = "greatest(0D, cast(t.k * cast(s.n - s.l - x.q + t.k as double) as double) / ((s.l - t.k + 1D) * (x.q - t.k + 1D)))"
    terms = lambda ratio, sign, start, step: _TERMS.format(wide=_WIDE, at="m", ratio=ratio, sign=sign, start=start, step=step)
    above, below = (terms(r, g, "0D", f"t.acc + t.w * {r}") for r, g in ((up, "+"), (down, "-")))
    # how many terms above (below) the mode the point passes
    climb = terms(up, "+", "struct(p - 1D as left, 0L as d)", f"struct(t.acc.left - t.w * {up} as left, t.acc.d + if(t.acc.left >= 0 and t.w * {up} > 0, 1, 0) as d)") + ".d"
    fall = terms(down, "-", "struct(p - 1D - a as left, 0L as d)", f"struct(t.acc.left - t.w * {down} as left, t.acc.d + if(t.acc.left >= 0 and t.w * {down} > 0, 1, 0) as d)") + ".d"
    let = lambda name, value, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    pick = f"case when p < 1D then m when p < 1D + a then m + {climb} else m - {fall} end"
    exact = let("m", "cast(floor((s.l + 1D) * ((x.q + 1D) / (s.n + 2D))) as bigint)", let("a", above, let("b", below, let("p", "x.u * (1D + a + b)", pick))))
    mean, var = "if(s.n > 0, s.l * (x.q / s.n), 0D)", "if(s.n > 1, greatest(0D, s.l * (x.q / s.n) * ((s.n - x.q) / s.n) * ((s.n - s.l) / (s.n - 1))), 0D)"
    drawn = f"if({var} <= 100D, {exact}, cast(round({mean} + x.z * sqrt({var})) as bigint))"
    return f"greatest(0L, s.l - (s.n - x.q), least(s.l, x.q, {drawn}))"


_SPLIT = f"""aggregate(
  transform(held, x -> struct(x._key as _key, x.q as q,
    (pmod(xxhash64({{seed}}, 1, node, shards, x._key), 9007199254740992) + 0.5D) / 9007199254740992 as u,
    sqrt(-2 * ln((pmod(xxhash64({{seed}}, 1, node, shards, x._key), 9007199254740992) + 0.5D) / 9007199254740992))
    * cos(2 * pi() * pmod(xxhash64({{seed}}, 2, node, shards, x._key), 9007199254740992) / 9007199254740992) as z)),
  struct(aggregate(held, 0L, (s, x) -> s + x.q) as n,
         aggregate(held, 0L, (s, x) -> s + x.q) * (shards div 2) div shards as l,
         cast(array() as array<struct<_key: string, q: bigint>>) as done),
  (s, x) -> element_at(transform(array({_law()}), d -> named_struct(
    'n', s.n - x.q, 'l', s.l - d, 'done', concat(s.done, array(named_struct('_key', x._key, 'q', d))))), 1),
  s -> s.done)"""


def decide(rows: DataFrame, planned: DataFrame, seed: int = 0) -> DataFrame:
    """Adds drawn to rows that have _key and _h: an array of (pass, shard, place) of their copies."""
    out = rows.join(small(planned.select(F.col("_key").alias("_k"), "source_size", "target", "passes", "cutoff", "filler", "bounds")), F.col("_key") == F.col("_k"))

    def block(p: Column) -> Column:
        before = F.filter("bounds", lambda b: (b["pass"] < p) | ((b["pass"] == p) & (b["_h"] <= F.col("_h"))))
        shard = F.coalesce(F.try_element_at(before, F.lit(-1))["shard"], F.lit(0))
        return F.struct(p.alias("pass"), shard.alias("shard"), F.xxhash64(F.lit(seed), F.lit("place"), p, "_h").alias("place"))

    return out.withColumn("drawn", F.transform(_copies(F.col("_h")), block)).drop("_k", "passes", "cutoff", "filler", "bounds")


def measure(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: int = 0) -> DataFrame:
    """The units of the documents: doc_id, source, size, and the two columns that decide."""
    rows = _with_hash(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")), "text", "doc_id", "source", seed)
    return cut(rows.select("doc_id", "source", words(F.col("text")).alias("size"), "_key", "_h"))


def mixed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, shards: int = 16, seed: int = 0) -> DataFrame:
    """The mix: the documents' own columns, a row per copy drawn, and mix_shard, mix_place.

    Sort by mix_place within mix_shard to read a shard in its shuffled order. Null or wordless
    texts have size 0 and are drawn only in whole passes. Null sources are one source, the last.
    Rows alike in doc_id and text have the same hash and are drawn together; ties of hashes go by
    doc_id. Very long texts are one block like any other and never shuffled. An empty table gives
    an empty mix. Columns that clash with mix_shard or mix_place are replaced, others stay.
    """
    planned = plan(measure(docs, text, doc_id, source, seed), weights, share, cap, shards, seed)
    own = [c for c in docs.columns if c not in ("mix_shard", "mix_place")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.col(text).alias("_t"), F.col(doc_id).alias("_d"), F.col(source).alias("_s"))
    rows = decide(_with_hash(rows, "_t", "_d", "_s", seed), planned, seed).select("_row", F.explode("drawn").alias("_x"))
    return rows.select("_row.*", F.col("_x.shard").alias("mix_shard"), F.col("_x.place").alias("mix_place"))


def taken(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, shards: int = 16, seed: int = 0) -> DataFrame:
    """One row per document: its size, its source's size and target, the words taken, the shards.

    Nulls, repeats, very long texts and empty tables are as in ``mixed``; other columns are ignored,
    whatever their names.
    """
    units = measure(docs, text, doc_id, source, seed)
    rows = decide(units, plan(units, weights, share, cap, shards, seed), seed)
    return rows.select("doc_id", "size", "source_size", "target", (F.size("drawn") * F.col("size")).cast("long").alias("taken"), F.col("drawn.shard").alias("shards"))
