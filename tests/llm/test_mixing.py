import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lodestone.llm.mixing import _SPLIT, mixed, taken

WS = " \t\n\x0b\x0c\r"


def reference_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        level = (total - sum(target.values())) / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] >= 2 * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
        open_ -= over
    return target


def rows(seed=1, n=3000):
    r = random.Random(seed)
    out = []
    for i in range(n):
        s = "hot" if r.random() < 0.4 else r.choice(["a", "b", "Z", "ä", "tiny", None, "c", "d"])
        if s == "tiny" and r.random() < 0.9:
            s = "a"
        out.append((i, r.choice([None, "", " \n"]) if r.random() < 0.05 else "w " * max(1, int(r.lognormvariate(4, 1))), s))
    return out


def test_targets_and_taken(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("size", F.lit("x")).repartition(7)
    got = {r.doc_id: r for r in taken(df).collect()}
    again = {r.doc_id: r for r in taken(df.repartition(3)).collect()}
    assert got == again
    sizes, took = defaultdict(int), defaultdict(int)
    for i, t, s in data:
        n = len((t or "").split())
        assert got[i].size == n and got[i].taken in (0, n, 2 * n)
        sizes[s] += n
        took[s] += got[i].taken
    want = reference_targets(sizes)
    for i, _, s in data:
        assert abs(got[i].target - want[s]) < 1e-6 * max(1, want[s]) and got[i].source_size == sizes[s]
    for s in sizes:
        assert abs(took[s] - want[s]) <= max(2, 0.005 * want[s]), (s, took[s], want[s])


def test_mix_rows_and_shards(spark):
    df = spark.createDataFrame(rows(2, 2000), "doc_id long, text string, source string").withColumn("mix_shard", F.lit("clash"))
    m = mixed(df, shards=8).cache()
    t = {r.doc_id: (r.taken, r["size"], r.shards) for r in taken(df, shards=8).collect()}
    per = {r.doc_id: sorted(r.s) for r in m.groupBy("doc_id").agg(F.collect_list("mix_shard").alias("s")).collect()}
    assert all(len(s) * t[d][1] == t[d][0] and sorted(t[d][2]) == s for d, s in per.items())
    counts = [r["count"] for r in m.groupBy("mix_shard").count().collect()]
    assert len(counts) == 8 and max(counts) - min(counts) <= 3
    assert m.columns == ["doc_id", "text", "source", "mix_shard", "mix_place"]


def test_edges(spark):
    assert taken(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    one = taken(spark.createDataFrame([(1, None, None), (1, None, None), (None, "a b", "x")], "doc_id long, text string, source string")).collect()
    assert len(one) == 3 and sum(r.taken for r in one) in (2, 4)
    assert mixed(spark.createDataFrame([(1, "", "s")], "doc_id long, text string, source string")).count() >= 0


def test_split_follows_the_hypergeometric_law(spark):
    """Draws of many nodes against the exact law, by chi-squared; quotas of a node always add up."""
    draws = 6000
    for held, shards in (((3, 5), 2), ((40, 60), 2), ((2, 1, 9), 3), ((7, 50_000_000), 4), ((1, 1, 1, 1), 2), ((300, 200), 5)):
        n, left = sum(held), sum(held) * (shards // 2) // shards
        df = spark.range(draws).selectExpr("cast(id as int) as node", f"{shards} as shards", "array(" + ",".join(f"named_struct('_key', 'k{i}', 'q', {q}L)" for i, q in enumerate(held)) + ") as held")
        got = [r[0] for r in df.select(F.expr(_SPLIT.format(seed=3))["q"]).collect()]
        assert all(sum(x) == left and all(0 <= a <= b for a, b in zip(x, held)) for x in got)
        q, count = held[0], Counter(x[0] for x in got)
        logs = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
        law = {k: draws * math.exp(logs(q, k) + logs(n - q, left - k) - logs(n, left)) for k in range(max(0, left - n + q), min(q, left) + 1)}
        some = {k: e for k, e in law.items() if e >= 8}
        chi = sum((count[k] - e) ** 2 / e for k, e in some.items())
        assert chi < len(some) + 5 * math.sqrt(2 * len(some)) + 5, (held, chi, len(some))


def test_any_number_of_shards_and_disjoint_blocks(spark):
    data = rows(3, 700)
    df = spark.createDataFrame([(i, t, s) for i, t, s in data if t and t.strip()], "doc_id long, text string, source string")
    for shards in (1, 6):
        m = mixed(df, shards=shards).select("doc_id", "source", "mix_shard", "mix_place").collect()
        size = Counter(r.mix_shard for r in m)
        assert sorted(size) == list(range(shards)) and max(size.values()) - min(size.values()) <= 3
        # no block is in two shards: a document's copies are different passes, which have different places
        assert len({(r.doc_id, r.mix_place) for r in m}) == len(m)
        assert len(m) == sum(r.taken // r["size"] for r in taken(df, shards=shards).collect() if r["size"])
        by = Counter((r.source, r.mix_shard) for r in m)
        whole = Counter(r.source for r in m)
        assert all(abs(by[s, k] - whole[s] / shards) < 6 * math.sqrt(whole[s]) + 3 for s in whole for k in range(shards))


def test_repeats_and_very_long_texts(spark):
    long = "w " * 1_000_000
    got = taken(spark.createDataFrame([(1, long, "a"), (2, "x", "a"), (2, "x", "a"), (3, "x y", "b")], "doc_id long, text string, source string").selectExpr("*", "0 as target", "1 as _key")).collect()
    assert sorted((r.doc_id, r["size"]) for r in got) == [(1, 1_000_000), (2, 1), (2, 1), (3, 2)]
    assert len({r.taken for r in got if r.doc_id == 2}) == 1
