import math

import numpy as np
import pytest

from lodestone.llm import topk


def brute(rows, k, scale=64.0):
    good = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % 5 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in good if j != i)[:k]
            out += [(i, r, j, -x) for r, (x, j) in enumerate(s, 1)]
    return sorted(out)


def rows(n=400, seed=0):
    r = np.random.default_rng(seed)
    out = [(i, [float(x) for x in r.normal(0, 0.2, 8)]) for i in range(n)]
    hot = [0.25] * 8
    out += [(n + i, hot) for i in range(150)]
    return out + [(2000, None), (2005, [1.0, None] + [0.0] * 6), (2010, [float("nan")] * 8), (2015, [float("inf")] * 8), (None, hot), (2020, []), (2025, [1.0])]


@pytest.mark.parametrize("limit", [32 << 20, 1000])
def test_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(topk, "CHUNK_BYTES", limit)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16 if limit == 1000 else 512)
    data = rows()
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").selectExpr("*", "'x' as rank", "0 as score").repartition(5)
    got = topk.top_k(df, df.where("vec_id % 5 = 0"), 20, scale=64.0)
    assert sorted(map(tuple, got.collect())) == brute(data, 20)


def test_few_and_none_and_large(spark):
    few = [(0, [1.0, 2.0]), (1, [1.0, 1.0]), (2, [-3.0, 0.5])]
    df = spark.createDataFrame(few, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df, df.where("vec_id % 5 = 0"), 20).collect())) == brute(few, 20, 1.0)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    assert topk.top_k(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0
    large = [(0, [2.0**30, 1.0]), (1, [2.0**30, 1.0]), (2, [2.0**30, 2.0]), (3, [2.0**30, 3.0])]
    df = spark.createDataFrame(large, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df, df.where("vec_id % 5 = 0"), 2).collect())) == brute(large, 2, 1.0)
