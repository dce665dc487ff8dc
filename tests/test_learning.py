import random
from collections import Counter

import numpy as np
import pytest

from lodestone.operators import classify, learning


def test_bootstrap_by_brute_force(spark):
    r = random.Random(1)
    rows = [(i * 7 - 30, r.gauss(0.3, 1.0)) for i in range(300)]
    got = learning.bootstrap(spark.createDataFrame(rows, "id long, difference double").repartition(5), samples=400, seed=3).first()
    k = learning._draws(np.array([i for i, _ in rows]), 400, 3)
    means = (np.array([d for _, d in rows]) @ k) / k.sum(axis=0)
    assert abs(got.low - np.percentile(means, 2.5)) < 1e-9 and abs(got.high - np.percentile(means, 97.5)) < 1e-9
    assert abs(k.mean() - 1) < 0.02 and abs(k.var() - 1) < 0.03  # a Poisson law of mean one
    assert got.low < np.mean([d for _, d in rows]) < got.high


def test_average_precision_over_many_scores(spark):
    r = random.Random(2)
    rows = [(i, r.choice([r.random(), 0.5]), r.randrange(2)) for i in range(500)]
    got = learning.average_precision(spark.createDataFrame(rows, "id long, score double, label int").repartition(6)).first()[0]
    found, total = 0, 0.0
    for k, (_, _, y) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])), 1):
        found += y
        total += y * found / k
    assert abs(got - total / found) < 1e-9


def test_sampling_under_shared_caps(spark):
    r = random.Random(3)
    rows = [(f"p{i}", r.choice([*learning.STRATA, "other"]), f"n{r.randrange(12)}", f"n{r.randrange(12)}", f"s{r.randrange(9)}", f"s{r.randrange(9)}") for i in range(400)]
    rows += [(f"q{i}", "high", "n1", "n2", "s1", "s2") for i in range(60)]
    df = spark.createDataFrame(rows, "pair_id string, stratum string, left_group string, right_group string, left_source string, right_source string")
    quotas = {"uncertain": 5, "high": 6, "low": 3, "diverse_name": 4}
    got = sorted((x.pair_id, x.stratum, x.place) for x in learning.sample_pairs(df.repartition(4), quotas, "z").collect())
    import hashlib

    names, sources, want = Counter(), Counter(), []
    for stratum in learning.STRATA:
        ranked = sorted((x for x in rows if x[1] == stratum), key=lambda x: (hashlib.sha256("\x1f".join(["z", "survivors", stratum, x[0]]).encode()).hexdigest(), x[0]))
        place = 0
        for p, _, a, b, s, t in ranked:
            if place < quotas[stratum] and all(names[g] < 2 for g in {a, b}) and all(sources[x] < 3 for x in {s, t}):
                names.update({a, b})
                sources.update({s, t})
                place += 1
                want.append((p, stratum, place))
    assert got == sorted(want) and len(got) > 5


def test_scorer_and_verdict(spark):
    r = random.Random(4)
    rows = [(float(y) + r.gauss(0, 0.4), r.random(), y) for y in [0, 1] * 80]
    df = spark.createDataFrame(rows, "a double, b double, label int")
    weights, intercept = classify.train_scorer(df, ("a", "b"))
    assert weights[0] > 1 and abs(weights[1]) < weights[0] and intercept < 0
    row = lambda *x: spark.createDataFrame([x], "positives int, negatives int, low double, precision_low double")
    assert classify.verdict(row(80, 90, 0.1, 0.95)).first().outcome == "eligible_for_manual_deployment_review"
    assert classify.verdict(row(8, 90, -0.1, None)).first().reasons == ["too_few_positives", "no_better_than_the_baseline", "precision_not_proven"]


def test_topics(spark):
    r = random.Random(5)
    say = lambda y: " ".join(r.choice(["war front tank", "market bank price", "goal match team"][y].split() + ["the", "of"]) for _ in range(12))
    df = spark.createDataFrame([(say(y), "abc"[y]) for y in [0, 0, 0, 1, 2] * 30], "text string, label string")
    model = classify.train_topics(df, iterations=15)
    got = classify.macro_f1(classify.predicted(model, df)).first()
    assert got.accuracy > 0.95 and got.macro_f1 > 0.9


@pytest.mark.parametrize("rounds", [1, 5])
def test_rows_go_in_one_after_the_other(spark, rounds):
    from lodestone.sources.sinks import new_rows

    r = random.Random(rounds)
    rows = [(i, f"u{r.randrange(40)}", f"h{r.randrange(40)}") for i in range(150)] + [(500 + i, f"c{i // 2}", f"c{(i + 1) // 2}") for i in range(12)]
    old = [("u1", "x"), ("y", "h2")]
    urls, hashes, want = {u for u, _ in old}, {h for _, h in old}, []
    for i, u, h in rows:
        if u not in urls and h not in hashes:
            urls.add(u)
            hashes.add(h)
            want.append(i)
    got = new_rows(spark.createDataFrame(rows, "id long, url string, hash string").repartition(3), spark.createDataFrame(old, "url string, hash string"), ["url", "hash"], "id")
    assert sorted(x.id for x in got.collect()) == want
