import random

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm.language import Model, _sample, family, features, least_score, predict, svm, train, whole_loss

SYL = {"en": "the and ing er on tion wh ble".split(), "de": "der sch ein ung keit ü ß tz".split(), "fr": "le eau oi é tion que ê ç".split(), "es": "el ción ñ os ado lla mente í".split(), "ja": "の に は を 日 本 語".split()}


def text(r, lang, n=40):
    return " ".join("".join(r.choice(SYL[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def test_families_and_held_out_accuracy(spark):
    r = random.Random(1)
    rows = [(i, text(r, lang, r.randrange(5, 60)), lang) for i, lang in enumerate(r.choice(sorted(SYL)) for _ in range(600))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1)).repartition(4)
    model = train(df, usable=F.col("doc_id") % 3 != 1, per_language=50)
    assert model.langs == sorted(SYL) and family("pt-BR") == "romance" and family("ja") == "ja"
    got = predict(df, model, keep=("doc_id", "lang")).where("doc_id % 3 = 1").collect()
    assert sum(g.lang == g.lang_pred for g in got) / len(got) > 0.97
    assert all(0 <= g.score <= 1 for g in got)


def test_edges(spark):
    m = Model.fit([text(random.Random(i), x) for i, x in enumerate(["en", "de"] * 10)], ["en", "de"] * 10)
    assert m.predict([None, "", " 12 !?", "a"])[0][:3] == ["und"] * 3
    assert m.predict(["a"])[0][0] in ("en", "de")
    one = Model.fit(["the and"], ["en"])
    assert one.predict(["xyz"])[0] == ["en"]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = train(empty)
    assert model.langs == [] and predict(empty, model).count() == 0
    assert predict(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), model).first().lang_pred == "und"


def test_features_ignore_neighbours():
    a, _ = features(["abc def", "x" * 1000, None])
    b, some = features(["abc def"])
    assert (a[0] == b[0]).all() and some.all()


def test_the_sample_is_bounded_with_repeats_and_null_ids(spark):
    r = random.Random(5)
    hot = text(r, "en")
    rows = [(7, hot, "en")] * 500 + [(None, hot, "en")] * 20 + [(i, text(r, "de", 10), "de") for i in range(200)] + [(None, text(r, "fr", 10), "fr"), (3, None, "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as at", "2 as row").repartition(3)
    got = _sample(df, "text", "lang", 30, False).collect()
    assert sum(x.lang == "en" for x in got) == 1 and sum(x.lang == "de" for x in got) == 30 and len({x.text for x in got}) == len(got)
    model = train(df, per_language=30)
    assert {x.lang_pred for x in predict(df.where("doc_id = 7 and lang = 'en'"), model).collect()} == {"en"}
    assert 0 < least_score(df, model) < 0.5


def test_very_long_text(spark):
    r = random.Random(6)
    m = Model.fit([text(r, x) for x in ["en", "de", "fr"] * 10], ["en", "de", "fr"] * 10)
    assert m.predict([text(r, "de", 200_000)])[0] == ["de"]


def test_features_ignore_the_place_in_a_batch():
    some = ["abc def", "", "naïve 12", None, "x"]
    whole, alone = features(some)[0], np.vstack([features([t])[0] for t in some])
    assert (whole == alone).all()


def test_training_reads_all_texts(spark):
    """The losses are those over all texts, and the machines those that have the least, though the sample has three texts a language."""
    r = random.Random(8)
    rows = [(text(r, lang, r.randrange(1, 30)), lang) for lang in ["en", "de", "fr", "es"] for _ in range(60)] + [(None, "en"), ("12 !", "de"), ("the", None)]
    df = spark.createDataFrame(rows, "text string, lang string")
    first, model = train(df, per_language=3, passes=0), train(df, per_language=3)
    used = [(t, lang) for t, lang in rows if lang and t and any(map(str.isalpha, t))]
    x, _ = features([t for t, _ in used])

    def brute(m):
        out = []
        for k, (w, b) in enumerate(zip(m.weights, m.bias, strict=True)):
            own, y = machine(m, k)
            slack = np.maximum(0, 1 - y * (x[own] @ w + b))
            out.append((w @ w) / 2 + 10 * sum((slack[y == s] ** 2).mean() / 2 for s in (1, -1)))
        return np.array(out)

    def machine(m, k):
        if k < len(m.families):
            return np.ones(len(x), bool), np.array([1.0 if family(lang) == m.families[k] else -1.0 for _, lang in used])
        a, b = (m.langs[i] for i in m.pairs[k - len(m.families)])
        own = np.array([lang in (a, b) for _, lang in used])
        return own, np.array([1.0 if lang == a else -1.0 for _, lang in used])[own]

    for m in (first, model):
        assert np.allclose(whole_loss(df.repartition(5), m)[0], brute(m), rtol=1e-4)
    best = []
    for k in range(len(model.bias)):
        own, y = machine(model, k)
        w, b = svm(x[own], y, steps=400)
        best.append(Model(model.langs, np.tile(w, (len(model.bias), 1)), np.full(len(model.bias), b)))
    least = np.array([brute(m)[k] for k, m in enumerate(best)])
    assert (brute(model) - least < 0.4 * (brute(first) - least)).all()


def test_the_least_score_is_that_of_all_texts(spark):
    r = random.Random(4)
    df = spark.createDataFrame([(text(r, lang, r.randrange(1, 30)), lang) for lang in ["en", "de", "fr"] for _ in range(300)] + [("qqq", None), (None, "en")], "text string, lang string").repartition(3)
    model = train(df, passes=0)
    right = [g.score for g in predict(df, model, keep=("lang",)).collect() if g.lang == g.lang_pred]
    assert least_score(df, model) == min(right) / 2
