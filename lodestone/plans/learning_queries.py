"""Evaluation, sampling, page sources and publication contract queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify, learning
from ..sources import pages as sources
from . import model
from .catalogue import read, register

_GOLD = "gold AS (SELECT * FROM mentions WHERE (doc_id * 7 + length(surface)) % 10 > 0), pred AS (SELECT * FROM mentions WHERE (doc_id * 3 + length(surface)) % 8 > 0)"
_SIDES = f"WITH {model.MENTIONS_SQL}, {_GOLD}, x AS (SELECT coalesce(p.doc_id, g.doc_id) AS doc_id, coalesce(p.surface, g.surface) AS surface, coalesce(p.object_type, g.object_type) AS object_type, p.doc_id IS NOT NULL AS p, g.doc_id IS NOT NULL AS g FROM pred p FULL JOIN gold g ON p.doc_id = g.doc_id AND p.surface = g.surface AND p.object_type = g.object_type)"
_PRF = "tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = model.mentions(spark, sf_dir)
    return m.where("(doc_id * 3 + length(surface)) % 8 > 0"), m.where("(doc_id * 7 + length(surface)) % 10 > 0")


_KEYS = ["doc_id", "surface", "object_type"]


@register("a18_span_scores", f"{_SIDES}, n AS (SELECT count(*) FILTER (WHERE p AND g) AS tp, count(*) FILTER (WHERE NOT g) AS fp, count(*) FILTER (WHERE NOT p) AS fn FROM x) SELECT tp, fp, fn, {_PRF} FROM n")
def span_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.span_scores(*_sides(spark, sf_dir), _KEYS)


@register("a19_span_scores_by_type", f"{_SIDES}, n AS (SELECT object_type, count(*) FILTER (WHERE p AND g) AS tp, count(*) FILTER (WHERE NOT g) AS fp, count(*) FILTER (WHERE NOT p) AS fn FROM x GROUP BY 1) SELECT object_type, tp, fp, fn, {_PRF} FROM n")
def span_scores_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.span_scores(*_sides(spark, sf_dir), _KEYS, ["object_type"])


@register("a20_span_errors", f"{_SIDES} SELECT doc_id, surface, object_type, CASE WHEN p THEN 'spurious' ELSE 'missed' END AS kind FROM x WHERE p <> g")
def span_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.span_errors(*_sides(spark, sf_dir), _KEYS)


_SCORES = "s AS (SELECT doc_id AS id, quality AS label, ((doc_id * 37 + quality * 300) % 1000) / 1000.0::DOUBLE AS score, doc_id % 40 AS grp FROM labels)"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), (((F.col("doc_id") * 37 + F.col("quality") * 300) % 1000) / 1000.0).alias("score"), (F.col("doc_id") % 40).alias("grp"))


@register(
    "a21_binary_metrics",
    f"WITH {_SCORES}, n AS (SELECT count(*) FILTER (WHERE score >= 0.6 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 0.6 AND label <> 1) AS fp, count(*) FILTER (WHERE score < 0.6 AND label = 1) AS fn, count(*) FILTER (WHERE score < 0.6 AND label <> 1) AS tn, avg((score - label) ** 2) AS brier FROM s) SELECT tp, fp, fn, tn, brier, {_PRF} FROM n",
)
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.binary_metrics(_scores(spark, sf_dir), 0.6)


@register("a22_w12_average_precision", f"WITH {_SCORES}, r AS (SELECT label, row_number() OVER w AS r, sum(label) OVER w AS f FROM s WINDOW w AS (ORDER BY score DESC, id)) SELECT sum(f / r) FILTER (WHERE label = 1) / sum(label) AS average_precision FROM r")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.average_precision(_scores(spark, sf_dir))


@register("a23_calibration", f"WITH {_SCORES} SELECT least(floor(score * 5), 4)::INT AS bin, count(*) AS n, avg(score) AS mean_score, avg(label) AS rate FROM s GROUP BY 1")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.calibration(_scores(spark, sf_dir))


@register(
    "a25_wilson_by_group",
    f"WITH {_SCORES}, n AS (SELECT grp, sum(label)::DOUBLE AS h, count(*)::DOUBLE AS n FROM s GROUP BY grp) SELECT grp, (h / n + 1.645 ** 2 / (2 * n) - 1.645 * sqrt(h / n * (1 - h / n) / n + 1.645 ** 2 / (4 * n * n))) / (1 + 1.645 ** 2 / n) AS lower FROM n",
)
def wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).groupBy("grp").agg(learning.wilson_lower(F.sum("label").cast("double"), F.count("*").cast("double")).alias("lower"))


@register("a26_bootstrap_interval")
def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval of how much lower the scorer's squared error is than that of a constant one half, pair by pair."""
    loss = lambda c: F.pow(c - F.col("label"), 2)
    return learning.bootstrap(_scores(spark, sf_dir).select("id", (loss(F.lit(0.5)) - loss(F.col("score"))).alias("difference")))


_THRESHOLDS = ", ".join(f"({0.3 + 0.05 * k:.2f}::DOUBLE)" for k in range(11))


@register(
    "l06_best_threshold",
    f"WITH {_SCORES}, n AS (SELECT t, count(*) FILTER (WHERE score >= t AND label = 1) AS tp, count(*) FILTER (WHERE score >= t AND label <> 1) AS fp, count(*) FILTER (WHERE score < t AND label = 1) AS fn FROM s, (VALUES {_THRESHOLDS}) AS g(t) GROUP BY t), f AS (SELECT t, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END::DOUBLE AS f1 FROM n) SELECT greatest(t, 0.6) AS threshold, f1 FROM f ORDER BY f1 DESC, t LIMIT 1",
)
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.best_threshold(_scores(spark, sf_dir))


_WILSON = "(p + 1.645 ** 2 / (2 * n) - 1.645 * sqrt(p * (1 - p) / n + 1.645 ** 2 / (4 * n * n))) / (1 + 1.645 ** 2 / n)"


@register(
    "l07_candidate_verdict",
    f"""WITH {_SCORES}, m AS (SELECT sum(label)::BIGINT AS positives, (count(*) - sum(label))::BIGINT AS negatives, avg((0.5 - label) ** 2 - (score - label) ** 2) AS low, count(*) FILTER (WHERE score >= 0.6 AND label = 1) / count(*) FILTER (WHERE score >= 0.6) AS p, count(*) FILTER (WHERE score >= 0.6)::DOUBLE AS n FROM s),
        r AS (SELECT list_filter([CASE WHEN positives < 60 THEN 'too_few_positives' END, CASE WHEN negatives < 60 THEN 'too_few_negatives' END, CASE WHEN coalesce(low <= 0, true) THEN 'no_better_than_the_baseline' END, CASE WHEN coalesce({_WILSON} < 0.9, true) THEN 'precision_not_proven' END], lambda x: x IS NOT NULL) AS reasons FROM m)
        SELECT CASE WHEN len(reasons) = 0 THEN 'eligible_for_manual_deployment_review' ELSE 'not_proven' END AS outcome, reasons FROM r""",
)
def candidate_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, hit = _scores(spark, sf_dir), F.col("score") >= 0.6
    gain = F.pow(0.5 - F.col("label"), 2) - F.pow(F.col("score") - F.col("label"), 2)
    n = s.agg(F.sum("label").alias("positives"), (F.count("*") - F.sum("label")).alias("negatives"), F.avg(gain).alias("low"), F.count_if(hit & (F.col("label") == 1)).alias("h"), F.count_if(hit).alias("n"))
    return classify.verdict(n.withColumn("precision_low", learning.wilson_lower(F.col("h"), F.col("n"))))


@register("l03_sampled_pairs")
def sampled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of pairs to label: quotas by stratum under caps on names and sources."""
    s = _scores(spark, sf_dir)
    rows = s.select(F.col("id").alias("pair_id"), learning.stratum(F.col("score"), F.col("label") != 0).alias("stratum"), F.concat(F.lit("n"), F.col("id") % 97).alias("left_group"), F.concat(F.lit("n"), F.col("id") % 89).alias("right_group"), F.col("grp").cast("string").alias("left_source"), F.concat(F.lit("s"), F.col("id") % 53).alias("right_source"))
    return learning.sample_pairs(rows, {"uncertain": 20, "high": 10, "low": 10, "diverse_name": 10}, "seed")


@register("c07_topic_classifier")
def topic_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and macro F1, on the fifth of the documents held out, of topics (here languages) learned from the others."""
    d = read(spark, sf_dir, "documents").where("lang is not null and text is not null").select("doc_id", "text", F.col("lang").alias("label"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    model = classify.train_topics(d.where(~held).drop("doc_id"), iterations=20)
    return classify.macro_f1(classify.predicted(model, d.where(held)))


@register(
    "l02_o07_strata",
    f"WITH {_SCORES} SELECT id, CASE WHEN abs(score - 0.6) <= 0.1 THEN 'uncertain' WHEN score >= 0.8 THEN 'high' WHEN score <= 0.2 THEN 'low' WHEN label = 0 THEN 'diverse_name' ELSE 'other' END AS stratum, sha256('seed' || chr(31) || grp || chr(31) || id) AS place FROM s",
)
def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scores(spark, sf_dir)
    return s.select("id", learning.stratum(F.col("score"), F.col("label") != 0).alias("stratum"), learning.seeded_order(F.lit("seed"), F.col("grp"), F.col("id")).alias("place"))


@register("l05_grouped_split", f"WITH {_SCORES}, g AS (SELECT grp, row_number() OVER (ORDER BY sha256('seed' || chr(31) || grp), grp) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT grp FROM s)) SELECT id, grp, CASE WHEN r <= greatest(1, least(n - 1, round_even(n * 0.2, 0))) THEN 'test' ELSE 'train' END AS split FROM s JOIN g USING (grp)")
def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.grouped_split(_scores(spark, sf_dir), "grp", "seed", 0.2).select("id", "grp", "split")


@register(
    "n04_n06_n07_values",
    "SELECT event_type, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS k, floor(count(*) / 40)::BIGINT AS batches FROM events GROUP BY event_type",
)
def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.975).alias("high"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"), F.floor(F.count("*") / 40).alias("batches"))


@register("s03_s04_links", r"""WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]+)"', 1)) AS href FROM pages) SELECT page_id, href, regexp_matches(href, '^/[A-Za-z]{2,4}$') AS short FROM l""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.links(read(spark, sf_dir, "pages")).withColumn("short", F.col("href").rlike("^/[A-Za-z]{2,4}$"))


def _sql_text(x: str) -> str:
    x = f"regexp_replace({x}, '(?s)<[^>]*>', '', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return f"trim(regexp_replace({x}, '[ \\t\\r\\n]+', ' ', 'g'))"


@register(
    "s14_f10_articles",
    f"""WITH a AS (SELECT page_id, url, {_sql_text("regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)")} AS title, array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?s)<p(?:\\s[^>]*)?>(.*?)</p>', 1), lambda p: {_sql_text("p")}), lambda p: p <> ''), ' ') AS body FROM pages)
        SELECT page_id, url, title, md5(body) AS body_md5, length(body) AS n FROM a WHERE title <> '' AND length(body) >= 120""",
)
def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = sources.articles(read(spark, sf_dir, "pages"), least=120)
    return a.select("page_id", "url", "title", model.md5(F.col("body")).alias("body_md5"), F.length("body").alias("n"))


@register(
    "s13_golden_occurrences",
    f"WITH {model.MENTIONS_SQL} SELECT m.doc_id, m.surface, (length(d.text) - length(replace(d.text, m.surface, ''))) / length(m.surface) = 1 AS once, strpos(d.text, m.surface) - 1 AS start FROM mentions m JOIN docs d ON d.id = m.doc_id",
)
def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = model.docs(spark, sf_dir).select(F.col("id").alias("doc_id"), "text")
    m = model.mentions(spark, sf_dir).join(d, "doc_id")
    n = (F.length("text") - F.length(F.replace("text", F.col("surface"), F.lit("")))) / F.length("surface")
    return m.select("doc_id", "surface", (n == 1).alias("once"), (F.expr("locate(surface, text)") - 1).cast("long").alias("start"))
