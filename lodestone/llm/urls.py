"""URL filters: rules first, then gradient-boosted trees on lexical features.

Rules are (host, path prefix) with a verdict; a rule fits its host and all subdomains, and the
longest that fits decides. The URLs that rules decide are the labelled ones: trees are fitted on
lexical features of a bounded sample of them (for either verdict ``TRAIN_ROWS`` / 2 distinct URLs,
those with the lowest hashes) and give the verdict of all others. Features: lengths, depth, shares
of digits and of other marks, character entropy, numbers of parameters, and statistics of the
host's last label: its share of hosts, and how many of its labelled hosts are blocked, shrunk
towards the share of all labelled hosts and taken from the folds of hosts other than the URL's, so
that no URL's own label, nor its site's, is among its features. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules of the registered query.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
TRAIN_ROWS = 20_000
PRIOR = 2.0
FOLDS = 4
FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "digits", "marks", "hyphens", "entropy", "parameters", "fragment", "secure", "longest_label", "suffix_length", "suffix_share", "suffix_blocked")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def match(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, written as host and path, and its verdict; else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def lexical(rows: DataFrame) -> DataFrame:
    """Adds the features that a URL's own characters give."""
    url, host, path = F.coalesce("_url", F.lit("")), F.col("host"), F.col("path")
    n = F.greatest(F.length(url), F.lit(1))
    share = F.transform(F.array_distinct(F.split(url, "")), lambda c: (F.length(url) - F.length(F.replace(url, c))) / n)
    return rows.withColumns(
        {
            "url_length": F.length(url).cast("double"),
            "host_length": F.length(host).cast("double"),
            "path_length": F.length(path).cast("double"),
            "depth": F.regexp_count(path, F.lit("/[^/]")).cast("double"),
            "labels": F.when(host == "", 0.0).otherwise(F.size(F.split(host, r"\.")).cast("double")),
            "digits": F.regexp_count(url, F.lit("[0-9]")) / n,
            "marks": F.regexp_count(url, F.lit("[^0-9A-Za-z]")) / n,
            "hyphens": F.regexp_count(host, F.lit("-")).cast("double"),
            "entropy": -F.aggregate(share, F.lit(0.0), lambda s, p: s + F.when(p > 0, p * F.log2(p)).otherwise(0.0)),
            "parameters": F.regexp_count(url, F.lit("[?&][^=&#]+=")).cast("double"),
            "fragment": F.contains(url, F.lit("#")).cast("double"),
            "secure": url.startswith("https:").cast("double"),
            "longest_label": F.array_max(F.transform(F.split(host, r"\."), F.length)).cast("double"),
            "_suffix": F.substring_index(host, ".", -1),
        }
    )


def host_statistics(rows: DataFrame) -> DataFrame:
    """(host, suffix_length, suffix_share, suffix_blocked): of the host's last label, over the hosts of other folds.

    A host's label is the mean verdict of its labelled URLs. Hosts fall into ``FOLDS`` by hash, and all hosts of a
    fold with one last label have the same statistics, which tell nothing of a host's own label. ``PRIOR`` hosts of
    the overall rate are added.
    """
    hosts = rows.groupBy("host", "_suffix").agg(F.avg((F.col("_ruled") == "block").cast("double")).alias("own"))
    hosts = cut(hosts.withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS))))
    by = hosts.groupBy("_suffix", "fold").agg(F.count("*").alias("n"), F.count("own").alias("known"), F.coalesce(F.sum("own"), F.lit(0.0)).alias("blocked"))
    whole = by.groupBy("_suffix").agg(F.sum("n").alias("n"), F.sum("known").alias("known_all"), F.sum("blocked").alias("blocked_all"))
    others = by.drop("n").join(whole, "_suffix")
    every = hosts.agg(F.count("*").alias("all"), F.coalesce(F.avg("own"), F.lit(0.5)).alias("rate")).first()
    return hosts.join(others, ["_suffix", "fold"]).select(
        "host",
        F.length("_suffix").cast("double").alias("suffix_length"),
        (F.col("n") / max(every["all"], 1)).alias("suffix_share"),
        ((F.col("blocked_all") - F.col("blocked") + PRIOR * every["rate"]) / (F.col("known_all") - F.col("known") + PRIOR)).alias("suffix_blocked"),
    )


def sampled(rows: DataFrame, train_rows: int) -> DataFrame:
    """Of either label, the distinct URLs of the lowest hashes, train_rows / 2 at most; weighted so that both labels weigh alike."""
    labelled = rows.where(F.col("rule").isNotNull()).withColumn("label", (F.col("_ruled") == "block").cast("double"))
    one = labelled.groupBy("_url").agg(F.first("label").alias("label"), *[F.first(f).alias(f) for f in FEATURES])
    most = max(1, train_rows // 2)
    each = [one.where(F.col("label") == v).orderBy(F.xxhash64("_url"), "_url").limit(most) for v in (0.0, 1.0)]
    sample = cut(each[0].unionByName(each[1]).coalesce(4))
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    weight = F.when(F.col("label") == 1, 1 / max(n.get(1.0, 0), 1)).otherwise(1 / max(n.get(0.0, 0), 1)) * sum(n.values())
    return sample.withColumn("_weight", weight)


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, url: str = "url", keep: tuple[str, ...] = ("page_id",), train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The kept columns with host, path, rule, verdict (allow or block), risk (the trees', 0 to 1).

    Null URLs and ones without ``://`` have an empty host and path; no rule fits those. Where the
    labelled URLs are of one verdict only, all others get it; where there are none, allow. Very
    long URLs are measured whole. Rows that repeat are judged alike, and count once in training;
    an empty table gives no rows; clashing columns aren't looked at.
    """
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.col(url).alias("_url"))
    host, path = split_url(F.col("_url"))
    rows = rows.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))
    rule, ruled = match(F.col("host"), F.col("path"), rules)
    rows = lexical(rows.withColumn("rule", rule).withColumn("_ruled", ruled))
    stats = cut(host_statistics(rows))
    rows = rows.join(small(stats), "host")
    names = ["_row.*", "host", "path", "rule"]
    sample = sampled(rows, train_rows)
    verdicts = [r["label"] for r in sample.select("label").distinct().collect()]
    if len(verdicts) < 2:
        only = "block" if 1.0 in verdicts else "allow"
        return rows.select(*names, F.coalesce("_ruled", F.lit(only)).alias("verdict"), F.lit(float(only == "block")).alias("risk"))
    judged = fitted(sample).transform(_assembler().transform(rows))
    return judged.select(*names, F.coalesce("_ruled", F.when(F.col("prediction") == 1, "block").otherwise("allow")).alias("verdict"), F.element_at(vector_to_array("probability"), 2).alias("risk"))


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="_features")


def fitted(sample: DataFrame):
    """The trees of a labelled sample."""
    trees = GBTClassifier(featuresCol="_features", labelCol="label", weightCol="_weight", maxIter=12, maxDepth=3, seed=7)
    return trees.fit(_assembler().transform(sample).select("_features", "label", "_weight"))
