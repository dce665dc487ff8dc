"""Mentions, blocking, pair scoring, clusters, review and lineage queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed, names, text
from ..operators import latest as ops
from ..operators import resolve
from ..operators.graph import cut, reachable
from . import model
from .catalogue import read, register

_NAME = "p_name || ' ' || lower(p_type)"
_KEYS = """list_sort(list_distinct(list_concat(['full:' || array_to_string(t, ''), 'last:' || t[-1], 'sorted:' || array_to_string(list_sort(t), '')],
  CASE WHEN len(t) > 1 THEN ['firstlast:' || t[1] || substr(t[-1], 1, 1)] ELSE [] END,
  list_transform(range(1, greatest(length(array_to_string(t, '')) - 1, 1)), lambda i: 'tri:' || substr(array_to_string(t, ''), i::INT, 3)))))"""
_RECORDS = f"""r0 AS (SELECT {_NAME} AS name, min(p_partkey) AS id, any_value(p_size % 3) AS x FROM part GROUP BY 1),
  r1 AS (SELECT r0.id, name, string_split(name, ' ') AS t, p_brand AS source, p_size % 2 AS object_type, CASE WHEN p_size % 5 > 0 THEN TIMESTAMP '2024-01-01' + to_days(p_size::INT) END AS published_at FROM r0 JOIN part ON part.p_partkey = r0.id),
  records AS (SELECT id, name, source, object_type, published_at, {_KEYS} AS keys, string_split(name, ' ') AS co_mentions FROM r1),
  k AS (SELECT id, unnest(keys) AS key FROM records), sizes AS (SELECT key, count(*) AS size FROM k GROUP BY key)"""
_PAIRS = _RECORDS + ", kept AS (SELECT k.* FROM k JOIN sizes USING (key) WHERE size BETWEEN 2 AND 100), pairs AS (SELECT DISTINCT l.id AS a, r.id AS b FROM kept l JOIN kept r ON l.key = r.key AND l.id < r.id)"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names collapsed to their least part, as records to resolve."""
    p = read(spark, sf_dir, "part")
    name = F.concat("p_name", F.lit(" "), F.lower("p_type"))
    least = p.groupBy(name.alias("name")).agg(F.min("p_partkey").alias("id"))
    own = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("source"), (F.col("p_size") % 2).alias("object_type"), F.when(F.col("p_size") % 5 > 0, F.lit("2024-01-01").cast("timestamp_ntz") + F.expr("make_dt_interval(p_size)")).alias("published_at"))
    r = least.join(own, "id")
    return r.withColumn("keys", text.blocking_keys(F.split("name", " "), fixed.NAME_NOISE)).withColumn("co_mentions", F.split("name", " "))


@register("t15_blocking_keys", f"WITH {_RECORDS} SELECT id, array_to_string(keys, ',') AS keys FROM records")
def blocking_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("id", F.array_join("keys", ",").alias("keys"))


@register("r05_j12_candidate_pairs", f"WITH {_PAIRS} SELECT a, b FROM pairs")
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.candidate_pairs(_records(spark, sf_dir))


@register("a14_block_sizes", f"WITH {_RECORDS} SELECT size, count(*) AS n, size > 100 AS dropped FROM sizes GROUP BY size")
def block_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.blocks(_records(spark, sf_dir))[1].groupBy("size").agg(F.count("*").alias("n")).withColumn("dropped", F.col("size") > 100)


@register(
    "a16_a17_reduction_and_completeness",
    f"""WITH {_PAIRS}, n AS (SELECT count(*) AS n FROM records), truth AS (SELECT l.id AS a, r.id AS b FROM records l JOIN records r ON l.id < r.id AND split_part(l.name, ' ', 1) = split_part(r.name, ' ', 1) AND l.source = r.source)
        SELECT (SELECT count(*) FROM pairs) AS candidates, (SELECT CASE WHEN n > 1 THEN 1 - (SELECT count(*) FROM pairs) / (n * (n - 1) / 2) ELSE 0 END FROM n)::DOUBLE AS reduction,
          CASE WHEN count(*) > 0 THEN count(pairs.a) / count(*) ELSE 1 END::DOUBLE AS completeness FROM truth LEFT JOIN pairs ON truth.a = pairs.a AND truth.b = pairs.b""",
)
def reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    pairs = resolve.candidate_pairs(r)
    first = r.select("id", F.element_at(F.split("name", " "), 1).alias("first"), "source")
    truth = first.withColumnRenamed("id", "a").join(first.withColumnRenamed("id", "b"), ["first", "source"]).where("a < b").select("a", "b")
    hit = truth.join(pairs.withColumn("hit", F.lit(1)), ["a", "b"], "left").agg(F.count("*").alias("t"), F.count("hit").alias("h"))
    n = F.col("n")
    out = pairs.agg(F.count("*").alias("candidates")).join(F.broadcast(r.agg(F.count("*").alias("n")))).join(F.broadcast(hit))
    return out.select("candidates", F.when(n > 1, 1 - F.col("candidates") / (n * (n - 1) / 2)).otherwise(0.0).alias("reduction"), F.when(F.col("t") > 0, F.col("h") / F.col("t")).otherwise(1.0).alias("completeness"))


_JAC = "(CASE WHEN len(list_distinct(list_concat({0}, {1}))) > 0 THEN len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) ELSE 0 END)::DOUBLE"
_FEATURES = _PAIRS + (
    ", features AS (SELECT p.a, p.b, x.name AS name_a, y.name AS name_b, "
    + _JAC.format("x.keys", "y.keys")
    + " AS key_overlap, "
    + _JAC.format("x.co_mentions", "y.co_mentions")
    + " AS co_mention_overlap, coalesce(greatest(0.0, 1 - abs(date_diff('second', x.published_at, y.published_at)) / 86400.0 / 30), 0.5)::DOUBLE AS temporal_proximity, (x.source = y.source)::INT::DOUBLE AS same_source, (x.object_type = y.object_type)::INT::DOUBLE AS same_type FROM pairs p JOIN records x ON x.id = p.a JOIN records y ON y.id = p.b)"
)
_TOTAL = " + ".join([str(fixed.PAIR_INTERCEPT), *(f"{w} * {f}" for w, f in list(zip(fixed.PAIR_WEIGHTS, fixed.PAIR_FEATURES, strict=True))[1:])])


@register("r06_r07_features_and_scores", f"WITH {_FEATURES} SELECT a, b, key_overlap, co_mention_overlap, temporal_proximity, same_source, same_type, 1 / (1 + exp(-({_TOTAL}))) AS p FROM features")
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    f = resolve.pair_features(resolve.candidate_pairs(r), r)
    return f.withColumn("p", resolve.probability(fixed.PAIR_WEIGHTS[1:], fixed.PAIR_INTERCEPT, fixed.PAIR_FEATURES[1:])).drop("name_a", "name_b")


@register(
    "r08_explain",
    f"WITH {_FEATURES} " + " UNION ALL ".join(f"SELECT a, b, '{f}' AS feature, {f} AS value, {w} * {f} AS contribution FROM features" for w, f in list(zip(fixed.PAIR_WEIGHTS, fixed.PAIR_FEATURES, strict=True))[1:]),
)
def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    return resolve.explain(resolve.pair_features(resolve.candidate_pairs(r), r), fixed.PAIR_WEIGHTS[1:], fixed.PAIR_FEATURES[1:])


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    return resolve.pair_features(resolve.candidate_pairs(r), r, names.name_similarity).withColumn("p", resolve.probability())


@register("n01_r07_name_similarity_scores")
def name_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("a", "b", "name_similarity", "p")


@register("r09_r15_clusters")
def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with a few decisions, clustered; then every record's cluster and the clusters' canonical names."""
    r, s = _records(spark, sf_dir), cut(_scored(spark, sf_dir))  # read three times
    same_type = s.where("same_type = 1")
    rejected = same_type.where("(a + b) % 7 = 0").select("a", "b")
    edges = resolve.matches(same_type, same_type.where("(a + b) % 97 = 1").select("a", "b"), rejected)
    got = resolve.clusters(edges, rejected)
    out = r.join(got, "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))
    best = out.groupBy("cluster").agg(F.max_by("name", F.struct(F.size("co_mentions").alias("n"), F.length("name").alias("l"), "name")).alias("canonical"), F.count("*").alias("members"))
    return out.select("id", "cluster").join(best, "cluster")


@register(
    "x01_r01_mention_contexts",
    f"""WITH {model.MENTIONS_SQL}, names AS (SELECT doc_id, list(DISTINCT canonical) AS ns FROM mentions GROUP BY doc_id)
        SELECT m.doc_id, m.object_type, m.canonical, m.surface, d.source, array_to_string(list_sort(list_filter(ns, lambda n: n <> m.canonical)), ',') AS co_mentions
        FROM mentions m JOIN docs d ON d.id = m.doc_id AND NOT d.retracted JOIN names USING (doc_id)""",
)
def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = model.docs(spark, sf_dir).where("not retracted").select(F.col("id").alias("doc_id"), "source")
    m = model.mentions(spark, sf_dir).join(d, "doc_id")
    m = m.withColumn("ns", F.collect_set("canonical").over(Window.partitionBy("doc_id")))  # a document's mentions, bounded by the dictionary
    return m.select("doc_id", "object_type", "canonical", "surface", "source", F.array_join(F.array_sort(F.array_remove("ns", F.col("canonical"))), ",").alias("co_mentions"))


@register(
    "a08_a09_r13_entities",
    f"""WITH {model.MENTIONS_SQL}, c AS (SELECT object_type, canonical, surface, count(*) AS n FROM mentions GROUP BY ALL)
        SELECT object_type, canonical, sum(n)::BIGINT AS mention_count, array_to_string(list_sort(list(surface)), ',') AS surface_forms, arg_max(surface, (n, surface)) AS modal,
          arg_max(surface, (len(string_split(surface, ' ')), n, length(surface), surface)) AS best FROM c GROUP BY ALL""",
)
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = model.mentions(spark, sf_dir).groupBy("object_type", "canonical", "surface").agg(F.count("*").alias("n"))
    return c.groupBy("object_type", "canonical").agg(
        F.sum("n").alias("mention_count"),
        F.array_join(F.array_sort(F.collect_list("surface")), ",").alias("surface_forms"),
        F.max_by("surface", F.struct("n", "surface")).alias("modal"),
        F.max_by("surface", F.struct(F.size(F.split("surface", " ")), "n", F.length("surface"), "surface")).alias("best"),
    )


_TOP_SQL = (
    f"WITH {model.MENTIONS_SQL}, c AS (SELECT object_type, surface, count(*) AS n FROM mentions GROUP BY ALL) SELECT object_type, surface, n FROM c QUALIFY row_number() OVER (PARTITION BY object_type ORDER BY n DESC, surface) <= 12"
)


def _top(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    c = model.mentions(spark, sf_dir).groupBy("object_type", "surface").agg(F.count("*").alias("n"))
    return c.withColumn("r", F.row_number().over(Window.partitionBy("object_type").orderBy(F.desc("n"), "surface"))).where(F.col("r") <= most).drop("r")


@register("w10_top_entities_12", _TOP_SQL)
def top_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, 12)


# -- review: orders stand for decisions about pairs (customer, status)

_DECISIONS = "d AS (SELECT o_orderkey AS id, o_custkey % 200 AS a, 200 + o_custkey % 17 AS b, CASE WHEN o_orderkey % 3 = 0 THEN 'same' ELSE 'different' END AS decision, o_totalprice / 600000 AS score FROM orders)"


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 200).alias("a"), (200 + F.col("o_custkey") % 17).alias("b"), F.when(F.col("o_orderkey") % 3 == 0, "same").otherwise("different").alias("decision"), (F.col("o_totalprice") / 600000).alias("score")
    )


@register("w04_latest_decisions", f"WITH {_DECISIONS} SELECT a, b, id, decision FROM d QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY id DESC) = 1")
def latest_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.newest(_decisions(spark, sf_dir), ["a", "b"], ["id", "decision"], ("id",))


@register(
    "w05_r17_j17_review_items",
    f"""WITH {_DECISIONS}, pairs AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY id DESC) = 1), done AS (SELECT a, b, decision, id FROM d WHERE id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY id DESC) = 1)
        SELECT p.a, p.b, p.score, CASE WHEN done.decision IS NULL THEN 'pending' WHEN done.decision = 'same' THEN 'accepted' ELSE 'rejected' END AS status FROM pairs p LEFT JOIN done ON p.a = done.a AND p.b = done.b""",
)
def review_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _decisions(spark, sf_dir)
    done = ops.newest(d.where("id % 2 = 0"), ["a", "b"], ["id", "decision"], ("id",)).select("a", "b", "decision")
    p = ops.newest(d, ["a", "b"], ["id", "score"], ("id",)).join(done, ["a", "b"], "left")
    return p.select("a", "b", "score", F.when(F.col("decision").isNull(), "pending").when(F.col("decision") == "same", "accepted").otherwise("rejected").alias("status"))


@register("o03_review_selection", f"WITH {_DECISIONS}, p AS (SELECT a, b, max(score) AS score FROM d GROUP BY a, b) SELECT a, b, score FROM p ORDER BY abs(score - 0.6), a, b LIMIT 25")
def review_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir).groupBy("a", "b").agg(F.max("score").alias("score")).orderBy(F.abs(F.col("score") - 0.6), "a", "b").limit(25)


@register(
    "g02_g03_w07_constraints",
    f"""WITH {_DECISIONS}, c AS (SELECT id, least(a, b) AS l, greatest(a, b) AS r, decision, CASE WHEN id % 5 = 4 THEN id - 1 END AS supersedes_id FROM d), h AS (SELECT * FROM c WHERE id NOT IN (SELECT supersedes_id FROM c WHERE supersedes_id IS NOT NULL)),
        k AS (SELECT *, count(DISTINCT decision) OVER (PARTITION BY l, r) AS kinds FROM h)
        SELECT id, l, r, CASE WHEN kinds > 1 OR (l = r AND decision = 'different') THEN 'conflict' WHEN l % 10 = 0 OR r % 10 = 0 THEN 'unresolved' ELSE 'remapped' END AS status FROM k""",
)
def constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _decisions(spark, sf_dir).select("id", F.least("a", "b").alias("l"), F.greatest("a", "b").alias("r"), "decision", F.when(F.col("id") % 5 == 4, F.col("id") - 1).alias("supersedes_id"))
    h = ops.heads(c)
    kinds = h.groupBy("l", "r").agg(F.countDistinct("decision").alias("kinds"))
    status = F.when((F.col("kinds") > 1) | ((F.col("l") == F.col("r")) & (F.col("decision") == "different")), "conflict").when((F.col("l") % 10 == 0) | (F.col("r") % 10 == 0), "unresolved").otherwise("remapped")
    return h.join(kinds, ["l", "r"]).select("id", "l", "r", status.alias("status"))


# -- lineage: parts move from one generation's owners (brand) to the next one's clusters (type and size)

_GEN = "m AS (SELECT p_partkey AS evidence, p_brand AS owner, p_type || '-' || (p_size % 9) AS cluster FROM part)"
_RECONCILE = f"""{_GEN}, o AS (SELECT owner, cluster, count(*) AS n FROM m GROUP BY ALL), child AS (SELECT owner, cluster, n FROM o QUALIFY row_number() OVER (PARTITION BY owner ORDER BY n DESC, cluster) = 1),
  heir AS (SELECT owner, cluster FROM child QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, owner) = 1)"""


def _overlap(parts: DataFrame) -> DataFrame:
    m = parts.select(F.col("p_brand").alias("owner"), F.concat("p_type", F.lit("-"), (F.col("p_size") % 9).cast("string")).alias("cluster"))
    return m.groupBy("owner", "cluster").agg(F.count("*").alias("n"))


def _heirs(o: DataFrame) -> DataFrame:
    child = ops.latest(o, ["owner"], [F.desc("n"), F.col("cluster")])
    return ops.latest(child, ["cluster"], [F.desc("n"), F.col("owner")]).select("owner", "cluster")


def _reconciled(o: DataFrame) -> DataFrame:
    c = o.select("cluster").distinct().join(_heirs(o), "cluster", "left")
    return c.select("cluster", F.coalesce("owner", F.concat(F.lit("new:"), F.substring(F.sha2("cluster", 256), 1, 8))).alias("stable_uid"), F.col("owner").isNotNull().alias("inherited"))


_RECONCILE_SQL = f"WITH {_RECONCILE}, c AS (SELECT DISTINCT cluster FROM o) SELECT c.cluster, coalesce(heir.owner, 'new:' || substr(sha256(c.cluster), 1, 8)) AS stable_uid, heir.owner IS NOT NULL AS inherited FROM c LEFT JOIN heir USING (cluster)"


@register("j13_g07_g08_reconcile_all", _RECONCILE_SQL)
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reconciled(_overlap(read(spark, sf_dir, "part")))


_LINEAGE_SQL = (
    f"""WITH {_RECONCILE}, best AS (SELECT owner, cluster FROM child), uid AS (SELECT DISTINCT o.cluster, coalesce(heir.owner, 'new:' || substr(sha256(o.cluster), 1, 8)) AS uid FROM o LEFT JOIN heir USING (cluster))
        SELECT o.owner AS src, uid.uid AS dst, CASE WHEN uid.uid = o.owner THEN 'continued' WHEN best.cluster IS NOT NULL THEN 'merged_into' ELSE 'split_into' END AS relationship, o.n AS witnesses
        FROM o JOIN uid USING (cluster) LEFT JOIN best ON best.owner = o.owner AND best.cluster = o.cluster"""
)


def _edges(o: DataFrame) -> DataFrame:
    child = ops.latest(o, ["owner"], [F.desc("n"), F.col("cluster")]).select("owner", "cluster", F.lit(True).alias("best"))
    heirs = _heirs(o).select("cluster", F.col("owner").alias("heir"))
    x = o.join(heirs, "cluster", "left").join(child, ["owner", "cluster"], "left").withColumn("dst", F.coalesce("heir", F.concat(F.lit("new:"), F.substring(F.sha2("cluster", 256), 1, 8))))
    kind = F.when(F.col("dst") == F.col("owner"), "continued").when(F.col("best"), "merged_into").otherwise("split_into")
    return x.select(F.col("owner").alias("src"), "dst", kind.alias("relationship"), F.col("n").alias("witnesses"))


@register("g11_lineage_all", _LINEAGE_SQL)
def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(_overlap(read(spark, sf_dir, "part")))


def _targets(orders: DataFrame) -> DataFrame:
    """The ends of walks over the orders' edges from every source node."""
    e = orders.select((F.col("o_custkey") % 300).alias("src"), (F.col("o_custkey") % 300 + 1 + F.col("o_orderkey") % 7).alias("dst")).distinct()
    start = e.select(F.col("src").alias("origin"), F.col("src").alias("node"))
    return reachable(e, start).join(e.select(F.col("src").alias("node")), "node", "left_anti")


@register(
    "g14_current_targets_all",
    "WITH RECURSIVE e AS (SELECT DISTINCT o_custkey % 300 AS src, o_custkey % 300 + 1 + o_orderkey % 7 AS dst FROM orders), w(origin, node) AS (SELECT DISTINCT src, src FROM e UNION SELECT w.origin, e.dst FROM w JOIN e ON e.src = w.node) SELECT origin, node FROM w WHERE node NOT IN (SELECT src FROM e)",
)
def current_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _targets(read(spark, sf_dir, "orders"))


_SNAPS = "s AS (SELECT DISTINCT p_brand AS uid, g AS generation, (p_size * 7 + g * 3 + length(p_brand)) % 4 > 0 AS present FROM (SELECT p_brand, min(p_size) AS p_size FROM part GROUP BY 1), (SELECT unnest(range(1, 7)) AS g))"


@register(
    "w09_g09_g13_lost_presence",
    f"WITH {_SNAPS}, x AS (SELECT *, lag(present) OVER (PARTITION BY uid ORDER BY generation) AS before FROM s) SELECT uid, max(generation) FILTER (WHERE before AND NOT present) AS lost_in, max(generation) FILTER (WHERE present) AS last_present, max_by(present, generation) AS now FROM x WHERE generation <= 5 GROUP BY uid",
)
def lost_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("uid")).agg(F.min("p_size").alias("size")).withColumn("generation", F.explode(F.sequence(F.lit(1), F.lit(6))))
    s = p.select("uid", "generation", ((F.col("size") * 7 + F.col("generation") * 3 + F.length("uid")) % 4 > 0).alias("present")).where("generation <= 5")
    x = s.withColumn("before", F.lag("present").over(Window.partitionBy("uid").orderBy("generation")))
    g = F.col("generation").cast("long")
    return x.groupBy("uid").agg(F.max(F.when(F.col("before") & ~F.col("present"), g)).alias("lost_in"), F.max(F.when(F.col("present"), g)).alias("last_present"), F.max_by("present", "generation").alias("now"))
