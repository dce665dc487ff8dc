"""Streams drained over what is there, extraction, contract and search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import romanize
from ..operators import contracts, extract
from ..streaming import ledger as streams
from . import model
from .catalogue import read, register
from .fact_queries import _CURRENT, _current


@register("b01_stream_windowed_counts", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = streams.windowed_counts(streams.events(spark, sf_dir, "events.parquet"))
    return streams.drained(counts).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@register("x02_x04_dictionary_mentions")
def dictionary_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = [(kind, surface) for kind, _, surface in model.DICTIONARY]
    return extract.mentions(model.docs(spark, sf_dir), entries, proclitics="")


@register(
    "c15_contract_violations",
    f"""WITH {model.FACTS_SQL}, {_CURRENT}, p AS (SELECT o_custkey AS a, o_custkey + o_orderkey % 3 AS b, o_totalprice / 400000 AS score FROM orders)
        SELECT 'classified_document_exists' AS rule, count(*) AS n FROM current WHERE subject_id NOT IN (SELECT id FROM docs) UNION ALL SELECT 'one_row_a_document', count(*) FROM (SELECT subject_id FROM current GROUP BY 1 HAVING count(*) > 1)
        UNION ALL SELECT 'escalation_is_known', count(*) FROM current WHERE escalation IS NULL OR escalation NOT IN ('high', 'medium', 'low') UNION ALL SELECT 'topic_is_named', count(*) FROM current WHERE topic IS NULL OR trim(topic) = ''
        UNION ALL SELECT 'source_is_named', count(*) FROM docs WHERE source IS NULL OR trim(source) = '' UNION ALL SELECT 'pair_is_ordered', count(*) FROM p WHERE a >= b UNION ALL SELECT 'score_is_a_probability', count(*) FROM p WHERE score < 0 OR score > 1""",
)
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    pairs = o.select(F.col("o_custkey").alias("a"), (F.col("o_custkey") + F.col("o_orderkey") % 3).alias("b"), (F.col("o_totalprice") / 400000).alias("score"))
    return contracts.count_violations(contracts.snapshot_rules(model.docs(spark, sf_dir), _current(spark, sf_dir), pairs))


@register("r19_e03_entity_search", "WITH n AS (SELECT DISTINCT p_name AS name FROM part) SELECT name FROM n WHERE contains(lower(name), 'gi') UNION SELECT name FROM n WHERE contains(lower(replace(name, ' ', '')), 'dwi') ORDER BY name LIMIT 50")
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    direct = n.where(F.lower("name").contains("gi"))
    bridged = n.where(F.lower(F.replace("name", F.lit(" "), F.lit(""))).contains("dwi"))
    return direct.union(bridged).distinct().orderBy("name").limit(50)


#: Columns with names or text, and their keys.
_NAMED = (("documents", "doc_id", "text"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"), ("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name"))


@register("t16_romanised_names")
def romanised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of all names and texts of the tables, and of the phrases."""
    t = model.phrases(spark).select(F.lit("phrases").alias("table"), "id", "text")
    for table, key, name in _NAMED:
        t = t.unionByName(read(spark, sf_dir, table).select(F.lit(table).alias("table"), F.col(key).cast("long").alias("id"), F.col(name).alias("text")))
    return t.select("table", "id", F.posexplode(romanize("text")).alias("rank", "spelling"))


@register(
    "w03_current_mentions",
    f"""WITH {model.MENTIONS_SQL}, v AS (SELECT *, 1 + (doc_id + length(surface)) % 3 AS version FROM mentions), marker AS (SELECT id AS doc_id, max(1 + (id * 5 + k) % 3) AS version FROM docs, (SELECT unnest(range(2)) AS k) WHERE NOT retracted GROUP BY id)
        SELECT v.doc_id, v.object_type, v.surface, v.version FROM v JOIN marker USING (doc_id, version)""",
)
def current_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = model.mentions(spark, sf_dir).withColumn("version", 1 + (F.col("doc_id") + F.length("surface")) % 3)
    marker = model.docs(spark, sf_dir).where("not retracted").select(F.col("id").alias("doc_id"), F.explode(F.array((1 + F.col("id") * 5 % 3), (1 + (F.col("id") * 5 + 1) % 3))).alias("version")).groupBy("doc_id").agg(F.max("version").alias("version"))
    return v.join(marker, ["doc_id", "version"]).select("doc_id", "object_type", "surface", "version")
