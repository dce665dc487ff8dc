"""The document model over the driver's tables, as DataFrames and, for the checks, as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import read

#: Phrases that the driver's documents lack: Arabic with marks, stretching, variants and prefixes.
PHRASES = (
    "قَصْفٌ عـنيف على دمشق وحلب، ومقتل مدنيين في غارة",
    "اجتماع ومحادثات في القاهرة بين مصر وقطر حول اتفاق",
    "المصرف المركزي ومصرف لبنان: أزمة اقتصاد وتضخم وعملة",
    "أحمد إبراهيم آل الشيخ ٱلله مصطفى فاطمة مؤسسة بيئة ماء ١٢٣",
    "الولايات المتحدة الولايات المتحدة وواشنطن ببغداد والعراق بالعراق",
    "إلى أو أن إن في على من",
    "رام الله وحزب الله، خان يونس؛ رفح وغزة؟",
    "Привет мир это тест кодировки",
    "a|b - c_d  e\t\nf",
    "",
)

TOPICS = {"Articles": ("the", "der ", "les "), "Links": ("and ", "und ", "que"), "Endings": ("ing", "ung", "mente"), "None": ("zzzzq",)}
HIGH, MEDIUM, LOW = ("idiot", "rated", "edst", "zuver"), ("ing.", "tion", "eit"), ("the ", "la ", "der ", "le ")
COUNTRY_WORDS = [("the", "England"), ("der", "Germany"), ("que", "Spain"), ("le", "France")]


def phrases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(-1 - i, t) for i, t in enumerate(PHRASES)], "id long, text string")


PHRASES_SQL = "(VALUES " + ", ".join(f"({-1 - i}, '{t}')" for i, t in enumerate(PHRASES)) + ") AS p(id, text)"

STAMP = "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast({h} as int))"

DOCS_SQL = """docs AS (SELECT doc_id AS id, source, lang, text, n_chars, TIMESTAMP '2024-01-01' + to_hours((doc_id * 7 % 1440)::INT) AS collected_at,
  CASE WHEN doc_id % 5 <> 0 THEN TIMESTAMP '2024-01-01' + to_hours((doc_id * 7 % 1440 - doc_id % 48)::INT) END AS published_at, doc_id % 17 = 0 AS retracted FROM documents)"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"),
        "source",
        "lang",
        "text",
        "n_chars",
        F.expr(STAMP.format(h="doc_id * 7 % 1440")).alias("collected_at"),
        F.when(F.col("doc_id") % 5 != 0, F.expr(STAMP.format(h="doc_id * 7 % 1440 - doc_id % 48"))).alias("published_at"),
        (F.col("doc_id") % 17 == 0).alias("retracted"),
    )


#: Facts: each document's language, source and size class, in several generations of two extractors.
FACTS_SQL = (
    DOCS_SQL
    + """, facts AS (SELECT id * 12 + k AS id, CASE k % 3 WHEN 0 THEN 'topic' WHEN 1 THEN 'escalation' ELSE 'country' END AS fact_type, id AS subject_id,
  CASE k % 3 WHEN 0 THEN lang WHEN 1 THEN CASE WHEN n_chars > 3000 THEN 'high' WHEN n_chars > 1000 THEN 'medium' ELSE 'low' END ELSE CASE WHEN id % 4 > 0 THEN source END END AS value,
  CASE WHEN (id + k) % 4 = 0 THEN 'v1' ELSE 'v2' END AS version, collected_at + to_hours(((id * 3 + k * k) % 5)::INT) AS created_at, (id + k) % 11 = 0 AS retracted
  FROM docs, (SELECT unnest(range(12)) AS k))"""
)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(11))))
    kind = F.col("k") % 3
    size = F.when(F.col("n_chars") > 3000, "high").when(F.col("n_chars") > 1000, "medium").otherwise("low")
    return d.select(
        (F.col("id") * 12 + F.col("k")).alias("id"),
        F.when(kind == 0, "topic").when(kind == 1, "escalation").otherwise("country").alias("fact_type"),
        F.col("id").alias("subject_id"),
        F.when(kind == 0, F.col("lang")).when(kind == 1, size).otherwise(F.when(F.col("id") % 4 > 0, F.col("source"))).alias("value"),
        F.when((F.col("id") + F.col("k")) % 4 == 0, "v1").otherwise("v2").alias("version"),
        (F.col("collected_at") + F.expr("make_dt_interval(0, cast((id * 3 + k * k) % 5 as int))")).alias("created_at"),
        ((F.col("id") + F.col("k")) % 11 == 0).alias("retracted"),
    )


#: Dictionary of surfaces: (type, canonical, surface).
DICTIONARY = (("person", "that", "that"), ("person", "that", "thatto"), ("person", "this", "this"), ("place", "from", "from"), ("place", "zu", "zu"), ("place", "zu", "zum"), ("group", "que", "que"), ("group", "que", "quela"), ("group", "with", "with"))
DICTIONARY_SQL = "dictionary AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in DICTIONARY) + ") AS d(object_type, canonical, surface))"

MENTIONS_SQL = (
    DOCS_SQL
    + ", "
    + DICTIONARY_SQL
    + """, words AS (SELECT id, unnest(list_distinct(string_split_regex(lower(text), '[^a-zß-ÿ]+'))) AS w FROM docs),
  mentions AS (SELECT words.id AS doc_id, object_type, canonical, w AS surface FROM words JOIN dictionary ON w = surface)"""
)


def dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DICTIONARY, "object_type string, canonical string, surface string")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct dictionary words of each document."""
    words = docs(spark, sf_dir).select(F.col("id").alias("doc_id"), F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-zß-ÿ]+"))).alias("surface"))
    return words.join(F.broadcast(dictionary(spark)), "surface").select("doc_id", "object_type", "canonical", "surface")


def md5(c: Column) -> Column:
    return F.md5(c.cast("binary"))


_SURFACES = [s for _, _, s in DICTIONARY]
#: Mentions with their offsets: a document's first occurrence of each dictionary surface that is one of its words.
SPANS_SQL = (
    MENTIONS_SQL
    + ", spans AS (SELECT m.doc_id * 10 + list_position(["
    + ", ".join(f"'{s}'" for s in _SURFACES)
    + """], m.surface) - 1 AS id, m.doc_id, m.object_type, m.canonical, m.surface, (strpos(lower(d.text), m.surface) - 1)::BIGINT AS start_offset,
  (strpos(lower(d.text), m.surface) - 1 + length(m.surface))::BIGINT AS end_offset, CASE WHEN (m.doc_id + length(m.surface)) % 4 = 0 THEN 'v1' ELSE 'v2' END AS version,
  (m.doc_id + length(m.surface)) % 11 = 0 AS retracted FROM mentions m JOIN docs d ON d.id = m.doc_id)"""
)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, doc_id, object_type, canonical, surface, start_offset, end_offset, version, retracted), without a shuffle."""
    d = docs(spark, sf_dir).select(F.col("id").alias("doc_id"), F.lower("text").alias("t"), F.array_distinct(F.split(F.lower("text"), "[^a-zß-ÿ]+")).alias("ws"))
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("object_type"), F.lit(b).alias("canonical"), F.lit(c).alias("surface")) for k, (a, b, c) in enumerate(DICTIONARY)])
    hits = d.select("doc_id", "t", F.explode(F.filter(entries, lambda x: F.array_contains("ws", x["surface"]))).alias("x")).select("doc_id", "t", "x.*")
    n = F.length("surface")
    at = F.expr("locate(surface, t)").cast("long") - 1
    return hits.select(
        (F.col("doc_id") * 10 + F.col("k")).alias("id"),
        "doc_id",
        "object_type",
        "canonical",
        "surface",
        at.alias("start_offset"),
        (at + n).alias("end_offset"),
        F.when((F.col("doc_id") + n) % 4 == 0, "v1").otherwise("v2").alias("version"),
        ((F.col("doc_id") + n) % 11 == 0).alias("retracted"),
    )
