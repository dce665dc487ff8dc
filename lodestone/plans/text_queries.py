"""Scalar text functions, classification and URL queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, text
from . import model
from .catalogue import read, register

_ALL_SQL = f"t AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT id::BIGINT, text FROM {model.PHRASES_SQL})"
_MARKS = f"regexp_replace(coalesce(text, ''), '[{fixed.MARK_RANGES}]', '', 'g')"
_ALEF = f"translate(replace({_MARKS}, '{fixed.TATWEEL}', ''), 'أإآٱ', 'اااا')"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{text.SPACES}+', ' ', 'g'))"


NORM = _collapse(f"regexp_replace(replace({_ALEF}, 'ى', 'ي'), '{text.OTHER}', ' ', 'g')")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(model.phrases(spark))


@register(
    "t01_t07_normalize",
    f"""WITH {_ALL_SQL} SELECT id, md5({_MARKS}) AS no_marks, md5(replace(text, '{fixed.TATWEEL}', '')) AS no_tatweel, md5(translate(text, 'أإآٱ', 'اااا')) AS alef,
        md5(translate(text, 'ىة', 'يه')) AS ya_teh, md5(translate(text, 'ى', 'ي')) AS ya, md5(regexp_replace(text, '{text.OTHER}', ' ', 'g')) AS no_punctuation,
        md5({_collapse("text")}) AS collapsed, md5({NORM}) AS normal, md5({_collapse(_ALEF.replace("'أإآٱ', 'اااا'", "'أإآٱىة', 'اااايه'"))}) AS with_punctuation FROM t""",
)
def normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, m = F.col("text"), model.md5
    return _texts(spark, sf_dir).select(
        "id",
        m(text.remove_marks(c)).alias("no_marks"),
        m(text.remove_tatweel(c)).alias("no_tatweel"),
        m(text.fold_alef(c)).alias("alef"),
        m(text.fold_ya(c)).alias("ya_teh"),
        m(text.fold_ya(c, False)).alias("ya"),
        m(text.strip_punctuation(c)).alias("no_punctuation"),
        m(text.collapse(c)).alias("collapsed"),
        m(text.normalize_arabic(c)).alias("normal"),
        m(text.normalize_arabic(c, teh_marbuta=True, punctuation=False)).alias("with_punctuation"),
    )


_STOP = ", ".join(f"'{w}'" for w in fixed.STOPWORDS)


@register(
    "t08_t09_clean",
    f"""WITH {_ALL_SQL} SELECT id, md5(trim(array_to_string(list_filter(string_split({NORM}, ' '), lambda w: w NOT IN ({_STOP})), ' '))) AS cleaned,
        len(list_filter(string_split({NORM}, ' '), lambda w: w NOT IN ({_STOP})))::INT AS n_words, md5(array_to_string(list_filter(string_split({NORM}, ' '), lambda w: w NOT IN ('the', 'and', 'der', 'que')), ' ')) AS own_words FROM t""",
)
def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = text.normalize_arabic(F.col("text"))
    kept = F.filter(F.split(n, " "), lambda w: ~w.isin(*fixed.STOPWORDS))
    return _texts(spark, sf_dir).select("id", model.md5(text.clean_arabic(F.col("text"))).alias("cleaned"), F.size(kept).alias("n_words"), model.md5(text.remove_words(n, ("the", "and", "der", "que"))).alias("own_words"))


def _count_sql(word: str, of: str) -> str:
    return f"((length({of}) - length(replace({of}, '{word}', ''))) / {len(word)})::INT"


def _best_sql(scores: list[tuple[str, str]]) -> str:
    return "list_max([" + ", ".join(f"{{'score': {s}, 'at': {-i}, 'name': '{n}'}}" for i, (n, s) in enumerate(scores)) + "])"


_FOLD = str.maketrans("أإآٱى", "ااااي")


def _topic_sql(topics: dict[str, tuple[str, ...]]) -> str:
    return _best_sql([(n, " + ".join(_count_sql(w.translate(_FOLD), "n") for w in ws)) for n, ws in topics.items()])


def _hits_sql(words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains(text, '{w}')::INT" for w in words) + ")"


def _escalation_sql(high: tuple[str, ...], medium: tuple[str, ...], low: tuple[str, ...]) -> tuple[str, str]:
    h = _hits_sql(high)
    score = f"(3 * {h} + 2 * {_hits_sql(medium)} - {_hits_sql(low)})"
    return score, f"CASE WHEN {h} >= 2 OR {score} >= 6 THEN 'high' WHEN {h} >= 1 OR {score} >= 2 THEN 'medium' ELSE 'low' END"


def _country_sql(countries: dict[str, tuple[str, ...]]) -> str:
    # no look-around here: with each space doubled, neighbouring matches never share the character between them
    one = lambda w: f"len(regexp_extract_all(n2, '(^|[^؀-ۿ])[وفبلك]{{0,2}}(ال)?{w.translate(_FOLD).replace(' ', '  ')}($|[^؀-ۿ])'))"
    return _best_sql([(n, " + ".join(one(w) for w in ws)) for n, ws in countries.items()])


_SCORE, _LABEL = _escalation_sql(fixed.HIGH, fixed.MEDIUM, fixed.LOW)
_SCORE2, _LABEL2 = _escalation_sql(model.HIGH, model.MEDIUM, model.LOW)


@register(
    "c01_c03_c04_classify",
    f"""WITH {_ALL_SQL}, n AS (SELECT *, {NORM} AS n, replace({NORM}, ' ', '  ') AS n2 FROM t),
        b AS (SELECT *, {_country_sql(fixed.COUNTRIES)} AS c, {_topic_sql(fixed.TOPICS)} AS tp FROM n)
        SELECT id, CASE WHEN c.score > 0 THEN c.name END AS country, tp.score::INT AS topic_score, CASE WHEN tp.score > 0 THEN tp.name ELSE 'Uncategorized' END AS topic,
          {_SCORE}::INT AS escalation_score, {_LABEL} AS escalation FROM b""",
)
def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _texts(spark, sf_dir).withColumn("n", text.normalize_arabic(F.col("text")))
    d = d.select("id", text.detect_country(F.col("n")).alias("country"), text.topic(F.col("n")).alias("t"), text.escalation(F.col("text")).alias("e"))
    return d.select("id", "country", F.col("t.score").alias("topic_score"), F.col("t.name").alias("topic"), F.col("e.score").alias("escalation_score"), F.col("e.label").alias("escalation"))


_GUESS = "CASE " + " ".join(f"WHEN contains(text, '{w}') THEN '{n}'" for w, n in model.COUNTRY_WORDS) + " END"


@register(
    "c02_c05_c06_process_facts",
    f"""WITH t AS (SELECT doc_id AS id, text FROM documents), n AS (SELECT *, {NORM} AS n FROM t),
        b AS (SELECT id, {_GUESS} AS country, {_topic_sql(model.TOPICS)} AS tp, {_LABEL2} AS escalation FROM n),
        f AS (SELECT id, country, escalation, CASE WHEN tp.score > 0 THEN tp.name ELSE 'Uncategorized' END AS topic FROM b)
        SELECT id AS subject_id, 'country' AS fact_type, country AS value FROM f UNION ALL SELECT id, 'escalation', escalation FROM f UNION ALL SELECT id, 'topic', topic FROM f""",
)
def process_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    d = read(spark, sf_dir, "documents").withColumn("n", text.normalize_arabic(c)).select(
        F.col("doc_id").alias("subject_id"),
        text.guess_country(c, model.COUNTRY_WORDS).alias("country"),
        text.escalation(c, model.HIGH, model.MEDIUM, model.LOW)["label"].alias("escalation"),
        text.topic(F.col("n"), model.TOPICS)["name"].alias("topic"),
    )
    return d.unpivot("subject_id", ["country", "escalation", "topic"], "fact_type", "value")


_PART = r"'^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?'"


def _url_sql(query: str) -> str:
    p = lambda k: f"regexp_extract(trim(url), {_PART}, {k})"
    return f"""CASE WHEN trim(url) = '' THEN '' ELSE concat(CASE WHEN {p(1)} = '' THEN '' ELSE lower({p(1)}) || ':' END, CASE WHEN {p(2)} = '' THEN '' ELSE '//' || lower({p(2)}) END,
      CASE WHEN regexp_replace({p(3)}, '/+$', '') = '' THEN '/' ELSE regexp_replace({p(3)}, '/+$', '') END, {p(4) if query else "''"}) END"""


@register(
    "t22_t23_t31_urls",
    f"""SELECT page_id, {_url_sql("")} AS canonical, {_url_sql("q")} AS listing, regexp_matches(url, '^https?://[^/?#@:]+(:[0-9]{{1,5}})?([/?#].*)?$') AND NOT regexp_matches(url, '[\\x00-\\x20\\x7f"''\\\\]') AS public FROM pages""",
)
def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", text.canonical_url(u).alias("canonical"), text.canonical_url(u, True).alias("listing"), text.is_public_url(u).alias("public"))


@register(
    "t24_t30_hashes_and_forms",
    """SELECT doc_id, sha256(trim(concat_ws('|', coalesce(source, ''), coalesce(lang, ''), coalesce(text, ''), ''))) AS content_hash, sha256(trim(concat_ws('|', coalesce(lang, ''), coalesce(text, '')))) AS scraper_hash,
        'v1/documents/' || substr(sha256(text), 1, 2) || '/' || sha256(text) || '.txt.gz' AS blob_key, md5(concat_ws(chr(10) || chr(10), nullif(source, ''), nullif(lang, ''), nullif(text, ''))) AS composed,
        CASE WHEN length(text) <= 40 THEN text ELSE substr(text, 1, 37) || '...' END AS short, regexp_replace(regexp_replace(lower(source || ' / ' || lang), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
        regexp_replace(source || ' | ' || lang, '[ \\t\\r\\n]*\\|.*$', '') AS title, regexp_matches(lower(trim(lang)), '^[a-z]{2,8}(-[a-z0-9]{2,8})*$') AS tag_ok, length(text) = n_chars AS length_ok FROM documents""",
)
def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, g, t = F.col("source"), F.col("lang"), F.col("text")
    return read(spark, sf_dir, "documents").select(
        "doc_id",
        text.content_hash(s, g, t, F.lit("")).alias("content_hash"),
        text.content_hash(g, t).alias("scraper_hash"),
        text.blob_key(t).alias("blob_key"),
        model.md5(text.compose(s, g, t)).alias("composed"),
        text.truncate(t, 40).alias("short"),
        text.slug(F.concat(s, F.lit(" / "), g)).alias("slug"),
        text.title_without_site(F.concat(s, F.lit(" | "), g)).alias("title"),
        text.is_language_tag(g).alias("tag_ok"),
        (F.length(t) == F.col("n_chars")).alias("length_ok"),
    )


@register(
    "t35_t38_review_and_snippets",
    """WITH x AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN '[entity-review] pair ' || doc_id || ' accept' WHEN 1 THEN '[entity-review] pair ' || doc_id || ' reject' ELSE 'pair ' || doc_id END AS title,
          CASE WHEN strpos(text, 'the ') > 0 THEN strpos(text, 'the ') - 1 END AS s FROM documents)
        SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN doc_id END AS pair, CASE doc_id % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' END AS verdict,
          CASE WHEN s IS NULL THEN substr(text, 1, 80) ELSE substr(text, (greatest(0, s - 20) + 1)::INT, (s - greatest(0, s - 20))::INT) || '[the]' || substr(text, (s + 4)::INT, 20) END AS snippet FROM x""",
)
def review_and_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    title = F.when(i % 3 == 0, F.concat(F.lit("[entity-review] pair "), i, F.lit(" accept"))).when(i % 3 == 1, F.concat(F.lit("[entity-review] pair "), i, F.lit(" reject"))).otherwise(F.concat(F.lit("pair "), i))
    at = F.locate("the ", F.col("text"))
    start = F.when(at > 0, at - 1)
    d = read(spark, sf_dir, "documents").select("doc_id", text.review_command(title).alias("r"), text.snippet(F.col("text"), start, start + 3).alias("snippet"))
    return d.select("doc_id", "r.pair", "r.verdict", "snippet")


@register(
    "f08_f09_mojibake",
    f"""WITH {_ALL_SQL} SELECT id, length(text) > 0 AND len(regexp_extract_all(text, '[\\x{{400}}-\\x{{4ff}}]')) >= 0.1 * length(text) AS retracted, CASE WHEN length(text) > 0 AND len(regexp_extract_all(text, '[\\x{{400}}-\\x{{4ff}}]')) >= 0.1 * length(text) THEN 'mojibake' END AS reason FROM t""",
)
def mojibake(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = text.mojibake(F.col("text"))
    return _texts(spark, sf_dir).select("id", bad.alias("retracted"), F.when(bad, "mojibake").alias("reason"))


@register(
    "t17_t18_script",
    f"""WITH {_ALL_SQL}, s AS (SELECT id, CASE WHEN len(regexp_extract_all(text, '\\pL')) > 0 THEN len(regexp_extract_all(text, '[ء-غف-يٱ-ە]')) / len(regexp_extract_all(text, '\\pL')) ELSE 0 END AS arabic,
          CASE WHEN len(regexp_extract_all(text, '\\pL')) > 0 THEN len(regexp_extract_all(text, '[A-Za-z]')) / len(regexp_extract_all(text, '\\pL')) ELSE 0 END AS latin FROM t)
        SELECT id, arabic::DOUBLE AS arabic, latin::DOUBLE AS latin, CASE WHEN latin > arabic THEN 'en' ELSE 'ar' END AS adapter FROM s""",
)
def script(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _texts(spark, sf_dir).select("id", text.script_share(F.col("text"), "[ء-غف-يٱ-ە]").alias("arabic"), text.script_share(F.col("text"), "[A-Za-z]").alias("latin"))
    return d.withColumn("adapter", F.when(F.col("latin") > F.col("arabic"), "en").otherwise("ar"))
