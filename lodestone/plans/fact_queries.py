"""Facts, documents and their aggregates: latest generations, counts, rollups, panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import latest as ops
from . import model
from .catalogue import read, register

_LIVE = "live AS (SELECT f.* FROM facts f JOIN docs d ON d.id = f.subject_id WHERE NOT f.retracted AND NOT d.retracted)"
_LATEST = _LIVE + ", latest AS (SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY subject_id, fact_type ORDER BY created_at DESC, id DESC) = 1)"
_CURRENT = (
    _LATEST
    + """, current AS (SELECT subject_id, max(CASE WHEN fact_type = 'topic' AND version = 'v2' THEN value END) AS topic, max(CASE WHEN fact_type = 'escalation' AND version = 'v2' THEN value END) AS escalation,
  max(CASE WHEN fact_type = 'country' AND version = 'v2' THEN value END) AS country FROM latest GROUP BY subject_id HAVING count(*) FILTER (WHERE fact_type IN ('topic', 'escalation') AND version = 'v2') = 2)"""
)
_BASE = f"WITH {model.FACTS_SQL}, {_LATEST}"


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.live(model.facts(spark, sf_dir), model.docs(spark, sf_dir))


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.newest(_live(spark, sf_dir), ["subject_id", "fact_type"], ["id", "value", "version", "created_at"])


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.current_generation(_latest(spark, sf_dir), "v2")


@register("w01_w06_latest_facts", f"{_BASE} SELECT subject_id, fact_type, id, value, version FROM latest")
def latest_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir).drop("created_at")


@register("w02_g15_current_generation", f"WITH {model.FACTS_SQL}, {_CURRENT} SELECT * FROM current")
def current_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _current(spark, sf_dir)


@register("f02_j07_pending_documents", f"WITH {model.FACTS_SQL}, {_CURRENT} SELECT id, source FROM docs WHERE NOT retracted AND id NOT IN (SELECT subject_id FROM current)")
def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.pending(model.docs(spark, sf_dir).where("not retracted"), _current(spark, sf_dir)).select("id", "source")


@register(
    "o02_pending_newest",
    f"WITH {model.FACTS_SQL}, {_CURRENT} SELECT id, strftime(collected_at, '%Y-%m-%d %H') AS hour FROM docs WHERE NOT retracted AND id NOT IN (SELECT subject_id FROM current) ORDER BY collected_at DESC, id DESC LIMIT 500",
)
def pending_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ops.pending(model.docs(spark, sf_dir).where("not retracted"), _current(spark, sf_dir))
    return ops.first_rows(p, 500, [F.desc("collected_at"), F.desc("id")]).select("id", F.date_format("collected_at", "yyyy-MM-dd HH").alias("hour"))


@register(
    "a01_a02_counts_by_source",
    f"WITH {model.DOCS_SQL} SELECT source, count(*) AS n, count(*) FILTER (WHERE NOT retracted) AS n_live FROM docs GROUP BY source ORDER BY n DESC, source",
)
def by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.count_if(~F.col("retracted")).alias("n_live")).orderBy(F.desc("n"), "source")


@register(
    "a03_counts_by_class",
    f"""WITH {model.FACTS_SQL}, {_CURRENT}, x AS (SELECT 'topic' AS kind, topic AS value FROM current UNION ALL SELECT 'escalation', escalation FROM current UNION ALL SELECT 'country', country FROM current)
        SELECT kind, value, count(*) AS n FROM x WHERE value IS NOT NULL GROUP BY ALL""",
)
def by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _current(spark, sf_dir).unpivot("subject_id", ["topic", "escalation", "country"], "kind", "value").where("value is not null").groupBy("kind", "value").agg(F.count("*").alias("n"))


_AS_OF = "TIMESTAMP '2024-02-20'"


@register(
    "a04_f03_window_counts",
    f"""WITH {model.FACTS_SQL}, {_CURRENT}, x AS (SELECT d.source, c.topic, c.escalation FROM current c JOIN docs d ON d.id = c.subject_id WHERE d.collected_at >= {_AS_OF} - INTERVAL 7 DAY AND d.collected_at <= {_AS_OF})
        SELECT 'source' AS kind, source AS value, count(*) AS n FROM x GROUP BY ALL UNION ALL SELECT 'topic', topic, count(*) FROM x WHERE topic IS NOT NULL GROUP BY ALL UNION ALL SELECT 'escalation', escalation, count(*) FROM x WHERE escalation IS NOT NULL GROUP BY ALL""",
)
def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit("2024-02-20").cast("timestamp_ntz")
    d = model.docs(spark, sf_dir).where((F.col("collected_at") >= as_of - F.expr("interval 7 days")) & (F.col("collected_at") <= as_of)).select(F.col("id").alias("subject_id"), "source")
    x = _current(spark, sf_dir).join(d, "subject_id").select("source", "topic", "escalation")
    return x.unpivot([], ["source", "topic", "escalation"], "kind", "value").where("value is not null").groupBy("kind", "value").agg(F.count("*").alias("n"))


@register(
    "a05_daily_counts",
    f"WITH {model.DOCS_SQL} SELECT strftime(collected_at, '%Y-%m-%d') AS day, count(*) AS n FROM docs WHERE collected_at >= {_AS_OF} - INTERVAL 30 DAY GROUP BY ALL ORDER BY day",
)
def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = model.docs(spark, sf_dir).where(F.col("collected_at") >= F.lit("2024-02-20").cast("timestamp_ntz") - F.expr("interval 30 days"))
    return d.groupBy(F.date_format("collected_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n")).orderBy("day")


@register(
    "a06_country_rollup",
    f"""WITH {model.FACTS_SQL}, {_CURRENT}, x AS (SELECT c.country, c.topic, c.escalation, d.id, d.source, d.collected_at FROM current c JOIN docs d ON d.id = c.subject_id WHERE c.country IS NOT NULL),
        r AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY collected_at DESC, id DESC) AS stamp FROM x)
        SELECT country, count(*) AS total, count(DISTINCT source) AS sources, count(*) FILTER (WHERE escalation = 'high') AS high, count(DISTINCT collected_at::DATE) AS days,
          array_to_string(list(id ORDER BY stamp) FILTER (WHERE stamp <= 50), ',') AS articles FROM r GROUP BY country""",
)
def country_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = model.docs(spark, sf_dir).select(F.col("id").alias("subject_id"), "source", "collected_at")
    x = _current(spark, sf_dir).where("country is not null").join(d, "subject_id")
    counts = x.groupBy("country").agg(
        F.count("*").alias("total"), F.countDistinct("source").alias("sources"), F.count_if(F.col("escalation") == "high").alias("high"), F.countDistinct(F.to_date("collected_at")).alias("days")
    )
    # at most 50 a country are collected
    first = x.withColumn("at", F.row_number().over(Window.partitionBy("country").orderBy(F.desc("collected_at"), F.desc("subject_id")))).where("at <= 50")
    lists = first.groupBy("country").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "subject_id"))), lambda s: s["subject_id"].cast("string")), ",").alias("articles"))
    return counts.join(lists, "country")


@register(
    "a10_a11_briefing",
    f"""WITH {model.FACTS_SQL}, {_CURRENT}, x AS (SELECT d.id, d.source, c.topic, c.escalation, coalesce(c.country, 'Unknown') AS country, coalesce(d.published_at, d.collected_at) AS stamp FROM docs d LEFT JOIN current c ON d.id = c.subject_id),
        top AS (SELECT (SELECT topic FROM x WHERE topic IS NOT NULL GROUP BY topic ORDER BY count(*) DESC, topic LIMIT 1) AS top_topic, (SELECT country FROM x WHERE country <> 'Unknown' GROUP BY country ORDER BY count(*) DESC, country LIMIT 1) AS top_country,
          (SELECT source FROM x GROUP BY source ORDER BY count(*) DESC, source LIMIT 1) AS top_source)
        SELECT count(DISTINCT id) AS n_raw, count(DISTINCT CASE WHEN topic IS NOT NULL THEN id END) AS n_processed, count(DISTINCT source) AS n_sources, count(*) FILTER (WHERE escalation = 'high') AS n_high,
          count(*) FILTER (WHERE stamp >= (SELECT max(stamp) FROM x) - INTERVAL 24 HOUR) AS n_day, any_value(top_topic) AS top_topic, any_value(top_country) AS top_country, any_value(top_source) AS top_source FROM x, top""",
)
def briefing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = model.docs(spark, sf_dir).withColumnRenamed("id", "subject_id").drop("text", "lang")
    x = d.join(_current(spark, sf_dir), "subject_id", "left").withColumns({"country": F.coalesce("country", F.lit("Unknown")), "at": F.coalesce("published_at", "collected_at")})
    latest = x.agg(F.max("at").alias("last"))
    main = x.join(F.broadcast(latest)).agg(
        F.countDistinct("subject_id").alias("n_raw"),
        F.countDistinct(F.when(F.col("topic").isNotNull(), F.col("subject_id"))).alias("n_processed"),
        F.countDistinct("source").alias("n_sources"),
        F.count_if(F.col("escalation") == "high").alias("n_high"),
        F.count_if(F.col("at") >= F.col("last") - F.expr("interval 24 hours")).alias("n_day"),
    )
    for c, rows in (("topic", x.where("topic is not null")), ("country", x.where("country <> 'Unknown'")), ("source", x)):
        counts = rows.groupBy(c).count()
        main = main.join(F.broadcast(counts.agg(F.min_by(c, F.struct((-F.col("count")).alias("n"), F.col(c))).alias(f"top_{c}"))))
    return main


@register(
    "a12_a13_day_and_country_panels",
    f"""WITH {model.FACTS_SQL}, {_CURRENT}, x AS (SELECT strftime(coalesce(d.published_at, d.collected_at), '%Y-%m-%d') AS day, coalesce(c.topic, 'Uncategorized') AS topic, coalesce(c.escalation, 'unknown') AS escalation, coalesce(c.country, 'Unknown') AS country FROM docs d LEFT JOIN current c ON d.id = c.subject_id)
        SELECT 'topic' AS panel, day AS a, topic AS b, count(*) AS n FROM x GROUP BY ALL UNION ALL SELECT 'escalation', day, escalation, count(*) FROM x GROUP BY ALL
        UNION ALL SELECT 'country', country, CASE WHEN escalation = 'high' THEN 'high' ELSE 'other' END, count(*) FROM x WHERE country <> 'Unknown' GROUP BY ALL""",
)
def panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = model.docs(spark, sf_dir).select(F.col("id").alias("subject_id"), F.date_format(F.coalesce("published_at", "collected_at"), "yyyy-MM-dd").alias("day"))
    x = d.join(_current(spark, sf_dir), "subject_id", "left").select(
        "day", F.coalesce("topic", F.lit("Uncategorized")).alias("topic"), F.coalesce("escalation", F.lit("unknown")).alias("escalation"), F.coalesce("country", F.lit("Unknown")).alias("country")
    )
    cells = F.array(
        F.struct(F.lit("topic").alias("panel"), F.col("day").alias("a"), F.col("topic").alias("b")),
        F.struct(F.lit("escalation").alias("panel"), F.col("day").alias("a"), F.col("escalation").alias("b")),
        F.struct(F.lit("country").alias("panel"), F.col("country").alias("a"), F.when(F.col("escalation") == "high", "high").otherwise("other").alias("b")),
    )
    out = x.select(F.explode(cells).alias("c")).select("c.*").where("not (panel = 'country' and a = 'Unknown')")
    return out.groupBy("panel", "a", "b").agg(F.count("*").alias("n"))


@register(
    "f04_f06_dashboard_filter",
    f"""WITH {model.FACTS_SQL}, {_CURRENT}, x AS (SELECT d.id, d.source, d.text, coalesce(d.published_at, d.collected_at) AS stamp, coalesce(c.topic, 'Uncategorized') AS topic, coalesce(c.country, 'Unknown') AS country FROM docs d LEFT JOIN current c ON d.id = c.subject_id)
        SELECT id, topic, country FROM x WHERE source IN ('src1', 'src2', 'src3', 'src4', 'src5') AND topic IN ('en', 'fr', 'Uncategorized') AND stamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-02-25'
          AND (contains(lower(text), 'thea') OR contains(lower(source), 'thea') OR contains(lower(country), 'thea'))""",
)
def dashboard_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = model.docs(spark, sf_dir).where(F.col("source").isin("src1", "src2", "src3", "src4", "src5")).withColumn("at", F.coalesce("published_at", "collected_at"))
    d = d.where(F.col("at").between(F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-02-25").cast("timestamp_ntz"))).withColumnRenamed("id", "subject_id")
    x = d.join(_current(spark, sf_dir), "subject_id", "left").withColumns({"topic": F.coalesce("topic", F.lit("Uncategorized")), "country": F.coalesce("country", F.lit("Unknown"))})
    hit = F.lit(False)
    for c in ("text", "source", "country"):
        hit |= F.lower(F.coalesce(c, F.lit(""))).contains("thea")
    return x.where(F.col("topic").isin("en", "fr", "Uncategorized") & hit).select(F.col("subject_id").alias("id"), "topic", "country")


@register(
    "c11_o05_priority",
    f"""WITH {model.FACTS_SQL}, {_CURRENT}, x AS (SELECT d.id, coalesce(d.published_at, d.collected_at) AS stamp, c.topic, c.escalation, d.n_chars % 12 AS kw FROM docs d LEFT JOIN current c ON d.id = c.subject_id),
        s AS (SELECT id, stamp, (4 * CASE escalation WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END + 2 * CASE topic WHEN 'en' THEN 3 WHEN 'de' THEN 2 ELSE 1 END
          + 3 * greatest(0.0, least(48.0, 48.0 - date_diff('hour', stamp, (SELECT max(stamp) FROM x)))) / 48.0 + 0.2 * least(kw, 8))::DOUBLE AS score FROM x)
        SELECT id, score FROM s ORDER BY score DESC, stamp DESC, id LIMIT 8""",
)
def priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = model.docs(spark, sf_dir).select(F.col("id").alias("subject_id"), F.coalesce("published_at", "collected_at").alias("at"), (F.col("n_chars") % 12).alias("kw"))
    x = d.join(_current(spark, sf_dir), "subject_id", "left")
    x = x.join(F.broadcast(x.agg(F.max("at").alias("last"))))
    esc = F.when(F.col("escalation") == "high", 3).when(F.col("escalation") == "medium", 2).when(F.col("escalation") == "low", 1).otherwise(0)
    top = F.when(F.col("topic") == "en", 3).when(F.col("topic") == "de", 2).otherwise(1)
    age = F.timestamp_diff("HOUR", F.col("at"), F.col("last")).cast("double")
    score = 4 * esc + 2 * top + 3 * F.greatest(F.lit(0.0), F.least(F.lit(48.0), 48.0 - age)) / 48.0 + 0.2 * F.least(F.col("kw"), F.lit(8))
    return x.withColumn("score", score.cast("double")).orderBy(F.desc("score"), F.desc("at"), "subject_id").limit(8).select(F.col("subject_id").alias("id"), "score")


@register(
    "o01_j14_recent_documents",
    f"""WITH {model.FACTS_SQL}, {_CURRENT}, r AS (SELECT id, source, collected_at FROM docs WHERE NOT retracted ORDER BY collected_at DESC, id DESC LIMIT 30)
        SELECT r.id, r.source, c.topic, c.escalation, c.country FROM r LEFT JOIN current c ON c.subject_id = r.id""",
)
def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ops.first_rows(model.docs(spark, sf_dir).where("not retracted").select(F.col("id").alias("subject_id"), "source", "collected_at"), 30, [F.desc("collected_at"), F.desc("subject_id")])
    return r.join(_current(spark, sf_dir), "subject_id", "left").select(F.col("subject_id").alias("id"), "source", "topic", "escalation", "country")


@register(
    "e01_e02_sets",
    f"""{_BASE}, a AS (SELECT DISTINCT subject_id FROM latest WHERE fact_type = 'topic' AND version = 'v2'), b AS (SELECT DISTINCT subject_id FROM latest WHERE fact_type = 'escalation' AND version = 'v2')
        SELECT 'both' AS kind, subject_id FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only_topic', subject_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'only_escalation', subject_id FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
)
def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _latest(spark, sf_dir).where("version = 'v2'")
    a, b = (rows.where(F.col("fact_type") == t).select("subject_id").distinct() for t in ("topic", "escalation"))
    parts = (("both", a.intersect(b)), ("only_topic", a.subtract(b)), ("only_escalation", b.subtract(a)))
    out = None
    for kind, df in parts:
        df = df.select(F.lit(kind).alias("kind"), "subject_id")
        out = df if out is None else out.unionByName(df)
    return out


_CRAWLED = "u AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) || '/' || (page_id * 7 % 60) AS url, sha256((page_id * 11 % 90)::VARCHAR) AS hash, url AS link, html FROM pages)"


def _crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages under canonical addresses and content hashes that some of them share."""
    p = read(spark, sf_dir, "pages")
    host = F.lower(F.regexp_extract("url", "^https?://([^/?#]*)", 1))
    return p.select("page_id", F.concat(host, F.lit("/"), F.col("page_id") * 7 % 60).alias("url"), F.sha2((F.col("page_id") * 11 % 90).cast("string"), 256).alias("hash"), F.col("url").alias("link"), "html")


@register(
    "k01_k03_inserted_rows",
    f"""WITH RECURSIVE {_CRAWLED}, old AS (SELECT url, hash FROM u WHERE page_id % 50 = 0), n AS (SELECT page_id, url, hash, row_number() OVER (ORDER BY page_id) AS i FROM u WHERE page_id % 50 <> 0),
        w(i, urls, hashes, page_id, url) AS (SELECT 0::BIGINT, (SELECT list(url) FROM old), (SELECT list(hash) FROM old), NULL::BIGINT, NULL::VARCHAR UNION ALL
          SELECT n.i, CASE WHEN list_contains(urls, n.url) OR list_contains(hashes, n.hash) THEN urls ELSE list_append(urls, n.url) END, CASE WHEN list_contains(urls, n.url) OR list_contains(hashes, n.hash) THEN hashes ELSE list_append(hashes, n.hash) END,
            CASE WHEN list_contains(urls, n.url) OR list_contains(hashes, n.hash) THEN NULL ELSE n.page_id END, n.url FROM w JOIN n ON n.i = w.i + 1)
        SELECT page_id, url FROM w WHERE page_id IS NOT NULL""",
)
def inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arriving pages inserted one after the other, each unless its address or its hash is there."""
    from ..sources.sinks import new_rows

    u = _crawled(spark, sf_dir).select("page_id", "url", "hash")
    return new_rows(u.where("page_id % 50 <> 0"), u.where("page_id % 50 = 0"), ["url", "hash"], "page_id").select("page_id", "url")


@register(
    "k04_ingested_facts",
    f"""WITH {_CRAWLED}, old AS (SELECT url FROM u WHERE page_id % 50 = 0), n AS (SELECT * FROM u WHERE page_id % 50 <> 0 AND url NOT IN (SELECT url FROM old) QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1),
        f AS (SELECT page_id, 'title' AS fact_type, regexp_extract(html, '<title>([^<]*)</title>', 1) AS value FROM n UNION ALL SELECT page_id, 'section', regexp_extract(link, '^https?://[^/]*/([a-z][a-z])/', 1) FROM n UNION ALL SELECT page_id, 'author', regexp_extract(html, 'name="author" content="([^"]*)"', 1) FROM n)
        SELECT page_id, fact_type, value FROM f WHERE value <> ''""",
)
def ingested_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of new addresses alone, and a fact for each metadata field that isn't empty."""
    from ..sources.sinks import facts_of, new_rows

    u = _crawled(spark, sf_dir)
    n = new_rows(u.where("page_id % 50 <> 0"), u.where("page_id % 50 = 0"), ["url"], "page_id")
    fields = {"title": F.regexp_extract("html", "<title>([^<]*)</title>", 1), "section": F.regexp_extract("link", "^https?://[^/]*/([a-z][a-z])/", 1), "author": F.regexp_extract("html", 'name="author" content="([^"]*)"', 1)}
    return facts_of(n.select("page_id", *[c.alias(k) for k, c in fields.items()]), "page_id", list(fields))


@register(
    "k02_upsert",
    "WITH x AS (SELECT o_orderkey, o_orderstatus, o_totalprice, 0 AS g FROM orders UNION ALL SELECT o_orderkey, 'X', o_totalprice * 2, 1 FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT -o_orderkey - 1, 'N', o_totalprice, 1 FROM orders WHERE o_orderkey % 100 = 0) SELECT o_orderkey, o_orderstatus, o_totalprice FROM x QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY g DESC) = 1",
)
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.sinks import upserted

    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderkey % 7 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    new = new.unionByName(o.where("o_orderkey % 100 = 0").select((-F.col("o_orderkey") - 1).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), "o_totalprice"))
    return upserted(o, new, ["o_orderkey"])
