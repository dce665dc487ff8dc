"""Panels, lists and caches around the documents, and the sources' own rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names
from ..functions.blobs import gunzipped, gzipped
from ..operators import contracts, learning, resolve
from ..sources import adapters
from . import model
from .catalogue import read, register
from .resolve_queries import _PAIRS, _RECORDS, _records


@register("a14_dropped_blocks", f"WITH {_RECORDS} SELECT key, size FROM sizes WHERE size > 40 ORDER BY size DESC, key LIMIT 20")
def dropped_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty largest blocks beyond a cap."""
    return resolve.blocks(_records(spark, sf_dir))[1].where("size > 40").orderBy(F.desc("size"), "key").limit(20)


@register("a15_cluster_sizes", "WITH c AS (SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1) SELECT size, count(*) AS clusters FROM c GROUP BY 1")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("size"))
    return c.groupBy("size").agg(F.count("*").alias("clusters"))


@register(
    "a24_blocking_recall",
    f"WITH {_PAIRS}, gold AS (SELECT l.id AS a, r.id AS b FROM records l JOIN records r ON l.source = r.source AND l.object_type = r.object_type AND l.id < r.id WHERE l.id % 5 = r.id % 5) SELECT count(*) AS positives, count(pairs.a) AS survived, CASE WHEN count(*) > 0 THEN count(pairs.a) / count(*) END::DOUBLE AS recall, count(*) >= 60 AS supported FROM gold LEFT JOIN pairs ON gold.a = pairs.a AND gold.b = pairs.b",
)
def blocking_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold pairs that blocking keeps; null without any, and supported from sixty."""
    r = _records(spark, sf_dir)
    own = r.select("id", "source", "object_type", (F.col("id") % 5).alias("m"))
    gold = own.withColumnRenamed("id", "a").join(own.withColumnRenamed("id", "b"), ["source", "object_type", "m"]).where("a < b").select("a", "b")
    met = gold.join(resolve.candidate_pairs(r).withColumn("hit", F.lit(1)), ["a", "b"], "left").agg(F.count("*").alias("positives"), F.count("hit").alias("survived"))
    return met.withColumns({"recall": learning.ratio(F.col("survived"), F.col("positives"), None), "supported": F.col("positives") >= 60})


@register("a27_status_counts", "WITH s AS (SELECT CASE WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus = 'F' THEN 'accepted' ELSE 'rejected' END AS status FROM orders) SELECT string_agg(status || '=' || n, ',' ORDER BY status) AS counts, sum(n)::BIGINT AS total FROM (SELECT status, count(*) AS n FROM s GROUP BY 1)")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "accepted").otherwise("rejected")
    by = read(spark, sf_dir, "orders").groupBy(status.alias("status")).agg(F.count("*").alias("n"))
    return by.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "status", "n"))), ",").alias("counts"), F.sum("n").alias("total"))


@register(
    "e04_disjoint_splits",
    f"WITH {_PAIRS}, t AS (SELECT a, b, a % 50 AS grp, CASE WHEN a % 50 < 40 THEN 'train' ELSE 'audit' END AS split FROM pairs) SELECT (SELECT count(*) FROM (SELECT a, b FROM t WHERE split = 'train' INTERSECT SELECT a, b FROM t WHERE split = 'audit')) AS shared_pairs, (SELECT count(*) FROM (SELECT grp FROM t WHERE split = 'train' INTERSECT SELECT b % 50 FROM t WHERE split = 'audit')) AS shared_groups",
)
def disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs and groups that training and audit share: none of the pairs, and of the groups those that right ends bring in."""
    t = resolve.candidate_pairs(_records(spark, sf_dir)).withColumns({"grp": F.col("a") % 50, "other": F.col("b") % 50})
    train, audit = t.where("grp < 40"), t.where("grp >= 40")
    pairs = train.select("a", "b").intersect(audit.select("a", "b")).agg(F.count("*").alias("shared_pairs"))
    groups = train.select("grp").intersect(audit.select(F.col("other").alias("grp"))).agg(F.count("*").alias("shared_groups"))
    return pairs.join(F.broadcast(groups))  # one row each


@register("o04_pending_list", f"WITH {model.DOCS_SQL}, queue AS (SELECT o_orderkey AS id, o_custkey AS doc_id, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 200) SELECT q.id, q.doc_id, d.source FROM queue q JOIN docs d ON d.id = q.doc_id AND NOT d.retracted")
def pending_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit comes before the evidence filter, so the list may be shorter."""
    q = read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(200).select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("doc_id"))
    d = model.docs(spark, sf_dir).where("not retracted").select(F.col("id").alias("doc_id"), "source")
    return d.join(F.broadcast(q), "doc_id").select("id", "doc_id", "source")


@register("o06_slices", "WITH s AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) SELECT n AS head, max(r) AS rows, min(o_totalprice) AS least FROM s, (VALUES (80), (20), (14)) AS h(n) WHERE r <= n GROUP BY n")
def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = read(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(80).select("o_totalprice", "o_orderkey")
    ranked = top.withColumn("r", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")))  # eighty rows
    return ranked.withColumn("head", F.explode(F.array(F.lit(80), F.lit(20), F.lit(14)))).where("r <= head").groupBy("head").agg(F.max("r").cast("long").alias("rows"), F.min("o_totalprice").alias("least"))


def select_documents(docs: DataFrame, source: str | None = None, since: str | None = None, limit: int | None = None) -> DataFrame:
    """Documents by optional filters; without a filter nothing is filtered."""
    if source is not None:
        docs = docs.where(F.col("source") == source)
    if since is not None:
        docs = docs.where(F.col("collected_at") >= F.lit(since).cast("timestamp_ntz"))
    return docs if limit is None else docs.orderBy(F.desc("collected_at"), "id").limit(limit)


@register(
    "f05_optional_filters",
    f"WITH {model.DOCS_SQL} SELECT 'source' AS filter, id FROM docs WHERE source = 'src3' UNION ALL SELECT 'since', id FROM docs WHERE collected_at >= TIMESTAMP '2024-02-01' UNION ALL SELECT 'none', id FROM docs UNION ALL SELECT * FROM (SELECT 'limit', id FROM docs WHERE source = 'src3' ORDER BY collected_at DESC, id LIMIT 5)",
)
def optional_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = model.docs(spark, sf_dir)
    ways = {"source": {"source": "src3"}, "since": {"since": "2024-02-01 00:00:00"}, "none": {}, "limit": {"source": "src3", "limit": 5}}
    some = [select_documents(d, **w).select(F.lit(k).alias("filter"), "id") for k, w in ways.items()]
    return some[0].unionByName(some[1]).unionByName(some[2]).unionByName(some[3])


@register("t13_tokens", "SELECT p_partkey, string_split(trim(regexp_replace(lower(p_name || ' (' || p_type || ')'), '[^a-z0-9]+', ' ', 'g')), ' ') AS tokens FROM part")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.trim(F.regexp_replace(F.lower(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))), "[^a-z0-9]+", " "))
    return read(spark, sf_dir, "part").select("p_partkey", F.split(form, " ").alias("tokens"))


@register("t19_paragraphs", r"SELECT doc_id, list_filter(list_transform(string_split_regex(replace(text, '. ', CASE WHEN doc_id % 3 = 0 THEN '.' || chr(13) || chr(13) ELSE '.' || chr(10) || ' ' || chr(10) END), '(\r\n|\r|\n)([ \t]*(\r\n|\r|\n))+'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS paragraphs FROM documents")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(". "), F.when(F.col("doc_id") % 3 == 0, ".\r\r").otherwise(".\n \n")).alias("text"))
    return d.select("doc_id", F.filter(F.transform(F.split("text", r"(?:\r\n|\r|\n)(?:[ \t]*(?:\r\n|\r|\n))+"), lambda x: F.btrim(x, F.lit(" \t\n\r"))), lambda x: x != "").alias("paragraphs"))


@register("t19_t20_segments")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sentences as exact spans of its text."""

    def run(frames):
        import pandas as pd

        for pdf in frames:
            rows = [(d, k, a, b) for d, t in zip(pdf.doc_id, pdf.text, strict=True) for k, (a, b, _) in enumerate(names.sentences(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "sentence", "start_offset", "end_offset"])

    return read(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(run, "doc_id long, sentence int, start_offset int, end_offset int")


_PAYLOAD = "'{\"topic_matches\": {\"a\": [\"' || source || '\", \"' || lang || '\"], \"b\": [\"' || lang || '\", \"x' || (doc_id % 7) || '\"]}, \"escalation_matches\": {\"h\": [\"y' || (doc_id % 5) || '\"]}}'"


@register(
    "t36_t37_keywords",
    "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'None captured' ELSE array_to_string(list_filter([source, lang, 'x' || (doc_id % 7), 'y' || (doc_id % 5)], lambda x, i: true), ', ') END AS keywords, CASE WHEN doc_id % 10 = 0 THEN 0 ELSE 5 END AS n FROM documents",
)
def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored matches, some unreadable: distinct ones in order of first sight, eight at most, and how many in all."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    text = F.concat(F.lit('{"topic_matches": {"a": ["'), "source", F.lit('", "'), "lang", F.lit('"], "b": ["'), "lang", F.lit('", "x'), F.col("doc_id") % 7, F.lit('"]}, "escalation_matches": {"h": ["y'), F.col("doc_id") % 5, F.lit('"]}}'))
    kind = "topic_matches map<string, array<string>>, escalation_matches map<string, array<string>>"
    got = d.withColumn("m", F.from_json(F.when(F.col("doc_id") % 10 == 0, F.element_at(F.array(F.lit("{oops"), F.lit("[1]"), F.lit("")), (F.col("doc_id") / 10 % 3 + 1).cast("int"))).otherwise(text), kind))
    values = lambda c: F.coalesce(F.flatten(F.map_values(c)), F.array().cast("array<string>"))
    every = F.concat(values("m.topic_matches"), values("m.escalation_matches"))
    first = F.array_join(F.slice(F.array_distinct(every), 1, 8), ", ")
    return got.select("doc_id", F.when(first == "", "None captured").otherwise(first).alias("keywords"), F.size(every).alias("n"))


@register("n06_map_merge", "WITH v AS (SELECT user_id, event_type AS k, max_by(event_id % 9, (ts, event_id)) AS v FROM events GROUP BY ALL) SELECT user_id, string_agg(k || '=' || v, ',' ORDER BY k) AS versions FROM v GROUP BY 1")
def map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of versions merged along the events, later ones winning key by key."""
    last = read(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("k")).agg(F.max_by(F.col("event_id") % 9, F.struct("ts", "event_id")).alias("v"))
    merged = last.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("m"))
    return merged.select("user_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("versions"))


_TITLES = "titles AS (SELECT id, CASE WHEN id % 9 = 0 THEN '  ' WHEN id % 4 > 0 THEN split_part(text, '.', 1) END AS title, collected_at FROM docs WHERE NOT retracted), recent AS (SELECT * FROM (SELECT * FROM titles WHERE title IS NOT NULL ORDER BY collected_at DESC, id LIMIT 300) WHERE trim(title) <> '')"


@register(
    "c09_c10_j19_n08_translations",
    f"""WITH {model.DOCS_SQL}, {_TITLES}, u AS (SELECT title, row_number() OVER (ORDER BY min(collected_at) DESC, min(id)) AS pos FROM recent GROUP BY title), cache AS (SELECT sha256(title) AS sha, 'cached:' || title AS translated FROM u WHERE length(title) % 3 = 0),
        m AS (SELECT u.title, translated, CASE WHEN translated IS NULL THEN count(*) FILTER (WHERE translated IS NULL) OVER (ORDER BY pos) END AS n FROM u LEFT JOIN cache ON sha = sha256(u.title))
        SELECT title, CASE WHEN n IS NULL THEN translated ELSE 'echo:' || title END AS translated, CASE WHEN n IS NOT NULL THEN (n - 1) // 40 END AS batch FROM m WHERE n IS NULL OR n <= 100""",
)
def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent titles (at most 300, so small), distinct in order; cached ones first, of the others a hundred in batches of forty."""
    d = model.docs(spark, sf_dir).where("not retracted")
    title = F.when(F.col("id") % 9 == 0, "  ").when(F.col("id") % 4 > 0, F.element_at(F.split("text", r"\."), 1))
    recent = d.select("id", title.alias("title"), "collected_at").where("title is not null").orderBy(F.desc("collected_at"), "id").limit(300).where("trim(title) <> ''")
    u = recent.groupBy("title").agg(F.min("collected_at").alias("c"), F.min("id").alias("i"))
    cache = u.where("length(title) % 3 = 0").select(F.sha2("title", 256).alias("sha"), F.concat(F.lit("cached:"), "title").alias("translated"))
    m = u.join(F.broadcast(cache), F.sha2("title", 256) == F.col("sha"), "left")
    lacking = F.col("translated").isNull()
    m = m.withColumn("n", F.when(lacking, F.sum(lacking.cast("int")).over(Window.orderBy(F.desc("c"), "i"))))
    return m.where("n is null or n <= 100").select("title", F.coalesce("translated", F.concat(F.lit("echo:"), "title")).alias("translated"), F.expr("(n - 1) div 40").alias("batch"))


_GENERATIONS = "g AS (SELECT uid, k AS generation_id, uid || '/' || k AS name, (uid_n + k) % 3 > 0 AS present FROM (SELECT p_brand AS uid, row_number() OVER (ORDER BY p_brand) AS uid_n FROM (SELECT DISTINCT p_brand FROM part)), (SELECT unnest(range(1, 9)) AS k)), gens AS (SELECT k AS id, k * 10 AS sequence FROM (SELECT unnest(range(1, 9)) AS k))"


@register("j16_g13_as_of", f"WITH {_GENERATIONS} SELECT uid, arg_max(name, sequence) AS name, arg_max(present, sequence) AS present, max(sequence) AS sequence, count(*) AS snapshots FROM g JOIN gens ON gens.id = g.generation_id AND sequence <= 50 GROUP BY uid")
def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity's latest snapshot of a generation whose sequence is at most fifty."""
    brands = read(spark, sf_dir, "part").select(F.col("p_brand").alias("uid")).distinct().withColumn("uid_n", F.row_number().over(Window.orderBy("uid")))  # a row a brand
    k = F.sequence(F.lit(1), F.lit(8))
    snaps = brands.withColumn("generation_id", F.explode(k)).select("uid", "generation_id", F.concat_ws("/", "uid", "generation_id").alias("name"), ((F.col("uid_n") + F.col("generation_id")) % 3 > 0).alias("present"))
    gens = spark.range(1, 9).select(F.col("id").cast("int").alias("generation_id"), (F.col("id") * 10).alias("sequence")).where("sequence <= 50")
    return snaps.join(F.broadcast(gens), "generation_id").groupBy("uid").agg(F.max_by("name", "sequence").alias("name"), F.max_by("present", "sequence").alias("present"), F.max("sequence").alias("sequence"), F.count("*").alias("snapshots"))


_PANELS = f"""{model.DOCS_SQL}, live AS (SELECT * FROM docs WHERE NOT retracted), stats AS (SELECT count(*) AS total, count(DISTINCT source) AS sources FROM live), topics AS (SELECT lang AS topic, count(*) AS n FROM live GROUP BY 1),
  countries AS (SELECT source AS country, lower(regexp_replace(source, '[^a-zA-Z0-9]+', '-', 'g')) AS slug, count(*) AS n FROM live GROUP BY 1), pages AS (SELECT source AS country, lang AS topic, count(*) AS n FROM live GROUP BY 1, 2)"""


@register(
    "c15_contract_sums",
    f"""WITH {_PANELS}, x AS (SELECT 'topics_sum_to_total' AS rule, (SELECT (sum(n) <> any_value(total))::INT FROM topics, stats)::BIGINT AS n UNION ALL SELECT 'countries_sum_to_total', (SELECT (sum(n) <> any_value(total))::INT FROM countries, stats) UNION ALL SELECT 'topics_are_unique', (SELECT count(*) - count(DISTINCT topic) FROM topics)
        UNION ALL SELECT 'slugs_are_unique', (SELECT count(*) - count(DISTINCT slug) FROM countries) UNION ALL SELECT 'page_sums', (SELECT count(*) FROM (SELECT country, sum(n) AS s FROM pages GROUP BY 1) p FULL JOIN countries c USING (country) WHERE p.s IS DISTINCT FROM c.n) UNION ALL SELECT 'page_topics_are_known', (SELECT count(*) FROM pages WHERE topic NOT IN (SELECT topic FROM topics)) UNION ALL SELECT 'counts_are_positive', (SELECT count(*) FROM topics WHERE n <= 0)) SELECT rule, n FROM x""",
)
def contract_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The publication's parts against each other: sums, unique names, country pages."""
    live = model.docs(spark, sf_dir).where("not retracted")
    stats = live.agg(F.count("*").alias("total"))
    by = lambda *c: live.groupBy(*c).agg(F.count("*").alias("n"))
    topics, countries, pages = by(F.col("lang").alias("topic")), by(F.col("source").alias("country")), by(F.col("source").alias("country"), F.col("lang").alias("topic"))
    off = lambda part: part.agg(F.sum("n").alias("s")).join(F.broadcast(stats)).where("s <> total")  # noqa: E731  one row each
    slugs = countries.withColumn("slug", F.lower(F.regexp_replace("country", "[^a-zA-Z0-9]+", "-")))
    sums = pages.groupBy("country").agg(F.sum("n").alias("s")).join(countries, "country", "full").where("not (s <=> n)")
    return contracts.count_violations(
        {
            "topics_sum_to_total": off(topics),
            "countries_sum_to_total": off(countries),
            "topics_are_unique": topics.groupBy("topic").count().where("count > 1"),
            "slugs_are_unique": slugs.groupBy("slug").count().where("count > 1"),
            "page_sums": sums,
            "page_topics_are_known": pages.join(topics.select("topic"), "topic", "left_anti"),
            "counts_are_positive": topics.where("n <= 0"),
        }
    )


_PATHS = "CASE page_id % 11 WHEN 0 THEN '/news/details/' || page_id WHEN 1 THEN '/article/' || page_id WHEN 2 THEN '/2024/01/0' || (page_id % 9 + 1) || '/x' WHEN 3 THEN '/articles/' || page_id WHEN 4 THEN '/politics/2024/1/' || (page_id % 28 + 1) || '/x' WHEN 5 THEN '/world/' || (1000000 + page_id) || '-a' WHEN 6 THEN '/sport_x/' || page_id || '.html' WHEN 7 THEN '/arabic/news/2024/01/02/' || page_id || '.html' WHEN 8 THEN '/' || (5000 + page_id) || '/' WHEN 9 THEN '/news/2024/1/2/a-' || page_id ELSE '/about' END"
_SITES = "(VALUES " + ", ".join(f"('{a[0]}', '{a[1]}', '{a[2]}')" for a in adapters.ADAPTERS) + ") AS a(source, site, path_pattern)"


@register("s02_s04_article_addresses", f"WITH c AS (SELECT a.source, a.path_pattern, page_id, CASE WHEN page_id % 5 = 0 THEN 'other.example' WHEN page_id % 7 = 0 THEN 'm.' || site ELSE site END AS host, site, {_PATHS} AS path FROM pages, {_SITES}) SELECT source, page_id, path FROM c WHERE ends_with(host, site) AND regexp_matches(path, path_pattern)")
def article_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of every source's site, and which of them its adapter takes for articles."""
    a = F.broadcast(adapters.adapters(spark).select("source", "site", "path_pattern"))  # 21 rows
    p = read(spark, sf_dir, "pages").select("page_id", F.expr(_PATHS).alias("path"))
    host = F.when(F.col("page_id") % 5 == 0, "other.example").when(F.col("page_id") % 7 == 0, F.concat(F.lit("m."), "site")).otherwise(F.col("site"))
    c = p.join(a).withColumn("url", F.concat(F.lit("https://"), host, "path"))
    return c.where(adapters.is_article(F.col("url"), F.col("site"), F.col("path_pattern"))).select("source", "page_id", "path")


_DATED = "CASE page_id % 6 WHEN 0 THEN '<meta name=\"pubdate\" content=\"2024-01-02\"><meta property=\"article:published_time\" content=\"2024-03-04 05:06:07\">' WHEN 1 THEN '<script type=\"application/ld+json\">{\"dateModified\": \"2024-05-06\", \"datePublished\": \"2024-04-05 06:07:08\"}</script>' WHEN 2 THEN '<time datetime=\"2024-07-08\">x</time>' WHEN 3 THEN '<meta name=\"timestamp\" content=\"no date\"><time datetime=\"2024-07-09\">x</time>' WHEN 4 THEN '<meta name=\"pubdate\" content=\"2024-08-09\"><time datetime=\"2024-07-10\">x</time>' ELSE '' END"


@register("s06_f07_dates", "SELECT page_id, CASE page_id % 6 WHEN 0 THEN TIMESTAMP '2024-03-04 05:06:07' WHEN 1 THEN TIMESTAMP '2024-04-05 06:07:08' WHEN 2 THEN TIMESTAMP '2024-07-08' WHEN 3 THEN TIMESTAMP '2024-07-09' WHEN 4 THEN TIMESTAMP '2024-08-09' END AS meta_first, CASE page_id % 6 WHEN 0 THEN TIMESTAMP '2024-03-04 05:06:07' WHEN 1 THEN TIMESTAMP '2024-04-05 06:07:08' WHEN 2 THEN TIMESTAMP '2024-07-08' WHEN 3 THEN TIMESTAMP '2024-07-09' WHEN 4 THEN TIMESTAMP '2024-07-10' END AS time_first FROM pages")
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publication dates by two sources' orders; unreadable values are passed over."""
    p = read(spark, sf_dir, "pages").select("page_id", F.expr(_DATED).alias("html"))
    way = lambda o: adapters.published(F.col("html"), F.lit(o)).cast("timestamp_ntz")
    return p.select("page_id", way("meta json time").alias("meta_first"), way("time meta json").alias("time_first"))


@register("s07_encodings", "WITH b AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'Windows-1256' WHEN 1 THEN 'ISO-8859-1' WHEN 2 THEN 'latin-1' END AS declared, page_id % 3 = 0 AS broken FROM pages) SELECT page_id, CASE WHEN declared IS NOT NULL AND lower(declared) NOT IN ('iso-8859-1', 'latin-1') THEN lower(declared) WHEN NOT broken THEN 'utf-8' ELSE 'windows-1256' END AS encoding FROM b")
def encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies as bytes, some of which aren't UTF-8, with declared charsets."""
    p = read(spark, sf_dir, "pages")
    declared = F.when(F.col("page_id") % 5 == 0, "Windows-1256").when(F.col("page_id") % 5 == 1, "ISO-8859-1").when(F.col("page_id") % 5 == 2, "latin-1")
    body = F.when(F.col("page_id") % 3 == 0, F.concat(F.encode("html", "UTF-8"), F.unhex(F.lit("C8FF")))).otherwise(F.encode("html", "UTF-8"))
    return p.select("page_id", adapters.encoding(body, declared).alias("encoding"))


@register("s03_listing_links", "WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]*', 0) AS root, regexp_extract(url, '^[^?#]*', 0) AS page FROM pages) SELECT page_id, page || '?page=' || (page_id % 9) AS href FROM p UNION SELECT page_id, root || '/list/' || page_id FROM p WHERE page_id % 2 = 0 UNION SELECT page_id, 'https://x.example/n' FROM p WHERE page_id % 3 = 0")
def listing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pagination links of listings, made absolute; other links aren't taken."""
    p = read(spark, sf_dir, "pages")
    tag = lambda test, *parts: F.when(test, F.concat(*parts)).otherwise(F.lit(""))
    html = F.concat(
        F.lit('<a href="/about">About</a><a class="n" href="?page='), F.col("page_id") % 9, F.lit('">2</a>'),
        tag(F.col("page_id") % 2 == 0, F.lit('<link rel="next" href="/list/'), F.col("page_id"), F.lit('">')),
        tag(F.col("page_id") % 3 == 0, F.lit('<a aria-label="Next page" href="https://x.example/n">»</a>')),
    )
    return adapters.listing_links(p.select("page_id", "url", html.alias("html")))


@register("n09_gzip_round_trip", "SELECT doc_id, sha256(text) AS sha, length(text) AS n, true AS smaller_or_short FROM documents WHERE text IS NOT NULL")
def gzip_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts compressed and back again; short ones may grow by the format's head."""
    d = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", gzipped("text").alias("b"))
    back = d.withColumn("t", gunzipped("b"))
    return back.select("doc_id", F.sha2("t", 256).alias("sha"), F.length("t").cast("long").alias("n"), (F.length("b") <= F.octet_length("text") + 40).alias("smaller_or_short"))


@register(
    "k14_review_labels",
    "WITH p AS (SELECT o_custkey % 200 AS a, 200 + o_custkey % 17 AS b, max_by(o_totalprice / 600000, o_orderkey) AS score, max(o_orderkey) AS pair_id FROM orders GROUP BY 1, 2), d AS (SELECT o_custkey % 200 AS a, 200 + o_custkey % 17 AS b, max_by(CASE WHEN o_orderkey % 3 = 0 THEN 'same' ELSE 'different' END, o_orderkey) AS decision FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1, 2) SELECT a, b, pair_id, score, decision = 'same' AS label FROM p JOIN d USING (a, b)",
)
def review_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the label export holds: the newest review row of each decided pair with its newest decision."""
    key, a, b = F.col("o_orderkey"), (F.col("o_custkey") % 200).alias("a"), (200 + F.col("o_custkey") % 17).alias("b")
    o = read(spark, sf_dir, "orders")
    p = o.groupBy(a, b).agg(F.max_by(F.col("o_totalprice") / 600000, key).alias("score"), F.max(key).alias("pair_id"))
    d = o.where("o_orderstatus <> 'O'").groupBy(a, b).agg(F.max_by(F.when(key % 3 == 0, "same").otherwise("different"), key).alias("decision"))
    return p.join(d, ["a", "b"]).select("a", "b", "pair_id", "score", (F.col("decision") == "same").alias("label"))


@register(
    "k12_country_pages",
    f"WITH {_PANELS}, recent AS (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY collected_at DESC, id) AS r FROM live) SELECT c.slug, c.n AS total, (SELECT string_agg(topic || '=' || p.n, ',' ORDER BY topic) FROM pages p WHERE p.country = c.country) AS topics, (SELECT string_agg(id::VARCHAR, ',' ORDER BY r) FROM recent WHERE recent.source = c.country AND r <= 50) AS articles FROM countries c",
)
def country_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a country page: totals, topics and the fifty newest documents, without their text."""
    live = model.docs(spark, sf_dir).where("not retracted")
    slug = F.lower(F.regexp_replace("source", "[^a-zA-Z0-9]+", "-"))
    topics = live.groupBy("source", "lang").agg(F.count("*").alias("n")).groupBy("source").agg(F.sum("n").alias("total"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "lang", "n"))), ",").alias("topics"))
    newest = Window.partitionBy("source").orderBy(F.desc("collected_at"), "id")
    top = live.select("source", "id", "collected_at").withColumn("r", F.row_number().over(newest)).where("r <= 50")
    lists = top.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"].cast("string")), ",").alias("articles"))
    return topics.join(lists, "source").select(slug.alias("slug"), "total", "topics", "articles")
