"""Source adapters as data: one parser, a row a source."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pages import _text, parse_date

#: Fixed: source, site, path of an article, heading, body, and where a date is looked for in turn.
ADAPTERS = (
    ("AlJazeeraArabic", "www.aljazeera.net", r"^/(news|politics|economy|ebusiness|programs|opinions|culture)/\d{4}/\d{1,2}/\d{1,2}/", "h1", "article", "time meta json"),
    ("BBCArabic", "www.bbc.com", r"^/arabic/(articles|news|middleeast|business|live)/", "h1", "article", "time meta json"),
    ("CNNArabic", "arabic.cnn.com", r"^/(middle-east|business|world|science|sport)/article/\d{4}/", "h1", "article", "time meta json"),
    ("AnNahar", "www.annahar.com", r"^/[a-z-]+(?:/[a-z-]+){0,2}/\d+/", "h1.title", "div.bodyText", "meta json time"),
    ("Youm7", "www.youm7.com", r"^/story/\d{4}/\d{1,2}/\d{1,2}/.+/\d+$", "h1", "div.articleCont", "meta json time"),
    ("LibyaAlAhrar", "libyaalahrar.tv", r"^/\d{4}/\d{2}/\d{2}/.+", "h1.cs-entry__title", "div.entry-content", "json meta time"),
    ("AlKhaleej", "www.alkhaleej.ae", r"^/\d{4}-\d{2}-\d{2}/.+", "h1.article-title", "div.article-text", "meta json time"),
    ("AlMasryAlYoum", "www.almasryalyoum.com", r"^/news/details/\d+", "h1.article-title", "div.article-details", "meta json time"),
    ("SANA", "sana.sy", r"^/[a-z-]+/\d+", "h1.s-title", "div.entry-content", "meta json time"),
    ("AsharqAlAwsat", "aawsat.com", r"^/[^/]+/\d{6,}-", "h1", "div.entry-content", "json meta"),
    ("AlMada", "almadapaper.net", r"^/\d{4,}/?$", "h1#article-main-title", "body", "json meta"),
    ("AlChourouk", "www.alchourouk.com", r"^/article/.+", "h1.page-header", "div", "epoch"),
    ("AmmonNews", "www.ammonnews.net", r"^/article/\d+$", "title", "div#newscontent", "text"),
    ("Hespress", "www.hespress.com", r"-\d+\.html$", "h1.post-title", "article", "meta json"),
    ("Akhbarona", "www.akhbarona.com", r"^/[a-z_]+/\d+\.html$", "h1", "article", "time meta json"),
    ("AlRai", "www.alraimedia.com", r"^/article/\d+(?:/[^/]+){2,}$", "h1.article-title", "div.article-desc", "meta json"),
    ("SudanTribune", "sudantribune.net", r"^/article/\d+$", "h1.single-post__entry-title", "div.entry__article", "json meta"),
    ("AlMasdarOnline", "almasdaronline.com", r"^/articles/\d+$", "h1#subject-title", "div.page_content", "text time"),
    ("AkhbarAlKhaleej", "akhbar-alkhaleej.com", r"^/news/article/\d+$", "h1", "body", "item"),
    ("Wafa", "www.wafa.ps", r"^/news/\d{4}/\d{1,2}/\d{1,2}/.+-\d+$", "h1", "div", "text"),
    ("AlWatanVoice", "www.alwatanvoice.com", r"^/arabic/news/\d{4}/\d{2}/\d{2}/\d+\.html$", "h1", "div#articleText", "meta json time"),
)
#: Fixed: meta names of a publication date, in the order they are tried.
META_DATES = (("property", "article:published_time"), ("name", "article:published_time"), ("property", "og:published_time"), ("name", "pubdate"), ("name", "timestamp"))
#: Fixed: JSON-LD keys of a date, in that order.
JSON_DATES = ("datePublished", "uploadDate", "dateCreated", "dateModified")
#: Fixed: what leads to the next listing page.
LISTING = (r"<link\s[^>]*rel=[\"']next[\"'][^>]*>", r"<a\s[^>]*rel=[\"']next[\"'][^>]*>", r"<a\s[^>]*aria-label=[\"'][^\"']*(?:التالي|Next)[^\"']*[\"'][^>]*>", r"<a\s[^>]*href=[\"'][^\"']*\?page=[^>]*>")
LATIN = ("iso-8859-1", "latin-1")


def element(selector: str) -> str:
    """A pattern for the content of the first element of a ``tag.class`` or ``tag#id`` selector."""
    tag, kind, name = re.fullmatch(r"(\w+)(?:([.#])([\w-]+))?", selector).groups()
    attr = {".": rf"[^>]*\bclass=[\"'][^\"']*(?<![\w-]){name}(?![\w-])[^>]*", "#": rf"[^>]*\bid=[\"']{name}[\"'][^>]*", None: r"(?:\s[^>]*)?"}[kind]
    return rf"(?is)<{tag}{attr}>(.*?)</{tag}>"


def adapters(spark: SparkSession) -> DataFrame:
    rows = [(s, h, p, element(t), element(b), d) for s, h, p, t, b, d in ADAPTERS]
    return spark.createDataFrame(rows, "source string, site string, path_pattern string, title_pattern string, body_pattern string, date_order string")


def meta_date(html: Column) -> Column:
    """The first readable date of the meta elements."""
    found = [F.regexp_extract(html, rf"(?is)<meta\s[^>]*{a}=[\"']{n}[\"'][^>]*content=[\"']([^\"']*)[\"']", 1) for a, n in META_DATES]
    return F.coalesce(*[parse_date(c) for c in found])


def json_date(html: Column) -> Column:
    """The first readable date of the JSON-LD keys."""
    return F.coalesce(*[parse_date(F.regexp_extract(html, rf"\"{k}\"\s*:\s*\"([^\"]*)\"", 1)) for k in JSON_DATES])


def time_date(html: Column) -> Column:
    return parse_date(F.regexp_extract(html, r"(?is)<time\s[^>]*datetime=[\"']([^\"']*)[\"']", 1))


def published(html: Column, order: Column) -> Column:
    """A page's date by its source's order."""
    ways = {"meta": meta_date(html), "json": json_date(html), "time": time_date(html)}
    by = F.lit(None).cast("timestamp")
    for text in sorted({x[-1] for x in ADAPTERS}):
        some = [ways[w] for w in text.split() if w in ways] or list(ways.values())
        by = F.when(order == text, F.coalesce(*some)).otherwise(by)
    return by


def is_article(url: Column, site: Column, path_pattern: Column) -> Column:
    """An address of the site, or of a subdomain, whose path is an article's."""
    own = F.lower(F.regexp_extract(url, r"^https?://([^/?#:]+)", 1))
    path = F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1)
    return own.endswith(site) & F.call_function("regexp_like", path, path_pattern)


def parse(pages: DataFrame, least: int = 0) -> DataFrame:
    """(source, page_id, url, title, body, published_at) of (source, page_id, url, html) rows, by their source's adapter."""
    rows = pages.join(F.broadcast(adapters(pages.sparkSession)), "source")
    title = _text(F.regexp_replace(F.call_function("regexp_extract", F.col("html"), F.col("title_pattern"), F.lit(1)), r"\s*\|.*$", ""))
    inner = F.call_function("regexp_extract", F.col("html"), F.col("body_pattern"), F.lit(1))
    body = F.array_join(F.filter(F.transform(F.regexp_extract_all(inner, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), 1), _text), lambda x: x != ""), " ")
    out = rows.select("source", "page_id", "url", title.alias("title"), body.alias("body"), published(F.col("html"), F.col("date_order")).alias("published_at"))
    return out.where((F.col("title") != "") & (F.length("body") > F.lit(max(least - 1, 0))))


def listing_links(pages: DataFrame) -> DataFrame:
    """(page_id, href): pagination links, absolute, each once."""
    tags = F.flatten(F.array(*[F.regexp_extract_all("html", F.lit(f"(?i){p}"), 0) for p in LISTING]))
    href = F.transform(tags, lambda t: F.trim(F.regexp_extract(t, r"(?i)href=[\"']([^\"']*)[\"']", 1)))
    rows = pages.select("page_id", "url", F.explode(F.filter(F.array_distinct(href), lambda h: h != "")).alias("h"))
    root, page = F.regexp_extract("url", r"^https?://[^/?#]*", 0), F.regexp_extract("url", r"^[^?#]*", 0)
    folder = F.regexp_replace(page, r"(?<=[^/:])/[^/]*$", "")
    full = F.when(F.col("h").rlike("^https?://"), F.col("h")).when(F.col("h").startswith("/"), F.concat(root, "h")).when(F.col("h").startswith("?"), F.concat(page, "h")).otherwise(F.concat(folder, F.lit("/"), "h"))
    return rows.select("page_id", full.alias("href")).distinct()


def encoding(body: Column, declared: Column, guess: str = "windows-1256") -> Column:
    """A page's charset: the declared one unless that is Latin-1, else UTF-8 if its bytes are, else a guess."""
    return F.when(declared.isNotNull() & ~F.lower(declared).isin(*LATIN), F.lower(declared)).when(F.is_valid_utf8(body.cast("string")), "utf-8").otherwise(guess)
