"""Article pages as rows: links, structured data, titles, dates and bodies by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Date formats in the order they are tried.
DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "dd-MM-yyyy hh:mm a", "dd/MM/yyyy HH:mm", "yyyy-MM-dd")


def links(pages: DataFrame, pattern: str = r"(?i)<a\s[^>]*href=\"([^\"]+)\"") -> DataFrame:
    """(page_id, href), each once a page."""
    return pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(pattern), 1))).alias("href"))


def same_site(url: Column, host: Column) -> Column:
    own = F.lower(F.regexp_extract(url, r"^https?://([^/?#:]+)", 1))
    return (own == host) | own.endswith(F.concat(F.lit("."), host))


def json_ld(pages: DataFrame) -> DataFrame:
    """(page_id, item): JSON-LD objects, lists flattened, graph members before what wraps them; bad JSON is skipped."""
    raw = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), 1)).alias("raw"))
    v = raw.select("page_id", F.try_parse_json("raw").alias("v")).where("v is not null")
    many = v.select("page_id", F.coalesce(F.expr("try_variant_get(v, '$', 'array<variant>')"), F.array("v")).alias("some"))
    each = many.select("page_id", F.explode("some").alias("v"))
    return each.select("page_id", F.explode(F.concat(F.coalesce(F.expr("try_variant_get(v, '$[\"@graph\"]', 'array<variant>')"), F.array().cast("array<variant>")), F.array("v"))).alias("item"))


def parse_date(c: Column) -> Column:
    """The first format that reads it; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS])


def _text(c: Column) -> Column:
    plain = F.regexp_replace(c, r"(?s)<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(plain, r"[ \t\r\n]+", " "))


def articles(pages: DataFrame, heading: str = "h1", paragraph: str = "p", least: int = 0) -> DataFrame:
    """(page_id, url, title, body): first heading, paragraphs on one line; pages without either go."""
    title = _text(F.regexp_extract("html", rf"(?s)<{heading}[^>]*>(.*?)</{heading}>", 1))
    paragraphs = F.transform(F.regexp_extract_all("html", F.lit(rf"(?s)<{paragraph}(?:\s[^>]*)?>(.*?)</{paragraph}>"), 1), _text)
    body = F.array_join(F.filter(paragraphs, lambda x: x != ""), " ")
    out = pages.select("page_id", "url", title.alias("title"), body.alias("body"))
    return out.where((F.col("title") != "") & (F.col("body") != "") & (F.length("body") >= least))
