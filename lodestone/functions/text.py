"""Text functions as Column expressions; regular expressions name their classes, as engines differ on ``\\w``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

#: White space as Unicode has it; the same class is used in SQL.
SPACES = "[\\t-\\r\\x1c- \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: Neither word character, white space nor in the Arabic block.
OTHER = "[^\\p{L}\\p{N}_" + SPACES[1:-1] + "\\x{600}-\\x{6ff}]"


def remove_marks(c: Column) -> Column:
    return F.regexp_replace(c, f"[{fixed.MARK_RANGES}]", "")


def remove_tatweel(c: Column) -> Column:
    return F.translate(c, fixed.TATWEEL, "")


def fold_alef(c: Column) -> Column:
    return F.translate(c, "أإآٱ", "اااا")


def fold_ya(c: Column, teh_marbuta: bool = True) -> Column:
    return F.translate(c, "ىة" if teh_marbuta else "ى", "يه" if teh_marbuta else "ي")


def strip_punctuation(c: Column) -> Column:
    """Other characters become spaces; Arabic punctuation stays."""
    return F.regexp_replace(c, OTHER, " ")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACES + "+", " "))


def normalize_arabic(c: Column, teh_marbuta: bool = False, punctuation: bool = True) -> Column:
    """Comparison form for the classifiers; null gives the empty string."""
    out = fold_ya(fold_alef(remove_tatweel(remove_marks(F.coalesce(c, F.lit(""))))), teh_marbuta)
    return collapse(strip_punctuation(out) if punctuation else out)


def remove_words(c: Column, words: tuple[str, ...] = fixed.STOPWORDS) -> Column:
    words = words or fixed.STOPWORDS
    return F.array_join(F.filter(F.split(collapse(c), " "), lambda w: ~w.isin(*words)), " ")


def clean_arabic(c: Column, stopwords: bool = True) -> Column:
    out = normalize_arabic(c)
    return F.trim(remove_words(out)) if stopwords else out


def occurrences(c: Column, word: str) -> Column:
    """Non-overlapping occurrences of a word as a substring."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(word), F.lit("")))) / len(word)).cast("int")


def first_max(scores: list[tuple[str, Column]]) -> Column:
    """(score, name) of the highest score; ties go to the first."""
    return F.array_max(F.array(*[F.struct(s.alias("score"), F.lit(-i).alias("at"), F.lit(n).alias("name")) for i, (n, s) in enumerate(scores)]))


def country_counts(c: Column, countries: dict[str, tuple[str, ...]] = fixed.COUNTRIES) -> list[tuple[str, Column]]:
    """Whole-word counts by country in a normalised text, attached prefixes allowed."""
    text = c
    fold = str.maketrans("أإآٱى", "ااااي")
    out = []
    for name, words in countries.items():
        parts = [F.regexp_count(text, F.lit(f"(?<![؀-ۿ])[وفبلك]{{0,2}}(?:ال)?{w.translate(fold)}(?![؀-ۿ])")) for w in words]
        out.append((name, sum(parts[1:], parts[0])))
    return out


def detect_country(c: Column, countries: dict[str, tuple[str, ...]] = fixed.COUNTRIES) -> Column:
    """The country that a normalised text mentions most, ties in the table's order; null without any."""
    best = first_max(country_counts(c, countries))
    return F.when(c.rlike("[؀-ۿ]") & (best["score"] > 0), best["name"])  # most texts have no such letter


def guess_country(c: Column, words: list[tuple[str, str]]) -> Column:
    """The country of the first listed word that is in the text."""
    return F.coalesce(*[F.when(c.contains(w), F.lit(n)) for w, n in words], F.lit(None).cast("string"))


def topic(c: Column, topics: dict[str, tuple[str, ...]] = fixed.TOPICS) -> Column:
    """(score, name): the topic with most occurrences in a normalised text; none is Uncategorized."""
    text = c
    fold = str.maketrans("أإآٱى", "ااااي")
    scores = []
    for name, words in topics.items():
        parts = [occurrences(text, w.translate(fold)) for w in words]
        scores.append((name, sum(parts[1:], parts[0])))
    best = first_max(scores)
    return F.struct(best["score"].alias("score"), F.when(best["score"] > 0, best["name"]).otherwise("Uncategorized").alias("name"))


def escalation(c: Column, high: tuple[str, ...] = fixed.HIGH, medium: tuple[str, ...] = fixed.MEDIUM, low: tuple[str, ...] = fixed.LOW) -> Column:
    """(score, label) from which cues are present at all."""
    text = F.coalesce(c, F.lit(""))
    count = lambda words: sum((text.contains(w).cast("int") for w in words[1:]), text.contains(words[0]).cast("int"))
    h = count(high)
    score = 3 * h + 2 * count(medium) - count(low)
    label = F.when((h >= 2) | (score >= 6), "high").when((h >= 1) | (score >= 2), "medium").otherwise("low")
    return F.struct(score.alias("score"), label.alias("label"))


def canonical_url(c: Column, keep_query: bool = False) -> Column:
    """Scheme and host in lower case, no fragment (and query), no slash at the end; an empty path is a slash."""
    url = F.trim(F.coalesce(c, F.lit("")))
    part = lambda k: F.regexp_extract(url, r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?", k)
    path = F.regexp_replace(part(3), "/+$", "")
    out = F.concat(
        F.when(part(1) == "", "").otherwise(F.concat(F.lower(part(1)), F.lit(":"))),
        F.when(part(2) == "", "").otherwise(F.concat(F.lit("//"), F.lower(part(2)))),
        F.when(path == "", "/").otherwise(path),
        part(4) if keep_query else F.lit(""),
    )
    return F.when(url == "", "").otherwise(out)


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.trim(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])), 256)


def blob_key(c: Column) -> Column:
    h = F.sha2(c, 256)
    return F.concat(F.lit("v1/documents/"), F.substring(h, 1, 2), F.lit("/"), h, F.lit(".txt.gz"))


def compose(*parts: Column) -> Column:
    """Non-empty parts joined by a blank line."""
    return F.concat_ws("\n\n", *[F.nullif(p, F.lit("")) for p in parts])


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n - 3), F.lit("...")))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def title_without_site(c: Column) -> Column:
    return F.regexp_replace(c, r"[ \t\r\n]*\|.*$", "")


def is_language_tag(c: Column) -> Column:
    return F.lower(F.trim(c)).rlike("^[a-z]{2,8}(-[a-z0-9]{2,8})*$")


def is_public_url(c: Column) -> Column:
    """Absolute http(s), no white space, quotes, backslash, control characters or user, a valid port."""
    good = c.rlike("^https?://[^/?#@:]+(:[0-9]{1,5})?([/?#].*)?$") & ~c.rlike("[\\x00-\\x20\\x7f\"'\\\\]")
    port = F.regexp_extract(c, "^https?://[^/?#@:]+:([0-9]{1,5})", 1)
    return good & ((port == "") | (F.try_to_number(port, F.lit("99999")) <= 65535))


def review_command(c: Column) -> Column:
    """(pair, verdict) of a review title; nulls if it is none."""
    pattern = r"^\[entity-review\] pair ([0-9]+) (accept|reject)$"
    return F.struct(F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).cast("long").alias("pair"), F.nullif(F.regexp_extract(c, pattern, 2), F.lit("")).alias("verdict"))


def snippet(text: Column, start: Column, end: Column, around: int = 20) -> Column:
    """The span in brackets with its surroundings; the text's beginning where there is no span."""
    before = F.greatest(F.lit(0), start - around)
    out = F.concat(text.substr(before + 1, start - before), F.lit("["), text.substr(start + 1, end - start), F.lit("]"), text.substr(end + 1, F.lit(around)))
    return F.when(start.isNull() | end.isNull(), F.substring(text, 1, 80)).otherwise(out)


def mojibake(c: Column, share: float = 0.1) -> Column:
    """Whether Cyrillic characters are at least that share of a text."""
    return (F.length(c) > 0) & (F.regexp_count(c, F.lit("[\\x{400}-\\x{4ff}]")) >= share * F.length(c))


def script_share(c: Column, letters: str) -> Column:
    """Share of letters in a class of letters; 0 without any."""
    n = F.regexp_count(c, F.lit("\\p{L}"))
    return F.when(n > 0, F.regexp_count(c, F.lit(letters)) / n).otherwise(0.0)


def strip_article(c: Column) -> Column:
    return F.when(c.startswith("ال") & (F.length(c) - 2 >= 3), c.substr(F.lit(3), F.length(c))).otherwise(c)


def blocking_keys(tokens: Column, noise: tuple[str, ...] = (), article: bool = False) -> Column:
    """Distinct sorted keys of a name's tokens: whole, last, sorted, first with last initial, three-grams."""
    t = F.filter(tokens, lambda x: (x != "") & ~x.isin(*(noise or ("",))))
    if article:
        t = F.transform(t, strip_article)
    joined, n = F.array_join(t, ""), F.size(t)
    tri = F.when(F.length(joined) >= 3, F.transform(F.sequence(F.lit(1), F.greatest(F.length(joined) - 2, F.lit(1))), lambda i: F.concat(F.lit("tri:"), joined.substr(i, F.lit(3))))).otherwise(F.array().cast("array<string>"))
    last = F.try_element_at(t, F.lit(-1))
    keys = F.array(F.concat(F.lit("full:"), joined), F.concat(F.lit("last:"), last), F.concat(F.lit("sorted:"), F.array_join(F.array_sort(t), "")))
    more = F.when(n > 1, F.array(F.concat(F.lit("firstlast:"), F.try_element_at(t, F.lit(1)), F.substring(last, 1, 1)))).otherwise(F.array().cast("array<string>"))
    return F.when(n > 0, F.array_sort(F.array_distinct(F.concat(keys, more, tri)))).otherwise(F.array().cast("array<string>"))
