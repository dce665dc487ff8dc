"""Identities, evidence and provenance: what a row was made from, and checks that it can be traced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: the version that is part of every evidence fingerprint.
EVIDENCE_VERSION = "1"


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based (SHA-1) UUID of a name in a namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def language_tag(c: Column) -> Column:
    return F.lower(F.trim(c))


def fingerprint(uid: Column, text_sha256: Column, start: Column, end: Column, object_type: Column, language: Column) -> Column:
    """``sha256:`` and the hash of the seven fields as compact JSON with sorted keys; the extractor is no part of it."""
    fields = F.struct(
        uid.alias("document_uid"),
        end.cast("long").alias("end_offset"),
        F.lit(EVIDENCE_VERSION).alias("identity_version"),
        language_tag(language).alias("language"),
        object_type.alias("object_type"),
        text_sha256.alias("source_text_sha256"),
        start.cast("long").alias("start_offset"),
    )
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(fields), 256))


def span_problem(text: Column, start: Column, end: Column, span: Column) -> Column:
    """Why a half-open code-point span isn't an exact slice of the text; null if it is."""
    return F.when((start < 0) | (end <= start) | (end > F.length(text)) | text.isNull(), "out_of_bounds").when(text.substr((start + 1).cast("int"), (end - start).cast("int")) != span, "other_text")


def mention_problem(types: tuple[str, ...]) -> Column:
    """The first rule that a mention breaks; columns text, text_sha256, start_offset, end_offset, surface, object_type, language."""
    c = F.col
    return F.coalesce(
        F.when(~c("object_type").isin(*types), "unknown_type"),
        F.when(F.coalesce(language_tag(c("language")), F.lit("und")) == "und", "no_language"),
        F.when(F.sha2("text", 256) != c("text_sha256"), "other_hash"),
        span_problem(c("text"), c("start_offset"), c("end_offset"), c("surface")),
    )


def registered(versions: DataFrame, wanted: DataFrame, keys: tuple[str, ...] = ("name", "version")) -> DataFrame:
    """Existing versions with ids, and the wanted ones that lack, numbered on in order of their keys (a handful of rows)."""
    from pyspark.sql.window import Window

    new = wanted.select(*keys).distinct().join(versions, list(keys), "left_anti")
    last = F.broadcast(versions.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")))
    numbered = new.withColumn("at", F.row_number().over(Window.orderBy(*keys))).join(last)
    return versions.select("id", *keys).unionByName(numbered.select((F.col("last") + F.col("at")).cast("long").alias("id"), *keys))


def adoption_issue(types: tuple[str, ...]) -> Column:
    """The first failing check of an unmapped mention beside its (maybe missing) document and extractor version."""
    c = F.col
    return F.coalesce(
        F.when(c("text").isNull(), "missing_document"),
        F.when(~c("object_type").isin(*types), "invalid_object_type"),
        F.when(c("extractor_id").isNull(), "missing_extractor_version"),
        F.when(F.coalesce(c("language"), F.lit("")) == "", "missing_language"),
        F.when((F.sha2("text", 256) != c("text_sha256")) | (F.length("text") != c("text_length")) | span_problem(c("text"), c("start_offset"), c("end_offset"), c("surface")).isNotNull(), "invalid_source_span"),
    )


def group_key(surfaces: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Adds known and group_key: the dictionary's canonical name where its type agrees, else the surface.

    Of a surface's several entries the last counts. The dictionary is as small as its file, and is broadcast.
    """
    last = dictionary.groupBy("surface").agg(F.max_by(F.struct("object_type", "canonical"), "position").alias("x"))
    own = F.broadcast(last.select("surface", F.col("x.object_type").alias("known_type"), F.col("x.canonical").alias("known")))
    out = surfaces.join(own, "surface", "left").withColumn("known", F.when(F.col("known_type") == F.col("object_type"), F.col("known")))
    return out.withColumn("group_key", F.coalesce("known", "surface")).drop("known_type")


def partition_apart(members: DataFrame, apart: DataFrame) -> DataFrame:
    """(grp, id, part): each group split so that no part holds a forbidden pair; part is its least member.

    Greedy in order of ids, each into the first part without anyone it must not meet. Ids that
    no forbidden pair names always go to the first part, so only the named ones of a group come together.
    """
    import pandas as pd

    ends = apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    inside = ends.join(members.select(F.col("grp"), F.col("id").alias("a")), "a").join(members.select("grp", F.col("id").alias("b")), ["grp", "b"])
    named = inside.select("grp", F.col("a").alias("id")).unionByName(inside.select("grp", F.col("b").alias("id"))).distinct()
    free = members.join(named, ["grp", "id"], "left_anti")
    kind = dict(members.dtypes)["grp"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = set(zip(pdf.a, pdf.b, strict=True))
        parts: list[list[int]] = []
        for x in sorted({v for p in pairs for v in p}):
            home = next((p for p in parts if all((min(x, y), max(x, y)) not in pairs for y in p)), None)
            parts.append([x]) if home is None else home.append(x)
        rows = [(pdf.grp.iloc[0], x, k) for k, p in enumerate(parts) for x in p]
        return pd.DataFrame(rows, columns=["grp", "id", "at"])

    placed = inside.groupBy("grp").applyInPandas(run, f"grp {kind}, id long, at int")
    at = placed.unionByName(free.select("grp", "id", F.lit(0).alias("at")))
    least = at.groupBy("grp", "at").agg(F.min("id").alias("part"))
    return at.join(least, ["grp", "at"]).select("grp", "id", "part")


def constraints_between(decisions: DataFrame, placed: DataFrame) -> DataFrame:
    """(a, b, decision) of the latest decisions between representatives; both ends must be known and differ."""
    latest = decisions.groupBy("a", "b").agg(F.max_by("decision", "id").alias("decision"))
    of = lambda end: placed.select(F.col("id").alias(end), F.col("part").alias(f"{end}_rep"))
    both = latest.join(of("a"), "a").join(of("b"), "b").where("a_rep <> b_rep")
    return both.select(F.least("a_rep", "b_rep").alias("a"), F.greatest("a_rep", "b_rep").alias("b"), "decision").distinct()


def digest(rows: DataFrame, by: str, member: str) -> DataFrame:
    """(by, n, digest): the hash of a key's distinct members as a sorted JSON list."""
    return rows.groupBy(by).agg(F.array_sort(F.collect_set(member)).alias("_m")).select(by, F.size("_m").alias("n"), F.sha2(F.to_json("_m"), 256).alias("digest"))
