"""Documents, mentions, entities and facts as written rows, with their evidence, provenance and adoption checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import provenance as prov
from . import model
from .catalogue import read, register

_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
_TYPES = ("person", "place")  # the dictionary's groups are unknown to this ontology
_IN = "('person', 'place')"

_UID = f"sha1(unhex('{_NAMESPACE.replace('-', '')}') || encode('document/' || {{id}}))"
_UUID = "substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr({h}, 17, 1)) - 1) % 4 + 1, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"
_WRITTEN = f"""{model.SPANS_SQL}, uids AS (SELECT id, {_UUID.format(h='h')} AS uid FROM (SELECT id, {_UID.format(id='id')} AS h FROM docs)),
  written AS (SELECT d.id, d.source, d.text, d.collected_at, d.retracted, d.lang, sha256(d.text) AS text_sha256, length(d.text)::BIGINT AS text_length, uid FROM docs d JOIN uids USING (id))"""


def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored: with hash, length and durable uid."""
    d = model.docs(spark, sf_dir)
    uid = prov.uuid5(_NAMESPACE, F.concat(F.lit("document/"), F.col("id")))
    return d.select("id", "source", "text", "collected_at", "retracted", "lang", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("long").alias("text_length"), uid.alias("uid"))


@register("k05_t34_documents", f"WITH {_WRITTEN} SELECT id, uid, text_sha256, text_length, 'v1/documents/' || substr(text_sha256, 1, 2) || '/' || text_sha256 || '.txt.gz' AS text_blob_key FROM written")
def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(spark, sf_dir).select("id", "uid", "text_sha256", "text_length", tx.blob_key(F.col("text")).alias("text_blob_key"))


@register(
    "s08_blob_check",
    f"WITH {_WRITTEN}, got AS (SELECT id, text_sha256, text_length, CASE WHEN id % 9 = 0 THEN text || '!' WHEN id % 14 <> 0 THEN text END AS blob FROM written) SELECT id, coalesce(sha256(blob) = text_sha256 AND length(blob) = text_length, false) AS intact FROM got",
)
def blob_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched texts against the stored hash and length; some are changed, some missing."""
    got = written(spark, sf_dir).withColumn("blob", F.when(F.col("id") % 9 == 0, F.concat("text", F.lit("!"))).when(F.col("id") % 14 != 0, F.col("text")))
    return got.select("id", F.coalesce((F.sha2("blob", 256) == F.col("text_sha256")) & (F.length("blob") == F.col("text_length")), F.lit(False)).alias("intact"))


#: Mentions as they arrive: some shifted, of an unknown type, in no language, or beside another text.
_ARRIVING = f"""{_WRITTEN}, arriving AS (SELECT s.id, s.doc_id, s.object_type, s.surface, s.start_offset + CASE WHEN s.id % 23 = 0 THEN 1 WHEN s.id % 29 = 0 THEN 10000000 ELSE 0 END AS start_offset,
  s.end_offset + CASE WHEN s.id % 23 = 0 THEN 1 WHEN s.id % 29 = 0 THEN 10000000 ELSE 0 END AS end_offset, CASE WHEN s.id % 31 = 0 THEN ' UND ' WHEN s.id % 37 > 0 THEN w.lang END AS language,
  w.text, CASE WHEN s.id % 41 = 0 THEN 'x' ELSE w.text_sha256 END AS text_sha256, w.text_length, w.uid, s.version FROM spans s JOIN written w ON w.id = s.doc_id)"""
_SPAN_SQL = "CASE WHEN start_offset < 0 OR end_offset <= start_offset OR end_offset > length(text) OR text IS NULL THEN 'out_of_bounds' WHEN substr(text, start_offset + 1, end_offset - start_offset) <> surface THEN 'other_text' END"


def arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = model.spans(spark, sf_dir).drop("retracted")
    w = written(spark, sf_dir).select(F.col("id").alias("doc_id"), "lang", "text", "text_sha256", "text_length", "uid")
    shift = F.when(F.col("id") % 23 == 0, 1).when(F.col("id") % 29 == 0, 10_000_000).otherwise(0)
    rows = s.join(w, "doc_id").withColumns({"start_offset": F.col("start_offset") + shift, "end_offset": F.col("end_offset") + shift})
    rows = rows.withColumn("language", F.when(F.col("id") % 31 == 0, " UND ").when(F.col("id") % 37 > 0, F.col("lang")))
    return rows.withColumn("text_sha256", F.when(F.col("id") % 41 == 0, "x").otherwise(F.col("text_sha256"))).drop("lang")


@register("t21_span_checks", f"WITH {_ARRIVING} SELECT id, {_SPAN_SQL} AS problem FROM arriving")
def span_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arriving(spark, sf_dir).select("id", prov.span_problem(F.col("text"), F.col("start_offset"), F.col("end_offset"), F.col("surface")).alias("problem"))


_PROBLEM_SQL = f"CASE WHEN object_type NOT IN {_IN} THEN 'unknown_type' WHEN coalesce(lower(trim(language)), 'und') = 'und' THEN 'no_language' WHEN sha256(text) <> text_sha256 THEN 'other_hash' ELSE {_SPAN_SQL} END"


@register("k06_mention_writes", f"WITH {_ARRIVING} SELECT id, {_PROBLEM_SQL} AS problem FROM arriving")
def mention_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arriving(spark, sf_dir).select("id", prov.mention_problem(_TYPES).alias("problem"))


_PRINT_SQL = """'sha256:' || sha256('{"document_uid":"' || uid || '","end_offset":' || end_offset || ',"identity_version":"1","language":"' || lower(trim(language)) || '","object_type":"' || object_type || '","source_text_sha256":"' || text_sha256 || '","start_offset":' || start_offset || '}')"""


@register("g01_t33_evidence_identities", f"WITH {_ARRIVING}, ok AS (SELECT *, {_PRINT_SQL} AS fingerprint FROM arriving WHERE ({_PROBLEM_SQL}) IS NULL) SELECT fingerprint, min(id) AS first_mention, count(*) AS mentions FROM ok GROUP BY 1")
def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Get-or-create: one identity a fingerprint, from the mentions that may be written."""
    ok = arriving(spark, sf_dir).where(prov.mention_problem(_TYPES).isNull())
    mark = prov.fingerprint(F.col("uid"), F.col("text_sha256"), F.col("start_offset"), F.col("end_offset"), F.col("object_type"), F.col("language"))
    return ok.groupBy(mark.alias("fingerprint")).agg(F.min("id").alias("first_mention"), F.count("*").alias("mentions"))


_VERSIONS_SQL = "versions AS (SELECT * FROM (VALUES (1, 'dictionary', 'v1'), (2, 'model', 'v1')) AS v(id, name, version))"


def _versions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, "dictionary", "v1"), (2, "model", "v1")], "id long, name string, version string")


@register(
    "k10_j02_extractor_versions",
    f"WITH {model.SPANS_SQL}, {_VERSIONS_SQL}, new AS (SELECT DISTINCT 'dictionary' AS name, version FROM spans EXCEPT SELECT name, version FROM versions), everything AS (SELECT id, name, version FROM versions UNION ALL SELECT 2 + row_number() OVER (ORDER BY name, version), name, version FROM new) SELECT v.id, v.name, v.version, count(s.id) AS mentions FROM everything v LEFT JOIN spans s ON v.name = 'dictionary' AND v.version = s.version GROUP BY ALL",
)
def extractor_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = model.spans(spark, sf_dir).select(F.lit("dictionary").alias("name"), "version").groupBy("name", "version").agg(F.count("*").alias("mentions"))
    every = prov.registered(_versions(spark), s)
    return every.join(F.broadcast(s), ["name", "version"], "left").select("id", "name", "version", F.coalesce("mentions", F.lit(0)).alias("mentions"))


@register(
    "g04_identity_adoption",
    f"""WITH {_ARRIVING}, {_VERSIONS_SQL}, x AS (SELECT a.id, a.object_type, a.surface, a.start_offset, a.end_offset, CASE WHEN a.doc_id % 43 > 0 THEN a.text END AS text, a.text_sha256, a.text_length, a.language, v.id AS extractor_id FROM arriving a LEFT JOIN versions v ON v.name = 'dictionary' AND v.version = a.version)
        SELECT id, CASE WHEN text IS NULL THEN 'missing_document' WHEN object_type NOT IN {_IN} THEN 'invalid_object_type' WHEN extractor_id IS NULL THEN 'missing_extractor_version' WHEN coalesce(language, '') = '' THEN 'missing_language' WHEN sha256(text) <> text_sha256 OR length(text) <> text_length OR ({_SPAN_SQL}) IS NOT NULL THEN 'invalid_source_span' END AS issue FROM x""",
)
def adoption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unmapped mention's first failing check; null ones are adopted."""
    v = _versions(spark).where("name = 'dictionary'").select("version", F.col("id").alias("extractor_id"))
    a = arriving(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 43 > 0, F.col("text"))).join(F.broadcast(v), "version", "left")
    return a.select("id", prov.adoption_issue(_TYPES).alias("issue"))


_POSITIONED = "dict AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {i})" for i, (a, b, c) in enumerate((*model.DICTIONARY, ("place", "that there", "that"), ("group", "with", "quela")))) + ") AS d(object_type, canonical, surface, position))"


def _positioned(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b, c, i) for i, (a, b, c) in enumerate((*model.DICTIONARY, ("place", "that there", "that"), ("group", "with", "quela")))], "object_type string, canonical string, surface string, position int")


_GROUPED = f"{model.SPANS_SQL}, {_POSITIONED}, last AS (SELECT surface, arg_max(object_type, position) AS known_type, arg_max(canonical, position) AS known FROM dict GROUP BY 1), grouped AS (SELECT s.id, s.doc_id, s.object_type, s.surface, CASE WHEN l.known_type = s.object_type THEN l.known END AS known, coalesce(CASE WHEN l.known_type = s.object_type THEN l.known END, s.surface) AS group_key FROM spans s LEFT JOIN last l USING (surface) WHERE NOT s.retracted)"


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = model.spans(spark, sf_dir).where("not retracted").select("id", "doc_id", "object_type", "surface")
    return prov.group_key(s, _positioned(spark))


@register("r02_r04_j18_x05_groups", f"WITH {_GROUPED} SELECT object_type, group_key, min(id) AS representative, arg_min(surface, id) AS surface, max(known) AS gazetteer_name, count(*) AS members FROM grouped GROUP BY 1, 2")
def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and dictionary groups, each with its least mention, whose context alone feeds the features."""
    g = grouped(spark, sf_dir).groupBy("object_type", "group_key")
    return g.agg(F.min("id").alias("representative"), F.min_by("surface", "id").alias("surface"), F.max("known").alias("gazetteer_name"), F.count("*").alias("members"))


#: Pairs that must stay apart: the same group's mentions in a document and the next one, in every sixth.
_APART_SQL = f"{_GROUPED}, apart AS (SELECT l.id AS a, r.id AS b FROM grouped l JOIN grouped r ON r.doc_id = l.doc_id + 1 AND l.doc_id % 6 = 0 AND l.surface = r.surface), placed AS (SELECT g.id, object_type || ':' || group_key AS grp, (apart.b IS NOT NULL)::INT AS lane FROM grouped g LEFT JOIN apart ON apart.b = g.id), parts AS (SELECT *, min(id) OVER (PARTITION BY grp, lane) AS part FROM placed)"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grouped(spark, sf_dir)
    left = g.where("doc_id % 6 = 0").select(F.col("id").alias("a"), (F.col("doc_id") + 1).alias("doc_id"), "surface")
    apart = left.join(g.select(F.col("id").alias("b"), "doc_id", "surface"), ["doc_id", "surface"]).select("a", "b")
    return prov.partition_apart(g.select(F.concat_ws(":", "object_type", "group_key").alias("grp"), "id"), apart)


@register("r03_parts_of_groups", f"WITH {_APART_SQL} SELECT grp, id, part FROM parts")
def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir)


_DECIDED = "decisions AS (SELECT o_orderkey AS id, (o_custkey % 120) * 10 + o_orderkey % 9 AS a, (o_custkey % 117) * 10 + o_orderkey % 7 AS b, CASE WHEN o_orderkey % 3 = 0 THEN 'same' ELSE 'different' END AS decision FROM orders)"


@register(
    "r10_constraints_to_representatives",
    f"WITH {_APART_SQL}, {_DECIDED}, latest AS (SELECT a, b, arg_max(decision, id) AS decision FROM decisions GROUP BY a, b) SELECT DISTINCT least(x.part, y.part) AS a, greatest(x.part, y.part) AS b, decision FROM latest l JOIN parts x ON x.id = l.a JOIN parts y ON y.id = l.b WHERE x.part <> y.part",
)
def representative_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    decisions = o.select(key.alias("id"), ((F.col("o_custkey") % 120) * 10 + key % 9).alias("a"), ((F.col("o_custkey") % 117) * 10 + key % 7).alias("b"), F.when(key % 3 == 0, "same").otherwise("different").alias("decision"))
    return prov.constraints_between(decisions, _parts(spark, sf_dir))


#: Entities: one a part of a group; every member is an entity_mentions row and a provenance row.
_ENTITIES = f"{_APART_SQL}, members AS (SELECT part AS entity_id, id AS mention_id FROM parts), entities AS (SELECT part AS id, any_value(grp) AS grp, count(*) AS mention_count FROM parts GROUP BY part)"


@register("k07_r14_entity_writes", f"WITH {_ENTITIES} SELECT e.id, grp, mention_count, count(m.mention_id) AS provenance_rows, count(DISTINCT s.doc_id) AS documents FROM entities e JOIN members m ON m.entity_id = e.id JOIN spans s ON s.id = m.mention_id GROUP BY ALL")
def entity_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _parts(spark, sf_dir).withColumn("doc_id", F.expr("id div 10"))
    return m.groupBy(F.col("part").alias("id")).agg(F.first("grp").alias("grp"), F.count("*").alias("mention_count"), F.count("id").alias("provenance_rows"), F.countDistinct("doc_id").alias("documents"))


_LINKABLE = (("person", "place"), ("person", "group"))


@register(
    "k08_links",
    f"WITH {_ENTITIES}, kinds AS (SELECT id, split_part(grp, ':', 1) AS kind FROM entities), pairs AS (SELECT x.entity_id AS src, y.entity_id AS dst, count(*) AS n FROM members x JOIN members y ON x.mention_id // 10 = y.mention_id // 10 AND x.entity_id <> y.entity_id GROUP BY ALL) SELECT src, dst, 'near' AS link_type, n FROM pairs JOIN kinds s ON s.id = src JOIN kinds d ON d.id = dst WHERE (s.kind, d.kind) IN (('person', 'place'), ('person', 'group'))",
)
def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between entities that share documents, of the kinds that the ontology lets link."""
    m = _parts(spark, sf_dir).select(F.expr("id div 10").alias("doc_id"), F.col("part").alias("entity"), F.substring_index("grp", ":", 1).alias("kind"))
    x, y = (m.withColumnsRenamed({"entity": e, "kind": f"{e}_kind"}) for e in ("src", "dst"))
    allowed = F.struct("src_kind", "dst_kind").isin(*[F.struct(F.lit(a), F.lit(b)) for a, b in _LINKABLE])
    near = x.join(y, "doc_id").where(allowed & (F.col("src") != F.col("dst")))  # a document has a mention a surface at most
    return near.groupBy("src", "dst").agg(F.lit("near").alias("link_type"), F.count("*").alias("n"))


@register("j09_a07_current_entities", f"WITH {_ENTITIES}, current AS (SELECT id FROM spans WHERE version = 'v2' AND NOT retracted) SELECT count(DISTINCT entity_id) AS entities, count(*) AS mentions FROM members JOIN current ON current.id = mention_id")
def current_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = model.spans(spark, sf_dir).where("version = 'v2' and not retracted").select("id")
    return _parts(spark, sf_dir).join(current, "id", "left_semi").agg(F.countDistinct("part").alias("entities"), F.count("*").alias("mentions"))


@register(
    "j10_j11_g05_live_clusters",
    f"""WITH {_ENTITIES}, mapped AS (SELECT s.id AS mention_id, s.doc_id || '@' || s.start_offset AS evidence, CASE WHEN s.id % 53 = 0 THEN 'other' ELSE s.object_type END AS evidence_type FROM spans s WHERE s.id % 47 > 0),
        wide AS (SELECT m.entity_id, split_part(e.grp, ':', 1) AS kind, s.id AS mention_id, s.version, d.retracted, p.evidence, p.evidence_type FROM entities e LEFT JOIN members m ON m.entity_id = e.id LEFT JOIN spans s ON s.id = m.mention_id LEFT JOIN docs d ON d.id = s.doc_id LEFT JOIN mapped p ON p.mention_id = s.id)
        SELECT entity_id, CASE WHEN mention_id IS NULL THEN 'no_mention' WHEN retracted THEN 'retracted_evidence' WHEN evidence IS NULL THEN 'unmapped_mention' WHEN evidence_type <> kind THEN 'other_type' ELSE 'ok' END AS outcome, count(*) AS n, min(mention_id) AS anchor FROM wide GROUP BY 1, 2""",
)
def live_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities joined through to their evidence; what lacks a row, or has the wrong one, is named."""
    m = _parts(spark, sf_dir).select(F.col("part").alias("entity_id"), F.substring_index("grp", ":", 1).alias("kind"), F.col("id").alias("mention_id"))
    s = model.spans(spark, sf_dir).select(F.col("id").alias("mention_id"), "doc_id", "object_type", "start_offset")
    d = model.docs(spark, sf_dir).select(F.col("id").alias("doc_id"), "retracted")
    mapped = s.where("mention_id % 47 > 0").select("mention_id", F.concat_ws("@", "doc_id", "start_offset").alias("evidence"), F.when(F.col("mention_id") % 53 == 0, "other").otherwise(F.col("object_type")).alias("evidence_type"))
    wide = m.join(s.select("mention_id", "doc_id"), "mention_id", "left").join(d, "doc_id", "left").join(mapped, "mention_id", "left")
    outcome = F.when(F.col("mention_id").isNull(), "no_mention").when(F.col("retracted"), "retracted_evidence").when(F.col("evidence").isNull(), "unmapped_mention").when(F.col("evidence_type") != F.col("kind"), "other_type").otherwise("ok")
    return wide.groupBy("entity_id", outcome.alias("outcome")).agg(F.count("*").alias("n"), F.min("mention_id").alias("anchor"))


@register(
    "g06_g06a_generation_checks",
    f"""WITH {_ENTITIES}, claims AS (SELECT entity_id, mention_id, 'r1' AS resolver FROM members WHERE mention_id % 59 > 0 UNION ALL SELECT entity_id, mention_id, 'r1' FROM members WHERE mention_id % 61 = 0 UNION ALL SELECT entity_id, mention_id, 'r0' FROM members WHERE mention_id % 67 = 0),
        c AS (SELECT m.entity_id, m.mention_id, count(resolver) FILTER (WHERE resolver = 'r1') AS own FROM members m LEFT JOIN claims USING (entity_id, mention_id) GROUP BY ALL)
        SELECT 'provenance_missing' AS rule, count(*) FILTER (WHERE own = 0) AS violations FROM c UNION ALL SELECT 'provenance_twice', count(*) FILTER (WHERE own > 1) FROM c
        UNION ALL SELECT 'evidence_of_two_owners', (SELECT count(*) FROM (SELECT mention_id FROM members GROUP BY 1 HAVING count(DISTINCT entity_id) > 1)) UNION ALL SELECT 'present_without_members', (SELECT count(*) FROM entities WHERE mention_count = 0)""",
)
def generation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _parts(spark, sf_dir).select(F.col("part").alias("entity_id"), F.col("id").alias("mention_id"))
    claim = lambda test, who: m.where(test).withColumn("resolver", F.lit(who))
    claims = claim("mention_id % 59 > 0", "r1").unionByName(claim("mention_id % 61 = 0", "r1")).unionByName(claim("mention_id % 67 = 0", "r0"))
    own = m.join(claims, ["entity_id", "mention_id"], "left").groupBy("entity_id", "mention_id").agg(F.count_if(F.col("resolver") == "r1").alias("own"))
    per = own.agg(F.count_if(F.col("own") == 0).alias("provenance_missing"), F.count_if(F.col("own") > 1).alias("provenance_twice"))
    two = m.groupBy("mention_id").agg(F.countDistinct("entity_id").alias("k")).agg(F.count_if(F.col("k") > 1).alias("evidence_of_two_owners"))
    none = m.groupBy("entity_id").agg(F.count("mention_id").alias("k")).agg(F.count_if(F.col("k") == 0).alias("present_without_members"))
    wide = per.join(F.broadcast(two)).join(F.broadcast(none))  # one row each
    return wide.unpivot([], ["provenance_missing", "provenance_twice", "evidence_of_two_owners", "present_without_members"], "rule", "violations")


@register("g10_g12_membership_digests", f"WITH {_ENTITIES}, d AS (SELECT entity_id, list_sort(list(DISTINCT (mention_id // 10) || '#' || (mention_id % 10))) AS l FROM members GROUP BY 1) SELECT entity_id, len(l) AS n, sha256('[\"' || array_to_string(l, '\",\"') || '\"]') AS digest FROM d")
def membership_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _parts(spark, sf_dir).select(F.col("part").alias("entity_id"), F.concat(F.expr("id div 10"), F.lit("#"), F.col("id") % 10).alias("evidence"))
    return prov.digest(m, "entity_id", "evidence").withColumn("n", F.col("n").cast("long"))


@register(
    "k09_j15_g16_provenance_chain",
    f"""WITH {model.SPANS_SQL}, fact_rows AS (SELECT id * 3 + k AS id, id AS doc_id, k AS kind, CASE WHEN k > 0 THEN id * 3 + k - 1 END AS supersedes_id FROM docs, (SELECT unnest(range(3)) AS k)),
        provenance AS (SELECT 'facts' AS target_table, f.id AS target_id, f.doc_id, s.id AS mention_id, CASE WHEN f.kind = 2 THEN 'v2' ELSE 'v1' END AS version FROM fact_rows f LEFT JOIN spans s ON s.doc_id = f.doc_id AND f.kind = 0)
        SELECT p.target_table, p.target_id, f.supersedes_id, d.source, p.mention_id, s.surface, s.start_offset, s.end_offset, p.version FROM provenance p JOIN fact_rows f ON f.id = p.target_id JOIN docs d ON d.id = p.doc_id LEFT JOIN spans s ON s.id = p.mention_id""",
)
def provenance_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All origins of recorded facts: document, span and extractor in one join."""
    d = model.docs(spark, sf_dir).select(F.col("id").alias("doc_id"), "source")
    f = d.withColumn("kind", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("target_id", F.col("doc_id") * 3 + F.col("kind"))
    s = model.spans(spark, sf_dir).select("doc_id", F.lit(0).alias("kind"), F.col("id").alias("mention_id"), "surface", "start_offset", "end_offset")
    out = f.join(s, ["doc_id", "kind"], "left")
    return out.select(F.lit("facts").alias("target_table"), "target_id", F.when(F.col("kind") > 0, F.col("target_id") - 1).alias("supersedes_id"), "source", "mention_id", "surface", "start_offset", "end_offset", F.when(F.col("kind") == 2, "v2").otherwise("v1").alias("version"))


_QUEUE = "cand AS (SELECT o_custkey % 300 AS a, 300 + o_custkey % 23 AS b, max(o_totalprice) / 600000 AS score FROM orders GROUP BY ALL), queued AS (SELECT DISTINCT o_custkey % 300 AS a, 300 + o_custkey % 23 AS b, 's1' AS scorer FROM orders WHERE o_orderpriority = '1-URGENT')"


@register("r16_enqueued_review_pairs", f"WITH {_QUEUE}, fresh AS (SELECT a, b, score FROM cand WHERE abs(score - 0.6) <= 0.3 AND (a, b) NOT IN (SELECT (a, b) FROM queued)) SELECT a, b, score, 's1' AS scorer, p.side FROM fresh, (VALUES ('left'), ('right')) AS p(side)")
def enqueued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review pairs that the scorer version hasn't queued yet, with a provenance row for either mention."""
    o = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 300).alias("a"), (300 + F.col("o_custkey") % 23).alias("b"), "o_totalprice", "o_orderpriority")
    cand = o.groupBy("a", "b").agg((F.max("o_totalprice") / 600000).alias("score")).where("abs(score - 0.6) <= 0.3")
    queued = o.where("o_orderpriority = '1-URGENT'").select("a", "b").distinct()
    fresh = cand.join(queued, ["a", "b"], "left_anti")
    return fresh.select("a", "b", "score", F.lit("s1").alias("scorer"), F.explode(F.array(F.lit("left"), F.lit("right"))).alias("side"))


@register(
    "r18_merge_and_split_checks",
    f"""WITH {_ENTITIES}, asked AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'merge' ELSE 'split' END AS act, (o_custkey % 200) * 10 + o_orderkey % 9 AS a, (o_custkey % 211) * 10 + o_orderkey % 8 AS b FROM orders)
        SELECT q.id, act, CASE WHEN x.id IS NULL OR y.id IS NULL THEN 'no_entity' WHEN split_part(x.grp, ':', 1) <> split_part(y.grp, ':', 1) THEN 'other_type' WHEN act = 'merge' AND x.part = y.part THEN 'already_one' WHEN act = 'split' AND x.part <> y.part THEN 'not_together' ELSE 'ok' END AS outcome, x.part AS a_anchor, y.part AS b_anchor
        FROM asked q LEFT JOIN parts x ON x.id = a LEFT JOIN parts y ON y.id = b""",
)
def merge_and_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether asked-for merges and splits are valid; an entity's anchor is its least mention."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    q = read(spark, sf_dir, "orders").select(key.alias("id"), F.when(key % 2 == 0, "merge").otherwise("split").alias("act"), ((cust % 200) * 10 + key % 9).alias("a"), ((cust % 211) * 10 + key % 8).alias("b"))
    p = _parts(spark, sf_dir)
    side = lambda e: p.select(F.col("id").alias(e), F.col("part").alias(f"{e}_anchor"), F.substring_index("grp", ":", 1).alias(f"{e}_kind"))
    w = q.join(side("a"), "a", "left").join(side("b"), "b", "left")
    one = F.col("a_anchor") == F.col("b_anchor")
    outcome = F.when(F.col("a_anchor").isNull() | F.col("b_anchor").isNull(), "no_entity").when(F.col("a_kind") != F.col("b_kind"), "other_type").when((F.col("act") == "merge") & one, "already_one").when((F.col("act") == "split") & ~one, "not_together").otherwise("ok")
    return w.select("id", "act", outcome.alias("outcome"), "a_anchor", "b_anchor")
