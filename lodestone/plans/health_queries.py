"""Health of runs, stages and sources: the whole projection, and the rules that feed it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import health
from .catalogue import register
from .ledger_queries import _SQL, ledger_events

_NOW = "TIMESTAMP '2024-01-25'"
#: Counters that the ledger's events lack, from their ids; the same text serves both engines.
_MORE = "CASE WHEN event_type LIKE 'source%' THEN id % 11 - 9 END AS selector_failures, CASE WHEN event_type LIKE 'source%' THEN id % 13 - 11 END AS parse_failures, CASE WHEN event_type = 'source_succeeded' AND reason_code = 'other' THEN NULL ELSE reason_code END AS code"
_EVENTS = f"{_SQL}, ev AS (SELECT *, {_MORE}, CASE WHEN event_type LIKE 'source%' THEN occurred_at - to_hours((id % 100)::INT) END AS latest_article_at FROM e)"
_RUNS = f"""{_EVENTS}, runs AS (SELECT r.run_id, t.event_type AS run_end, t.code AS run_reason, l.lease_expires_at AS lease FROM (SELECT DISTINCT run_id FROM ev) r
  LEFT JOIN (SELECT * FROM ev WHERE event_type IN ('run_succeeded', 'run_partial', 'run_failed', 'run_abandoned') QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY occurred_at DESC, id DESC) = 1) t USING (run_id)
  LEFT JOIN (SELECT * FROM ev WHERE lease_expires_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY occurred_at DESC, id DESC) = 1) l USING (run_id))"""
_UNFINISHED = "CASE WHEN run_end IS NULL THEN 'running' WHEN run_end = 'run_abandoned' THEN 'abandoned' WHEN run_end = 'run_succeeded' THEN 'partial' ELSE 'failed' END"
_WHY = "CASE WHEN run_end = 'run_abandoned' THEN 'lease_expired' WHEN run_end IS NOT NULL THEN 'upstream_stage_failed' END"
_STAGES = f"""{_RUNS}, stage_ends AS (SELECT * FROM ev WHERE event_type IN ('stage_succeeded', 'stage_failed') QUALIFY row_number() OVER (PARTITION BY run_id, stage ORDER BY occurred_at DESC, id DESC) = 1),
  stages AS (SELECT k.run_id, k.stage, CASE WHEN x.id IS NULL THEN {_UNFINISHED} WHEN x.event_type = 'stage_failed' THEN 'failed' WHEN x.error_count > 0 THEN 'degraded' ELSE 'succeeded' END AS status,
    CASE WHEN x.id IS NULL THEN {_WHY} WHEN x.event_type = 'stage_failed' THEN x.code WHEN x.error_count > 0 THEN 'unexpected_error' END AS reason
    FROM (SELECT DISTINCT run_id, stage FROM ev WHERE event_type LIKE 'stage%') k JOIN runs USING (run_id) LEFT JOIN stage_ends x ON x.run_id = k.run_id AND x.stage IS NOT DISTINCT FROM k.stage)"""
_SOURCES = f"""{_STAGES}, source_ends AS (SELECT * FROM ev WHERE event_type IN ('source_succeeded', 'source_failed') QUALIFY row_number() OVER (PARTITION BY run_id, stage, source ORDER BY occurred_at DESC, id DESC) = 1),
  warned AS (SELECT *, coalesce(code, CASE WHEN output_count = 0 THEN 'source_zero_yield' END, CASE WHEN selector_failures > 0 THEN 'source_selector_failed' END, CASE WHEN parse_failures > 0 THEN 'source_parse_failed' END,
    CASE WHEN error_count > 0 THEN 'unexpected_error' END, CASE WHEN latest_article_at + INTERVAL 2 DAY < {_NOW} THEN 'data_stale' END) AS warning FROM source_ends),
  sources AS (SELECT w.run_id, w.stage, w.source, CASE WHEN event_type = 'source_failed' THEN 'failed' WHEN warning IS NOT NULL THEN 'degraded' ELSE 'healthy' END AS status, CASE WHEN event_type = 'source_failed' THEN code ELSE warning END AS reason FROM warned w)"""


def health_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ledger_events(spark, sf_dir)
    of = F.col("event_type").startswith("source")
    e = e.withColumns({"selector_failures": F.when(of, F.col("id") % 11 - 9), "parse_failures": F.when(of, F.col("id") % 13 - 11), "latest_article_at": F.when(of, F.col("occurred_at") - F.expr("make_dt_interval(0, cast(id % 100 as int))"))})
    return e.withColumn("reason_code", F.when(~((F.col("event_type") == "source_succeeded") & (F.col("reason_code") == "other")) | F.col("reason_code").isNull(), F.col("reason_code")))


def _now() -> F.Column:
    return F.lit("2024-01-25").cast("timestamp_ntz")


@register("b03a_stage_status", f"WITH {_STAGES} SELECT run_id, stage, status, reason FROM stages")
def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = health_events(spark, sf_dir)
    return health.stage_status(e, health.run_ends(e))


@register("b03b_source_status", f"WITH {_SOURCES} SELECT run_id, stage, source, status, reason FROM sources")
def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = health_events(spark, sf_dir)
    return health.source_status(e, health.run_ends(e), _now())


@register(
    "b03c_overall_status",
    f"""WITH {_SOURCES}, c AS (SELECT run_id, status FROM stages UNION ALL SELECT run_id, status FROM sources), w AS (SELECT run_id, bool_or(status IN ('failed', 'abandoned')) AS f, bool_or(status IN ('running', 'partial')) AS p, bool_or(status = 'degraded') AS d FROM c GROUP BY 1)
        SELECT run_id, CASE WHEN run_end IS NULL AND lease <= {_NOW} THEN 'overdue' WHEN run_end IS NULL THEN 'running' WHEN run_end = 'run_failed' THEN 'failed' WHEN run_end = 'run_abandoned' THEN 'abandoned' WHEN f THEN 'failed' WHEN p THEN 'partial' WHEN d THEN 'degraded' ELSE 'healthy' END AS status FROM runs LEFT JOIN w USING (run_id)""",
)
def overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = health_events(spark, sf_dir)
    runs = health.run_ends(e)
    children = health.stage_status(e, runs).select("run_id", "status").unionByName(health.source_status(e, runs, _now()).select("run_id", "status"))
    return health.overall_status(runs, children, _now())


_DEGRADING = "('source_fetch_failed', 'source_selector_failed', 'source_parse_failed', 'source_zero_yield', 'data_stale')"
_OWN = "CASE id % 8 WHEN 0 THEN 'source_zero_yield' WHEN 1 THEN 'data_stale' WHEN 2 THEN 'nonsense' WHEN 3 THEN 'count_invariant_failed' WHEN 4 THEN 'source_fetch_failed' END"


@register(
    "b06_b07_ingest_outcomes",
    f"""WITH {_SQL}, s AS (SELECT run_id, stage, id, output_count, {_OWN} AS own FROM e WHERE event_type LIKE 'source%'),
        r AS (SELECT *, CASE WHEN own IS NULL THEN CASE WHEN output_count = 0 THEN 'source_zero_yield' END WHEN own = 'nonsense' OR (output_count > 0 AND own = 'source_zero_yield') THEN 'unexpected_error' ELSE own END AS reason FROM s)
        SELECT run_id, stage, count(*) FILTER (WHERE reason IS NULL) AS success, count(*) FILTER (WHERE reason IN {_DEGRADING}) AS degraded, count(*) FILTER (WHERE reason NOT IN {_DEGRADING}) AS failed, CASE WHEN bool_and(output_count = 0) THEN 'source_zero_yield' END AS fatal_reason FROM r GROUP BY ALL""",
)
def ingest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by status, and the stage's fatal reason: every source yielded nothing."""
    e = ledger_events(spark, sf_dir).where("event_type like 'source%'").withColumn("reason", health.scrape_reason(F.expr(_OWN), F.col("output_count")))
    s = e.withColumn("status", health.status_of(F.col("reason")))
    count = lambda x: F.count_if(F.col("status") == x).alias(x)
    return s.groupBy("run_id", "stage").agg(count("success"), count("degraded"), count("failed"), F.when(F.bool_and(F.col("output_count") == 0), "source_zero_yield").alias("fatal_reason"))


@register("b17_times", f"WITH {_SQL} SELECT id, strftime(occurred_at, '%Y-%m-%dT%H:%M:%SZ') AS iso, coalesce(strftime(CASE WHEN id % 4 > 0 THEN occurred_at END, '%Y-%m-%d'), 'Unknown') AS label FROM e")
def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO form with Z, and the day or 'Unknown'."""
    e = ledger_events(spark, sf_dir)
    return e.select("id", F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), F.coalesce(F.date_format(F.when(F.col("id") % 4 > 0, F.col("occurred_at")), "yyyy-MM-dd"), F.lit("Unknown")).alias("label"))


_RELEASES = "rel AS (SELECT event_id AS id, ts AS occurred_at, event_id // 10 AS release, CASE event_type WHEN 'signup' THEN 'release_candidate_created' WHEN 'click' THEN 'promotion_started' WHEN 'view' THEN 'release_published' WHEN 'error' THEN 'release_failed' ELSE 'release_superseded' END AS kind FROM events)"


@register(
    "b09_releases",
    f"WITH {_RELEASES}, p AS (SELECT max(release) AS high_water FROM rel WHERE kind = 'release_published'), now AS (SELECT release FROM rel WHERE kind = 'release_published' ORDER BY occurred_at DESC, id DESC LIMIT 1), c AS (SELECT DISTINCT release FROM rel WHERE kind = 'release_candidate_created') SELECT c.release, CASE WHEN c.release = now.release THEN 'current' WHEN c.release > high_water THEN 'open' ELSE 'superseded' END AS state FROM c, p, now",
)
def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates beside the release last published and the highest one ever published."""
    from .catalogue import read

    kind = F.when(F.col("event_type") == "signup", "release_candidate_created").when(F.col("event_type") == "view", "release_published")
    r = read(spark, sf_dir, "events").select(F.expr("event_id div 10").alias("release"), kind.alias("kind"), F.struct("ts", "event_id").alias("at"))
    out = r.where("kind = 'release_published'").agg(F.max("release").alias("high"), F.max_by("release", "at").alias("now"))
    state = F.when(F.col("release") == F.col("now"), "current").when(F.col("release") > F.col("high"), "open").otherwise("superseded")
    return r.where("kind = 'release_candidate_created'").select("release").distinct().join(F.broadcast(out)).select("release", state.alias("state"))  # one row
