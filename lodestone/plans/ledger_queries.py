"""Event ledger queries: the events table read as runs, stages and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger
from .catalogue import read, register

_KIND = "CASE event_type WHEN 'signup' THEN 'run_started' WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'run_heartbeat' ELSE 'stage_started' END WHEN 'click' THEN 'source_succeeded' WHEN 'error' THEN 'source_failed' ELSE CASE event_id % 6 WHEN 0 THEN 'run_succeeded' WHEN 1 THEN 'run_failed' WHEN 2 THEN 'run_partial' ELSE 'stage_succeeded' END END"
#: Runs are a user's events of one day; the same text serves both engines.
_COLUMNS = """event_id AS id, event_id - event_id % 10 AS bucket, {kind} AS event_type, ts AS occurred_at,
  CASE WHEN {kind} LIKE 'stage%' OR {kind} LIKE 'source%' THEN CASE WHEN event_id % 31 > 0 THEN 'ingest' END END AS stage, CASE WHEN {kind} LIKE 'source%' THEN {src} END AS source,
  CASE WHEN {kind} IN ('run_failed', 'run_partial', 'source_failed') THEN CASE WHEN event_id % 13 > 0 THEN 'boom' END WHEN {kind} = 'source_succeeded' AND event_id % 5 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 'source_zero_yield' ELSE 'other' END END AS reason_code,
  CASE WHEN {kind} LIKE 'source%' THEN event_id % 7 END AS input_count, CASE WHEN {kind} LIKE 'source%' THEN event_id % 4 END AS output_count, CASE WHEN {kind} LIKE 'source%' AND event_id % 29 > 0 THEN event_id % 3 END AS error_count"""
_SQL = (
    "e AS (SELECT "
    + _COLUMNS.format(kind=_KIND, src="'s' || (event_id % 6)")
    + ", 'r' || user_id || '-' || strftime(ts, '%Y%m%d') AS run_id, CASE WHEN "
    + _KIND
    + " IN ('run_started', 'run_heartbeat') AND event_id % 37 > 0 THEN ts + to_minutes((event_id % 90 - 3)::INT) END AS lease_expires_at FROM events)"
)


def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    columns = _COLUMNS.format(kind=_KIND, src="concat('s', event_id % 6)")
    lease = f"CASE WHEN {_KIND} IN ('run_started', 'run_heartbeat') AND event_id % 37 > 0 THEN ts + make_dt_interval(0, 0, cast(event_id % 90 - 3 as int)) END AS lease_expires_at"
    return spark.sql(f"SELECT {columns}, concat('r', user_id, '-', date_format(ts, 'yyyyMMdd')) AS run_id, {lease} FROM {{e}}", e=e)


_NOW = "TIMESTAMP '2024-01-25'"
_RUN = "('run_started', 'run_heartbeat', 'run_succeeded', 'run_partial', 'run_failed', 'run_abandoned')"
_FAIL = "('run_failed', 'run_abandoned', 'run_partial', 'stage_failed', 'source_failed')"
_TERM = "('run_succeeded', 'run_partial', 'run_failed', 'run_abandoned')"
_LEASED = "('run_started', 'run_heartbeat')"
_WARN = "('source_zero_yield', 'source_selector_failure', 'source_parse_failure', 'source_fetch_failure', 'source_stale')"
_RULES = {
    "scope_run": f"event_type IN {_RUN} AND (stage IS NOT NULL OR source IS NOT NULL)",
    "scope_stage": "event_type IN ('stage_started', 'stage_succeeded', 'stage_failed') AND (stage IS NULL OR source IS NOT NULL)",
    "scope_source": "event_type LIKE 'source%' AND (stage IS NULL OR source IS NULL)",
    "reason_missing": f"event_type IN {_FAIL} AND reason_code IS NULL",
    "reason_abandoned": "event_type = 'run_abandoned' AND reason_code <> 'lease_expired'",
    "reason_not_a_warning": f"event_type = 'source_succeeded' AND reason_code IS NOT NULL AND reason_code NOT IN {_WARN}",
    "reason_unexpected": f"event_type NOT IN {_FAIL} AND event_type <> 'source_succeeded' AND reason_code IS NOT NULL",
    "counters_missing": "event_type IN ('source_succeeded', 'source_failed') AND (input_count IS NULL OR output_count IS NULL OR error_count IS NULL)",
    "zero_yield_without_warning": "event_type = 'source_succeeded' AND output_count = 0 AND reason_code IS NULL",
    "zero_yield_contradicted": "reason_code = 'source_zero_yield' AND output_count > 0",
    "lease_missing": f"event_type IN {_LEASED} AND lease_expires_at IS NULL",
    "lease_unexpected": f"event_type NOT IN {_LEASED} AND lease_expires_at IS NOT NULL",
    "lease_in_the_past": "lease_expires_at <= occurred_at",
}


@register("b02a_event_violations", f"WITH {_SQL}, v AS (" + " UNION ALL ".join(f"SELECT id, '{n}' AS rule FROM e WHERE {t}" for n, t in _RULES.items()) + ") SELECT id, rule FROM v")
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_events(spark, sf_dir).select("id", F.explode(ledger.violations()).alias("rule"))


_APPEND_SQL = (
    f"""WITH {_SQL}, old AS (SELECT run_id || ':' || event_type AS k, event_type || coalesce(source, '') || (id % 2) AS c FROM e WHERE hour(occurred_at) < 12 QUALIFY row_number() OVER (PARTITION BY k ORDER BY id) = 1),
        new AS (SELECT DISTINCT run_id || ':' || event_type AS k, event_type || coalesce(source, '') || (id % 2) AS c FROM e WHERE hour(occurred_at) >= 12),
        bad AS (SELECT new.k FROM new JOIN old ON new.k = old.k AND new.c <> old.c UNION SELECT k FROM new GROUP BY k HAVING count(*) > 1)
        SELECT k AS event_key, 'new' AS outcome FROM new WHERE k NOT IN (SELECT k FROM old) AND k NOT IN (SELECT k FROM bad) UNION ALL SELECT k, 'conflict' FROM bad"""
)


def _appended(spark: SparkSession, sf_dir: str, stored: str, arriving: str) -> DataFrame:
    """What becomes of the arriving events' keys beside those stored."""
    e = ledger_events(spark, sf_dir)
    rows = e.select("id", "occurred_at", F.concat("run_id", F.lit(":"), "event_type").alias("event_key"), F.concat("event_type", F.coalesce("source", F.lit("")), F.col("id") % 2).alias("content"))
    old = rows.where(stored).groupBy("event_key").agg(F.min_by("content", "id").alias("content"))
    new, bad = ledger.append(old, rows.where(arriving).drop("id", "occurred_at"), ["content"])
    return new.select("event_key", F.lit("new").alias("outcome")).unionByName(bad.select("event_key", F.lit("conflict").alias("outcome")))


#: Runs are of one day, so the day's first half is stored and the second arrives; each event is in one of both.
@register("b01_idempotent_append_all", _APPEND_SQL)
def idempotent_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _appended(spark, sf_dir, "hour(occurred_at) < 12", "hour(occurred_at) >= 12")


@register(
    "b03_w08_run_health",
    f"""WITH {_SQL}, l AS (SELECT run_id, lease_expires_at FROM e WHERE event_type IN {_LEASED} QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY occurred_at DESC, id DESC) = 1),
        t AS (SELECT run_id, event_type, occurred_at FROM e WHERE event_type IN {_TERM} QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY occurred_at DESC, id DESC) = 1),
        a AS (SELECT run_id, min(occurred_at) FILTER (WHERE event_type = 'run_started') AS s, arg_max(event_type, (occurred_at, id)) AS last_kind, max(occurred_at) AS m, count(*) FILTER (WHERE event_type IN ('stage_failed', 'source_failed')) AS f, count(*) FILTER (WHERE event_type = 'source_succeeded' AND reason_code IS NOT NULL) AS w FROM e GROUP BY run_id)
        SELECT a.run_id, last_kind, CASE WHEN t.run_id IS NULL AND lease_expires_at <= {_NOW} THEN 'overdue' WHEN t.run_id IS NULL THEN 'running' WHEN t.event_type IN ('run_failed', 'run_abandoned') THEN 'failed' WHEN t.event_type = 'run_partial' OR f > 0 THEN 'partial' WHEN w > 0 THEN 'degraded' ELSE 'healthy' END AS status,
          CASE WHEN s IS NULL THEN 0 ELSE greatest(0, datesub('second', s, coalesce(t.occurred_at, m))) END AS seconds FROM a LEFT JOIN l USING (run_id) LEFT JOIN t USING (run_id)""",
)
def run_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.run_health(ledger_events(spark, sf_dir), F.lit("2024-01-25").cast("timestamp_ntz")).drop("started_at")


@register(
    "b03b_b05_source_health",
    f"""WITH {_SQL}, s AS (SELECT * FROM e WHERE event_type IN ('source_succeeded', 'source_failed') QUALIFY row_number() OVER (PARTITION BY run_id, stage, source ORDER BY occurred_at DESC, id DESC) = 1),
        r AS (SELECT *, coalesce(reason_code, CASE WHEN output_count = 0 THEN 'source_zero_yield' END, CASE WHEN error_count > 0 THEN 'source_fetch_failure' END) AS reason FROM s)
        SELECT run_id, stage, source, CASE WHEN event_type = 'source_failed' THEN 'failed' WHEN reason IS NOT NULL THEN 'degraded' ELSE 'healthy' END AS status, reason FROM r""",
)
def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.source_health(ledger_events(spark, sf_dir))


@register(
    "b04_expired_runs",
    f"""WITH {_SQL}, l AS (SELECT run_id, lease_expires_at FROM e WHERE event_type IN {_LEASED} QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY occurred_at DESC, id DESC) = 1)
        SELECT run_id, 'run_abandoned' AS event_type, 'lease_expired' AS reason_code, run_id || ':abandoned' AS event_key FROM l WHERE lease_expires_at <= {_NOW} AND run_id NOT IN (SELECT run_id FROM e WHERE event_type IN {_TERM})""",
)
def expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.expired(ledger_events(spark, sf_dir), F.lit("2024-01-25").cast("timestamp_ntz"))


@register(
    "b02_transitions",
    f"""WITH {_SQL}, x AS (SELECT id, event_type, coalesce(max((event_type = 'run_started')::INT) OVER w, 0) AS s, coalesce(max((event_type IN {_TERM})::INT) OVER w, 0) AS t FROM e WINDOW w AS (PARTITION BY run_id ORDER BY occurred_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT id, CASE WHEN t = 1 THEN 'after_end' WHEN s = 1 AND event_type = 'run_started' THEN 'second_start' ELSE 'before_start' END AS problem FROM x WHERE t = 1 OR (s = 1 AND event_type = 'run_started') OR (s = 0 AND event_type <> 'run_started')""",
)
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.out_of_order(ledger_events(spark, sf_dir))


@register(
    "b05_b07_reasons_and_fatal_runs",
    f"""WITH {_SQL}, s AS (SELECT run_id, CASE WHEN error_count > 1 THEN 'source_parse_failure' WHEN error_count > 0 THEN 'source_selector_failure' WHEN input_count = 6 THEN 'source_fetch_failure' WHEN output_count = 0 THEN 'source_zero_yield' END AS reason, output_count FROM e WHERE event_type LIKE 'source%')
        SELECT run_id, count(reason) AS n_reasons, count(*) FILTER (WHERE reason = 'source_zero_yield') AS n_zero, bool_and(output_count = 0) AS fatal FROM s GROUP BY run_id""",
)
def reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ledger_events(spark, sf_dir).where("event_type like 'source%'")
    reason = ledger.reason_of_counts(F.coalesce(F.col("error_count"), F.lit(0)) - 1, F.coalesce("error_count", F.lit(0)), (F.col("input_count") == 6).cast("int"), F.col("output_count"))
    return e.withColumn("reason", reason).groupBy("run_id").agg(F.count("reason").alias("n_reasons"), F.count_if(F.col("reason") == "source_zero_yield").alias("n_zero"), F.bool_and(F.col("output_count") == 0).alias("fatal"))
