"""The event ledger: validation, idempotent append, health projection, expired runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed: kinds of events by scope, and codes that go with them.
RUN_EVENTS = ("run_started", "run_heartbeat", "run_succeeded", "run_partial", "run_failed", "run_abandoned")
TERMINAL = ("run_succeeded", "run_partial", "run_failed", "run_abandoned")
STAGE_EVENTS = ("stage_started", "stage_succeeded", "stage_failed")
SOURCE_EVENTS = ("source_started", "source_succeeded", "source_failed")
FAILURES = ("run_failed", "run_abandoned", "run_partial", "stage_failed", "source_failed")
WARNINGS = ("source_zero_yield", "source_selector_failure", "source_parse_failure", "source_fetch_failure", "source_stale")


def violations() -> Column:
    """Names of the row-local rules that an event breaks."""
    c = F.col
    kind, terminal_source = c("event_type"), c("event_type").isin("source_succeeded", "source_failed")
    has = lambda x: c(x).isNotNull()
    rules = {
        "scope_run": kind.isin(*RUN_EVENTS) & (has("stage") | has("source")),
        "scope_stage": kind.isin(*STAGE_EVENTS) & (~has("stage") | has("source")),
        "scope_source": kind.isin(*SOURCE_EVENTS) & ~(has("stage") & has("source")),
        "reason_missing": kind.isin(*FAILURES) & ~has("reason_code"),
        "reason_abandoned": (kind == "run_abandoned") & (c("reason_code") != "lease_expired"),
        "reason_not_a_warning": (kind == "source_succeeded") & has("reason_code") & ~c("reason_code").isin(*WARNINGS),
        "reason_unexpected": ~kind.isin(*FAILURES, "source_succeeded") & has("reason_code"),
        "counters_missing": terminal_source & ~(has("input_count") & has("output_count") & has("error_count")),
        "zero_yield_without_warning": (kind == "source_succeeded") & (c("output_count") == 0) & ~has("reason_code"),
        "zero_yield_contradicted": (c("reason_code") == "source_zero_yield") & (c("output_count") > 0),
        "lease_missing": kind.isin("run_started", "run_heartbeat") & ~has("lease_expires_at"),
        "lease_unexpected": ~kind.isin("run_started", "run_heartbeat") & has("lease_expires_at"),
        "lease_in_the_past": c("lease_expires_at") <= c("occurred_at"),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]))


def append(existing: DataFrame, rows: DataFrame, content: list[str]) -> tuple[DataFrame, DataFrame]:
    """(new rows, conflicts): a key again with its content is no event; with other content a conflict."""
    digest = F.sha2(F.to_json(F.struct(*content)), 256)
    old = existing.select("event_key", digest.alias("_old"))
    rows = rows.withColumn("_new", digest).dropDuplicates(["event_key", "_new"])
    met = rows.join(old, "event_key", "left")
    twice = met.groupBy("event_key").agg(F.count("*").alias("_n")).where("_n > 1").select("event_key")
    bad = met.where("_old <> _new").select("event_key").unionByName(twice).distinct()
    return met.where("_old is null").join(bad, "event_key", "left_anti").drop("_old", "_new"), bad


def run_health(events: DataFrame, now: Column) -> DataFrame:
    """(run_id, started_at, last_kind, status, seconds): a run's state from its events."""
    order = F.struct("occurred_at", "id")
    runs = events.groupBy("run_id").agg(
        F.min(F.when(F.col("event_type") == "run_started", F.col("occurred_at"))).alias("started_at"),
        F.max(F.when(F.col("event_type").isin(*TERMINAL), F.struct("occurred_at", "id", "event_type"))).alias("terminal"),
        F.max_by("event_type", order).alias("last_kind"),
        F.max(F.when(F.col("event_type").isin("run_started", "run_heartbeat"), F.struct("occurred_at", "id", "lease_expires_at"))).alias("lease"),
        F.count_if(F.col("event_type").isin("stage_failed", "source_failed")).alias("failures"),
        F.count_if((F.col("event_type") == "source_succeeded") & F.col("reason_code").isNotNull()).alias("warnings"),
        F.max("occurred_at").alias("last_at"),
    )
    status = (
        F.when(F.col("terminal").isNull() & (F.col("lease.lease_expires_at") <= now), "overdue")
        .when(F.col("terminal").isNull(), "running")
        .when(F.col("terminal.event_type").isin("run_failed", "run_abandoned"), "failed")
        .when((F.col("terminal.event_type") == "run_partial") | (F.col("failures") > 0), "partial")
        .when(F.col("warnings") > 0, "degraded")
        .otherwise("healthy")
    )
    end = F.coalesce("terminal.occurred_at", "last_at")
    return runs.select("run_id", "started_at", "last_kind", status.alias("status"), F.greatest(F.lit(0).cast("long"), F.timestamp_diff("SECOND", F.col("started_at"), end)).alias("seconds"))


def source_health(events: DataFrame) -> DataFrame:
    """(run_id, stage, source, status, reason): explicit code, zero yield, error, else healthy."""
    last = events.where(F.col("event_type").isin("source_succeeded", "source_failed")).groupBy("run_id", "stage", "source").agg(F.max(F.struct("occurred_at", "id", "event_type", "reason_code", "output_count", "error_count")).alias("x")).select("run_id", "stage", "source", "x.*")
    reason = F.coalesce("reason_code", F.when(F.col("output_count") == 0, "source_zero_yield"), F.when(F.col("error_count") > 0, "source_fetch_failure"))
    return last.select("run_id", "stage", "source", F.when(F.col("event_type") == "source_failed", "failed").when(reason.isNotNull(), "degraded").otherwise("healthy").alias("status"), reason.alias("reason"))


def expired(events: DataFrame, now: Column) -> DataFrame:
    """run_abandoned events for runs whose latest lease has passed and that have no terminal event."""
    leases = events.where(F.col("event_type").isin("run_started", "run_heartbeat")).groupBy("run_id").agg(F.max(F.struct("occurred_at", "id", "lease_expires_at")).alias("x"))
    done = events.where(F.col("event_type").isin(*TERMINAL)).select("run_id")
    out = leases.where(F.col("x.lease_expires_at") <= now).join(done, "run_id", "left_anti")
    return out.select("run_id", F.lit("run_abandoned").alias("event_type"), F.lit("lease_expired").alias("reason_code"), F.concat("run_id", F.lit(":abandoned")).alias("event_key"))


def out_of_order(events: DataFrame) -> DataFrame:
    """(id, problem): before the start, second start, after the end."""
    w = Window.partitionBy("run_id").orderBy("occurred_at", "id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    started = F.coalesce(F.max((F.col("event_type") == "run_started").cast("int")).over(before), F.lit(0))
    ended = F.coalesce(F.max(F.col("event_type").isin(*TERMINAL).cast("int")).over(before), F.lit(0))
    problem = F.when(ended == 1, "after_end").when((started == 1) & (F.col("event_type") == "run_started"), "second_start").when((started == 0) & (F.col("event_type") != "run_started"), "before_start")
    return events.select("id", problem.alias("problem")).where("problem is not null")


def reason_of_counts(parse: Column, selector: Column, fetch: Column, output: Column) -> Column:
    return F.when(parse > 0, "source_parse_failure").when(selector > 0, "source_selector_failure").when(fetch > 0, "source_fetch_failure").when(output == 0, "source_zero_yield")
