"""Health of runs, stages and sources, projected from the event ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ledger import TERMINAL

#: Fixed: codes that degrade a source; any other fails it.
DEGRADING = ("source_fetch_failed", "source_selector_failed", "source_parse_failed", "source_zero_yield", "data_stale")


def _ends(events: DataFrame, by: list[str], kind: str) -> DataFrame:
    """First start and last end of each stage or source, as one row each."""
    at = F.struct("occurred_at", "id")
    own = events.where(F.col("event_type").startswith(f"{kind}_"))
    last = F.struct("occurred_at", "id", "event_type", "reason_code", "output_count", "error_count", "selector_failures", "parse_failures", "latest_article_at")
    out = own.groupBy(*by).agg(F.min(F.when(F.col("event_type") == f"{kind}_started", at)).alias("start"), F.max(F.when(F.col("event_type") != f"{kind}_started", last)).alias("end"))
    return out.where("start is not null or end is not null")


def run_ends(events: DataFrame) -> DataFrame:
    """(run_id, run_end, run_reason, lease): a run's last terminal event and its latest lease."""
    end = F.max(F.when(F.col("event_type").isin(*TERMINAL), F.struct("occurred_at", "id", "event_type", "reason_code"))).alias("end")
    lease = F.max(F.when(F.col("lease_expires_at").isNotNull(), F.struct("occurred_at", "id", "lease_expires_at"))).alias("lease")
    out = events.groupBy("run_id").agg(end, lease)
    return out.select("run_id", F.col("end.event_type").alias("run_end"), F.col("end.reason_code").alias("run_reason"), F.col("lease.lease_expires_at").alias("lease"))


def _unfinished() -> Column:
    """Status of a part that never ended, by how its run did."""
    end = F.col("run_end")
    return F.when(end.isNull(), "running").when(end == "run_abandoned", "abandoned").when(end == "run_succeeded", "partial").otherwise("failed")


def _unfinished_reason() -> Column:
    end = F.col("run_end")
    return F.when(end == "run_abandoned", "lease_expired").when(end.isNotNull(), "upstream_stage_failed")


def stage_status(events: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, stage, status, reason)."""
    s = _ends(events, ["run_id", "stage"], "stage").join(runs, "run_id")
    kind, errors = F.col("end.event_type"), F.col("end.error_count") > 0
    status = F.when(kind.isNull(), _unfinished()).when(kind == "stage_failed", "failed").when(errors, "degraded").otherwise("succeeded")
    reason = F.when(kind.isNull(), _unfinished_reason()).when(kind == "stage_failed", F.col("end.reason_code")).when(errors, "unexpected_error")
    return s.select("run_id", "stage", status.alias("status"), reason.alias("reason"))


def source_status(events: DataFrame, runs: DataFrame, now: Column, stale_after: str = "interval 2 days") -> DataFrame:
    """(run_id, stage, source, status, reason): explicit code, zero yield, selector, parse, error, stale."""
    s = _ends(events, ["run_id", "stage", "source"], "source").join(runs, "run_id")
    end = lambda c: F.col(f"end.{c}")
    warning = F.coalesce(
        end("reason_code"),
        F.when(end("output_count") == 0, "source_zero_yield"),
        F.when(end("selector_failures") > 0, "source_selector_failed"),
        F.when(end("parse_failures") > 0, "source_parse_failed"),
        F.when(end("error_count") > 0, "unexpected_error"),
        F.when(end("latest_article_at") + F.expr(stale_after) < now, "data_stale"),
    )
    kind = end("event_type")
    status = F.when(kind.isNull(), _unfinished()).when(kind == "source_failed", "failed").when(warning.isNotNull(), "degraded").otherwise("healthy")
    reason = F.when(kind.isNull(), _unfinished_reason()).when(kind == "source_failed", end("reason_code")).otherwise(warning)
    return s.select("run_id", "stage", "source", status.alias("status"), reason.alias("reason"))


def overall_status(runs: DataFrame, children: DataFrame, now: Column) -> DataFrame:
    """(run_id, status): lease and end first, else the worst of the run's stages and sources."""
    worst = children.groupBy("run_id").agg(
        F.bool_or(F.col("status").isin("failed", "abandoned")).alias("failed"), F.bool_or(F.col("status").isin("running", "partial")).alias("partial"), F.bool_or(F.col("status") == "degraded").alias("degraded")
    )
    r = runs.join(worst, "run_id", "left")
    end = F.col("run_end")
    status = (
        F.when(end.isNull() & (F.col("lease") <= now), "overdue")
        .when(end.isNull(), "running")
        .when(end == "run_failed", "failed")
        .when(end == "run_abandoned", "abandoned")
        .when(F.col("failed"), "failed")
        .when(F.col("partial"), "partial")
        .when(F.col("degraded"), "degraded")
        .otherwise("healthy")
    )
    return r.select("run_id", status.alias("status"))


def scrape_reason(reason: Column, output: Column) -> Column:
    """A scraper's own code as a closed one: none with no yield is a zero yield, a zero yield with some is an error."""
    known = reason.isin(*DEGRADING, "unexpected_error", "upstream_stage_failed", "count_invariant_failed", "lease_expired")
    return F.when(reason.isNull(), F.when(output == 0, "source_zero_yield")).when(~known | ((output > 0) & (reason == "source_zero_yield")), "unexpected_error").otherwise(reason)


def status_of(reason: Column) -> Column:
    return F.when(reason.isNull(), "success").when(reason.isin(*DEGRADING), "degraded").otherwise("failed")
