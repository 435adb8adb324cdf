"""From alerts to remediation: diagnosis, strategy selection, retries, quarantine, backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: fixed values: known alert types and their strategies; keywords in the order they are tried
KNOWN = {"upstream_timeout": "auto_retry", "schema_violation": "quarantine", "data_gap": "backfill", "freshness_breach": "backfill"}
KEYWORDS = {"timeout": "auto_retry", "schema": "quarantine", "gap": "backfill", "freshness": "backfill"}
EXACT, KEYWORD, UNKNOWN = 0.8, 0.6, 0.3
LEAST_CONFIDENCE, MOST_FAILURES, WINDOW_HOURS = 0.5, 3, 24
FALLBACK = "escalate"


def normal_type(column: Column) -> Column:
    """Lower case, without white space of any kind at the ends."""
    return F.regexp_replace(F.lower(column), r"^\s+|\s+$", "")


def diagnose(alerts: DataFrame) -> DataFrame:
    """alerts with root_cause, suggested_strategy and confidence; exact types before keywords, else escalation."""
    t = normal_type(F.col("anomaly_type"))
    strategy, sure = F.lit(FALLBACK), F.lit(UNKNOWN)
    for word, s in reversed(KEYWORDS.items()):
        strategy, sure = F.when(t.contains(word), F.lit(s)).otherwise(strategy), F.when(t.contains(word), F.lit(KEYWORD)).otherwise(sure)
    for name, s in KNOWN.items():
        strategy, sure = F.when(t == name, F.lit(s)).otherwise(strategy), F.when(t == name, F.lit(EXACT)).otherwise(sure)
    cause = F.when(t.isin(list(KNOWN)), t).otherwise(F.concat(F.lit("unknown:"), t))
    return alerts.withColumns({"root_cause": cause, "suggested_strategy": strategy, "confidence": sure})


def recent_failures(diagnoses: DataFrame, history: DataFrame, as_of: Column) -> DataFrame:
    """alert_id, failures: failed runs of the suggested strategy since 24 hours before ``as_of`` whose details name the cause.

    The strategy is the join's key; time and text are tested on its matches. A null in ``details`` names no cause.
    """
    bad = history.where(~F.col("success") & (F.col("started_at") >= as_of - F.make_interval(hours=F.lit(WINDOW_HOURS)))).select(F.col("strategy").alias("suggested_strategy"), "details")
    met = diagnoses.select("alert_id", "suggested_strategy", "root_cause").join(bad, "suggested_strategy").where(F.col("details").contains(F.col("root_cause")))
    return met.groupBy("alert_id").agg(F.count(F.lit(1)).alias("failures"))


def select_strategy(diagnoses: DataFrame, history: DataFrame, as_of: Column) -> DataFrame:
    """diagnoses with ``strategy``: escalation when unsure or after three recent failures, else what was suggested."""
    out = diagnoses.join(recent_failures(diagnoses, history, as_of), "alert_id", "left").fillna(0, ["failures"])
    give_up = (F.col("confidence") < LEAST_CONFIDENCE) | (F.col("failures") >= MOST_FAILURES)
    return out.withColumn("strategy", F.when(give_up, F.lit(FALLBACK)).otherwise(F.col("suggested_strategy")))


def selection_log(selected: DataFrame, at: Column) -> DataFrame:
    return selected.select("alert_id", "root_cause", "confidence", "strategy", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("selected_at"))


def retry_delays(policies: DataFrame) -> DataFrame:
    """Ours: attempt and delay of each retry: min(base * multiplier^k, longest). policies: base, multiplier, longest, retries."""
    k = F.explode(F.sequence(F.lit(0), F.col("retries") - 1)).alias("attempt")
    return policies.where("retries >= 1").select("*", k).withColumn("delay", F.least(F.col("base") * F.pow(F.col("multiplier"), F.col("attempt")), F.col("longest")))


def quarantine(df: DataFrame, good: Column, reason: str) -> tuple[DataFrame, DataFrame]:
    """Ours: rows that pass, and the rest with the reason. A check that gives null doesn't pass."""
    passes = F.coalesce(good, F.lit(False))
    return df.where(passes), df.where(~passes).withColumn("quarantine_reason", F.lit(reason))


def missing_days(df: DataFrame, ts: str, first: Column, last: Column) -> DataFrame:
    """Ours: days from first to last without a row, the jobs of a backfill."""
    days = df.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("day"))
    return days.join(df.select(F.to_date(ts).alias("day")).distinct(), "day", "left_anti")


def _id(*parts: Column) -> Column:
    """A repeatable id of what a row is about."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def quarantine_receipt(bad: DataFrame, dataset: str, at: Column, reprocessable: bool = True) -> DataFrame:
    """Ours: a receipt for each reason among quarantined rows: how many, when, and whether they may be processed again."""
    n = bad.groupBy(F.col("quarantine_reason").alias("reason")).agg(F.count(F.lit(1)).alias("record_count"))
    return n.select(_id(F.lit(dataset), F.col("reason"), at).alias("quarantine_id"), F.lit(dataset).alias("dataset"), "record_count", "reason", at.alias("quarantined_at"), F.lit(reprocessable).alias("reprocessable"))


def backfill_jobs(days: DataFrame, dataset: str, triggered_by: str, reason: str) -> DataFrame:
    """Ours: pending jobs, one for each run of successive missing days (day), from the first day up to the day after the last."""
    island = F.date_sub("day", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("day")))
    runs = days.select("day", island.alias("i")).groupBy("i").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    return runs.select(
        _id(F.lit(dataset), F.col("a"), F.col("b")).alias("job_id"), F.lit(dataset).alias("dataset"), F.col("a").alias("time_range_start"), F.date_add("b", 1).alias("time_range_end"),
        F.lit(triggered_by).alias("triggered_by"), F.lit(reason).alias("reason"), F.lit("pending").alias("status"), F.lit(0).cast("long").alias("records_processed"), F.lit(0).cast("long").alias("records_failed"),
    )


def escalations(selected: DataFrame, at: Column) -> DataFrame:
    """Ours: a row for each alert whose strategy is to escalate, at the first level."""
    return selected.where(F.col("strategy") == FALLBACK).select(_id(F.col("alert_id"), at).alias("chain_id"), "alert_id", "root_cause", F.lit(1).alias("current_level"), at.alias("started_at"))


def record_result(history: DataFrame, alert_id: str, dataset: str, strategy: str, success: bool, started_at: Column, details: str, records_affected: int = 0) -> DataFrame:
    """``history`` with one result appended."""
    row = history.sparkSession.range(1).select(F.lit(alert_id).alias("alert_id"), F.lit(dataset).alias("dataset"), F.lit(strategy).alias("strategy"), F.lit(success).alias("success"), started_at.alias("started_at"), F.lit(details).alias("details"), F.lit(records_affected).cast("long").alias("records_affected"))
    return history.unionByName(row, allowMissingColumns=True)
