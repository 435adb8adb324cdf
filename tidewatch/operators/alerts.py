"""Alerts: deduplication, suppression by lineage, escalation. (Ours: the names of the fields set the meaning.)"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MOST_LEVELS, LEVEL_TIMEOUT = 5, 300


def deduplicate(alerts: DataFrame) -> DataFrame:
    """One alert a (dataset, anomaly_type, metric_name), with how often it occurred and the first and last time."""
    return alerts.groupBy("dataset", "anomaly_type", "metric_name").agg(F.min("alert_id").alias("alert_id"), F.count(F.lit(1)).alias("occurrence_count"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))


def deduplicate_within(alerts: DataFrame, gap: str) -> DataFrame:
    """As above, a new alert after a pause of ``gap``."""
    return alerts.groupBy("dataset", "anomaly_type", "metric_name", F.session_window("created_at", gap).alias("w")).agg(F.count(F.lit(1)).alias("occurrence_count")).select("dataset", "anomaly_type", "metric_name", F.col("w.start").alias("first_seen"), "occurrence_count")


def active(alerts: DataFrame, dataset: str | None = None) -> DataFrame:
    out = alerts.where(F.col("acknowledged_at").isNull())
    return (out if dataset is None else out.where(F.col("dataset") == dataset)).orderBy(F.desc("created_at"))


def correlate(alerts: DataFrame, ancestors: DataFrame) -> DataFrame:
    """alerts with ``suppressed``: true where an ancestor of the dataset alerts too. ancestors: dataset, ancestor."""
    alerting = alerts.select(F.col("dataset").alias("ancestor")).distinct()
    hit = ancestors.where(F.col("dataset") != F.col("ancestor")).join(alerting, "ancestor", "left_semi").select("dataset").distinct().withColumn("suppressed", F.lit(True))
    return alerts.drop("suppressed").join(hit, "dataset", "left").fillna(False, ["suppressed"])


def escalation_levels(alerts: DataFrame, levels: DataFrame, as_of: Column) -> DataFrame:
    """alert_id, level: how far an unacknowledged alert has escalated. levels: level, timeout_seconds."""
    order = Window.partitionBy(F.lit(0)).orderBy("level")  # five levels at most
    reach = levels.where(F.col("level") <= MOST_LEVELS).withColumn("after", F.coalesce(F.sum("timeout_seconds").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("level", "after")
    age = F.timestamp_diff("SECOND", F.col("created_at"), as_of)
    waiting = alerts.where(F.col("acknowledged_at").isNull()).select("alert_id", age.alias("age"))
    return waiting.join(F.broadcast(reach), F.col("age") >= F.col("after"), "left").groupBy("alert_id").agg(F.max("level").alias("level"))
