"""Staleness against service levels, with a status that only worsens until data arrives again.

Arrivals and checks are logs with a recording order ``seq``: the last arrival is the last recorded one, even if its time is
older, and checks may look back in time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions.expressions import STATES, named, ranked

LONGEST_SLA = 2_592_000
WARNING, CRITICAL = 0.8, 0.9
MOST_CONSUMED = 2.0
SMOOTHING = 0.3


class SlaError(ValueError):
    pass


def check_sla(max_staleness_seconds: int, warning: float = WARNING, critical: float = CRITICAL) -> None:
    if not 1 <= max_staleness_seconds <= LONGEST_SLA:
        raise SlaError(f"max_staleness_seconds must be 1 to {LONGEST_SLA}")
    if not 0 < warning < critical <= 1:
        raise SlaError("thresholds must satisfy 0 < warning < critical <= 1")


def sla_violations(slas: DataFrame) -> DataFrame:
    """dataset, reason of service levels that may not be registered."""
    reason = F.when(~F.col("max_staleness_seconds").between(1, LONGEST_SLA), "max_staleness_range").when(~((F.col("warning_threshold") > 0) & (F.col("warning_threshold") < F.col("critical_threshold")) & (F.col("critical_threshold") <= 1)), "threshold_order")
    return slas.select("dataset", reason.alias("reason")).where(F.col("reason").isNotNull())


def registered(slas: DataFrame) -> DataFrame:
    """The last registration of each dataset."""
    rest = [c for c in slas.columns if c != "dataset"]
    return slas.groupBy("dataset").agg(F.max_by(F.struct(*rest), "seq").alias("s")).select("dataset", "s.*").drop("seq")


def seconds_between(a: Column, b: Column) -> Column:
    """b - a in seconds, with fractions."""
    return F.timestamp_diff("MICROSECOND", a, b) / 1_000_000


def _judged(df: DataFrame) -> DataFrame:
    """From last_updated, check_time and a service level to staleness, share and the status before enforcement."""
    top = F.col("max_staleness_seconds")
    stale = F.when(F.col("last_updated").isNull(), top.cast("double")).otherwise(F.greatest(F.lit(0.0), seconds_between(F.col("last_updated"), F.col("check_time"))))
    df = df.withColumn("staleness_seconds", stale)
    s = F.col("staleness_seconds")
    status = F.when(F.col("last_updated").isNull() | (s > F.col("critical_threshold") * top), "critical").when(s > F.col("warning_threshold") * top, "warning").otherwise("healthy")
    share = F.when(F.col("last_updated").isNull(), F.lit(MOST_CONSUMED)).otherwise(F.least(s / top, F.lit(MOST_CONSUMED)))
    return df.withColumn("sla_consumed_pct", share).withColumn("raw_status", status)


def check_freshness(arrivals: DataFrame, checks: DataFrame, slas: DataFrame) -> DataFrame:
    """Every check with its status, in the order the log was recorded (an as-of join by sequence, then a running maximum).

    A check of a dataset without a service level is an error; ``unregistered_checks`` lists them beforehand.
    """
    log = arrivals.select("dataset", "seq", F.col("at").alias("arrived"), F.lit(None).cast(dict(checks.dtypes)["at"]).alias("check_time")).unionByName(
        checks.select("dataset", "seq", F.lit(None).cast(dict(arrivals.dtypes)["at"]).alias("arrived"), F.col("at").alias("check_time"))
    )
    so_far = Window.partitionBy("dataset").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    log = log.withColumns({"last_updated": F.last("arrived", ignorenulls=True).over(so_far), "epoch": F.count("arrived").over(so_far)})
    met = log.where(F.col("check_time").isNotNull()).join(slas, "dataset", "left")
    known = F.when(F.col("max_staleness_seconds").isNull(), F.raise_error(F.concat(F.lit("no service level is registered for "), F.col("dataset"))).cast("int")).otherwise(F.col("max_staleness_seconds"))
    found = _judged(met.withColumn("max_staleness_seconds", known))
    since = Window.partitionBy("dataset", "epoch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    worst = F.max(ranked(F.col("raw_status"), STATES)).over(since)
    return found.select("dataset", "seq", "check_time", "last_updated", "staleness_seconds", "sla_consumed_pct", named(worst, STATES).alias("status"))


def unregistered_checks(checks: DataFrame, slas: DataFrame) -> DataFrame:
    """(dataset, checks, error): datasets that are checked without a service level."""
    n = checks.groupBy("dataset").agg(F.count(F.lit(1)).alias("checks")).join(slas, "dataset", "left_anti")
    return n.withColumn("error", F.concat(F.lit("no service level is registered for "), F.col("dataset")))


def current_status(arrivals: DataFrame, checks: DataFrame, slas: DataFrame, as_of: Column) -> DataFrame:
    """One check of every registered dataset at one time, after the logs given: a status earlier checks left doesn't improve."""
    last = arrivals.select("dataset", "seq").unionByName(checks.select("dataset", "seq")).groupBy("dataset").agg(F.max("seq").alias("seq"))
    now = slas.select("dataset").join(last, "dataset", "left").select("dataset", (F.coalesce("seq", F.lit(0)) + 1).alias("seq"), as_of.alias("at"))
    logs = [x.select("dataset", "seq", "at").join(slas, "dataset", "left_semi") for x in (arrivals, checks)]
    done = check_freshness(logs[0], logs[1].unionByName(now), slas)
    return done.join(now.select("dataset", "seq"), ["dataset", "seq"], "left_semi").drop("seq")


def check_history(checked: DataFrame, dataset: str) -> DataFrame:
    """A dataset's recorded checks in the order they were made, whatever time they looked at."""
    return checked.where(F.col("dataset") == dataset).orderBy("seq")


def staleness_over_time(arrivals: DataFrame, slas: DataFrame, first: Column, last: Column, step: Column) -> DataFrame:
    """(dataset, at, staleness_seconds, sla_consumed_pct, warning_line, breach_line) on a time grid, both ends included.

    Each point sees the arrivals up to it; the lines are where a warning and a breach begin, as shares of the service level.
    """
    grid = slas.select("dataset", F.explode(F.sequence(first, last, step)).alias("at"))
    log = grid.withColumn("arrived", F.lit(None).cast(dict(grid.dtypes)["at"])).unionByName(arrivals.select("dataset", "at", F.col("at").alias("arrived")).join(slas, "dataset", "left_semi"))
    upto = Window.partitionBy("dataset").orderBy("at", F.col("arrived").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = log.withColumn("last_updated", F.max("arrived").over(upto)).where(F.col("arrived").isNull()).withColumnRenamed("at", "check_time")
    found = _judged(seen.join(slas, "dataset"))
    return found.select("dataset", F.col("check_time").alias("at"), "staleness_seconds", "sla_consumed_pct", F.col("warning_threshold").alias("warning_line"), F.lit(1.0).alias("breach_line"))


def suppressed_by_maintenance(statuses: DataFrame, windows: DataFrame) -> DataFrame:
    """Ours: statuses whose check lies in no maintenance window [starts, ends) of the dataset."""
    w = windows.withColumnRenamed("dataset", "_d")
    return statuses.join(w, (F.col("dataset") == F.col("_d")) & (F.col("check_time") >= F.col("starts")) & (F.col("check_time") < F.col("ends")), "left_anti")


def predicted_arrival(arrivals: DataFrame, alpha: float = SMOOTHING) -> DataFrame:
    """Ours: the next arrival by exponential smoothing of the gaps between arrivals.

    The smoothed gap is a weighted sum over the gaps' ranks from the newest, so it is an aggregate, not a loop.
    """
    order = Window.partitionBy("dataset").orderBy("seq")
    gaps = arrivals.withColumn("gap", seconds_between(F.lag("at").over(order), F.col("at"))).withColumn("back", F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("seq"))) - 1)
    gaps = gaps.withColumn("n", F.count("gap").over(Window.partitionBy("dataset")))
    weight = F.when(F.col("back") == F.col("n") - 1, F.pow(F.lit(1 - alpha), F.col("back"))).otherwise(alpha * F.pow(F.lit(1 - alpha), F.col("back")))
    return gaps.groupBy("dataset").agg(F.max_by("at", "seq").alias("last_arrival"), F.sum(F.when(F.col("gap").isNotNull(), weight * F.col("gap"))).alias("smoothed_gap_seconds"))
