"""Tables behind overview pages: counts, shares, timelines, feeds, and guards on streams of agent events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def counts_with_total(df: DataFrame, column: str, label: str = "all") -> DataFrame:
    """column, count for each value and for all rows together."""
    g = df.rollup(column).agg(F.count(F.lit(1)).alias("count"), F.grouping(column).alias("_g"))
    return g.select(F.when(F.col("_g") == 1, F.lit(label)).otherwise(F.col(column)).alias(column), "count")


def score_bins(df: DataFrame, score: str = "score", bins: int = 5) -> DataFrame:
    """bin, count of scores in [0, 1]; 1 itself belongs to the last bin. Empty bins are kept."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return zero_filled(df.select(b.alias("bin")), "bin", 0, bins - 1)


def zero_filled(df: DataFrame, column: str, first: int, last: int) -> DataFrame:
    """count of each integer from first to last, zeros kept."""
    grid = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias(column))
    n = df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return grid.join(n, column, "left").fillna(0, ["count"])


def escalation_label(level: Column) -> Column:
    return F.when(level == 0, "New").when(level == 1, "Team").when(level == 2, "Manager").when(level == 3, "Executive").otherwise("Unknown")


def success_rates(df: DataFrame, by: str) -> DataFrame:
    """by, actions, succeeded, success_rate (whole percent of finished actions, 0 if none finished)."""
    good, bad = F.count_if(F.col("status") == "success"), F.count_if(F.col("status") == "failed")
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("actions"), good.alias("succeeded"), F.when(good + bad > 0, F.floor(100 * good / (good + bad) + 0.5)).otherwise(0).cast("long").alias("success_rate"))


def per_day(df: DataFrame, ts: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(F.to_date(ts).alias("day"), *(by or [])).agg(F.count(F.lit(1)).alias("count"))


def last_days(df: DataFrame, ts: str, last: Column, days: int = 7) -> DataFrame:
    """day, count of the last ``days`` days up to ``last``, zeros kept."""
    grid = df.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    n = df.where((F.to_date(ts) > F.date_sub(last, days)) & (F.to_date(ts) <= last)).groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("count"))
    return grid.join(n, "day", "left").fillna(0, ["count"])


def shares(df: DataFrame, column: str) -> DataFrame:
    """column, count, share of all: pre-aggregated, so the window runs over one row a value."""
    n = df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return n.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy(F.lit(0))))


def label_search(df: DataFrame, column: str, text: str) -> DataFrame:
    return df.where(F.lower(column).contains(text.lower()))


def activity_feed(parts: dict[str, DataFrame], k: int) -> DataFrame:
    """kind, id, at of the k latest rows of several tables (each: id, at)."""
    each = [df.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "at").orderBy(F.desc("at"), "id").limit(k) for kind, df in parts.items()]
    return reduce(DataFrame.unionByName, each).orderBy(F.desc("at"), "kind", "id").limit(k)


def spikes(df: DataFrame, key: str, ts: str, value: str, window: str = "1 minute", z: float = 3.0) -> DataFrame:
    """Windows whose total lies more than z deviations above the key's mean over all its windows."""
    w = df.groupBy(key, F.window(ts, window).alias("w")).agg(F.sum(value).alias("total")).select(key, F.col("w.start").alias("start"), "total")
    own = Window.partitionBy(key)
    w = w.withColumns({"mean": F.avg("total").over(own), "sd": F.stddev_samp("total").over(own)})
    return w.where(F.col("sd") > 0).withColumn("z", (F.col("total") - F.col("mean")) / F.col("sd")).where(F.col("z") > z)


def repeated_calls(df: DataFrame, key: str, order: list[str], call: str, soft: int = 5, hard: int = 10) -> DataFrame:
    """Runs of at least ``soft`` equal calls in a row: key, call, run, verdict (soft or hard)."""
    all_, own = Window.partitionBy(key).orderBy(*order), Window.partitionBy(key, call).orderBy(*order)
    runs = df.withColumn("_g", F.row_number().over(all_) - F.row_number().over(own)).groupBy(key, call, "_g").agg(F.count(F.lit(1)).alias("run"))
    return runs.where(F.col("run") >= soft).select(key, call, "run", F.when(F.col("run") >= hard, "hard").otherwise("soft").alias("verdict"))


def growth(df: DataFrame, key: str, order: list[str], ts: str, value: str, limit: float) -> DataFrame:
    """Rows whose value grew by more than ``limit`` a second since the key's row before."""
    own = Window.partitionBy(key).orderBy(*order)
    seconds = F.timestamp_diff("MICROSECOND", F.lag(ts).over(own), F.col(ts)) / 1_000_000
    rate = F.when(seconds > 0, (F.col(value) - F.lag(value).over(own)) / seconds)
    return df.withColumn("rate", rate).where(F.col("rate") > limit)


def policy_limits(df: DataFrame, key: str, ts: str, value: str, length: str, slide: str, soft: float, hard: float, cooldown_seconds: int) -> DataFrame:
    """Sliding windows over a limit; a verdict within ``cooldown_seconds`` after the key's one before is marked quiet."""
    w = df.groupBy(key, F.window(ts, length, slide).alias("w")).agg(F.sum(value).alias("total")).where(F.col("total") > soft)
    w = w.select(key, F.col("w.end").alias("at"), "total", F.when(F.col("total") > hard, "hard").otherwise("soft").alias("verdict"))
    before = F.lag("at").over(Window.partitionBy(key).orderBy("at"))
    return w.withColumn("quiet", F.coalesce(F.timestamp_diff("SECOND", before, F.col("at")) < cooldown_seconds, F.lit(False)))
