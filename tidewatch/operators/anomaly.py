"""Distribution shift against a rolling baseline: Kolmogorov-Smirnov and Kullback-Leibler on histograms.

Histograms are rows (dataset, column_name, profile, position, lower, upper, count). Counts weigh the midpoints; nothing is expanded.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions.expressions import kolmogorov_tail

KS_THRESHOLD, KL_THRESHOLD = 0.15, 0.5
LEAST_PROFILES, FULL_CONFIDENCE, WINDOW_DAYS = 7, 30, 30
P_VALUE = 0.05
EPSILON = 1e-10
EXACT_UP_TO = 10_000  # points of the larger side up to which a p-value is counted, not approximated
KEY = ["dataset", "column_name"]


def midpoint() -> Column:
    return (F.col("lower") + F.col("upper")) / 2


def baseline_window(profiles: DataFrame, as_of: Column, days: int = WINDOW_DAYS) -> DataFrame:
    """Profiles kept by an update at ``as_of``; one exactly ``days`` old stays."""
    return profiles.where(F.col("profiled_at") >= as_of - F.make_interval(days=F.lit(days)))


def enough_profiles(baseline: DataFrame, least: int = LEAST_PROFILES) -> DataFrame:
    """dataset, profiles: datasets whose baseline has enough profiles."""
    return baseline.groupBy("dataset").agg(F.count_distinct("profile").alias("profiles")).where(F.col("profiles") >= least)


def exact_p_value(d: float, n1: int, n2: int) -> float:
    """The share of all interleavings of n1 and n2 points whose two-sample statistic is d or more.

    An interleaving is a lattice path; the mass of those that stay within the statistic is carried along the diagonals.
    """
    if n1 < 1 or n2 < 1:
        return 1.0
    most = int(round(d * n1 * n2))  # a path is out where |i * n2 - j * n1| reaches it
    if most <= 0:
        return 1.0
    mass, out = np.zeros(n1 + 1), 0.0
    mass[0] = 1.0
    i = np.arange(n1 + 1)
    for k in range(1, n1 + n2 + 1):
        low, high = max(0, k - n2), min(n1, k)
        # of all paths through (i, k - i), the share that comes from (i - 1, k - i), and from (i, k - i - 1)
        left = n1 + n2 - k + 1
        right = np.clip((n1 - i) / left, 0, 1)
        step = mass * (1 - right)
        step[1:] += (mass * right)[:-1]
        mass = np.zeros(n1 + 1)
        own = i[low : high + 1]
        inside = np.abs(own * n2 - (k - own) * n1) < most
        mass[own[inside]] = step[own[inside]]
        out += float(step[own[~inside]].sum())
    return min(1.0, out)


def ks_p_value(d: Column, n1: Column, n2: Column, exact_up_to: int = EXACT_UP_TO) -> Column:
    """Counted exactly for sides of up to ``exact_up_to`` points, by Kolmogorov's series above. One value a column, so few rows."""
    if exact_up_to <= 0:
        return kolmogorov_tail(d, n1, n2)

    @F.pandas_udf("double")
    def exact(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
        return pd.Series([exact_p_value(x, int(a), int(b)) if x == x and max(a, b) <= exact_up_to else None for x, a, b in zip(d, n1, n2, strict=True)], dtype="float64")

    return F.coalesce(exact(d, n1, n2), kolmogorov_tail(d, n1, n2))


def baseline_key(namespace: Column, version: Column) -> Column:
    return F.format_string("%s:v%d", namespace, version.cast("long"))


def update_baseline(baseline: DataFrame, new: DataFrame, as_of: Column, days: int = WINDOW_DAYS) -> DataFrame:
    """``baseline`` with the profiles of ``new`` appended, then what is older than ``days`` dropped from the datasets of ``new`` alone."""
    touched = new.select(F.col("dataset").alias("_t")).distinct()
    both = baseline.unionByName(new).join(touched, F.col("dataset") == F.col("_t"), "left")
    return both.where(F.col("_t").isNull() | (F.col("profiled_at") >= as_of - F.make_interval(days=F.lit(days)))).drop("_t")


def get_baseline(baseline: DataFrame, dataset: str) -> DataFrame:
    """The profiles kept for a dataset, oldest first; none if it has none."""
    return baseline.where(F.col("dataset") == dataset).orderBy("profiled_at")


def unusable(histograms: DataFrame) -> DataFrame:
    """(dataset, column_name, profile, reason): histograms no test can take. The tests leave them out and go on with the rest."""
    bad = F.max(F.when(F.col("count") < 0, "negative count").when(F.col("count").isNull(), "missing count").when(~_finite("lower") | ~_finite("upper"), "bounds that are no numbers"))
    return histograms.groupBy(*KEY, "profile").agg(bad.alias("reason")).where(F.col("reason").isNotNull())


def _finite(column: str) -> Column:
    x = F.col(column)
    return F.coalesce((x == x) & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def usable(histograms: DataFrame) -> DataFrame:
    """``histograms`` without the unusable ones. A small table: a row a bin."""
    return histograms.join(unusable(histograms), [*KEY, "profile"], "left_anti")


def ks_statistic(current: DataFrame, baseline: DataFrame, exact_up_to: int = EXACT_UP_TO) -> DataFrame:
    """dataset, column_name, n_current, n_baseline, d, p_value; the baseline's profiles are pooled by their counts."""
    side = lambda df, a, b: df.select(*KEY, midpoint().alias("x"), (F.col("count") * a).alias("c"), (F.col("count") * b).alias("b"))
    points = side(current, 1, 0).unionByName(side(baseline, 0, 1)).groupBy(*KEY, "x").agg(F.sum("c").alias("c"), F.sum("b").alias("b"))
    whole = Window.partitionBy(*KEY)
    up_to = whole.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    cdf = points.select(*KEY, F.sum("c").over(up_to).alias("c"), F.sum("b").over(up_to).alias("b"), F.sum("c").over(whole).alias("n_c"), F.sum("b").over(whole).alias("n_b"))
    d = cdf.where((F.col("n_c") >= 2) & (F.col("n_b") >= 2)).groupBy(*KEY).agg(F.max("n_c").alias("n_current"), F.max("n_b").alias("n_baseline"), F.max(F.abs(F.col("c") / F.col("n_c") - F.col("b") / F.col("n_b"))).alias("d"))
    return d.withColumn("p_value", ks_p_value(F.col("d"), F.col("n_current"), F.col("n_baseline"), exact_up_to))


def kl_divergence(current: DataFrame, baseline: DataFrame, aligned: bool = False) -> DataFrame:
    """dataset, column_name, profile, kl of the current histogram against each profile.

    Bins pair by position, whatever their bounds, the shorter side padded with zeros; with ``aligned`` they pair by the
    lower bound instead, which also sees a shift of location.
    """
    place = "lower" if aligned else "position"
    c = current.select(*KEY, F.col(place).alias("k"), F.col("count").alias("c"))
    b = baseline.select(*KEY, "profile", F.col(place).alias("k"), F.col("count").alias("b"))
    profiles = b.select(*KEY, "profile").distinct()
    both = c.join(profiles, KEY).join(b, [*KEY, "profile", "k"], "full").join(c.select(*KEY).distinct(), KEY, "left_semi")
    both = both.select(*KEY, "profile", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("b", F.lit(0)).alias("b"))
    own = Window.partitionBy(*KEY, "profile")
    both = both.withColumns({"nc": F.sum("c").over(own), "nb": F.sum("b").over(own), "m": F.count(F.lit(1)).over(own)}).where("nc > 0 AND nb > 0")
    p, q = (F.col("c") / F.col("nc") + EPSILON) / (1 + F.col("m") * EPSILON), (F.col("b") / F.col("nb") + EPSILON) / (1 + F.col("m") * EPSILON)
    return both.groupBy(*KEY, "profile").agg(F.greatest(F.lit(0.0), F.sum(p * F.log(p / q))).alias("kl"))


def with_threshold(stats: DataFrame, thresholds: DataFrame | None, name: str, default: float) -> DataFrame:
    """Adds ``threshold``: the column's own where one is set, else the default. thresholds: dataset, column_name, ks_threshold, kl_threshold."""
    if thresholds is None:
        return stats.withColumn("threshold", F.lit(default))
    own = thresholds.select(*KEY, F.col(name).cast("double").alias("_t"))
    return stats.join(own, KEY, "left").withColumn("threshold", F.coalesce("_t", F.lit(default))).drop("_t")


def set_threshold(thresholds: DataFrame, dataset: str, column: str, ks: float | None = None, kl: float | None = None) -> DataFrame:
    """The table with one column's thresholds set; an argument that is None leaves the old value."""
    spark = thresholds.sparkSession
    new = spark.createDataFrame([(dataset, column, ks, kl)], "dataset string, column_name string, new_ks double, new_kl double")
    return thresholds.join(new, KEY, "full").select(*KEY, F.coalesce("new_ks", "ks_threshold").alias("ks_threshold"), F.coalesce("new_kl", "kl_threshold").alias("kl_threshold"))


def score(stat: Column, threshold: Column) -> Column:
    return F.when(threshold <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), stat / threshold)))


def confidence(profiles: Column) -> Column:
    return F.when(profiles <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), profiles / FULL_CONFIDENCE))


def severity(score_: Column) -> Column:
    return F.when(score_ >= 0.8, "critical").when(score_ >= 0.5, "warning").otherwise("info")


def _events(hits: DataFrame, algorithm: str, metric: str, word: str, at: Column) -> DataFrame:
    s, t, p = F.col("stat"), F.col("threshold"), F.col("p_value")
    own = score(s, t)
    said = F.concat(F.lit("column '"), F.col("column_name"), F.lit(f"': {word} "), F.format_string("%.4f", s), F.lit(" exceeds threshold "), F.format_string("%.4f", t))
    facts = {"algorithm": F.lit(algorithm), metric: s.cast("string"), "p_value": p.cast("string"), "adaptive_threshold": t.cast("string"), "anomaly_score": own.cast("string")}
    context = F.map_filter(F.create_map(*[x for k, v in facts.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    return hits.select(
        F.md5(F.concat_ws("|", *KEY, F.lit(algorithm), at.cast("string"))).alias("anomaly_id"), *KEY, F.lit("distribution_shift").alias("category"), severity(own).alias("severity"), at.alias("detected_at"), own.alias("score"),
        confidence(F.col("profiles")).alias("confidence"), F.lit(algorithm).alias("algorithm"), F.lit(metric).alias("metric_name"), s.alias("observed"), t.alias("expected"), F.struct(F.lit(0.0).alias("lo"), t.alias("hi")).alias("expected_range"),
        F.when(p.isNull(), said).otherwise(F.concat(said, F.lit(" (p-value "), F.format_string("%.6f", p), F.lit(")"))).alias("description"), context.alias("context"), F.try_divide(s, t).alias("raw_ratio"),
    )


def detect_anomalies(current: DataFrame, baseline: DataFrame, thresholds: DataFrame | None = None, exact_up_to: int = EXACT_UP_TO, detected_at: Column | None = None) -> DataFrame:
    """Events of all columns: at most one of each test. Datasets with too few profiles give none; columns without a baseline are skipped.

    Histograms that no test can take are left out, so a broken column doesn't keep the others from being tested.
    """
    at = F.current_timestamp() if detected_at is None else detected_at
    gate = enough_profiles(baseline)
    if "profile" not in current.columns:
        current = current.withColumn("profile", F.lit("current"))
    current, baseline = usable(current), usable(baseline)
    ks = with_threshold(ks_statistic(current, baseline, exact_up_to), thresholds, "ks_threshold", KS_THRESHOLD)
    ks = ks.join(gate, "dataset").where((F.col("d") > F.col("threshold")) & (F.col("p_value") < P_VALUE)).withColumnRenamed("d", "stat")
    kl = kl_divergence(current, baseline).groupBy(*KEY).agg(F.max("kl").alias("stat"))
    kl = with_threshold(kl, thresholds, "kl_threshold", KL_THRESHOLD).join(gate, "dataset").where(F.col("stat") > F.col("threshold")).withColumn("p_value", F.lit(None).cast("double"))
    return _events(ks, "ks_test", "ks_statistic", "Kolmogorov-Smirnov statistic", at).unionByName(_events(kl, "kl_divergence", "kl_divergence", "Kullback-Leibler divergence", at))


def adaptive_thresholds(stats: DataFrame, days: int = 7, sigmas: float = 3.0) -> DataFrame:
    """Ours: a column's threshold as mean plus ``sigmas`` deviations of its statistic on the same weekday cycle.

    stats: dataset, column_name, day date, stat. Each day is compared with the days whose distance is a multiple of ``days``.
    """
    phase = F.pmod(F.datediff("day", F.lit("1970-01-01").cast("date")), F.lit(days))
    past = Window.partitionBy(*KEY, phase).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return stats.withColumn("threshold", F.avg("stat").over(past) + sigmas * F.coalesce(F.stddev_samp("stat").over(past), F.lit(0.0)))
