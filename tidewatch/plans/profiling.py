"""Queries on profiles, histograms, baselines and distribution shift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import anomaly, profile
from tidewatch.plans.support import at, load, query, round_scaled, rounded, values


def profile_sql(source: str, numeric: dict[str, str], text: list[str] = (), other: dict[str, str] | None = None, by: str = "") -> str:
    """Profiles in SQL. numeric: column -> declared type; other: columns with counts only."""
    parts, key, group = [], f"{by}, " if by else "", f" GROUP BY {by}" if by else ""
    counts = lambda c, t: f"{key}'{c}' AS column_name, '{t}' AS dtype, count(*) AS total_count, CAST(count(*) - count({c}) AS BIGINT) AS null_count, CAST(0 AS BIGINT) AS nan_count"
    none = ", ".join(f"CAST(NULL AS DOUBLE) AS {n}" for n in profile.NUMERIC)
    for c, t in numeric.items():
        x = f"CAST({c} AS DOUBLE)"
        spread = f"stddev_samp({x}) > 0"
        p = ", ".join(f"round(quantile_cont({x}, {q}), 4) AS {n}" for q, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.99, "p99")))
        parts.append(
            f"SELECT {counts(c, t)}, round(avg({x}), 4) AS mean, round(min({x}), 4) AS min_value, round(max({x}), 4) AS max_value, round(stddev_samp({x}), 4) AS std_dev, {p}, "
            f"round(CASE WHEN count({c}) >= 3 AND {spread} THEN skewness({x}) END, 4) AS skewness, round(CASE WHEN count({c}) >= 4 AND {spread} THEN kurtosis_pop({x}) END, 4) AS kurtosis, "
            f"CAST(NULL AS DOUBLE) AS avg_length, CAST(NULL AS BIGINT) AS max_length FROM {source}{group}"
        )
    for c in text:
        parts.append(f"SELECT {counts(c, 'string')}, {none}, round(avg(length({c})), 4) AS avg_length, CAST(max(length({c})) AS BIGINT) AS max_length FROM {source}{group}")
    for c, t in (other or {}).items():
        parts.append(f"SELECT {counts(c, t)}, {none}, CAST(NULL AS DOUBLE) AS avg_length, CAST(NULL AS BIGINT) AS max_length FROM {source}{group}")
    return "\nUNION ALL ".join(parts)


_LINE = {"l_quantity": "float", "l_extendedprice": "float", "l_discount": "float", "l_tax": "float", "l_linenumber": "integer"}


@query(profile_sql("lineitem", _LINE))
def profile_numeric_lineitem(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.column_statistics(load(spark, d, "lineitem"), list(_LINE)))


@query(profile_sql("orders", {"o_totalprice": "float", "o_custkey": "integer"}))
def profile_numeric_orders(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.column_statistics(load(spark, d, "orders"), ["o_totalprice", "o_custkey"]))


@query(profile_sql("documents", {"n_chars": "integer"}, ["text", "lang", "source"]))
def profile_string_documents(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.column_statistics(load(spark, d, "documents"), ["n_chars", "text", "lang", "source"]))


@query(profile_sql("customer", {"c_acctbal": "float"}, ["c_name", "c_mktsegment"]))
def profile_string_customer(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.column_statistics(load(spark, d, "customer"), ["c_acctbal", "c_name", "c_mktsegment"]))


@query(profile_sql("(SELECT CAST(o_totalprice AS DECIMAL(18,2)) AS dec_value, o_totalprice > 100000 AS flag, CAST(o_orderdate AS DATE) AS day, o_orderdate AS ts FROM orders)", {"dec_value": "decimal"}, [], {"flag": "boolean", "day": "date", "ts": "timestamp"}))
def profile_other_types(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select(F.col("o_totalprice").cast("decimal(18,2)").alias("dec_value"), (F.col("o_totalprice") > 100000).alias("flag"), F.to_date("o_orderdate").alias("day"), F.col("o_orderdate").alias("ts"))
    return rounded(profile.column_statistics(o))


@query(profile_sql("(SELECT CASE WHEN l_linenumber > 1 THEN l_discount END AS part, CASE WHEN l_linenumber < 0 THEN l_discount END AS void_value, CASE WHEN l_linenumber > 2 THEN l_returnflag END AS word FROM lineitem)", {"part": "float", "void_value": "float"}, ["word"]))
def profile_with_nulls(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem")
    return rounded(profile.column_statistics(li.select(F.when(F.col("l_linenumber") > 1, F.col("l_discount")).alias("part"), F.when(F.col("l_linenumber") < 0, F.col("l_discount")).alias("void_value"), F.when(F.col("l_linenumber") > 2, F.col("l_returnflag")).alias("word"))))


@query(profile_sql("(SELECT CAST(ts AS DATE) AS day, value FROM events)", {"value": "float"}, by="day"))
def profile_events_daily(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").select(F.to_date("ts").alias("day"), "value")
    return rounded(profile.column_statistics(e, ["value"], by=["day"]))


_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("\nUNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count FROM orders" for c in _ORDERS))
def distinct_exact_orders(spark: SparkSession, d: str) -> DataFrame:
    return profile.distinct_exact(load(spark, d, "orders"), _ORDERS)


@query("\nUNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count FROM lineitem" for c in _LINE))
def distinct_adaptive_lineitem(spark: SparkSession, d: str) -> DataFrame:
    return profile.distinct_counts(load(spark, d, "lineitem"), list(_LINE))


@query("\nUNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS exact, true AS within_two_percent FROM orders" for c in ("o_orderkey", "o_custkey", "o_totalprice")))
def distinct_sketch_orders(spark: SparkSession, d: str) -> DataFrame:
    o, names = load(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"]
    exact = profile.distinct_exact(o, names).withColumnRenamed("distinct_count", "exact")
    return profile.distinct_approx(o, names).join(exact, "column_name").select("column_name", "exact", (F.abs(F.col("distinct_count") - F.col("exact")) <= 0.02 * F.col("exact")).alias("within_two_percent"))


@query("SELECT 'value' AS column_name, count(DISTINCT CAST(ts AS DATE)) AS sketches, count(DISTINCT value) AS exact, true AS merged_equals_whole FROM events")
def distinct_sketch_merge(spark: SparkSession, d: str) -> DataFrame:
    """Sketches of days, joined, against the sketch of all and against the exact count."""
    e = load(spark, d, "events").withColumn("day", F.to_date("ts"))
    merged = profile.distinct_sketches(e, ["value"], ["day"]).groupBy("column_name").agg(F.count(F.lit(1)).alias("sketches"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("a"))
    whole = profile.distinct_approx(e, ["value"]).withColumnRenamed("distinct_count", "b").join(profile.distinct_exact(e, ["value"]).withColumnRenamed("distinct_count", "exact"), "column_name")
    near = (F.abs(F.col("a") - F.col("b")) <= 0.02 * F.col("b")) & (F.abs(F.col("a") - F.col("exact")) <= 0.02 * F.col("exact"))
    return merged.join(whole, "column_name").select("column_name", "sketches", "exact", near.alias("merged_equals_whole"))


def histogram_sql(source: str, x: str, n: int, by: str = "") -> str:
    """Buckets in SQL: position, lower, upper, count (and ``by``), unrounded."""
    key, on = (f"{by}, ", f"USING ({by})") if by else ("", "ON true")
    full = f"USING ({key}position)"
    return f"""
WITH v AS (SELECT {key}CAST({x} AS DOUBLE) AS x FROM {source} WHERE {x} IS NOT NULL),
s AS (SELECT {key}CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo, CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM v {f"GROUP BY {by}" if by else ""}),
i AS (SELECT {key}x, lo, hi, (hi - lo) / {n} AS step, least(floor((x - lo) / (hi - lo) * {n}), {n - 1}) AS i FROM v JOIN s {on}),
b AS (SELECT {key}CAST(CASE WHEN x < (CASE WHEN i = {n} THEN hi ELSE lo + i * step END) THEN i - 1 WHEN x >= (CASE WHEN i + 1 = {n} THEN hi ELSE lo + (i + 1) * step END) AND i < {n - 1} THEN i + 1 ELSE i END AS INT) AS position, count(*) AS n FROM i GROUP BY ALL),
g AS (SELECT {key}lo, hi, CAST(k AS INT) AS position FROM s, range({n}) AS r(k)),
hist AS (SELECT {key}position, lo + position * ((hi - lo) / {n}) AS lower, CASE WHEN position = {n - 1} THEN hi ELSE lo + (position + 1) * ((hi - lo) / {n}) END AS upper, coalesce(b.n, 0) AS count FROM g LEFT JOIN b {full})"""


_HIST = " SELECT position, round(lower, 4) AS lower, round(upper, 4) AS upper, count FROM hist"


@query(histogram_sql("lineitem", "l_extendedprice", 20) + _HIST)
def histogram_extendedprice(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.histogram(load(spark, d, "lineitem"), "l_extendedprice"))


@query(histogram_sql("lineitem", "l_discount", 20) + _HIST)
def histogram_discount(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.histogram(load(spark, d, "lineitem"), "l_discount"))


@query(histogram_sql("(SELECT 5 AS c FROM orders)", "c", 5) + _HIST)
def histogram_constant(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.histogram(load(spark, d, "orders").select(F.lit(5).alias("c")), "c", 2))


@query(histogram_sql("(SELECT CAST(ts AS DATE) AS day, value FROM events)", "value", 20, "day") + " SELECT day, position, round(lower, 4) AS lower, round(upper, 4) AS upper, count FROM hist")
def histogram_events_daily(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.histogram(load(spark, d, "events").withColumn("day", F.to_date("ts")), "value", by=["day"]))


@query("SELECT value, count, round(count / sum(count) OVER (), 4) AS share FROM (SELECT o_orderpriority AS value, count(*) AS count FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1) ORDER BY count DESC, value LIMIT 10")
def top_values_priority(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.top_values(load(spark, d, "orders"), "o_orderpriority"))


@query("SELECT 'warehouse.orders' AS dataset, 'all' AS partition_key, count(*) AS row_count FROM orders")
def dataset_row_count(spark: SparkSession, d: str) -> DataFrame:
    p = profile.column_statistics(load(spark, d, "orders")).select(F.lit("warehouse.orders").alias("dataset"), F.lit("all").alias("partition_key"), F.when(F.col("column_name") == "o_orderkey", 0).otherwise(1).alias("ordinal"), "total_count")
    return profile.row_count(p)


_HOLES = "(SELECT l_quantity AS whole, CASE WHEN l_linenumber > 2 THEN l_discount END AS part, CASE WHEN l_orderkey = 1 THEN l_tax END AS few FROM lineitem)"


@query("\nUNION ALL ".join(f"SELECT '{c}' AS column_name, CASE WHEN count({c}) = 0 THEN 0 ELSE greatest(1, CAST(floor(count({c}) * 0.3) AS BIGINT)) END AS sampled, true AS of_the_column FROM {_HOLES}" for c in ("whole", "part", "few")))
def sample_properties(spark: SparkSession, d: str) -> DataFrame:
    """How many values of each column are drawn, and whether they lie within the column's."""
    li = load(spark, d, "lineitem").select(F.col("l_quantity").alias("whole"), F.when(F.col("l_linenumber") > 2, F.col("l_discount")).alias("part"), F.when(F.col("l_orderkey") == 1, F.col("l_tax")).alias("few"))
    names = li.columns
    each = lambda df: df.agg(F.array(*[F.struct(F.lit(c).alias("column_name"), F.count(c).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi")) for c in names]).alias("s")).select(F.inline("s"))
    part, whole = each(profile.sample_columns(li, names, 0.3)), each(li).select("column_name", F.col("lo").alias("a"), F.col("hi").alias("b"))
    return part.join(whole, "column_name").select("column_name", F.col("n").alias("sampled"), F.coalesce((F.col("lo") >= F.col("a")) & (F.col("hi") <= F.col("b")), F.lit(True)).alias("of_the_column"))


_PROFILED = {"c_acctbal": "float", "c_nationkey": "integer"}


@query(f"""WITH stats AS ({profile_sql("customer", _PROFILED, ["c_mktsegment"])}),
dist AS ({" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count FROM customer" for c in [*_PROFILED, "c_mktsegment"])}),
bins AS ({" UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(20 AS BIGINT) AS bins, count({c}) AS binned, round(min({c})::DOUBLE, 4) AS first_lower, round(max({c})::DOUBLE, 4) AS last_upper FROM customer" for c in _PROFILED)})
SELECT 'warehouse.customer' AS dataset, 'all' AS partition_key, stats.*, distinct_count, bins, binned, first_lower, last_upper FROM stats JOIN dist USING (column_name) LEFT JOIN bins USING (column_name)""")
def profile_dataset_customer(spark: SparkSession, d: str) -> DataFrame:
    """The whole profile of a dataset, its histograms as their number of bins, their sum and their ends."""
    p = profile.profile_dataset(load(spark, d, "customer"), "warehouse.customer", "all", [*_PROFILED, "c_mktsegment"])
    h = F.col("histogram")
    size = F.when(h.isNotNull(), F.size(h)).cast("long")
    total = F.aggregate(h, F.lit(0).cast("long"), lambda a, b: a + b["count"])
    found = p.select("*", size.alias("bins"), total.alias("binned"), F.get(h, F.lit(0))["lower"].alias("first_lower"), F.get(h, F.lit(19))["upper"].alias("last_upper"))
    return rounded(found.drop("histogram", "profiling_duration_ms"), how=round_scaled)


@query(histogram_sql("(SELECT l_discount * 100 AS x FROM lineitem)", "x", 10).replace("WITH v", "WITH a AS (WITH v", 1) + " SELECT 'scaled' AS column_name, * FROM hist), " + histogram_sql("lineitem", "l_quantity", 10).replace("WITH v", "b AS (WITH v", 1).strip() + " SELECT 'l_quantity' AS column_name, * FROM hist) SELECT column_name, position, round(lower, 4) AS lower, round(upper, 4) AS upper, count FROM (SELECT * FROM a UNION ALL SELECT * FROM b)")
def histograms_lineitem(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").withColumn("scaled", F.col("l_discount") * 100)
    return rounded(profile.histograms(li, ["scaled", "l_quantity"], 10))


# --- shift against a baseline -----------------------------------------------------------------------------------

LAST_DAY = "2024-01-30"


def _event_histograms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Histograms of the last day and of the days before."""
    e = load(spark, d, "events").withColumn("profile", F.to_date("ts").cast("string"))
    return _days(e)


def _days(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    h = profile.histogram(e, "value", by=["profile"]).select(F.lit("events:v1").alias("dataset"), F.lit("value").alias("column_name"), "*")
    h = profile.held(h)  # a few rows a day, read several times below
    return h.where(F.col("profile") == LAST_DAY), h.where(F.col("profile") < LAST_DAY)


_EVENTS = histogram_sql("(SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS profile, value FROM events)", "value", 20, "profile") + f"""
, cur AS (SELECT * FROM hist WHERE profile = '{LAST_DAY}'), base AS (SELECT * FROM hist WHERE profile < '{LAST_DAY}'),
pts AS (SELECT x, sum(c) AS c, sum(b) AS b FROM (SELECT (lower + upper) / 2 AS x, count AS c, 0 AS b FROM cur UNION ALL SELECT (lower + upper) / 2, 0, count FROM base) GROUP BY x),
cdf AS (SELECT sum(c) OVER (ORDER BY x) AS c, sum(b) OVER (ORDER BY x) AS b, sum(c) OVER () AS nc, sum(b) OVER () AS nb FROM pts),
ks AS (SELECT CAST(max(nc) AS BIGINT) AS n_current, CAST(max(nb) AS BIGINT) AS n_baseline, max(abs(c / nc - b / nb)) AS d FROM cdf),
ksp AS (SELECT *, greatest(0, least(1, 2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * k * k * d * d * n_current * n_baseline / (n_current + n_baseline)))))) AS p_value FROM ks),
pair AS (SELECT base.profile, CAST(coalesce(cur.count, 0) AS DOUBLE) AS c, CAST(base.count AS DOUBLE) AS b FROM base LEFT JOIN cur USING (position)),
prob AS (SELECT profile, (c / sum(c) OVER w + 1e-10) / (1 + count(*) OVER w * 1e-10) AS p, (b / sum(b) OVER w + 1e-10) / (1 + count(*) OVER w * 1e-10) AS q FROM pair WINDOW w AS (PARTITION BY profile)),
kl AS (SELECT profile, greatest(0, sum(p * ln(p / q))) AS kl FROM prob GROUP BY profile)"""


@query(_EVENTS + " SELECT 'events:v1' AS dataset, 'value' AS column_name, n_current, n_baseline, round(d, 4) AS d, round(p_value, 4) AS p_value FROM ksp")
def ks_events_daily(spark: SparkSession, d: str) -> DataFrame:
    return rounded(anomaly.ks_statistic(*_event_histograms(spark, d), exact_up_to=0))


@query(_EVENTS + " SELECT 'events:v1' AS dataset, 'value' AS column_name, profile, round(kl, 4) AS kl FROM kl")
def kl_events_daily(spark: SparkSession, d: str) -> DataFrame:
    return rounded(anomaly.kl_divergence(*_event_histograms(spark, d)))


_AT = "2024-01-31 00:00:00"
_EVENT_ROWS = """SELECT 'events:v1' AS dataset, 'value' AS column_name, 'distribution_shift' AS category, CASE WHEN sc >= 0.8 THEN 'critical' WHEN sc >= 0.5 THEN 'warning' ELSE 'info' END AS severity, TIMESTAMP '2024-01-31 00:00:00' AS detected_at, sc AS score,
round(least(1.0, (SELECT count(DISTINCT profile) FROM base) / 30.0), 4)::DOUBLE AS confidence, algorithm, metric_name, round(stat, 4) AS observed, round(t, 4)::DOUBLE AS expected, 0.0::DOUBLE AS lo, round(t, 4)::DOUBLE AS hi,
'column ''value'': ' || word || ' ' || printf('%.4f', stat) || ' exceeds threshold ' || printf('%.4f', CAST(t AS DOUBLE)) || coalesce(' (p-value ' || printf('%.6f', p) || ')', '') AS description,
CASE WHEN p IS NULL THEN 'adaptive_threshold,algorithm,anomaly_score,kl_divergence' ELSE 'adaptive_threshold,algorithm,anomaly_score,ks_statistic,p_value' END AS facts, round(stat / t, 4) AS raw_ratio FROM (SELECT *, greatest(0, least(1, stat / CAST(t AS DOUBLE)))::DOUBLE AS sc FROM (
SELECT 'ks_test' AS algorithm, 'ks_statistic' AS metric_name, 'Kolmogorov-Smirnov statistic' AS word, d AS stat, {ks} AS t, p_value AS p FROM ksp WHERE d > {ks} AND p_value < 0.05
UNION ALL SELECT 'kl_divergence', 'kl_divergence', 'Kullback-Leibler divergence', max(kl), {kl}, NULL FROM kl HAVING max(kl) > {kl}))"""


def _plain(events: DataFrame) -> DataFrame:
    facts = F.array_join(F.sort_array(F.map_keys("context")), ",")
    return rounded(events.select("*", F.col("expected_range.lo").alias("lo"), F.col("expected_range.hi").alias("hi"), facts.alias("facts")).drop("expected_range", "context", "anomaly_id"))


@query(_EVENTS + _EVENT_ROWS.format(ks=0.15, kl=0.5))
def anomaly_events_daily(spark: SparkSession, d: str) -> DataFrame:
    return _plain(anomaly.detect_anomalies(*_event_histograms(spark, d), exact_up_to=0, detected_at=at(_AT)))


@query(_EVENTS + _EVENT_ROWS.format(ks=0.001, kl=0.001))
def anomaly_threshold_override(spark: SparkSession, d: str) -> DataFrame:
    low = values(spark, "(VALUES ('events:v1', 'value', 0.001, 0.001)) AS t(dataset, column_name, ks_threshold, kl_threshold)")
    return _plain(anomaly.detect_anomalies(*_event_histograms(spark, d), low, exact_up_to=0, detected_at=at(_AT)))


_SHIFTED = histogram_sql("(SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS profile, CASE WHEN CAST(ts AS DATE) = DATE '2024-01-30' THEN value * value ELSE value END AS value FROM events)", "value", 20, "profile")


@query(_EVENTS.replace(histogram_sql("(SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS profile, value FROM events)", "value", 20, "profile"), _SHIFTED) + _EVENT_ROWS.format(ks=0.15, kl=0.5))
def anomaly_shifted_day(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").withColumn("profile", F.to_date("ts").cast("string")).withColumn("value", F.when(F.col("profile") == LAST_DAY, F.col("value") * F.col("value")).otherwise(F.col("value")))
    return _plain(anomaly.detect_anomalies(*_days(e), exact_up_to=0, detected_at=at(_AT)))


@query("SELECT day AS profiled_at, n FROM (SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, count(*) AS n FROM events GROUP BY 1) WHERE day >= TIMESTAMP '2024-02-10 00:00:00' - INTERVAL 30 DAY")
def baseline_window(spark: SparkSession, d: str) -> DataFrame:
    days = load(spark, d, "events").groupBy(F.to_date("ts").cast("timestamp_ntz").alias("profiled_at")).agg(F.count(F.lit(1)).alias("n"))
    return anomaly.baseline_window(days, at("2024-02-10 00:00:00"))


@query("SELECT dataset, count(DISTINCT profile) AS profiles FROM (SELECT event_type AS dataset, CAST(ts AS DATE) AS profile FROM events WHERE event_type <> 'click' OR CAST(ts AS DATE) < DATE '2024-01-07') GROUP BY dataset HAVING count(DISTINCT profile) >= 7")
def baseline_gate(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").select(F.col("event_type").alias("dataset"), F.to_date("ts").alias("profile"))
    return anomaly.enough_profiles(e.where((F.col("dataset") != "click") | (F.col("profile") < "2024-01-07")))


_SCORES = "(VALUES (0.1, 0.2, 0), (0.3, 0.2, 7), (0.09, 0.1, 30), (0.0, 0.5, 45), (0.2, 0.0, 15)) AS t(stat, threshold, profiles)"


@query(f"SELECT CAST(stat AS DOUBLE) AS stat, round(s, 4) AS score, round(least(1.0, greatest(0, profiles / 30.0)), 4)::DOUBLE AS confidence, CASE WHEN s >= 0.8 THEN 'critical' WHEN s >= 0.5 THEN 'warning' ELSE 'info' END AS severity FROM (SELECT *, CASE WHEN threshold <= 0 THEN 1.0 ELSE greatest(0.0, least(1.0, CAST(stat AS DOUBLE) / CAST(threshold AS DOUBLE))) END::DOUBLE AS s FROM {_SCORES})")
def anomaly_scores(spark: SparkSession, d: str) -> DataFrame:
    v = values(spark, _SCORES).select(F.col("stat").cast("double").alias("stat"), F.col("threshold").cast("double").alias("threshold"), "profiles")
    s = anomaly.score(F.col("stat"), F.col("threshold"))
    return rounded(v.select("stat", s.alias("score"), anomaly.confidence(F.col("profiles")).alias("confidence"), anomaly.severity(s).alias("severity")))


_SMALL_KS = "(VALUES (0.5, 3, 4), (0.75, 4, 4), (0.4, 5, 5), (0.6, 5, 2), (1.0, 3, 3), (0.25, 4, 6)) AS t(d, n1, n2)"


@query(f"""WITH t AS (SELECT CAST(d AS DOUBLE) AS d, n1, n2 FROM {_SMALL_KS}),
way AS (SELECT t.*, m FROM t, range(1024) AS r(m) WHERE m < 1 << (n1 + n2) AND bit_count(CAST(m AS INT)) = n1),
most AS (SELECT d, n1, n2, m, max(abs(bit_count(CAST(m & ((1 << k) - 1) AS INT)) * n2 - (k - bit_count(CAST(m & ((1 << k) - 1) AS INT))) * n1)) AS h FROM way, range(1, 11) AS s(k) WHERE k <= n1 + n2 GROUP BY ALL)
SELECT d, n1, n2, round(count(*) FILTER (WHERE h >= round(d * n1 * n2)) / count(*), 6) AS p_value FROM most GROUP BY d, n1, n2""")
def ks_exact_small(spark: SparkSession, d: str) -> DataFrame:
    """Exact p-values of small samples; the SQL goes through all interleavings."""
    v = values(spark, _SMALL_KS).select(F.col("d").cast("double").alias("d"), "n1", "n2")
    return rounded(v.withColumn("p_value", anomaly.ks_p_value(F.col("d"), F.col("n1"), F.col("n2"))), 6)


_FLOW = "(SELECT event_type || ':v1' AS dataset, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS profiled_at, count(*) AS n FROM events GROUP BY 1, 2)"


@query(f"SELECT dataset, profiled_at, n FROM {_FLOW} WHERE dataset <> 'click:v1' OR profiled_at >= TIMESTAMP '2024-02-05 00:00:00' - INTERVAL 30 DAY UNION ALL SELECT 'click:v1', TIMESTAMP '2024-02-05 00:00:00', 7")
def baseline_update(spark: SparkSession, d: str) -> DataFrame:
    """A profile of one dataset arrives: it is appended, and that dataset alone loses what is older than thirty days."""
    e = load(spark, d, "events").groupBy(anomaly.baseline_key(F.col("event_type"), F.lit(1)).alias("dataset"), F.to_date("ts").cast("timestamp_ntz").alias("profiled_at")).agg(F.count(F.lit(1)).alias("n"))
    new = spark.range(1).select(F.lit("click:v1").alias("dataset"), at("2024-02-05 00:00:00").alias("profiled_at"), F.lit(7).cast("long").alias("n"))
    return anomaly.update_baseline(e, new, at("2024-02-05 00:00:00"))


@query(f"SELECT dataset, profiled_at, n FROM {_FLOW} WHERE dataset = 'view:v1'")
def baseline_of_dataset(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").groupBy(anomaly.baseline_key(F.col("event_type"), F.lit(1)).alias("dataset"), F.to_date("ts").cast("timestamp_ntz").alias("profiled_at")).agg(F.count(F.lit(1)).alias("n"))
    return anomaly.get_baseline(e, "view:v1")


@query("SELECT 'events:v1' AS dataset, event_type AS column_name, 'bounds that are no numbers' AS reason FROM events WHERE event_type = 'click' GROUP BY 2 UNION ALL SELECT 'events:v1', event_type, 'negative count' FROM events WHERE event_type = 'view' GROUP BY 2")
def histograms_unusable(spark: SparkSession, d: str) -> DataFrame:
    """One column's bounds broken, another's counts: both are listed, all others stay."""
    h = profile.histogram(load(spark, d, "events"), "value", by=["event_type"]).select(F.lit("events:v1").alias("dataset"), F.col("event_type").alias("column_name"), F.lit("p").alias("profile"), "position", "lower", "upper", "count")
    broken = h.withColumn("lower", F.when((F.col("column_name") == "click") & (F.col("position") == 3), float("nan")).otherwise(F.col("lower"))).withColumn("count", F.when((F.col("column_name") == "view") & (F.col("position") == 2), -1).otherwise(F.col("count")))
    return anomaly.unusable(broken).drop("profile")
