"""Queries on remediation, alerts, stores, constraint checks and overview pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.expressions import relative_time, short_number
from tidewatch.operators import alerts, checks, dashboards, healing
from tidewatch.plans.support import at, load, query, rounded, values
from tidewatch.sources import store

# --- remediation --------------------------------------------------------------------------------------------------

_ALERTS = """(VALUES ('a1', 'upstream_timeout'), ('a2', '  Schema_Violation '), ('a3', 'data_gap'), ('a4', 'freshness_breach'), ('a5', 'db timeout in schema'), ('a6', 'new schema gap'), ('a7', 'stale freshness'), ('a8', 'volume'), ('a9', 'gap found'))
AS t(alert_id, anomaly_type)"""
_T = "regexp_replace(lower(anomaly_type), '^\\s+|\\s+$', '', 'g')"
_DIAG = f"""SELECT alert_id, CASE WHEN x IN ('upstream_timeout', 'schema_violation', 'data_gap', 'freshness_breach') THEN x ELSE 'unknown:' || x END AS root_cause,
CASE WHEN x = 'upstream_timeout' THEN 'auto_retry' WHEN x = 'schema_violation' THEN 'quarantine' WHEN x IN ('data_gap', 'freshness_breach') THEN 'backfill' WHEN contains(x, 'timeout') THEN 'auto_retry' WHEN contains(x, 'schema') THEN 'quarantine' WHEN contains(x, 'gap') OR contains(x, 'freshness') THEN 'backfill' ELSE 'escalate' END AS suggested_strategy,
CASE WHEN x IN ('upstream_timeout', 'schema_violation', 'data_gap', 'freshness_breach') THEN 0.8::DOUBLE WHEN contains(x, 'timeout') OR contains(x, 'schema') OR contains(x, 'gap') OR contains(x, 'freshness') THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END AS confidence FROM (SELECT alert_id, {_T} AS x FROM {_ALERTS})"""


@query(_DIAG)
def healing_diagnose(spark: SparkSession, d: str) -> DataFrame:
    return healing.diagnose(values(spark, _ALERTS)).drop("anomaly_type")


_HIST = """(VALUES ('auto_retry', false, TIMESTAMP '2024-01-02 12:00:00', 'upstream_timeout x'), ('auto_retry', false, TIMESTAMP '2024-01-02 00:00:00', 'upstream_timeout y'), ('auto_retry', false, TIMESTAMP '2024-01-02 13:00:00', 'again upstream_timeout'),
('auto_retry', true, TIMESTAMP '2024-01-02 13:30:00', 'upstream_timeout'), ('auto_retry', false, TIMESTAMP '2024-01-01 23:59:59', 'upstream_timeout'), ('backfill', false, TIMESTAMP '2024-01-02 13:00:00', 'data_gap'), ('backfill', false, TIMESTAMP '2024-01-02 14:00:00', 'data_gap'),
('quarantine', false, TIMESTAMP '2024-01-02 14:00:00', NULL)) AS t(strategy, success, started_at, details)"""
_FAIL = f"""SELECT alert_id, count(*) AS failures FROM ({_DIAG}) g JOIN {_HIST.replace(' t(', ' h(')} ON h.strategy = g.suggested_strategy AND NOT success AND started_at >= TIMESTAMP '2024-01-03 00:00:00' - INTERVAL 24 HOUR AND contains(details, root_cause) GROUP BY 1"""


@query(_FAIL)
def healing_failures_24h(spark: SparkSession, d: str) -> DataFrame:
    return healing.recent_failures(healing.diagnose(values(spark, _ALERTS)), values(spark, _HIST), at("2024-01-03 00:00:00"))


@query(f"SELECT alert_id, CASE WHEN confidence < 0.5 OR coalesce(failures, 0) >= 3 THEN 'escalate' ELSE suggested_strategy END AS strategy FROM ({_DIAG}) LEFT JOIN ({_FAIL}) USING (alert_id)")
def healing_select(spark: SparkSession, d: str) -> DataFrame:
    return healing.select_strategy(healing.diagnose(values(spark, _ALERTS)), values(spark, _HIST), at("2024-01-03 00:00:00")).select("alert_id", "strategy")


@query("SELECT attempt::INT AS attempt, round(least(1.0 * 2.0 ** attempt, 300.0), 4)::DOUBLE AS delay FROM range(12) AS r(attempt)")
def retry_schedule(spark: SparkSession, d: str) -> DataFrame:
    p = values(spark, "(VALUES (1.0, 2.0, 300.0, 12)) AS t(base, multiplier, longest, retries)").select(*[F.col(c).cast("double").alias(c) for c in ("base", "multiplier", "longest")], "retries")
    return rounded(healing.retry_delays(p).select("attempt", F.col("delay").cast("double").alias("delay")))


@query("SELECT l_returnflag, count(*) FILTER (WHERE ok) AS good, count(*) FILTER (WHERE NOT ok) AS bad FROM (SELECT *, l_quantity <= 45 AND l_discount < 0.1 AS ok FROM lineitem) GROUP BY 1")
def quarantine_split(spark: SparkSession, d: str) -> DataFrame:
    good, bad = healing.quarantine(load(spark, d, "lineitem"), (F.col("l_quantity") <= 45) & (F.col("l_discount") < 0.1), "limits")
    n = good.select("l_returnflag", F.lit(1).alias("g")).unionByName(bad.select("l_returnflag", F.lit(0).alias("g")))
    return n.groupBy("l_returnflag").agg(F.count_if(F.col("g") == 1).alias("good"), F.count_if(F.col("g") == 0).alias("bad"))


@query("SELECT CAST(g AS DATE) AS day FROM generate_series(TIMESTAMP '2023-12-28', TIMESTAMP '2024-02-03', INTERVAL 1 DAY) AS s(g) WHERE CAST(g AS DATE) NOT IN (SELECT CAST(ts AS DATE) FROM events)")
def backfill_gaps(spark: SparkSession, d: str) -> DataFrame:
    return healing.missing_days(load(spark, d, "events"), "ts", F.lit("2023-12-28").cast("date"), F.lit("2024-02-03").cast("date"))


@query("SELECT 'lineitem' AS dataset, reason, count(*) AS record_count, TIMESTAMP '2024-02-01 00:00:00' AS quarantined_at, true AS reprocessable FROM (SELECT 'quantity' AS reason FROM lineitem WHERE NOT l_quantity <= 45 UNION ALL SELECT 'discount' FROM lineitem WHERE NOT l_discount < 0.1) GROUP BY reason")
def quarantine_receipts(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem")
    bad = healing.quarantine(li, F.col("l_quantity") <= 45, "quantity")[1].unionByName(healing.quarantine(li, F.col("l_discount") < 0.1, "discount")[1])
    return healing.quarantine_receipt(bad, "lineitem", at("2024-02-01 00:00:00")).drop("quarantine_id")


@query("""WITH g AS (SELECT CAST(g AS DATE) AS day FROM generate_series(TIMESTAMP '2023-12-28', TIMESTAMP '2024-02-03', INTERVAL 1 DAY) AS s(g) WHERE CAST(g AS DATE) NOT IN (SELECT CAST(ts AS DATE) FROM events)),
i AS (SELECT day, day - CAST(row_number() OVER (ORDER BY day) AS INT) AS k FROM g) SELECT 'events' AS dataset, min(day) AS time_range_start, CAST(max(day) + 1 AS DATE) AS time_range_end, 'data_gap' AS triggered_by, 'days without rows' AS reason, 'pending' AS status, CAST(0 AS BIGINT) AS records_processed, CAST(0 AS BIGINT) AS records_failed FROM i GROUP BY k""")
def backfill_jobs(spark: SparkSession, d: str) -> DataFrame:
    days = healing.missing_days(load(spark, d, "events"), "ts", F.lit("2023-12-28").cast("date"), F.lit("2024-02-03").cast("date"))
    return healing.backfill_jobs(days, "events", "data_gap", "days without rows").drop("job_id")


def _selected(spark: SparkSession) -> DataFrame:
    return healing.select_strategy(healing.diagnose(values(spark, _ALERTS)), values(spark, _HIST), at("2024-01-03 00:00:00"))


_SELECTED = f"SELECT alert_id, root_cause, confidence, CASE WHEN confidence < 0.5 OR coalesce(failures, 0) >= 3 THEN 'escalate' ELSE suggested_strategy END AS strategy FROM ({_DIAG}) LEFT JOIN ({_FAIL}) USING (alert_id)"


@query(f"SELECT alert_id, root_cause, 1 AS current_level, TIMESTAMP '2024-01-03 00:00:00' AS started_at FROM ({_SELECTED}) WHERE strategy = 'escalate'")
def healing_escalations(spark: SparkSession, d: str) -> DataFrame:
    return healing.escalations(_selected(spark), at("2024-01-03 00:00:00")).drop("chain_id")


@query(f"SELECT *, '2024-01-03T00:00:00' AS selected_at FROM ({_SELECTED})")
def healing_log(spark: SparkSession, d: str) -> DataFrame:
    return healing.selection_log(_selected(spark), at("2024-01-03 00:00:00"))


@query(f"SELECT strategy, count(*) AS results, count(*) FILTER (WHERE NOT success) AS failed FROM (SELECT strategy, success FROM {_HIST} UNION ALL SELECT 'backfill', false) GROUP BY 1")
def healing_recorded(spark: SparkSession, d: str) -> DataFrame:
    h = healing.record_result(values(spark, _HIST), "a3", "events", "backfill", False, at("2024-01-02 20:00:00"), "data_gap again", 12)
    return h.groupBy("strategy").agg(F.count(F.lit(1)).alias("results"), F.count_if(~F.col("success")).alias("failed"))


# --- alerts and stores ----------------------------------------------------------------------------------------------


def _alerts(spark: SparkSession, d: str) -> DataFrame:
    """Alerts made from events: value over 80 on a user's stream."""
    e = load(spark, d, "events").where("value > 80")
    return e.select(F.col("event_id").alias("alert_id"), F.col("event_type").alias("dataset"), F.lit("spike").alias("anomaly_type"), (F.col("user_id") % 5).cast("string").alias("metric_name"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("acknowledged_at"))


_AL = "(SELECT event_id AS alert_id, event_type AS dataset, 'spike' AS anomaly_type, CAST(user_id % 5 AS VARCHAR) AS metric_name, ts AS created_at, CASE WHEN event_id % 3 = 0 THEN ts END AS acknowledged_at FROM events WHERE value > 80)"


@query(f"SELECT alert_id, created_at FROM {_AL} WHERE acknowledged_at IS NULL")
def alerts_active(spark: SparkSession, d: str) -> DataFrame:
    return alerts.active(_alerts(spark, d)).select("alert_id", "created_at")


@query(f"SELECT dataset, anomaly_type, metric_name, min(alert_id) AS alert_id, count(*) AS occurrence_count, min(created_at) AS first_seen, max(created_at) AS last_seen FROM {_AL} GROUP BY 1, 2, 3")
def alerts_dedup(spark: SparkSession, d: str) -> DataFrame:
    return alerts.deduplicate(_alerts(spark, d))


@query(f"""WITH a AS (SELECT *, CASE WHEN created_at >= lag(created_at) OVER w + INTERVAL 6 HOUR OR lag(created_at) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM {_AL} WINDOW w AS (PARTITION BY dataset, anomaly_type, metric_name ORDER BY created_at)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY dataset, anomaly_type, metric_name ORDER BY created_at RANGE UNBOUNDED PRECEDING) AS k FROM a) SELECT dataset, anomaly_type, metric_name, min(created_at) AS first_seen, count(*) AS occurrence_count FROM s GROUP BY dataset, anomaly_type, metric_name, k""")
def alerts_sessions(spark: SparkSession, d: str) -> DataFrame:
    return alerts.deduplicate_within(_alerts(spark, d), "6 hours")


_UP = "(VALUES ('purchase', 'click'), ('purchase', 'view'), ('click', 'absent'), ('click', 'click')) AS t(dataset, ancestor)"


@query(f"SELECT dataset, suppressed, count(*) AS n FROM (SELECT dataset, dataset IN (SELECT dataset FROM {_UP} WHERE dataset <> ancestor AND ancestor IN (SELECT dataset FROM {_AL})) AS suppressed FROM {_AL}) GROUP BY 1, 2")
def alerts_root_cause(spark: SparkSession, d: str) -> DataFrame:
    return alerts.correlate(_alerts(spark, d), values(spark, _UP)).groupBy("dataset", "suppressed").agg(F.count(F.lit(1)).alias("n"))


_LEVELS = "(VALUES (0, 86400), (1, 300000), (2, 600000), (3, 300)) AS t(level, timeout_seconds)"


@query(f"WITH r AS (SELECT level, coalesce(sum(timeout_seconds) OVER (ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS after FROM {_LEVELS}) SELECT alert_id, max(level) AS level FROM {_AL} LEFT JOIN r ON date_diff('microsecond', created_at, TIMESTAMP '2024-01-31 00:00:00') // 1000000 >= after WHERE acknowledged_at IS NULL GROUP BY 1")
def escalation_levels(spark: SparkSession, d: str) -> DataFrame:
    return alerts.escalation_levels(_alerts(spark, d), values(spark, _LEVELS), at("2024-01-31 00:00:00"))


@query("SELECT user_id, max_by(event_id, ts) AS event_id, max(ts) AS ts FROM events GROUP BY 1")
def store_latest(spark: SparkSession, d: str) -> DataFrame:
    return store.latest_by(load(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], "ts")


@query("SELECT event_id, ts FROM events WHERE event_type = 'click' AND ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' ORDER BY ts DESC LIMIT 100")
def store_time_range(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").where("event_type = 'click'").select("event_id", "ts")
    return store.time_range(e, "ts", at("2024-01-05 00:00:00"), at("2024-01-20 00:00:00"))


@query("SELECT event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) WHERE r <= 3")
def store_newest_per(spark: SparkSession, d: str) -> DataFrame:
    return store.newest_per(load(spark, d, "events").select("event_type", "event_id", "ts"), ["event_type"], "event_id", 3)


def _domains(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").select(F.col("c_custkey").alias("dataset"), F.col("c_mktsegment").alias("domain"), (F.col("c_custkey") % 97).alias("recorded"))


@query("SELECT c_custkey AS dataset, c_mktsegment AS domain FROM customer WHERE c_mktsegment = 'BUILDING'")
def store_datasets_of_domain(spark: SparkSession, d: str) -> DataFrame:
    return store.list_datasets(_domains(spark, d), "BUILDING").select("dataset", "domain")


_REPORT = "SELECT event_type AS dataset, event_id AS recorded, value FROM events"


def _reports(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select(F.col("event_type").alias("dataset"), F.col("event_id").alias("recorded"), "value", F.col("ts").alias("check_time"))


@query(f"SELECT * FROM ({_REPORT}) WHERE dataset = 'view' ORDER BY recorded DESC LIMIT 25")
def store_drift_reports(spark: SparkSession, d: str) -> DataFrame:
    return store.newest_of(_reports(spark, d), "view", 25).drop("check_time")


@query(f"SELECT dataset, count(*) AS results, max(recorded) AS newest FROM (SELECT * FROM ({_REPORT}) WHERE dataset = 'purchase' ORDER BY recorded DESC LIMIT 100) GROUP BY 1")
def store_healing_results(spark: SparkSession, d: str) -> DataFrame:
    return store.newest_of(_reports(spark, d), "purchase").groupBy("dataset").agg(F.count(F.lit(1)).alias("results"), F.max("recorded").alias("newest"))


@query("SELECT event_id AS recorded, ts AS check_time FROM events WHERE event_type = 'error' AND ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00' ORDER BY ts DESC LIMIT 40")
def store_freshness_range(spark: SparkSession, d: str) -> DataFrame:
    own = _reports(spark, d).where(F.col("dataset") == "error").select("recorded", "check_time")
    return store.time_range(own, "check_time", at("2024-01-10 00:00:00"), at("2024-01-12 00:00:00"), 40)


@query(f"SELECT dataset, value, recorded FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY recorded DESC) AS r FROM ({_REPORT})) WHERE r <= 2")
def store_threshold_history(spark: SparkSession, d: str) -> DataFrame:
    return store.newest_per(_reports(spark, d).drop("check_time"), ["dataset"], "recorded", 2)


# --- constraints ----------------------------------------------------------------------------------------------------

_RULES = [
    {"name": "l_orderkey", "nullable": False}, {"name": "l_quantity", "min_value": 5, "max_value": 45}, {"name": "l_returnflag", "allowed_values": ["A", "N"]},
    {"name": "l_linestatus", "pattern": "[OF]"}, {"name": "l_discount", "max_value": 0.05},
]


@query("""SELECT 'l_orderkey:not_null' AS "check", count(*) AS rows, count(*) FILTER (WHERE l_orderkey IS NULL) AS violations FROM lineitem UNION ALL SELECT 'l_quantity:min_value', count(*), count(*) FILTER (WHERE l_quantity < 5) FROM lineitem
UNION ALL SELECT 'l_quantity:max_value', count(*), count(*) FILTER (WHERE l_quantity > 45) FROM lineitem UNION ALL SELECT 'l_returnflag:allowed_values', count(*), count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N')) FROM lineitem
UNION ALL SELECT 'l_linestatus:pattern', count(*), count(*) FILTER (WHERE NOT regexp_full_match(l_linestatus, '[OF]')) FROM lineitem UNION ALL SELECT 'l_discount:max_value', count(*), count(*) FILTER (WHERE l_discount > 0.05) FROM lineitem""")
def check_constraints(spark: SparkSession, d: str) -> DataFrame:
    return checks.check_rows(load(spark, d, "lineitem"), _RULES)


@query("SELECT 'v' AS column_name, round(count(*) FILTER (WHERE value < 10) / count(*), 4) AS null_rate, 0.05::DOUBLE AS max_null_rate, count(*) FILTER (WHERE value < 10) / count(*) <= 0.05 AS passed FROM events UNION ALL SELECT 'event_id', 0, 1.0, true")
def check_null_rate(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").select("event_id", F.when(F.col("value") >= 10, F.col("value")).alias("v"))
    return rounded(checks.check_null_rates(e, [{"name": "v", "max_null_rate": 0.05}, {"name": "event_id"}]))


@query("SELECT 'o_orderkey' AS column_name, count(*) AS duplicated_values, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus_rows FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey HAVING count(*) > 1) UNION ALL SELECT 'o_custkey', count(*), CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1)")
def check_unique(spark: SparkSession, d: str) -> DataFrame:
    return checks.check_unique(load(spark, d, "orders"), ["o_orderkey", "o_custkey"])


@query("SELECT event_type, count(*) AS rows, count(*) BETWEEN 100 AND 2000 AS passed FROM events GROUP BY 1")
def check_row_count(spark: SparkSession, d: str) -> DataFrame:
    return checks.check_row_count(load(spark, d, "events"), 100, 2000, ["event_type"])


# --- overview pages -------------------------------------------------------------------------------------------------


@query("SELECT coalesce(event_type, 'all') AS event_type, count(*) AS count FROM events GROUP BY ROLLUP (event_type)")
def dash_severity_counts(spark: SparkSession, d: str) -> DataFrame:
    return dashboards.counts_with_total(load(spark, d, "events"), "event_type")


_SCORE = "value / 100"


@query(f"SELECT CAST(b AS INT) AS bin, count(s) AS count FROM range(5) AS r(b) LEFT JOIN (SELECT least(floor({_SCORE} * 5), 4) AS s FROM events WHERE value BETWEEN 0 AND 100) ON s = b GROUP BY 1")
def dash_score_bins(spark: SparkSession, d: str) -> DataFrame:
    return dashboards.score_bins(load(spark, d, "events").where("value BETWEEN 0 AND 100").select(F.expr(_SCORE).alias("score")))


@query(f"SELECT acknowledged_at IS NOT NULL AS acknowledged, count(*) AS count FROM {_AL} GROUP BY 1")
def dash_acknowledged(spark: SparkSession, d: str) -> DataFrame:
    return _alerts(spark, d).groupBy(F.col("acknowledged_at").isNotNull().alias("acknowledged")).agg(F.count(F.lit(1)).alias("count"))


@query(f"SELECT CAST(l AS INT) AS level, count(a.level) AS count, CASE l WHEN 0 THEN 'New' WHEN 1 THEN 'Team' WHEN 2 THEN 'Manager' WHEN 3 THEN 'Executive' ELSE 'Unknown' END AS label FROM range(5) AS r(l) LEFT JOIN (SELECT alert_id % 3 AS level FROM {_AL} WHERE acknowledged_at IS NULL) a ON a.level = l GROUP BY l")
def dash_escalation(spark: SparkSession, d: str) -> DataFrame:
    a = alerts.active(_alerts(spark, d)).select((F.col("alert_id") % 3).cast("int").alias("level"))
    return dashboards.zero_filled(a, "level", 0, 4).withColumn("label", dashboards.escalation_label(F.col("level")))


def _actions(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select(F.col("event_type").alias("strategy"), F.when(F.col("event_id") % 4 == 0, "failed").when(F.col("event_id") % 4 == 1, "in_progress").otherwise("success").alias("status"), F.col("ts").alias("at"), F.col("event_id").alias("id"))


_ACT = "(SELECT event_type AS strategy, CASE WHEN event_id % 4 = 0 THEN 'failed' WHEN event_id % 4 = 1 THEN 'in_progress' ELSE 'success' END AS status, ts AS at_time, event_id AS id FROM events)"


@query(f"SELECT strategy, count(*) AS actions, count(*) FILTER (WHERE status = 'success') AS succeeded, CAST(floor(100 * count(*) FILTER (WHERE status = 'success') / count(*) FILTER (WHERE status IN ('success', 'failed')) + 0.5) AS BIGINT) AS success_rate FROM {_ACT} GROUP BY 1")
def dash_success_rate(spark: SparkSession, d: str) -> DataFrame:
    return dashboards.success_rates(_actions(spark, d), "strategy")


@query(f"SELECT DISTINCT strategy FROM {_ACT}")
def dash_strategies(spark: SparkSession, d: str) -> DataFrame:
    return _actions(spark, d).select("strategy").distinct()


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS count FROM events GROUP BY 1, 2")
def dash_timeline(spark: SparkSession, d: str) -> DataFrame:
    return dashboards.per_day(load(spark, d, "events"), "ts", ["event_type"])


@query("SELECT event_type, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM events GROUP BY 1")
def dash_health_shares(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dashboards.shares(load(spark, d, "events"), "event_type"))


@query("SELECT CAST(g AS DATE) AS day, count(ts) AS count FROM generate_series(TIMESTAMP '2024-01-26', TIMESTAMP '2024-02-01', INTERVAL 1 DAY) AS s(g) LEFT JOIN events ON CAST(ts AS DATE) = CAST(g AS DATE) GROUP BY 1")
def dash_sparkline(spark: SparkSession, d: str) -> DataFrame:
    return dashboards.last_days(load(spark, d, "events"), "ts", F.lit("2024-02-01").cast("date"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'large w')")
def dash_label_search(spark: SparkSession, d: str) -> DataFrame:
    return dashboards.label_search(load(spark, d, "part").select("p_partkey", "p_name"), "p_name", "LARGE W")


@query("SELECT kind, id, t AS at FROM (SELECT 'event' AS kind, CAST(event_id AS VARCHAR) AS id, ts AS t FROM events UNION ALL SELECT 'order', CAST(o_orderkey AS VARCHAR), o_orderdate FROM orders) ORDER BY t DESC, kind, id LIMIT 20")
def dash_activity_feed(spark: SparkSession, d: str) -> DataFrame:
    return dashboards.activity_feed({"event": load(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at")), "order": load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))}, 20)


@query("""SELECT n, CASE WHEN n >= 1000000 THEN printf('%.1f', n / 1000000.0::DOUBLE) || 'M' WHEN n >= 1000 THEN printf('%.1f', n / 1000.0::DOUBLE) || 'K' ELSE CAST(n AS VARCHAR) END AS short,
CASE WHEN n < 60 THEN 'just now' WHEN n < 3600 THEN (n // 60) || 'm ago' WHEN n < 86400 THEN (n // 3600) || 'h ago' ELSE (n // 86400) || 'd ago' END AS ago FROM (SELECT CAST(o_orderkey * o_orderkey // 7 AS BIGINT) AS n FROM orders)""")
def dash_formats(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "orders").select(F.expr("cast(o_orderkey * o_orderkey div 7 as bigint)").alias("n"))
    return n.select("n", short_number(F.col("n")).alias("short"), relative_time(F.col("n")).alias("ago"))


@query("""WITH w AS (SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS start, sum(value) AS total FROM events GROUP BY 1, 2), s AS (SELECT *, avg(total) OVER (PARTITION BY user_id) AS mean, stddev_samp(total) OVER (PARTITION BY user_id) AS sd FROM w)
SELECT user_id, start, round(total, 6) AS total, round(mean, 6) AS mean, round(sd, 6) AS sd, round((total - mean) / sd, 6) AS z FROM s WHERE sd > 0 AND (total - mean) / sd > 1.5""")
def agent_spikes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dashboards.spikes(load(spark, d, "events"), "user_id", "ts", "value", "1 day", 1.5), 6)


@query("""WITH g AS (SELECT k, event_type, row_number() OVER (PARTITION BY k ORDER BY event_id) - row_number() OVER (PARTITION BY k, event_type ORDER BY event_id) AS i FROM (SELECT *, user_id % 3 AS k FROM events))
SELECT k, event_type, run, CASE WHEN run >= 5 THEN 'hard' ELSE 'soft' END AS verdict FROM (SELECT k, event_type, i, count(*) AS run FROM g GROUP BY 1, 2, 3) WHERE run >= 3""")
def agent_loops(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").withColumn("k", F.col("user_id") % 3)
    return dashboards.repeated_calls(e, "k", ["event_id"], "event_type", 3, 5)


@query("""WITH r AS (SELECT event_id, (value - lag(value) OVER w) / nullif(date_diff('microsecond', lag(ts) OVER w, ts) / 1000000, 0) AS rate, date_diff('microsecond', lag(ts) OVER w, ts) AS us FROM events WINDOW w AS (PARTITION BY user_id % 3 ORDER BY ts, event_id))
SELECT event_id, round(rate, 4) AS rate FROM r WHERE us > 0 AND rate > 0.05""")
def agent_growth(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").withColumn("k", F.col("user_id") % 3)
    return rounded(dashboards.growth(e, "k", ["ts", "event_id"], "ts", "value", 0.05).select("event_id", "rate"))


@query("""WITH w AS (SELECT event_type, g AS start, sum(value) AS total FROM events JOIN generate_series(TIMESTAMP '2023-12-31', TIMESTAMP '2024-02-01', INTERVAL 12 HOUR) AS s(g) ON ts >= g AND ts < g + INTERVAL 1 DAY GROUP BY 1, 2),
v AS (SELECT event_type, start + INTERVAL 1 DAY AS t, total, CASE WHEN total > 4200 THEN 'hard' ELSE 'soft' END AS verdict FROM w WHERE total > 3600)
SELECT event_type, t AS at, round(total, 4) AS total, verdict, coalesce(date_diff('second', lag(t) OVER (PARTITION BY event_type ORDER BY t), t) < 86400, false) AS quiet FROM v""")
def agent_policy_limits(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dashboards.policy_limits(load(spark, d, "events"), "event_type", "ts", "value", "1 day", "12 hours", 3600, 4200, 86400))
