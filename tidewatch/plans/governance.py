"""Queries on contracts, drift, freshness and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.expressions import TYPE_WIDTH
from tidewatch.operators import contracts, freshness, lineage
from tidewatch.plans.support import at, load, query, rounded, values

TYPES = ["string", "integer", "float", "boolean", "timestamp", "date", "decimal", "array", "map", "struct", "binary"]

# --- contracts ----------------------------------------------------------------------------------------------------

_REG = "(VALUES ('a', 1, 9), ('a', 2, 1), ('b', 3, 1), ('a', 4, 7)) AS t(dataset, seq, version)"
_OLD = "(VALUES ('a', 3), ('c', 1)) AS t(dataset, version)"


@query(f"SELECT r.dataset, seq, CAST(row_number() OVER (PARTITION BY r.dataset ORDER BY seq) + coalesce(m, 0) AS INT) AS version FROM {_REG.replace('t(', 'r(')} LEFT JOIN (SELECT dataset, max(version) AS m FROM {_OLD} GROUP BY 1) USING (dataset)")
def contract_versions(spark: SparkSession, d: str) -> DataFrame:
    return contracts.assign_versions(values(spark, _REG), values(spark, _OLD)).withColumn("version", F.col("version").cast("int"))


@query("SELECT dataset, version, newest FROM (SELECT o_orderpriority AS dataset, o_orderkey AS version, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey DESC) AS INT) AS newest FROM orders) WHERE newest <= 50")
def contract_history(spark: SparkSession, d: str) -> DataFrame:
    return contracts.contract_history(load(spark, d, "orders").select(F.col("o_orderpriority").alias("dataset"), F.col("o_orderkey").alias("version")))


_HAVE = "(VALUES ('a', 1, 0, 'id', 'integer'), ('a', 2, 0, 'id', 'float'), ('a', 2, 1, 'x', 'string'), ('b', 1, 0, 'k', 'date')) AS t(dataset, version, ordinal, name, dtype)"
_ADD = "(VALUES (9, 0, 'id', 'decimal'), (9, 1, 'y', 'string')) AS t(version, ordinal, name, dtype)"


def _versions(spark: SparkSession) -> DataFrame:
    rest = [F.lit(True).alias("nullable"), F.lit(False).alias("primary_key"), F.lit(1.0).alias("max_null_rate"), F.lit(None).cast("double").alias("min_value"), F.lit(None).cast("double").alias("max_value")]
    return values(spark, _HAVE).select("*", *rest, at("2024-01-01 00:00:00").alias("created_at"))


@query(f"""WITH h AS (SELECT dataset, version, ordinal, name, dtype, TIMESTAMP '2024-01-01 00:00:00' AS created_at FROM {_HAVE}), n AS (SELECT dataset, max(version) + 1 AS version FROM h GROUP BY 1 UNION ALL SELECT 'c', 1)
SELECT * FROM h WHERE dataset IN ('a', 'c') UNION ALL SELECT n.dataset, n.version, t.ordinal, t.name, t.dtype, TIMESTAMP '2024-02-01 00:00:00' FROM n, {_ADD} WHERE n.dataset IN ('a', 'c')""")
def contract_registered(spark: SparkSession, d: str) -> DataFrame:
    """The same columns registered for a dataset with contracts and for a new one; the version they carry is ignored."""
    new = values(spark, _ADD).join(_versions(spark).select("nullable", "primary_key", "max_null_rate", "min_value", "max_value").limit(1))
    out = _versions(spark)
    for dataset in ("a", "c"):
        out = contracts.register_contract(out, dataset, new, at("2024-02-01 00:00:00"))
    return out.where("dataset <> 'b'").select("dataset", "version", "ordinal", "name", "dtype", "created_at")


@query(f"WITH h AS (SELECT * FROM {_HAVE}) SELECT 'latest' AS asked, h.* FROM h WHERE dataset = 'a' AND version = (SELECT max(version) FROM h WHERE dataset = 'a') UNION ALL SELECT 'first', h.* FROM h WHERE dataset = 'a' AND version = 1 UNION ALL SELECT 'none', h.* FROM h WHERE dataset = 'a' AND version = 7")
def contract_of_version(spark: SparkSession, d: str) -> DataFrame:
    v = values(spark, _HAVE)
    asked = {"latest": contracts.get_contract(v, "a"), "first": contracts.get_contract(v, "a", 1), "none": contracts.get_contract(v, "a", 7)}
    parts = [x.select(F.lit(k).alias("asked"), "*") for k, x in asked.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_COLS = """(VALUES ('ok', 0, 'id', 'integer', false, true, 1.0, NULL, NULL), ('ok', 1, 'age', 'integer', true, false, 0.5, 0.0, 150.0),
('bad', 0, '', 'string', true, false, 1.5, NULL, NULL), ('bad', 1, 'k', 'integer', true, true, 1.0, 5.0, 1.0), ('bad', 2, 'k', 'integer', true, false, -0.1, 2.0, 2.0),
('long', 0, 'xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx', 'string', true, false, 1.0, NULL, NULL))
AS t(dataset, ordinal, name, dtype, nullable, primary_key, max_null_rate, min_value, max_value)"""


@query(f"""WITH t AS (SELECT * FROM {_COLS}), g AS (SELECT dataset, count(name) AS n, count(DISTINCT name) AS d FROM t GROUP BY 1)
SELECT dataset, 'column_count_minimum' AS rule, CAST(NULL AS VARCHAR) AS column_name FROM g WHERE n < 1 UNION ALL SELECT dataset, 'column_count_maximum', NULL FROM g WHERE n > 1000 UNION ALL SELECT dataset, 'unique_column_names', NULL FROM g WHERE d < n
UNION ALL SELECT dataset, 'column_name_length_minimum', name FROM t WHERE length(name) < 1 UNION ALL SELECT dataset, 'column_name_length_maximum', name FROM t WHERE length(name) > 128
UNION ALL SELECT dataset, 'primary_key_non_nullable', name FROM t WHERE primary_key AND nullable UNION ALL SELECT dataset, 'max_null_rate_range', name FROM t WHERE max_null_rate < 0 OR max_null_rate > 1 UNION ALL SELECT dataset, 'min_max_value_ordering', name FROM t WHERE min_value > max_value""")
def contract_rule_violations(spark: SparkSession, d: str) -> DataFrame:
    return contracts.rule_violations(values(spark, _COLS), ["dataset"])


_CONTRACT = """(VALUES (0, 'l_orderkey', 'integer', false, true), (1, 'l_comment', 'string', true, false), (2, 'l_quantity', 'decimal', true, false), (3, 'l_tax', 'float', false, false), (4, 'L_TAX', 'float', false, false), (5, 'l_shipdate', 'date', true, false))
AS t(ordinal, name, dtype, nullable, primary_key)"""
_SEEN = """(VALUES (0, 'l_orderkey', 'integer', true), (1, 'l_partkey', 'integer', true), (2, 'l_suppkey', 'integer', true), (3, 'l_linenumber', 'integer', true), (4, 'l_quantity', 'float', true), (5, 'l_extendedprice', 'float', true),
(6, 'l_discount', 'float', true), (7, 'l_tax', 'float', true), (8, 'l_returnflag', 'string', true), (9, 'l_linestatus', 'string', true), (10, 'l_shipdate', 'timestamp', true)) AS t(ordinal, name, dtype, nullable)"""


@query(f"""WITH c AS (SELECT * FROM {_CONTRACT}), o AS (SELECT * FROM {_SEEN}), e AS (
SELECT 0 AS grp, c.ordinal * 2 AS place, name AS column_name, 'missing ' || CASE WHEN primary_key OR NOT nullable THEN 'required' ELSE 'optional' END || ' column ''' || name || '''' AS error FROM c WHERE name NOT IN (SELECT name FROM o)
UNION ALL SELECT 1, o.ordinal * 2, c.name, 'column ''' || c.name || ''' is ' || o.dtype || ', not ' || c.dtype FROM c JOIN o USING (name) WHERE c.dtype <> o.dtype
UNION ALL SELECT 1, o.ordinal * 2 + 1, c.name, 'column ''' || c.name || ''' may be null' FROM c JOIN o USING (name) WHERE NOT c.nullable AND o.nullable)
SELECT column_name, error, CAST(row_number() OVER (ORDER BY grp, place) AS INT) AS position FROM e""")
def validate_lineitem(spark: SparkSession, d: str) -> DataFrame:
    return contracts.validation_errors(values(spark, _CONTRACT), contracts.observed_columns(load(spark, d, "lineitem")))


@query(f"SELECT name, primary_key OR NOT nullable AS required FROM {_CONTRACT}")
def contract_required(spark: SparkSession, d: str) -> DataFrame:
    return values(spark, _CONTRACT).select("name", contracts.is_required().alias("required"))


# --- drift --------------------------------------------------------------------------------------------------------

_ORDERS = """(VALUES (0, 'o_orderkey', 'integer', false, true), (1, 'o_comment', 'string', false, false), (2, 'o_totalprice', 'decimal', true, false), (3, 'o_orderstatus', 'integer', true, false), (4, 'o_clerk', 'string', true, false), (5, 'o_orderdate', 'date', true, false))
AS t(ordinal, name, dtype, nullable, primary_key)"""
_ORDERS_SEEN = """(VALUES (0, 'o_orderkey', 'integer', true), (1, 'o_custkey', 'integer', true), (2, 'o_orderstatus', 'string', true), (3, 'o_totalprice', 'float', true), (4, 'o_orderdate', 'timestamp', true), (5, 'o_orderpriority', 'string', true)) AS t(ordinal, name, dtype, nullable)"""
_WIDTH = "CASE {} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in TYPE_WIDTH.items()) + " END"


def _drift_sql(contract: str, seen: str) -> str:
    a, b = _WIDTH.format("c.dtype"), _WIDTH.format("o.dtype")
    return f"""WITH c AS (SELECT * FROM {contract}), o AS (SELECT * FROM {seen}), drift AS (
SELECT 0 AS grp, c.ordinal * 2 AS place, name AS column_name, 'column_removed' AS drift_type, CASE WHEN primary_key OR NOT nullable THEN 'critical' ELSE 'warning' END AS severity, dtype AS old_value, CAST(NULL AS VARCHAR) AS new_value FROM c WHERE name NOT IN (SELECT name FROM o)
UNION ALL SELECT 1, o.ordinal * 2, name, 'column_added', 'info', NULL, dtype FROM o WHERE name NOT IN (SELECT name FROM c)
UNION ALL SELECT 2, c.ordinal * 2, c.name, 'type_changed', CASE WHEN {a} IS NULL OR {b} IS NULL OR {b} < {a} THEN 'critical' ELSE 'warning' END, c.dtype, o.dtype FROM c JOIN o USING (name) WHERE c.dtype <> o.dtype
UNION ALL SELECT 2, c.ordinal * 2 + 1, c.name, 'nullability_changed', CASE WHEN o.nullable THEN 'critical' ELSE 'warning' END, CASE WHEN c.nullable THEN 'True' ELSE 'False' END, CASE WHEN o.nullable THEN 'True' ELSE 'False' END FROM c JOIN o USING (name) WHERE c.nullable <> o.nullable)"""


@query(_drift_sql(_ORDERS, _ORDERS_SEEN) + " SELECT column_name, drift_type, severity, old_value, new_value, CAST(row_number() OVER (ORDER BY grp, place) AS INT) AS position, CAST(0 AS BIGINT) AS affected_downstream FROM drift")
def drift_orders(spark: SparkSession, d: str) -> DataFrame:
    return contracts.schema_drift(values(spark, _ORDERS), contracts.observed_columns(load(spark, d, "orders")))


@query(_drift_sql(_ORDERS, _ORDERS_SEEN) + " SELECT CASE max(CASE severity WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END AS overall_severity, bool_and(severity = 'info') AS auto_evolvable, bool_or(severity = 'critical') AS requires_human_review, count(*) AS changes FROM drift")
def drift_rollup(spark: SparkSession, d: str) -> DataFrame:
    return contracts.drift_rollup(contracts.schema_drift(values(spark, _ORDERS), contracts.observed_columns(load(spark, d, "orders"))))


_SAME = _ORDERS_SEEN.replace("(VALUES", "(SELECT *, false AS primary_key FROM (VALUES", 1) + ")"


@query(_drift_sql(_SAME, _ORDERS_SEEN) + " SELECT CASE coalesce(max(CASE severity WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 END), 0) WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END AS overall_severity, coalesce(bool_and(severity = 'info'), true) AS auto_evolvable, coalesce(bool_or(severity = 'critical'), false) AS requires_human_review, count(*) AS changes FROM drift")
def drift_none(spark: SparkSession, d: str) -> DataFrame:
    seen = contracts.observed_columns(load(spark, d, "orders"))
    return contracts.drift_rollup(contracts.schema_drift(seen, seen))


_TYPES = "(VALUES " + ", ".join(f"('{t}')" for t in TYPES) + ")"


@query(f"""SELECT c.dtype AS old_value, o.dtype AS new_value, CASE WHEN {_WIDTH.format("c.dtype")} IS NULL OR {_WIDTH.format("o.dtype")} IS NULL OR {_WIDTH.format("o.dtype")} < {_WIDTH.format("c.dtype")} THEN 'critical' ELSE 'warning' END AS severity
FROM {_TYPES} AS c(dtype), {_TYPES} AS o(dtype) WHERE c.dtype <> o.dtype""")
def drift_type_matrix(spark: SparkSession, d: str) -> DataFrame:
    pairs = [(i * 11 + j, f"{a}_{b}", a, b) for i, a in enumerate(TYPES) for j, b in enumerate(TYPES)]
    row = lambda k, n, t: (k, n, t, True, False)
    shape = "ordinal int, name string, dtype string, nullable boolean, primary_key boolean"
    c = spark.createDataFrame([row(k, n, a) for k, n, a, _ in pairs], shape)
    o = spark.createDataFrame([row(k, n, b) for k, n, _, b in pairs], shape)
    return contracts.schema_drift(c, o).select("old_value", "new_value", "severity")


@query(_drift_sql(_ORDERS, _ORDERS_SEEN) + " SELECT 'strict' AS rule, count(*) = 0 AS allowed FROM drift UNION ALL SELECT 'additive', count(*) = 0 FROM drift WHERE drift_type <> 'column_added' UNION ALL SELECT 'permissive', count(*) = 0 FROM drift WHERE severity = 'critical'")
def drift_policies(spark: SparkSession, d: str) -> DataFrame:
    found = contracts.schema_drift(values(spark, _ORDERS), contracts.observed_columns(load(spark, d, "orders")))
    a, b, c = (contracts.evolution_allowed(found, r) for r in ("strict", "additive", "permissive"))
    return a.unionByName(b).unionByName(c)


# --- freshness ----------------------------------------------------------------------------------------------------

_SLA = "(VALUES ('click', 3600, 0.8, 0.9), ('view', 36000, 0.5, 0.9), ('purchase', 1800, 0.8, 0.9), ('absent', 600, 0.8, 0.9)) AS t(dataset, max_staleness_seconds, warning_threshold, critical_threshold)"


def _slas(spark: SparkSession, rows: str = _SLA) -> DataFrame:
    return values(spark, rows).select("dataset", F.col("max_staleness_seconds").cast("int").alias("max_staleness_seconds"), *[F.col(c).cast("double").alias(c) for c in ("warning_threshold", "critical_threshold")])


_JUDGE = """stale AS (SELECT *, CASE WHEN last_updated IS NULL THEN CAST(max_staleness_seconds AS DOUBLE) ELSE greatest(0, date_diff('microsecond', last_updated, check_time) / 1000000) END AS s FROM met),
raw AS (SELECT *, CASE WHEN last_updated IS NULL THEN 2.0 ELSE least(s / max_staleness_seconds, 2.0) END AS pct, CASE WHEN last_updated IS NULL OR s > CAST(critical_threshold AS DOUBLE) * max_staleness_seconds THEN 2 WHEN s > CAST(warning_threshold AS DOUBLE) * max_staleness_seconds THEN 1 ELSE 0 END AS r FROM stale)"""
_NAME = "CASE {} WHEN 0 THEN 'healthy' WHEN 1 THEN 'warning' ELSE 'critical' END"


def _log_sql(arrivals: str, checks: str, slas: str) -> str:
    return f"""WITH log AS (SELECT dataset, seq, ts AS arrived, CAST(NULL AS TIMESTAMP) AS check_time FROM ({arrivals}) UNION ALL SELECT dataset, seq, NULL, ts FROM ({checks})),
l AS (SELECT *, last_value(arrived IGNORE NULLS) OVER w AS last_updated, count(arrived) OVER w AS epoch FROM log WINDOW w AS (PARTITION BY dataset ORDER BY seq ROWS UNBOUNDED PRECEDING)),
met AS (SELECT * FROM l JOIN {slas.replace(' t(', ' s(')} USING (dataset) WHERE check_time IS NOT NULL), {_JUDGE}
SELECT dataset, seq, check_time, last_updated, round(s, 3) AS staleness_seconds, round(pct, 3) AS sla_consumed_pct, {_NAME.format('max(r) OVER (PARTITION BY dataset, epoch ORDER BY seq ROWS UNBOUNDED PRECEDING)')} AS status FROM raw"""


_NOW = f"SELECT dataset, (SELECT 2 * max(event_id) + 2 FROM events) AS seq, TIMESTAMP '2024-01-31 00:30:00' AS ts FROM {_SLA.replace(' t(', ' q(')}"
_EARLY = "SELECT event_type AS dataset, event_id * 2 + 1 AS seq, ts + INTERVAL 3 HOUR AS ts FROM events"


@query(_log_sql("SELECT event_type AS dataset, event_id * 2 AS seq, ts FROM events", f"{_EARLY} UNION ALL {_NOW}", _SLA).replace("SELECT dataset, seq, check_time", "SELECT * EXCLUDE (seq) FROM (SELECT dataset, seq, check_time") + ") WHERE seq > (SELECT 2 * max(event_id) + 1 FROM events)")
def sla_all(spark: SparkSession, d: str) -> DataFrame:
    """One check of every dataset now; the last event's own check, three hours ahead, left a status that can't improve."""
    e = load(spark, d, "events").select(F.col("event_type").alias("dataset"), (F.col("event_id") * 2).alias("seq"), F.col("ts").alias("at"))
    checks = e.select("dataset", (F.col("seq") + 1).alias("seq"), (F.col("at") + F.expr("INTERVAL 3 HOURS")).alias("at"))
    return rounded(freshness.current_status(e, checks, _slas(spark), at("2024-01-31 00:30:00")), 3)


@query(f"SELECT event_type AS dataset, count(*) AS checks, 'no service level is registered for ' || event_type AS error FROM events WHERE event_type NOT IN (SELECT dataset FROM {_SLA}) GROUP BY 1")
def sla_missing(spark: SparkSession, d: str) -> DataFrame:
    checks = load(spark, d, "events").select(F.col("event_type").alias("dataset"), F.col("event_id").alias("seq"), F.col("ts").alias("at"))
    return freshness.unregistered_checks(checks, _slas(spark))


@query(f"""WITH g AS (SELECT s.*, g AS check_time FROM {_SLA.replace(' t(', ' s(')}, generate_series(TIMESTAMP '2024-01-05 00:00:00', TIMESTAMP '2024-01-07 00:00:00', INTERVAL 20 MINUTE) AS r(g)),
met AS (SELECT g.*, (SELECT max(ts) FROM events WHERE event_type = g.dataset AND ts <= g.check_time) AS last_updated FROM g), {_JUDGE}
SELECT dataset, check_time AS at, round(s, 3) AS staleness_seconds, round(pct, 3) AS sla_consumed_pct, CAST(warning_threshold AS DOUBLE) AS warning_line, 1.0::DOUBLE AS breach_line FROM raw""")
def staleness_history(spark: SparkSession, d: str) -> DataFrame:
    arrivals = load(spark, d, "events").select(F.col("event_type").alias("dataset"), F.col("ts").alias("at"))
    return rounded(freshness.staleness_over_time(arrivals, _slas(spark), at("2024-01-05 00:00:00"), at("2024-01-07 00:00:00"), F.expr("INTERVAL 20 MINUTES")), 3)


@query(_log_sql("SELECT event_type AS dataset, event_id * 2 + 1 AS seq, ts FROM events", "SELECT event_type AS dataset, event_id * 2 AS seq, ts FROM events", _SLA))
def freshness_monotonic(spark: SparkSession, d: str) -> DataFrame:
    """Every event is a check of its dataset and then an arrival; the other way round each check would see itself and be fresh."""
    e = load(spark, d, "events").select(F.col("event_type").alias("dataset"), (F.col("event_id") * 2).alias("seq"), F.col("ts").alias("at"))
    return rounded(freshness.check_freshness(e.withColumn("seq", F.col("seq") + 1), e.join(_slas(spark), "dataset", "left_semi"), _slas(spark)), 3)


_ARR = "(VALUES ('o', 1, TIMESTAMP '2024-01-01 00:00:00'), ('o', 6, TIMESTAMP '2023-12-31 23:00:00'), ('r', 1, TIMESTAMP '2024-01-01 00:00:00'), ('r', 5, TIMESTAMP '2024-01-01 00:58:20')) AS t(dataset, seq, ts)"
_CHK = """(VALUES ('o', 2, TIMESTAMP '2024-01-01 00:48:00'), ('o', 3, TIMESTAMP '2024-01-01 00:54:00'), ('o', 4, TIMESTAMP '2024-01-01 00:54:00.5'), ('o', 5, TIMESTAMP '2024-01-01 00:10:00'), ('o', 7, TIMESTAMP '2024-01-01 00:00:00'),
('r', 2, TIMESTAMP '2024-01-01 00:01:40'), ('r', 3, TIMESTAMP '2024-01-01 00:58:19'), ('r', 4, TIMESTAMP '2024-01-01 00:01:00'), ('r', 6, TIMESTAMP '2024-01-01 00:58:21'), ('n', 1, TIMESTAMP '2024-01-01 00:00:00')) AS t(dataset, seq, ts)"""
_SMALL = "(VALUES ('o', 3600, 0.8, 0.9), ('r', 3600, 0.8, 0.9), ('n', 7200, 0.8, 0.9)) AS t(dataset, max_staleness_seconds, warning_threshold, critical_threshold)"


@query(_log_sql(f"SELECT * FROM {_ARR}", f"SELECT * FROM {_CHK}", _SMALL))
def freshness_boundary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(freshness.check_freshness(values(spark, _ARR).withColumnRenamed("ts", "at"), values(spark, _CHK).withColumnRenamed("ts", "at"), _slas(spark, _SMALL)), 3)


_BAD_SLA = "(VALUES ('a', 0, 0.8, 0.9), ('b', 2592001, 0.8, 0.9), ('c', 60, 0.9, 0.8), ('d', 60, 0.8, 1.1), ('e', 2592000, 0.8, 1.0), ('f', 60, 0.0, 0.5)) AS t(dataset, max_staleness_seconds, warning_threshold, critical_threshold)"


@query(f"SELECT dataset, reason FROM (SELECT dataset, CASE WHEN max_staleness_seconds NOT BETWEEN 1 AND 2592000 THEN 'max_staleness_range' WHEN NOT (warning_threshold > 0 AND warning_threshold < critical_threshold AND critical_threshold <= 1) THEN 'threshold_order' END AS reason FROM {_BAD_SLA}) WHERE reason IS NOT NULL")
def sla_violations(spark: SparkSession, d: str) -> DataFrame:
    return freshness.sla_violations(_slas(spark, _BAD_SLA))


@query(_log_sql(f"SELECT * FROM {_ARR}", f"SELECT * FROM {_CHK}", _SMALL) + " QUALIFY dataset = 'o'")
def freshness_history(spark: SparkSession, d: str) -> DataFrame:
    """One dataset's checks as they were made, among them one that looks back in time."""
    checked = freshness.check_freshness(values(spark, _ARR).withColumnRenamed("ts", "at"), values(spark, _CHK).withColumnRenamed("ts", "at"), _slas(spark, _SMALL))
    return rounded(freshness.check_history(checked, "o"), 3)


_TWICE = "(VALUES ('a', 1, 60), ('a', 2, 90), ('b', 3, 30)) AS t(dataset, seq, max_staleness_seconds)"


@query(f"SELECT dataset, max_by(max_staleness_seconds, seq) AS max_staleness_seconds FROM {_TWICE} GROUP BY dataset")
def sla_registered(spark: SparkSession, d: str) -> DataFrame:
    return freshness.registered(values(spark, _TWICE))


_MAINT = "(VALUES ('click', TIMESTAMP '2024-01-10 00:00:00', TIMESTAMP '2024-01-12 00:00:00'), ('view', TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-02 00:00:00')) AS t(dataset, starts, ends)"


@query(f"SELECT event_id, event_type AS dataset, ts AS check_time FROM events e WHERE NOT EXISTS (SELECT 1 FROM {_MAINT.replace(' t(', ' m(')} WHERE m.dataset = e.event_type AND e.ts >= starts AND e.ts < ends)")
def freshness_maintenance(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").select("event_id", F.col("event_type").alias("dataset"), F.col("ts").alias("check_time"))
    return freshness.suppressed_by_maintenance(e, values(spark, _MAINT))


@query("""WITH a AS (SELECT event_type AS dataset, event_id, ts, date_diff('microsecond', lag(ts) OVER w, ts) / 1000000 AS gap, count(*) OVER (PARTITION BY event_type) - row_number() OVER w AS back, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id))
SELECT dataset, max_by(ts, event_id) AS last_arrival, round(sum(CASE WHEN i = 2 THEN 1 ELSE 0.3 END * pow(0.7, back) * gap), 2) AS smoothed_gap_seconds FROM a GROUP BY dataset""")
def arrival_prediction(spark: SparkSession, d: str) -> DataFrame:
    """Its SQL is the closed weighted sum, as a recursion would take a step an event."""
    e = load(spark, d, "events").select(F.col("event_type").alias("dataset"), F.col("event_id").alias("seq"), F.col("ts").alias("at"))
    return rounded(freshness.predicted_arrival(e), 2)


# --- lineage ------------------------------------------------------------------------------------------------------

_EDGES = """(VALUES ('raw.a:v1:id', 'st.b:v1:source_id', 'direct', 'p1', 1.0, 1), ('raw.a:v1:id', 'st.b:v1:alt_id', 'direct', 'p1', 0.9, 2), ('st.b:v1:source_id', 'dw.c:v1:final_id', 'derived', 'p2', 0.7, 3),
('st.b:v1:alt_id', 'dw.c:v1:final_id', 'derived', 'p3', 0.9, 4), ('dw.c:v1:final_id', 'bi.d:v2:kpi', 'aggregated', 'p4', 1.0, 5), ('dw.c:v1:final_id', 'bi.d:v1:kpi', 'aggregated', 'p4', 0.5, 6), ('bi.d:v2:kpi', 'bi.e:v1:tile', 'direct', 'p5', 1.0, 7),
('raw.z:v1:x', 'st.b:v1:alt_id', 'joined', 'p6', 0.9, 8), ('raw.a:v1:id', 'st.b:v1:alt_id', 'direct', 'p7', 1.0, 9)) AS t(src, dst, transformation_type, pipeline_id, confidence, edge_seq)"""
_NODES = "(VALUES ('raw.a:v1:id'), ('st.b:v1:source_id'), ('st.b:v1:alt_id'), ('dw.c:v1:final_id'), ('bi.d:v1:kpi'), ('bi.d:v2:kpi'), ('bi.e:v1:tile'), ('raw.z:v1:x')) AS t(node)"


def _edges(spark: SparkSession) -> DataFrame:
    return values(spark, _EDGES).withColumn("confidence", F.col("confidence").cast("double"))


def _node(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "node string")


def _walk(root: str, depth: int, src: str = "src", dst: str = "dst") -> str:
    return f"WITH RECURSIVE e AS (SELECT * FROM {_EDGES}), w AS (SELECT '{root}' AS node, 0 AS level UNION SELECT {dst}, level + 1 FROM w JOIN e ON e.{src} = w.node WHERE level < {depth}), m AS (SELECT node, min(level) AS level FROM w GROUP BY node)"


@query(_walk("raw.a:v1:id", 10) + " SELECT node, level FROM m WHERE level > 0")
def lineage_impact(spark: SparkSession, d: str) -> DataFrame:
    return lineage.downstream(_edges(spark), _node(spark, "raw.a:v1:id"), 10).select("node", "level")


@query(f"""WITH RECURSIVE e AS (SELECT src, dst, [split_part(dst, ':', 1), split_part(dst, ':', 3), lpad(CAST(edge_seq AS VARCHAR), 9, '0')] AS k FROM {_EDGES}),
w AS (SELECT 'raw.a:v1:id' AS node, 0 AS level, CAST([] AS VARCHAR[]) AS way UNION ALL SELECT dst, level + 1, list_concat(way, k) FROM w JOIN e ON e.src = w.node WHERE level < 10),
f AS (SELECT node, level, way FROM (SELECT *, min(level) OVER (PARTITION BY node) AS l FROM (SELECT node, level, min(way) AS way FROM w GROUP BY node, level)) WHERE level = l)
SELECT node, level, CAST(row_number() OVER (PARTITION BY level ORDER BY way) AS INT) AS ord FROM f WHERE level > 0""")
def lineage_impact_order(spark: SparkSession, d: str) -> DataFrame:
    return lineage.downstream(_edges(spark), _node(spark, "raw.a:v1:id"), 10).select("node", "level", F.col("ord").cast("int").alias("ord"))


@query(_walk("raw.a:v1:id", 2) + " SELECT node, level FROM m WHERE level > 0")
def lineage_impact_depth(spark: SparkSession, d: str) -> DataFrame:
    return lineage.downstream(_edges(spark), _node(spark, "raw.a:v1:id"), 2).select("node", "level")


@query(_walk("bi.e:v1:tile", 10, "dst", "src") + " SELECT node, level FROM m WHERE level > 0")
def lineage_upstream(spark: SparkSession, d: str) -> DataFrame:
    return lineage.upstream(_edges(spark), _node(spark, "bi.e:v1:tile")).select("node", "level")


@query(_walk("raw.a:v1:id", 3) + " SELECT DISTINCT pipeline_id FROM e JOIN m ON e.src = m.node WHERE level < 3")
def lineage_pipelines(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark)
    return lineage.impact_pipelines(e, lineage.downstream(e, _node(spark, "raw.a:v1:id"), 3), "raw.a:v1:id", 3)


@query(_walk("raw.a:v1:id", 10) + " SELECT DISTINCT regexp_replace(node, ':[^:]*$', '') AS dataset FROM m WHERE level > 0")
def lineage_datasets(spark: SparkSession, d: str) -> DataFrame:
    found = lineage.downstream(_edges(spark), _node(spark, "raw.a:v1:id"), 10)
    return lineage.affected_datasets(found).select("dataset")


_NEW = "(VALUES ('bi.e:v1:tile', 'raw.a:v1:id'), ('raw.a:v1:id', 'raw.a:v1:id'), ('raw.z:v1:x', 'bi.e:v1:tile'), ('dw.c:v1:final_id', 'raw.z:v1:x')) AS t(src, dst)"


@query(f"""WITH RECURSIVE e AS (SELECT * FROM {_EDGES}), n AS (SELECT * FROM {_NEW}), w AS (SELECT dst AS root, dst AS node FROM n UNION SELECT root, e.dst FROM w JOIN e ON e.src = w.node)
SELECT DISTINCT n.src, n.dst FROM n JOIN w ON w.root = n.dst AND w.node = n.src""")
def lineage_cycle_candidates(spark: SparkSession, d: str) -> DataFrame:
    return lineage.reachable(_edges(spark), values(spark, _NEW))


_WANTED = "(VALUES ('raw.a:v1:id'), ('raw.a:v2:id'), ('gone:v1:x'), ('gone:v1:x')) AS t(node)"


@query(f"SELECT DISTINCT node FROM {_WANTED} WHERE node NOT IN (SELECT node FROM {_NODES.replace(' t(', ' n(')})")
def lineage_missing(spark: SparkSession, d: str) -> DataFrame:
    return lineage.missing_nodes(values(spark, _WANTED), values(spark, _NODES))


@query("SELECT s AS src, t AS dst, 'derived' AS transformation_type FROM (VALUES ('a'), ('b')) AS x(s), (VALUES ('c'), ('d'), ('e')) AS y(t)")
def lineage_transformation(spark: SparkSession, d: str) -> DataFrame:
    row = spark.createDataFrame([(["a", "b"], ["c", "d", "e"], "derived")], "sources array<string>, targets array<string>, transformation_type string")
    return lineage.transformation_edges(row)


_HOW = "(SELECT p_partkey, ['parsed_sql', 'schema_name_matching', 'data_type_matching', 'heuristic', 'other'][p_partkey % 5 + 1] AS method FROM part)"


@query(f"SELECT method, count(*) AS edges, CASE method WHEN 'parsed_sql' THEN 1.0 WHEN 'schema_name_matching' THEN 0.9 WHEN 'data_type_matching' THEN 0.7 WHEN 'heuristic' THEN 0.5 END::DOUBLE AS confidence FROM {_HOW} GROUP BY 1")
def lineage_confidence(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("parsed_sql", "schema_name_matching", "data_type_matching", "heuristic", "other")])
    v = load(spark, d, "part").select(F.get(names, (F.col("p_partkey") % 5).cast("int")).alias("method"))
    return v.groupBy("method").agg(F.count(F.lit(1)).alias("edges")).withColumn("confidence", lineage.confidence_of(F.col("method")))


@query(f"SELECT DISTINCT node FROM (SELECT node FROM {_NODES} UNION ALL SELECT src FROM {_EDGES} UNION ALL SELECT unnest(['raw.a:v1:id', 'new.f:v1:c']))")
def lineage_add_edge_nodes(spark: SparkSession, d: str) -> DataFrame:
    """An edge to a column not known yet makes its node; one that is known stays one node."""
    nodes, edges = lineage.add_edge(values(spark, _NODES), _edges(spark), "raw.a:v1:id", "new.f:v1:c", "direct", "p9")
    return lineage.existing_nodes(nodes, edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct())


@query(f"SELECT src, dst, edge_seq FROM {_EDGES} UNION ALL SELECT 'raw.z:v1:x', unnest(['dw.c:v1:final_id', 'bi.d:v1:kpi']), max(edge_seq) + unnest([1, 2]) FROM {_EDGES}")
def lineage_register(spark: SparkSession, d: str) -> DataFrame:
    out = lineage.register(spark, values(spark, _NODES), _edges(spark), ["raw.z:v1:x"], ["dw.c:v1:final_id", "bi.d:v1:kpi"], "joined", "p8", "someone", "schema_name_matching")
    return out.select("src", "dst", F.col("edge_seq").cast("int").alias("edge_seq"))


@query(f"""WITH RECURSIVE e AS (SELECT * FROM {_EDGES}), w AS (SELECT 'st.b:v1:alt_id' AS node, ['st.b:v1:alt_id'] AS way, [0] AS k UNION ALL SELECT dst, list_append(way, dst), list_append(k, edge_seq) FROM w JOIN e ON e.src = w.node),
f AS (SELECT way FROM w WHERE node = 'bi.e:v1:tile' ORDER BY len(way), k LIMIT 1), c AS (SELECT list_concat(['bi.e:v1:tile'], list_concat(way[2:-2], [way[1]])) AS c FROM f)
SELECT CAST(p AS INT) AS position, split_part(c[p], ':', 1) || '.' || split_part(c[p], ':', 3) AS name FROM c, range(1, 10) AS r(p) WHERE p <= len(c)""")
def lineage_cycle_path(spark: SparkSession, d: str) -> DataFrame:
    return lineage.cycle_path(_edges(spark), "bi.e:v1:tile", "st.b:v1:alt_id")


@query(f"SELECT e.src, e.dst, edge_seq FROM {_EDGES.replace(' t(', ' e(')} WHERE e.src = 'dw.c:v1:final_id' OR e.dst = 'dw.c:v1:final_id'")
def lineage_adjacent(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark)
    return lineage.edges_from(e, "dw.c:v1:final_id").unionByName(lineage.edges_to(e, "dw.c:v1:final_id")).select("src", "dst", "edge_seq")


@query(f"SELECT src, dst, edge_seq FROM {_EDGES} WHERE NOT (src = 'raw.a:v1:id' AND dst = 'st.b:v1:alt_id')")
def lineage_remove_edge(spark: SparkSession, d: str) -> DataFrame:
    return lineage.remove_edge(_edges(spark), "raw.a:v1:id", "st.b:v1:alt_id")[0].select("src", "dst", "edge_seq")


# a larger graph: parts feed parts of half their key, so depth grows with the logarithm of the table
_PARTS = "SELECT CAST(p_partkey // 2 AS VARCHAR) AS src, CAST(p_partkey AS VARCHAR) AS dst FROM part WHERE p_partkey > 1"


@query(f"WITH RECURSIVE e AS ({_PARTS}), w AS (SELECT node AS root, node FROM (VALUES ('2'), ('7'), ('100'), ('9999999')) AS r(node) UNION SELECT root, e.dst FROM w JOIN e ON e.src = w.node) SELECT root, count(*) - 1 AS affected FROM w GROUP BY root")
def lineage_downstream_counts(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "part").where("p_partkey > 1").select(F.expr("cast(p_partkey div 2 as string)").alias("src"), F.col("p_partkey").cast("string").alias("dst"), F.col("p_partkey").alias("edge_seq"))
    return lineage.downstream_counts(e, _node(spark, "2", "7", "100", "9999999"))


@query(f"""WITH RECURSIVE e AS (SELECT src, dst, CAST(confidence AS DOUBLE) AS c FROM {_EDGES}), w AS (SELECT 'bi.e:v1:tile' AS node, 0 AS hops, CAST(1 AS DOUBLE) AS c UNION ALL SELECT src, hops + 1, w.c * e.c FROM w JOIN e ON e.dst = w.node),
m AS (SELECT node, hops, max(c) AS c, min(hops) OVER (PARTITION BY node) AS h FROM w GROUP BY node, hops) SELECT 'bi.e:v1:tile' AS root, node, hops, round(c, 4) AS confidence FROM m WHERE hops = h AND hops > 0""")
def lineage_root_causes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lineage.root_causes(_edges(spark), _node(spark, "bi.e:v1:tile")))
