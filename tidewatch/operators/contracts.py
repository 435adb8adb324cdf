"""Schema contracts: rules, versions, validation, drift.

A contract's columns are rows (dataset, ordinal, name, dtype, nullable, primary_key, max_null_rate, min_value, max_value, ...). Names are
compared as values, so case matters whatever the session's setting. Tables of columns are small; Spark broadcasts them
by their size where it can.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions.expressions import SEVERITIES, named, severity_rank, type_width
from tidewatch.operators.profile import declared_type

FEWEST_COLUMNS, MOST_COLUMNS = 1, 1000
SHORTEST_NAME, LONGEST_NAME = 1, 128
CONTRACT_SCHEMA = "ordinal int, name string, dtype string, nullable boolean, primary_key boolean, `unique` boolean, min_value double, max_value double, allowed_values array<string>, pattern string, max_null_rate double"


class ContractError(ValueError):
    """A contract breaks a rule; ``violated_rule`` is its code."""

    def __init__(self, violated_rule: str, message: str):
        super().__init__(message)
        self.violated_rule = violated_rule


def observed_columns(df: DataFrame) -> DataFrame:
    """The schema of a table as contract rows; no job runs."""
    rows = [(i, f.name, declared_type(f.dataType), f.nullable, False, False, None, None, None, None, 1.0) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, CONTRACT_SCHEMA)


def contract_columns(spark: SparkSession, columns: list[dict]) -> DataFrame:
    """Contract rows from plain mappings; a primary key is never nullable, whatever is said."""
    rows = []
    for i, c in enumerate(columns):
        key = bool(c.get("primary_key", False))
        rows.append((i, c["name"], c["dtype"], bool(c.get("nullable", True)) and not key, key, bool(c.get("unique", False)), c.get("min_value"), c.get("max_value"), c.get("allowed_values"), c.get("pattern"), float(c.get("max_null_rate", 1.0))))
    return spark.createDataFrame(rows, CONTRACT_SCHEMA)


def rule_violations(columns: DataFrame, by: list[str] | None = None) -> DataFrame:
    """rule, column_name of every broken rule of contracts' columns, grouped by ``by``."""
    by = by or []
    whole = columns.groupBy(*by).agg(F.count("name").alias("n"), F.count_distinct("name").alias("d"))
    rule = lambda df, cond, code, name=F.lit(None).cast("string"): df.where(cond).select(*by, F.lit(code).alias("rule"), name.alias("column_name"))
    name = F.col("name")
    found = [
        rule(whole, F.col("n") < FEWEST_COLUMNS, "column_count_minimum"),
        rule(whole, F.col("n") > MOST_COLUMNS, "column_count_maximum"),
        rule(whole, F.col("d") < F.col("n"), "unique_column_names"),
        rule(columns, F.length("name") < SHORTEST_NAME, "column_name_length_minimum", name),
        rule(columns, F.length("name") > LONGEST_NAME, "column_name_length_maximum", name),
        rule(columns, F.col("primary_key") & F.col("nullable"), "primary_key_non_nullable", name),
        rule(columns, (F.col("max_null_rate") < 0) | (F.col("max_null_rate") > 1), "max_null_rate_range", name),
        rule(columns, F.col("min_value") > F.col("max_value"), "min_max_value_ordering", name),
    ]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def check_contract(columns: DataFrame) -> None:
    """Raise the first broken rule."""
    broken = rule_violations(columns).limit(1).collect()
    if broken:
        raise ContractError(broken[0].rule, f"{broken[0].rule}: {broken[0].column_name or 'contract'}")


def assign_versions(registrations: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """registrations (dataset, seq) with ``version``: after the latest of the dataset, in order of seq; a version given is ignored."""
    order = Window.partitionBy("dataset").orderBy("seq")
    out = registrations.drop("version").withColumn("version", F.row_number().over(order))
    if existing is not None:
        last = existing.groupBy("dataset").agg(F.max("version").alias("_last"))
        out = out.join(last, "dataset", "left").withColumn("version", F.col("version") + F.coalesce("_last", F.lit(0))).drop("_last")
    return out


def contract_history(versions: DataFrame, limit: int = 50) -> DataFrame:
    """The newest ``limit`` versions of each dataset, with ``newest`` = 1 for the latest."""
    order = Window.partitionBy("dataset").orderBy(F.desc("version"))
    return versions.withColumn("newest", F.row_number().over(order)).where(F.col("newest") <= limit)


def latest_contract(versions: DataFrame) -> DataFrame:
    return contract_history(versions, 1).drop("newest")


def get_contract(versions: DataFrame, dataset: str, version: int | None = None) -> DataFrame:
    """The columns of a dataset's contract: of one version, or of the latest. ``versions``: rows of contracts' columns with dataset and version."""
    own = versions.where(F.col("dataset") == dataset)
    if version is not None:
        return own.where(F.col("version") == version)
    return own.join(own.agg(F.max("version").alias("version")), "version").select(*versions.columns)


def register_contract(versions: DataFrame, dataset: str, columns: DataFrame, created_at: Column | None = None) -> DataFrame:
    """``versions`` with the contract appended: its rules checked, numbered after the dataset's latest version and stamped.

    Raises ``ContractError`` with the first broken rule and changes nothing. A version that the columns carry is ignored.
    """
    check_contract(columns)
    last = versions.where(F.col("dataset") == dataset).agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first().v
    new = columns.drop("dataset", "version", "created_at").select(F.lit(dataset).alias("dataset"), F.lit(int(last) + 1).alias("version"), "*", (F.current_timestamp() if created_at is None else created_at).alias("created_at"))
    return versions.unionByName(new, allowMissingColumns=True)


def is_required() -> Column:
    return F.col("primary_key") | ~F.col("nullable")


def _paired(contract: DataFrame, observed: DataFrame, by: list[str]) -> DataFrame:
    c = contract.select(*by, "name", F.col("ordinal").alias("c_ord"), F.col("dtype").alias("c_type"), F.col("nullable").alias("c_null"), F.col("primary_key").alias("c_pk"))
    o = observed.select(*by, "name", F.col("ordinal").alias("o_ord"), F.col("dtype").alias("o_type"), F.col("nullable").alias("o_null"))
    return c.join(o, [*by, "name"], "full")


def validation_errors(contract: DataFrame, observed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """position, column_name, error: missing columns in contract order, then mismatches in observed order, type before nullability."""
    by = by or []
    p = _paired(contract, observed, by)
    row = lambda when, group, place, text: F.when(when, F.struct(F.lit(group).alias("group"), place.alias("place"), text.alias("error")))
    kind = F.when(F.col("c_pk") | ~F.col("c_null"), "required").otherwise("optional")
    both = F.col("c_ord").isNotNull() & F.col("o_ord").isNotNull()
    each = F.array(
        row(F.col("o_ord").isNull(), 0, F.col("c_ord") * 2, F.concat(F.lit("missing "), kind, F.lit(" column '"), F.col("name"), F.lit("'"))),
        row(both & (F.col("c_type") != F.col("o_type")), 1, F.col("o_ord") * 2, F.concat(F.lit("column '"), F.col("name"), F.lit("' is "), F.col("o_type"), F.lit(", not "), F.col("c_type"))),
        row(both & ~F.col("c_null") & F.col("o_null"), 1, F.col("o_ord") * 2 + 1, F.concat(F.lit("column '"), F.col("name"), F.lit("' may be null"))),
    )
    found = p.select(*by, F.col("name").alias("column_name"), F.inline(F.array_compact(each)))
    order = Window.partitionBy(*by).orderBy("group", "place") if by else Window.partitionBy(F.lit(0)).orderBy("group", "place")
    return found.withColumn("position", F.row_number().over(order)).drop("group", "place")


def validate_schema(contract: DataFrame | None, observed: DataFrame) -> tuple[bool, list[str]]:
    """Whether observed columns fulfil the contract, and the errors in order. Without a contract nothing is valid."""
    if contract is None or contract.isEmpty():
        return False, ["no contract is registered"]
    errors = [r.error for r in validation_errors(contract, observed).orderBy("position").collect()]  # at most 3 a column
    return not errors, errors


def schema_drift(contract: DataFrame, observed: DataFrame, by: list[str] | None = None, downstream: DataFrame | None = None) -> DataFrame:
    """Changes in order: removals, additions, then shared columns with type before nullability.

    downstream: (name, affected) counts from lineage; without it no column affects another.
    """
    by = by or []
    p = _paired(contract, observed, by)
    true_false = lambda c: F.initcap(c.cast("string"))
    none = F.lit(None).cast("string")

    def row(when: Column, group: int, place: Column, kind: str, severity: Column, old: Column, new: Column) -> Column:
        return F.when(when, F.struct(F.lit(group).alias("group"), place.alias("place"), F.lit(kind).alias("drift_type"), severity.alias("severity"), old.alias("old_value"), new.alias("new_value")))

    both = F.col("c_ord").isNotNull() & F.col("o_ord").isNotNull()
    a, b = type_width(F.col("c_type")), type_width(F.col("o_type"))
    widened = F.when(a.isNull() | b.isNull(), "critical").when(b < a, "critical").otherwise("warning")
    each = F.array(
        row(F.col("o_ord").isNull(), 0, F.col("c_ord") * 2, "column_removed", F.when(F.col("c_pk") | ~F.col("c_null"), "critical").otherwise("warning"), F.col("c_type"), none),
        row(F.col("c_ord").isNull(), 1, F.col("o_ord") * 2, "column_added", F.lit("info"), none, F.col("o_type")),
        row(both & (F.col("c_type") != F.col("o_type")), 2, F.col("c_ord") * 2, "type_changed", widened, F.col("c_type"), F.col("o_type")),
        row(both & (F.col("c_null") != F.col("o_null")), 2, F.col("c_ord") * 2 + 1, "nullability_changed", F.when(F.col("o_null"), "critical").otherwise("warning"), true_false(F.col("c_null")), true_false(F.col("o_null"))),
    )
    found = p.select(*by, F.col("name").alias("column_name"), F.inline(F.array_compact(each)))
    order = Window.partitionBy(*by).orderBy("group", "place") if by else Window.partitionBy(F.lit(0)).orderBy("group", "place")
    found = found.withColumn("position", F.row_number().over(order)).drop("group", "place")
    if downstream is None:
        return found.withColumn("affected_downstream", F.lit(0).cast("long"))
    return found.join(downstream.select(F.col("name").alias("column_name"), F.col("affected").alias("affected_downstream")), "column_name", "left").fillna(0, ["affected_downstream"])


def drift_rollup(drift: DataFrame, by: list[str] | None = None) -> DataFrame:
    """overall_severity, auto_evolvable, requires_human_review; without any change: info, true, false."""
    by = by or []
    rank = F.coalesce(F.max(severity_rank(F.col("severity"))), F.lit(0))
    return drift.groupBy(*by).agg(named(rank, SEVERITIES).alias("overall_severity"), F.coalesce(F.bool_and(F.col("severity") == "info"), F.lit(True)).alias("auto_evolvable"), F.coalesce(F.bool_or(F.col("severity") == "critical"), F.lit(False)).alias("requires_human_review"), F.count("severity").alias("changes"))


def evolution_allowed(drift: DataFrame, rule: str) -> DataFrame:
    """Ours: whether a policy admits the changes. strict: none; additive: additions only; permissive: all but critical ones."""
    bad = {"strict": F.lit(True), "additive": F.col("drift_type") != "column_added", "permissive": F.col("severity") == "critical"}[rule]
    return drift.agg(F.lit(rule).alias("rule"), (F.coalesce(F.count_if(bad), F.lit(0)) == 0).alias("allowed"))
