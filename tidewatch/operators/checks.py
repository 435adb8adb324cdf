"""Data against its contract's constraints. (Ours: contracts hold the constraints; here they are applied to rows.)"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_checks(contract: list[dict]) -> dict[str, Column]:
    """Check name -> whether a row passes. A null passes all but the null checks."""
    out: dict[str, Column] = {}
    for c in contract:
        x, name = F.col(f"`{c['name']}`"), c["name"]
        ok = lambda cond, x=x: x.isNull() | cond
        if not c.get("nullable", True) or c.get("primary_key"):
            out[f"{name}:not_null"] = x.isNotNull()
        if c.get("min_value") is not None:
            out[f"{name}:min_value"] = ok(x >= c["min_value"])
        if c.get("max_value") is not None:
            out[f"{name}:max_value"] = ok(x <= c["max_value"])
        if c.get("allowed_values") is not None:
            out[f"{name}:allowed_values"] = ok(x.cast("string").isin([str(v) for v in c["allowed_values"]]))
        if c.get("pattern") is not None:
            out[f"{name}:pattern"] = ok(x.cast("string").rlike(f"^(?:{c['pattern']})$"))
    return out


def check_rows(df: DataFrame, contract: list[dict]) -> DataFrame:
    """check, rows, violations: all row checks in one aggregation."""
    checks = row_checks(contract)
    found = F.array(*[F.struct(F.lit(k).alias("check"), F.count(F.lit(1)).alias("rows"), F.count_if(~ok).alias("violations")) for k, ok in checks.items()])
    return df.agg(found.alias("c")).select(F.inline("c"))


def check_null_rates(df: DataFrame, contract: list[dict]) -> DataFrame:
    """column_name, null_rate, max_null_rate, passed."""
    rate = lambda n: F.coalesce(F.try_divide(F.count_if(F.col(f"`{n}`").isNull()), F.count(F.lit(1))), F.lit(0.0))
    found = F.array(*[F.struct(F.lit(c["name"]).alias("column_name"), rate(c["name"]).alias("null_rate"), F.lit(float(c.get("max_null_rate", 1.0))).alias("max_null_rate")) for c in contract])
    return df.agg(found.alias("c")).select(F.inline("c")).withColumn("passed", F.col("null_rate") <= F.col("max_null_rate"))


def check_unique(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, duplicated_values, surplus_rows of columns that should be unique; nulls don't count."""
    each = []
    for c in columns:
        n = df.where(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`").alias("v")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        each.append(n.agg(F.count(F.lit(1)).alias("duplicated_values"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_rows")).select(F.lit(c).alias("column_name"), "duplicated_values", "surplus_rows"))
    return reduce(DataFrame.unionByName, each)


def check_row_count(df: DataFrame, least: int | None, most: int | None, by: list[str] | None = None) -> DataFrame:
    """rows and passed for each group."""
    ok = F.lit(True)
    if least is not None:
        ok = ok & (F.col("rows") >= least)
    if most is not None:
        ok = ok & (F.col("rows") <= most)
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("rows")).withColumn("passed", ok)
