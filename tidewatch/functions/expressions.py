"""Column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("info", "warning", "critical")
STATES = ("healthy", "warning", "critical", "unknown")
#: Width of the types that can be compared; a change to a greater width is a widening.
TYPE_WIDTH = {"boolean": 0, "integer": 1, "float": 2, "decimal": 3, "string": 4}


def ranked(column: Column, names: tuple[str, ...]) -> Column:
    out = F.lit(None).cast("int")
    for i, name in enumerate(names):
        out = F.when(column == name, F.lit(i)).otherwise(out)
    return out


def severity_rank(column: Column) -> Column:
    """info < warning < critical; a comparison of the words themselves would be wrong."""
    return ranked(column, SEVERITIES)


def named(rank: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in names]), rank + 1)


def type_width(column: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, width in TYPE_WIDTH.items():
        out = F.when(column == name, F.lit(width)).otherwise(out)
    return out


def adjusted_skewness(x: Column) -> Column:
    """Bias-corrected skewness; null below three values or without spread."""
    n = F.count(x).cast("double")
    return F.when((F.count(x) >= 3) & (F.stddev_samp(x) > 0), F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def excess_kurtosis(x: Column) -> Column:
    """Population excess kurtosis; null below four values or without spread."""
    return F.when((F.count(x) >= 4) & (F.stddev_samp(x) > 0), F.kurtosis(x))


def bin_index(x: Column, lo: Column, hi: Column, n: Column) -> Column:
    """The bin of x among n equal ones over [lo, hi]: closed below, the last one closed at both ends.

    The quotient alone misplaces values that lie on an edge, so it is corrected against the edges themselves.
    """
    step = (hi - lo) / n
    edge = lambda k: F.when(k == n, hi).otherwise(lo + k * step)
    i = F.least(F.floor((x - lo) / (hi - lo) * n), n - 1)
    return F.when(x < edge(i), i - 1).when((x >= edge(i + 1)) & (i < n - 1), i + 1).otherwise(i).cast("int")


def kolmogorov_tail(d: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic two-sided p-value of the two-sample statistic d (Kolmogorov's series, 100 terms)."""
    lam2 = d * d * n1 * n2 / (n1 + n2)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda a, k: a + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam2))
    return F.when(lam2 <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * series)))


def relative_time(seconds: Column) -> Column:
    """How long ago, in words."""
    unit = lambda n, s: F.concat(F.floor(seconds / n).cast("string"), F.lit(s))
    return F.when(seconds < 60, "just now").when(seconds < 3600, unit(60, "m ago")).when(seconds < 86400, unit(3600, "h ago")).otherwise(unit(86400, "d ago"))


def one_decimal(x: Column) -> Column:
    """A double of 1 or more with one decimal, by its exact value and ties to even; ``format_string`` rounds the shortest decimal that reads as it, up at a half."""
    parts = ((x - F.floor(x)) * 2.0**52).cast("long") * 10  # nothing is lost: from 1 on doubles are multiples of 2**-52
    tenths = F.floor(x) * 10 + F.shiftright(parts + (2**51 - 1) + F.shiftright(parts, 52) % 2, 52)
    return F.when(x < 2.0**53, (tenths.cast("decimal(19,0)") * F.lit(Decimal("0.1"))).cast("string")).otherwise(F.format_string("%.1f", x))  # no fractions beyond


def short_number(x: Column) -> Column:
    """1.2M, 3.4K, or the number itself."""
    shown = one_decimal(x.cast("double") / F.when(x >= 1_000_000, 1_000_000).otherwise(1_000))
    return F.when(x >= 1_000, F.concat(shown, F.when(x >= 1_000_000, "M").otherwise("K"))).otherwise(x.cast("long").cast("string"))
