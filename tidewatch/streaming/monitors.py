"""Continuous checks: freshness state, tumbling profiles, alert sessions. Sources and sinks are the caller's."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch.functions.expressions import STATES

STATUS_SCHEMA = "dataset string, seq long, staleness_seconds double, sla_consumed_pct double, status string"


def tumbling_profiles(events: DataFrame, ts: str, value: str, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Per window: counts, moments and a mergeable distinct sketch. Rows later than the watermark are dropped by the engine."""
    x = F.col(value).cast("double")
    w = events.withWatermark(ts, late).groupBy(F.window(ts, length).alias("w"))
    found = w.agg(F.count(F.lit(1)).alias("total_count"), F.count_if(F.col(value).isNull()).alias("null_count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std_dev"), F.min(x).alias("min_value"), F.max(x).alias("max_value"), F.hll_sketch_estimate(F.hll_sketch_agg(F.col(value).cast("string"), 14)).alias("distinct_count"))
    return found.select(F.col("w.start").alias("window_start"), "total_count", "null_count", "mean", "std_dev", "min_value", "max_value", "distinct_count")


def alert_sessions(alerts: DataFrame, ts: str = "created_at", gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Equal alerts with pauses below ``gap`` as one."""
    s = alerts.withWatermark(ts, late).groupBy("dataset", "anomaly_type", "metric_name", F.session_window(ts, gap).alias("w"))
    return s.agg(F.count(F.lit(1)).alias("occurrence_count")).select("dataset", "anomaly_type", "metric_name", F.col("w.start").alias("first_seen"), "occurrence_count")


def freshness_status(log: DataFrame, slas: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Statuses of the checks in a stream of (dataset, seq, kind, at): kind is arrival or check, at in epoch seconds.

    State of a dataset: its last arrival and the worst status since. Rows of a micro-batch are taken in order of seq.
    ``slas``: dataset -> (longest staleness, warning share, critical share), a small table of the caller's.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, worst = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        sla = slas.get(key[0])
        for r in rows.itertuples():
            if r.kind == "arrival":
                last, worst = float(r.at), 0
            elif sla:
                top, warn, crit = sla
                stale = top if last is None else max(0.0, r.at - last)
                rank = 2 if last is None or stale > crit * top else 1 if stale > warn * top else 0
                worst = max(worst, rank)
                out.append((key[0], int(r.seq), float(stale), 2.0 if last is None else min(stale / top, 2.0), STATES[worst]))
        state.update((last, worst))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in STATUS_SCHEMA.split(", ")])

    return log.groupBy("dataset").applyInPandasWithState(step, STATUS_SCHEMA, "last double, worst int", "append", GroupStateTimeout.NoTimeout)
