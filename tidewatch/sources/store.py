"""Tables of metadata, time series and alerts below one folder, appended as Parquet and read by time, key or recency."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: table -> its key, if rows replace earlier ones of the same key
TABLES = {
    "contracts": None, "datasets": "dataset", "drift_reports": None, "healing_results": None, "alerts": "alert_id",
    "profiles": None, "freshness": None, "thresholds": None, "lineage_nodes": "node", "lineage_edges": None,
}
#: time tables -> what they are read by; they are laid out by its day, so that a range reads its days alone
TIMED = {"profiles": "profiled_at", "freshness": "check_time"}
DEFAULT_LIMIT = 100


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


class TableStore:
    """Every append gets ``recorded``, microseconds that rise from append to append, also after what other stores wrote before."""

    def __init__(self, spark: SparkSession, folder: str, now: Callable[[], float] = time.time):
        self.spark, self.folder, self.now, self.last = spark, folder, now, {}

    def _path(self, table: str) -> str:
        if table not in TABLES:
            raise KeyError(table)
        return f"{self.folder}/{table}"

    def _files(self, table: str, merge: bool = False) -> DataFrame:
        return self.spark.read.option("mergeSchema", str(merge).lower()).parquet(self._path(table))

    def _stamp(self, table: str) -> int:
        if table not in self.last:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(self._path(table))
            there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
            self.last[table] = (self._files(table).agg(F.max("recorded").alias("m")).first().m or 0) if there else 0  # from the files' statistics
        self.last[table] = max(self.last[table] + 1, int(self.now() * 1_000_000))
        return self.last[table]

    def append(self, table: str, rows: DataFrame) -> None:
        rows = rows.withColumn("recorded", F.lit(self._stamp(table)))
        ts = TIMED.get(table)
        if ts in rows.columns:
            rows.withColumn("recorded_day", F.to_date(ts)).write.mode("append").partitionBy("recorded_day").parquet(self._path(table))
        else:
            rows.write.mode("append").parquet(self._path(table))

    def read(self, table: str, merge: bool = True) -> DataFrame:
        """All rows, or for keyed tables the last one of each key. merge: also columns that only some appends had."""
        df = self._files(table, merge)
        key = TABLES[table]
        return (latest_by(df, [key]) if key else df).drop("recorded_day")

    def newest(self, table: str, limit: int = DEFAULT_LIMIT, **equals) -> DataFrame:
        df = self.read(table)
        for column, value in equals.items():
            df = df.where(F.col(column) == value)
        return df.orderBy(F.desc("recorded")).limit(max(0, limit))

    def between(self, table: str, dataset: str, ts: str, start, end, limit: int = DEFAULT_LIMIT) -> DataFrame:
        """Rows of a dataset from start to end, both included, newest first; of a time table only the days between are read."""
        df = self._files(table) if TIMED.get(table) == ts else self.read(table)
        if "recorded_day" in df.columns:
            df = df.where(F.col("recorded_day").between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).drop("recorded_day")
        return time_range(df.where(F.col("dataset") == dataset), ts, F.lit(start), F.lit(end), limit)


def list_datasets(datasets: DataFrame, domain: str | None = None) -> DataFrame:
    return datasets if domain is None else datasets.where(F.col("domain") == domain)


def newest_of(df: DataFrame, dataset: str, limit: int = DEFAULT_LIMIT, order: str = "recorded") -> DataFrame:
    """A dataset's newest rows: of drift reports, remediation results or thresholds."""
    return df.where(F.col("dataset") == dataset).orderBy(F.desc(order)).limit(max(0, limit))


def latest_by(df: DataFrame, keys: list[str], order: str = "recorded") -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_s")).select(*keys, "_s.*")


def time_range(df: DataFrame, ts: str, start, end, limit: int = DEFAULT_LIMIT) -> DataFrame:
    return df.where(F.col(ts).between(start, end)).orderBy(F.desc(ts)).limit(limit)


def newest_per(df: DataFrame, keys: list[str], order: str, limit: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


class TtlCache:
    """A driver-side cache; an entry is gone once the clock is past its expiry."""

    def __init__(self, clock: Callable[[], float] = time.monotonic):
        self.clock, self.items = clock, {}

    def set(self, key: str, value, ttl_seconds: float | None = None) -> None:
        self.items[key] = (value, None if ttl_seconds is None else self.clock() + ttl_seconds)

    def get(self, key: str):
        if not self.exists(key):
            return None
        return self.items[key][0]

    def exists(self, key: str) -> bool:
        found = self.items.get(key)
        if found and found[1] is not None and self.clock() > found[1]:
            del self.items[key]
            return False
        return found is not None

    def delete(self, key: str) -> bool:
        return self.exists(key) and self.items.pop(key) is not None

    def clear(self) -> None:
        self.items.clear()
