"""Every query on tables gives what its SQL gives."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from tests.compare import TABLES, assert_same
from tidewatch.plans import registry

NAMES = sorted(registry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf_dir, name):
    assert_same(registry.queries()[name](spark, sf_dir), sf_dir, registry.oracle_sql()[name])


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_corpus_operators(tmp_path, pipeline):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", *([] if pipeline else ["corpus_pipeline.py"])))
    ask = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(q) == set(o) and len(q) > 90 and 'pipeline' not in q, sorted(q)"
    done = subprocess.run([sys.executable, "-c", ask], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_profile_of_a_dataset_rounds_ties_as_its_sql(spark, sf_dir, tmp_path):
    """Means of 20 000 rows may lie on a tie of the last digit, 11.50035 and 5.00055 here; those of 150, 1500 or 15 000 can't."""
    for t in set(TABLES) - {"customer"}:
        os.symlink(f"{sf_dir}/{t}.parquet", tmp_path / f"{t}.parquet")
    rows = "SELECT range AS c_custkey, CAST(range % 24 + if(range < 71, 1, 0) AS INT) AS c_nationkey, (range * 7919 % 1100000) / 100 - 1000 AS c_acctbal, if(range < 11, 'abcdef', 'abcde') AS c_mktsegment FROM range(20000)"
    duckdb.connect().execute(f"COPY ({rows}) TO '{tmp_path}/customer.parquet'")
    got = registry.queries()["profile_dataset_customer"](spark, str(tmp_path))
    assert {r.column_name: r.avg_length or r.mean for r in got.where("column_name <> 'c_acctbal'").collect()} == {"c_nationkey": 11.5003, "c_mktsegment": 5.0005}
    assert_same(got, str(tmp_path), registry.oracle_sql()["profile_dataset_customer"])


def test_profile_of_a_dataset_keeps_the_sign_of_a_zero(spark, sf_dir, tmp_path):
    """A skewness of -0.000007 is -0.0 in the SQL; both zeros are one distinct value."""
    for t in set(TABLES) - {"customer"}:
        os.symlink(f"{sf_dir}/{t}.parquet", tmp_path / f"{t}.parquet")
    rows = "SELECT range AS c_custkey, CAST(range % 25 AS INT) AS c_nationkey, CASE range WHEN 199 THEN -0.0::DOUBLE WHEN 301 THEN 1.002::DOUBLE ELSE (range - 200) / 100 END AS c_acctbal, 'a' AS c_mktsegment FROM range(501)"
    duckdb.connect().execute(f"COPY ({rows}) TO '{tmp_path}/customer.parquet'")
    got = registry.queries()["profile_dataset_customer"](spark, str(tmp_path))
    [r] = got.where("column_name = 'c_acctbal'").collect()
    assert (str(r.skewness), r.distinct_count) == ("-0.0", 500)
    assert_same(got, str(tmp_path), registry.oracle_sql()["profile_dataset_customer"])


def test_arrival_prediction_takes_every_event(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("event_id").collect()
    assert len(events) > 300
    last, smoothed = {}, {}
    for e in events:
        if e.event_type in last:
            gap = (e.ts - last[e.event_type]).total_seconds()
            smoothed[e.event_type] = 0.3 * gap + 0.7 * smoothed[e.event_type] if e.event_type in smoothed else gap
        last[e.event_type] = e.ts
    got = {r.dataset: r for r in registry.queries()["arrival_prediction"](spark, sf_dir).collect()}
    assert {k: r.last_arrival for k, r in got.items()} == last
    assert all(abs(r.smoothed_gap_seconds - smoothed[k]) < 0.02 for k, r in got.items())


def test_freshness_takes_every_event(spark, sf_dir):
    sla = {"click": 3600, "view": 36000, "purchase": 1800}
    last, want = {}, {}
    for e in spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("event_id").collect():
        if e.event_type in sla:
            stale = max(0.0, (e.ts - last[e.event_type]).total_seconds()) if e.event_type in last else float(sla[e.event_type])
            want[2 * e.event_id] = (e.ts, last.get(e.event_type), round(stale, 3))
        last[e.event_type] = e.ts
    got = registry.queries()["freshness_monotonic"](spark, sf_dir).collect()
    assert len(got) == len(want) and {r.seq: (r.check_time, r.last_updated, r.staleness_seconds) for r in got} == want
