"""Cases of single operators: boundaries, empty input, errors, order."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.expressions import short_number
from tidewatch.operators import alerts, anomaly, checks, contracts, dashboards, freshness, healing, lineage, profile
from tidewatch.sources.store import TableStore, TtlCache
from tidewatch.streaming import monitors


def stats(spark, rows, kind="double", **kw):
    df = spark.createDataFrame([(x,) for x in rows], f"x {kind}")
    return profile.column_statistics(df, **kw).first()


def test_numeric_statistics(spark):
    r = stats(spark, [1.0, 2.0, 3.0, 4.0, 5.0])
    assert (r.mean, r.min_value, r.max_value, r.total_count, r.null_count) == (3.0, 1.0, 5.0, 5, 0)
    assert stats(spark, list(range(1, 101)), "int").p50 == 50.5
    skew = stats(spark, [1.0, 2.0, 3.0, 4.0, 10.0])
    assert skew.skewness == pytest.approx(1.69706, abs=1e-4)


def test_few_values(spark):
    one = stats(spark, [42.0])
    assert one.mean == 42.0 and one.std_dev is None and one.skewness is None and one.kurtosis is None
    two = stats(spark, [1.0, 3.0])
    assert two.std_dev == pytest.approx(math.sqrt(2)) and two.skewness is None
    flat = stats(spark, [2.0] * 6)
    assert flat.std_dev == 0 and flat.skewness is None and flat.kurtosis is None


def test_nulls_and_nan(spark):
    r = stats(spark, [1.0, None, 3.0, None, 5.0])
    assert (r.total_count, r.null_count, r.mean) == (5, 2, 3.0)
    r = stats(spark, [1.0, float("nan"), 3.0])
    assert (r.nan_count, r.mean, r.max_value) == (1, 2.0, 3.0)
    for kind in ("double", "string"):
        r = stats(spark, [None, None], kind)
        assert r.total_count == 2 and r.null_count == 2 and r.mean is None and r.max_length is None
    assert stats(spark, [], "double").total_count == 0


def test_lengths_are_code_points(spark):
    assert stats(spark, ["héllo😀", None, ""], "string").max_length == 6


def test_histogram_properties(spark):
    rng = random.Random(3)
    rows = [rng.gauss(0, 1) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in rows], "x double")
    for asked, n in ((None, 20), (7, 7), (1, 5), (1000, 100)):
        h = profile.histogram(df, "x", asked).orderBy("position").collect()
        assert len(h) == n and sum(b["count"] for b in h) == 500
        assert all(h[i].upper == pytest.approx(h[i + 1].lower) for i in range(n - 1))
    assert profile.histogram(df.limit(0), "x").count() == 0


def test_profile_dataset_and_limit(spark):
    df = spark.createDataFrame([(10.0 * i, f"n{i}") for i in range(1, 6)], "amount double, name string")
    rows = {r.column_name: r for r in profile.profile_dataset(df, "w.sales", "2024-01-15").collect()}
    assert rows["amount"].mean == 30 and rows["amount"].distinct_count == 5 and len(rows["amount"].histogram) == 20
    assert rows["name"].histogram is None and rows["name"].profiling_duration_ms >= 1
    sampled = {r.column_name: r for r in profile.profile_dataset(df, "w.sales", "p", sample_rate=0.5).collect()}
    assert sampled["amount"].total_count == 5
    wide = spark.range(1).select(*[F.lit(1).alias(f"c{i}") for i in range(1025)])
    with pytest.raises(profile.ProfileError):
        profile.column_statistics(wide)


def test_distinct_above_limit_uses_sketch(spark):
    df = spark.range(150_000).select(F.col("id").alias("x"))
    n = profile.distinct_counts(df, ["x"]).first().distinct_count
    assert abs(n - 150_000) <= 3000
    assert profile.distinct_counts(df.limit(10), ["x"], 100).first().distinct_count == 10


def test_distinct_counts_are_exact_at_any_size(spark):
    df = spark.range(400_000).select((F.col("id") % 250_000).alias("x"), (F.col("id") % 3).alias("y"), (F.col("id") / 7).alias("z"), F.lit(None).cast("double").alias("none"))
    got = {r.column_name: r.distinct_count for r in profile.distinct_counts(df, df.columns).collect()}
    assert got == {"x": 250_000, "y": 3, "z": 400_000, "none": 0}


def test_profile_counts_many_distinct_values_exactly(spark):
    df = spark.range(240_000).select((F.col("id") % 160_000 / 100).alias("x"), F.format_string("n%d", F.col("id") % 130_000).alias("s"))
    got = {r.column_name: r for r in profile.profile_dataset(df, "w.d", "p").collect()}
    assert (got["x"].distinct_count, got["s"].distinct_count) == (160_000, 130_000)
    assert sum(b["count"] for b in got["x"].histogram) == got["x"].total_count == 240_000


def buckets(spark, profiles):
    rows = []
    for name, values in profiles:
        df = spark.createDataFrame([(float(x),) for x in values], "x double")
        for b in profile.histogram(df, "x", 10).collect():
            rows.append(("d", "x", name, b.position, b.lower, b.upper, b["count"]))
    return spark.createDataFrame(rows, "dataset string, column_name string, profile string, position int, lower double, upper double, count long")


def test_shift_is_found_and_gate_holds(spark):
    rng = random.Random(42)
    normal = lambda m, s: [rng.gauss(m, s) for _ in range(200)]
    base = buckets(spark, [(f"p{i}", normal(50, 10)) for i in range(7)])
    far = buckets(spark, [("now", normal(200, 5))])
    events = anomaly.detect_anomalies(far, base).collect()
    assert events and all(e.severity == "critical" and e.score == 1.0 for e in events)
    assert events[0].expected_range.lo == 0.0 and events[0].context["algorithm"] == events[0].algorithm
    few = base.where("profile < 'p6'")
    assert anomaly.detect_anomalies(far, few).count() == 0
    same = buckets(spark, [("now", normal(50, 10))])
    wide = spark.createDataFrame([("d", "x", 0.5, 2.0)], "dataset string, column_name string, ks_threshold double, kl_threshold double")
    assert anomaly.detect_anomalies(same, base, wide).count() == 0
    assert anomaly.kl_divergence(same, same.withColumn("profile", F.lit("q"))).first().kl == pytest.approx(0, abs=1e-9)
    assert 0 <= anomaly.ks_statistic(same, base).first().d <= 1


def test_percentiles_are_exact_in_bounded_brackets(spark):
    rng = random.Random(11)
    cases = {"a": [rng.gauss(0, 1e6) for _ in range(40_000)], "b": [float(rng.randint(0, 3)) for _ in range(40_000)], "c": [7.0] * 40_000, "d": [rng.choice([-1e300, 0.0, 5e-324]) for _ in range(40_000)]}
    df = spark.createDataFrame(list(zip(*cases.values(), strict=True)), ", ".join(f"{c} double" for c in cases)).repartition(5)
    got = {r.column_name: r for r in profile.column_statistics(df).collect()}
    exact = df.agg(*[F.percentile(c, F.array(*[F.lit(q) for q in profile.QUANTILES])).alias(c) for c in cases]).first()
    for c in cases:
        assert [got[c].p25, got[c].p50, got[c].p75, got[c].p99] == pytest.approx(exact[c]), c
    for n in (1, 2, 3, 7, 499, 501, 2600):
        few = spark.createDataFrame([(g, rng.random()) for g in (None, "x") for _ in range(n)], "g string, v double")
        rows = profile.column_statistics(few, ["v"], ["g"]).collect()
        want = {r.g: r.p for r in few.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(q) for q in profile.QUANTILES])).alias("p")).collect()}
        assert len(rows) == 2 and all([r.p25, r.p50, r.p75, r.p99] == pytest.approx(want[r.g]) for r in rows), n


def test_histograms_of_many_columns_and_groups(spark):
    rng = random.Random(12)
    df = spark.createDataFrame([(rng.choice([None, "x", "y"]), rng.random(), rng.randint(0, 5) if rng.random() < 0.7 else None, None) for _ in range(500)], "g string, a double, `b.c` int, void double")
    rows = profile.histograms(df, ["a", "b.c", "void"], 5, ["g"]).collect()
    want = {(g, c): df.where(F.col("g").eqNullSafe(F.lit(g)) & F.col(f"`{c}`").isNotNull()).count() for g in (None, "x", "y") for c in ("a", "b.c")}
    got = {}
    for r in rows:
        got[(r.g, r.column_name)] = got.get((r.g, r.column_name), 0) + r["count"]
    assert got == want and len(rows) == 30


def test_samples_have_their_exact_size(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("a"), F.col("id").alias("b"), F.lit(None).cast("int").alias("c"), F.when(F.col("id") == 5, 1).alias("d"))
    for rate, want in ((0.5, (167, 500, 0, 1)), (0.01, (3, 10, 0, 1)), (0.0001, (3, 10, 0, 1)), (5.0, (330, 990, 0, 1))):
        s = profile.sample_columns(df, df.columns, rate)
        assert tuple(s.agg(*[F.count(c) for c in df.columns]).first()) == want
    few = {r.column_name: r for r in profile.profile_dataset(df.limit(100), "d", "p", sample_rate=0.01).collect()}
    assert few["b"].mean is not None and few["b"].total_count == 100 and few["c"].null_count == 100


def test_exact_p_values(spark):
    import itertools

    for n1, n2 in ((3, 4), (5, 5), (4, 6), (1, 3)):
        heights = []
        for chosen in itertools.combinations(range(n1 + n2), n1):
            i = most = 0
            for k in range(n1 + n2):
                i += k in chosen
                most = max(most, abs(i * n2 - (k + 1 - i) * n1))
            heights.append(most)
        for h in range(n1 * n2 + 1):
            assert anomaly.exact_p_value(h / (n1 * n2), n1, n2) == pytest.approx(sum(x >= h for x in heights) / len(heights))
    big = spark.createDataFrame([(0.05, 20_000, 30_000), (0.05, 2_000, 3_000)], "d double, n1 int, n2 int")
    p, tail = (big.select(f(F.col("d"), F.col("n1"), F.col("n2")).alias("p")).collect() for f in (anomaly.ks_p_value, lambda *x: anomaly.ks_p_value(*x, 0)))
    assert p[0].p == tail[0].p and p[1].p != tail[1].p and p[1].p == pytest.approx(tail[1].p, rel=0.2)


def test_broken_columns_do_not_stop_the_others(spark):
    rng = random.Random(5)
    base = buckets(spark, [(f"p{i}", [rng.gauss(50, 10) for _ in range(100)]) for i in range(8)])
    far = buckets(spark, [("now", [rng.gauss(200, 5) for _ in range(100)])])
    both = lambda df, bad: df.unionByName(df.withColumn("column_name", F.lit("broken")).withColumn("upper", F.lit(bad)))
    for bad in (float("nan"), float("inf"), None):
        events = anomaly.detect_anomalies(both(far, bad), both(base, 1.0)).collect()
        assert {e.column_name for e in events} == {"x"} and {e.metric_name for e in events} <= {"ks_statistic", "kl_divergence"}
        ks = next(e for e in events if e.metric_name == "ks_statistic")
        assert float(ks.context["p_value"]) < 0.05 and float(ks.context["adaptive_threshold"]) == 0.15 and ks.detected_at and len(ks.anomaly_id) == 32


def test_thresholds_update_only_what_is_given(spark):
    t = spark.createDataFrame([("d", "x", 0.1, 0.2)], "dataset string, column_name string, ks_threshold double, kl_threshold double")
    r = anomaly.set_threshold(t, "d", "x", ks=0.3).first()
    assert (r.ks_threshold, r.kl_threshold) == (0.3, 0.2)


def test_baseline_keeps_the_boundary(spark):
    now = dt.datetime(2024, 3, 1)
    rows = [(now - dt.timedelta(days=d),) for d in (1, 30, 31)]
    df = spark.createDataFrame(rows, "profiled_at timestamp_ntz")
    assert anomaly.baseline_window(df, F.lit("2024-03-01").cast("timestamp_ntz")).count() == 2


def test_contract_rules(spark):
    ok = contracts.contract_columns(spark, [{"name": "id", "dtype": "integer", "primary_key": True, "nullable": True}])
    assert ok.first().nullable is False
    contracts.check_contract(ok)
    with pytest.raises(contracts.ContractError) as e:
        contracts.check_contract(contracts.contract_columns(spark, [{"name": "a", "dtype": "string"}, {"name": "a", "dtype": "string"}]))
    assert e.value.violated_rule == "unique_column_names"
    with pytest.raises(contracts.ContractError) as e:
        contracts.check_contract(ok.limit(0))
    assert e.value.violated_rule == "column_count_minimum"


def test_validate_schema(spark):
    c = contracts.contract_columns(spark, [{"name": "id", "dtype": "integer", "primary_key": True}, {"name": "email", "dtype": "string", "nullable": False}, {"name": "age", "dtype": "integer"}])
    assert contracts.validate_schema(c, c) == (True, [])
    seen = contracts.contract_columns(spark, [{"name": "age", "dtype": "string"}, {"name": "email", "dtype": "string"}, {"name": "more", "dtype": "date"}])
    valid, errors = contracts.validate_schema(c, seen)
    assert not valid and [("missing" in x, "age" in x, "null" in x) for x in errors] == [(True, False, False), (False, True, False), (False, False, True)]
    assert contracts.validate_schema(None, c)[0] is False


def test_sla_bounds():
    for bad in ((0, 0.8, 0.9), (-1, 0.8, 0.9), (2_592_001, 0.8, 0.9), (60, 0.9, 0.9), (60, 0.8, 1.01), (60, 0.0, 0.5)):
        with pytest.raises(freshness.SlaError):
            freshness.check_sla(*bad)
    freshness.check_sla(2_592_000, 0.5, 1.0)


def graph(spark, pairs):
    nodes = spark.createDataFrame([(n,) for n in sorted({x for p in pairs for x in p})], "node string")
    edges = spark.createDataFrame([(a, b, "direct", None, f"p{i}", 1.0, i) for i, (a, b) in enumerate(pairs)], "src string, dst string, transformation_type string, transformation_expr string, pipeline_id string, confidence double, edge_seq long")
    return nodes, edges


def test_lineage_registration(spark):
    nodes, edges = graph(spark, [("n:v1:a", "n:v1:b"), ("n:v1:b", "n:v1:c")])
    out = lineage.register(spark, nodes, edges, ["n:v1:a", "n:v1:b"], ["n:v1:c"], "derived", "p9", "someone", "heuristic")
    assert out.count() == 4 and out.where("pipeline_id = 'p9'").first().confidence == 0.5
    with pytest.raises(lineage.MissingColumns) as e:
        lineage.register(spark, nodes, edges, ["x:v1:q"], ["y:v1:q", "n:v1:a"], "derived", "p")
    assert len(e.value.missing) == 2
    with pytest.raises(lineage.CycleFound) as e:
        lineage.register(spark, nodes, edges, ["n:v1:c"], ["n:v1:a"], "derived", "p")
    assert e.value.path == ["n.c", "n.b", "n.a"]
    with pytest.raises(lineage.CycleFound):
        lineage.register(spark, nodes, edges, ["n:v1:a"], ["n:v1:a"], "derived", "p")


def test_walks_of_large_and_small_graphs_agree(spark):
    rng = random.Random(31)
    names = [f"n{i % 7}:v{i % 3}:c{i}" for i in range(60)]
    pairs = [(names[a], names[b]) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(140)) if a < b or rng.random() < 0.1]
    nodes, edges = graph(spark, pairs)
    roots = spark.createDataFrame([(n,) for n in (names[0], names[3], "absent")], "node string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    for depth, ordered in ((None, True), (2, True), (None, False)):
        assert rows(lineage.downstream(edges, roots, depth, ordered)) == rows(lineage.downstream(edges, roots, depth, ordered, small=0))
    assert rows(lineage.upstream(edges, roots)) == rows(lineage.upstream(edges, roots, small=0))
    close = lineage.downstream(edges, roots, None).where(F.col("level") >= 3).orderBy(F.desc("level"), "node").first()
    if close:
        paths = [[r.name for r in lineage.cycle_path(edges, close.node, close.root, small=k).orderBy("position").collect()] for k in (lineage.SMALL_GRAPH, 0)]
        assert paths[0] == paths[1] and len(paths[0]) == close.level + 1
    assert lineage.cycle_path(edges, "absent", names[0]).count() == 0
    seen = lineage.impact_table(edges, nodes, pairs[0][0], 99)
    assert seen.first().max_depth == 50


def test_lineage_impact(spark):
    nodes, edges = graph(spark, [("n:v1:a", "n:v1:c"), ("n:v1:a", "n:v1:b"), ("n:v1:b", "m:v1:d"), ("n:v1:c", "m:v1:d")])
    r = lineage.impact(edges, nodes, "n:v1:a", 100)
    assert r["columns"] == ["n:v1:b", "n:v1:c", "m:v1:d"] and r["datasets"] == ["n:v1", "m:v1"] and r["max_depth"] == 50
    assert r["pipelines"] == ["p0", "p1", "p2", "p3"]
    assert lineage.impact(edges, nodes, "n:v1:a", 0)["total_affected"] == 2
    with pytest.raises(lineage.LineageError):
        lineage.impact(edges, nodes, "no:v1:x")
    assert lineage.remove_edge(edges, "a", "b")[1] is False


def test_selection_boundaries(spark):
    d = spark.createDataFrame([("a", "c", "quarantine", 0.49), ("b", "c", "quarantine", 0.5)], "alert_id string, root_cause string, suggested_strategy string, confidence double")
    h = spark.createDataFrame([], "strategy string, success boolean, started_at timestamp_ntz, details string")
    got = {r.alert_id: r.strategy for r in healing.select_strategy(d, h, F.lit("2024-01-01").cast("timestamp_ntz")).collect()}
    assert got == {"a": "escalate", "b": "quarantine"}


def test_quarantine_keeps_every_row(spark):
    df = spark.createDataFrame([(1,), (None,), (9,)], "x int")
    good, bad = healing.quarantine(df, F.col("x") < 5, "range")
    assert (good.count(), bad.count()) == (1, 2)


def test_checks_on_empty_table(spark):
    df = spark.createDataFrame([], "x int")
    assert checks.check_null_rates(df, [{"name": "x", "max_null_rate": 0.0}]).first().passed
    assert checks.check_rows(df, [{"name": "x", "nullable": False}]).first().violations == 0
    assert dashboards.zero_filled(df, "x", 0, 2).count() == 3


def test_store_and_cache(spark, tmp_path):
    s = TableStore(spark, str(tmp_path), now=lambda: 1.0)
    for owner in ("x", "y"):
        s.append("datasets", spark.createDataFrame([("d", owner)], "dataset string, owner string"))
        s.append("drift_reports", spark.createDataFrame([("d", owner)], "dataset string, owner string"))
    assert [r.owner for r in s.read("datasets").collect()] == ["y"]
    assert [r.owner for r in s.newest("drift_reports", 1).collect()] == ["y"] and s.newest("drift_reports", 0).count() == 0
    clock = [0.0]
    c = TtlCache(lambda: clock[0])
    c.set("k", 1, 5)
    clock[0] = 5.0
    assert c.get("k") == 1
    clock[0] = 5.1
    assert c.get("k") is None and not c.delete("k")


def test_store_reads_only_the_days_of_a_range(spark, tmp_path):
    s = TableStore(spark, str(tmp_path))
    rows = [("d" if i % 2 else "e", dt.datetime(2024, 1, 1) + dt.timedelta(hours=6 * i), float(i)) for i in range(40)]
    s.append("profiles", spark.createDataFrame(rows[:20], "dataset string, profiled_at timestamp, mean double"))
    TableStore(spark, str(tmp_path), now=lambda: 0.0).append("profiles", spark.createDataFrame(rows[20:], "dataset string, profiled_at timestamp, mean double"))
    got = s.between("profiles", "d", "profiled_at", dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 5))
    want = [m for d, t, m in rows if d == "d" and dt.datetime(2024, 1, 3) <= t <= dt.datetime(2024, 1, 5)]
    assert [r["mean"] for r in got.collect()] == sorted(want, reverse=True)
    assert len(got.inputFiles()) > 0 and "PartitionFilters: [isnotnull(recorded_day" in got._jdf.queryExecution().toString()
    assert s.read("profiles").columns == ["dataset", "profiled_at", "mean", "recorded"]
    assert [r.recorded for r in s.read("profiles").select("recorded").distinct().orderBy("recorded").collect()][1] > 1_000_000


def test_checks_without_a_service_level_are_errors(spark):
    log = spark.createDataFrame([("x", 1, dt.datetime(2024, 1, 1))], "dataset string, seq long, at timestamp_ntz")
    slas = spark.createDataFrame([("y", 60, 0.8, 0.9)], "dataset string, max_staleness_seconds int, warning_threshold double, critical_threshold double")
    with pytest.raises(Exception, match="no service level is registered for x"):
        freshness.check_freshness(log, log, slas).collect()
    assert [(r.dataset, r.checks) for r in freshness.unregistered_checks(log, slas).collect()] == [("x", 1)]
    # a status that earlier checks left stays until data arrives
    arrived = spark.createDataFrame([("y", 1, dt.datetime(2024, 1, 1))], log.schema)
    checked = spark.createDataFrame([("y", 2, dt.datetime(2024, 1, 1, 0, 2))], log.schema)
    now = F.lit("2024-01-01 00:00:01").cast("timestamp_ntz")
    assert freshness.current_status(arrived, checked, slas, now).first().status == "critical"
    assert freshness.current_status(arrived, checked.limit(0), slas, now).first().status == "healthy"


def test_contract_registration(spark):
    cols = contracts.contract_columns(spark, [{"name": "id", "dtype": "integer", "primary_key": True}])
    none = cols.limit(0).select(F.lit("").alias("dataset"), F.lit(0).alias("version"), "*", F.current_timestamp().alias("created_at"))
    two = contracts.register_contract(contracts.register_contract(none, "a", cols), "a", cols.withColumn("version", F.lit(9)))
    assert sorted(r.version for r in two.collect()) == [1, 2] and two.where("created_at IS NULL").count() == 0
    assert contracts.get_contract(two, "a").first().version == 2 and contracts.get_contract(two, "a", 1).count() == 1 and contracts.get_contract(two, "b").count() == 0
    with pytest.raises(contracts.ContractError):
        contracts.register_contract(two, "a", cols.unionByName(cols))


def test_alerts_order(spark):
    rows = [("a", dt.datetime(2024, 1, 1), None), ("b", dt.datetime(2024, 1, 2), None), ("c", dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 3))]
    df = spark.createDataFrame(rows, "dataset string, created_at timestamp_ntz, acknowledged_at timestamp_ntz")
    assert [r.dataset for r in alerts.active(df).collect()] == ["b", "a"]


def test_streaming_freshness(spark, tmp_path):
    log = [("o", 1, "check", 5.0), ("o", 2, "arrival", 0.0), ("o", 3, "check", 100.0), ("o", 4, "check", 2900.0), ("o", 5, "check", 3500.0), ("o", 6, "check", 10.0), ("o", 7, "arrival", 3500.0), ("o", 8, "check", 3501.0)]
    df = spark.createDataFrame(log, "dataset string, seq long, kind string, at double")
    df.where("seq <= 4").write.parquet(str(tmp_path / "in" / "a"))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = monitors.freshness_status(stream, {"o": (3600.0, 0.8, 0.9)}).writeStream.format("memory").queryName("fresh").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    df.where("seq > 4").write.parquet(str(tmp_path / "in" / "b"))
    q.processAllAvailable()
    q.stop()
    got = [r.status for r in spark.table("fresh").orderBy("seq").collect()]
    assert got == ["critical", "healthy", "warning", "critical", "critical", "healthy"]


def test_streaming_profiles_drop_late_rows(spark, tmp_path):
    t = lambda d, h: dt.datetime(2024, 1, d, h)
    schema = "ts timestamp, value double"
    batches = [[(t(1, 1), 1.0), (t(1, 2), 3.0)], [(t(3, 1), 5.0)], [(t(1, 3), 99.0), (t(4, 9), 1.0)]]
    src = tmp_path / "in"
    src.mkdir()
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(src))
    q = None
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).write.parquet(str(src / str(i)))
        if q is None:
            q = monitors.tumbling_profiles(stream, "ts", "value").writeStream.format("memory").queryName("prof").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
    q.stop()
    got = {r.window_start.day: r.mean for r in spark.table("prof").collect()}
    assert got[1] == 2.0


def test_short_numbers_round_the_exact_value(spark):
    rng = random.Random(5)
    some = [0, 999, 1000, 1250, 1350, 1750, 999_949, 999_950, 999_999, 1_250_000, 273_450_000, 803_550_000, 999_950_000, 2**53 + 1, 2**63 - 1, None]
    some += [rng.randrange(20, 10**7) * 50_000 for _ in range(2000)] + [rng.randrange(1000, 10**6) for _ in range(2000)]
    want = lambda n: n if n is None else f"{n / 1e6:.1f}M" if n >= 10**6 else f"{n / 1e3:.1f}K" if n >= 1000 else str(n)
    got = spark.createDataFrame([(n,) for n in some], "n long").select("n", short_number(F.col("n")).alias("s")).collect()
    assert [r.s for r in got if r.s != want(r.n)] == [] and len(got) == len(some)
