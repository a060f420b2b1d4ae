import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from heliograph.functions import dims, scoring, stats
from heliograph.operators import campaigns, experiments, metrics, selection
from heliograph.operators import timeseries as ts
from heliograph.operators.common import prefix_sum

T0 = dt.datetime(2024, 1, 1)


def series(spark, values, step=6):
    rows = [("k", T0 + dt.timedelta(hours=step * i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "key string, ts timestamp, value double")


def last(spark, values, step=6):
    return ts.trend(series(spark, values, step), "key").orderBy(F.desc("ts")).first()


def test_velocity_examples(spark):
    assert last(spark, [100, 105, 110, 120, 130])["velocity"] == pytest.approx(0.30)
    assert last(spark, [0, 5, 10, 20, 30])["velocity"] == 0.0
    assert last(spark, [7])["velocity"] == 0.0


def test_trend_equals_scalar_restatement(spark):
    rng = random.Random(2)
    values = [rng.choice([0.0, 5.0, 9.0, 20.0]) for _ in range(30)]

    def velocity(pts):
        if len(pts) < 2:
            return 0.0
        now, v = pts[-1]
        past = [x for t, x in pts[:-1] if t <= now - 24]
        base = past[-1] if past else pts[0][1]
        return (v - base) / base if base else 0.0

    points = [(5 * i, v) for i, v in enumerate(values)]
    got = ts.trend(series(spark, values, 5), "key").orderBy("ts").collect()
    for i, row in enumerate(got):
        upto = points[: i + 1]
        sub = [p for p in upto if p[0] <= upto[-1][0] - 6]
        want = velocity(upto) - (velocity(sub) if len(sub) >= 2 else 0.0) if len(upto) >= 3 else 0.0
        assert row["velocity"] == pytest.approx(velocity(upto)) and row["acceleration"] == pytest.approx(want)


def test_states(spark):
    df = spark.createDataFrame([(1.5, 0.1), (0.3, 0.1), (-0.2, 0.0), (0.01, 0.0), (0.1, 0.0)], "v double, a double")
    got = [r[0] for r in df.select(scoring.trend_state(F.col("v"), F.col("a"))).collect()]
    assert got == ["viral", "rising", "falling", "peaking", "stable"]


def test_decay_half_life(spark):
    df = spark.createDataFrame([(T0,), (T0 + dt.timedelta(days=30),)], "t timestamp")
    got = [r[0] for r in df.select(100 * scoring.time_decay(F.col("t"), F.lit("2024-01-08"))).collect()]
    assert got == [pytest.approx(50.0), 100.0]


def test_attribution(spark):
    raw = spark.createDataFrame([("a", 72, 0.75, 75.0), ("b", 24, 0.40, 40.0), ("b", 168, 0.95, 95.0)], "content_id string, hours int, correction double, raw double")
    assert {r[0]: r[1] for r in ts.attribution_total(raw).collect()} == pytest.approx({"a": 100.0, "b": 100.0})
    jobs = ts.schedule(spark.createDataFrame([("a", T0)], "content_id string, published_at timestamp")).collect()
    assert [(r["run_at"] - T0).total_seconds() / 3600 for r in jobs] == [h for h, _x in dims.CHECKPOINTS.values()]


def test_seasonal_boost_stays_in_bounds(spark):
    rows = [(T0 + dt.timedelta(days=i), 10.0 + i % 7 * 40) for i in range(60)]
    df = spark.createDataFrame(rows, "ts timestamp, value double")
    got = [r["boost"] for r in ts.with_seasonal_boost(df, "ts", ts.seasonal_index(df, "ts", "value")).collect()]
    assert min(got) >= 0.5 and max(got) <= 2.0 and len(got) == 60
    zero = df.withColumn("value", F.lit(0.0))
    assert {r["index"] for r in ts.seasonal_index(zero, "ts", "value").collect()} == {1.0}


def test_revenue(spark):
    df = spark.createDataFrame([("blog", "joy", []), ("blog", "joy", ["copyright_risk"]), ("none", "odd", list(dims.RISK_WEIGHTS))], "p string, e string, f array<string>")
    got = [r[0] for r in df.select(scoring.revenue_score(F.col("p"), F.col("e"), F.col("f"))).collect()]
    assert got == [pytest.approx(1.725 * 4.5 * 1.2), pytest.approx(1.725 * 4.5 * 1.2 * 0.6), pytest.approx(0.0)]


def test_ctr_posterior_rejects_impossible_rows(spark):
    log = spark.createDataFrame([("blog", 50, 100), ("blog", 5, 1), ("new", 0, 10)], "platform string, clicks int, impressions int")
    got = {r["platform"]: (r["alpha"], r["beta"]) for r in selection.ctr_posterior(log).collect()}
    assert got["blog"] == (52.0, 148.0) and got["new"] == (1.0, 109.0) and got["youtube"] == (4.0, 96.0)


def test_fold_equals_sequential_updates(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), i, rng.gauss(0, 6)) for i in range(900)]
    want = {"a": 1.0, "b": 1.0}
    for c, _i, s in rows:
        want[c] = max(0.01, min(10.0, want[c] + s))
    df = spark.createDataFrame(rows, "c string, i long, s double")
    folded = selection.fold_steps(df, "c", "i", "s", chunk=7)
    got = {r[0]: r[1] for r in folded.select("c", selection.apply_fold(F.lit(1.0), F.col("f"))).collect()}
    assert got == pytest.approx(want)


def test_prefix_sum(spark):
    rng = random.Random(8)
    rows = [(rng.choice("xyz"), i, rng.randrange(9)) for i in range(300)]
    want, run = {}, {}
    for k, i, v in rows:
        run[k] = run.get(k, 0) + v
        want[i] = run[k]
    df = spark.createDataFrame(rows, "k string, i long, v int")
    assert {r["i"]: r["out"] for r in prefix_sum(df, ["k"], "i", F.col("v"), "out", chunk=16).collect()} == want


def test_selector_rules(spark):
    df = spark.createDataFrame([(i, f"t{i % 2}", 1.0 / (i + 1)) for i in range(10)], "id int, topic string, final_score double")
    first = selection.thompson_select(df, "id", F.col("topic"), "blog", 5, seed=1).collect()
    again = selection.thompson_select(df.repartition(7), "id", F.col("topic"), "blog", 5, seed=1).collect()
    assert first == again and len(first) == 4 and max(sum(r["topic"] == t for r in first) for t in ("t0", "t1")) == 2
    assert selection.thompson_select(df, "id", F.col("topic"), "blog", 0, seed=1).count() == 0
    quota = selection.platform_quota(spark.range(300).select("id", F.lit("instagram").alias("p")), "p", "id")
    assert quota.count() == 200
    assert selection.platform_quota(spark.range(300).select("id", F.lit("odd").alias("p")), "p", "id").count() == 300


def test_portfolio_weights(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 10.0), ("b", 10.5), ("c", -1.0), ("c", -2.0)], "k string, v double")
    got = {r[0]: r[1] for r in selection.inverse_variance_weights(df, "k", "v").collect()}
    assert sum(got.values()) == pytest.approx(1.0) and got["b"] > got["a"] >= got["c"] > 0


def test_assignment_and_results(spark):
    definitions = spark.createDataFrame(
        [("e", ["A", "B"], [0.5, 0.5]), ("bad", ["A", "B"], [0.5, 0.6]), ("one", ["A"], [1.0])],
        "experiment_id string, variants array<string>, traffic_split array<double>",
    )
    variants = experiments.create(definitions)
    assert {r["experiment_id"] for r in variants.collect()} == {"e"}
    units = spark.range(2000).select(F.lit("e").alias("experiment_id"), F.concat(F.lit("u"), "id").alias("unit_id"))
    arms = {r["variant"]: r["count"] for r in experiments.assign(units, variants).groupBy("variant").count().collect()}
    assert abs(arms["A"] - 1000) < 120
    rows = [("e", "A", 1.0)] * 30 + [("e", "B", 5.0)] * 30
    result = experiments.results(spark.createDataFrame(rows, "experiment_id string, variant string, metric double"), variants).first()
    assert result["winner"] == "B" and result["significant"] and result["p_value"] < 0.05
    flat = [("e", "A", 2.0)] * 30 + [("e", "B", 2.0)] * 30
    same = experiments.results(spark.createDataFrame(flat, "experiment_id string, variant string, metric double"), variants).first()
    assert same["winner"] is None and not same["significant"]


def test_mann_whitney_equals_pair_counting(spark):
    rng = random.Random(6)
    a, b = [rng.randrange(20) / 2 for _ in range(70)], [rng.randrange(26) / 2 for _ in range(50)]
    u1 = sum((x > y) + 0.5 * (x == y) for x in b for y in a)
    rows = [("e", "c", float(v)) for v in a] + [("e", "t", float(v)) for v in b]
    got = experiments.mann_whitney(spark.createDataFrame(rows, "experiment_id string, variant string, metric double"), "c", "t").first()
    assert got["u"] == min(u1, 70 * 50 - u1)


def test_t_distribution(spark):
    df = spark.createDataFrame([(2.228, 10.0), (0.0, 5.0), (12.706, 1.0)], "t double, d double")
    got = [r[0] for r in df.select(stats.t_two_sided("t", "d")).collect()]
    assert got == [pytest.approx(0.05, abs=1e-4), pytest.approx(1.0), pytest.approx(0.05, abs=1e-4)]


def test_campaign_match_and_boost(spark):
    nodes = spark.createDataFrame([("n", ["ai", "tech", "gpu"], ["Q1"]), ("m", ["x"], [])], "node_id string, tags array<string>, qids array<string>")
    rows = [("e1", ["ai", "tech", "robotics"], [], 5.0), ("e2", ["other"], ["Q1"], 1.5), ("e3", ["Q1", "z"], [], 0.5), ("e4", ["no"], [], 9.0)]
    events = spark.createDataFrame(rows, "event_id string, tags array<string>, qids array<string>, boost_multiplier double")
    matched = campaigns.match(nodes, events)
    assert {r["event_id"]: r["match_score"] for r in matched.collect()} == {"e1": 0.5, "e2": 1.0, "e3": 1.0}
    assert {r[0]: r[1] for r in campaigns.boost(nodes, matched).collect()} == {"n": 3.0, "m": 1.0}


def test_histogram_quantile(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 101)], "v double")
    hist = metrics.cumulative_histogram(df, "v", (10.0, 50.0, 100.0))
    assert metrics.histogram_quantile(hist, 0.95).first()["quantile"] == pytest.approx(95.0)
    wide = metrics.cumulative_histogram(df, "v", (10.0,))
    assert metrics.histogram_quantile(wide, 0.95).first()["quantile"] == 10.0
