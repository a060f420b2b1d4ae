"""Operators whose plan must not grow with one hot key, one long interval or one far target."""

import heapq
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from heliograph.operators import campaigns as cp
from heliograph.operators import common, graph, selection


def dijkstra(edges, source):
    steps = {}
    for a, b, w in edges:
        if w > 0:
            steps.setdefault(a, {})[b] = min(1.0 / w, steps.get(a, {}).get(b, 1e9))
    cost, heap = {source: 0.0}, [(0.0, source)]
    while heap:
        c, a = heapq.heappop(heap)
        if c > cost[a]:
            continue
        for b, s in steps.get(a, {}).items():
            if c + s < cost.get(b, 1e18):
                cost[b] = c + s
                heapq.heappush(heap, (c + s, b))
    return cost, steps


def test_shortest_path_equals_dijkstra(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}", rng.choice([0.0, 0.1, 0.5, 0.9, 2.0])) for _ in range(220)]
    edges += [("far", "n0", 1.0)]
    df = spark.createDataFrame([(a, b, "r", w) for a, b, w in edges], "from_node string, to_node string, relation_type string, weight double")
    cost, steps = dijkstra(edges, "n0")
    last = max(cost, key=cost.get)
    for target in (last, "n0"):
        row = graph.shortest_path(df, "n0", target).collect()
        assert len(row) == 1 and row[0]["cost"] == pytest.approx(cost[target])
        path = row[0]["path"]
        assert path[0] == "n0" and path[-1] == target
        assert sum(steps[a][b] for a, b in zip(path, path[1:], strict=False)) == pytest.approx(cost[target])
    assert graph.shortest_path(df, "n0", "far").count() == 0
    assert graph.shortest_path(df.limit(0), "n0", "n1").count() == 0


def test_campaign_blocks_are_few_and_exact(spark):
    rng = random.Random(5)
    start = datetime(1995, 3, 5, 7, 30)
    rows = [("century", start, start + timedelta(days=11_000)), ("hour", start, start), ("odd", start + timedelta(days=2), start), ("none", None, start)]
    for i in range(40):
        low = start + timedelta(minutes=rng.randrange(600_000))
        rows.append((f"c{i}", low, low + timedelta(minutes=rng.randrange(1, 90_000))))
    camps = spark.createDataFrame(rows, "event_id string, start_date timestamp_ntz, end_date timestamp_ntz")
    sizes = {r["event_id"]: r["n"] for r in cp.laid_out(camps).groupBy("event_id").agg(F.count("*").alias("n")).collect()}
    assert sizes["century"] <= 2 * 19 and sizes["hour"] == 1 and "odd" not in sizes and "none" not in sizes
    times = [start + timedelta(minutes=rng.randrange(-1000, 700_000)) for _ in range(300)] + [start, rows[5][1], rows[6][2]]
    points = spark.createDataFrame([(i, x) for i, x in enumerate(times)], "p long, ts timestamp_ntz")
    got = sorted((r["p"], r["event_id"]) for r in cp.interval_join(points, "ts", camps).collect())
    want = sorted((i, e) for i, x in enumerate(times) for e, a, b in rows if a is not None and a <= x <= b)
    assert got == want
    assert cp.interval_join(points, "ts", camps.limit(0)).count() == 0


def test_a_tag_of_all_nodes_is_no_key(spark):
    rng = random.Random(6)
    names = [f"t{i}" for i in range(200)]
    nodes = [(i, ["everyone", *rng.sample(names, 5)], [f"q{i % 7}"] if i % 3 == 0 else None) for i in range(400)] + [(400, None, None), (401, [], ["t1"])]
    camps = [(f"e{i}", 1.5, ["everyone", *rng.sample(names, 4)], [f"q{i}"]) for i in range(60)] + [("e98", 1.0, ["everyone"], None), ("e99", 1.0, None, None)]
    left = spark.createDataFrame(nodes, "node_id long, tags array<string>, qids array<string>")
    right = spark.createDataFrame(camps, "event_id string, boost_multiplier double, tags array<string>, qids array<string>")
    got = {(r["node_id"], r["event_id"]): r["match_score"] for r in cp.match(left, right).collect()}
    want = {}
    for n, tags, qids in nodes:
        for e, _, others, q in camps:
            a, b = set(tags or []), set(others or [])
            j = len(a & b) / len(a | b) if a | b else 0.0
            hit = bool(set(qids or []) & (set(q or []) | b))
            if hit or (a & b and j >= 0.30):
                want[n, e] = max(j, float(hit))
    assert got == pytest.approx(want) and got.keys() == want.keys()
    keys = left.select(F.explode(cp.tag_prefixes([left, right], 0.30)).alias("k")).filter("k = 'everyone'").count()
    assert keys == 0  # it is last in the order, and 6 tags have 5 keys


def test_running_sums_over_many_chunks(spark):
    rows = [(i % 2, i, i % 5) for i in range(9000)]
    df = spark.createDataFrame(rows, "k int, seq long, v long")
    got = {(r["k"], r["seq"]): r["s"] for r in common.prefix_sum(df, ["k"], "seq", F.col("v"), "s", chunk=1).collect()}
    sums = {0: 0, 1: 0}
    for k, i, v in rows:
        sums[k] += v
        assert got[k, i] == sums[k]


def test_quota_of_a_hot_platform_is_cut_before_the_shuffle(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 10 == 0, F.lit("elsewhere")).otherwise("blog").alias("platform"), F.col("id").alias("seq"))
    cut = selection.platform_quota(df, "platform", "seq")
    by = {r["platform"]: r["n"] for r in cut.groupBy("platform").agg(F.count("*").alias("n")).collect()}
    quota = selection.dims.PLATFORMS["blog"][1]
    assert by == {"elsewhere": 500, "blog": quota}
    assert sorted(r["seq"] for r in cut.filter("platform = 'blog'").collect()) == [i for i in range(5000) if i % 10][:quota]
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan or "WindowGroupLimit" in cut._jdf.queryExecution().executedPlan().toString()
