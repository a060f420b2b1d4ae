import heapq
import random

import pytest
from pyspark.sql import functions as F

from heliograph import session
from heliograph.operators import graph
from heliograph.operators.versions import GraphVersions
from heliograph.plans import load_catalog
from heliograph.session import cut_lineage, scratch
from heliograph.sources import stores

EDGES = "from_node string, to_node string, relation_type string, weight double"
SMALL = [("a", "b", "related_to", 0.8), ("b", "c", "related_to", 0.5), ("a", "d", "causes", 0.9)]


def rank(nodes, edges, rounds=50, d=0.85):
    n = len(nodes)
    r = {v: 1 / n for v in nodes}
    out = {v: sum(w for s, _t, _r, w in edges if s == v) for v in nodes}
    for _ in range(rounds):
        lost = sum(r[v] for v in nodes if out[v] == 0)
        new = {v: (1 - d + d * lost) / n for v in nodes}
        for s, t, _r, w in edges:
            new[t] += d * r[s] * w / out[s]
        r = new
    total = sum(r.values())
    return {v: x / total for v, x in r.items()}


@pytest.mark.parametrize("hub_split", [100_000, 2])
def test_pagerank_with_dangling_nodes_and_sliced_hubs(spark, hub_split):
    edges = [("0", "1", "causes", 1.0), ("1", "2", "causes", 0.5), ("2", "0", "causes", 1.0), ("3", "0", "causes", 2.0),
             ("3", "4", "causes", 0.1), ("3", "1", "causes", 0.2), ("3", "2", "causes", 0.2), ("0", "1", "leads_to", 0.3)]
    nodes = [str(i) for i in range(6)]
    got = graph.pagerank(spark.createDataFrame([(v,) for v in nodes], "id string"), spark.createDataFrame(edges, EDGES), hub_split=hub_split)
    got = {r["id"]: r["rank"] for r in got.collect()}
    assert sum(got.values()) == pytest.approx(1.0) and got == pytest.approx(rank(nodes, edges))


def test_neighbors(spark):
    edges = spark.createDataFrame(SMALL + [("c", "a", "causes", 0.7)], EDGES)
    assert {r["node_id"] for r in graph.neighbors(edges, "a").collect()} == {"b", "d"}
    assert {r["node_id"] for r in graph.neighbors(edges, "a", relation="causes").collect()} == {"d"}
    far = {r["node_id"]: r["hops"] for r in graph.neighbors(edges, "a", max_hops=4).collect()}
    assert far == {"b": 1, "d": 1, "c": 2, "a": 3}


def test_propagation_counts_walks(spark):
    rng = random.Random(5)
    names = "abcdefg"
    rows = [(s, t, "causes", round(rng.random(), 3)) for s in names for t in names if s != t and rng.random() < 0.4]

    def walk(seed, hops):
        total, level = {}, [(seed, 1.0)]
        for _ in range(hops):
            level = [(t, x * w * 0.5) for v, x in level for s, t, _r, w in rows if s == v]
            for t, x in level:
                total[t] = total.get(t, 0.0) + x
        total.pop(seed, None)
        return total

    got = graph.propagate(spark.createDataFrame(rows, EDGES), spark.createDataFrame([("a",), ("b",)], "id string"), hops=3)
    for seed in "ab":
        assert {r["node_id"]: r["influence"] for r in got.filter(F.col("seed") == seed).collect()} == pytest.approx(walk(seed, 3))


def test_shortest_paths_equal_dijkstra(spark):
    rng = random.Random(9)
    rows = [(f"n{s}", f"n{t}", "causes", rng.choice([0.0, 0.1, 0.5, 0.9])) for s in range(12) for t in range(12) if s != t and rng.random() < 0.25]
    best, heap = {"n0": 0.0}, [(0.0, "n0")]
    while heap:
        cost, v = heapq.heappop(heap)
        for s, t, _r, w in rows:
            if s == v and w > 0 and cost + 1 / w < best.get(t, 1e9) - 1e-12:
                best[t] = cost + 1 / w
                heapq.heappush(heap, (best[t], t))
    edges = spark.createDataFrame(rows, EDGES)
    assert {r["id"]: r["cost"] for r in graph.shortest_paths(edges, "n0").collect()} == pytest.approx(best)
    assert graph.shortest_path(edges, "n0", "missing").count() == 0
    assert {r["id"]: r["cost"] for r in graph.shortest_paths(edges, "n0", paths=False).collect()} == pytest.approx(best)


def test_nodes_without_edges_add_no_rounds_to_a_shortest_path(spark, monkeypatch):
    """Leaves at 5 to 100 are far beyond an average step; a node that sends nothing waits for no round."""
    rows = [("n0", f"hub{i}", "causes", 1.0) for i in range(20)]
    rows += [(f"hub{i}", f"leaf{i}_{j}", "causes", 1.0 / (5 * (j + 1))) for i in range(20) for j in range(20 if i == 0 else 2)]
    written = []
    monkeypatch.setattr(graph, "cut_lineage", lambda df: written.append(1) or cut_lineage(df))
    row = graph.shortest_path(spark.createDataFrame(rows, EDGES), "n0", "leaf0_19").first()
    assert row["cost"] == pytest.approx(101.0) and row["path"] == ["n0", "hub0", "leaf0_19"]
    assert len(written) <= 8


def test_endpoints_and_validation(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    good, bad = graph.split_by_endpoints(spark.createDataFrame(SMALL, EDGES), nodes)
    assert (good.count(), bad.count()) == (1, 2)
    good, bad = graph.build_edges(spark.createDataFrame([("a", "b", "causes", None), ("a", "b", "odd", 1.0)], EDGES))
    assert good.first()["weight"] == 0.8 and bad.count() == 1


def test_node_merge_rules(spark):
    log = spark.createDataFrame(
        [("x", "topic", "first", 0.2, None, 1), ("x", "entity", "later", 0.9, [1.0], 2), ("x", "topic", "last", 0.1, [2.0], 3)],
        "id string, type string, name string, weight double, embedding array<double>, seq int",
    )
    assert tuple(graph.merge_nodes(log).first()) == ("x", "topic", "first", 0.9, [1.0])
    assert stores.current_graph(log, ["id"]).first()["name"] == "last"


def test_versions_keep_diff_and_rollback(spark):
    store = GraphVersions(spark, scratch(spark, "t"), keep=3)
    nodes = spark.createDataFrame([(v, "topic", v, 1.0) for v in "abcd"], "id string, type string, name string, weight double")
    edges = spark.createDataFrame(SMALL, EDGES)
    more = nodes.unionByName(spark.createDataFrame([("e", "topic", "e", 1.0)], nodes.schema))
    links = edges.unionByName(spark.createDataFrame([("a", "e", "causes", 0.4)], EDGES))
    assert store.create(nodes, edges, "one") == 1 and store.create(more, links, "two") == 2
    assert {tuple(r) for r in store.diff(1, 2).collect()} == {("node", "added", "e"), ("edge", "added", "a->e:causes")}
    assert {r["key"] for r in store.delta(2).collect()} == {"e", "a->e:causes"}
    assert store.rollback(1) == 3 and store.read(3)[0].count() == 4
    store.create(nodes, edges, "four")
    assert [r["version"] for r in store.list().collect()] == [2, 3, 4]
    with pytest.raises(KeyError):
        store.read(1)


def test_graph_score_minmax(spark):
    rows = [("x", 10.0, 0.1, 0.5, 0.0), ("y", 20.0, 0.2, 0.5, 0.0), ("z", 30.0, 0.1, 0.5, 0.0)]
    df = spark.createDataFrame(rows, "node_id string, edge_sum double, centrality double, trend_score double, event_boost double")
    got = {r["node_id"]: r["score"] for r in graph.graph_score(df).collect()}
    assert got == pytest.approx({"x": 0.0, "y": 0.15 + 0.25, "z": 0.30})


def test_bootstrap_seeds_only_an_empty_graph(spark):
    payload = spark.createDataFrame(
        [('{"nodes":[{"id":"a","type":"topic","name":"A"}],"edges":[{"from_node":"a","to_node":"a","relation_type":"causes"}]}',)], "payload string"
    )
    nodes = spark.createDataFrame([], "id string, type string, name string, weight double")
    edges = spark.createDataFrame([], EDGES)
    seeded, links = stores.bootstrap(nodes, edges, payload)
    assert seeded.first()["weight"] == 1.0 and links.first()["weight"] == 0.8
    assert stores.bootstrap(seeded, links, payload)[0].count() == 1
    assert stores.bootstrap(seeded, links, payload, force=True)[0].count() == 1


def test_pagerank_rounds_have_tasks_by_links_and_not_by_the_session(spark):
    assert graph.link_parts(100, 12) == 1
    assert graph.link_parts(3_600_000, 12) == 12
    assert graph.link_parts(36_000_000, 12) == 36
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    nodes = spark.range(50).select(F.concat(F.lit("n"), "id").alias("id"))
    edges = spark.range(49).select(F.concat(F.lit("n"), "id").alias("from_node"), F.concat(F.lit("n"), F.col("id") + 1).alias("to_node"), F.lit("r").alias("relation_type"), F.lit(1.0).alias("weight"))
    tracker = spark.sparkContext.statusTracker()
    spark.conf.set(name, "150")
    spark.sparkContext.setJobGroup("ranks", "ranks")
    try:
        ranks = graph.pagerank(nodes, edges, iterations=8).collect()
        assert spark.conf.get(name) == "150"
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("ranks")]
        stages = [tracker.getStageInfo(s) for j in jobs if j for s in j.stageIds]
        wide = [s.numTasks for s in stages if s and s.numTasks >= 150]
    finally:
        spark.conf.set(name, before)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert abs(sum(r["rank"] for r in ranks) - 1.0) < 1e-9 and len(ranks) == 50
    assert not wide


def test_endpoint_check_and_store_have_tasks_by_rows_and_not_by_the_session(spark, tmp_path, monkeypatch):
    tables = {
        "region": ([(0, "R")], "r_regionkey long, r_name string"),
        "nation": ([(0, "N", 0)], "n_nationkey long, n_name string, n_regionkey long"),
        "supplier": ([(i, f"S{i}", 0, 100.0) for i in range(10)], "s_suppkey long, s_name string, s_nationkey long, s_acctbal double"),
        "part": ([(i, f"P{i}") for i in range(200)], "p_partkey long, p_name string"),
        "customer": ([(i, f"C{i}", 0) for i in range(20)], "c_custkey long, c_name string, c_nationkey long"),
        "lineitem": ([(i % 10, i % 201, 5.0) for i in range(2010)], "l_suppkey long, l_partkey long, l_quantity double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    settings = {"spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    tracker = spark.sparkContext.statusTracker()
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        for query, least, count in (("edge_endpoint_check", 40, 41), ("graph_persist", 80, 41 + 232)):
            spark.sparkContext.setJobGroup(query, query)
            assert load_catalog()[0][query](spark, str(tmp_path)).count() == 2010 + count
            jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(query)]
            stages = [tracker.getStageInfo(s) for j in jobs if j for s in j.stageIds]
            assert max(s.numTasks for s in stages if s) >= least
            assert spark.conf.get("spark.sql.shuffle.partitions") == "1"
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_pagerank_lets_shuffle_files_go_with_each_step(spark, monkeypatch):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, seen, stored = spark.conf.get(name), [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: seen.append(spark.conf.get(name)) or stored(df))
    nodes = spark.createDataFrame([(c,) for c in "abcd"], "id string")
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("a", "c", 1.0)], "from_node string, to_node string, weight double")
    ranks = {r.id: r["rank"] for r in graph.pagerank(nodes, edges, iterations=5).collect()}
    assert set(seen) == {"true"} and spark.conf.get(name) == before
    assert abs(sum(ranks.values()) - 1) < 1e-12 and ranks["c"] > ranks["b"] > ranks["a"] == ranks["d"]
