"""Graph construction, walks, ranking, dashboard reads and versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograph.functions import dims, text
from heliograph.operators import graph, versions
from heliograph.plans import star_graph
from heliograph.plans.registry import query
from heliograph.plans.star_graph import SQL as G
from heliograph.plans.text_queries import sql_case
from heliograph.session import bounded_tasks, cut_lineage, scratch

c = F.col  # resolved lazily, per call


def with_g(sql: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{G} {sql}"


# -- building -----------------------------------------------------------------
SQL_DEFAULT = sql_case(dims.RELATION_WEIGHTS, "relation_type", "0.5")


@query(
    "edge_default_weight",
    with_g(f"SELECT from_node, to_node, relation_type, ({SQL_DEFAULT})::double AS default_weight FROM edges"),
)
def _(t):
    return star_graph.edges(t).select(
        "from_node", "to_node", "relation_type", graph.default_weight(c("relation_type")).alias("default_weight")
    )


def raw_edges(t):
    """The star edges with customer links under an unknown relation and no weight on supplier links."""
    e = star_graph.edges(t)
    relation = F.when(c("relation_type") == "leads_to", "buys_from").otherwise(c("relation_type"))
    weight = F.when(~c("relation_type").isin("related_to", "causes"), c("weight"))
    return e.select("from_node", "to_node", relation.alias("relation_type"), weight.alias("weight"))


@query(
    "build_edges",
    with_g(f"""
    SELECT from_node, to_node, relation_type,
           CASE WHEN relation_type IN ('related_to', 'causes') THEN ({SQL_DEFAULT})::double ELSE weight END AS weight,
           'edge' AS outcome FROM edges WHERE relation_type <> 'leads_to'
    UNION ALL SELECT from_node, to_node, 'buys_from', weight, 'rejected' FROM edges WHERE relation_type = 'leads_to'
    """),
)
def _(t):
    good, bad = graph.build_edges(raw_edges(t))
    return good.withColumn("outcome", F.lit("edge")).unionByName(bad.withColumn("outcome", F.lit("rejected")))


@query(
    "build_nodes",
    r"""
    SELECT 'topic:' || regexp_replace(regexp_replace(lower(n_name), '\s+', '_', 'g'), '[^a-z0-9_:-]', '', 'g') AS id,
           'topic' AS type, n_name AS name, 1.0::double AS weight, 'node' AS outcome FROM nation
    UNION ALL
    SELECT 'product:' || regexp_replace(regexp_replace(lower(p_name || ' ' || p_partkey), '\s+', '_', 'g'), '[^a-z0-9_:-]', '', 'g'),
           'product', p_name || ' ' || p_partkey, p_retailprice / 1000.0, 'node' FROM part
    UNION ALL
    SELECT 'place:' || regexp_replace(regexp_replace(lower(r_name), '\s+', '_', 'g'), '[^a-z0-9_:-]', '', 'g'),
           'place', r_name, 1.0::double, 'rejected' FROM region
    """,
)
def _(t):
    raw = (
        t.nation.select(F.lit("topic").alias("t"), c("n_name").alias("n"), F.lit(1.0).alias("w"))
        .unionByName(
            t.part.select(
                F.lit("product").alias("t"), F.concat_ws(" ", "p_name", "p_partkey").alias("n"),
                (c("p_retailprice") / 1000.0).alias("w"),
            )
        )
        .unionByName(t.region.select(F.lit("place").alias("t"), c("r_name").alias("n"), F.lit(1.0).alias("w")))
    )
    good, bad = graph.build_nodes(raw, c("t"), c("n"), c("w"))
    cols = ["id", "type", "name", "weight"]
    return (
        good.select(*cols, F.lit("node").alias("outcome")).unionByName(bad.select(*cols, F.lit("rejected").alias("outcome")))
    )


def node_log(t):
    """Two ingest batches: the star nodes, then supplier rows under another name
    and weight, with a vector."""
    first = star_graph.nodes(t).withColumns({"seq": F.lit(1), "embedding": F.lit(None).cast("array<double>")})
    second = t.supplier.select(
        F.concat(F.lit("entity:supplier_"), "s_suppkey").alias("id"),
        F.lit("entity").alias("type"),
        F.concat(F.lit("renamed "), "s_name").alias("name"),
        (c("s_acctbal") / 10000.0).alias("weight"),
        F.lit(2).alias("seq"),
        F.array(c("s_acctbal"), F.lit(1.0)).alias("embedding"),
    )
    return first.unionByName(second)


@query(
    "node_upsert_merge",
    with_g("""
    SELECT n.id, n.type, n.name, round(greatest(n.weight, coalesce(s.s_acctbal / 10000.0, n.weight)), 6) AS weight,
           CASE WHEN s.s_suppkey IS NULL THEN 0 ELSE 2 END AS dim
    FROM nodes n LEFT JOIN supplier s ON n.id = 'entity:supplier_' || s.s_suppkey
    """),
)
def _(t):
    dim = F.coalesce(F.size("embedding"), F.lit(0))
    return graph.merge_nodes(node_log(t)).select(
        "id", "type", "name", F.round("weight", 6).alias("weight"), F.when(dim > 0, dim).otherwise(0).alias("dim")
    )


def edge_log(t):
    """Edges as seen line by line: one row per sale, so pairs repeat."""
    return t.lineitem.select(
        F.concat(F.lit("entity:supplier_"), "l_suppkey").alias("from_node"),
        F.concat(F.lit("product:part_"), "l_partkey").alias("to_node"),
        F.lit("monetizes_via").alias("relation_type"),
        (c("l_quantity") / 100.0).alias("weight"),
        (c("l_orderkey") * 8 + c("l_linenumber")).alias("seq"),
    )


@query(
    "edge_dedup_max",
    """
    SELECT 'entity:supplier_' || l_suppkey AS from_node, 'product:part_' || l_partkey AS to_node,
           'monetizes_via' AS relation_type, max(l_quantity / 100.0) AS weight
    FROM lineitem GROUP BY l_suppkey, l_partkey
    """,
)
def _(t):
    return graph.merge_edges(edge_log(t))


@query(
    "edge_endpoint_check",
    with_g("""
    , raw AS (SELECT from_node, CASE WHEN relation_type = 'leads_to' THEN to_node || '0' ELSE to_node END AS to_node, relation_type FROM edges)
    SELECT r.from_node, r.to_node, r.relation_type,
           r.from_node IN (SELECT id FROM nodes) AND r.to_node IN (SELECT id FROM nodes) AS accepted FROM raw r
    """),
)
def _(t):
    to_node = F.when(c("relation_type") == "leads_to", F.concat("to_node", F.lit("0"))).otherwise(c("to_node"))
    raw = star_graph.edges(t).select("from_node", to_node.alias("to_node"), "relation_type")
    with bounded_tasks(t.spark, t.lineitem.count()):
        good, bad = graph.split_by_endpoints(raw, star_graph.nodes(t))
    return good.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False)))


@query(
    "graph_scan",
    with_g("""
    SELECT 'node' AS kind, id, type, name, weight FROM nodes
    UNION ALL SELECT 'edge', from_node || '->' || to_node || ':' || relation_type, relation_type, to_node, weight FROM edges
    """),
)
def _(t):
    n = star_graph.nodes(t).select(F.lit("node").alias("kind"), "id", "type", "name", "weight")
    e = star_graph.edges(t).select(
        F.lit("edge").alias("kind"),
        text.edge_id(c("from_node"), c("to_node"), c("relation_type")).alias("id"),
        c("relation_type").alias("type"),
        c("to_node").alias("name"),
        "weight",
    )
    return n.unionByName(e)


@query("node_lookup", with_g("SELECT * FROM nodes WHERE id = 'entity:supplier_7'"))
def _(t):
    return star_graph.nodes(t).filter(c("id") == "entity:supplier_7")


# -- walks ----------------------------------------------------------------------
@query(
    "neighbors_khop",
    with_g("""
    , h1 AS (SELECT to_node AS node_id, arg_min(struct_pack(r := relation_type, w := weight), (from_node, relation_type)) AS v
             FROM edges WHERE from_node = 'topic:nation_0' GROUP BY to_node),
    h2 AS (SELECT e.to_node AS node_id, arg_min(struct_pack(r := relation_type, w := weight), (from_node, relation_type)) AS v
           FROM edges e WHERE e.from_node IN (SELECT node_id FROM h1 WHERE node_id <> 'topic:nation_0')
             AND e.to_node NOT IN (SELECT node_id FROM h1) GROUP BY e.to_node)
    SELECT node_id, v.r AS relation, v.w AS weight, 1 AS hops FROM h1
    UNION ALL SELECT node_id, v.r, v.w, 2 FROM h2
    """),
)
def _(t):
    return graph.neighbors(star_graph.edges(t), "topic:nation_0", max_hops=2)


@query(
    "propagate_scores",
    with_g("""
    , h1 AS (SELECT n.id AS seed, e.to_node AS node_id, sum(e.weight * 0.5) AS x FROM nodes n JOIN edges e ON e.from_node = n.id
             WHERE n.type = 'topic' GROUP BY 1, 2),
    h2 AS (SELECT h.seed, e.to_node AS node_id, sum(h.x * e.weight * 0.5) AS x FROM h1 h JOIN edges e ON e.from_node = h.node_id GROUP BY 1, 2)
    SELECT seed, node_id, round(sum(x), 6) AS influence FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2)
    WHERE seed <> node_id GROUP BY seed, node_id
    """),
)
def _(t):
    seeds = star_graph.nodes(t).filter(c("type") == "topic")
    spread = graph.propagate(star_graph.edges(t), seeds, hops=2)
    return spread.select("seed", "node_id", F.round("influence", 6).alias("influence"))


@query(
    "shortest_path",
    with_g("""
    , walk AS (
        SELECT 0 AS depth, 'audience:customer_0' AS id, 0.0::double AS cost, ['audience:customer_0'] AS path
        UNION ALL
        SELECT depth + 1, e.to_node, cost + 1.0 / e.weight, list_append(path, e.to_node)
        FROM walk w JOIN edges e ON e.from_node = w.id
        WHERE e.weight > 0 AND depth < 6 AND NOT list_contains(path, e.to_node)
    )
    SELECT id, round(min(cost), 6) AS cost, array_to_string(arg_min(path, (cost, path)), ' > ') AS path FROM walk GROUP BY id
    """, recursive=True),
)
def _(t):
    paths = graph.shortest_paths(star_graph.edges(t), "audience:customer_0")
    return paths.select("id", F.round("cost", 6).alias("cost"), F.array_join("path", " > ").alias("path"))


@query(
    "shortest_path_between",
    with_g("""
    , walk AS (
        SELECT 0 AS depth, 'audience:customer_0' AS id, 0.0::double AS cost, ['audience:customer_0'] AS path
        UNION ALL
        SELECT depth + 1, e.to_node, cost + 1.0 / e.weight, list_append(path, e.to_node)
        FROM walk w JOIN edges e ON e.from_node = w.id
        WHERE e.weight > 0 AND depth < 6 AND NOT list_contains(path, e.to_node)
    ),
    far AS (SELECT id, min(cost) AS cost FROM walk GROUP BY id)
    SELECT id, round(cost, 6) AS cost FROM far WHERE id = (SELECT max_by(id, (round(cost, 6), id)) FROM far)
    """, recursive=True),
)
def _(t):
    """The node that is farthest from a customer, by the path between the two."""
    edges = cut_lineage(star_graph.edges(t).select("from_node", "to_node", "weight"))
    far = graph.shortest_paths(edges, "audience:customer_0", paths=False).agg(F.max_by("id", F.struct(F.round("cost", 6), "id"))).first()[0]
    return graph.shortest_path(edges, "audience:customer_0", far).select("id", F.round("cost", 6).alias("cost"))


@query(
    "induced_subgraph",
    with_g("""
    , ids AS (SELECT id FROM nodes WHERE weight >= 0.75)
    SELECT 'node' AS kind, id AS key, weight FROM nodes WHERE id IN (FROM ids)
    UNION ALL SELECT 'edge', from_node || '->' || to_node || ':' || relation_type, weight FROM edges
    WHERE from_node IN (FROM ids) AND to_node IN (FROM ids)
    """),
)
def _(t):
    n, e = star_graph.nodes(t), star_graph.edges(t)
    n2, e2 = graph.induced_subgraph(n, e, n.filter(c("weight") >= 0.75))
    key = text.edge_id(c("from_node"), c("to_node"), c("relation_type"))
    return n2.select(F.lit("node").alias("kind"), c("id").alias("key"), "weight").unionByName(
        e2.select(F.lit("edge").alias("kind"), key.alias("key"), "weight")
    )


# -- ranking ----------------------------------------------------------------------
SQL_DEGREE = "deg AS (SELECT from_node AS id, count(*) AS edge_sum, sum(weight) AS out_weight FROM edges GROUP BY from_node)"


@query(
    "out_degree",
    with_g(f""", {SQL_DEGREE} SELECT n.id, coalesce(edge_sum, 0) AS edge_sum, round(coalesce(out_weight, 0), 6) AS out_weight
    FROM nodes n LEFT JOIN deg USING (id)"""),
)
def _(t):
    return graph.out_degree(star_graph.nodes(t), star_graph.edges(t)).select(
        "id", "edge_sum", F.round("out_weight", 6).alias("out_weight")
    )


SQL_RANK = """
, ow AS MATERIALIZED (SELECT from_node AS id, sum(weight) AS w FROM edges GROUP BY from_node),
cnt AS MATERIALIZED (SELECT count(*)::double AS n FROM nodes),
pr AS (
    SELECT 0 AS i, id, 1.0 / n AS r FROM nodes, cnt
    UNION ALL
    SELECT max(i) + 1 AS i, id, sum(x) AS r FROM (
        SELECT p.i, e.to_node AS id, 0.85::double * p.r * e.weight / ow.w AS x
        FROM pr p JOIN ow ON ow.id = p.id JOIN edges e ON e.from_node = p.id WHERE p.i < 50
        UNION ALL
        SELECT d.i, nodes.id, (0.15::double + 0.85::double * d.lost) / cnt.n
        FROM nodes, cnt, (SELECT max(p.i) AS i, sum(CASE WHEN ow.id IS NULL THEN p.r ELSE 0 END) AS lost
                          FROM pr p LEFT JOIN ow ON ow.id = p.id WHERE p.i < 50) d WHERE d.i IS NOT NULL
    ) GROUP BY id
),
rank AS (SELECT id, r / (SELECT sum(r) FROM pr WHERE i = 50) AS rank FROM pr WHERE i = 50)
"""


@query("pagerank", with_g(SQL_RANK + "SELECT id, round(rank, 10) AS rank FROM rank", recursive=True))
def _(t):
    return graph.pagerank(star_graph.nodes(t), star_graph.edges(t)).select("id", F.round("rank", 10).alias("rank"))


def candidates(t):
    """Every node as a candidate: out-degree, in-weight share as centrality, weight
    as trend, supplier rating as event boost."""
    n, e = star_graph.nodes(t), star_graph.edges(t)
    into = e.groupBy(c("to_node").alias("id")).agg(F.sum("weight").alias("centrality"))
    return (
        graph.out_degree(n, e)
        .join(into, "id", "left")
        .select(
            c("id").alias("node_id"), "name", "type",
            c("edge_sum").cast("double").alias("edge_sum"),
            F.coalesce("centrality", F.lit(0.0)).alias("centrality"),
            c("weight").alias("trend_score"),
            F.length("name").cast("double").alias("event_boost"),
        )
    )


SQL_CAND = f"""
, {SQL_DEGREE},
inw AS (SELECT to_node AS id, sum(weight) AS centrality FROM edges GROUP BY to_node),
cand AS (SELECT n.id AS node_id, n.name, n.type, coalesce(edge_sum, 0)::double AS edge_sum, coalesce(centrality, 0.0) AS centrality,
                n.weight AS trend_score, length(n.name)::double AS event_boost
         FROM nodes n LEFT JOIN deg USING (id) LEFT JOIN inw USING (id)),
scored AS (SELECT *,
    0.30::double * (edge_sum - min(edge_sum) OVER ()) / (max(edge_sum) OVER () - min(edge_sum) OVER ())
  + 0.25::double * (centrality - min(centrality) OVER ()) / (max(centrality) OVER () - min(centrality) OVER ())
  + 0.30::double * (trend_score - min(trend_score) OVER ()) / (max(trend_score) OVER () - min(trend_score) OVER ())
  + 0.15::double * (event_boost - min(event_boost) OVER ()) / (max(event_boost) OVER () - min(event_boost) OVER ()) AS score
  FROM cand)
"""


@query("graph_minmax_score", with_g(SQL_CAND + "SELECT node_id, round(score, 6) AS score FROM scored"))
def _(t):
    return graph.graph_score(candidates(t)).select("node_id", F.round("score", 6).alias("score"))


@query(
    "top_k_by_score",
    with_g("""SELECT id AS node_id, name, weight AS score FROM nodes WHERE weight >= 0.35 ORDER BY weight DESC, id LIMIT 50"""),
)
def _(t):
    return graph.top_by_score(star_graph.nodes(t), c("weight"), 50).select(c("id").alias("node_id"), "name", "score")


# -- dashboard reads -----------------------------------------------------------------
def revenue_paths(nodes, edges, k: int):
    names = nodes.select("id", F.coalesce("name", "id").alias("label"))
    top = edges.filter(c("relation_type") == "monetizes_via").orderBy(F.desc("weight"), "from_node", "to_node").limit(k)
    src = names.select(c("id").alias("from_node"), c("label").alias("src"))
    dst = names.select(c("id").alias("to_node"), c("label").alias("dst"))
    return top.join(src, "from_node", "left").join(dst, "to_node", "left").select(
        F.coalesce("src", "from_node").alias("source"), F.coalesce("dst", "to_node").alias("target"), "weight",
        "from_node", "to_node",
    )


SQL_PATHS = """
, top AS (SELECT * FROM edges WHERE relation_type = 'monetizes_via' ORDER BY weight DESC, from_node, to_node LIMIT {k}),
paths AS (SELECT coalesce(a.name, from_node) AS source, coalesce(b.name, to_node) AS target, top.weight, from_node, to_node
          FROM top LEFT JOIN nodes a ON a.id = from_node LEFT JOIN nodes b ON b.id = to_node)
"""


@query("revenue_paths", with_g(SQL_PATHS.format(k=5) + "SELECT source, target, weight FROM paths"))
def _(t):
    return revenue_paths(star_graph.nodes(t), star_graph.edges(t), 5).select("source", "target", "weight")


@query(
    "content_queue",
    with_g(SQL_PATHS.format(k=4) + """
    , num AS (SELECT *, row_number() OVER (ORDER BY weight DESC, from_node, to_node) AS rn FROM paths)
    SELECT 'content-' || lpad(rn::varchar, 3, '0') AS id, source || ' → ' || target AS title,
           (['blog', 'youtube', 'newsletter', 'instagram'])[((rn - 1) % 4 + 1)::int] AS channel,
           (['draft', 'in_review', 'approved', 'published'])[((rn - 1) % 4 + 1)::int] AS status,
           round(0.6::double + weight * 0.4::double, 3) AS quality_score FROM num
    """),
)
def _(t):
    from pyspark.sql.window import Window as W

    top = revenue_paths(star_graph.nodes(t), star_graph.edges(t), 4)  # at most four rows
    rn = F.row_number().over(W.orderBy(F.desc("weight"), "from_node", "to_node"))
    slot = F.pmod(c("rn") - 1, F.lit(4)) + 1
    return top.withColumn("rn", rn).select(
        F.concat(F.lit("content-"), F.lpad(c("rn").cast("string"), 3, "0")).alias("id"),
        F.concat("source", F.lit(" → "), "target").alias("title"),
        F.element_at(dims.literal_array(["blog", "youtube", "newsletter", "instagram"]), slot).alias("channel"),
        F.element_at(dims.literal_array(["draft", "in_review", "approved", "published"]), slot).alias("status"),
        F.round(0.6 + c("weight") * 0.4, 3).alias("quality_score"),
    )


@query(
    "graph_payload",
    with_g(f"""
    SELECT 'node' AS kind, id AS a, name AS b, type AS c, weight, {sql_case({k: f"'{v}'" for k, v in dims.NODE_COLORS.items()}, 'type', "'#8892a6'")} AS color FROM nodes
    UNION ALL SELECT 'link', from_node, to_node, relation_type, weight, NULL FROM edges
    """),
)
def _(t):
    n = star_graph.nodes(t).select(
        F.lit("node").alias("kind"), c("id").alias("a"), F.coalesce("name", "id").alias("b"),
        F.coalesce("type", F.lit("topic")).alias("c"), F.coalesce("weight", F.lit(0.5)).alias("weight"),
        dims.lookup(dims.NODE_COLORS, F.coalesce("type", F.lit("topic")), dims.UNKNOWN_COLOR).alias("color"),
    )
    e = star_graph.edges(t).select(
        F.lit("link").alias("kind"), c("from_node").alias("a"), c("to_node").alias("b"),
        F.coalesce("relation_type", F.lit("related_to")).alias("c"), F.coalesce("weight", F.lit(0.5)).alias("weight"),
        F.lit(None).cast("string").alias("color"),
    )
    return n.unionByName(e)


def seed_fallback(stored_nodes, stored_edges, seed_nodes, seed_edges):
    """The stored graph when it has a node, else the seed graph."""
    return (seed_nodes, seed_edges) if stored_nodes.isEmpty() else (stored_nodes, stored_edges)


@query(
    "seed_fallback",
    with_g("""SELECT 'stored' AS origin, (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges
    UNION ALL SELECT 'seed', (SELECT count(*) FROM nodes WHERE type = 'topic'), (SELECT count(*) FROM edges WHERE relation_type = 'belongs_to_event')"""),
)
def _(t):
    n, e = star_graph.nodes(t), star_graph.edges(t)
    seed = n.filter(c("type") == "topic"), e.filter(c("relation_type") == "belongs_to_event")
    sizes = []
    for origin, stored in (("stored", n), ("seed", n.filter(c("weight") < 0))):
        nodes, edges = seed_fallback(stored, e, *seed)
        one = nodes.agg(F.count("*").alias("n_nodes")).withColumn("n_edges", edges.agg(F.count("*")).scalar())
        sizes.append(one.select(F.lit(origin).alias("origin"), "n_nodes", "n_edges"))
    return sizes[0].unionByName(sizes[1])


def graph_counts(nodes, edges):
    count = F.count("*").alias("n")
    return nodes.agg(count).select(F.lit("nodes").alias("what"), "n").unionByName(
        edges.agg(count).select(F.lit("edges").alias("what"), "n")
    )


@query("graph_counts", with_g("SELECT 'nodes' AS what, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges"))
def _(t):
    return graph_counts(star_graph.nodes(t), star_graph.edges(t))


@query(
    "graph_stats",
    with_g("""
    SELECT 'nodes' AS what, coalesce(type, 'total') AS label, count(*) AS n FROM nodes GROUP BY ROLLUP (type)
    UNION ALL SELECT 'edges', coalesce(relation_type, 'total'), count(*) FROM edges GROUP BY ROLLUP (relation_type)
    """),
)
def _(t):
    def tally(df, what, label):
        named = df.select(F.coalesce(label, F.lit("unknown")).alias("label"))
        counted = named.rollup("label").agg(F.count("*").alias("n"), F.grouping("label").alias("g"))
        return counted.select(F.lit(what).alias("what"), F.when(c("g") == 1, "total").otherwise(c("label")).alias("label"), "n")

    return tally(star_graph.nodes(t), "nodes", "type").unionByName(tally(star_graph.edges(t), "edges", "relation_type"))


@query(
    "dashboard_summary",
    with_g("SELECT 'heliograph' AS app_name, 'parquet' AS graph_backend, (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count"),
)
def _(t):
    n, e = star_graph.nodes(t), star_graph.edges(t)
    return n.agg(F.count("*").alias("node_count")).select(
        F.lit("heliograph").alias("app_name"), F.lit("parquet").alias("graph_backend"), "node_count",
        e.agg(F.count("*")).scalar().alias("edge_count"),
    )


# -- versions --------------------------------------------------------------------
def _two_versions(t):
    """Version 1 lacks region 4 and its edges; version 2 is the full graph."""
    store = versions.GraphVersions(t.spark, scratch(t.spark, "graph-versions"))
    n, e = star_graph.nodes(t), star_graph.edges(t)
    store.create(n.filter(c("id") != "event:region_4"), e.filter(c("to_node") != "event:region_4"), "without region 4")
    store.create(n, e, "full")
    return store


SQL_V = """
, vn AS (SELECT 1 AS version, id FROM nodes WHERE id <> 'event:region_4' UNION ALL SELECT 2, id FROM nodes),
ve AS (SELECT 1 AS version, from_node || '->' || to_node || ':' || relation_type AS id FROM edges WHERE to_node <> 'event:region_4'
       UNION ALL SELECT 2, from_node || '->' || to_node || ':' || relation_type FROM edges)
"""


@query(
    "snapshot_create",
    with_g(SQL_V + """
    SELECT 'node' AS kind, id AS key FROM (SELECT id FROM vn WHERE version = 2 EXCEPT SELECT id FROM vn WHERE version = 1)
    UNION ALL SELECT 'edge', id FROM (SELECT id FROM ve WHERE version = 2 EXCEPT SELECT id FROM ve WHERE version = 1)
    """),
)
def _(t):
    return _two_versions(t).delta(2)


@query(
    "snapshot_list",
    with_g(SQL_V + """
    SELECT v.version, CASE version WHEN 1 THEN 'without region 4' ELSE 'full' END AS label,
           CASE version WHEN 2 THEN 1 END AS parent,
           (SELECT count(*) FROM vn WHERE vn.version = v.version) AS num_nodes,
           (SELECT count(*) FROM ve WHERE ve.version = v.version) AS num_edges,
           CASE version WHEN 2 THEN 1 ELSE 0 END::bigint AS delta_nodes,
           CASE version WHEN 2 THEN (SELECT count(*) FROM edges WHERE to_node = 'event:region_4') ELSE 0 END AS delta_edges
    FROM (VALUES (1), (2)) v(version)
    """),
)
def _(t):
    return _two_versions(t).list().drop("created_at")


@query(
    "snapshot_diff",
    with_g(SQL_V + """
    SELECT 'node' AS kind, 'removed' AS change, id AS key FROM (SELECT id FROM vn WHERE version = 2 EXCEPT SELECT id FROM vn WHERE version = 1)
    UNION ALL SELECT 'edge', 'removed', id FROM (SELECT id FROM ve WHERE version = 2 EXCEPT SELECT id FROM ve WHERE version = 1)
    """),
)
def _(t):
    return _two_versions(t).diff(2, 1)


@query(
    "snapshot_rollback",
    with_g(SQL_V + """
    SELECT 'node' AS kind, id AS key FROM vn WHERE version = 1 UNION ALL SELECT 'edge', id FROM ve WHERE version = 1
    """),
)
def _(t):
    store = _two_versions(t)
    store.rollback(1)
    nodes, edges = store.read(store.current())
    key = text.edge_id(c("from_node"), c("to_node"), c("relation_type"))
    return nodes.select(F.lit("node").alias("kind"), c("id").alias("key")).unionByName(
        edges.select(F.lit("edge").alias("kind"), key.alias("key"))
    )
