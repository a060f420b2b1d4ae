"""The content graph: building, walking and ranking it.

``nodes``: id, type, name, weight (more columns allowed).
``edges``: from_node, to_node, relation_type, weight; a directed multigraph
with one row per (from_node, to_node, relation_type).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions import dims, text
from heliograph.operators.common import minmax_scaled
from heliograph.session import cut_lineage, keep, shuffle_parts, tidy_shuffles

EDGE_KEY = ["from_node", "to_node", "relation_type"]
# Links of a PageRank task: at most, and at least before the work is dealt to more tasks.
TASK_LINKS, FEW_LINKS = 1_000_000, 10_000


# -- building -------------------------------------------------------------------
def build_nodes(df: DataFrame, node_type: Column, name: Column, weight: Column) -> tuple[DataFrame, DataFrame]:
    """(nodes, rejected): the id is derived; unknown types go to ``rejected``."""
    out = df.withColumns({"type": node_type, "name": name, "weight": weight}).withColumn(
        "id", text.node_id(F.col("type"), text.squash(F.col("name")))
    )
    valid = F.col("type").isin(*dims.NODE_TYPES)
    return out.filter(valid), out.filter(~F.coalesce(valid, F.lit(False)))


def nodes_from_entities(entities: DataFrame) -> DataFrame:
    """(text, label, confidence, language, qid) -> entity nodes keyed by QID or slug."""
    return entities.select(
        F.coalesce("qid", text.node_id(F.lit("entity"), text.squash(F.col("text")))).alias("id"),
        F.lit("entity").alias("type"),
        F.col("text").alias("name"),
        F.col("confidence").cast("double").alias("weight"),
        F.create_map(
            F.lit("qid"), F.col("qid"), F.lit("ner_label"), F.col("label"), F.lit("language"), F.col("language")
        ).alias("attrs"),
    )


def default_weight(relation: Column) -> Column:
    return dims.lookup(dims.RELATION_WEIGHTS, relation, dims.DEFAULT_EDGE_WEIGHT)


def build_edges(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, rejected): fills missing weights; unknown relations are rejected."""
    valid = F.col("relation_type").isin(*dims.RELATION_WEIGHTS)
    filled = df.withColumn("weight", F.coalesce("weight", default_weight(F.col("relation_type"))))
    return filled.filter(valid), df.filter(~F.coalesce(valid, F.lit(False)))


def merge_nodes(log: DataFrame) -> DataFrame:
    """Idempotent upsert: greatest weight, first type and name, first embedding."""
    first = F.min_by(F.struct("type", "name"), F.col("seq"))
    vector = F.min_by("embedding", F.when(F.col("embedding").isNotNull(), F.col("seq")))
    merged = log.groupBy("id").agg(first.alias("f"), F.max("weight").alias("weight"), vector.alias("embedding"))
    return merged.select("id", "f.type", "f.name", "weight", "embedding")


def merge_edges(log: DataFrame) -> DataFrame:
    return log.groupBy(*EDGE_KEY).agg(F.max("weight").alias("weight"))


def split_by_endpoints(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): an edge needs both of its nodes. Each end is looked up once."""
    ids = nodes.select("id").distinct()
    marked = edges
    for end in ("from_node", "to_node"):
        known = ids.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}"))
        marked = marked.join(known, end, "left")
    both = F.col("_from_node").isNotNull() & F.col("_to_node").isNotNull()
    marked = cut_lineage(marked.select(*edges.columns, both.alias("_known")))
    return marked.filter("_known").select(*edges.columns), marked.filter("NOT _known").select(*edges.columns)


def induced_subgraph(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    ids = ids.select("id").distinct()
    inside = edges.join(ids.withColumnRenamed("id", "from_node"), "from_node", "left_semi").join(
        ids.withColumnRenamed("id", "to_node"), "to_node", "left_semi"
    )
    return nodes.join(ids, "id", "left_semi"), inside.select(*edges.columns)


# -- walking ----------------------------------------------------------------------
def neighbors(edges: DataFrame, source: str, max_hops: int = 1, relation: str | None = None) -> DataFrame:
    """Nodes within ``max_hops`` with the edge that first reached them.

    Among edges of one hop, the smallest (from_node, relation_type) counts. A
    cycle may return the source; it is not walked again.
    """
    spark = edges.sparkSession
    usable = edges if relation is None else edges.filter(F.col("relation_type") == relation)
    frontier = spark.range(1).select(F.lit(source).alias("from_node"))
    visited, found = frontier, None
    for hop in range(1, max_hops + 1):
        best = F.min_by(F.struct("relation_type", "weight"), F.struct("from_node", "relation_type"))
        step = usable.join(frontier, "from_node").groupBy("to_node").agg(best.alias("via"))
        if found is not None:
            step = step.join(found.select(F.col("node_id").alias("to_node")), "to_node", "left_anti")
        step = step.select(
            F.col("to_node").alias("node_id"),
            F.col("via.relation_type").alias("relation"),
            F.col("via.weight").alias("weight"),
            F.lit(hop).alias("hops"),
        )
        if hop < max_hops:
            step = cut_lineage(step)
        found = step if found is None else found.unionByName(step)
        frontier = step.select(F.col("node_id").alias("from_node")).join(visited, "from_node", "left_anti")
        visited = visited.unionByName(frontier)
    return found


def propagate(edges: DataFrame, seeds: DataFrame, hops: int = 2, hop_decay: float = 0.5) -> DataFrame:
    """(seed, node_id, influence): walks of up to ``hops`` edges, each walk worth
    the product of weight and decay; the seed itself is left out.

    Influence is summed per (seed, node) at every hop, which equals summing walks.
    """
    live = edges.filter(F.col("weight") > 0).select("from_node", "to_node", "weight")
    level = seeds.select(F.col("id").alias("seed"), F.col("id").alias("node_id"), F.lit(1.0).alias("influence"))
    total = None
    for _ in range(hops):
        moved = F.sum(F.col("influence") * F.col("weight") * hop_decay)
        level = (
            level.join(live, F.col("node_id") == F.col("from_node"))
            .groupBy("seed", F.col("to_node").alias("node_id"))
            .agg(moved.alias("influence"))
        )
        total = level if total is None else total.unionByName(level)
    summed = total.groupBy("seed", "node_id").agg(F.sum("influence").alias("influence"))
    return summed.filter(F.col("seed") != F.col("node_id"))


def shortest_paths(edges: DataFrame, source: str, paths: bool = True) -> DataFrame:
    """(id, cost, path) of every node reachable from ``source``; an edge costs
    1/weight. Only improved nodes relax their edges, until none improves. Without
    ``paths`` (id, cost): minima of numbers, which need no sort."""
    spark = edges.sparkSession
    steps = keep(
        edges.filter(F.col("weight") > 0)
        .groupBy("from_node", "to_node")
        .agg((1.0 / F.max("weight")).alias("step"))
    )
    start = spark.range(1).select(F.lit(source).alias("id"), F.lit(0.0).alias("cost"))
    cost = (F.col("cost") + F.col("step")).alias("cost")
    least = F.min(cost).alias("cost")
    if paths:
        start = start.withColumn("path", F.array(F.lit(source)))
        least = F.min(F.struct(cost, F.array_append("path", F.col("to_node")).alias("path"))).alias("b")
    best = improved = start
    while True:
        reached = (
            improved.join(steps, F.col("id") == F.col("from_node"))
            .groupBy("to_node")
            .agg(least)
            .select(F.col("to_node").alias("id"), *(["b.*"] if paths else ["cost"]))
        )
        known = best.select("id", F.col("cost").alias("known"))
        improved = cut_lineage(
            reached.join(known, "id", "left")
            .filter(F.col("known").isNull() | (F.col("cost") < F.col("known")))
            .drop("known")
        )
        if improved.isEmpty():
            steps.unpersist()
            return best
        best = cut_lineage(best.join(improved.select("id"), "id", "left_anti").unionByName(improved))


def shortest_path(edges: DataFrame, source: str, target: str) -> DataFrame:
    """One row (id, cost, path) of the cheapest path, or none when the target is out of reach.

    Delta-stepping: of the nodes whose cost fell, those within one average step of the
    cheapest relax their edges together. A round writes improvements with their
    predecessors only; what costs as much as the target is not followed, and a node
    without edges waits for no round. The path is read back from the predecessors in
    the end; of equally cheap ones the smallest counts.
    """
    spark = edges.sparkSession
    steps = cut_lineage(
        edges.filter(F.col("weight") > 0).groupBy("from_node", "to_node").agg((1.0 / F.max("weight")).alias("step"))
    )
    senders = cut_lineage(steps.select(F.col("from_node").alias("id")).distinct())
    width = steps.agg(F.avg("step")).first()[0] or 1.0
    reached = cut_lineage(spark.range(1).select(F.lit(source).alias("id"), F.lit(0.0).alias("cost"), F.lit(None).cast("string").alias("pred")))
    pending = reached
    while True:
        known = reached.groupBy("id").agg(F.min(F.struct("cost", "pred")).alias("b")).select("id", "b.*")
        low = pending.agg(F.min("cost")).first()[0]
        bound = reached.filter(F.col("id") == target).agg(F.min("cost")).first()[0]
        if low is None or (bound is not None and low >= bound):
            break
        near = F.col("cost") < low + width
        relaxed = (
            pending.filter(near).join(steps, F.col("id") == F.col("from_node"))
            .groupBy(F.col("to_node").alias("id"))
            .agg(F.min(F.struct((F.col("cost") + F.col("step")).alias("cost"), F.col("from_node").alias("pred"))).alias("b"))
            .select("id", "b.*")
        )
        if bound is not None:
            relaxed = relaxed.filter(F.col("cost") < bound)
        old = known.select("id", F.col("cost").alias("known"))
        improved = cut_lineage(
            relaxed.join(old, "id", "left").filter(F.col("known").isNull() | (F.col("cost") < F.col("known"))).drop("known")
        )
        reached = reached.unionByName(improved)
        later = pending.filter(~near).unionByName(improved.join(senders, "id", "left_semi"))
        pending = cut_lineage(later.groupBy("id").agg(F.min(F.struct("cost", "pred")).alias("b")).select("id", "b.*"))
    tree = cut_lineage(known)
    path, at, cost = [], target, bound
    while cost is not None and at is not None:
        path.append(at)
        at = tree.filter(F.col("id") == at).first()["pred"]
    rows = [(target, float(cost), path[::-1])] if path else []
    return spark.createDataFrame(rows, "id string, cost double, path array<string>")


# -- ranking ------------------------------------------------------------------------
def out_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    stats = edges.groupBy(F.col("from_node").alias("id")).agg(
        F.count("*").alias("edge_sum"), F.sum("weight").alias("out_weight")
    )
    return nodes.join(stats, "id", "left").na.fill({"edge_sum": 0, "out_weight": 0.0})


def link_parts(links: int, slots: int) -> int:
    """Tasks of a PageRank round: every slot has work, a task at most TASK_LINKS links, and a small graph few tasks. The
    session's shuffle partitions do not count: a round of small sums in many tasks is all task overhead."""
    return max(min(slots, links // FEW_LINKS + 1), -(-links // TASK_LINKS))


def pagerank(
    nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 50, hub_split: int = 100_000, write_every: int = 4
) -> DataFrame:
    """(id, rank): weighted PageRank, dangling rank spread evenly, scaled to sum 1. Shuffle files of a step go with it."""
    with tidy_shuffles(nodes.sparkSession):
        return _pagerank(nodes, edges, damping, iterations, hub_split, write_every)


def _pagerank(nodes: DataFrame, edges: DataFrame, damping: float, iterations: int, hub_split: int, write_every: int) -> DataFrame:
    """The rank held by dangling nodes is itself carried as the rank of one extra
    node: links lead to it with the share they give to dangling nodes, and it
    leads to every node evenly. A round is then one join and one sum, with no
    figure to fetch between rounds, so ``write_every`` rounds make one job.

    Links are partitioned once and persisted; only node-sized sums are shuffled,
    and they are hashed, so the links are never sorted. A node with more than
    ``hub_split`` out-links is cut into slices and its rank row copied to each,
    so no task owns a whole hub. In-hubs are met by partial sums.
    """
    # Rounds run on whole-number node keys; names are joined back at the end.
    ids = cut_lineage(nodes.select("id").distinct().withColumn("v", F.monotonically_increasing_id()))
    n = ids.count()
    if n == 0:
        return ids.select("id", F.lit(0.0).alias("rank"))
    pairs = (
        edges.join(ids.select(F.col("id").alias("from_node"), F.col("v").alias("s")), "from_node")
        .join(ids.select(F.col("id").alias("to_node"), F.col("v").alias("d")), "to_node")
        .groupBy("s", "d")
        .agg(F.sum("weight").alias("w"))
    )
    pairs = cut_lineage(pairs)
    parts = link_parts(pairs.count() + n, ids.sparkSession.sparkContext.defaultParallelism)
    out = pairs.groupBy("s").agg(F.sum("w").alias("ow")).filter(F.col("ow") != 0)
    dangling = cut_lineage(ids.select("v").join(out.select(F.col("s").alias("v")), "v", "left_anti"))
    lost = dangling.count()
    sink = F.lit(-1).cast("bigint")
    shares = cut_lineage(pairs.join(out, "s").select("s", "d", (F.col("w") / F.col("ow") * damping).alias("share")))
    given = shares.join(dangling.select(F.col("v").alias("d")), "d").groupBy("s").agg(F.sum("share").alias("share"))
    one = ids.sparkSession.range(1)
    links = cut_lineage(
        shares.unionByName(given.select("s", sink.alias("d"), "share"))
        .unionByName(ids.select(sink.alias("s"), F.col("v").alias("d"), F.lit(damping / n).alias("share")))
        .unionByName(one.select(sink.alias("s"), sink.alias("d"), F.lit(damping * lost / n).alias("share")))
    )
    frame = ids.select("v", F.lit(1.0 / n).alias("start"), F.lit((1.0 - damping) / n).alias("base"))
    frame = frame.unionByName(
        one.select(sink.alias("v"), F.lit(lost / n).alias("start"), F.lit((1.0 - damping) * lost / n).alias("base"))
    )
    degrees = links.groupBy("s").agg(F.ceil(F.count("*") / hub_split).cast("int").alias("slices"))
    frame = cut_lineage(frame.join(degrees, frame["v"] == degrees["s"], "left").drop("s"))
    hubs = frame.filter("slices > 1").limit(1).count() > 0
    keys = ["s", "slice"] if hubs else ["s"]
    if hubs:
        links = links.join(degrees, "s").withColumn("slice", F.pmod(F.hash("d"), F.col("slices"))).drop("slices")
    # A fixed number of partitions, which adaptive execution does not change, so
    # every round finds links and frame partitioned as its joins need them.
    links = keep(links.repartition(parts, *keys))
    frame = keep(frame.repartition(parts, "v"))
    ranks = frame.withColumn("rank", F.col("start"))
    with shuffle_parts(ids.sparkSession, parts):
        for i in range(1, iterations + 1):
            senders = ranks.filter("slices IS NOT NULL").withColumnRenamed("v", "s")
            if hubs:
                senders = senders.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
            received = (
                links.join(senders.select(*keys, "rank").hint("shuffle_hash"), keys)
                .groupBy(F.col("d").alias("v"))
                .agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
            )
            ranks = frame.join(received.hint("shuffle_hash"), "v", "left").select(
                "v", "slices", (F.coalesce("got", F.lit(0.0)) + F.col("base")).alias("rank")
            )
            if i % write_every == 0 or i == iterations:
                ranks = cut_lineage(ranks)
    named = ranks.join(ids, "v").select("id", "rank")
    total = named.agg(F.sum("rank")).first()[0] or 1.0
    links.unpersist()
    frame.unpersist()
    return named.select("id", (F.col("rank") / total).alias("rank"))


def graph_score(candidates: DataFrame) -> DataFrame:
    """Adds ``score``: weighted sum of the min-max scaled components."""
    parts = dims.GRAPH_SCORE_WEIGHTS
    filled = candidates.na.fill(0.0, [c for c in parts if c in candidates.columns])
    for name in parts:
        if name not in filled.columns:
            filled = filled.withColumn(name, F.lit(0.0))
    scaled = minmax_scaled(filled, {c: f"_{c}" for c in parts})
    score = sum((F.col(f"_{c}") * w for c, w in parts.items()), F.lit(0.0))
    return scaled.withColumn("score", score).drop(*[f"_{c}" for c in parts])


def top_by_score(nodes: DataFrame, score: Column, k: int, floor: float = dims.MIN_GRAPH_SCORE) -> DataFrame:
    """The k best nodes at or above the floor; a negative k gives none."""
    kept = nodes.withColumn("score", score).filter(F.col("score") >= floor)
    return kept.orderBy(F.desc("score"), "id").limit(max(0, k))
