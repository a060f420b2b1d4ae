"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Each distinct vector is scaled to length one and rounded to int8 codes with a scale of its own, x = s c + e.
For two vectors |x.y - s t (c.d)| <= |e||y| + |f||s c|, so a pair is surely below the threshold if its integer
product is below a bound that each tile takes from its norms; only the other pairs are computed again in double
precision. Vectors form tiles by a hash; pairs of tiles meet by a join on the tile pair, each pair of tiles once.
Integer products are taken in float32 matrix products: codes are at most 127, so sums below 2**24 (to a
dimension of 1040; longer vectors go in parts) are exact.

Equal vectors are one row with a weight, so a hot vector costs one. A tile pair gives link counts per vector and
a spanning forest of its links, never the links themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import components, small_batches
from heliograph.session import cut_lineage

THRESHOLD = 0.9
TILE_ROWS = 8192
# Rows of a tile whose products a task takes at a time, and tasks that share the tile pairs at most.
BLOCK_ROWS, TASKS = 2048, 20_000
# Dimensions whose int8 product is exact in float32.
EXACT = 1024
# Slack for rounding in double precision, far below any difference that matters.
SLACK = 1e-9


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, length of the error) of rows of unit length."""
    scale = np.abs(x).max(axis=1) / 127.0
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes, scale, error * (1 + SLACK) + SLACK


def possible(a: tuple, b: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two tiles whose products the error bounds do not keep below the threshold."""
    (ca, sa, ea), (cb, sb, eb) = a, b
    product = np.zeros((len(ca), len(cb)))
    for i in range(0, ca.shape[1], EXACT):
        product += ca[:, i : i + EXACT].astype(np.float32) @ cb[:, i : i + EXACT].astype(np.float32).T
    # |y| = 1 and |s c| <= 1 + |e|
    least = threshold - SLACK - ea[:, None] - eb[None, :] * (1 + ea[:, None])
    return np.nonzero(product * (sa[:, None] * sb[None, :]) >= least)


def forest(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which of the links (left, right) join two parts that earlier ones have not joined."""
    names, codes = np.unique(np.concatenate([left, right]), return_inverse=True)
    parent = list(range(len(names)))
    a, b = codes[: len(left)].tolist(), codes[len(left) :].tolist()
    keep = np.zeros(len(left), bool)
    for k, (i, j) in enumerate(zip(a, b, strict=True)):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        while parent[j] != j:
            parent[j] = parent[parent[j]]
            j = parent[j]
        if i != j:
            parent[i] = j
            keep[k] = True
    return keep


def _unpacked(tile: dict, kind: type) -> tuple:
    """(ids, weights, vectors scaled by a power of two, so that no square over- or underflows, their codes)."""
    ids = np.frombuffer(tile["ids"], np.int64)
    vectors = np.frombuffer(tile["x"], kind).astype(np.float64).reshape(len(ids), -1)
    vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    return ids, np.frombuffer(tile["w"], np.int64), vectors, quantised(unit)


def _linked_blocks(a: tuple, b: tuple, threshold: float):
    """Of two tiles, which may be one: (p, q) index arrays of their links, block by block."""
    va, qa, vb, qb = a[2], a[3], b[2], b[3]
    for i in range(0, len(va), BLOCK_ROWS):
        for j in range(i if a is b else 0, len(vb), BLOCK_ROWS):
            p, q = possible(tuple(x[i : i + BLOCK_ROWS] for x in qa), tuple(x[j : j + BLOCK_ROWS] for x in qb), threshold)
            p, q = p + i, q + j
            if a is b and i == j:
                p, q = p[p < q], q[p < q]
            keep = [np.empty(0, bool)]
            for k in range(0, len(p), 1 << 16):
                x, y = va[p[k : k + (1 << 16)]], vb[q[k : k + (1 << 16)]]
                lengths = np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))
                keep.append((x * y).sum(axis=1) / lengths >= threshold)
            keep = np.concatenate(keep)
            if keep.any():
                yield p[keep], q[keep]


def _tile_links(a: tuple, b: tuple, threshold: float) -> pa.RecordBatch | None:
    """Rows (nid, links, to) of two tiles: link weights of a vector, or a link of the forest in ``to``."""
    counts_a, counts_b = np.zeros(len(a[0])), np.zeros(len(b[0]))
    left, right = [], []
    for p, q in _linked_blocks(a, b, threshold):
        counts_a += np.bincount(p, weights=b[1][q], minlength=len(counts_a))
        counts_b += np.bincount(q, weights=a[1][p], minlength=len(counts_b))
        tree = forest(p, q if a is b else q + len(a[0]))
        left.append(p[tree])
        right.append(q[tree])
    if not left:
        return None
    p, q = np.concatenate(left), np.concatenate(right)
    tree = forest(p, q if a is b else q + len(a[0]))
    p, q = p[tree], q[tree]
    ids = np.concatenate([a[0][counts_a > 0], b[0][counts_b > 0], a[0][p]])
    links = np.concatenate([counts_a[counts_a > 0], counts_b[counts_b > 0], np.zeros(len(p))]).astype(np.int64)
    to = np.concatenate([np.full(len(ids) - len(p), -1, np.int64), b[0][q]])
    return pa.record_batch([pa.array(ids), pa.array(links), pa.array(to, mask=to < 0)], ["nid", "links", "to"])


def _linked(threshold: float, kind: type):
    """Rows (dim, ta, tb, ids, w, x), both tiles of a pair in a row one after the other, to rows (nid, links, to)."""

    def work(batches):
        first = None
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["ta"] == row["tb"]:
                    tile = _unpacked(row, kind)
                    out = _tile_links(tile, tile, threshold)
                elif first is None or any(first[c] != row[c] for c in ("dim", "ta", "tb")):
                    first = row  # a pair with one tile only has no links
                    continue
                else:
                    out = _tile_links(_unpacked(first, kind), _unpacked(row, kind), threshold)
                    first = None
                if out is not None:
                    yield out

    return work


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Per input row: vec_id, n_links, component_id, kept, by cosine of ``threshold`` or more.

    A vector that is null, empty, zero or holds a null or non-finite component links with nothing, and so does one of
    another dimension. Equal vectors link with each other. component_id is the smallest vec_id reached (a null one only if
    there is no other); a repeated vec_id is a row like others. Columns other than vec_id and embedding are not read.
    An empty table gives no rows.
    """
    whole = F.col("embedding").cast("array<double>")
    fit = F.coalesce(
        (F.size("embedding") > 0) & F.forall(whole, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists(whole, lambda v: v != 0), F.lit(False)
    )
    # as bytes; -0.0 becomes 0.0 so that equal vectors have equal bytes
    rows = cut_lineage(embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(fit, F.transform(whole, lambda v: v + F.lit(0.0))).alias("vector"),
    ))
    best = F.min(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id"))
    digest = F.sha2(F.array_join(F.transform("vector", lambda v: v.cast("string")), ","), 256)
    named = cut_lineage(rows.withColumn("digest", digest))
    nodes = named.where("digest is not null").groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("weight"), F.first("vector").alias("vector"))
    tiles = nodes.count() // tile_rows + 1
    nodes = cut_lineage(nodes.select(
        "digest", "best", "weight", "vector", F.size("vector").alias("dim"), F.pmod(F.xxhash64("digest"), F.lit(tiles)).cast("int").alias("tile"),
        F.monotonically_increasing_id().alias("nid"),
    ))

    # single precision holds every number of a table of floats
    kind = np.float32 if dict(embeddings.dtypes)["embedding"] == "array<float>" else np.float64

    def gather(table: pa.Table) -> pa.Table:
        vectors = table["vector"].combine_chunks()
        return pa.table({
            "dim": table["dim"][:1], "tile": table["tile"][:1],
            "ids": pa.array([table["nid"].to_numpy().tobytes()], pa.binary()), "w": pa.array([table["weight"].to_numpy().tobytes()], pa.binary()),
            "x": pa.array([vectors.flatten().to_numpy().astype(kind).tobytes()], pa.binary()),
        })

    whole_tiles = cut_lineage(
        nodes.select("dim", "tile", "nid", "weight", "vector").groupBy("dim", "tile")
        .applyInArrow(gather, "dim int, tile int, ids binary, w binary, x binary")
    )
    both = small_batches(whole_tiles).select("*", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("other"))
    both = both.select("dim", F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"), "ids", "w", "x")
    tasks = min(tiles * (tiles + 1) // 2, TASKS)
    number = F.expr("tb * (tb + 1L) div 2 + ta")
    pairs = both.repartitionById(tasks, F.pmod(number, F.lit(tasks)).cast("int")).sortWithinPartitions("dim", "ta", "tb")
    found = cut_lineage(pairs.mapInArrow(_linked(threshold, kind), "nid long, links long, to long"))
    counts = found.where("to is null").groupBy("nid").agg(F.sum("links").alias("links"))
    groups = components(found.where("to is not null").select(F.col("nid").alias("a"), F.col("to").alias("b")))
    placed = nodes.select("digest", "nid", "best", "weight").join(counts, "nid", "left").join(groups.withColumnRenamed("node", "nid"), "nid", "left")
    placed = placed.select("digest", "best", F.coalesce("component", "nid").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    heads = placed.groupBy("component").agg(F.min("best").alias("head"))
    placed = cut_lineage(placed.join(heads, "component").select("digest", "n_links", F.col("head.vec_id").alias("head")))
    alone = F.col("head_row").isNull()
    out = named.join(placed.withColumn("head_row", F.lit(True)), "digest", "left")
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("head"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
