"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from heliograph.session import cut_lineage, small_batches  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"

# Rows of one key that a numbering window sorts together.
CHUNK_ROWS = 50_000
# Bits of a filter table that goes to each task; a full table lets more rows through, never fewer.
FILTER_BITS = 1 << 25
# Text bytes that a task hashes at a time; the working arrays take some 60 times as much.
SLICE_BYTES = 1 << 17


def running(
    df: DataFrame, keys: list[str], order: list[str], out: str, value: Column | None = None
) -> DataFrame:
    """Adds ``out``: the sum of ``value`` (default 1) over the rows before this one within ``keys``.

    The order is that of a hash of ``order`` and then ``order`` itself, so it is the
    same in every run; rows equal in it are interchangeable. A key may hold most rows,
    so windows run inside hash chunks of about CHUNK_ROWS rows and a second window
    carries the chunk totals. ``keys`` hold no nulls; ``df`` is a stored frame, as it
    is read three times.
    """
    chunks = df.count() // CHUNK_ROWS + 1
    rows = df.withColumns(
        {"_chunk": F.pmod(F.xxhash64(F.lit(17), *order), F.lit(chunks)), "_value": F.lit(1).cast("long") if value is None else value}
    )
    totals = rows.groupBy(*keys, "_chunk").agg(F.sum("_value").alias("_total"))
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*keys, "_chunk", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        rows.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .join(starts, [*keys, "_chunk"])
        .withColumn(out, F.col("_inside") + F.col("_start"))
        .select(*df.columns, out)
    )


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Connected components of undirected ``edges``: one row (node, component) per node, component the
    smallest node. Nodes without edges do not appear.

    Rounds of hooking and contraction: each node points to its smallest neighbour, pointers are
    followed once, and edges are rewritten between the roots; equal edges collapse, so the edge
    table shrinks by half or more a round. Every round is written to the shared folder.
    """
    now = cut_lineage(
        edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b").distinct()
    )
    label = None  # (node, component) so far
    while not now.isEmpty():
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("up"))
        hook = cut_lineage(hook)
        # follow the pointer once: up <= node, so chains end at local minima
        jump = hook.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        hook = cut_lineage(hook.join(jump, "up").select("node", F.col("upper").alias("up")))
        if label is None:
            label = hook.select("node", F.col("up").alias("component"))
        else:
            moved = hook.select(F.col("node").alias("component"), "up")
            label = cut_lineage(
                label.join(moved, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
            )
        ends = hook.select(F.col("node").alias("a"), F.col("up").alias("x"))
        now = cut_lineage(
            now.join(ends, "a").select("x", "b").join(ends.withColumnsRenamed({"a": "b", "x": "y"}), "b")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()
        )
    if label is None:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return label


def filter_table(hashes: DataFrame) -> np.ndarray:
    """A table of FILTER_BITS bits with a bit set for each number in the one column of ``hashes``; 4 MB at any size."""
    bits = hashes.toDF("h").select(F.pmod("h", F.lit(FILTER_BITS)).cast("int").alias("bit"))
    words = bits.groupBy(F.expr("bit div 32").alias("word")).agg(F.expr("bit_or(shiftleft(1L, bit % 32))").alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 32, np.uint32)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return table


def in_table(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each signed 64-bit number is set."""
    bit = np.mod(hashes, FILTER_BITS)
    return (table[bit >> 5] >> (bit & 31).astype(np.uint32) & np.uint32(1)).astype(bool)


def may_hold(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``df`` without most rows whose ``key`` is not in the one column of ``keys``; a join after it decides. No row of
    ``df`` moves for it."""
    table = df.sparkSession.sparkContext.broadcast(filter_table(keys.toDF("k").select(F.xxhash64("k"))))

    @F.pandas_udf("boolean")
    def held(h: pd.Series) -> pd.Series:
        return pd.Series(in_table(table.value, h.to_numpy()))

    return df.where(held(F.xxhash64(key)))


def slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """Index ranges of ``texts`` of about ``limit`` bytes each; a longer text is alone."""
    sizes = np.diff(offsets_of(texts))
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def offsets_of(texts: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary array."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    return np.frombuffer(texts.buffers()[1], kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string or binary array; nulls are empty."""
    at = offsets_of(texts)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int, kind: str = "up") -> np.ndarray:
    """The first n powers of the hash base, or of its inverse, modulo 2**64."""
    if len(_powers[kind]) < n:
        step = np.full(max(n, SLICE_BYTES + 1), _BASE if kind == "up" else _BASE_INVERSE, np.uint64)
        step[0] = 1
        _powers[kind] = np.multiply.accumulate(step)
    return _powers[kind][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums h with h[i] = sum of byte value times power before i; a substring's hash is
    (h[end] - h[start]) times the inverse power of start."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data)), out=out[1:])
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit hash) of each word of each text, in order; A-Z count as a-z."""
    data, at = bytes_of(texts)
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    data = _LOWER[data]
    word = ~_BLANK[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | edge[1:-1]
    ends[:-1] &= ~word[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    h = prefix_hash(data)
    value = (h[end] - h[start]) * powers(n, "down")[start]
    return np.searchsorted(at, start, "right") - 1, mixed(value + (end - start).astype(np.uint64))


def shingles(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of the k-word shingles of each text. Fewer than k words make
    one shingle; no word makes none. Two shingles collide with probability 2**-64."""
    doc, word = word_hashes(texts)
    counts = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    m = len(word)
    with np.errstate(over="ignore"):
        salt = mixed(np.arange(1, k + 1, dtype=np.uint64) * _BASE)
        rolled = np.zeros(max(m - k + 1, 0), np.uint64)
        for j in range(k):
            rolled += mixed(word[j : j + len(rolled)] ^ salt[j]) * (salt[j] | np.uint64(1))
        rolled = mixed(rolled + np.uint64(k))
        out = []
        for i, n in enumerate(counts):
            s = first[i]
            if n >= k:
                out.append(np.unique(rolled[s : s + n - k + 1]))
            elif n:
                few = mixed(word[s : s + n] ^ salt[:n]) * (salt[:n] | np.uint64(1))
                out.append(mixed(np.array([few.sum(dtype=np.uint64) + np.uint64(n)], np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
    return out
