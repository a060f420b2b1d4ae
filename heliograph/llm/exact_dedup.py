"""Exact dedup against a history kept as sharded minimal perfect hashes.

The history of distinct digests is cut into shards by digest. Each shard is one row: a minimal perfect
hash (levels of bit arrays: a key takes the first level where no other key of the shard meets it; its
slot is the rank of its bit) and, per slot, the full 32-byte digest with the locator of the winner.
Arriving digests are first grouped, so a hot text is one row; a lookup computes the slot and compares
all 32 bytes, so that a digest outside the history is never taken for a member.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import SPACE, mixed
from heliograph.session import cut_lineage

# Distinct digests of a shard of the history, about; 32 bytes of digest and 24 of locator each.
SHARD_KEYS = 100_000
# Bits of a level for each key it has to place.
ROOM = 2

_BEST = "points long, doc_id long, rows long"


def normalised(text: str | Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, points, digest) per row: code points of the whole text, SHA-256 of the normalised one."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("points"),
        F.unhex(F.sha2(normalised("text"), 256)).alias("digest"),
    )


def grouped(rows: DataFrame) -> DataFrame:
    """One row per digest: most code points, then smallest doc_id (null last), and the number of rows."""
    best = F.min(F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id"))
    return (
        rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("rows"))
        .select("digest", (-F.col("best.less")).alias("points"), F.col("best.doc_id").alias("doc_id"), "rows")
    )


def _words(digest: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of each 32-byte digest for a level."""
    part = digest.view(np.uint64)
    with np.errstate(over="ignore"):
        seed = mixed(np.array([level + 1], np.uint64))
        return mixed(part[:, 0] ^ mixed(part[:, 1] + seed))


def build_hash(digest: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Levels of bits and the slot of each of the distinct digests (rows of 32 bytes)."""
    slots = np.full(len(digest), -1, np.int64)
    left, levels, base = np.arange(len(digest)), [], 0
    while len(left):
        size = max(64, ROOM * len(left))
        at = (_words(digest[left], len(levels)) % np.uint64(size)).astype(np.int64)
        bits = np.bincount(at, minlength=size) == 1
        rank = np.cumsum(bits) - 1
        placed = bits[at]
        slots[left[placed]] = base + rank[at[placed]]
        base += int(bits.sum())
        levels.append(bits)
        left = left[~placed]
    return levels, slots


def look_up(levels: list[np.ndarray], digest: np.ndarray) -> np.ndarray:
    """The slot of each digest that is a member; any slot or -1 for others."""
    slots = np.full(len(digest), -1, np.int64)
    left, base = np.arange(len(digest)), 0
    for level, bits in enumerate(levels):
        if not len(left):
            break
        at = (_words(digest[left], level) % np.uint64(len(bits))).astype(np.int64)
        hit = bits[at]
        slots[left[hit]] = base + (np.cumsum(bits) - 1)[at[hit]]
        base += int(bits.sum())
        left = left[~hit]
    return slots


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def shards_for(keys: int) -> int:
    return keys // SHARD_KEYS + 1


def shard_of(shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(9), "digest"), F.lit(shards)).cast("int")


def build_history(distinct: DataFrame, shards: int) -> DataFrame:
    """One row per shard: shard, level sizes, packed bits, and by slot the digests and winners' locators."""

    def build(table: pa.Table) -> pa.Table:
        digest = _matrix(table["digest"])
        levels, slots = build_hash(digest)
        order = np.argsort(slots)
        row = {
            "shard": [table["shard"][0].as_py()],
            "sizes": [[len(x) for x in levels]],
            "bits": [b"".join(np.packbits(x).tobytes() for x in levels)],
            "digests": [digest[order].tobytes()],
        }
        row |= {f"at_{c}": [table[c].combine_chunks().take(pa.array(order)).to_pylist()] for c in ("points", "doc_id", "rows")}
        return pa.table(row, schema=pa.schema(
            [("shard", pa.int32()), ("sizes", pa.list_(pa.int64())), ("bits", pa.binary()), ("digests", pa.binary())]
            + [(f"at_{c}", pa.list_(pa.int64())) for c in ("points", "doc_id", "rows")]
        ))

    slots = "shard int, sizes array<long>, bits binary, digests binary, at_points array<long>, at_doc_id array<long>, at_rows array<long>"
    return distinct.withColumn("shard", shard_of(shards)).groupBy("shard").applyInArrow(build, slots)


def members(arrived: DataFrame, history: DataFrame, shards: int) -> DataFrame:
    """``arrived`` distinct digests with old_points, old_doc_id and old_rows of the history; null for nonmembers."""

    def probe(new: pa.Table, old: pa.Table) -> pa.Table:
        old_columns = {f"old_{c}": pa.nulls(new.num_rows, pa.int64()) for c in ("points", "doc_id", "rows")}
        if new.num_rows and old.num_rows:
            sizes = old["sizes"][0].as_py()
            packed, levels, start = np.frombuffer(old["bits"][0].as_py(), np.uint8), [], 0
            for size in sizes:
                end = start + (size + 7) // 8
                levels.append(np.unpackbits(packed[start:end])[:size].astype(bool))
                start = end
            digest = _matrix(new["digest"])
            held = np.frombuffer(old["digests"][0].as_py(), np.uint8).reshape(-1, 32)
            slot = look_up(levels, digest)
            same = (slot >= 0) & (held[slot] == digest).all(axis=1)
            take = pa.array(np.where(same, slot, 0), mask=~same)
            for c in ("points", "doc_id", "rows"):
                values = old[f"at_{c}"].combine_chunks()
                old_columns[f"old_{c}"] = values.values.slice(values.offsets[0].as_py()).take(take)
        return pa.table({c: new[c] for c in ("digest", "points", "doc_id", "rows")} | old_columns)

    return (
        arrived.withColumn("shard", shard_of(shards)).groupBy("shard").cogroup(history.groupBy("shard"))
        .applyInArrow(probe, f"digest binary, {_BEST}, old_points long, old_doc_id long, old_rows long")
    )


def winners(docs: DataFrame, history_rows: DataFrame) -> DataFrame:
    """(digest, points, doc_id, rows) of the best row of each text over the history and ``docs``.

    ``history_rows`` and ``docs`` are frames of ``digests``. Members are settled against their slot, nonmembers among
    themselves; history texts that do not arrive again are included.
    """
    past = cut_lineage(grouped(history_rows))
    shards = shards_for(past.count())
    history = cut_lineage(build_history(past, shards))
    met = cut_lineage(members(grouped(docs), history, shards))
    better = F.coalesce(
        F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"))
        <= F.struct((-F.col("old_points")).alias("p"), F.col("old_doc_id").isNull().alias("z"), F.col("old_doc_id").alias("i")),
        F.lit(True),
    )
    old = F.col("old_rows").isNotNull()
    new = met.select(
        "digest",
        F.when(old & ~better, F.col("old_points")).otherwise(F.col("points")).alias("points"),
        F.when(old & ~better, F.col("old_doc_id")).otherwise(F.col("doc_id")).alias("doc_id"),
        (F.col("rows") + F.coalesce("old_rows", F.lit(0))).alias("rows"),
    )
    rest = past.join(met.where(old).select("digest"), "digest", "left_anti")
    return cut_lineage(new.unionByName(rest.select("digest", "points", "doc_id", "rows")))


def earlier(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Splits one table into a history and arrivals by a bit of the row's own hash."""
    bit = F.pmod(F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.hex("digest")).cast("binary")), F.lit(2))
    return rows.where(bit == 0), rows.where(bit == 1)


def exact_groups(docs: DataFrame) -> DataFrame:
    """Per input row: doc_id, keep_id, group_size, kept, text_sha256.

    The row of most code points, then smallest doc_id, stays; a null doc_id comes last. Of repeated rows (same doc_id,
    same text) one is kept. A null text is an empty one. Other columns are not read; an empty table gives no rows.
    """
    rows = cut_lineage(digests(docs))
    history, arrived = earlier(rows)
    best = winners(arrived, history).withColumnsRenamed({"points": "best_points", "doc_id": "keep_id", "rows": "group_size"})
    alike = rows.groupBy("doc_id", "points", "digest").agg(F.count(F.lit(1)).alias("m"))
    joined = cut_lineage(alike).join(best, "digest")
    won = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("best_points"))
    return joined.select(
        "doc_id", "keep_id", "group_size", won.alias("won"), F.lower(F.hex("digest")).alias("text_sha256"),
        F.explode(F.sequence(F.lit(1), F.col("m"))).alias("copy"),
    ).select("doc_id", "keep_id", "group_size", (F.col("won") & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def exact_filter(docs: DataFrame) -> DataFrame:
    """``docs`` with the row that stays of each group of equal texts; all columns are kept."""
    rows = cut_lineage(digests(docs))
    history, arrived = earlier(rows)
    best = winners(arrived, history).select("digest", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "points")
    packed = docs.select(
        F.struct("*").alias("row"),
        F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("id"),
        F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("points"),
        F.unhex(F.sha2(normalised("text"), 256)).alias("digest"),
    )
    on = ["digest", "id", "points"]
    return packed.join(best, on, "left_semi").dropDuplicates(on).select("row.*")
