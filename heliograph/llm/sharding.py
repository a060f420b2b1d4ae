"""Sharding by a two-pass external shuffle.

Pass one scatters records by a seeded hash into buckets that fit a task's memory; pass two loads a bucket,
puts it in an order that depends on its records only, shuffles it by Fisher-Yates with a generator seeded
by the bucket, and writes it. Buckets one after another are one random order of all records. It is cut into
shards of equal counts (at most one apart), so a bucket writes to the few shards that its range touches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from heliograph.llm.common import small_batches
from heliograph.session import cut_lineage

SHARDS = 40
SEED = 811
# Bytes of records a bucket holds, about.
BUCKET_BYTES = 16 << 20
RECORD_BYTES = 16


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniformly random order of n records by swaps from the end."""
    order = list(range(n))
    picks = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64).tolist()
    for i in range(n - 1, 0, -1):
        j = picks[i]
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def shuffled_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``docs`` as (shard, slot, size, row): slots count from 0 without gaps, shards differ by one record at most.

    size is the UTF-8 bytes of the text (null: none) plus RECORD_BYTES; row holds all columns as they came. A record
    scatters by its hash and its place in the input, so that a hot repeated row is spread too; the shuffled buckets are
    written once and everything else is read from there. An empty table gives no rows. With fewer records than shards,
    the last shards stay empty. Null columns are columns like others.
    """
    plain = [F.col(f"`{c}`") for c, t in docs.dtypes if "map" not in t and "variant" not in t]
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + RECORD_BYTES).cast("long")
    total = docs.agg(F.sum(size)).first()[0] or 0
    buckets = int(total // BUCKET_BYTES + 1)
    key = F.xxhash64(F.lit(seed), *plain, F.monotonically_increasing_id())
    rows = small_batches(docs).select(F.struct("*").alias("row"), size.alias("size"), key.alias("key"))
    rows = rows.withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int"))
    fields = rows.columns

    def shuffle(which: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table["key"].to_numpy(), kind="stable")
        order = order[fisher_yates(len(order), np.random.default_rng([seed, which[0].as_py()]))]
        return table.select(fields).take(pa.array(order)).append_column("within", pa.array(np.arange(len(order)), pa.int64()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    stored = cut_lineage(rows.groupBy("bucket").applyInArrow(shuffle, f"{kinds}, within long"))
    counts = stored.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = cut_lineage(counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    n = stored.count()
    out = stored.join(starts, "bucket").withColumn("at", F.col("base") + F.col("within"))
    out = out.withColumn("shard", _shard_of(F.col("at"), n, shards))
    return out.select("shard", (F.col("at") - _start_of(F.col("shard"), n, shards)).alias("slot"), "size", "row")


def _start_of(shard, n: int, shards: int):
    """The first place of a shard: the first n % shards shards hold one more."""
    small, more = divmod(n, shards)
    return shard.cast("long") * small + F.least(shard.cast("long"), F.lit(more))


def _shard_of(at, n: int, shards: int):
    small, more = divmod(n, shards)
    edge = more * (small + 1)
    rest = F.lit(more) + F.floor((at - edge) / max(small, 1))
    return F.when(at < edge, F.floor(at / (small + 1))).otherwise(rest).cast("int")


def write_shards(placed: DataFrame, path: str) -> DataFrame:
    """Writes the shards as Parquet folders below ``path`` and gives them back; a bucket's order is kept within its file."""
    placed.write.partitionBy("shard").parquet(path)
    return placed.sparkSession.read.schema(placed.schema).parquet(path)


def shard_digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per record of the shards: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return shuffled_shards(docs, shards).select(
        F.col("row.doc_id").cast("long").alias("doc_id"), "size",
        F.crc32(F.coalesce(F.col("row.text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
