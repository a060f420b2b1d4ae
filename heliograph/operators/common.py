"""Small building blocks: latest row, min-max scaling, ordered prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def latest_by_key(log: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Last writer wins: the row with the highest ``seq`` per key."""
    rest = [c for c in log.columns if c not in keys and c != seq]
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_row"))
    return best.select(*keys, "_row.*")


def minmax_scaled(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds ``out = (col - min) / (max - min)`` for each (col, out); 0.0 if constant.

    The bounds are one scalar subquery, so no window gathers the rows.
    """
    stats = df.agg(
        F.struct(
            *[F.min(F.col(c).cast("double")).alias(f"lo_{c}") for c in columns],
            *[F.max(F.col(c).cast("double")).alias(f"hi_{c}") for c in columns],
        ).alias("s")
    ).scalar()

    def scaled(c: str) -> Column:
        low, high = stats[f"lo_{c}"], stats[f"hi_{c}"]
        return F.coalesce((F.col(c) - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0))

    return df.withColumns({out: scaled(c) for c, out in columns.items()})


# Chunk totals that one window of the carrying level takes.
FAN = 4096


def _before(totals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _chunk, _offset): the sum of ``_total`` over smaller chunks, in two levels, so that
    the chunks of one key are not one task."""
    grouped = totals.withColumn("_group", F.floor(F.col("_chunk") / FAN))
    groups = grouped.groupBy(*keys, "_group").agg(F.sum("_total").alias("_sum"))
    up = W.partitionBy(*keys).orderBy("_group").rowsBetween(W.unboundedPreceding, -1)
    base = groups.select(*keys, "_group", F.coalesce(F.sum("_sum").over(up), F.lit(0)).alias("_base"))
    inside = W.partitionBy(*keys, "_group").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    near = grouped.withColumn("_near", F.coalesce(F.sum("_total").over(inside), F.lit(0)))
    return near.join(base, [*keys, "_group"]).select(*keys, "_chunk", (F.col("_near") + F.col("_base")).alias("_offset"))


def prefix_sum(
    df: DataFrame, keys: list[str], seq: str, value: Column, out: str, chunk: int | Column = 65536
) -> DataFrame:
    """Running sum of ``value`` by ``seq`` within ``keys``, inclusive.

    ``seq`` is unique per key; it is a non-negative whole number unless ``chunk``
    gives a chunk number that grows with it. A key may hold most of the
    rows, so a window by key alone would be one task: sums run inside chunks of
    ``seq``, and chunk totals are carried in two levels of FAN chunks each.
    """
    chunk_of = chunk if isinstance(chunk, Column) else F.floor(F.col(seq) / chunk)
    spread = df.withColumns({"_chunk": chunk_of, "_value": value})
    totals = spread.groupBy(*keys, "_chunk").agg(F.sum("_value").alias("_total"))
    offsets = _before(totals, keys)
    inside = W.partitionBy(*keys, "_chunk").orderBy(seq).rowsBetween(W.unboundedPreceding, 0)
    return (
        spread.withColumn("_inside", F.sum("_value").over(inside))
        .join(offsets, [*keys, "_chunk"])
        .withColumn(out, F.col("_inside") + F.col("_offset"))
        .select(*df.columns, out)
    )
