"""Chat formatting with cumulative snapshots collapsed.

Logs often hold a conversation several times, each time one turn longer. A rolling hash over the turns gives
every prefix of every conversation a 128-bit name: the exclusive or, from the first turn on, of two hashes of
(position, role, text). A conversation whose whole name is the name of a proper prefix of another goes in an
anti-join; of equal conversations the smallest conv_id stays. What remains is rendered turn by turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from heliograph.session import cut_lineage

# Turns of one conversation that a window takes together.
CHUNK_TURNS = 4096
# Fixed values of the rendered form.
START, END = "<|im_start|>", "<|im_end|>"


def _numbered(turns: DataFrame) -> DataFrame:
    """(conv, conv_id, at, chunk, role, text): places within a conversation, counted from 0 without gaps.

    Turns are ordered by turn (null first), role and text. Places are counted in chunks of the turn number, so a
    conversation of very many turns is never one task; equal turns of a chunk are next to each other.
    """
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    rows = turns.select(
        conv.alias("conv"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / CHUNK_TURNS), F.lit(-(1 << 60))).cast("long").alias("part"),
    )
    rows = cut_lineage(rows)
    sizes = rows.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = cut_lineage(sizes.select("conv", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    inside = W.partitionBy("conv", "part").orderBy("turn", "role", "text")
    placed = rows.withColumn("i", F.row_number().over(inside) - 1).join(starts, ["conv", "part"])
    return placed.select("conv", "conv_id", (F.col("base") + F.col("i")).alias("at"), "part", "role", "text")


def _prefixes(placed: DataFrame) -> DataFrame:
    """(conv, conv_id, at, h1, h2): the name of the prefix that ends at each turn."""
    hashed = placed.select("conv", "conv_id", "at", "part", *(F.xxhash64(F.lit(s), "at", "role", "text").alias(f"t{s}") for s in (1, 2)))
    hashed = cut_lineage(hashed)
    totals = hashed.groupBy("conv", "part").agg(F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2"))
    before = W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carried = cut_lineage(totals.select("conv", "part", *(F.coalesce(F.bit_xor(f"x{s}").over(before), F.lit(0)).alias(f"c{s}") for s in (1, 2))))
    inside = W.partitionBy("conv", "part").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    rolled = hashed.select("conv", "conv_id", "at", "part", *(F.bit_xor(f"t{s}").over(inside).alias(f"r{s}") for s in (1, 2)))
    return rolled.join(carried, ["conv", "part"]).select(
        "conv", "conv_id", "at", *(F.col(f"r{s}").bitwiseXOR(F.col(f"c{s}")).alias(f"h{s}") for s in (1, 2))
    )


def maximal_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv of the conversations that stay, all turns in places)."""
    placed = cut_lineage(_numbered(turns))
    names = cut_lineage(_prefixes(placed))
    lengths = names.groupBy("conv").agg(F.max("at").alias("at"))
    full = names.join(lengths, ["conv", "at"], "left_semi")
    alike = full.groupBy("at", "h1", "h2").agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "conv")).alias("best"))
    proper = names.join(lengths, ["conv", "at"], "left_anti").select("at", "h1", "h2").distinct()
    kept = alike.join(proper, ["at", "h1", "h2"], "left_anti")
    return kept.select(F.col("best.conv").alias("conv")), placed


def rendered_turns(turns: DataFrame) -> DataFrame:
    """The turns of the conversations that stay: conv_id, turn (place from 0), n_turns, piece (rendered text).

    The pieces of a conversation in order are its rendered form; no conversation is gathered in one row, however long.
    A null role or text counts as empty; rows with a null conv_id are one conversation. Equal turns stay turns of
    their own. Other columns are not read; an empty table gives no rows.
    """
    kept, placed = maximal_conversations(turns)
    stay = placed.join(cut_lineage(kept), "conv", "left_semi")
    lengths = placed.groupBy("conv").agg(F.count(F.lit(1)).alias("n_turns"))
    piece = F.concat(F.lit(START), "role", F.lit("\n"), "text", F.lit(END + "\n"))
    return stay.join(lengths, "conv").select("conv_id", F.col("at").alias("turn"), "n_turns", piece.alias("piece"))
