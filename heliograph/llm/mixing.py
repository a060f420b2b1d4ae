"""Mixing sources to target weights by blocks of words.

The words of each source are packed, document after document, into blocks of a fixed length. Every output shard
draws how many of its slots each source gets from a multinomial over what the sources owe, in tasks, by halving the
range of shards; counts of two halves are those of their whole, so all shards together settle the targets. The n-th slot of a source takes the block that a pseudorandom permutation of the source's block
numbers gives for n, a new permutation for each pass, so no block is used more than one time above another and none
more than REPEAT times. Slots and blocks then meet in a join on the block number; no source is ever in one task.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from heliograph.llm.common import WORD, mixed, running, small_batches
from heliograph.session import cut_lineage

BLOCK_WORDS = 128
SHARD_SLOTS = 16_384
# Shards that are drawn together, and sources that go to every task as a table; more are joined by a shuffle.
TASK_SHARDS, FEW_SOURCES = 16, 100_000
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, REPEAT = 1.5, 2.0
SEED = 20_240_607

_KINDS = ("map", "variant")


def keyed(docs: DataFrame) -> DataFrame:
    """(rk, doc_id, source, size, row): rk is the same for equal rows only; size counts the words of the whole text."""
    plain = [F.col(f"`{c}`") for c, t in docs.dtypes if not any(k in t for k in _KINDS)]
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.concat(F.md5(F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("\x1e")), F.coalesce("source", F.lit("\x1e")), text)), F.hex(F.xxhash64(*plain))).alias("rk"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.struct("*").alias("row"),
    )


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeat: float = REPEAT) -> list[float]:
    """Words each source is to give: ``share`` of all words by repeating weights, none above ``repeat`` times its size;
    what is cut off is shared among the others by weight."""
    budget, out, open_ = share * sum(sizes), [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s]
    while open_:
        total = sum(weights[i % len(weights)] for i in open_)
        over = [i for i in open_ if budget * weights[i % len(weights)] / total > repeat * sizes[i]]
        if not over:
            for i in open_:
                out[i] = budget * weights[i % len(weights)] / total
            break
        for i in over:
            out[i] = repeat * sizes[i]
            open_.remove(i)
        budget -= sum(out[i] for i in over)
    return out


def drawn(owed: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Counts of k slots: multinomial by what is owed, never more than that."""
    counts = np.zeros_like(owed)
    while k:
        left = owed - counts
        more = np.minimum(rng.multinomial(k, left / left.sum()), left)
        counts += more
        k -= int(more.sum())
    return counts


def draw_counts(owed: np.ndarray, slots: int, seed: int, first: int = 0, last: int | None = None):
    """Yields (shard, counts by source, counts of all earlier shards) for the shards from ``first`` to before ``last``.

    The range of all shards is halved again and again; a half draws its counts from those of its whole, with a seed of
    its own, so any part of the shards is found from its path alone.
    """

    def part(low, high, owed, before):
        if high <= first or (last is not None and low >= last) or low >= high:
            return
        if high - low == 1:
            yield low, owed, before
            return
        middle = (low + high) // 2
        left = drawn(owed, (middle - low) * slots, np.random.default_rng([seed, low, high]))
        yield from part(low, middle, left, before)
        yield from part(middle, high, owed - left, before + left)

    yield from part(0, -(-int(owed.sum()) // slots), owed, np.zeros_like(owed))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(size), for each row its own size and key: a Feistel network over the next
    even number of bits, repeated until the number is in range."""
    bits = np.ceil(np.log2(np.maximum(size, 2)))
    half = np.ceil(bits / 2).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.ones(len(index), bool)
    size = size.astype(np.uint64)
    with np.errstate(over="ignore"):
        while todo.any():
            a, b = out[todo] >> half[todo], out[todo] & low[todo]
            for turn in range(4):
                a, b = b, a ^ (mixed(b + mixed(key[todo] + np.uint64(turn))) & low[todo])
            out[todo] = a << half[todo] | b
            todo[todo] = out[todo] >= size[todo]
    return out.astype(np.int64)


def mix(rows: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(placements, sources) of a stored frame with rk, doc_id, source and size.

    placements: shard, slot, epoch, block, sid, start, rk, doc_id, first (word of the document), words; (sid, start)
    names one row, as start counts the words of the source before it. sources: sid, source, source_size, target.
    Rows without words are never placed. The sources, not the rows, pass through the driver.
    """
    spark = rows.sparkSession
    found = rows.groupBy("source").agg(F.sum("size").alias("n")).collect()
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [int(r.n) for r in found]
    aims = targets(sizes)
    blocks_of = np.array([-(-n // BLOCK_WORDS) for n in sizes], np.int64)
    owed = np.array([min(round(t * b / n), int(REPEAT) * b) if n else 0 for t, b, n in zip(aims, blocks_of.tolist(), sizes, strict=True)], np.int64)
    sources = spark.createDataFrame(
        [(i, r.source, sizes[i], float(aims[i])) for i, r in enumerate(found)], "sid int, source string, source_size long, target double"
    )
    if len(found) <= FEW_SOURCES:
        sources = F.broadcast(sources)
    same = rows["source"].eqNullSafe(sources["source"])
    light = cut_lineage(rows.join(sources, same).where("size > 0").select("sid", "rk", "doc_id", "size"))
    placed = running(light, ["sid"], ["rk"], "start", F.col("size"))

    first, last = F.floor(F.col("start") / BLOCK_WORDS), F.floor((F.col("start") + F.col("size") - 1) / BLOCK_WORDS)
    parts = placed.select("*", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("start"), F.col("block") * BLOCK_WORDS)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK_WORDS)
    parts = parts.select("sid", "block", "start", "rk", "doc_id", (begin - F.col("start")).alias("first"), (end - begin).alias("words"))

    shards = -(-int(owed.sum()) // SHARD_SLOTS)

    def draws(batches):
        for batch in batches:
            for low in batch.column(0).to_pylist():
                out = []
                for shard, counts, before in draw_counts(owed, SHARD_SLOTS, seed, low, low + TASK_SHARDS):
                    some = np.flatnonzero(counts)
                    base = np.cumsum(counts[some]) - counts[some]
                    out.append([np.full(len(some), shard), some, before[some], counts[some], base, np.full(len(some), counts.sum())])
                columns = [np.concatenate(c).astype(t) for c, t in zip(zip(*out, strict=True), (np.int32, np.int32, *[np.int64] * 4), strict=True)]
                yield pa.record_batch([pa.array(c) for c in columns], ["shard", "sid", "before", "n", "base", "total"])

    # stored, so that a task has one Python worker: two at a time would stay for all later stages, with what they hold
    table = cut_lineage(spark.range(0, shards, TASK_SHARDS).mapInArrow(draws, "shard int, sid int, before long, n long, base long, total long"))
    slots = table.select("shard", "sid", "base", "total", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))

    def aim(batches):
        for batch in batches:
            shard, sid, base, total, earlier, i = (batch.column(c).to_numpy() for c in range(6))
            size = blocks_of[sid]
            ordinal = earlier + i
            epoch = ordinal // size
            with np.errstate(over="ignore"):
                key = mixed(np.uint64(seed) + mixed(sid.astype(np.uint64) * np.uint64(1 << 32) + epoch.astype(np.uint64)))
                spot = mixed(np.uint64(seed + 1) + shard.astype(np.uint64))
            block = permuted(ordinal % size, size, key)
            slot = permuted(base + i, total, spot)
            yield pa.record_batch(
                [batch.column(0), pa.array(slot, pa.int64()), batch.column(1), pa.array(epoch, pa.int32()), pa.array(block, pa.int64())],
                ["shard", "slot", "sid", "epoch", "block"],
            )

    aimed = slots.mapInArrow(aim, "shard int, slot long, sid int, epoch int, block long")
    # slots grow with the words, which the planner cannot see behind the draws: never a broadcast
    return aimed.hint("merge").join(parts, ["sid", "block"]), sources


def mixed_counts(docs: DataFrame) -> DataFrame:
    """Per input row: doc_id, size, source_size, target, taken (words the mix takes of it, repeats counted).

    A null text has no words and is never taken; a null source is a source of its own, the last one. Repeated rows are
    rows of their own. Columns other than doc_id, source and text only tell rows apart. An empty table gives no rows.
    """
    rows = cut_lineage(keyed(docs).select("rk", "doc_id", "source", "size"))
    placements, sources = mix(rows)
    taken = placements.groupBy("sid", "start", "rk").agg(F.sum("words").alias("taken"))
    # equal rows share rk; their totals are dealt out in the order of their starts
    order = W.partitionBy("rk").orderBy("start")
    taken = taken.select("rk", "taken", F.row_number().over(order).alias("copy"))
    counts = rows.groupBy("rk", "doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m"))
    each = counts.select("rk", "doc_id", "source", "size", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("copy"))
    named = each.join(taken, ["rk", "copy"], "left")
    same = named["source"].eqNullSafe(sources["source"])
    return named.join(sources, same).select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def cut_runs(text: str, runs: list[tuple[int, int]]) -> list[str]:
    """Of each (first, words) that many words of a text from word ``first`` on, with the white space between them. The
    text is read once; only the words at the ends of runs are remembered."""
    wanted = sorted({i for first, words in runs for i in (first, first + words - 1)}, reverse=True)
    spans = {}
    for i, match in enumerate(re.finditer(WORD, text)):
        if i == wanted[-1]:
            spans[wanted.pop()] = match.span()
            if not wanted:
                break
    return [text[spans[first][0] : spans[first + words - 1][1]] for first, words in runs]


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as rows of ``docs``: a row taken whole in a pass comes once with its whole text, of another each run of
    neighbouring blocks comes as a row with that part of its text. n_chars follows the text; other columns are kept."""
    full = keyed(small_batches(docs))
    rows = cut_lineage(full.select("rk", "doc_id", "source", "size"))
    placements, _ = mix(rows)
    line = W.partitionBy("sid", "start", "epoch").orderBy("first")
    runs = placements.select("sid", "start", "epoch", "rk", "first", "words", (F.col("first") != F.coalesce(F.lag(F.col("first") + F.col("words")).over(line), F.lit(0))).cast("int").alias("gap"))
    runs = runs.withColumn("run", F.sum("gap").over(line)).groupBy("sid", "start", "epoch", "rk", "run").agg(F.min("first").alias("first"), F.sum("words").alias("words"))
    # all runs of a document meet its text in one row, so a text moves once however often it is cut
    runs = runs.groupBy("sid", "start", "rk").agg(F.collect_list(F.struct("first", "words")).alias("runs"))
    texts = full.select("rk", "size", "row").dropDuplicates(["rk"])

    @F.pandas_udf("array<string>")
    def parts(text, firsts, words):
        return pd.Series([[] if t is None else cut_runs(t, list(zip(f.tolist(), w.tolist(), strict=True))) for t, f, w in zip(text, firsts, words, strict=True)])

    joined = runs.join(texts, "rk")
    pieces = F.filter("runs", lambda r: r["words"] != F.col("size"))
    cut = F.when(F.size(pieces) > 0, F.col("row.text"))
    whole = F.transform(F.filter("runs", lambda r: r["words"] == F.col("size")), lambda _: F.col("row.text"))
    made = F.concat(whole, parts(cut, pieces["first"], pieces["words"]))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))
    return joined.select("row", F.explode(made).alias("text")).select(row.alias("row")).select("row.*")
