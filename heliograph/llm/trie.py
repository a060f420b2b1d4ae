"""A trie of conversation prefixes, built as a z-fast trie.

Every prefix of a conversation has a 128-bit name, the exclusive or of two hashes of (place, role, text) of its turns.
The trie is kept compacted: a node stands at an extent where conversations end or part, with an edge (p, e] from its
parent's extent p to its own e and a representative conversation that runs along it. A node is found by its handle: the
prefix at the two-fattest depth of (p, e], the number there that the largest power of two divides. A fat binary search
over depths probes handles by a join and comes to the deepest node that a conversation matches whole in about
log2(length) probes; the child by the next turn and a comparison of names along its edge then give its exit point.

Conversations go in by batches of growing size. Each batch is located in the trie as it is, splits the edges on which
it leaves, and only the turns after the exit points are grouped to make its own nodes, so a first turn that most
conversations share is grouped for the first, small batch only. Counts are summed up the compacted tree by pointer
doubling, and in the end edges are expanded to a node per depth.

Names lie in arrays of up to PART turns, so a conversation of any length is many rows; nothing else grows with one.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from heliograph.llm.common import WORD
from heliograph.session import cut_lineage

# Turns of one array of names.
PART = 256
# Batches by a hash out of 64: the first below 2, then the rest.
BATCHES = (2, 64)
# Copies of a dictionary row, so that probes for one hot prefix are many join keys.
SALTS = 8
# Conversation ids of one row of a list of ends; they are distinct, so it is a bound.
RUN_IDS = 4096

NAME = "struct<x:long,y:long>"
_ZERO = f"named_struct('h', cast(named_struct('x', 0L, 'y', 0L) AS {NAME}), 'w', 0L)"


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv, at, role, text): turns with their places from 0, ordered by turn (null first), role and text.

    Null roles and texts are empty; rows with a null conv_id belong to no conversation. Places are counted within
    ranges of the turn number and carried over, so a long conversation is many tasks.
    """
    rows = cut_lineage(conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.floor(F.col("turn") / 4096), F.lit(-(1 << 60))).cast("long").alias("range"),
    ))
    before = W.partitionBy("conv").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sizes = rows.groupBy("conv", "range").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("conv", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = W.partitionBy("conv", "range").orderBy("turn", "role", "text")
    placed = rows.withColumn("i", F.row_number().over(inside) - 1).join(starts, ["conv", "range"])
    return placed.select("conv", (F.col("start") + F.col("i")).cast("long").alias("at"), "role", "text")


def rebuilt(turns: DataFrame, group: int = 20, kinds: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): each conversation c begins with the first h turns of conversation c - c % group, all if
    it has fewer, and goes on with its own after its first h; h = crc32(c) % kinds. ``turns`` is a stored frame."""
    own = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("size"))
    head = F.col("conv") - F.col("conv") % group
    convs = own.select("conv", head.alias("head"), (F.crc32(F.col("conv").cast("string").cast("binary")) % kinds).alias("h"))
    convs = cut_lineage(convs.join(own.select(F.col("conv").alias("head"), F.col("size").alias("given")), "head", "left"))
    taken = turns.where(F.col("at") < kinds - 1).withColumnRenamed("conv", "head").join(convs.select("head", "conv", "h"), "head")
    taken = taken.where("at < h").select("conv", "at", "role", "text")
    shift = F.least("h", F.coalesce("given", F.lit(0))) - F.col("h")
    rest = turns.join(convs.select("conv", "h", shift.alias("shift")), "conv").where("at >= h")
    return taken.unionByName(rest.select("conv", (F.col("at") + F.col("shift")).alias("at"), "role", "text")), convs.select("conv")


def _spread(left: DataFrame, right: DataFrame, keys: list[str], by: str, how: str = "inner") -> DataFrame:
    """Join of many rows with few; right rows come SALTS times so that a hot key is that many keys."""
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def fattest(low: Column, high: Column) -> Column:
    """The two-fattest number of (low, high], low < high."""
    bits = F.length(F.bin(low.bitwiseXOR(high))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", high, bits), bits).cast("long")


class _Prefixes:
    """Names and word counts of all prefixes: (conv, part, a), where a[i] is of depth PART * part + i, from 0."""

    def __init__(self, turns: DataFrame) -> None:
        place = F.struct("at", "role", "text")
        rows = cut_lineage(turns.select(
            "conv", "at", F.expr(f"at div {PART}").alias("part"), *(F.xxhash64(F.lit(s), place).alias(k) for s, k in ((11, "x"), (12, "y"))),
            F.regexp_count("text", F.lit(WORD)).cast("long").alias("w"),
        ))
        totals = rows.groupBy("conv", "part").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("w").alias("w"))
        before = W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        zero = F.lit(0).cast("long")
        carried = totals.select("conv", "part", *(F.coalesce(F.bit_xor(k).over(before), zero).alias(f"{k}0") for k in "xy"), F.coalesce(F.sum("w").over(before), zero).alias("w0"))
        listed = rows.groupBy("conv", "part").agg(F.array_sort(F.collect_list(F.struct("at", "x", "y", "w"))).alias("l")).join(carried, ["conv", "part"])
        start = F.array(F.struct(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")).alias("h"), F.col("w0").alias("w")))

        def add(acc: Column, t: Column) -> Column:
            last = F.element_at(acc, -1)
            name = F.struct(last["h"]["x"].bitwiseXOR(t["x"]).alias("x"), last["h"]["y"].bitwiseXOR(t["y"]).alias("y"))
            return F.array_append(acc, F.struct(name.alias("h"), (last["w"] + t["w"]).alias("w")))

        self.table = cut_lineage(listed.select("conv", "part", F.aggregate("l", start.cast(f"array<struct<h:{NAME},w:long>>"), add).alias("a")))
        self.depth = self.table.agg(F.max(F.col("part") * PART + F.size("a") - 1).alias("d")).first().d or 0

    def at(self, df: DataFrame, conv: str, depth: Column, out: str) -> DataFrame:
        """Adds ``out``: struct (h, w) of the prefix of ``conv`` of that depth."""
        keyed = df.withColumn("_depth", depth).withColumn("_part", F.expr(f"greatest(_depth - 1, 0L) div {PART}"))
        names = self.table.select(F.col("conv").alias(conv), F.col("part").alias("_part"), F.col("a").alias("_a"))
        found = keyed.join(names, [conv, "_part"], "left")
        value = F.coalesce(F.get("_a", (F.col("_depth") - F.col("_part") * PART).cast("int")), F.expr(_ZERO))
        return found.withColumn(out, value).drop("_a", "_part", "_depth")

    def after(self, starts: DataFrame) -> DataFrame:
        """(conv, m, d, h, before, w): the prefixes deeper than ``m`` of the conversations of ``starts`` (conv, m), each
        with the name of the one above and the words down to it."""
        kept = self.table.join(starts, "conv").where(F.col("part") * PART + F.size("a") - 1 > F.col("m"))
        each = kept.select("conv", "m", "part", "a", F.explode(F.sequence(F.lit(1), F.size("a") - 1)).alias("i"))
        rows = each.select("conv", "m", (F.col("part") * PART + F.col("i")).alias("d"), F.get("a", F.col("i"))["h"].alias("h"),
                           F.get("a", F.col("i") - 1)["h"].alias("before"))
        return rows.where("d > m")


def _with_keys(nodes: DataFrame, prefixes: _Prefixes) -> DataFrame:
    """Nodes (e, h, p, q, rep) with their handle (f, g) and the name c of the prefix of depth p + 1."""
    named = prefixes.at(nodes.withColumn("f", fattest(F.col("p"), F.col("e"))), "rep", F.col("f"), "_f")
    named = prefixes.at(named, "rep", F.col("p") + 1, "_c")
    return named.select("e", "h", "p", "q", "rep", "f", F.col("_f.h").alias("g"), F.col("_c.h").alias("c"))


def _part(depth: Column) -> Column:
    """The part that holds the name of this depth as one of its own."""
    return F.floor((F.greatest(depth, F.lit(1)) - 1) / PART).cast("long")


def _located(batch: DataFrame, nodes: DataFrame, prefixes: _Prefixes) -> DataFrame:
    """(conv, n, lo, a, part): lo is the depth of the deepest node that a conversation (conv, n) matches whole, a the
    part of its names with depth lo + 1 (n, if it ends there).

    Rows carry one part of their names; a round probes one handle for each row that has the depth at hand, and checks the
    extent of the node it meets. Rows that need another part fetch it first.
    """
    handles = nodes.where("e > 0").select("f", "g", "e", "h", "p")
    # (e, h, p) is the node met last, while its extent lies in another part
    state = batch.select("conv", "n", F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi"), *(F.lit(None).cast(t).alias(c) for c, t in (("e", "long"), ("h", NAME), ("p", "long"))))
    state = cut_lineage(state.withColumn("part", F.lit(0).cast("long")).join(prefixes.table, ["conv", "part"]))
    name = lambda depth: F.get("a", (depth - F.col("part") * PART).cast("int"))["h"]
    probe = F.when(F.col("lo") < F.col("hi"), fattest(F.col("lo"), F.col("hi")))
    needed = F.coalesce("e", probe, F.least(F.col("lo") + 1, "n"))
    while True:
        far = _part(needed) != F.col("part")
        todo = state.agg(F.count_if(far).alias("far"), F.count_if(F.col("lo") < F.col("hi")).alias("going")).first()
        if todo.far:
            moved = state.where(far).withColumn("part", _part(needed)).drop("a").join(prefixes.table, ["conv", "part"])
            state = cut_lineage(state.where(~far).unionByName(moved.select(*state.columns)))
        if not todo.going:
            if not todo.far:
                return state.select("conv", "n", "lo", "part", "a")
            continue
        whole = name(F.col("e")) == F.col("h")
        checked = state.select(
            "conv", "n", "part", "a", F.when(F.col("e").isNull(), F.col("lo")).when(whole, F.col("e")).otherwise(F.col("p")).alias("lo"),
            F.when(F.col("e").isNull() | whole, F.col("hi")).otherwise(F.col("p")).alias("hi"),
        )
        asked = checked.withColumn("f", probe).withColumn("g", F.when(_part(F.col("f")) == F.col("part"), name(F.col("f"))))
        met = _spread(asked, handles, ["f", "g"], "conv", "left")
        waits, lost = F.col("g").isNull(), F.col("e").isNull()
        short = F.col("e") > F.col("n")
        later = ~short & (_part(F.col("e")) != F.col("part"))
        whole = ~short & (name(F.col("e")) == F.col("h"))
        decided = lambda keep, miss, hit, part: F.when(waits | (~lost & later), keep).when(lost, miss).when(whole, hit).otherwise(part)
        state = cut_lineage(met.select(
            "conv", "part", "n", decided(F.col("lo"), F.col("lo"), F.col("e"), F.col("p")).alias("lo"),
            decided(F.col("hi"), F.col("f") - 1, F.col("hi"), F.col("p")).alias("hi"),
            *(F.when(~waits & ~lost & later, F.col(c)).alias(c) for c in ("e", "h", "p")), "a",
        ))


def locate(batch: DataFrame, nodes: DataFrame, prefixes: _Prefixes) -> DataFrame:
    """(conv, n, m, hm, edge) of the conversations (conv, n): m is the length of the longest prefix that the trie has,
    hm its name; edge is the node (e, h, p, q, rep) on whose edge it ends, null if it ends at a node."""
    deepest = _located(batch, nodes, prefixes)
    # the child by the next turn; comparing names along its edge
    asked = deepest.withColumn("c", F.when(F.col("lo") < F.col("n"), F.get("a", (F.col("lo") + 1 - F.col("part") * PART).cast("int"))["h"])).drop("a", "part")
    edges = nodes.where("e > 0").select(F.col("p").alias("lo"), "c", F.struct("e", "h", "p", "q", "rep").alias("edge"))
    asked = cut_lineage(_spread(asked, edges, ["lo", "c"], "conv", "left").drop("c"))
    last = F.least("n", "edge.e")
    parts = asked.where("edge is not null").select(
        "conv", "lo", last.alias("last"), F.col("edge.rep").alias("rep"), F.explode(F.expr(f"sequence(lo div {PART}, (least(n, edge.e) - 1) div {PART})")).alias("part"))
    mine = parts.join(prefixes.table, ["conv", "part"])
    theirs = prefixes.table.join(edges.select(F.col("edge.rep").alias("conv")).distinct(), "conv", "left_semi")
    both = _spread(mine, theirs.select(F.col("conv").alias("rep"), "part", F.col("a").alias("b")), ["rep", "part"], "conv")
    first = F.greatest(F.col("lo") + 1 - F.col("part") * PART, F.lit(1)).cast("int")
    end = F.least(F.col("last") - F.col("part") * PART, F.lit(PART)).cast("int")
    alike = F.size(F.filter(F.sequence(first, end), lambda i: F.get("a", i)["h"] == F.get("b", i)["h"]))
    steps = both.groupBy("conv").agg(F.sum(alike).alias("steps"))
    ended = asked.join(steps, "conv", "left").withColumn("m", F.col("lo") + F.coalesce("steps", F.lit(0)))
    return cut_lineage(prefixes.at(ended, "conv", F.col("m"), "_m").select(
        "conv", "n", "m", F.col("_m.h").alias("hm"), F.when(F.col("m") > F.col("lo"), F.col("edge")).alias("edge")))


def insert(nodes: DataFrame, batch: DataFrame, prefixes: _Prefixes) -> DataFrame:
    """The nodes of the trie with the conversations (conv, n) of a batch, no two of which are equal or in it."""
    found = locate(batch, nodes, prefixes)
    # edges are cut where a conversation leaves them or ends
    points = found.where("edge is not null").select("edge", F.col("m").alias("e"), F.col("hm").alias("h")).distinct()
    cut = cut_lineage(points.unionByName(points.select("edge").distinct().select("edge", F.col("edge.e").alias("e"), F.col("edge.h").alias("h"))))
    along = W.partitionBy("edge").orderBy("e")
    above = F.coalesce(F.lag(F.struct(F.col("e").alias("p"), F.col("h").alias("q"))).over(along), F.struct(F.col("edge.p").alias("p"), F.col("edge.q").alias("q")))
    pieces = cut.withColumn("above", above).select("e", "h", "above.p", "above.q", "edge.rep")
    # new nodes: where the turns after the exit points part or end
    rest = cut_lineage(prefixes.after(found.select("conv", "m")))
    parting = rest.where("d > m + 1").groupBy((F.col("d") - 1).alias("d"), F.col("before").alias("h")).agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high")
    ends = rest.join(found.select("conv", F.col("n").alias("d")), ["conv", "d"]).select("d", "h")
    fresh = cut_lineage(parting.select("d", "h").unionByName(ends).distinct())
    on_path = _spread(rest, fresh, ["d", "h"], "conv").join(found.select("conv", "hm"), "conv")
    path = W.partitionBy("conv").orderBy("d")
    above = F.coalesce(F.lag(F.struct(F.col("d").alias("p"), F.col("h").alias("q"))).over(path), F.struct(F.col("m").alias("p"), F.col("hm").alias("q")))
    new = on_path.withColumn("above", above).groupBy(F.col("d").alias("e"), "h").agg(F.min(F.struct("conv", "above")).alias("r"))
    new = new.select("e", "h", "r.above.p", "r.above.q", F.col("r.conv").alias("rep"))
    stay = nodes.join(cut.select("e", "h", F.lit(True).alias("_cut")), ["e", "h"], "left_anti")
    return cut_lineage(stay.unionByName(_with_keys(pieces.unionByName(new), prefixes).select(*stay.columns)))


def _summed(tree: DataFrame, sums: dict[str, str]) -> DataFrame:
    """(id, sums) over each node and what is below it, by pointer doubling on (id, up): after k rounds a node has what is
    less than 2**k below it, and up is its ancestor 2**k above. ``sums`` names the columns and their aggregates."""
    now, any_up = cut_lineage(tree.select("id", "up", *sums)), True
    add = {"sum": lambda c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)), "min": lambda c: F.least(c, f"_{c}")}
    while any_up:
        given = now.where("up is not null").groupBy(F.col("up").alias("id")).agg(*(getattr(F, f)(c).alias(f"_{c}") for c, f in sums.items()))
        higher = now.where("up is not null").select(F.col("id").alias("up"), F.col("up").alias("_upper"))
        now = cut_lineage(_spread(now.join(given, "id", "left"), higher, ["up"], "id", "left").select("id", F.col("_upper").alias("up"), *(add[f](c).alias(c) for c, f in sums.items())))
        any_up = not now.where("up is not null").isEmpty()
    return now.drop("up")


def _ends(convs: DataFrame) -> DataFrame:
    """(e, h, ends, first, ends_sha256) of conversations (conv, n, h) by where they end. Ids are gathered in rows of a bounded
    range, which one stream per place then hashes in order."""
    runs = convs.groupBy(F.col("n").alias("e"), "h", F.expr(f"conv div {RUN_IDS}").alias("run"), (F.col("conv") < 0).alias("plus")).agg(F.array_sort(F.collect_list("conv")).alias("ids"))
    runs = runs.select("e", "h", F.element_at("ids", 1).alias("start"), F.size("ids").cast("long").alias("m"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    # a count is named, as adaptive execution would put the few, small rows into one task
    tasks = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = runs.repartition(tasks, "e", "h").sortWithinPartitions("e", "h", "start")

    def digest(batches):
        key, state, first, count = None, None, None, 0

        def done():
            (e, (x, y)) = key
            return pa.record_batch([pa.array([e]), pa.array([{"x": x, "y": y}], pa.struct([("x", pa.int64()), ("y", pa.int64())])), pa.array([count]), pa.array([first]), pa.array([state.hexdigest()])], ["e", "h", "ends", "first", "ends_sha256"])

        for batch in batches:
            for row in batch.to_pylist():
                here = row["e"], (row["h"]["x"], row["h"]["y"])
                if here != key:
                    if key is not None:
                        yield done()
                    key, state, first, count = here, hashlib.sha256(), row["start"], 0
                else:
                    state.update(b",")
                state.update(row["ids"].encode())
                count += row["m"]
        if key is not None:
            yield done()

    return ordered.mapInArrow(digest, f"e long, h {NAME}, ends long, first long, ends_sha256 string")


def trie_nodes(turns: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """One row per distinct prefix of the conversations ``turns`` (conv, at from 0 without gaps, role, text): conv_id
    (smallest conversation that begins with it), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    (words of the last texts in the subtree, each as often as conversations share it beyond the first), ends_sha256
    (of the comma-joined ids that end here).

    ``convs`` (conv) adds conversations without turns, which end at the root. Equal conversations are inserted once. Without
    any conversation there are no rows, not even the root. An empty role or text is a turn like others.
    """
    prefixes = _Prefixes(turns)
    lengths = prefixes.table.groupBy("conv").agg(F.max(F.col("part") * PART + F.size("a") - 1).alias("n"))
    if convs is not None:
        lengths = convs.select("conv").distinct().join(lengths, "conv", "left").select("conv", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    whole = cut_lineage(prefixes.at(lengths, "conv", F.col("n"), "_n").select("conv", "n", F.col("_n.h").alias("h")))
    ends = cut_lineage(_ends(whole))
    strings = cut_lineage(ends.where("e > 0").select(F.col("first").alias("conv"), F.col("e").alias("n"), F.pmod(F.xxhash64("first"), F.lit(BATCHES[-1])).alias("deal")))

    spark = turns.sparkSession
    schema = f"e long, h {NAME}, p long, q {NAME}, rep long, f long, g {NAME}, c {NAME}"
    nodes = cut_lineage(spark.range(1).select(F.expr(_ZERO)["h"].alias("h"), F.lit(0).cast("long").alias("e"))).select(
        "e", "h", *(F.lit(None).cast(t).alias(c) for c, t in (("p", "long"), ("q", NAME), ("rep", "long"), ("f", "long"), ("g", NAME), ("c", NAME))))
    assert nodes.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
    low = 0
    for high in BATCHES:
        batch = strings.where((F.col("deal") >= low) & (F.col("deal") < high)).select("conv", "n")
        nodes = insert(nodes, batch, prefixes)
        low = high

    # counts up the compacted tree; the root, which everything is below, is summed apart
    ids = cut_lineage(nodes.where("e > 0").select("e", "h", "p", "q", "rep").withColumn("id", F.monotonically_increasing_id()))
    up = ids.select(F.col("e").alias("p"), F.col("h").alias("q"), F.col("id").alias("up"))
    tree = _spread(ids, up, ["p", "q"], "id", "left").join(ends.drop("ends_sha256"), ["e", "h"], "left")
    below = ids.groupBy(F.col("p").alias("e"), F.col("q").alias("h")).agg(F.count(F.lit(1)).alias("n_children"))
    tree = tree.join(below, ["e", "h"], "left").na.fill(0, ["ends", "n_children"])
    tree = prefixes.at(tree, "rep", F.col("e"), "_e")
    tree = prefixes.at(tree, "rep", F.col("p"), "_p")
    tree = cut_lineage(tree.select("id", "e", "h", "p", "q", "rep", "up", "n_children", F.col("ends").alias("n_convs"), F.col("first").alias("conv_id"),
                                   (F.col("n_children") == 0).cast("long").alias("n_leaves"), F.col("_e.w").alias("upto"), (F.col("_e.w") - F.col("_p.w")).alias("words")))
    counts = _summed(tree.withColumn("gone", F.col("n_convs") * F.col("upto")).withColumn("distinct", F.col("words")),
                     {"n_convs": "sum", "conv_id": "min", "n_leaves": "sum", "gone": "sum", "distinct": "sum"})
    # of an edge and what is below it: words down to all ends, less those above the edge, less each word once
    deep = F.col("gone") - F.col("n_convs") * (F.col("upto") - F.col("words")) - F.col("distinct")
    kept = tree.select("id", "e", "p", "rep", "up", "n_children", "upto", "words", "h")
    tree = kept.join(counts, "id").withColumn("deep", deep).join(ends.select("e", "h", "ends_sha256"), ["e", "h"], "left")
    tree = cut_lineage(_spread(tree, counts.select(F.col("id").alias("up"), F.col("conv_id").alias("_parent")), ["up"], "id", "left"))

    # edges expanded to a node per depth
    first = whole.agg(F.min("conv")).scalar()
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    none = F.lit(None).cast("long")
    parts = tree.withColumn("part", F.explode(F.expr(f"sequence(p div {PART}, (e - 1) div {PART})")))
    held = parts.join(prefixes.table.withColumnRenamed("conv", "rep"), ["rep", "part"])
    each = held.select("*", F.explode(F.expr(f"sequence(greatest(p + 1 - part * {PART}, 1L), least(e - part * {PART}, {PART}L))")).alias("i"))
    depth = F.col("part") * PART + F.col("i")
    at_end = depth == F.col("e")
    above = F.get("a", (F.col("i") - 1).cast("int"))["w"] - (F.col("upto") - F.col("words"))  # words of the edge above this depth
    saved = F.col("deep") - (F.col("n_convs") - 1) * above
    inner = each.select(
        "conv_id", depth.alias("depth"), F.when(depth > F.col("p") + 1, F.col("conv_id")).otherwise(F.coalesce("_parent", first)).alias("parent_conv_id"),
        "n_convs", F.when(at_end, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves", saved.alias("saved_tokens"),
        F.when(at_end, F.coalesce("ends_sha256", empty)).otherwise(empty).alias("ends_sha256"),
    )
    top = whole.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    at_root = tree.agg(F.sum(F.when(F.col("p") == 0, 1).otherwise(0)).alias("n_children"), F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaves"), F.sum(F.when(F.col("p") == 0, F.col("deep")).otherwise(0)).alias("saved"))
    rooted = ends.where("e = 0").agg(F.max("ends_sha256").alias("ends_sha256"))
    root = top.crossJoin(at_root).crossJoin(rooted).select(  # three single rows
        "conv_id", F.lit(0).cast("long").alias("depth"), none.alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.greatest(F.coalesce("leaves", F.lit(0)), F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"), F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )
    longs = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    return inner.unionByName(root).select(*(F.col(c).cast("long").alias(c) for c in longs), "ends_sha256")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations; see ``numbered``, ``rebuilt`` and ``trie_nodes``. Other columns are not read."""
    turns, convs = rebuilt(cut_lineage(numbered(conversations)))
    return trie_nodes(cut_lineage(turns), convs)
