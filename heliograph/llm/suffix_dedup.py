"""Repeated passages by suffix structures: threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte goes if it is covered by a string of ``length`` bytes that also starts anywhere else. The corpus is never
one suffix array. Every such string has a key that depends on its bytes only, the least hash of its GRAM-byte
windows; neighbouring strings mostly share it, so a text falls into runs of strings of one key. Keys that only one run
has are dropped, by a bit table of fixed size, before any text moves. Runs of equal bytes are one row with a count, and
the runs of a key meet in one group, where all equal strings are together. Keys that very many runs have, as under a
passage of very many texts, are divided by the least hash under a second order. A key whose distinct runs still hold
more than GROUP_BYTES is no group: its strings are counted one by one by their digests, so a group is bounded.

A group's runs are joined by separators and sorted by suffix; from the Burrows-Wheeler transform of that order,
breadth-first backward extension of intervals derives the common prefixes of neighbouring suffixes by increasing
value: the interval of a string w of v bytes is extended to cw for each byte c before it, and the first extension that
ends at a place sets the common prefix there to v. At ``length`` it stops: places not reached have a common prefix of
``length`` or more, and the suffixes between reached places share a string of that many bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import bytes_of, filter_table, in_table, mixed, powers, prefix_hash, slices, small_batches
from heliograph.session import cut_lineage

LENGTH = 400
GRAM = 32
# Runs from which a key is divided.
HOT_RUNS = 256
# The least of some hundred windows is nearly always under this.
SMALL = np.uint64((1 << 64) // 16)
# Bytes of the largest group that is sorted, and those that a task sorts at a time when several small groups come together.
GROUP_BYTES = 1 << 20
# Strings that a task counts or sends at a time.
COUNT_STRINGS = 1 << 18


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours: running minima from both ends of blocks of that width."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    full = -(-len(x) // width) * width
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def key_runs(
    data: np.ndarray, length: int, gram: int, hot: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first string, strings, least hash, key, whether a string may repeat inside) of the runs of equal keys of a text
    of at least ``length`` bytes. Least hashes in the table ``hot`` are divided by a second order. A string repeats
    inside a run only if its least window does, in the bytes of that run."""
    with np.errstate(over="ignore"):
        h = prefix_hash(data)
        grams = mixed((h[gram:] - h[:-gram]) * powers(len(data) - gram + 1, "down"))
        one = _least(grams, length - gram + 1)
        starts = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]]))
        first = one[starts]
        key = first
        divided = np.zeros(len(starts), bool) if hot is None else in_table(hot, first.view(np.int64))
        if divided.any():
            two = _least(mixed(grams ^ np.uint64(0xA5A5F00D5EED1234)), length - gram + 1)
            within = np.repeat(divided, np.diff(np.append(starts, len(one))))
            starts = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (within[1:] & (two[1:] != two[:-1]))]))
            first = one[starts]
            key = np.where(within[starts], mixed(first + mixed(two[starts])), first)
        strings = np.diff(np.append(starts, len(one)))
        # least windows are small numbers: neighbouring places (left, right) of those of them that the text holds twice
        at = np.flatnonzero(grams < SMALL)
        at = at[np.argsort(grams[at], kind="stable")]
        twice = np.flatnonzero(grams[at[1:]] == grams[at[:-1]])
        again = first >= SMALL
        if len(twice):
            left, right = at[twice], at[twice + 1]
            value, which = np.unique(grams[left], return_inverse=True)
            j = np.searchsorted(value, first)
            pair = np.searchsorted(which * len(data) + left, j * len(data) + starts)
            j, pair = np.minimum(j, len(value) - 1), np.minimum(pair, len(left) - 1)
            again |= (value[j] == first) & (which[pair] == j) & (left[pair] >= starts) & (right[pair] < starts + strings + length - gram)
        return starts, strings, first, key, again


def _ordered(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of numbers of at most ``bits`` bits, and the numbers in it."""
    low = len(key).bit_length()
    if bits + low > 63:
        order = np.argsort(key, kind="stable")
        return order, key[order]
    packed = key << low | np.arange(len(key))
    packed.sort()
    return packed & ((1 << low) - 1), packed >> low


def suffix_order(text: np.ndarray, left: np.ndarray, length: int) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """(order, k, heads, ends) of the suffixes of a text with ``left`` symbols from each place to its separator, 0.

    Suffixes are sorted by prefix doubling up to ``length`` symbols or more, and by place where they are equal in these
    or up to their separators; strings up to ``length`` have the places that the whole order would give them. Symbols
    after a separator do not count. The first sort takes k symbols: heads are the places in order whose k symbols are
    not those of the place before, ends those of them that differ in the last of the k only.
    """
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    k = max(1, min(length, (63 - n.bit_length()) // bits))
    padded = np.concatenate([text.astype(np.int64), np.zeros(k, np.int64)])
    first = np.zeros(n, np.int64)
    for j in range(k):
        first <<= bits
        first |= padded[j : j + n]
    first &= np.array([-1 << bits * (k - m) for m in range(k + 1)])[np.minimum(left, k)]
    order, key = _ordered(first, bits * k)
    room = left[order]
    head = np.append(True, (key[1:] != key[:-1]) | (room[1:] < k))
    ends = np.flatnonzero(head[1:] & (key[1:] >> bits == key[:-1] >> bits) & (room[1:] >= k - 1)) + 1
    heads = np.flatnonzero(head)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    open_ = ~(head & np.append(head[1:], True))
    places, head, step = np.flatnonzero(open_), head[open_], k
    while len(places) and step < length:
        some = order[places]
        group = np.cumsum(head) - 1
        at, key = _ordered(group << n.bit_length() | rank[some + step], n.bit_length() + int(group[-1]).bit_length())
        some = some[at]
        order[places] = some
        head = np.append(True, key[1:] != key[:-1])
        at = np.flatnonzero(head)
        rank[some] = np.repeat(places[at], np.diff(np.append(at, len(places))))
        open_ = ~(head & np.append(head[1:], True))
        places, head = places[open_], head[open_]
        step *= 2
    return order, k, heads, ends


def common_prefix_reaches(bwt: np.ndarray, length: int, k: int, heads: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the suffix at each place shares ``length`` symbols or more with the one before it in suffix order.

    Symbols are above 0; 0 is a separator, each unlike all others, which no string crosses. The intervals of strings of k
    symbols begin at ``heads``; those whose common prefix with the next is k - 1 end at ``ends``.
    """
    n = len(bwt)
    below = np.zeros(n + 1, bool)  # below[i]: the common prefix of places i-1 and i is known to be shorter
    below[heads] = True
    below[n] = True
    by_symbol = np.argsort(bwt, kind="stable")
    last_first = np.empty(n, np.int64)
    last_first[by_symbol] = np.arange(n)
    # the places of the same symbol before and after each; a separator is neither the first nor the last of its kind
    edge = bwt[by_symbol[1:]] != bwt[by_symbol[:-1]]
    before, after = np.empty(n, np.int64), np.empty(n, np.int64)
    before[by_symbol] = np.append(-1, np.where(edge, -1, by_symbol[:-1]))
    after[by_symbol] = np.append(np.where(edge, n, by_symbol[1:]), n)
    before[bwt == 0], after[bwt == 0] = n, -1
    right = ends
    left = heads[np.searchsorted(heads, ends) - 1]
    for _ in range(k, length):
        if not len(left):
            break
        one = right - left == 1
        at = left[one]
        at = last_first[at[bwt[at] > 0]]
        new_left, new_right = at, at + 1
        if len(at) < len(left) and not one.all():
            start, end = left[~one], right[~one]
            size = end - start
            stops = np.cumsum(size)
            places = np.arange(stops[-1]) + np.repeat(start - (stops - size), size)
            # the places of one interval and symbol go to neighbouring places, and no others go between: the first and
            # the last of each, in order, are the ends of the new intervals
            first = last_first[places[before[places] < np.repeat(start, size)]]
            last = last_first[places[after[places] >= np.repeat(end, size)]]
            first.sort()
            last.sort()
            new_left, new_right = np.concatenate([at, first]), np.concatenate([new_right, last + 1])
        keep = ~below[new_right]
        left, right = new_left[keep], new_right[keep]
        below[right] = True
    return ~below[:n]


def _hit_places(texts: list[bytes], counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether the string of ``length`` bytes at each place of the joined texts starts more than once in all the texts,
    first place of each text); a text with a count above one stands for so many."""
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    lengths = np.array([len(t) for t in texts])
    separators = np.cumsum(lengths + 1) - 1
    met = np.bincount(raw, minlength=256)
    met[0] -= len(texts)
    symbol = np.cumsum(met > 0)
    text = symbol.astype(np.uint8 if symbol[-1] < 256 else np.uint16)[raw]
    text[separators] = 0
    left = np.repeat(separators, lengths + 1) - np.arange(len(raw))
    order, k, heads, ends = suffix_order(text, left, length)
    reaches = common_prefix_reaches(text[order - 1], length, k, heads, ends)
    # places from one that does not reach to the next are the suffixes of one string
    group = np.cumsum(~reaches) - 1
    weight = np.bincount(group, weights=np.repeat(counts, lengths + 1)[order])
    hit = np.zeros(len(raw), bool)
    hit[order] = weight[group] > 1
    return hit & (left >= length), separators - lengths


def repeated_strings(texts: list[bytes], counts: np.ndarray, length: int) -> list[np.ndarray]:
    """For each distinct text the positions whose string of ``length`` bytes starts more than once in all the texts,
    a text with a count above one standing for so many."""
    hit, starts = _hit_places(texts, counts, length)
    at = np.flatnonzero(hit)
    owner = np.searchsorted(starts, at, "right") - 1
    return np.split(at - starts[owner], np.searchsorted(owner, np.arange(1, len(texts))))


def spans_of(positions: np.ndarray) -> np.ndarray:
    """(first, count) of the runs of neighbouring positions."""
    if not len(positions):
        return np.empty((0, 2), np.int64)
    starts = np.flatnonzero(np.concatenate([[True], np.diff(positions) > 1]))
    return np.column_stack([positions[starts], np.diff(np.append(starts, len(positions)))])


def _runs(texts: pa.Array, length: int, gram: int, hot: np.ndarray | None = None):
    """(text number, bytes, first string, strings, least hash, key, repeats inside) of each text that is long enough."""
    for a, b in slices(texts):
        data, at = bytes_of(texts[a:b])
        for i in range(b - a):
            one = data[at[i] : at[i + 1]]
            if len(one) >= length:
                yield a + i, one, *key_runs(one, length, gram, hot)


def _key_tables(rows: DataFrame, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Filter tables of the least hashes of two runs or more (or of one that may repeat a string), and of HOT_RUNS or more."""

    def emit(batches):
        for batch in batches:
            found = [y for x in _runs(batch.column(0), length, gram) for y in (x[4], x[4][x[6]])]
            if found:
                yield pa.record_batch([pa.array(np.concatenate(found).view(np.int64))], ["key"])

    counted = rows.select("text").mapInArrow(emit, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counted = cut_lineage(counted)
    return filter_table(counted.select("key")), filter_table(counted.where(F.col("n") >= HOT_RUNS).select("key"))


def _string_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the string at each position that has one."""
    with np.errstate(over="ignore"):
        h = prefix_hash(data)
        return mixed((h[length:] - h[:-length]) * powers(len(data) - length + 1, "down")).view(np.int64)


def _hits_by_digest(runs: DataFrame, length: int) -> DataFrame:
    """(run, hits) of distinct runs (run, content, n), whose keys are too large for a group.

    Strings whose 64-bit hash comes once go by a filter table of fixed size; the rest are counted by MD5. A run leaves
    for a string at most a row, and only if the string may repeat."""

    def count(batches):
        def flush(held):
            values, at = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            n = np.zeros(len(values), np.int64)
            np.add.at(n, at, np.repeat([c for _, c in held], [len(h) for h, _ in held]))
            return pa.record_batch([pa.array(values), pa.array(n)], ["h", "n"])

        held, size = [], 0
        for batch in batches:
            for content, n in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                held.append((_string_hashes(np.frombuffer(content.as_buffer(), np.uint8), length), n))
                size += len(held[-1][0])
                if size > COUNT_STRINGS:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    counted = runs.select("content", "n").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    several = runs.sparkSession.sparkContext.broadcast(filter_table(counted.where("n > 1").select("h")))

    def send(batches):
        def flush(held):
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64())
            return pa.record_batch([pa.array([x[i] for x in held], k) for i, k in enumerate(kinds)], ["digest", "run", "at", "n"])

        held = []
        for batch in batches:
            for run, content, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                some = np.flatnonzero(in_table(several.value, _string_hashes(np.frombuffer(content, np.uint8), length)))
                for at in some.tolist():
                    held.append((hashlib.md5(content[at : at + length]).digest(), run, at, n))
                    if len(held) >= COUNT_STRINGS:
                        yield flush(held)
                        held = []
        if held:
            yield flush(held)

    sent = cut_lineage(runs.select("run", "content", "n").mapInArrow(send, "digest binary, run binary, at long, n long"))
    repeated = cut_lineage(sent.groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1").select("digest"))
    hit = sent.join(repeated, "digest", "left_semi")
    # the first position of each range of neighbours, and the number of them
    placed = hit.select("run", "at").groupBy("run").agg(F.sort_array(F.collect_list("at")).alias("at"))

    def span(batches):
        for batch in batches:
            hits = [[{"at": int(a), "n": int(n)} for a, n in spans_of(np.array(at, np.int64))] for at in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(hits, _HITS)], ["run", "hits"])

    return placed.mapInArrow(span, "run binary, hits array<struct<at: long, n: long>>")


_HITS = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per input row: doc_id, text, spans - the byte ranges [start, end) to remove, in order, apart and without overlap.

    A null text is empty and has none. Equal texts are repeats of each other; so are repeated rows. Matches are judged on
    the texts as given. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("tkey", F.unhex(F.md5("text")))
    shared, hot = (spark.sparkContext.broadcast(t) for t in _key_tables(rows, length, gram))

    def cut(batches):
        for batch in batches:
            texts, out, held = batch.column(0), [], 0
            tkeys = batch.column(1)
            for i, data, first, strings, least, key, again in _runs(texts, length, gram, hot.value):
                for j in np.flatnonzero(in_table(shared.value, least.view(np.int64))).tolist():
                    content = data[first[j] : first[j] + strings[j] + length - 1].tobytes()
                    out.append((tkeys[i].as_py(), int(first[j]), int(strings[j]), int(key[j : j + 1].view(np.int64)[0]), hashlib.md5(content).digest(), content, bool(again[j])))
                    held += len(content)
                if held > GROUP_BYTES:
                    yield _pieces(out)
                    out, held = [], 0
            if out:
                yield _pieces(out)

    pieces = cut_lineage(rows.select("text", "tkey").mapInArrow(cut, "tkey binary, first long, strings long, key long, run binary, content binary, again boolean"))
    sizes = pieces.select("key", "run", "strings").distinct().groupBy("key").agg(F.sum(F.col("strings") + (length - 1)).alias("bytes"))
    large = cut_lineage(sizes.where(F.col("bytes") > GROUP_BYTES).select("key"))

    def runs_of(some: DataFrame) -> DataFrame:
        return some.groupBy("key", "run").agg(F.first("content").alias("content"), F.count(F.lit(1)).alias("n"), F.first("again").alias("again"))

    distinct = runs_of(pieces.join(large, "key", "left_anti"))
    distinct = distinct.repartition("key").sortWithinPartitions("key", "run")

    def judge(batches):
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > GROUP_BYTES and row[0] != held[-1][0]:
                    yield _judged(held, length)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield _judged(held, length)

    found = distinct.select("key", "run", "content", "n", "again").mapInArrow(judge, "run binary, hits array<struct<at: long, n: long>>")
    if not large.isEmpty():
        found = found.unionByName(_hits_by_digest(cut_lineage(runs_of(pieces.join(large, "key", "left_semi"))), length))
    found = cut_lineage(found)
    owners = pieces.select("tkey", "first", "run").distinct()
    hits = owners.join(found, "run").select("tkey", "first", F.explode("hits").alias("hit"))
    spans = hits.select("tkey", (F.col("first") + F.col("hit.at")).alias("a"), (F.col("first") + F.col("hit.at") + F.col("hit.n") - 1 + length).alias("b"))
    spans = spans.groupBy("tkey").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))
    return rows.join(spans, "tkey", "left").select("doc_id", "text", "spans")


def _pieces(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_())
    return pa.record_batch([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["tkey", "first", "strings", "key", "run", "content", "again"])


def _judged(held: list[tuple], length: int) -> pa.RecordBatch:
    """Whole groups of (key, run, content, count, whether a string may repeat inside), judged together: strings of
    different keys are never equal."""
    keys = np.array([x[0] for x in held])
    counts = np.array([x[3] for x in held])
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    alone = np.zeros(len(held), bool)
    sizes = np.diff(np.append(starts, len(held)))
    alone[starts[sizes == 1]] = True
    # one run that comes more than once: what repeats is all of it
    owner = np.flatnonzero(alone & (counts > 1))
    at, n = np.zeros(len(owner), np.int64), np.array([len(held[i][2]) - length + 1 for i in owner.tolist()], np.int64)
    # a run that may hold a string twice is judged like a group, as are the runs of keys with several
    rest = np.flatnonzero(~alone | ((counts == 1) & [x[4] for x in held]))
    if len(rest):
        hit, begins = _hit_places([held[i][2] for i in rest.tolist()], counts[rest], length)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).view(np.int8)))
        which = np.searchsorted(begins, edge[::2], "right") - 1
        owner = np.concatenate([owner, rest[which]])
        at, n = np.concatenate([at, edge[::2] - begins[which]]), np.concatenate([n, edge[1::2] - edge[::2]])
    order = np.argsort(owner, kind="stable")
    some, first = np.unique(owner[order], return_index=True)
    spans = pa.StructArray.from_arrays([pa.array(at[order], pa.int64()), pa.array(n[order], pa.int64())], fields=list(_HITS.value_type))
    hits = pa.ListArray.from_arrays(pa.array(np.append(first, len(owner)), pa.int32()), spans)
    return pa.record_batch([pa.array([held[i][1] for i in some.tolist()], pa.binary()), hits.cast(_HITS)], ["run", "hits"])


def merged_spans(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Sorted ranges with those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for s in spans or ():
        if out and s["a"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["b"]))
        else:
            out.append((s["a"], s["b"]))
    return out


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per input row: doc_id, n_bytes, n_removed, n_spans and the bytes that are left, as ``kept``."""

    def drop(batches):
        for batch in batches:
            texts, rows = batch.column(1), []
            spans = batch.column(2).to_pylist()
            for i, text in enumerate(texts.to_pylist()):
                ranges = merged_spans(spans[i])
                edges = [0, *(e for r in ranges for e in r), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if ranges else text
                rows.append((len(text), len(text) - len(kept), len(ranges), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.record_batch([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return repeats(docs, length, gram).mapInArrow(drop, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
