"""Packing token pieces into sequences: a configuration linear program over the length histogram.

A configuration is a multiset of lengths that fits a sequence. The histogram of lengths has at most CAPACITY
rows however many pieces there are, so the program is solved on the driver: multiplicative weights price the
lengths, an unbounded knapsack by dynamic programming finds the configuration of the highest price, and prices
of what it covers fall. Whole parts of the fractional solution are taken, the rest is filled by best fit,
again on the histogram. Pieces then take their places by their rank within their length.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import accumulate, chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import bytes_of, running, slices, small_batches
from heliograph.session import cut_lineage

CAPACITY = 4096
END_ID = 1
# Rounds of multiplicative weights, and how far a price falls when its length is covered once.
ROUNDS, FALL = 300, 3.0
# Words whose ids a worker remembers before it forgets the rare ones, and text bytes and new words it takes at a time.
MEMORY, TEXT_BYTES, NEW_WORDS = 200_000, 1 << 22, 4096

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(97, 123)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
# Letters that the normalizer lower-cases one by one: no marks to join, none of several letters in lower case.
_LETTERS = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
_LATIN = re.compile(f"[{_LETTERS}]+").fullmatch

_encoders: dict[str, _Encoder] = {}


class _Encoder:
    """A tokenizer of this process with the ids of the words it has met."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.spelt = {ord(c): "".join(x for x, _ in self._parts(c)) for c in _LETTERS if not ("a" <= c <= "z")}
        # a file of other rules, which part such words or spell them otherwise, goes all the way
        self.direct = self.tokenizer.truncation is None and all(
            self._parts(w) == [(w.translate(self.spelt), (0, len(w)))] for w in (_LETTERS, _LETTERS[::-1], _LETTERS[::7])
        )
        # letters of spellings go first, as they are spelt otherwise themselves
        of_others = {*"".join(self.spelt.values())} & {*map(chr, self.spelt)}
        self.direct = self.direct and len(of_others) < 2
        self.letters = sorted(map(chr, self.spelt), key=lambda c: c not in of_others)
        self.known: dict[str, int] = {}
        self.again = np.zeros(0, bool)
        self.ids, self.ends = array("I"), array("q", [0])

    def _parts(self, text: str) -> list[tuple[str, tuple[int, int]]]:
        """What the model gets of a text, with the place of each part."""
        rules = self.tokenizer
        return rules.pre_tokenizer.pre_tokenize_str(rules.normalizer.normalize_str(text) if rules.normalizer else text) if rules.pre_tokenizer else []

    def forget(self) -> None:
        """Keeps the words met again since the last time, at most half of MEMORY; most words come once."""
        ids, ends = np.array(self.ids, np.uint32), np.array(self.ends)
        kept = np.flatnonzero(self.again)[: MEMORY // 2]
        words = list(self.known)
        size = np.diff(ends)[kept]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = ids[np.arange(total[-1]) + np.repeat(ends[kept] - total[:-1], size)]
        self.known = {words[at]: i for i, at in enumerate(kept.tolist())}
        self.again = np.zeros(len(kept), bool)
        self.ids, self.ends = array("I", ids.tobytes()), array("q", total.astype(np.int64).tobytes())

    def places(self, words: list[str]) -> np.ndarray:
        """The number of each word among the known ones, new words included."""
        if len(self.known) > MEMORY:
            self.forget()
        known, ids, ends = self.known, self.ids, self.ends
        new = [w for w in words if w not in known]
        before = len(known)
        for i in range(0, len(new), NEW_WORDS):
            some = new[i : i + NEW_WORDS]
            own = self.encoded(some)
            known.update(zip(some, range(len(known), len(known) + len(some))))
            ends.extend(accumulate(map(len, own[1:]), initial=len(ids) + len(own[0])))
            ids.extend(chain.from_iterable(own))
        at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        self.again = np.concatenate([self.again, np.zeros(len(known) - before, bool)])
        self.again[at[at < before]] = True
        return at

    def encoded(self, words: list[str]) -> list[list[int]]:
        """The ids of each of the words. A word of Latin letters alone is one piece to the pre-tokenizer, spelt letter by
        letter, so the model of the tokenizer takes it directly; other words go all the way."""
        latin = [self.direct and _LATIN(w) is not None for w in words]
        spelt = " ".join(compress(words, latin))
        for c in self.letters:
            spelt = spelt.replace(c, self.spelt[ord(c)])
        spelt, tokenize = iter(spelt.split(" ")), self.model.tokenize
        own = [[t.id for t in tokenize(next(spelt))] if direct else None for direct in latin]
        other = [i for i, direct in enumerate(latin) if not direct]
        for i, e in zip(other, self.tokenizer.encode_batch_fast([words[i] for i in other], add_special_tokens=False), strict=True):
            own[i] = e.ids
        return own


def _plain_words(texts: pa.Array) -> pa.Array:
    """``texts`` with the same ids and fewer distinct words: ASCII letters in lower case, as the tokenizer makes them,
    and a space before an ASCII sign after a letter or digit, where it always cuts. A text that may spell a special
    token, which is found before lower-casing, is left alone."""
    data, at = bytes_of(texts)
    special = (data[:-1] == 60) & (data[1:] == 124) if len(data) else np.empty(0, bool)
    if special.any():
        return texts
    low = _LOWER[data]
    cut = np.zeros(len(low), bool)
    if len(low) > 2:
        before, lead = low[1:-1], low[:-2]
        # U+00C0 to U+024F are letters but for two signs, and one whose lower case has a mark of its own
        latin = (before >= 128) & (before < 192) & (lead >= 195) & (lead <= 201)
        latin &= ~((lead == 195) & ((before == 151) | (before == 183))) & ~((lead == 196) & (before == 176))
        cut[2:] = _SIGN[low[2:]] & (_ALNUM[before] | latin)
        cut[at[at < len(low)]] = False
    spots = np.flatnonzero(cut)
    moved = at + np.searchsorted(spots, at)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(moved.astype(np.int64)), pa.py_buffer(np.insert(low, spots, 32)))


def encoded(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, start of each text in them).

    The tokenizer drops white space and never joins letters across it, so words between ASCII white space
    are encoded apart and once each.
    """
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    encoder = _encoders[path]
    words = pc.ascii_split_whitespace(_plain_words(texts))
    flat = words.flatten().dictionary_encode()
    place = encoder.places(flat.dictionary.to_numpy(zero_copy_only=False).tolist())
    pool, ends = np.frombuffer(encoder.ids, np.uint32), np.frombuffer(encoder.ends, np.int64)
    at = place[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.empty(0, np.int64)
    each = np.diff(ends).astype(np.int32)[at]
    total = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
    take = np.repeat(ends[at] - total[:-1], each)
    take += np.arange(total[-1])
    bounds = np.asarray(words.offsets) - words.offsets[0].as_py()
    ids = pool[take]
    del pool, ends
    return ids, total[bounds]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids) per piece: the ids of a text and END_ID, cut every ``capacity`` ids.

    ids are little-endian unsigned 32-bit numbers. A null or empty text is END_ID alone; repeated rows and null
    doc_ids are pieces like others. Other columns are not read.
    """

    def cut(batches):
        try:
            for batch in batches:
                doc_ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
                none = np.asarray(batch.column(0).is_null())
                for a, b in slices(texts, TEXT_BYTES):
                    ids, starts = encoded(texts[a:b], path)
                    out = []
                    for i in range(b - a):
                        one = np.append(ids[starts[i] : starts[i + 1]], np.uint32(END_ID))
                        out += [(a + i, p, p * capacity, one[p * capacity : (p + 1) * capacity]) for p in range(-(-len(one) // capacity))]
                    row = np.array([x[0] for x in out])
                    yield pa.record_batch(
                        [
                            pa.array(np.where(none[row], 0, doc_ids[row]).astype(np.int64), mask=none[row]),
                            pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int64()),
                            pa.array([len(x[3]) for x in out], pa.int64()), pa.array([x[3].astype("<u4").tobytes() for x in out], pa.binary()),
                        ],
                        ["doc_id", "piece", "start", "length", "ids"],
                    )
        finally:  # the process stays for other tasks: those of this stage meet many words again, others need its memory
            for encoder in _encoders.values():
                encoder.forget()
            pa.default_memory_pool().release_unused()

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


def _knapsack(price: np.ndarray, lengths: np.ndarray, capacity: int) -> dict[int, int]:
    """Counts by length of the dearest configuration; a length may be used many times."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    fit = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if fit[room]:
            value = price[: fit[room]] + best[room - lengths[: fit[room]]]
            i = int(value.argmax())
            if value[i] > best[room]:
                best[room], pick[room] = value[i], i
    found, room = {}, capacity
    while room > 0:
        if pick[room] < 0:
            room -= 1
            continue
        length = int(lengths[pick[room]])
        found[length] = found.get(length, 0) + 1
        room -= length
    return found


def configurations(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """(configuration, times) that hold exactly the pieces of ``histogram``."""
    left = {n: c for n, c in histogram.items() if c}
    plan: list[tuple[dict[int, int], int]] = []
    for n in [n for n in left if 2 * n > capacity and n + min(left) > capacity]:  # nothing fits beside these
        plan.append(({n: 1}, left.pop(n)))
    if not left:
        return plan
    lengths = np.array(sorted(left))
    stock = np.array([left[int(n)] for n in lengths], float)
    # the linear program: cover every length; x counts how often a configuration is used
    price, covered = lengths / capacity, np.zeros(len(lengths))
    used: dict[tuple, float] = {}
    for _ in range(rounds if len(lengths) > 1 else 1):
        if (covered >= 1).all():
            break
        chosen = _knapsack(np.where(covered < 1, price, 0.0), lengths, capacity)
        at = np.searchsorted(lengths, list(chosen))
        share = np.array(list(chosen.values())) / stock[at]
        times = min(1.0, float((1 - covered[at]).max())) / share.max()
        key = tuple(sorted(chosen.items()))
        used[key] = used.get(key, 0.0) + times
        covered[at] += times * share
        price[at] *= np.exp(-FALL * times * share / rounds**0.5)
    for key, times in sorted(used.items(), key=lambda x: (-x[1], x[0])):
        whole = min(int(times), *(left[n] // c for n, c in key))
        if whole > 0:
            plan.append((dict(key), whole))
            for n, c in key:
                left[n] -= c * whole
    return plan + best_fit({n: c for n, c in left.items() if c}, capacity)


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Configurations that use up ``left``: each starts with the largest length and fills its gap as far as any
    choice of the rest can, taken as often as the stock allows."""
    plan = []
    while left:
        first = max(left)
        chosen = {first: 1}
        room = capacity - first
        stock = dict(left)
        stock[first] -= 1
        # sums that can be reached by stages of lengths, largest first, as bits of one number
        stages, reach, mask = [], 1, (1 << (room + 1)) - 1
        for n in sorted((n for n, c in stock.items() if c and n <= room), reverse=True):
            before, count, step = reach, min(stock[n], room // n), 1
            while count > 0:
                use = min(step, count)
                reach |= reach << (n * use)
                count -= use
                step *= 2
            reach &= mask
            stages.append((n, before))
            if reach >> room & 1:
                break
        gap = reach.bit_length() - 1
        for n, before in reversed(stages):
            while not before >> gap & 1:
                chosen[n] = chosen.get(n, 0) + 1
                gap -= n
        times = min(left[n] // c for n, c in chosen.items())
        plan.append((chosen, times))
        for n, c in chosen.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
    return plan


def _places(plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Sorted runs of ranks of each length with where they go: at most one row per configuration and length."""
    rows, taken, sequence = [], {}, 0
    for chosen, times in plan:
        offset = 0
        for n in sorted(chosen, reverse=True):
            rows.append((n, taken.get(n, 0), chosen[n], sequence, offset))
            taken[n] = taken.get(n, 0) + chosen[n] * times
            offset += n * chosen[n]
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return {"length": table[:, 0], "rank": table[:, 1], "copies": table[:, 2], "sequence": table[:, 3], "offset": table[:, 4]}


def packed(parts: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``parts`` with sequence_id and offset. ``parts`` is stored, has ``length`` from 1 to ``capacity`` and is told
    apart by ``order``; an empty frame stays empty."""
    counted = parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    table = _places(configurations({int(r.length): int(r.n) for r in counted}, capacity))
    key = table["length"] * (1 << 44) + table["rank"]
    ranked = running(parts, ["length"], order, "_rank")
    fields = [*parts.columns]

    def place(batches):
        for batch in batches:
            length = batch.column(fields.index("length")).to_numpy()
            rank = batch.column(len(fields)).to_numpy()
            at = np.searchsorted(key, length * (1 << 44) + rank, "right") - 1
            inner = rank - table["rank"][at]
            sequence = table["sequence"][at] + inner // table["copies"][at]
            offset = table["offset"][at] + inner % table["copies"][at] * length
            yield pa.record_batch([*batch.columns[:-1], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*fields, "sequence_id", "offset"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in parts.dtypes)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """(pieces with their ids, placement of each piece) of all ``docs``; the placement has a digest of the ids."""
    cut = cut_lineage(pieces(docs, path, capacity))
    light = cut_lineage(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return cut, packed(light, ["doc_id", "piece", "ids_crc32"], capacity)


def sequences(parts: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of each sequence in one binary, at most CAPACITY ids each."""
    keys = ["doc_id", "piece", "ids_crc32"]
    texts = parts.withColumn("ids_crc32", F.crc32("ids")).dropDuplicates(keys)
    same = [placed[k].eqNullSafe(texts[k]) for k in keys]
    rows = placed.join(texts, same).select("sequence_id", "offset", "ids")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("h")))), lambda x: x["h"]), "")
    return rows.groupBy("sequence_id").agg(F.unhex(joined).alias("ids"))
