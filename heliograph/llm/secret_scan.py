"""Secret scans: fixed patterns, and a randomness test battery for tokens that no pattern names.

A token is a run of 16 or more characters of base64 in either alphabet, and each part of it between ``+/_-``. Its
encoding is the smallest alphabet that holds it. Three tests ask whether it could be drawn evenly from that alphabet:
chi-squared uniformity (by exact moments, so short tokens are fair), the number of runs of character classes, and the
serial correlation of neighbouring codes. Their squared normal scores add up to the token's statistic t; a token with
t above ACCEPT is not random.

What else looks as random is learned from the whole corpus: the text outside tokens, without its spaces, is cut into
windows of every length class, read in every alphabet, and scored alike. The share of such ordinary windows with a t
as small is the token's p-value in its stratum (encoding and length class), and within each stratum the tokens that the
Benjamini-Hochberg rule admits at a false-discovery rate of FDR are secrets. Short tokens, which ordinary text can
imitate, thus need more than long ones. Only counts of (encoding, length class, t class) pass through the driver.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import bytes_of, slices, small_batches
from heliograph.session import cut_lineage

# Fixed values of the base patterns; the order of the kinds is that of equal starts.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
# Both kinds lie within one token; a match that is too short never hides a longer one, so the length goes into the pattern.
ACCESS, HEX = re.compile(rb"AKIA[A-Z0-9]{16,}"), re.compile(rb"[0-9a-f]{24,}")

LENGTHS = (16, 20, 24, 32, 40, 48, 64, 96, 128)
# Upper 0.001 quantile of chi-squared with three degrees of freedom.
ACCEPT = 16.266
FDR = 0.05
# Classes of t: steps of 1/STEPS up to the last, open one.
STEPS, CLASSES = 4, 128
SLICE = 1 << 22

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class _Encoding:
    """An alphabet with its codes by byte; ``folded`` takes letters of the other case as well."""

    def __init__(self, name: str, alphabet: str) -> None:
        self.name, self.size = name, len(alphabet)
        self.codes = np.full(256, -1, np.int16)
        for i, letter in enumerate(sorted(alphabet)):
            self.codes[ord(letter)] = i
        self.folded = self.codes.copy()
        for i in range(26):
            low, up = ord(_LOWER[i]), ord(_UPPER[i])
            self.folded[low] = self.codes[low] if self.codes[low] >= 0 else self.codes[up]
            self.folded[up] = self.codes[up] if self.codes[up] >= 0 else self.codes[low]
        kind = {c: k for k, letters in enumerate((_DIGITS, _UPPER, _LOWER)) for c in letters}
        self.kinds = np.array([kind.get(c, 3) for c in sorted(alphabet)], np.int8)
        share = np.bincount(self.kinds, minlength=4) / self.size
        two, three = float((share**2).sum()), float((share**3).sum())
        self.change = 1 - two
        self.varies = self.change * (1 - self.change)
        self.linked = 1 - 2 * two + three - self.change**2  # covariance of neighbouring changes


ENCODINGS = (
    _Encoding("hex", _DIGITS + "abcdef"), _Encoding("HEX", _DIGITS + "ABCDEF"), _Encoding("base32", _UPPER + "234567"),
    _Encoding("base36", _LOWER + _DIGITS), _Encoding("BASE36", _UPPER + _DIGITS), _Encoding("base62", _UPPER + _LOWER + _DIGITS),
    _Encoding("base64", _UPPER + _LOWER + _DIGITS + "+/"), _Encoding("base64url", _UPPER + _LOWER + _DIGITS + "-_"),
)
_TOKEN = np.zeros(256, bool)
_TOKEN[[ord(c) for c in _UPPER + _LOWER + _DIGITS + "+/_-"]] = True
_PART = re.compile(rb"[A-Za-z0-9]{16,}")


def battery(codes: np.ndarray, encoding: _Encoding) -> np.ndarray:
    """t of each row of codes (windows x length): squared scores of uniformity (excess only), runs and serial correlation."""
    m, length = codes.shape
    k = encoding.size
    counts = np.bincount((np.arange(m)[:, None] * k + codes).ravel(), minlength=m * k).reshape(m, k)
    chi = (counts.astype(np.float64) ** 2).sum(axis=1) * (k / length) - length
    # scaled to a chi-squared of the same mean and variance, then the cube root is near normal
    freedom = (k - 1) / (1 - 1 / length)
    uniform = ((np.maximum(chi, 0) / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * freedom))) / np.sqrt(2 / (9 * freedom))
    kinds = encoding.kinds[codes]
    changes = (kinds[:, 1:] != kinds[:, :-1]).sum(axis=1)
    spread = (length - 1) * encoding.varies + 2 * (length - 2) * encoding.linked
    runs = (changes - (length - 1) * encoding.change) / np.sqrt(spread)
    centred = codes - (k - 1) / 2
    serial = (centred[:, 1:] * centred[:, :-1]).sum(axis=1) / ((k * k - 1) / 12) / np.sqrt(length - 1)
    return np.maximum(uniform, 0) ** 2 + runs**2 + serial**2


def t_class(t: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(t * STEPS), CLASSES - 1).astype(np.int64)


def length_class(length: int) -> int:
    return int(np.searchsorted(LENGTHS, length, "right")) - 1


def inferred(token: bytes) -> int | None:
    """The number of the smallest alphabet that holds the token; none for digits alone or both alphabets of base64."""
    raw = np.frombuffer(token, np.uint8)
    if ((raw >= 48) & (raw <= 57)).all():
        return None
    return next((i for i, e in enumerate(ENCODINGS) if (e.codes[raw] >= 0).all()), None)


class _Ordinary:
    """Counts of t by stratum over windows of ordinary text; what is left of a stream waits for the next slice."""

    def __init__(self) -> None:
        self.counts = np.zeros((len(ENCODINGS), len(LENGTHS), CLASSES), np.int64)
        self.rest = [np.empty(0, np.int16) for _ in ENCODINGS]

    def add(self, data: np.ndarray) -> None:
        whole = sum(LENGTHS)
        for e, encoding in enumerate(ENCODINGS):
            codes = encoding.folded[data]
            stream = np.concatenate([self.rest[e], codes[codes >= 0]])
            full = len(stream) // whole
            rounds, self.rest[e] = stream[: full * whole].reshape(full, whole), stream[full * whole :]
            self._cut(e, rounds)

    def _cut(self, e: int, rounds: np.ndarray) -> None:
        start = 0
        for b, length in enumerate(LENGTHS):
            if len(rounds) and start + length <= rounds.shape[1]:
                t = battery(rounds[:, start : start + length], ENCODINGS[e])
                self.counts[e, b] += np.bincount(t_class(t), minlength=CLASSES)
            start += length

    def finish(self) -> np.ndarray:
        """The last, short round of each stream gives its windows up to the last that is full."""
        for e, rest in enumerate(self.rest):
            self._cut(e, rest[None, :])
        return self.counts


def _runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the runs of token characters of LENGTHS[0] or more; no run crosses a text's edge."""
    inside = _TOKEN[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    long = end - start >= LENGTHS[0]
    return start[long], end[long]


def _patterns(raw: bytes, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the base patterns of one text."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    for kind, pattern in ((1, ACCESS), (2, HEX)):
        found += [(a + m.start(), kind, a + m.end()) for a, b in tokens for m in pattern.finditer(raw[a:b])]
    return found


def _candidates(raw: bytes, a: int, b: int):
    """(start, end, encoding, length class, t) of a token and of its parts."""
    token = raw[a:b]
    spans = {(0, b - a)} | {m.span() for m in _PART.finditer(token)}
    for i, j in sorted(spans):
        e = inferred(token[i:j])
        if e is None:
            continue
        codes = ENCODINGS[e].codes[np.frombuffer(token[i:j], np.uint8)][None, :]
        yield a + i, a + j, e, length_class(j - i), float(battery(codes, ENCODINGS[e])[0])


_SPAN = "array<struct<start:int,kind:int,stop:int>>"
_TRIED = "array<struct<start:int,stop:int,stratum:int,t:double>>"


def _scan(batches):
    """Rows (row, base, tried, stratum, t_class, n): one per text in order, then the task's counts of ordinary windows."""
    ordinary = _Ordinary()
    span, tried_type = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())]), pa.struct(
        [("start", pa.int32()), ("stop", pa.int32()), ("stratum", pa.int32()), ("t", pa.float64())])
    for batch in batches:
        texts = batch.column(1)
        for first, last in slices(texts, SLICE):
            part = texts.slice(first, last - first)
            data, at = bytes_of(part)
            start, end = _runs(data, at) if len(data) else (np.empty(0, np.int64), np.empty(0, np.int64))
            owner = np.searchsorted(at, start, "right") - 1
            by_text: dict[int, list[tuple[int, int]]] = {}
            for i, a, b in zip(owner.tolist(), start.tolist(), end.tolist(), strict=True):
                by_text.setdefault(i, []).append((a - int(at[i]), b - int(at[i])))
            base, tried = [], []
            for i in range(last - first):
                raw = data[at[i] : at[i + 1]].tobytes()
                tokens = by_text.get(i, [])
                spans = _patterns(raw, tokens)
                tests = [c for a, b in tokens for c in _candidates(raw, a, b)]
                if spans or tests:
                    points = np.zeros(len(raw) + 1, np.int64)
                    np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, out=points[1:])
                    base.append([{"start": int(points[a]), "kind": k, "stop": int(points[b])} for a, k, b in sorted(spans)])
                    tried.append([{"start": int(points[a]), "stop": int(points[b]), "stratum": e * len(LENGTHS) + c, "t": t} for a, b, e, c, t in tests])
                else:
                    base.append([])
                    tried.append([])
            if len(start):
                keep = np.ones(len(data) + 1, np.int64)
                keep[:] = 0
                np.add.at(keep, start, 1)
                np.add.at(keep, end, -1)
                ordinary.add(data[np.cumsum(keep)[:-1] == 0])
            else:
                ordinary.add(data)
            none = pa.nulls(last - first, pa.int32())
            yield pa.record_batch([batch.column(0).slice(first, last - first), pa.array(base, pa.list_(span)), pa.array(tried, pa.list_(tried_type)),
                                   none, none, pa.nulls(last - first, pa.int64())], ["doc_id", "base", "tried", "stratum", "t_class", "n"])
    counts = ordinary.finish().reshape(-1, CLASSES)
    stratum, t = np.nonzero(counts)
    if len(stratum):
        m = len(stratum)
        yield pa.record_batch([pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(span)), pa.nulls(m, pa.list_(tried_type)), pa.array(stratum.astype(np.int32)),
                               pa.array(t.astype(np.int32)), pa.array(counts[stratum, t])], ["doc_id", "base", "tried", "stratum", "t_class", "n"])


def cutoffs(ordinary: np.ndarray, tokens: np.ndarray, rate: float = FDR) -> np.ndarray:
    """The greatest admitted t class of each stratum (-1: none): the last class c where the number of tokens expected
    by chance, all tokens times the p-value of c, is at most ``rate`` of the tokens up to c."""
    p = (1 + ordinary.cumsum(axis=1)) / (1 + ordinary.sum(axis=1, keepdims=True))
    upto = tokens.cumsum(axis=1)
    good = (p * tokens.sum(axis=1, keepdims=True) <= rate * upto) & (upto > 0)
    return np.where(good.any(axis=1), CLASSES - 1 - good[:, ::-1].argmax(axis=1), -1)


def _table(counted: DataFrame) -> np.ndarray:
    out = np.zeros((len(ENCODINGS) * len(LENGTHS), CLASSES), np.int64)
    for row in counted.collect():  # at most one row per cell
        out[row.stratum, row.t_class] = row.n
    return out


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = FDR) -> DataFrame:
    """Per input row: doc_id and spans, array<struct<start, kind, stop>> in code points (stop exclusive), in the order
    of start and then of KINDS, kind as its number there.

    A null or empty text has no spans. Repeated rows and null ids stay rows. A random span inside a base span or inside
    another random span is left out, all base spans stay. Other columns are not read; an empty table gives no rows.
    """
    source = small_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    rows = cut_lineage(source.mapInArrow(_scan, f"doc_id long, base {_SPAN}, tried {_TRIED}, stratum int, t_class int, n long"))
    windows = _table(rows.where("n is not null").groupBy("stratum", "t_class").agg(F.sum("n").alias("n")))
    texts = rows.where("n is null")
    tests = texts.select(F.explode("tried").alias("c")).select("c.stratum", F.least(F.ceil(F.col("c.t") * STEPS), F.lit(CLASSES - 1)).cast("int").alias("t_class"))
    admitted = cutoffs(windows, _table(tests.groupBy("stratum", "t_class").agg(F.count(F.lit(1)).alias("n"))), rate)
    limit = F.array(*[F.lit(min(float(c) / STEPS, ACCEPT) if c < CLASSES - 1 else ACCEPT) for c in admitted])
    random = F.filter("tried", lambda c: c["t"] <= F.get(limit, c["stratum"]))
    random = F.transform(random, lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), c["stop"].alias("stop")))

    def outer(c: Column, others: Column) -> Column:
        wider = lambda o: (o["start"] <= c["start"]) & (o["stop"] >= c["stop"]) & (
            (o["kind"] != c["kind"]) | (o["stop"] - o["start"] > c["stop"] - c["start"]))
        return ~F.exists(others, wider)

    both = texts.select("doc_id", "base", random.alias("random"))
    kept = F.filter("random", lambda c: outer(c, F.concat("base", "random")))
    return both.select("doc_id", F.array_sort(F.concat("base", kept)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan_digest(docs: DataFrame) -> DataFrame:
    """Per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans (joined), n_random."""
    found = secret_spans(docs)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] < KINDS.index("random"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"), count("random"))
