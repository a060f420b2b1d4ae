"""Toxicity by a learned lexicon: a Levenshtein automaton over its trie, and context windows.

Training learns from a bounded sample of labelled rows: whole terms and word families (a stem with many
endings) that mark toxic texts, words near a term that clean texts use, and a calibration of the
evidence. Scoring walks each distinct word through the deterministic product of the lexicon trie and a
Levenshtein automaton, so that misspelled terms are met, and weighs each hit by its window: in a quotation
or after a word of reporting it counts little, beside an address in the second person more.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import small_batches
from heliograph.session import cut_lineage

# Bound of the training sample, in labelled rows, taken by hash.
TRAIN_ROWS = 20_000
# A term marks toxic texts if this share of them (and three) has it, and its odds are so many times those of clean texts;
# for a family, texts count that have two or more of its words.
SUPPORT, ODDS = 0.02, 20.0
# Least log-likelihood ratio of a term: of many thousand words that mean nothing, few reach it.
GAIN = 16.0
# At most so many candidates are looked at, and so many near words of clean texts are kept.
CANDIDATES, NEAR_WORDS = 4_000, 20_000
STEMS = (3, 4, 5, 6, 7, 8)
THRESHOLD = 0.3
WINDOW = 8
# Factor of a hit that is misspelled, quoted or reported, or beside a direct address.
NEAR, QUOTED, ADDRESSED = 0.7, 0.25, 1.25
# Distinct words a worker remembers.
MEMORY = 150_000

# Fixed values.
REPORTING = frozenset("said says wrote writes quoted quote called calls term word slur reported dit écrit sagte schrieb dijo escribió".split())
ADDRESS = frozenset("you your yours u tu toi vous ton votre du dich dir dein deine sie tú usted vosotros te".split())

_WORD = re.compile(r"[\w@$*]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def edits_for(term: str) -> int:
    """Edits allowed in a term: none under 5 letters, one under 9, else two."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """Deterministic product of a lexicon trie and a Levenshtein automaton, made state by state as words need it.

    A state is the set of (trie node, edits so far) that some spelling of the read letters can be at. A family
    accepts any ending once its stem is read without an edit.
    """

    def __init__(self, terms: dict[str, float], families: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.term: dict[int, tuple[float, int]] = {}
        self.stem: dict[int, float] = {}
        self.room = [0]  # most edits a term below the node allows
        for kind, lexicon in (("term", terms), ("stem", families)):
            for word, weight in lexicon.items():
                node, allowed = 0, edits_for(word) if kind == "term" else 0
                self.room[0] = max(self.room[0], allowed)
                for ch in word:
                    if ch not in self.children[node]:
                        self.children[node][ch] = len(self.children)
                        self.children.append({})
                        self.room.append(0)
                    node = self.children[node][ch]
                    self.room[node] = max(self.room[node], allowed)
                if kind == "term":
                    self.term[node] = (weight, allowed)
                else:
                    self.stem[node] = weight
        self.letters = {ch for c in self.children for ch in c}
        self.states: list[tuple[tuple[int, int], ...]] = []
        self.known: dict[tuple, int] = {}
        self.moves: list[dict[str, int]] = []
        self.start = self._state({(0, 0)})

    def _state(self, reached: set[tuple[int, int]]) -> int:
        least: dict[int, int] = {}
        todo = list(reached)
        while todo:  # letters of the term that the word leaves out
            node, e = todo.pop()
            if e > self.room[node] and e or least.get(node, 9) <= e:
                continue
            least[node] = e
            todo += [(child, e + 1) for child in self.children[node].values()]
        key = tuple(sorted(least.items()))
        if key not in self.known:
            self.known[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        return self.known[key]

    def _move(self, state: int, ch: str) -> int:
        reached = set()
        for node, e in self.states[state]:
            for letter, child in self.children[node].items():
                reached.add((child, e if letter == ch else e + 1))
            reached.add((node, e + 1))
        return self._state(reached)

    def match(self, word: str) -> tuple[float, int, bool] | None:
        """(weight, edits, whether a family) of the best term or family, or None."""
        state, stems = self.start, 0.0
        for ch in word:
            key = ch if ch in self.letters else ""
            moves = self.moves[state]
            state = moves[key] if key in moves else moves.setdefault(key, self._move(state, key))
            reached = self.states[state]
            if not reached:
                break
            if self.stem:
                for node, e in reached:
                    if not e and node in self.stem:
                        stems = max(stems, self.stem[node])
        best = (stems, 0, True) if stems else None
        for node, e in self.states[state]:
            weight, allowed = self.term.get(node, (0.0, -1))
            if e <= allowed and (best is None or (-e, weight) > (-best[1], best[0])):
                best = (weight, e, False)
        return best


class Model:
    """A lexicon with its calibration; small, and sent to every task."""

    def __init__(self, terms: dict[str, float], families: dict[str, float]):
        self.terms, self.families = terms, families
        self.clean: frozenset[str] = frozenset()
        self.curve = np.array([1.0, 1.0, 1.0, -4.0])
        self._automaton = None
        self._memory: dict[str, tuple[float, int, bool] | None] = {}

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None, "_memory": {}}

    def hit(self, word: str) -> tuple[float, int, bool] | None:
        memory = self._memory
        if word in memory:
            return memory[word]
        if self._automaton is None:
            self._automaton = Automaton(self.terms, self.families)
        if len(memory) >= MEMORY:
            memory.clear()
        found = self._automaton.match(word)
        if found and found[1] and word in self.clean:
            found = None
        memory[word] = found
        return found

    def evidence(self, text: str | None) -> tuple[float, float, float]:
        """Weights of the hits on terms and on families, each by its context window, and those on families per 100 words."""
        if not text or not (self.terms or self.families):
            return 0.0, 0.0, 0.0
        low = text.lower()
        hits = {w: h for w in set(_WORD.findall(low)) if (h := self.hit(w))}
        if not hits:
            return 0.0, 0.0, 0.0
        spans = [(m.start(), m.group()) for m in _WORD.finditer(low)]
        marks = quoted_spans(low)
        terms = families = 0.0
        for i, (at, word) in enumerate(spans):
            if word not in hits:
                continue
            weight, edits, family = hits[word]
            before = [w for _, w in spans[max(0, i - WINDOW) : i]]
            after = [w for _, w in spans[i + 1 : i + 1 + WINDOW]]
            factor = NEAR if edits else 1.0
            if inside(marks, at) or REPORTING.intersection(before):
                factor *= QUOTED
            elif ADDRESS.intersection(before) or ADDRESS.intersection(after):
                factor *= ADDRESSED
            if family:
                families += weight * factor
            else:
                terms += weight * factor
        return terms, families, 100 * families / len(spans)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        """Scores from rows of evidence."""
        return 1.0 / (1.0 + np.exp(-(np.log1p(evidence.reshape(-1, 3)) @ self.curve[:3] + self.curve[3])))


def quoted_spans(text: str) -> np.ndarray:
    """Start and end of each quotation of up to 400 letters within a line."""
    found = [(m.start(), m.end()) for m in re.finditer(r'"[^"\n]{1,400}"|“[^”\n]{1,400}”|«[^»\n]{1,400}»|„[^“”\n]{1,400}[“”]', text)]
    return np.array(found, np.int64).reshape(-1, 2)


def inside(spans: np.ndarray, at: int) -> bool:
    i = int(np.searchsorted(spans[:, 0], at, "right")) - 1
    return i >= 0 and at < spans[i, 1]


def held_out(doc_id: Column) -> Column:
    """The rows that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of at most TRAIN_ROWS labelled rows outside the held-out part; near copies, known by the
    three smallest hashes of their words, count once."""
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(TRAIN_ROWS)
    texts = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def keyed(batches):
        for batch in batches:
            keys = []
            for text in batch.column(0).to_pylist():
                found = pd.util.hash_array(np.array(sorted(set(words_of(text))), dtype=object)) if text.strip() else np.empty(0, np.uint64)
                keys.append(np.sort(found)[:3].tobytes())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(keys, pa.binary())], ["text", "toxic", "alike"])

    rows = texts.select("text", "toxic").mapInArrow(keyed, "text string, toxic int, alike binary")
    best = rows.groupBy("toxic", "alike").agg(F.min(F.md5("text")).alias("one"))
    return cut_lineage(rows.withColumn("one", F.md5("text")).join(best, ["toxic", "alike", "one"]).dropDuplicates(["toxic", "alike"]).select("text", "toxic"))


def _counted(batches):
    """Texts of either label that have a word, or two words with a stem, per batch."""
    for batch in batches:
        seen: Counter = Counter()
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = words_of(text)
            stems = Counter(w[:k] for w in words for k in STEMS if len(w) > k)
            seen.update(("=" + w, toxic) for w in set(words))
            seen.update(("*" + s, toxic) for s, n in stems.items() if n > 1)
        items = list(seen.items())
        yield pa.record_batch(
            [pa.array([x[0][0] for x in items], pa.string()), pa.array([x[1] if x[0][1] else 0 for x in items], pa.int64()), pa.array([0 if x[0][1] else x[1] for x in items], pa.int64())],
            ["term", "bad", "good"],
        )


def _lexicon(found: list, bad: int, good: int) -> tuple[dict[str, float], dict[str, float]]:
    """Terms and families with their log odds from (term, bad, good) rows."""
    weight = {r.term: math.log((r.bad + 0.5) / (bad + 1)) - math.log((r.good + 0.5) / (good + 1)) for r in found}
    words = {r.term[1:]: r.bad for r in found if r.term[0] == "="}
    stems = {r.term[1:]: r.bad for r in found if r.term[0] == "*"}
    families: dict[str, float] = {}
    for stem in sorted(stems, key=lambda s: (-stems[s] * weight["*" + s], -len(s), s)):
        one = max((n for w, n in words.items() if w.startswith(stem)), default=0)
        if one < 0.6 * stems[stem] and not any(stem.startswith(f) or f.startswith(stem) for f in families):
            families[stem] = weight["*" + stem]
    terms = {w: weight["=" + w] for w in words if not any(w.startswith(f) for f in families)}
    return terms, families


def _gain(bad: int, good: int) -> Column:
    """Log-likelihood ratio of the columns bad and good against one common rate."""
    parts = F.lit(0.0)
    share = (F.col("bad") + F.col("good")) / (bad + good)
    for seen, of in ((F.col("bad"), bad), (F.col("good"), good)):
        for n, expected in ((seen, share * of), (of - seen, (1 - share) * of)):
            parts = parts + F.when(n > 0, n * F.ln(n / F.greatest(expected, F.lit(1e-9)))).otherwise(0.0)
    return 2 * parts


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns a model. Without labels of both kinds the lexicon is empty and every score is low."""
    sample = _sample(docs, labels)
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return Model({}, {})
    counts = sample.mapInArrow(_counted, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = (F.col("bad") + 0.5) / (bad + 1) / ((F.col("good") + 0.5) / (good + 1))
    marked = counts.where((F.col("bad") >= max(3, SUPPORT * bad)) & (odds >= min(ODDS, (good + 1) / 4)) & (_gain(bad, good) >= GAIN))
    model = Model(*_lexicon(marked.orderBy(F.desc("bad"), "good", "term").limit(CANDIDATES).collect(), bad, good))

    def near(batches):
        for batch in batches:
            text = batch.column(0).filter(pc.equal(batch.column(1), 0)).to_pylist()
            found = {w for t in text for w in set(words_of(t)) if (h := model.hit(w)) and h[1]}
            yield pa.record_batch([pa.array(sorted(found), pa.string())], ["word"])

    words = sample.mapInArrow(near, "word string").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    clean = words.orderBy(F.desc("n"), "word").limit(NEAR_WORDS).collect()
    model = Model(model.terms, model.families)
    model.clean = frozenset(r.word for r in clean)

    def weighed(batches):
        for batch in batches:
            values = np.array([model.evidence(t) for t in batch.column(0).to_pylist()], float).reshape(-1, 3)
            yield pa.record_batch([*(pa.array(values[:, i]) for i in range(3)), batch.column(1)], ["t", "f", "d", "toxic"])

    pairs = sample.mapInArrow(weighed, "t double, f double, d double, toxic int").toArrow()
    model.curve = _calibrate(np.column_stack([pairs[c].to_numpy() for c in "tfd"]), pairs["toxic"].to_numpy())
    return model


def _calibrate(evidence: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Coefficients of a logistic curve over log(1 + evidence), by Newton steps with a weak prior."""
    order = np.lexsort((toxic, *evidence.T))
    x = np.column_stack([np.log1p(evidence[order]), np.ones(len(order))])
    y, b = toxic[order].astype(float), np.zeros(4)
    for _ in range(60):
        p = 1 / (1 + np.exp(-(x @ b)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(4), x.T @ (y - p) - 0.05 * b)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return np.append(np.maximum(b[:3], 0.0), b[3])


def scorer(model: Model):
    """The score of a text column, as an Arrow function."""

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([model.evidence(t) for t in text], float)))

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per input row: doc_id, held_out, score (0 to 1), predicted (1 from THRESHOLD on).

    A null or empty text has no evidence and gets the lowest score. Rows of ``labels`` with a null doc_id or another
    label than 0 and 1 are not learned from; of repeated labels the largest holds. Other columns are not read.
    """
    score = scorer(fit(small_batches(docs), labels))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score("text").alias("score"))
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def toxicity_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that score THRESHOLD or more; all columns are kept."""
    score = scorer(fit(small_batches(docs), labels))
    packed = docs.select(F.struct("*").alias("row"), score("text").alias("score"))
    return packed.where(F.col("score") < THRESHOLD).select("row.*")
