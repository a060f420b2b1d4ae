import random
from collections import Counter

import numpy as np

from heliograph.llm import suffix_dedup
from heliograph.llm.suffix_dedup import repeated_strings, without_repeats
from tests.llm.conftest import make_docs, prose


def brute(texts, length):
    """(bytes, removed, spans, what is left) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, np.frombuffer(t, np.uint8)[~gone].tobytes()))
    return out


def compare(spark, rows, length, gram):
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in without_repeats(make_docs(spark, rows), length, gram).collect())
    assert got == Counter((r[0], *x) for r, x in zip(rows, brute([r[1] for r in rows], length), strict=True))


def test_intervals_against_counts():
    rng = random.Random(3)
    for _ in range(200):
        length = rng.choice([1, 2, 3, 5, 8])
        texts = list({bytes(rng.choice(b"ab") for _ in range(rng.randint(length, 30))) for _ in range(rng.randint(1, 6))})
        counts = np.array([rng.choice([1, 1, 2]) for _ in texts])
        seen = Counter()
        for t, n in zip(texts, counts.tolist(), strict=True):
            seen.update({t[i : i + length]: 0 for i in range(len(t) - length + 1)})
            for i in range(len(t) - length + 1):
                seen[t[i : i + length]] += n
        want = [[i for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1] for t in texts]
        assert [h.tolist() for h in repeated_strings(texts, counts, length)] == want


def test_awkward_rows(spark, awkward):
    compare(spark, awkward, 400, 32)


def test_passages_in_many_contexts(spark):
    rng = random.Random(9)
    passages = [prose(rng, 40, 100_000) for _ in range(3)]
    rows = []
    for i in range(120):
        text = prose(rng, rng.randrange(60), 100_000)
        if i % 3:
            p = passages[i % len(passages)]
            cut = rng.randrange(80)
            text += " " + p[cut:] + " " + prose(rng, rng.randrange(30), 100_000)
        if i % 7 == 0:
            text += " ha" * 90
        rows.append((i, text, "s"))
    compare(spark, rows, 100, 16)


def test_no_group_above_the_bound(spark, monkeypatch):
    """A passage of half of the texts, whose edges are distinct in each: its runs are not sorted together."""
    bound, judged = 20_000, suffix_dedup._judged

    def bounded(held, length):
        sizes = Counter()
        for row in held:
            sizes[row[0]] += len(row[2])
        assert max(sizes.values()) <= bound
        return judged(held, length)

    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", bound)
    monkeypatch.setattr(suffix_dedup, "_judged", bounded)
    rng = random.Random(13)
    for words in (12, 30):  # shorter and longer than the strings
        passage = prose(rng, words, 100_000)
        rows = [(i, prose(rng, 40, 100_000) + (f" {passage} " if i % 2 else " ") + prose(rng, 40, 100_000), "s") for i in range(600)]
        rows += [(900, rows[1][1], "s"), (901, "z" * 30_000, "s"), (902, "y" + "z" * 30_000, "s")]
        compare(spark, rows, 100, 16)


def test_empty_table(no_docs):
    assert without_repeats(no_docs).collect() == []


def test_a_run_alone_is_sorted_only_if_its_least_window_comes_twice_in_it(spark, monkeypatch):
    """A sentence that a text has twice, far apart, shares no string; the runs around it are not sorted."""
    rng = random.Random(17)
    rows = []
    for i in range(40):
        sentence = prose(rng, 12, 100_000)
        rows.append((i, " ".join([prose(rng, 60, 100_000), sentence, prose(rng, 200, 100_000), sentence, prose(rng, 60, 100_000)]), "s"))
    key_runs = suffix_dedup.key_runs
    data = [np.frombuffer(t.encode(), np.uint8) for _, t, _ in rows]
    assert not any(key_runs(d, 400, 32)[4].any() for d in data)
    phrase = prose(rng, 20, 100_000)
    for text in ("z" * 1200, phrase * 8, "ab" * 300, "x" * 150 + "ab" * 300 + "y" * 150, prose(rng, 90, 100_000) + (phrase + " ") * 9):
        raw = text.encode()
        starts, strings, _, _, again = key_runs(np.frombuffer(raw, np.uint8), 400, 32)
        for s, n, flag in zip(starts.tolist(), strings.tolist(), again.tolist(), strict=True):
            inside = Counter(raw[i : i + 400] for i in range(s, s + n))
            assert flag or max(inside.values()) == 1
        rows.append((len(rows), text, "s"))
    compare(spark, rows, 400, 32)


def test_equal_strings_of_many_lengths_and_symbols():
    """Common prefixes near the bound, at the ends of texts and over all byte values, nulls included."""
    rng = random.Random(19)
    for symbols, length in ((256, 40), (3, 40), (60, 7), (2, 100), (256, 1), (5, 13)):
        for _ in range(12):
            shared = [bytes(rng.randrange(symbols) for _ in range(length + d)) for d in (-1, 0, 1, 30)]
            texts = {b"".join(rng.choice(shared) if rng.random() < 0.5 else bytes(rng.randrange(symbols) for _ in range(rng.randint(0, 50))) for _ in range(rng.randint(1, 8))) for _ in range(9)}
            texts = sorted(texts, key=lambda t: rng.random())
            counts = np.array([rng.choice([1, 1, 3]) for _ in texts])
            seen = Counter()
            for t, n in zip(texts, counts.tolist(), strict=True):
                for i in range(len(t) - length + 1):
                    seen[t[i : i + length]] += n
            want = [[i for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1] for t in texts]
            assert [h.tolist() for h in repeated_strings(texts, counts, length)] == want
