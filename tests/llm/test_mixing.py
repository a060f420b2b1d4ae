import re
from collections import Counter

import numpy as np
import pytest

from heliograph.llm.mixing import BLOCK_WORDS, cut_runs, draw_counts, mixed_counts, mixed_documents, permuted, targets


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_stop_at_twice_the_size():
    sizes = [100, 1000, 1000, 0]
    out = targets(sizes)
    assert sum(out) == pytest.approx(1.5 * sum(sizes))
    assert out[0] == 200 and all(t <= 2 * s for t, s in zip(out, sizes, strict=True))
    assert out[1] / out[2] == pytest.approx(2.0)


def test_permutation_and_draws():
    for n in (1, 2, 5, 64, 1000):
        index = np.arange(n)
        assert sorted(permuted(index, np.full(n, n), np.full(n, 7, np.uint64)).tolist()) == index.tolist()
    owed = np.array([700, 20, 0, 333])
    drawn = list(draw_counts(owed, 100, 3))
    assert (sum(c for _, c, _ in drawn) == owed).all() and all(c.sum() <= 100 for _, c, _ in drawn)
    assert [s for s, _, _ in drawn] == list(range(11)) and list(draw_counts(owed * 0, 100, 3)) == []
    for i in range(11):  # a part is found alone, with what lies before it
        (shard, counts, before), = draw_counts(owed, 100, 3, i, i + 1)
        assert shard == i and (counts == drawn[i][1]).all() and (before == sum((c for _, c, _ in drawn[:i]), owed * 0)).all()


def test_awkward_rows(docs, awkward):
    first, again = ([tuple(r) for r in mixed_counts(docs).collect()] for _ in range(2))
    assert Counter(first) == Counter(again)
    assert Counter((r[0], r[1]) for r in first) == Counter((i, size(t)) for i, t, _ in awkward)
    names = sorted({s for *_, s in awkward if s is not None}) + [None]
    sizes = [sum(size(t) for _, t, s in awkward if s == name) for name in names]
    aims = dict(zip(zip(sizes, targets(sizes), strict=True), names, strict=True))
    taken = Counter()
    for _, n, whole, aim, words in first:
        assert words <= 2 * n and (whole, aim) in aims
        taken[(whole, aim)] += words
    for key, words in taken.items():
        assert abs(words - key[1]) <= 2 * BLOCK_WORDS


def test_documents_of_the_mix(docs, awkward):
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    texts = [t or "" for _, t, _ in awkward]
    rows = mixed.collect()
    assert all(any(r.text in t for t in texts) and r.n_chars == len(r.text) for r in rows)
    assert Counter() + Counter({None: 0}) == Counter() and sum(size(r.text) for r in rows) == sum(r.taken for r in mixed_counts(docs).collect())


def test_runs_of_a_text():
    text = "  one two\tthree\n\nfour five  six "
    words = text.split()
    for runs in ([(0, 6)], [(5, 1)], [(1, 2), (1, 2), (0, 1)], [(3, 3), (0, 4), (2, 1)]):
        got = cut_runs(text, runs)
        assert [g.split() for g in got] == [words[f : f + n] for f, n in runs] and all(g in text for g in got)


def test_a_long_text_is_cut_whole(spark):
    """Every block of a long text that the mix takes comes back as text, and runs of neighbours stay together."""
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(0, long, "a", 7)] + [(i, f"x{i} y", "b", 3) for i in range(1, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    taken = {r.doc_id: r.taken for r in mixed_counts(docs).collect()}
    got = [r.text for r in mixed_documents(docs).where("doc_id = 0").collect()]
    assert sum(size(t) for t in got) == taken[0] and all(t in long for t in got)
    seen = Counter(w for t in got for w in t.split())
    assert max(seen.values()) <= 2
    neighbours = sum(int(a.split()[-1][1:]) + 1 == int(b.split()[0][1:]) for a in got for b in got)
    assert len(got) < 2 * 40_000 / BLOCK_WORDS and neighbours <= len(got)


def test_empty_table(no_docs):
    assert mixed_counts(no_docs).collect() == []
    assert mixed_documents(no_docs).collect() == []


def test_draws_and_places_do_not_run_python_in_one_stage(docs, capsys):
    from heliograph.llm.mixing import keyed, mix
    from heliograph.session import cut_lineage

    placements, _ = mix(cut_lineage(keyed(docs).select("rk", "doc_id", "source", "size")))
    capsys.readouterr()
    placements.explain("formatted")
    assert len(re.findall(r"(?m)^\(\d+\) MapInArrow", capsys.readouterr().out)) == 1
