import random
from collections import Counter

import pytest

from heliograph.llm.toxicity import Automaton, Model, edits_for, fit, held_out, toxicity_filter, toxicity_scores
from heliograph.tables import table
from tests.llm.conftest import make_docs, prose

SF = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int, text string, score double"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_distances():
    rng = random.Random(1)
    lexicon = {"abcab": 1.0, "abc": 2.0, "bacaba": 3.0, "aabbccabc": 4.0}
    automaton = Automaton(lexicon, {"cc": 9.0})
    for _ in range(3000):
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 11)))
        fits = [(d, -w) for t, w in lexicon.items() if (d := distance(word, t)) <= edits_for(t)]
        if word.startswith("cc"):
            fits.append((0, -9.0))
        want = (-min(fits)[1], min(fits)[0]) if fits else None
        got = automaton.match(word)
        assert (got and got[:2]) == want, word


def test_quotation_counts_less_than_abuse():
    model = Model({"scoundrel": 3.0}, {})
    plain = model.evidence("what a scoundrel")[0]
    assert model.evidence("you scoundrel")[0] > plain > model.evidence('the word "scoundrel" is old')[0] > 0
    assert 0 < model.evidence("what a scoundrl")[0] < plain
    assert model.evidence(None) == model.evidence("") == (0.0, 0.0, 0.0)


@pytest.fixture(scope="module")
def toy(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 60, 5000) + (" you dreadful rascal" if i % 5 == 0 else ""), "s") for i in range(300)]
    rows += [(1000, None, None), (1001, "", "s"), (None, "dreadful rascal you dreadful rascal", "s"), (0, rows[0][1], "s")]
    labels = [(i, 1, int(i % 5 == 0), "t", 0.5) for i in range(200)] + [(None, 1, 1, "t", 0.5), (1, None, None, "t", 0.5), (2, 1, 7, "t", 0.5)]
    return make_docs(spark, rows), spark.createDataFrame(labels, LABELS), rows


def test_awkward_rows(toy):
    docs, labels, rows = toy
    got = toxicity_scores(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    bad = {r.doc_id for r in got if r.predicted}
    assert bad == {i for i in range(0, 300, 5)} | {None}
    left = toxicity_filter(docs, labels)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {r[0] for r in rows} - bad


def test_nothing_to_learn_from(toy, no_docs, spark):
    docs, labels, rows = toy
    none = spark.createDataFrame([], LABELS)
    assert {r.predicted for r in toxicity_scores(docs, none).collect()} == {0}
    assert toxicity_scores(no_docs, labels).collect() == []


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    judged = toxicity_scores(docs, labels).where("held_out").join(labels.select("doc_id", "toxic"), "doc_id")
    counts = {(r.toxic, r.predicted): r["count"] for r in judged.groupBy("toxic", "predicted").count().collect()}
    hit, missed, wrong = counts.get((1, 1), 0), counts.get((1, 0), 0), counts.get((0, 1), 0)
    assert hit / (hit + missed) >= 0.9 and hit / (hit + wrong) >= 0.85


def test_held_out_rows_are_not_learned_from(spark):
    docs = make_docs(spark, [(i, f"text number{i} secretword", "s") for i in range(200)])
    ids = {r.doc_id for r in docs.where(held_out(docs.doc_id)).collect()}
    labels = spark.createDataFrame([(i, 1, int(i in ids), "t", 0.0) for i in range(200)], LABELS)
    model = fit(docs, labels)
    assert not model.terms and not model.families
