"""The pipeline's rows against a brute-force pipeline on a small folder."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from heliograph.llm.mixing import targets
from tests.llm.test_exact_dedup import brute as exact_brute
from tests.llm.test_ngram_join import brute as near_brute

SF = "/root/testdata/sf0.001"


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(("documents", docs.collect(), docs.columns))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, SF))
        out.append((name, docs.collect(), docs.columns))
        assert i == 4 or docs.columns == out[0][2]
    return out


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "mixing", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_filters(stages):
    _, docs, _ = stages[0]
    _, clean, _ = stages[1]
    assert set(clean) <= set(docs) and len(clean) >= 0.8 * len(docs)
    rows = [(r.doc_id, r.text) for r in clean]
    assert {r.doc_id for r in stages[2][1]} == {k[0] for k in exact_brute(rows) if k[3]}
    rows = [(r.doc_id, r.text) for r in stages[2][1]]
    assert {r.doc_id for r in stages[3][1]} == {c for (_, _, c) in near_brute(rows, 5, 80, 100)}


def test_mix_and_packing(stages):
    before, after, packed = stages[3][1], stages[4][1], stages[5][1]
    sizes = defaultdict(int)
    for r in before:
        sizes[r.source] += size(r.text)
    names = sorted(n for n in sizes if n is not None) + [None] * (None in sizes)
    aims = dict(zip(names, targets([sizes[n] for n in names]), strict=True))
    taken = Counter()
    for r in after:
        taken[r.source] += size(r.text)
    assert all(abs(taken[n] - aims[n]) <= 256 for n in names)
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in after)
    assert len({r.sequence_id for r in packed}) <= -(-sum(r.length for r in packed) // 4096) + 1
