import hashlib
import re
from collections import Counter

import numpy as np

from heliograph.llm.exact_dedup import build_hash, exact_filter, exact_groups, look_up


def brute(rows):
    groups = {}
    for i, t, *_ in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups.setdefault(hashlib.sha256(norm.encode()).hexdigest(), []).append((-len(t or ""), i is None, i))
    out = Counter()
    for h, members in groups.items():
        best, kept = min(members, key=lambda m: (m[0], m[1], m[2] or 0)), False
        for m in members:
            out[(m[2], best[2], len(members), m == best and not kept, h)] += 1
            kept |= m == best
    return out


def test_awkward_rows(docs, awkward):
    assert Counter(tuple(r) for r in exact_groups(docs).collect()) == brute(awkward)


def test_filter(docs, awkward):
    left = exact_filter(docs)
    assert left.columns == docs.columns
    want = Counter(k[0] for k, n in brute(awkward).items() for _ in range(n) if k[3])
    assert Counter(r.doc_id for r in left.collect()) == want


def test_empty_table(no_docs):
    assert exact_groups(no_docs).collect() == []
    assert exact_filter(no_docs).collect() == []


def test_hash_is_perfect_and_minimal():
    digest = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(5000)), np.uint8).reshape(-1, 32)
    levels, slots = build_hash(digest)
    assert sorted(slots.tolist()) == list(range(5000))
    assert (look_up(levels, digest) == slots).all()
