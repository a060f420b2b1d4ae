import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from heliograph.llm.trie import fattest, numbered, prefix_trie, trie_nodes

SCHEMA = "conv_id long, turn long, role string, text string"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


def rebuild(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = own.get(base, [])[:h] + ts[h:]
    return out


def brute(convs):
    """All nodes of a plain trie: rows as the contract gives them."""
    members = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        own = (len(members[node]) - 1) * words(node[-1][1]) if node else 0
        saved[node] = own + sum(saved[k] for k in kids[node])
    out = []
    for node, ms in members.items():
        ends = sorted(c for c in ms if len(convs[c]) == len(node))
        out.append((min(ms), len(node), min(members[node[:-1]]) if node else None, len(ms), len(kids[node]), leaves[node], saved[node],
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(0, 40) for b in range(a + 1, 70)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", fattest(*map(__import__("pyspark.sql.functions", fromlist=["col"]).col, "ab")).alias("f")).collect()
    for r in got:
        assert r.f == max(range(r.a + 1, r.b + 1), key=lambda x: x & -x)


def conversations(rng, n):
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, 9)):
            text = rng.choice(["hot first turn", ""]) if t == 0 and rng.random() < 0.6 else f"w{rng.randrange(3)} of {t}"
            rows.append((c, t, rng.choice(["user", "assistant"]) if rng.random() < 0.2 else "user", text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_rebuilt_trie_equals_brute_force(spark, seed):
    import random

    rng = random.Random(seed)
    rows = conversations(rng, 300)
    rows += [(None, 0, "user", "nobody"), (7, None, None, None), (7, None, None, None), (7, 3, "user", " "), (-45, 1, "a", "b"), (-40, 0, "a", "c"), (-41, 0, "a", "c")]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", depth int")
    assert rows_of(prefix_trie(df)) == brute(rebuild(rows))


def test_long_conversations_and_copies(spark):
    """Edges longer than a part, splits inside them, many equal conversations and one that is a prefix of another."""
    base = [("user", f"turn {i} x") for i in range(700)]
    convs = {0: base, 1: base[:300], 2: [*base[:513], ("user", "else")], 3: [*base[:256], ("user", "else")], 4: base[:256], 5: base[:257], 6: []}
    convs |= {10 + i: base[:40] for i in range(300)} | {5000 + i: [*base[:40], ("user", f"{i}")] for i in range(40)}
    turns = spark.createDataFrame([(c, i, *t) for c, ts in convs.items() for i, t in enumerate(ts)], "conv long, at long, role string, text string")
    ids = spark.createDataFrame([(c,) for c in convs], "conv long")
    assert rows_of(trie_nodes(turns, ids)) == brute(convs)


@pytest.mark.parametrize("rows", [[], [(None, 1, "a", "b")], [(5, None, None, None)], [(20, 0, "u", "a b"), (20, 0, "u", "a b")]])
def test_tiny_tables(spark, rows):
    got = rows_of(prefix_trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == (brute(rebuild(rows)) if rebuild(rows) else [])


def test_order_of_turns(spark):
    rows = [(1, 2, "b", "x"), (1, None, "z", None), (1, 2, "a", "y"), (1, -5, None, "q")]
    got = sorted(tuple(r) for r in numbered(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 0, "z", ""), (1, 1, "", "q"), (1, 2, "a", "y"), (1, 3, "b", "x")]
