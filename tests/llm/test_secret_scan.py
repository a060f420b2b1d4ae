import hashlib
import random
import re

import numpy as np
import pytest

from heliograph.llm.secret_scan import (
    ACCEPT, CLASSES, ENCODINGS, KINDS, LENGTHS, STEPS, battery, cutoffs, inferred, length_class, scan_digest, secret_spans,
)

WORDS = "lantern orchard whisper meadow of the and from granite copper velvet thimble harbour quiet river Dawn Ähre señal".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def brute_base(text):
    """The contract's patterns on code points, read literally."""
    word = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    assign = re.compile(rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out)


def texts():
    rng = random.Random(5)
    out = ["", None, "Token:abc", "secret: token:abcdefgh", "token=token=abcdef", "ſecret=abcdefgh", "PASSWORD'  :  \"ab.cd=e-f", "api_key=ABCDEF apikey: abcde",
           "xAKIAAKIA" + "Z" * 15, "AKIA" + "9" * 15, "AKIA" + "9" * 16 + "é" + "AKIA" + "Q" * 30, "a" * 23 + " " + "b" * 24, "é" * 7 + "0f" * 30 + "Gsecret=0f0f0f",
           "password=\n abcdefgh", "token==abcdef", "x" * 300_000 + " token: zzzzzzz", "passwd:" + "q" * 200_000]
    for _ in range(60):
        t = prose(rng, 40).split()
        t.insert(rng.randrange(40), rng.choice(["secret = ", "Api_Key:'", "passwd:=", "token"]) + "".join(rng.choices("abcdef0123456789.=_", k=rng.randrange(3, 40))))
        t.insert(rng.randrange(40), "".join(rng.choices("AKI", k=6)) + "AKIA" + "".join(rng.choices("ABC12", k=rng.randrange(10, 22))))
        out.append(" ".join(t))
    return out


def test_base_spans_equal_brute_force(spark):
    rows = [(i, t, "en") for i, t in enumerate(texts())] + [(None, "secret=abcdefgh", None), (3, "secret: token:abcdefgh", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = scan_digest(df).collect()
    want = {}
    for i, t, _ in rows:
        spans = brute_base(t or "")
        joined = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
        counts = tuple(sum(k == n for _, k, _ in spans) for n in range(3))
        want.setdefault(i, []).append((*counts, hashlib.sha256(joined.encode()).hexdigest(), spans))
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) in [w[:4] for w in want[r.doc_id]]
        shown = [tuple(s.split(":")) for s in r.spans.split(",") if s]
        assert shown == sorted(shown, key=lambda s: (int(s[1]), KINDS.index(s[0])))


def slow_battery(codes, e):
    """t of one token in plain Python."""
    k, n = e.size, len(codes)
    chi = sum((codes.count(c) - n / k) ** 2 / (n / k) for c in range(k))
    freedom = (k - 1) / (1 - 1 / n)
    z = ((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * freedom))) / (2 / (9 * freedom)) ** 0.5
    kinds = [int(e.kinds[c]) for c in codes]
    share = [sum(1 for x in e.kinds if x == j) / k for j in range(4)]
    p = 1 - sum(s * s for s in share)
    both = sum(share[a] * share[b] * share[c] for a in range(4) for b in range(4) for c in range(4) if a != b and b != c)
    var = (n - 1) * p * (1 - p) + 2 * (n - 2) * (both - p * p)
    runs = (sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) - (n - 1) * p) / var**0.5
    mean, var = (k - 1) / 2, (k * k - 1) / 12
    serial = sum((a - mean) * (b - mean) for a, b in zip(codes, codes[1:], strict=False)) / var / (n - 1) ** 0.5
    return max(z, 0) ** 2 + runs**2 + serial**2


@pytest.mark.parametrize("e", ENCODINGS, ids=lambda e: e.name)
def test_battery_equals_plain_python(e):
    rng = np.random.default_rng(1)
    for n in (16, 33, 128):
        codes = rng.integers(0, e.size, (5, n))
        assert np.allclose(battery(codes, e), [slow_battery(c.tolist(), e) for c in codes])


@pytest.mark.parametrize("e", ENCODINGS, ids=lambda e: e.name)
def test_even_draws_are_accepted(e):
    rng = np.random.default_rng(2)
    for n in LENGTHS:
        t = battery(rng.integers(0, e.size, (4000, n)), e)
        assert (t <= ACCEPT).mean() > 0.98


def test_encoding_is_the_smallest():
    want = {b"00ff00ff00ff00ff": "hex", b"00FF00FF00FF00FA": "HEX", b"ABCDEFGHIJKL2345": "base32", b"abcxyz0189abcxyz": "base36", b"ABCXYZ0189ABCXYZ": "BASE36",
            b"abcXYZ0189ABCXYZ": "base62", b"abc/XYZ0189+BCXYZ": "base64", b"abc-XYZ0189_BCXYZ": "base64url"}
    assert {t: ENCODINGS[inferred(t)].name for t in want} == want
    assert inferred(b"1234567890123456") is None and inferred(b"a/b-c") is None


def test_cutoffs_are_benjamini_hochberg():
    rng = np.random.default_rng(3)
    ordinary = rng.poisson(np.linspace(0, 40, CLASSES), (5, CLASSES))
    ordinary[0] = 0
    tokens = rng.poisson(np.linspace(4, 0, CLASSES), (5, CLASSES))
    tokens[1] = 0
    got = cutoffs(ordinary, tokens, 0.2)
    for s in range(5):
        p = [(1 + ordinary[s, : c + 1].sum()) / (1 + ordinary[s].sum()) for c in range(CLASSES)]
        values = sorted(p[c] for c in range(CLASSES) for _ in range(tokens[s, c]))
        rank = max((i + 1 for i, v in enumerate(values) if v <= 0.2 * (i + 1) / len(values)), default=0)
        admitted = int(tokens[s, : got[s] + 1].sum()) if got[s] >= 0 else 0
        assert admitted == rank


def test_random_tokens_are_found_and_names_are_not(spark):
    rng = random.Random(11)
    alphabets = {"b62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "b36": "abcdefghijklmnopqrstuvwxyz0123456789", "HEX": "0123456789ABCDEF"}
    docs, planted = [], {}
    plain = ["someVeryLongFunctionNameThatNobodyReads", "http/example/paths/of/some/length/index", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "ABABABABABABABABABABABAB",
             "0123456789abcdefghijklmnopqrstuvwxyz", "snake_case_name_with_many_parts_in_it", "Donaudampfschifffahrtsgesellschaft", "4111111111111111"]
    for i in range(600):
        words = prose(rng, 300).split()
        if i % 10 == 0:
            kind = rng.choice(list(alphabets))
            token = "".join(rng.choices(alphabets[kind], k=rng.choice([32, 40, 48])))
            words.insert(rng.randrange(300), token)
            planted[i] = token
        elif i % 10 == 1:
            words.insert(rng.randrange(300), plain[(i // 10) % len(plain)])
        docs.append((i, " ".join(words)))
    found = secret_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    hits = {r.doc_id: [docs[r.doc_id][1][s.start : s.stop] for s in r.spans if s.kind == 3] for r in found}
    caught = sum(hits[i] == [t] for i, t in planted.items())
    assert caught >= 0.95 * len(planted)
    assert not [h for i, h in hits.items() if h and i not in planted]


def test_length_decides_what_is_admitted(spark):
    """The same share of ordinary windows, so the same p-values: with more tokens that are not random, fewer are admitted."""
    assert length_class(16) == 0 and length_class(19) == 0 and length_class(20) == 1 and length_class(10**6) == len(LENGTHS) - 1
    ordinary, tokens = np.zeros((1, CLASSES), int), np.zeros((1, CLASSES), int)
    ordinary[0, 40:60] = 50
    tokens[0, 10], tokens[0, 90] = 3, 3
    assert cutoffs(ordinary, tokens)[0] >= 10
    tokens[0, 90] = 3 * 1000
    assert cutoffs(ordinary, tokens)[0] == -1
    assert STEPS * ACCEPT < CLASSES - 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert scan_digest(df).count() == 0
