from collections import Counter, defaultdict

from heliograph.llm.chat import rendered_turns

SCHEMA = "conv_id long, turn long, role string, text string, at long, part long, conv string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "c") for r in rows], SCHEMA).repartition(3)


def brute(rows):
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        talks[conv].append((turn is not None, turn or 0, role or "", text or ""))
    talks = {k: tuple(t[2:] for t in sorted(v)) for k, v in talks.items()}
    proper = {t[:i] for t in talks.values() for i in range(1, len(t))}
    first = {}
    for conv in sorted(talks, key=lambda c: (c is None, c or 0)):
        first.setdefault(talks[conv], conv)
    kept = [conv for t, conv in first.items() if t not in proper]
    return Counter((c, i, len(talks[c]), f"<|im_start|>{r}\n{t}<|im_end|>\n") for c in kept for i, (r, t) in enumerate(talks[c]))


def test_snapshots_collapse(spark):
    base = [("user", "hello"), ("assistant", "hi"), ("user", "why"), ("assistant", None), (None, "x" * 50_000)]
    rows = [(c, t, *base[t]) for c, n in ((1, 2), (2, 4), (3, 5), (4, 5), (5, 1)) for t in range(n)]
    rows += [(6, 0, "user", "hello"), (6, 1, "assistant", "other"), (7, 0, "user", ""), (8, None, "user", "hello"), (None, 0, "user", "lost")]
    rows += [(9, 0, "user", "twice"), (9, 0, "user", "twice"), (9, 3, "user", "gap"), (10, 5, "user", "hello"), (10, 9, "assistant", "hi")]
    rows += [(11, 0, "us", "erhello"), (12, 10_000, "user", "far"), (12, 3, "user", "near")]
    assert Counter(tuple(r) for r in rendered_turns(frame(spark, rows)).collect()) == brute(rows)


def test_empty_table(spark):
    assert rendered_turns(frame(spark, [])).collect() == []
