import base64
import hashlib
import io
import random
import zlib
from collections import Counter

from heliograph.llm import warc
from heliograph.session import scratch


def member(raw):
    engine = zlib.compressobj(6, zlib.DEFLATED, 31)
    return engine.compress(raw) + engine.flush()


def records(n):
    return [warc.record_bytes(i, f"http://a/{i}", f"<p>{i}</p>".encode() * (i % 50), None) for i in range(n)]


def ids(found):
    return [f["record_id"] for kind, *_, f in found if kind == "record"]


def test_round_trip_of_awkward_pages(spark):
    rows = [(1, "u", "a"), (2, "u", "a"), (3, None, None), (4, "v\r\nx", ""), (None, "w", "a"), (5, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (2, "u", "a"), (2, "other", "a"), (6, "x", "long " * 300_000), (7, "y", "é\U0001f600")]
    pages = spark.createDataFrame([(*r, "k", True) for r in rows], "page_id long, url string, html string, key string, first boolean").repartition(3)
    got = Counter(tuple(r) for r in warc.round_trip(pages).collect())
    want = Counter()
    best, left = {}, {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    for i, _, h in rows:
        body, top = (h or "").encode(), best[h or ""]
        response = i == top and not left.get(h or "")
        if response:
            left[h or ""] = True
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        want[(i, len(body), digest, "response" if response else "revisit", None if response else top)] += 1
    assert got == want


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_salvage_of_compressed_archives():
    raw = records(60)
    parts = [member(r) for r in raw]
    whole = b"".join(parts)
    assert len(ids(warc.salvage(io.BytesIO(whole)))) == 60
    rng = random.Random(4)
    for trial in range(60):
        bad = rng.sample(range(60), 4)
        damaged = list(parts)
        for i in bad:
            p = bytearray(parts[i])
            how = rng.randrange(3)
            if how == 0:
                p[rng.randrange(len(p) // 2, len(p) - 1)] ^= 0x55
            elif how == 1:
                p = p[: len(p) // 2]
            else:
                p = p + b"\x1f\x8b\x08junk WARC/1.0\r\nnothing"
            damaged[i] = bytes(p)
        data = b"".join(damaged)
        found = list(warc.salvage(io.BytesIO(data)))
        names = set(ids(found))
        assert names >= {f"<urn:page:{i}>" for i in range(60) if i not in bad}, trial
        edges = [(a, b) for _, a, b, *_ in found]
        assert edges[0][0] == 0 and edges[-1][1] == len(data) and all(x[1] == y[0] for x, y in zip(edges, edges[1:], strict=False))
        assert any(kind == "gap" for kind, *_ in found)


def test_salvage_of_plain_archives():
    raw = records(30)
    data = b"".join(raw[:10]) + raw[10][:-20] + b"garbage" + b"".join(raw[11:20]) + raw[20].replace(b"<p>", b"<q>", 1) + b"".join(raw[21:])
    found = list(warc.salvage(io.BytesIO(data)))
    assert ids(found) == [f"<urn:page:{i}>" for i in range(30) if i not in (10, 20)]
    assert [r for kind, _, _, r, _ in found if kind == "gap"][-1] == "block digest"


def test_gaps_of_a_damaged_archive(spark, tmp_path):
    path = tmp_path / "a.warc.gz"
    parts = [member(r) for r in records(5)]
    parts[2] = parts[2][:30]
    path.write_bytes(b"".join(parts))
    rows = warc.read_archives(spark.createDataFrame([(f"file://{path}",)], "archive string")).orderBy("start").collect()
    assert [r.kind for r in rows] == ["record", "record", "gap", "record", "record"]
    assert rows[2].end - rows[2].start == 30 and rows[2].reason
    assert scratch(spark, "x") != scratch(spark, "x")
