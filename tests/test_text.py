import hashlib

import pytest
from pyspark.sql import functions as F

from heliograph.functions import dims, text, vectors
from heliograph.operators import compliance, entities


def one(spark, schema, row, *cols):
    return spark.createDataFrame([row], schema).select(*cols).first()


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[1] for r in df.select("i", expr).orderBy("i").collect()]


def test_normalize_folds_width_and_space(spark):
    got = column(spark, ["  a \t b\n", "ＡＩ　ｔｅｓｔ", None, "é"], text.normalize_text(F.col("t")))
    assert got == ["a b", "AI test", "", "é"]


def test_content_hash_keeps_case(spark):
    a, b, c = column(spark, ["Hello  World", "Hello World", "hello world"], text.content_hash(text.normalize_text(F.col("t"))))
    assert a == b == hashlib.sha256(b"Hello World").hexdigest()
    assert c != a


def test_language_by_script(spark):
    values = ["Hello there", "안녕하세요 hello", "これは日本語です", "这是中文", "12345 !!", "", "ー"]
    assert column(spark, values, text.detect_language(F.col("t"))) == ["en", "ko", "ja", "zh", "other", "other", "ja"]


def test_shingles_short_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "a b"), (3, "")], "i int, n string")
    got = {r["i"]: set(r["shingles"]) for r in text.with_shingles(df, "n").collect()}
    assert got == {1: {"a b c", "b c d"}, 2: {"a b"}, 3: set()}


def test_flesch_matches_word_by_word_count(spark):
    import re

    value = "The quick brown fox jumps. Why not? Rhythms pass by éa in 2024 __ x!!! "
    words = re.findall(r"\w+", value)
    sentences = [s for s in re.split(r"[.!?]+", value) if s.strip()]
    syllables = sum(max(1, len(re.findall("[aeiouy]+", w.lower()))) for w in words)
    want = max(0.0, min(100.0, 206.835 - 1.015 * len(words) / len(sentences) - 84.6 * syllables / len(words)))
    assert column(spark, [value, ""], text.flesch_reading_ease(F.col("t"))) == [pytest.approx(want), 0.0]


def test_tokens_and_syllables(spark):
    assert column(spark, ["one two three", "", "   "], text.estimate_tokens(F.col("t"))) == [5, 0, 1]
    assert column(spark, ["queue", "rhythm", "tsk"], text.count_syllables(F.col("t"))) == [1, 1, 1]


def test_cues_in_three_languages_and_ties(spark):
    df = spark.createDataFrame(
        [(0, "I am so happy and I love it"), (1, "너무 무서워요"), (2, "不安です"), (3, "nothing here"), (4, "happy angry"), (5, "buy now")],
        "i int, normalized string",
    )
    rows = text.classify(df, "normalized").orderBy("i").collect()
    assert [r["emotion"] for r in rows] == ["joy", "fear", "fear", "unknown", "joy", "unknown"]
    assert rows[5]["intent"] == "transactional" and rows[4]["emotion_conf"] == pytest.approx(0.8)


def test_clamp_keeps_null(spark):
    df = spark.createDataFrame([(5.0,), (None,), (-1.0,)], "v double")
    assert [r[0] for r in df.select(text.clamp(F.col("v"), 0.0, 1.0)).collect()] == [1.0, None, 0.0]


def test_cosine_and_jaccard_edges(spark):
    row = one(
        spark, "a array<double>, b array<double>, z array<double>, s array<string>, e array<string>",
        ([1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0], ["x", "y"], []),
        vectors.cosine(F.col("a"), F.col("b")), vectors.cosine(F.col("a"), F.col("z")), vectors.cosine(F.col("a"), F.col("a")),
        vectors.jaccard(F.col("s"), F.col("e")), vectors.jaccard(F.col("s"), F.array(F.lit("y"), F.lit("z"))),
    )
    assert list(row) == [0.0, 0.0, 1.0, 0.0, pytest.approx(1 / 3)]


def test_hash_embedding_bits(spark):
    got = column(spark, ["Alpha beta alpha", ""], vectors.hash_embedding("t"))
    want = [0.0] * 768
    for token in ("alpha", "beta", "alpha"):
        digest = hashlib.md5(token.encode()).digest()
        want[int.from_bytes(digest[:4], "big") % 768] += 1.0 if digest[4] & 1 else -1.0
    norm = sum(x * x for x in want) ** 0.5
    assert got[0] == pytest.approx([x / norm for x in want]) and got[1] == [0.0] * 768


def test_pii_claims(spark):
    values = ["mail me@x.org now", "rrn 900101-1234567", "call 010-1234-5678", "clean text", "card 4111 1111 1111 1111"]
    assert column(spark, values, compliance.pii_mask(F.col("t"))) == [
        "mail [EMAIL] now", "rrn [RRN]", "call [PHONE]", "clean text", "card [CARD]",
    ]
    hits = column(spark, values, compliance.pii_detections(F.col("t")))
    assert [h[0]["type"] if h else None for h in hits] == ["email", "krrn", "phone_kr", None, "credit_card"]
    assert hits[0][0]["start"] == 5 and hits[0][0]["end"] == 13


def test_copyright_score(spark):
    quote = '"this is a long quoted passage of text"'
    df = spark.createDataFrame([("plain words", "http://x", "CC-BY"), (quote, "", None), ("plain", None, "odd")], "t string, u string, l string")
    got = [r[0] for r in df.select(text.copyright_score(F.col("t"), F.col("u"), F.col("l"))).collect()]
    assert got == [pytest.approx(0.015), pytest.approx(0.5 * 37 / 39 + 0.2 + 0.12), pytest.approx(0.32)]


def test_quality_issues(spark):
    df = spark.createDataFrame([("T", "The cat sat. It was good."), ("", " "), ("T", "A miracle cure is here. It is so.")], "t string, b string")
    issues = compliance.quality_issues(F.col("t"), F.col("b"), F.lit("blog"), F.lit("http://x"), F.lit("mit"))
    rows = [r[0] for r in df.select(issues).collect()]
    assert rows[0] == [] and rows[1][:2] == ["empty body", "missing title"] and rows[2] == ["banned term: 'miracle cure'"]


def test_robots_agree_with_standard_library(spark):
    from urllib.robotparser import RobotFileParser

    robots = (
        "# head\nUser-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /private # no\nAllow: /private/open\nCrawl-delay: 7\n"
        "\nUser-agent: newsbot\nUser-agent: second\nAllow: /private/a\nDisallow: /private\nDisallow:\n"
    )
    paths = ["/private/x", "/public", "/private/open", "/private/a", "", "/x?q=1"]
    pages = spark.createDataFrame([(f"https://h.org{p}",) for p in paths] + [("https://none.org/private",)], "url string")
    files = spark.createDataFrame([("h.org", robots)], "host string, robots string")
    for agent in ("hg-bot", "newsbot/2.0"):
        parser = RobotFileParser()
        parser.parse(robots.splitlines())
        rules = compliance.robots_rules(files, agent)
        got = {r["url"]: r["allowed"] for r in compliance.robots_allowed(pages, rules).collect()}
        want = {f"https://h.org{p}": parser.can_fetch(agent, f"https://h.org{p}") for p in paths}
        assert got == {**want, "https://none.org/private": True}
        delays = compliance.crawl_delays(spark.createDataFrame([("h.org",), ("none.org",)], "host string"), rules)
        found = parser.crawl_delay(agent)
        assert {r[0]: r[1] for r in delays.collect()} == {"h.org": float(found) if found else 1.0, "none.org": 1.0}


def test_mentions_and_linking(spark):
    df = spark.createDataFrame([(1, "OpenAI met Open AI and NVIDIA Corp. in Séoul; openai")], "id int, n string")
    found = entities.mentions(df, "id", "n").collect()
    assert [r["text"] for r in found] == ["OpenAI", "Open AI", "NVIDIA Corp", "Séoul"]
    linked = {r["key"]: r["text"] for r in entities.link(entities.mentions(df, "id", "n"), "id").collect()}
    assert linked == {"Q21708200": "OpenAI", "nvidia corp": "NVIDIA Corp", "séoul": "Séoul"}
    spans = df.select(entities.mention_spans("n")).first()[0]
    assert spans[1]["text"] == "Open AI" and spans[1]["start"] == 11


def test_fixed_tables_line_up():
    assert abs(sum(dims.GRAPH_SCORE_WEIGHTS.values()) - 1) < 1e-9
    assert abs(sum(dims.STREAM_WEIGHTS.values()) - 1) < 1e-9
    assert sorted(dims.BANNED_TERMS) == list(dims.BANNED_TERMS)


def test_kmeans_steps_read_stored_counts(spark, monkeypatch):
    """IDF and KMeans are fitted on persisted word counts, which are freed; nearest centres hold."""
    from heliograph.operators import entities

    kept = []
    monkeypatch.setattr(entities, "keep", lambda df: kept.append(df.persist()) or kept[-1])
    docs = spark.createDataFrame([(i, f"alpha{i % 3} beta{i % 3} gamma") for i in range(30)], "doc_id long, text string")
    assert entities.kmeans_distances(docs, "text", 3, 16).filter("own > nearest + 1e-6").count() == 0
    assert [df.columns for df in kept] == [["_tf"]] and not kept[0].is_cached
