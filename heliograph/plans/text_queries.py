"""Text functions over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograph.functions import dims, text, vectors
from heliograph.operators import compliance
from heliograph.plans.registry import query
from heliograph.session import small_batches

# SQL fragments used by the checks.
SQUASH = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
NORM = SQUASH.format("text")
TOKEN = r"[\p{L}\p{N}_]+"
LICENSES = ("cc0", "cc-by", "cc-by-sa", "public-domain", "mit", "fair-use", "all-rights-reserved", "")
SQL_LICENSE = f"(['{"','".join(LICENSES)}'])[(doc_id % 8)::int + 1]"
SQL_URL = "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'https://example.org/' || doc_id END"
SQL_TITLE = "split_part(text, chr(10), 1)"
PLATFORM_NAMES = ("blog", "youtube", "instagram", "newsletter", "shorts")
SQL_PLATFORM = "(['blog','youtube','instagram','newsletter','shorts'])[(doc_id % 5)::int + 1]"


def sql_case(values: dict, key: str, default: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items())
    return f"CASE {key} {arms} ELSE {default} END"


def with_content(docs):
    """Documents as content: title = first line, licence, URL, platform by id."""
    return docs.select(
        "doc_id",
        "lang",
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("body"),
        F.element_at(dims.literal_array(LICENSES), (F.col("doc_id") % 8 + 1).cast("int")).alias("license"),
        F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("https://example.org/"), "doc_id")).alias("source_url"),
        F.element_at(dims.literal_array(PLATFORM_NAMES), (F.col("doc_id") % 5 + 1).cast("int")).alias("platform"),
    )


@query("normalize_text", f"SELECT doc_id, {NORM} AS normalized FROM documents")
def _(t):
    return t.documents.select("doc_id", text.normalize_text(F.col("text")).alias("normalized"))


@query(
    "content_hash",
    f"""
    SELECT doc_id, sha256({NORM}) AS content_hash,
           sha256({SQUASH.format(f"{SQL_TITLE} || chr(10) || text")}) AS dedup_key
    FROM documents
    """,
)
def _(t):
    both = F.concat(F.substring_index("text", "\n", 1), F.lit("\n"), "text")
    return t.documents.select(
        "doc_id",
        text.content_hash(text.normalize_text(F.col("text"))).alias("content_hash"),
        text.content_hash(text.normalize_text(both)).alias("dedup_key"),
    )


@query(
    "make_node_id",
    r"""
    SELECT p_partkey, 'product:' || regexp_replace(regexp_replace(lower(p_name), '\s+', '_', 'g'),
           '[^a-z0-9_:-]', '', 'g') AS node_id FROM part
    """,
)
def _(t):
    return t.part.select("p_partkey", text.node_id(F.lit("product"), text.squash(F.col("p_name"))).alias("node_id"))


@query("clamp", "SELECT event_id, greatest(5.0, least(50.0, value)) AS clamped FROM events")
def _(t):
    return t.events.select("event_id", text.clamp(F.col("value"), 5.0, 50.0).alias("clamped"))


@query(
    "cache_key",
    "SELECT event_id, 'hg:ctr:' || substr(md5(user_id::varchar || ':' || event_type), 1, 12) AS cache_key FROM events",
)
def _(t):
    return t.events.select("event_id", text.cache_key("ctr", F.col("user_id"), F.col("event_type")).alias("cache_key"))


def sql_shingles(k: int, source: str = "documents") -> str:
    """CTEs tok, grams(doc_id, g): distinct k-word shingles of every document."""
    return f"""
    tok AS (SELECT doc_id, regexp_extract_all(lower({NORM}), '{TOKEN}') AS w FROM {source}),
    grams AS (
        SELECT DISTINCT doc_id, array_to_string(w[i:i + {k - 1}], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - {k} + 2)) AS i FROM tok WHERE len(w) >= {k})
        UNION ALL
        SELECT doc_id, array_to_string(w, ' ') FROM tok WHERE len(w) < {k} AND len(w) > 0
    )"""


@query(
    "word_shingles",
    f"""
    WITH {sql_shingles(3)}
    SELECT doc_id, count(*) AS n_shingles, min(g) AS first_shingle, max(g) AS last_shingle
    FROM grams GROUP BY doc_id
    """,
)
def _(t):
    docs = text.with_normalized(t.documents.select("doc_id", "text"), "text")
    return text.with_shingles(docs, "normalized", "s").filter(F.size("s") > 0).select(
        "doc_id",
        F.size("s").cast("bigint").alias("n_shingles"),
        F.array_min("s").alias("first_shingle"),
        F.array_max("s").alias("last_shingle"),
    )


SQL_LANG = r"""
CASE WHEN ko > 0 AND ko >= greatest(ja, zh) THEN 'ko' WHEN ja > 0 THEN 'ja'
     WHEN zh > 0 THEN 'zh' WHEN latin > 0 THEN 'en' ELSE 'other' END"""
SQL_SCRIPTS = r"""
len(regexp_extract_all(text, '\p{Hangul}')) AS ko,
len(regexp_extract_all(text, '[\p{Hiragana}\p{Katakana}]')) AS ja,
len(regexp_extract_all(text, '\p{Han}')) AS zh,
len(regexp_extract_all(text, '\p{Latin}')) AS latin"""


@query(
    "detect_language",
    f"SELECT doc_id, {SQL_LANG} AS language FROM (SELECT doc_id, {SQL_SCRIPTS} FROM documents)",
)
def _(t):
    return t.documents.select("doc_id", text.detect_language(F.col("text")).alias("language"))


@query(
    "map_language_code",
    """
    SELECT doc_id, CASE WHEN lower(lang) LIKE 'zh%' THEN 'zh' WHEN lower(lang) IN ('ko','en','ja') THEN lower(lang)
           ELSE 'other' END AS language FROM documents
    """,
)
def _(t):
    return t.documents.select("doc_id", text.map_language_code(F.col("lang")).alias("language"))


# -- personal data ---------------------------------------------------------------
def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")


# The checks mask claimed text with a neutral mark, so that a later pattern
# cannot reach into an earlier claim. RE2 has no Unicode word boundary, so they
# first fold each letter outside ASCII to "x"; the masked text is compared so.
FOLDED = r"regexp_replace(text, '[^\x00-\x7F]', 'x', 'g')"


def _sql_chain(final: bool) -> str:
    expr = FOLDED
    for _kind, pattern, mask in dims.PII_PATTERNS:
        expr = f"regexp_replace({expr}, '{_re2(pattern)}', '{mask if final else '¤'}', 'g')"
    return expr


def _sql_hits() -> str:
    parts, expr = [], FOLDED
    for kind, pattern, _mask in dims.PII_PATTERNS:
        parts.append(f"SELECT doc_id, lang, '{kind}' AS type, unnest(regexp_extract_all({expr}, '{_re2(pattern)}')) AS original FROM documents")
        expr = f"regexp_replace({expr}, '{_re2(pattern)}', '¤', 'g')"
    return " UNION ALL ".join(parts)


@query("pii_detect", f"SELECT doc_id, type, original FROM ({_sql_hits()})")
def _(t):
    hits = t.documents.select("doc_id", F.explode(compliance.pii_detections(F.col("text"))).alias("h"))
    return hits.select("doc_id", "h.type", "h.original")


@query("pii_mask", f"SELECT doc_id, {_sql_chain(True)} AS masked FROM documents")
def _(t):
    return t.documents.select("doc_id", compliance.pii_mask(F.col("text")).alias("masked")).select(
        "doc_id", F.regexp_replace("masked", r"[^\x00-\x7F]", "x").alias("masked")
    )


@query("pii_report", f"SELECT lang, type, count(*) AS n FROM ({_sql_hits()}) GROUP BY lang, type")
def _(t):
    return compliance.pii_report(t.documents, "text", "lang")


# -- copyright and readability -----------------------------------------------------
SQL_QUOTE = """
CASE WHEN length(text) > 0 THEN least(1.0, coalesce(list_sum(list_transform(
    regexp_extract_all(text, '["“”]([^"“”]{10,})["“”]', 1), lambda x: length(x))), 0)::double / length(text))
ELSE 0.0 END"""
SQL_RISK = f"""
greatest(0.0, least(1.0, 0.5::double * ({SQL_QUOTE})
  + 0.2::double * (CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END)
  + 0.3::double * ({sql_case(dims.LICENSE_RISK, SQL_LICENSE, '0.40')})::double))"""


@query("quote_ratio", f"SELECT doc_id, round({SQL_QUOTE}, 6) AS quote_ratio FROM documents")
def _(t):
    return t.documents.select("doc_id", F.round(text.quote_ratio(F.col("text")), 6).alias("quote_ratio"))


@query(
    "copyright_score",
    f"SELECT doc_id, round({SQL_RISK}, 6) AS score, {SQL_RISK} <= 0.30::double AS safe FROM documents",
)
def _(t):
    score = text.copyright_score(F.col("body"), F.col("source_url"), F.col("license"))
    return with_content(t.documents).select(
        "doc_id", F.round(score, 6).alias("score"), (score <= dims.COPYRIGHT_SAFE_MAX).alias("safe")
    )


SQL_EASE = rf"""
CASE WHEN words = 0 THEN 0.0 ELSE greatest(0.0, least(100.0, 206.835::double
  - 1.015::double * (words::double / greatest(1, sentences)) - 84.6::double * (syll::double / words))) END"""
SQL_EASE_PARTS = rf"""
len(regexp_extract_all(text, '{TOKEN}')) AS words,
len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g')) <> '')) AS sentences,
coalesce(list_sum(list_transform(regexp_extract_all(text, '{TOKEN}'),
   lambda w: greatest(1, len(regexp_extract_all(lower(w), '[aeiouy]+'))))), 0) AS syll"""


@query(
    "flesch_reading_ease",
    f"SELECT doc_id, round({SQL_EASE}, 4) AS ease FROM (SELECT doc_id, {SQL_EASE_PARTS} FROM documents)",
)
def _(t):
    return t.documents.select("doc_id", F.round(text.flesch_reading_ease(F.col("text")), 4).alias("ease"))


@query(
    "count_syllables",
    rf"""
    SELECT word, greatest(1, len(regexp_extract_all(word, '[aeiouy]+')))::bigint AS syllables, count(*) AS uses
    FROM (SELECT unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS word FROM documents) GROUP BY word
    """,
)
def _(t):
    words = t.documents.select(F.explode(text.tokens(F.lower("text"))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("uses"))
    return counts.select("word", text.count_syllables(F.col("word")).cast("bigint").alias("syllables"), "uses")


SQL_TOKENS = r"""
CASE WHEN coalesce({0}, '') = '' THEN 0 ELSE
  floor(len(regexp_extract_all({0}, '\S+'))::double / 0.75::double)::bigint + 1 END"""


@query("estimate_tokens", f"SELECT doc_id, {SQL_TOKENS.format('text')} AS n_tokens FROM documents")
def _(t):
    return t.documents.select("doc_id", text.estimate_tokens(F.col("text")).alias("n_tokens"))


# -- cue classifiers ---------------------------------------------------------------
def _sql_counts(cues: dict) -> str:
    def count(word):
        return f"(length(low) - length(replace(low, '{word}', ''))) / {len(word)}"

    return ", ".join(f"{' + '.join(count(w) for w in words)} AS n_{label}" for label, words in cues.items())


def _sql_label(cues: dict) -> tuple[str, str]:
    names = [f"n_{label}" for label in cues]
    top = f"greatest({', '.join(names)})"
    total = f"({' + '.join(names)})"
    arms = " ".join(f"WHEN n_{label} = {top} THEN '{label}'" for label in cues)
    conf = f"CASE WHEN low = '' THEN 0.0 WHEN {total} = 0 THEN 0.5 ELSE least(0.99, 0.6::double + 0.4::double * {top} / {total}) END"
    return f"CASE WHEN {total} = 0 OR ({conf}) < {{floor}} THEN 'unknown' {arms} END", f"round({conf}, 4)"


def _sql_classify(source: str, keys: str, which: str) -> str:
    cols = []
    if "e" in which:
        label, conf = _sql_label(dims.EMOTION_CUES)
        cols.append(f"{label.format(floor=dims.EMOTION_CONF_MIN)} AS emotion, {conf} AS emotion_conf")
    if "i" in which:
        label, conf = _sql_label(dims.INTENT_CUES)
        cols.append(f"{label.format(floor=dims.INTENT_CONF_MIN)} AS intent, {conf} AS intent_conf")
    return f"""
    SELECT {keys}, {', '.join(cols)} FROM (
      SELECT *, {_sql_counts(dims.EMOTION_CUES)}, {_sql_counts(dims.INTENT_CUES)}
      FROM (SELECT {keys}, lower({NORM}) AS low FROM {source}))"""


def _classified(df, keys, emotion=True, intent=True):
    normal = text.with_normalized(df.select(*keys, "text"), "text").drop("text")
    return text.classify(normal, "normalized", emotion, intent).drop("normalized")


@query("emotion_classify", _sql_classify("documents", "doc_id", "e"))
def _(t):
    return _classified(t.documents, ["doc_id"], intent=False)


@query("intent_classify", _sql_classify("conversations", "conv_id, turn", "i"))
def _(t):
    return _classified(t.conversations, ["conv_id", "turn"], emotion=False)


@query("classify_batch", _sql_classify("conversations", "conv_id, turn", "ei"))
def _(t):
    return _classified(t.conversations, ["conv_id", "turn"])


# -- vectors and sets ----------------------------------------------------------------
def sql_slots(source: str) -> str:
    """(doc_id, slot, value) of the non-zero slots of the hashed embeddings of ``source``; a document without one has a row
    with null in both."""
    return rf"""
    tok AS (SELECT doc_id, unnest(string_split(lower({NORM}), ' ')) AS w FROM {source}),
    hit AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::bigint % {vectors.EMBED_DIM} AS slot,
                   CASE WHEN ('0x' || substr(md5(w), 9, 2))::int % 2 = 1 THEN 1 ELSE -1 END AS sign FROM tok WHERE w <> ''),
    slots AS (SELECT doc_id, slot, sum(sign)::double AS v FROM hit GROUP BY ALL HAVING sum(sign) <> 0)
    SELECT d.doc_id, slot, round(v / sqrt(sum(v * v) OVER (PARTITION BY d.doc_id)), 6) AS value FROM {source} d LEFT JOIN slots ON slots.doc_id = d.doc_id"""


def slots_of(encoded):
    """The non-zero slots of (doc_id, embedding), or one row of nulls."""
    cells = F.transform("embedding", lambda v, i: F.struct(i.cast("bigint").alias("slot"), F.round(v, 6).alias("value"), (v != 0).alias("some")))
    each = encoded.select("doc_id", F.explode_outer(F.filter(cells, lambda x: x["some"])).alias("c"))
    return each.select("doc_id", "c.slot", "c.value")


@query("hash_embedding", f"WITH {sql_slots('documents')}")
def _(t):
    docs = small_batches(t.documents).select("doc_id", text.normalize_text(F.col("text")).alias("n"))
    return slots_of(docs.select("doc_id", vectors.hash_embedding("n").alias("embedding")))


@query(
    "cosine_similarity",
    """
    SELECT a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) AS cosine
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
    """,
)
def _(t):
    nxt = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return t.embeddings.join(nxt, "vec_id").select(
        "vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine")
    )


@query(
    "jaccard_similarity",
    rf"""
    WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '{TOKEN}')) AS s FROM conversations)
    SELECT a.conv_id, a.turn, round(CASE WHEN len(a.s) = 0 OR len(b.s) = 0 THEN 0.0 ELSE
       len(list_intersect(a.s, b.s))::double / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) END, 6) AS jaccard
    FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
    """,
)
def _(t):
    words = t.conversations.select("conv_id", "turn", text.tokens(F.lower("text")).alias("s"))
    nxt = words.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("s").alias("o"))
    return words.join(nxt, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(vectors.jaccard(F.col("s"), F.col("o")), 6).alias("jaccard")
    )


@query(
    "hamming_distance",
    "SELECT event_id, bit_count(xor(event_id, user_id * 7919))::bigint AS distance FROM events",
)
def _(t):
    return t.events.select(
        "event_id", vectors.hamming(F.col("event_id"), F.col("user_id") * 7919).cast("bigint").alias("distance")
    )


# -- quality -----------------------------------------------------------------------
SQL_FORMAT_LIST = f"""
list_filter([
  CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 'empty body' END,
  CASE WHEN trim(regexp_replace({SQL_TITLE}, '\\s+', ' ', 'g')) = '' THEN 'missing title' END,
  CASE WHEN length(text) > max_chars THEN 'body exceeds max_chars (' || length(text) || ' > ' || max_chars || ')' END
], lambda x: x IS NOT NULL)"""
SQL_LIMIT = sql_case({k: v[0] for k, v in dims.PLATFORMS.items()}, SQL_PLATFORM, "NULL")
SQL_BRAND_LIST = "list_filter([{}, CASE WHEN risk > 0.30::double THEN 'copyright risk too high (' || printf('%.2f', risk) || ')' END], lambda x: x IS NOT NULL)".format(
    ", ".join(f"CASE WHEN contains(lower(text), '{term}') THEN 'banned term: ''{term}''' END" for term in dims.BANNED_TERMS)
)


@query(
    "quality_format_issues",
    f"""
    SELECT doc_id, array_to_string({SQL_FORMAT_LIST}, '; ') AS issues
    FROM (SELECT *, {SQL_LIMIT} AS max_chars FROM documents)
    """,
)
def _(t):
    issues = compliance.format_issues(F.col("title"), F.col("body"), F.col("platform"))
    return with_content(t.documents).select("doc_id", F.array_join(issues, "; ").alias("issues"))


@query(
    "quality_brand_issues",
    f"SELECT doc_id, array_to_string({SQL_BRAND_LIST}, '; ') AS issues FROM (SELECT *, {SQL_RISK} AS risk FROM documents)",
)
def _(t):
    issues = compliance.brand_issues(F.col("body"), F.col("source_url"), F.col("license"))
    return with_content(t.documents).select("doc_id", F.array_join(issues, "; ").alias("issues"))


@query(
    "quality_gate",
    f"""
    SELECT doc_id, len(issues) = 0 AS passed, array_to_string(issues, '; ') AS issues FROM (
      SELECT doc_id, list_concat(list_concat({SQL_FORMAT_LIST},
        CASE WHEN ease < 60 THEN ['readability ' || printf('%.1f', ease) || ' < 60.0'] ELSE [] END), {SQL_BRAND_LIST}) AS issues
      FROM (SELECT *, {SQL_EASE} AS ease FROM
        (SELECT *, {SQL_LIMIT} AS max_chars, {SQL_RISK} AS risk, {SQL_EASE_PARTS} FROM documents)))
    """,
)
def _(t):
    c = F.col
    issues = compliance.quality_issues(c("title"), c("body"), c("platform"), c("source_url"), c("license"))
    return (
        with_content(t.documents)
        .select("doc_id", issues.alias("i"))
        .select("doc_id", (F.size("i") == 0).alias("passed"), F.array_join("i", "; ").alias("issues"))
    )
