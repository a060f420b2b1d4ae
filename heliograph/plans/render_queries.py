"""Templates over parts (as graph nodes) and documents (as content)."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograph.functions import dims
from heliograph.operators import render
from heliograph.plans.registry import query
from heliograph.plans.text_queries import SQL_PLATFORM, SQL_TOKENS, sql_case, with_content

c, lit = F.col, F.lit
EMOTIONS = ("joy", "fear", "anger", "surprise", "sadness", "disgust", "calm")


def part_nodes(t):
    emotion = F.element_at(dims.literal_array(EMOTIONS), (c("p_partkey") % 7 + 1).cast("int"))
    return t.part.select(
        "p_partkey", c("p_name").alias("name"), emotion.alias("emotion"),
        F.array(c("p_brand"), c("p_type"), c("p_name"), c("p_size").cast("string")).alias("tags"),
    )


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


SQL_NODES = f"n AS (SELECT p_partkey, p_name AS name, (['{"','".join(EMOTIONS)}'])[(p_partkey % 7)::int + 1] AS emotion, p_brand AS t1, p_type AS t2, p_name AS t3, p_size::varchar AS t4 FROM part)"
SQL_EMOJI = sql_case({k: q(v) for k, v in dims.EMOTION_EMOJI.items()}, "emotion", q("📝"))


@query(
    "render_blog_template",
    f"""WITH {SQL_NODES}, b AS (SELECT p_partkey, substr({SQL_EMOJI} || ' ' || name || {q(dims.BLOG_TITLE[5:])}, 1, 50) AS title,
      replace(replace({q(dims.BLOG_BODY)}, '%1$s', name), '%2$s', t1 || ', ' || t2 || ', ' || t3) AS body,
      '#' || t1 || ' #' || t2 || ' #' || t3 || ' #' || t4 AS hashtags FROM n)
    SELECT p_partkey, title, body, hashtags, length(body) AS char_count, {SQL_TOKENS.format('body')} AS token_count FROM b""",
)
def _(t):
    made = render.blog(part_nodes(t), lit("blog"))
    return made.select("p_partkey", "title", "body", F.array_join("hashtags", " ").alias("hashtags"), "char_count", "token_count")


@query(
    "render_short_video",
    f"""WITH {SQL_NODES}, h AS (SELECT *, {sql_case({k: q(v) for k, v in dims.VIDEO_HOOKS.items()}, 'emotion', q(dims.VIDEO_HOOK_DEFAULT))} || ' ' || name || '!' AS hook FROM n)
    SELECT p_partkey, name || ' in 60 seconds' AS title, hook || chr(10) || chr(10) || '[generated-offline] ' ||
      substr('Write a 45-second punchy script body about ''' || name || ''' for a short video.', 1, 120) || chr(10) || chr(10) || 'Follow for daily shorts!' AS body,
      replace('#' || t1 || '|#' || t2 || '|#' || t3 || '|#' || t4, ' ', '') AS hashtags FROM h""",
)
def _(t):
    made = render.short_video(part_nodes(t), lit("shorts"))
    return made.select("p_partkey", "title", "body", F.array_join("hashtags", "|").alias("hashtags"))


@query(
    "build_prompt",
    f"""WITH {SQL_NODES} SELECT p_partkey, replace(replace(replace(replace({q(dims.BLOG_PROMPT.replace('주제: %s', '주제: <1>').replace('감정: %s %s', '감정: <2> <3>').replace('키워드: %s', '키워드: <4>'))},
      '<1>', name), '<2>', emotion), '<3>', {SQL_EMOJI}), '<4>', t1 || ', ' || t2 || ', ' || t3 || ', ' || t4) AS prompt FROM n""",
)
def _(t):
    return part_nodes(t).select("p_partkey", render.prompt().alias("prompt"))


@query(
    "content_finalize",
    f"""SELECT doc_id, 'blog' AS format, length(text) AS char_count, {SQL_TOKENS.format('text')} AS token_count,
    {sql_case({k: v[0] for k, v in dims.PLATFORMS.items()}, SQL_PLATFORM, 'NULL')} AS max_chars FROM documents""",
)
def _(t):
    limit = dims.lookup({k: v[0] for k, v in dims.PLATFORMS.items()}, c("platform"))
    made = render.finalize(with_content(t.documents), "blog")
    return made.select("doc_id", "format", "char_count", "token_count", limit.alias("max_chars"))


@query(
    "newsletter_digest",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part)
    SELECT p_brand, {q(dims.DIGEST_SUBTITLE)} || chr(10) || chr(10) ||
      string_agg(rank || '. ' || p_name || chr(10) || '   ' || p_type, chr(10) || chr(10) ORDER BY rank) ||
      chr(10) || chr(10) || '---' || chr(10) || {q(dims.DIGEST_FOOTER)} AS body FROM r WHERE rank <= 5 GROUP BY p_brand""",
)
def _(t):
    made = render.digest(t.part, "p_brand", [F.desc("p_retailprice"), c("p_partkey")], "p_name", "p_type")
    return made.select("p_brand", "body")


SQL_FMT = "(['blog', 'newsletter', 'short_video'])[(doc_id % 3)::int + 1]"


@query(
    "length_validate",
    rf"""SELECT doc_id, format, CASE format WHEN 'blog' THEN length(text) <= ({sql_case(dims.BLOG_MAX_CHARS, 'platform', '5000')})
      WHEN 'newsletter' THEN length(text) <= ({sql_case({k: v[0] for k, v in dims.PLATFORMS.items()}, 'platform', '50000')})
      ELSE len(regexp_extract_all(text, '\S+')) <= 160 END AS ok FROM (SELECT *, {SQL_FMT} AS format, {SQL_PLATFORM} AS platform FROM documents)""",
)
def _(t):
    fmt = F.element_at(dims.literal_array(["blog", "newsletter", "short_video"]), (c("doc_id") % 3 + 1).cast("int"))
    rows = with_content(t.documents).withColumn("format", fmt)
    return rows.select("doc_id", "format", render.length_ok(c("format"), c("body"), c("platform")).alias("ok"))
