"""Feed payloads, logs and stores. Payloads are built from the driver tables, so
the parsers read as many items as the tables hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograph.functions import text, vectors
from heliograph.operators import graph
from heliograph.plans import star_graph
from heliograph.plans.graph_queries import node_log
from heliograph.plans.registry import query
from heliograph.plans.star_graph import SQL as G
from heliograph.plans.text_queries import NORM, PLATFORM_NAMES, SQL_TITLE, SQUASH, slots_of, sql_slots
from heliograph.sources import feeds, stores
from heliograph.session import bounded_tasks, cut_lineage, scratch, small_batches

c, lit = F.col, F.lit
TITLE = SQUASH.format(SQL_TITLE)


def payloads(df, *fields):
    return df.select(F.to_json(F.struct(*fields)).alias("payload"))


def title():
    return F.substring_index("text", "\n", 1)


@query(
    "seed_graph_load",
    """
    SELECT 'node' AS kind, 'product:' || p_partkey AS key, p_name AS label, CASE WHEN p_size > 10 THEN p_size / 50.0 ELSE 1.0 END AS weight FROM part
    UNION ALL
    SELECT 'edge', 'supplier:' || s_suppkey, CASE WHEN s_acctbal > 5000 THEN 'causes' ELSE 'leads_to' END,
           CASE WHEN s_acctbal > 5000 THEN 0.8 WHEN s_acctbal > 0 THEN 0.25 ELSE 0.6 END FROM supplier
    """,
)
def _(t):
    node = F.struct(
        F.concat(lit("product:"), "p_partkey").alias("id"), lit("product").alias("type"), c("p_name").alias("name"),
        F.when(c("p_size") > 10, c("p_size") / 50.0).alias("weight"),
    )
    rich = c("s_acctbal") > 5000
    edge = F.struct(
        F.concat(lit("supplier:"), "s_suppkey").alias("from_node"), F.concat(lit("nation:"), "s_nationkey").alias("to_node"),
        F.when(rich, "causes").otherwise("leads_to").alias("relation_type"),
        F.when(~rich & (c("s_acctbal") > 0), 0.25).alias("weight"),
    )
    n = stores.load_seed_nodes(payloads(t.part, F.array(node).alias("nodes")))
    e = stores.load_seed_edges(payloads(t.supplier, F.array(edge).alias("edges")))
    return n.select(lit("node").alias("kind"), c("id").alias("key"), c("name").alias("label"), "weight").unionByName(
        e.select(lit("edge").alias("kind"), c("from_node").alias("key"), c("relation_type").alias("label"), "weight")
    )


def _xml(col):
    return F.replace(F.replace(F.replace(col, lit("&"), lit("&amp;")), lit("<"), lit("&lt;")), lit(">"), lit("&gt;"))


@query(
    "rss_parse",
    f"""
    SELECT CASE doc_id % 4 WHEN 0 THEN 'g' || doc_id WHEN 1 THEN 'https://example.org/' || doc_id ELSE {TITLE} END AS source_id,
           {TITLE} AS title, {NORM} AS text, CASE WHEN doc_id % 4 < 2 THEN 'https://example.org/' || doc_id ELSE '' END AS url
    FROM documents
    """,
)
def _(t):
    kind = c("doc_id") % 4
    head = F.concat(lit("<title>"), _xml(title()), lit("</title>"))
    link = F.concat(lit("https://example.org/"), "doc_id")
    rss_link = F.when(kind < 2, F.concat(lit("<link>"), link, lit("</link>"))).otherwise("")
    guid = F.when(kind == 0, F.concat(lit("<guid>g"), "doc_id", lit("</guid>"))).otherwise("")
    rss = F.concat(
        lit("<rss><channel><item>"), head, lit("<description>"), _xml(c("text")), lit("</description>"), rss_link, guid,
        lit("</item></channel></rss>"),
    )
    atom = F.concat(
        lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry>'), head, lit('<link href="'), link, lit('"/><summary>'),
        _xml(c("text")), lit("</summary></entry></feed>"),
    )
    docs = t.documents.select(F.when(kind < 3, rss).otherwise(atom).alias("payload"))
    return feeds.parse_rss(docs).select("source_id", "title", "text", "url")


@query(
    "reddit_listing_parse",
    f"""
    SELECT 't' || doc_id AS source_id, {TITLE} AS title, CASE WHEN doc_id % 2 = 0 THEN {NORM} ELSE '' END AS text,
           CASE WHEN doc_id % 2 = 0 THEN 'https://reddit.com/r/' || lang || '/' || doc_id ELSE 'https://example.org/' || doc_id END AS url,
           strftime(make_timestamp((1700000000 + doc_id) * 1000000), '%Y-%m-%d %H:%M:%S') AS published_at, n_chars::varchar AS score
    FROM documents
    """,
)
def _(t):
    own = c("doc_id") % 2 == 0
    post = F.struct(
        F.concat(lit("t"), "doc_id").alias("id"), title().alias("title"), F.when(own, c("text")).alias("selftext"),
        F.when(own, F.concat(lit("/r/"), "lang", lit("/"), "doc_id")).alias("permalink"),
        F.concat(lit("https://example.org/"), "doc_id").alias("url"), (1700000000 + c("doc_id")).alias("created_utc"),
        c("lang").alias("subreddit"), c("n_chars").alias("score"),
    )
    listing = payloads(t.documents, F.struct(F.array(F.struct(post.alias("data"))).alias("children")).alias("data"))
    return feeds.parse_reddit(listing).select(
        "source_id", "title", "text", "url", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"),
        F.element_at("raw", "score").alias("score"),
    )


def _snippet(t):
    return F.struct(title().alias("title"), c("text").alias("description"), c("source").alias("channelTitle"),
                    c("lang").alias("channelId"), lit("2024-01-05T00:00:00Z").alias("publishedAt"))


@query(
    "youtube_search_parse",
    f"""
    SELECT CASE WHEN doc_id % 3 = 2 THEN 'e' || doc_id ELSE 'v' || doc_id END AS source_id, {TITLE} AS title, {NORM} AS text,
           CASE WHEN doc_id % 3 = 2 THEN '' ELSE 'https://www.youtube.com/watch?v=v' || doc_id END AS url, source AS author
    FROM documents
    """,
)
def _(t):
    kind, video = c("doc_id") % 3, F.concat(lit("v"), "doc_id")
    as_object = F.struct(F.array(F.struct(
        F.struct(F.when(kind == 0, video).alias("videoId")).alias("id"), F.concat(lit("e"), "doc_id").alias("etag"),
        _snippet(t).alias("snippet"))).alias("items"))
    as_text = F.struct(F.array(F.struct(video.alias("id"), _snippet(t).alias("snippet"))).alias("items"))
    docs = t.documents.select(F.when(kind == 1, F.to_json(as_text)).otherwise(F.to_json(as_object)).alias("payload"))
    return feeds.parse_youtube_search(docs).select("source_id", "title", "text", "url", "author")


@query(
    "youtube_detail_parse",
    f"""
    SELECT 'v' || doc_id AS source_id, {SQL_TITLE} AS title, n_chars AS view_count, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE doc_id END AS like_count,
           CASE WHEN doc_id % 5 = 0 THEN '2024-02-01 00:00:00' ELSE '2024-01-05 10:00:00' END AS published_at
    FROM documents
    """,
)
def _(t):
    snippet = F.struct(title().alias("title"), c("text").alias("description"), c("source").alias("channelTitle"),
                       F.when(c("doc_id") % 5 == 0, "not a date").otherwise("2024-01-05T10:00:00Z").alias("publishedAt"))
    stats = F.struct(c("n_chars").cast("string").alias("viewCount"),
                     F.when(c("doc_id") % 4 != 0, c("doc_id").cast("string")).alias("likeCount"))
    item = F.struct(F.concat(lit("v"), "doc_id").alias("id"), snippet.alias("snippet"), stats.alias("statistics"))
    parsed = feeds.parse_youtube_detail(payloads(t.documents, F.array(item).alias("items")), lit("2024-02-01 00:00:00"))
    return parsed.select("source_id", "title", "view_count", "like_count",
                         F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"))


# The pages and documents hold these entities only.
SQL_UNESCAPE = ("replace(replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&'), "
                "'&amp', '&')")


@query(
    "naver_blog_parse",
    f"""
    SELECT 'https://example.org/' || doc_id AS url, trim(regexp_replace({SQL_TITLE}, '<[^>]+>', '', 'g')) AS title,
           regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '^\\s+|\\s+$', '', 'g') AS text, source AS author,
           CASE WHEN doc_id % 7 = 0 THEN '2024-02-01' ELSE '2024-01-' || lpad((doc_id % 28 + 1)::varchar, 2, '0') END AS posted
    FROM documents
    """,
)
def _(t):
    day = F.concat(lit("202401"), F.lpad((c("doc_id") % 28 + 1).cast("string"), 2, "0"))
    item = F.struct(
        F.concat(lit("<b>"), _xml_amp(title()), lit("</b>")).alias("title"), F.concat(lit("https://example.org/"), "doc_id").alias("link"),
        _xml_amp(c("text")).alias("description"), c("source").alias("bloggername"),
        F.when(c("doc_id") % 7 == 0, "soon").otherwise(day).alias("postdate"),
    )
    parsed = feeds.parse_naver(payloads(t.documents, F.array(item).alias("items")), lit("2024-02-01 00:00:00"))
    return parsed.select("url", "title", "text", "author", F.date_format("published_at", "yyyy-MM-dd").alias("posted"))


def _xml_amp(col):
    return F.replace(col, lit("&"), lit("&amp;"))


SQL_STRIP = f"regexp_replace({SQL_UNESCAPE.format("regexp_replace(html, '<[^>]+>', '', 'g')")}, '^\\s+|\\s+$', '', 'g')"


@query("strip_html_pages", f"SELECT page_id, {SQL_STRIP} AS text FROM pages")
def _(t):
    return t.pages.select("page_id", text.strip_html(c("html")).alias("text"))


@query(
    "raw_document_union",
    f"""
    SELECT source, 'd' || doc_id AS source_id, {SQL_TITLE} AS title, text, NULL AS url, lang AS language FROM documents
    UNION ALL SELECT 'page', 'p' || page_id, '', html, url, NULL FROM pages
    """,
)
def _(t):
    docs = t.documents.select("source", F.concat(lit("d"), "doc_id").alias("source_id"), title().alias("title"),
                              c("text").alias("body"), "lang")
    pages = t.pages.select(lit("page").alias("source"), F.concat(lit("p"), "page_id").alias("source_id"),
                           lit("").alias("title"), c("html").alias("text"), "url")
    return feeds.union_documents(docs, pages).select("source", "source_id", "title", "text", "url", "language")


# -- logs and stores ------------------------------------------------------------------
def metric_events(t, *further):
    """Events as metric snapshots of a user's content, with ``further`` columns."""
    e = t.events
    platform = F.element_at(F.array(*[lit(p) for p in PLATFORM_NAMES]), (c("user_id") % 5 + 1).cast("int"))
    return e.select(
        c("user_id").cast("string").alias("content_id"), platform.alias("platform"), "ts", "event_id",
        c("event_type").isin("view", "click").cast("int").alias("views"), (c("event_type") == "click").cast("int").alias("clicks"),
        F.when(c("event_type") == "purchase", c("value")).alias("revenue_est"), c("props").alias("unknown_key"), *further,
    )


SQL_METRICS = """
SELECT user_id::varchar AS content_id, (['blog','youtube','instagram','newsletter','shorts'])[(user_id % 5)::int + 1] AS platform,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, (event_type IN ('view', 'click'))::int::double AS views,
       (event_type = 'click')::int::double AS clicks, CASE WHEN event_type = 'purchase' THEN value END AS revenue_est FROM events
"""


@query("metrics_append", SQL_METRICS)
def _(t):
    path = scratch(t.spark, "metrics")
    stores.append_metrics(metric_events(t), path)
    return stores.read_metrics(t.spark, path).select(
        "content_id", "platform", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "views", "clicks", "revenue_est"
    )


@query(
    "dlq_quarantine",
    """SELECT event_id, 'unknown event type: ' || event_type AS error, 0 AS retries, value
    FROM events WHERE event_type NOT IN ('signup', 'view', 'click', 'purchase')""",
)
def _(t):
    path = scratch(t.spark, "dead-letters")
    valid = c("event_type").isin("signup", "view", "click", "purchase")
    stores.quarantine(t.events, valid, F.concat(lit("unknown event type: "), "event_type"), path)
    item = F.from_json("payload", "event_id bigint, value double")
    return stores.drain(t.spark, path).select(item["event_id"].alias("event_id"), "error", "retries", item["value"].alias("value"))


@query(
    "graph_persist",
    f"""WITH {G}
    SELECT 'node' AS kind, n.id AS key, coalesce('renamed ' || s_name, n.name) AS label, coalesce(s_acctbal / 10000.0, n.weight) AS weight
    FROM nodes n LEFT JOIN supplier ON n.id = 'entity:supplier_' || s_suppkey
    UNION ALL SELECT 'edge', from_node || '->' || to_node || ':' || relation_type, relation_type,
      CASE WHEN relation_type = 'monetizes_via' THEN weight / 2 ELSE weight END FROM edges""",
)
def _(t):
    path = scratch(t.spark, "graph-log")
    nodes = node_log(t).drop("embedding")
    stores.append_graph(nodes.filter("seq = 1"), f"{path}/nodes")
    stores.append_graph(nodes.filter("seq = 2"), f"{path}/nodes")
    with bounded_tasks(t.spark, 2 * t.lineitem.count()):
        e = cut_lineage(star_graph.edges(t))
        stores.append_graph(e.withColumn("seq", lit(1)), f"{path}/edges")
        sold = e.filter("relation_type = 'monetizes_via'")
        stores.append_graph(sold.withColumns({"weight": c("weight") / 2, "seq": lit(2)}), f"{path}/edges")
        n2 = cut_lineage(stores.current_graph(t.spark.read.parquet(f"{path}/nodes"), ["id"]))
        e2 = cut_lineage(stores.current_graph(t.spark.read.parquet(f"{path}/edges"), graph.EDGE_KEY))
    return n2.select(lit("node").alias("kind"), c("id").alias("key"), c("name").alias("label"), "weight").unionByName(
        e2.select(lit("edge").alias("kind"), text.edge_id(c("from_node"), c("to_node"), c("relation_type")).alias("key"),
                  c("relation_type").alias("label"), "weight")
    )


@query(
    "node_upsert_overwrite",
    """
    SELECT 'vec_' || vec_id AS node_id, CASE WHEN label = 0 THEN 'second' ELSE 'first' END AS name,
           CASE WHEN label = 0 THEN 0.5 ELSE 1.0 END::double AS weight, len(embedding)::bigint AS dim,
           round((CASE WHEN label = 0 THEN embedding[64] ELSE embedding[1] END)::double, 6) AS head FROM embeddings
    """,
)
def _(t):
    base = t.embeddings.select(F.concat(lit("vec_"), "vec_id").alias("node_id"), "label", "embedding")
    first = base.select("node_id", lit("first").alias("name"), lit(1.0).alias("weight"), "embedding", lit(1).alias("seq"))
    second = base.filter("label = 0").select(
        "node_id", lit("second").alias("name"), lit(0.5).alias("weight"), F.reverse("embedding").alias("embedding"), lit(2).alias("seq")
    )
    current = stores.current_graph(first.unionByName(second), ["node_id"])
    return current.select("node_id", "name", "weight", F.size("embedding").cast("bigint").alias("dim"),
                          F.round(F.element_at("embedding", 1).cast("double"), 6).alias("head"))


@query(
    "content_save",
    f"""SELECT doc_id::varchar AS content_id, {SQL_TITLE} AS title, 'draft' AS status, source AS platform, n_chars, text AS body FROM documents""",
)
def _(t):
    path = scratch(t.spark, "content")
    items = t.documents.select(c("doc_id").cast("string").alias("content_id"), title().alias("title"), c("text").alias("body"),
                               c("source").alias("platform"), "n_chars")
    stores.save_content(items, path)
    saved = t.spark.read.parquet(path)
    body = F.get_json_object("payload", "$.body")
    return saved.select("content_id", "title", "status", "platform", "n_chars", body.alias("body"))


@query(
    "content_status_update",
    """
    SELECT user_id AS content_id, arg_max(event_type, event_id) AS status,
           arg_max(props, event_id) FILTER (event_type IN ('purchase', 'error')) AS payload FROM events GROUP BY user_id
    """,
)
def _(t):
    log = t.events.select(
        c("user_id").alias("content_id"), c("event_id").alias("seq"), c("event_type").alias("status"),
        F.when(c("event_type") == "purchase", c("props")).alias("result"), F.when(c("event_type") == "error", c("props")).alias("error"),
    )
    return stores.content_state(log)


HISTORY_SQL = """
SELECT o_orderkey AS content_id, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS created_at
FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1997-01-01' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50
"""


@query("content_history", HISTORY_SQL)
def _(t):
    rows = t.orders.select(c("o_orderkey").alias("content_id"), c("o_orderstatus").alias("status"), c("o_orderdate").alias("created_at"))
    newest = stores.content_history(rows, limit=50, status="F", since="1997-01-01")
    return newest.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd"))


@query("content_counts", "SELECT coalesce(o_orderstatus, 'total') AS status, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus)")
def _(t):
    counted = t.orders.rollup("o_orderstatus").agg(F.count("*").alias("n"), F.grouping("o_orderstatus").alias("g"))
    return counted.select(F.when(c("g") == 1, "total").otherwise(c("o_orderstatus")).alias("status"), "n")


# -- dimension payloads ------------------------------------------------------------------
def part_aliases(t):
    meta = F.struct(F.concat(lit("Q"), "p_partkey").alias("qid"), c("p_brand").alias("canonical"))
    one = t.part.select("p_partkey", F.to_json(F.create_map(F.upper("p_name"), meta)).alias("payload"))
    return stores.load_aliases(one, c("p_partkey"))


SQL_ALIASES = """
loaded AS (SELECT lower(p_name) AS surface, 'Q' || arg_max(p_partkey, p_partkey) AS qid, arg_max(p_brand, p_partkey) AS canonical FROM part GROUP BY 1),
aliases AS (SELECT * FROM loaded UNION ALL SELECT * FROM (VALUES ('openai','Q21708200','OpenAI'), ('open ai','Q21708200','OpenAI'),
  ('nvidia','Q182477','Nvidia'), ('google','Q95','Google'), ('alphabet inc','Q20800404','Alphabet Inc.')) b(surface, qid, canonical)
  WHERE surface NOT IN (SELECT surface FROM loaded))
"""


@query("alias_dict_load", f"WITH {SQL_ALIASES} SELECT * FROM aliases")
def _(t):
    return part_aliases(t)


@query("embedding_cache_fill", f"WITH {sql_slots('(SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))')}")
def _(t):
    cached = t.labels.select("doc_id")
    missing = small_batches(t.documents).select("doc_id", "text").join(cached, "doc_id", "left_anti")
    path = scratch(t.spark, "embeddings")
    encoded = missing.select("doc_id", vectors.hash_embedding(text.normalize_text(c("text"))).alias("embedding"))
    encoded.filter(F.size("embedding") == vectors.EMBED_DIM).write.mode("append").parquet(path)
    return slots_of(t.spark.read.parquet(path))


@query(
    "cpm_dim_load",
    "SELECT (['blog','youtube','instagram','newsletter','shorts'])[(user_id % 5)::int + 1] AS platform, round(avg(value), 6) AS cpm FROM events GROUP BY 1",
)
def _(t):
    means = metric_events(t, "value").groupBy("platform").agg(F.avg("value").alias("v"))
    one = means.select(F.to_json(F.struct(F.create_map("platform", "v").alias("cpm_by_platform"))).alias("payload"))
    return stores.load_cpm(one).select("platform", F.round("cpm", 6).alias("cpm"))
