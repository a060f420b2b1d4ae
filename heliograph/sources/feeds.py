"""Feed and API payloads to one document schema.

Each parser takes a frame with one payload per row (a whole file or response)
and yields one row per item; the ``read_*`` helpers load such payload files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions import text

DOCUMENT_COLUMNS = "source source_id title text url author language published_at collected_at raw".split()


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One row (payload) per file under ``path``."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("payload"))


def _or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def _first_filled(*cols: Column) -> Column:
    """The first value that is neither NULL nor empty, else the empty string."""
    return _or_empty(F.coalesce(*[F.nullif(c, F.lit("")) for c in cols]))


def _clean(col: Column) -> Column:
    return text.normalize_text(_or_empty(col))


_RSS = (
    "channel struct<item array<struct<title string, description string, summary string, content string, "
    "guid string, link string, author string, pubDate string, updated string>>>, "
    "entry array<struct<title string, summary string, content string, id string, "
    "link struct<_href string, _VALUE string>, author struct<name string>, updated string>>"
)


def parse_rss(payloads: DataFrame, feed_url: str = "") -> DataFrame:
    """RSS 2.0 items, else Atom entries. The id is guid, else link, else title."""
    feed = payloads.select(F.from_xml("payload", _RSS).alias("f"))
    items = feed.filter(F.size("f.channel.item") > 0).select(F.explode("f.channel.item").alias("i"))
    entries = feed.filter(F.coalesce(F.size("f.channel.item"), F.lit(0)) < 1).select(F.explode("f.entry").alias("i"))
    rss = items.select(
        "i.title", _first_filled(F.col("i.description"), F.col("i.summary"), F.col("i.content")).alias("text"),
        "i.guid", _or_empty(F.col("i.link")).alias("link"), "i.author",
        _first_filled(F.col("i.pubDate"), F.col("i.updated")).alias("published_at"),
    )
    # Atom carries the link in an attribute of a namespaced element, which the
    # feed rules do not look up: an entry's id falls through to its title.
    atom = entries.select(
        "i.title", _first_filled(F.col("i.summary"), F.col("i.content")).alias("text"),
        F.lit(None).cast("string").alias("guid"), F.lit("").alias("link"),
        F.lit("").alias("author"), _or_empty(F.col("i.updated")).alias("published_at"),
    )
    cleaned = rss.unionByName(atom).withColumns(
        {c: _clean(F.col(c)) for c in ("title", "text", "guid", "author", "published_at")}
    )
    return cleaned.select(
        F.lit("rss").alias("source"),
        _first_filled(F.col("guid"), F.col("link"), F.col("title")).alias("source_id"),
        "title", "text", F.col("link").alias("url"), "author", "published_at",
        F.create_map(F.lit("feed"), F.lit(feed_url)).alias("raw"),
    )


_REDDIT = (
    "data struct<children array<struct<data struct<id string, name string, title string, selftext string, "
    "permalink string, url string, author string, created_utc double, subreddit string, score bigint>>>>"
)


def parse_reddit(payloads: DataFrame) -> DataFrame:
    """Listing children; the URL is the permalink, else the linked address."""
    posts = payloads.select(F.explode(F.from_json("payload", _REDDIT)["data"]["children"]).alias("c")).select("c.data.*")
    permalink = F.when(_or_empty(F.col("permalink")) != "", F.concat(F.lit("https://reddit.com"), "permalink"))
    return posts.select(
        F.lit("reddit").alias("source"),
        _or_empty(F.coalesce("id", "name")).alias("source_id"),
        _clean(F.col("title")).alias("title"),
        _clean(F.col("selftext")).alias("text"),
        # Link posts carry no text of their own; the address stands in for it.
        _first_filled(F.col("selftext"), F.col("url")).alias("body"),
        F.coalesce(permalink, _or_empty(F.col("url"))).alias("url"),
        _or_empty(F.col("author")).alias("author"),
        F.timestamp_seconds("created_utc").alias("published_at"),
        F.create_map(
            F.lit("subreddit"), _or_empty(F.col("subreddit")),
            F.lit("score"), F.coalesce("score", F.lit(0)).cast("string"),
        ).alias("raw"),
    )


_SEARCH = (
    "items array<struct<id string, etag string, snippet struct<title string, description string, "
    "channelTitle string, channelId string, publishedAt string>>>"
)


def parse_youtube_search(payloads: DataFrame) -> DataFrame:
    """Search hits; ``id`` is an object holding videoId, or the id itself."""
    hits = payloads.select(F.explode(F.from_json("payload", _SEARCH)["items"]).alias("i")).select("i.*")
    video = _or_empty(F.when(F.col("id").startswith("{"), F.get_json_object("id", "$.videoId")).otherwise(F.col("id")))
    return hits.withColumn("video", video).select(
        F.lit("youtube").alias("source"),
        _first_filled(F.col("video"), F.col("etag")).alias("source_id"),
        _clean(F.col("snippet.title")).alias("title"),
        _clean(F.col("snippet.description")).alias("text"),
        F.when(F.col("video") != "", F.concat(F.lit("https://www.youtube.com/watch?v="), "video"))
        .otherwise("").alias("url"),
        _or_empty(F.col("snippet.channelTitle")).alias("author"),
        _or_empty(F.col("snippet.publishedAt")).alias("published_at"),
        F.create_map(F.lit("channel_id"), _or_empty(F.col("snippet.channelId"))).alias("raw"),
    )


_DETAIL = (
    "items array<struct<id string, snippet struct<title string, description string, channelTitle string, "
    "publishedAt string>, statistics struct<viewCount string, likeCount string, commentCount string>, "
    "contentDetails struct<duration string>>>"
)


def parse_youtube_detail(payloads: DataFrame, default_time: Column) -> DataFrame:
    """Video details with counts; an unreadable date becomes ``default_time``."""
    items = payloads.select(F.explode(F.from_json("payload", _DETAIL)["items"]).alias("i")).select("i.*")

    def count(name: str) -> Column:
        return F.coalesce(F.col(f"statistics.{name}").try_cast("bigint"), F.lit(0).cast("bigint"))

    return items.select(
        F.lit("youtube").alias("source"),
        F.col("id").alias("source_id"),
        _or_empty(F.col("snippet.title")).alias("title"),
        _or_empty(F.col("snippet.description")).alias("text"),
        F.concat(F.lit("https://youtube.com/watch?v="), "id").alias("url"),
        _or_empty(F.col("snippet.channelTitle")).alias("author"),
        F.coalesce(F.col("snippet.publishedAt").try_cast("timestamp"), default_time.cast("timestamp")).alias("published_at"),
        count("viewCount").alias("view_count"),
        count("likeCount").alias("like_count"),
        count("commentCount").alias("comment_count"),
        _or_empty(F.col("contentDetails.duration")).alias("duration"),
    )


_NAVER = "items array<struct<title string, link string, description string, bloggername string, postdate string>>"


def parse_naver(payloads: DataFrame, default_time: Column) -> DataFrame:
    """Blog search items; markup is stripped and ``postdate`` is yyyyMMdd."""
    items = payloads.select(F.explode(F.from_json("payload", _NAVER)["items"]).alias("i")).select("i.*")
    posted = F.try_to_timestamp("postdate", F.lit("yyyyMMdd"))
    return items.select(
        F.lit("naver_blog").alias("source"),
        _or_empty(F.col("link")).alias("url"),
        text.strip_html(F.col("title")).alias("title"),
        text.strip_html(F.col("description")).alias("text"),
        _or_empty(F.col("bloggername")).alias("author"),
        F.coalesce(posted, default_time.cast("timestamp")).alias("published_at"),
        F.lit("ko").alias("language"),
    )


def union_documents(*frames: DataFrame) -> DataFrame:
    """Frames of either document shape (text / body, language / lang) in one schema."""

    def canonical(df: DataFrame) -> DataFrame:
        renamed = df.withColumnsRenamed(
            {old: new for old, new in (("body", "text"), ("lang", "language")) if new not in df.columns}
        )
        for name in DOCUMENT_COLUMNS:
            if name not in renamed.columns:
                kind = "map<string,string>" if name == "raw" else "string"
                renamed = renamed.withColumn(name, F.lit(None).cast(kind))
        plain = [F.col(c).cast("string").alias(c) for c in DOCUMENT_COLUMNS if c != "raw"]
        return renamed.select(*plain, "raw")

    return reduce(DataFrame.unionByName, map(canonical, frames))
