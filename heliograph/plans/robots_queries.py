"""Crawl permission of every page under robots files derived per host."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograph.operators import compliance
from heliograph.plans.registry import query

c, lit = F.col, F.lit
AGENT = "hg-bot/1.0"


def hosts(t):
    return t.pages.select(compliance.url_host(c("url")).alias("host")).distinct()


def robots(t):
    """.net hosts name the agent, .org hosts allow one folder, www hosts set a delay."""
    body = (
        F.when(c("host").endswith(".net"), lit("User-agent: HG-Bot\nDisallow: /fr # none\nCrawl-delay: 5\n\nUser-agent: *\nDisallow: /\n"))
        .when(c("host").endswith(".org"), lit("User-agent: *\nAllow: /en\nDisallow: /\n"))
        .when(c("host").startswith("www."), F.concat(lit("User-agent: *\nDisallow:\nCrawl-delay: "), F.length("host")))
    )
    return hosts(t).withColumn("robots", body).filter("robots IS NOT NULL")


SQL_HOSTS = """
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_replace(url, '^[a-z]+://[^/?#]*', '') AS path FROM pages)
"""


@query(
    "robots_filter",
    SQL_HOSTS + """SELECT page_id, CASE WHEN host LIKE '%.net' THEN NOT starts_with(path, '/fr') WHEN host LIKE '%.org' THEN starts_with(path, '/en')
    ELSE true END AS allowed FROM p""",
)
def _(t):
    rules = compliance.robots_rules(robots(t), AGENT)
    return compliance.robots_allowed(t.pages.select("page_id", "url"), rules).select("page_id", "allowed")


@query(
    "crawl_delay",
    SQL_HOSTS + """SELECT DISTINCT host, CASE WHEN host LIKE '%.net' THEN 5.0::double WHEN host LIKE '%.org' THEN 1.0
    WHEN host LIKE 'www.%' THEN length(host)::double ELSE 1.0 END AS crawl_delay FROM p""",
)
def _(t):
    return compliance.crawl_delays(hosts(t), compliance.robots_rules(robots(t), AGENT))
