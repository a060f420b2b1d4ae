"""Metric log, dashboards and histograms over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograph.functions import dims
from heliograph.operators import metrics
from heliograph.plans.registry import query
from heliograph.plans.source_queries import metric_events

c, lit = F.col, F.lit
STAMP = "yyyy-MM-dd HH:mm:ss"


@query(
    "metrics_latest",
    """SELECT user_id::varchar AS content_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts,
    arg_max((event_type IN ('view', 'click'))::int, (ts, event_id)) AS views FROM events GROUP BY user_id""",
)
def _(t):
    last = metrics.latest(metric_events(t).select("content_id", "ts", "event_id", "views"), "content_id", "ts", "event_id")
    return last.select("content_id", F.date_format("ts", STAMP).alias("ts"), "views")


@query(
    "metrics_time_series",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, (event_type = 'click')::int AS clicks FROM events
    WHERE user_id = 7 AND ts >= (SELECT max(ts) FROM events WHERE user_id = 7) - INTERVAL 10 DAY""",
)
def _(t):
    series = metrics.time_series(metric_events(t), "7", days=10)
    return series.select("event_id", F.date_format("ts", STAMP).alias("ts"), "clicks")


@query(
    "run_label_counts",
    """
    SELECT 'run' AS metric, event_type AS label, (event_type = 'error')::varchar AS status, count(*) AS n FROM events GROUP BY ALL
    UNION ALL SELECT 'content', (['blog','youtube','instagram','newsletter','shorts'])[(user_id % 5)::int + 1], (value > 50)::varchar, count(*) FROM events GROUP BY ALL
    UNION ALL SELECT 'documents', source, (n_chars > 0)::varchar, count(*) FROM documents GROUP BY ALL
    """,
)
def _(t):
    def tally(df, metric, label, status):
        grouped = df.groupBy(label.alias("label"), status.cast("string").alias("status"))
        return grouped.agg(F.count("*").alias("n")).select(lit(metric).alias("metric"), "label", "status", "n")

    platform = F.element_at(dims.literal_array(dims.CTR_PRIORS), (c("user_id") % 5 + 1).cast("int"))
    return (
        tally(t.events, "run", c("event_type"), c("event_type") == "error")
        .unionByName(tally(t.events, "content", platform, c("value") > 50))
        .unionByName(tally(t.documents, "documents", c("source"), c("n_chars") > 0))
    )


SQL_LE = ", ".join([f"({b}::double)" for b in dims.RUN_BUCKETS] + ["('inf'::double)"])
SQL_HIST = f"""
WITH le(le) AS (VALUES {SQL_LE}), hist AS (SELECT event_type, le, count(*) FILTER (value <= le) AS n FROM events, le GROUP BY ALL)
"""


@query("duration_histogram", SQL_HIST + "SELECT event_type, le::varchar AS le, n FROM hist")
def _(t):
    hist = metrics.cumulative_histogram(t.events, "value", dims.RUN_BUCKETS, "event_type")
    shown = F.when(c("le") == float("inf"), "inf").otherwise(c("le").cast("string"))
    return hist.withColumn("le", shown)


@query(
    "histogram_p95",
    SQL_HIST + """
    , b AS (SELECT *, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(n) OVER w, 0) AS before, max(n) OVER (PARTITION BY event_type) AS total
            FROM hist WINDOW w AS (PARTITION BY event_type ORDER BY le)),
    p AS (SELECT event_type, arg_min(CASE WHEN le = 'inf'::double THEN lo ELSE lo + (le - lo) * (0.95 * total - before) / (n - before) END, le) AS q
          FROM b WHERE n >= 0.95 * total GROUP BY 1)
    SELECT event_type, round(q, 6) AS p95 FROM p
    """,
)
def _(t):
    hist = metrics.cumulative_histogram(t.events, "value", dims.RUN_BUCKETS, "event_type")
    return metrics.histogram_quantile(hist, 0.95, "event_type").select("event_type", F.round("quantile", 6).alias("p95"))


@query(
    "metrics_snapshot",
    """
    SELECT 'gauge_' || event_type AS metric, arg_max(value, event_id) AS value FROM events GROUP BY event_type
    UNION ALL SELECT 'total_' || event_type, count(*)::double FROM events GROUP BY event_type
    """,
)
def _(t):
    gauges = t.events.select(F.concat(lit("gauge_"), "event_type").alias("metric"), "value", c("event_id").alias("seq"))
    counters = t.events.select(F.concat(lit("total_"), "event_type").alias("metric"), lit(1.0).alias("value"))
    return metrics.snapshot(gauges, counters)
