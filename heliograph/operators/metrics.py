"""Metric log reads, histograms and quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def latest(log: DataFrame, key: str = "content_id", *order: str) -> DataFrame:
    """The last snapshot per key by the given order columns."""
    rest = [c for c in log.columns if c != key]
    best = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(key, "r.*")


def time_series(log: DataFrame, content_id, days: int | None = None) -> DataFrame:
    """All snapshots of an id in time order; ``days`` keeps those of the last days
    before its newest one."""
    rows = log.filter(F.col("content_id") == content_id)
    if days is not None:
        newest = rows.agg(F.max("ts")).scalar()
        rows = rows.filter(F.col("ts") >= newest - F.make_dt_interval(F.lit(days)))
    return rows.orderBy("ts")


def cumulative_histogram(df: DataFrame, value: str, bounds, *by: str) -> DataFrame:
    """(by…, le, n): rows at or under each bound, +Inf last; one aggregation."""
    edges = [float(b) for b in bounds] + [float("inf")]
    sums = [F.count_if(F.col(value) <= F.lit(e)).alias(f"b{i}") for i, e in enumerate(edges)]
    wide = df.groupBy(*by).agg(*sums)
    cells = F.array(*[F.struct(F.lit(e).alias("le"), F.col(f"b{i}").alias("n")) for i, e in enumerate(edges)])
    return wide.select(*by, F.explode(cells).alias("c")).select(*by, "c.*")


def histogram_quantile(hist: DataFrame, q: float, *by: str) -> DataFrame:
    """(by…, quantile): linear within the first bucket reaching q of the total; a
    quantile in the +Inf bucket is the greatest finite bound."""
    order = W.partitionBy(*by).orderBy("le")
    rows = hist.withColumns(
        {
            "_lo": F.coalesce(F.lag("le").over(order), F.lit(0.0)),
            "_before": F.coalesce(F.lag("n").over(order), F.lit(0)),
            "_total": F.max("n").over(W.partitionBy(*by)),
        }
    )
    target = F.col("_total") * q
    inside = F.col("_lo") + (F.col("le") - F.col("_lo")) * (target - F.col("_before")) / F.nullif(F.col("n") - F.col("_before"), F.lit(0))
    value = F.when(F.col("le") == float("inf"), F.col("_lo")).otherwise(inside)
    hit = rows.filter((F.col("_total") > 0) & (F.col("n") >= target))
    return hit.groupBy(*by).agg(F.min_by(value, "le").alias("quantile"))


def snapshot(gauges: DataFrame, counters: DataFrame) -> DataFrame:
    """(metric, value): the latest value of gauges, sums over labels of counters."""
    last = gauges.groupBy("metric").agg(F.max_by("value", "seq").alias("value"))
    total = counters.groupBy("metric").agg(F.sum("value").alias("value"))
    return last.unionByName(total)


def sliding_rate(events: DataFrame, label: str, window: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """(label, start, per_second): rows per second over a sliding window; works on
    streams (with a watermark) and tables alike."""
    spans = F.window("ts", window, slide)
    counted = events.groupBy(spans, label).agg(F.count("*").alias("n"))
    seconds = F.unix_seconds("window.end") - F.unix_seconds("window.start")
    return counted.select(label, F.col("window.start").alias("start"), (F.col("n") / seconds).alias("per_second"))
