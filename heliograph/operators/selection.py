"""Ranking, selection, portfolio weights and online weight updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from heliograph.functions import dims, scoring, stats
from heliograph.functions.text import clamp
from heliograph.operators.common import minmax_scaled, prefix_sum


# -- CTR posterior ------------------------------------------------------------------
def ctr_priors(spark) -> DataFrame:
    rows = [(p, a, b) for p, (a, b) in dims.CTR_PRIORS.items()]
    return spark.createDataFrame(rows, "platform string, alpha double, beta double")


def ctr_posterior(log: DataFrame) -> DataFrame:
    """(platform, clicks, impressions) rows over the priors; rows that break
    0 <= clicks <= impressions are left out."""
    valid = log.filter("clicks >= 0 AND clicks <= impressions")
    seen = valid.groupBy("platform").agg(F.sum("clicks").alias("c"), F.sum("impressions").alias("i"))
    return posterior_from_counts(seen)


def posterior_from_counts(seen: DataFrame) -> DataFrame:
    alpha, beta = dims.DEFAULT_CTR_PRIOR
    joined = seen.join(ctr_priors(seen.sparkSession), "platform", "full_outer")
    clicks, shown = F.coalesce("c", F.lit(0)), F.coalesce("i", F.lit(0))
    return joined.select(
        "platform",
        (F.coalesce("alpha", F.lit(alpha)) + clicks).alias("alpha"),
        (F.coalesce("beta", F.lit(beta)) + shown - clicks).alias("beta"),
    )


# -- ranking ------------------------------------------------------------------------
def graph_score_of(df: DataFrame) -> Column:
    cols = [F.col(c) for c in ("score", "graph_score") if c in df.columns]
    return F.coalesce(*cols, F.lit(0.0))


def above_threshold(df: DataFrame, floor: float = dims.MIN_GRAPH_SCORE) -> DataFrame:
    return df.filter(graph_score_of(df) >= floor)


def rank_blend(df: DataFrame) -> DataFrame:
    """Adds ``final_score`` from the min-max scaled score families."""
    ready = df.withColumn("_graph", graph_score_of(df)).withColumns(
        {
            f"_{n}": F.coalesce(F.col(f"{n}_score"), F.lit(0.0)) if f"{n}_score" in df.columns else F.lit(0.0)
            for n in ("revenue", "probability")
        }
    )
    scaled = minmax_scaled(ready, {f"_{n}": f"_{n}_s" for n in dims.RANK_BLEND})
    total = sum((F.col(f"_{n}_s") * w for n, w in dims.RANK_BLEND.items()), F.lit(0.0))
    drop = [f"_{n}" for n in dims.RANK_BLEND] + [f"_{n}_s" for n in dims.RANK_BLEND]
    return scaled.withColumn("final_score", total).drop(*drop)


def top_k(df: DataFrame, k: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(max(0, k))


# -- selection ------------------------------------------------------------------------
def thompson_value(df: DataFrame, key: str, seed: int | None) -> DataFrame:
    """Adds ``value`` = Beta(success, fail) draw x score; with no seed, the mean.

    The draw is fixed by (seed, key), so a retried task repeats it.
    """
    one = F.lit(1.0)
    success = F.greatest(F.coalesce(F.col("success"), one) if "success" in df.columns else one, F.lit(1e-6))
    fail = F.greatest(F.coalesce(F.col("fail"), one) if "fail" in df.columns else one, F.lit(1e-6))
    score = F.coalesce(*[F.col(c) for c in ("final_score", "score") if c in df.columns], one)
    if seed is None:
        draw = scoring.beta_mean(success, fail)
    else:
        draw = stats.beta_draw(seed)(F.col(key).cast("string"), success, fail)
    return df.withColumn("value", draw * score)


def diversity_cap(df: DataFrame, topic: Column, order: list[Column], cap: int = dims.MAX_PER_TOPIC) -> DataFrame:
    """At most ``cap`` rows per topic. Row numbers under a small limit are cut
    before the shuffle as well, so a hot topic stays small."""
    ranked = df.withColumn("_topic", topic).withColumn("_rn", F.row_number().over(W.partitionBy("_topic").orderBy(*order)))
    return ranked.filter(F.col("_rn") <= cap).drop("_topic", "_rn")


# The longest row-number limit that Spark also applies before the shuffle.
CUT_EARLY = 1000


def platform_quota(df: DataFrame, platform: str, seq: str) -> DataFrame:
    """The first quota rows of each platform by ``seq``; no quota, no cut. Quotas of at most
    CUT_EARLY are row-number limits that Spark also applies before the shuffle, so a hot
    platform stays small; larger ones are counted in chunks."""
    quotas = {p: v[1] for p, v in dims.PLATFORMS.items()}
    most = max([q for q in quotas.values() if q <= CUT_EARLY], default=0)
    limited = df.withColumn("_quota", dims.lookup(quotas, F.col(platform)))
    few = limited.filter(F.col("_quota") <= CUT_EARLY).withColumn("_rank", F.row_number().over(W.partitionBy(platform).orderBy(seq)))
    few = few.filter(F.col("_rank") <= most).filter(F.col("_rank") <= F.col("_quota"))
    many = prefix_sum(limited.filter(F.col("_quota") > CUT_EARLY), [platform], seq, F.lit(1), "_rank").filter(F.col("_rank") <= F.col("_quota"))
    free = limited.filter(F.col("_quota").isNull())
    return few.select(df.columns).unionByName(many.select(df.columns)).unionByName(free.select(df.columns))


def thompson_select(df: DataFrame, key: str, topic: Column, platform: str, n: int, seed: int | None) -> DataFrame:
    """Draw, cap per topic, cut to the platform quota and to n, best first."""
    if n <= 0:
        return df.limit(0)
    valued = thompson_value(df, key, seed)
    order = [F.desc("value"), F.col(key)]
    quota = dims.PLATFORMS.get(platform, (0, n, 0))[1]
    return diversity_cap(valued, topic, order).orderBy(*order).limit(min(n, quota))


def budget_gate(calls: DataFrame, period: str, seq: str, cost: Column, budget: float) -> DataFrame:
    """Adds ``allowed``: spend of the period, this call included, is in budget."""
    spent = prefix_sum(calls, [period], seq, cost, "spent")
    return spent.withColumn("allowed", F.round("spent", 9) <= budget)


# -- portfolio --------------------------------------------------------------------------
def inverse_variance_weights(returns: DataFrame, key: str, value: str) -> DataFrame:
    """(key, weight): max(mean, 0)/variance scaled to 1, floored, scaled again."""
    moments = returns.groupBy(key).agg(F.avg(value).alias("mean"), F.var_samp(value).alias("var"))
    variance = F.when(F.col("var") > 0, F.col("var")).otherwise(1e-6)
    raw = moments.select(key, (F.greatest(F.col("mean"), F.lit(0.0)) / variance + 1e-9).alias("raw"))
    floored = raw.select(
        key, F.greatest(F.lit(dims.MIN_PORTFOLIO_WEIGHT), F.col("raw") / raw.agg(F.sum("raw")).scalar()).alias("w")
    )
    return floored.select(key, (F.col("w") / floored.agg(F.sum("w")).scalar()).alias("weight"))


# -- weights ------------------------------------------------------------------------------
def weight_step(actual: Column, expected: Column, gradient: Column) -> Column:
    grad = clamp(gradient, -dims.GRADIENT_CLIP, dims.GRADIENT_CLIP)
    return dims.LEARNING_RATE * (actual - expected) * grad


def _compose(first: Column, then: Column) -> Column:
    """Clipped shifts x -> clip(x + s, lo, hi) are closed under composition."""

    def clip(x):
        return F.greatest(then["lo"], F.least(then["hi"], x))

    return F.struct(
        (first["s"] + then["s"]).alias("s"),
        clip(first["lo"] + then["s"]).alias("lo"),
        clip(first["hi"] + then["s"]).alias("hi"),
    )


def fold_steps(log: DataFrame, key: str, seq: str, step: str, chunk: int = 4096) -> DataFrame:
    """(key, f): all steps of a key, in ``seq`` order, as one clipped shift.

    Each step clips, so order matters; but composing clipped shifts is
    associative. Steps are folded in chunks of ``seq`` (unique, >= 0), then the
    chunks in chunks: no task ever holds more than ``chunk`` of one key.
    """
    low, high = dims.WEIGHT_BOUNDS
    unit = F.struct(F.col(step).cast("double").alias("s"), F.lit(low).alias("lo"), F.lit(high).alias("hi"))
    level = log.select(key, F.col(seq).cast("bigint").alias("_q"), unit.alias("f"))
    top = log.agg(F.max(seq)).first()[0] or 0
    while True:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("_q", "f"))), lambda r: r["f"])
        rest = F.slice(F.col("fs"), 2, F.greatest(F.size("fs") - 1, F.lit(0)))
        level = (
            level.groupBy(key, F.floor(F.col("_q") / chunk).alias("_q"))
            .agg(ordered.alias("fs"))
            .select(key, "_q", F.aggregate(rest, F.get("fs", F.lit(0)), _compose).alias("f"))
        )
        top //= chunk
        if top == 0:
            return level.select(key, "f")


def apply_fold(weight: Column, fold: Column) -> Column:
    return F.greatest(fold["lo"], F.least(fold["hi"], weight + fold["s"]))


def updated_weights(log: DataFrame, key: str, seq: str, step: str, start: float = 1.0) -> DataFrame:
    return fold_steps(log, key, seq, step).select(key, apply_fold(F.lit(start), F.col("f")).alias("weight"))
