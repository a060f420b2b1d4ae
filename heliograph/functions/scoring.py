"""Revenue, CTR, decay and trend column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heliograph.functions import dims
from heliograph.functions.text import clamp

STREAM_FACTOR = sum(w * dims.STREAM_FACTORS[s] for s, w in dims.STREAM_WEIGHTS.items())


def estimate_cpm(platform: Column) -> Column:
    return dims.lookup(dims.CPM, platform, dims.DEFAULT_CPM)


def emotion_boost(emotion: Column) -> Column:
    return clamp(dims.lookup(dims.EMOTION_BOOST, emotion, 1.0), *dims.EMOTION_BOUNDS)


def risk_penalty(flags: Column) -> Column:
    """Sum of flag weights in [0, 1]; a repeated flag counts again."""

    def uses(name: str) -> Column:
        return F.size(F.filter(F.coalesce(flags, F.array().cast("array<string>")), lambda flag: flag == name))

    hits = [uses(name) * weight for name, weight in dims.RISK_WEIGHTS.items()]
    return clamp(sum(hits, F.lit(0.0)), 0.0, 1.0)


def revenue_score(platform: Column, emotion: Column, flags: Column) -> Column:
    return STREAM_FACTOR * estimate_cpm(platform) * emotion_boost(emotion) * (1.0 - risk_penalty(flags))


def beta_mean(alpha: Column, beta: Column) -> Column:
    return alpha / (alpha + beta)


def beta_variance(alpha: Column, beta: Column) -> Column:
    total = alpha + beta
    return alpha * beta / (total * total * (total + 1.0))


def time_decay(created: Column, now: Column, half_life_days: Column | float = dims.HALF_LIFE_DAYS) -> Column:
    """0.5 ** (age / half-life); a future time has age 0, a half-life <= 0 no decay."""
    half = half_life_days if isinstance(half_life_days, Column) else F.lit(float(half_life_days))
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(created.cast("timestamp"))) / 86400e6
    rate = F.when(half > 0, F.log(F.lit(2.0)) / half).otherwise(0.0)
    return F.exp(-rate * F.greatest(F.lit(0.0), age))


def trend_state(velocity: Column, acceleration: Column) -> Column:
    return (
        F.when(velocity > 1.00, "viral")
        .when((velocity > 0.20) & (acceleration > 0.0), "rising")
        .when(velocity < -0.10, "falling")
        .when(F.abs(velocity) < 0.05, "peaking")
        .otherwise("stable")
    )


def optimal_publish_window(velocity: Column, acceleration: Column) -> Column:
    return (trend_state(velocity, acceleration) == "rising") & (acceleration > 0.05)


def sample_size(effect: Column, power: float = 0.80) -> Column:
    """Per-group size of a two-sided test; NULL unless the effect is positive."""
    z = 1.959963985 + {0.80: 0.8416, 0.90: 1.2816, 0.95: 1.6449}.get(power, 0.8416)
    n = F.ceil(2.0 * F.pow(F.lit(z) / effect, F.lit(2)))
    return F.when(effect > 0, F.greatest(F.lit(2), n).cast("bigint"))
