"""A/B experiments: definition, assignment and significance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions import stats
from heliograph.operators.common import prefix_sum

ALPHA = 0.05


def create(definitions: DataFrame) -> DataFrame:
    """(experiment_id, variants, traffic_split) -> one row per variant with its
    cumulative share; definitions that do not line up or sum to 1 are left out."""
    total = F.aggregate("traffic_split", F.lit(0.0), lambda a, x: a + x)
    valid = (F.size("variants") == F.size("traffic_split")) & (F.abs(total - 1.0) <= 1e-6) & (F.size("variants") >= 2)
    upto = F.aggregate(F.slice("traffic_split", 1, F.col("pos") + 1), F.lit(0.0), lambda a, x: a + x)
    rows = definitions.filter(valid).select("experiment_id", "traffic_split", F.posexplode("variants").alias("pos", "variant"))
    last = F.size("traffic_split") - 1 == F.col("pos")
    return rows.select("experiment_id", "pos", "variant", F.get("traffic_split", F.col("pos")).alias("share"),
                       upto.alias("cumulative"), last.alias("is_last"))


def unit_bucket(experiment_id: Column, unit_id: Column) -> Column:
    """The first 64 bits of SHA-256(experiment:unit) as a share in [0, 1)."""
    digest = F.substring(F.sha2(F.concat_ws(":", experiment_id, unit_id.cast("string")), 256), 1, 16)
    return F.conv(digest, 16, 10).cast("decimal(20,0)").cast("double") / float(1 << 64)


def assign(units: DataFrame, variants: DataFrame) -> DataFrame:
    """(experiment_id, unit_id) -> variant: the first whose cumulative share
    exceeds the bucket, else the last. Each experiment is one array row."""
    plan = variants.groupBy("experiment_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "cumulative", "variant"))).alias("plan")
    )
    bucketed = units.withColumn("_b", unit_bucket(F.col("experiment_id"), F.col("unit_id"))).join(plan, "experiment_id")
    hit = F.filter("plan", lambda v: F.col("_b") < v["cumulative"])
    chosen = F.coalesce(F.get(hit, F.lit(0))["variant"], F.element_at("plan", -1)["variant"])
    return bucketed.withColumn("variant", chosen).drop("_b", "plan")


def variant_stats(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("experiment_id", "variant").agg(
        F.avg("metric").alias("mean"), F.count("metric").alias("n"), F.var_samp("metric").alias("var")
    )


def mann_whitney(outcomes: DataFrame, control: str, treatment: str, chunks: int = 64) -> DataFrame:
    """(experiment_id, n_control, n_treatment, u, z, p_value), mid-ranks for ties,
    normal approximation without tie correction; p is 1 when an arm has < 2 rows.

    Ranks come from counts per distinct value, and the running count from chunks
    of about equal weight, so a huge experiment is never one task.
    """
    keyed = outcomes.select("experiment_id", (F.col("variant") == treatment).cast("int").alias("t"), "metric").filter(
        F.col("variant").isin(control, treatment)
    )
    counts = keyed.groupBy("experiment_id", "metric").agg(F.count("*").alias("n"), F.sum("t").alias("nt"))
    cuts = outcomes.groupBy("experiment_id").agg(
        F.percentile_approx("metric", [i / chunks for i in range(1, chunks)], 1000).alias("_cuts")
    )
    chunk = F.size(F.filter("_cuts", lambda x: x < F.col("metric")))
    ranked = prefix_sum(counts.join(cuts, "experiment_id"), ["experiment_id"], "metric", F.col("n"), "upto", chunk)
    mid = F.col("upto") - F.col("n") + (F.col("n") + 1) / 2.0
    sums = ranked.groupBy("experiment_id").agg(
        F.sum(F.col("nt") * mid).alias("r1"), F.sum("nt").alias("n1"), (F.sum("n") - F.sum("nt")).alias("n2")
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    u1 = F.col("r1") - n1 * (n1 + 1) / 2.0
    sigma = F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0)
    enough = (F.col("n1") >= 2) & (F.col("n2") >= 2)
    tested = sums.withColumn("u", F.when(enough, F.least(u1, n1 * n2 - u1)).otherwise(0.0)).withColumn(
        "z", F.when(enough, (F.col("u") - n1 * n2 / 2.0) / F.nullif(sigma, F.lit(0.0)))
    )
    p = F.coalesce(F.least(F.lit(1.0), 2.0 * stats.normal_cdf("z")), F.lit(1.0))
    return tested.select("experiment_id", F.col("n2").alias("n_control"), F.col("n1").alias("n_treatment"), "u", "z", p.alias("p_value"))


def welch(outcomes: DataFrame, control: str, treatment: str) -> DataFrame:
    """(experiment_id, t, df, p_value) of the unequal-variance t-test."""

    def arm(name: str, prefix: str) -> list[Column]:
        value = F.when(F.col("variant") == name, F.col("metric"))
        return [F.avg(value).alias(f"m{prefix}"), F.var_samp(value).alias(f"v{prefix}"), F.count(value).alias(f"n{prefix}")]

    wide = outcomes.groupBy("experiment_id").agg(*arm(control, "c"), *arm(treatment, "t")).filter("nc >= 2 AND nt >= 2")
    a, b = F.col("vt") / F.col("nt"), F.col("vc") / F.col("nc")
    t = (F.col("mt") - F.col("mc")) / F.sqrt(a + b)
    df = F.pow(a + b, 2) / (F.pow(a, 2) / (F.col("nt") - 1) + F.pow(b, 2) / (F.col("nc") - 1))
    tested = wide.filter(F.col("vt") + F.col("vc") > 0).select("experiment_id", t.alias("t"), df.alias("df"))
    return tested.withColumn("p_value", stats.t_two_sided("t", "df"))


def results(outcomes: DataFrame, variants: DataFrame) -> DataFrame:
    """(experiment_id, variant, mean, n, p_value, significant, winner).

    Two variants: the first is control; the winner has the greater mean, if
    significant. More: the greatest mean wins untested, unless all are zero.
    """
    arms = variants.groupBy("experiment_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "variant"))), lambda v: v["variant"]).alias("arms")
    )
    per = variants.select("experiment_id", "pos", "variant").join(
        variant_stats(outcomes).drop("var"), ["experiment_id", "variant"], "left"
    ).na.fill({"mean": 0.0, "n": 0})
    paired = outcomes.join(arms.filter(F.size("arms") == 2), "experiment_id")
    role = F.when(F.col("variant") == F.get("arms", F.lit(0)), "c").otherwise("t")
    tests = mann_whitney(paired.select("experiment_id", role.alias("variant"), "metric"), "c", "t").select("experiment_id", "p_value")
    best = per.groupBy("experiment_id").agg(
        F.max_by("variant", F.struct("mean", -F.col("pos"))).alias("best"), F.max(F.abs("mean")).alias("top"), F.count("*").alias("k")
    )
    judged = best.join(tests, "experiment_id", "left").withColumn("significant", F.coalesce(F.col("p_value") < ALPHA, F.lit(False)))
    winner = F.when(F.col("k") == 2, F.when(F.col("significant"), F.col("best"))).otherwise(F.when(F.col("top") > 0, F.col("best")))
    return per.join(judged.select("experiment_id", "p_value", "significant", winner.alias("winner")), "experiment_id")
