"""Experiments over the events and orders tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograph.functions import scoring
from heliograph.operators import experiments as ex
from heliograph.plans.registry import query

c, lit = F.col, F.lit


@query(
    "create_experiment",
    """
    WITH n AS (SELECT o_orderpriority AS p, o_orderstatus AS s, count(*) AS k FROM orders GROUP BY ALL),
    f AS (SELECT p AS experiment_id, (row_number() OVER w - 1)::int AS pos, s AS variant, k::double / sum(k) OVER (PARTITION BY p) AS share,
          sum(k) OVER w::double / sum(k) OVER (PARTITION BY p) AS cumulative FROM n WINDOW w AS (PARTITION BY p ORDER BY s))
    SELECT experiment_id, pos, variant, round(share, 6) AS share, round(cumulative, 6) AS cumulative FROM f WHERE experiment_id <> '5-LOW'
    """.replace("sum(k) OVER w::double", "(sum(k) OVER w)::double"),
)
def _(t):
    counts = t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("k"))
    packed = counts.groupBy("o_orderpriority").agg(F.array_sort(F.collect_list(F.struct("o_orderstatus", "k"))).alias("a"), F.sum("k").alias("n"))
    split = F.transform("a", lambda x: x["k"] / c("n"))
    # The low-priority definition lacks a share and must be refused.
    split = F.when(c("o_orderpriority") == "5-LOW", F.slice(split, 1, 1)).otherwise(split)
    names = F.transform("a", lambda x: x["o_orderstatus"])
    definitions = packed.select(c("o_orderpriority").alias("experiment_id"), names.alias("variants"), split.alias("traffic_split"))
    made = ex.create(definitions)
    return made.select("experiment_id", "pos", "variant", F.round("share", 6).alias("share"), F.round("cumulative", 6).alias("cumulative"))


def variants(t):
    """An experiment per event type: three arms for views, two for the others."""
    kinds = t.events.select(F.concat(lit("exp_"), "event_type").alias("experiment_id")).distinct()
    three = c("experiment_id") == "exp_view"
    return ex.create(
        kinds.select(
            "experiment_id",
            F.when(three, F.array(lit("A"), lit("B"), lit("C"))).otherwise(F.array(lit("A"), lit("B"))).alias("variants"),
            F.when(three, F.array(lit(0.2), lit(0.5), lit(0.3))).otherwise(F.array(lit(0.5), lit(0.5))).alias("traffic_split"),
        )
    )


SQL_ASSIGN = """
b AS (SELECT DISTINCT 'exp_' || event_type AS experiment_id, user_id AS unit_id FROM events),
h AS (SELECT *, ('0x' || substr(sha256(experiment_id || ':' || unit_id), 1, 16))::ubigint::double / 18446744073709551616.0::double AS bucket FROM b),
assigned AS (SELECT experiment_id, unit_id, CASE WHEN experiment_id = 'exp_view' THEN CASE WHEN bucket < 0.2 THEN 'A' WHEN bucket < 0.7 THEN 'B' ELSE 'C' END
       WHEN bucket < 0.5 THEN 'A' ELSE 'B' END AS variant FROM h)
"""


def assigned(t):
    units = t.events.select(F.concat(lit("exp_"), "event_type").alias("experiment_id"), c("user_id").alias("unit_id")).distinct()
    return ex.assign(units, variants(t))


@query("assign_variant", f"WITH {SQL_ASSIGN} SELECT * FROM assigned")
def _(t):
    return assigned(t)


SQL_OUT = SQL_ASSIGN + """
, o AS (SELECT a.experiment_id, a.variant, e.value AS metric FROM events e JOIN assigned a ON a.experiment_id = 'exp_' || e.event_type AND a.unit_id = e.user_id)
"""


def outcomes(t):
    rows = t.events.select(F.concat(lit("exp_"), "event_type").alias("experiment_id"), c("user_id").alias("unit_id"), c("value").alias("metric"))
    return rows.join(assigned(t), ["experiment_id", "unit_id"]).select("experiment_id", "variant", "metric")


# erf by its power series: exact to about 1e-12 for the |z| met here.
SQL_CDF = """
0.5 * (1 + 2 / sqrt(pi()) * (SELECT sum((CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * pow({z} / sqrt(2), 2 * k + 1) / (gamma(k + 1) * (2 * k + 1))) FROM range(0, 80) r(k)))
"""
SQL_MW = SQL_OUT + f"""
, rk AS (SELECT experiment_id, variant, rank() OVER w + (count(*) OVER (PARTITION BY experiment_id, metric) - 1) / 2.0 AS r FROM o
         WHERE variant IN ('A', 'B') WINDOW w AS (PARTITION BY experiment_id ORDER BY metric)),
s AS (SELECT experiment_id, sum(r) FILTER (variant = 'B') AS r1, count(*) FILTER (variant = 'B')::double AS n1, count(*) FILTER (variant = 'A')::double AS n2 FROM rk GROUP BY 1),
mw AS (SELECT experiment_id, n1, n2, least(r1 - n1 * (n1 + 1) / 2, n1 * n2 - r1 + n1 * (n1 + 1) / 2) AS u FROM s),
mz AS (SELECT *, (u - n1 * n2 / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12) AS z FROM mw),
mp AS (SELECT *, least(1.0, 2 * {SQL_CDF.format(z='z')}) AS p FROM mz)
"""


@query(
    "mann_whitney_u",
    f"WITH {SQL_MW} SELECT experiment_id, n2::bigint AS n_control, n1::bigint AS n_treatment, round(u, 4)::double AS u, round(z, 6) AS z, round(p, 6) AS p_value FROM mp",
)
def _(t):
    tested = ex.mann_whitney(outcomes(t), "A", "B")
    return tested.select("experiment_id", "n_control", "n_treatment", F.round("u", 4).alias("u"), F.round("z", 6).alias("z"), F.round("p_value", 6).alias("p_value"))


@query(
    "welch_ttest",
    f"""WITH {SQL_OUT}, a AS (SELECT experiment_id, avg(metric) FILTER (variant = 'A') AS mc, var_samp(metric) FILTER (variant = 'A') AS vc, count(*) FILTER (variant = 'A') AS nc,
       avg(metric) FILTER (variant = 'B') AS mt, var_samp(metric) FILTER (variant = 'B') AS vt, count(*) FILTER (variant = 'B') AS nt FROM o GROUP BY 1)
    SELECT experiment_id, round((mt - mc) / sqrt(vt / nt + vc / nc), 6) AS t,
           round(pow(vt / nt + vc / nc, 2) / (pow(vt / nt, 2) / (nt - 1) + pow(vc / nc, 2) / (nc - 1)), 4) AS df FROM a""",
)
def _(t):
    return ex.welch(outcomes(t), "A", "B").select("experiment_id", F.round("t", 6).alias("t"), F.round("df", 4).alias("df"))


@query(
    "welch_p_value",
    f"""WITH {SQL_OUT}, a AS (SELECT experiment_id, avg(metric) FILTER (variant = 'A') AS mc, var_samp(metric) FILTER (variant = 'A') AS vc, count(*) FILTER (variant = 'A') AS nc,
       avg(metric) FILTER (variant = 'B') AS mt, var_samp(metric) FILTER (variant = 'B') AS vt, count(*) FILTER (variant = 'B') AS nt FROM o GROUP BY 1),
    w AS (SELECT experiment_id, (mt - mc) / sqrt(vt / nt + vc / nc) AS t,
       pow(vt / nt + vc / nc, 2) / (pow(vt / nt, 2) / (nt - 1) + pow(vc / nc, 2) / (nc - 1)) AS df FROM a),
    u AS (SELECT experiment_id, df, atan(abs(t) / sqrt(df)) AS u FROM w),
    s AS (SELECT experiment_id, df, u / 6000 * sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(cos(u * i / 2000), df - 1)) AS area
          FROM u, range(2001) r(i) GROUP BY experiment_id, df, u)
    SELECT experiment_id, round(least(1, greatest(0, 1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()) * area)), 6) AS p_value FROM s""",
)
def _(t):
    return ex.welch(outcomes(t), "A", "B").select("experiment_id", F.round("p_value", 6).alias("p_value"))


@query(
    "experiment_results",
    f"""WITH {SQL_MW}, v AS (SELECT experiment_id, variant, avg(metric) AS mean, count(*) AS n FROM o GROUP BY 1, 2),
    best AS (SELECT experiment_id, arg_max(variant, mean) AS best FROM v GROUP BY 1)
    SELECT v.experiment_id, v.variant, round(v.mean, 6) AS mean, v.n, CASE WHEN v.experiment_id <> 'exp_view' THEN round(p, 6) END AS p_value,
           v.experiment_id <> 'exp_view' AND p < 0.05 AS significant,
           CASE WHEN v.experiment_id = 'exp_view' OR p < 0.05 THEN best END AS winner
    FROM v JOIN mp USING (experiment_id) JOIN best USING (experiment_id)""",
)
def _(t):
    out = ex.results(outcomes(t), variants(t))
    return out.select("experiment_id", "variant", F.round("mean", 6).alias("mean"), "n", F.round("p_value", 6).alias("p_value"), "significant", "winner")


@query(
    "sample_size",
    """SELECT user_id, greatest(2, ceil(2.0::double * pow((1.959963985::double + 0.8416::double) / e, 2)))::bigint AS n_per_group
    FROM (SELECT user_id, round(avg(value) / 100.0, 6) AS e FROM events GROUP BY user_id) WHERE e > 0""",
)
def _(t):
    effects = t.events.groupBy("user_id").agg(F.round(F.avg("value") / 100.0, 6).alias("e"))
    return effects.select("user_id", scoring.sample_size(c("e")).alias("n_per_group")).filter("n_per_group IS NOT NULL")
