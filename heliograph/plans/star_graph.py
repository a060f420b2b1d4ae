"""The content graph derived from the star-schema tables, in Spark and as SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def nodes(t) -> DataFrame:
    def part(df, prefix, kind, key, name, weight):
        return df.select(
            F.concat(F.lit(prefix), F.col(key)).alias("id"),
            F.lit(kind).alias("type"),
            F.col(name).alias("name"),
            F.lit(weight).alias("weight"),
        )

    parts = [
        part(t.region, "event:region_", "event", "r_regionkey", "r_name", 0.7),
        part(t.nation, "topic:nation_", "topic", "n_nationkey", "n_name", 1.0),
        part(t.supplier, "entity:supplier_", "entity", "s_suppkey", "s_name", 0.75),
        part(t.part, "product:part_", "product", "p_partkey", "p_name", 0.65),
        part(t.customer, "audience:customer_", "audience", "c_custkey", "c_name", 0.8),
    ]
    return reduce(DataFrame.unionByName, parts)


def edges(t) -> DataFrame:
    def part(df, src, src_key, dst, dst_key, relation, weight):
        return df.select(
            F.concat(F.lit(src), F.col(src_key)).alias("from_node"),
            F.concat(F.lit(dst), F.col(dst_key)).alias("to_node"),
            F.lit(relation).alias("relation_type"),
            weight.alias("weight"),
        )

    sold = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(
        F.round(F.least(F.lit(1.0), F.sum("l_quantity") / 100.0), 6).alias("w")
    )
    supplier, nation, region = "entity:supplier_", "topic:nation_", "event:region_"
    parts = [
        part(t.nation, nation, "n_nationkey", region, "n_regionkey", "belongs_to_event", F.lit(0.65)),
        part(t.supplier, supplier, "s_suppkey", nation, "s_nationkey", "related_to", F.lit(0.5)),
        part(t.supplier, nation, "s_nationkey", supplier, "s_suppkey", "causes", F.lit(0.8)),
        part(t.customer, "audience:customer_", "c_custkey", nation, "c_nationkey", "leads_to", F.lit(0.6)),
        part(sold, supplier, "l_suppkey", "product:part_", "l_partkey", "monetizes_via", F.col("w")),
    ]
    return reduce(DataFrame.unionByName, parts)


SQL = """
nodes AS MATERIALIZED (
    SELECT 'event:region_' || r_regionkey AS id, 'event' AS type, r_name AS name, 0.7::double AS weight FROM region
    UNION ALL SELECT 'topic:nation_' || n_nationkey, 'topic', n_name, 1.0::double FROM nation
    UNION ALL SELECT 'entity:supplier_' || s_suppkey, 'entity', s_name, 0.75::double FROM supplier
    UNION ALL SELECT 'product:part_' || p_partkey, 'product', p_name, 0.65::double FROM part
    UNION ALL SELECT 'audience:customer_' || c_custkey, 'audience', c_name, 0.8::double FROM customer
),
edges AS MATERIALIZED (
    SELECT 'topic:nation_' || n_nationkey AS from_node, 'event:region_' || n_regionkey AS to_node,
           'belongs_to_event' AS relation_type, 0.65::double AS weight FROM nation
    UNION ALL SELECT 'entity:supplier_' || s_suppkey, 'topic:nation_' || s_nationkey, 'related_to', 0.5::double FROM supplier
    UNION ALL SELECT 'topic:nation_' || s_nationkey, 'entity:supplier_' || s_suppkey, 'causes', 0.8::double FROM supplier
    UNION ALL SELECT 'audience:customer_' || c_custkey, 'topic:nation_' || c_nationkey, 'leads_to', 0.6::double FROM customer
    UNION ALL SELECT 'entity:supplier_' || l_suppkey, 'product:part_' || l_partkey, 'monetizes_via',
           round(least(1.0, sum(l_quantity) / 100.0), 6)::double FROM lineitem GROUP BY l_suppkey, l_partkey
)
"""
