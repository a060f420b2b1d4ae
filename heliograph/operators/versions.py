"""Graph snapshots as version-partitioned Parquet with a small metadata log.

Layout: ``nodes/version=N``, ``edges/version=N``, ``delta/version=N`` and one
metadata row per version. A version counts once its metadata row is written,
so a failed write leaves no half version behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions import text

META = (
    "version int, label string, parent int, created_at timestamp, "
    "num_nodes bigint, num_edges bigint, delta_nodes bigint, delta_edges bigint"
)


class GraphVersions:
    """Full copies with deltas against the parent; the last ``keep`` are listed."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 7) -> None:
        self.spark = spark
        self.path = path
        self.keep = keep

    def _meta(self) -> DataFrame:
        try:
            return self.spark.read.schema(META).parquet(f"{self.path}/meta")
        except Exception as exc:  # the store has no version yet
            if "PATH_NOT_FOUND" not in str(exc):
                raise
            return self.spark.createDataFrame([], META)

    def current(self) -> int | None:
        return self._meta().agg(F.max("version")).first()[0]

    def _known(self, version: int) -> None:
        row = self.list().filter(F.col("version") == version).limit(1).collect()
        if not row:
            raise KeyError(f"version {version} is unknown or no longer kept")

    def read(self, version: int) -> tuple[DataFrame, DataFrame]:
        self._known(version)
        return (
            self.spark.read.parquet(f"{self.path}/nodes/version={version}"),
            self.spark.read.parquet(f"{self.path}/edges/version={version}"),
        )

    def _keys(self, version: int) -> DataFrame:
        """(kind, key) of all nodes and edges of a version."""
        nodes = self.spark.read.parquet(f"{self.path}/nodes/version={version}")
        edges = self.spark.read.parquet(f"{self.path}/edges/version={version}")
        edge_key = text.edge_id(F.col("from_node"), F.col("to_node"), F.col("relation_type"))
        return nodes.select(F.lit("node").alias("kind"), F.col("id").alias("key")).unionByName(
            edges.select(F.lit("edge").alias("kind"), edge_key.alias("key"))
        )

    def create(self, nodes: DataFrame, edges: DataFrame, label: str) -> int:
        parent = self.current()
        version = (parent or 0) + 1
        nodes.write.mode("overwrite").parquet(f"{self.path}/nodes/version={version}")
        edges.write.mode("overwrite").parquet(f"{self.path}/edges/version={version}")
        keys = self._keys(version)
        delta = keys.limit(0) if parent is None else keys.join(self._keys(parent), ["kind", "key"], "left_anti")
        delta.write.mode("overwrite").parquet(f"{self.path}/delta/version={version}")
        sizes = keys.groupBy().agg(
            F.count_if(F.col("kind") == "node").alias("num_nodes"),
            F.count_if(F.col("kind") == "edge").alias("num_edges"),
        )
        new = self.delta(version).groupBy().agg(
            F.count_if(F.col("kind") == "node").alias("delta_nodes"),
            F.count_if(F.col("kind") == "edge").alias("delta_edges"),
        )
        size, added = sizes.first(), new.first()
        row = [(version, label, parent, *size, *added)]
        meta = self.spark.createDataFrame(
            row, "version int, label string, parent int, num_nodes bigint, num_edges bigint, "
            "delta_nodes bigint, delta_edges bigint"
        )
        meta.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(f"{self.path}/meta")
        return version

    def delta(self, version: int) -> DataFrame:
        """(kind, key) rows this version added to its parent."""
        return self.spark.read.parquet(f"{self.path}/delta/version={version}")

    def list(self) -> DataFrame:
        meta = self._meta()
        newest = meta.agg(F.max("version")).scalar()
        return meta.filter(F.col("version") > newest - self.keep).orderBy("version")

    def diff(self, a: int, b: int) -> DataFrame:
        """(kind, change, key) going from version a to version b."""
        self._known(a), self._known(b)
        left, right = self._keys(a), self._keys(b)
        added = right.join(left, ["kind", "key"], "left_anti").select("kind", F.lit("added").alias("change"), "key")
        removed = left.join(right, ["kind", "key"], "left_anti").select("kind", F.lit("removed").alias("change"), "key")
        return added.unionByName(removed)

    def rollback(self, version: int) -> int:
        """Write the state of ``version`` as the new current version."""
        nodes, edges = self.read(version)
        return self.create(nodes, edges, f"rollback to {version}")
