"""SQL over snapshots: every table of a statement at one version."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..operators.snapshot import snapshot
from ..sources.manifest import Manifest


def sql(spark: SparkSession, statement: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Run a statement that names tables as {name}; nothing is left registered."""
    used = {name: df for name, df in tables.items() if "{" + name + "}" in statement}
    return spark.sql(statement, **used)


def at_version(spark: SparkSession, statement: str, manifests: Mapping[str, Manifest], target: int) -> DataFrame:
    """Run a statement over several tables, all at ``target``; their watermarks may differ.

    Raises ``SnapshotUnavailable`` before anything runs if one of them cannot be exact.
    """
    for manifest in manifests.values():
        manifest.check(target)
    return sql(spark, statement, {name: snapshot(spark, m, target) for name, m in manifests.items()})


def register(spark: SparkSession, manifests: Mapping[str, Manifest], target: int) -> None:
    """Temporary views of all tables at ``target``, for clients that send plain SQL."""
    for name, manifest in manifests.items():
        snapshot(spark, manifest, target).createOrReplaceTempView(name)
