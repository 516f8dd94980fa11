"""The role registry against what cites it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INTRINSIC = ("vault", "web", "memory")


def resolve(needs: DataFrame, registry: DataFrame, tools: DataFrame) -> DataFrame:
    """needs (skill, role) with outcome: missing (no row), none (declared as nothing), stale (its source is no tool at hand) or ok. Registry and tools are dimensions; Spark broadcasts them while they are small."""
    r = registry.select("role", "source", F.lit(True).alias("declared"))
    t = tools.select(F.col("tool").alias("source"), F.lit(True).alias("at_hand")).distinct()
    outcome = F.when(F.col("declared").isNull(), "missing").when(F.col("source") == "none", "none").when(F.col("at_hand").isNull(), "stale").otherwise("ok")
    return needs.join(r, "role", "left").join(t, "source", "left").select("skill", "role", "source", outcome.alias("outcome"))


def unknown(roles: DataFrame, known: DataFrame) -> DataFrame:
    return roles.select("role").distinct().join(known.select("role").distinct(), "role", "left_anti")


def undeclared(cited: DataFrame, registry: DataFrame, intrinsic: tuple[str, ...] = INTRINSIC) -> DataFrame:
    """Cited roles that are neither declared nor part of the engine."""
    return unknown(cited.where(~F.col("role").isin(*intrinsic)), registry)
