"""Saved designs as a table of states that only grows: the last state of an owner counts, and a cleared one is a state without a body."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jadwal.sources.responses import saved_designs

STATE = "owner string, saved_at long, json string"


def save(designs: DataFrame, path: str) -> None:
    """Append states (owner, saved_at, json) to the table at ``path``."""
    designs.select(
        F.col("owner").cast("string").alias("owner"), F.col("saved_at").cast("long").alias("saved_at"), "json"
    ).write.mode("append").parquet(path)


def clear(owners: DataFrame, path: str) -> None:
    """Take out the designs of ``owners`` (owner, saved_at)."""
    save(owners.withColumn("json", F.lit(None).cast("string")), path)


def load(spark: SparkSession, path: str, defaults: dict[str, object]) -> DataFrame:
    """owner, saved_at, grid and the fields of ``defaults`` of every owner whose last state is a design of version 1 with a grid."""
    last = F.max_by(F.struct("saved_at", "json"), F.struct("saved_at", F.col("json").isNull()))
    states = spark.read.schema(STATE).parquet(path).groupBy("owner").agg(last.alias("s")).select("owner", "s.saved_at", "s.json")
    return saved_designs(states.where("json is not null"), defaults)
