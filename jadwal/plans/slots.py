"""Timetable-shaped views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as readings of lessons: schedule, day (Sunday is 0), period, minute, confidence, class text, order."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    grade = (F.col("user_id") % 3 + 1).cast("string")
    section = F.when(F.col("user_id") % 5 == 0, "1").otherwise(F.get(F.array(*[F.lit(c) for c in "abcd"]), (F.col("user_id") % 4).cast("int")))
    mark = F.get(F.array(*[F.lit(c) for c in ("/", " / ", "-", "\\")]), (F.col("event_id") % 4).cast("int"))
    return e.select(
        F.col("event_id").alias("ord"), (F.col("user_id") % 20).alias("sched"), (F.dayofweek("ts") - 1).alias("day_idx"), (
            F.hour("ts") * 60 + F.minute("ts")
        ).alias("minute"),
        (F.hour("ts") % 12 + 1).alias("period"), (F.col("event_id") % 101 / F.lit(100.0)).alias("conf"), F.concat(grade, mark, section).alias("class_raw"), F.concat(
            grade, F.lit("/"), section
        ).alias("class_name"),
        F.concat(
            (F.col("user_id") % 4 + 1).cast("string"), F.lit("/"),
            F.when(F.col("user_id") % 2 == 0, F.col("user_id") % 20 + 1).otherwise(F.col("user_id") % 5 + 1).cast("string")
        ).alias("pair_name"),
    )


#: The same view for DuckDB.
SLOTS_SQL = r"""slots AS (
  SELECT event_id AS ord, user_id % 20 AS sched, dayofweek(ts) AS day_idx, hour(ts) * 60 + minute(ts) AS minute, hour(ts) % 12 + 1 AS period,
         (event_id % 101) / 100.0::DOUBLE AS conf,
         (user_id % 3 + 1) || CASE event_id % 4 WHEN 0 THEN '/' WHEN 1 THEN ' / ' WHEN 2 THEN '-' ELSE '\' END || sec AS class_raw,
         (user_id % 3 + 1) || '/' || sec AS class_name,
         (user_id % 4 + 1) || '/' || CASE WHEN user_id % 2 = 0 THEN user_id % 20 + 1 ELSE user_id % 5 + 1 END AS pair_name
  FROM (SELECT *, CASE WHEN user_id % 5 = 0 THEN '1' ELSE chr((97 + user_id % 4)::INT) END AS sec FROM events)
)"""
