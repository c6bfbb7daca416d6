"""Edits of lectures (id, day, start, end, course, room, needs_review), in sets instead of one by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jadwal.functions import text

# The order of the days of a university week.
DAY_KEYS = ["sun", "mon", "tue", "wed", "thu", "fri", "sat"]


def fault(start: Column, end: Column, course: Column) -> Column:
    """Why a form's lecture (times as ``H:MM``) is refused: no-course, no-time or end-before-start; null if it is fine."""
    a, b = text.parse_time(start), text.parse_time(end)
    return F.when(F.trim(F.coalesce(course, F.lit(""))) == "", "no-course").when(a.isNull() | b.isNull(), "no-time").when(b <= a, "end-before-start")


def edited(lectures: DataFrame, changes: DataFrame, removed: DataFrame) -> DataFrame:
    """``lectures`` with ``changes`` put in by id (an edited lecture asks for no review) and the ids of ``removed`` taken out."""
    kept = lectures.join(changes.select("id"), "id", "left_anti").unionByName(
        changes.withColumn("needs_review", F.lit(None).cast("boolean")).select(*lectures.columns)
    )
    return kept.join(removed.select("id"), "id", "left_anti").select(*lectures.columns)


def in_order(lectures: DataFrame) -> DataFrame:
    """By day, Sunday first, and start."""
    place = F.array_position(F.array(*[F.lit(d) for d in DAY_KEYS]), F.col("day"))
    return lectures.orderBy(place, "start", "course")
