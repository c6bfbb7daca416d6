"""Axis inference: direction, missing labels and ordering by clock, as windows within one line of a schedule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def direction_vote(labels: DataFrame, group: list[str], position: str, value: str) -> DataFrame:
    """inc, dec and step per line: do labels mostly rise (equal neighbours count as falling) along the positions?"""
    before = F.lag(value).over(Window.partitionBy(*group).orderBy(position))
    marked = labels.withColumn("__before", before).where(F.col("__before").isNotNull())
    counts = marked.groupBy(*group).agg(
        F.count_if(F.col(value) > F.col("__before")).alias("inc"), F.count_if(F.col(value) <= F.col("__before")).alias("dec")
    )
    return counts.withColumn("step", F.when(F.col("inc") >= F.col("dec"), 1).otherwise(-1))


def fill_gaps(lines: DataFrame, group: list[str], low: int = 1, high: int = 12, step: str | None = None) -> DataFrame:
    """Labels of a line's positions (pos, label or null, is_data), rising by one a position, or by column ``step``.

    A gap between two labels is filled when it fits exactly (confidence 0.55). Given two labels, those before the
    first and after the last are continued while positions hold data and numbers stay valid (0.5).
    """
    w = Window.partitionBy(*group).orderBy("pos")
    up_to, from_here, every = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(*group)
    known = F.when(F.col("label").isNotNull(), F.struct("pos", "label"))
    hole = F.when(~F.col("is_data"), F.col("pos"))
    t = (
        lines.withColumn("a", F.last(known, ignorenulls=True).over(up_to)).withColumn("b", F.first(known, ignorenulls=True).over(from_here))
        .withColumn("n", F.count("label").over(every))
        .withColumn("hole_before", F.max(hole).over(up_to)).withColumn("hole_after", F.min(hole).over(from_here))
    )
    by = F.col(step) if step else F.lit(1)
    ahead, back = F.col("a.label") + by * (F.col("pos") - F.col("a.pos")), F.col("b.label") - by * (F.col("b.pos") - F.col("pos"))
    inner = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("b.label") - F.col("a.label") == by * (F.col("b.pos") - F.col("a.pos")))
    after = F.col("b").isNull() & (F.col("n") >= 2) & (F.coalesce("hole_before", F.lit(-1)) < F.col("a.pos")) & ahead.between(low, high)
    before = F.col("a").isNull() & (F.col("n") >= 2) & (F.coalesce("hole_after", F.lit(1 << 30)) > F.col("b.pos")) & back.between(low, high)
    value = F.when(F.col("label").isNotNull(), F.col("label")).when(inner | after, ahead).when(before, back)
    sure = F.when(F.col("label").isNotNull(), 1.0).when(inner, 0.55).otherwise(0.5)
    return t.select(
        *group, "pos", value.alias("value"), F.col("label").isNull().alias("inferred"), sure.alias("confidence")
    ).where("value is not null")


def rank_by_clock(headers: DataFrame, group: list[str]) -> DataFrame:
    """Period numbers of a line's headers (pos, minute, label or null) by their clock times.

    Lines of at least three are ranked. If the labels that were read rise with time, the first one anchors the ranking and they
    stay; otherwise the times decide from 1. Numbers outside 1 to 12 are dropped.
    """
    w, every = Window.partitionBy(*group).orderBy("minute", "pos"), Window.partitionBy(*group)
    t = headers.withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(every)).where("n >= 3")
    before = F.last("label", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("slip", F.col("label").isNotNull() & before.isNotNull() & (F.col("label") <= before))
    t = t.withColumn("ok", ~F.max("slip").over(every)).withColumn(
        "anchor", F.min(F.when(F.col("label").isNotNull(), F.struct("i", "label"))).over(every)
    )
    rank = F.when(F.col("ok") & F.col("anchor").isNotNull(), F.col("anchor.label") + F.col("i") - F.col("anchor.i")).otherwise(F.col("i"))
    value = F.when(F.col("ok") & F.col("label").isNotNull(), F.col("label")).otherwise(rank)
    return t.select(*group, "pos", value.cast("int").alias("value"), "ok").where(F.col("value").between(1, 12))


def axis_scores(labels: DataFrame, group: str) -> DataFrame:
    """score per (schedule, orientation) of labels (kind, value, pos), and which orientation wins.

    Twice the days' positions, one and a half times the periods' positions, and one for every distinct value of either;
    columns win only with a strictly better score.
    """
    day, period = F.col("kind") == "day", F.col("kind") == "period"
    s = labels.groupBy(group, "orientation").agg(
        F.count_distinct(F.when(day, F.col("pos"))).alias("days_read"), F.count_distinct(F.when(period, F.col("pos"))).alias("periods_read"),
        F.count_distinct(F.when(day, F.col("value"))).alias("days"), F.count_distinct(F.when(period, F.col("value"))).alias("periods"),
    )
    score = 2.0 * F.col("days_read") + 1.5 * F.col("periods_read") + F.col("days") + F.col("periods")
    both = s.withColumn("score", score).groupBy(group).agg(
        F.max(F.when(F.col("orientation") == "rows", F.col("score"))).alias("rows_score"),
        F.max(F.when(F.col("orientation") == "columns", F.col("score"))).alias("columns_score")
    )
    r, c = F.coalesce("rows_score", F.lit(-1.0)), F.coalesce("columns_score", F.lit(-1.0))
    return both.select(
        group, r.alias("rows_score"), c.alias("columns_score"), F.when(c > r, "days-in-columns").otherwise("days-in-rows").alias("orientation")
    )
