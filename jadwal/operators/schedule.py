"""From recognised cells to lessons: which axis holds the days, the labels of both axes, and the slots.

Both orientations are worked out side by side as rows of one table: ``dp`` is the position along the days and ``pp``
along the periods, so days in rows have dp = row, and days in columns dp = column. A document is one timetable, so all
windows run within a document and an orientation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jadwal.operators.axes import fill_gaps, rank_by_clock
from jadwal.storage import written

# The order of the days on an axis; Sunday to Thursday are school days.
DAY_ORDER = ["sat", "sun", "mon", "tue", "wed", "thu", "fri"]
FIRST_SCHOOL_DAY, LAST_SCHOOL_DAY = 1, 5
KEY = ["doc_id", "o"]


def day_number(day: Column) -> Column:
    return F.array_position(F.array(*[F.lit(d) for d in DAY_ORDER]), day).cast("int") - 1


def places(cells: DataFrame, grids: DataFrame) -> DataFrame:
    """Every place of the grid with the cell that covers it (the later one), in both orientations."""
    inside = cells.join(grids.select("doc_id", "rows", "cols"), "doc_id")
    spread = inside.withColumn("r", F.explode(F.sequence("row", F.col("row") + F.col("row_span") - 1))).withColumn(
        "c", F.explode(F.sequence("col", F.col("col") + F.col("col_span") - 1))
    )
    names = [c for c in cells.columns if c != "doc_id"]
    top = spread.where("r < rows and c < cols").groupBy("doc_id", "r", "c").agg(F.max_by(F.struct(*names), "ord").alias("cell")).select(
        "doc_id", "r", "c", "cell.*"
    )
    return top.withColumn("o", F.lit("days-in-rows")).withColumn("dp", F.col("r")).withColumn("pp", F.col("c")).unionByName(
        top.withColumn("o", F.lit("days-in-columns")).withColumn("dp", F.col("c")).withColumn("pp", F.col("r"))
    )


def _best_line(at: DataFrame, kind: str, value: str, line: str, name: str) -> DataFrame:
    """The first line with the most distinct labels of a kind."""
    counts = at.where((F.col("kind") == kind) & F.col(value).isNotNull()).groupBy(*KEY, line).agg(F.count_distinct(value).alias("n"))
    return counts.groupBy(*KEY).agg(F.max_by(line, F.struct("n", -F.col(line))).alias(f"{name}_line"), F.max("n").alias(f"{name}_best"))


def _vote(known: DataFrame, name: str) -> DataFrame:
    before = F.lag("label").over(Window.partitionBy(*KEY).orderBy("pos"))
    votes = known.withColumn("up", F.when(before.isNotNull(), F.when(F.col("label") > before, 1).otherwise(-1)))
    return votes.groupBy(*KEY).agg(
        F.count("*").alias(f"{name}_known"), F.min("pos").alias(f"{name}_first"),
        F.when(F.sum("up") >= 0, 1).when(F.sum("up") < 0, -1).alias(f"{name}_vote")
    )


def _with_clock(lined: DataFrame, known: DataFrame) -> DataFrame:
    """``known`` periods and those that their clock times give, on period lines where some position has no label."""
    starts = F.col("pp") == F.when(F.col("o") == "days-in-rows", F.col("col")).otherwise(F.col("row"))
    timed = lined.where("dp = period_line and minutes is not null and kind in ('other', 'period')").where(starts).select(
        *KEY, F.col("pp").alias("pos"), F.col("minutes").alias("minute")
    )
    places = F.when(F.col("o") == "days-in-rows", F.col("cols")).otherwise(F.col("rows"))
    full = lined.select(*KEY, places.alias("places")).distinct().join(
        known.groupBy(*KEY).agg(F.count("*").alias("n")), KEY
    ).where("n >= places").select(*KEY)
    headers = timed.join(full, KEY, "left_anti").join(known.select(*KEY, "pos", "label"), [*KEY, "pos"], "left")
    ranked = rank_by_clock(headers, KEY).join(known.select(*KEY, "pos", "label"), [*KEY, "pos"], "left")
    new = written(ranked.where("label is null or not ok").select(*KEY, "pos", F.col("value").alias("label"), F.lit(0.6).alias("sure")), "clock")
    return known.join(new.select(*KEY, "pos"), [*KEY, "pos"], "left_anti").unionByName(new)


def _adopted(axis: DataFrame, frame: DataFrame, grids: DataFrame) -> DataFrame:
    """Unlabelled data lines of grids without ruled lines, with the label of the nearest labelled line (the first of equally near ones).

    It may lie at most 0.45 of the labelled lines' median distance away. ``grids`` has method, row_lines and col_lines.
    """
    lines = grids.where("method <> 'lines'").select("doc_id", "row_lines", "col_lines")
    edges = F.when(F.col("o") == "days-in-rows", F.col("row_lines")).otherwise(F.col("col_lines"))
    centred = lambda df: df.join(lines, "doc_id").withColumn("__e", edges).withColumn(
        "centre", (F.get("__e", F.col("pos")) + F.get("__e", F.col("pos") + 1)) / 2
    ).drop("__e", "row_lines", "col_lines")
    named = centred(axis).withColumn("gap", F.abs(F.col("centre") - F.lag("centre").over(Window.partitionBy(*KEY).orderBy("pos"))))
    gaps = F.array_sort(F.collect_list("gap"))
    spacing = named.groupBy(*KEY).agg(gaps.alias("gaps")).select(
        *KEY, F.get("gaps", F.floor(F.size("gaps") / 2).cast("int")).alias("spacing")
    ).where("spacing is not null")
    free = centred(frame.where("is_data").select(*KEY, "pos").join(axis.select(*KEY, "pos"), [*KEY, "pos"], "left_anti"))
    near = free.select(*KEY, F.col("pos").alias("own"), F.col("centre").alias("at")).join(
        named.select(*KEY, "pos", "centre", "value", "confidence"), KEY
    )
    best = near.groupBy(*KEY, "own", "at").agg(
        F.min_by(F.struct("centre", "value", "confidence"), F.struct(F.abs(F.col("centre") - F.col("at")), "pos")).alias("b")
    )
    close = best.join(spacing, KEY).where(F.abs(F.col("b.centre") - F.col("at")) <= F.col("spacing") * 0.45)
    return close.select(*KEY, F.col("own").alias("pos"), "b.value", F.lit(True).alias("inferred"), (F.col("b.confidence") * 0.9).alias("confidence"))


def axes(at: DataFrame, grids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(days, periods, facts): the labelled positions of both orientations (pos, value, inferred, confidence), and per
    orientation what was read."""
    facts = at.select(*KEY).distinct().join(_best_line(at, "day", "day", "pp", "day"), KEY, "left").join(
        _best_line(at, "period", "period", "dp", "period"), KEY, "left"
    ).na.fill(0, ["day_best", "period_best"])
    facts = facts.where("day_best >= 2 or period_best >= 2").join(grids.select("doc_id", "rows", "cols"), "doc_id")
    lined = at.join(facts, KEY)
    sure = F.col("parse_confidence") * 0.6 + F.col("ocr") * 0.4
    known_days = lined.where("day_best >= 2 and pp = day_line and kind = 'day'").select(
        *KEY, F.col("dp").alias("pos"), day_number(F.col("day")).alias("label"), sure.alias("sure")
    )
    known_periods = lined.where("period_best >= 2 and dp = period_line and kind = 'period' and period is not null").select(
        *KEY, F.col("pp").alias("pos"), F.col("period").alias("label"), sure.alias("sure")
    )
    known_periods = _with_clock(lined, known_periods)
    facts = facts.join(_vote(known_days, "days"), KEY, "left").join(_vote(known_periods, "periods"), KEY, "left").na.fill(
        0, ["days_known", "periods_known"]
    )
    in_rows = F.col("o") == "days-in-rows"
    facts = written(
        facts.withColumn(
            "period_step",
            F.when(F.col("periods_known") >= 2, F.col("periods_vote")).when(in_rows & (F.col("day_line") > F.col("cols") / 2), -1).otherwise(1)
        )
        .withColumn(
            "day_step",
            F.when(F.col("days_known") >= 2, F.col("days_vote")).when(~in_rows & (F.col("period_line") > F.col("cols") / 2), -1).otherwise(1)
        ),
        "axis-facts",
    )

    lesson = (F.col("kind") == "lesson") | ((F.col("kind") == "other") & (F.col("parse_confidence") < 0.5))
    facing = at.join(facts, KEY)
    day_head = ((F.col("period_best") >= 2) & (F.col("dp") == F.col("period_line"))) | F.coalesce(F.col("dp") < F.col("days_first"), F.lit(False)) | F.coalesce(
        F.col("dp") == F.col("period_line"), F.lit(False)
    )
    period_head = F.coalesce(F.col("pp") == F.col("day_line"), F.lit(False)) | F.coalesce(
        (F.col("pp") < F.col("periods_first")) & (F.col("day_line") > F.col("pp")), F.lit(False)
    )
    out = []
    for line, head, known, step, low, high, other in (
        ("dp", day_head, known_days, "day_step", FIRST_SCHOOL_DAY, LAST_SCHOOL_DAY, "periods"),
        ("pp", period_head, known_periods, "period_step", 1, 12, "days")
    ):
        own = "days" if other == "periods" else "periods"
        seen = facing.groupBy(*KEY, F.col(line).alias("pos"), step, "days_known", "periods_known").agg(
            F.max(head).alias("head"), F.max(lesson).alias("lessons")
        )
        frame = seen.withColumn("is_data", ~F.col("head") & F.col("lessons")).join(known, [*KEY, "pos"], "left")
        filled = fill_gaps(frame, KEY, low, high, step).join(known.select(*KEY, "pos", "sure"), [*KEY, "pos"], "left")
        labelled = filled.select(*KEY, "pos", "value", "inferred", F.coalesce("sure", "confidence").alias("confidence"))
        # without two labels of its own, an axis is numbered by position when the other axis was read
        free = frame.where((F.col(f"{own}_known") < 2) & (F.col(f"{other}_known") >= 2)).where("is_data" if own == "periods" else "not head")
        ranked = free.withColumn("i", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("pos") * F.col(step)))).withColumn(
            "n", F.count("*").over(Window.partitionBy(*KEY))
        )
        if own == "days":
            ranked = ranked.where(F.col("n") == LAST_SCHOOL_DAY - FIRST_SCHOOL_DAY + 1)
        numbered = ranked.select(
            *KEY, "pos", F.col("i").alias("value"), F.lit(True).alias("inferred"), F.lit(0.4 if own == "days" else 0.45).alias("confidence")
        )
        axis = labelled.unionByName(numbered.join(labelled.select(*KEY, "pos"), [*KEY, "pos"], "left_anti"))
        if own == "days" and "method" in grids.columns:
            axis = axis.unionByName(_adopted(axis, frame, grids))
        out.append(written(axis, f"axis-{own}"))
    return out[0], out[1], facts


def lessons(cells: DataFrame, grids: DataFrame) -> DataFrame:
    """doc_id, orientation, day, period, class_name, subject, room, raw_text, confidence, row, col.

    ``cells`` are recognised cells with ``ord`` (their order) and ``text``; ``grids`` has doc_id, rows and cols, and method, row_lines
    and col_lines where lines without a label may take that of their neighbour.
    """
    at = written(places(cells, grids), "places")
    days, periods, facts = axes(at, grids)
    distinct = lambda df, name: df.groupBy(*KEY).agg(F.count_distinct("value").alias(name))
    scored = facts.join(distinct(days, "d"), KEY, "left").join(distinct(periods, "p"), KEY, "left").na.fill(0, ["d", "p"])
    score = 2.0 * F.col("days_known") + 1.5 * F.col("periods_known") + F.col("d") + F.col("p")
    chosen = scored.groupBy("doc_id").agg(F.max_by("o", F.struct(score, F.col("o"))).alias("o"))  # in rows unless columns are better

    body = at.join(chosen, KEY).where("kind not in ('day', 'period')")
    d = days.select(*KEY, F.col("pos").alias("dp"), F.col("value").alias("day_no"), F.col("confidence").alias("day_sure"))
    p = periods.select(*KEY, F.col("pos").alias("pp"), F.col("value").alias("period_no"), F.col("confidence").alias("period_sure"))
    placed = body.join(d, [*KEY, "dp"]).join(p, [*KEY, "pp"]).withColumn("at", F.struct("r", "c"))
    cell = placed.groupBy(*KEY, "day_no", "period_no", "ord").agg(
        F.min("at").alias("at"),
        *[F.first(x).alias(x) for x in ("kind", "class_name", "subject", "room", "text", "norm", "parse_confidence", "ocr", "row", "col")],
        F.min_by(F.least("day_sure", "period_sure"), "at").alias("axis_sure")
    )
    full = F.col("kind") != "empty"
    first = lambda value, test: F.min_by(value, F.when(full & test, F.col("at")))
    named, taught = F.col("class_name").isNotNull(), F.col("subject").isNotNull()
    texts = F.array_sort(F.collect_list(F.when(full & (F.trim("text") != ""), F.struct("at", F.trim("text").alias("t")))))
    slot = cell.groupBy(*KEY, "day_no", "period_no").agg(
        F.count_if(full).alias("n"), first("class_name", named).alias("class_name"), first("parse_confidence", named).alias("sure"), first("subject", taught).alias("subject"), first(
            "room", F.col("room").isNotNull()
        ).alias("room"),
        F.avg(F.when(full, F.col("ocr"))).alias("ocr"), first("norm", F.lit(True)).alias("norm"), first("row", F.lit(True)).alias("row"), first("col", F.lit(True)).alias("col"), F.array_join(
            F.transform(texts, lambda t: t["t"]), "\n"
        ).alias("raw_text"), F.min_by("axis_sure", "at").alias("axis_sure"),
    ).where("n > 0")
    parse = F.when(F.col("class_name").isNotNull(), F.col("sure")).when(F.col("subject").isNotNull(), 0.45).otherwise(0.25)
    name = F.coalesce("class_name", F.when(F.col("subject").isNotNull(), "").otherwise(F.substring(F.translate("norm", "\n", " "), 1, 24)))
    confidence = (0.55 * parse + 0.45 * F.col("ocr")) * (0.85 + 0.15 * F.col("axis_sure"))
    day = F.get(F.array(*[F.lit(x) for x in DAY_ORDER]), F.col("day_no"))
    return slot.select(
        "doc_id", F.col("o").alias("orientation"), day.alias("day"), F.col("period_no").alias("period"), name.alias("class_name"), "subject", "room",
        "raw_text", F.greatest(F.lit(0.05), F.least(F.lit(1.0), confidence)).alias("confidence"), "row", "col"
    )


def in_order(found: DataFrame) -> DataFrame:
    """Lessons by document, day (Saturday first) and period."""
    return found.orderBy("doc_id", day_number(F.col("day")), "period")


def labels_read(found: DataFrame) -> DataFrame:
    """doc_id, days and periods of the lessons, each in order."""
    numbers = found.groupBy("doc_id").agg(
        F.array_sort(F.collect_set(day_number(F.col("day")))).alias("d"), F.array_sort(F.collect_set("period")).alias("periods")
    )
    return numbers.select("doc_id", F.transform("d", lambda i: F.get(F.array(*[F.lit(x) for x in DAY_ORDER]), i)).alias("days"), "periods")
