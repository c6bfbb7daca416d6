"""Operators on lessons: one row per (schedule, day, period) reading with its class, confidence and order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jadwal.functions import text
from jadwal.shipping import ship

DAYS, PERIODS = 5, 12


def valid_slots(rows: DataFrame) -> DataFrame:
    """School days (0 to 4) and periods 1 to 12."""
    return rows.where(F.col("day_idx").between(0, DAYS - 1) & F.col("period").between(1, PERIODS))


def first_wins(rows: DataFrame, keys: list[str], value: str, ord_: str = "ord") -> DataFrame:
    """The first reading of every slot, by map-side partial aggregation instead of a sort."""
    return rows.groupBy(*keys).agg(F.min_by(value, ord_).alias(value), F.min(ord_).alias(ord_))


def canonical_classes(rows: DataFrame, group: str, key: str, name: str, conf: str, ord_: str = "ord") -> DataFrame:
    """``rows`` with ``label``: the spelling of their class that has the greatest confidence (first of equals)."""
    labels = rows.groupBy(group, key).agg(F.max_by(name, F.struct(conf, -F.col(ord_))).alias("label"))
    return rows.join(labels, [group, key])


def swap_digit_pairs(rows: DataFrame, group: str, name: str, plain: str | None = None, shown: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """``rows`` with ``fixed``: in a schedule of at least three d/d names whose second numbers are all equal while
    the first ones differ, the pairs were read mirrored and are swapped. ``plain``: the column with the names normalised;
    ``shown`` writes the digits of a fixed name."""
    a, b = (F.regexp_extract(plain or name, r"^([0-9]{1,2})/([0-9]{1,2})$", i) for i in (1, 2))
    seen = (
        rows.where(a != "").groupBy(group)
        .agg(F.count("*").alias("pairs"), F.min(a).alias("a0"), F.max(a).alias("a1"), F.min(b).alias("b0"), F.max(b).alias("b1"))
        .select(group, ((F.col("pairs") >= 3) & (F.col("a0") != F.col("a1")) & (F.col("b0") == F.col("b1"))).alias("mirrored"))
    )
    swapped = F.concat(shown(b), F.lit("/"), shown(a))
    return rows.join(seen, group, "left").withColumn("fixed", F.when(F.col("mirrored") & (a != ""), swapped).otherwise(F.col(name))).drop("mirrored")


def fix_section_style(
    rows: DataFrame, group: str, name: str, alef: str = "ا", written: str = "أ", one: str = "١", letter: str = r"[ء-ي]+", plain: str | None = None, shown: Callable[
        [Column], Column
    ] = lambda c: c
) -> DataFrame:
    """``rows`` with ``fixed``: a bare alef and the digit one are read as what most sections of the schedule are."""
    grade, section = (F.regexp_extract(plain or name, r"^([0-9]{1,2})/([^ \n]+)$", i) for i in (1, 2))
    letters = F.count_if(section.rlike(f"^(?:{letter})$") & (section != alef))
    digits = F.count_if(section.rlike("^[0-9]+$") & (section != "1"))
    style = rows.where(section != "").groupBy(group).agg(F.count("*").alias("n"), letters.alias("letters"), digits.alias("digits"))
    many = F.col("n") >= 3
    to_letter = many & (F.col("letters") > F.col("digits")) & (F.col("letters") >= 2) & section.isin("1", alef)
    to_digit = many & (F.col("digits") > F.col("letters")) & (F.col("digits") >= 2) & (section == alef)
    fixed = F.when(to_letter, F.concat(shown(grade), F.lit(f"/{written}"))).when(
        to_digit, F.concat(shown(grade), F.lit(f"/{one}"))
    ).otherwise(F.col(name))
    return rows.join(style, group, "left").withColumn("fixed", fixed).drop("n", "letters", "digits")


def validated(rows: DataFrame, axes: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """(lessons, verdicts): the lessons with one spelling a class and repaired sections, and per schedule what they are worth.

    ``rows`` has group, period, class_name, conf and ord; ``axes`` has group, days and periods (how many labels each axis shows),
    also for schedules without lessons. Periods outside 1 to 12 are dropped, which is a warning. Verdicts: lessons, dropped,
    quality, ok.
    """
    ship(rows.sparkSession)
    valid = F.coalesce(F.col("period").between(1, PERIODS), F.lit(False))
    key = lambda c: text.class_key(text.normalize_arabic(F.coalesce(c, F.lit(""))))
    good = rows.where(valid).withColumn("__key", key(F.col("class_name")))
    named = canonical_classes(
        good.where("class_name <> ''"), group, "__key", "class_name", "conf"
    ).withColumn("class_name", F.col("label")).drop("label")
    good = named.unionByName(good.where("class_name = '' or class_name is null"))
    for repair in (swap_digit_pairs, fix_section_style):
        plain = good.withColumn("__plain", text.normalize_arabic(F.coalesce("class_name", F.lit(""))))
        good = repair(
            plain, group, "class_name", plain="__plain", shown=text.to_arabic_digits
        ).withColumn("class_name", F.col("fixed")).drop("fixed", "__plain")
    good = good.select(*rows.columns)
    sure = F.col("conf")
    seen = rows.groupBy(group).agg(
        F.count_if(valid).alias("lessons"), F.count_if(~valid).alias("dropped"), F.count_if(valid & (sure >= 0.5)).alias("recognised"),
        F.count_if(valid & (F.col("class_name") != "") & (sure >= 0.35)).alias("with_class"),
    )
    facts = axes.join(seen, group, "left").na.fill(0, ["lessons", "dropped", "recognised", "with_class"])
    q = quality(*[F.col(x) for x in ("days", "periods", "lessons", "recognised", "with_class")])
    return good, facts.select(
        group, "lessons", "dropped", F.round(q, 6).alias("quality"), accepted(F.col("days"), F.col("periods"), F.col("lessons"), q).alias("ok")
    )


def accepted(days: Column, periods: Column, lessons: Column, worth: Column) -> Column:
    return (days >= 3) & (periods >= 3) & (lessons >= 3) & (worth >= 0.45)


def pass_is_good(days_read: Column, periods_read: Column) -> Column:
    """Whether one reading of an image needs no other rotation."""
    return (days_read >= 3) & (periods_read >= 3)


def final_score(assignment: Column, lessons: Column) -> Column:
    """Of an orientation: the score of its axes, and a quarter for each of up to 40 lessons."""
    return assignment + F.least(lessons, F.lit(40)) / 4


def confidence_counts(rows: DataFrame, group: str, conf: str) -> DataFrame:
    c = F.col(conf)
    return rows.groupBy(group).agg(
        F.count_if(c >= 0.8).alias("high"), F.count_if((c >= 0.5) & (c < 0.8)).alias("medium"), F.count_if(c < 0.5).alias("low")
    )


def quality(days: Column, periods: Column, lessons: Column, recognised: Column, with_class: Column) -> Column:
    lesson = F.when(lessons > 0, (0.5 * recognised + 0.5 * with_class) / lessons).otherwise(0.0)
    return 0.35 * F.least(F.lit(1.0), days / 5) + 0.25 * F.least(F.lit(1.0), periods / 5) + 0.4 * lesson


def schedule_quality(rows: DataFrame, group: str, name: str, conf: str) -> DataFrame:
    """Per schedule: days, periods, lessons, quality and whether it is accepted."""
    c = F.col(conf)
    seen = valid_slots(rows).groupBy(group).agg(
        F.count_distinct("day_idx").alias("days"), F.count_distinct("period").alias("periods"), F.count("*").alias("lessons"),
        F.count_if(c >= 0.5).alias("recognised"), F.count_if((F.col(name) != "") & (c >= 0.35)).alias("with_class"),
    )
    q = quality(*[F.col(x) for x in ("days", "periods", "lessons", "recognised", "with_class")])
    ok = accepted(F.col("days"), F.col("periods"), F.col("lessons"), q)
    return seen.select(group, "days", "periods", "lessons", F.round(q, 6).alias("quality"), ok.alias("ok"))


def merge_readings(rows: DataFrame, group: str, name: str, conf: str, source: str, ord_: str = "ord", subject: str | None = None) -> DataFrame:
    """Per slot the fold of its readings in order of source and position.

    The first reading is stored. A reading of the same class, and of no other subject, fills in the subject, raises the confidence and
    renews the review flag; any other is a conflict, asks for review and is kept as an alternative (the first reading too).

    The fold needs no lists of readings: it follows from counts, first and last places and the greatest confidence of each class and
    subject of a slot, which are aggregated before the shuffle.
    """
    keys, at = [group, "day_idx", "period"], F.struct(F.col(source).alias("s"), F.col(ord_).alias("o"))
    taught = F.coalesce(F.col(subject), F.lit("")) if subject else F.lit("")
    items = rows.select(
        *keys, F.col(name).alias("name"), taught.alias("subject"), F.col(conf).alias("conf"), at.alias("at"),
        F.struct(-F.col(source), -F.col(ord_)).alias("__back")
    )
    kinds = items.groupBy(*keys, "name", "subject").agg(
        F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.max("conf").alias("top"), F.max_by(
            "at", F.struct("conf", "__back")
        ).alias("top_at")
    )
    slot = Window.partitionBy(*keys)
    in_order = slot.orderBy("first_at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kinds = kinds.withColumn("own", F.first("name").over(in_order))
    filled = F.first(F.when(F.col("name").eqNullSafe(F.col("own")) & (F.col("subject") != ""), F.col("subject")), ignorenulls=True).over(in_order)
    kinds = kinds.withColumn("filled", F.coalesce(filled, F.lit("")))
    same = F.col("name").eqNullSafe(F.col("own")) & ((F.col("subject") == "") | (F.col("subject") == F.col("filled")))
    merged = kinds.groupBy(*keys).agg(
        F.first("own").alias("name"), F.first("filled").alias("subject"), F.max(F.when(same, F.col("top"))).alias("conf"),
        F.min(
            F.when(same, F.struct(-F.col("top"), F.col("top_at").alias("at")))
        )["at"].alias("raised"), F.max(F.when(~same, F.col("last_at"))).alias("clash"),
        F.coalesce(F.sum(F.when(~same, F.col("n"))), F.lit(0)).alias("others"),
    )
    review = F.coalesce(F.col("clash") > F.col("raised"), F.lit(False)) | (F.col("conf") < 0.5)
    out = [*keys, "name", *(["subject"] if subject else []), "conf", review.alias("review"), (F.col("others") > 0).alias("conflict")]
    return merged.select(*out, F.when(F.col("others") > 0, F.col("others") + 1).otherwise(0).alias("alternatives"))


def merge_facts(merged: DataFrame, images: DataFrame, group: str) -> DataFrame:
    """Per schedule: lessons, days, periods, uncertain and conflicting slots of ``merge_readings``, failed images and warnings.

    ``images`` has group, image (from 1), ok, and warnings (a list, of images that are ok).
    """
    slots = merged.groupBy(group).agg(
        F.count("*").alias("lessons"), F.count_distinct("day_idx").alias("days"), F.count_distinct("period").alias("periods"), F.count_if("review").alias("uncertain"), F.count_if("conflict").alias(
            "conflicts"
        )
    )
    told = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("ok"), F.col("warnings"))))))
    seen = images.groupBy(group).agg(F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("image")))).alias("failed_images"), told.alias("warnings"))
    return seen.join(slots, group, "left").na.fill(0, ["lessons", "days", "periods", "uncertain", "conflicts"])


def accuracy(expected: DataFrame, actual: DataFrame, group: str, name: str) -> DataFrame:
    """Per schedule: correct, expected and extra slots, and correct / max(1, expected + extra)."""
    keys = [group, "day_idx", "period"]
    both = expected.select(*keys, F.col(name).alias("want")).join(actual.select(*keys, F.col(name).alias("got")), keys, "full_outer")
    counts = both.groupBy(group).agg(
        F.count_if(F.col("want") == F.col("got")).alias("correct"), F.count("want").alias("expected"),
        F.count_if(F.col("want").isNull()).alias("extra")
    )
    return counts.withColumn("accuracy", F.round(F.col("correct") / F.greatest(F.lit(1), F.col("expected") + F.col("extra")), 6))


def spans_to_slots(cells: DataFrame, group: str) -> DataFrame:
    """Cells (row, col, row_span, col_span, ord, name, conf) to slots: the spans are unfolded, the later cell covers
    a place, and a slot takes its first class and the mean confidence of its cells with text."""
    places = cells.withColumn("r", F.explode(F.sequence("row", F.col("row") + F.col("row_span") - 1))).withColumn(
        "c", F.explode(F.sequence("col", F.col("col") + F.col("col_span") - 1))
    )
    top = places.groupBy(group, "r", "c").agg(F.max_by(F.struct("ord", "name", "conf"), "ord").alias("cell"))
    text = F.col("cell.name") != ""
    return top.groupBy(group, F.pmod("c", F.lit(7)).alias("day_idx"), (F.pmod("r", F.lit(12)) + 1).alias("period")).agg(
        F.min_by("cell.name", F.when(text, F.col("cell.ord"))).alias("name"), F.round(
            F.avg(F.when(text, F.col("cell.conf"))), 6
        ).alias("conf"), F.count_if(text).alias("cells")
    )


def classes_in_order(rows: DataFrame, group: str, key: str, name: str, palette: list[str], ord_: str = "ord") -> DataFrame:
    """Distinct classes of a schedule in order of appearance, with a colour each."""
    seen = rows.groupBy(group, key).agg(F.min_by(name, ord_).alias("label"), F.min(ord_).alias("first_ord"))
    place = F.row_number().over(Window.partitionBy(group).orderBy("first_ord")) - 1
    return seen.withColumn("place", place).withColumn(
        "color", F.get(F.array(*[F.lit(c) for c in palette]), F.pmod("place", F.lit(len(palette))))
    ).select(group, key, "label", "place", "color")


def colored(rows: DataFrame, group: str, key: str, classes: DataFrame, overrides: DataFrame | None = None, fallback: str = "#e6e8de") -> DataFrame:
    """``rows`` with ``color``: the user's own for the class (group, key, color), else that of ``classes``, else ``fallback``."""
    out = rows.join(classes.select(group, key, F.col("color").alias("__usual")), [group, key], "left")
    own = F.lit(None).cast("string")
    if overrides is not None:
        out, own = out.join(overrides.select(group, key, F.col("color").alias("__own")), [group, key], "left"), F.col("__own")
    return out.withColumn("color", F.coalesce(own, "__usual", F.lit(fallback))).drop("__usual", "__own")


def mistakes(expected: DataFrame, actual: DataFrame, group: str, name: str) -> DataFrame:
    """group, day_idx, period, want, got of every slot that differs; null where a side has none."""
    keys = [group, "day_idx", "period"]
    both = expected.select(*keys, F.col(name).alias("want")).join(actual.select(*keys, F.col(name).alias("got")), keys, "full_outer")
    return both.where(~F.col("want").eqNullSafe(F.col("got")))


def hours(lectures: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """start_hour and end_hour of every row of ``groups`` by its lectures (start and end in minutes); 8 to 12 without any."""
    first, last = F.floor(F.min("start") / 60), F.ceil(F.max("end") / 60)
    seen = lectures.groupBy(*keys).agg(
        F.greatest(F.lit(0), first).cast("int").alias("start_hour"), F.least(F.lit(24), F.greatest(last, first + 1)).cast("int").alias("end_hour")
    )
    return groups.select(*keys).distinct().join(seen, keys, "left").na.fill({"start_hour": 8, "end_hour": 12})


def active_days(used: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """key, day_idx: Sunday to Thursday for every row of ``groups``, and Friday and Saturday where they are used."""
    base = groups.select(key).distinct().withColumn("day_idx", F.explode(F.sequence(F.lit(0), F.lit(DAYS - 1))))
    return base.unionByName(used.where(F.col("day_idx") >= DAYS).select(key, "day_idx").distinct())


# --- the designer's grid: one row per (group, period, day_idx) with subject, classroom, occupied, review, conflict


def empty_grid(spark: SparkSession, periods: int = 7, days: int = DAYS) -> DataFrame:
    """period, day_idx, subject, classroom of an empty week."""
    cells = F.explode(F.sequence(F.lit(1), F.lit(periods))), F.explode(F.sequence(F.lit(0), F.lit(days - 1)))
    return spark.range(1).select(cells[0].alias("period")).select(
        "period", cells[1].alias("day_idx"), F.lit("").alias("subject"), F.lit("").alias("classroom")
    )


def is_filled() -> Column:
    return (F.coalesce("subject", F.lit("")) != "") | (F.coalesce("classroom", F.lit("")) != "") | F.coalesce("occupied", F.lit(False))


def grid_gates(grid: DataFrame, states: DataFrame, group: str) -> DataFrame:
    """Per design of ``states`` (group, source): filled cells, whether it may be applied (no conflict) and exported (reviewed)."""
    seen = grid.groupBy(group).agg(F.count_if(is_filled()).alias("lessons"), F.count_if("conflict").alias("conflicts"))
    joined = states.join(seen, group, "left").na.fill(0, ["lessons", "conflicts"])
    return joined.select(
        group, "lessons", (F.col("conflicts") == 0).alias("can_apply"), ((F.col("lessons") > 0) & (F.col("source") != "photo")).alias("can_export")
    )


def patched(grid: DataFrame, edits: DataFrame, group: str) -> DataFrame:
    """``grid`` after ``edits`` (group, period, day_idx, subject, classroom; null leaves a field): an edited cell asks for no review."""
    keys = [group, "period", "day_idx"]
    own = edits.select(*keys, F.col("subject").alias("__s"), F.col("classroom").alias("__c"), F.lit(True).alias("__edit"))
    both = grid.join(own, keys, "left").withColumn("subject", F.coalesce("__s", "subject")).withColumn("classroom", F.coalesce("__c", "classroom"))
    edit, text_left = F.coalesce("__edit", F.lit(False)), (F.trim("subject") != "") | (F.trim("classroom") != "")
    both = both.withColumn("occupied", F.when(edit, text_left).otherwise(F.col("occupied")))
    return both.withColumn("review", F.col("review") & ~edit).withColumn("conflict", F.col("conflict") & ~edit).select(*grid.columns)


def resized(grid: DataFrame, group: str, periods: int) -> DataFrame:
    """``grid`` with exactly ``periods`` periods: later ones go, missing ones are empty. 1 to 12 periods."""
    periods = max(1, min(PERIODS, periods))
    frame = grid.select(group, "day_idx").distinct().withColumn("period", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    out = frame.join(grid, [group, "period", "day_idx"], "left")
    return out.na.fill({"subject": "", "classroom": "", "occupied": False, "review": False, "conflict": False}).select(*grid.columns)


def boxes(grid: DataFrame, width: float, margin: float, label_width: float, top: float, row_height: float, days: int = DAYS) -> DataFrame:
    """x, y, w, h of every cell (period, day_idx) of a week laid out from right to left, with the labels on the right."""
    column = (width - 2 * margin - label_width) / days
    return grid.withColumn("x", width - margin - label_width - column * (F.col("day_idx") + 1)).withColumn(
        "y", top + row_height * (F.col("period") - 1)
    ).withColumn("w", F.lit(column)).withColumn("h", F.lit(row_height))
