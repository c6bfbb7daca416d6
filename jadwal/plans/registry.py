"""Queries over the driver's tables, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jadwal.functions import fuzzy, text
from jadwal.operators import axes, grid, lessons, numeric
from jadwal.plans import images, readings
from jadwal.plans.oracle import ORACLE as TABLE_SQL
from jadwal.plans.oracle import TYPOS
from jadwal.plans.slots import slots, table

# The designer's colours.
PALETTE = ["#8fd3ad", "#93b4f2", "#f6c65a", "#f29bbd", "#7fd0d6", "#c3a4f0", "#f5a07f", "#c9dd6e", "#86bde6", "#e2b58f"]
SLOT = ["sched", "day_idx", "period"]


def slot_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return lessons.first_wins(lessons.valid_slots(slots(spark, d)), SLOT, "class_raw")


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    return slots(spark, d).withColumn("class_key", text.class_key(text.fold("class_raw")))


def class_key_canonical(spark: SparkSession, d: str) -> DataFrame:
    labelled = lessons.canonical_classes(_keyed(spark, d), "sched", "class_key", "class_raw", "conf")
    return labelled.groupBy("sched", "class_key", "label").agg(
        F.count("*").alias("lessons"), F.count_if(F.col("class_raw") != F.col("label")).alias("changed")
    )


def section_style_fix(spark: SparkSession, d: str) -> DataFrame:
    first = lessons.first_wins(lessons.valid_slots(slots(spark, d)), SLOT, "class_name")
    return lessons.fix_section_style(
        first, "sched", "class_name", alef="a", written="A", one="1", letter="[a-z]+"
    ).select(*SLOT, "class_name", "fixed")


def digit_pair_swap(spark: SparkSession, d: str) -> DataFrame:
    first = lessons.first_wins(lessons.valid_slots(slots(spark, d)), SLOT, "pair_name")
    return lessons.swap_digit_pairs(first, "sched", "pair_name").select(*SLOT, "pair_name", "fixed")


def confidence_bands(spark: SparkSession, d: str) -> DataFrame:
    return lessons.confidence_counts(slots(spark, d), "sched", "conf")


def schedule_quality(spark: SparkSession, d: str) -> DataFrame:
    return lessons.schedule_quality(slots(spark, d), "sched", "class_name", "conf")


def week_grid_pivot(spark: SparkSession, d: str) -> DataFrame:
    named = slots(spark, d).select(
        "sched", "period", F.get(F.array(*[F.lit(x) for x in ("sun", "mon", "tue", "wed", "thu", "fri", "sat")]), "day_idx").alias("day")
    )
    return named.groupBy("sched", "period").pivot("day", ["sun", "mon", "tue", "wed", "thu"]).agg(F.count(F.lit(1))).na.fill(0)


def source_merge_conflicts(spark: SparkSession, d: str) -> DataFrame:
    readings = lessons.valid_slots(slots(spark, d)).withColumn("image", F.col("ord") % 3)
    merged = lessons.merge_readings(readings, "sched", "class_name", "conf", "image")
    return merged.select(
        *SLOT, "name", F.round("conf", 6).alias("conf"), "review", "conflict", F.col("alternatives").cast("long").alias("alternatives")
    )


def _line(spark: SparkSession, d: str) -> DataFrame:
    """12 positions per schedule and day; the label is read where the number of events is no multiple of three."""
    counted = slots(spark, d).groupBy("sched", "day_idx", "period").agg(F.count("*").alias("n"))
    label = F.col("period") + F.when((F.col("sched") % 2 == 1) & (F.col("period") > 6), 1).otherwise(0)
    frame = counted.select("sched", "day_idx").distinct().withColumn("pos", F.explode(F.sequence(F.lit(1), F.lit(12))))
    seen = counted.select(
        "sched", "day_idx", F.col("period").alias("pos"), F.when(F.col("n") % 3 != 0, label).alias("label"), F.lit(True).alias("seen")
    )
    return frame.join(seen, ["sched", "day_idx", "pos"], "left").select(
        "sched", "day_idx", "pos", "label", F.coalesce("seen", F.lit(False)).alias("is_data")
    )


def period_gap_fill(spark: SparkSession, d: str) -> DataFrame:
    return axes.fill_gaps(_line(spark, d), ["sched", "day_idx"])


def direction_vote(spark: SparkSession, d: str) -> DataFrame:
    labels = slots(spark, d).groupBy("sched", "day_idx", "minute").agg(F.min_by("period", "ord").alias("period"))
    return axes.direction_vote(labels, ["sched", "day_idx"], "minute", "period")


def time_rank_periods(spark: SparkSession, d: str) -> DataFrame:
    h = slots(spark, d).groupBy("sched", "day_idx", F.col("period").alias("pos")).agg(F.min("minute").alias("minute"), F.count("*").alias("n"))
    return axes.rank_by_clock(h.withColumn("label", F.when(F.col("n") % 3 == 0, F.col("pos"))), ["sched", "day_idx"])


def axis_choice(spark: SparkSession, d: str) -> DataFrame:
    s = slots(spark, d).withColumn("orientation", F.when(F.col("ord") % 2 == 0, "rows").otherwise("columns"))
    days = s.select("sched", "orientation", F.lit("day").alias("kind"), F.col("day_idx").alias("value"), (F.col("ord") % 6).alias("pos"))
    return axes.axis_scores(
        days.unionByName(
            s.select("sched", "orientation", F.lit("period").alias("kind"), F.col("period").alias("value"), (F.col("ord") % 7).alias("pos"))
        ),
        "sched"
    )


def palette_assignment(spark: SparkSession, d: str) -> DataFrame:
    return lessons.classes_in_order(_keyed(spark, d), "sched", "class_key", "class_raw", PALETTE)


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    return slots(spark, d).select("ord", "sched", "day_idx", F.col("minute").alias("start"), F.least(F.col("minute") + 50, F.lit(1440)).alias("end"))


def hour_range(spark: SparkSession, d: str) -> DataFrame:
    rows = _intervals(spark, d)
    return lessons.hours(rows, rows, ["sched", "day_idx"])


def active_days(spark: SparkSession, d: str) -> DataFrame:
    used = slots(spark, d).select("sched", "day_idx")
    return lessons.active_days(used, used, "sched")


def interval_clip_layout(spark: SparkSession, d: str) -> DataFrame:
    rows = _intervals(spark, d)
    inside = rows.where("start between 480 and 900")
    usual = lessons.hours(inside, inside, ["sched", "day_idx"])
    lo, hi = F.col("start_hour") * 60, F.col("end_hour") * 60
    top, bottom = F.greatest("start", lo), F.least("end", hi)
    return rows.join(usual, ["sched", "day_idx"]).where((F.col("end") > lo) & (F.col("start") < hi)).select(
        "ord", "sched", "day_idx", (top - lo).alias("top"), F.greatest(bottom - top, F.lit(36)).alias("height")
    )


def accuracy_score(spark: SparkSession, d: str) -> DataFrame:
    s = lessons.valid_slots(slots(spark, d))
    sides = [lessons.first_wins(s.where(f"ord % 2 = {i}"), SLOT, "class_name") for i in (0, 1)]
    return lessons.accuracy(*sides, "sched", "class_name")


def clock_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.first_time(F.col("text")).alias("minutes")).where("minutes is not null")


def token_letters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        "p_partkey", F.size(text.tokens(F.col("p_name"))).alias("n_tokens"), text.letters_only(F.col("p_name")).alias("letters")
    )


def noise_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", text.strip_noise(F.col("text"), ["the", "of", "and"]).alias("clean"))


def json_ingest(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k double")["k"]
    return table(spark, d, "events").select("event_id", F.when(k == F.floor(k), k.cast("long")).alias("k")).where("k is not null")


def fuzzy_best_match(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "part").select(F.explode(text.tokens(F.lower("p_name"))).alias("word"))
    lexicon = spark.range(1).select(
        F.posexplode(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("variant")) for k, v in TYPOS])).alias("ord", "e")
    ).select("ord", "e.*")
    return fuzzy.best_match(words, "word", lexicon, 0.6).select("text", "key", "variant", F.round("score", 6).alias("score"))


def upper_median(spark: SparkSession, d: str) -> DataFrame:
    return numeric.upper_median(table(spark, d, "orders"), "o_orderpriority", "o_totalprice")


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return numeric.histogram(table(spark, d, "lineitem"), F.least(F.lit(255), F.floor(F.col("l_extendedprice") / 400)))


def otsu_threshold(spark: SparkSession, d: str) -> DataFrame:
    return numeric.otsu(_levels(spark, d))


def percentile_stretch(spark: SparkSession, d: str) -> DataFrame:
    return numeric.percentile_cut(_levels(spark, d), 0.02, 0.98)


def peak_islands(spark: SparkSession, d: str) -> DataFrame:
    profile = slots(spark, d).groupBy(F.col("minute").alias("pos")).agg(F.count("*").alias("v"))
    level = profile.agg(F.avg("v").alias("level"))
    return numeric.peak_islands(profile.crossJoin(F.broadcast(level)), F.col("level"))


def center_clusters(spark: SparkSession, d: str) -> DataFrame:
    return numeric.clusters(table(spark, d, "part"), "p_retailprice", 1.5)


def nearest_center(spark: SparkSession, d: str) -> DataFrame:
    centres = table(spark, d, "nation").select(F.col("n_nationkey").alias("idx"), (F.col("n_nationkey") * 20000.0).alias("centre"))
    return numeric.nearest(table(spark, d, "orders"), "o_totalprice", centres).groupBy("idx").agg(
        F.count("*").alias("n"), F.round(F.max(F.abs(F.col("o_totalprice") - F.col("centre"))), 4).alias("farthest")
    )


def _grid(spark: SparkSession, d: str) -> DataFrame:
    counted = slots(spark, d).groupBy(F.col("day_idx").alias("y"), F.floor(F.col("minute") / 60).cast("int").alias("x")).agg(F.count("*").alias("n"))
    frame = spark.range(7 * 24).select((F.col("id") / 24).cast("int").alias("y"), (F.col("id") % 24).cast("int").alias("x"))
    return frame.join(counted, ["y", "x"], "left").select("y", "x", F.coalesce("n", F.lit(0)).alias("v"))


def integral_box_mean(spark: SparkSession, d: str) -> DataFrame:
    return grid.box_mean(_grid(spark, d))


def _mask(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d)
    return g.crossJoin(F.broadcast(g.agg(F.avg("v").alias("mean")))).select("y", "x", (F.col("v") > F.col("mean")).cast("int").alias("v"))


def dilate_erode_grid(spark: SparkSession, d: str) -> DataFrame:
    return grid.morphology(_mask(spark, d))


def grid_components(spark: SparkSession, d: str) -> DataFrame:
    return grid.components(_mask(spark, d), 24)


def components_by_size(spark: SparkSession, d: str) -> DataFrame:
    return grid.by_size(grid.components(_mask(spark, d), 24))


def template_dice(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return numeric.template_scores(e, e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("t")), "vec_id", "embedding")


def _cells(spark: SparkSession, d: str) -> DataFrame:
    s = slots(spark, d)
    return s.select(
        "sched", "ord", (F.col("period") - 1).alias("row"), F.col("day_idx").alias("col"), (F.col("ord") % 2 + 1).cast("int").alias("row_span"),
        (F.col("ord") % 3 + 1).cast("int").alias("col_span"), F.when(F.col("ord") % 5 == 0, "").otherwise(F.col("class_name")).alias("name"), "conf"
    )


def cell_spans_to_slots(spark: SparkSession, d: str) -> DataFrame:
    return lessons.spans_to_slots(_cells(spark, d), "sched")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with spans to slots, one spelling per class, and the quality of every schedule."""
    found = lessons.spans_to_slots(_cells(spark, sf_dir), "sched").where("name is not null")
    keyed = found.withColumn("class_key", text.class_key(text.fold("name"))).withColumn("ord", F.col("day_idx") * 12 + F.col("period"))
    labelled = lessons.canonical_classes(keyed, "sched", "class_key", "name", "conf")
    return lessons.schedule_quality(labelled.select("sched", "day_idx", "period", "label", "conf"), "sched", "label", "conf")


QUERIES = {
    f.__name__: f
    for f in (
        slot_first_wins, class_key_canonical, section_style_fix, digit_pair_swap, confidence_bands, schedule_quality, week_grid_pivot,
        source_merge_conflicts, period_gap_fill, direction_vote,
        time_rank_periods, axis_choice, palette_assignment, hour_range, active_days, interval_clip_layout, accuracy_score, clock_extract,
        token_letters, noise_strip, json_ingest, fuzzy_best_match,
        upper_median, otsu_threshold, percentile_stretch, peak_islands, center_clusters, nearest_center, integral_box_mean, dilate_erode_grid,
        grid_components, template_dice, cell_spans_to_slots, components_by_size,
    )
}
QUERIES["flagship"] = flagship
QUERIES |= images.QUERIES | readings.QUERIES
ORACLE = TABLE_SQL | {"components_by_size": TABLE_SQL["grid_components"]} | images.ORACLE | readings.ORACLE
