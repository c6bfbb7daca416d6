"""Statistics kernels: medians, histograms, thresholds, runs and clusters, without sorting a whole column in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_TEMPLATES = 10_000
MOST_CENTRES = 10_000


def upper_median(rows: DataFrame, key: str, value: str, bins: int = 4096) -> DataFrame:
    """Per key the element at place floor(n/2) of the sorted values.

    Exact in two passes: a histogram of ``bins`` per key finds the bin that holds the place, and only that bin's
    values are counted one by one. Null values are ignored.
    """
    rows = rows.where(F.col(value).isNotNull())
    ends = rows.groupBy(key).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n"))
    width = F.col("high") - F.col("low")
    place = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("low")) / width * bins))).otherwise(0)
    binned = rows.join(ends, key).withColumn("bin", place)
    upto = Window.partitionBy(key).orderBy("bin")
    cumulative = binned.groupBy(key, "bin", "n").count().withColumn("upto", F.sum("count").over(upto))
    target = F.floor(F.col("n") / 2)
    chosen = cumulative.where((F.col("upto") > target) & (F.col("upto") - F.col("count") <= target)).select(
        key, "bin", (target - F.col("upto") + F.col("count")).alias("skip")
    )
    inside = binned.join(chosen, [key, "bin"]).groupBy(key, "skip", value).count()
    seen = inside.withColumn("upto", F.sum("count").over(Window.partitionBy(key).orderBy(value)))
    return seen.where((F.col("upto") > F.col("skip")) & (F.col("upto") - F.col("count") <= F.col("skip"))).select(key, F.col(value).alias("median"))


def histogram(rows: DataFrame, level: Column) -> DataFrame:
    """level (0 to 255), n."""
    return rows.groupBy(level.cast("int").alias("level")).agg(F.count("*").alias("n")).where("level between 0 and 255")


def otsu(hist: DataFrame) -> DataFrame:
    """threshold: the level that separates the two classes best (the first of equals; 127 when nothing separates).

    The histogram has at most 256 rows, so one window over it is small at any input size.
    """
    w = Window.partitionBy().orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    t = hist.select(
        "level", "n", F.sum("n").over(w).alias("wb"), F.sum(F.col("n") * F.col("level")).over(w).alias("sb"), F.sum("n").over(every).alias("total"),
        F.sum(F.col("n") * F.col("level")).over(every).alias("whole")
    )
    wf = F.col("total") - F.col("wb")
    gap = F.col("sb") / F.col("wb") - (F.col("whole") - F.col("sb")) / wf
    between = F.when(wf > 0, F.col("wb").cast("double") * wf * gap * gap)
    return t.select("level", F.round(between, 2).alias("between")).where("between > 0").agg(
        F.coalesce(F.max_by("level", F.struct("between", -F.col("level"))), F.lit(127)).alias("threshold")
    )


def percentile_cut(hist: DataFrame, low: float, high: float, least: int = 30) -> DataFrame:
    """lo, hi, stretched: the first level from below with ``low`` of all, from above with 1 - ``high``."""
    every = Window.partitionBy()
    below = F.sum("n").over(Window.partitionBy().orderBy("level").rowsBetween(Window.unboundedPreceding, 0))
    above = F.sum("n").over(Window.partitionBy().orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0))
    t = hist.select("level", below.alias("below"), above.alias("above"), F.sum("n").over(every).alias("total"))
    ends = t.agg(
        F.min(F.when(F.col("below") >= F.col("total") * low, F.col("level"))).alias("lo"),
        F.max(F.when(F.col("above") >= F.col("total") * (1 - high), F.col("level"))).alias("hi")
    )
    return ends.withColumn("stretched", F.col("hi") - F.col("lo") >= least)


def peak_islands(profile: DataFrame, threshold: Column) -> DataFrame:
    """Runs of positions (pos, v) whose value reaches the threshold: first, last, strength, centre by weight.

    A profile is one projection (bounded by the image or the day), not the raw rows.
    """
    high = profile.where(F.col("v") >= threshold)
    run = high.withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy().orderBy("pos")))
    return run.groupBy("run").agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"), F.max("v").alias("strength"),
        F.round(F.sum(F.col("pos") * F.col("v")) / F.sum("v"), 6).alias("centre")
    ).drop("run")


def clusters(rows: DataFrame, value: str, tolerance: float, stretch: int = 4096) -> DataFrame:
    """Sorted values, cut where the gap to the previous one exceeds ``tolerance``: first, last, n, mean.

    Values in one bin of the tolerance's width always belong together. Bins are cut within stretches of ``stretch`` bins, and the
    stretches' borders are joined up over one row a stretch, so no window sees all rows or all bins.
    """
    exact = F.col(value).cast("decimal(38,6)")
    bins = rows.where(F.col(value).isNotNull()).groupBy(F.floor(F.col(value) / tolerance).alias("bin")).agg(
        F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("n"), F.sum(exact).alias("total")
    )
    w = Window.partitionBy("part").orderBy("bin")
    placed = bins.withColumn("part", F.floor(F.col("bin") / stretch))
    cut = placed.withColumn("cut", F.when(F.col("lo") - F.lag("hi").over(w) > tolerance, 1).otherwise(0)).withColumn("inner", F.sum("cut").over(w))
    ends = cut.groupBy("part").agg(F.min_by("lo", "bin").alias("lo"), F.max_by("hi", "bin").alias("hi"), F.sum("cut").alias("cuts"))
    order = Window.partitionBy().orderBy("part")
    border = F.when(F.col("lo") - F.lag("hi").over(order) > tolerance, 1).otherwise(0)
    before = F.sum(F.col("border") + F.coalesce("earlier", F.lit(0))).over(order)
    offsets = ends.withColumn("border", border).withColumn("earlier", F.lag("cuts").over(order)).select("part", before.alias("offset"))
    numbered = cut.join(offsets, "part").withColumn("cluster", F.col("offset") + F.col("inner"))
    return numbered.groupBy("cluster").agg(
        F.min("lo").alias("first"), F.max("hi").alias("last"), F.sum("n").alias("n"),
        F.round(F.sum("total").cast("double") / F.sum("n"), 4).alias("mean")
    ).drop("cluster")


def nearest(rows: DataFrame, value: str, centres: DataFrame) -> DataFrame:
    """``rows`` with the nearest centre (idx, centre); of equally near ones the lower idx.

    Centres are the lines of a grid: at most MOST_CENTRES, which is checked before they are sent to every task.
    """
    if centres.limit(MOST_CENTRES + 1).count() > MOST_CENTRES:
        raise ValueError(f"at most {MOST_CENTRES} centres")
    listed = centres.agg(F.array_sort(F.collect_list(F.struct("idx", F.col("centre").cast("double").alias("centre")))).alias("__centres"))
    best = F.array_min(
        F.transform(
            "__centres", lambda c: F.struct(F.abs(F.col(value) - c["centre"]).alias("distance"), c["idx"].alias("idx"), c["centre"].alias("centre"))
        )
    )
    return rows.crossJoin(F.broadcast(listed)).withColumn("__best", best).withColumn("idx", F.col("__best.idx")).withColumn("centre", F.col("__best.centre")).drop(
        "__best", "__centres"
    )


def template_scores(samples: DataFrame, templates: DataFrame, key: str, vector: str) -> DataFrame:
    """For each sample the template (label, t) with the best Dice score 2ab / (a² + b² + 1e-6); the lower label of equals.

    Templates are a fixed dimension of at most MOST_TEMPLATES rows, which is checked.
    """
    if templates.limit(MOST_TEMPLATES + 1).count() > MOST_TEMPLATES:
        raise ValueError(f"at most {MOST_TEMPLATES} templates")
    product = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    pairs = samples.select(key, vector).crossJoin(F.broadcast(templates.select("label", "t")))
    score = 2 * product(vector, "t") / (product(vector, vector) + product("t", "t") + 1e-6)
    return pairs.withColumn("score", F.round(score, 6)).groupBy(key).agg(F.max_by(F.struct("label", "score"), F.struct("score", -F.col("label"))).alias("m")).select(
        key, F.col("m.label").alias("template"), "m.score"
    )
