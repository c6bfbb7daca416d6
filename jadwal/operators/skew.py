"""Skew of photographed pages, and the quadrilateral of the table on them, from masks (img, y, x, v) of many images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jadwal.operators import grid, raster


def half_up(c: Column) -> Column:
    """The nearest whole number, halves upwards."""
    return F.floor(F.round(c, 9) + 0.5)


def _variances(points: DataFrame, *more: str) -> DataFrame:
    """img, deg, var: h² times the variance of the row sums after a turn by ``deg``, exactly, for points (img, y, x, h, w, degs).

    Each task adds up its own points before anything is shuffled, so partial sums of rows meet and not points.
    """
    turned = points.select("img", "h", *more, F.explode("degs").alias("deg"), "y", "x", "w")
    angle = F.radians("deg")
    row = half_up(-(F.col("x") - F.col("w") / 2) * F.sin(angle) + (F.col("y") - F.col("h") / 2) * F.cos(angle) + F.col("h") / 2)
    sums = turned.select("img", "h", *more, "deg", row.alias("row")).where("row >= 0 and row < h").groupBy("img", "h", *more, "deg", "row").agg(
        F.count("*").alias("n")
    )
    return sums.groupBy("img", *more, "deg").agg((F.first("h") * F.sum(F.col("n") * F.col("n")) - F.sum("n") * F.sum("n")).alias("var"))


def estimate_skew(mask: DataFrame, side: int = 700, least: int = 200, widest: int = 12) -> DataFrame:
    """img, points, coarse, skew (degrees clockwise) of every image of ``mask``.

    Whole degrees up to ``widest`` are tried on the image reduced to about ``side`` pixels; round the best one, a finer table with steps of a quarter
    is opened, which goes on as long as it improves (three degrees at most). An angle counts if the rows' variance is at least 1.2
    times that of the upright image. Images of fewer than ``least`` points, or without any ink, have skew 0.
    """
    factor = F.greatest(F.lit(1), half_up(F.greatest("h", "w") / side))
    inside = mask.join(raster.sides(mask).withColumn("f", factor), "img").where(
        (F.col("v") == 1) & (F.col("y") % F.col("f") == 0) & (F.col("x") % F.col("f") == 0)
    )
    part = lambda c: F.floor(F.col(c) / F.col("f")).alias(c)
    points = inside.select("img", part("y"), part("x"), part("h"), part("w")).where("y < h and x < w")
    tried = _variances(points.withColumn("degs", F.sequence(F.lit(-widest), F.lit(widest)).cast("array<double>")))
    best = F.max_by(F.struct("deg", "var"), F.struct("var", F.col("deg") == 0, -F.col("deg")))
    coarse = tried.groupBy("img").agg(best.alias("best"), F.coalesce(F.max(F.when(F.col("deg") == 0, F.col("var"))), F.lit(0)).alias("upright"))
    leaning = coarse.where("best.deg <> 0").select(
        "img", F.transform(F.sequence(F.lit(-3), F.lit(12)), lambda k: F.col("best.deg") + k / 4).alias("degs")
    )
    finer = _variances(points.join(leaning, "img")).groupBy("img").agg(F.array_sort(F.collect_list(F.struct("deg", "var"))).alias("finer"))  # 16 angles an image
    step = lambda s, a: F.when((a["deg"] <= s["deg"] + 0.75) & (a["var"] > s["var"]), a).otherwise(s)
    ends = coarse.join(finer, "img", "left").withColumn(
        "end", F.aggregate(F.coalesce("finer", F.array().cast("array<struct<deg:double,var:bigint>>")), F.col("best"), step)
    )
    clear = (F.col("points") >= least) & (F.col("end.var") * 5 >= F.col("upright") * 6) & (F.abs("end.deg") >= 1)
    images = mask.select("img").distinct().join(points.groupBy("img").agg(F.count("*").alias("points")), "img", "left").join(ends, "img", "left")
    return images.select(
        "img", F.coalesce("points", F.lit(0)).alias("points"), F.coalesce("best.deg", F.lit(0.0)).alias("coarse"),
        F.when(clear, F.col("end.deg")).otherwise(0.0).alias("skew")
    )


def edge_coverage(mask: DataFrame, edges: DataFrame, keys: list[str], band: int) -> DataFrame:
    """``keys``, coverage: the share of every other pixel along an edge (img, ax, ay, bx, by) that has ink within ``band``.

    The ink is spread once, so that a point of an edge meets one pixel and no distances between points and edges are computed.
    """
    near = raster.dilate(mask, band, band).where("v = 1").select("img", "y", "x", F.lit(1).alias("hit"))
    length = F.greatest(F.lit(1), half_up(F.sqrt(F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by") - F.col("ay"), 2))))
    steps = edges.withColumn("len", length.cast("long")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), "len", F.lit(2).cast("long"))))
    on = lambda c: half_up(F.col(f"a{c}") + (F.col(f"b{c}") - F.col(f"a{c}")) * F.col("i") / F.col("len")).cast("int").alias(c)
    asked = steps.select(*keys, "len", on("y"), on("x"))
    return asked.join(near, ["img", "y", "x"], "left").groupBy(*keys).agg((F.count("hit") / (F.floor(F.first("len") / 2) + 1)).alias("coverage"))


def table_quads(mask: DataFrame, least: int = 400, skip_full: bool = False) -> DataFrame:
    """img, label, tl, tr, br, bl (structs of y and x), framed: the table of each image that has one.

    The largest component of the ink spread by one, by its bounds, whose bounds hold 0.12 of the image, are 0.3 wide and 0.15
    high, and whose opposite edges differ by less than 0.4; with ``skip_full``, one that fills the image is passed over. ``framed`` says that three of its
    edges have ink along half of their length.
    """
    size = raster.sides(mask)
    spread = raster.dilate(mask, 1, 1).where("v = 1")
    labelled = grid.labelled(spread)
    cells = labelled.withColumn("ord", F.col("y").cast("long") * grid.SIDE + F.col("x"))
    shape = cells.groupBy("img", "label").agg(
        F.count("*").alias("area"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1")
    )
    bw, bh = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    large = (F.col("area") >= least) & (bw * bh >= F.col("h") * F.col("w") * 0.12) & (bw >= F.col("w") * 0.3) & (bh >= F.col("h") * 0.15)
    if skip_full:
        large &= ~((bw >= F.col("w") * 0.9) & (bh >= F.col("h") * 0.9))
    fit = shape.join(size, "img").where(large).select("img", "label", (bw * bh).alias("bounds"), "h", "w")
    corners = grid.corners(cells.join(fit.select("img", "label"), ["img", "label"], "left_semi"), ["img", "label"])
    away = lambda a, b: F.sqrt(F.pow(F.col(f"{a}.x") - F.col(f"{b}.x"), 2) + F.pow(F.col(f"{a}.y") - F.col(f"{b}.y"), 2))
    alike = lambda p, q: F.least(p, q) / F.greatest(p, q) >= 0.6
    even = alike(away("top_left", "top_right"), away("bottom_left", "bottom_right")) & alike(
        away("top_left", "bottom_left"), away("top_right", "bottom_right")
    )
    first = F.max_by(F.struct("label", "top_left", "top_right", "bottom_right", "bottom_left", "h", "w"), F.struct("bounds", -F.col("label")))
    chosen = corners.join(fit, ["img", "label"]).where(even).groupBy("img").agg(first.alias("q")).select("img", "q.*")
    names = ["top_left", "top_right", "bottom_right", "bottom_left"]
    sides = F.array(
        *[
            F.struct(
                F.lit(i).alias("edge"), F.col(f"{a}.x").alias("ax"), F.col(f"{a}.y").alias("ay"), F.col(f"{b}.x").alias("bx"),
                F.col(f"{b}.y").alias("by")
            ) for i,
            (a, b) in enumerate(zip(names, names[1:] + names[:1], strict=True))
        ]
    )
    edges = chosen.withColumn("band", F.greatest(F.lit(3), half_up(F.greatest("w", "h") * 0.008)).cast("int")).select(
        "img", "band", F.explode(sides).alias("e")
    ).select("img", "band", "e.*")
    covered = None
    for band in sorted(r["band"] for r in edges.select("band").distinct().collect()):  # the image sizes' few bands
        part = edge_coverage(mask, edges.where(F.col("band") == band), ["img", "edge"], band)
        covered = part if covered is None else covered.unionByName(part)
    if covered is None:
        return chosen.select("img", "label", *names, F.lit(False).alias("framed"))
    framed = covered.groupBy("img").agg((F.count_if(F.col("coverage") >= 0.5) >= 3).alias("framed"))
    return chosen.join(framed, "img").select("img", "label", *names, "framed")


def expanded(quads: DataFrame, margin: float, size: DataFrame) -> DataFrame:
    """``quads`` (img and corners) with every corner ``margin`` pixels further from the middle, within the image (img, h, w)."""
    names = ["top_left", "top_right", "bottom_right", "bottom_left"]
    middle = lambda c: sum((F.col(f"{n}.{c}") for n in names), F.lit(0.0)) / 4
    dy, dx = (lambda n: F.col(f"{n}.y") - F.col("my")), (lambda n: F.col(f"{n}.x") - F.col("mx"))
    long = lambda n: F.sqrt(dy(n) * dy(n) + dx(n) * dx(n))
    reach = lambda n: F.when(long(n) == 0, 1.0).otherwise(long(n))
    end = lambda n, c, d, most: F.greatest(F.lit(0.0), F.least(F.col(most) - 1.0, F.col(f"{n}.{c}") + d(n) / reach(n) * margin))
    moved = [F.struct(end(n, "y", dy, "h").alias("y"), end(n, "x", dx, "w").alias("x")).alias(n) for n in names]
    return quads.join(size, "img").withColumn("my", middle("y")).withColumn("mx", middle("x")).select("img", *moved)


def quad_skew(quads: DataFrame) -> DataFrame:
    """img, degrees: the mean slope of the upper and the lower edge."""
    slope = lambda a, b: F.atan2(F.col(f"{b}.y") - F.col(f"{a}.y"), F.col(f"{b}.x") - F.col(f"{a}.x"))
    return quads.select("img", F.degrees((slope("top_left", "top_right") + slope("bottom_left", "bottom_right")) / 2).alias("degrees"))
