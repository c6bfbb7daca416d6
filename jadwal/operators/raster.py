"""Raster operators on tables of pixels (img, y, x, v), for many images at once.

``v`` is a gray level (0 is black) or a mask (1 is ink). Every window runs along one row or one column of one image, so
the work spreads over all images and is bounded by an image's side; box operators are two such passes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from jadwal.storage import written

PIXEL = ["img", "y", "x"]
FILL = {"y": "x", "x": "y"}


def along(axis: str, radius: int) -> WindowSpec:
    """The places within ``radius`` on the line of a pixel that runs along ``axis``."""
    return Window.partitionBy("img", FILL[axis]).orderBy(axis).rangeBetween(-radius, radius)


def _rounded(c: Column) -> Column:
    return F.floor(F.round(c, 9) + 0.5).cast("int")


def gray(pixels: DataFrame) -> DataFrame:
    """Rec. 601 luma of (img, y, x, r, g, b, a) over white."""
    share = F.col("a") / 255
    over = lambda c: F.col(c) * share + 255 * (1 - share)
    return pixels.select(*PIXEL, _rounded(0.299 * over("r") + 0.587 * over("g") + 0.114 * over("b")).alias("v"))


def sides(grid: DataFrame) -> DataFrame:
    """img, h, w."""
    return grid.groupBy("img").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


def crop(grid: DataFrame, y0: int, x0: int, height: int, width: int) -> DataFrame:
    inside = grid.where(F.col("y").between(y0, y0 + height - 1) & F.col("x").between(x0, x0 + width - 1))
    return inside.select("img", (F.col("y") - y0).alias("y"), (F.col("x") - x0).alias("x"), "v")


def pad(grid: DataFrame, border: int, value: int = 255) -> DataFrame:
    """With a border of ``value`` on all sides."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) + (2 * border - 1)))
    frame = sides(grid).withColumn("y", every("h")).withColumn("x", every("w")).select(*PIXEL)
    moved = grid.select("img", (F.col("y") + border).alias("y"), (F.col("x") + border).alias("x"), "v")
    return frame.join(moved, PIXEL, "left").select(*PIXEL, F.coalesce("v", F.lit(value)).alias("v"))


def rotate(grid: DataFrame, angle: int) -> DataFrame:
    """Clockwise by 0, 90, 180 or 270 degrees."""
    if angle == 0:
        return grid.select(*PIXEL, "v")
    low, right = F.col("h") - 1 - F.col("y"), F.col("w") - 1 - F.col("x")
    y, x = {90: (F.col("x"), low), 180: (low, right), 270: (right, F.col("y"))}[angle]
    return grid.join(sides(grid), "img").select("img", y.alias("y"), x.alias("x"), "v")


def downscale(grid: DataFrame, factor: float) -> DataFrame:
    """Mean of the pixels that each target pixel covers; a factor of 1 or less changes nothing."""
    if factor <= 1:
        return grid.select(*PIXEL, "v")
    target = lambda c: (F.ceil((F.col(c) + 1) / factor) - 1).cast("int").alias(c)
    size = sides(grid).select("img", *[F.greatest(F.lit(1), F.floor(F.col(c) / factor)).alias(c) for c in ("h", "w")])
    means = grid.select("img", target("y"), target("x"), "v").groupBy(*PIXEL).agg(_rounded(F.avg("v")).alias("v"))
    return means.join(size, "img").where("y < h and x < w").select(*PIXEL, "v")


def _corners(place: str, old: str, new: int) -> Column:
    """The two source places of a target place and their weights."""
    at = F.least(F.col(old) - 1, (F.col(place) + 0.5) * (F.col(old) / new) - 0.5)
    first = F.greatest(F.lit(0), F.floor(at)).cast("int")
    part = lambda p, w: F.struct(p.cast("int").alias("at"), w.alias("weight"))
    return F.explode(F.array(part(first, 1 - (at - first)), part(F.least(F.col(old) - 1, first + 1), at - first)))


def resize(grid: DataFrame, height: int, width: int) -> DataFrame:
    """Bilinear, by pixel centres."""
    frame = sides(grid).withColumn("ty", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn(
        "tx", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))
    )
    asked = frame.withColumn("cy", _corners("ty", "h", height)).withColumn("cx", _corners("tx", "w", width))
    asked = asked.select(
        "img", "ty", "tx", F.col("cy.at").alias("y"), F.col("cx.at").alias("x"), (F.col("cy.weight") * F.col("cx.weight")).alias("weight")
    )
    sums = asked.join(grid, PIXEL).groupBy("img", "ty", "tx").agg(_rounded(F.sum(F.col("weight") * F.col("v"))).alias("v"))
    return sums.select("img", F.col("ty").alias("y"), F.col("tx").alias("x"), "v")


def stretch(grid: DataFrame, low: float = 0.02, high: float = 0.98, least: int = 30) -> DataFrame:
    """Levels spread between each image's percentiles; images whose levels span less than ``least`` stay."""
    counts = grid.groupBy("img", "v").agg(F.count("*").alias("n"))
    upto = lambda order: F.sum("n").over(Window.partitionBy("img").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy("img"))
    marked = counts.select("img", "v", (upto(F.col("v")) >= total * low).alias("low"), (upto(F.desc("v")) >= total * (1 - high)).alias("high"))
    ends = marked.groupBy("img").agg(F.min(F.when(F.col("low"), F.col("v"))).alias("lo"), F.max(F.when(F.col("high"), F.col("v"))).alias("hi"))
    spread = F.greatest(F.lit(0), F.least(F.lit(255), _rounded((F.col("v") - F.col("lo")) * 255 / (F.col("hi") - F.col("lo")))))
    return grid.join(ends, "img").select(*PIXEL, F.when(F.col("hi") - F.col("lo") < least, F.col("v")).otherwise(spread).cast("int").alias("v"))


def box(grid: DataFrame, radius: int) -> DataFrame:
    """``grid`` with mean: that of the square around each pixel, clipped at the edges."""
    rows = grid.withColumn("__s", F.sum("v").over(along("x", radius))).withColumn("__n", F.count("v").over(along("x", radius)))
    down = along("y", radius)
    return rows.withColumn("mean", F.sum("__s").over(down) / F.sum("__n").over(down)).drop("__s", "__n")


def blur(grid: DataFrame) -> DataFrame:
    return box(grid, 1).select(*PIXEL, _rounded(F.col("mean")).alias("v"))


def adaptive_mask(grid: DataFrame, window: int = 31, constant: float = 12) -> DataFrame:
    """Ink where a pixel is darker than its surroundings' mean less ``constant``."""
    return box(grid, max(1, window // 2)).select(*PIXEL, (F.col("v") < F.col("mean") - constant).cast("int").alias("v"))


def global_mask(grid: DataFrame, level: float) -> DataFrame:
    return grid.select(*PIXEL, (F.col("v") < level).cast("int").alias("v"))


def _spread(mask: DataFrame, rx: int, ry: int, end: Callable[[str], Column]) -> DataFrame:
    for axis, radius in (("x", rx), ("y", ry)):
        if radius > 0:
            mask = mask.withColumn("v", end("v").over(along(axis, radius)))
    return mask.select(*PIXEL, "v")


def dilate(mask: DataFrame, rx: int, ry: int) -> DataFrame:
    return _spread(mask, rx, ry, F.max)


def erode(mask: DataFrame, rx: int, ry: int) -> DataFrame:
    return _spread(mask, rx, ry, F.min)


def opened(mask: DataFrame, radius: int) -> DataFrame:
    """Regions thicker than twice ``radius``."""
    return dilate(erode(mask, radius, radius), radius, radius)


def combined(a: DataFrame, b: DataFrame, how: Callable[[Column, Column], Column]) -> DataFrame:
    """Two masks of the same images pixel by pixel, as with ``Column.bitwiseOR`` or ``Column.bitwiseXOR``."""
    return a.join(b.withColumnRenamed("v", "__w"), PIXEL).select(*PIXEL, how(F.col("v"), F.col("__w")).alias("v"))


def without_lines(ink: DataFrame, lines: DataFrame, radius: int = 1) -> DataFrame:
    """Ink that is not within ``radius`` of a line."""
    return combined(ink, dilate(lines, radius, radius), lambda v, line: v * (1 - line))


def runs(hits: DataFrame, group: list[str], pos: str, gap: int) -> DataFrame:
    """first and last of the runs of positions, across at most ``gap`` missing ones."""
    w = Window.partitionBy(*group).orderBy(pos)
    cut = F.when(F.col(pos) - F.lag(pos).over(w) <= gap + 1, 0).otherwise(1)
    return hits.select(*group, pos, cut.alias("__cut")).withColumn("run", F.sum("__cut").over(w)).groupBy(*group, "run").agg(
        F.min(pos).alias("first"), F.max(pos).alias("last")
    )


def lines(mask: DataFrame, axis: str, least: int, gap: int = 2) -> DataFrame:
    """Ink runs along ``axis`` of at least ``least`` pixels, with their gaps filled."""
    across = FILL[axis]
    kept = runs(mask.where("v = 1"), ["img", across], axis, gap).where(F.col("last") - F.col("first") + 1 >= least)
    drawn = kept.select("img", across, F.explode(F.sequence("first", "last")).alias(axis), F.lit(1).alias("__line"))
    return mask.join(drawn, PIXEL, "left").select(*PIXEL, F.coalesce("__line", F.lit(0)).alias("v"))


def longest_run(mask: DataFrame, axis: str, gap: int) -> DataFrame:
    """Per line along ``axis`` its longest run, gaps counted."""
    return runs(mask.where("v = 1"), ["img", FILL[axis]], axis, gap).groupBy("img", FILL[axis]).agg(
        F.max(F.col("last") - F.col("first") + 1).alias("length")
    )


def projection(mask: DataFrame, axis: str) -> DataFrame:
    """img, pos, v: the ink of each row (``y``) or column (``x``)."""
    return mask.groupBy("img", F.col(axis).alias("pos")).agg(F.sum("v").alias("v"))


def ink(mask: DataFrame) -> DataFrame:
    return mask.groupBy("img").agg(F.sum("v").alias("ink"), F.round(F.avg("v"), 6).alias("ratio"))


def line_peaks(profile: DataFrame, threshold: Column, distance: float) -> DataFrame:
    """Runs of the profile (img, pos, v) that reach the threshold; neighbours nearer than ``distance`` become one.

    Per image in order, a peak joins the one before with their places weighted by strength. An image has few peaks.
    """
    w = Window.partitionBy("img").orderBy("pos")
    high = profile.where(F.col("v") >= threshold).withColumn("run", F.col("pos") - F.row_number().over(w))
    weight = F.sum(F.col("pos") * F.col("v")) / F.sum("v")
    peaks = high.groupBy("img", "run").agg(
        F.min("pos").cast("int").alias("first"), F.max("pos").cast("int").alias("last"), weight.cast("double").alias("at"),
        F.max("v").cast("double").alias("strength")
    )
    listed = peaks.groupBy("img").agg(F.array_sort(F.collect_list(F.struct("first", "last", "at", "strength"))).alias("peaks"))

    def joined(done: Column, p: Column) -> Column:
        t = F.element_at(done, -1)
        at = (t["at"] * t["strength"] + p["at"] * p["strength"]) / (t["strength"] + p["strength"])
        one = F.struct(t["first"].alias("first"), p["last"].alias("last"), at.alias("at"), F.greatest(t["strength"], p["strength"]).alias("strength"))
        near = p["at"] - t["at"] < distance
        return F.when(near, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(one))).otherwise(F.concat(done, F.array(p)))

    merged = F.aggregate(F.slice("peaks", 2, F.size("peaks")), F.slice("peaks", 1, 1), joined)
    return listed.select("img", F.explode(merged).alias("p")).select("img", "p.first", "p.last", F.round("p.at", 6).alias("at"), "p.strength")


def segments(profile: DataFrame, threshold: float, gap: int, least: int) -> DataFrame:
    """Stretches of the profile (img, pos, v) above the threshold, ``gap`` empty places apart and ``least`` long, with ``before``: the boundary to the previous one (null for an image's first)."""
    found = runs(profile.where(F.col("v") > threshold), ["img"], "pos", gap - 1).where(F.col("last") - F.col("first") + 1 >= least)
    return found.select(
        "img", "first", "last", ((F.lag("last").over(Window.partitionBy("img").orderBy("first")) + F.col("first")) / 2).alias("before")
    )


def text_bands(profile: DataFrame, keys: list[str], gap: int = 3) -> DataFrame:
    """``keys``, first, after: stretches of the profile (``keys``, pos, v) with ink, ``gap`` empty places apart.

    In order, a band that is much shorter than the one before it (less than 0.35), or much longer, and near (within 0.6 of the longer one), joins
    it; the joined band then decides about the next. The fold runs over one profile's bands.
    """
    bands = runs(profile.where("v > 0"), keys, "pos", gap - 1).select(*keys, F.struct("first", (F.col("last") + 1).alias("after")).alias("band"))
    listed = bands.groupBy(*keys).agg(F.array_sort(F.collect_list("band")).alias("bands"))

    def joined(done: Column, b: Column) -> Column:
        last = F.element_at(done, -1)
        high, before = b["after"] - b["first"], last["after"] - last["first"]
        uneven = (high < before * 0.35) | (before < high * 0.35)
        near = b["first"] - last["after"] <= F.greatest(high, before) * 0.6
        one = F.struct(last["first"].alias("first"), b["after"].alias("after"))
        return F.when(uneven & near, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(one))).otherwise(F.concat(done, F.array(b)))

    merged = F.aggregate(F.slice("bands", 2, F.size("bands")), F.slice("bands", 1, 1), joined)
    return listed.select(*keys, F.explode(merged).alias("b")).select(*keys, "b.first", "b.after")


def otsu_levels(grid: DataFrame) -> DataFrame:
    """img, level: each image's level that separates its two classes best, the first of equals; 127 where nothing separates."""
    counts = grid.groupBy("img", "v").agg(F.count("*").alias("n"))
    upto, every = Window.partitionBy("img").orderBy("v").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("img")
    mass = F.col("n") * F.col("v")
    t = counts.select(
        "img", "v", F.sum("n").over(upto).alias("wb"), F.sum(mass).over(upto).alias("sb"), F.sum("n").over(every).alias("total"),
        F.sum(mass).over(every).alias("whole")
    )
    wf = F.col("total") - F.col("wb")
    apart = F.col("sb") / F.col("wb") - (F.col("whole") - F.col("sb")) / wf
    between = F.when(wf > 0, F.round(F.col("wb").cast("double") * wf * apart * apart, 2))
    best = F.max_by(F.when(F.col("between") > 0, F.col("v")), F.struct(F.coalesce("between", F.lit(-1.0)), -F.col("v")))
    return t.withColumn("between", between).groupBy("img").agg(F.coalesce(best, F.lit(127)).alias("level"))


def binarize(grid: DataFrame, constant: float = 10, window: int | None = None, radius: int | None = None, edge: int = 2) -> DataFrame:
    """Ink of gray images: darker than the surroundings, but lighter than them inside large dark areas, whose outline is ink.

    Areas are dark below the image's own threshold (150 at most) and thicker than twice ``radius``. Window and radius follow from an image's
    longer side unless they are given; images of the same size are done together.
    """
    size = sides(grid).withColumn("dim", F.greatest("h", "w"))
    wide = F.greatest(F.lit(15), F.floor(F.col("dim") / 40 + 0.5)) if window is None else F.lit(window)
    thick = F.greatest(F.lit(4), F.floor(F.col("dim") * 0.004 + 0.5)) if radius is None else F.lit(radius)
    size = size.select("img", (wide + (wide % 2 == 0).cast("int")).cast("int").alias("__window"), thick.cast("int").alias("__radius"))
    level = F.least("level", F.lit(150))
    known = grid.join(size, "img").join(otsu_levels(grid).select("img", level.alias("__level")), "img")
    done = []
    for r in size.select("__window", "__radius").distinct().collect():  # one row for each size class, not for each image
        own = known.where((F.col("__window") == r["__window"]) & (F.col("__radius") == r["__radius"]))
        plain = own.select(*PIXEL, "v")
        dark, light = adaptive_mask(plain, r["__window"], constant), adaptive_mask(plain.withColumn("v", 255 - F.col("v")), r["__window"], constant)
        solid = opened(own.select(*PIXEL, (F.col("v") < F.col("__level")).cast("int").alias("v")), r["__radius"])
        name = lambda m, n: m.withColumnRenamed("v", n)
        all_ = name(dark, "dark").join(name(light, "light"), PIXEL).join(name(dilate(solid, edge, edge), "outer"), PIXEL).join(
            name(erode(solid, edge, edge), "inner"), PIXEL
        )
        done.append(all_.select(*PIXEL, F.when(F.col("inner") == 1, F.col("light")).when(F.col("outer") == 1, 1).otherwise(F.col("dark")).alias("v")))
    return reduce(DataFrame.unionByName, done) if done else grid.select(*PIXEL, "v")


def best_turn(grid: DataFrame, read: Callable[[DataFrame], DataFrame], angles: tuple[int, ...] = (180, 90, 270)) -> DataFrame:
    """img, angle and what ``read`` finds: the accepted reading of every image.

    ``read`` gives a row an image with days, periods, score and good. An image whose upright reading is good is settled; the others are turned by one angle after
    the other. A later reading replaces the held one if it found two days and a period and scores higher, and an image whose held reading is good drops out:
    each turn is made only for images that are still open.
    """
    held = written(read(grid).withColumn("angle", F.lit(0)), "readings")
    settled = held.where("good")
    open_ = held.where("not good")
    for angle in angles:
        if open_.isEmpty():
            break
        tried = read(rotate(grid.join(open_.select("img"), "img", "left_semi"), angle)).withColumn("angle", F.lit(angle))
        better = (F.col("t.days") >= 2) & (F.col("t.periods") >= 1) & (F.col("t.score") > F.col("h.score"))
        fields = [F.when(F.coalesce(better, F.lit(False)), F.col(f"t.{c}")).otherwise(F.col(f"h.{c}")).alias(c) for c in held.columns if c != "img"]
        now = written(
            open_.alias("h").join(tried.alias("t"), F.col("h.img") == F.col("t.img"), "left").select(F.col("h.img").alias("img"), *fields), "readings"
        )
        settled, open_ = settled.unionByName(now.where("good")), now.where("not good")
    return settled.unionByName(open_)


def inked(cells: DataFrame, mask: DataFrame, keys: list[str], least: int = 12, share: float = 0.0015) -> DataFrame:
    """``cells`` (img, ``keys``, x, y, w, h) with ink and empty: a cell of fewer than ``least`` pixels, or than ``share`` of its area, is empty.

    A cell meets the ink row by row, so that an image's cells and pixels are not all compared.
    """
    rows = cells.select(
        "img", *keys, "x", "w", F.explode(F.sequence(F.col("y").cast("int"), (F.col("y") + F.col("h")).cast("int") - 1)).alias("__y")
    ).distinct()
    own = mask.where("v = 1").select("img", F.col("y").alias("__y"), F.col("x").alias("__x"))
    met = rows.join(own, ["img", "__y"]).where(
        (F.col("__x") >= F.col("x")) & (F.col("__x") < F.col("x") + F.col("w"))
    ).groupBy("img", *keys).agg(F.count("*").alias("ink"))
    out = cells.join(met, ["img", *keys], "left").na.fill(0, ["ink"])
    return out.withColumn("empty", (F.col("ink") < least) | (F.col("ink") / (F.col("w") * F.col("h")) < share))
