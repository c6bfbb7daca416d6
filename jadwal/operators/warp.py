"""Homographies as array expressions, and warping by inverse mapping, where each target pixel joins its source pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jadwal.functions.columns import let
from jadwal.operators.raster import PIXEL, sides

SMALL = 1e-12


def solved(matrix: Column) -> Column:
    """The solution of n linear equations, given as n rows of n + 1 numbers; null where they have none.

    Elimination with the largest pivot (the first of equals), as a fold over the columns.
    """
    n = F.size(matrix)

    def step(m: Column, col: Column) -> Column:
        size = lambda r: F.struct(F.abs(m[r][col]).alias("size"), (-r).alias("row"))
        pivot = -F.array_max(F.transform(F.sequence(col, F.size(m) - 1), size))["row"]

        def with_pivot(p: Column) -> Column:
            top = m[p]
            swapped = F.transform(m, lambda row, i: F.when(i == col, top).when(i == p, m[col]).otherwise(row))
            less = lambda row: F.zip_with(row, top, lambda a, b: a - row[col] / top[col] * b)
            return F.when(
                F.abs(top[col]) >= SMALL, F.transform(swapped, lambda row, i: F.when((i == col) | (row[col] == 0), row).otherwise(less(row)))
            )

        return F.when(m.isNotNull(), let(pivot, with_pivot))

    done = F.aggregate(F.sequence(F.lit(0), n - 1), matrix, step)
    return F.transform(done, lambda row, i: row[F.size(row) - 1] / row[i])


def homography(source: Column, target: Column) -> Column:
    """The 9 numbers of the map of four source points (arrays of structs y, x) onto four target points; null where there is none."""

    def rows(p: Column, q: Column) -> Column:
        one, zero = F.lit(1.0), F.lit(0.0)
        line = lambda u, first: F.array(
            *[
                c.cast("double") for c in (
                    (p["x"], p["y"], one, zero, zero, zero) if first else (zero, zero, zero, p["x"], p["y"], one)
                ) + (-u * p["x"], -u * p["y"], u)
            ]
        )
        return F.array(line(q["x"], True), line(q["y"], False))

    found = solved(F.flatten(F.zip_with(source, target, rows)))
    return F.when(found.isNotNull(), F.concat(found, F.array(F.lit(1.0))))


def rectangle(height: int, width: int) -> Column:
    """The corners of a target of this size: upper left, upper right, lower right, lower left."""
    at = [(0, 0), (0, width - 1), (height - 1, width - 1), (height - 1, 0)]
    return F.array(*[F.struct(F.lit(float(y)).alias("y"), F.lit(float(x)).alias("x")) for y, x in at])


def sampled(grid: DataFrame, asked: DataFrame, fill: int = 255) -> DataFrame:
    """img, y, x, v: bilinear values of ``grid`` at the source places (sy, sx) of the target pixels ``asked``; outside the image ``fill``.

    A null place is outside.
    """
    size = sides(grid)
    placed = asked.join(size, "img").withColumn(
        "inside",
        F.coalesce((F.col("sx") >= 0) & (F.col("sy") >= 0) & (F.col("sx") <= F.col("w") - 1) & (F.col("sy") <= F.col("h") - 1), F.lit(False))
    )
    place = lambda s, n: F.array(
        F.struct(F.floor(s).alias("at"), (1 - (F.col(s) - F.floor(s))).alias("share")),
        F.struct(F.least(F.col(n) - 1, F.floor(s) + 1).alias("at"), (F.col(s) - F.floor(s)).alias("share"))
    )
    four = placed.where("inside").select(*PIXEL, F.explode(place("sy", "h")).alias("cy"), "sx", "w").select(
        *PIXEL, "cy", F.explode(place("sx", "w")).alias("cx")
    )
    four = four.select(
        "img", F.col("y").alias("ty"), F.col("x").alias("tx"), F.col("cy.at").cast("int").alias("y"), F.col("cx.at").cast("int").alias("x"),
        (F.col("cy.share") * F.col("cx.share")).alias("share")
    )
    sums = four.join(grid, PIXEL).groupBy("img", "ty", "tx").agg(F.floor(F.round(F.sum(F.col("share") * F.col("v")), 6) + 0.5).cast("int").alias("v"))
    sums = sums.select("img", F.col("ty").alias("y"), F.col("tx").alias("x"), "v")
    return asked.select(*PIXEL).join(sums, PIXEL, "left").select(*PIXEL, F.coalesce("v", F.lit(fill)).alias("v"))


def warp_places(maps: DataFrame, height: int, width: int) -> DataFrame:
    """img, y, x, sy, sx: the source place of every target pixel, for ``maps`` (img, h: from target to source)."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    frame = maps.select("img", "h", every(height).alias("y")).select("img", "h", "y", every(width).alias("x"))
    h = lambda i: F.col("h")[i]
    line = lambda i: h(i) * F.col("x") + h(i + 1) * F.col("y") + h(i + 2)
    return frame.select(*PIXEL, F.round(F.try_divide(line(3), line(6)), 9).alias("sy"), F.round(F.try_divide(line(0), line(6)), 9).alias("sx"))


def warped(grid: DataFrame, quads: DataFrame, height: int, width: int, fill: int = 255) -> DataFrame:
    """Each image's quadrilateral (img, quad: upper left, upper right, lower right, lower left) as an upright image of this size.

    Images whose quadrilateral is degenerate have no rows.
    """
    maps = quads.select("img", homography(rectangle(height, width), F.col("quad")).alias("h")).where("h is not null")
    return sampled(grid, warp_places(maps, height, width), fill)


def turned(grid: DataFrame, angles: DataFrame, fill: int = 255) -> DataFrame:
    """Every image turned about its middle by its own angle (img, degrees)."""
    about = grid.join(sides(grid), "img").join(angles, "img")
    dy, dx, angle = F.col("y") - F.col("h") / 2, F.col("x") - F.col("w") / 2, F.radians("degrees")
    sy, sx = -F.sin(angle) * dx + F.cos(angle) * dy + F.col("h") / 2, F.cos(angle) * dx + F.sin(angle) * dy + F.col("w") / 2
    return sampled(grid, about.select(*PIXEL, F.round(sy, 9).alias("sy"), F.round(sx, 9).alias("sx")), fill)
