"""Operators on small raster grids (y, x, v): box means, dilation, erosion, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jadwal.storage import written


def _around(grid: DataFrame, radius: int) -> DataFrame:
    """Each value at every place within ``radius`` (2r + 1 squared copies; a place outside the grid is dropped later)."""
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    spread = grid.withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
    return spread.select((F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), "v")


def box_mean(grid: DataFrame, radius: int = 1) -> DataFrame:
    """Mean of the square around each place, clipped at the edges."""
    means = _around(grid, radius).groupBy("y", "x").agg(F.round(F.avg("v"), 6).alias("mean"))
    return grid.select("y", "x").join(means, ["y", "x"])


def morphology(grid: DataFrame, radius: int = 1) -> DataFrame:
    """dilated and eroded masks (v is 0 or 1); outside the grid nothing counts."""
    ends = _around(grid, radius).groupBy("y", "x").agg(F.max("v").alias("dilated"), F.min("v").alias("eroded"))
    return grid.select("y", "x").join(ends, ["y", "x"])


def connected(nodes: DataFrame, edges: DataFrame, within: list[str]) -> DataFrame:
    """``within``, id, label: the smallest id reachable from each node by ``edges`` (``within``, id, to), which hold both directions and each node itself.

    Each round takes the smallest label next door and then that label's own label, and is written, until no label changes.
    """
    edges = written(edges.select(*within, "id", "to"), "edges")
    labels = written(nodes.select(*within, "id", F.col("id").alias("label")), "labels")
    while True:
        stepped = edges.join(labels.withColumnRenamed("id", "to"), [*within, "to"]).groupBy(*within, "id").agg(F.min("label").alias("label"))
        further = labels.select(*within, F.col("id").alias("label"), F.col("label").alias("further"))
        new = written(stepped.join(further, [*within, "label"]).select(*within, "id", F.least("label", "further").alias("label")), "labels")
        if new.join(labels, [*within, "id", "label"], "left_anti").isEmpty():
            return new
        labels = new


def _next_door(cells: DataFrame, within: list[str]) -> DataFrame:
    """Edges (``within``, id, to) between cells (``within``, id, y, x) that touch, and from each cell to itself."""
    steps = F.sequence(F.lit(-1), F.lit(1))
    asked = cells.withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
    asked = asked.select(*within, F.col("id").alias("to"), (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"))
    return cells.join(asked, [*within, "y", "x"]).select(*within, "id", "to")


def components(grid: DataFrame, width: int) -> DataFrame:
    """area and bounds of the 8-connected components of v = 1, labelled by their smallest y * width + x."""
    cells = grid.where("v = 1").select((F.col("y") * width + F.col("x")).cast("long").alias("id"), "y", "x")
    labels = connected(cells, _next_door(cells, []), [])
    return cells.join(labels, "id").groupBy("label").agg(
        F.count("*").alias("area"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1")
    )


SIDE = 1 << 20  # no image has a longer side


def labelled(mask: DataFrame) -> DataFrame:
    """img, y, x, label of the ink of many images: the label is y * SIDE + x of the component's first pixel."""
    cells = mask.where("v = 1").select("img", (F.col("y").cast("long") * SIDE + F.col("x")).alias("id"), "y", "x")
    return cells.join(connected(cells, _next_door(cells, ["img"]), ["img"]), ["img", "id"]).select("img", "y", "x", "label")


def corners(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys`` (the label, if none are given) and the places (y, x) of the least and greatest x + y and x - y of labelled cells (label, y, x, ord)."""
    at, up, down = F.struct("y", "x"), F.col("x") + F.col("y"), F.col("x") - F.col("y")
    first = lambda c: F.struct(c, F.col("ord"))
    ends = [F.min_by(at, first(c)).alias(n) for c, n in ((up, "top_left"), (-up, "bottom_right"), (-down, "top_right"), (down, "bottom_left"))]
    return cells.groupBy(*(keys or ["label"])).agg(*ends)


def by_size(components: DataFrame) -> DataFrame:
    """Components in falling order of their bounds' area."""
    return components.orderBy(F.desc((F.col("y1") - F.col("y0") + 1) * (F.col("x1") - F.col("x0") + 1)), "label")
