"""Cells from ruling lines: coverage of separators, merged cells, restored and outer lines. Masks are (img, y, x, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jadwal.operators import grid, raster
from jadwal.operators.skew import half_up

LINES = 1 << 20  # no image has more lines in one direction


def numbered(lines: DataFrame) -> DataFrame:
    """img, i, pos: the lines of each image (img, pos) in order."""
    return lines.select("img", (F.row_number().over(Window.partitionBy("img").orderBy("pos")) - 1).alias("i"), "pos")


def separator_coverage(mask: DataFrame, lines: DataFrame, marks: DataFrame, axis: str, band: int) -> DataFrame:
    """img, line, part, coverage: for each line along ``axis`` and each part between two marks, the share of places with ink within ``band`` of the line.

    Lines and marks are (img, i, pos). Every line's places with ink and the marks are put in one order, and a running count read at the marks gives
    each part's count by two reads, for any number of marks and whatever lies between them.
    """
    across = raster.FILL[axis]
    places = lines.select("img", F.col("i").alias("line"), half_up(F.col("pos")).alias("at"))
    around = places.withColumn(across, F.explode(F.sequence((F.col("at") - band).cast("int"), (F.col("at") + band).cast("int"))))
    hits = mask.where("v = 1").join(around, ["img", across]).select(
        "img", "line", F.col(axis).cast("long").alias("t"), F.lit(1).alias("ink"), F.lit(None).cast("int").alias("mark")
    ).distinct()
    asked = places.select("img", "line").join(marks.select("img", F.col("i").cast("int").alias("mark"), half_up(F.col("pos")).alias("t")), "img")
    both = hits.unionByName(asked.select("img", "line", "t", F.lit(0).alias("ink"), "mark"))
    order = Window.partitionBy("img", "line").orderBy("t", "ink").rowsBetween(Window.unboundedPreceding, 0)
    read = both.withColumn("upto", F.sum("ink").over(order)).where("mark is not null")
    nxt = Window.partitionBy("img", "line").orderBy("mark")
    parts = read.select(
        "img", "line", F.col("mark").alias("part"), (F.lead("upto").over(nxt) - F.col("upto")).alias("ink"),
        (F.lead("t").over(nxt) - F.col("t")).alias("length")
    )
    return parts.where("length is not null").select("img", "line", "part", (F.col("ink") / F.greatest(F.lit(1), "length")).alias("coverage"))


def build_cells(rows: DataFrame, columns: DataFrame, across: DataFrame, down: DataFrame, band: int, least: float = 0.3) -> DataFrame:
    """img, row, col, row_span, col_span, x, y, w, h of the cells between row and column lines (img, pos).

    Two neighbours whose separator is covered by less than ``least`` are one cell; a group of such cells takes its bounds. ``across`` and ``down`` are the
    masks of horizontal and vertical lines. Images with fewer than two lines in a direction have no cells.
    """
    r, c = numbered(rows), numbered(columns)
    n = lambda lines, name: lines.groupBy("img").agg(F.max("i").alias(name))
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    frame = n(r, "nr").where("nr > 0").join(n(c, "nc").where("nc > 0"), "img").select("img", every("nr").alias("row"), "nc").select(
        "img", "row", every("nc").alias("col")
    )
    name = lambda row, col: row.cast("long") * LINES + col
    inner = lambda lines: lines.join(n(lines, "last"), "img").where("i > 0 and i < last").drop("last")
    right = separator_coverage(down, inner(c), r, "y", band).where(F.col("coverage") < least).select(
        "img", name(F.col("part"), F.col("line") - 1).alias("id"), name(F.col("part"), F.col("line")).alias("to")
    )
    below = separator_coverage(across, inner(r), c, "x", band).where(F.col("coverage") < least).select(
        "img", name(F.col("line") - 1, F.col("part")).alias("id"), name(F.col("line"), F.col("part")).alias("to")
    )
    open_ = right.unionByName(below)
    cells = frame.select("img", "row", "col", name(F.col("row"), F.col("col")).alias("id"))
    edges = open_.unionByName(open_.select("img", F.col("to").alias("id"), F.col("id").alias("to"))).unionByName(
        cells.select("img", "id", F.col("id").alias("to"))
    )
    groups = cells.join(grid.connected(cells.select("img", "id"), edges, ["img"]), ["img", "id"]).groupBy("img", "label")
    bounds = groups.agg(*[f(x).alias(f"{x}{e}") for x in ("row", "col") for f, e in ((F.min, 0), (F.max, 1))])
    at = lambda lines, i, as_: lines.select("img", F.col("i").alias(i), F.col("pos").alias(as_))
    placed = bounds.withColumn("row2", F.col("row1") + 1).withColumn("col2", F.col("col1") + 1)
    for lines, i, as_ in ((r, "row0", "y"), (r, "row2", "y2"), (c, "col0", "x"), (c, "col2", "x2")):
        placed = placed.join(at(lines, i, as_), ["img", i])
    span = lambda x: (F.col(f"{x}1") - F.col(f"{x}0") + 1).alias(f"{x}_span")
    return placed.select(
        "img", F.col("row0").alias("row"), F.col("col0").alias("col"), span("row"), span("col"), "x", "y", (F.col("x2") - F.col("x")).alias("w"),
        (F.col("y2") - F.col("y")).alias("h")
    )


def upper_medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys``, median: the element at place n/2 of few sorted values a key."""
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("__v"))
    return listed.select(*keys, F.get("__v", F.floor(F.size("__v") / 2).cast("int")).alias("median"))


def split_tall(lines: DataFrame, profile: DataFrame) -> DataFrame:
    """img, pos: the lines (img, pos), and those restored in gaps of about twice the usual size or more.

    Such a gap of n usual ones gets n - 1 lines, each in the middle of the widest run without ink (of three places at least) within 0.3 of a
    part round its expected place, the first of equals. ``profile`` (img, pos, v) has the ink of each place; a place without a row has none.
    The runs are the stretches between neighbouring inked places, joined with the windows that they reach into. Images with fewer than three lines stay as they are.
    """
    w = Window.partitionBy("img").orderBy("pos")
    gaps = lines.select(
        "img", F.col("pos").cast("double").alias("a"), F.lead(F.col("pos").cast("double")).over(w).alias("b")
    ).where("b is not null").withColumn("size", F.col("b") - F.col("a"))
    usual = upper_medians(gaps, ["img"], "size").join(lines.groupBy("img").agg(F.count("*").alias("n_lines")).where("n_lines >= 3"), "img")
    tall = gaps.join(usual, "img").withColumn("n", half_up(F.col("size") / F.col("median"))).where(
        (F.col("n") >= 2) & (F.col("size") >= F.col("median") * 1.7)
    )
    part = F.col("size") / F.col("n")
    aims = tall.select(
        "img", "a", part.alias("part"), F.explode(F.sequence(F.lit(1), (F.col("n") - 1).cast("int"))).alias("k")
    ).withColumn("aim", F.col("a") + F.col("k") * F.col("part"))
    aims = aims.select(
        "img", "a", "k", half_up(F.col("aim") - F.col("part") * 0.3).alias("lo"), half_up(F.col("aim") + F.col("part") * 0.3).alias("hi")
    )
    length = profile.groupBy("img").agg((F.max("pos") + 1).alias("length"))
    inked = profile.where("v > 0").select("img", F.col("pos").cast("long").alias("pos"))
    ends = inked.unionByName(length.select("img", F.lit(-1).cast("long").alias("pos"))).unionByName(
        length.select("img", F.col("length").cast("long").alias("pos"))
    )
    empty = ends.select("img", (F.col("pos") + 1).alias("first"), F.lead("pos").over(w).alias("after")).where("after > first")
    inside = aims.join(empty, "img").where("first <= hi and after > lo").select(
        "img", "a", "k", F.greatest("first", "lo").alias("s"), F.least("after", F.col("hi") + 1).alias("e")
    )
    runs = inside.withColumn("len", F.col("e") - F.col("s")).groupBy("img", "a", "k").agg(
        F.max_by(F.struct("s", "len"), F.struct("len", -F.col("s"))).alias("r")
    )
    found = runs.where("r.len >= 3").select("img", (F.col("r.s") + F.col("r.len") / 2).alias("pos"))
    return lines.select("img", F.col("pos").cast("double").alias("pos")).unionByName(found)


def with_outer(lines: DataFrame, profile: DataFrame, least: int, span: Column) -> DataFrame:
    """img, pos: the lines, with one at each end of the image where a margin of more than ``least`` holds more ink than 1.5 times ``span``.

    ``profile`` (img, pos, v) has a row for every place.
    """
    ends = lines.groupBy("img").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    size = profile.groupBy("img").agg((F.max("pos") + 1).alias("size"))
    inks = profile.join(ends, "img").groupBy("img", "first", "last").agg(
        F.sum(F.when(F.col("pos") < half_up(F.col("first")), F.col("v")).otherwise(0)).alias("before"),
        F.sum(F.when(F.col("pos") >= half_up(F.col("last")), F.col("v")).otherwise(0)).alias("after")
    )
    known = inks.join(size, "img").withColumn("__span", span)
    upper = known.where((F.col("first") > least) & (F.col("before") > F.col("__span") * 1.5)).select("img", F.lit(0.0).alias("pos"))
    lower = known.where((F.col("size") - F.col("last") > least) & (F.col("after") > F.col("__span") * 1.5)).select(
        "img", (F.col("size") - 1).cast("double").alias("pos")
    )
    return lines.select("img", F.col("pos").cast("double").alias("pos")).unionByName(upper).unionByName(lower)
