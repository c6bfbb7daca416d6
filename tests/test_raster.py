from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Column
from pyspark.sql import functions as F

from jadwal.operators import raster


def pixels(spark, image):
    return spark.createDataFrame([(1, y, x, int(v)) for (y, x), v in np.ndenumerate(np.array(image))], "img int, y int, x int, v int")


def back(df):
    rows = df.collect()
    out = np.full((max(r["y"] for r in rows) + 1, max(r["x"] for r in rows) + 1), -1)
    for r in rows:
        out[r["y"], r["x"]] = r["v"]
    return out


@pytest.fixture(scope="module")
def image():
    return np.random.default_rng(4).integers(0, 256, (6, 9))


def around(a, y, x, r):
    return a[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1]


def test_boxes_and_masks(spark, image):
    p = pixels(spark, image)
    assert (back(raster.blur(p)) == [[int(around(image, y, x, 1).mean() + 0.5) for x in range(9)] for y in range(6)]).all()
    mask = back(raster.adaptive_mask(p, 5, 12))
    assert (mask == [[int(image[y, x] < around(image, y, x, 2).mean() - 12) for x in range(9)] for y in range(6)]).all()
    m = pixels(spark, mask)
    shrunk = np.array([[around(mask, y, x, 1).min() for x in range(9)] for y in range(6)])
    assert (back(raster.opened(m, 1)) == [[around(shrunk, y, x, 1).max() for x in range(9)] for y in range(6)]).all()
    assert not back(raster.combined(m, m, Column.bitwiseXOR)).any() and not back(raster.without_lines(m, m)).any()


def test_geometry(spark, image):
    p = pixels(spark, image)
    for angle, turns in ((90, -1), (180, 2), (270, 1)):
        assert (back(raster.rotate(p, angle)) == np.rot90(image, turns)).all()
    assert (back(raster.downscale(p, 3)) == [[int(image[3 * y : 3 * y + 3, 3 * x : 3 * x + 3].mean() + 0.5) for x in range(3)] for y in range(2)]).all()
    assert (back(raster.crop(raster.pad(p, 2), 2, 2, 6, 9)) == image).all()
    assert (back(raster.resize(p, 6, 9)) == image).all()


def test_lines_and_profiles(spark):
    art = pixels(spark, [[int(c == "#") for c in row] for row in ("##.##...#.", "#.........", "...######.")])
    assert ["".join(".#"[v] for v in row) for row in back(raster.lines(art, "x", 5, 1))] == ["#####.....", "..........", "...######."]
    assert {r["y"]: r["length"] for r in raster.longest_run(art, "x", 1).collect()} == {0: 5, 1: 1, 2: 6}
    profile = spark.createDataFrame([(1, i, v) for i, v in enumerate([0, 4, 4, 0, 4, 0, 0, 0, 0, 9])], "img int, pos int, v int")
    assert [(r["first"], r["last"], r["at"]) for r in raster.line_peaks(profile, F.lit(4), 3).orderBy("first").collect()] == [(1, 4, 2.75), (9, 9, 9.0)]
    assert [(r["first"], r["last"], r["before"]) for r in raster.segments(profile, 0, 2, 1).orderBy("first").collect()] == [(1, 4, None), (9, 9, 6.5)]
