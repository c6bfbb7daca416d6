"""The image operators on drawn pictures and against plain versions."""

from __future__ import annotations

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_raster import back, pixels

from jadwal.operators import glyphs, grid, raster, rulings, skew, warp


def images(spark, *arts):
    rows = [(i, y, x, int(v)) for i, art in enumerate(arts) for (y, x), v in np.ndenumerate(np.array(art))]
    return spark.createDataFrame(rows, "img int, y int, x int, v int")


def ruled(angle, h=60, w=80):
    """Lines that lean by ``angle`` degrees."""
    art = np.zeros((h, w), int)
    for y0 in range(10, h - 8, 10):
        for x in range(w):
            y = round(y0 + (x - w / 2) * math.tan(math.radians(angle)))
            if 0 <= y < h:
                art[y, x] = 1
    return art


def test_skew(spark):
    blank, few = np.zeros((60, 80), int), np.zeros((60, 80), int)
    few[5:8, 5:8] = 1
    got = {r["img"]: r for r in skew.estimate_skew(images(spark, ruled(5), ruled(-3), ruled(0), blank, few)).collect()}
    assert abs(got[0]["skew"] - 5) <= 0.5 and abs(got[1]["skew"] + 3) <= 0.5 and [got[i]["skew"] for i in (2, 3, 4)] == [0, 0, 0]
    assert (got[3]["points"], got[4]["points"]) == (0, 9)
    upright = warp.turned(images(spark, 255 * (1 - ruled(5))), spark.createDataFrame([(0, -5.0)], "img int, degrees double"))
    assert (back(upright.where("img = 0"))[20:40, 20:60] < 128).any(1).sum() <= 8  # lines take few rows again


def plain_homography(src, dst):
    a, b = [], []
    for (y, x), (v, u) in zip(src, dst, strict=True):
        a += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        b += [u, v]
    return np.append(np.linalg.solve(np.array(a, float), np.array(b, float)), 1)


def test_homographies(spark):
    quad = [(2.0, 3.0), (4.0, 17.0), (12.0, 19.0), (10.0, 1.0)]
    flat = [(0.0, 0.0), (0.0, 5.0), (0.0, 9.0), (0.0, 12.0)]
    rows = [(0, [{"y": y, "x": x} for y, x in quad]), (1, [{"y": y, "x": x} for y, x in flat])]
    df = spark.createDataFrame(rows, "img int, quad array<struct<y double, x double>>")
    got = {r["img"]: r["h"] for r in df.select("img", warp.homography(F.col("quad"), warp.rectangle(8, 9)).alias("h")).collect()}
    assert np.allclose(got[0], plain_homography(quad, [(0, 0), (0, 8), (7, 8), (7, 0)])) and got[1] is None
    art = np.random.default_rng(1).integers(0, 255, (14, 21))
    h = plain_homography([(0, 0), (0, 8), (7, 8), (7, 0)], quad)
    want = np.full((8, 9), 255)
    for y, x in itertools.product(range(8), range(9)):
        d = h[6] * x + h[7] * y + h[8]
        sx, sy = (h[0] * x + h[1] * y + h[2]) / d, (h[3] * x + h[4] * y + h[5]) / d
        if -1e-9 <= sx <= 20 and -1e-9 <= sy <= 13:
            y0, x0 = int(sy + 1e-9), int(sx + 1e-9)
            y1, x1, wy, wx = min(13, y0 + 1), min(20, x0 + 1), sy - y0, sx - x0
            want[y, x] = int(np.round(art[y0, x0] * (1 - wy) * (1 - wx) + art[y0, x1] * (1 - wy) * wx + art[y1, x0] * wy * (1 - wx) + art[y1, x1] * wy * wx, 6) + 0.5)
    assert (back(warp.warped(images(spark, art, art), df, 8, 9)) == want).all()


def test_table_on_a_photo(spark):
    art = np.zeros((60, 80), int)
    for y in (10, 25, 40, 50):
        art[y, 10:71] = 1
    for x in (10, 40, 70):
        art[10:51, x] = 1
    art[2:4, 2:5] = 1  # a speck
    quads = skew.table_quads(images(spark, art, np.zeros((60, 80), int)), least=100)
    (r,) = quads.collect()
    assert r["img"] == 0 and r["framed"] and tuple(r["top_left"]) == (9, 9) and tuple(r["bottom_right"]) == (51, 71)
    (wide,) = skew.expanded(quads, 3, raster.sides(images(spark, art))).collect()
    assert wide["top_left"]["y"] < 9 and wide["bottom_right"]["x"] > 71 and abs(skew.quad_skew(quads).first()["degrees"]) < 1e-9


def plain_cells(art, rows, cols, band):
    def coverage(vertical, line, a, b):
        near = lambda t: any((art[t, line + d] if vertical else art[line + d, t]) for d in range(-band, band + 1) if 0 <= line + d < art.shape[vertical])
        return sum(near(t) for t in range(a, b) if t < art.shape[not vertical]) / max(1, b - a)

    nr, nc = len(rows) - 1, len(cols) - 1
    group = {(r, c): {(r, c)} for r in range(nr) for c in range(nc)}
    for r, c in list(group):
        for other, open_ in (((r, c + 1), c + 1 < nc and coverage(True, cols[c + 1], rows[r], rows[r + 1]) < 0.3), ((r + 1, c), r + 1 < nr and coverage(False, rows[r + 1], cols[c], cols[c + 1]) < 0.3)):
            if open_:
                both = group[r, c] | group[other]
                for cell in both:
                    group[cell] = both
    out = set()
    for cells in {frozenset(g) for g in group.values()}:
        r0, r1, c0, c1 = min(r for r, _ in cells), max(r for r, _ in cells), min(c for _, c in cells), max(c for _, c in cells)
        out.add((r0, c0, r1 - r0 + 1, c1 - c0 + 1, cols[c0], rows[r0], cols[c1 + 1] - cols[c0], rows[r1 + 1] - rows[r0]))
    return sorted(out)


@pytest.mark.parametrize("band", [0, 1])
def test_cells_from_rulings(spark, band):
    rng = np.random.default_rng(band)
    art, rows, cols = (rng.random((40, 50)) < 0.3).astype(int), [0, 9, 20, 31, 39], [0, 12, 24, 36, 49]
    lines = lambda at: spark.createDataFrame([(0, float(p)) for p in at], "img int, pos double")
    got = rulings.build_cells(lines(rows), lines(cols), images(spark, art), images(spark, art), band)
    assert sorted(tuple(int(v) for v in r[1:]) for r in got.distinct().collect()) == plain_cells(art, rows, cols, band)
    assert rulings.build_cells(lines(rows[:1]), lines(cols), images(spark, art), images(spark, art), band).count() == 0


def test_restored_and_outer_lines(spark):
    lines = spark.createDataFrame([(0, float(p)) for p in (0, 10, 20, 40, 50)] + [(1, 0.0), (1, 30.0)], "img int, pos double")
    profile = spark.createDataFrame([(i, p, 0 if 28 <= p <= 32 else 3) for i in (0, 1) for p in range(60)], "img int, pos int, v int")
    got = sorted((r["img"], r["pos"]) for r in rulings.split_tall(lines, profile).collect())
    assert got == [(0, 0.0), (0, 10.0), (0, 20.0), (0, 30.5), (0, 40.0), (0, 50.0), (1, 0.0), (1, 30.0)]
    inner = spark.createDataFrame([(0, 20.0), (0, 40.0)], "img int, pos double")
    assert sorted(r["pos"] for r in rulings.with_outer(inner, profile, 5, F.lit(20.0)).collect()) == [0.0, 20.0, 40.0, 59.0]


def plain_groups(boxes):
    groups = [[*b, 1] for b in sorted(boxes)]
    while True:
        out = []
        for g in groups:
            if out:
                t = out[-1]
                overlap = min(t[1], g[1]) - max(t[0], g[0]) + 1
                if overlap > 0 and overlap / min(t[1] - t[0] + 1, g[1] - g[0] + 1) >= 0.45:
                    out[-1] = [min(t[0], g[0]), max(t[1], g[1]), min(t[2], g[2]), max(t[3], g[3]), t[4] + g[4], t[5] + g[5]]
                    continue
            out.append(list(g))
        if len(out) == len(groups):
            return out
        groups = out


def test_groups_of_components(spark):
    r = random.Random(3)
    boxes = {k: sorted((x, x + r.randint(0, 9), y, y + 4, r.randint(1, 9)) for x, y in ((r.randint(0, 60), r.randint(0, 5)) for _ in range(r.randint(1, 18)))) for k in range(40)}
    df = spark.createDataFrame([(k, *b) for k, bs in boxes.items() for b in bs], "img int, x0 int, x1 int, y0 int, y1 int, area int").repartition(3)
    got = {x["img"]: [(g["x0"], g["x1"], g["y0"], g["y1"], g["area"], len(g["parts"])) for g in x["groups"]] for x in glyphs.group_components(df, ["img"]).collect()}
    assert got == {k: [tuple(g) for g in plain_groups(bs)] for k, bs in boxes.items()}


def plain_order(chars):
    out, run = [], []
    for i, c in enumerate(chars):
        if re.fullmatch("[0-9٠-٩]", c) or (c in "/-" and run and i + 1 < len(chars) and re.fullmatch("[0-9٠-٩]", chars[i + 1])):
            run.append(c)
        else:
            out += run[::-1] + [c]
            run = []
    return "".join(out + run[::-1])


def test_restored_order(spark):
    texts = ["4/2", "ب/٢", "12/أ3", "-5", "1--2", "/", "", "٣٢١", "a-1/2-b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["o"] for r in df.select("t", glyphs.restore_order(F.split("t", "")).alias("o")).collect()}
    assert got == {t: plain_order(t) for t in texts}


def plain_reading(alternatives, most=6):
    if len(alternatives) > most:
        return None
    best = None
    for way in itertools.product(*alternatives):
        pieces = [p for alt in way for p in alt]
        if not 0 < len(pieces) <= most + 1:
            continue
        scores, text = [p[1] for p in pieces], plain_order([p[0] for p in pieces])
        ascii_ = text.translate(str.maketrans("٠١٢٣٤٥٦٧٨٩", "0123456789"))
        total = round(0.7 * sum(scores) / len(scores) + 0.3 * min(scores) + (0.08 if re.match(glyphs.PLAUSIBLE, ascii_) else 0) - (len(pieces) - len(alternatives)) * 0.05, 9)
        if best is None or total > best[0]:
            best = (total, pieces, text)
    _, pieces, text = best
    if len(pieces) > 1 and any(p[0] == "-" and p[3] > 0.45 * max(q[3] for q in pieces) for p in pieces):
        return None
    if len(pieces) == 1 and pieces[0][0] == "-" and pieces[0][2] / pieces[0][3] < 2.5:
        return None
    if re.fullmatch("[اأ|][/-].", text):
        text = "١" + text[1:]
    if re.fullmatch("[-/]+", text):
        return ""
    return text if re.search("[0-9٠-٩]", text) else None


def test_readings(spark):
    p = lambda s, score=0.9, w=5, h=10: (s, score, w, h)
    labels = [
        [[[p("٢")]], [[p("/")]], [[p("ب")]]], [[[p("ب")]], [[p("/")]], [[p("٢")]]], [[[p("ا")]], [[p("/")]], [[p("٣")]]], [[[p("8", 0.5)], [p("1"), p("2")]]], [[[p("-", 0.9, 9, 2)]]],
        [[[p("-", 0.9, 4, 2)]]], [[[p("-")]], [[p("3")]]], [[[p("ب")]]], [[[p("1")]]] * 7, [[[p("1"), p("2")], [p("3", 0.95)]], [[p("/")]], [[p("4")], [p("ب")]]],
    ]
    schema = f"img int, alternatives array<array<array<{glyphs.PIECE}>>>"
    got = {r["img"]: r["text"] for r in glyphs.readings(spark.createDataFrame(list(enumerate(labels)), schema), ["img"]).collect()}
    assert got == {i: plain_reading(a) for i, a in enumerate(labels)}
    assert got[1] == "ب/٢" and got[4] == "" and got[5] is None


GLYPHS = {"1": ["..##..", "..##..", "..##..", "..##..", "..##..", "..##.."], "7": ["######", "....##", "....##", "....##", "....##", "....##"], "L": ["##....", "##....", "##....", "##....", "##....", "######"]}


def drawn(*symbols):
    rows = [sum(([0] * 2 + [int(c == "#") for c in GLYPHS[s][y]] for s in symbols), []) + [0, 0] for y in range(6)]
    art = 220 - 160 * np.pad(np.array(rows), ((2, 2), (1, 1)))
    art[0, 0] = 100  # ink is darker than the threshold, which is this level
    return art


def test_recognize(spark):
    """Drawn labels are read from right to left, and digits in a row from left to right."""
    arts = [drawn("1", "7"), drawn("7", "L"), drawn("L"), drawn("7", "1", "7", "1", "7", "1", "7"), np.full((9, 9), 200)]
    masks = images(spark, *[drawn(s) for s in GLYPHS])
    ink = masks.select("img", "y", "x", (F.col("v") < 100).cast("int").alias("v"))
    boxes = ink.where("v = 1").groupBy("img").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("area"))
    names = spark.createDataFrame([(i, s) for i, s in enumerate(GLYPHS)], "img int, symbol string")
    templates = glyphs.samples(ink, boxes, []).join(boxes, "img").join(names, "img").select(F.col("img").alias("ord"), "symbol", ((F.col("x1") - F.col("x0") + 1) / (F.col("y1") - F.col("y0") + 1)).alias("aspect"), F.col("sample").alias("t"))
    got = {r["img"]: (r["text"], r["confidence"]) for r in glyphs.recognize(images(spark, *arts), templates).collect()}
    assert got[0][0] == "17" and got[1][0] in ("L7", "7L") and got[0][1] > 0.9
    assert got[2][0] is None and got[3][0] is None and got[4][0] is None  # no digit, too many groups, no ink


def test_bands_at_any_partitioning(spark):
    r = random.Random(1)
    rows = [(k, p, r.choice([0, 0, 0, 1, 4])) for k in range(5) for p in range(200)]
    some = [sorted(map(tuple, raster.text_bands(spark.createDataFrame(rows, "k int, pos int, v int").repartition(n), ["k"]).collect())) for n in (1, 7)]
    assert some[0] == some[1] and len(some[0]) > 20


def test_turns_stop_when_settled(spark):
    art = np.zeros((6, 8), int)
    art[4, 6] = 5
    asked = []

    def read(grid_):
        asked.append(sorted(r["img"] for r in grid_.select("img").distinct().collect()))
        at = grid_.where("v = 5").select("img", (F.col("y") < 3).alias("good"))
        return at.select("img", F.lit(3).alias("days"), F.lit(3).alias("periods"), F.when(F.col("good"), 2.0).otherwise(1.0).alias("score"), "good")

    got = {r["img"]: (r["angle"], r["good"]) for r in raster.best_turn(images(spark, art, art[::-1], art), read).collect()}
    assert got == {0: (180, True), 1: (0, True), 2: (180, True)} and asked == [[0, 1, 2], [0, 2]]


def test_binarize_lights_in_dark_areas(spark):
    art = np.full((40, 60), 240)
    art[5:20, 5:55] = 30  # a dark bar
    art[10:13, 20:40] = 220  # light text in it
    art[6, 6:9] = 60  # dark is what is below the threshold, which is this level
    art[30, 10:50] = 20  # a dark line on paper
    got = back(raster.binarize(images(spark, art), window=9, radius=2))
    assert got[11, 20] == 1 and got[30, 30] == 1 and got[16, 48] == 0 and got[35, 5] == 0 and got[5, 30] == 1


def test_labels_of_many_images(spark):
    art = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 1, 0, 1]])
    found = grid.labelled(images(spark, art, 1 - art)).groupBy("img").agg(F.count_distinct("label").alias("n")).collect()
    assert {r["img"]: r["n"] for r in found} == {0: 4, 1: 1}
    assert pixels(spark, art).count() == 16
