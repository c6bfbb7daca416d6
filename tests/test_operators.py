from __future__ import annotations

from jadwal.operators import axes, grid, lessons, numeric


def test_merge_keeps_order(spark):
    rows = spark.createDataFrame([(1, 0, 1, "a", 0.4, 0, 0), (1, 0, 1, "a", 0.9, 1, 1), (1, 0, 1, "b", 0.8, 2, 2)], "g int, day_idx int, period int, name string, conf double, image int, ord int")
    r = lessons.merge_readings(rows, "g", "name", "conf", "image").first()
    assert (r["name"], r["conf"], r["review"], r["conflict"], r["alternatives"]) == ("a", 0.9, True, True, 2)


def test_later_agreement_clears_the_review_flag(spark):
    rows = spark.createDataFrame([(1, 0, 1, "a", 0.4, 0, 0), (1, 0, 1, "b", 0.9, 1, 1), (1, 0, 1, "a", 0.8, 2, 2)], "g int, day_idx int, period int, name string, conf double, image int, ord int")
    assert lessons.merge_readings(rows, "g", "name", "conf", "image").first()["review"] is False


def test_section_style(spark):
    rows = spark.createDataFrame([(1, "1/ب"), (1, "2/ج"), (1, "3/1"), (1, "2/ا"), (2, "1/2"), (2, "1/3"), (2, "1/ا")], "g int, name string")
    got = {(r["g"], r["name"]): r["fixed"] for r in lessons.fix_section_style(rows, "g", "name").collect()}
    assert got == {(1, "1/ب"): "1/ب", (1, "2/ج"): "2/ج", (1, "3/1"): "3/أ", (1, "2/ا"): "2/أ", (2, "1/2"): "1/2", (2, "1/3"): "1/3", (2, "1/ا"): "1/١"}


def test_digit_pairs_need_three(spark):
    rows = spark.createDataFrame([(1, "1/2"), (1, "3/2"), (2, "1/2"), (2, "3/2"), (2, "4/2")], "g int, name string")
    got = sorted((r["g"], r["fixed"]) for r in lessons.swap_digit_pairs(rows, "g", "name").collect())
    assert got == [(1, "1/2"), (1, "3/2"), (2, "2/1"), (2, "2/3"), (2, "2/4")]


def test_gap_fill(spark):
    line = [(1, 1, None, True), (1, 2, 2, True), (1, 3, None, False), (1, 4, 4, True), (1, 5, None, True), (1, 6, None, False), (1, 7, None, True)]
    got = {r["pos"]: (r["value"], r["confidence"]) for r in axes.fill_gaps(spark.createDataFrame(line, "g int, pos int, label int, is_data boolean"), ["g"]).collect()}
    assert got == {1: (1, 0.5), 2: (2, 1.0), 3: (3, 0.55), 4: (4, 1.0), 5: (5, 0.5)}


def test_clock_decides_over_slips(spark):
    rows = spark.createDataFrame([(1, 1, 400, 3), (1, 2, 450, 2), (1, 3, 500, None)], "g int, pos int, minute int, label int")
    assert sorted((r["pos"], r["value"]) for r in axes.rank_by_clock(rows, ["g"]).collect()) == [(1, 1), (2, 2), (3, 3)]


def test_upper_median(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)] + [("b", 5.0), ("c", None), ("d", 7.0), ("d", 7.0)], "k string, v double")
    assert {r["k"]: r["median"] for r in numeric.upper_median(rows, "k", "v").collect()} == {"a": 3.0, "b": 5.0, "d": 7.0}


def test_clusters_join_across_bins(spark):
    rows = spark.createDataFrame([(v,) for v in (0.9, 1.1, 1.9, 5.0, 5.5)], "v double")
    assert sorted((r["first"], r["last"], r["n"]) for r in numeric.clusters(rows, "v", 1.0).collect()) == [(0.9, 1.9, 3), (5.0, 5.5, 2)]


def test_components(spark):
    art = ["#..#", ".#.#", "...#", "#..."]
    cells = spark.createDataFrame([(y, x, int(c == "#")) for y, row in enumerate(art) for x, c in enumerate(row)], "y int, x int, v int")
    assert sorted((r["label"], r["area"]) for r in grid.components(cells, 4).collect()) == [(0, 2), (3, 3), (12, 1)]
