from __future__ import annotations

import pytest

from jadwal.operators import cells, schedule

TABLES = {
    "rows": [["٣", "٢", "١", "اليوم"], ["", "٢/ب", "١/أ", "الأحد"], ["٣/أ", "", "٢/أ", "الاثنين"]],
    "columns": [["الاثنين", "الأحد", "الحصة"], ["٢/أ", "١/أ", "الأولى"], ["", "٢/ب", "الثانية"]],
    "gap": [["٤", "", "٢", "١", "اليوم"], ["١/أ", "٢/أ", "٣/أ", "١/ب", "الأحد"], ["", "١/أ", "", "٢/ب", "الاثنين"], ["٢/ب", "", "١/ب", "", "الثلاثاء"]],
    "unnumbered": [["", "٢/ب", "١/أ", "الأحد"], ["٣/أ", "", "٢/أ", "الاثنين"], ["١/ب", "٢/أ", "", "الثلاثاء"]],
    "nothing": [["x", "y"], ["", "z"]],
}


@pytest.fixture(scope="module")
def found(spark):
    reads = [(name, r, c, 1, 1, r * 100 + c, t, 90.0) for name, rows in TABLES.items() for r, row in enumerate(rows) for c, t in enumerate(row)]
    table = spark.createDataFrame(reads, "doc_id string, row int, col int, row_span int, col_span int, ord int, text string, ocr_confidence double")
    grids = spark.createDataFrame([(n, len(t), len(t[0])) for n, t in TABLES.items()], "doc_id string, rows int, cols int")
    out: dict = {}
    for r in schedule.lessons(cells.classify(table), grids).collect():
        out.setdefault((r["doc_id"], r["orientation"]), {})[r["day"], r["period"]] = r["class_name"]
    return out


def test_days_in_rows(found):
    assert found["rows", "days-in-rows"] == {("sun", 1): "١/أ", ("sun", 2): "٢/ب", ("mon", 1): "٢/أ", ("mon", 3): "٣/أ"}


def test_days_in_columns(found):
    assert found["columns", "days-in-columns"] == {("sun", 1): "١/أ", ("sun", 2): "٢/ب", ("mon", 1): "٢/أ"}


def test_missing_label(found):
    assert found["gap", "days-in-rows"]["sun", 3] == "٢/أ" and found["gap", "days-in-rows"]["sun", 4] == "١/أ"


def test_numbered_by_position(found):
    assert found["unnumbered", "days-in-rows"] == {("sun", 1): "١/أ", ("sun", 2): "٢/ب", ("mon", 1): "٢/أ", ("mon", 3): "٣/أ", ("tue", 2): "٢/أ", ("tue", 3): "١/ب"}


def test_no_axes(found):
    assert len(found) == 4
