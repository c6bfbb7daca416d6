from __future__ import annotations

import json

from pyspark.sql import functions as F

from jadwal.sources import responses


def table(spark, *bodies):
    return spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "doc_id long, json string")


def test_teacher_lessons(spark):
    body = {"ok": True, "periodsCount": 7, "lessons": [
        {"day": "sun", "period": 1, "className": "٢/أ", "subject": "رياضيات"}, {"day": "sun", "period": 1, "className": "x"}, {"day": "fri", "period": 2, "className": "x"},
        {"day": "mon", "period": 1.5, "className": "x"}, {"day": "mon", "period": 3.0, "className": " y ", "subject": "a b c"}, {"day": "tue", "period": 7, "className": None},
    ]}
    t = table(spark, body, {"ok": False}, {"ok": True}, "junk")
    got = sorted((r["day"], r["period"], r["class_name"], r["subject"]) for r in responses.lessons(t).collect())
    assert got == [("mon", 3, "y", None), ("sun", 1, "٢/أ", "رياضيات"), ("tue", 7, "", None)]
    status = {r["doc_id"]: (r["status"], r["periods"], r["lessons"]) for r in responses.outcomes(t).collect()}
    assert status == {0: ("ok", 7, 3), 1: (None, 0, 0), 2: (None, 0, 0), 3: (None, 0, 0)}


def test_university_lectures(spark):
    rows = [
        {"day": "Sunday", "start": "8:00", "end": "9:50", "course": "MATH  101", "room": " 12 "}, {"day": "sun", "start": "8:00", "end": "9:00", "course": "MATH 101"},
        {"day": "R", "start": "23:30", "end": "8:00", "course": "X", "uncertain": True}, {"day": "?", "start": "8:00", "course": "X"}, {"day": "mon", "start": "8h", "course": "X"}, {"day": "mon", "start": "9:00", "course": " "},
    ]
    got = sorted((r["day"], r["start"], r["end"], r["course"], r["room"], r["needs_review"]) for r in responses.lectures(table(spark, {"ok": True, "lectures": rows})).collect())
    assert got == [("sun", 480, 590, "MATH 101", "12", None), ("thu", 1410, 1440, "X", None, True)]


def test_day_aliases(spark):
    given = ["sun", " Wed ", "thursday", "الأحد", "ثن", "nonsense", None]
    t = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, d string").select("i", responses.normalize_day(F.col("d")))
    assert [r[1] for r in sorted(t.collect())] == ["sun", "wed", "thu", "sun", "mon", None, None]


def test_courses(spark):
    rows = spark.createDataFrame([(1, 0, "MATH 101"), (1, 1, "math - 102"), (1, 2, "Math  101 "), (1, 3, "MATH/102")], "doc_id long, ord int, course string")
    assert sorted((r["key"], r["label"], r["color"]) for r in responses.courses(rows, ["a", "b"]).collect()) == [("math 101", "MATH 101", "a"), ("math-102", "math - 102", "b")]


def test_saved_designs(spark):
    t = table(spark, {"version": 1, "grid": [["x"]], "title": "t"}, {"version": 2, "grid": []}, {"version": 1, "grid": "no"})
    got = responses.saved_designs(t, {"title": "none", "size": 3}).collect()
    assert [(r["doc_id"], r["title"], r["size"]) for r in got if r["grid"]] == [(0, "t", 3.0)]
