from __future__ import annotations

import pytest

from jadwal.operators import cells

CASES = {
    "الأحد": ("day", "sun"), "يوم الاثنين": ("day", "mon"), "التلاتاء": ("day", "tue"), "الاربعاء": ("day", "wed"), "الخميس": ("day", "thu"),
    "السابعة": ("period", 7), "الأولى": ("period", 1), "الأيام": ("other", None), "٣": ("period", 3), "الحصة الرابعة": ("period", 4), "الحصة ٧": ("period", 7), "الثامنة 12:00": ("period", 8), "الثانية": ("period", 2),
    "٢/أ": ("lesson", "٢/أ"), "أ/٢": ("lesson", "٢/أ"), "3/ب": ("lesson", "٣/ب"), "١/ا": ("lesson", "١/أ"), "٢-ب": ("lesson", "٢/ب"), "3/1": ("lesson", "٣/١"),
    "ثاني متوسط أ": ("lesson", "ثاني متوسط أ"), "رياضيات ثاني متوسطب": ("lesson", "ثاني متوسط ب"), "الصف الثالث ب": ("lesson", "ثالث ب"), "ثالث ثانوي/أ": ("lesson", "ثالث ثانوي أ"), "اني متوسطأ": ("lesson", "ثاني متوسط أ"),
    "منتظر ١": ("lesson", "منتظر ١"), "انتظار": ("lesson", "انتظار"), "": ("empty", None), None: ("empty", None), "–": ("empty", None), "10:00": ("other", None),
}
SUBJECTS = {"رياضيات ٢/أ": "رياضيات", "لغه انجليزيه": "لغة إنجليزية", "علوم": "علوم", "٢/أ\nفيزياء": "فيزياء"}


@pytest.fixture(scope="module")
def read(spark):
    rows = spark.createDataFrame([(t, 90.0) for t in [*CASES, *SUBJECTS]], "text string, ocr_confidence double")
    return {r["text"]: r for r in cells.classify(rows).collect()}


@pytest.mark.parametrize("given", list(CASES))
def test_kind(read, given):
    kind, value = CASES[given]
    r = read[given]
    assert r["kind"] == kind
    assert {"day": r["day"], "period": r["period"], "lesson": r["class_name"]}.get(kind) == value


@pytest.mark.parametrize("given", list(SUBJECTS))
def test_subject(read, given):
    assert read[given]["subject"] == SUBJECTS[given]
