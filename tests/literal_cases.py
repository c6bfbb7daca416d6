"""Small literal tables of cell readings, stored replies and edits, with the rows that the timetable rules give for them.

The texts of cells are fixed values: test vectors of the recognisers.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jadwal.functions import text
from jadwal.operators import cells, choices, lectures, lessons, raster, schedule, splits
from jadwal.sources import responses

CELL = "doc_id string, row int, col int, row_span int, col_span int, ord long, text string, ocr_confidence double, words array<struct<text string, x0 double, x1 double, confidence double>>"
GRID = "doc_id string, rows int, cols int, method string, row_lines array<double>, col_lines array<double>"


def _sql(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}::DOUBLE"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def expected(columns: str, rows: list[tuple]) -> str:
    """SQL that gives these rows."""
    body = ", ".join("(" + ", ".join(_sql(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"


QUERIES, ORACLE = {}, {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return keep


# --- texts

NORMAL = [("٢/أ", "2/ا", "ا"), ("الأَحَد", "الاحد", "الاحد"), ("ثانيةٌ", "ثانيه", "ثانيه"), ("a – b", "a - b", "ab"), ("۳\\ب", "3/ب", "ب"), (" x  y \n\n z ", "x y\nz", "xyz"), ("«نص»؟", "نص", "نص"), ("", "", "")]


@query("text_normal", expected("given, norm, letters", NORMAL))
def text_normal(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([(g,) for g, _, _ in NORMAL], "given string").withColumn("norm", text.normalize_arabic(F.col("given")))
    return t.withColumn("letters", text.letters_only(F.col("norm")))


KEYS = [("٢ / أ", "2/ا", "2/ا", "2-ا"), ("قصد 414 - 3", "قصد 414/3", "قصد 414/3", "قصد 414-3"), ("101  تقن", "101 تقن", "101 تقن", "101 تقن"), ("A–B", "A/B", "A/B", "a-b"), ("1//2", "1/2", "1/2", "1--2")]


@query("name_keys", expected("given, class_key, design_key, course_key", KEYS))
def name_keys(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([(r[0],) for r in KEYS], "given string").withColumn("n", text.normalize_arabic(F.col("given")))
    return t.select("given", text.class_key(F.col("n")).alias("class_key"), text.design_key(F.col("n")).alias("design_key"), text.course_key(F.col("n")).alias("course_key"))


@query(
    "time_formats",
    """WITH m AS (SELECT unnest(range(0, 1440, 7))::INT AS minutes), h AS (SELECT minutes, minutes // 60 AS hour, lpad((minutes % 60)::VARCHAR, 2, '0') AS mm FROM m)
SELECT minutes, ((hour + 11) % 12 + 1) || ':' || mm AS shown, lpad(hour::VARCHAR, 2, '0') || ':' || mm AS input, minutes AS parsed,
       translate(((hour + 11) % 12 + 1)::VARCHAR, '0123456789', '٠١٢٣٤٥٦٧٨٩') AS arabic_hour FROM h""",
)
def time_formats(spark: SparkSession, d: str) -> DataFrame:
    m = spark.range(0, 1440, 7).select(F.col("id").cast("int").alias("minutes"))
    t = m.select("minutes", text.format_time(F.col("minutes")).alias("shown"), text.input_time(F.col("minutes")).alias("input"), text.format_hour(F.floor(F.col("minutes") / 60)).alias("arabic_hour"))
    return t.withColumn("parsed", text.parse_time(F.col("input")))


INKS = ["#8fd3ad", "#203c32", "#ffffff", "#000000", "#f29bbd", "#777777", "#b0b0b0", "#a9a9ad", "#ff0000", "#00ff00", "#0000ff"]


@query(
    "contrast_inks",
    "WITH c AS (SELECT unnest(" + str(INKS) + """) AS color), v AS (SELECT color, list_transform([2, 4, 6], lambda i: ('0x' || substr(color, i, 2))::INT / 255) AS x FROM c),
l AS (SELECT color, list_transform(x, lambda a: CASE WHEN a <= 0.04045 THEN a / 12.92 ELSE pow((a + 0.055) / 1.055, 2.4) END) AS y FROM v)
SELECT color, CASE WHEN 0.2126 * y[1] + 0.7152 * y[2] + 0.0722 * y[3] > 0.42 THEN '#203c32' ELSE '#ffffff' END AS ink FROM l""",
)
def contrast_inks(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(c,) for c in INKS], "color string").withColumn("ink", text.contrast_ink(F.col("color")))


# --- cells

KINDS = [
    ("الأحد", "day", "sun"), ("يوم الاثنين", "day", "mon"), ("التلاتاء", "day", "tue"), ("الاربعاء", "day", "wed"), ("الخميس", "day", "thu"), ("السابعة", "period", "7"), ("الأولى", "period", "1"),
    ("الأيام", "other", None), ("٣", "period", "3"), ("الحصة الرابعة", "period", "4"), ("الحصة ٧", "period", "7"), ("الثامنة 12:00", "period", "8"), ("الثانية", "period", "2"),
    ("٢/أ", "lesson", "٢/أ"), ("أ/٢", "lesson", "٢/أ"), ("3/ب", "lesson", "٣/ب"), ("١/ا", "lesson", "١/أ"), ("٢-ب", "lesson", "٢/ب"), ("3/1", "lesson", "٣/١"), ("ثاني متوسط أ", "lesson", "ثاني متوسط أ"),
    ("رياضيات ثاني متوسطب", "lesson", "ثاني متوسط ب"), ("الصف الثالث ب", "lesson", "ثالث ب"), ("ثالث ثانوي/أ", "lesson", "ثالث ثانوي أ"), ("اني متوسطأ", "lesson", "ثاني متوسط أ"),
    ("منتظر ١", "lesson", "منتظر ١"), ("انتظار", "lesson", "انتظار"), ("", "empty", None), ("–", "empty", None), ("10:00", "other", None),
]


@query("cell_kinds", expected("text, kind, value", KINDS))
def cell_kinds(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(t, 90.0) for t, _, _ in KINDS], "text string, ocr_confidence double")
    return cells.classify(rows).select("text", "kind", F.coalesce("day", F.col("period").cast("string"), "class_name").alias("value"))


SUBJECTS = [("رياضيات ٢/أ", "رياضيات", None), ("لغه انجليزيه", "لغة إنجليزية", None), ("٢/أ\nفيزياء", "فيزياء", None), ("٢/أ رياضيات غرفة 12", "رياضيات", "غرفه 12"), ("٣/ب\nطرخون  بقدونس 08:00", "طرخون  بقدونس", None)]


@query("cell_subjects", expected("text, subject, room", SUBJECTS))
def cell_subjects(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(t, 90.0) for t, _, _ in SUBJECTS], "text string, ocr_confidence double")
    return cells.classify(rows).select("text", "subject", "room")


TABLES = {
    "rows": [["٣", "٢", "١", "اليوم"], ["", "٢/ب", "١/أ", "الأحد"], ["٣/أ", "", "٢/أ", "الاثنين"]],
    "columns": [["الاثنين", "الأحد", "الحصة"], ["٢/أ", "١/أ", "الأولى"], ["", "٢/ب", "الثانية"]],
    "gap": [["٤", "", "٢", "١", "اليوم"], ["١/أ", "٢/أ", "٣/أ", "١/ب", "الأحد"], ["", "١/أ", "", "٢/ب", "الاثنين"], ["٢/ب", "", "١/ب", "", "الثلاثاء"]],
    "unnumbered": [["", "٢/ب", "١/أ", "الأحد"], ["٣/أ", "", "٢/أ", "الاثنين"], ["١/ب", "٢/أ", "", "الثلاثاء"]],
    "clock": [["09:15", "08:30", "الثانية 07:45", "07:00", "اليوم"], ["٤/أ", "", "٢/أ", "١/أ", "الأحد"], ["", "٣/ب", "", "١/ب", "الاثنين"]],
    "near": [["٢", "١", "اليوم"], ["", "١/أ", "الأحد"], ["٢/ب", "", ""], ["", "٣/أ", "الاثنين"]],
    "nothing": [["x", "y"], ["", "z"]],
}
LESSONS = [
    ("rows", "days-in-rows", "sun", 1, "١/أ"), ("rows", "days-in-rows", "sun", 2, "٢/ب"), ("rows", "days-in-rows", "mon", 1, "٢/أ"), ("rows", "days-in-rows", "mon", 3, "٣/أ"),
    ("columns", "days-in-columns", "sun", 1, "١/أ"), ("columns", "days-in-columns", "sun", 2, "٢/ب"), ("columns", "days-in-columns", "mon", 1, "٢/أ"),
    *[("gap", "days-in-rows", "sun", p, c) for p, c in ((1, "١/ب"), (2, "٣/أ"), (3, "٢/أ"), (4, "١/أ"))], ("gap", "days-in-rows", "mon", 1, "٢/ب"), ("gap", "days-in-rows", "mon", 3, "١/أ"),
    ("gap", "days-in-rows", "tue", 2, "١/ب"), ("gap", "days-in-rows", "tue", 4, "٢/ب"),
    ("unnumbered", "days-in-rows", "sun", 1, "١/أ"), ("unnumbered", "days-in-rows", "sun", 2, "٢/ب"), ("unnumbered", "days-in-rows", "mon", 1, "٢/أ"), ("unnumbered", "days-in-rows", "mon", 3, "٣/أ"),
    ("unnumbered", "days-in-rows", "tue", 2, "٢/أ"), ("unnumbered", "days-in-rows", "tue", 3, "١/ب"),
    ("clock", "days-in-rows", "sun", 1, "١/أ"), ("clock", "days-in-rows", "sun", 2, "٢/أ"), ("clock", "days-in-rows", "sun", 4, "٤/أ"), ("clock", "days-in-rows", "mon", 1, "١/ب"), ("clock", "days-in-rows", "mon", 3, "٣/ب"),
    ("near", "days-in-rows", "sun", 1, "١/أ"), ("near", "days-in-rows", "sun", 2, "٢/ب"), ("near", "days-in-rows", "mon", 1, "٣/أ"),
]


def read_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    reads = [(name, r, c, 1, 1, r * 100 + c, t, 90.0, None) for name, rows in TABLES.items() for r, row in enumerate(rows) for c, t in enumerate(row)]
    near = [0.0, 50.0, 100.0, 110.0, 210.0]
    grids = [(n, len(t), len(t[0]), "projection" if n == "near" else "lines", near if n == "near" else None, None) for n, t in TABLES.items()]
    return spark.createDataFrame(reads, CELL), spark.createDataFrame(grids, GRID)


@query("schedule_lessons", expected("doc_id, orientation, day, period, class_name", LESSONS))
def schedule_lessons(spark: SparkSession, d: str) -> DataFrame:
    reads, grids = read_tables(spark)
    return schedule.lessons(cells.classify(reads.drop("words")), grids).select("doc_id", "orientation", "day", "period", "class_name")


SPANNED = [
    ("a", 1, 0, 4, 1, 1, "الأحد\nالثلاثاء"), ("a", 0, 0, 1, 1, 2, "الأحد\nالاثنين"), ("b", 1, 0, 2, 1, 1, "الأحد\nالاثنين"), ("b", 3, 0, 2, 1, 2, "الخميس\nالأحد"), ("c", 0, 1, 1, 3, 5, "الاثنين\nالأربعاء"), ("c", 2, 0, 2, 1, 6, "x\ny"),
]
CUT = [
    *[("a", 1 + i, 0, 1, 1, 64 + i, t) for i, t in enumerate(("الاحد", "الاثنين", "الثلاثاء", "الاربعاء"))], ("a", 0, 0, 1, 1, 128, "الأحد\nالاثنين"), ("b", 1, 0, 1, 1, 64, "الأحد"), ("b", 2, 0, 1, 1, 65, "الاثنين"),
    ("b", 3, 0, 1, 1, 128, "الخميس"), ("b", 4, 0, 1, 1, 129, "الأحد"), *[("c", 0, 1 + i, 1, 1, 320 + i, t) for i, t in enumerate(("الاثنين", "الثلاثاء", "الاربعاء"))], ("c", 2, 0, 2, 1, 384, "x\ny"),
]


@query("day_cells", expected('doc_id, "row", col, row_span, col_span, ord, "text"', CUT))
def day_cells(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([(*r, 90.0, None) for r in SPANNED], CELL)
    return splits.days_apart(t).drop("ocr_confidence", "words")


WIDE = [
    ("a", 0, 0, 1, 3, 1, "١ ٢ ٣", 80.0, [("١", 210.0, 220.0, 90.0), ("٢", 110.0, 130.0, 80.0), ("الثانية", 132.0, 140.0, 60.0), ("٣", 10.0, 20.0, 70.0), ("x", 400.0, 410.0, 10.0)]),
    ("a", 1, 0, 1, 2, 2, "١/أ درس", 80.0, [("كلام", 10.0, 20.0, 50.0), ("١", 110.0, 120.0, 50.0)]), ("a", 1, 2, 1, 1, 3, "٥", 80.0, [("٥", 210.0, 220.0, 50.0)]),
]


@query("label_cells", expected('"row", col, col_span, ord, "text", confidence', [(0, 0, 1, 64, "٣", 70.0), (0, 1, 1, 65, "٢ الثانية", 70.0), (0, 2, 1, 66, "١", 90.0), (1, 0, 2, 128, "١/أ درس", 80.0), (1, 2, 1, 192, "٥", 80.0)]))
def label_cells(spark: SparkSession, d: str) -> DataFrame:
    grids = spark.createDataFrame([("a", 2, 3, "lines", None, [0.0, 100.0, 200.0, 300.0])], GRID)
    return splits.labels_apart(spark.createDataFrame(WIDE, CELL), grids).select("row", "col", "col_span", "ord", "text", F.col("ocr_confidence").alias("confidence"))


CHOICES = [
    (1, "الأحد", 80.0, "١/أ", 0.9, "الأحد", 80.0), (2, "xx", 30.0, "١/أ", 0.9, "١/أ", 90.0), (3, "٢/ب", 90.0, "١/أ", 0.3, "٢/ب", 90.0), (4, "٢/ب", 50.0, "١/أ", 0.9, "١/أ", 90.0), (5, "كلمات طويلة", 60.0, "١/أ", 0.8, "كلمات طويلة", 60.0),
    (6, "كلمات طويلة", 85.0, "١/أ", 0.9, "كلمات طويلة", 85.0), (7, "x", 10.0, None, None, "x", 10.0), (8, "x", 10.0, "??", 0.9, "x", 10.0), (9, "٢/ب", 95.0, "١/أ", 0.4, "٢/ب", 95.0),
]


@query("chosen_readings", expected("id, text, confidence", [(r[0], r[5], r[6]) for r in CHOICES]))
def chosen_readings(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([r[:5] for r in CHOICES], "id int, ocr_text string, ocr_confidence double, short_text string, short_confidence double")
    return choices.chosen(t).select("id", "text", "confidence")


# --- stored replies

TEACHER = {
    "ok": True, "periodsCount": 8, "lessons": [
        {"day": "wed", "period": 2, "className": "3/ج", "subject": "العلوم"}, {"day": "wed", "period": 5, "className": "ثالث/2", "subject": "مراجعة الوحدة الأولى كاملة"},
        {"day": "thu", "period": 6, "className": "خامس ابتدائي 1", "subject": "الاجتماعيات"}, {"day": "mon", "period": 8, "className": "منتظر 3"}, {"day": "mon", "period": 8, "className": "said twice"},
        {"day": "sat", "period": 2, "className": "not a school day"},
    ],
}
FEW = {"ok": True, "lessons": [{"day": "sun", "period": 1, "className": "٢/أ"}, {"day": "mon", "period": 1.5, "className": "x"}]}
REPLIES = [(1, TEACHER), (2, FEW), (3, {"ok": False, "error": "quota"}), (4, {"ok": True})]


def _replies(spark: SparkSession, rows: list) -> DataFrame:
    return spark.createDataFrame([(i, json.dumps(b)) for i, b in rows], "doc_id int, json string")


@query("teacher_lessons", expected("doc_id, day, period, class_name, subject", [(1, "wed", 2, "٣/ج", "علوم"), (1, "wed", 5, "ثالث/٢", None), (1, "thu", 6, "خامس ابتدائي/١", "دراسات اجتماعية"), (1, "mon", 8, "منتظر ٣", None), (2, "sun", 1, "٢/أ", None)]))
def teacher_lessons(spark: SparkSession, d: str) -> DataFrame:
    return responses.lessons(_replies(spark, REPLIES)).select("doc_id", "day", "period", "class_name", "subject")


@query("teacher_outcomes", expected("doc_id, lessons, days, periods, quality, status", [(1, 4, 3, 8, 0.95, "ok"), (2, 1, 1, 1, 0.3, "failed"), (3, 0, 0, 0, None, None), (4, 0, 0, 0, None, None)]))
def teacher_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return responses.outcomes(_replies(spark, REPLIES))


UNIVERSITY = {
    "ok": True, "lectures": [
        {"day": "mon", "start": "07:30", "end": "08:45", "course": "204 كيم"}, {"day": "mon", "start": "07:30", "end": "08:45", "course": "204 كيم"},
        {"day": "THU", "start": "15:10", "end": "16:00", "course": "ريض 2B-310", "room": "B 12  4", "uncertain": True}, {"day": "sat", "start": "11:20", "end": "11:00", "course": "ends early"},
        {"day": "?", "start": "09:00", "end": "10:00", "course": "no day"}, {"day": "fri", "start": "7", "end": "8", "course": "no time"}, {"day": "Tuesday", "start": "23:50", "course": "  p   q"},
    ],
}
HEARD = [("mon", 450, 525, "204 كيم", None, False), ("thu", 910, 960, "ريض 2B-310", "B 12 4", True), ("sat", 680, 730, "ends early", None, False), ("tue", 1430, 1440, "p q", None, False)]


@query("university_lectures", expected('day, start, "end", course, room, needs_review', HEARD))
def university_lectures(spark: SparkSession, d: str) -> DataFrame:
    return responses.lectures(_replies(spark, [(1, UNIVERSITY), (2, {"ok": True, "lessons": []})])).select("day", "start", "end", "course", "room", F.coalesce("needs_review", F.lit(False)).alias("needs_review"))


ALIASES = [("Sunday", "sun"), ("الأحد", "sun"), ("U", "sun"), ("thu", "thu"), ("R", "thu"), ("Wednesday", "wed"), ("ثن", "mon"), ("ر", "wed"), ("yesterday", None), (None, None)]


@query("day_aliases", expected("given, day", ALIASES))
def day_aliases(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(g,) for g, _ in ALIASES], "given string").withColumn("day", responses.normalize_day(F.col("given")))


MODEL = [
    (1, "```json\n" + json.dumps({"periodsCount": 6, "lessons": [{"day": "sun", "period": i % 7 + 1.0, "className": str(i)} for i in range(150)] + [{"period": 1}]}) + "\n```"),
    (2, '{"lectures": [{"day": "sun", "start": "8:00"}, {"day": "mon"}], "notes": "n"}'), (3, "sorry"), (4, '{"lessons": [{"day": "sun", "period": 1.5}, {"day": "mon", "period": 2}]}'),
]


@query("cleaned_replies", expected("doc_id, lessons, lectures, error", [(1, 120, -1, None), (2, -1, 1, None), (3, -1, -1, "unparseable"), (4, 1, -1, None)]))
def cleaned_replies(spark: SparkSession, d: str) -> DataFrame:
    t = responses.cleaned(spark.createDataFrame(MODEL, "doc_id int, text string"))
    rows = lambda name: F.size(F.from_json(F.get_json_object("json", f"$.{name}"), "array<struct<day string>>"))
    count = lambda name: F.when(F.get_json_object("json", f"$.{name}").isNotNull(), rows(name)).otherwise(-1).alias(name)
    return t.select("doc_id", count("lessons"), count("lectures"), "error")


@query("routed_readers", expected("doc_id, reader, status, skipped", [(1, "smart", "ok", None), (2, "local", "ok", "too-few"), (3, "local", "failed", "quota"), (4, "local", "ok", "unavailable")]))
def routed_readers(spark: SparkSession, d: str) -> DataFrame:
    hosted = spark.createDataFrame([(1, "ok", None), (2, "failed", None), (3, None, "quota")], "doc_id int, status string, reason string")
    local = spark.createDataFrame([(2, "ok"), (3, "failed"), (4, "ok")], "doc_id int, status string")
    return responses.routed(spark.range(1, 5).select(F.col("id").cast("int").alias("doc_id")), hosted, local)


FILES = [("u", f"p{i}.png", 100, "too-many" if i > 2 else None) for i in range(1, 5)] + [("u", "a.txt", 5, "not-an-image"), ("u", "b.JPG", 30 << 20, "too-large"), ("v", "z.webp", 20 << 20, None)]


@query("admitted_images", expected("upload, path, refused", [(u, p, r) for u, p, _, r in FILES]))
def admitted_images(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([f[:3] for f in FILES], "upload string, path string, length long")
    return responses.admission(t, most=2).select("upload", "path", "refused")


# --- lessons

READ = [
    ("a", "sun", 1, "٢/أ", 0.9), ("a", "sun", 2, "2/ا", 0.6), ("a", "mon", 1, "١/ب", 0.95), ("b", "sun", 1, "١/٣", 0.9), ("b", "sun", 2, "٢/٣", 0.9), ("b", "mon", 3, "٤/٣", 0.4), ("b", "mon", 13, "x", 0.9),
    ("c", "sun", 1, "٢/١", 0.9), ("c", "mon", 2, "٢/ب", 0.9), ("c", "tue", 3, "٣/ج", 0.9), ("c", "tue", 4, "١/د", 0.9), ("c", "wed", 4, "", 0.3),
]


def _validated(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    rows = spark.createDataFrame([(*r, i) for i, r in enumerate(READ)], "doc string, day string, period int, class_name string, conf double, ord int")
    axes = spark.createDataFrame([("a", 5, 7), ("b", 2, 3), ("c", 4, 4), ("none", 1, 0)], "doc string, days int, periods int")
    return lessons.validated(rows, axes, "doc")


FIXED = [("a", 0, "٢/أ"), ("a", 1, "٢/أ"), ("a", 2, "١/ب"), ("b", 3, "٣/١"), ("b", 4, "٣/٢"), ("b", 5, "٣/٤"), ("c", 7, "٢/أ"), ("c", 8, "٢/ب"), ("c", 9, "٣/ج"), ("c", 10, "١/د"), ("c", 11, "")]


@query("validated_lessons", expected("doc, ord, class_name", FIXED))
def validated_lessons(spark: SparkSession, d: str) -> DataFrame:
    return _validated(spark)[0].select("doc", "ord", "class_name")


WORTH = [("a", 3, 0, 1.0, True), ("b", 3, 1, round(0.35 * 0.4 + 0.25 * 0.6 + 0.4 * (0.5 * 2 + 0.5 * 3) / 3, 6), False), ("c", 5, 0, round(0.35 * 0.8 + 0.25 * 0.8 + 0.4 * 0.8, 6), True), ("none", 0, 0, 0.07, False)]


@query("validated_verdicts", expected("doc, lessons, dropped, quality, ok", WORTH))
def validated_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _validated(spark)[1]


SEEN = [  # image, ord, day, period, class, subject, confidence
    (1, 0, 0, 1, "x", "", 0.4), (2, 0, 0, 1, "x", "s", 0.7), (3, 0, 0, 1, "x", "t", 0.9), (4, 0, 0, 1, "x", "", 0.8), (1, 1, 1, 2, "y", "s", 0.6), (2, 1, 1, 2, "y", "s", 0.3), (1, 2, 2, 3, "z", "", 0.9), (2, 2, 2, 3, "w", "", 0.95), (3, 2, 2, 3, "w", "", 0.2),
    (1, 3, 3, 1, "v", "", 0.45),
]
MERGED = [(0, 1, "x", "s", 0.8, False, True, 2), (1, 2, "y", "s", 0.6, False, False, 0), (2, 3, "z", "", 0.9, True, True, 3), (3, 1, "v", "", 0.45, True, False, 0)]


def _merged(spark: SparkSession) -> DataFrame:
    t = spark.createDataFrame([("a", *r) for r in SEEN], "doc string, image int, ord int, day_idx int, period int, class_name string, subject string, conf double")
    return lessons.merge_readings(t, "doc", "class_name", "conf", "image", subject="subject")


@query("merged_subjects", expected("day_idx, period, name, subject, conf, review, conflict, alternatives", MERGED))
def merged_subjects(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark).drop("doc")


@query("merge_summary", expected("doc, failed_images, warnings, lessons, days, periods, uncertain, conflicts", [("a", "3,5", "dim,far", 4, 4, 3, 2, 2), ("b", "1", "", 0, 0, 0, 0, 0)]))
def merge_summary(spark: SparkSession, d: str) -> DataFrame:
    images = spark.createDataFrame([("a", 1, True, ["far"]), ("a", 2, True, ["dim", "far"]), ("a", 3, False, ["lost"]), ("a", 5, False, None), ("b", 1, False, None)], "doc string, image int, ok boolean, warnings array<string>")
    facts = lessons.merge_facts(_merged(spark), images, "doc")
    return facts.withColumn("failed_images", F.concat_ws(",", F.col("failed_images").cast("array<string>"))).withColumn("warnings", F.concat_ws(",", "warnings"))


SIDE = "doc string, day_idx int, period int, name string"


@query("lesson_mistakes", expected("day_idx, period, want, got", [(0, 2, "b", "x"), (1, 1, "c", None), (2, 2, None, "d")]))
def lesson_mistakes(spark: SparkSession, d: str) -> DataFrame:
    want = spark.createDataFrame([("a", 0, 1, "a"), ("a", 0, 2, "b"), ("a", 1, 1, "c")], SIDE)
    got = spark.createDataFrame([("a", 0, 1, "a"), ("a", 0, 2, "x"), ("a", 2, 2, "d")], SIDE)
    return lessons.mistakes(want, got, "doc", "name").drop("doc")


@query("class_colors", expected("class_key, color", [("x", "#222222"), ("y", "#8fd3ad"), ("z", "#e6e8de")]))
def class_colors(spark: SparkSession, d: str) -> DataFrame:
    make = lambda *rows: spark.createDataFrame(list(rows), "doc int, class_key string, color string")
    rows = spark.createDataFrame([(1, "x"), (1, "y"), (1, "z")], "doc int, class_key string")
    return lessons.colored(rows, "doc", "class_key", make((1, "x", "#111111"), (1, "y", "#8fd3ad")), make((1, "x", "#222222"))).drop("doc")


@query("default_hours", expected("doc, start_hour, end_hour", [(1, 8, 12), (2, 8, 15), (3, 10, 12), (4, 8, 12), (5, 23, 24)]))
def default_hours(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([(1, 480, 590), (1, 600, 710), (2, 480, 590), (2, 780, 880), (3, 615, 665), (5, 1435, 1440)], "doc int, start int, end int")
    return lessons.hours(t, spark.range(1, 6).select(F.col("id").cast("int").alias("doc")), ["doc"])


@query("weekend_days", expected("doc, day_idx", [*[(i, k) for i in (1, 2, 3) for k in range(5)], (2, 6)]))
def weekend_days(spark: SparkSession, d: str) -> DataFrame:
    used = spark.createDataFrame([(1, 1), (2, 6), (2, 6)], "doc int, day_idx int")
    return lessons.active_days(used, spark.range(1, 4).select(F.col("id").cast("int").alias("doc")), "doc")


@query("week_boxes", "SELECT p AS period, d AS day_idx, round(1200 - 40 - 120 - (1200 - 80 - 120) / 5 * (d + 1), 6) AS x, round(300 + 250.0 * (p - 1), 6) AS y, 200.0::DOUBLE AS w, 250.0::DOUBLE AS h FROM range(1, 8) a(p), range(0, 5) b(d)")
def week_boxes(spark: SparkSession, d: str) -> DataFrame:
    laid = lessons.boxes(lessons.empty_grid(spark), 1200.0, 40.0, 120.0, 300.0, 250.0)
    return laid.select("period", "day_idx", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "w", "h")


DESIGN = "doc int, period int, day_idx int, subject string, classroom string, occupied boolean, review boolean, conflict boolean"
CELLS = [(1, 1, 0, "s", "x", True, True, True), (1, 1, 1, "", "", False, False, False), (1, 2, 0, "", "y", True, True, False), (1, 2, 1, "", "", False, False, False), (2, 1, 0, "", "", False, False, False)]


@query("design_gates", expected("doc, lessons, can_apply, can_export", [(1, 2, False, False), (2, 0, True, False), (3, 0, True, False)]))
def design_gates(spark: SparkSession, d: str) -> DataFrame:
    states = spark.createDataFrame([(1, "photo"), (2, "manual"), (3, "empty")], "doc int, source string")
    return lessons.grid_gates(spark.createDataFrame(CELLS, DESIGN), states, "doc")


EDITED = [(1, 1, 0, "s", "z", True, False, False), (1, 1, 1, "", "", False, False, False), (1, 2, 0, "", "", False, False, False), (1, 2, 1, "", "", False, False, False), (1, 3, 0, "", "", False, False, False), (1, 3, 1, "", "", False, False, False), (2, 1, 0, "", "", False, False, False), (2, 2, 0, "", "", False, False, False), (2, 3, 0, "", "", False, False, False)]


@query("design_edits", expected("doc, period, day_idx, subject, classroom, occupied, review, conflict", EDITED))
def design_edits(spark: SparkSession, d: str) -> DataFrame:
    edits = spark.createDataFrame([(1, 1, 0, None, "z"), (1, 2, 0, None, "")], "doc int, period int, day_idx int, subject string, classroom string")
    return lessons.resized(lessons.patched(spark.createDataFrame(CELLS, DESIGN), edits, "doc"), "doc", 3)


LECTURE = "id string, day string, start int, end int, course string, room string, needs_review boolean"


@query("lecture_edits", expected('id, day, start, "end", course, room, needs_review', [("a", "mon", 500, 560, "A2", None, False), ("c", "tue", 600, 650, "C", None, True), ("d", "sat", 700, 750, "D", "r", False)]))
def lecture_edits(spark: SparkSession, d: str) -> DataFrame:
    old = spark.createDataFrame([("a", "sun", 480, 530, "A", "1", True), ("b", "mon", 480, 530, "B", None, None), ("c", "tue", 600, 650, "C", None, True)], LECTURE)
    new = spark.createDataFrame([("a", "mon", 500, 560, "A2", None, True), ("d", "sat", 700, 750, "D", "r", None)], LECTURE)
    return lectures.in_order(lectures.edited(old, new, spark.createDataFrame([("b",)], "id string"))).na.fill({"needs_review": False})


FORMS = [(1, "8:00", "9:00", "x", None), (2, "8:00", "9:00", " ", "no-course"), (3, "8", "9:00", "x", "no-time"), (4, "9:00", "9:00", "x", "end-before-start"), (5, None, "9:00", "x", "no-time")]


@query("lecture_forms", expected("id, fault", [(r[0], r[4]) for r in FORMS]))
def lecture_forms(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([r[:4] for r in FORMS], "id int, start string, end string, course string")
    return t.select("id", lectures.fault(F.col("start"), F.col("end"), F.col("course")).alias("fault"))


# --- rasters: two images whose pixels follow from their places

PIXELS_SQL = "p AS (SELECT i AS img, y, x, ((y * 7 + x * 13 + i * 5) % 11 * 20)::INT AS v FROM range(1, 3) a(i), range(0, 6) b(y), range(0, 9) c(x)), m AS (SELECT img, y, x, (v < 100)::INT AS v FROM p)"


def _pixels(spark: SparkSession) -> DataFrame:
    at = spark.range(2 * 6 * 9).select((F.col("id") / 54).cast("int").alias("i"), (F.col("id") % 54 / 9).cast("int").alias("y"), (F.col("id") % 9).cast("int").alias("x"))
    return at.select((F.col("i") + 1).alias("img"), "y", "x", ((F.col("y") * 7 + F.col("x") * 13 + (F.col("i") + 1) * 5) % 11 * 20).alias("v"))


def _ink(spark: SparkSession) -> DataFrame:
    return raster.global_mask(_pixels(spark), 100)


@query("raster_projection", f"WITH {PIXELS_SQL} SELECT img, y AS pos, sum(v) AS v FROM m GROUP BY 1, 2")
def raster_projection(spark: SparkSession, d: str) -> DataFrame:
    return raster.projection(_ink(spark), "y")


@query("raster_ink", f"WITH {PIXELS_SQL} SELECT img, sum(v) AS ink, round(avg(v), 6) AS ratio FROM m GROUP BY 1")
def raster_ink(spark: SparkSession, d: str) -> DataFrame:
    return raster.ink(_ink(spark))


@query("raster_rotate", f"WITH {PIXELS_SQL} SELECT img, x AS y, 5 - y AS x, v FROM p")
def raster_rotate(spark: SparkSession, d: str) -> DataFrame:
    return raster.rotate(_pixels(spark), 90)


@query("raster_crop", f"WITH {PIXELS_SQL} SELECT img, y - 1 AS y, x - 2 AS x, v FROM p WHERE y BETWEEN 1 AND 3 AND x BETWEEN 2 AND 6")
def raster_crop(spark: SparkSession, d: str) -> DataFrame:
    return raster.crop(_pixels(spark), 1, 2, 3, 5)


@query(
    "raster_longest_run",
    f"""WITH {PIXELS_SQL}, h AS (SELECT img, y, x, CASE WHEN x - lag(x) OVER (PARTITION BY img, y ORDER BY x) <= 2 THEN 0 ELSE 1 END AS cut FROM m WHERE v = 1),
r AS (SELECT *, sum(cut) OVER (PARTITION BY img, y ORDER BY x) AS run FROM h), l AS (SELECT img, y, run, max(x) - min(x) + 1 AS n FROM r GROUP BY 1, 2, 3) SELECT img, y, max(n) AS length FROM l GROUP BY 1, 2""",
)
def raster_longest_run(spark: SparkSession, d: str) -> DataFrame:
    return raster.longest_run(_ink(spark), "x", 1)


@query("raster_xor", f"WITH {PIXELS_SQL} SELECT img, y, x, xor(v, (x % 2)::INT) AS v FROM m")
def raster_xor(spark: SparkSession, d: str) -> DataFrame:
    stripes = _pixels(spark).withColumn("v", F.col("x") % 2)
    return raster.combined(_ink(spark), stripes, lambda a, b: a.bitwiseXOR(b))
