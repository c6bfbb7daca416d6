"""Queries that read the events and orders as cell texts, stored replies, designs and edits, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jadwal.functions import text
from jadwal.operators import cells, choices, lectures, lessons, raster, schedule, splits
from jadwal.plans.images import HEIGHT, INK_SQL, PIXELS_SQL, WIDTH, ink, pixels
from jadwal.plans.slots import SLOTS_SQL, slots, table
from jadwal.sources import designs, responses
from jadwal.storage import shared_dir

REPLY_ROWS = 40  # events of one stored reply

# Day keys, Arabic and English names, one-letter names.
DAYS = ["sun", "mon", "tue", "wed", "thu", "fri", "sat"]
ARABIC = ["الأحد", "الاثنين", "الثلاثاء", "الأربعاء", "الخميس", "الجمعة", "السبت"]
ENGLISH = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
LETTERS = "UMTWRFS"
SPELLED = [("رياضيات", "رياضيات"), ("العلوم", "علوم"), ("لغه انجليزيه", "لغة إنجليزية"), ("الفقه", "فقه")]
COLORS = ["#8fd3ad", "#93b4f2", "#f6c65a"]

QUERIES, ORACLE = {}, {}


def query(*parts: str):
    """Registers a query under its function's name, with the SQL of the last part after the parts before it."""

    def keep(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = "WITH RECURSIVE " + ", ".join([SLOTS_SQL, *parts[:-1]]) + " " + parts[-1]
        return f

    return keep


def pick(items: list, at: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in items]), at.cast("int"))


def sql_list(items: list) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def arabic(name: Column) -> Column:
    """A class as a timetable shows it."""
    return F.translate(name, "123abcd", "١٢٣أبجد")


ARABIC_SQL = "translate({}, '123abcd', '١٢٣أبجد')"
CLASS = ARABIC_SQL.format("class_name")
DIGITS_SQL = "translate(({})::VARCHAR, '0123456789', '٠١٢٣٤٥٦٧٨٩')"


# --- texts


@query(
    """SELECT ord, (ord % 1000) || '/' || ['ا', 'ا', 'ا', 'ه', 'ي'][ord % 5 + 1] || ' - x' AS norm, ['ا', 'ا', 'ا', 'ه', 'ي'][ord % 5 + 1] || 'x' AS letters FROM slots"""
)
def text_normal(spark: SparkSession, d: str) -> DataFrame:
    given = F.concat(
        F.lit(" "), text.to_arabic_digits(F.col("ord") % 1000), F.lit("\\"), pick(["أَ", "إ", "آ", "ة", "ى"], F.col("ord") % 5), F.lit("  – x\n\n")
    )
    t = slots(spark, d).select("ord", given.alias("given")).withColumn("norm", text.normalize_arabic(F.col("given")))
    return t.select("ord", "norm", text.letters_only(F.col("norm")).alias("letters"))


@query(
    "SELECT ord, class_name AS class_key, class_name AS design_key, replace(class_name, '/', '-') AS course_key FROM slots WHERE ord % 4 <> 2 "
    "UNION ALL SELECT ord, class_name, class_name, replace(class_name, '/', '-') FROM slots WHERE ord % 4 = 2"
)
def name_keys(spark: SparkSession, d: str) -> DataFrame:
    n = text.normalize_arabic(F.col("class_raw"))
    return slots(spark, d).select(
        "ord", text.class_key(n).alias("class_key"), text.design_key(n).alias("design_key"), text.course_key(n).alias("course_key")
    )


@query(
    "h AS (SELECT ord, minute, minute // 60 AS hour, lpad((minute % 60)::VARCHAR, 2, '0') AS mm FROM slots)",
    "SELECT ord, ((hour + 11) % 12 + 1) || ':' || mm AS shown, lpad(hour::VARCHAR, 2, '0') || ':' || mm AS input, minute AS parsed, " + DIGITS_SQL.format("(hour + 11) % 12 + 1") + " AS arabic_hour FROM h",
)
def time_formats(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("minute")
    t = slots(spark, d).select(
        "ord", text.format_time(m).alias("shown"), text.input_time(m).alias("input"), text.format_hour(F.floor(m / 60)).alias("arabic_hour")
    )
    return t.withColumn("parsed", text.parse_time(F.col("input")))


@query(
    "c AS (SELECT o_orderkey, printf('%06x', o_orderkey * 7919 % 16777216) AS hex FROM orders)", "v AS (SELECT *, list_transform([1, 3, 5], lambda "
    "i: ('0x' || substr(hex, i, 2))::INT / 255) AS x FROM c)",
    "l AS (SELECT *, list_transform(x, lambda a: CASE WHEN a <= 0.04045 THEN a / 12.92 ELSE pow((a + 0.055) / 1.055, 2.4) END) AS y FROM v)",
    "SELECT o_orderkey, CASE WHEN 0.2126 * y[1] + 0.7152 * y[2] + 0.0722 * y[3] > 0.42 THEN '#203c32' ELSE '#ffffff' END AS ink FROM l",
)
def contrast_inks(spark: SparkSession, d: str) -> DataFrame:
    color = F.concat(F.lit("#"), F.lower(F.lpad(F.hex(F.col("o_orderkey") * 7919 % 16777216), 6, "0")))
    return table(spark, d, "orders").select("o_orderkey", text.contrast_ink(color).alias("ink"))


# --- cells

CELL = "doc_id long, row int, col int, row_span int, col_span int, ord long, text string, ocr_confidence double, words array<struct<text string, x0 double, x1 double, confidence double>>"


def _cell_texts(spark: SparkSession, d: str) -> DataFrame:
    """sched, text: readings of nine kinds."""
    k, shown = F.col("ord") % 9, arabic(F.col("class_name"))
    kinds = [
        shown, F.translate(shown, "١٢٣", "123"), pick(ARABIC, F.col("day_idx")), F.concat(
            F.lit("الحصة "), text.to_arabic_digits(F.col("period"))
        ), text.input_time(F.col("minute")), F.lit(""),
        F.concat(F.lit("رياضيات "), shown), F.concat(F.lit("منتظر "), F.col("period").cast("string")), F.lit("–"),
    ]
    return slots(spark, d).select(
        "sched", F.coalesce(*[F.when(k == i, t) for i, t in enumerate(kinds)]).alias("text"), F.lit(90.0).alias("ocr_confidence")
    )


@query(
    f"told AS (SELECT sched, ['lesson', 'lesson', 'day', 'period', 'other', 'empty', 'lesson', 'lesson', 'empty'][ord % 9 + 1] AS kind, CASE ord % "
    f"9 WHEN 2 THEN {sql_list(DAYS)}[day_idx + 1] WHEN 3 THEN period::VARCHAR WHEN 7 THEN 'منتظر ' || {DIGITS_SQL.format('period')} WHEN 0 THEN "
    f"{CLASS} WHEN 1 THEN {CLASS} WHEN 6 THEN {CLASS} END AS value FROM slots)",
    "SELECT sched, kind, value, count(*) AS n FROM told GROUP BY ALL",
)
def cell_kinds(spark: SparkSession, d: str) -> DataFrame:
    read = cells.classify(_cell_texts(spark, d))
    return read.groupBy("sched", "kind", F.coalesce("day", F.col("period").cast("string"), "class_name").alias("value")).agg(F.count("*").alias("n"))


@query(
    f"SELECT {sql_list([s for _, s in SPELLED])}[ord % 4 + 1] AS subject, CASE WHEN ord % 3 = 0 THEN 'معمل ' || period END AS room, {CLASS} AS "
    f"class_name, count(*) AS n FROM slots GROUP BY ALL",
)
def cell_subjects(spark: SparkSession, d: str) -> DataFrame:
    subject, shown = pick([s for s, _ in SPELLED], F.col("ord") % 4), arabic(F.col("class_name"))
    room = F.when(F.col("ord") % 3 == 0, F.concat(F.lit(" معمل "), F.col("period").cast("string"))).otherwise("")
    body = F.when(F.col("ord") % 2 == 0, F.concat(subject, F.lit(" "), shown, room)).otherwise(F.concat(shown, F.lit("\n"), subject, room))
    read = cells.classify(slots(spark, d).select(body.alias("text"), F.lit(90.0).alias("ocr_confidence")))
    return read.groupBy("subject", "room", "class_name").agg(F.count("*").alias("n"))


def _week_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each schedule as a table: a row a school day, periods 7 to 1 in columns, the days in the last column."""
    first = lessons.first_wins(lessons.valid_slots(slots(spark, d)).where("period <= 7"), ["sched", "day_idx", "period"], "class_name")
    cell = lambda row, col, body: F.struct(row.cast("int").alias("row"), col.cast("int").alias("col"), body.alias("text"))
    head = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: cell(F.lit(0), c, F.when(c == 7, "اليوم").otherwise(text.to_arabic_digits(7 - c))))
    days = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda r: cell(r, F.lit(7), pick(ARABIC, r - 1)))
    docs = first.select(F.col("sched").alias("doc_id")).distinct()
    frame = docs.select("doc_id", F.explode(F.concat(head, days)).alias("c")).select("doc_id", "c.*")
    body = first.select(
        F.col("sched").alias("doc_id"), (F.col("day_idx") + 1).alias("row"), (7 - F.col("period")).alias("col"),
        arabic(F.col("class_name")).alias("text")
    )
    every = frame.unionByName(body).select(
        "doc_id", "row", "col", F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), (F.col("row") * 100 + F.col("col")).cast("long").alias("ord"),
        "text", F.lit(90.0).alias("ocr_confidence")
    )
    return every, docs.select("doc_id", F.lit(6).alias("rows"), F.lit(8).alias("cols"))


@query(
    "SELECT sched AS doc_id, 'days-in-rows' AS orientation, " + sql_list(DAYS) + "[day_idx + 1] AS day, period, " + ARABIC_SQL.format("arg_min(class_name, ord)") + " AS class_name FROM slots WHERE day_idx BETWEEN 0 AND 4 AND period <= 7 GROUP BY sched, day_idx, period",
)
def schedule_lessons(spark: SparkSession, d: str) -> DataFrame:
    reads, grids = _week_tables(spark, d)
    return schedule.lessons(cells.classify(reads), grids).select("doc_id", "orientation", "day", "period", "class_name")


@query(
    "k AS (SELECT sched, count(*) % 4 + 2 AS days FROM slots GROUP BY 1)",
    f"SELECT sched AS doc_id, (i + 1)::INT AS \"row\", 0 AS col, 1 AS row_span, 1 AS col_span, (sched * 64 + i)::BIGINT AS ord, "
    f"{sql_list(ARABIC)}[i + 1] AS \"text\" FROM k, LATERAL (SELECT unnest(range(days)) AS i)",
)
def day_cells(spark: SparkSession, d: str) -> DataFrame:
    days = (F.count("*") % 4 + 2).cast("int")
    k = slots(spark, d).groupBy(F.col("sched").alias("doc_id")).agg(days.alias("row_span"))
    names = F.array_join(F.slice(F.array(*[F.lit(x) for x in ARABIC]), F.lit(1), F.col("row_span")), "\n")
    wide = k.select(
        "doc_id", F.lit(1).alias("row"), F.lit(0).alias("col"), "row_span", F.lit(1).alias("col_span"), F.col("doc_id").alias("ord"),
        names.alias("text"), F.lit(90.0).alias("ocr_confidence"), F.lit(None).cast(CELL.split("words ")[1]).alias("words")
    )
    return splits.days_apart(wide).drop("ocr_confidence", "words")


@query(
    "k AS (SELECT sched, count(*) % 9 AS n FROM slots GROUP BY 1)",
    f"SELECT sched AS doc_id, i::INT AS col, 1 AS col_span, (sched * 64 + i)::BIGINT AS ord, {DIGITS_SQL.format('(n + i) % 9 + 1')} AS \"text\", "
    f"(50 + i)::DOUBLE AS confidence FROM k, range(3) AS r(i)",
)
def label_cells(spark: SparkSession, d: str) -> DataFrame:
    k = slots(spark, d).groupBy(F.col("sched").alias("doc_id")).agg((F.count("*") % 9).cast("int").alias("n"))
    word = lambda i: F.struct(
        text.to_arabic_digits((F.col("n") + i) % 9 + 1).alias("text"), (i * 100 + 30.0).alias("x0"), (i * 100 + 60.0).alias("x1"),
        (i + 50.0).alias("confidence")
    )
    words = F.transform(F.sequence(F.lit(0), F.lit(2)), word)
    wide = k.select(
        "doc_id", F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit(1).alias("row_span"), F.lit(3).alias("col_span"), F.col("doc_id").alias("ord"),
        F.lit("").alias("text"), F.lit(80.0).alias("ocr_confidence"), words.alias("words")
    )
    grids = k.select("doc_id", F.array(*[F.lit(100.0 * i) for i in range(4)]).alias("col_lines"))
    return splits.labels_apart(wide, grids).select("doc_id", "col", "col_span", "ord", "text", F.col("ocr_confidence").alias("confidence"))


@query(
    "t AS (SELECT ord, ord % 3 AS k, conf FROM slots)",
    "SELECT ord, CASE WHEN k = 0 AND conf >= 0.55 THEN 'الأحد' WHEN k = 1 AND conf > 0.9 THEN '٢/ب' WHEN k = 2 THEN 'x' ELSE '١/أ' END AS "
    "\"text\", CASE WHEN k = 2 OR (k = 0 AND conf >= 0.55) OR (k = 1 AND conf > 0.9) THEN round(conf * 100, 6) ELSE 90.0 END AS confidence FROM t",
)
def chosen_readings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("ord") % 3
    t = slots(spark, d).select(
        "ord", pick(["الأحد", "٢/ب", "x"], k).alias("ocr_text"), F.round(F.col("conf") * 100, 6).alias("ocr_confidence"), F.when(k != 2, "١/أ").alias("short_text"), F.when(k != 2, 0.9).alias(
            "short_confidence"
        )
    )
    return choices.chosen(t).select("ord", "text", "confidence")


# --- stored replies: forty events each


def _listed(spark: SparkSession, d: str, row: Column) -> DataFrame:
    """doc_id, rows: a list for every forty events, in order."""
    at = F.struct("ord", row.alias("row"))
    return slots(spark, d).groupBy(F.floor(F.col("ord") / REPLY_ROWS).alias("doc_id")).agg(
        F.transform(F.array_sort(F.collect_list(at)), lambda x: x["row"]).alias("rows")
    )


def _teacher_replies(spark: SparkSession, d: str) -> DataFrame:
    """Every eleventh reply is no JSON, every seventh is not ok."""
    row = F.struct(
        pick(DAYS, F.col("day_idx")).alias("day"), F.col("period").cast("double").alias("period"), arabic(F.col("class_name")).alias("className"),
        F.lit("الرياضيات").alias("subject")
    )
    body = F.to_json(F.struct((F.col("doc_id") % 7 != 6).alias("ok"), F.lit(7.0).alias("periodsCount"), F.col("rows").alias("lessons")))
    return _listed(spark, d, row).select("doc_id", F.when(F.col("doc_id") % 11 == 10, "no answer").otherwise(body).alias("json"))


TAUGHT_SQL = f"taught AS (SELECT ord // 40 AS doc_id, day_idx, period, arg_min(class_name, ord) AS class_name FROM slots WHERE day_idx < 5 AND (ord // 40) % 7 <> 6 AND (ord // 40) % 11 <> 10 GROUP BY ALL)"  # noqa: F541


@query(TAUGHT_SQL, f"SELECT doc_id, {sql_list(DAYS)}[day_idx + 1] AS day, period, {CLASS} AS class_name, 'رياضيات' AS subject FROM taught")
def teacher_lessons(spark: SparkSession, d: str) -> DataFrame:
    return responses.lessons(_teacher_replies(spark, d)).select("doc_id", "day", "period", "class_name", "subject")


@query(
    TAUGHT_SQL,
    "k AS (SELECT doc_id, count(*) AS n, count(DISTINCT day_idx) AS d, max(period) AS top FROM taught GROUP BY 1)",
    """SELECT doc_id, coalesce(n, 0) AS lessons, coalesce(d, 0) AS days, CASE WHEN doc_id % 11 = 10 THEN 0 ELSE least(12, greatest(7, coalesce(top, 0))) END AS periods,
  CASE WHEN usable THEN CASE WHEN coalesce(n, 0) >= 3 AND coalesce(d, 0) >= 3 THEN 0.95 ELSE 0.3 END END AS quality, CASE WHEN usable THEN CASE WHEN coalesce(n, 0) >= 3 AND coalesce(d, 0) >= 3 THEN 'ok' ELSE 'failed' END END AS status
  FROM (SELECT DISTINCT ord // 40 AS doc_id, (ord // 40) % 7 <> 6 AND (ord // 40) % 11 <> 10 AS usable FROM slots) LEFT JOIN k USING (doc_id)""",
)
def teacher_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return responses.outcomes(_teacher_replies(spark, d))


@query(
    "said AS (SELECT ord // 40 AS doc_id, day_idx, minute, class_name, min(ord) AS ord FROM slots GROUP BY ALL)",
    f"""SELECT doc_id, {sql_list(DAYS)}[day_idx + 1] AS day, minute AS start, CASE WHEN ord % 3 <> 0 AND least(minute + 70, 1439) > minute THEN least(minute + 70, 1439) ELSE least(minute + 50, 1440) END AS "end",
  class_name AS course, CASE WHEN ord % 2 = 0 THEN 'r ' || period_ END AS room, ord % 5 = 0 AS needs_review FROM (SELECT *, (minute // 60) % 12 + 1 AS period_ FROM said)""",
)
def university_lectures(spark: SparkSession, d: str) -> DataFrame:
    end = F.when(F.col("ord") % 3 != 0, text.input_time(F.least(F.col("minute") + 70, F.lit(1439)))).otherwise("00:00")
    room = F.when(F.col("ord") % 2 == 0, F.concat(F.lit("  r   "), F.col("period").cast("string")))
    row = F.struct(
        pick(ENGLISH, F.col("day_idx")).alias("day"), text.input_time(F.col("minute")).alias("start"), end.alias("end"),
        F.col("class_name").alias("course"), room.alias("room"), (F.col("ord") % 5 == 0).alias("uncertain")
    )
    body = F.to_json(F.struct(F.lit(True).alias("ok"), F.col("rows").alias("lectures")))
    found = responses.lectures(_listed(spark, d, row).select("doc_id", body.alias("json")))
    return found.select("doc_id", "day", "start", "end", "course", "room", F.coalesce("needs_review", F.lit(False)).alias("needs_review"))


@query(
    "seen AS (SELECT ord // 40 AS doc_id, replace(class_name, '/', '-') AS key, arg_min(class_raw, ord) AS label, min(ord) AS ord FROM slots GROUP BY ALL)",
    f"SELECT doc_id, key, label, {sql_list(COLORS)}[(row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1) % 3 + 1] AS color FROM seen",
)
def reply_courses(spark: SparkSession, d: str) -> DataFrame:
    """The distinct courses of every forty events, in order of appearance."""
    rows = slots(spark, d).select(F.floor(F.col("ord") / REPLY_ROWS).alias("doc_id"), F.concat(F.lit(" "), "class_raw").alias("course"), "ord")
    return responses.courses(rows, COLORS)


@query(f"SELECT ord, CASE WHEN ord % 5 <> 4 THEN {sql_list(DAYS)}[day_idx + 1] END AS day FROM slots")
def day_aliases(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("day_idx")
    given = F.coalesce(
        *[
            F.when(F.col("ord") % 5 == k, v) for k,
            v in enumerate(
                (pick(ENGLISH, i), pick(list(LETTERS), i), pick(ARABIC, i), F.upper(F.concat(F.lit(" "), pick(DAYS, i))), F.lit("some day"))
            )
        ]
    )
    return slots(spark, d).select("ord", responses.normalize_day(given).alias("day"))


@query(
    "k AS (SELECT ord // 40 AS doc_id, count(*) FILTER (ord % 3 <> 0 AND ord % 4 <> 0) AS n FROM slots GROUP BY 1)",
    "SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN -1 ELSE least(n, 15) END AS lessons, CASE WHEN doc_id % 5 = 4 THEN 'unparseable' END AS error "
    "FROM k",
)
def cleaned_replies(spark: SparkSession, d: str) -> DataFrame:
    row = F.struct(
        F.when(F.col("ord") % 3 != 0, pick(DAYS, F.col("day_idx"))).alias("day"),
        (F.col("period") + F.when(F.col("ord") % 4 == 0, 0.5).otherwise(0.0)).alias("period")
    )
    body = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("rows").alias("lessons"))), F.lit("\n```"))
    replies = _listed(spark, d, row).select("doc_id", F.when(F.col("doc_id") % 5 == 4, "I could not read it").otherwise(body).alias("text"))
    found = F.size(F.from_json(F.get_json_object("json", "$.lessons"), "array<struct<day string>>"))
    return responses.cleaned(replies, most=15).select("doc_id", F.when(F.col("json").isNotNull(), found).otherwise(-1).alias("lessons"), "error")


@query(
    "k AS (SELECT DISTINCT ord // 40 AS doc_id FROM slots)",
    """SELECT doc_id, CASE WHEN h = 0 THEN 'smart' ELSE 'local' END AS reader, CASE WHEN h = 0 OR doc_id % 2 = 0 THEN 'ok' ELSE 'failed' END AS status, CASE h WHEN 1 THEN 'too-few' WHEN 2 THEN 'quota' WHEN 3 THEN 'unavailable' END AS skipped
  FROM (SELECT doc_id, doc_id % 4 AS h FROM k)""",
)
def routed_readers(spark: SparkSession, d: str) -> DataFrame:
    docs = slots(spark, d).select(F.floor(F.col("ord") / REPLY_ROWS).alias("doc_id")).distinct()
    h = F.col("doc_id") % 4
    hosted = docs.where(h != 3).select("doc_id", pick(["ok", "failed", None], h).alias("status"), F.when(h == 2, "quota").alias("reason"))
    return responses.routed(docs, hosted, docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "ok").otherwise("failed").alias("status")))


@query(
    "f AS (SELECT doc_id % 97 AS upload, 'd' || doc_id || ['.png', '.JPG', '.txt', '.webp'][doc_id % 4 + 1] AS path, doc_id % 4 AS k, n_chars * "
    "4096 AS length FROM documents)",
    "r AS (SELECT upload, path, CASE WHEN k = 2 THEN 'not-an-image' WHEN length > 20971520 THEN 'too-large' END AS refused FROM f)",
    "SELECT upload, path, coalesce(refused, CASE WHEN row_number() OVER (PARTITION BY upload, refused ORDER BY path) > 3 THEN 'too-many' END) AS "
    "refused FROM r",
)
def admitted_images(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    path = F.concat(F.lit("d"), i.cast("string"), pick([".png", ".JPG", ".txt", ".webp"], i % 4))
    files = table(spark, d, "documents").select((i % 97).alias("upload"), path.alias("path"), (F.col("n_chars") * 4096).alias("length"))
    return responses.admission(files, most=3).select("upload", "path", "refused")


# --- lessons


def _validated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = slots(spark, d).select(
        "sched", (F.col("period") + F.when(F.col("ord") % 6 == 0, 1).otherwise(0)).alias("period"), arabic(F.col("class_raw")).alias("class_name"),
        "conf", "ord"
    )
    axes = slots(spark, d).where("day_idx < 5").groupBy("sched").agg(
        F.count_distinct("day_idx").alias("days"), F.count_distinct("period").alias("periods")
    )
    return lessons.validated(rows, axes, "sched")


READ_SQL = "read AS (SELECT sched, ord, conf, class_name, period + CASE WHEN ord % 6 = 0 THEN 1 ELSE 0 END AS period, class_raw FROM slots)"


@query(
    READ_SQL,
    "best AS (SELECT sched, class_name, class_raw AS label FROM read WHERE period <= 12 QUALIFY row_number() OVER (PARTITION BY sched, class_name "
    "ORDER BY conf DESC, ord) = 1)",
    "named AS (SELECT r.sched, ord, label, replace(label, '\\', '/') AS plain FROM read r JOIN best b ON b.sched = r.sched AND b.class_name = "
    "r.class_name WHERE r.period <= 12)",
    "pairs AS (SELECT sched, count(*) >= 3 AND count(DISTINCT split_part(plain, '/', 1)) >= 2 AND count(DISTINCT split_part(plain, '/', 2)) = 1 AS "
    "swap FROM named WHERE regexp_full_match(plain, '[0-9]/[0-9]') GROUP BY 1)",
    "SELECT sched, ord, " + ARABIC_SQL.format("CASE WHEN swap AND regexp_full_match(plain, '[0-9]/[0-9]') THEN split_part(plain, '/', 2) || '/' || "
    "split_part(plain, '/', 1) ELSE label END") + " AS class_name FROM named LEFT JOIN pairs USING (sched)",
)
def validated_lessons(spark: SparkSession, d: str) -> DataFrame:
    return _validated(spark, d)[0].select("sched", "ord", "class_name")


@query(
    READ_SQL,
    "axes AS (SELECT sched, count(DISTINCT day_idx) AS days, count(DISTINCT period) AS periods FROM slots WHERE day_idx < 5 GROUP BY 1)",
    "k AS (SELECT sched, count(*) FILTER (period <= 12) AS lessons, count(*) FILTER (period > 12) AS dropped, count(*) FILTER (period <= 12 AND "
    "conf >= 0.5) AS rec, count(*) FILTER (period <= 12 AND conf >= 0.35) AS cls FROM read GROUP BY 1)",
    "q AS (SELECT *, 0.35::DOUBLE * least(1.0::DOUBLE, days / 5) + 0.25::DOUBLE * least(1.0::DOUBLE, periods / 5) + 0.4::DOUBLE * ((0.5::DOUBLE * "
    "rec + 0.5::DOUBLE * cls) / lessons) AS worth FROM axes JOIN k USING (sched))",
    "SELECT sched, lessons, dropped, round(worth, 6) AS quality, days >= 3 AND periods >= 3 AND lessons >= 3 AND worth >= 0.45 AS ok FROM q",
)
def validated_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _validated(spark, d)[1]


def _merged(spark: SparkSession, d: str) -> DataFrame:
    seen = lessons.valid_slots(slots(spark, d)).withColumn("image", F.col("ord") % 3 + 1).withColumn(
        "subject", pick(["", "s", "s", "", "t"], F.col("ord") % 5)
    )
    return lessons.merge_readings(seen, "sched", "class_name", "conf", "image", subject="subject")


MERGED_SQL = (
    "seen AS (SELECT sched, day_idx, period, class_name, conf, ['', 's', 's', '', 't'][ord % 5 + 1] AS subject, row_number() OVER (PARTITION BY "
    "sched, day_idx, period ORDER BY ord % 3, ord) AS i FROM slots WHERE day_idx < 5)",
    """fold AS (SELECT sched, day_idx, period, i, class_name AS name, subject, conf, conf < 0.5 AS review, 0 AS others FROM seen WHERE i = 1
  UNION ALL SELECT f.sched, f.day_idx, f.period, s.i, f.name, CASE WHEN same AND f.subject = '' THEN s.subject ELSE f.subject END, CASE WHEN same THEN greatest(f.conf, s.conf) ELSE f.conf END,
    CASE WHEN NOT same THEN true WHEN s.conf > f.conf THEN s.conf < 0.5 ELSE f.review END, f.others + CASE WHEN same THEN 0 ELSE 1 END
  FROM fold f JOIN seen s ON s.sched = f.sched AND s.day_idx = f.day_idx AND s.period = f.period AND s.i = f.i + 1, LATERAL (SELECT s.class_name = f.name AND (s.subject = '' OR f.subject = '' OR s.subject = f.subject) AS same))""",
    "merged AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY sched, day_idx, period ORDER BY i DESC) = 1)",
)


@query(
    *MERGED_SQL,
    "SELECT sched, day_idx, period, name, subject, round(conf, 6) AS conf, review, others > 0 AS conflict, CASE WHEN others > 0 THEN others + 1 "
    "ELSE 0 END AS alternatives FROM merged"
)
def merged_subjects(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).withColumn("conf", F.round("conf", 6))


@query(
    *MERGED_SQL,
    "image AS (SELECT sched, i, (sched + i) % 4 <> 0 AS ok FROM (SELECT DISTINCT sched FROM slots), range(1, 4) AS r(i))",
    "told AS (SELECT sched, coalesce(string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (NOT ok), '') AS failed_images, CASE WHEN count(*) FILTER (ok "
    "AND i = 2) > 0 THEN 'dim,far' ELSE 'far' END AS warnings FROM image GROUP BY 1)",
    "k AS (SELECT sched, count(*) AS lessons, count(DISTINCT day_idx) AS days, count(DISTINCT period) AS periods, count(*) FILTER (review) AS "
    "uncertain, count(*) FILTER (others > 0) AS conflicts FROM merged GROUP BY 1)",
    "SELECT * FROM told JOIN k USING (sched)",
)
def merge_summary(spark: SparkSession, d: str) -> DataFrame:
    every = slots(spark, d).select("sched").distinct().withColumn("image", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    told = F.when(F.col("image") == 2, F.array(F.lit("far"), F.lit("dim"))).otherwise(F.array(F.lit("far")))
    images = every.select("sched", "image", ((F.col("sched") + F.col("image")) % 4 != 0).alias("ok"), told.alias("warnings"))
    facts = lessons.merge_facts(_merged(spark, d), images, "sched")
    return facts.withColumn("failed_images", F.concat_ws(",", F.col("failed_images").cast("array<string>"))).withColumn(
        "warnings", F.concat_ws(",", "warnings")
    )


SIDES_SQL = "side AS (SELECT sched, day_idx, period, ord % 2 AS s, arg_min(class_name, ord) AS name FROM slots WHERE day_idx < 5 GROUP BY ALL)"


@query(
    SIDES_SQL,
    "SELECT coalesce(a.sched, b.sched) AS sched, coalesce(a.day_idx, b.day_idx) AS day_idx, coalesce(a.period, b.period) AS period, a.name AS "
    "want, b.name AS got FROM (FROM side WHERE s = 0) a FULL JOIN (FROM side WHERE s = 1) b ON a.sched = b.sched AND a.day_idx = b.day_idx AND "
    "a.period = b.period WHERE a.name IS DISTINCT FROM b.name"
)
def lesson_mistakes(spark: SparkSession, d: str) -> DataFrame:
    s = lessons.valid_slots(slots(spark, d))
    sides = [lessons.first_wins(s.where(f"ord % 2 = {i}"), ["sched", "day_idx", "period"], "class_name") for i in (0, 1)]
    return lessons.mistakes(*sides, "sched", "class_name")


@query(
    "seen AS (SELECT sched, class_name, min(ord) AS ord FROM slots GROUP BY ALL)",
    f"usual AS (SELECT sched, class_name, {sql_list(COLORS)}[(row_number() OVER (PARTITION BY sched ORDER BY ord) - 1) % 3 + 1] AS color FROM seen "
    f"WHERE class_name NOT LIKE '3%')",
    "SELECT sched, class_name, CASE WHEN sched % 3 = 0 AND class_name LIKE '2%' THEN '#222222' ELSE coalesce(color, '#e6e8de') END AS color FROM "
    "seen LEFT JOIN usual USING (sched, class_name)",
)
def class_colors(spark: SparkSession, d: str) -> DataFrame:
    s = slots(spark, d)
    usual = lessons.classes_in_order(s.where("class_name not like '3%'"), "sched", "class_name", "class_name", COLORS)
    rows = s.select("sched", "class_name").distinct()
    own = rows.where("sched % 3 = 0 and class_name like '2%'").withColumn("color", F.lit("#222222"))
    return lessons.colored(rows, "sched", "class_name", usual.select("sched", "class_name", "color"), own)


@query(
    "k AS (SELECT sched, day_idx, min(minute) AS a, max(least(minute + 50, 1440)) AS b FROM slots WHERE sched % 4 <> 0 GROUP BY ALL)",
    "SELECT sched, day_idx, coalesce(a // 60, 8)::INT AS start_hour, (CASE WHEN a IS NULL THEN 12 ELSE least(24, greatest(ceil(b / 60), a // 60 + "
    "1)) END)::INT AS end_hour FROM (SELECT DISTINCT sched, day_idx FROM slots) LEFT JOIN k USING (sched, day_idx)",
)
def default_hours(spark: SparkSession, d: str) -> DataFrame:
    rows = slots(spark, d).select("sched", "day_idx", F.col("minute").alias("start"), F.least(F.col("minute") + 50, F.lit(1440)).alias("end"))
    return lessons.hours(rows.where("sched % 4 <> 0"), rows, ["sched", "day_idx"])


@query(
    "SELECT sched, d AS day_idx FROM (SELECT DISTINCT sched FROM slots), range(5) AS r(d) UNION ALL SELECT DISTINCT sched, day_idx FROM slots "
    "WHERE day_idx >= 5 AND minute % 97 = sched"
)
def weekend_days(spark: SparkSession, d: str) -> DataFrame:
    s = slots(spark, d)
    return lessons.active_days(s.where("minute % 97 = sched"), s, "sched")


@query(
    "SELECT DISTINCT sched, period, day_idx, round(1200 - 40 - 120 - (1200 - 80 - 120) / 5 * (day_idx + 1), 6) AS x, round(300 + 250.0 * (period - "
    "1), 6) AS y, 200.0::DOUBLE AS w, 250.0::DOUBLE AS h FROM slots WHERE day_idx < 5"
)
def week_boxes(spark: SparkSession, d: str) -> DataFrame:
    grid = lessons.valid_slots(slots(spark, d)).select("sched", "period", "day_idx").distinct()
    laid = lessons.boxes(grid, 1200.0, 40.0, 120.0, 300.0, 250.0)
    return laid.select("sched", "period", "day_idx", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "w", "h")


def _designs(spark: SparkSession, d: str) -> DataFrame:
    """A design for each schedule: first classes of its slots; a slot of many readings is a conflict."""
    first = lessons.valid_slots(slots(spark, d)).groupBy("sched", "period", "day_idx").agg(
        F.min_by("class_name", "ord").alias("classroom"), F.count("*").alias("n"), F.min("ord").alias("ord")
    )
    filled = F.col("ord") % 3 != 0
    return first.select(
        "sched", "period", "day_idx", F.lit("").alias("subject"), F.when(filled, F.col("classroom")).otherwise("").alias("classroom"), filled.alias("occupied"), (
            F.col("n") % 2 == 1
        ).alias("review"),
        ((F.col("n") % 7 == 6) & (F.col("sched") % 2 == 0)).alias("conflict"),
    )


DESIGN_SQL = "design AS (SELECT sched, period, day_idx, '' AS subject, CASE WHEN min(ord) % 3 <> 0 THEN arg_min(class_name, ord) ELSE '' END AS classroom, min(ord) % 3 <> 0 AS occupied, count(*) % 2 = 1 AS review, count(*) % 7 = 6 AND sched % 2 = 0 AS conflict FROM slots WHERE day_idx < 5 GROUP BY sched, period, day_idx)"


@query(
    DESIGN_SQL,
    "SELECT sched, count(*) FILTER (occupied) AS lessons, count(*) FILTER (conflict) = 0 AS can_apply, count(*) FILTER (occupied) > 0 AND sched % "
    "3 <> 0 AS can_export FROM design GROUP BY sched"
)
def design_gates(spark: SparkSession, d: str) -> DataFrame:
    states = slots(spark, d).select("sched").distinct().withColumn("source", F.when(F.col("sched") % 3 == 0, "photo").otherwise("manual"))
    return lessons.grid_gates(_designs(spark, d), states, "sched")


@query(
    DESIGN_SQL,
    "edited AS (SELECT sched, period, day_idx, subject, CASE WHEN e THEN t ELSE classroom END AS classroom, CASE WHEN e THEN t <> '' ELSE occupied "
    "END AS occupied, review AND NOT e AS review, conflict AND NOT e AS conflict FROM (SELECT *, (period + day_idx) % 4 = 0 AS e, CASE WHEN sched "
    "% 2 = 0 THEN 'z' ELSE '' END AS t FROM design))",
    "frame AS (SELECT sched, day_idx, p AS period FROM (SELECT DISTINCT sched, day_idx FROM design), range(1, 10) AS r(p))",
    "SELECT sched, period, day_idx, coalesce(subject, '') AS subject, coalesce(classroom, '') AS classroom, coalesce(occupied, false) AS occupied, "
    "coalesce(review, false) AS review, coalesce(conflict, false) AS conflict FROM frame LEFT JOIN edited USING (sched, day_idx, period)",
)
def design_edits(spark: SparkSession, d: str) -> DataFrame:
    grid = _designs(spark, d)
    edits = grid.where("(period + day_idx) % 4 = 0").select(
        "sched", "period", "day_idx", F.lit(None).cast("string").alias("subject"),
        F.when(F.col("sched") % 2 == 0, "z").otherwise("").alias("classroom")
    )
    return lessons.resized(lessons.patched(grid, edits, "sched"), "sched", 9)


def _lectures(spark: SparkSession, d: str) -> DataFrame:
    return slots(spark, d).select(
        F.col("ord").cast("string").alias("id"), pick(DAYS, F.col("day_idx")).alias("day"), F.col("minute").alias("start"),
        (F.col("minute") + 50).alias("end"), F.col("class_name").alias("course"), F.lit(None).cast("string").alias("room"),
        (F.col("ord") % 2 == 0).alias("needs_review")
    )


@query(
    f"SELECT ord::VARCHAR AS id, {sql_list(DAYS)}[day_idx + 1] AS day, minute + CASE WHEN ord % 10 = 0 THEN 5 ELSE 0 END AS start, minute + CASE "
    f"WHEN ord % 10 = 0 THEN 65 ELSE 50 END AS \"end\", class_name || CASE WHEN ord % 10 = 0 THEN '*' ELSE '' END AS course, CASE WHEN ord % 10 = "
    f"0 THEN 'r' END AS room, ord % 10 <> 0 AND ord % 2 = 0 AS needs_review FROM slots WHERE ord % 15 <> 1",
)
def lecture_edits(spark: SparkSession, d: str) -> DataFrame:
    old = _lectures(spark, d)
    new = old.where("id % 10 = 0").select(
        "id", "day", (F.col("start") + 5).alias("start"), (F.col("end") + 15).alias("end"), F.concat("course", F.lit("*")).alias("course"),
        F.lit("r").alias("room"), "needs_review"
    )
    return lectures.in_order(lectures.edited(old, new, old.where("id % 15 = 1"))).na.fill({"needs_review": False})


@query(
    "SELECT ord, CASE WHEN ord % 7 = 0 THEN 'no-course' WHEN ord % 5 = 0 THEN 'no-time' WHEN ord % 3 = 0 THEN 'end-before-start' END AS fault FROM "
    "slots"
)
def lecture_forms(spark: SparkSession, d: str) -> DataFrame:
    i, m = F.col("ord"), F.col("minute") % 1380
    start = F.when(i % 5 == 0, F.when(i % 2 == 0, "8h")).otherwise(text.input_time(m))
    end = F.when(i % 3 == 0, text.input_time(m)).otherwise(text.input_time(m + 50))
    return slots(spark, d).select("ord", lectures.fault(start, end, F.when(i % 7 == 0, "  ").otherwise(F.col("class_name"))).alias("fault"))


@query("SELECT sched, count(DISTINCT day_idx) >= 3 AND count(DISTINCT period) FILTER (conf >= 0.9) >= 3 AS good FROM slots GROUP BY 1")
def good_passes(spark: SparkSession, d: str) -> DataFrame:
    seen = slots(spark, d).groupBy("sched").agg(
        F.count_distinct("day_idx").alias("days"), F.count_distinct(F.when(F.col("conf") >= 0.9, F.col("period"))).alias("periods")
    )
    return seen.select("sched", lessons.pass_is_good(F.col("days"), F.col("periods")).alias("good"))


def _found(spark: SparkSession, d: str) -> DataFrame:
    reads, grids = _week_tables(spark, d)
    sure = F.when((F.col("row") > 0) & (F.col("col") < 7), 50.0 + (F.col("doc_id") * 7 + F.col("ord")) % 50).otherwise(F.col("ocr_confidence"))
    return schedule.lessons(cells.classify(reads.withColumn("ocr_confidence", sure)), grids)


# a class of a digit and a letter scores 1, of two digits 0.85; a day's name 1, a period's digit 0.95; labels are read with 0.9
@query(
    f"first AS (SELECT sched, day_idx, period, {ARABIC_SQL.format('arg_min(class_name, ord)')} AS class_name FROM slots WHERE day_idx < 5 AND "
    f"period <= 7 GROUP BY ALL)",
    f"SELECT sched AS doc_id, {sql_list(DAYS)}[day_idx + 1] AS day, period, round((0.55 * (CASE WHEN class_name LIKE '%/١' THEN 0.85 ELSE 1.0 END "
    f"* 0.85 + 0.1) + 0.45 * (50 + (sched * 7 + (day_idx + 1) * 100 + 7 - period) % 50) / 100) * (0.85 + 0.15 * (0.95 * 0.6 + 0.9 * 0.4)), 4) AS "
    f"confidence FROM first",
)
def lesson_confidence(spark: SparkSession, d: str) -> DataFrame:
    return schedule.in_order(_found(spark, d)).select("doc_id", "day", "period", F.round("confidence", 4).alias("confidence"))


@query(
    "f AS (SELECT DISTINCT sched, day_idx, period FROM slots WHERE day_idx < 5 AND period <= 7)",
    f"SELECT sched AS doc_id, array_to_string(list_transform(list_sort(list(DISTINCT day_idx)), lambda i: {sql_list(DAYS)}[i + 1]), ',') AS days, "
    f"array_to_string(list_sort(list(DISTINCT period)), ',') AS periods FROM f GROUP BY sched",
)
def labels_read(spark: SparkSession, d: str) -> DataFrame:
    told = schedule.labels_read(_found(spark, d))
    return told.select("doc_id", F.concat_ws(",", "days").alias("days"), F.concat_ws(",", F.col("periods").cast("array<string>")).alias("periods"))


@query(
    "k AS (SELECT sched, day_idx, count(*) AS n FROM slots GROUP BY ALL)", "t AS (SELECT sched, count(*) AS n, array_to_string(list(n ORDER BY "
    "day_idx), ',') AS grid FROM k GROUP BY 1)",
    "SELECT sched::VARCHAR AS owner, CASE WHEN sched % 2 = 0 THEN 1 ELSE 2 END AS saved_at, grid || CASE WHEN sched % 2 = 0 THEN '' ELSE ',new' "
    "END AS grid, CASE WHEN sched % 3 = 0 THEN 'mine' ELSE 'My week' END AS title FROM t WHERE sched % 5 <> 4 AND sched % 7 <> 6",
)
def stored_designs(spark: SparkSession, d: str) -> DataFrame:
    """Designs that are saved, saved again, cleared, or of another version, as loading finds them."""
    counts = slots(spark, d).groupBy("sched", "day_idx").agg(F.count("*").alias("n"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("day_idx", "n"))), lambda x: x["n"].cast("string"))
    grid = counts.groupBy("sched").agg(rows.alias("rows"))
    state = lambda body: F.to_json(
        F.struct(
            F.when(F.col("sched") % 7 == 6, 2).otherwise(1).alias("version"), F.array(body).alias("grid"),
            F.when(F.col("sched") % 3 == 0, "mine").alias("title")
        )
    )
    path = f"{shared_dir(spark)}/designs-{uuid.uuid4().hex}"
    designs.save(grid.select(F.col("sched").alias("owner"), F.lit(1).alias("saved_at"), state(F.col("rows")).alias("json")), path)
    designs.save(
        grid.where("sched % 2 = 1").select(
            F.col("sched").alias("owner"), F.lit(2).alias("saved_at"), state(F.concat("rows", F.array(F.lit("new")))).alias("json")
        ),
        path
    )
    designs.clear(grid.where("sched % 5 = 4").select(F.col("sched").alias("owner"), F.lit(3).alias("saved_at")), path)
    return designs.load(spark, path, {"title": "My week"}).select("owner", "saved_at", F.array_join(F.flatten("grid"), ",").alias("grid"), "title")


# --- rasters

_PX = (PIXELS_SQL, INK_SQL.format(n=HEIGHT * WIDTH, times=1))


@query(*_PX, "SELECT img, y AS pos, sum(v) AS v FROM ink GROUP BY 1, 2")
def raster_projection(spark: SparkSession, d: str) -> DataFrame:
    return raster.projection(ink(spark, d), "y")


@query(*_PX, "SELECT img, sum(v) AS ink, round(avg(v), 6) AS ratio FROM ink GROUP BY 1")
def raster_ink(spark: SparkSession, d: str) -> DataFrame:
    return raster.ink(ink(spark, d))


@query(*_PX, f"SELECT img, x AS y, {HEIGHT - 1} - y AS x, v FROM px")
def raster_rotate(spark: SparkSession, d: str) -> DataFrame:
    return raster.rotate(pixels(spark, d), 90)


@query(*_PX, "SELECT img, y - 1 AS y, x - 2 AS x, v FROM px WHERE y BETWEEN 1 AND 13 AND x BETWEEN 2 AND 26")
def raster_crop(spark: SparkSession, d: str) -> DataFrame:
    return raster.crop(pixels(spark, d), 1, 2, 13, 25)


@query(
    *_PX,
    "h AS (SELECT img, y, x, CASE WHEN x - lag(x) OVER (PARTITION BY img, y ORDER BY x) <= 2 THEN 0 ELSE 1 END AS cut FROM ink WHERE v = 1)",
    "r AS (SELECT *, sum(cut) OVER (PARTITION BY img, y ORDER BY x) AS run FROM h)", "l AS (SELECT img, y, run, max(x) - min(x) + 1 AS n FROM r "
    "GROUP BY 1, 2, 3)",
    "SELECT img, y, max(n) AS length FROM l GROUP BY 1, 2",
)
def raster_longest_run(spark: SparkSession, d: str) -> DataFrame:
    return raster.longest_run(ink(spark, d), "x", 1)


@query(*_PX, "SELECT img, y, x, xor(v, (x % 2)::INT) AS v FROM ink")
def raster_xor(spark: SparkSession, d: str) -> DataFrame:
    stripes = pixels(spark, d).withColumn("v", F.col("x") % 2)
    return raster.combined(ink(spark, d), stripes, lambda a, b: a.bitwiseXOR(b))
