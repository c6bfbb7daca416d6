"""Stored JSON of the two hosted readers, as tables of lessons and lectures.

Both readers give one JSON document per image. Schemas are declared, never inferred; a response that is not ``ok`` or
has no list gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jadwal.functions import text
from jadwal.operators import cells
from jadwal.shipping import ship
from jadwal.storage import written

TEACHER = "ok boolean, error string, periodsCount double, notes string, lessons array<struct<day string, period double, className string, subject string>>"
UNIVERSITY = "ok boolean, error string, notes string, lectures array<struct<day string, start string, end string, course string, room string, uncertain boolean>>"

# Day keys and their aliases.
SCHOOL_DAYS = ["sun", "mon", "tue", "wed", "thu"]
DAY_KEYS = [*SCHOOL_DAYS, "fri", "sat"]
DAY_ALIASES = {
    "sunday": "sun", "monday": "mon", "tuesday": "tue", "wednesday": "wed", "thursday": "thu", "friday": "fri", "saturday": "sat",
    "u": "sun", "m": "mon", "t": "tue", "w": "wed", "r": "thu", "f": "fri", "s": "sat",
    "ح": "sun", "ن": "mon", "ثن": "mon", "ث": "tue", "ر": "wed", "خ": "thu", "ج": "fri", "س": "sat",
    "الأحد": "sun", "الاحد": "sun", "الإثنين": "mon", "الاثنين": "mon", "الثلاثاء": "tue", "الأربعاء": "wed", "الاربعاء": "wed", "الخميس": "thu", "الجمعة": "fri", "السبت": "sat",
}


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def normalize_day(c: Column) -> Column:
    """A day key from a key, an alias, or an alias of its first three letters; else null."""
    raw = F.lower(F.trim(c))
    return F.coalesce(F.when(raw.isin(DAY_KEYS), raw), _lookup(DAY_ALIASES, raw), _lookup(DAY_ALIASES, F.substring(raw, 1, 3)))


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), text.SPACE[:-1] + "\\n]+", " "))


def _read_rows(responses: DataFrame, doc: str, body: str) -> DataFrame:
    """doc_id, day, period, name, subject (both as read and trimmed) of valid slots, the first row of a slot."""
    rows = responses.select(F.col(doc).alias("doc_id"), F.from_json(body, TEACHER).alias("r")).where("r.ok").select(
        "doc_id", F.posexplode("r.lessons").alias("ord", "l")
    )
    valid = rows.where(F.col("l.day").isin(SCHOOL_DAYS) & (F.col("l.period") == F.floor("l.period")) & F.col("l.period").between(1, 12))
    first = valid.groupBy("doc_id", F.col("l.day").alias("day"), F.col("l.period").cast("int").alias("period")).agg(F.min_by("l", "ord").alias("l"))
    return first.select(
        "doc_id", "day", "period", F.trim(F.coalesce("l.className", F.lit(""))).alias("name"),
        F.trim(F.coalesce("l.subject", F.lit(""))).alias("subject")
    )


def lessons(responses: DataFrame, doc: str = "doc_id", body: str = "json") -> DataFrame:
    """doc_id, day, day_idx, period, class_name, subject, raw_text, confidence: the teacher reader's lessons.

    School days and whole periods 1 to 12 only; the first row of a slot stays. Classes and subjects get their canonical names; a class
    that none fits stays as read, and so does a subject of at most two words and 16 characters. Distinct texts are recognised once.
    """
    first = _read_rows(responses, doc, body)
    known = cells.labels(first.select(F.explode(F.array("name", "subject")).alias("label")).where("label <> ''"), "label")
    known = written(known.select("label", F.col("name").alias("as_class"), F.col("subject").alias("as_subject")), "labels")
    named = first.join(known.select(F.col("label").alias("name"), "as_class"), "name", "left").join(
        known.select(F.col("label").alias("subject"), "as_subject"), "subject", "left"
    )
    short = (F.col("subject") != "") & (F.size(F.split("subject", r"\s+")) <= 2) & (F.length("subject") <= 16)
    raw = F.array_join(F.filter(F.array("name", "subject"), lambda x: x != ""), "\n")
    place = F.array_position(F.array(*[F.lit(d) for d in SCHOOL_DAYS]), F.col("day")).cast("int") - 1
    return named.select(
        "doc_id", "day", place.alias("day_idx"), "period", F.coalesce("as_class", "name").alias("class_name"), F.coalesce(
            "as_subject", F.when(short, F.col("subject"))
        ).alias("subject"),
        raw.alias("raw_text"), F.lit(0.9).alias("confidence"),
    )


def outcomes(responses: DataFrame, doc: str = "doc_id", body: str = "json") -> DataFrame:
    """doc_id, lessons, days, periods, quality, status of every response that is ok and has a list; others give null status."""
    found = _read_rows(responses, doc, body).groupBy("doc_id").agg(
        F.count("*").alias("lessons"), F.count_distinct("day").alias("days"), F.max("period").alias("top")
    )
    r = F.from_json(body, TEACHER)
    all_ = responses.select(
        F.col(doc).alias("doc_id"), r["periodsCount"].alias("told"), F.coalesce(r["ok"] & r["lessons"].isNotNull(), F.lit(False)).alias("usable")
    )
    joined = all_.join(found, "doc_id", "left").na.fill(0, ["lessons", "days", "top"])
    ok = (F.col("lessons") >= 3) & (F.col("days") >= 3)
    periods = F.least(F.lit(12), F.greatest("top", F.coalesce("told", F.lit(0)))).cast("int")
    when = lambda c: F.when(F.col("usable"), c)
    return joined.select(
        "doc_id", "lessons", "days", periods.alias("periods"), when(F.when(ok, 0.95).otherwise(0.3)).alias("quality"),
        when(F.when(ok, "ok").otherwise("failed")).alias("status")
    )


def cleaned(replies: DataFrame, doc: str = "doc_id", body: str = "text", most: int = 120) -> DataFrame:
    """doc_id, json, error: a model's reply as a stored response.

    A code fence round the JSON goes, rows without a day and a whole period (or, of lectures, a start) go, and the first ``most`` rows
    stay, in the order of the list. What is no JSON object has the error ``unparseable``.
    """
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(body, F.lit("")), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    lesson, lecture = TEACHER.split("lessons ")[1], UNIVERSITY.split("lectures ")[1]
    r = F.from_json(F.col("__plain"), f"periodsCount double, notes string, lessons {lesson}, lectures {lecture}")
    t = replies.select(F.col(doc).alias("doc_id"), plain.alias("__plain")).withColumn("r", r)
    fine = F.col("__plain").rlike(r"^\s*\{") & F.get_json_object("__plain", "$").isNotNull()
    good = F.slice(F.filter("r.lessons", lambda x: x["day"].isNotNull() & (x["period"] == F.floor(x["period"]))), 1, most)
    heard = F.slice(F.filter("r.lectures", lambda x: x["day"].isNotNull() & x["start"].isNotNull()), 1, most)
    out = F.to_json(
        F.struct(
            F.lit(True).alias("ok"), F.col("r.periodsCount").alias("periodsCount"), F.coalesce("r.notes", F.lit("")).alias("notes"),
            good.alias("lessons"), heard.alias("lectures")
        )
    )
    return t.select("doc_id", F.when(fine, out).alias("json"), F.when(~fine, "unparseable").alias("error"))


def acceptable_upload(image: Column, mime: Column) -> Column:
    """Whether a stored request has an image of 100 to 8,000,000 characters and a type that the reader takes."""
    return F.length(image).between(100, 8_000_000) & mime.isin("image/jpeg", "image/png", "image/webp", "image/heic")


def routed(images: DataFrame, hosted: DataFrame, local: DataFrame, configured: bool = True, enabled: bool = True) -> DataFrame:
    """doc_id, reader, status, skipped: the hosted outcome (doc_id, status, reason) where it is ok, else the local one (doc_id, status).

    ``skipped`` says why the hosted reader was not taken: disabled, too-few, or its reason; null where none is configured.
    """
    both = images.select("doc_id").join(hosted.select("doc_id", F.col("status").alias("h"), F.col("reason")), "doc_id", "left").join(
        local.select("doc_id", F.col("status").alias("l")), "doc_id", "left"
    )
    taken = F.lit(configured and enabled) & F.coalesce(F.col("h") == "ok", F.lit(False))
    why = F.when(F.col("h").isNotNull(), "too-few").otherwise(F.coalesce("reason", F.lit("unavailable"))) if enabled else F.lit("disabled")
    return both.select(
        "doc_id", F.when(taken, "smart").otherwise("local").alias("reader"), F.when(taken, F.col("h")).otherwise(F.col("l")).alias("status"),
        (F.when(~taken, why) if configured else F.lit(None).cast("string")).alias("skipped")
    )


def lectures(responses: DataFrame, doc: str = "doc_id", body: str = "json") -> DataFrame:
    """doc_id, id, day, start, end, course, room, needs_review: the university reader's lectures.

    A known day, a readable start and a course are needed. An end that is missing or not after the start becomes 50
    minutes after it, midnight at most. The first of equal (day, start, course) stays. Ids are hashes, not random.
    """
    rows = responses.select(F.col(doc).alias("doc_id"), F.from_json(body, UNIVERSITY).alias("r")).where("r.ok").select(
        "doc_id", F.posexplode("r.lectures").alias("ord", "l")
    )
    start, end = text.parse_time(F.col("l.start")), text.parse_time(F.col("l.end"))
    repaired = F.when(end > start, end).otherwise(F.least(start + 50, F.lit(1440)))
    room = _squeezed(F.col("l.room"))
    read = rows.select(
        "doc_id", "ord", normalize_day(F.col("l.day")).alias("day"), start.alias("start"), repaired.alias("end"),
        _squeezed(F.col("l.course")).alias("course"), F.when(room != "", room).alias("room"), F.when(F.col("l.uncertain"), True).alias("needs_review")
    )
    valid = read.where("day is not null and start is not null and course <> ''")
    first = valid.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "day", "start", "course").orderBy("ord"))).where("n = 1")
    return first.select(
        "doc_id",
        F.substring(F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), "day", F.col("start").cast("string"), "course"), 256), 1, 8).alias("id"),
        "day", "start", "end", "course", "room", "needs_review"
    )


def courses(rows: DataFrame, palette: list[str]) -> DataFrame:
    """doc_id, key, label, color: the distinct courses of a timetable in order of appearance (column ``ord``)."""
    ship(rows.sparkSession)
    keyed = rows.withColumn("key", text.course_key(text.normalize_arabic(F.col("course")))).where("key <> ''")
    seen = keyed.groupBy("doc_id", "key").agg(F.min_by(F.trim("course"), "ord").alias("label"), F.min("ord").alias("first_ord"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("first_ord")) - 1
    return seen.select("doc_id", "key", "label", F.get(F.array(*[F.lit(c) for c in palette]), F.pmod(place, F.lit(len(palette)))).alias("color"))


def admission(images: DataFrame, most: int = 8, limit: int = 20 << 20) -> DataFrame:
    """``binaryFile`` rows (upload, path, length) with ``refused``: not-an-image, too-large, too-many, or null for those that are
    admitted, which are the first ``most`` images of each upload by path."""
    fault = F.when(~F.lower("path").rlike(r"\.(png|jpe?g|webp|gif|bmp|heic)$"), "not-an-image").when(F.col("length") > limit, "too-large")
    n = F.row_number().over(Window.partitionBy("upload", "refused").orderBy("path"))
    return images.withColumn("refused", fault).withColumn("n", n).withColumn(
        "refused", F.coalesce("refused", F.when(F.col("n") > most, "too-many"))
    ).drop("n")


def admitted(images: DataFrame, most: int = 8, limit: int = 20 << 20) -> DataFrame:
    """The rows of ``images`` that ``admission`` refuses nothing of."""
    return admission(images, most, limit).where("refused is null").drop("refused")


def saved_designs(states: DataFrame, defaults: dict[str, object], body: str = "json") -> DataFrame:
    """Saved designs of version 1 that have a grid, with defaults where a field is missing."""
    fields = ", ".join(f"{k} {'double' if isinstance(v, int | float) else 'string'}" for k, v in defaults.items())
    parsed = states.withColumn("s", F.from_json(body, f"version int, grid array<array<string>>, {fields}")).where(
        "s.version = 1 and s.grid is not null"
    )
    return parsed.select(
        *[c for c in states.columns if c != body], "s.grid", *[F.coalesce(F.col("s")[k], F.lit(v)).alias(k) for k, v in defaults.items()]
    )
