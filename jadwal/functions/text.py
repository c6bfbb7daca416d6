"""Text normalisation and small recognisers as native columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The character classes and words of the timetable rules.
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
MARKS = r"[ؐ-ًؚ-ٰٟۖ-ۭـ]"
LETTER_FORMS = ("أإآٱىةؤئ", "اااايهوي")
SLASHES, DASHES = r"[\\⁄∕]", r"[–—−]"
NOISE_PUNCTUATION = r"[،,؛;·•|_'\"“”«»()\[\]{}<>?!؟*+=~^`]"
SPACE = r"[\t\x0B\f\r    -     　﻿]"
NOT_LETTER = r"[^ء-يa-zA-Z]"
NOISE_WORDS = ["محضره", "محضرة", "طباعه", "طباعة", "وتنزيل", "تنزيل", "عرض", "تفاصيل", "اعداد", "إعداد", "دخول", "حضور", "رابط", "تحضير"]
CLOCK = r"([0-9]{1,2})[ \t\n\f\r]*[:.][ \t\n\f\r]*([0-9]{2})[ \t\n\f\r]*(ص|م|am|pm)?"


@F.pandas_udf(T.StringType())
def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(c: Column) -> Column:
    """Compatibility normalisation; plain ASCII text does not leave the JVM's hands changed."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), _nfkc(c)).otherwise(c)


def digits_to_ascii(c: Column) -> Column:
    return F.translate(c, ARABIC_DIGITS + PERSIAN_DIGITS, "0123456789" * 2)


def to_arabic_digits(c: Column) -> Column:
    return F.translate(c.cast("string"), "0123456789", ARABIC_DIGITS)


def fold(c: Column) -> Column:
    """All of the normalisation but NFKC: one spelling for matching; lines are kept, empty lines go. Null is empty."""
    s = digits_to_ascii(F.coalesce(c, F.lit("")))
    s = F.translate(F.regexp_replace(s, MARKS, ""), *LETTER_FORMS)
    s = F.regexp_replace(F.regexp_replace(s, SLASHES, "/"), DASHES, "-")
    s = F.regexp_replace(F.regexp_replace(s, NOISE_PUNCTUATION, " "), SPACE + "+", " ")
    lines = F.filter(F.transform(F.split(s, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(lines, "\n")


def normalize_arabic(c: Column) -> Column:
    return fold(nfkc(c))


def letters_only(c: Column) -> Column:
    return F.regexp_replace(c, NOT_LETTER, "")


def has_content(c: Column) -> Column:
    return c.rlike(r"[ء-يa-zA-Z0-9]")


def tokens(c: Column) -> Column:
    """Runs between white space, slashes and dashes, without dots, colons and Arabic commas at their ends."""
    parts = F.transform(F.split(c, r"[ \t\n\f\r/-]+"), lambda t: F.regexp_replace(t, r"^[.:،؛]+|[.:،؛]+$", ""))
    return F.filter(parts, lambda t: t != "")


def class_key(folded: Column) -> Column:
    """One key for the spellings of a class name (already folded)."""
    return F.trim(F.regexp_replace(F.regexp_replace(folded, r"[ ]*[/\\-]+[ ]*", "/"), r"[ \n]+", " "))


def design_key(folded: Column) -> Column:
    """The designer's key, which takes bars and dashes for separators too."""
    return F.trim(F.regexp_replace(F.regexp_replace(folded, r"[ ]*[/|\\–-]+[ ]*", "/"), r"[ \n]+", " "))


def course_key(folded: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(folded, r"[ ]*[-/][ ]*", "-"), r"[ \n]+", " ")))


def first_time(c: Column) -> Column:
    """Minutes since midnight of the first clock time; an unmarked 1 to 5 o'clock is in the afternoon."""
    h, m, mark = (F.regexp_extract(c, CLOCK, i) for i in (1, 2, 3))
    hour, minute = h.cast("int"), m.cast("int")
    later = (mark.isin("م", "pm") & (hour < 12)) | ((mark == "") & hour.between(1, 5))
    return F.when((h != "") & (hour <= 23) & (minute <= 59), (hour + F.when(later, 12).otherwise(0)) * 60 + minute)


def parse_time(c: Column) -> Column:
    """Minutes of an ``H:MM`` text, else null."""
    h, m = (F.regexp_extract(F.trim(c), r"^([0-9]{1,2}):([0-9]{2})$", i) for i in (1, 2))
    return F.when((h != "") & (h.cast("int") <= 23) & (m.cast("int") <= 59), h.cast("int") * 60 + m.cast("int"))


def format_time(minutes: Column) -> Column:
    """Twelve-hour clock without a suffix."""
    return F.concat(_hour12(F.floor(minutes / 60)), F.lit(":"), F.lpad(F.pmod(minutes, F.lit(60)).cast("string"), 2, "0"))


def _hour12(hour: Column) -> Column:
    h = F.pmod(hour, F.lit(12))
    return F.when(h == 0, 12).otherwise(h).cast("int").cast("string")


def format_hour(hour: Column) -> Column:
    """Twelve-hour clock in Arabic digits."""
    return to_arabic_digits(_hour12(hour))


def input_time(minutes: Column) -> Column:
    """``HH:MM`` of 24 hours, as a form field has it."""
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    return F.concat(two(F.floor(minutes / 60)), F.lit(":"), two(F.pmod(minutes, F.lit(60))))


def contrast_ink(hex_color: Column) -> Column:
    """The dark or the light ink for a background, by its relative luminance in sRGB."""

    def linear(at: int) -> Column:
        x = F.conv(F.substring(F.translate(hex_color, "#", ""), at, 2), 16, 10).cast("int") / 255
        return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, 2.4))

    # The two inks.
    return F.when(0.2126 * linear(1) + 0.7152 * linear(3) + 0.0722 * linear(5) > 0.42, "#203c32").otherwise("#ffffff")


def strip_noise(c: Column, words: list[str] | None = None) -> Column:
    """Lines without clock ranges, brackets and noise words; lines of punctuation only become empty and go."""
    one = r"[0-9]{1,2}[ ]*[:.][ ]*[0-9]{2}(?:[ ]*(?:ص|م|am|pm))?"
    noise = F.array(*[F.lit(w) for w in (words or NOISE_WORDS)])

    def line(x: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(x, rf"{one}(?:[ ]*-[ ]*{one})?", " "), r"[()«»]", " ")
        kept = F.filter(F.split(plain, r"[ \t\f\r]+"), lambda t: (t != "") & ~F.array_contains(noise, t) & ~F.array_contains(noise, letters_only(t)))
        joined = F.array_join(kept, " ")
        return F.when(joined.rlike(r"^[ \-–—.·]*$"), "").otherwise(joined)

    return F.array_join(F.filter(F.transform(F.split(c, "\n"), line), lambda x: x != ""), "\n")


def confidence_level(c: Column) -> Column:
    return F.when(c >= 0.8, "high").when(c >= 0.5, "medium").otherwise("low")
