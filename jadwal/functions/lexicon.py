"""Reference dimensions of the timetable rules, in the order in which equal matches are decided."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Normalised spellings by category and key, common misreadings included.
DAYS = [
    ("sun", ["الاحد", "احد"]),
    ("mon", ["الاثنين", "اثنين", "الاتنين", "الائنين"]),
    ("tue", ["الثلاثاء", "ثلاثاء", "الثلاثا", "التلاتاء", "الثلائاء"]),
    ("wed", ["الاربعاء", "اربعاء", "الاربعا", "الاريعاء"]),
    ("thu", ["الخميس", "خميس", "الحميس"]),
    ("fri", ["الجمعه", "جمعه"]),
    ("sat", ["السبت", "سبت"]),
]
ORDINALS = [
    ("1", ["الاولي", "الاول", "اولي", "اول", "الأولى", "الاولى"]),
    ("2", ["الثانيه", "الثاني", "ثانيه", "ثاني", "الثانبه"]),
    ("3", ["الثالثه", "الثالث", "ثالثه", "ثالث", "الثالنه"]),
    ("4", ["الرابعه", "الرابع", "رابعه", "رابع", "الرايعه"]),
    ("5", ["الخامسه", "الخامس", "خامسه", "خامس", "الحامسه"]),
    ("6", ["السادسه", "السادس", "سادسه", "سادس", "السادسة"]),
    ("7", ["السابعه", "السابع", "سابعه", "سابع", "السايعه"]),
    ("8", ["الثامنه", "الثامن", "ثامنه", "ثامن", "الثامته"]),
    ("9", ["التاسعه", "التاسع", "تاسعه"]),
    ("10", ["العاشره", "العاشر", "عاشره"]),
]
GRADES = [
    ("أول", ["اول", "الاول", "الاولي", "اولي"]),
    ("ثاني", ["ثاني", "الثاني", "ثانيه", "الثانيه"]),
    ("ثالث", ["ثالث", "الثالث", "ثالثه", "الثالثه"]),
    ("رابع", ["رابع", "الرابع", "رابعه", "الرابعه"]),
    ("خامس", ["خامس", "الخامس", "خامسه", "الخامسه"]),
    ("سادس", ["سادس", "السادس", "سادسه", "السادسه"]),
]
STAGES = [("ابتدائي", ["ابتدائي", "ابتدايي", "ابتدائى"]), ("متوسط", ["متوسط", "متوسطه"]), ("ثانوي", ["ثانوي", "ثانويه"])]
HEADERS = [("header", ["اليوم", "الايام", "اليومالحصه", "الحصهاليوم", "يوم", "الوقت", "الزمن", "التوقيت", "الفسحه", "الصلاه", "الطابور"])]
STANDBY = [("standby", ["منتظر", "انتظار", "الانتظار", "احتياط", "مناوبه", "نتظر", "نتظ", "نتض", "متظر"])]
PERIOD_WORDS = ["الحصه", "حصه", "ح", "حصة", "الحصة"]
SECTIONS = {
    "ا": "أ", "ب": "ب", "ج": "ج", "د": "د", "ه": "هـ", "و": "و", "ز": "ز", "ح": "ح", "ط": "ط", "ي": "ي", "a": "أ", "b": "ب", "c": "ج", "d": "د",
    "e": "هـ", "f": "و"
}
SUBJECTS = [
    ("رياضيات", ["رياضيات", "الرياضيات", "رياضبات", "رياضيان"]),
    ("علوم", ["علوم", "العلوم"]),
    ("لغتي", ["لغتي", "لغتى", "لغتي الجميله", "لغتي الخالده"]),
    ("لغة عربية", ["لغه عربيه", "اللغه العربيه", "عربي", "عربيه", "كفايات لغويه", "الكفايات اللغويه"]),
    ("لغة إنجليزية", ["لغه انجليزيه", "انجليزي", "انجليزيه", "اللغه الانجليزيه", "english", "انقليزي", "انجليزى"]),
    ("قرآن كريم", ["قران كريم", "قران", "القران الكريم", "قرآن", "تلاوه", "حفظ", "القران"]),
    ("تربية إسلامية", ["تربيه اسلاميه", "اسلاميه", "دراسات اسلاميه", "الدراسات الاسلاميه", "اسلامية"]),
    ("توحيد", ["توحيد", "التوحيد"]),
    ("فقه", ["فقه", "الفقه", "فقه وسلوك"]),
    ("حديث", ["حديث", "الحديث"]),
    ("تفسير", ["تفسير", "التفسير"]),
    ("دراسات اجتماعية", ["دراسات اجتماعيه", "اجتماعيات", "اجتماعيه", "الاجتماعيات", "الدراسات الاجتماعيه"]),
    ("تاريخ", ["تاريخ", "التاريخ"]),
    ("جغرافيا", ["جغرافيا", "الجغرافيا"]),
    ("حاسب آلي", ["حاسب", "حاسب الي", "الحاسب", "حاسوب", "تقنيه رقميه", "التقنيه الرقميه", "مهارات رقميه", "المهارات الرقميه"]),
    ("تربية فنية", ["تربيه فنيه", "فنيه", "الفنيه", "فنون", "التربيه الفنيه"]),
    ("تربية بدنية", ["تربيه بدنيه", "بدنيه", "البدنيه", "رياضه", "التربيه البدنيه", "بدنية"]),
    ("مهارات حياتية", ["مهارات حياتيه", "حياتيه", "المهارات الحياتيه", "مهارات حياتيه واسريه"]),
    ("تفكير ناقد", ["تفكير ناقد", "التفكير الناقد"]),
    ("أحياء", ["احياء", "الاحياء"]),
    ("كيمياء", ["كيمياء", "الكيمياء"]),
    ("فيزياء", ["فيزياء", "الفيزياء"]),
    ("علم البيئة", ["علم البيئه", "بيئه"]),
    ("انتظار", ["انتظار", "الانتظار"]),
    ("نشاط", ["نشاط", "النشاط"]),
    ("ريادة الأعمال", ["رياده الاعمال", "رياده"]),
    ("دفاع عن النفس", ["دفاع عن النفس", "دفاع"]),
    ("التربية الصحية", ["تربيه صحيه", "صحيه", "التربيه الصحيه"]),
    ("التربية الأسرية", ["تربيه اسريه", "اسريه", "التربيه الاسريه"]),
    ("مهارات إدارية", ["مهارات اداريه", "اداريه"]),
    ("علوم إدارية", ["علوم اداريه"]),
    ("حديث وسيرة", ["حديث وسيره"]),
    ("مناوبة", ["مناوبه", "المناوبه"]),
]
CATEGORIES = {"day": DAYS, "ordinal": ORDINALS, "grade": GRADES, "stage": STAGES, "header": HEADERS, "standby": STANDBY, "subject": SUBJECTS}


def lexicon(spark: SparkSession) -> DataFrame:
    """category, key, variant, ord."""
    rows = [{"category": c, "key": k, "variant": v} for c, entries in CATEGORIES.items() for k, vs in entries for v in vs]
    return spark.range(1).select(
        F.posexplode(F.from_json(F.lit(json.dumps(rows)), "array<struct<category:string,key:string,variant:string>>")).alias("ord", "e")
    ).select("e.*", "ord")
