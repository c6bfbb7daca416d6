"""Which of two readings of a cell to keep: the general one, or that of the reader for short labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jadwal.operators import cells
from jadwal.storage import written


def chosen(readings: DataFrame) -> DataFrame:
    """``readings`` (ocr_text, ocr_confidence of 0 to 100, short_text, short_confidence of 0 to 1, or null) with text and confidence.

    The short label counts if it is a class or a period and sure enough. The general reading wins against it when it is a meaningful
    word, or a word of some length and sure enough; else the product of parse score and confidence decides.
    """
    texts = readings.select(F.explode(F.array("ocr_text", "short_text")).alias("label"))
    known = written(cells.labels(texts, "label"), "readings")
    score = F.coalesce("class_score", "period_score", F.lit(0.0))
    word = F.coalesce("day_score", "subject_score", F.when(F.col("letters") >= 3, F.col("period_score")), F.lit(0.0))
    general = known.select(
        F.col("label").alias("ocr_text"), score.alias("__ocr_parse"), word.alias("__word"), F.col("letters").alias("__letters"),
        F.col("numbered").alias("__numbered")
    )
    both = readings.join(general, "ocr_text", "left").join(
        known.select(F.col("label").alias("short_text"), score.alias("__short_parse")), "short_text", "left"
    )
    sure, short, letters, parse = F.col("ocr_confidence"), F.col("short_confidence"), F.coalesce("__letters", F.lit(0)), F.coalesce(
        "__ocr_parse", F.lit(0.0)
    )
    own = F.coalesce("__short_parse", F.lit(0.0))
    keeps = (
        (own == 0) | F.coalesce(short < 0.35, F.lit(True)) | ((F.coalesce("__word", F.lit(0.0)) >= 0.7) & (sure >= 55)) | (
            (letters >= 4) & (sure >= 45) & (short < 0.85)
        )
        | ((letters >= 4) & (sure >= 80) & ~F.coalesce("__numbered", F.lit(False))) | ~((parse == 0) | (own * short >= parse * (sure / 100)))
    )
    text, confidence = F.when(keeps, F.col("ocr_text")).otherwise(F.col("short_text")), F.when(keeps, sure).otherwise(
        F.floor(short * 100 + 0.5).cast("double")
    )
    return both.withColumn("text", text).withColumn("confidence", confidence).select(*readings.columns, "text", "confidence")
