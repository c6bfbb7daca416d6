"""Cells that hold several labels, cut into one cell a label.

Separators between header cells are often too faint to be found, so that one cell spans several lines of the grid. Cells have doc_id,
row, col, row_span, col_span, ord, text, ocr_confidence and words (text, x0, x1, confidence); grids have row_lines and col_lines. A new
cell's ``ord`` is its old one times 64 and its place, so that the order of cells stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jadwal.functions.lexicon import DAYS
from jadwal.operators import cells as recognise
from jadwal.operators.schedule import DAY_ORDER, LAST_SCHOOL_DAY, day_number
from jadwal.storage import written

STEP = 64


def _half_up(c: Column) -> Column:
    return F.floor(c + 0.5).cast("int")


def days_apart(cells: DataFrame) -> DataFrame:
    """``cells`` with each cell that spans lines and lists at least two days cut into one cell a day.

    Days that do not follow each other, or are fewer than the lines, are counted from the first one on, if the week has room for them.
    """
    span = F.greatest("row_span", "col_span")
    tall = cells.where((span >= 2) & F.contains("text", F.lit("\n")))
    lines = tall.select(
        "doc_id", "ord", span.alias("span"), F.posexplode(F.split("text", "\n")).alias("i", "line")
    ).withColumn("line", F.trim("line")).where("line <> ''")
    read = recognise.labels(lines, "line").where("day_score >= 0.7").select("line", day_number(F.col("day")).alias("n"))
    found = lines.join(read, "line").groupBy("doc_id", "ord", "span").agg(F.array_sort(F.collect_list(F.struct("i", "n", "line"))).alias("d"))
    found = found.where((F.size("d") >= 2) & (F.size(F.array_distinct(F.transform("d", lambda x: x["n"]))) >= 2) & (F.size("d") <= F.col("span")))
    first = F.get("d", F.lit(0))["n"]
    in_turn = F.forall(F.transform("d", lambda x, i: x["n"] == first + i), lambda ok: ok)
    again = ~(in_turn & (F.size("d") == F.col("span"))) & (first + F.col("span") - 1 <= LAST_SCHOOL_DAY)
    shown = F.array(*[F.lit(dict(DAYS)[d][0]) for d in DAY_ORDER])
    counted = F.transform(F.sequence(F.lit(0), F.col("span") - 1), lambda i: F.get(shown, first + i))
    parts = written(
        found.select("doc_id", "ord", F.when(again, counted).otherwise(F.transform("d", lambda x: x["line"])).alias("names")), "day-cells"
    )
    many = cells.join(parts, ["doc_id", "ord"]).withColumn("__n", F.size("names")).select(
        *cells.columns, "__n", F.posexplode("names").alias("__i", "__name")
    )
    at = lambda i: _half_up(F.greatest("row_span", "col_span") / F.col("__n") * i)
    upright, begin, size = F.col("row_span") >= F.col("col_span"), at(F.col("__i")), at(F.col("__i") + 1) - at(F.col("__i"))
    new = {
        "text": F.col("__name"), "ord": F.col("ord") * STEP + F.col("__i"), "row": F.col("row") + F.when(upright, begin).otherwise(0), "row_span": F.when(upright, size).otherwise(
            F.col("row_span")
        ),
        "col": F.col("col") + F.when(upright, 0).otherwise(begin), "col_span": F.when(upright, F.col("col_span")).otherwise(size),
    }
    cut = many.select(*[new.get(c, F.col(c)).cast(cells.schema[c].dataType).alias(c) for c in cells.columns])
    whole = cells.join(parts.select("doc_id", "ord"), ["doc_id", "ord"], "left_anti").withColumn(
        "ord", (F.col("ord") * STEP).cast(cells.schema["ord"].dataType)
    )
    return whole.select(*cells.columns).unionByName(cut)


def labels_apart(cells: DataFrame, grids: DataFrame) -> DataFrame:
    """``cells`` with each cell over several columns whose words are labels of at least two of them cut into its columns.

    A word belongs to the column that its middle lies in; words outside go. A label is a period, a day or a clock time.
    """
    wide = cells.where((F.col("col_span") >= 2) & (F.size("words") >= 2)).join(grids.select("doc_id", "col_lines"), "doc_id")
    word = wide.select(
        "doc_id", "ord", "col", "col_span", "col_lines", F.posexplode("words").alias("i", "w")
    ).withColumn("x", (F.col("w.x0") + F.col("w.x1")) / 2)
    columns = F.filter(
        F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1),
        lambda c: (F.col("x") >= F.get("col_lines", c)) & (F.col("x") < F.get("col_lines", c + 1))
    )
    placed = word.withColumn("at", F.get(columns, F.lit(0))).where("at is not null")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("i", F.col("w.text").alias("t")))), lambda x: x["t"])
    groups = written(
        placed.groupBy("doc_id", "ord", "at").agg(F.array_join(texts, " ").alias("__text"), F.avg("w.confidence").alias("__sure")), "word-columns"
    )
    label = recognise.labels(groups, "__text").where("period is not null or day is not null or timed").select("__text")
    split = written(
        groups.join(label, "__text").groupBy("doc_id", "ord").agg(F.count("*").alias("n")).where("n >= 2").select("doc_id", "ord"), "label-cells"
    )
    many = cells.join(split, ["doc_id", "ord"]).withColumn(
        "at", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1))
    ).join(groups, ["doc_id", "ord", "at"], "left")
    new = {
        "text": F.coalesce("__text", F.lit("")), "ocr_confidence": F.coalesce(
            "__sure", F.lit(0.0)
        ), "ord": F.col("ord") * STEP + F.col("at") - F.col("col"), "col": F.col("at"), "col_span": F.lit(1), "words": F.lit(None),
    }
    cut = many.select(*[new.get(c, F.col(c)).cast(cells.schema[c].dataType).alias(c) for c in cells.columns])
    whole = cells.join(split, ["doc_id", "ord"], "left_anti").withColumn("ord", (F.col("ord") * STEP).cast(cells.schema["ord"].dataType))
    return whole.select(*cells.columns).unionByName(cut)
