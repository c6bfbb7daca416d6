"""Short labels from ink: grouping of components, cuts of touching glyphs, sampling, matching with templates, and decoding.

Groups are boxes (x0, y0, x1, y1, area) of an image. A label has few components and its boxes are narrow, so the lists of one image's
components, columns and readings are bounded by the label and not by the data.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jadwal.functions.columns import let
from jadwal.operators import grid, raster
from jadwal.operators.skew import half_up
from jadwal.storage import written

BOX = ["x0", "y0", "x1", "y1", "area"]
MOST_TEMPLATES = 10_000
# Symbols of a special height.
SPECIAL = {"٠": ("most", 0.45, 0.55), "/": ("least", 0.55, 0.7), "-": ("most", 0.35, 0.5)}
PIECE = "struct<symbol:string,score:double,w:int,h:int>"
ONES = ["١", "1", "ا", "|"]
PLAUSIBLE = r"^([0-9]{1,2}|[0-9]\s?[/-]\s?[ء-يa-zA-Z0-9]|[ء-يa-zA-Z][/-][0-9]|[0-9][ء-ي])$"


def group_components(parts: DataFrame, keys: list[str], share: float = 0.45) -> DataFrame:
    """``keys``, groups: components (``keys``, x0, y0, x1, y1, area) whose widths overlap by ``share`` of the narrower one, merged until nothing changes.

    Left to right, a component joins the group before it, which grows and so may take the next; when a pass has merged anything, another one follows. Each
    pass is one job over the keys that the last pass changed, and every pass that changes a key leaves it fewer groups. Equal left ends go by the other numbers.
    """
    part = F.struct(*BOX)
    listed = parts.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("x0", "x1", "y0", "y1", "area", F.array(part).alias("parts")))).alias("groups")
    )

    def joined(done: Column, g: Column) -> Column:
        def with_last(last: Column) -> Column:
            overlap = F.least(last["x1"], g["x1"]) - F.greatest(last["x0"], g["x0"]) + 1
            narrow = F.least(last["x1"] - last["x0"], g["x1"] - g["x0"]) + 1
            ends = [
                F.least(last["x0"], g["x0"]).alias("x0"), F.greatest(last["x1"], g["x1"]).alias("x1"), F.least(last["y0"], g["y0"]).alias("y0"),
                F.greatest(last["y1"], g["y1"]).alias("y1")
            ]
            one = F.struct(*ends, (last["area"] + g["area"]).alias("area"), F.concat(last["parts"], g["parts"]).alias("parts"))
            merges = (overlap > 0) & (overlap / narrow >= share)
            return F.when(merges, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(one))).otherwise(F.concat(done, F.array(g)))

        return let(F.element_at(done, -1), with_last)

    settled, open_ = [], listed
    while True:
        passed = F.aggregate(F.slice("groups", 2, F.size("groups")), F.slice("groups", 1, 1), joined)
        after = written(open_.select(*keys, passed.alias("groups"), F.size("groups").alias("before")), "groups")
        settled.append(after.where(F.size("groups") == F.col("before")).drop("before"))
        open_ = after.where(F.size("groups") < F.col("before")).drop("before")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, settled)


def columns_of(mask: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """``boxes`` (img, ``keys``, x0, y0, x1, y1) with cols: for each column of a box its place, ink, and the first and last inked row."""
    asked = boxes.select("img", *keys, "y0", "y1", F.explode(F.sequence("x0", "x1")).alias("x"))
    ink = mask.where("v = 1").select("img", "x", "y")
    met = asked.join(ink, ["img", "x"], "left").withColumn("y", F.when(F.col("y").between(F.col("y0"), F.col("y1")), F.col("y")))
    one = met.groupBy("img", *keys, "x").agg(F.count("y").alias("n"), F.min("y").alias("top"), F.max("y").alias("bottom"))
    return boxes.join(one.groupBy("img", *keys).agg(F.array_sort(F.collect_list(F.struct("x", "n", "top", "bottom"))).alias("cols")), ["img", *keys])


def tight(cols: Column, first: Column, last: Column, least: int = 3) -> Column:
    """The bounds of the ink between two columns; null where there are fewer than ``least`` pixels."""

    def bounds(own: Column) -> Column:
        area = F.aggregate(own, F.lit(0).cast("long"), lambda s, c: s + c["n"])
        of = lambda name: F.transform(own, lambda c: c[name])
        box = F.struct(
            F.array_min(of("x")).alias("x0"), F.array_min(of("top")).alias("y0"), F.array_max(of("x")).alias("x1"),
            F.array_max(of("bottom")).alias("y1"), area.alias("area")
        )
        return F.when(area >= least, box)

    return let(F.filter(cols, lambda c: (c["x"] >= first) & (c["x"] <= last) & (c["n"] > 0)), bounds)


def _width() -> Column:
    return F.col("x1") - F.col("x0") + 1


def _mean() -> Column:
    return F.aggregate("cols", F.lit(0).cast("long"), lambda s, c: s + c["n"]) / F.size("cols")


def _between(step: int) -> Column:
    """Places within the box where it may be cut."""
    return F.sequence(F.floor(_width() * 0.12).cast("int"), F.ceil(_width() * 0.88).cast("int"), F.lit(step))


def _pieces(cuts: Column) -> Column:
    """The tight pieces between ``cuts`` (places within the box), right piece first; null where one has too little ink."""
    ends = F.concat(F.array(F.col("x0") - 1), F.transform(F.array_sort(cuts), lambda c: F.col("x0") + c), F.array(F.col("x1") + 1))
    spans = let(ends, lambda e: F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda k: tight(F.col("cols"), e[k] + 1, e[k + 1] - 1)))
    return let(spans, lambda p: F.when(~F.exists(p, lambda x: x.isNull()), F.reverse(F.array_sort(p))))


def valley_splits(boxes: DataFrame) -> DataFrame:
    """``boxes`` (with cols) with cuts and splits: the thinnest columns, and the splits at the first one, two and three of them.

    A cut's column holds at most 0.45 of the mean ink and no more than its neighbours; thinner ones come first, and a cut keeps 0.15 of the width away from
    those before it. Boxes narrower than 8, or than 0.8 of their height, have no splits; a split with a piece of fewer than three pixels goes.
    """
    n = lambda i: F.get("cols", i)["n"]
    low = F.filter(_between(1), lambda i: (i > 0) & (n(i) <= F.col("__mean") * 0.45) & (n(i) <= n(i - 1)) & (n(i) <= n(i + 1)))
    ordered = F.transform(F.array_sort(F.transform(low, lambda i: F.struct(n(i).alias("n"), i.alias("i")))), lambda c: c["i"])
    apart = F.greatest(F.lit(4), half_up(_width() * 0.15))
    keep = lambda chosen, c: F.when(
        (F.size(chosen) < 3) & F.forall(chosen, lambda k: F.abs(k - c) >= F.col("__apart")), F.concat(chosen, F.array(c))
    ).otherwise(chosen)
    wide = (_width() >= 8) & (_width() / (F.col("y1") - F.col("y0") + 1) >= 0.8)
    none = F.array().cast("array<int>")
    cut = boxes.withColumn("__mean", _mean()).withColumn("__apart", apart).withColumn(
        "cuts", F.when(wide, F.aggregate(ordered, none, keep)).otherwise(none)
    ).drop("__mean", "__apart")
    some = F.transform(F.when(F.size("cuts") > 0, F.sequence(F.lit(1), F.size("cuts"))).otherwise(none), lambda k: _pieces(F.slice("cuts", 1, k)))
    return cut.withColumn("splits", F.filter(some, lambda s: s.isNotNull()))


def search_splits(boxes: DataFrame, keys: list[str], score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """img, ``keys``, pieces, score: each box's best split in two and its best one in three.

    Cuts are every other column with at most 0.85 of the mean ink, two cuts 0.12 of the width apart. A split's score is 0.7 of its pieces' mean score and 0.3 of
    their least; of equal ones the first cut wins. ``score`` gets the distinct pieces (img, ``keys``, a, b and a box) once, and adds
    symbol and score: each piece is scored once however many splits it is part of. Boxes narrower than 12 have none.
    """
    able = boxes.where(_width() >= 12).withColumn("mean", _mean())
    able = able.withColumn("cuts", F.filter(_between(2), lambda i: F.get("cols", i)["n"] <= F.col("mean") * 0.85)).where(F.size("cuts") > 0)
    able = able.withColumn("apart", F.greatest(F.lit(5), half_up(_width() * 0.12))).drop("mean")
    left, right = (lambda c: F.col("x0") + c - 1), (lambda c: F.col("x0") + c + 1)
    two = F.transform(
        "cuts",
        lambda c: F.struct(
            F.lit(2).alias("n"), c.alias("i"), F.lit(-1).alias("j"),
            F.array(F.struct(F.col("x0").alias("a"), left(c).alias("b")), F.struct(right(c).alias("a"), F.col("x1").alias("b"))).alias("spans")
        )
    )
    of_two = lambda c, d: F.array(
        F.struct(F.col("x0").alias("a"), left(c).alias("b")), F.struct(right(c).alias("a"), left(d).alias("b")),
        F.struct(right(d).alias("a"), F.col("x1").alias("b"))
    )
    three = F.flatten(
        F.transform(
            "cuts",
            lambda c: F.transform(
                F.filter("cuts", lambda d: d - c >= F.col("apart")),
                lambda d: F.struct(F.lit(3).alias("n"), c.alias("i"), d.alias("j"), of_two(c, d).alias("spans"))
            )
        )
    )
    tried = able.select("img", *keys, F.explode(F.concat(two, three)).alias("t")).select("img", *keys, "t.n", "t.i", "t.j", F.posexplode("t.spans").alias("at", "span")).select(
        "img", *keys, "n", "i", "j", "at", "span.*"
    )
    tried = written(tried, "tried")
    asked = tried.select("img", *keys, "a", "b").distinct().join(able.select("img", *keys, "cols"), ["img", *keys]).withColumn(
        "box", tight(F.col("cols"), F.col("a"), F.col("b"))
    )
    scored = score(asked.where("box is not null").select("img", *keys, "a", "b", "box.*"))
    piece = F.struct("at", *BOX, "symbol", "score")
    whole = tried.join(scored, ["img", *keys, "a", "b"]).groupBy("img", *keys, "n", "i", "j").agg(
        F.count("*").alias("m"), F.avg("score").alias("mean"), F.min("score").alias("min"),
        F.sort_array(F.collect_list(piece), asc=False).alias("pieces")
    )
    good = whole.where("m = n").withColumn("score", F.round(0.7 * F.col("mean") + 0.3 * F.col("min"), 9))
    best = good.groupBy("img", *keys, "n").agg(
        F.max_by(F.struct("i", "j", "pieces", "score"), F.struct("score", -F.col("i"), -F.col("j"))).alias("s")
    )
    return best.select("img", *keys, "n", "s.*")


def samples(mask: DataFrame, boxes: DataFrame, keys: list[str], side: int = 24) -> DataFrame:
    """img, ``keys``, sample: each box as ``side`` by ``side`` means, fitted to the longer side and centred.

    A target place covers an interval of columns and one of rows; ink meets both intervals by equality with the places that they cover.
    """
    w, h = _width(), F.col("y1") - F.col("y0") + 1
    scale = F.lit(side) / F.greatest(w, h)
    size = lambda n: F.greatest(F.lit(1), half_up(n * scale)).cast("int")
    fitted = boxes.select("img", *keys, "x0", "y0", w.alias("w"), h.alias("h"), size(w).alias("dw"), size(h).alias("dh"))

    def covered(axis: str, n: str, d: str) -> DataFrame:
        to = fitted.withColumn("t", F.explode(F.sequence(F.lit(0), F.col(d) - 1)))
        first = F.floor(F.col("t") * F.col(n) / F.col(d))
        to = to.withColumn("first", F.col(f"{axis}0") + first).withColumn(
            "after", F.greatest(F.col("first") + 1, F.col(f"{axis}0") + F.floor((F.col("t") + 1) * F.col(n) / F.col(d)))
        )
        placed = (F.floor((side - F.col(d)) / 2) + F.col("t")).cast("int").alias(f"t{axis}")
        return to.select(
            "img", *keys, placed, (F.col("after") - F.col("first")).alias(f"n{axis}"),
            F.explode(F.sequence(F.col("first").cast("int"), (F.col("after") - 1).cast("int"))).alias(axis)
        )

    ink = mask.where("v = 1").select("img", "y", "x")
    met = covered("x", "w", "dw").join(ink, ["img", "x"]).join(covered("y", "h", "dh"), ["img", *keys, "y"])
    means = met.groupBy("img", *keys, "ty", "tx").agg((F.count("*") / F.first(F.col("nx") * F.col("ny"))).alias("v"))
    held = means.groupBy("img", *keys).agg(
        F.map_from_entries(F.collect_list(F.struct((F.col("ty") * side + F.col("tx")).alias("i"), "v"))).alias("held")
    )
    filled = F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: F.coalesce(F.col("held")[i], F.lit(0.0)))
    return held.select("img", *keys, filled.alias("sample"))


def size_prior(symbol: Column, height: Column) -> Column:
    """How well a symbol goes with its share of the line's height: dots are small, strokes tall, dashes flat."""
    out = F.when(height >= 0.4, 1.0).otherwise(0.75)
    for s, (how, limit, less) in SPECIAL.items():
        fits = height <= limit if how == "most" else height >= limit
        out = F.when(symbol == s, F.when(fits, 1.0).otherwise(less)).otherwise(out)
    return out


def matched(samples: DataFrame, templates: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, symbol, score: the best template (ord, symbol, aspect, t) of each sample (``keys``, sample, aspect, height).

    The score is the Dice score, weighted by the aspects' ratio and by the symbol's height; of equal ones the first template wins, and without a
    positive score the symbol is ``?``. Templates are a fixed dimension, whose size is checked before it is broadcast.
    """
    if templates.limit(MOST_TEMPLATES + 1).count() > MOST_TEMPLATES:
        raise ValueError(f"at most {MOST_TEMPLATES} templates")
    product = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    known = templates.select("ord", "symbol", F.col("aspect").alias("__aspect"), "t", product("t", "t").alias("__norm"))
    pairs = samples.withColumn("__own", product("sample", "sample")).crossJoin(F.broadcast(known))
    dice = 2 * product("sample", "t") / (F.col("__own") + F.col("__norm") + 1e-6)
    ratio = F.least("aspect", "__aspect") / F.greatest("aspect", "__aspect")
    score = F.round(dice * (0.55 + 0.45 * ratio) * size_prior(F.col("symbol"), F.col("height")), 9)
    best = pairs.withColumn("score", score).groupBy(*keys).agg(F.max_by(F.struct("symbol", "score"), F.struct("score", -F.col("ord"))).alias("m"))
    good = F.col("m.score") > 0
    return best.select(
        *keys, F.when(good, F.col("m.symbol")).otherwise("?").alias("symbol"), F.when(good, F.col("m.score")).otherwise(0.0).alias("score")
    )


def is_digit(c: Column) -> Column:
    return c.rlike("^[0-9٠-٩]$")


def restore_order(chars: Column) -> Column:
    """The text of characters read from right to left: runs of digits, and separators between two digits, are turned round."""
    seen = F.transform(chars, lambda c, i: F.struct(c.alias("c"), F.coalesce(is_digit(F.get(chars, i + 1)), F.lit(False)).alias("before_digit")))
    none = F.array().cast("array<string>")

    def step(s: Column, x: Column) -> Column:
        runs = is_digit(x["c"]) | (x["c"].isin("/", "-") & (F.size(s["run"]) > 0) & x["before_digit"])
        on = F.struct(s["out"].alias("out"), F.concat(F.array(x["c"]), s["run"]).alias("run"))
        return F.when(runs, on).otherwise(F.struct(F.concat(s["out"], s["run"], F.array(x["c"])).alias("out"), none.alias("run")))

    start = F.struct(none.alias("out"), none.alias("run"))
    return F.array_join(F.aggregate(seen, start, step, lambda s: F.concat(s["out"], s["run"])), "")


def _ascii(c: Column) -> Column:
    return F.translate(c, "٠١٢٣٤٥٦٧٨٩", "0123456789")


def readings(groups: DataFrame, keys: list[str], most: int = 6) -> DataFrame:
    """``keys``, text, confidence, glyphs: the best reading of each label; text is null where it is a word and no label.

    ``groups`` holds a row for each label with alternatives: for each of its groups, right one first, the ways to read it, each a list of pieces (symbol, score, w, h). All ways
    are combined, group by group; a reading scores 0.7 of its pieces' mean and 0.3 of their least, 0.08 more if it looks like a label, and 0.05 less for
    each piece beyond the groups. The first of equal readings wins. Labels of more than ``most`` groups are words.
    """
    few = groups.where(F.size("alternatives") <= most)
    empty = F.array(F.array()).cast(f"array<array<{PIECE}>>")
    paths = F.aggregate("alternatives", empty, lambda done, alts: F.flatten(F.transform(done, lambda p: F.transform(alts, lambda a: F.concat(p, a)))))
    listed = few.select(
        *keys, F.size("alternatives").alias("n"), F.posexplode(paths).alias("way", "pieces")
    ).where(F.size("pieces").between(1, most + 1))
    scores = F.transform("pieces", lambda p: p["score"])
    mean = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / F.size("pieces")
    chars = F.transform("pieces", lambda p: p["symbol"])
    told = listed.withColumn("mean", mean).withColumn("min", F.array_min(scores)).withColumn("chars", chars).withColumn(
        "restored", restore_order(F.col("chars"))
    )
    bonus = F.when(_ascii(F.col("restored")).rlike(PLAUSIBLE), 0.08).otherwise(0.0)
    total = F.round(0.7 * F.col("mean") + 0.3 * F.col("min") + bonus - (F.size("pieces") - F.col("n")) * 0.05, 9)
    best = told.groupBy(*keys).agg(
        F.max_by(F.struct("pieces", "mean", "min", "chars", "restored"), F.struct(total, -F.col("way"))).alias("b")
    ).select(*keys, "b.*")
    line = F.array_max(F.transform("pieces", lambda p: p["h"]))
    tall_dash = F.exists("pieces", lambda p: (p["symbol"] == "-") & (p["h"] > line * 0.45))
    short_dash = (F.col("pieces")[0]["symbol"] == "-") & (F.col("pieces")[0]["w"] / F.col("pieces")[0]["h"] < 2.5)
    word = F.when(F.size("pieces") > 1, tall_dash).otherwise(short_dash)
    text = F.when(F.col("restored").rlike("^[اأ|][/-].$"), F.concat(F.lit("١"), F.substring("restored", 2, 2))).otherwise(F.col("restored"))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (0.6 * F.col("mean") + 0.4 * F.col("min") - 0.45) / 0.4))
    ended = best.withColumn("word", word).withColumn("text", text).withColumn("dashes", F.col("text").rlike("^[-/]+$"))
    label = F.when(F.col("word"), None).when(F.col("dashes"), "").when(F.col("text").rlike("[0-9٠-٩]"), F.col("text"))
    out = ended.select(
        *keys, label.alias("text"), F.when(label.isNotNull(), F.when(F.col("dashes"), 0.9).otherwise(sure)).alias("confidence"),
        F.when(label.isNotNull(), F.size("pieces")).alias("glyphs")
    )
    return groups.select(*keys).join(out, keys, "left")


def with_hamza(symbol: Column, parts: Column) -> Column:
    """A vertical stroke of several parts is an alef with a mark, not a one."""
    return F.when((parts >= 2) & symbol.isin(ONES), "أ").otherwise(symbol)


def recognize(gray: DataFrame, templates: DataFrame, most: int = 6, side: int = 24) -> DataFrame:
    """img, text, confidence, glyphs: the short label on each image (img, y, x, v), or null where it is none that can be read.

    Ink is what is darker than the image's own threshold, which must lie between 40 and 230. Specks go, components that lie above each other are one group, and
    more than ``most`` groups are a word. A group is read whole, in its parts, or cut at thin columns; a wide one that no template fits well, also by
    searching its cuts. Every piece of every image is sampled and matched in one pass.
    """
    level = raster.otsu_levels(gray).where("level between 40 and 230")
    mask = gray.join(level, "img").select("img", "y", "x", (F.col("v") < F.col("level")).cast("int").alias("v"))
    shape = grid.labelled(mask).groupBy("img", "label").agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("area")
    ).where("area >= 3")
    high = F.col("y1") - F.col("y0") + 1
    largest = shape.groupBy("img").agg(F.max("area").alias("top"), F.max(high).alias("tall"))
    kept = shape.join(largest, "img").where((F.col("area") >= F.col("top") * 0.01) & (high >= F.greatest(F.lit(2.0), F.col("tall") * 0.08))).select(
        "img", *[F.col(c).cast("int").alias(c) for c in BOX]
    )
    listed = group_components(kept, ["img"]).where(F.size("groups") <= most)
    line = F.array_max(F.transform("groups", lambda g: g["y1"] - g["y0"] + 1))
    groups = listed.select("img", line.alias("line"), F.posexplode(F.reverse("groups")).alias("g", "b")).select("img", "line", "g", "b.*")
    whole = written(columns_of(mask, groups, ["g"]), "label-groups")
    valleys = written(valley_splits(whole).select("img", "g", "splits"), "valleys")
    lines = whole.select("img", "g", "line")

    def score(pieces: DataFrame, names: list[str]) -> DataFrame:
        aspect = (F.col("x1") - F.col("x0") + 1) / (F.col("y1") - F.col("y0") + 1)
        shaped = pieces.join(lines, ["img", "g"]).select(
            "img", "g", *names, *BOX, aspect.alias("aspect"), ((F.col("y1") - F.col("y0") + 1) / F.col("line")).alias("height")
        )
        drawn = samples(mask, shaped, ["g", *names], side).join(shaped.drop(*BOX), ["img", "g", *names])
        return shaped.drop("aspect", "height").join(matched(drawn, templates, ["img", "g", *names]), ["img", "g", *names])

    own = F.struct(*BOX)
    parts = F.when(F.size("parts").between(2, 3), F.array(F.reverse(F.array_sort("parts")))).otherwise(
        F.array().cast("array<array<struct<x0:int,y0:int,x1:int,y1:int,area:bigint>>>")
    )
    plain = whole.select("img", "g", F.array(F.array(own)).alias("a"), parts.alias("b")).join(valleys, ["img", "g"])
    box = "array<array<struct<x0:int,y0:int,x1:int,y1:int,area:bigint>>>"
    ways = plain.select(
        "img", "g", F.posexplode(F.concat(F.col("a").cast(box), F.col("b").cast(box), F.col("splits").cast(box))).alias("way", "pieces")
    ).select("img", "g", "way", F.posexplode("pieces").alias("at", "p"))
    ways = written(ways.select("img", "g", "way", "at", "p.*"), "ways")
    read = written(score(ways, ["way", "at"]), "read-pieces")
    weak = read.where("way = 0 and score < 0.8").select("img", "g")
    wide = whole.where(F.col("x1") - F.col("x0") + 1 >= 1.15 * (F.col("y1") - F.col("y0") + 1)).join(weak, ["img", "g"], "left_semi")
    searched = search_splits(wide, ["g"], lambda pieces: score(pieces, ["a", "b"]))
    found = searched.select("img", "g", (1000 + F.col("n")).alias("way"), F.posexplode("pieces").alias("at", "p")).select(
        "img", "g", "way", "at", *[F.col(f"p.{c}").alias(c) for c in (*BOX, "symbol", "score")]
    )
    told = read.select("img", "g", "way", "at", *BOX, "symbol", "score").unionByName(found).join(
        whole.select("img", "g", F.size("parts").alias("n")), ["img", "g"]
    )
    symbol = F.when(F.col("way") == 0, with_hamza(F.col("symbol"), F.col("n"))).otherwise(F.col("symbol"))
    piece = F.struct(
        "at", symbol.alias("symbol"), "score", (F.col("x1") - F.col("x0") + 1).cast("int").alias("w"),
        (F.col("y1") - F.col("y0") + 1).cast("int").alias("h")
    )
    one = told.groupBy("img", "g", "way").agg(
        F.transform(
            F.array_sort(F.collect_list(piece)),
            lambda p: F.struct(p["symbol"].alias("symbol"), p["score"].alias("score"), p["w"].alias("w"), p["h"].alias("h"))
        ).alias("pieces")
    )
    alternatives = one.groupBy("img", "g").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("way", "pieces"))), lambda w: w["pieces"]).alias("ways")
    )
    labels = alternatives.groupBy("img").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("g", "ways"))), lambda g: g["ways"]).alias("alternatives")
    )
    return gray.select("img").distinct().join(readings(labels, ["img"], most), "img", "left")
