"""Queries of the image operators over events as images, each with its SQL.

``events`` are 20 images of 24 rows (hours) and 30 columns (two minutes each); a pixel's value is its number of events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jadwal.operators import glyphs, raster, rulings, skew, warp
from jadwal.plans.slots import table

HEIGHT, WIDTH = 24, 30
ROWS, COLUMNS = (0, 4, 9, 14, 19, 23), (0, 5, 11, 17, 23, 29)
SIDE = 8  # of glyph samples; the vectors of ``embeddings`` are the templates


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """img, y, x, v."""
    e = table(spark, d, "events").where("user_id is not null and ts is not null")
    counted = e.groupBy(
        (F.col("user_id") % 20).alias("img"), F.hour("ts").alias("y"), F.floor(F.minute("ts") / 2).cast("int").alias("x")
    ).agg(F.count("*").cast("int").alias("v"))
    frame = counted.select("img").distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(HEIGHT - 1)))).withColumn(
        "x", F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1)))
    )
    return frame.join(counted, ["img", "y", "x"], "left").na.fill(0, ["v"])


def ink(spark: SparkSession, d: str, times: int = 1) -> DataFrame:
    """The pixels whose value is above ``times`` the image's mean."""
    p = pixels(spark, d)
    total = p.groupBy("img").agg(F.sum("v").alias("total"))
    return p.join(total, "img").select("img", "y", "x", (F.col("v") * (HEIGHT * WIDTH) > F.col("total") * times).cast("int").alias("v"))


def gray(spark: SparkSession, d: str) -> DataFrame:
    """Pixels as gray levels, dark where many events are."""
    p = pixels(spark, d)
    top = p.groupBy("img").agg(F.max("v").alias("top"))
    return p.join(top, "img").select("img", "y", "x", (255 - F.floor(F.col("v") * 255 / F.greatest("top", F.lit(1)))).cast("int").alias("v"))


PIXELS_SQL = f"""counted AS (SELECT user_id % 20 AS img, hour(ts) AS y, minute(ts) // 2 AS x, count(*) AS v FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL),
px AS (SELECT img, y, x, coalesce(v, 0) AS v FROM (SELECT DISTINCT img FROM counted) CROSS JOIN (SELECT unnest(range({HEIGHT})) AS y) CROSS JOIN (SELECT unnest(range({WIDTH})) AS x) LEFT JOIN counted USING (img, y, x))"""
INK_SQL = "ink AS (SELECT img, y, x, CASE WHEN v * {n} > {times} * sum(v) OVER (PARTITION BY img) THEN 1 ELSE 0 END AS v FROM px)"
GRAY_SQL = "gray AS (SELECT img, y, x, (255 - floor(v * 255 / greatest(max(v) OVER (PARTITION BY img), 1)))::INT AS v FROM px)"


def _sql(*parts: str, times: int = 1) -> str:
    ink_sql = INK_SQL.format(n=HEIGHT * WIDTH, times=times)
    return "WITH RECURSIVE " + ", ".join([PIXELS_SQL, ink_sql, GRAY_SQL, *parts[:-1]]) + " " + parts[-1]


# --- skew


def image_skew(spark: SparkSession, d: str) -> DataFrame:
    return skew.estimate_skew(ink(spark, d), least=20)


_TURNED = "floor(round(-(x - 15) * sin(radians(deg)) + (y - 12) * cos(radians(deg)) + 12, 9) + 0.5)"
_VARIANCE = f"""SELECT img, deg, ({HEIGHT} * sum(n * n) - sum(n) * sum(n))::BIGINT AS var FROM (
  SELECT img, deg, {_TURNED} AS r, count(*) AS n FROM ink, LATERAL (SELECT unnest({{degs}}) AS deg) {{more}} WHERE v = 1 GROUP BY ALL) WHERE r >= 0 AND r < {HEIGHT} GROUP BY ALL"""
SKEW_SQL = _sql(
    "tried AS (" + _VARIANCE.format(degs="range(-12, 13)", more="") + ")",
    "coarse AS (SELECT img, arg_max({'deg': deg::DOUBLE, 'var': var}, (var, deg = 0, -deg)) AS best, coalesce(max(var) FILTER (deg = 0), 0) AS "
    "upright FROM tried GROUP BY 1)",
    "leaning AS (SELECT img, best.deg AS lead FROM coarse WHERE best.deg <> 0)",
    "finer AS (" + _VARIANCE.format(degs="range(-3, 13)", more="").replace("unnest(range(-3, 13)) AS deg", "lead + unnest(range(-3, 13)) / "
    "4.0::DOUBLE AS deg").replace("FROM ink, LATERAL", "FROM ink JOIN leaning USING (img), LATERAL") + ")",
    "numbered AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY deg) AS i FROM finer)",
    "fold AS (SELECT img, 0::BIGINT AS i, best.deg AS deg, best.var AS var FROM coarse UNION ALL SELECT f.img, n.i, CASE WHEN n.deg <= f.deg + "
    "0.75 AND n.var > f.var THEN n.deg ELSE f.deg END, CASE WHEN n.deg <= f.deg + 0.75 AND n.var > f.var THEN n.var ELSE f.var END FROM fold f "
    "JOIN numbered n ON n.img = f.img AND n.i = f.i + 1)",
    "ends AS (SELECT img, arg_max(deg, i) AS deg, arg_max(var, i) AS var FROM fold GROUP BY 1)",
    "points AS (SELECT img, sum(v)::BIGINT AS points FROM ink GROUP BY 1)",
    """SELECT img, points, coalesce(best.deg, 0.0)::DOUBLE AS coarse, (CASE WHEN points >= 20 AND var * 5 >= upright * 6 AND abs(deg) >= 1 THEN deg ELSE 0.0 END)::DOUBLE AS skew
  FROM points LEFT JOIN coarse USING (img) LEFT JOIN ends USING (img)""",
)


# --- cells from rulings


def _lines(spark: SparkSession, d: str, places: tuple[int, ...]) -> DataFrame:
    return pixels(spark, d).select("img").distinct().withColumn("pos", F.explode(F.array(*[F.lit(float(p)) for p in places])))


def ruled_cells(spark: SparkSession, d: str) -> DataFrame:
    mask = ink(spark, d)
    return rulings.build_cells(_lines(spark, d, ROWS), _lines(spark, d, COLUMNS), mask, mask, band=0)


def _separators(line: str, places: tuple[int, ...], along: str, marks: tuple[int, ...]) -> str:
    return f"""SELECT img, l AS line, p AS part FROM (SELECT img, l, p, sum(v) / any_value({marks}[p + 2] - {marks}[p + 1]) AS coverage
  FROM ink, LATERAL (SELECT unnest(range(1, {len(places) - 1})) AS l), LATERAL (SELECT unnest(range({len(marks) - 1})) AS p)
  WHERE {line} = {places}[l + 1] AND {along} >= {marks}[p + 1] AND {along} < {marks}[p + 2] GROUP BY img, l, p) WHERE coverage < 0.3"""


_R, _C = list(ROWS), list(COLUMNS)
CELLS_SQL = _sql(
    "open AS (SELECT img, part AS r1, line - 1 AS c1, part AS r2, line AS c2 FROM (" + _separators("x", _C, "y", _R) + ") UNION ALL SELECT img, "
    "line - 1, part, line, part FROM (" + _separators("y", _R, "x", _C) + "))",
    "both_ways AS (SELECT * FROM open UNION ALL SELECT img, r2, c2, r1, c1 FROM open)",
    f"cell AS (SELECT img, r, c FROM (SELECT DISTINCT img FROM px), range({len(ROWS) - 1}) AS a(r), range({len(COLUMNS) - 1}) AS b(c))",
    "reach AS (SELECT img, r, c, r AS r0, c AS c0 FROM cell UNION SELECT reach.img, reach.r, reach.c, r2, c2 FROM reach JOIN both_ways b ON b.img "
    "= reach.img AND b.r1 = r0 AND b.c1 = c0)",
    "grouped AS (SELECT DISTINCT img, min(r0) AS ra, max(r0) AS rb, min(c0) AS ca, max(c0) AS cb, min((r0, c0)) AS root FROM reach GROUP BY img, "
    "r, c)",
    f"SELECT img, ra AS row, ca AS col, rb - ra + 1 AS row_span, cb - ca + 1 AS col_span, {_C}[ca + 1]::DOUBLE AS x, {_R}[ra + 1]::DOUBLE AS y, "
    f"({_C}[cb + 2] - {_C}[ca + 1])::DOUBLE AS w, ({_R}[rb + 2] - {_R}[ra + 1])::DOUBLE AS h FROM grouped",
)


# --- warping


def _quads(spark: SparkSession, d: str) -> DataFrame:
    """The outermost dark pixels of each image in the four diagonal directions; every fifth image has a degenerate one."""
    at, up, down = F.struct(
        F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x")
    ), F.col("y") + F.col("x"), F.col("x") - F.col("y")
    first = lambda c: F.min_by(at, F.struct(c, F.col("y")))
    tl, tr, br, bl = first(up), first(-down), first(-up), first(down)
    ends = ink(spark, d).where("v = 1").groupBy("img").agg(tl.alias("tl"), tr.alias("tr"), br.alias("br"), bl.alias("bl"))
    return ends.select("img", F.array("tl", F.when(F.col("img") % 5 == 4, F.col("tl")).otherwise(F.col("tr")), "br", "bl").alias("quad"))


def image_homographies(spark: SparkSession, d: str) -> DataFrame:
    h = warp.homography(F.col("quad"), warp.rectangle(12, 16))
    return _quads(spark, d).select("img", F.transform(h, lambda v: F.round(v, 6) + 0.0).alias("h")).select(
        "img", *[F.col("h")[i].alias(f"h{i}") for i in range(9)]
    )


def warped_images(spark: SparkSession, d: str) -> DataFrame:
    return warp.warped(gray(spark, d), _quads(spark, d), 12, 16)


_QUADS_SQL = """quads AS (SELECT img, [tl, CASE WHEN img % 5 = 4 THEN tl ELSE tr END, br, bl] AS quad FROM (
  SELECT img, arg_min([y, x], (y + x, y))::DOUBLE[] AS tl, arg_min([y, x], (y - x, y))::DOUBLE[] AS tr, arg_min([y, x], (-y - x, y))::DOUBLE[] AS br, arg_min([y, x], (x - y, y))::DOUBLE[] AS bl FROM ink WHERE v = 1 GROUP BY 1))"""


def _solved_sql(source: str, target: str) -> str:
    """The eight unknowns by elimination, one recursive step a column."""
    line = lambda p, q: f"[[{p}[2], {p}[1], 1, 0, 0, 0, -{q}[2] * {p}[2], -{q}[2] * {p}[1], {q}[2]], [0, 0, 0, {p}[2], {p}[1], 1, -{q}[1] * {p}[2], -{q}[1] * {p}[1], {q}[1]]]"
    rows = " || ".join(line(f"{source}[{i}]", f"{target}[{i}]") for i in range(1, 5))
    return f"""step AS (SELECT img, 0 AS k, ({rows})::DOUBLE[][] AS m FROM sides
  UNION ALL SELECT img, k + 1, list_transform(range(1, 9), lambda i: CASE WHEN i = k + 1 THEN s[i] ELSE list_transform(range(1, 10), lambda j: s[i][j] - s[i][k + 1] / s[k + 1][k + 1] * s[k + 1][j]) END) FROM (
    SELECT img, k, list_transform(range(1, 9), lambda i: CASE WHEN i = k + 1 THEN m[p] WHEN i = p THEN m[k + 1] ELSE m[i] END) AS s FROM (
      SELECT *, list_sort(list_transform(range(k + 1, 9), lambda i: {{'a': -abs(m[i][k + 1]), 'i': i}}))[1].i AS p FROM step WHERE k < 8)
    WHERE abs(m[p][k + 1]) >= 1e-12)),
solution AS (SELECT img, list_transform(range(1, 9), lambda i: m[i][9] / m[i][i]) || [1.0] AS h FROM step WHERE k = 8)"""


_TARGET = "[[0, 0], [0, 15], [11, 15], [11, 0]]::DOUBLE[][]"
HOMOGRAPHY_SQL = _sql(
    _QUADS_SQL, f"sides AS (SELECT img, quad AS p, {_TARGET} AS q FROM quads)", _solved_sql("p", "q"),
    "SELECT img, " + ", ".join(f"round(h[{i + 1}], 6) + 0.0 AS h{i}" for i in range(9)) + " FROM quads LEFT JOIN solution USING (img)"
)
WARP_SQL = _sql(
    _QUADS_SQL, f"sides AS (SELECT img, {_TARGET} AS p, quad AS q FROM quads)", _solved_sql("p", "q"),
    "asked AS (SELECT img, y, x, round((h[4] * x + h[5] * y + h[6]) / (h[7] * x + h[8] * y + h[9]), 9) AS sy, round((h[1] * x + h[2] * y + h[3]) / "
    "(h[7] * x + h[8] * y + h[9]), 9) AS sx FROM solution, range(12) AS a(y), range(16) AS b(x))",
    "inside AS (SELECT *, floor(sy)::INT AS y0, floor(sx)::INT AS x0, least(23, floor(sy) + 1)::INT AS y1, least(29, floor(sx) + 1)::INT AS x1 "
    "FROM asked WHERE sy >= 0 AND sx >= 0 AND sy <= 23 AND sx <= 29)",
    """four AS (SELECT i.img, i.y, i.x, floor(round((a.v + (b.v - a.v) * (sx - x0)) + ((c.v + (e.v - c.v) * (sx - x0)) - (a.v + (b.v - a.v) * (sx - x0))) * (sy - y0), 6) + 0.5)::INT AS v FROM inside i
  JOIN gray a ON a.img = i.img AND a.y = y0 AND a.x = x0 JOIN gray b ON b.img = i.img AND b.y = y0 AND b.x = x1 JOIN gray c ON c.img = i.img AND c.y = y1 AND c.x = x0 JOIN gray e ON e.img = i.img AND e.y = y1 AND e.x = x1)""",
    "SELECT img, y, x, coalesce(f.v, 255) AS v FROM asked LEFT JOIN four f USING (img, y, x)",
)


# --- text bands, tall gaps, outer lines


def schedule_bands(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("user_id is not null and ts is not null")
    profile = e.groupBy((F.col("user_id") % 20).alias("sched"), (F.hour("ts") * 60 + F.minute("ts")).alias("pos")).agg(F.count("*").alias("v"))
    return raster.text_bands(profile, ["sched"])


BANDS_SQL = """WITH hit AS (SELECT DISTINCT user_id % 20 AS sched, hour(ts) * 60 + minute(ts) AS pos FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
cut AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY sched ORDER BY pos) <= 3 THEN 0 ELSE 1 END AS c FROM hit),
band AS (SELECT sched, min(pos) AS first, max(pos) + 1 AS after FROM (SELECT *, sum(c) OVER (PARTITION BY sched ORDER BY pos) AS run FROM cut) GROUP BY sched, run),
folded AS (SELECT sched, list_reduce(list([{'f': first, 'a': after}] ORDER BY first), lambda done, b: CASE
  WHEN (b[1].a - b[1].f < 0.35 * (done[-1].a - done[-1].f) OR done[-1].a - done[-1].f < 0.35 * (b[1].a - b[1].f)) AND b[1].f - done[-1].a <= 0.6 * greatest(b[1].a - b[1].f, done[-1].a - done[-1].f)
  THEN done[:-2] || [{'f': done[-1].f, 'a': b[1].a}] ELSE done || b END) AS bands FROM band GROUP BY 1)
SELECT sched, b.f AS first, b.a AS after FROM (SELECT sched, unnest(bands) AS b FROM folded)"""


def _column_profile(spark: SparkSession, d: str, times: int) -> DataFrame:
    return raster.projection(ink(spark, d, times), "x")


TALL = (0, 3, 6, 15, 18, 27)


def restored_lines(spark: SparkSession, d: str) -> DataFrame:
    busy = _column_profile(spark, d, 2).select(
        "img", "pos", F.when(F.col("v") > (F.col("pos") + F.col("img")) % 5, F.col("v")).otherwise(0).alias("v")
    )
    return rulings.split_tall(_lines(spark, d, TALL), busy)


RESTORED_SQL = _sql(
    "profile AS (SELECT img, x AS pos, CASE WHEN sum(v) > (x + img) % 5 THEN sum(v) ELSE 0 END AS v FROM ink GROUP BY img, x)",
    f"lines AS (SELECT img, unnest({list(TALL)})::DOUBLE AS pos FROM (SELECT DISTINCT img FROM px))",
    "gaps AS (SELECT *, b - a AS size FROM (SELECT img, pos AS a, lead(pos) OVER (PARTITION BY img ORDER BY pos) AS b FROM lines) WHERE b IS NOT "
    "NULL)",
    "tall AS (SELECT *, floor(size / med + 0.5) AS n FROM (SELECT *, list_sort(list(size) OVER (PARTITION BY img))[len(list(size) OVER (PARTITION "
    "BY img)) // 2 + 1] AS med FROM gaps) WHERE floor(size / med + 0.5) >= 2 AND size >= 1.7 * med)",
    "aims AS (SELECT img, a, k, floor(a + k * size / n - 0.3 * size / n + 0.5) AS lo, floor(a + k * size / n + 0.3 * size / n + 0.5) AS hi FROM "
    "tall, LATERAL (SELECT unnest(range(1, n::INT)) AS k))",
    "spot AS (SELECT img, a, k, t, CASE WHEN v = 0 THEN t - row_number() OVER (PARTITION BY img, a, k, v = 0 ORDER BY t) END AS run FROM aims JOIN "
    "profile USING (img), LATERAL (SELECT pos AS t) WHERE t BETWEEN lo AND hi)",
    "best AS (SELECT img, a, k, s, n FROM (SELECT img, a, k, min(t) AS s, count(*) AS n FROM spot WHERE run IS NOT NULL GROUP BY img, a, k, run) "
    "QUALIFY row_number() OVER (PARTITION BY img, a, k ORDER BY n DESC, s) = 1)",
    "SELECT img, pos FROM lines UNION ALL SELECT img, (s + n / 2)::DOUBLE FROM best WHERE n >= 3",
    times=2,
)


def outer_lines(spark: SparkSession, d: str) -> DataFrame:
    return rulings.with_outer(_lines(spark, d, (4, 12, 24)), _column_profile(spark, d, 1), 3, F.lit(float(HEIGHT)))


OUTER_SQL = _sql(
    "side AS (SELECT img, sum(v) FILTER (x < 4) AS l, sum(v) FILTER (x >= 24) AS r FROM ink GROUP BY 1)",
    "SELECT img, unnest([4, 12, 24])::DOUBLE AS pos FROM side UNION ALL SELECT img, 0.0 FROM side WHERE l > 36 UNION ALL SELECT img, 29.0 FROM "
    "side WHERE r > 36",
)


# --- glyphs


def grouped_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders as boxes: days across and order numbers down, for each customer."""
    o = table(spark, d, "orders")
    start, key = F.datediff("o_orderdate", F.lit("1992-01-01")), F.col("o_orderkey")
    boxes = o.select(
        "o_custkey", start.alias("x0"), (start + F.floor(F.col("o_totalprice") / 1000)).alias("x1"), (key % 50).alias("y0"),
        (key % 50 + 5).alias("y1"), (key % 7).alias("area")
    )
    found = glyphs.group_components(boxes, ["o_custkey"]).select("o_custkey", F.explode("groups").alias("g"))
    return found.select("o_custkey", *[F.col(f"g.{c}").cast("long").alias(c) for c in glyphs.BOX], F.size("g.parts").cast("long").alias("parts"))


GROUPS_SQL = """WITH RECURSIVE box AS (SELECT o_custkey, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS x0, floor(o_totalprice / 1000)::BIGINT AS len, o_orderkey % 50 AS y0, o_orderkey % 7 AS area FROM orders),
start AS (SELECT o_custkey, list_sort(list({'x0': x0::BIGINT, 'x1': (x0 + len)::BIGINT, 'y0': y0::BIGINT, 'y1': (y0 + 5)::BIGINT, 'area': area::BIGINT, 'n': 1::BIGINT})) AS todo FROM box GROUP BY 1),
fold AS (
  SELECT o_custkey, todo[2:] AS todo, todo[1:1] AS done, false AS changed, false AS ended FROM start
  UNION ALL
  SELECT o_custkey, CASE WHEN len(todo) > 0 THEN todo[2:] ELSE done[2:] END, CASE WHEN len(todo) = 0 THEN done[1:1] WHEN hit THEN done[:-2] || [{'x0': least(l.x0, g.x0), 'x1': greatest(l.x1, g.x1), 'y0': least(l.y0, g.y0), 'y1': greatest(l.y1, g.y1), 'area': l.area + g.area, 'n': l.n + g.n}] ELSE done || [g] END,
    len(todo) > 0 AND (changed OR hit), false
  FROM (SELECT *, coalesce(least(l.x1, g.x1) - greatest(l.x0, g.x0) + 1 > 0 AND (least(l.x1, g.x1) - greatest(l.x0, g.x0) + 1) / (least(l.x1 - l.x0, g.x1 - g.x0) + 1) >= 0.45, false) AS hit FROM (SELECT *, done[-1] AS l, todo[1] AS g FROM fold WHERE len(todo) > 0 OR changed))),
last AS (SELECT o_custkey, done FROM fold WHERE len(todo) = 0 AND NOT changed)
SELECT o_custkey, g.x0, g.y0, g.x1, g.y1, g.area, g.n AS parts FROM (SELECT o_custkey, unnest(done) AS g FROM last)"""


def _boxes(mask: DataFrame) -> DataFrame:
    return mask.where("v = 1").groupBy("img").agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("area")
    )


def valley_cuts(spark: SparkSession, d: str) -> DataFrame:
    mask = ink(spark, d, 2)
    cut = glyphs.valley_splits(glyphs.columns_of(mask, _boxes(mask), []))
    return cut.select("img", F.array_join("cuts", ",").alias("cuts"), F.explode_outer("splits").alias("s")).select(
        "img", "cuts", F.size("s").alias("n"),
        F.array_join(F.transform("s", lambda p: F.concat_ws(":", *[p[c] for c in glyphs.BOX])), " ").alias("pieces")
    )


_COLUMNS_SQL = """box AS (SELECT img, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM ink WHERE v = 1 GROUP BY 1),
cols AS (SELECT b.*, x - x0 AS i, sum(v) AS n FROM ink JOIN box b USING (img) WHERE x BETWEEN x0 AND x1 GROUP BY ALL),
near AS (SELECT *, lag(n) OVER w AS before, lead(n) OVER w AS after, avg(n) OVER (PARTITION BY img) AS mean, x1 - x0 + 1 AS w, y1 - y0 + 1 AS h FROM cols WINDOW w AS (PARTITION BY img ORDER BY i))"""
_TIGHT_SQL = "SELECT {keys}, min(x) AS px0, min(y) AS py0, max(x) AS px1, max(y) AS py1, count(*) AS area FROM {spans} s JOIN ink USING (img) WHERE v = 1 AND x BETWEEN a AND b GROUP BY ALL HAVING count(*) >= 3"
VALLEY_SQL = _sql(
    _COLUMNS_SQL,
    "low AS (SELECT img, x0, x1, greatest(4, floor(0.15 * w + 0.5)) AS apart, i, row_number() OVER (PARTITION BY img ORDER BY n, i) AS k FROM near "
    "WHERE w >= 8 AND w / h >= 0.8 AND i BETWEEN floor(0.12 * w) AND ceil(0.88 * w) AND n <= 0.45 * mean AND n <= before AND n <= after)",
    "pick AS (SELECT img, 0::BIGINT AS k, []::BIGINT[] AS chosen FROM box UNION ALL SELECT p.img, l.k, CASE WHEN len(chosen) < 3 AND "
    "len(list_filter(chosen, lambda c: abs(c - i) < apart)) = 0 THEN chosen || [i] ELSE chosen END FROM pick p JOIN low l ON l.img = p.img AND l.k "
    "= p.k + 1)",
    "cuts AS (SELECT img, arg_max(chosen, k) AS chosen FROM pick GROUP BY 1)",
    "ends AS (SELECT img, chosen, m, [x0 - 1] || list_transform(list_sort(chosen[1:m]), lambda c: x0 + c) || [x1 + 1] AS e FROM cuts JOIN box "
    "USING (img), LATERAL (SELECT unnest(range(1, len(chosen) + 1)) AS m))",
    "spans AS (SELECT img, chosen, m, e[j] + 1 AS a, e[j + 1] - 1 AS b FROM ends, LATERAL (SELECT unnest(range(1, len(e))) AS j))",
    "tight AS (" + _TIGHT_SQL.format(keys="img, chosen, m, a, b", spans="spans") + ")",
    "whole AS (SELECT img, m, count(*)::INT AS n, string_agg(px0 || ':' || py0 || ':' || px1 || ':' || py1 || ':' || area, ' ' ORDER BY px0 DESC) "
    "AS pieces FROM tight GROUP BY 1, 2 HAVING count(*) = m + 1)",
    "SELECT img, array_to_string(chosen, ',') AS cuts, n, pieces FROM cuts LEFT JOIN whole USING (img)",
    times=2,
)


def _templates(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").where("label is not null")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v"))
    return first.select(
        F.col("label").alias("ord"), F.col("label").cast("string").alias("symbol"), (1 + F.col("label") / 10).alias("aspect"),
        F.transform("v", lambda x: F.abs(x.cast("double"))).alias("t")
    )


def _scored(spark: SparkSession, d: str, mask: DataFrame, pieces: DataFrame, keys: list[str]) -> DataFrame:
    shape = pieces.select(
        "img", *keys, *glyphs.BOX, ((F.col("x1") - F.col("x0") + 1) / (F.col("y1") - F.col("y0") + 1)).alias("aspect"),
        ((F.col("y1") - F.col("y0") + 1) / HEIGHT).alias("height")
    )
    drawn = glyphs.samples(mask, pieces, keys, SIDE).join(shape.drop(*glyphs.BOX), ["img", *keys])
    return shape.drop("aspect", "height").join(glyphs.matched(drawn, _templates(spark, d), ["img", *keys]), ["img", *keys])


def glyph_samples(spark: SparkSession, d: str) -> DataFrame:
    mask = ink(spark, d, 2)
    drawn = glyphs.samples(mask, _boxes(mask), [], 24)
    return drawn.select("img", F.posexplode("sample").alias("i", "v")).where("v > 0").select("img", "i", F.round("v", 6).alias("v"))


def _drawn_sql(boxes: str, keys: str, side: int) -> str:
    size = lambda n: f"greatest(1, floor(round({n} * ({side}::DOUBLE / greatest(px1 - px0 + 1, py1 - py0 + 1)), 9) + 0.5))::INT"
    return f"""sized AS (SELECT {keys}, px0, py0, px1 - px0 + 1 AS pw, py1 - py0 + 1 AS ph, {size("(px1 - px0 + 1)")} AS dw, {size("(py1 - py0 + 1)")} AS dh FROM {boxes}),
target AS (SELECT {keys}, (({side} - dh) // 2 + ty) * {side} + ({side} - dw) // 2 + tx AS i, px0 + tx * pw // dw AS xa, greatest(px0 + tx * pw // dw + 1, px0 + (tx + 1) * pw // dw) AS xb, py0 + ty * ph // dh AS ya, greatest(py0 + ty * ph // dh + 1, py0 + (ty + 1) * ph // dh) AS yb
  FROM sized, LATERAL (SELECT unnest(range(dw)) AS tx), LATERAL (SELECT unnest(range(dh)) AS ty)),
drawn AS (SELECT {keys}, i, count(*) / ((xb - xa) * (yb - ya))::DOUBLE AS v FROM target JOIN ink USING (img) WHERE ink.v = 1 AND x >= xa AND x < xb AND y >= ya AND y < yb GROUP BY {keys}, i, xa, xb, ya, yb)"""


SAMPLES_SQL = _sql(
    "box AS (SELECT img, min(x) AS px0, min(y) AS py0, max(x) AS px1, max(y) AS py1 FROM ink WHERE v = 1 GROUP BY 1)", _drawn_sql("box", "img", 24),
    "SELECT img, i::INT AS i, round(v, 6) AS v FROM drawn", times=2
)


def searched_cuts(spark: SparkSession, d: str) -> DataFrame:
    mask = ink(spark, d, 2)
    boxes = glyphs.columns_of(mask, _boxes(mask), [])
    best = glyphs.search_splits(boxes, [], lambda pieces: _scored(spark, d, mask, pieces, ["a", "b"]))
    return best.select(
        "img", "n", "i", "j", F.array_join(F.transform("pieces", lambda p: p["symbol"]), "").alias("symbols"), F.round("score", 6).alias("score")
    )


SEARCHED_SQL = _sql(
    _COLUMNS_SQL,
    "cuts AS (SELECT img, x0, x1, i, greatest(5, floor(0.12 * w + 0.5)) AS apart FROM near WHERE w >= 12 AND i BETWEEN floor(0.12 * w) AND "
    "ceil(0.88 * w) AND (i - floor(0.12 * w)) % 2 = 0 AND n <= 0.85 * mean)",
    "ways AS (SELECT img, 2 AS n, i, -1 AS j, [[x0, x0 + i - 1], [x0 + i + 1, x1]] AS spans FROM cuts UNION ALL SELECT c.img, 3, c.i, e.i, [[c.x0, "
    "c.x0 + c.i - 1], [c.x0 + c.i + 1, c.x0 + e.i - 1], [c.x0 + e.i + 1, c.x1]] FROM cuts c JOIN cuts e ON c.img = e.img AND e.i - c.i >= c.apart)",
    "parts AS (SELECT img, n, i, j, nth, spans[nth][1] AS a, spans[nth][2] AS b FROM ways, LATERAL (SELECT unnest(range(1, n + 1)) AS nth))",
    "asked AS (SELECT DISTINCT img, a, b FROM parts)",
    "piece AS (" + _TIGHT_SQL.format(keys="img, a, b", spans="asked") + ")",
    _drawn_sql("piece", "img, a, b", SIDE),
    "tpl AS (SELECT label, 1 + label / 10.0::DOUBLE AS aspect, list_transform(arg_min(embedding, vec_id), lambda x: abs(x::DOUBLE)) AS t FROM "
    "embeddings WHERE label IS NOT NULL GROUP BY 1)",
    "norms AS (SELECT label, aspect, t, list_sum(list_transform(t, lambda x: x * x)) AS nt FROM tpl)",
    "dots AS (SELECT img, a, b, label, aspect, nt, sum(v * t[i + 1]) AS dot, sum(v * v) AS nv FROM drawn, norms GROUP BY ALL)",
    f"rated AS (SELECT d.*, round(2 * dot / (nv + nt + 1e-6) * (0.55 + 0.45 * least(r, aspect) / greatest(r, aspect)) * CASE WHEN (py1 - py0 + 1) "
    f"/ {HEIGHT} >= 0.4 THEN 1.0 ELSE 0.75 END, 9) AS score FROM dots d JOIN (SELECT *, (px1 - px0 + 1) / (py1 - py0 + 1) AS r FROM piece) USING "
    f"(img, a, b))",
    "named AS (SELECT img, a, b, label, score FROM rated QUALIFY row_number() OVER (PARTITION BY img, a, b ORDER BY score DESC, label) = 1)",
    "scored AS (SELECT img, n, i, j, string_agg(label::VARCHAR, '' ORDER BY nth DESC) AS symbols, round(0.7 * avg(score) + 0.3 * min(score), 9) AS "
    "score FROM parts JOIN named USING (img, a, b) GROUP BY img, n, i, j HAVING count(*) = n)",
    "SELECT img, n, i, j, symbols, round(score, 6) AS score FROM scored QUALIFY row_number() OVER (PARTITION BY img, n ORDER BY scored.score DESC, "
    "i, j) = 1",
    times=2,
)


def restored_order(spark: SparkSession, d: str) -> DataFrame:
    """Order priorities and dates as characters read from right to left."""
    read = F.concat_ws("/", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", glyphs.restore_order(F.split(read, "")).alias("label"))


ORDER_SQL = r"""WITH chars AS (SELECT o_orderkey, i, s[i] AS c, s[i - 1] AS b, s[i + 1] AS n FROM (SELECT o_orderkey, string_split(o_orderpriority || '/' || strftime(o_orderdate, '%Y-%m-%d') || '/' || o_orderkey, '') AS s FROM orders), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i)),
marked AS (SELECT *, c ~ '^[0-9]$' OR (c IN ('/', '-') AND i > 1 AND b ~ '^[0-9]$' AND coalesce(n ~ '^[0-9]$', false)) AS run FROM chars),
runs AS (SELECT *, CASE WHEN run THEN i - row_number() OVER (PARTITION BY o_orderkey, run ORDER BY i) ELSE i END AS k FROM marked),
placed AS (SELECT *, min(i) OVER (PARTITION BY o_orderkey, run, k) AS start FROM runs)
SELECT o_orderkey, string_agg(c, '' ORDER BY start, CASE WHEN run THEN -i ELSE i END) AS label FROM placed GROUP BY 1"""


# --- turns, tables, binarization


def _read(grid: DataFrame) -> DataFrame:
    """A stand-in for a reader: rows and columns near the upper left corner with any value, and the share of values there."""
    size = raster.sides(grid)
    near = grid.join(size, "img").withColumn("c", (F.col("y") * 2 < F.col("h")) & (F.col("x") * 2 < F.col("w")))
    rows = F.count_distinct(F.when(F.col("c") & (F.col("v") > 1), F.col("y")))
    columns = F.count_distinct(F.when(F.col("c") & (F.col("v") > 1), F.col("x")))
    score = F.round(F.sum(F.when(F.col("c"), F.col("v")).otherwise(0)) / F.greatest(F.sum("v"), F.lit(1)), 6)
    return near.groupBy("img").agg(rows.alias("days"), columns.alias("periods"), score.alias("score")).withColumn("good", F.col("score") >= 0.27)


def best_turns(spark: SparkSession, d: str) -> DataFrame:
    return raster.best_turn(pixels(spark, d), _read)


def _turn_sql(angle: int) -> str:
    y, x, h, w = {0: ("y", "x", 24, 30), 90: ("x", "23 - y", 30, 24), 180: ("23 - y", "29 - x", 24, 30), 270: ("29 - x", "y", 30, 24)}[angle]
    near = f"2 * ({y}) < {h} AND 2 * ({x}) < {w}"
    return f"SELECT img, {angle} AS angle, count(DISTINCT {y}) FILTER ({near} AND v > 1) AS days, count(DISTINCT {x}) FILTER ({near} AND v > 1) AS periods, round(coalesce(sum(v) FILTER ({near}), 0) / greatest(sum(v), 1), 6) AS score FROM px GROUP BY 1"


TURN_SQL = _sql(
    "read AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY list_position([0, 180, 90, 270], angle)) AS k FROM (" + " UNION ALL "
    "".join(_turn_sql(a) for a in (0, 90, 180, 270)) + "))",
    "held AS (SELECT img, k, angle, days, periods, score FROM read WHERE k = 1 UNION ALL SELECT h.img, r.k, CASE WHEN b THEN r.angle ELSE h.angle "
    "END, CASE WHEN b THEN r.days ELSE h.days END, CASE WHEN b THEN r.periods ELSE h.periods END, CASE WHEN b THEN r.score ELSE h.score END FROM "
    "held h JOIN read r ON r.img = h.img AND r.k = h.k + 1, LATERAL (SELECT r.days >= 2 AND r.periods >= 1 AND r.score > h.score AS b) WHERE "
    "h.score < 0.27)",
    "SELECT img, angle, days, periods, score, score >= 0.27 AS good FROM held QUALIFY row_number() OVER (PARTITION BY img ORDER BY k DESC) = 1",
)


def table_corners(spark: SparkSession, d: str) -> DataFrame:
    found = skew.table_quads(ink(spark, d, 2), least=20)
    sides = [F.col(f"{n}.{c}").alias(f"{n}_{c}") for n in ("top_left", "top_right", "bottom_right", "bottom_left") for c in ("y", "x")]
    return found.select("img", *sides, "framed")


_FAR = lambda p, q: f"sqrt(({p}[1] - {q}[1]) ** 2 + ({p}[2] - {q}[2]) ** 2)"
_EVEN = lambda p, q: f"least({p}, {q}) / greatest({p}, {q}) >= 0.6"
CORNERS_SQL = _sql(
    "spread AS (SELECT DISTINCT p.img, p.y, p.x FROM px p JOIN ink i ON i.img = p.img AND abs(i.y - p.y) <= 1 AND abs(i.x - p.x) <= 1 WHERE i.v = 1)",
    "door AS (SELECT a.img, a.y, a.x, b.y AS y2, b.x AS x2 FROM spread a JOIN spread b ON a.img = b.img AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) "
    "<= 1)",
    "lab AS (SELECT img, y, x, y * 1000 + x AS label, 0 AS i FROM spread UNION ALL SELECT * FROM (SELECT d.img, d.y, d.x, min(l.label) AS label, "
    "any_value(l.i) + 1 AS i FROM door d JOIN lab l ON l.img = d.img AND l.y = d.y2 AND l.x = d.x2 GROUP BY d.img, d.y, d.x) WHERE i <= 120)",
    "part AS (SELECT img, y, x, label FROM lab WHERE i = 120)",
    """shape AS (SELECT img, label, (max(y) - min(y) + 1) * (max(x) - min(x) + 1) AS bounds, arg_min([y, x], (x + y, y, x)) AS tl, arg_min([y, x], (y - x, y, x)) AS tr, arg_min([y, x], (-x - y, y, x)) AS br, arg_min([y, x], (x - y, y, x)) AS bl
  FROM part GROUP BY 1, 2 HAVING count(*) >= 20 AND (max(y) - min(y) + 1) * (max(x) - min(x) + 1) >= 86.4 AND max(x) - min(x) + 1 >= 9 AND max(y) - min(y) + 1 >= 3.6)""",
    f"chosen AS (SELECT * FROM shape WHERE {_EVEN(_FAR('tl', 'tr'), _FAR('bl', 'br'))} AND {_EVEN(_FAR('tl', 'bl'), _FAR('tr', 'br'))} QUALIFY "
    f"row_number() OVER (PARTITION BY img ORDER BY bounds DESC, label) = 1)",
    "edge AS (SELECT img, e, [tl, tr, br, bl][e] AS a, [tr, br, bl, tl][e] AS b FROM chosen, range(1, 5) AS r(e))",
    f"walk AS (SELECT img, e, n, floor(round(a[1] + (b[1] - a[1]) * t / n, 9) + 0.5) AS y, floor(round(a[2] + (b[2] - a[2]) * t / n, 9) + 0.5) AS "
    f"x FROM (SELECT *, greatest(1, floor({_FAR('a', 'b')} + 0.5))::INT AS n FROM edge), LATERAL (SELECT unnest(range(0, n + 1, 2)) AS t))",
    "cover AS (SELECT img, e, count(*) FILTER (EXISTS (SELECT 1 FROM ink i WHERE i.img = w.img AND i.v = 1 AND abs(i.y - w.y) <= 3 AND abs(i.x - "
    "w.x) <= 3)) / (any_value(n) // 2 + 1) AS share FROM walk w GROUP BY 1, 2)",
    "SELECT img, tl[1] AS top_left_y, tl[2] AS top_left_x, tr[1] AS top_right_y, tr[2] AS top_right_x, br[1] AS bottom_right_y, br[2] AS "
    "bottom_right_x, bl[1] AS bottom_left_y, bl[2] AS bottom_left_x, n >= 3 AS framed FROM chosen JOIN (SELECT img, count(*) FILTER (share >= 0.5) "
    "AS n FROM cover GROUP BY 1) USING (img)",
    times=2,
)


def binarized_ink(spark: SparkSession, d: str) -> DataFrame:
    return raster.ink(raster.binarize(gray(spark, d), constant=10, window=7, radius=1, edge=1)).select(
        "img", F.col("ink").cast("long").alias("ink"), "ratio"
    )


def _box_sql(name: str, source: str, how: str, r: int) -> str:
    return f"{name} AS (SELECT p.img, p.y, p.x, {how}(s.v) AS v FROM px p JOIN {source} s ON s.img = p.img AND abs(s.y - p.y) <= {r} AND abs(s.x - p.x) <= {r} GROUP BY ALL)"


BINARIZED_SQL = _sql(
    "hist AS (SELECT img, v, count(*) AS n FROM gray GROUP BY 1, 2)",
    "cum AS (SELECT img, v, sum(n) OVER w AS wb, sum(n * v) OVER w AS sb, sum(n) OVER (PARTITION BY img) AS total, sum(n * v) OVER (PARTITION BY "
    "img) AS whole FROM hist WINDOW w AS (PARTITION BY img ORDER BY v))",
    "parted AS (SELECT img, v, CASE WHEN total > wb THEN round(wb::DOUBLE * (total - wb) * (sb / wb - (whole - sb) / (total - wb)) * (sb / wb - "
    "(whole - sb) / (total - wb)), 2) END AS score FROM cum)",
    "level AS (SELECT img, least(150, coalesce(arg_max(v, (score, -v)) FILTER (score > 0), 127)) AS t FROM parted GROUP BY 1)",
    _box_sql("mean", "gray", "avg", 3), "below AS (SELECT img, y, x, CASE WHEN v < t THEN 1 ELSE 0 END AS v FROM gray JOIN level USING (img))",
    _box_sql("worn", "below", "min", 1), _box_sql("solid", "worn", "max", 1), _box_sql("outside", "solid", "max", 1), _box_sql(
        "inside", "solid", "min", 1
    ),
    "done AS (SELECT g.img, CASE WHEN i.v = 1 THEN (255 - g.v < 255 - m.v - 10)::INT WHEN o.v = 1 THEN 1 ELSE (g.v < m.v - 10)::INT END AS v FROM "
    "gray g JOIN mean m USING (img, y, x) JOIN outside o USING (img, y, x) JOIN inside i USING (img, y, x))",
    "SELECT img, sum(v)::BIGINT AS ink, round(avg(v), 6) AS ratio FROM done GROUP BY 1",
)

# --- single steps


def gray_pixels(spark: SparkSession, d: str) -> DataFrame:
    v, y, x = F.col("v"), F.col("y"), F.col("x")
    rgba = pixels(spark, d).select(
        "img", "y", "x", (v * 37 % 256).alias("r"), ((v * 7 + x) % 256).alias("g"), (y * 9 % 256).alias("b"),
        F.when((x + y) % 3 == 0, 128).otherwise(255).alias("a")
    )
    return raster.gray(rgba)


_OVER = "(({c}) * a / 255.0::DOUBLE + 255 * (1 - a / 255.0::DOUBLE))"
GRAY_PIXELS_SQL = _sql(
    "rgba AS (SELECT img, y, x, v * 37 % 256 AS r, (v * 7 + x) % 256 AS g, y * 9 % 256 AS b, CASE WHEN (x + y) % 3 = 0 THEN 128 ELSE 255 END AS a "
    "FROM px)",
    "SELECT img, y, x, floor(round(0.299::DOUBLE * " + _OVER.format(c="r") + " + 0.587::DOUBLE * " + _OVER.format(c="g") + " + 0.114::DOUBLE * " + _OVER.format(c="b") + ", 9) + 0.5)::INT AS v FROM rgba",
)


def resized_images(spark: SparkSession, d: str) -> DataFrame:
    return raster.resize(gray(spark, d), 16, 21)


_PLACES = "{n} AS (SELECT t, greatest(0, floor(p))::INT AS a, least({old} - 1, greatest(0, floor(p))::INT + 1) AS b, p - greatest(0, floor(p)) AS w FROM (SELECT t, least({old} - 1, (t + 0.5::DOUBLE) * ({old} / {new}::DOUBLE) - 0.5) AS p FROM range({new}) AS r(t)))"
RESIZED_SQL = _sql(
    _PLACES.format(n="ys", old=HEIGHT, new=16), _PLACES.format(n="xs", old=WIDTH, new=21),
    """SELECT g.img, ys.t AS y, xs.t AS x, floor(round(sum(v * CASE WHEN g.y = ys.a AND ys.a = ys.b THEN 1 WHEN g.y = ys.a THEN 1 - ys.w ELSE ys.w END * CASE WHEN g.x = xs.a AND xs.a = xs.b THEN 1 WHEN g.x = xs.a THEN 1 - xs.w ELSE xs.w END), 9) + 0.5)::INT AS v
  FROM gray g JOIN ys ON g.y IN (ys.a, ys.b) JOIN xs ON g.x IN (xs.a, xs.b) GROUP BY ALL""",
)


def downscaled_images(spark: SparkSession, d: str) -> DataFrame:
    return raster.downscale(gray(spark, d), 2.5)


DOWNSCALED_SQL = _sql(
    "SELECT * FROM (SELECT img, (ceil((y + 1) / 2.5) - 1)::INT AS y, (ceil((x + 1) / 2.5) - 1)::INT AS x, floor(round(avg(v), 9) + 0.5)::INT AS v "
    "FROM gray GROUP BY ALL) WHERE y < 9 AND x < 12"
)


def stretched_images(spark: SparkSession, d: str) -> DataFrame:
    return raster.stretch(gray(spark, d), 0.05, 0.9)


STRETCHED_SQL = _sql(
    "hist AS (SELECT img, v, count(*) AS n FROM gray GROUP BY 1, 2)",
    "upto AS (SELECT img, v, sum(n) OVER (PARTITION BY img ORDER BY v) AS below, sum(n) OVER (PARTITION BY img ORDER BY v DESC) AS above, sum(n) "
    "OVER (PARTITION BY img) AS total FROM hist)",
    "ends AS (SELECT img, min(v) FILTER (below >= total * 0.05::DOUBLE) AS lo, max(v) FILTER (above >= total * (1 - 0.9::DOUBLE)) AS hi FROM upto "
    "GROUP BY 1)",
    "SELECT img, y, x, (CASE WHEN hi - lo < 30 THEN v ELSE greatest(0, least(255, floor(round((v - lo) * 255 / (hi - lo), 9) + 0.5))) END)::INT AS "
    "v FROM gray JOIN ends USING (img)",
)


def _around_sql(source: str, what: str, ry: int, rx: int) -> str:
    return f"SELECT p.img, p.y, p.x, {what} AS v FROM {source} p JOIN {source} s ON s.img = p.img AND abs(s.y - p.y) <= {ry} AND abs(s.x - p.x) <= {rx} GROUP BY p.img, p.y, p.x"


def blurred_images(spark: SparkSession, d: str) -> DataFrame:
    return raster.blur(gray(spark, d))


def widened_ink(spark: SparkSession, d: str) -> DataFrame:
    return raster.dilate(ink(spark, d, 2), 2, 0)


def opened_ink(spark: SparkSession, d: str) -> DataFrame:
    return raster.opened(ink(spark, d), 1)


def adaptive_ink(spark: SparkSession, d: str) -> DataFrame:
    return raster.adaptive_mask(gray(spark, d), 7, 12)


def line_pixels(spark: SparkSession, d: str) -> DataFrame:
    return raster.lines(ink(spark, d), "x", 6, 1)


_LINES_SQL = (
    "hit AS (SELECT img, y, x, CASE WHEN x - lag(x) OVER (PARTITION BY img, y ORDER BY x) <= 2 THEN 0 ELSE 1 END AS c FROM ink WHERE v = 1)",
    "run AS (SELECT img, y, min(x) AS a, max(x) AS b FROM (SELECT *, sum(c) OVER (PARTITION BY img, y ORDER BY x) AS k FROM hit) GROUP BY img, y, "
    "k HAVING max(x) - min(x) + 1 >= 6)",
    "drawn AS (SELECT p.img, p.y, p.x, (a IS NOT NULL)::INT AS v FROM px p LEFT JOIN run r ON r.img = p.img AND r.y = p.y AND p.x BETWEEN a AND b)",
)


def text_ink(spark: SparkSession, d: str) -> DataFrame:
    mask = ink(spark, d)
    return raster.without_lines(mask, raster.lines(mask, "x", 6, 1), 0)


def profile_segments(spark: SparkSession, d: str) -> DataFrame:
    return raster.segments(_column_profile(spark, d, 2), 1, 2, 2)


SEGMENTS_SQL = _sql(
    "hit AS (SELECT img, x FROM ink GROUP BY 1, 2 HAVING sum(v) > 1)", "cut AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY img ORDER BY x) "
    "<= 2 THEN 0 ELSE 1 END AS c FROM hit)",
    "run AS (SELECT img, min(x) AS first, max(x) AS last FROM (SELECT *, sum(c) OVER (PARTITION BY img ORDER BY x) AS k FROM cut) GROUP BY img, k "
    "HAVING max(x) - min(x) + 1 >= 2)",
    "SELECT *, (lag(last) OVER (PARTITION BY img ORDER BY first) + first) / 2.0::DOUBLE AS before FROM run",
    times=2,
)


def column_peaks(spark: SparkSession, d: str) -> DataFrame:
    profile = _column_profile(spark, d, 1)
    level = profile.groupBy("img").agg(F.avg("v").alias("level"))
    return raster.line_peaks(profile.join(level, "img"), F.col("level"), 3)


PEAKS_SQL = _sql(
    "profile AS (SELECT img, x AS pos, sum(v) AS v, avg(sum(v)) OVER (PARTITION BY img) AS level FROM ink GROUP BY img, x)",
    "high AS (SELECT *, pos - row_number() OVER (PARTITION BY img ORDER BY pos) AS k FROM profile WHERE v >= level)",
    "peak AS (SELECT img, min(pos) AS first, max(pos) AS last, sum(pos * v) / sum(v)::DOUBLE AS at_, max(v)::DOUBLE AS s FROM high GROUP BY img, k)",
    "numbered AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY first) AS i FROM peak)",
    """fold AS (SELECT img, i, [{'first': first, 'last': last, 'at_': at_, 's': s}] AS done FROM numbered WHERE i = 1
  UNION ALL SELECT f.img, n.i, CASE WHEN n.at_ - t.at_ < 3 THEN f.done[:-2] || [{'first': t.first, 'last': n.last, 'at_': (t.at_ * t.s + n.at_ * n.s) / (t.s + n.s), 's': greatest(t.s, n.s)}] ELSE f.done || [{'first': n.first, 'last': n.last, 'at_': n.at_, 's': n.s}] END
  FROM (SELECT *, done[-1] AS t FROM fold) f JOIN numbered n ON n.img = f.img AND n.i = f.i + 1)""",
    "SELECT img, p.first, p.last, round(p.at_, 6) AS \"at\", p.s AS strength FROM (SELECT img, unnest(done) AS p FROM (SELECT img, arg_max(done, "
    "i) AS done FROM fold GROUP BY 1))",
)


def inked_cells(spark: SparkSession, d: str) -> DataFrame:
    mask = ink(spark, d)
    cells = rulings.build_cells(_lines(spark, d, ROWS), _lines(spark, d, COLUMNS), mask, mask, band=0)
    return raster.inked(cells, ink(spark, d, 2), ["row", "col", "row_span", "col_span"], 5, 0.12).select("img", "row", "col", "ink", "empty")


INKED_SQL = _sql(
    "cells AS (SELECT * FROM (" + CELLS_SQL + "))",
    f"more AS (SELECT img, y, x FROM (SELECT *, v * {HEIGHT * WIDTH} > 2 * sum(v) OVER (PARTITION BY img) AS dark FROM px) WHERE dark)",
    'SELECT img, "row", col, ink, ink < 5 OR ink / (w * h) < 0.12 AS empty FROM (SELECT *, (SELECT count(*) FROM more m WHERE m.img = c.img AND '
    'm.x >= c.x AND m.x < c.x + c.w AND m.y >= c.y AND m.y < c.y + c.h) AS ink FROM cells c)',
)


def short_labels(spark: SparkSession, d: str) -> DataFrame:
    """Each image's ink read as one label: whole, or by its best splits."""
    mask = ink(spark, d, 2)
    boxes = glyphs.columns_of(mask, _boxes(mask), [])
    whole = _scored(spark, d, mask, boxes.drop("cols").withColumn("a", F.col("x0")).withColumn("b", F.col("x1")), ["a", "b"])
    piece = lambda p: F.struct(
        p["symbol"].alias("symbol"), p["score"].alias("score"), (p["x1"] - p["x0"] + 1).cast("int").alias("w"),
        (p["y1"] - p["y0"] + 1).cast("int").alias("h")
    )
    one = whole.select("img", F.lit(1).alias("n"), F.array(piece(F.struct(*glyphs.BOX, "symbol", "score"))).alias("pieces"))
    split = glyphs.search_splits(boxes, [], lambda pieces: _scored(spark, d, mask, pieces, ["a", "b"])).select(
        "img", "n", F.transform("pieces", piece).alias("pieces")
    )
    ways = one.unionByName(split).groupBy("img").agg(F.array_sort(F.collect_list(F.struct("n", "pieces"))).alias("ways"))
    read = glyphs.readings(ways.select("img", F.array(F.transform("ways", lambda w: w["pieces"])).alias("alternatives")), ["img"])
    return read.select("img", "text", F.round("confidence", 6).alias("confidence"), "glyphs")


LABELS_SQL = SEARCHED_SQL[: SEARCHED_SQL.rindex("scored AS (")].replace("ways AS (SELECT img, 2 AS n", "ways AS (SELECT img, 1 AS n, -1 AS i, -1 AS j, [[x0, x1]] AS spans FROM box UNION ALL SELECT img, 2 AS n") + """scored AS (
  SELECT img, n, i, j, reverse(string_agg(label::VARCHAR, '' ORDER BY nth DESC)) AS label, avg(score) AS mean, min(score) AS low, round(0.7 * avg(score) + 0.3 * min(score), 9) AS s FROM parts JOIN named USING (img, a, b) GROUP BY img, n, i, j HAVING count(*) = n),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY img, n ORDER BY s DESC, i, j) = 1),
chosen AS (SELECT *, round(0.7 * mean + 0.3 * low + CASE WHEN n <= 2 THEN 0.08 ELSE 0 END - (n - 1) * 0.05, 9) AS total FROM best QUALIFY row_number() OVER (PARTITION BY img ORDER BY total DESC, n) = 1)
SELECT img, label AS "text", round(greatest(0, least(1, (0.6 * mean + 0.4 * low - 0.45) / 0.4)), 6) AS confidence, n AS glyphs FROM chosen"""

QUERIES = {
    f.__name__: f
    for f in (
        image_skew, ruled_cells, image_homographies, warped_images, schedule_bands, restored_lines, outer_lines, grouped_orders, valley_cuts,
        glyph_samples, searched_cuts, restored_order, best_turns,
        table_corners, binarized_ink, gray_pixels, resized_images, downscaled_images, stretched_images, blurred_images, widened_ink, opened_ink,
        adaptive_ink, line_pixels, text_ink, profile_segments,
        column_peaks, inked_cells, short_labels,
    )
}
ORACLE = {
    "image_skew": SKEW_SQL, "ruled_cells": CELLS_SQL, "image_homographies": HOMOGRAPHY_SQL, "warped_images": WARP_SQL, "schedule_bands": BANDS_SQL,
    "restored_lines": RESTORED_SQL, "outer_lines": OUTER_SQL,
    "grouped_orders": GROUPS_SQL, "valley_cuts": VALLEY_SQL, "glyph_samples": SAMPLES_SQL, "searched_cuts": SEARCHED_SQL, "restored_order": ORDER_SQL,
    "best_turns": TURN_SQL, "table_corners": CORNERS_SQL,
    "binarized_ink": BINARIZED_SQL, "gray_pixels": GRAY_PIXELS_SQL, "resized_images": RESIZED_SQL, "downscaled_images": DOWNSCALED_SQL,
    "stretched_images": STRETCHED_SQL,
    "blurred_images": _sql(_around_sql("gray", "floor(round(avg(s.v), 9) + 0.5)::INT", 1, 1)), "widened_ink": _sql(
        _around_sql("ink", "max(s.v)", 0, 2), times=2
    ),
    "opened_ink": _sql(f"worn AS ({_around_sql('ink', 'min(s.v)', 1, 1)})", _around_sql("worn", "max(s.v)", 1, 1)), "adaptive_ink": _sql(
        _around_sql("gray", "(any_value(p.v) < avg(s.v) - 12)::INT", 3, 3)
    ),
    "line_pixels": _sql(*_LINES_SQL, "SELECT * FROM drawn"), "text_ink": _sql(
        *_LINES_SQL, "SELECT img, y, x, ink.v * (1 - drawn.v) AS v FROM ink JOIN drawn USING (img, y, x)"
    ), "profile_segments": SEGMENTS_SQL,
    "column_peaks": PEAKS_SQL, "inked_cells": INKED_SQL, "short_labels": LABELS_SQL,
}
