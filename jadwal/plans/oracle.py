"""The queries in SQL for DuckDB, written separately from the Spark plans."""

from __future__ import annotations

from jadwal.plans.slots import SLOTS_SQL

#: A lexicon with slips, for tolerant matching of ASCII words.
TYPOS = [
    ("red", "rde"), ("green", "gren"), ("blue", "bluee"), ("small", "smal"), ("large", "lagre"), ("widget", "wigdet"), ("gadget", "gadgte"),
    ("steel", "stele"), ("brass", "bras"), ("copper", "coper"), ("bolt", "blot"), ("screw", "scerw")
]

_VALID = "day_idx BETWEEN 0 AND 4 AND period BETWEEN 1 AND 12"
_FIRST = "SELECT sched, day_idx, period, arg_min({c}, ord) AS {c}, min(ord) AS ord FROM slots WHERE " + _VALID + " GROUP BY ALL"
_KEYED = r"keyed AS (SELECT *, regexp_replace(replace(class_raw, '\', '/'), ' *[/-]+ *', '/', 'g') AS class_key FROM slots)"
_LINE = """counted AS (SELECT sched, day_idx, period, count(*) AS n FROM slots GROUP BY ALL),
line AS (
  SELECT f.sched, f.day_idx, f.pos, CASE WHEN n % 3 <> 0 THEN period + CASE WHEN f.sched % 2 = 1 AND period > 6 THEN 1 ELSE 0 END END AS label, n IS NOT NULL AS is_data
  FROM (SELECT DISTINCT sched, day_idx, unnest(range(1, 13)) AS pos FROM counted) f
  LEFT JOIN counted c ON c.sched = f.sched AND c.day_idx = f.day_idx AND c.period = f.pos)"""
_INTERVALS = 'iv AS (SELECT ord, sched, day_idx, minute AS s, least(minute + 50, 1440) AS e FROM slots)'
_LEVELS = "levels AS (SELECT least(255, floor(l_extendedprice / 400))::INT AS level, count(*) AS n FROM lineitem GROUP BY 1)"
_GRID = """g AS (
  SELECT y, x, count(sched) AS v FROM (SELECT unnest(range(0, 7)) AS y) CROSS JOIN (SELECT unnest(range(0, 24)) AS x)
  LEFT JOIN slots ON day_idx = y AND minute // 60 = x GROUP BY y, x)"""
_MASK = _GRID + ", mask AS (SELECT y, x, CASE WHEN v > (SELECT avg(v) FROM g) THEN 1 ELSE 0 END AS v FROM g)"
# The designer's colours.
_PALETTE = "['#8fd3ad', '#93b4f2', '#f6c65a', '#f29bbd', '#7fd0d6', '#c3a4f0', '#f5a07f', '#c9dd6e', '#86bde6', '#e2b58f']"


def _q(*parts: str) -> str:
    return "WITH " + ", ".join([SLOTS_SQL, *parts[:-1]]) + " " + parts[-1]


ORACLE = {
    "slot_first_wins": _q(_FIRST.format(c="class_raw")),
    "class_key_canonical": _q(
        _KEYED,
        "best AS (SELECT sched, class_key, class_raw AS label FROM keyed QUALIFY row_number() OVER (PARTITION BY sched, class_key ORDER BY conf "
        "DESC, ord) = 1)",
        "SELECT sched, class_key, label, count(*) AS lessons, count(*) FILTER (class_raw <> label) AS changed FROM keyed JOIN best USING (sched, "
        "class_key) GROUP BY ALL",
    ),
    "section_style_fix": _q(
        f"f AS ({_FIRST.format(c='class_name')})", "p AS (SELECT *, split_part(class_name, '/', 1) AS g, split_part(class_name, '/', 2) AS s FROM f)",
        "k AS (SELECT sched, count(*) AS n, count(*) FILTER (regexp_full_match(s, '[a-z]+') AND s <> 'a') AS l, count(*) FILTER "
        "(regexp_full_match(s, '[0-9]+') AND s <> '1') AS d FROM p GROUP BY 1)",
        "SELECT sched, day_idx, period, class_name, CASE WHEN n >= 3 AND l > d AND l >= 2 AND s IN ('1', 'a') THEN g || '/A' WHEN n >= 3 AND d > l "
        "AND d >= 2 AND s = 'a' THEN g || '/1' ELSE class_name END AS fixed FROM p JOIN k USING (sched)",
    ),
    "digit_pair_swap": _q(
        f"f AS ({_FIRST.format(c='pair_name')})", "p AS (SELECT *, split_part(pair_name, '/', 1) AS a, split_part(pair_name, '/', 2) AS b FROM f)",
        "k AS (SELECT sched, count(*) >= 3 AND count(DISTINCT b) = 1 AND count(DISTINCT a) >= 2 AS swap FROM p GROUP BY 1)",
        "SELECT sched, day_idx, period, pair_name, CASE WHEN swap THEN b || '/' || a ELSE pair_name END AS fixed FROM p JOIN k USING (sched)",
    ),
    "confidence_bands": _q(
        "SELECT sched, count(*) FILTER (conf >= 0.8) AS high, count(*) FILTER (conf >= 0.5 AND conf < 0.8) AS medium, count(*) FILTER (conf < 0.5) "
        "AS low FROM slots GROUP BY 1"
    ),
    "schedule_quality": _q(
        f"k AS (SELECT sched, count(DISTINCT day_idx) AS days, count(DISTINCT period) AS periods, count(*) AS lessons, count(*) FILTER (conf >= "
        f"0.5) AS rec, count(*) FILTER (class_name <> '' AND conf >= 0.35) AS cls FROM slots WHERE {_VALID} GROUP BY 1)",
        "q AS (SELECT *, 0.35::DOUBLE * least(1.0::DOUBLE, days / 5) + 0.25::DOUBLE * least(1.0::DOUBLE, periods / 5) + 0.4::DOUBLE * "
        "((0.5::DOUBLE * rec + 0.5::DOUBLE * cls) / lessons) AS quality FROM k)",
        "SELECT sched, days, periods, lessons, round(quality, 6) AS quality, days >= 3 AND periods >= 3 AND lessons >= 3 AND quality >= 0.45 AS ok "
        "FROM q",
    ),
    "week_grid_pivot": _q(
        "SELECT sched, period, " + ", ".join(f"count(*) FILTER (day_idx = {i}) AS {d}" for i, d in enumerate(("sun", "mon", "tue", "wed", "thu"))) + " FROM slots GROUP BY 1, 2"
    ),
    "source_merge_conflicts": _q(
        f"r AS (SELECT sched, day_idx, period, class_name, conf, row_number() OVER w AS i, first_value(class_name) OVER w AS name FROM slots WHERE "
        f"{_VALID} WINDOW w AS (PARTITION BY sched, day_idx, period ORDER BY ord % 3, ord))",
        "m AS (SELECT *, class_name = name AS same, max(CASE WHEN class_name = name THEN conf END) OVER (PARTITION BY sched, day_idx, period ORDER "
        "BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM r)",
        "e AS (SELECT *, CASE WHEN i = 1 THEN conf < 0.5 WHEN NOT same THEN true WHEN conf > top THEN conf < 0.5 END AS flag FROM m)",
        "SELECT sched, day_idx, period, any_value(name) AS name, round(max(conf) FILTER (same), 6) AS conf, arg_max(flag, i) FILTER (flag IS NOT "
        "NULL) AS review, count(*) FILTER (NOT same) > 0 AS conflict, CASE WHEN count(*) FILTER (NOT same) > 0 THEN 1 + count(*) FILTER (NOT same) "
        "ELSE 0 END AS alternatives FROM e GROUP BY 1, 2, 3",
    ),
    "period_gap_fill": _q(
        _LINE,
        """w AS (SELECT *, (SELECT count(*) FROM line k WHERE k.sched = l.sched AND k.day_idx = l.day_idx AND k.label IS NOT NULL) AS n,
             (SELECT max(k.pos) FROM line k WHERE k.sched = l.sched AND k.day_idx = l.day_idx AND k.label IS NOT NULL AND k.pos <= l.pos) AS pa,
             (SELECT min(k.pos) FROM line k WHERE k.sched = l.sched AND k.day_idx = l.day_idx AND k.label IS NOT NULL AND k.pos >= l.pos) AS pb FROM line l)""",
        "v AS (SELECT w.*, a.label AS la, b.label AS lb FROM w LEFT JOIN line a ON a.sched = w.sched AND a.day_idx = w.day_idx AND a.pos = pa LEFT "
        "JOIN line b ON b.sched = w.sched AND b.day_idx = w.day_idx AND b.pos = pb)",
        """h AS (SELECT v.*, NOT EXISTS (SELECT 1 FROM line k WHERE k.sched = v.sched AND k.day_idx = v.day_idx AND NOT k.is_data AND k.pos > pa AND k.pos <= v.pos) AS clear_a,
             NOT EXISTS (SELECT 1 FROM line k WHERE k.sched = v.sched AND k.day_idx = v.day_idx AND NOT k.is_data AND k.pos < pb AND k.pos >= v.pos) AS clear_b FROM v)""",
        """o AS (SELECT sched, day_idx, pos, CASE WHEN label IS NOT NULL THEN label
               WHEN pa IS NOT NULL AND pb IS NOT NULL THEN CASE WHEN lb - la = pb - pa THEN la + pos - pa END
               WHEN n >= 2 AND pb IS NULL AND clear_a AND la + pos - pa <= 12 THEN la + pos - pa
               WHEN n >= 2 AND pa IS NULL AND clear_b AND lb - (pb - pos) >= 1 THEN lb - (pb - pos) END AS value,
             label IS NULL AS inferred, CASE WHEN label IS NOT NULL THEN 1.0::DOUBLE WHEN pa IS NOT NULL AND pb IS NOT NULL THEN 0.55::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM h)""",
        "SELECT * FROM o WHERE value IS NOT NULL",
    ),
    "direction_vote": _q(
        "l AS (SELECT sched, day_idx, minute, arg_min(period, ord) AS p FROM slots GROUP BY 1, 2, 3)", "b AS (SELECT *, lag(p) OVER (PARTITION BY "
        "sched, day_idx ORDER BY minute) AS q FROM l)",
        "k AS (SELECT sched, day_idx, count(*) FILTER (p > q) AS inc, count(*) FILTER (p <= q) AS dec FROM b WHERE q IS NOT NULL GROUP BY 1, 2)",
        "SELECT *, CASE WHEN inc >= dec THEN 1 ELSE -1 END AS step FROM k",
    ),
    "time_rank_periods": _q(
        "h AS (SELECT sched, day_idx, period AS pos, min(minute) AS minute, CASE WHEN count(*) % 3 = 0 THEN period END AS label FROM slots GROUP "
        "BY 1, 2, 3)",
        "t AS (SELECT *, row_number() OVER (PARTITION BY sched, day_idx ORDER BY minute, pos) AS i, count(*) OVER (PARTITION BY sched, day_idx) AS "
        "n FROM h QUALIFY n >= 3)",
        "k AS (SELECT *, lag(label) OVER (PARTITION BY sched, day_idx ORDER BY i) AS before FROM t WHERE label IS NOT NULL)",
        "a AS (SELECT sched, day_idx, coalesce(bool_and(label > before) FILTER (before IS NOT NULL), true) AS ok, min(i) AS ai, arg_min(label, i) "
        "AS al FROM k GROUP BY 1, 2)",
        "r AS (SELECT t.*, coalesce(ok, true) AS ok, CASE WHEN coalesce(ok, true) AND label IS NOT NULL THEN label WHEN ok AND ai IS NOT NULL THEN "
        "al + i - ai ELSE i END AS value FROM t LEFT JOIN a USING (sched, day_idx))",
        "SELECT sched, day_idx, pos, value, ok FROM r WHERE value BETWEEN 1 AND 12",
    ),
    "axis_choice": _q(
        "k AS (SELECT sched, ord % 2 AS o, 2 * count(DISTINCT ord % 6) + 1.5::DOUBLE * count(DISTINCT ord % 7) + count(DISTINCT day_idx) + "
        "count(DISTINCT period) AS score FROM slots GROUP BY 1, 2)",
        "b AS (SELECT sched, coalesce(max(score) FILTER (o = 0), -1.0::DOUBLE) AS rows_score, coalesce(max(score) FILTER (o = 1), -1.0::DOUBLE) AS "
        "columns_score FROM k GROUP BY 1)",
        "SELECT *, CASE WHEN columns_score > rows_score THEN 'days-in-columns' ELSE 'days-in-rows' END AS orientation FROM b",
    ),
    "palette_assignment": _q(
        _KEYED, "f AS (SELECT sched, class_key, arg_min(class_raw, ord) AS label, min(ord) AS o FROM keyed GROUP BY 1, 2)",
        "r AS (SELECT *, row_number() OVER (PARTITION BY sched ORDER BY o) - 1 AS place FROM f)",
        f"SELECT sched, class_key, label, place, {_PALETTE}[(place % 10 + 1)::INT] AS color FROM r",
    ),
    "hour_range": _q(
        _INTERVALS,
        "SELECT sched, day_idx, greatest(0, min(s) // 60) AS start_hour, least(24, greatest(ceil(max(e) / 60)::INT, min(s) // 60 + 1)) AS end_hour "
        "FROM iv GROUP BY 1, 2"
    ),
    "active_days": _q(
        "u AS (SELECT DISTINCT sched, day_idx FROM slots)",
        "SELECT DISTINCT sched, unnest(range(0, 5)) AS day_idx FROM u UNION ALL SELECT sched, day_idx FROM u WHERE day_idx > 4"
    ),
    "interval_clip_layout": _q(
        _INTERVALS,
        "h AS (SELECT sched, day_idx, 60 * (min(s) // 60) AS lo, 60 * least(24, greatest(ceil(max(e) / 60)::INT, min(s) // 60 + 1)) AS hi FROM iv "
        "WHERE s BETWEEN 480 AND 900 GROUP BY 1, 2)",
        "SELECT ord, sched, day_idx, greatest(s, lo) - lo AS top, greatest(least(e, hi) - greatest(s, lo), 36) AS height FROM iv JOIN h USING "
        "(sched, day_idx) WHERE e > lo AND s < hi",
    ),
    "accuracy_score": _q(
        f"f AS (SELECT ord % 2 AS side, sched, day_idx, period, arg_min(class_name, ord) AS name FROM slots WHERE {_VALID} GROUP BY 1, 2, 3, 4)",
        "j AS (SELECT coalesce(a.sched, b.sched) AS sched, a.name AS want, b.name AS got FROM (SELECT * FROM f WHERE side = 0) a FULL JOIN (SELECT "
        "* FROM f WHERE side = 1) b ON a.sched = b.sched AND a.day_idx = b.day_idx AND a.period = b.period)",
        "SELECT sched, count(*) FILTER (want = got) AS correct, count(want) AS expected, count(*) FILTER (want IS NULL) AS extra, round(count(*) "
        "FILTER (want = got) / greatest(1, count(*)), 6) AS accuracy FROM j GROUP BY 1",
    ),
    "clock_extract": r"""WITH m AS (SELECT doc_id, regexp_extract(text, '([0-9]{1,2})[ \t\n\f\r]*[:.][ \t\n\f\r]*([0-9]{2})[ \t\n\f\r]*(ص|م|am|pm)?', ['h', 'm', 's']) AS t FROM documents),
n AS (SELECT doc_id, try_cast(t.h AS INT) AS h, try_cast(t.m AS INT) AS m, t.s AS s FROM m)
SELECT doc_id, (h + CASE WHEN (s IN ('م', 'pm') AND h < 12) OR (s = '' AND h BETWEEN 1 AND 5) THEN 12 ELSE 0 END) * 60 + m AS minutes FROM n WHERE h <= 23 AND m <= 59""",
    "token_letters": r"""SELECT p_partkey, len(list_filter(regexp_split_to_array(p_name, '[ \t\n\f\r/-]+'), lambda t: trim(t, '.:،؛') <> '')) AS n_tokens, regexp_replace(p_name, '[^ء-يa-zA-Z]', '', 'g') AS letters FROM part""",
    "noise_strip": r"""WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM conversations),
p AS (SELECT conv_id, turn, i, regexp_replace(regexp_replace(line, '[0-9]{1,2} *[:.] *[0-9]{2}(?: *(?:ص|م|am|pm))?(?: *- *[0-9]{1,2} *[:.] *[0-9]{2}(?: *(?:ص|م|am|pm))?)?', ' ', 'g'), '[()«»]', ' ', 'g') AS line FROM l),
c AS (SELECT conv_id, turn, i, array_to_string(list_filter(regexp_split_to_array(line, '[ \t\f\r]+'), lambda t: t <> '' AND t NOT IN ('the', 'of', 'and') AND regexp_replace(t, '[^ء-يa-zA-Z]', '', 'g') NOT IN ('the', 'of', 'and')), ' ') AS line FROM p),
k AS (SELECT conv_id, turn, string_agg(line, chr(10) ORDER BY i) FILTER (NOT regexp_full_match(line, '[ \-–—.·]*')) AS clean FROM c GROUP BY 1, 2)
SELECT conv_id, turn, coalesce(clean, '') AS clean FROM k""",
    "json_ingest": "WITH k AS (SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) SELECT event_id, k::BIGINT "
    "AS k FROM k WHERE k = floor(k)",
    "fuzzy_best_match": "WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(p_name), '[ /-]+')) AS text FROM part), lex(key, variant, "
    "o) AS (VALUES "
    + ", ".join(f"('{k}', '{v}', {i})" for i, (k, v) in enumerate(TYPOS))
    + """), s AS (SELECT text, key, variant, o, 1 - damerau_levenshtein(text, variant) / greatest(length(text), length(variant)) AS score FROM w CROSS JOIN lex WHERE text <> '')
SELECT text, key, variant, round(score, 6) AS score FROM s WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY text ORDER BY score DESC, o) = 1""",
    "upper_median": "SELECT o_orderpriority, list_sort(list(o_totalprice))[count(*) // 2 + 1] AS median FROM orders GROUP BY 1",
    "otsu_threshold": f"""WITH {_LEVELS}, c AS (SELECT a.level, sum(b.n) AS wb, sum(b.n * b.level) AS sb FROM levels a JOIN levels b ON b.level <= a.level GROUP BY 1),
t AS (SELECT sum(n) AS total, sum(n * level) AS whole FROM levels),
v AS (SELECT level, round(wb::DOUBLE * (total - wb) * pow(sb / wb - (whole - sb) / (total - wb), 2), 2) AS between_ FROM c, t WHERE total > wb)
SELECT coalesce((SELECT level FROM v WHERE between_ > 0 ORDER BY between_ DESC, level LIMIT 1), 127) AS threshold""",
    "percentile_stretch": f"""WITH {_LEVELS}, c AS (SELECT a.level, sum(b.n) FILTER (b.level <= a.level) AS below, sum(b.n) FILTER (b.level >= a.level) AS above, sum(b.n) AS total FROM levels a CROSS JOIN levels b GROUP BY 1)
SELECT min(level) FILTER (below >= total * 0.02) AS lo, max(level) FILTER (above >= total * (1 - 0.98)) AS hi, max(level) FILTER (above >= total * (1 - 0.98)) - min(level) FILTER (below >= total * 0.02) >= 30 AS stretched FROM c""",
    "peak_islands": _q(
        "p AS (SELECT minute, count(*) AS v FROM slots GROUP BY 1)", "h AS (SELECT * FROM p WHERE v >= (SELECT avg(v) FROM p))", "r AS (SELECT *, "
        "minute - row_number() OVER (ORDER BY minute) AS run FROM h)",
        "SELECT min(minute) AS first, max(minute) AS last, max(v) AS strength, round(sum(minute * v) / sum(v), 6) AS centre FROM r GROUP BY run",
    ),
    "center_clusters": """WITH s AS (SELECT p_retailprice AS v, CASE WHEN p_retailprice - lag(p_retailprice) OVER (ORDER BY p_retailprice) <= 1.5 THEN 0 ELSE 1 END AS cut FROM part),
c AS (SELECT v, sum(cut) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT min(v) AS first, max(v) AS last, count(*) AS n, round(sum(v::DECIMAL(18, 6))::DOUBLE / count(*), 4) AS mean FROM c GROUP BY k""",
    "nearest_center": """WITH d AS (SELECT o_orderkey, o_totalprice AS v, n_nationkey AS idx, abs(o_totalprice - n_nationkey * 20000.0::DOUBLE) AS dist, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(o_totalprice - n_nationkey * 20000.0::DOUBLE), n_nationkey) AS rn FROM orders CROSS JOIN nation)
SELECT idx, count(*) AS n, round(max(dist), 4) AS farthest FROM d WHERE rn = 1 GROUP BY 1""",
    "integral_box_mean": _q(
        _GRID, "SELECT a.y, a.x, round(avg(b.v), 6) AS mean FROM g a JOIN g b ON abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY 1, 2"
    ),
    "dilate_erode_grid": _q(
        _MASK,
        "SELECT a.y, a.x, max(b.v) AS dilated, min(b.v) AS eroded FROM mask a JOIN mask b ON abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY "
        "1, 2"
    ),
    "grid_components": "WITH RECURSIVE "
    + SLOTS_SQL
    + ", "
    + _MASK
    + """, cells AS (SELECT y * 24 + x AS id, y, x FROM mask WHERE v = 1),
reach(id, seen) AS (SELECT id, id FROM cells UNION SELECT r.id, b.id FROM reach r JOIN cells a ON a.id = r.seen JOIN cells b ON abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
lab AS (SELECT id, min(seen) AS label FROM reach GROUP BY 1)
SELECT label, count(*) AS area, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM cells JOIN lab USING (id) GROUP BY 1""",
    "template_dice": """WITH t AS (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS t FROM embeddings GROUP BY 1), e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT vec_id, label, round(2 * list_dot_product(v, t) / (list_dot_product(v, v) + list_dot_product(t, t) + 1e-6), 6) AS score FROM e CROSS JOIN t)
SELECT vec_id, label AS template, score FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) = 1""",
    "cell_spans_to_slots": _q(
        "c AS (SELECT sched, ord, CASE WHEN ord % 5 = 0 THEN '' ELSE class_name END AS name, conf, period - 1 AS r0, day_idx AS c0, ord % 2 + 1 AS "
        "rs, ord % 3 + 1 AS cs FROM slots)",
        "p AS (SELECT sched, ord, name, conf, r, unnest(range(c0, c0 + cs)) AS c FROM (SELECT *, unnest(range(r0, r0 + rs)) AS r FROM c))",
        "t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY sched, r, c ORDER BY ord DESC) = 1)",
        "SELECT sched, c % 7 AS day_idx, r % 12 + 1 AS period, arg_min(name, ord) FILTER (name <> '') AS name, round(avg(conf) FILTER (name <> "
        "''), 6) AS conf, count(*) FILTER (name <> '') AS cells FROM t GROUP BY 1, 2, 3",
    ),
}

ORACLE["flagship"] = _q(
    "s AS (" + "SELECT * FROM (" + ORACLE["cell_spans_to_slots"].replace("WITH " + SLOTS_SQL + ", ", "WITH ", 1) + ") WHERE name IS NOT NULL)",
    r"k AS (SELECT *, regexp_replace(replace(name, '\', '/'), ' *[/-]+ *', '/', 'g') AS class_key, day_idx * 12 + period AS ord FROM s)",
    "b AS (SELECT sched, class_key, arg_min(name, ord) FILTER (conf = top) AS label FROM (SELECT *, max(conf) OVER (PARTITION BY sched, class_key) "
    "AS top FROM k) GROUP BY 1, 2)",
    f"n AS (SELECT sched, count(DISTINCT day_idx) AS days, count(DISTINCT period) AS periods, count(*) AS lessons, count(*) FILTER (conf >= 0.5) "
    f"AS rec, count(*) FILTER (label <> '' AND conf >= 0.35) AS cls FROM k JOIN b USING (sched, class_key) WHERE {_VALID} GROUP BY 1)",
    "q AS (SELECT *, 0.35::DOUBLE * least(1.0::DOUBLE, days / 5) + 0.25::DOUBLE * least(1.0::DOUBLE, periods / 5) + 0.4::DOUBLE * ((0.5::DOUBLE * "
    "rec + 0.5::DOUBLE * cls) / lessons) AS quality FROM n)",
    "SELECT sched, days, periods, lessons, round(quality, 6) AS quality, days >= 3 AND periods >= 3 AND lessons >= 3 AND quality >= 0.45 AS ok "
    "FROM q",
)
