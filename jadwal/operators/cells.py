"""Recognition of cell texts: day, period, class, subject, and the kind of each cell.

Distinct texts are normalised once. Every word that a rule may compare with the lexicon is matched in one join over
distinct words, and the matches come back to each text as a small map from (category, word) to (key, score). The rules
themselves are column expressions over that map, tried in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jadwal.functions import text
from jadwal.functions.columns import let
from jadwal.functions.fuzzy import similar_pairs
from jadwal.functions.lexicon import PERIOD_WORDS, SECTIONS, lexicon
from jadwal.shipping import ship
from jadwal.storage import written

LEAST = 0.5
TIME = r"(?<![A-Za-z0-9_])[0-9]{1,2}[ ]*[:.][ ]*[0-9]{2}(?![A-Za-z0-9_])"
CLOCK_RANGE = r"[0-9]{1,2}[ ]*[:.][ ]*[0-9]{2}(?:[ ]*(?:ص|م|am|pm))?(?:[ ]*-[ ]*[0-9]{1,2}[ ]*[:.][ ]*[0-9]{2}(?:[ ]*(?:ص|م|am|pm))?)?"
SECTION = "ابجدهوزحطي"
AR = "ء-ي"
MATCH = "struct<key:string,score:double>"


def first_of(items: Column, good: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(items, lambda x: good(x)), F.lit(0))


def _best(scored: Column) -> Column:
    """The element with the greatest ``score``, the first of equals; nulls do not count."""
    fine = F.filter(scored, lambda x: x["score"].isNotNull())
    return let(fine, lambda xs: first_of(xs, lambda x: x["score"] == F.array_max(F.transform(xs, lambda y: y["score"]))))


def look(matches: Column, category: str, word: Column, least: Column | float) -> Column:
    """The match of ``word`` in a category, if it scores ``least``."""
    return let(F.element_at(matches, F.concat(F.lit(f"{category}|"), word)), lambda m: F.when(m["score"] >= least, m))


def flat(c: Column) -> Column:
    return F.translate(c, "\n", " ")


def lines_of(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def replace_first(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, rf"^([\s\S]*?){pattern}", "$1 ")


# --- words that the rules look up


def day_words(norm: Column) -> Column:
    plain = F.trim(F.regexp_replace(flat(norm), r"^(?:يوم|اليوم) *", ""))
    return F.array_distinct(F.concat(F.array(text.letters_only(plain)), F.transform(text.tokens(plain), lambda t: text.letters_only(t))))


def period_tokens(line: Column) -> Column:
    s = F.regexp_replace(replace_first(line, TIME), r"(?<![A-Za-z0-9_])(?:am|pm)(?![A-Za-z0-9_])|(?<=[A-Za-z0-9_])[صم](?=[A-Za-z0-9_])", " ")
    bare = F.transform(text.tokens(s), lambda t: F.regexp_replace(F.regexp_replace(t, r"^ح(?=[0-9])", ""), r"(?<=[0-9])ح$", ""))
    freed = F.transform(bare, lambda t: F.when(text.letters_only(t).rlike(r"^(?:ال)?ل?حصه."), F.regexp_replace(t, r"^(?:ال)?ل?حصه", "")).otherwise(t))
    return F.filter(freed, lambda t: ~text.letters_only(t).isin(PERIOD_WORDS))


def stage_words(tokens: Column) -> Column:
    """Letters of every token and of every two neighbours, with and without the last letter, and without glued digits."""
    letters = F.transform(tokens, lambda t: text.letters_only(t))
    pairs = F.transform(letters, lambda t, i: F.concat(t, F.coalesce(F.get(letters, i + 1), F.lit(""))))
    both = F.concat(letters, pairs)
    return F.array_distinct(F.concat(both, F.transform(both, lambda t: F.regexp_replace(t, ".$", ""))))


def phrases(tokens: Column) -> Column:
    """(phrase, first, size) of one to three neighbouring tokens, longer ones first at equal places."""
    place = F.transform(tokens, lambda t, i: i)
    spans = F.flatten(
        F.transform(place, lambda i: F.transform(F.array(*[F.lit(n) for n in (1, 2, 3)]), lambda n: F.struct(i.alias("first"), n.alias("size"))))
    )
    fit = F.filter(spans, lambda s: s["first"] + s["size"] <= F.size(tokens))
    named = F.transform(
        fit,
        lambda s: F.struct(
            F.array_join(
                F.filter(F.transform(F.slice(tokens, s["first"] + 1, s["size"]), lambda t: text.letters_only(t)), lambda t: t != ""), " "
            ).alias("phrase"),
            s["first"].alias("first"), s["size"].alias("size")
        )
    )
    return F.filter(named, lambda p: F.length(F.regexp_replace(p["phrase"], " ", "")) >= 3)


def matched(rows: DataFrame, key: str, words: dict[str, Column]) -> DataFrame:
    """``rows`` (distinct by ``key``) with ``matches``: the best lexicon entry of every word asked for, by category.

    All categories' words are gathered in one pass, and compared with the lexicon once however many texts have them. Texts, words and matches are written
    on the way: what follows reads plain columns, and its plan does not repeat how they came about.
    """
    ship(rows.sparkSession)
    tagged = lambda category, column: F.transform(column, lambda w: F.struct(F.lit(category).alias("category"), w.alias("word")))
    named = [tagged(*item) for item in words.items()]
    asked = rows.select(key, F.explode(F.array_distinct(F.concat(*named))).alias("a")).select(key, "a.*").where("length(word) > 1")
    asked = written(asked, "words")
    pairs = asked.select("category", "word").distinct().join(F.broadcast(lexicon(rows.sparkSession)), "category")
    scored = similar_pairs(pairs, "word", "variant", LEAST)
    best = scored.groupBy("category", "word").agg(F.max_by(F.struct("key", "score"), F.struct("score", -F.col("ord"))).alias("m"))
    entries = asked.join(best, ["category", "word"]).groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "category", "word"), "m"))).alias("__m")
    )
    return written(
        rows.join(entries, key, "left").withColumn("matches", F.coalesce("__m", F.create_map().cast(f"map<string,{MATCH}>"))).drop("__m"), "matches"
    )


# --- rules


def match_day(norm: Column, matches: Column) -> Column:
    return _best(
        F.transform(
            F.filter(day_words(norm), lambda w: F.length(w) >= 3), lambda w: look(matches, "day", w, F.when(F.length(w) <= 4, 0.75).otherwise(0.66))
        )
    )


def _period(key: Column, score: Column | float) -> Column:
    n = key.cast("int")
    return F.when(
        n.between(1, 12),
        F.struct(n.alias("period"), F.lit(score).cast("double").alias("score") if isinstance(score, float) else score.alias("score"))
    )


def _ordinal(toks: Column, matches: Column, size: int, least: float) -> Column:
    return _best(
        F.transform(
            F.filter(F.transform(toks, lambda t: text.letters_only(t)), lambda w: F.length(w) >= size), lambda w: look(matches, "ordinal", w, least)
        )
    )


def match_period_line(line: Column, matches: Column) -> Column:
    number = r"^[0-9]{1,2}$"

    def rules(toks: Column) -> Column:
        strong, weak = _ordinal(toks, matches, 4, 0.72), _ordinal(toks, matches, 3, 0.7)
        digit = first_of(toks, lambda t: t.rlike(number))
        only = (F.size(toks) == 1) & F.get(toks, F.lit(0)).rlike(number)
        return (
            F.when(strong.isNotNull() & (F.size(toks) <= 4), _period(strong["key"], strong["score"]))
            .when(only, _period(digit, 0.95))
            .when(weak.isNotNull() & (F.size(toks) <= 3), _period(weak["key"], weak["score"]))
            .when(digit.isNotNull() & F.contains(line, F.lit("حص")) & digit.cast("int").between(1, 12), _period(digit, 0.85))
            .otherwise(_period(weak["key"], weak["score"]))
        )

    return let(period_tokens(line), rules)


def match_period(norm: Column, matches: Column) -> Column:
    """Of several lines the first that is a period on its own."""
    found = F.filter(F.transform(lines_of(norm), lambda x: match_period_line(x, matches)), lambda p: p.isNotNull())
    return F.get(found, F.lit(0))


def _section(letter: Column) -> Column:
    shown = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])
    return F.coalesce(F.element_at(shown, F.lower(letter)), letter)


def _class(name: Column, score: float, rest: Column) -> Column:
    return F.struct(name.alias("name"), F.lit(score).alias("score"), rest.alias("rest"))


def digit_class(line: Column) -> Column:
    """Forms with digits: 2/b, b/2, 3/1, 2b or b2, in this order."""
    sep, letter = r" *[/-] *", f"[{SECTION}a-fA-F]"
    forms = [
        (rf"(?<![0-9])([0-9]{{1,2}}){sep}({letter})(?![{AR}a-zA-Z])", True, 1.0), (
            rf"(?<![{AR}a-zA-Z])({letter}){sep}([0-9]{{1,2}})(?![0-9])", False, 0.95
        ),
        (r"(?<![0-9])([0-9]{1,2}) *[/-] *([0-9]{1,2})(?![0-9])", None, 0.85),
        (rf"(?<![0-9{AR}])([0-9]{{1,2}}) ?([{SECTION}])(?![{AR}])", True, 0.65), (
            rf"(?<![{AR}])([{SECTION}]) ?([0-9]{{1,2}})(?![0-9{AR}])", False, 0.65
        ),
    ]
    out = []
    for pattern, digit_first, score in forms:
        a, b = F.regexp_extract(line, pattern, 1), F.regexp_extract(line, pattern, 2)
        grade, part = (a, b) if digit_first in (True, None) else (b, a)
        shown = text.to_arabic_digits(part.cast("int")) if digit_first is None else _section(part)
        fits = grade.cast("int").between(1, 12) & (part.cast("int").between(1, 20) if digit_first is None else F.lit(True))
        out.append(
            F.when(
                (a != "") & fits, _class(F.concat(text.to_arabic_digits(grade.cast("int")), F.lit("/"), shown), score, replace_first(line, pattern))
            )
        )
    return F.coalesce(*out)


def _worded(grade: Column, stage: Column, section: Column) -> Column:
    head = F.concat_ws(" ", grade, stage)
    return F.when(section.isNull(), head).when(section.rlike("^[٠-٩0-9]+$"), F.concat(head, F.lit("/"), section)).otherwise(
        F.concat(head, F.lit(" "), section)
    )


def _tok(toks: Column, i: Column | int) -> Column:
    return F.coalesce(F.get(toks, i if isinstance(i, Column) else F.lit(i)), F.lit(""))


def match_stage(toks: Column, i: Column, matches: Column) -> Column:
    """(stage, section, used) of the stage word at place ``i``, perhaps with its section glued to it or cut in two."""
    raw = _tok(toks, i)

    def one(word: Column, used: int) -> Column:
        head, digits = (F.regexp_extract(raw, rf"^([{AR}]+)([0-9]{{1,2}})$", g) for g in (1, 2))
        glued = look(matches, "stage", head, 0.75)
        last = F.substring(word, -1, 1)
        short = look(matches, "stage", F.regexp_replace(word, ".$", ""), 0.9)
        whole = look(matches, "stage", word, 0.75)
        make = lambda m, section: F.struct(m["key"].alias("stage"), section.cast("string").alias("section"), F.lit(used).alias("used"))
        tries = [
            F.when((F.length(word) > 3) & last.rlike(f"[{SECTION}]") & short.isNotNull(), make(short, _section(last))),
            F.when((F.length(word) > 1) & whole.isNotNull(), make(whole, F.lit(None)))
        ]
        if used == 1:
            tries.insert(0, F.when((head != "") & glued.isNotNull(), make(glued, text.to_arabic_digits(digits))))
        return F.coalesce(*tries)

    here, after = text.letters_only(raw), text.letters_only(_tok(toks, i + 1))
    return F.coalesce(one(here, 1), F.when(after != "", one(F.concat(here, after), 2)))


def _without(toks: Column, start: Column, end: Column) -> Column:
    """Tokens outside [start, end), as text."""
    return F.array_join(F.concat(F.slice(toks, F.lit(1), start), F.slice(toks, end + 1, F.greatest(F.size(toks) - end, F.lit(0)))), " ")


def worded_class(s: Column, matches: Column, bare_allowed: bool = False) -> Column:
    """Forms in words: [class] grade [stage] [section]; else a garbled grade before a stage word."""
    small = lambda c: c.rlike("^[0-9]{1,2}$") & (c.cast("int") <= 20)

    def at(toks: Column, i: Column) -> Column:
        word = text.letters_only(_tok(toks, i))
        grade = look(matches, "grade", word, 0.8)
        titled = (i > 0) & text.letters_only(_tok(toks, i - 1)).rlike("^(?:ال)?صف$")
        start = F.when(titled, i - 1).otherwise(i)
        bare = ~word.startswith("ال") & ~word.endswith("ه")
        glued = F.regexp_extract(_tok(toks, i), rf"^[{AR}]+([0-9]{{1,2}})$", 1)
        after = _tok(toks, i + 1)

        def with_stage(st: Column) -> Column:
            used = 1 + F.coalesce(st["used"], F.lit(0))
            nxt = F.when(st["section"].isNull(), _tok(toks, i + used)).otherwise("")
            letter, number = nxt.rlike(f"^[{SECTION}]$"), small(nxt) & (st.isNotNull() | bare)
            section = F.coalesce(st["section"], F.when(letter, _section(nxt)).when(number, text.to_arabic_digits(nxt)))
            end = i + used + F.when(letter | number, 1).otherwise(0)
            named = _worded(grade["key"], st["stage"], section)
            alone = st.isNull() & section.isNull() & ~titled
            score = F.when(st.isNotNull() | section.isNotNull(), 0.95).otherwise(0.75)
            full = F.struct(named.alias("name"), score.alias("score"), _without(toks, start, end).alias("rest"))
            return F.when(~alone, full).when(F.lit(bare_allowed), _class(grade["key"], 0.6, _without(toks, i, i + 1)))

        direct = F.when(
            (glued != "") & ~word.startswith("ال"),
            _class(_worded(grade["key"], F.lit(None), text.to_arabic_digits(glued)), 0.9, _without(toks, start, i + 1))
        )
        stage = match_stage(toks, i + 1, matches)
        number = F.when(
            stage.isNull() & bare & small(after),
            _class(_worded(grade["key"], F.lit(None), text.to_arabic_digits(after)), 0.95, _without(toks, start, i + 2))
        )
        return F.when((word != "") & grade.isNotNull(), F.coalesce(direct, number, let(stage, with_stage)))

    def rescued(toks: Column, i: Column) -> Column:
        back = F.transform(
            F.array(*[F.lit(k) for k in (1, 2, 3)]),
            lambda k: F.struct(
                look(
                    matches, "grade",
                    F.when((i - k >= 0) & (F.length(text.letters_only(_tok(toks, i - k))) >= 2), text.letters_only(_tok(toks, i - k))).otherwise(""),
                    0.5
                ).alias("g"),
                (i - k).alias("at")
            )
        )

        def build(st: Column) -> Column:
            grade = first_of(back, lambda b: b["g"].isNotNull())
            nxt = F.when(st["section"].isNull(), _tok(toks, i + st["used"])).otherwise("")
            letter, number = nxt.rlike(f"^[{SECTION}]$"), small(nxt)
            section = F.coalesce(st["section"], F.when(letter, _section(nxt)).when(number, text.to_arabic_digits(nxt)))
            end = i + st["used"] + F.when(letter | number, 1).otherwise(0)
            return F.when(
                st.isNotNull() & grade.isNotNull(), _class(_worded(grade["g"]["key"], st["stage"], section), 0.6, _without(toks, grade["at"], end))
            )

        return let(match_stage(toks, i, matches), build)

    def rules(toks: Column) -> Column:
        found = F.filter(F.transform(toks, lambda t, i: at(toks, i)), lambda c: c.isNotNull())
        saved = F.filter(F.transform(toks, lambda t, i: F.when(i >= 1, rescued(toks, i))), lambda c: c.isNotNull())
        return F.coalesce(F.get(found, F.lit(0)), F.get(saved, F.lit(0)))

    return let(text.tokens(s), rules)


def parse_class(norm: Column, matches: Column, bare_allowed: bool = False) -> Column:
    """(name, score, rest): words win when a stage or class word is there, or with the better score."""
    s = flat(norm)
    ls = lines_of(norm)

    def of_line(line: Column, i: Column) -> Column:
        others = lambda d: F.concat(F.slice(ls, F.lit(1), i), F.array(d["rest"]), F.slice(ls, i + 2, F.size(ls)))
        whole = lambda d: F.struct(d["name"].alias("name"), d["score"].alias("score"), F.array_join(others(d), " ").alias("rest"))
        return let(digit_class(line), lambda d: F.when(d.isNotNull(), whole(d)))

    digits = F.when(F.size(ls) > 1, _best(F.transform(ls, of_line))).otherwise(digit_class(s))
    readings = [digits.alias("d"), worded_class(s, matches).alias("w")] + ([worded_class(s, matches, True).alias("b")] if bare_allowed else [])

    def chosen(x: Column) -> Column:
        words = x["b" if bare_allowed else "w"]
        better = words.isNotNull() & (x["d"].isNull() | (words["score"] > x["d"]["score"]))
        return F.when(s.rlike("متوسط|ابتدائ|ثانوي|صف") & x["w"].isNotNull(), x["w"]).when(better, words).otherwise(x["d"])

    return let(F.struct(*readings), chosen)


def match_subject(s: Column, matches: Column) -> Column:
    """(key, score, rest): the best phrase; of equals the longer one."""

    def rules(toks: Column) -> Column:
        scored = F.transform(
            phrases(toks),
            lambda p: let(
                look(matches, "subject", p["phrase"], F.when(F.length(p["phrase"]) <= 4, 0.8).otherwise(0.72)),
                lambda m: F.struct(
                    (m["score"] + p["size"] * 1e-9).alias("score"), m["key"].alias("key"), m["score"].alias("plain"), p["first"].alias("first"),
                    p["size"].alias("size")
                )
            )
        )
        return let(
            _best(scored),
            lambda b: F.when(
                b.isNotNull(),
                F.struct(b["key"].alias("key"), b["plain"].alias("score"), _without(toks, b["first"], b["first"] + b["size"]).alias("rest"))
            )
        )

    return let(text.tokens(flat(s)), rules)


def standby(cleaned: Column, matches: Column) -> Column:
    word, number = (F.regexp_extract(F.trim(flat(cleaned)), rf"^(?:حصه *)?([{AR}]{{3,8}}) *([0-9]{{1,2}})?$", g) for g in (1, 2))
    fits = look(matches, "standby", word, F.when(number != "", 0.5).otherwise(0.6)).isNotNull()
    return F.when((word != "") & fits, F.when(number != "", F.concat(F.lit("منتظر "), text.to_arabic_digits(number))).otherwise("انتظار"))


def labels(texts: DataFrame, body: str) -> DataFrame:
    """For each distinct text what it is as a label: ``body``, name (of a class or standby, bare grades allowed), class_name and
    class_score (bare grades not allowed), period, period_score, day, day_score, subject, subject_score, timed, letters, numbered."""
    ship(texts.sparkSession)
    t = written(
        texts.select(F.col(body).alias("raw")).where(F.col(body).isNotNull()).distinct().withColumn("norm", text.normalize_arabic(F.col("raw"))),
        "texts"
    )
    norm, toks = F.col("norm"), text.tokens(flat(F.col("norm")))
    words = F.transform(toks, lambda x: text.letters_only(x))
    found = matched(t, "raw", {
        "day": day_words(norm), "ordinal": F.flatten(
            F.transform(lines_of(norm), lambda x: F.transform(period_tokens(x), lambda p: text.letters_only(p)))
        ), "grade": words, "stage": stage_words(toks),
        "standby": F.array(
            F.regexp_extract(F.trim(flat(norm)), rf"^(?:حصه *)?([{AR}]{{3,8}}) *([0-9]{{1,2}})?$", 1)
        ), "subject": F.transform(phrases(toks), lambda p: p["phrase"]),
    })
    m = F.col("matches")
    read = found.select(
        "raw", "norm", standby(norm, m).alias("w"), parse_class(norm, m, True).alias("b"), parse_class(norm, m).alias("c"),
        match_period(norm, m).alias("p"), match_day(norm, m).alias("d"), match_subject(norm, m).alias("s")
    )
    return read.select(
        F.col("raw").alias(body), F.coalesce("w", "b.name").alias("name"), F.col("c.name").alias("class_name"), F.col("c.score").alias("class_score"), "p.period", F.col("p.score").alias("period_score"), F.col(
            "d.key"
        ).alias("day"),
        F.col("d.score").alias("day_score"), F.col("s.key").alias("subject"), F.col("s.score").alias("subject_score"), norm.rlike(
            "[0-9]{1,2}[:.][0-9]{2}"
        ).alias("timed"),
        F.length(F.regexp_replace(norm, f"[^{AR}]", "")).alias("letters"), norm.rlike("[0-9]").alias("numbered"),
    )


def classify(cells: DataFrame, body: str = "text", ocr: str = "ocr_confidence") -> DataFrame:
    """``cells`` with kind, day, period, class_name, subject, room, minutes and parse_confidence.

    The rules and their order follow the timetable rules; null texts are empty. Cells with one text are recognised
    once. OCR confidence is 0 to 100.
    """
    ship(cells.sparkSession)
    texts = cells.select(F.col(body).alias("raw")).distinct().withColumn("plain", text.nfkc(F.col("raw")))
    by_line = F.transform(F.split(F.coalesce("plain", F.lit("")), "\n"), lambda x: text.strip_noise(text.fold(x)))
    texts = texts.select(
        "raw", F.sha2(F.coalesce("raw", F.lit("\x00")), 256).alias("id"), text.fold(F.col("plain")).alias("norm"), by_line.alias("line_norms")
    )
    texts = written(texts.withColumn("cleaned", text.strip_noise(F.col("norm"))), "texts")
    norm, cleaned = F.col("norm"), F.col("cleaned")
    toks = text.tokens(flat(cleaned))
    first = matched(texts, "id", {
        "day": day_words(norm), "ordinal": F.flatten(
            F.transform(lines_of(norm), lambda x: F.transform(period_tokens(x), lambda t: text.letters_only(t)))
        ),
        "grade": F.transform(toks, lambda t: text.letters_only(t)), "stage": stage_words(toks), "header": F.array(text.letters_only(flat(norm))),
        "standby": F.array(F.regexp_extract(F.trim(flat(cleaned)), rf"^(?:حصه *)?([{AR}]{{3,8}}) *([0-9]{{1,2}})?$", 1)),
    })
    m = F.col("matches")
    first = first.select(
        "id", "raw", "norm", "cleaned", "line_norms", match_day(norm, m).alias("d"), match_period(norm, m).alias("p"),
        parse_class(cleaned, m).alias("c"), worded_class(flat(cleaned), m, True).alias("bare"), standby(cleaned, m).alias("standby"),
        look(m, "header", text.letters_only(flat(norm)), 0.8).isNotNull().alias("header")
    )
    first = written(first.withColumn("rest", F.coalesce("c.rest", "cleaned")), "read-texts")
    second = matched(first, "id", {"subject": F.transform(phrases(text.tokens(flat(F.col("rest")))), lambda p: p["phrase"])})
    t = second.withColumn("s", match_subject(F.col("rest"), F.col("matches"))).drop("matches")
    lone = F.col("c").isNull() & F.col("s").isNotNull() & F.contains("cleaned", F.lit("\n"))
    t = written(t.withColumn("c", F.coalesce("c", F.when(lone, F.col("bare")))), "cell-texts")
    joined = cells.withColumn("id", F.sha2(F.coalesce(body, F.lit("\x00")), 256)).join(t.drop("raw"), "id")

    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(ocr) / 100))
    size, c, s, d, p = F.size(toks), F.col("c"), F.col("s"), F.col("d"), F.when(F.col("c").isNull(), F.col("p"))
    day_score, period_score = F.coalesce(d["score"], F.lit(0.0)), F.coalesce(p["score"], F.lit(0.0))
    time, letters = text.first_time(norm), F.length(text.letters_only(norm))
    long_words = F.size(F.filter(toks, lambda x: F.length(text.letters_only(x)) >= 3))
    remainder = F.coalesce(s["rest"], c["rest"])
    room = F.regexp_extract(remainder, rf"((?:غرفه|قاعه|معمل|مختبر|مصدر|فصل) *(?:[0-9]{{1,3}}|[{AR}]{{1,6}})?)", 1)
    left = F.filter(text.tokens(flat(remainder)), lambda x: (F.length(text.letters_only(x)) >= 2) | x.rlike("^[0-9]+$"))
    def as_read(words: Column) -> Column:
        """The first line that holds all the words, else the words."""
        spelled = F.array_join(words, " ")
        raw = F.split(F.coalesce(body, F.lit("")), "\n")
        whole = F.get(F.filter(raw, lambda x, i: F.forall(words, lambda w: F.contains(F.get(F.col("line_norms"), i), w))), F.lit(0))
        return F.when(
            F.length(text.letters_only(spelled)) >= 3, F.substring(F.trim(F.regexp_replace(F.coalesce(whole, spelled), CLOCK_RANGE, "")), 1, 60)
        )

    title = let(left, as_read)
    no_digit = ~norm.rlike("[0-9]")

    def cell(kind: str, score: Column | float, **values: Column) -> Column:
        types = {"day": "string", "period": "int", "class_name": "string", "subject": "string", "room": "string", "minutes": "int"}
        return F.struct(
            F.lit(kind).alias("kind"), (F.lit(score) if isinstance(score, float) else score).cast("double").alias("parse_confidence"),
            *[(values[k] if k in values else F.lit(None)).cast(v).alias(k) for k, v in types.items()]
        )

    rules = [
        (~text.has_content(norm), cell("empty", 1.0)),
        (F.col("standby").isNotNull(), cell("lesson", 0.9, class_name=F.col("standby"))),
        (F.col("header") & c.isNull() & s.isNull(), cell("other", 0.9)),
        (d.isNotNull() & (size <= 3) & c.isNull() & (day_score >= period_score), cell("day", d["score"], day=d["key"])),
        ((day_score >= 0.85) & (long_words <= 1) & s.isNull(), cell("day", d["score"] * 0.9, day=d["key"])),
        (p.isNotNull() & s.isNull() & (size <= 4), cell("period", p["score"], period=p["period"], minutes=time)),
        (
            c.isNotNull(),
            cell(
                "lesson", F.least(F.lit(1.0), c["score"] * 0.85 + F.when(s.isNotNull(), 0.15).otherwise(0.1)), class_name=c["name"],
                subject=F.coalesce(s["key"], title), room=F.when(room != "", F.trim(room))
            )
        ),
        (s.isNotNull(), cell("lesson", s["score"] * 0.7, subject=s["key"])),
        (norm.rlike(TIME) & (letters <= 2), cell("other", 0.9, minutes=time)),
        (no_digit & (letters <= 3), cell("empty", 0.6)),
        ((sure < 0.45) & no_digit, cell("empty", 0.4)),
    ]
    decided = F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), value) for test, value in rules], cell("other", 0.3, minutes=time))
    return joined.withColumn("__cell", decided).select(*cells.columns, "norm", sure.alias("ocr"), "__cell.*")
