"""The text-preparation operators against brute force, on small and awkward tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from jadwal.llm import ann, components, decontaminate, near_dedup, packing, pii, sharding, suffix_array, suffix_dedup, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, h string"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


PASSAGE = words(1, 60)
LONG = words(2, 9000)
ROWS = [
    (1, words(3, 80)),
    (2, words(3, 80)),
    (3, words(3, 80).replace(" ", "  ", 3) + " tail"),
    (4, PASSAGE),
    (5, "start " + PASSAGE + " end"),
    (6, None),
    (7, ""),
    (8, "two words"),
    (9, "Two  words"),
    (10, LONG),
    (11, LONG[:20000] + " other " + LONG[20000:]),
    (12, "mail bob.x@mail.example.com, 10.20.30.40 or +1 (425) 555-0100, card 4111 1111 1111 1111."),
    (13, "Zürich émotion – 你好 " + "é" * 60),
    (14, "x " + "é" * 60),
    (15, "a" * 120),
    (16, "b" + "a" * 110),
    (17, "Licensed under the Apache License, Version 2.0.\nAll rights reserved."),
    (None, PASSAGE),
    (5, "start " + PASSAGE + " end"),
]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, 1, "clash") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return docs_of(spark, ROWS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


# --- near duplicates


def plain_set(text, width):
    """Shingles as tuples of words, by the contract's own rule."""
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)} or ({tuple(ws)} if ws else set())


def brute_components(rows, width, percent):
    sets = defaultdict(list)
    for i, t in rows:
        if i is not None:
            sets[i].append(plain_set(t, width))
    best = {i: i for i in sets}
    link = {(a, b) for a in sets for b in sets if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b])}
    changed = True
    while changed:
        changed = False
        for a, b in link:
            if best[a] != best[b]:
                best[a] = best[b] = min(best[a], best[b])
                changed = True
    return best


@pytest.mark.parametrize(("width", "percent", "long"), [(3, 85, 64), (5, 80, 2)])
def test_near_duplicates(docs, width, percent, long):
    got = near_dedup.near_duplicates(docs, width, percent, long=long).collect()
    want = brute_components(ROWS, width, percent)
    assert len(got) == len(ROWS)
    for r in got:
        assert r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]])
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])
    sizes = {(i, len(plain_set(t, width))) for i, t in ROWS}
    assert {(r["doc_id"], r["n_shingles"]) for r in got} == sizes


def test_near_duplicates_in_long_lists(spark):
    r = random.Random(5)
    base = words(7, 150).split()
    rows = []
    for i in range(90):
        ws = list(base)
        for _ in range(r.randint(0, 9)):
            ws[r.randrange(len(ws))] = f"new{r.randrange(10**6)}"
        rows.append((i, " ".join(ws)))
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(docs_of(spark, rows), 3, 85, long=6).collect()}
    assert got == brute_components(rows, 3, 85)


def test_near_duplicates_without_broadcasts_and_in_small_blocks(spark, monkeypatch):
    """Documents of a frequent part and an own part of any share, some linked only through long lists."""
    for name, value in (("BROADCAST_ROWS", -1), ("BLOCK", 16), ("MEMBERS", 3), ("BUCKET_SHINGLES", 2_000), ("SALTS", 3)):
        monkeypatch.setattr(near_dedup, name, value)
    r = random.Random(6)
    common = [words(70 + j, 120).split() for j in range(3)]
    rows = []
    for i in range(120):
        ws = list(r.choice(common))
        own = words(5000 + i, r.choice([0, 3, 20, 30, 60, 120])).split()
        for _ in range(r.choice([0, 0, 1, 4])):
            ws[r.randrange(len(ws))] = f"new{r.randrange(10**6)}"
        rows.append((i, " ".join(own + ws)))
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(docs_of(spark, rows), 5, 80, long=8).collect()}
    assert got == brute_components(rows, 5, 80)


def test_the_chance_of_a_missed_pair():
    assert near_dedup.miss_bound(0.8) < 1e-6 and near_dedup.miss_bound(0.85) < 1e-6


def test_shingles_follow_the_word_rule():
    of = near_dedup.Shingler(3)
    assert len(of("a b")) == 1 and len(of("")) == len(of(None)) == len(of(" \t")) == 0
    assert np.array_equal(of("A B\x0bC"), of("a b c")) and not np.array_equal(of("É b c"), of("é b c"))
    assert len(of("a b\xa0c d")) == 1


def test_near_duplicates_of_nothing(empty):
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.deduplicated(empty).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (7, 3), (20, 21), (None, 4)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 5: 5, 20: 20, 21: 20}
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["label"] for r in components.components(chain).collect()} == {0}


# --- suffix arrays


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    for n, sigma in ((4, 2), (60, 3), (500, 4), (800, 1)):
        s = np.append(rng.integers(1, sigma + 1, n), 0).astype("u2")
        plain = s.tolist()
        want = sorted(range(n + 1), key=lambda i: plain[i:])
        order = suffix_array.suffix_array(s, sigma + 1)
        assert order.tolist() == want
        shared = suffix_array.permuted_common_prefixes(s, order, n + 1)
        for a, b in zip(want, want[1:], strict=False):
            k = 0
            while plain[a + k : a + k + 1] == plain[b + k : b + k + 1] and a + k <= n and b + k <= n:
                k += 1
            assert shared[b] == k


def doubled(s):
    """Suffix order by ranks of doubled prefixes."""
    n, size, rank = len(s), 1, np.unique(s, return_inverse=True)[1].astype("i8")
    while True:
        after = np.zeros(n, "i8")
        after[: max(0, n - size)] = rank[size:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        rank = np.zeros(n, "i8")
        rank[order] = np.cumsum(np.append(0, np.diff(key[order]) != 0))
        size *= 2
        if rank[order[-1]] == n - 1:
            return order


@pytest.mark.parametrize(("n", "sigma", "names"), [(150_000, 200, 20_000), (30_000, 2, 0), (20_000, 5_000, 0)])
def test_suffix_array_of_wide_alphabets(n, sigma, names, monkeypatch):
    seen = []
    plain = suffix_array._induce_by_place
    monkeypatch.setattr(suffix_array, "_induce_by_place", lambda s, low, seeds, sigma: seen.append(sigma) or plain(s, low, seeds, sigma))
    r = np.random.default_rng(n)
    s = r.integers(1, sigma + 1, n)
    s[n // 2 : n // 2 + n // 4] = s[: n // 4]
    s = np.append(s, 0)
    assert np.array_equal(suffix_array.suffix_array(s, sigma + 1), doubled(s)) and max(seen, default=0) >= names


def test_an_anchor_with_many_contexts_never_meets_in_one_group(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 1 << 18)
    r = random.Random(8)
    letters = "abcdefghij"
    phrases = ["".join(r.choice(letters) for _ in range(24)) for _ in range(20_000)]
    data = np.frombuffer("".join(phrases).encode(), "u1")
    phrase = phrases[int(suffix_dedup.Grams(data).at(24)[::24].argmin())]
    rows = []
    for i in range(30_000):
        left, right = ("".join(r.choice(letters) for _ in range(28)) for _ in range(2))
        if i % 50 == 0 and rows:  # a window that an earlier document has
            left, right = left[:10] + rows[-7 if len(rows) > 7 else 0][1][10:28], rows[-7 if len(rows) > 7 else 0][1][52:70] + right[:5]
        rows.append((i, left + phrase + right))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    base = table.withColumn("tid", F.hash("text"))
    heavy = suffix_dedup.heavy_anchors(base, 5000, 50, 24)
    assert len(heavy) == 1
    places = suffix_dedup._entries(base, 8, heavy, 50, 24).where("place >= 0").groupBy("place").agg(F.sum(F.size("low")).alias("n"))
    assert places.agg(F.max("n")).first()[0] < 15_000  # the anchor alone has 30,000
    want = brute_removal(rows)
    assert sum(w[2] for w in want) > 20_000
    for most in (suffix_dedup.DEALT_CONTEXTS, 2000):
        monkeypatch.setattr(suffix_dedup, "DEALT_CONTEXTS", most)
        assert sorted((tuple(x) for x in suffix_dedup.without_repeats(table).collect()), key=str) == want


def test_heavy_anchor_of_single_contexts(spark):
    """An anchor with one new context in each of many batches is found, and the limit does not depend on how many texts there are."""
    r = random.Random(5)
    phrases = ["".join(r.choice("klmnop") for _ in range(24)) for _ in range(20_000)]
    phrase = phrases[int(suffix_dedup.Grams(np.frombuffer("".join(phrases).encode(), "u1")).at(24)[::24].argmin())]
    rows = [(i, "".join(r.choice("klmnop") for _ in range(26)) + phrase + "".join(r.choice("klmnop") for _ in range(26))) for i in range(2400)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(80)
    base = table.withColumn("tid", F.hash("text"))
    everywhere = suffix_dedup.heavy_anchors(base, 300, 50, 24, part=1)
    assert len(everywhere) >= 1 and set(suffix_dedup.heavy_anchors(base, 300, 50, 24)) <= set(suffix_dedup.heavy_anchors(base, 100, 50, 24, part=1))
    assert set(everywhere) & set(suffix_dedup.heavy_anchors(base, 300, 50, 24))


def brute_removal(rows, span=50):
    first: dict[bytes, int] = {}
    for i, t in rows:
        raw = (t or "").encode()
        if i is not None:
            for j in range(len(raw) - span + 1):
                w = raw[j : j + span]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for j in range(len(raw) - span + 1 if i is not None else 0):
            if first[raw[j : j + span]] < i:
                gone[j : j + span] = b"\1" * span
        runs = sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1]))
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out.append((i, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("many", [5000, 1])
def test_suffix_dedup(docs, many):
    got = suffix_dedup.without_repeats(docs, many=many).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_removal(ROWS)


def test_suffix_dedup_of_nothing(empty):
    assert suffix_dedup.without_repeats(empty).count() == 0


# --- decontamination


def test_decontamination(spark, docs, empty):
    items = [(100, PASSAGE), (101, words(50, 40)), (102, "TWO words"), (106, "reserved"), (107, "two  words too"), (108, "?"), (103, None), (None, PASSAGE), (104, " ".join(LONG.split()[4000:4040])), (105, " ".join(PASSAGE.split()[:50] + words(9, 10).split()))]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(5))
    pairs = {(r["doc_id"], r["item_id"]): r["containment"] for r in decontaminate.contained_items(docs, benchmark).collect()}
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    runs = lambda ws, n: {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}
    want = {}
    for i, t in ROWS:
        for item in {k for k, _ in items if k is not None}:
            asked = set().union(*[runs(ws, min(5, len(ws))) for k, body in items if k == item for ws in [split(body)] if ws])
            held = set().union(*[runs(split(t), n) for n in range(1, 6)])
            if i is not None and asked and len(asked & held) / len(asked) >= 0.8:
                want[i, item] = round(len(asked & held) / len(asked), 6)
    assert pairs == want and {(4, 100), (5, 100), (10, 104), (11, 104), (8, 102), (9, 102), (17, 106)} <= set(want)
    left = [r["doc_id"] for r in decontaminate.decontaminated(docs, benchmark).collect()]
    assert sorted(left, key=str) == sorted((i for i, _ in ROWS if i not in {d for d, _ in want}), key=str)
    assert decontaminate.contained_items(docs, benchmark.limit(0)).count() == decontaminate.contained_items(empty, benchmark).count() == 0


# --- packing


def test_packing_round_trip(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    exact = Tokenizer.from_file(path)
    with_ids = packing.token_pieces(docs, path, with_ids=True).collect()
    packed = packing.pack_documents(docs).collect()
    want = defaultdict(list)
    for i, t in ROWS:
        want[i].append([*exact.encode(t or "", add_special_tokens=False).ids, 1])
    got = defaultdict(list)
    for r in with_ids:
        got[r["doc_id"]].append((r["start"], r["ids"]))
    for i, wanted in want.items():
        assert sorted(got[i]) == sorted((s, ids[s : s + 2048]) for ids in wanted for s in range(0, len(ids), 2048))
    assert sorted((str(r["doc_id"]), r["start"], r["ids_crc32"]) for r in packed) == sorted((str(r["doc_id"]), r["start"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in with_ids)
    at = defaultdict(list)
    for r in packed:
        assert 0 < r["length"] <= 2048
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in at.values():
        end = 0
        for offset, n in sorted(pieces):
            assert offset == end
            end += n
        assert end <= 2048


@pytest.mark.parametrize("text", ["don't STOP", "naïve café", "ÀÉ x1y2", "a\x01b c", "Σίσυφος", "1234567", "#*&%! ok...", "\u00a0x\u2003y", "<|endoftext|> z", "e\u0301"])
def test_words_encode_as_the_tokenizer_does(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    assert np.frombuffer(packing.tokenizer(path).encode([text])[0], "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_any_characters_encode_as_the_tokenizer_does(monkeypatch):
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    signs = "' 's 're 've 'll 'LL 'd 't 'm '' s r e v l \x01 \x02 \0 <| |> <|endoftext|> <|startoftext|> <|ENDOFTEXT|> Σ ς İ ẞ é \u0301 \u0345 Ⓐ Ⅷ ½ 9 12 日本 ก็ 한 😀 Å Ω ﬁ - ... \u088f \u1c89 \ua7cb \U000105c9 \U00016d40".split(" ")
    r = random.Random(5)
    texts = ["".join(r.choice([*signs, " ", "\n", "\t", "\x1c", "\x85", "\u3000"]) for _ in range(r.randrange(30))) for _ in range(4000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    tok = packing.WordTokenizer(path)
    assert tok.encode(texts) == want
    monkeypatch.setattr(packing, "LONG", 10)  # in parts
    assert tok.encode(texts) == want
    assert tok.encode([]) == [] and tok.encode([None, "", "a"])[:2] == [b"", b""]


def test_a_pre_token_is_encoded_once(monkeypatch):
    import public_tokenizers

    tok = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    learned: list = []
    monkeypatch.setattr(tok, "learn", lambda words, learn=tok.learn: (learned.extend(words), learn(words)))
    tok.encode(["Stone, stone; STONE. (stone) stone's"])
    tok.encode(["A stone."])
    assert sorted(learned) == sorted(b"stone , ; . ( ) 's a".split())


def test_first_fit_decreasing():
    r = np.random.default_rng(3)
    lengths = r.integers(1, 100, 300)
    sequence, offset = packing.first_fit_decreasing(lengths, 100)
    bins: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):
        k = next((k for k, used in enumerate(bins) if used + lengths[i] <= 100), len(bins))
        bins[k:] = bins[k:] or [0]
        assert (sequence[i], offset[i]) == (k, bins[k])
        bins[k] += lengths[i]


def test_packing_does_not_depend_on_files(spark, monkeypatch):
    monkeypatch.setattr(packing, "REPEATS", 20)
    rows = [(i % 150, 0, 1 + i * 37 % 900, i % 150, 1) for i in range(300)] + [(7, 0, 260, 7, 1)] * 90
    one = spark.createDataFrame(rows, packing.PIECES).coalesce(1)
    other = spark.createDataFrame(rows[::-1], packing.PIECES).repartition(5)
    a, b = (sorted(map(tuple, packing.pack(t, group_pieces=64).collect())) for t in (one, other))
    assert a == b and len(a) == len(rows)


def test_packing_of_nothing(empty):
    assert packing.pack_documents(empty).count() == 0


# --- sharding


def test_sharding_law_and_slots(docs, empty, spark):
    many = docs.select("doc_id", "text").unionByName(spark.range(100, 900).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")))
    rows = sharding.shard_rows(many, sharding.layout(4, 3, 2), bucket_rows=8).collect()
    assert len(rows) == len(ROWS) + 800 and {r["shard"] for r in rows} == set(range(24))
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and any(r["grown_shard"] == 24 for r in rows)
    of = {(r["doc_id"], r["shard"]) for r in rows}
    assert len(of) == len({d for d, _ in of})
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] in (6, 7)} == {(8, 0)}
    assert sharding.shard_rows(empty, sharding.layout(4, 3, 2)).count() == 0


def test_slots_do_not_depend_on_partitions_and_repeats_spread(spark, monkeypatch):
    monkeypatch.setattr(sharding, "REPEATS", 50)
    one = spark.range(700).select(F.lit(5).cast("long").alias("doc_id"), F.when(F.col("id") < 400, F.lit("same")).otherwise(F.col("id").cast("string")).alias("text"))
    rows = one.union(spark.range(1000, 1300).select("id", F.lit("t"))).union(spark.range(60).select(F.lit(None).cast("long"), F.col("id").cast("string")))
    seen = []
    for n in (4, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = sharding.shard_rows(rows.repartition(n), sharding.layout(4, 3, 2), bucket_rows=20)
        seen.append(sorted((str(tuple(r)) for r in got.collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert seen[0] == seen[1] and len(seen[0]) == 1060
    slots = defaultdict(list)
    for r in got.collect():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    spread = got.where("doc_id = 5 and size <> 12").select("slot").distinct().count()
    assert spread == 300 and got.where("doc_id = 5 and size = 12").count() == 400


def test_weights_move_rows_only_into_the_changed_subtree(spark):
    tree = sharding.layout(3, 2, 2)
    heavier = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in tree]
    ids = spark.range(3000).withColumnRenamed("id", "k")
    both = sharding.with_shard(sharding.with_shard(ids, "k", tree, "a"), "k", heavier, "b").collect()
    region = {x.shard: x.region for x in tree}
    assert all(region[r["b"]] in (region[r["a"]], "r1") for r in both)
    share = sum(r["b"] == 5 for r in both) / len(both)
    assert abs(share - 3 / 14) < 0.03


def test_descent_follows_the_smallest_draw(spark):
    """Level by level in plain Python, with the draws' hashes taken from the session."""
    tree = [sharding.Leaf(x.region, x.rack, x.shard, 1.0 + x.shard % 3) for x in sharding.layout(3, 2, 2)]
    keys = spark.range(200).select(F.col("id").alias("k"))
    got = {r["k"]: r["s"] for r in sharding.with_shard(keys, "k", tree, "s").collect()}
    names = sorted({x.region for x in tree} | {x.rack for x in tree} | {str(x.shard) for x in tree})
    hashes = {(r["k"], n): r[n] for r in keys.select("k", *[F.xxhash64("k", F.lit(n)).alias(n) for n in names]).collect() for n in names}

    def draw(k, name, weight):
        return -math.log((((hashes[k, name] & (2**64 - 1)) >> 11) + 1) / 2**53) / weight

    def least(k, leaves, level):
        groups = defaultdict(float)
        for x in leaves:
            groups[str(getattr(x, level))] += x.weight
        return min((draw(k, n, w), n) for n, w in groups.items())[1]

    for k, shard in got.items():
        leaves = tree
        for level in ("region", "rack", "shard"):
            name = least(k, leaves, level)
            leaves = [x for x in leaves if str(getattr(x, level)) == name]
        assert shard == leaves[0].shard


# --- personal data


@pytest.fixture(scope="module")
def span_model():
    r = random.Random(4)
    texts = [f"w{i} token = \"{''.join(r.choice('0123456789abcdef') for _ in range(40))}\" and 10.{i}.3.4 a{i}@b.example.com +1 (425) 555-{1000 + i} code {r.randrange(10**15)}" for i in range(60)]
    return pii.SpanModel.fit(texts)


def test_base_spans():
    text = ROWS[11][1]
    assert [(k, text[s:e]) for s, e, k in pii.base_spans(text)] == [("email", "bob.x@mail.example.com"), ("ip", "10.20.30.40"), ("phone", "+1 (425) 555-0100"), ("card", "4111 1111 1111 1111")]
    assert pii.base_spans("1.2.3.999 1.2.3.4.5 00000000000000000001.2.3.4") == [(10, 17, "ip"), (20, 46, "ip")]
    assert pii.base_spans("9" * 5000 + " 4111111111111112") == []


def test_pii_scan(docs, empty, span_model):
    rows = pii.scan(docs, span_model).collect()
    assert len(rows) == len(ROWS)
    r = next(r for r in rows if r["doc_id"] == 12)
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1)
    assert r["base_sha256"] == hashlib.sha256(b"email:5:27,ip:29:40,phone:44:61,card:68:87").hexdigest()
    assert r["redacted"] == "mail [EMAIL], [IP] or [PHONE], card [CARD]."
    assert pii.scan(empty, span_model).count() == 0
    clean = pii.redact_documents(docs, span_model)
    assert clean.columns == docs.columns and clean.where("text is null").count() == 1


def test_added_spans(span_model):
    text = 'x token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" y'
    (base, spans), (_, none), _ = pii.all_spans([text, "plain words only, 12 of them", ""], span_model)
    assert base == [] and [(k, text[s:e]) for s, e, k in spans] == [("secret", "b44e15e09fd311c3cf3163b66d5a9875b883d8ce")] and none == []


def test_rare_secrets_set_their_threshold_from_all_documents(spark):
    r = random.Random(12)
    key = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    secrets = [f'{words(20_000 + i, 3)} token = "{key()}" y' for i in range(12)]
    rows = [(i, f"{words(i, 4)} number {r.randrange(10**6)} of {r.randrange(10**16):016d} parts") for i in range(40_000)] + [(50_000 + i, t) for i, t in enumerate(secrets)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.train(docs)
    assert 0.5 <= model.thresholds["secret"] <= 1
    assert sum("[SECRET]" in (x["redacted"] or "") for x in pii.scan(docs.where("doc_id >= 50000"), model).collect()) >= 11
    assert pii.scan(docs.where("doc_id < 2000"), model).where("redacted like '%[SECRET]%'").count() == 0


def test_tolerant_emails_cards_and_phones_are_added(spark):
    r = random.Random(21)

    def card(n):
        head = "".join(r.choice("123456789") for _ in range(n - 1))
        return next(head + str(c) for c in range(10) if pii.luhn(head + str(c)))

    def rows(at, n):
        out = []
        for i in range(at, at + n):
            w, c, p = words(i, 3), card(16), f"{r.randrange(200, 999)}-{r.randrange(200, 999)}-{r.randrange(1000, 9999)}"
            out += [f"{w} a{i} (at) host{i} (dot) org yes", f"{w} {c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]} yes", f"{w} call {p} yes", f"{w} 10[.]{i % 200}[.]7[.]9 yes"]
            out += [f"{w} part {r.randrange(10**9)} on 12.5 of {r.randrange(10**11)} yes", f"{w} {i % 28 + 1}.12.2021 14:30 yes"]
        return out

    docs = spark.createDataFrame(list(enumerate(rows(0, 150))), "doc_id long, text string")
    model = pii.train(docs)
    want = ["EMAIL", "CARD", "PHONE", "IP", None, None]
    fresh = rows(1000, 30)
    right = defaultdict(list)
    for i, (text, (base, spans)) in enumerate(zip(fresh, pii.all_spans(fresh, model), strict=True)):
        assert base == []
        right[want[i % 6]].append([k.upper() for _, _, k in spans] == ([want[i % 6]] if want[i % 6] else []))
    assert all(np.mean(v) >= 0.9 for v in right.values()), {k: np.mean(v) for k, v in right.items()}


def test_boosting_learns_a_rule():
    r = np.random.default_rng(1)
    x = r.random((600, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    model = pii.BoostedTrees.fit(x[:400], y[:400])
    assert ((model.predict(x[400:]) > 0.5) == y[400:]).mean() > 0.9


# --- toxicity


def test_toxicity_on_held_out_words(spark):
    r = random.Random(8)
    bad = ["gorp", "vilefoo", "mudsnar"]
    rows = []
    for i in range(400):
        toxic = i % 5 == 0
        ws = words(1000 + i, r.randint(0, 60)).split()
        for _ in range(3 * toxic):
            ws.insert(r.randint(0, len(ws)), r.choice(bad) + r.choice(["", "a", "ing"]))
        rows.append((i, " ".join(ws), "en" if i % 2 else None, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    net = toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    scored = toxicity.score_documents(docs, net).select("doc_id", "toxicity", toxicity.held_out("doc_id").alias("held")).collect()
    held = [(s["toxicity"] >= 0.3) == (s["doc_id"] % 5 == 0) for s in scored if s["held"]]
    assert len(held) > 60 and np.mean(held) > 0.95
    assert all(0 <= s["toxicity"] <= 1 for s in scored)


def test_toxicity_gradients_are_those_of_the_loss():
    r = np.random.default_rng(5)
    net = toxicity.Network.start(r)
    net.emb = net.emb.astype("f8") * 10
    net.emb[0] = 0
    net.filters = {w: f.astype("f8") for w, f in net.filters.items()}
    net.bias = {w: 0.3 + r.normal(0, 0.1, toxicity.FILTERS) for w in toxicity.WIDTHS}
    net.out = net.out.astype("f8")
    coded = toxicity.Words().encode(["a few words here", "some other words follow", "", "unrelated"])
    y = np.array([1.0, 0.0, 1.0, 0.0])

    def loss():
        p = 1 / (1 + np.exp(-net.raw(*coded)))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grad = toxicity.gradients(net, *coded, y)
    used = np.unique(coded[0][coded[0] > 0])
    places = [(net.emb, grad["e"], (int(i), int(j))) for i, j in zip(r.choice(used, 12), r.integers(0, toxicity.DIM, 12), strict=True)]
    places += [(net.filters[w], grad["f", w], tuple(int(r.integers(0, n)) for n in net.filters[w].shape)) for w in toxicity.WIDTHS for _ in range(6)]
    places += [(net.bias[w], grad["b", w], (int(r.integers(0, toxicity.FILTERS)),)) for w in toxicity.WIDTHS for _ in range(3)]
    places += [(net.out, grad["o"], (int(i),)) for i in r.integers(0, len(net.out), 6)]
    for values, g, at in places:
        was = values[at]
        values[at] = was + 1e-5
        up = loss()
        values[at] = was - 1e-5
        down = loss()
        values[at] = was
        assert math.isclose((up - down) / 2e-5, g[at], rel_tol=1e-3, abs_tol=1e-6)


def test_the_convolution_tells_what_single_words_cannot(spark):
    """The same words in both classes; only their order differs."""
    r = random.Random(3)
    rows = []
    for i in range(1600):
        ws = words(3000 + i, 12).split()
        pair = ["gorp", "fisk"] if i % 2 else ["fisk", "gorp"]
        ws[r.randrange(10) : r.randrange(10)] = []
        at = r.randrange(len(ws))
        rows.append((i, " ".join([*ws[:at], *pair, *ws[at:]]), i % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    net = toxicity.train(docs, docs.select("doc_id", "toxic"))
    scored = toxicity.score_documents(docs, net, flag="flag").where(toxicity.held_out("doc_id")).select("toxicity", "toxic").collect()
    assert len(scored) > 200 and np.mean([(s["toxicity"] >= 0.5) == (s["toxic"] == 1) for s in scored]) > 0.9


def test_toxicity_of_repeated_and_contradictory_labels(spark, docs):
    rows = [(i % 50, "gorp gorp" if i % 2 else words(i, 9)) for i in range(300)] + [(None, "gorp"), (7, None), (8, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit("own")).withColumn("raw", F.lit(1))
    labels = spark.createDataFrame([(i % 50, i % 2) for i in range(100)] + [(i, 1 - i % 2) for i in range(10)] + [(None, 1), (3, None), (4, 9)], "doc_id long, toxic int")
    net = toxicity.train(table, labels)
    scored = toxicity.score_documents(table, net, score="s", flag="f")
    assert scored.columns == [*table.columns, "s", "f"] and scored.count() == len(rows) and scored.where("s is null or s < 0 or s > 1 or toxic <> 'own'").count() == 0


def test_toxicity_thresholds_of_rare_languages(spark):
    r = random.Random(9)
    rows = []
    for i in range(3000):
        toxic = i % 5 == 0
        ws = words(1000 + i, r.randint(5, 30)).split() + [r.choice(["gorp", "vilefoo"])] * (3 * toxic)
        rows.append((i, " ".join(ws), "xx" if i % 16 == 0 else "en", int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    net = toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic"), {1: 100, 0: 200})
    assert set(net.thresholds) == {"en", "xx"}


def test_toxicity_without_labels_or_texts(docs, empty, spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    net = toxicity.train(docs, labels)
    assert toxicity.score_documents(docs, net).where("toxicity is null or toxic").count() == 0
    assert toxicity.score_documents(empty, net).count() == 0


# --- nearest neighbours


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((700, 24)).astype("f4")
    x[5] = x[6] = x[7] = x[8] = x[9] = x[10] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [None] * 24), (904, []), (None, x[1].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).repartition(4)
    got = defaultdict(list)
    for r in ann.nearest(table, table.where("vec_id % 50 = 0"), "vec_id", "embedding", block_rows=200).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    y = x.astype("f8")
    unit = y / np.sqrt((y * y).sum(1))[:, None]
    hits = total = 0
    for q in range(0, 700, 50):
        score = unit @ unit[q]
        want = sorted((-round(s, 12), i) for i, s in enumerate(score) if i != q)[:5]
        assert len(got[q]) == 5 and got[q] == sorted(got[q], key=lambda r: (-r[1], r[0]))
        for i, s in got[q]:
            assert math.isclose(s, float(unit[i] @ unit[q]), abs_tol=1e-12)
        hits += len({i for _, i in want} & {i for i, _ in got[q]})
        total += 5
    assert hits / total >= 0.9 and [i for i, _ in got[0]] == [5, 6, 7, 8, 9]
    assert ann.nearest(table.limit(0), table, "vec_id", "embedding").count() == ann.nearest(table, table.limit(0), "vec_id", "embedding").count() == 0


@pytest.mark.parametrize("n", [5_000, 40_000])
def test_a_forest_reaches_its_recall_with_a_fixed_number_of_candidates(n):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 64))
    x /= np.sqrt((x * x).sum(1))[:, None]
    q = x[:n:50][:100]
    hits = total = 0
    for y, found in zip(q, ann.Forest(x).candidates(q), strict=True):
        score = x @ y
        want = np.argpartition(-score, 5)[:6]
        hits, total = hits + np.isin(want, found).sum(), total + len(found)
    assert hits / (6 * len(q)) >= 0.9 and total / len(q) <= 8_192


# --- url filter


def test_url_filter(spark):
    urls = ["http://A.Example.com/en/x?q#f", "https://www.example.com/en/", "https://m.www.example.com/en/y", "x://net/fr/", "x://b.net/es/1", "x://b.net/e", "no scheme", "", None, "http://spam-farm.example.org/de/", "http://example.com?x", "a://org/://net/fr/", "http://com/", "http://spam-farm.example.com/a", "http://notexample.com/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("key", F.lit("clash")).withColumn("rule", F.lit(1))
    rows = url_filter.filter_urls(pages, url_filter.production_list(spark)).orderBy("page_id").collect()
    want = [("a.example.com", "/en/x", "example.com/en/", "block"), ("www.example.com", "/en/", "www.example.com/en/", "allow"), ("m.www.example.com", "/en/y", "www.example.com/en/", "allow"), ("net", "/fr/", "net/fr/", "block"), ("b.net", "/es/1", "net/es/", "block"), ("b.net", "/e", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("spam-farm.example.org", "/de/", None, "block"), ("example.com", "", None, "allow"), ("org", "/://net/fr/", None, "allow"), ("com", "/", "com/", "allow"), ("spam-farm.example.com", "/a", "com/", "allow"), ("notexample.com", "/en/", "com/", "allow")]
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in rows] == want
    big = url_filter.filter_urls(pages, url_filter.production_list(spark), broadcast_rows=0).orderBy("page_id").collect()
    assert [r["verdict"] for r in big] == [r["verdict"] for r in rows]
    assert url_filter.filter_urls(pages.limit(0), url_filter.production_list(spark)).count() == 0


def test_toxicity_scores_once(spark):
    """One encoding gives the scores that training and scoring apart give, for every row."""
    rows = [(i, " ".join(["bad" if i % 3 == 0 else "good", *words(i, 6).split()]), "en", int(i % 3 == 0)) for i in range(300)] + [(None, "bad", "en", None), (400, None, "fr", None), (401, "", None, None), (0, "bad", "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    labels = docs.select("doc_id", "toxic").where("toxic is not null").distinct()
    docs = docs.drop("toxic")
    apart = toxicity.score_documents(docs, toxicity.train(docs, labels)).select("doc_id", F.round("toxicity", 4), "toxic")
    once = toxicity.judged(docs, labels).select("doc_id", F.round("score", 4), "toxic")
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, apart.collect()), key=str)


def test_toxicity_sample_is_bounded_by_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "bad " * 50 if i % 2 else "good " * 50, i % 2) for i in range(200)], "doc_id long, text string, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, y: seen.append(sum(map(len, texts))) or toxicity.Network.start(np.random.default_rng(0)))
    for limit in (3000, 1 << 20):
        monkeypatch.setattr(toxicity, "TRAIN_BYTES", limit)
        toxicity.fitted(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    assert 0 < seen[0] <= 3000 < seen[1]
