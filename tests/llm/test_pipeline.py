"""All five stages of the pipeline against plain versions of them, with clashing names, nulls, empties and repeats."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from jadwal.llm import pii, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, toxic string, toxicity double, component_id long, rule string"
BENCHMARK = " ".join(f"item{i}" for i in range(30))


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def corpus():
    r = random.Random(4)
    rows = []
    for i in range(300):
        ws = words(i, r.randint(20, 120)).split()
        if i % 6 == 0:
            ws += ["gorp", "vilefoo"] * 2
        rows.append([i, " ".join(ws)])
    near = words(7, 100).split()
    near[3] = "changed"
    rows += [[400, words(7, 100)], [401, " ".join(near)], [402, words(7, 100)], [402, words(7, 100)]]
    rows += [[410, "start " + BENCHMARK + " end"], [411, BENCHMARK.upper()], [412, " ".join(BENCHMARK.split()[:12])]]
    rows += [[420, "mail a.b@c.example.de or 10.1.2.3, card 4111 1111 1111 1111 and +1 (425) 555-0100"], [421, f"{words(9, 50)} x@y.org"]]
    rows += [[430, None], [431, ""], [432, ""], [None, words(11, 40)], [None, words(11, 40)], [433, words(12, 9000)]]
    return [(i, t, "en" if (i or 0) % 2 else None, "s", len(t or ""), "own", 0.5, 77, "x") for i, t in rows]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, 0, int(i % 6 == 0)) for i in range(300)] + [(410, 0, None), (411, 0, 2), (None, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, BENCHMARK), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def naive_score(net, text):
    """The network word by word: sums of embeddings, filters at every place, maxima, the logistic layer."""
    ws = (text or "").lower().split() or [""]
    ws = ws + [""] * (max(toxicity.WIDTHS) - 1)
    vectors = []
    for w in ws:
        raw = re.sub(r"[\W_]+", "", w).encode()
        ids = [1 + zlib.crc32(raw) % (toxicity.ROWS - 1)] if raw else []
        ids += [1 + zlib.crc32(raw[:p], p) % (toxicity.ROWS - 1) for p in toxicity.PREFIXES if len(raw) > p]
        vectors.append(sum((net.emb[i].astype("f8") for i in ids), np.zeros(toxicity.DIM)))
    top = []
    for width in toxicity.WIDTHS:
        at = [sum(vectors[i + j] @ net.filters[width][j] for j in range(width)) for i in range(len(ws) - width + 1)]
        top.append(np.max(at[: len(ws) - max(toxicity.WIDTHS) + 1], axis=0) + net.bias[width])
    raw = np.maximum(np.concatenate(top), 0) @ net.out + net.out_bias
    return 1 / (1 + np.exp(-(net.scale[0] * raw + net.scale[1])))


def key(row):
    return tuple(str(v) for v in row)


def plain_near(rows):
    def shingles(t):
        ws = (t or "").encode().lower().split()
        return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or ({tuple(ws)} if ws else set())

    sets = [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    best = {i: i for i, _ in sets}
    for _ in range(3):
        for a, x in sets:
            for b, y in sets:
                if x and y and 5 * len(x & y) >= 4 * len(x | y):
                    best[a] = best[b] = min(best[a], best[b])
    return [r for r in rows if r[0] is None or best[r[0]] == r[0]]


def test_every_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    net = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    clean = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    assert clean.schema == docs.schema
    want = [r for r in rows if r[1] is None or naive_score(net, r[1]) < net.thresholds.get(r[2], 0.3)]
    got = [tuple(r) for r in clean.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    gone = {r[0] for r in rows} - {r[0] for r in got}
    assert len(gone & set(range(0, 300, 6))) >= 45 and len(gone) <= 55

    one = corpus_pipeline.drop_near_duplicates(spark, clean, sf_dir)
    assert one.schema == docs.schema
    want = plain_near(got)
    got = [tuple(r) for r in one.collect()]
    assert sorted(got, key=key) == sorted(want, key=key) and not {401, 402} & {r[0] for r in got}

    free = corpus_pipeline.drop_contaminated(spark, one, sf_dir)
    assert free.schema == docs.schema
    want = [r for r in got if r[0] not in (410, 411)]
    got = [tuple(r) for r in free.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)

    safe = corpus_pipeline.redact_personal_data(spark, free, sf_dir)
    assert safe.columns == docs.columns
    model = pii.train(free)
    want = []
    for r in got:
        text = r[1]
        if text is not None:
            (_, spans), = pii.all_spans([text], model)
            marks, out, at = [None] * len(text), [], 0
            for start, end, kind in reversed(spans):
                marks[start:end] = [(kind, start)] * (end - start)
            while at < len(text):  # runs of touched characters, each by its first kind
                if marks[at] is None:
                    out.append(text[at])
                    at += 1
                else:
                    out.append(f"[{marks[at][0].upper()}]")
                    end = max(e for s, e, _ in spans if s <= at)
                    while any(s < end < e for s, e, _ in spans):
                        end = max(e for s, e, _ in spans if s < end)
                    at = end
            text = "".join(out)
        want.append((r[0], text, *r[2:4], None if text is None else len(text), *r[5:]))
    got = [tuple(r) for r in safe.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    texts = {r[0]: r[1] for r in got}
    assert texts[420] == "mail [EMAIL] or [IP], card [CARD] and [PHONE]" and texts[421].endswith(" [EMAIL]") and texts[430] is None

    packed = corpus_pipeline.pack_sequences(spark, safe, sf_dir).collect()
    check_packed(got, packed)


def check_packed(rows, packed):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in rows:
        ids = [*exact.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want.update((r[0], s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes()), len(ids)) for s in range(0, len(ids), 2048))
    assert Counter((p["doc_id"], p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in packed) == want
    places = defaultdict(list)
    for p in packed:
        places[p["sequence_id"]].append((p["offset"], p["length"]))
    for pieces in places.values():
        ends = 0
        for offset, n in sorted(pieces):
            assert offset == ends
            ends += n
        assert ends <= 2048


def test_run_applies_the_stages_and_repeats_itself(spark, sf_dir):
    first = corpus_pipeline.run(spark, sf_dir)
    again = corpus_pipeline.run(spark, sf_dir)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(key, first.select(names).collect())) == sorted(map(key, again.select(names).collect()))
    ids = {r[0] for r in first.select("doc_id").distinct().collect()}
    assert {412, 420, 421, 430, 431, 432, 433, None} <= ids and not ids & {401, 402, 410, 411}


def test_run_of_empty_tables(spark, sf_dir, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_names_that_are_not_taken(spark):
    docs = spark.range(1).withColumn("_toxic", F.lit(1)).withColumn("TOXIC", F.lit(1))
    assert corpus_pipeline.unused("toxic", docs) == "__toxic" and corpus_pipeline.unused("score", docs) == "score"


def test_a_very_long_text(spark, tmp_path):
    """Texts of megabytes, also one without white space, pass all stages whole."""
    long = " ".join(words(i, 4000) for i in range(90))
    rows = [(i, words(i, 40), "en", "s", 0) for i in range(40)] + [(100, long, "en", "s", len(long)), (101, "z" * 300_000, "en", "s", 0), (102, "mail me at a.b@example.org " + long[:100_000], None, "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i % 5 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, BENCHMARK)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert len(long) > 1_500_000
    packed = corpus_pipeline.run(spark, str(tmp_path)).where("doc_id >= 100").groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("tokens"), F.max(F.col("start") + F.col("length")).alias("end")).collect()
    assert {r["doc_id"] for r in packed} == {100, 101, 102} and all(r["n"] == r["tokens"] == r["end"] > 1000 for r in packed)
