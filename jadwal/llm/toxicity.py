"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word is the sum of hashed embeddings of itself and of its first letters, so that unseen forms of a stem
share its meaning. Filters of one, two and three words run over the whole text, each filter keeps its
maximum, and a logistic layer scores the document. Scores are calibrated on all labelled documents that are not
held out and that the network has not seen, by a histogram, reweighted to the true share of toxic labels; thresholds
are then set by language.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jadwal.llm.common import table, text_slices, written
from jadwal.shipping import ship

ROWS, DIM, FILTERS, WIDTHS = 1 << 15, 16, 8, (1, 2, 3)
PREFIXES = (4, 5, 6)  # bytes
TRAIN_PER_CLASS = {1: 1500, 0: 3000}  # the bound on the labelled sample
TRAIN_BYTES = 64 << 20  # and on its texts together
LEAST_THRESHOLD_ROWS = 60
LEAST_DOCUMENTS = 3  # of the sample that hold a feature which is to have an embedding
CACHE_WORDS, CACHE_BYTES = 80_000, 12 << 20  # the words that a worker keeps
DOCS_AT_ONCE = 256
BIN = 32  # bins for each unit of the raw score
NOT_WORD = re.compile(r"[\W_]+")


class Words:
    """Texts to rows of feature ids; words are looked up once per worker (bounded)."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {"": 0}
        self.held = 0
        self.table = np.zeros((1 << 16, 1 + len(PREFIXES)), "i4")  # row 0 is padding

    def _learn(self, words: set[str]) -> None:
        n, new = len(self.at), []
        crc = zlib.crc32
        for i, w in enumerate(words):
            self.at[w] = n + i
            self.held += len(w)
            raw = (w if w.isalnum() else NOT_WORD.sub("", w)).encode()
            size = len(raw)
            new.append(1 + crc(raw) % (ROWS - 1) if size else 0)
            for p in PREFIXES:
                new.append(1 + crc(raw[:p], p) % (ROWS - 1) if size > p else 0)
        while n + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[n : n + len(words)] = np.array(new, "i4").reshape(len(words), -1)

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers of all texts, each padded at its end; start of each text)."""
        if len(self.at) > CACHE_WORDS or self.held > CACHE_BYTES:
            self.at, self.held = {"": 0}, 0
        split = [(t or "").lower().split() for t in texts]
        at = self.at
        if new := {w for ws in split for w in ws if w not in at}:
            self._learn(new)
        pad = max(WIDTHS) - 1
        sizes = np.array([max(1, len(ws)) + pad for ws in split])
        starts = np.cumsum(sizes) - sizes
        out = np.zeros(sizes.sum(), "i8")
        for start, ws in zip(starts.tolist(), split, strict=True):
            out[start : start + len(ws)] = [at[w] for w in ws]
        return out, starts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(features of the distinct words, word numbers of all texts with padding, start of each text)."""
        numbers, starts = self.numbers(texts)
        return distinct(self.table, numbers, starts)


def distinct(table: np.ndarray, numbers: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers renumbered by the distinct words that occur."""
    present = np.zeros(len(table), bool)
    present[numbers] = True
    used = np.flatnonzero(present)
    place = np.zeros(len(table), "i4")
    place[used] = np.arange(len(used))
    return table[used], place[numbers], starts


@dataclass
class Network:
    """Embeddings, filters and the logistic layer."""

    emb: np.ndarray
    filters: dict[int, np.ndarray]  # width -> (width, DIM, FILTERS)
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)

    @staticmethod
    def start(rng: np.random.Generator) -> Network:
        emb = rng.normal(0, 0.1, (ROWS, DIM)).astype("f4")
        emb[0] = 0
        filters = {w: rng.normal(0, 0.3, (w, DIM, FILTERS)).astype("f4") for w in WIDTHS}
        return Network(emb, filters, {w: np.zeros(FILTERS, "f4") for w in WIDTHS}, rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype("f4"))

    def pooled(self, feats: np.ndarray, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(texts, filters): maxima over each whole text, before the rectifier."""
        x = self.emb[feats].sum(1)
        parts = []
        for w in WIDTHS:
            tables = [x @ self.filters[w][j] for j in range(w)]
            n = len(words) - w + 1
            act = tables[0][words[:n]]
            for j in range(1, w):
                act = act + tables[j][words[j : j + n]]
            parts.append(np.maximum.reduceat(act, starts, axis=0) + self.bias[w])
        return np.concatenate(parts, 1)

    def raw(self, feats: np.ndarray, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.maximum(self.pooled(feats, words, starts), 0) @ self.out + self.out_bias

    def score(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * raw + self.scale[1], -30, 30)))


class Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.state = rate, 0, {}

    def step(self, name: object, value: np.ndarray, grad: np.ndarray) -> None:
        m, v = self.state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        value -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-7)


def fit(texts: list[str], labels: np.ndarray, passes: int = 3, least_steps: int = 300, batch: int = 64, seed: int = 3) -> Network:
    """A network for these texts; embeddings start from the smoothed log-odds of their features."""
    rng = np.random.default_rng(seed)
    net = Network.start(rng)
    words = Words()
    numbers, starts = words.numbers(texts)
    table, numbers, _ = distinct(words.table, numbers, starts)
    docs = np.split(numbers, starts[1:])
    seen = {y: np.full(ROWS, 0.5) for y in (0, 1)}
    for doc, y in zip(docs, labels, strict=True):
        seen[int(y)][np.unique(table[doc])] += 1
    total = {y: max(1, (labels == y).sum()) for y in (0, 1)}
    odds = np.log(seen[1] / total[1]) - np.log(seen[0] / total[0])
    sure = np.minimum(1, (seen[0] + seen[1] - 1) / 6)
    net.emb[1:, 0] += (0.5 * np.clip(odds * sure, -1, 4))[1:].astype("f4")
    rare = seen[0] + seen[1] - 1 < LEAST_DOCUMENTS
    net.emb[rare] = 0  # words that teach nothing say nothing, like those that were never seen
    for w in WIDTHS:
        net.filters[w][:, 0, : FILTERS // 4] += 0.5
    net.out.reshape(len(WIDTHS), FILTERS)[:, : FILTERS // 4] += 0.5
    net.out_bias = -1.0
    opt = Adam(0.004)
    steps, order = max(least_steps, passes * -(-len(texts) // batch)), np.zeros(0, "i8")
    for _ in range(steps):
        if not len(order):
            order = rng.permutation(len(texts))
        rows, order = order[:batch], order[batch:]
        sizes = np.array([len(docs[r]) for r in rows])
        own = distinct(table, np.concatenate([docs[r] for r in rows]), np.cumsum(sizes) - sizes)
        _step(net, opt, *own, labels[rows].astype("f4"), rare)
    return net


def gradients(net: Network, feats: np.ndarray, nums: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict:
    """Of the mean logistic loss, by parameter: ("f", width), ("b", width), "e", "o" and "c" (the last bias)."""
    x = net.emb[feats].sum(1)
    best, pooled = {}, []
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(nums))))
    for w in WIDTHS:
        tables = [x @ net.filters[w][j] for j in range(w)]
        n = len(nums) - w + 1
        act = tables[0][nums[:n]]
        for j in range(1, w):
            act = act + tables[j][nums[j : j + n]]
        top = np.maximum.reduceat(act, starts, axis=0)
        hit_row, hit_col = np.nonzero(act == top[owner[:n]])
        where = np.zeros(top.shape, "i8")
        where[owner[hit_row], hit_col] = hit_row  # any of equal maxima
        best[w] = where
        pooled.append(top + net.bias[w])
    h = np.concatenate(pooled, 1)
    p = 1 / (1 + np.exp(-np.clip(np.maximum(h, 0) @ net.out + net.out_bias, -30, 30)))
    g = (p - y) / len(y)
    dh = g[:, None] * net.out * (h > 0)
    out: dict = {"o": np.maximum(h, 0).T @ g, "c": float(g.sum()), "e": np.zeros_like(net.emb)}
    for k, w in enumerate(WIDTHS):
        d = dh[:, k * FILTERS : (k + 1) * FILTERS].astype("f4")
        df = np.zeros_like(net.filters[w])
        for j in range(w):
            at = nums[best[w] + j]
            df[j] = np.einsum("bf,bfd->df", d, x[at])
            rows, col = np.nonzero(d)
            dx = d[rows, col][:, None] * net.filters[w][j].T[col]
            for f in feats[at[rows, col]].T:
                np.add.at(out["e"], f, dx)
        out["f", w], out["b", w] = df, d.sum(0)
    out["e"][0] = 0
    return out


def _step(net: Network, opt: Adam, feats: np.ndarray, nums: np.ndarray, starts: np.ndarray, y: np.ndarray, still: np.ndarray) -> None:
    grad = gradients(net, feats, nums, starts, y)
    grad["e"][still] = 0
    opt.t += 1
    for w in WIDTHS:
        opt.step(("f", w), net.filters[w], grad["f", w])
        opt.step(("b", w), net.bias[w], grad["b", w])
    opt.step("e", net.emb, grad["e"])
    opt.step("o", net.out, grad["o"] + 1e-4 * net.out)
    net.out_bias -= opt.rate * grad["c"] * 4


def calibrate(net: Network, histogram: list[tuple[str | None, int, int, int]], share: float, bar: float = 0.3) -> None:
    """Platt scaling reweighted to ``share`` of toxic rows, then each language's threshold by best F1.

    ``histogram`` has language, bin of the raw score, toxic rows and all rows.
    """
    cells = [(lang, k, y, toxic if y else total - toxic) for lang, k, toxic, total in histogram for y in (0, 1)]
    cells = sorted(((lang or "", k, y, n) for lang, k, y, n in cells if n))
    if not cells:
        return
    langs = np.array([c[0] for c in cells])
    raw, labels, n = ((np.array([c[i] for c in cells], "f8") + 0.5 * (i == 1)) / (BIN if i == 1 else 1) for i in (1, 2, 3))
    toxic, total = (n * labels).sum(), n.sum()
    now = toxic / total
    weight = n * (np.where(labels == 1, share / now, (1 - share) / (1 - now)) if 0 < now < 1 else 1.0)
    a, b = 1.0, 0.0
    soft = np.where(labels == 1, 1 - 1 / (toxic + 2), 1 / (total - toxic + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        d, s = weight * (p - soft), weight * p * (1 - p) + 1e-9
        h = np.array([[(s * raw * raw).sum() + 1e-3, (s * raw).sum()], [(s * raw).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(h, [(d * raw).sum() + 1e-3 * (a - 1), d.sum()])
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -2, 2))
    net.scale = (max(a, 1e-3), b)
    score = net.score(raw)
    edge = net.score(raw - 0.5 / BIN)
    for lang in sorted({x for x in langs.tolist() if x}):
        own = langs == lang
        if n[own].sum() >= LEAST_THRESHOLD_ROWS and 0 < (n * labels)[own].sum() < n[own].sum():
            s, y, w = score[own], labels[own], weight[own]
            tried = np.unique(np.append(edge[own], bar))
            f1 = [2 * (w * y * (s >= t)).sum() / ((w * y).sum() + (w * (s >= t)).sum() or 1) for t in tried]
            good = tried[np.flatnonzero(np.array(f1) >= max(f1) - 1e-9)]
            net.thresholds[lang] = float(np.clip(good[np.abs(good - bar).argmin()], 0.1, 0.9))


def held_out(doc_id) -> F.Column:  # type: ignore[name-defined]
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, per_class: dict[int, int] | None = None) -> tuple[Network, DataFrame, float | None]:
    """A network that is not calibrated yet, the labels to calibrate it with, and the share of toxic labels.

    Four in five labelled rows that are not held out may train: per class, those with the smallest hash of their id, and of their texts, in the order of
    the hash, as many as have ``TRAIN_BYTES`` together; only those reach the driver. All other labels, also those beyond the first bound, calibrate.
    """
    bounds = per_class or TRAIN_PER_CLASS
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).select("doc_id", "toxic")
    share = known.agg(F.avg("toxic")).first()[0]
    order = F.xxhash64(F.lit("sample"), "doc_id")
    may = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(5)) < 4
    ids = None
    for y, n in sorted(bounds.items()):
        own = known.where((F.col("toxic") == y) & may).orderBy(order, "doc_id").limit(n)
        ids = own if ids is None else ids.unionByName(own)
    rest = known.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_anti")
    lang = F.coalesce("lang", F.lit("")) if "lang" in docs.columns else F.lit("")
    drawn = docs.select("doc_id", "text", lang.alias("lang")).join(F.broadcast(ids), "doc_id").where("text is not null").withColumn("h", F.xxhash64(F.lit("sample"), "doc_id", "text", "lang"))
    sizes = drawn.select("doc_id", "h", F.octet_length("text").alias("bytes")).orderBy("h", "doc_id").limit(sum(bounds.values()))
    fits = sizes.withColumn("upto", F.sum("bytes").over(Window.partitionBy().orderBy("h", "doc_id"))).where(F.col("upto") <= TRAIN_BYTES)  # over the few rows of the sample
    rows = sorted(tuple(r) for r in drawn.join(F.broadcast(fits.select("doc_id", "h").distinct()), ["doc_id", "h"]).select("doc_id", "text", "lang", "toxic").collect())
    if not rows or share in (None, 0.0, 1.0):
        net = Network.start(np.random.default_rng(0))
        net.scale = (1e-3, -4.0 if not share else 4.0)
        return net, rest, None
    rows.sort(key=lambda r: (zlib.crc32(b"order%d" % r[0]), r))
    return fit([r[1] for r in rows], np.array([r[3] for r in rows])), rest, share


def raw_scores(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, lang, known (there are an id and a text) and raw score of the documents, without their texts; null texts are as empty ones."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for part in text_slices(batch, 2, DOCS_AT_ONCE):
                raw = shared.value.raw(*words.encode(part.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array(raw.astype("f8"))], ["doc_id", "lang", "known", "raw"])

    ship(docs.sparkSession)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    known = (F.col("text").isNotNull() & F.col("doc_id").isNotNull()).alias("known")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang, "text", known)
    return rows.mapInArrow(work, "doc_id long, lang string, known boolean, raw double")


def histogram_of(raw: DataFrame, rest: DataFrame) -> list[tuple[str | None, int, int, int]]:
    """Language, bin, toxic rows and all rows of the documents with labels in ``rest``."""
    k = F.floor(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), "raw")) * BIN).cast("int").alias("k")
    both = raw.join(rest, "doc_id").groupBy("lang", k).agg(F.sum(F.col("toxic").cast("long")).alias("toxic"), F.count("*").alias("total"))
    return [tuple(r) for r in both.collect()]


def train(docs: DataFrame, labels: DataFrame, per_class: dict[int, int] | None = None) -> Network:
    """A network from a bounded sample of the labels, calibrated on all other labels that are not held out."""
    net, rest, share = fitted(docs, labels, per_class)
    if share is not None:
        calibrate(net, histogram_of(raw_scores(docs.where("text is not null and doc_id is not null"), net), rest), share)
    return net


def threshold(net: Network, bar: float, has_lang: bool) -> Column:
    """The language's threshold, else ``bar``."""
    limit = F.lit(bar)
    for lang, t in sorted(net.thresholds.items()) if has_lang else ():
        limit = F.when(F.col("lang") == lang, t).otherwise(limit)
    return limit


def judged(docs: DataFrame, labels: DataFrame, bar: float = 0.3) -> DataFrame:
    """doc_id, score, toxic of every row of ``docs``, by a network trained on them; without their texts.

    The texts are encoded once: the raw scores are written, calibrate the network, and become the scores, which are a monotone map of them.
    """
    net, rest, share = fitted(docs, labels)
    raw = written(raw_scores(docs, net), "raw-scores")
    if share is not None:
        calibrate(net, histogram_of(raw.where("known"), rest), share)
    a, b = net.scale
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("raw") * a + b))))
    return raw.withColumn("score", score).select("doc_id", "score", (F.col("score") >= threshold(net, bar, True)).alias("toxic"))


def score_documents(docs: DataFrame, net: Network, bar: float = 0.3, score: str = "toxicity", flag: str = "toxic") -> DataFrame:
    """``docs`` with columns ``score`` and ``flag`` (the score reaches the language's threshold, else ``bar``).

    The whole text is scored; null and empty texts have the score of a text without words. Repeated rows, also those that
    repeat a doc_id, are scored each; rows without a doc_id are scored too. Own columns of these two names are replaced,
    all others stay.
    """
    docs = docs.drop(score, flag)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for part in text_slices(batch, at, DOCS_AT_ONCE):
                net = shared.value
                value = net.score(net.raw(*words.encode(part.column(at).to_pylist())))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(value.astype("f8"))], [*part.schema.names, score])

    ship(docs.sparkSession)
    out = docs.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))
    return out.withColumn(flag, F.col(score) >= threshold(net, bar, "lang" in docs.columns))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "toxic")
