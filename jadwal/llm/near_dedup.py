"""Near-duplicates by bottom-k sketches from one hash function.

Every document's set of word shingles is hashed once; equal sets collapse to their smallest document. A
set retains its k smallest hash values. Inverted lists of retained values generate pairs, the union of two
sketches estimates their similarity, and exact Jaccard on the full sets verifies. With similarity s, each of
the k smallest values of a union is shared with probability s, so the chance that a linked pair shares too few
is below 1e-6 at the defaults (``miss_bound``); sets of at most k shingles are their own sketches and exact.

Long lists never become all pairs:

* a document with at most RICH of its retained values in long lists is found through its other values alone,
  since a link leaves about 1 - s of the union unshared;
* the other documents consist mostly of frequent text. In a long list they are compared with one hub; those
  that the hub's component does not take are compared in blocks of the list, exactly, until they link.

Of the pairs from short lists, each document's best one is verified first, then those that still join two components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jadwal.llm.common import table, text_slices, written
from jadwal.llm.components import components
from jadwal.shipping import ship

K = 32
LONG = 64  # entries of a list that may become all pairs
RICH = 3 / 8  # a document with a greater share of its retained values in long lists takes part in the search of those
ESTIMATE_SLACK = 0.41  # a pair is verified when its estimate is at least the threshold less this
LEAD = 10  # smallest retained values whose long lists are searched in blocks
BLOCK = 512
BROADCAST_ROWS = 500_000  # of at most four numbers each
SLOTS = 1 << 24  # bits that tell which documents' texts are asked for
MEMBERS, BUCKET_SHINGLES, SALTS = 256, 500_000, 16
CACHE_WORDS, CACHE_BYTES = 80_000, 12 << 20  # the words that a worker keeps
DOCS_AT_ONCE = 512

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, width: int):
        self.width, self.cache, self.held = width, {}, 0

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
        if not words:
            return np.zeros(0, "i8")
        cache = self.cache
        if len(cache) > CACHE_WORDS or self.held > CACHE_BYTES:
            cache.clear()
            self.held = 0
        for w in words:
            if w not in cache:
                cache[w] = xxhash.xxh64_intdigest(w)
                self.held += len(w)
        h = np.array([cache[w] for w in words], "u8")
        width = min(self.width, len(words))
        n = len(words) - width + 1
        acc = np.full(n, width, "u8")
        for j in range(width):
            acc = (acc ^ (acc >> np.uint64(29))) * _MIX[0] + h[j : j + n]
        acc = (acc ^ (acc >> np.uint64(30))) * _MIX[1]
        acc = (acc ^ (acc >> np.uint64(27))) * _MIX[2]
        return np.unique((acc ^ (acc >> np.uint64(31))).view("i8"))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union; empty sets are linked with nothing."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def miss_bound(s: float, k: int = K) -> float:
    """At most the chance that a pair of similarity ``s`` is not found, for sets of more than ``k`` shingles.

    It is missed if its sketches share too few values for the estimate; if all that they share lies in long lists and one of
    them takes no part in those; or if none of the LEAD smallest values is shared.
    """
    at_most = lambda m: sum(math.comb(k, i) * s**i * (1 - s) ** (k - i) for i in range(m + 1))
    return at_most(math.ceil((s - ESTIMATE_SLACK) * k) - 1) + at_most(int(RICH * k)) + (1 - s) ** LEAD


def shingle_sets(docs: DataFrame, width: int, k: int = K) -> DataFrame:
    """doc_id, n, fp (of the whole set), sketch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingler(width)
        for batch in (part for whole in batches for part in text_slices(whole, 1, DOCS_AT_ONCE)):
            sets = [of(t) for t in batch.column(1).to_pylist()]
            n = pa.array([len(s) for s in sets], pa.int64())
            fp = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, fp, pa.array([s[:k] for s in sets], pa.list_(pa.int64()))], ["doc_id", "n", "fp", "sketch"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n long, fp binary, sketch array<long>")


def _fits(a: str, b: str, percent: int) -> F.Column:  # type: ignore[name-defined]
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _list_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """a < b, from short lists (v, rep, n)."""
    left = lists.select("v", F.col("rep").alias("a"), F.col("n").alias("na"))
    right = lists.select("v", F.col("rep").alias("b"), F.col("n").alias("nb"))
    return left.join(right, "v").where((F.col("a") < F.col("b")) & _fits("na", "nb", percent)).select("a", "b").distinct()


def _estimated(pairs: DataFrame, reps: DataFrame, k: int, least: float) -> DataFrame:
    """a, b, est: the share of the union's k smallest values that both sketches hold, if at least ``least``."""
    s = reps.select("rep", "sketch")
    both = pairs.join(s.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")), "a").join(s.select(F.col("rep").alias("b"), F.col("sketch").alias("sb")), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    est = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union)) / F.size(union)
    return both.select("a", "b", est.alias("est")).where(F.col("est") >= least)


def _bounded(df: DataFrame, rows: int, most: int | None = None) -> DataFrame:
    return F.broadcast(df) if rows <= (BROADCAST_ROWS if most is None else most) else df


def _asked_texts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``docs`` without most of those that are in no pair (a, b), so that a join need not move every text.

    The driver keeps one bit a slot, however large the tables are; documents share slots by chance.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS)).cast("int")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    bits = np.zeros(SLOTS // 8, "u1")
    for found in ids.select(slot("id").alias("slot")).distinct().toArrow().column("slot").chunks:
        i = found.to_numpy()
        np.bitwise_or.at(bits, i >> 3, np.left_shift(1, i & 7).astype("u1"))
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def asked(slots: pa.Array) -> pa.Array:
        i = slots.to_numpy(zero_copy_only=False)
        return pa.array((held.value[i >> 3] >> (i & 7).astype("u1") & 1).astype(bool))

    return docs.where(F.arrow_udf(asked, "boolean")(slot("doc_id")))


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, width: int, percent: int, most: int | None = None) -> DataFrame:
    """The linked ones of ``pairs`` (a, b), from the full sets of both texts.

    Pairs are dealt by ``a``, in chunks of MEMBERS, over buckets of about BUCKET_SHINGLES; a bucket gets the text of each of its
    ``a`` once, so that a hub's text is sent once for many members. Tables of more than ``most`` rows are not broadcast.
    """
    pairs = written(pairs.select("a", "b"), "asked")
    many = pairs.groupBy("a").agg(F.count("*").alias("m")).where(F.col("m") > MEMBERS)
    many = written(many, "hubs-asked")
    volume = pairs.join(reps.select(F.col("rep").alias("b"), "n"), "b").agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-volume // BUCKET_SHINGLES))
    part = F.pmod(F.xxhash64("b"), F.ceil(F.coalesce("m", F.lit(1)) / MEMBERS))
    dealt = pairs.join(_bounded(many, many.count(), most), "a", "left").select("a", "b", F.pmod(F.xxhash64("a", part), F.lit(buckets)).alias("bucket"))
    dealt = written(dealt, "dealt")
    sides = dealt.select(F.col("b").alias("doc_id"), "bucket", "a").union(dealt.select(F.col("a"), "bucket", F.lit(None).cast("long")).distinct())
    rows = 2 * pairs.count()
    if (BROADCAST_ROWS if most is None else most) < rows <= SLOTS // 4:
        docs = _asked_texts(docs, pairs)
    texts = docs.join(_bounded(sides, rows, most), "doc_id").select("bucket", F.col("doc_id").alias("b"), "a", "text")

    def work(t: pa.Table) -> pa.Table:
        of, ids, others, text = Shingler(width), t.column("b").to_pylist(), t.column("a").to_pylist(), t.column("text")
        own: dict[int, list[int]] = {}
        for i, (b, a) in enumerate(zip(ids, others, strict=True)):
            if a is None:
                own.setdefault(b, []).append(i)
        members: dict[int, list[int]] = {}
        for i, a in enumerate(others):
            if a is not None:
                members.setdefault(a, []).append(i)
        good = []
        for a, rows in members.items():  # one set of ``a`` at a time
            sets = [of(text[i].as_py()) for i in own.get(a, [])]
            good += [i for i in rows if any(linked(of(text[i].as_py()), s, percent) for s in sets)]
        return pa.table({"a": pa.array([others[i] for i in good], pa.int64()), "b": pa.array([ids[i] for i in good], pa.int64())})

    return written(texts.groupBy("bucket").applyInArrow(work, "a long, b long").distinct(), "links")


def _by_value(rows: DataFrame, values: DataFrame, most: int | None = None) -> DataFrame:
    """``rows`` (v, rep and more) with the columns of ``values``, one row a value; a frequent value never fills one task."""
    values = written(values, "values")
    if values.count() <= (BROADCAST_ROWS if most is None else most):
        return rows.join(F.broadcast(values), "v")
    salted = values.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(salted, ["v", "salt"]).drop("salt")


def _stragglers(lists: DataFrame, labels: DataFrame, docs: DataFrame, width: int, percent: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) of the members of long lists (v, rep) that their list's main component did not take.

    A list's members are dealt over blocks and its stragglers over chunks of the same size. In each pair of them a
    straggler looks for one linked member of every other component, among those that share enough of its sketch.
    """
    least = percent / 100 - ESTIMATE_SLACK
    own = written(lists.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("v", "rep", F.coalesce("label", "rep").alias("label")), "members")
    main = own.groupBy("v", "label").count().groupBy("v").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.sum("count").alias("size"))
    main = written(main, "main")
    late = written(_by_value(own, main).where("label <> main").select("v", "rep", "label"), "late")
    if late.isEmpty():
        return docs.sparkSession.createDataFrame([], "a long, b long")
    parts = main.select("v", "size").join(late.groupBy("v").agg(F.count("*").alias("n_late")), "v").select("v", F.ceil(F.col("size") / block).alias("blocks"), F.ceil(F.col("n_late") / block).alias("chunks"))
    part = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    every_part = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    placed = _by_value(own, parts).withColumn("block", part("blocks")).withColumn("chunk", every_part("chunks"))
    asked = _by_value(late, parts).withColumn("chunk", part("chunks")).withColumn("block", every_part("blocks"))
    every = written(placed.select("v", "block", "chunk", "rep", "label", F.lit(False).alias("late")).unionByName(asked.select("v", "block", "chunk", "rep", "label", F.lit(True).alias("late"))), "straggler-rows")
    ids = every.select(F.col("rep").alias("doc_id")).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingler(width)
        for batch in (part for whole in batches for part in text_slices(whole, 1, DOCS_AT_ONCE)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([of(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["rep", "set"])

    full = docs.join(_bounded(ids, ids.count()), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(sets, "rep long, set binary")

    def search(t: pa.Table) -> pa.Table:
        reps, label, is_late = (t.column(c).to_numpy() for c in ("rep", "label", "late"))
        sets = [np.frombuffer(s.as_buffer(), "i8") for s in t.column("set")]
        sizes = np.array([len(s) for s in sets])
        members = np.flatnonzero(~is_late.astype(bool))
        heads = np.concatenate([sets[i][:K] for i in members]) if len(members) else np.zeros(0, "i8")
        owner = np.repeat(np.arange(len(members)), np.minimum(sizes[members], K))
        order = np.argsort(heads, kind="stable")
        heads, owner = heads[order], owner[order]
        out = []
        for y in np.flatnonzero(is_late):
            head = sets[y][:K]
            spans = zip(np.searchsorted(heads, head, "left").tolist(), np.searchsorted(heads, head, "right").tolist(), strict=True)
            common = np.bincount(np.concatenate([owner[i:j] for i, j in spans]), minlength=len(members))
            need = least * np.minimum(K, np.maximum(sizes[members], sizes[y]))
            near = np.flatnonzero((common >= need) & (label[members] != label[y]))
            done = set()
            for i in near[np.argsort(-common[near], kind="stable")]:
                x = members[i]
                if label[x] not in done and linked(sets[y], sets[x], percent):
                    done.add(label[x])
                    out.append((min(reps[x], reps[y]), max(reps[x], reps[y])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return every.join(full, "rep").groupBy("v", "block", "chunk").applyInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, k: int = K, long: int = LONG) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for every row of ``docs``.

    Words are lower-cased (A-Z) runs of other characters than ASCII white space; a set holds the distinct
    shingles of ``width`` words, or a shorter text's whole sequence. Documents are linked at 100 * intersection
    >= ``percent`` * union; component_id is the smallest doc_id reachable. Null and empty texts have
    empty sets and are linked with nothing. Rows without a doc_id are linked with nothing and have no
    component_id, but are kept. Rows that repeat a doc_id are one document, with the links of all of them; repeated
    rows are all kept or all dropped. Extra columns are ignored.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = written(shingle_sets(source, width, k), "sets")
    named = sets.where("doc_id is not null and n > 0")
    reps = written(named.groupBy("fp", "n").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")), "reps")

    postings = reps.select(F.explode("sketch").alias("v"), "rep", "n")
    counts = written(postings.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "counts")
    frequent_values = counts.where(F.col("df") > long)
    frequent = written(_by_value(postings, frequent_values).select("v", "rep", "n"), "frequent")
    plain = postings.join(_bounded(frequent_values.select("v"), frequent_values.count()), "v", "left_anti")
    shared = plain.join(counts.where(F.col("df") <= long).select("v"), "v")
    poor = frequent.groupBy("rep", "n").agg(F.count("*").alias("hot")).where(F.col("hot") > RICH * F.least(F.col("n"), F.lit(k))).select("rep")
    hot = written(frequent.join(poor, "rep", "left_semi"), "hot")
    hot = written(_by_value(hot, hot.groupBy("v").agg(F.count("*").alias("df"), F.min("rep").alias("hub"))), "hot-lists")
    short = shared.select("v", "rep", "n").unionByName(hot.where((F.col("df") > 1) & (F.col("df") <= long)).select("v", "rep", "n"))
    long_lists = hot.where(F.col("df") > long)
    stars = long_lists.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    least = percent / 100 - ESTIMATE_SLACK
    pairs = written(_estimated(_list_pairs(short, percent).union(stars).distinct(), reps, k, least), "pairs")

    texts = source.where("doc_id is not null and text is not null")
    first = written(pairs.groupBy("b").agg(F.max_by("a", F.struct("est", -F.col("a"))).alias("a")).select("a", "b"), "first")
    labels = components(_verified(first, reps, texts, width, percent))
    la, lb = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    rest = pairs.select("a", "b").join(first, ["a", "b"], "left_anti").join(la, "a", "left").join(lb, "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b"))
    labels = components(_verified(rest, reps, texts, width, percent), labels)
    lead = long_lists.select("v", "rep").join(reps.select("rep", F.slice("sketch", 1, LEAD).alias("lead")), "rep").where(F.array_contains("lead", F.col("v"))).select("v", "rep")
    lead = written(lead, "lead")
    if not lead.isEmpty():
        labels = components(written(_stragglers(lead, labels, texts, width, percent), "links"), labels)

    classes = reps.select("fp", "n", "rep").join(labels, reps["rep"] == labels["node"], "left").select("fp", "n", F.coalesce("label", "rep").alias("component"))
    by_row = sets.join(classes, ["fp", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return by_row.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, **kwargs: int) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest doc_id."""
    dropped = written(near_duplicates(docs, **kwargs).where(~F.col("kept")).select("doc_id").distinct(), "dropped")
    return docs.join(_bounded(dropped, dropped.count()), "doc_id", "left_anti")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
