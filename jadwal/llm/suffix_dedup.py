"""Removal of repeated byte strings: suffix arrays over the shards of the text that can repeat.

A byte goes when it lies in a ``span``-byte string that also starts in a document with a smaller id.

1. Exact copies of a document with a smaller id are repeated whole, and leave.
2. Every span-byte window has an anchor: the gram with the smallest hash in it, so equal windows have equal
   anchors at equal offsets. The windows of one anchor form a context. Contexts are dealt by their anchor's hash
   over buckets of bounded size.
   An anchor with very many contexts would fill its bucket: a first pass over a fixed share of the documents counts contexts by
   anchor, and the contexts of anchors above a limit that does not depend on the size are dealt by their own hash instead.
3. Equal contexts collapse to their smallest document, in each batch first, so that a frequent line sends a bucket one
   entry a batch; a later document's context is repeated throughout.
4. Where an anchor has several contexts, a window may also occur in another one. Those contexts are sharded by
   anchor; each shard's suffix array is built by induced sorting, and runs of suffixes whose permuted common
   prefixes reach the span are equal windows, whose smallest document decides. The windows of an anchor with very
   many contexts, which would make a shard of its own, are grouped by content instead, which gives the same.
5. The repeated intervals are united per document and cut out of its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jadwal.llm.common import table, written
from jadwal.llm.suffix_array import permuted_common_prefixes, suffix_array
from jadwal.shipping import ship

SPAN = 50
GRAM = 24
BATCH_BYTES = 1 << 19
FLUSH_BYTES = 12 << 20
BUCKET_BYTES = 8 << 20  # of input text a bucket
SHARD_BYTES = 5 << 17
MANY_CONTEXTS = 5000
DEALT_CONTEXTS = 500_000  # contexts of one anchor that are dealt together, about 15 MB
SAMPLE_PART = 16
FREQUENT = 4096  # occurrences of a window whose rows are not shuffled by it
BROADCAST_ROWS = 500_000  # of at most four numbers each

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _join_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a ^ (a >> np.uint64(29))) * _A + b


def _final(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(31))) * _B
    return a ^ (a >> np.uint64(32))


class Grams:
    """Hashes of the byte strings of given lengths at every place of a buffer, by doubling."""

    def __init__(self, data: np.ndarray):
        first = (data.astype("u8") + np.uint64(1)) * _B
        self.by_size = {1: first ^ (first >> np.uint64(30))}
        self.n = len(data)

    def _power(self, size: int) -> np.ndarray:
        if size not in self.by_size:
            half = self._power(size // 2)
            self.by_size[size] = _join_hash(half[: -(size // 2)], half[size // 2 :]) if len(half) > size // 2 else half[:0]
        return self.by_size[size]

    def at(self, length: int, places: np.ndarray | None = None) -> np.ndarray:
        out, off, size = None, 0, 1 << (length.bit_length() - 1)
        while size:
            if length & size:
                part = self._power(size)
                part = part[off : off + self.n - length + 1] if places is None else part[places + off]
                out = part if out is None else _join_hash(out, part)
                off += size
            size >>= 1
        return _final(out)


def contexts(data: np.ndarray, starts: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document number, anchor hash, context hash, start, end in the buffer) of all contexts.

    ``starts``: the first byte of each document in the buffer. Windows lie in one document.
    """
    n = len(data) - span + 1
    empty = np.zeros(0, "i8")
    if n <= 0:
        return empty, empty.view("u8"), empty, empty, empty
    grams = Grams(data)
    h = grams.at(gram)
    best = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype="u8")
    wide, size = span - gram + 1, 1
    while 2 * size <= wide:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    anchor = (np.minimum(best[:n], best[wide - size : wide - size + n]) & np.uint64(0xFFFFFFFF)).astype("i8")
    ends = np.append(starts[1:], len(data))
    inside = np.zeros(len(data) + 1, "i4")
    room = np.maximum(ends - starts - span + 1, 0)
    np.add.at(inside, starts, (room > 0).astype("i4"))
    np.add.at(inside, starts + room, -(room > 0).astype("i4"))
    window = np.flatnonzero(np.cumsum(inside)[:n])
    if not len(window):
        return empty, empty.view("u8"), empty, empty, empty
    a = anchor[window]
    owner = np.searchsorted(starts, window, "right") - 1
    new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (owner[1:] != owner[:-1])))
    first, last = window[new], window[np.append(new[1:], len(window)) - 1]
    whole = _final(_join_hash(_join_hash(grams.at(span, first), grams.at(span, last)), (last - first).astype("u8")))
    return owner[new], h[a[new]], whole.view("i8"), first, last + span


ENTRY = "place long, low array<int>, context array<long>, doc array<long>, tid array<int>, start array<int>, size array<tinyint>"
MARKS = "doc long, tid int, first array<int>, end array<int>"
FOUND = MARKS + ", h long, n int, start int, size int"


def _by_document(doc: np.ndarray, tid: np.ndarray, first: np.ndarray, end: np.ndarray) -> dict[str, pa.Array]:
    """MARKS: one row per document, overlapping intervals united."""
    order = np.lexsort((first, tid, doc))
    doc, tid, first, end = (c[order] for c in (doc, tid, first, end))
    other = np.append(True, (doc[1:] != doc[:-1]) | (tid[1:] != tid[:-1]))[: len(doc)]
    new = np.flatnonzero(other | np.append(True, first[1:] > end[:-1])[: len(doc)])  # contexts of a document end in the order in which they start
    doc, tid, first, end = doc[new], tid[new], first[new], np.maximum.reduceat(end, new) if len(new) else end
    row = np.flatnonzero(other[new])
    offsets = pa.array(np.append(row, len(doc)), pa.int32())
    lists = lambda c: pa.ListArray.from_arrays(offsets, pa.array(c.astype("i4")))
    return {"doc": pa.array(doc[row]), "tid": pa.array(tid[row]), "first": lists(first), "end": lists(end)}


def _context_batches(batches: Iterator[pa.RecordBatch], span: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(doc, tid, anchor hash, context hash, start, size) of the contexts of about FLUSH_BYTES of texts at a time."""
    parts: list[tuple[np.ndarray, ...]] = []
    held = 0
    for batch in batches:
        ids, tids, raw = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
        sizes = np.array([len(x.as_py()) if x.is_valid else 0 for x in raw])
        at = 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), BATCH_BYTES)) + at)
            data = np.frombuffer(b"".join(x.as_py() for x in raw[at:to]), "u1")
            starts = np.cumsum(sizes[at:to]) - sizes[at:to]
            owner, h, context, first, end = contexts(data, starts, span, gram)
            if len(h):
                doc = at + owner
                parts.append((ids[doc], tids[doc], h, context, (first - starts[owner]).astype("i4"), (end - first).astype("i1")))
            held += len(data)
            at = to
            if held >= FLUSH_BYTES and parts:
                yield tuple(np.concatenate(c) for c in zip(*parts, strict=True))
                parts, held = [], 0
    if parts:
        yield tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _texts(docs: DataFrame, span: int) -> DataFrame:
    return docs.select("doc_id", "tid", F.col("text").cast("binary")).where(F.octet_length("text") >= span)


def heavy_anchors(docs: DataFrame, most: int, span: int, gram: int, part: int | None = None) -> np.ndarray:
    """The hashes of the anchors with more than about ``most`` contexts, in order.

    They are counted on every ``part``-th document (SAMPLE_PART), single contexts included, so it does not matter over how many batches an anchor's contexts
    are spread. The limit is the same at every size: an anchor that is left out has about ``most`` contexts at most, and as each of those found has
    more, their number is a fixed small share of the text (eight bytes for ``most`` contexts).
    """
    part = part or SAMPLE_PART

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, h, context, _, _ in _context_batches(batches, span, gram):
            order = np.lexsort((context, h))
            h, context = h[order], context[order]
            h = h[np.append(True, (h[1:] != h[:-1]) | (context[1:] != context[:-1]))]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(h[first].view("i8")), pa.array(np.diff(np.append(first, len(h))))], ["h", "n"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id", "tid"), F.lit(part)) == 0)
    counts = _texts(sample, span).mapInArrow(work, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") * part > most).select("h").toArrow().column("h").to_numpy()
    return np.sort(found.astype("i8").view("u8"))


def _entries(docs: DataFrame, buckets: int, heavy: np.ndarray, span: int, gram: int) -> DataFrame:
    """Rows of ENTRY: the contexts of each batch by bucket of their anchor, combined as far as the batch can.

    Of equal contexts only those of the batch's smallest document go to the bucket. The others are repeated for certain;
    their united intervals pass at a negative place, with the interval's end in ``low``. Contexts of ``heavy`` anchors go to
    the places from ``buckets`` on, by their own hash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def flush(doc: np.ndarray, tid: np.ndarray, h: np.ndarray, context: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((doc, context, h))
        run = np.flatnonzero(np.append(True, (h[order][1:] != h[order][:-1]) | (context[order][1:] != context[order][:-1])))
        least = np.empty(len(h), "i8")
        least[order] = np.repeat(doc[order][run], np.diff(np.append(run, len(h))))
        gone, keep = np.flatnonzero(doc > least), np.flatnonzero(doc == least)
        out: list[tuple] = []
        low = (h & np.uint64(0xFFFFFFFF)).astype("u4").view("i4")
        bucket = ((h[keep] >> np.uint64(32)) % np.uint64(buckets)).astype("i8")
        if len(shared.value):
            at = np.searchsorted(shared.value, h[keep]).clip(0, len(shared.value) - 1)
            by_context = buckets + (context[keep].view("u8") % np.uint64(buckets)).astype("i8")
            bucket = np.where(shared.value[at] == h[keep], by_context, bucket)
        by = np.argsort(bucket, kind="stable")  # in a bucket in order of documents, which shuffles small
        for part in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
            out.append((int(bucket[part[0]]), *[c[keep[part]] for c in (low, context, doc, tid, start, size)]))
        if len(gone):
            marks = _by_document(doc[gone], tid[gone], start[gone], start[gone] + size[gone])
            repeats = np.diff(marks["first"].offsets.to_numpy())
            columns = [marks["end"].flatten().to_numpy(), np.zeros(0, "i8"), np.repeat(marks["doc"].to_numpy(), repeats), np.repeat(marks["tid"].to_numpy(), repeats), marks["first"].flatten().to_numpy(), np.zeros(0, "i1")]
            out.append((-1 - int(doc[gone[0]]) % buckets, *columns))
        types = [pa.int64(), *[pa.list_(t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int8())]]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["place", "low", "context", "doc", "tid", "start", "size"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _context_batches(batches, span, gram):
            yield from flush(*found)

    return _texts(docs, span).mapInArrow(work, ENTRY)


def _flat(t: pa.Table, name: str, dtype: str) -> np.ndarray:
    column = t.column(name).combine_chunks()
    return (column.flatten() if len(column) else pa.array([], pa.int64())).to_numpy(zero_copy_only=False).astype(dtype)


def shared_contexts(docs: DataFrame, buckets: int, span: int, gram: int, many: int) -> DataFrame:
    """Rows of FOUND: intervals repeated because an earlier document has the whole context; and, with ``n`` contexts of its
    anchor, each context of an anchor with several whose windows are still to be compared (``h`` 0 for heavy anchors)."""
    heavy = heavy_anchors(docs, DEALT_CONTEXTS, span, gram)

    def meet(t: pa.Table) -> pa.Table:
        low, doc, tid, start = (_flat(t, n, d) for n, d in (("low", "i8"), ("doc", "i8"), ("tid", "i4"), ("start", "i8")))
        if t.column("place")[0].as_py() < 0:
            marks, rest = _by_document(doc, tid, start, low), np.zeros(0, "i8")
            h = n = size = rest
        else:
            context, size = _flat(t, "context", "i8"), _flat(t, "size", "i8")
            place = t.column("place")[0].as_py()
            h = (np.int64(place) << np.int64(32)) | low & np.int64(0xFFFFFFFF)
            order = np.lexsort((doc, context, h))
            new_h = np.append(True, h[order][1:] != h[order][:-1])
            new = new_h | np.append(True, context[order][1:] != context[order][:-1])
            run = np.flatnonzero(new)
            least = np.empty(len(h), "i8")
            least[order] = np.repeat(doc[order][run], np.diff(np.append(run, len(h))))
            anchor = np.flatnonzero(new_h[run])  # each anchor's first context
            several = np.diff(np.append(anchor, len(run)))
            firsts = doc[order][run]
            contested = (several > 1) & (np.minimum.reduceat(firsts, anchor) < np.maximum.reduceat(firsts, anchor))
            per_anchor = np.diff(np.append(run[anchor], len(h)))
            n_of, open_ = np.empty(len(h), "i8"), np.empty(len(h), bool)
            n_of[order], open_[order] = np.repeat(several, per_anchor), np.repeat(contested, per_anchor)
            if place >= buckets:  # the anchor's other contexts are elsewhere
                h, n_of, open_ = np.zeros_like(h), np.full(len(h), many + 1), np.ones(len(h), bool)
            gone = np.flatnonzero(doc > least)
            marks = _by_document(doc[gone], tid[gone], start[gone], start[gone] + size[gone])
            rest = np.flatnonzero(open_ & (doc == least))
            n = n_of
        none = lambda k, kind: pa.nulls(k, kind)
        lists, k, m = pa.list_(pa.int32()), len(marks["doc"]), len(rest)
        one = pa.table({**marks, "h": none(k, pa.int64()), "n": none(k, pa.int32()), "start": none(k, pa.int32()), "size": none(k, pa.int32())})
        two = pa.table({"doc": doc[rest], "tid": tid[rest], "first": none(m, lists), "end": none(m, lists), "h": h[rest], "n": n[rest].astype("i4"), "start": start[rest].astype("i4"), "size": size[rest].astype("i4")})
        return pa.concat_tables([one, two])

    return _entries(docs, buckets, heavy, span, gram).groupBy("place").applyInArrow(meet, FOUND)


def _marks_by_suffix_array(shards: DataFrame, span: int) -> DataFrame:
    """MARKS: the windows of contexts (shard, doc, tid, start, body) that a context of a smaller document has."""

    def search(t: pa.Table) -> pa.Table:
        bodies, doc, begin = t.column("body").to_pylist(), t.column("doc").to_numpy(), t.column("start").to_numpy()
        sizes = np.array([len(b) for b in bodies])
        text = np.frombuffer(b"".join(b + b"\0" for b in bodies), "u1").astype("u2") + 2
        ends = np.cumsum(sizes + 1) - 1
        text[ends] = 1  # smaller than every byte
        text = np.append(text, 0).astype("u2")
        order = suffix_array(text, 258)
        prefix = permuted_common_prefixes(text, order, 2 * span, ends - sizes)
        owner = np.repeat(np.arange(len(sizes)), sizes + 1)
        room = ends[owner] - np.arange(len(owner))
        order = order[order < len(owner)]
        order = order[room[order] >= span]  # windows, in suffix order; what stood between two equal ones was equal too
        run = np.flatnonzero(np.append(True, prefix[order[1:]] < span))
        least = np.repeat(np.minimum.reduceat(doc[owner[order]], run), np.diff(np.append(run, len(order))))
        hit = np.sort(order[least < doc[owner[order]]])
        at = owner[hit]
        first = begin[at] + hit - (ends - sizes)[at]
        return pa.table(_by_document(doc[at], t.column("tid").to_numpy()[at], first, first + span))

    return shards.groupBy("shard").applyInArrow(search, MARKS)


def _marks_by_content(many: DataFrame, span: int) -> DataFrame:
    """The same for anchors with very many contexts: windows grouped by their bytes."""
    windows = many.select("h", "doc", "tid", "start", F.posexplode(F.transform(F.sequence(F.lit(1), F.octet_length("body") - span + 1), lambda i: F.substring("body", i, F.lit(span)))).alias("at", "window"))
    least = windows.groupBy("h", "window").agg(F.min("doc").alias("least"), F.max("doc").alias("last"), F.count("*").alias("times")).where("least < last")
    least = written(least.drop("last"), "windows")
    frequent = least.where(F.col("times") > FREQUENT)
    n_frequent = frequent.count()
    if n_frequent <= BROADCAST_ROWS:  # the rows of a frequent window stay where they are
        often = windows.join(F.broadcast(frequent), ["h", "window"])
        seldom = windows.join(F.broadcast(frequent), ["h", "window"], "left_anti").join(least.where(F.col("times") <= FREQUENT), ["h", "window"])
        hit = often.unionByName(seldom)
    else:
        hit = windows.join(least, ["h", "window"])
    hit = hit.where("least < doc").select("doc", "tid", (F.col("start") + F.col("at")).alias("p"))
    return hit.groupBy("doc", "tid").agg(F.array_sort(F.collect_set("p")).alias("first")).withColumn("end", F.transform("first", lambda p: p + span))


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def repeated_intervals(docs: DataFrame, total_bytes: int, span: int = SPAN, gram: int = GRAM, many: int = MANY_CONTEXTS) -> DataFrame:
    """doc_id, tid, spans (lists of first and end): the repeated intervals of documents (doc_id, tid, text) with distinct texts."""
    found = written(shared_contexts(docs, max(1, -(-total_bytes // BUCKET_BYTES)), span, gram, many), "found")
    contested = found.where("h is not null").select("h", "n", F.col("doc").alias("doc_id"), "tid", "start", "size")
    ids = written(contested.select("doc_id", "tid").distinct(), "owners")
    own = docs.join(_bounded(ids, ids.count()), ["doc_id", "tid"], "left_semi").select("doc_id", "tid", F.col("text").cast("binary").alias("raw"))
    bodies = contested.join(own, ["doc_id", "tid"]).select("h", "n", F.col("doc_id").alias("doc"), "tid", "start", F.expr("substring(raw, start + 1, size)").alias("body"))
    bodies = written(bodies, "bodies")
    volume = bodies.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    shards = bodies.where(F.col("n") <= many).withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(max(1, -(-volume // SHARD_BYTES)))))
    marks = found.where("h is null").select("doc", "tid", "first", "end").unionByName(_marks_by_suffix_array(shards, span)).unionByName(_marks_by_content(bodies.where(F.col("n") > many), span))
    return marks.groupBy(F.col("doc").alias("doc_id"), "tid").agg(F.collect_list(F.struct("first", "end")).alias("spans"))


def cut_out(raw: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """(bytes removed, maximal runs removed, remaining bytes); ``spans`` in order."""
    removed = runs = at = 0
    kept = []
    for first, end in spans:
        if first > at or not runs:
            kept.append(raw[at:first])
            runs += 1
            removed += end - first
            at = end
        elif end > at:
            removed += end - at
            at = end
    kept.append(raw[at:])
    return removed, runs, b"".join(kept)


def without_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, many: int = MANY_CONTEXTS, with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept`` bytes if asked for): one row for every row.

    Null texts are empty. Rows without a doc_id lose nothing and make nothing repeated. Rows that repeat a doc_id
    are not smaller than each other. Extra columns are ignored.
    """
    ship(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tid", F.hash("text"))
    sizes = written(base.select("doc_id", "tid", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "sizes")
    long_ones = sizes.where((F.col("n_bytes") >= span) & F.col("doc_id").isNotNull())
    first = long_ones.groupBy("sha").agg(F.min("doc_id").alias("d0"))
    copies = written(long_ones.join(first, "sha").where("doc_id > d0").select("doc_id", "tid").distinct(), "copies")
    total = long_ones.agg(F.sum("n_bytes")).first()[0] or 0
    texts = base.where("doc_id is not null").join(_bounded(copies, copies.count()), ["doc_id", "tid"], "left_anti")
    spans = written(repeated_intervals(texts, total, span, gram, many), "spans")
    touched = _bounded(spans.select("doc_id", "tid"), spans.count())
    joined = texts.join(touched, ["doc_id", "tid"], "left_semi").join(spans, ["doc_id", "tid"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [cut_out(text.encode(), sorted(p for s in spans for p in zip(s["first"], s["end"], strict=True))) for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            columns = [batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string())]
            if with_kept:
                columns.append(pa.array([r[2] for r in rows], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tid", "n_removed", "n_spans", "kept_sha256", "kept"][: len(columns)])

    extra = ", kept binary" if with_kept else ""
    changed = joined.select("doc_id", "tid", "text", "spans").mapInArrow(work, "doc_id long, tid int, n_removed long, n_spans long, kept_sha256 string" + extra)
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    gone = copies.join(sizes.select("doc_id", "tid", "n_bytes").distinct(), ["doc_id", "tid"]).select("doc_id", "tid", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), empty.alias("kept_sha256"), *([F.lit(b"").alias("kept")] if with_kept else []))
    results = changed.unionByName(gone).dropDuplicates(["doc_id", "tid"])
    out = sizes.join(results, ["doc_id", "tid"], "left")
    columns = ["doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")]
    return out.select(*columns, *(["kept"] if with_kept else []))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
