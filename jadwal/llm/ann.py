"""Nearest neighbours by a hash-prefix forest.

Equal vectors are collapsed to one (with their smallest ids; more than k + 1 of them can never be
asked for), and the distinct vectors are dealt evenly over blocks of bounded size. A block holds, per tree, the sorted
array of its vectors' hash strings. A string's symbols are each the largest of ``WIDTH`` random projections with its
sign, so that vectors at a small angle often share a long prefix. A query descends every tree to its
longest matching prefix and then ascends all trees together, one bit at a time, until the ranges under
the common prefix length hold ``LEAST`` entries, a fixed number for every query. Candidates are scored exactly, in
double precision.

The queries are cut into large chunks; each (chunk, block) pair is one task, which is the stated query
set against all rows in blocks. Every row is indexed. A block is sent, and its forest built, once for each chunk and not for each query: at two queries in
a hundred rows, the vectors are shuffled once for each 6.5 million rows. Work grows with queries times blocks, as it must for a
recall that does not fall with the rows where vectors have no cluster structure.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jadwal.llm.common import table, written
from jadwal.shipping import ship

TREES = 224
WIDTH, SYMBOLS = 32, 4
LEAST = 4096  # entries that the ranges of all trees hold together, counted with repetition
BLOCK_ROWS = 65_536
CHUNK_QUERIES = 131_072  # 64 MB of vectors of 64 components; a block's forest serves so many queries
QUERIES_AT_ONCE = 512


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and vector of the rows that take part: no null, zero, NaN or infinite components, id not null."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(fine)


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """v, ids: each distinct vector with its ``keep`` smallest ids."""
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= keep)
    return ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))


class Forest:
    """Sorted arrays of hash strings over some vectors, one array a tree."""

    def __init__(self, x: np.ndarray, trees: int = TREES, seed: int = 11):
        self.n, self.bits = len(x), SYMBOLS * (2 * WIDTH - 1).bit_length()
        self.planes = [np.random.default_rng([seed, x.shape[1], t]).standard_normal((x.shape[1], SYMBOLS * WIDTH)).astype("f4") for t in range(trees)]
        single = x.astype("f4")
        self.order, self.keys = np.empty((trees, self.n), "i4"), np.empty((trees, self.n), "i4")
        for t in range(trees):
            keys = self.strings(single, t)
            self.order[t] = np.argsort(keys, kind="stable")
            self.keys[t] = keys[self.order[t]]

    def strings(self, x: np.ndarray, t: int) -> np.ndarray:
        """The hash strings of the rows of ``x`` in tree ``t``, first symbol highest."""
        y = (x @ self.planes[t]).reshape(len(x), SYMBOLS, WIDTH)
        best = np.abs(y).argmax(2)
        code = 2 * best + (np.take_along_axis(y, best[:, :, None], 2)[:, :, 0] > 0)
        return (code << np.arange((SYMBOLS - 1) * (2 * WIDTH - 1).bit_length(), -1, -(2 * WIDTH - 1).bit_length())).sum(1).astype("i4")

    def candidates(self, q: np.ndarray, least: int = LEAST) -> Iterator[np.ndarray]:
        """For each query, the vectors under the longest common prefix length with ``least`` entries."""
        trees, single = len(self.planes), q.astype("f4")
        keys = np.stack([self.strings(single, t) for t in range(trees)])
        lo, hi = np.zeros((trees, len(q)), "i4"), np.full((trees, len(q)), self.n, "i4")
        open_ = np.arange(len(q))
        for depth in range(self.bits, 0, -1):
            drop = self.bits - depth
            first = keys[:, open_] >> drop << drop
            for t in range(trees):
                lo[t, open_] = np.searchsorted(self.keys[t], first[t], "left")
                hi[t, open_] = np.searchsorted(self.keys[t], first[t] + ((1 << drop) - 1), "right")
            short = (hi[:, open_] - lo[:, open_]).sum(0) < least
            open_ = open_[short]
            if not len(open_):
                break
        lo[:, open_], hi[:, open_] = 0, self.n  # at the root
        for i in range(len(q)):
            seen = np.zeros(self.n, bool)
            for t in np.flatnonzero(hi[:, i] > lo[:, i]):
                seen[self.order[t, lo[t, i] : hi[t, i]]] = True
            yield np.flatnonzero(seen)


def matrices(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The vectors of a list column by their number of components: (rows, one vector a row)."""
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    starts, flat = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py(), lists.flatten().to_numpy(zero_copy_only=False)
    out = {}
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        out[dim] = (rows, flat[starts[rows][:, None] + np.arange(dim)])
    return out


def nearest(data: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int = 5, trees: int = TREES, least: int = LEAST, block_rows: int = BLOCK_ROWS, chunk_queries: int = CHUNK_QUERIES, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its ``k`` nearest found rows by cosine.

    A row is never its own neighbour; equal scores go by the smaller id. Rows whose vector is null,
    zero, or holds null or non-finite components take no part, nor do rows without an id or with
    another number of components than the query. Repeated ids count as one row per distinct vector.
    Other columns are ignored.
    """
    ship(data.sparkSession)
    rows = written(distinct_vectors(usable(data, id_col, vec_col).distinct(), k + 1), "vectors")
    asked = usable(queries, id_col, vec_col).distinct()
    blocks = max(1, -(-rows.count() // block_rows))
    dealt = rows.select(F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int").alias("block"), "v", "ids")
    chunks = max(1, -(-asked.count() // chunk_queries))
    spread = asked.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(q: pa.Table, d: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        names, held, known = q.column("id").to_pylist(), d.column("ids").combine_chunks(), matrices(d.column("v"))
        for dim, (qi, ys) in matrices(q.column("v")).items():
            if dim not in known:
                continue
            di, x = known[dim]
            norms = np.sqrt((x * x).sum(1))
            forest = Forest(x / norms[:, None], trees, seed)
            for at in range(0, len(qi), QUERIES_AT_ONCE):
                part = ys[at : at + QUERIES_AT_ONCE]
                unit = part / np.sqrt((part * part).sum(1))[:, None]
                for i, found in enumerate(forest.candidates(unit, least)):
                    y, name = part[i], names[qi[at + i]]
                    near = (x[found] @ unit[i]) / norms[found]
                    n = min(len(found), k + 1)
                    found = found[near >= np.partition(near, len(near) - n)[len(near) - n] - 1e-9]
                    score = (x[found] * y).sum(1) / (norms[found] * np.sqrt((y * y).sum()))
                    best = sorted((-s, v) for s, f in zip(score.tolist(), found, strict=True) for v in held[int(di[f])].as_py() if v != name)[:k]
                    out[0].extend([name] * len(best))
                    out[1].extend(v for _, v in best)
                    out[2].extend(-s for s, _ in best)
        return pa.table([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema)

    if rows.isEmpty():
        return data.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    pairs = spread.groupBy("block", "chunk").cogroup(dealt.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).groupBy("block", "chunk"))
    found = pairs.applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 50 = 0"), "vec_id", "embedding")
