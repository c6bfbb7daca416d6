"""Hard negatives by a Voronoi-partitioned distributed join.

Vectors are integers. A component is added to each row that makes all norms equal, and 0 to an anchor, so that the largest
inner products are the smallest distances. Every row goes to the cell of its nearest pivot and keeps its distance to it;
anchors are put into groups of bounded size by their own nearest pivot. For a group and a cell, the largest and the smallest product of an
anchor with the pivot, and the longest anchor, bound the score of a row by the row's distance to its pivot. A row is sent to those groups only whose bound it can reach:

* positives: at least the score that the rows nearest to the pivots already guarantee to every anchor of the group;
* negatives: a score within the window that the group's positives open.

A group's candidates are dealt over chunks by their ids, so neither a hot label nor a hot cell fills one task; each (group, chunk) is
joined exactly, and the chunks' best are merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jadwal.llm.common import partitions, table, written
from jadwal.shipping import ship

PIVOTS = 128
GROUP_ANCHORS, CHUNK_ROWS = 16_384, 16_384
QUERIES_AT_ONCE = 256
BROADCAST_ROWS, SALTS = 500_000, 16
EXACT = 2.0**52  # products below this are exact in double precision


def labelled_cells(df: DataFrame, id_col: str, vec_col: str, label: Column, scale: int) -> DataFrame:
    """vec_id, label, cells: floor(scale * x) of the rows whose label and components are all there and finite, one row an id.

    Of rows that share an id, that with the smallest label, then with the smallest cells, takes part.
    """
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & v.isNotNull()).where(fine)
    rows = rows.select(
        F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(v, lambda x: F.floor(x * scale)).alias("cells")
    ).where("label is not null")
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "cells")).alias("r")).select("vec_id", "r.label", "r.cells")


def matrix(cells: pa.Array, dims: int) -> np.ndarray:
    """Integer vectors as rows; missing components are 0."""
    sizes = np.diff(cells.offsets.to_numpy())
    out = np.zeros((len(cells), dims), "i8")
    out[np.arange(dims) < sizes[:, None]] = cells.flatten().to_numpy(zero_copy_only=False)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    norm = lambda x: float((x.astype("f8") ** 2).sum(1).max(initial=0))
    if norm(a) * norm(b) < EXACT**2:
        return (a.astype("f8") @ b.astype("f8").T).astype("i8")
    return (a.astype(object) @ b.astype(object).T).astype("i8")  # beyond 64 bits this is an error


class Pivots:
    """Rows that start cells, with the component that makes all norms equal."""

    def __init__(self, cells: list, dims: int, longest: float):
        self.at = np.array([c + [0] * (dims - len(c)) for c in cells], "f8").reshape(-1, dims)
        self.longest = longest
        self.extra = self.lift(self.at)

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.longest - (x * x).sum(1)))

    def placed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's nearest pivot and the distance to it."""
        near = x @ self.at.T + self.lift(x)[:, None] * self.extra
        best = near.argmax(1)
        return best, np.sqrt(np.maximum(0.0, 2 * (self.longest - near[np.arange(len(x)), best])))


def _spread(rows: DataFrame, other: DataFrame, on: list[str], by: str) -> DataFrame:
    """``rows`` joined with a table of few rows a key; a frequent key never fills one task."""
    other = written(other, "bounds")
    if other.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(other), on)
    salted = other.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(salted, [*on, "salt"]).drop("salt")


def _groups(anchors: DataFrame, keys: list[str], size: int) -> DataFrame:
    """``anchors`` with ``run`` and ``part``: neighbouring cells together up to about ``size`` anchors, a larger cell in parts."""
    counts = anchors.groupBy(*keys, "home").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("home").rowsBetween(Window.unboundedPreceding, -1))
    runs = counts.select(*keys, "home", F.floor(F.coalesce(before, F.lit(0)) / size).alias("run"), F.ceil(F.col("n") / size).alias("parts"))
    return _spread(anchors, runs, [*keys, "home"], "vec_id").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).drop("parts", "home")


def _bounds(anchors: DataFrame, pivots: Pivots, group: list[str]) -> DataFrame:
    """group, pivot, most and least product of an anchor with the pivot, norm of the longest anchor."""
    dims = pivots.at.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("cells"), dims).astype("f8")
            near, norm = x @ pivots.at.T, np.sqrt((x * x).sum(1))
            names = np.stack([batch.column(g).to_numpy(zero_copy_only=False) for g in group], 1)
            known, which = np.unique(names, axis=0, return_inverse=True)
            for i, name in enumerate(known):
                own = near[which.ravel() == i]
                columns = {g: pa.array([int(v)] * len(pivots.at), pa.int64()) for g, v in zip(group, name, strict=True)}
                yield pa.RecordBatch.from_pydict(
                    columns | {
                        "pivot": pa.array(range(len(pivots.at)), pa.int32()), "most": own.max(0), "least": own.min(0),
                        "norm": np.full(len(pivots.at), norm[which.ravel() == i].max())
                    }
                )

    schema = ", ".join(f"{g} long" for g in group) + ", pivot int, most double, least double, norm double"
    return anchors.select(*group, "cells").mapInArrow(work, schema).groupBy(*group, "pivot").agg(
        F.max("most").alias("most"), F.min("least").alias("least"), F.max("norm").alias("norm")
    )


def _joined(anchors: DataFrame, served: DataFrame, group: list[str], chunks: int, work: Callable, schema: str) -> DataFrame:
    """``work`` (anchors, candidates) for every group and chunk."""
    chunk = F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int").alias("chunk")
    left = anchors.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).groupBy(*group, "chunk")
    return left.cogroup(served.select("*", chunk).groupBy(*group, "chunk")).applyInArrow(work, schema)


def best_first(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, of equal ones the first places."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        above, ties = np.flatnonzero(score > least), np.flatnonzero(score == least)
        chosen = np.concatenate([above, ties[: k - len(above)]])
    else:
        chosen = np.arange(len(score))
    return chosen[np.lexsort((chosen, -score[chosen]))]


def _positives(anchors: DataFrame, rows: DataFrame, pivots: Pivots, k: int, chunks: int, group_anchors: int) -> DataFrame:
    """anchor_id, positive_id, score: each anchor's ``k`` best other rows of its label."""
    group, dims = ["label", "run", "part"], pivots.at.shape[1]
    anchors = written(_groups(anchors, ["label"], group_anchors), "anchors")
    bounds = written(_bounds(anchors, pivots, group), "anchor-bounds")
    # an anchor may be among the rows nearest to a pivot, so one more than k of them is looked at
    closest = rows.select(
        "label", "pivot", "away", F.row_number().over(Window.partitionBy("label", "pivot").orderBy("away")).alias("i")
    ).where(F.col("i") <= k + 1)
    sure = bounds.join(closest, ["label", "pivot"]).withColumn("score", F.col("least") - F.col("norm") * F.col("away"))
    kth = sure.withColumn(
        "i", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score")))
    ).where(F.col("i") == k + 1).select(*group, F.col("score").alias("need"))
    asked = bounds.join(kth, group, "left").select(*group, "pivot", "most", "norm", "need")
    may = F.col("need").isNull() | (F.col("most") + F.col("norm") * F.col("away") + F.abs("most") * 1e-9 + 1 >= F.col("need"))
    served = _spread(rows, asked, ["label", "pivot"], "vec_id").where(may).select(*group, "vec_id", "cells")

    def work(a: pa.Table, c: pa.Table) -> pa.Table:
        asker, ids = a.column("vec_id").to_numpy(), c.column("vec_id").to_numpy()
        order = np.argsort(ids)
        ids, x, q = ids[order], matrix(c.column("cells").combine_chunks(), dims)[order], matrix(a.column("cells").combine_chunks(), dims)
        out: list[tuple[int, int, int]] = []
        for at in range(0, len(q), QUERIES_AT_ONCE):
            for i, score in enumerate(products(q[at : at + QUERIES_AT_ONCE], x), at):
                found = [j for j in best_first(score, k + 1).tolist() if ids[j] != asker[i]][:k]
                out += [(int(asker[i]), int(ids[j]), int(score[j])) for j in found]
        return pa.table({n: pa.array([r[p] for r in out], pa.int64()) for p, n in enumerate(("anchor_id", "positive_id", "score"))})

    found = _joined(anchors.select(*group, "vec_id", "cells"), served, group, chunks, work, "anchor_id long, positive_id long, score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id"))
    return found.withColumn("i", rank).where(F.col("i") <= k).drop("i")


def _negatives(
    anchors: DataFrame, rows: DataFrame, positives: DataFrame, pivots: Pivots, k: int, low: int, high: int, chunks: int, group_anchors: int
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    group, dims = ["run", "part"], pivots.at.shape[1]
    mine = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "score")).alias("positives"))  # at most one a positive
    anchors = written(_groups(anchors.join(mine, "vec_id"), [], group_anchors), "anchors")
    ends = [F.when(F.col("p.score") >= 0, F.col("p.score") * c).otherwise(F.col("p.score") * d) / 100 for c, d in ((low, high), (high, low))]
    windows = anchors.select(*group, F.explode("positives").alias("p")).groupBy(*group).agg(
        F.min(F.least(*ends)).alias("from"), F.max(F.greatest(*ends)).alias("to")
    )
    asked = _bounds(anchors, pivots, group).join(windows, group)
    reach = F.col("norm") * F.col("away") + 1
    may = (F.col("most") + reach + F.abs("most") * 1e-9 >= F.col("from")) & (F.col("least") - reach - F.abs("least") * 1e-9 <= F.col("to"))
    served = _spread(rows, asked, ["pivot"], "vec_id").where(may).select(*group, "vec_id", "label", "cells")

    def work(a: pa.Table, c: pa.Table) -> pa.Table:
        asker, own, wanted = a.column("vec_id").to_numpy(), a.column("label").to_numpy(), a.column("positives").to_pylist()
        ids = c.column("vec_id").to_numpy()
        order = np.argsort(ids)
        ids, label = ids[order], c.column("label").to_numpy()[order]
        x, q = matrix(c.column("cells").combine_chunks(), dims)[order], matrix(a.column("cells").combine_chunks(), dims)
        out: list[tuple] = []
        for at in range(0, len(q), QUERIES_AT_ONCE):
            for i, score in enumerate(products(q[at : at + QUERIES_AT_ONCE], x), at):
                ends = [(low * p["score"], high * p["score"]) for p in wanted[i]]
                near = np.flatnonzero((label != own[i]) & (score >= min(e[0] for e in ends) // 100) & (score <= -(-max(e[1] for e in ends) // 100)))
                for p, (least, most) in zip(wanted[i], ends, strict=True):
                    fit = near[(100 * score[near] >= least) & (100 * score[near] <= most)]
                    out += [
                        (int(asker[i]), p["positive_id"], int(ids[j]), p["score"], int(score[j])) for j in fit[best_first(score[fit], k)].tolist()
                    ]
        names = ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")
        return pa.table({n: pa.array([r[p] for r in out], pa.int64()) for p, n in enumerate(names)})

    schema = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    found = _joined(anchors.select(*group, "vec_id", "label", "cells", "positives"), served, group, chunks, work, schema)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return found.select(
        "anchor_id", "positive_id", rank.cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    ).where(F.col("rank") <= k)


def hard_negatives(
    df: DataFrame, id_col: str, vec_col: str, label: Column, anchors: str, scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80,
    high: int = 100,
    pivots: int = PIVOTS, group_anchors: int = GROUP_ANCHORS, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` is a condition on vec_id. For each anchor and each of its ``positives`` best other rows of its label, the ``negatives`` best
    rows of other labels whose score is ``low`` to ``high`` percent of the positive's. Scores are inner products of floor(scale * x); of equal
    ones the smaller id comes first. Rows without id, label or vector, or with a null or non-finite component, take no part; rows that share an id
    are one row (``labelled_cells``); a shorter vector counts as if zeros followed. Anchors without positives, or whose windows are empty,
    have no rows. A score beyond 64 bits is an error. Other columns are ignored.
    """
    spark = df.sparkSession
    ship(spark)
    cells = written(labelled_cells(df, id_col, vec_col, label, scale), "cells")
    norm = F.aggregate("cells", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    n, dims, longest = cells.agg(F.count("*"), F.max(F.size("cells")), F.max(norm)).first()
    starts = cells.select("cells", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(pivots).collect()  # ``pivots`` rows
    if not n or not dims:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    by = Pivots([r["cells"] for r in starts], dims, longest)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("cells"), dims).astype("f8")
            pivot, away = by.placed(x)
            home = (x @ by.at.T).argmax(1)
            columns = [*batch.columns, pa.array(pivot, pa.int32()), pa.array(away + 1e-6 * (1 + away)), pa.array(home, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "cells", "pivot", "away", "home"])

    rows = written(cells.mapInArrow(place, "vec_id long, label long, cells array<long>, pivot int, away double, home int"), "placed")
    asking = rows.where(anchors).select("vec_id", "label", "cells", "home")
    chunks = max(partitions(spark), -(-n // chunk_rows))
    found = written(_positives(asking, rows.select("vec_id", "label", "cells", "pivot", "away"), by, positives, chunks, group_anchors), "positives")
    return _negatives(asking, rows.select("vec_id", "label", "cells", "pivot", "away"), found, by, negatives, low, high, chunks, group_anchors)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label, "vec_id % 100 = 0")


OP11_SQL = """WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM kept a JOIN kept b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positive AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, p.other AS positive_id, (row_number() OVER (PARTITION BY anchor_id, p.other ORDER BY n.score DESC, n.other))::INT AS rank, n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN scored n USING (anchor_id) WHERE NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score QUALIFY rank <= 5"""
