"""Lloyd's rounds on integer vectors, by filtering kd-trees.

Every partition grows kd-trees over its vectors once, without a shuffle; a tree's nodes hold count, integer sums and bounding
box, and the trees are written. In each round a node passes on only those centroids that can be nearest somewhere in its box: a
centroid goes when, at the box's corner that suits it best, the centroid nearest to the box's middle is still strictly nearer.
One that is left alone takes the whole node by its count and sums; leaves are resolved vector by vector. All arithmetic is on
integers, so that ties are ties (the smaller number wins) and results do not depend on partitions. What meets between
tasks is one count and one sum vector a centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jadwal.llm.common import table, written
from jadwal.shipping import ship

TREE_ROWS, LEAF_ROWS = 2048, 32
LARGEST = 1 << 27  # a component beyond this could not be squared and summed in 64 bits
TREES = "ids array<long>, points binary, spans binary, children binary, boxes binary, sums binary"


def cell_vectors(df: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """vec_id, cells: floor(scale * x) of the vectors with ``dims`` components, all finite."""
    v = F.col(vec_col).cast("array<double>")
    fine = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(v.isNotNull()).where(fine).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale)).alias("cells")
    )


class KdTree:
    """Nodes over the rows of ``points``, which are put into the tree's order."""

    def __init__(self, ids: list, points: np.ndarray, spans: np.ndarray, children: np.ndarray, boxes: np.ndarray, sums: np.ndarray):
        self.ids, self.points, self.spans, self.children, self.boxes, self.sums = ids, points, spans, children, boxes, sums

    @classmethod
    def grown(cls, ids: list, points: np.ndarray) -> KdTree:
        order, spans, children, boxes, sums = np.arange(len(points)), [(0, len(points))], [], [], []
        for first, last in spans:  # grows while it is read
            part = points[order[first:last]]
            low, high = part.min(0), part.max(0)
            boxes.append((low, high))
            sums.append(part.sum(0))
            if last - first <= LEAF_ROWS or not (high > low).any():
                children.append(0)
                continue
            middle = (last - first) // 2
            order[first:last] = order[first:last][np.argpartition(part[:, np.argmax(high - low)], middle)]
            children.append(len(spans))
            spans += [(first, first + middle), (first + middle, last)]
        return cls(
            [ids[i] for i in order], points[order], np.array(spans, "i8"), np.array(children, "i8"), np.array(boxes, "i8"), np.array(sums, "i8")
        )

    def row(self) -> dict:
        return {"ids": self.ids} | {
            name: np.ascontiguousarray(getattr(self, name), "<i8").tobytes() for name in ("points", "spans", "children", "boxes", "sums")
        }

    @classmethod
    def read(cls, row: dict, dims: int) -> KdTree:
        shapes = {"points": (-1, dims), "spans": (-1, 2), "children": (-1,), "boxes": (-1, 2, dims), "sums": (-1, dims)}
        return cls(row["ids"], *[np.frombuffer(row[name], "<i8").reshape(shape) for name, shape in shapes.items()])

    def assigned(self, centroids: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray | int]]:
        """node, first and last row, and the centroid of the whole node or of each of its rows."""
        stack = [(0, np.arange(len(centroids)))]
        while stack:
            node, left = stack.pop()
            low, high = self.boxes[node]
            if len(left) > 1:
                rivals = centroids[left]
                best = rivals[((2 * rivals - low - high) ** 2).sum(1).argmin()]
                corner = np.where(rivals > best, high, low)
                left = left[((rivals - corner) ** 2).sum(1) <= ((best - corner) ** 2).sum(1)]
            first, last = self.spans[node].tolist()
            if len(left) == 1:
                yield node, first, last, int(left[0])
            elif self.children[node]:
                stack += [(int(self.children[node]) + side, left) for side in (0, 1)]
            else:
                away = self.points[first:last, None] - centroids[left]
                yield node, first, last, left[(away * away).sum(2).argmin(1)]


def trees_of(cells: DataFrame, dims: int) -> DataFrame:
    """A row for each tree of at most TREE_ROWS vectors (vec_id, cells) of one partition."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held: list[np.ndarray] = []
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("i8").reshape(-1, dims)
            if (np.abs(flat) > LARGEST).any():
                raise ValueError(f"a component is beyond {LARGEST}, so distances do not fit into 64 bits")
            for at in range(0, len(flat), TREE_ROWS):
                ids += batch.column(0)[at : at + TREE_ROWS].to_pylist()
                held.append(flat[at : at + TREE_ROWS])
                if len(ids) >= TREE_ROWS:
                    whole = np.concatenate(held)
                    yield pa.RecordBatch.from_pylist([KdTree.grown(ids[:TREE_ROWS], whole[:TREE_ROWS]).row()], schema)
                    ids, held = ids[TREE_ROWS:], [whole[TREE_ROWS:]]
        if ids:
            yield pa.RecordBatch.from_pylist([KdTree.grown(ids, np.concatenate(held)).row()], schema)

    schema = pa.schema([("ids", pa.list_(pa.int64()))] + [(name, pa.binary()) for name in ("points", "spans", "children", "boxes", "sums")])
    return cells.mapInArrow(grow, TREES)


def _moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round; what reaches the driver is a count and a sum for each centroid and component."""
    k, dims = centroids.shape

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, "i8"), np.zeros((k, dims), "i8")
        for batch in batches:
            for i in range(batch.num_rows):
                tree = KdTree.read(batch.slice(i, 1).to_pylist()[0], dims)
                for node, first, last, who in tree.assigned(centroids):
                    if isinstance(who, int):
                        count[who] += last - first
                        total[who] += tree.sums[node]
                    else:
                        np.add.at(count, who, 1)
                        np.add.at(total, who, tree.points[first:last])
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict(
            {"cluster": pa.array(some, pa.int32()), "n": count[some], "total": pa.array(list(total[some]), pa.list_(pa.int64()))}
        )

    parts = trees.mapInArrow(gather, "cluster int, n long, total array<long>").select("cluster", "n", F.posexplode("total").alias("at", "total"))
    moved = centroids.copy()
    for r in parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        moved[r["cluster"], r["at"]] = r["total"] // r["n"]
    return moved


def clustered(cells: DataFrame, dims: int, k: int, rounds: int, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance for every row of ``cells`` (vec_id, cells), and the final centroids.

    The first centroids are the rows with the ``k`` smallest sha256 of ``seed:vec_id``, of equal ones the smaller cells; with fewer rows there are
    fewer centroids. Rows without a vec_id are clustered, but do not start a centroid. Repeated rows count as often as they occur. An empty
    cluster keeps its centroid. A component beyond LARGEST is an error.
    """
    ship(cells.sparkSession)
    trees = written(trees_of(cells, dims), "kd-trees")
    starts = cells.where("vec_id is not null").select(
        F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("hash"), "cells"
    ).orderBy("hash", "cells").limit(k).collect()
    centroids = np.array([r["cells"] for r in starts], "i8").reshape(-1, dims)
    if not len(centroids):
        return cells.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    for _ in range(rounds):
        centroids = _moved(trees, centroids)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tree = KdTree.read(batch.slice(i, 1).to_pylist()[0], dims)
                cluster = np.empty(len(tree.points), "i4")
                for _, first, last, who in tree.assigned(centroids):
                    cluster[first:last] = who
                away = tree.points - centroids[cluster]
                yield pa.RecordBatch.from_pydict({"vec_id": pa.array(tree.ids, pa.int64()), "cluster": cluster, "distance": (away * away).sum(1)})

    return trees.mapInArrow(resolve, "vec_id long, cluster int, distance long"), centroids


def kd_clusters(df: DataFrame, id_col: str, vec_col: str, dims: int = 64, scale: int = 64, k: int = 16, rounds: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every usable row; other rows and columns are left out.

    Rows whose vector is null, has another number of components, or holds null or non-finite ones take no part.
    """
    found, centroids = clustered(cell_vectors(df, id_col, vec_col, dims, scale), dims, k, rounds)
    found = written(found, "clusters")
    sums = {r["cluster"]: r["inertia"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # one row a centroid
    name = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    about = [(c, s, sum(sums.values()), name(c)) for c, s in sums.items()]
    return found.join(F.broadcast(df.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_clusters(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


_NEAREST = """SELECT vec_id, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
  SELECT vec_id, v, c, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, {means}) GROUP BY ALL"""
_MEANS = """SELECT c, coalesce(m, old) AS m FROM (SELECT c, m AS old FROM {means}) LEFT JOIN (
  SELECT c, list((s - (s % n + n) % n) // n ORDER BY pos) AS m FROM (
    SELECT c, pos, sum(v[pos])::BIGINT AS s, count(*) AS n FROM near{i}, range(1, 65) AS r(pos) GROUP BY c, pos) GROUP BY c) USING (c)"""


def _sql(rounds: int = 3) -> str:
    parts = [
        "kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE "
        "len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(embedding) = 64)",
        "means0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m FROM (SELECT sha256('1:' || vec_id) AS h, v FROM kept WHERE vec_id "
        "IS NOT NULL ORDER BY h, v LIMIT 16))",
    ]
    for i in range(rounds):
        parts += [f"near{i} AS ({_NEAREST.format(means=f'means{i}')})", f"means{i + 1} AS ({_MEANS.format(means=f'means{i}', i=i)})"]
    parts.append(f"near AS ({_NEAREST.format(means=f'means{rounds}')})")
    last = f"SELECT vec_id, c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM near JOIN means{rounds} USING (c)"
    return "WITH " + ", ".join(parts) + " " + last


OP12_SQL = _sql()
