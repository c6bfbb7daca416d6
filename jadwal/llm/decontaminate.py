"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions only.

Test items are partitioned by the power of two above their number of distinct shingles. Each partition keeps
so many of an item's smallest hash values (its MinHash sketch) that a document which contains the asked share of
the item's shingles must hold at least one of them, however long the document is: with at most u shingles
in the partition and containment t, floor((1 - t) * u) + 1 values. Documents stream their shingle hashes
against the sketches, which finds (document, item) candidates without a missed one; each candidate is then
verified by exact containment of the shingles themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jadwal.llm.common import let, table, written

WORDS = 5
CONTAINMENT = 0.8
BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _places(n: Column, width: int) -> Column:
    return F.when(n >= width, F.sequence(F.lit(1), n - width + 1)).otherwise(F.array().cast("array<int>"))


def shingle_hashes(w: Column, width: int) -> Column:
    """64-bit hashes of the runs of ``width`` words; none for fewer words."""
    one = lambda ws: F.transform(_places(F.size(ws), width), lambda i: F.xxhash64(*[F.get(ws, i + (j - 1)) for j in range(width)]))
    return let(w, one)


def shingles(w: Column, width: int) -> Column:
    return let(w, lambda ws: F.transform(_places(F.size(ws), width), lambda i: F.array_join(F.slice(ws, i, width), " ")))


def item_shingles(benchmark: DataFrame, width: int) -> DataFrame:
    """item_id, width, h, s: the distinct shingles of every item; a shorter item's one shingle is its whole sequence."""
    w = words(F.col("text"))
    items = benchmark.where("item_id is not null and text is not null").select("item_id", w.alias("w")).where(F.size("w") > 0)
    parts = []
    for n in range(1, width + 1):
        own = items.where(F.least(F.size("w"), F.lit(width)) == n)
        parts.append(own.select("item_id", F.lit(n).alias("width"), F.inline(F.arrays_zip(shingle_hashes(F.col("w"), n).alias("h"), shingles(F.col("w"), n).alias("s")))))
    return reduce(DataFrame.unionByName, parts).distinct()


def sketches(items: DataFrame, containment: float) -> DataFrame:
    """item_id, h: the retained hash values of every item, by size partition."""
    sized = items.groupBy("item_id").agg(F.array_sort(F.collect_set("h")).alias("hs"))
    partition = F.ceil(F.log2(F.size("hs").cast("double"))).cast("int")  # the size partition, 2^(p-1) < n <= 2^p
    keep = F.floor((1 - containment) * F.pow(F.lit(2.0), partition) + 1e-9).cast("int") + 1
    return sized.select("item_id", F.explode(F.slice("hs", F.lit(1), keep)).alias("h")).distinct()


def bounded(df: DataFrame, size: int, bound: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast only what has been measured to be small."""
    return F.broadcast(df) if size <= bound else df


def contained_items(docs: DataFrame, benchmark: DataFrame, width: int = WORDS, containment: float = CONTAINMENT, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, item_id, shared, item_shingles, containment for every pair of at least ``containment``.

    Words are runs of letters and digits, lower-cased; an item's shingles are counted once. An item of fewer than
    ``width`` words has its whole sequence as its one shingle, which documents hold where the words follow each other.
    Documents with null id or text, and items with null id, null text or no words match nothing. Rows that repeat an id count
    as one document (or item) with all their shingles; extra columns are ignored.
    """
    items = written(item_shingles(benchmark, width), "items")
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())
    n_items, letters = items.agg(F.count("*"), F.sum(F.octet_length("s"))).first()
    size = 64 * n_items + (letters or 0)
    every = lambda one: F.flatten(F.array(*[one(F.col("w"), n) for n in widths or [width]]))
    source = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    stream = source.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.explode(every(shingle_hashes)).alias("h"))
    found = stream.join(bounded(sketches(items, containment), 64 * n_items, broadcast_bytes), "h").select("doc_id", "item_id").distinct()
    found = written(found, "candidates")
    n_found = 64 * found.count()

    ids = bounded(found.select("doc_id").distinct(), n_found, broadcast_bytes)
    held = source.join(ids, "doc_id", "left_semi").select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.explode(F.array_distinct(every(shingles))).alias("s"))
    hits = held.join(bounded(items.select("item_id", "s"), size, broadcast_bytes), "s").join(bounded(found, n_found, broadcast_bytes), ["doc_id", "item_id"], "left_semi")
    shared = hits.distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))
    sizes = items.groupBy("item_id").agg(F.count("*").alias("item_shingles"))
    share = F.col("shared") / F.col("item_shingles")
    return (
        shared.join(bounded(sizes, 64 * n_items, broadcast_bytes), "item_id").where(share >= containment - 1e-12)
        .select("doc_id", "item_id", "shared", "item_shingles", F.round(share, 6).alias("containment"))
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, **kwargs: float) -> DataFrame:
    """``docs`` without the documents that contain a test item; rows with a null id stay."""
    bad = written(contained_items(docs, benchmark, **kwargs).select("doc_id").distinct(), "contaminated")
    return docs.join(bounded(bad, 64 * bad.count()), "doc_id", "left_anti")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql_words(name: str, key: str) -> str:
    return f"""
  SELECT {key}, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws
  FROM {name} WHERE {key} IS NOT NULL AND text IS NOT NULL"""


def _sql_shingles(name: str, key: str) -> str:
    return f"""
  SELECT DISTINCT {key}, array_to_string(ws[i:i + {WORDS - 1}], ' ') AS s
  FROM (SELECT {key}, ws, unnest(range(1, len(ws) - {WORDS - 2})) AS i FROM {name})"""


OP1_SQL = f"""
WITH dw AS ({_sql_words("documents", "doc_id")}), bw AS ({_sql_words("benchmark", "item_id")}),
d AS ({_sql_shingles("dw", "doc_id")}), b AS ({_sql_shingles("bw", "item_id")}
  UNION SELECT DISTINCT item_id, array_to_string(ws, ' ') FROM bw WHERE len(ws) BETWEEN 1 AND {WORDS - 1}),
n AS (SELECT item_id, count(*) AS item_shingles FROM b GROUP BY 1),
hits AS (SELECT DISTINCT doc_id, item_id, s FROM d JOIN b USING (s)
  UNION SELECT DISTINCT doc_id, item_id, s FROM dw JOIN (SELECT * FROM b WHERE len(string_split(s, ' ')) < {WORDS}) AS short
    ON contains(' ' || array_to_string(ws, ' ') || ' ', ' ' || s || ' ')),
c AS (SELECT doc_id, item_id, count(*) AS shared FROM hits GROUP BY 1, 2)
SELECT doc_id, item_id, shared, item_shingles, round(shared / item_shingles, 6) AS containment
FROM c JOIN n USING (item_id) WHERE shared / item_shingles >= {CONTAINMENT} - 1e-12
"""
