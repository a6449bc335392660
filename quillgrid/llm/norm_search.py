"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped into buckets of similar length. For a query and a bucket the score still to
be beaten becomes a local cosine threshold. A bucket whose threshold no direction can reach is
skipped; by that threshold it is otherwise scanned either as far down its lengths as they can
reach, or by bounds from the coordinates in which the query is largest. Survivors are verified
by their full integer products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgrid.llm.common import checkpointed

#: Queries that meet all buckets in one pass; their vectors are what is broadcast.
QUERY_BLOCK = 4096
#: Vectors of a bucket.
BUCKET = 512
#: Local cosine thresholds at or above this use coordinates, below it lengths.
COORDINATE_COSINE = 0.35
#: Coordinates of the query, largest first, that bound a product before the rest is known.
FOCUS = 16


def quantised(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as longs; null where a component is missing or not finite."""
    x = embedding.cast("array<double>")
    broken = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    sound = F.when(embedding.isNotNull() & ~F.coalesce(broken, F.lit(False)), x)
    return F.transform(sound, lambda v: F.floor(v * F.lit(float(scale))).cast("long"))


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, width).astype(np.int64)


def exact_products(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Integer products, by floats where these cannot round."""
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0))
    if most * rows.shape[1] < 2**52:
        return (rows.astype(float) @ queries.astype(float).T).astype(np.int64)
    return rows @ queries.T


def search_bucket(
    ids: np.ndarray, rows: np.ndarray, lengths: np.ndarray, query: np.ndarray, query_id: int,
    query_length: float, best: list, k: int,
) -> None:
    """Put the bucket's rows that belong among the `k` best of the query into `best`, in place.

    `rows` are by descending length, `best` holds (-score, id), sorted. Bounds have a margin for
    rounding and let ties through.
    """
    if len(best) == k and query_length > 0 and lengths[0] > 0:
        floor = -best[-1][0]
        margin = 1e-9 * (1.0 + query_length * lengths[0])
        cosine = floor / (query_length * lengths[0])
        if floor > query_length * lengths[0] + margin:
            return
        if floor > 0:
            if cosine >= COORDINATE_COSINE:
                focus = np.argsort(-np.abs(query))[:FOCUS]
                part = rows[:, focus]
                rest = np.sqrt(np.maximum(lengths**2 - (part.astype(float) ** 2).sum(1), 0.0))
                left = query.astype(float)
                beyond = np.sqrt(max(query_length**2 - (left[focus] ** 2).sum(), 0.0))
                bound = part.astype(float) @ left[focus] + rest * beyond
                keep = np.flatnonzero(bound + margin >= floor)
            else:
                keep = np.arange(np.searchsorted(-lengths, -(floor - margin) / query_length, "right"))
            ids, rows = ids[keep], rows[keep]
    other = ids != query_id
    ids, rows = ids[other], rows[other]
    if not len(ids):
        return
    scores = exact_products(rows, query[None, :])[:, 0]
    top = np.lexsort((ids, -scores))[:k]
    best.extend(zip((-scores[top]).tolist(), ids[top].tolist()))
    best.sort()
    del best[k:]


def top_products(
    df: DataFrame, id_col: str, vector: Column, is_query: Column, k: int = 5
) -> DataFrame:
    """query_id, rank, vec_id and score: the `k` largest integer products of each query.

    `vector` is an array of longs; rows where it, or the id, is missing take no part. A row is
    no candidate of a query with the same id. Ties go to the smaller id; a repeated row (same id
    and vector) counts once, as does a query. A vector meets only vectors of the same width; one
    without components scores 0. Fewer than `k` candidates give fewer rows, and an empty table
    none. Other columns are ignored.

    Candidates are sorted by length into partitions. Queries pass in blocks of a fixed number,
    so what is broadcast has a fixed size at any number of queries; every partition hands on at
    most `k` rows for each of them, and equal vectors are never gathered.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), vector.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull()
    )
    width = F.size("v").alias("width")
    length = F.sqrt(
        F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    )
    rows = rows.select("id", "v", width, length.alias("length")).dropDuplicates(["id", "v"])
    ranged = checkpointed(rows.repartitionByRange(F.col("width"), F.col("length").desc(), "id"))
    asked = checkpointed(
        df.where(is_query)
        .select(F.col(f"`{id_col}`").cast("long").alias("id"), vector.alias("v"))
        .where(F.col("id").isNotNull() & F.col("v").isNotNull())
        .dropDuplicates(["id", "v"])
    )
    schema = "query_id long, vec_id long, score long"
    found = None
    later = asked
    while block := later.orderBy("id", "v").limit(QUERY_BLOCK).collect():
        last, components = block[-1]["id"], F.array(*[F.lit(x) for x in block[-1]["v"]]).cast("array<bigint>")
        later = asked.where((F.col("id") > last) | ((F.col("id") == last) & (F.col("v") > components)))
        questions = spark.sparkContext.broadcast([(b["id"], np.array(b["v"], np.int64)) for b in block])
        part = ranged.sortWithinPartitions("width", F.col("length").desc()).mapInArrow(
            bucket_search(questions, k), schema
        )
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = (
        found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(order).cast("int"))
        .where(F.col("rank") <= k)
    )
    return best.select("query_id", "rank", "vec_id", "score")


def bucket_search(questions, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = questions.value
        best: list[list] = [[] for _ in queries]
        lengths_of = [float(np.sqrt((q.astype(float) ** 2).sum())) for _, q in queries]
        for batch in batches:
            ids = batch.column("id").to_numpy()
            lengths = batch.column("length").to_numpy()
            widths = batch.column("width").to_numpy()
            cuts = np.flatnonzero(np.diff(widths)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
                if low == high:
                    continue
                width = int(widths[low])
                table = matrix(batch.column("v").slice(low, high - low), width) if width else \
                    np.zeros((high - low, 0), np.int64)
                for a in range(0, high - low, BUCKET):
                    piece = slice(a, a + BUCKET)
                    for q, (query_id, query) in enumerate(queries):
                        if len(query) == width:
                            search_bucket(
                                ids[low:high][piece], table[piece], lengths[low:high][piece],
                                query, query_id, lengths_of[q], best[q], k,
                            )
        out = [(queries[q][0], i, -s) for q, found in enumerate(best) for s, i in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in out], pa.int64()) for c in range(3)],
            ["query_id", "vec_id", "score"],
        )

    return run
