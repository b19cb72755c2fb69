"""Exact top-k by inner product of integer vectors, with pivot-table elimination.

Every row's distances to many pivots are computed once and stored with it. For a query
the largest difference between its own and a row's pivot distances is a lower bound of
their distance, hence an upper bound of their inner product. Rows are evaluated in the
order of that bound until the k-th best score exceeds all bounds left.

Rows are dealt to blocks and queries to query blocks; each pair of blocks is a group of
its own, so all queries meet all rows without a cross join, and no group grows with the
table. Each group returns the k best of each query; those are merged.

Defined results: vectors that are NULL or hold NULL, NaN or infinite components, and rows
without an id, take no part; shorter vectors are padded with zeros; the rows of a
repeated query id count as one query, with its smallest vector, and none of them is a
candidate for it; repeated candidates are ranked one by one; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickersift.functions.scratch import staged
from tickersift.llm.vectors import best, finite, matrix, padded, spread

SCORES = "query_id long, vec_id long, score long"


def integer_vectors(rows: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """Rows (vec_id, v): floor(scale * x) of each component."""
    vector = F.col(vector_column)
    kept = rows.where(finite(vector) & F.col(id_column).isNotNull())
    parts = F.transform(vector.cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))).cast("bigint"))
    return kept.select(F.col(id_column).cast("bigint").alias("vec_id"), parts.alias("v"))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Far apart rows of the sample: each is the farthest from those before."""
    if not len(sample):
        return sample
    chosen = [int(((sample - sample.mean(0)) ** 2).sum(1).argmax())]
    nearest = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def pivot_distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (vectors**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * (vectors @ pivots.T)
    return np.sqrt(np.maximum(squares, 0))


def exact_scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products; in numbers of any size where 64 bits could overflow, then held to the range of a long."""
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(1, rows.shape[1])
    if most < 2.0**62:
        return rows @ query
    wide = rows.astype(object) @ query.astype(object)
    return np.array([max(-(2**63), min(2**63 - 1, int(x))) for x in wide], np.int64)


def top_of_block(
    query: np.ndarray, query_pivots: np.ndarray, own: int, ids: np.ndarray, rows: np.ndarray, table: np.ndarray, squares: np.ndarray, k: int, step: int = 512
) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best rows; ``step`` rows are evaluated between two looks at the bounds."""
    square = float((query.astype(np.float64) ** 2).sum())
    gap = np.abs(table - query_pivots).max(1)
    # Rounding in the distances must not exclude a row: the bound gets more room than they can lose.
    bound = (square + squares - gap**2) / 2 + 1e-7 * (square + squares) + 1
    bound[ids == own] = -np.inf
    order = np.argsort(-bound, kind="stable")
    order = order[: len(order) - int((ids == own).sum())]
    best_ids, best_scores = np.empty(0, np.int64), np.empty(0, np.int64)
    for at in range(0, len(order), step):
        if len(best_scores) == k and best_scores[-1] > bound[order[at]]:
            break
        some = order[at : at + step]
        best_ids = np.concatenate([best_ids, ids[some]])
        best_scores = np.concatenate([best_scores, exact_scores(rows[some], query)])
        top = _top(best_ids, best_scores, k)
        best_ids, best_scores = best_ids[top], best_scores[top]
    return best_ids, best_scores


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    by_id = np.argsort(ids, kind="stable")
    return by_id[np.argsort(~scores[by_id], kind="stable")][:k]  # ~s falls as s rises, without overflow


def exact_top_k(
    rows: DataFrame,
    is_query: Column,
    k: int,
    scale: int = 1024,
    pivots: int = 48,
    sample_rows: int = 2000,
    block_rows: int = 8192,
    block_queries: int = 1024,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score). ``is_query`` is a condition on vec_id; the sample only serves to choose pivots."""
    spark = rows.sparkSession
    integers = integer_vectors(rows, id_column, vector_column, scale)
    total, size = integers.agg(F.count("*"), F.max(F.size("v"))).first()
    if not total or not size:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    integers = integers.withColumn("v", padded(F.col("v"), size, F.lit(0).cast("bigint")))
    share = min(1.0, 2.0 * sample_rows / total)
    drawn = integers.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < share * (1 << 20)).limit(sample_rows).collect()
    chosen = choose_pivots(np.array([r["v"] for r in drawn], np.float64).reshape(-1, size), pivots)
    if not len(chosen):
        chosen = np.zeros((1, size))
    width = len(chosen)

    def measure(batches):
        for batch in batches:
            table = pivot_distances(matrix(batch.column(1), size, np.float64), chosen)
            distances = pa.FixedSizeListArray.from_arrays(pa.array(table.ravel()), width).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, distances], ["vec_id", "v", "d"])

    index = staged(integers.mapInArrow(measure, "vec_id long, v array<long>, d array<double>"), "pivot-table")
    queries = index.where(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "d")).alias("q")).select("vec_id", "q.v", "q.d")
    queries = staged(queries, "pivot-queries")
    asked = queries.count()
    row_blocks, query_blocks = -(-total // block_rows), max(1, -(-asked // block_queries))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.withColumn("block", spread(index, row_blocks)).withColumn("query_block", every(query_blocks))
    right = queries.withColumn("query_block", spread(queries, query_blocks)).withColumn("block", every(row_blocks))

    def search(table: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if table.num_rows and asked.num_rows:
            ids, own = table.column("vec_id").to_numpy(), asked.column("vec_id").to_numpy()
            v, q = matrix(table.column("v"), size, np.int64), matrix(asked.column("v"), size, np.int64)
            d, dq = matrix(table.column("d"), width, np.float64), matrix(asked.column("d"), width, np.float64)
            squares = (v.astype(np.float64) ** 2).sum(1)
            for i in range(len(q)):
                found, scores = top_of_block(q[i], dq[i], int(own[i]), ids, v, d, squares, k)
                out.append((np.full(len(found), own[i]), found, scores))
        columns = [np.concatenate([o[c] for o in out]) if out else np.empty(0, np.int64) for c in range(3)]
        return pa.table({"query_id": columns[0], "vec_id": columns[1], "score": columns[2]})

    key = ("query_block", "block")
    return best(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, SCORES), k)
