"""Approximate nearest neighbours by inner product: an inverted-list index with an adaptive dimension scan.

Vectors get one more component so that all are equally long; distance then orders rows
as the inner product does. Lists are the cells of k-means centroids, fitted on a bounded
sample (``sample_rows``, or 16 rows a list if that is more, at most 65,536); every row is in the index. The number of probed lists is set on
the sample as well: the smallest that finds ``recall`` of the sample's own neighbours.

Within a probed list vectors are rotated at random and scanned in blocks of columns. After
each block the partial distance, scaled up to all dimensions, is held against the k-th
best distance known: where a hypothesis test says that the full distance will exceed it,
the row is abandoned. Rows that survive are scored on the original vectors in double
precision. The first threshold is the k-th best distance among some rows of the sample, and
it falls with every step. The queries of a list scan it together. A query whose nearest lists hold fewer than k rows probes more.

Neighbouring lists form groups of about ``group_rows`` rows; a query scans its lists of a
group nearest first, with one threshold, and returns k rows per group, not per list.
Groups are split into chunks of rows, and their queries into parts, so neither a hot list
nor a popular one makes a task that grows with the table.

Defined results: vectors that are NULL, zero, or hold NULL, NaN or infinite components,
and rows without an id, take no part; shorter vectors are padded with zeros; the rows of
a repeated query id count as one query, with its smallest vector, and none of them is a
candidate for it; repeated candidates are ranked one by one; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickersift.functions.scratch import staged
from tickersift.llm.vectors import best, finite, matrix, padded

COLUMN_BLOCK = 16
# Of the hypothesis test: how many standard errors a partial distance may lie off.
EPSILON = 2.1
# Rows and queries of one product of matrices.
ROW_STEP = 1024
QUERY_STEP = 256
# Share of live pairs below which they are followed one by one.
SPARSE = 0.03
# Rows whose distances to a query give its first limit; at most one in eight of all rows, so that a query's lists hold enough rows within it.
SEEDS = 4096
# Rows of the sample for each list.
SAMPLE_A_LIST = 16


@dataclass(frozen=True)
class Index:
    """What is fitted on the sample; its size does not depend on the table's."""

    size: int
    longest: float
    rotation: np.ndarray
    centroids: np.ndarray
    groups: np.ndarray
    probes: int
    seeds: np.ndarray

    def first_limits(self, lifted: np.ndarray, k: int) -> np.ndarray:
        """A distance that k rows other than the query's own do not exceed."""
        if len(self.seeds) <= k:
            return np.full(len(lifted), np.inf, np.float32)
        return slackened(np.partition(squared_distances(lifted, self.seeds), k, axis=1)[:, k])

    def lifted(self, vectors: np.ndarray, candidates: bool) -> np.ndarray:
        """Rotated vectors of one more dimension."""
        extra = np.sqrt(np.maximum(self.longest**2 - (vectors**2).sum(1), 0)) if candidates else np.zeros(len(vectors))
        return (np.column_stack([vectors, extra]) @ self.rotation).astype(np.float32)

    def nearest_lists(self, lifted: np.ndarray) -> np.ndarray:
        """All lists, nearest centroid first."""
        return np.argsort(squared_distances(lifted, self.centroids), axis=1, kind="stable").astype(np.int32)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * (a @ b.T), 0)


def k_means(rows: np.ndarray, count: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    random = np.random.default_rng(seed)
    centroids = rows[np.sort(random.choice(len(rows), count, replace=False))]
    for _ in range(rounds):
        own = squared_distances(rows, centroids).argmin(1)
        filled = np.bincount(own, minlength=count)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, rows)
        centroids = np.where(filled[:, None] > 0, sums / np.maximum(filled, 1)[:, None], centroids).astype(np.float32)
    return centroids


def fit_index(vectors: np.ndarray, longest: float, lists: int, groups: int, k: int, recall: float, seeds: int, trials: int = 256, seed: int = 3) -> Index:
    size = vectors.shape[1]
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((size + 1, size + 1)))[0]
    bare = Index(size, longest, rotation, np.zeros((1, size + 1), np.float32), np.zeros(1, np.int32), 1, np.zeros((0, size + 1), np.float32))
    sample = bare.lifted(vectors, candidates=True)
    centroids = k_means(sample, min(lists, len(sample)))
    group = squared_distances(centroids, k_means(centroids, min(groups, len(centroids)))).argmin(1).astype(np.int32)
    fitted = Index(size, longest, rotation, centroids, group, 1, bare.seeds)
    own = fitted.nearest_lists(sample)[:, 0]
    tried = np.unique(np.linspace(0, len(sample) - 1, min(trials, len(sample))).astype(int))
    asked = bare.lifted(vectors[tried], candidates=False)
    gaps = squared_distances(asked, sample)
    gaps[np.arange(len(tried)), tried] = np.inf
    near = np.argsort(gaps, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
    order = fitted.nearest_lists(asked)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1], dtype=np.int32)[None, :].repeat(len(tried), 0), 1)
    found_by = np.take_along_axis(place, own[near], 1) + 1
    probes = int(np.quantile(found_by, recall, method="higher")) if found_by.size else 1
    few = sample[np.random.default_rng(seed).permutation(len(sample))[:seeds]]
    return Index(size, longest, rotation, centroids, group, probes, few)


def slackened(limit):
    """A little more, so that rounding costs no row."""
    return limit * (1 + 1e-4) + 1e-5


class Nearest:
    """The nearest rows of each query met so far, and the distance that a row must not exceed."""

    def __init__(self, limit: np.ndarray, k: int):
        self.k, self.limit = k, limit.astype(np.float32)
        self.found = [np.empty(0, np.int64)] * len(limit)
        self.gaps = [np.empty(0, np.float32)] * len(limit)

    def add(self, query: np.ndarray, rows: np.ndarray, gaps: np.ndarray) -> None:
        """Pairs, ordered by query. Ties with the last one, and rounding, are left to the original vectors."""
        starts = np.flatnonzero(np.diff(query, prepend=-1))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(query)], strict=False):
            q = query[a]
            found, gap = np.concatenate([self.found[q], rows[a:b]]), np.concatenate([self.gaps[q], gaps[a:b]])
            if len(gap) >= self.k:
                self.limit[q] = min(self.limit[q], slackened(np.partition(gap, self.k - 1)[self.k - 1]))
                near = gap <= self.limit[q]
                found, gap = found[near], gap[near]
            self.found[q], self.gaps[q] = found, gap


def adaptive_scan(queries: np.ndarray, rows: np.ndarray, asking: np.ndarray, begin: int, end: int, own: np.ndarray, ids: np.ndarray, nearest: Nearest) -> int:
    """Hold the rows from begin to end against the asking queries; returns how many pairs were followed to the last column.

    Blocks of columns are products of matrices while many pairs are alive; the few that
    the test leaves are followed one by one.
    """
    dims, followed = rows.shape[1], 0
    for first in range(begin, end, ROW_STEP):
        block = rows[first : min(end, first + ROW_STEP)]
        limit, asked = nearest.limit[asking], queries[asking]
        partial, alive = np.float32(0), own[asking][:, None] != ids[None, first : first + len(block)]
        at = row = None
        for column in range(0, dims, COLUMN_BLOCK):
            upto = min(dims, column + COLUMN_BLOCK)
            if at is None:
                partial = partial + squared_distances(asked[:, column:upto], block[:, column:upto])
                alive &= _near(partial, upto, dims, limit[:, None])
                if np.count_nonzero(alive) < SPARSE * alive.size:
                    at, row = np.nonzero(alive)
                    partial = partial[at, row]
            else:
                part = block[row, column:upto] - asked[at, column:upto]
                partial = partial + np.einsum("ij,ij->i", part, part)
                keep = _near(partial, upto, dims, limit[at])
                at, row, partial = at[keep], row[keep], partial[keep]
        if at is None:
            at, row = np.nonzero(alive)
            partial = partial[at, row]
        followed += len(at)
        nearest.add(asking[at], first + row, partial)
    return followed


def _near(partial: np.ndarray, upto: int, dims: int, limit: np.ndarray) -> np.ndarray:
    """The hypothesis test: scaled up to all columns, may the distance be within the limit?"""
    slack = (1 + EPSILON / math.sqrt(upto)) ** 2 if upto < dims else 1.0
    return partial * np.float32(dims / upto) <= limit * np.float32(slack)


def scan_lists(
    queries: np.ndarray, rows: np.ndarray, starts: np.ndarray, lists: list[list[int]], limit: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int
) -> tuple[list[np.ndarray], int]:
    """For each query the k nearest rows of its lists, or more that come as near; and the number of pairs followed to the end.

    Every query scans its nearest list first, all queries of a list together, then its
    second one, so limits fall early.
    """
    nearest, followed = Nearest(limit, k), 0
    rounds = np.full((len(lists), max(map(len, lists), default=0)), -1, np.int64)
    for i, own_lists in enumerate(lists):
        rounds[i, : len(own_lists)] = own_lists
    for column in rounds.T:
        for number in np.unique(column[column >= 0]):
            asking = np.flatnonzero(column == number)
            for some in np.array_split(asking, -(-len(asking) // QUERY_STEP)):
                followed += adaptive_scan(queries, rows, some, starts[number], starts[number + 1], own, ids, nearest)
    return nearest.found, followed


def approximate_top_k(
    rows: DataFrame,
    is_query: Column,
    k: int,
    list_rows: int = 1000,
    max_lists: int = 4096,
    sample_rows: int = 10_000,
    recall: float = 0.97,
    group_rows: int = 8192,
    chunk_rows: int = 16384,
    part_queries: int = 2048,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score). ``is_query`` is a condition on vec_id."""
    spark = rows.sparkSession
    vector = F.col(vector_column)
    kept = rows.where(finite(vector) & F.col(id_column).isNotNull()).where(F.exists(vector, lambda x: x != 0))
    kept = kept.select(F.col(id_column).cast("bigint").alias("vec_id"), vector.cast("array<double>").alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x)
    total, size, longest = kept.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kept = kept.withColumn("v", padded(F.col("v"), size, F.lit(0.0)))
    # A list should get some rows of the sample; at most sample_rows rows reach the driver.
    lists = max(1, min(max_lists, total // list_rows))
    sample_rows = max(sample_rows, SAMPLE_A_LIST * lists)
    share = min(1.0, 1.2 * sample_rows / total)
    drawn = kept.where(F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.lit(1 << 20)) < share * (1 << 20)).limit(sample_rows).toArrow()
    if not drawn.num_rows:
        drawn = kept.limit(1).toArrow()
    sample = matrix(drawn.column("v"), size, np.float64)
    sample = sample[np.lexsort((*sample.T[::-1], drawn.column("vec_id").to_numpy()))]
    fitted = fit_index(sample, math.sqrt(longest), lists, max(1, -(-total // group_rows)), k, recall, min(SEEDS, total // 8))
    parts = tuple(getattr(fitted, f) for f in Index.__dataclass_fields__)
    sent = spark.sparkContext.broadcast(parts)  # a rotation, at most max_lists centroids and SEEDS rows

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*sent.value)
        for batch in batches:
            cell = index.nearest_lists(index.lifted(matrix(batch.column(1), size, np.float64), True))[:, 0]
            columns = [*batch.columns, pa.array(cell), pa.array(index.groups[cell])]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "list", "group"])

    index = staged(kept.mapInArrow(assign, "vec_id long, v array<double>, list int, group int"), "lists")
    filled = np.zeros(len(fitted.centroids), np.int64)
    for r in index.groupBy("list").count().collect():  # one row per list
        filled[r["list"]] = r["count"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*sent.value)
        for batch in batches:
            lifted = index.lifted(matrix(batch.column(1), size, np.float64), False)
            cells, limits = index.nearest_lists(lifted), index.first_limits(lifted, k)
            short = (np.cumsum(filled[cells], axis=1) <= k).sum(1) + 1  # one row may be the query's own
            probes = np.minimum(np.maximum(short, index.probes), cells.shape[1])
            at, group, own = [], [], []
            for i, n in enumerate(probes.tolist()):
                among = index.groups[cells[i, :n]]
                for g in np.unique(among):
                    at.append(i)
                    group.append(g)
                    own.append(cells[i, :n][among == g])
            asking = pa.array(at, pa.int64())
            arrays = [batch.column(0).take(asking), batch.column(1).take(asking), pa.array(group, pa.int32()), pa.array(own, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(limits[at], pa.float32())], ["vec_id", "v", "group", "lists", "limit"])

    queries = kept.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = staged(queries.mapInArrow(probe, "vec_id long, v array<double>, group int, lists array<int>, limit float"), "probes")
    def search(table: pa.Table, asked: pa.Table) -> pa.Table:
        index, out = Index(*sent.value), []
        if table.num_rows and asked.num_rows:
            ids, own = table.column("vec_id").to_numpy(), asked.column("vec_id").to_numpy()
            v, q = matrix(table.column("v"), size, np.float64), matrix(asked.column("v"), size, np.float64)
            turned, turned_q = index.lifted(v, True), index.lifted(q, False)
            cell = table.column("list").to_numpy()
            by_list = np.argsort(cell, kind="stable")
            starts = np.searchsorted(cell[by_list], np.arange(len(index.centroids) + 1))
            ids, v, turned = ids[by_list], v[by_list], turned[by_list]
            nearest, _ = scan_lists(turned_q, turned, starts, asked.column("lists").to_pylist(), asked.column("limit").to_numpy(), own, ids, k)
            for i, found in enumerate(nearest):
                scores = (v[found] * q[i]).sum(1)  # row by row, so equal vectors get equal scores
                best_first = np.lexsort((ids[found], -scores))[:k]
                found = found[best_first]
                out.append((np.full(len(found), own[i]), ids[found], scores[best_first]))
        kinds = (np.int64, np.int64, np.float64)
        columns = [np.concatenate([o[c] for o in out]) if out else np.empty(0, kinds[c]) for c in range(3)]
        return pa.table({"query_id": columns[0], "vec_id": columns[1], "score": columns[2]})

    def nearest_rows(asked: DataFrame) -> DataFrame:
        # One row per group, so at most max_lists.
        chunks = index.groupBy("group").agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("chunks"))
        askers = asked.groupBy("group").agg(F.ceil(F.count("*") / part_queries).cast("int").alias("parts"))
        plan = staged(chunks.join(askers, "group"), "group-plan")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        place = F.xxhash64(F.monotonically_increasing_id())
        left = index.withColumn("place", place).join(F.broadcast(plan), "group")
        left = left.select("group", F.pmod("place", "chunks").cast("int").alias("chunk"), every("parts").alias("part"), "vec_id", "v", "list")
        right = asked.withColumn("place", place).join(F.broadcast(plan), "group")
        right = right.select("group", every("chunks").alias("chunk"), F.pmod("place", "parts").cast("int").alias("part"), "vec_id", "v", "lists", "limit")
        key = ("group", "chunk", "part")
        found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score double")
        return best(found, k)

    found = staged(nearest_rows(asked), "nearest")
    # A first limit may leave a query without k rows, if its lists lack the rows of the sample that set it.
    whole = found.groupBy(F.col("query_id").alias("vec_id")).count().where(F.col("count") >= k).select("vec_id")
    short = staged(asked.join(whole, "vec_id", "left_anti").withColumn("limit", F.lit(float("inf")).cast("float")), "short-queries")
    if not short.limit(1).count():
        return found
    rest = short.select(F.col("vec_id").alias("query_id")).distinct()
    return found.join(rest, "query_id", "left_anti").unionByName(nearest_rows(short))
