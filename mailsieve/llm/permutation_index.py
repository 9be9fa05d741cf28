"""Approximate nearest neighbours with a permutation index.

A vector is represented by its ``length`` nearest pivots in order of nearness, and posted in the
inverted files of these pivots with its place there. A query reads the files of its own pivots: a
vector that shares a pivot gains ``length`` less the later of the two places, which ranks the
vectors by footrule distance over the prefixes (a missing pivot counts as place ``length``). The
leading share of every shard is reranked by inner products in double precision.

Inner products are turned into nearness on a sphere: a vector gets one more component that brings
it to the greatest length of all, a query gets zero there. Pivots are the first of a sample of at
most ``SAMPLE`` rows; on queries of the same sample ``calibrate`` picks the prefix length and the share to rerank
that reach ``RECALL`` most cheaply (in the end all, so the recall is reached whatever the data are). The sample's
size is the only bound: every row is indexed and every query searched.

The index is a table (vector, prefix). Queries meet all rows in blocks (``query_blocks``); a
batch of rows is a shard with its own inverted files, built in the task from the prefixes. Of equal
vectors only the ``k + 1`` smallest ids are indexed: no result can hold more of them.

Defined cases: rows with a null id, and vectors that are null, empty, zero, or hold null or
non-finite components take no part, neither as queries nor as candidates. Vectors of different length never
meet. Candidates are the rows with another id; rows that repeat an id and a vector count once as
candidates, and each as a query. Ties go to the smaller id, in reranking and in what is reranked. Other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsieve.llm.common import written
from mailsieve.llm.query_blocks import finite, matrix, meet

SAMPLE = 8_192
RECALL = 0.96
PIVOTS = 512
LENGTHS = (8, 16, 32, 64, 96, 128)
_ASKED = 200
_GATHERED = 1 << 21
_SHARD = 4_096
_LEAST = 256  # rows reranked of a shard at least: small tables are searched whole
_ENTRY, _RERANK = 12.0, 1.0  # nanoseconds of a posting, and of a component in reranking
_FOUND = "query bigint, query_id bigint, id bigint, score double"


class Plan(NamedTuple):
    """Pivots (unit vectors with the added component), the greatest length, prefix length, reranked share."""

    pivots: np.ndarray
    longest: float
    length: int
    share: float


def _on_sphere(vectors: np.ndarray, longest: float) -> np.ndarray:
    rest = np.maximum(longest**2 - (vectors**2).sum(axis=1), 0)
    return np.column_stack([vectors, np.sqrt(rest)])


def _prefixes(points: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The nearest pivots of every point, nearest first."""
    near = points @ pivots.T
    length = min(length, len(pivots))
    found = np.argpartition(-near, length - 1, axis=1)[:, :length]
    order = np.argsort(-np.take_along_axis(near, found, 1), axis=1, kind="stable")
    return np.take_along_axis(found, order, 1).astype(np.int16)


class _Files:
    """The inverted files of a shard: for each pivot the rows that hold it, and its place there."""

    def __init__(self, prefixes: np.ndarray, pivots: int):
        self.rows, self.length = prefixes.shape
        flat = prefixes.reshape(-1)
        order = np.argsort(flat, kind="stable")
        self.row, self.place = np.divmod(order, self.length)
        self.first = np.searchsorted(flat[order], np.arange(pivots + 1))

    def gains(self, prefixes: np.ndarray) -> np.ndarray:
        """By (query, row): twice this, taken from a constant, is their footrule distance."""
        found = np.zeros((len(prefixes), self.rows), np.int32)
        for query, pivots in enumerate(prefixes):
            spans = [slice(self.first[p], self.first[p + 1]) for p in pivots]
            rows = np.concatenate([self.row[s] for s in spans])
            later = np.concatenate([np.maximum(self.place[s], place) for place, s in enumerate(spans)])
            found[query] = np.bincount(rows, weights=self.length - later, minlength=self.rows)
        return found


def _leading(gains: np.ndarray, count: int) -> np.ndarray:
    """The rows with the highest gains, of equal ones the first (rows are in order of their ids)."""
    rows = gains.shape[1]
    if count >= rows:
        return np.broadcast_to(np.arange(rows), gains.shape)
    keys = gains.astype(np.int64) * rows - np.arange(rows)
    return np.argpartition(-keys, count - 1, axis=1)[:, :count]


def calibrate(sample: np.ndarray, longest: float, k: int) -> Plan:
    """The cheapest plan that finds ``RECALL`` of the true neighbours in the sample."""
    points = _on_sphere(sample, longest)
    norms = np.linalg.norm(points, axis=1, keepdims=True)
    pivots = points[:PIVOTS] / norms[:PIVOTS]
    asked = np.arange(len(sample))[-_ASKED:]
    scores = sample[asked] @ sample.T
    scores[np.arange(len(asked)), asked] = -np.inf
    top = min(k, len(sample) - 1)
    if top < 1:
        return Plan(pivots, longest, min(LENGTHS[0], len(pivots)), 1.0)
    true = np.argpartition(-scores, top - 1, axis=1)[:, :top]
    queries = np.column_stack([sample[asked], np.zeros(len(asked))])
    plans = []
    for length in sorted({min(n, len(pivots)) for n in LENGTHS}):
        files = _Files(_prefixes(points, pivots, length), len(pivots))
        gains = files.gains(_prefixes(queries, pivots, length))
        gains[np.arange(len(asked)), asked] = -1
        rank = np.empty_like(gains)
        np.put_along_axis(rank, np.argsort(-gains, axis=1, kind="stable"), np.arange(len(sample))[None], 1)
        share = (np.quantile(np.take_along_axis(rank, true, 1), RECALL, method="higher") + 1) / len(sample)
        cost = _ENTRY * length**2 / len(pivots) + _RERANK * share * sample.shape[1]
        plans.append((cost, Plan(pivots, longest, length, float(share))))
    return min(plans, key=lambda p: p[0])[1]


class _Cell:
    """A block of queries: shards go by, the nearest ``k`` of each query stay."""

    def __init__(self, queries: pa.Table, plans: dict[int, Plan], k: int):
        self.numbers, self.ids = queries["number"].to_numpy(), queries["id"].to_numpy()
        self.vectors = matrix(queries["vector"])
        self.plan = plans[self.vectors.shape[1]]
        points = np.column_stack([self.vectors, np.zeros(len(self.vectors))])
        self.prefixes = _prefixes(points, self.plan.pivots, self.plan.length)
        self.k = k
        self.best = np.full((len(self.ids), k), -np.inf)
        self.best_ids = np.full((len(self.ids), k), np.iinfo(np.int64).max)

    def add(self, rows: pa.RecordBatch) -> None:
        for at in range(0, rows.num_rows, _SHARD):
            self._shard(rows.slice(at, _SHARD))

    def _shard(self, rows: pa.RecordBatch) -> None:
        ids = rows.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], matrix(rows.column("vector"))[order]
        files = _Files(matrix(rows.column("prefix"), np.int16)[order], len(self.plan.pivots))
        count = min(len(ids), max(_LEAST, 4 * self.k, int(np.ceil(self.plan.share * len(ids)))))
        step = max(1, min(256, _GATHERED // (count * vectors.shape[1])))
        for at in range(0, len(self.ids), step):
            here = slice(at, at + step)
            found = _leading(files.gains(self.prefixes[here]), count)
            # A sum of products along each pair, so that equal vectors get equal scores wherever they stand.
            scores = (vectors[found] * self.vectors[here, None]).sum(axis=2)
            near = ids[found]
            scores[near == self.ids[here, None]] = -np.inf
            scores = np.concatenate([self.best[here], scores], axis=1)
            near = np.concatenate([self.best_ids[here], near], axis=1)
            near[scores == -np.inf] = np.iinfo(np.int64).max
            first = np.lexsort((near, -scores), axis=1)[:, : self.k]
            self.best[here] = np.take_along_axis(scores, first, 1)
            self.best_ids[here] = np.take_along_axis(near, first, 1)

    def end(self) -> pa.Table:
        found = self.best_ids != np.iinfo(np.int64).max
        each = np.repeat(np.arange(len(found)), found.sum(axis=1))
        columns = [self.numbers[each], self.ids[each], self.best_ids[found], self.best[found]]
        return pa.table([pa.array(c) for c in columns], ["query", "query_id", "id", "score"])


def _usable(rows: DataFrame, id_column: str, vector_column: str, asked: Column) -> DataFrame:
    kind = rows.select(F.col(f"`{vector_column}`")).schema[0].dataType.elementType.simpleString()
    base = rows.select(
        F.col(f"`{id_column}`").cast("bigint").alias("id"),
        F.col(f"`{vector_column}`").cast(f"array<{kind if kind == 'float' else 'double'}>").alias("vector"),
        F.coalesce(asked, F.lit(False)).alias("asked"),
    )
    good = F.col("id").isNotNull() & finite(F.col("vector")) & F.exists("vector", lambda x: x != 0)
    return base.where(F.coalesce(good, F.lit(False))).withColumn("dim", F.size("vector"))


def _different(rows: DataFrame, k: int) -> DataFrame:
    """Of equal vectors the ``k + 1`` smallest ids, each once; partitions drop the others before the shuffle."""
    order = Window.partitionBy("vector").orderBy("id")
    few = rows.select("id", "vector", "dim").withColumn("copy", F.dense_rank().over(order)).where(F.col("copy") <= k + 1)
    few = few.withColumn("again", F.row_number().over(Window.partitionBy("vector", "id").orderBy("dim")))
    return few.where("again = 1").drop("copy", "again")


def plan_index(rows: DataFrame, k: int) -> tuple[dict[int, Plan], int]:
    """A plan for every length of vectors, from a sample in the order of a hash of the ids; the number of rows."""
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    known = rows.groupBy("dim").agg(F.max(length).alias("longest"), F.count("*").alias("rows")).collect()
    plans = {}
    for dim, longest, _ in known:  # one row for each length of vectors
        drawn = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toArrow()
        plans[dim] = calibrate(matrix(drawn["vector"]), longest, k)
    return plans, sum(r["rows"] for r in known)


def build_index(rows: DataFrame, plans: dict[int, Plan]) -> DataFrame:
    """``id, vector, dim, prefix``: every row with its nearest pivots in order."""

    def prefixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                plan = plans[int(dim)]
                for at in range(0, part.num_rows, _SHARD):
                    few = part.slice(at, _SHARD)
                    prefix = _prefixes(_on_sphere(matrix(few.column("vector")), plan.longest), plan.pivots, plan.length)
                    lists = pa.ListArray.from_arrays(
                        np.arange(0, prefix.size + 1, prefix.shape[1], dtype=np.int32), pa.array(prefix.reshape(-1))
                    )
                    yield pa.RecordBatch.from_arrays([*few.columns, lists], [*few.schema.names, "prefix"])

    schema = f"id bigint, vector {rows.schema['vector'].dataType.simpleString()}, dim int, prefix array<smallint>"
    return rows.select("id", "vector", "dim").mapInArrow(prefixed, schema)


def nearest(
    rows: DataFrame, queries: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every row for which ``queries`` holds."""
    base = _usable(rows, id_column, vector_column, queries)
    asked = written(base.where("asked").select("id", "vector", "dim", F.monotonically_increasing_id().alias("number")), "queries")
    different = written(_different(base, k), "different")
    plans, count = plan_index(different, k)
    index = written(build_index(different, plans).withColumn("number", F.monotonically_increasing_id()), "index")
    found = meet(asked, index, lambda t: _Cell(t, plans, k), _FOUND, (asked.count(), count), k)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
