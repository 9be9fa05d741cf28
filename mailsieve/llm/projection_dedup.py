"""Near-duplicate embeddings by collision counting on sorted one-dimensional projections.

Unit vectors are projected on many random directions. Far out on a direction stand few vectors
that are mostly near each other, so a vector is entered in the lists of the ``tails`` directions
on which it reaches furthest; the crowded middles tell nothing and are left out. In a list,
sorted by projection, a pair collides if one lies in the window of half-width ``WINDOW`` around
the other. Collisions are counted per pair over all lists, and pairs with enough of them are
verified by their cosine in double precision. ``calibrate`` simulates pairs that lie exactly at
the threshold and picks the tails and the count that keep ``RECALL`` of them.

A vector carries its own list entries, so a list counts the collisions of its pairs by itself,
and a pair is handled in the first list where it collides: no pair is ever shuffled. A list
gives each vector its number of links and one edge towards its group. Equal vectors are one
vector with a weight. Lists longer than ``LIST_ROWS`` are split by a hash of the vector, and
each pair of parts is a group of its own. The number of directions follows the number of
vectors up to ``MAX_DIRECTIONS``; beyond, lists grow and are split.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link
with nothing, nor do rows with a null id; vectors of different length never link; repeated rows
count as other vectors; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsieve.llm.common import components, written

RECALL = 0.95
WINDOW = 1.2
MAX_DIRECTIONS = 8192
LIST_ROWS = 512
_PER_DIRECTION = 16
_BLOCK = 256


def _directions(dim: int, count: int) -> np.ndarray:
    return np.random.default_rng([dim, count]).standard_normal((dim, count), dtype=np.float32)


def _furthest(units: np.ndarray, directions: np.ndarray, tails: int) -> tuple[np.ndarray, np.ndarray]:
    """The directions on which each vector reaches furthest, and its projections there."""
    reach = units.astype(np.float32) @ directions
    lists = np.argpartition(-reach, tails - 1, axis=1)[:, :tails]
    return lists.astype(np.int32), np.take_along_axis(reach, lists, axis=1)


def calibrate(dim: int, directions: int, cosine: float, recall: float = RECALL, pairs: int = 600) -> tuple[int, int]:
    """``tails, collisions`` that find the wanted share of simulated pairs at the threshold cosine."""
    rng = np.random.default_rng([dim, 1])
    first = rng.standard_normal((pairs, dim))
    first /= np.linalg.norm(first, axis=1, keepdims=True)
    other = rng.standard_normal((pairs, dim))
    other -= (other * first).sum(axis=1, keepdims=True) * first
    norm = np.linalg.norm(other, axis=1, keepdims=True)
    other = np.divide(other, norm, out=np.zeros_like(other), where=norm > 0)
    second = cosine * first + np.sqrt(1 - cosine**2) * other
    for tails in (4, 6, 8, 12, 16, 24, 32, 48, 64):
        tails = min(tails, directions)
        a, x = _furthest(first, _directions(dim, directions), tails)
        b, y = _furthest(second, _directions(dim, directions), tails)
        same = (a[:, :, None] == b[:, None, :]) & (np.abs(x[:, :, None] - y[:, None, :]) <= WINDOW)
        count = np.sort(same.sum(axis=(1, 2)))
        enough = int(count[int((1 - recall) * pairs)])
        if enough or tails == directions:
            break
    return tails, max(enough, 1)


def _units(cells: list[bytes], kind: str) -> np.ndarray:
    vectors = np.frombuffer(b"".join(cells), kind).reshape(len(cells), -1).astype(np.float64)
    vectors /= np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _entries(vectors: DataFrame, plan: dict[int, tuple[int, int, int]], kind: str) -> DataFrame:
    """One row per vector and list: the list, the vector, its weight and all its entries."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = np.array(batch.column("dim").to_pylist())
            for dim in np.unique(dims):
                count, tails, _ = plan[int(dim)]
                if dim not in made:
                    made[dim] = _directions(int(dim), count)
                rows = batch.take(pa.array(np.flatnonzero(dims == dim)))
                for at in range(0, rows.num_rows, _BLOCK):
                    part = rows.slice(at, _BLOCK)
                    cells = [np.array(v.values, kind).tobytes() for v in part.column("vector")]
                    lists, reach = _furthest(_units(cells, kind), made[dim], tails)
                    n = part.num_rows
                    again = pa.array(np.repeat(np.arange(n), tails))
                    own = [pa.array([x.tobytes() for x in m], pa.binary()).take(again) for m in (lists, reach)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(lists.reshape(-1)), part.column("dim").take(again),
                            part.column("id").take(again), part.column("weight").take(again),
                            pa.array(cells, pa.binary()).take(again), *own,
                        ],
                        ["list", "dim", "id", "weight", "cell", "lists", "reach"],
                    )

    schema = "list int, dim int, id bigint, weight bigint, cell binary, lists binary, reach binary"
    return vectors.mapInArrow(project, schema)


def _linked(table: pa.Table, own: int, need: int, cosine: float, kind: str) -> np.ndarray:
    """Which pairs of a group's vectors are handled here and linked, as a symmetric matrix."""
    n = table.num_rows
    lists = np.frombuffer(b"".join(table["lists"].to_pylist()), np.int32).reshape(n, -1)
    reach = np.frombuffer(b"".join(table["reach"].to_pylist()), np.float32).reshape(n, -1)
    count, first = np.zeros((n, n), np.int16), np.full((n, n), np.iinfo(np.int32).max, np.int32)
    for a in range(lists.shape[1]):
        for b in range(lists.shape[1]):
            same = lists[:, a, None] == lists[None, :, b]
            if not same.any():
                continue
            same &= np.abs(reach[:, a, None] - reach[None, :, b]) <= WINDOW
            count += same
            np.minimum(first, lists[:, a, None], out=first, where=same)
    found = (count >= need) & (first == own)
    part = np.array(table["part"].to_pylist())
    if part.min() != part.max():  # two parts of a list meet: only pairs across
        found &= part[:, None] != part[None, :]
    np.fill_diagonal(found, False)
    if found.any():
        units = _units(table["cell"].to_pylist(), kind)
        found &= units @ units.T >= cosine
    return found


def near_vectors(
    vectors: DataFrame, cosine: float = 0.9, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """``id, n_links, component_id, kept``, one row per row of ``vectors``."""
    element = vectors.select(F.col(f"`{vector_column}`")).schema[0].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    rows = vectors.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), F.col(f"`{vector_column}`").alias("vector"))
    if element not in ("float", "double"):
        rows = rows.withColumn("vector", F.col("vector").cast("array<double>"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.coalesce(
        F.col("id").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0), F.lit(False)
    )
    rows = rows.withColumn("_usable", usable)
    good = rows.where("_usable")
    distinct = good.groupBy("vector").agg(F.min("id").alias("class"), F.count("*").alias("weight"))
    classes = written(distinct.withColumn("dim", F.size("vector")), "classes")
    plan = {}
    for dim, n in classes.groupBy("dim").count().collect():  # a row for each length of vectors
        directions = int(min(MAX_DIRECTIONS, max(256, 2 ** np.ceil(np.log2(n / _PER_DIRECTION)))))
        plan[dim] = (directions, *calibrate(dim, directions, cosine))
    entries = _entries(classes.select(F.col("class").alias("id"), "weight", "dim", "vector"), plan, kind)
    entries = written(entries, "entries")
    parts = entries.groupBy("dim", "list").agg(F.ceil(F.count("*") / LIST_ROWS).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    met = (
        entries.join(parts, ["dim", "list"])
        .withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("lo", F.least("part", "other"))
        .withColumn("hi", F.greatest("part", "other"))
    )

    def link(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dim, own = key[0].as_py(), key[1].as_py()
        found = _linked(table, own, plan[dim][2], cosine, kind)
        rows_at = np.flatnonzero(found.any(axis=1))
        found = found[np.ix_(rows_at, rows_at)]
        ids = table["id"].to_numpy()[rows_at]
        weights = table["weight"].to_numpy()[rows_at]
        label = np.arange(len(ids))
        while len(ids):
            least = np.minimum(label, np.where(found, label[None, :], len(ids)).min(axis=1))
            if (least == label).all():
                break
            label = least
        return pa.table({"a": ids, "b": ids[label], "links": found @ weights})

    groups = met.groupBy("dim", "list", "lo", "hi")
    links = written(groups.applyInArrow(link, "a bigint, b bigint, links bigint"), "links")
    labels = components(classes.select(F.col("class").alias("node")), links.select("a", "b"))
    counted = links.groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    result = (
        classes.join(labels.select(F.col("node").alias("class"), "component"), "class")
        .join(counted, "class", "left")
        .select("vector", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component")
    )
    out = [
        F.col("id").alias(id_column),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"),
    ]
    # A vector that very many rows repeat makes this join uneven; adaptive execution splits it.
    apart = rows.where("NOT _usable").select("id", F.lit(0).alias("n_links"), F.col("id").alias("component"))
    return good.drop("_usable").join(result, "vector").drop("vector").unionByName(apart).select(*out)
