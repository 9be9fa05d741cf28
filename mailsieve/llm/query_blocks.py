"""A stated set of queries against all rows, in blocks: a grid of (block of queries, stripe of rows).

Queries are dealt into blocks of about ``QUERIES`` rows at most and rows into stripes, both by a hash of
a number of the row, so that no key of the data decides where a row goes. There are two cells for
each core; their shape (many stripes or many blocks) keeps what is sent smallest: rows go to
every block, and queries go to every stripe and bring answers back from each.
A cell of the grid is one run of sorted rows in a partition: first its block of queries, then its
stripe, streamed in Arrow batches. A task holds one block of queries and what it found for
them, never a stripe, and the sort spills. Nothing is broadcast or collected, and a lost task is
computed again by itself. Vectors of different length never meet, as each length has cells of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES = 32_768
ROWS = 256
_CELL = ("dim", "block", "stripe", "kind")


def finite(vector: Column) -> Column:
    """Whether a vector has components and all of them are numbers."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) > 0) & good, F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array, kind: type = np.float64) -> np.ndarray:
    """Lists of one length as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(kind)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, ...], pa.RecordBatch]]:
    """Slices of a batch with one cell and kind each."""
    keys = np.column_stack([batch.column(c).to_numpy() for c in _CELL])
    cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
    for first, last in zip(cuts, cuts[1:]):
        yield tuple(keys[first].tolist()), batch.slice(first, last - first)


def shape(queries: int, rows: int, answers: int, cells: int) -> tuple[int, int]:
    """Blocks of queries and stripes of rows, about ``cells`` together or more.

    With ``b`` blocks and ``s`` stripes, ``b * rows + s * queries * cost`` rows are sent; an answer is
    taken as a sixteenth of a row."""
    cost = 1 + answers / 16
    blocks = max(1, round((cells * queries * cost / max(rows, 1)) ** 0.5), -(-queries // QUERIES))
    return blocks, max(1, min(-(-cells // blocks), -(-rows // ROWS)))


def meet(
    queries: DataFrame,
    rows: DataFrame,
    start: Callable[[pa.Table], object],
    schema: str,
    counts: tuple[int, int],
    answers: int,
) -> DataFrame:
    """Rows of ``schema`` that ``start(queries).add(rows)`` and ``.end()`` make of every cell.

    Both frames have ``dim`` and ``number`` (a bigint) and other columns; one that only the other has
    is null. ``counts`` are the numbers of queries and of rows, ``answers`` is how many
    rows of ``schema`` a cell gives for a query at most. ``start`` gets all queries of a cell; its
    ``add`` gets record batches of rows, and ``end`` gives a table."""
    blocks, stripes = shape(*counts, answers, 2 * queries.sparkSession.sparkContext.defaultParallelism)

    def dealt(over: int) -> Column:
        return F.pmod(F.xxhash64("number"), F.lit(over)).cast("int")

    def every(over: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(over - 1)))

    left = queries.select("*", F.lit(0).alias("kind"), dealt(blocks).alias("block"), every(stripes).alias("stripe"))
    right = rows.select("*", F.lit(1).alias("kind"), dealt(stripes).alias("stripe"), every(blocks).alias("block"))
    cells = left.unionByName(right, allowMissingColumns=True)
    cells = cells.repartitionById(blocks * stripes, F.col("block") * stripes + F.col("stripe"))
    cells = cells.sortWithinPartitions(*_CELL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cell, state = [], None, None

        def ended() -> Iterator[pa.RecordBatch]:
            if state is not None:
                yield from state.end().to_batches(max_chunksize=10_000)

        for batch in batches:
            for (*key, kind), part in _runs(batch) if batch.num_rows else ():
                if key != cell:
                    yield from ended()
                    held, cell, state = [], key, None
                if not kind:
                    held.append(part)
                elif held:
                    if state is None:
                        state = start(pa.Table.from_batches(held))
                    state.add(part)
        yield from ended()

    return cells.mapInArrow(run, schema)
