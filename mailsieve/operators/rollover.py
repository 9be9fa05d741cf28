"""Splitting ordered lines into files of limited size, exactly as one writer would.

A writer that fills files one after the other ("next fit") is sequential: where a file
starts depends on where the previous one started. The step itself is local, though: a
file that starts at row ``s`` ends before the first row whose end passes
``start(s) + cap - header``. Lines are therefore cut into blocks of consecutive bytes;
every block works out, for each row at which a file might enter it, where that chain of
files leaves it. Joining these tables with themselves doubles the blocks they span, so
the chain that really starts at the first row is known after log2(blocks) rounds. Only
keys and offsets are shuffled, never lines, and only totals reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailsieve.sources.session import work_path

# A block holds this many of the longest steps a file boundary can make, so that the
# rows at which a chain may enter are a small share of its rows.
_STEPS_PER_BLOCK = 16
# About this many lines at most, unless a single step is longer.
_BLOCK_LINES = 1_000_000


@dataclass(frozen=True)
class _Split:
    room: int  # bytes of lines that fit behind the header
    step: int  # the furthest a file boundary can lie behind the previous one
    block: int


def _written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder; columns stay prunable."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def with_offsets(lines: DataFrame, order: Sequence[str | Column], size: str) -> DataFrame:
    """Global byte offsets ``start`` and ``end`` of each line in the given total order.

    Every range partition sums its own rows; one number per partition gives the bases.
    Written out, because sampling the ranges again could place rows differently.
    """
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema)

    def running_sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = pc.add(pc.cumulative_sum(batch[size].cast("int64")), total)
            total = ends[-1].as_py()
            slices = pa.array(np.full(batch.num_rows, here, dtype=np.int32))
            names = [*batch.schema.names, "_slice", "_end"]
            yield pa.RecordBatch.from_arrays([*batch.columns, slices, ends], names=names)

    placed = _written(
        ranged.mapInArrow(running_sum, f"{schema}, _slice int, _end bigint"), "offsets"
    )
    # One row per partition: small enough for a single window and a broadcast.
    sums = placed.groupBy("_slice").agg(F.max("_end").alias("bytes"))
    before = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select("_slice", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("_base"))
    return (
        placed.join(F.broadcast(bases), "_slice")
        .withColumn("end", F.col("_end") + F.col("_base"))
        .withColumn("start", F.col("end") - F.col(size))
        .drop("_slice", "_end", "_base")
    )


def _next_file(starts: np.ndarray, ends: np.ndarray, room: int) -> np.ndarray:
    """Row at which the file after the one starting at each row starts; the file's first
    row is written even if it does not fit."""
    return np.searchsorted(ends, np.maximum(starts + room, ends[: len(starts)]), side="right")


def _chains(offsets: DataFrame, split: _Split) -> DataFrame:
    """``entry, exit, files``: from each possible first file start of a block to the first
    one behind the block, with the number of files started in between."""
    block, size, step = F.expr(f"start div {split.block}"), split.block, split.step
    near_head = F.col("start") - F.col("block") * size < step
    copies = F.when((F.col("block") > 0) & near_head, F.array("block", F.col("block") - 1))
    rows = (
        offsets.select("start", "end")
        .withColumn("block", block)
        .withColumn("block", F.explode(copies.otherwise(F.array("block"))))
    )
    room = split.room

    def leave(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("start")
        starts, ends = table["start"].to_numpy(), table["end"].to_numpy()
        first = key[0].as_py() * size
        own = int(np.searchsorted(starts, first + size))
        # Rows behind the block absorb; doubling the hops until all chains have left.
        hop = np.concatenate([_next_file(starts[:own], ends, room), np.arange(own, len(starts) + 1)])
        files = np.concatenate([np.ones(own, np.int64), np.zeros(len(starts) + 1 - own, np.int64)])
        while own and hop[:own].min() < own:
            files, hop = files + files[hop], hop[hop]
        entries = np.flatnonzero(starts[:own] < first + step)
        entries = entries if len(entries) else np.arange(min(own, 1))
        left = hop[entries]
        exits = pa.array(np.append(starts, -1)[left], mask=left == len(starts))
        return pa.table({"entry": starts[entries], "exit": exits, "files": files[entries]})

    return rows.groupBy("block").applyInArrow(leave, "entry bigint, exit bigint, files bigint")


def _first_entry(spark: SparkSession, first_part: int) -> DataFrame:
    return spark.range(1).select(
        F.lit(0).cast("bigint").alias("entry"), F.lit(first_part).cast("bigint").alias("part")
    )


def _block_entries(chains: DataFrame, first_part: int, blocks: int) -> DataFrame:
    """``entry, part``: the first file start in each block on the chain from offset 0."""
    reached = _first_entry(chains.sparkSession, first_part)
    reach = 1
    while reach < blocks:
        further = reached.join(chains.where("exit IS NOT NULL"), "entry").select(
            F.col("exit").alias("entry"), (F.col("part") + F.col("files")).alias("part")
        )
        reached = _written(reached.unionByName(further), "entries")
        reach *= 2
        if reach < blocks:
            then = chains.select(
                F.col("entry").alias("exit"), F.col("exit").alias("exit2"), F.col("files").alias("files2")
            )
            chains = _written(
                chains.join(then, "exit").select(
                    "entry", F.col("exit2").alias("exit"), (F.col("files") + F.col("files2")).alias("files")
                ),
                "chains",
            )
    return reached


def assign_parts(
    lines: DataFrame,
    order: Sequence[str | Column],
    size: str,
    max_bytes: int,
    header_bytes: int,
    block_bytes: int | None = None,
) -> DataFrame:
    """``lines`` with ``start`` and the 1-based ``part`` (file number) of each line.

    ``lines`` should be narrow: the order columns, a key and the line size. A cap that is
    not positive leaves everything in part 1. A line that does not fit opens a file of
    its own; if it is the very first one, part 1 stays empty.
    """
    offsets = with_offsets(lines, order, size)
    if max_bytes <= 0:
        return offsets.drop("end").withColumn("part", F.lit(1).cast("bigint"))
    totals = offsets.agg(
        F.max("end").alias("total"),
        F.max(F.col(size)).alias("longest"),
        F.max(F.when(F.col("start") == 0, F.col(size))).alias("first"),
        F.count("*").alias("lines"),
    ).first()
    if totals.total is None:
        return offsets.drop("end").withColumn("part", F.lit(1).cast("bigint"))
    room = max(max_bytes - header_bytes, 0)
    step = max(room, totals.longest)
    by_lines = _BLOCK_LINES * totals.total // totals.lines
    split = _Split(room, step, max(block_bytes or min(_STEPS_PER_BLOCK * step, by_lines), step, 1))
    first_part = 2 if totals.first > max_bytes - header_bytes else 1
    blocks = -(-totals.total // split.block)
    chains = _written(_chains(offsets, split), "chains")
    entries = _block_entries(chains, first_part, blocks)
    # A last block in which no file starts continues the very last file.
    last = entries.join(chains, "entry").agg(F.max(F.col("part") + F.col("files") - 1)).scalar()
    by_block = entries.withColumn("block", F.expr(f"entry div {split.block}"))
    rows = offsets.withColumn("block", F.expr(f"start div {split.block}")).join(by_block, "block", "left")
    rows = rows.withColumn("last", last)
    out = offsets.drop("end").schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out) + ", part bigint"

    def number(table: pa.Table) -> pa.Table:
        table = table.sort_by("start")
        starts, ends = table["start"].to_numpy(), table["end"].to_numpy()
        entry, part = table["entry"][0].as_py(), table["part"][0].as_py()
        opened = np.zeros(len(starts), dtype=np.int64)
        if entry is None:
            parts = opened + table["last"][0].as_py()
        else:
            following = _next_file(starts, ends, room)
            row = int(np.searchsorted(starts, entry))
            while row < len(starts):
                opened[row] = 1
                row = int(following[row])
            parts = np.cumsum(opened) + (part - 1)
        return table.select(out.names).append_column("part", pa.array(parts))

    return rows.groupBy("block").applyInArrow(number, schema)
