"""Mixing sources to target weights by Pfair scheduling with earliest deadlines first.

Rows of a source are cut into blocks. Block i of a source with weight share w is released at slot
floor(i / w) of its phase and due at slot ceil((i + 1) / w); at every slot the released block with
the earliest deadline goes. One resource used to the full meets all these deadlines, so at any slot
of a phase every source is less than one block away from its share, however long the phase is and
however small the share. A phase ends when a source has run out; then the weights of the others are
scaled up and the next phase begins. No row is left out.

Shares are integers that add up to ``UNIT``, and all arithmetic on them is exact. The driver goes
through the slots once, in one number per block and without rows, and notes how many blocks each source
has had where a frame of ``frame`` slots begins. Frames are then scheduled side by side by the same rule,
as a fold over the slots of each from what was noted.

Only DataFrame and SQL functions touch rows: they are numbered within (source, bucket) so that a
source with a third of all rows is spread over many tasks, and reach their slots by (source, block).
The driver sees one count per source.

Defined cases: a null source is a source of its own; sources without a positive weight follow
after all others, in equal shares; within a source rows are in the order of a hash of their id
(ties by id); an empty table gives an empty result; a column of the input that is named like
an added one is replaced.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FRAME = 1000
UNIT = 1 << 30  # shares are rounded to this part, which is a block in so many slots
BLOCK_ROWS = 16
TEMPERATURE = 0.5
_ROWS_PER_BUCKET = 100_000
_BROADCAST_ROWS = 500_000
ADDED = ("block", "phase", "slot", "position")


def quotas(weights: Mapping[str | None, float], frame: int) -> dict[str | None, int]:
    """Shares of each source in ``frame`` parts: largest remainders, ties by name."""
    total = sum(weights.values())
    exact = {s: w * frame / total for s, w in weights.items()}
    share = {s: math.floor(x) for s, x in exact.items()}
    by_rest = sorted(exact, key=lambda s: (share[s] - exact[s], s is not None, s or ""))
    for s in by_rest[: frame - sum(share.values())]:
        share[s] += 1
    return share


def _slots(shares: list[int], done: list[int], limits: list[int], frame: int) -> Iterator[list[int]]:
    """``done`` at the start of every frame, earliest deadline first until a source reaches its limit.

    The last list is ``done`` at the end. The work is a heap operation or two for each block."""
    total, slot = sum(shares), 0
    waiting = [(0, s) for s in range(len(shares))]  # releases of the next block of each source
    ready: list[tuple[int, int]] = []
    first = list(done)
    while True:
        if slot % frame == 0:
            yield [d - f for d, f in zip(done, first, strict=True)]
        while waiting and waiting[0][0] <= slot:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(done[s] - first[s] + 1) * total // shares[s]), s))
        s = heapq.heappop(ready)[1]
        done[s] += 1
        slot += 1
        if done[s] == limits[s]:
            break
        heapq.heappush(waiting, ((done[s] - first[s]) * total // shares[s], s))
    yield [d - f for d, f in zip(done, first, strict=True)]


def phases(blocks: Mapping[str | None, int], weights: Mapping[str | None, float], frame: int) -> list[dict]:
    """Phases in order: first slot, slots, (source, share, first block) of each active source, and the
    blocks each of them has had in the phase where its frames begin."""
    # Ties go by name, not by the order in which counts arrived.
    left, start, out = {s: blocks[s] for s in sorted(blocks, key=lambda s: (s is not None, s or ""))}, 0, []
    while any(left.values()):
        active = {s: weights.get(s) or 0.0 for s, n in left.items() if n and (weights.get(s) or 0) > 0}
        active = active or {s: 1.0 for s, n in left.items() if n}
        share = {s: max(q, 1) for s, q in quotas(active, UNIT).items()}
        done = [blocks[s] - left[s] for s in share]
        shares = [(s, q, b) for (s, q), b in zip(share.items(), done, strict=True)]
        *begun, had = _slots(list(share.values()), done, [blocks[s] for s in share], frame)
        out.append({"phase": len(out), "start": start, "slots": sum(had), "shares": shares, "begun": begun})
        start += sum(had)
        for s, n in zip(share, had, strict=True):
            left[s] -= n
    return out


def _schedule(
    quota: Column, frame: int | Column, total: Column | None = None, first: Column | None = None, begun: Column | None = None
) -> Column:
    """Array of ``(slot, source, i)``: earliest deadline first over the slots of one frame.

    ``quota`` is an array of shares, ``total`` their sum (``frame`` unless given); sources are its
    positions. ``first`` is the frame's first slot and ``begun`` what each source has had by then."""
    total = F.lit(frame).cast("bigint") if total is None else total
    first = F.lit(0).cast("bigint") if first is None else first
    begun = F.transform(quota, lambda q: F.lit(0).cast("bigint")) if begun is None else begun
    at = F.sequence(F.lit(0), F.lit(frame) - 1)
    none = F.lit(1 << 62).cast("bigint")

    def div(a: Column, b: Column) -> Column:
        return F.call_function("div", a, b.cast("bigint"))

    def pick(acc: Column, slot: Column) -> Column:
        # The key orders by deadline, then by the position of the source.
        keys = F.zip_with(
            acc["done"],
            quota,
            lambda done, q: F.when(
                div(done * total, q) <= first + slot, div((done + 1) * total + q - 1, q)
            ).otherwise(none),
        )
        best = F.array_position(keys, F.array_min(keys)).cast("int")
        done = F.transform(acc["done"], lambda d, i: F.when(i == best - 1, d + 1).otherwise(d))
        picked = F.struct(
            slot.alias("slot"), (best - 1).alias("source"), F.element_at(acc["done"], best).alias("i")
        )
        return F.struct(done.alias("done"), F.concat(acc["out"], F.array(picked)).alias("out"))

    start = F.struct(
        begun.alias("done"),
        F.expr("CAST(array() AS array<struct<slot:int,source:int,i:bigint>>)").alias("out"),
    )
    return F.aggregate(at, start, pick, lambda acc: acc["out"])


def mix(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    id_column: str = "doc_id",
    source_column: str = "source",
    frame: int = FRAME,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``docs`` with ``block, phase, slot`` and ``position``, the place of the row in the mixture.

    Without ``weights`` a source weighs its number of rows to the power ``TEMPERATURE``.
    Positions are unique and ordered; they have gaps where the last block of a source is not full.
    """
    spark = docs.sparkSession
    docs = docs.drop(*ADDED)
    source, key = F.col(f"`{source_column}`"), F.col(f"`{id_column}`")
    sizes = {r[0]: r[1] for r in docs.groupBy(source.alias("s")).count().collect()}
    rows_seen = sum(sizes.values())
    if not rows_seen:
        return docs.select(
            "*", *[F.lit(None).cast("int" if c == "phase" else "bigint").alias(c) for c in ADDED]
        )
    weights = weights or {s: n**TEMPERATURE for s, n in sizes.items()}
    plan = phases({s: -(-n // block_rows) for s, n in sizes.items()}, weights, frame)

    buckets = max(64, rows_seen // _ROWS_PER_BUCKET)
    name = F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))
    order = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    bucket = F.conv(F.substring(order, 1, 8), 16, 10).cast("bigint") * buckets
    # The row travels as one column, so that none of its names can clash.
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
        key.alias("_id"),
        name.alias("_source"),
        order.alias("_order"),
        F.floor(bucket / (1 << 32)).cast("int").alias("_bucket"),
    )
    counts = rows.groupBy("_source", "_bucket").agg(F.count("*").alias("n"))
    before = W.partitionBy("_source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("_source", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    within = W.partitionBy("_source", "_bucket").orderBy("_order", "_id")
    numbered = (
        rows.withColumn("_rank", F.row_number().over(within))
        .join(bases, ["_source", "_bucket"])
        .withColumn("_row", F.col("_base") + F.col("_rank") - 1)
        .withColumn("block", F.floor(F.col("_row") / block_rows))
    )

    frames = [
        (p["phase"], p["start"], at * frame, p["slots"], sum(q for _, q, _ in p["shares"]),
         ["" if s is None else f"={s}" for s, _, _ in p["shares"]], [q for _, q, _ in p["shares"]],
         [b for _, _, b in p["shares"]], begun)
        for p in plan
        for at, begun in enumerate(p["begun"])
    ]
    table = spark.createDataFrame(
        frames,
        "phase int, start bigint, at bigint, slots bigint, total bigint, sources array<string>,"
        " shares array<bigint>, firsts array<bigint>, begun array<bigint>",
    )
    table = table.repartition(max(1, min(len(frames) // 4, 1024)))
    size = F.least(F.lit(frame), F.col("slots") - F.col("at")).cast("int")
    picked = F.explode(_schedule(F.col("shares"), size, F.col("total"), F.col("at"), F.col("begun")))
    slots = table.select("*", picked.alias("e")).select(
        F.element_at("sources", F.col("e.source") + 1).alias("_source"),
        (F.element_at("firsts", F.col("e.source") + 1) + F.col("e.i")).alias("block"),
        "phase",
        (F.col("start") + F.col("at") + F.col("e.slot")).alias("slot"),
    )
    if sum(p["slots"] for p in plan) <= _BROADCAST_ROWS:  # the size of the table is known here
        slots = F.broadcast(slots)
    return numbered.join(slots, ["_source", "block"]).select(
        *[F.col("_doc").getField(c).alias(c) for c in docs.columns],
        "block",
        "phase",
        "slot",
        (F.col("slot") * block_rows + F.col("_row") % block_rows).alias("position"),
    )
