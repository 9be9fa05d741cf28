"""Hard negatives by slots: positives' upper limits split the scores, the best of each slot are kept.

An anchor's positives are its best rows of its own label. A negative for a positive is a row of
another label whose score lies between a lower and an upper share of the positive's score. The
windows of one anchor's positives overlap; their upper limits cut the scores into disjoint slots,
and the first ``negatives`` of a window are among the first of the slots from its upper limit
downwards. So a task keeps the best of each slot (a bounded table per anchor, whatever rows
come by), the tables of all tasks are merged slot by slot, and a suffix of the slots in descending
order, cut at the lower limit and at ``negatives``, answers each window.

Anchors meet all rows in blocks (``query_blocks``), once for positives, once for negatives. Scores are
inner products of integers, held exactly in doubles.

Defined cases: rows with a null id, label or vector, with a null component or without components
take no part, nor do rows whose squares sum to 2^53 or more (their scores would not be exact).
Vectors of different length never meet. A row with the anchor's id is neither its positive nor its
negative. Rows that repeat an id count one by one, and so do anchors. Ties go to the smaller
id. Anchors without positives and positives without negatives give no rows; a positive of negative
score has an empty window. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsieve.llm.common import written
from mailsieve.llm.query_blocks import matrix, meet

_ANCHORS = 512
_FOUND = "anchor bigint, slot int, id bigint, score bigint"


class _Best:
    """The first ``keep`` rows of every (anchor, slot) so far: higher scores, then smaller ids."""

    def __init__(self, slots: int, keep: int):
        self.slots, self.keep = slots, keep
        self.place = np.empty(0, np.int64)  # anchor * slots + slot
        self.ids = np.empty(0, np.int64)
        self.scores = np.empty(0)

    def least(self, anchors: int) -> np.ndarray:
        """The score that a newcomer must reach, by (anchor, slot)."""
        found = np.full(anchors * self.slots, -np.inf)
        count = np.bincount(self.place, minlength=len(found))
        full = np.flatnonzero(count >= self.keep)
        last = np.cumsum(count) - 1
        found[full] = self.scores[last[full]]
        return found.reshape(anchors, self.slots)

    def add(self, place: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        place, ids, scores = (np.concatenate(p) for p in ((self.place, place), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, -scores, place))
        place, ids, scores = place[order], ids[order], scores[order]
        first = np.r_[True, place[1:] != place[:-1]] if len(place) else np.empty(0, bool)
        rank = np.arange(len(place)) - np.maximum.accumulate(np.where(first, np.arange(len(place)), 0))
        kept = rank < self.keep
        self.place, self.ids, self.scores = place[kept], ids[kept], scores[kept]


class _Cell:
    """A block of anchors: rows go by, the best of each slot stay.

    ``uppers`` (descending, a row per anchor) are the slots' inclusive upper limits, ``lowers`` the least
    useful score of each; without them the one slot holds rows of the anchor's own label."""

    def __init__(self, anchors: pa.Table, keep: int, slots: int, limited: bool):
        self.numbers = anchors["number"].to_numpy()
        self.ids, self.labels = anchors["id"].to_numpy(), anchors["label"].to_numpy()
        self.vectors = matrix(anchors["vector"])
        self.limits = None
        if limited:
            self.limits = [
                np.array([[*x, *[-np.inf] * (slots - len(x))] for x in anchors[c].to_pylist()], float).reshape(-1, slots)
                for c in ("uppers", "lowers")
            ]
        self.best = _Best(slots, keep)

    def add(self, rows: pa.RecordBatch) -> None:
        vectors, ids, labels = matrix(rows.column("vector")), rows.column("id").to_numpy(), rows.column("label").to_numpy()
        least, offers = self.best.least(len(self.ids)), []
        for at in range(0, len(self.ids), _ANCHORS):
            here = slice(at, at + _ANCHORS)
            scores = self.vectors[here] @ vectors.T
            fits = (self.labels[here, None] == labels[None]) != (self.limits is not None)
            fits &= self.ids[here, None] != ids[None]
            for slot in range(self.best.slots):
                usable = fits & (scores >= least[here, slot, None])
                if self.limits is not None:
                    uppers, lowers = (x[here] for x in self.limits)
                    usable &= (scores <= uppers[:, slot, None]) & (scores >= lowers[:, slot, None])
                    if slot + 1 < self.best.slots:
                        usable &= scores > uppers[:, slot + 1, None]
                anchor, row = self._leading(usable, scores)
                offers.append(((anchor + at) * self.best.slots + slot, ids[row], scores[anchor, row]))
        self.best.add(*(np.concatenate(c) for c in zip(*offers)))

    def _leading(self, usable: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The usable (anchor, row) pairs, without those below an anchor's ``keep``-th best."""
        keep = self.best.keep
        many = np.flatnonzero(usable.sum(axis=1) > 4 * keep)
        if len(many):
            own = np.where(usable[many], scores[many], -np.inf)
            usable[many] &= own >= np.partition(own, -keep, axis=1)[:, -keep, None]
        return np.nonzero(usable)

    def end(self) -> pa.Table:
        best = self.best
        anchor, slot = np.divmod(best.place, best.slots)
        columns = [self.numbers[anchor], slot.astype(np.int32), best.ids, best.scores.astype(np.int64)]
        return pa.table([pa.array(c) for c in columns], ["anchor", "slot", "id", "score"])


def _first(found: DataFrame, keep: int) -> DataFrame:
    """The first rows of every (anchor, slot) over all tasks."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)


def hard_negatives(
    rows: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 10,
    percent: tuple[int, int] = (30, 90),
    id_column: str = "vec_id",
    label_column: str = "label",
    vector_column: str = "vector",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` tells of a row of ``rows`` whether it is an anchor; vectors hold integers."""
    low, high = percent
    base = rows.select(
        F.col(f"`{id_column}`").cast("bigint").alias("id"),
        F.col(f"`{label_column}`").cast("bigint").alias("label"),
        F.col(f"`{vector_column}`").cast("array<bigint>").alias("vector"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
    )
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0) & (squares < 2.0**53)
    base = base.where(F.coalesce(good, F.lit(False)))
    base = written(base.select("*", F.size("vector").alias("dim"), F.monotonically_increasing_id().alias("number")), "rows")
    count = base.agg(F.count_if("anchor").alias("queries"), F.count("*").alias("rows")).first()
    counts = (count["queries"], count["rows"])
    base, chosen = base.drop("anchor"), base.where("anchor").drop("anchor")

    found = meet(chosen, base, lambda t: _Cell(t, positives, 1, False), _FOUND, counts, positives)
    best = _first(found, positives).groupBy(F.col("anchor").alias("number"))
    own = best.agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id"))).alias("found"))
    own = own.withColumn("positives", F.transform("found", lambda p: F.struct((-p["minus"]).alias("score"), p["id"].alias("id"))))
    # Positives come in descending order, and so do their limits; equal upper limits make one slot.
    hundred = F.lit(100).cast("decimal(3,0)")
    own = own.withColumn("limits", F.transform("positives", lambda p: F.struct(
        F.floor(p["score"] * high / hundred).cast("bigint").alias("upper"),
        F.ceil(p["score"] * low / hundred).cast("bigint").alias("lower"),
    )))
    own = own.withColumn("uppers", F.array_distinct("limits.upper"))
    own = own.withColumn("lowers", F.transform(
        "uppers", lambda u: F.array_min(F.filter("limits", lambda x: x["upper"] == u)["lower"])
    ))
    own = own.select("number", "positives", "uppers", "lowers")
    with_positives = written(chosen.join(own, "number"), "anchors")

    slots = meet(with_positives.drop("positives"), base, lambda t: _Cell(t, negatives, positives, True), _FOUND, counts, positives * negatives)
    merged = _first(slots, negatives).groupBy(F.col("anchor").alias("number")).agg(
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id"))).alias("all")
    )
    each = with_positives.select("number", F.col("id").alias("anchor_id"), F.explode("positives").alias("positive"))
    suffix = F.filter("all", lambda n: (-n["minus"] * 100 <= F.col("positive.score") * high) & (-n["minus"] * 100 >= F.col("positive.score") * low))
    window = each.join(merged, "number").select(
        "anchor_id", "positive", F.posexplode(F.slice(suffix, 1, negatives)).alias("at", "negative")
    )
    return window.select(
        "anchor_id",
        F.col("positive.id").alias("positive_id"),
        (F.col("at") + 1).cast("int").alias("rank"),
        F.col("negative.id").alias("negative_id"),
        F.col("positive.score").alias("positive_score"),
        (-F.col("negative.minus")).alias("negative_score"),
    )
