"""Shared pieces: tables in the shared folder, bounded slices of Arrow batches, components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsieve.sources.session import work_path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder, so that a lost executor costs a read."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a slice hold about ``limit`` bytes (one text may hold more)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
        first, held = 0, 0
        for row, size in enumerate(sizes):
            if row > first and held + size > limit:
                yield batch.slice(first, row - first)
                first, held = row, 0
            held += size
        yield batch.slice(first)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable over ``edges`` (``a, b``), itself included.

    Labels fall to the smallest label of the neighbours and then to the label of that label
    (pointer jumping), until a round changes nothing. Every round is one table in the shared
    folder; only the number of changes reaches the driver. Endpoints outside ``nodes`` and
    null endpoints are ignored, repeated edges are harmless.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a != b").distinct()
    both = written(both, "edges")
    labels = written(nodes.select("node").distinct().withColumn("component", F.col("node")), "labels")
    if both.isEmpty():
        return labels
    touched = written(both.select(F.col("a").alias("node")).distinct(), "touched")
    inside = touched.join(labels, "node").select("node", "component")
    while True:
        near = (
            both.join(inside.select(F.col("node").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        lower = inside.join(near, "node", "left").select(
            "node", "component", F.least("component", "near").alias("low")
        )
        jump = inside.select(F.col("node").alias("low"), F.col("component").alias("jump"))
        after = written(
            lower.join(jump, "low", "left").select(
                "node", F.least("low", "jump").alias("component"), F.col("component").alias("before")
            ),
            "labels",
        )
        changed = after.where("component != before").limit(1).count()
        inside = after.select("node", "component")
        if not changed:
            break
    final = inside.select("node", F.col("component").alias("reached"))
    return labels.join(final, "node", "left").select(
        "node", F.coalesce("reached", "component").alias("component")
    )
