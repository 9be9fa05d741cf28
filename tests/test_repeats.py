"""Repeated ids, missing headers and broken payloads neither lose nor multiply rows."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from mailsieve.operators import predicates as pr
from mailsieve.operators.analyses import dedupe_message_id
from mailsieve.sources.csv_files import write_rolled_csv
from mailsieve.sources.messages import (
    DUMP_SCHEMA,
    land_messages,
    quarantine,
    read_landed,
    stream_messages,
    with_parts,
)
from mailsieve.streaming import runs


def _row(i, message_id, days_ago=0, payload=None):
    headers = [{"name": "From", "value": f"a{i}@x.org"}]
    if message_id:
        headers.append({"name": "Message-ID", "value": message_id})
    at = datetime(2024, 5, 1) - timedelta(days=days_ago)
    return (f"m{i}", at, "t", ["INBOX"], "s", json.dumps({"headers": headers}) if payload is None else payload)


def test_stream_dedupe_equals_batch(spark, tmp_path):
    files = [
        [_row(1, "<a>"), _row(2, None), _row(3, None)],
        [_row(4, "<b>", 400), _row(1, "<a>"), _row(5, None, 900)],
        [_row(4, "<b>", 400), _row(6, "<c>", 2000)],
    ]
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, DUMP_SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    arriving = runs.dedupe_stream(stream_messages(spark, str(tmp_path / "in"), files_per_batch=1))
    kept = runs.run_available(
        arriving.select("message_id", "id", "internal_date"), str(tmp_path / "out"), str(tmp_path / "progress")
    )
    landed = with_parts(spark.read.schema(DUMP_SCHEMA).json(str(tmp_path / "in")))
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, dedupe_message_id(landed).collect()))


def test_rolled_csv_keeps_repeated_keys(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (1, "a")], "k int, v string")
    stats = write_rolled_csv(rows, str(tmp_path / "csv"), "base", ["v"], "k", ["k"], 6).collect()
    lines = [r.value for r in spark.read.text(str(tmp_path / "csv")).collect()]
    assert sorted(x for x in lines if x != "v") == ["a", "a", "b", "c"]
    assert sum(r.rows for r in stats) == 4
    assert sum(r.bytes for r in stats) == sum(len(x) + 1 for x in lines)


def test_row_cap_on_repeated_ids(spark):
    rows = [("x", 1), ("x", 1), ("x", 1), ("y", 2), ("z", 0), ("z", None)]
    mail = spark.createDataFrame(rows, "id string, d int").select("id", F.timestamp_seconds("d").alias("internal_date"))
    for cap in range(1, 8):
        assert pr.row_cap(mail, cap).count() == min(cap, len(rows))
    assert "y" in [r.id for r in pr.row_cap(mail, 1).collect()]


def test_bad_payload_is_put_aside(spark):
    rows = [_row(1, "<a>"), _row(2, "<b>", payload="{broken"), ("", *_row(3, "<c>")[1:])]
    dump = spark.createDataFrame(rows, DUMP_SCHEMA)
    assert [(r.id, r.headers is None) for r in with_parts(dump).collect()] == [("m1", False), ("m2", True)]
    assert sorted(map(tuple, quarantine(dump).collect())) == [("", "no id"), ("m2", "bad payload")]


def test_landed_header_query_reads_no_bodies(spark, tmp_path):
    dump = spark.createDataFrame([_row(1, "<a>"), _row(2, "<b>", payload="{broken")], DUMP_SCHEMA)
    land_messages(dump, str(tmp_path / "landed"))
    landed = read_landed(spark, str(tmp_path / "landed"))
    assert [r.id for r in landed.collect()] == ["m1"]
    assert spark.read.parquet(str(tmp_path / "landed" / "quarantine")).count() == 1
    scan = landed.where(pr.from_contains("a1@")).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "headers" in scan.split("ReadSchema")[-1] and "parts" not in scan.split("ReadSchema")[-1]
