"""Rolled files by their names: staged, renamed, resumed, and filled batch by batch."""

import json
import random

import pytest
from pyspark.sql import functions as F

from mailsieve.operators.options import ExportOptions
from mailsieve.plans.export import export_totals, run_export, run_export_timed
from mailsieve.plans.mailbox import dump
from mailsieve.sources import csv_files, files
from mailsieve.sources.csv_files import close_rolled, roll_batch, write_rolled_csv
from mailsieve.sources.messages import DUMP_SCHEMA, stream_messages, with_parts
from mailsieve.sources.session import checkpoint_dir
from mailsieve.streaming.runs import export_rolled


def rows(spark, count=60, seed=1):
    draw = random.Random(seed)
    return spark.createDataFrame([(i, "x" * draw.randint(0, 25)) for i in range(count)], "k int, v string")


def content(path):
    return {p.name: p.read_text() for p in sorted(path.iterdir()) if not p.name.startswith((".", "_"))}


def by_one_writer(lines, cap, header="v"):
    """What a single writer leaves: file name -> text."""
    texts = [header + "\n"]
    for line in lines:
        if len(texts[-1]) + len(line) + 1 > cap:
            texts.append(header + "\n")
        texts[-1] += line + "\n"
    return {f"out{f'_part{n:03}' if n > 1 else ''}.csv": t for n, t in enumerate(texts, 1)}


@pytest.mark.parametrize("cap", [20, 60, 10_000])
def test_the_folder_holds_exactly_these_files(spark, tmp_path, cap):
    df = rows(spark)
    before = files.names(spark, checkpoint_dir(spark))
    stats = write_rolled_csv(df, str(tmp_path / "o"), "out", ["v"], "k", ["k"], cap).collect()
    want = by_one_writer([r.v for r in df.orderBy("k").collect()], cap)
    assert content(tmp_path / "o") == want
    assert {r.file: r.bytes for r in stats} == {n: len(t) for n, t in want.items()}
    assert files.names(spark, checkpoint_dir(spark)) == before  # nothing stays behind
    assert not [p for p in (tmp_path / "o").iterdir() if p.name.startswith("_")]


def test_nothing_to_export_is_a_header(spark, tmp_path):
    stats = write_rolled_csv(rows(spark, 0), str(tmp_path / "o"), "out", ["v"], "k", ["k"], 50).collect()
    assert content(tmp_path / "o") == {"out.csv": "v\n"} and [tuple(r) for r in stats] == [(1, "out.csv", 0, 2)]


def test_a_file_of_that_name_is_an_error(spark, tmp_path):
    write_rolled_csv(rows(spark), str(tmp_path / "o"), "out", ["v"], "k", ["k"], 60)
    write_rolled_csv(rows(spark), str(tmp_path / "o"), "outer", ["v"], "k", ["k"], 60)
    with pytest.raises(FileExistsError):
        write_rolled_csv(rows(spark), str(tmp_path / "o"), "out", ["v"], "k", ["k"], 60)


def test_a_run_after_a_failure_between_renames_finishes(spark, tmp_path, monkeypatch):
    df, done, real = rows(spark), [], files.move

    def failing(spark, source, target):
        if target.endswith(".csv") and len(done) >= 3:
            raise OSError("lost")
        done.append(target)
        real(spark, source, target)

    monkeypatch.setattr(files, "move", failing)
    monkeypatch.setattr(files, "_MOVERS", 1)
    with pytest.raises(OSError):
        write_rolled_csv(df, str(tmp_path / "o"), "out", ["v"], "k", ["k"], 60)
    monkeypatch.setattr(files, "move", real)
    want = by_one_writer([r.v for r in df.orderBy("k").collect()], 60)
    assert 0 < len(content(tmp_path / "o")) < len(want)
    stats = write_rolled_csv(df, str(tmp_path / "o"), "out", ["v"], "k", ["k"], 60).collect()
    assert content(tmp_path / "o") == want and sum(r.rows for r in stats) == 60


@pytest.mark.parametrize("cap,cuts", [(60, (20, 40)), (20, (1, 2)), (10_000, (30, 30)), (27, (0, 60))])
def test_batches_give_the_files_of_one_run(spark, tmp_path, cap, cuts):
    df = rows(spark, seed=cap)
    for batch, (first, last) in enumerate(zip((0, *cuts), (*cuts, 60))):
        own = df.where(F.col("k").between(first, last - 1))
        for _ in range(2 if batch == 1 else 1):  # the second batch runs twice
            roll_batch(own, str(tmp_path / "o"), "out", ["v"], "k", ["k"], cap, str(tmp_path / "state"), batch)
    total = close_rolled(spark, str(tmp_path / "o"), "out", ["v"], str(tmp_path / "state"))
    want = by_one_writer([r.v for r in df.orderBy("k").collect()], cap)
    assert content(tmp_path / "o") == want
    assert total == {"rows": 60, "bytes": sum(map(len, want.values())), "files": len(want)}


def test_no_batches_leave_a_header(spark, tmp_path):
    assert close_rolled(spark, str(tmp_path / "o"), "out", ["v"], str(tmp_path / "state"))["files"] == 1
    assert content(tmp_path / "o") == {"out.csv": "v\n"}


def test_a_stream_fills_the_files_that_one_export_fills(spark, sf, tmp_path):
    options = ExportOptions(
        fields=("message_id", "subject", "labels"), include_timestamp=False, prefix="out", max_bytes_per_file=4_000
    )
    mail = dump(spark, sf).drop("headers").orderBy(F.col("internal_date").desc(), "id").limit(150).collect()
    for at in (0, 50, 100):  # newest first, so that the order of arrival is the order of the export
        part = spark.createDataFrame(mail[at : at + 50], DUMP_SCHEMA)
        part.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        arriving = stream_messages(spark, str(tmp_path / "in"))
        stream = ExportOptions(**{**options.__dict__, "output_dir": str(tmp_path / "stream")})
        summary = export_rolled(arriving, stream, "out", str(tmp_path / "progress"), close=at == 100)
    batch = ExportOptions(**{**options.__dict__, "output_dir": str(tmp_path / "batch")})
    stats, total = run_export_timed(with_parts(spark.createDataFrame(mail, DUMP_SCHEMA)), batch)
    assert content(tmp_path / "stream") == content(tmp_path / "batch") and len(content(tmp_path / "batch")) > 2
    assert (summary.rows, summary.bytes, summary.files) == (total.rows, total.bytes, total.files)
    assert total.bytes == sum(r.bytes for r in stats.collect()) == sum(len(t.encode()) for t in content(tmp_path / "batch").values())
    assert total.rows == sum(r.rows for r in stats.collect()) and total.rows_per_second == total.rows / total.seconds > 0


def test_totals_without_a_limit(spark, sf, tmp_path):
    options = ExportOptions(fields=("subject",), output_dir=str(tmp_path), include_timestamp=False, max_bytes_per_file=0)
    mail = with_parts(dump(spark, sf).drop("headers"))
    total = export_totals(run_export(mail, options)).first()
    lines = spark.read.text(str(tmp_path / "mail_export.csv")).where("value != 'subject'")
    assert total.files == 1 and total.rows == lines.count()
    json.dumps(total.asDict())
    assert csv_files.STATS_SCHEMA.startswith("part")
