"""The landed mailbox: one parse, bodies apart, days as folders, batches that may run twice."""

import json
import subprocess
import sys
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from mailsieve.operators import analyses as an
from mailsieve.operators import predicates as pr
from mailsieve.operators.fields import FIELD_SETS, project_fields
from mailsieve.operators.options import ExportOptions
from mailsieve.plans.mailbox import dump
from mailsieve.sources import files
from mailsieve.sources.messages import (
    DUMP_SCHEMA,
    ingest,
    land_messages,
    read_landed,
    read_quarantine,
    with_parts,
)
from mailsieve.sources.session import job_folder, work_path


@pytest.fixture(scope="module")
def landed(spark, sf):
    path = work_path(spark, "landed")
    land_messages(dump(spark, sf).drop("headers"), path)
    return read_landed(spark, path)


def plan_of(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def read_columns(df):
    return " ".join(x for x in plan_of(df).splitlines() if x.startswith("ReadSchema"))


@pytest.mark.parametrize("fields", [FIELD_SETS["all"], FIELD_SETS["attachment"]])
def test_landed_messages_give_the_same_fields(spark, sf, landed, fields):
    options = ExportOptions(fields=fields, sanitize=True)
    raw = with_parts(dump(spark, sf).drop("headers"))
    got = project_fields(landed, options, ("id",)).collect()
    assert sorted(got) == sorted(project_fields(raw, options, ("id",)).collect())


def test_attachments_read_no_bodies(landed):
    queries = [
        landed.where(pr.has_attachment()).select("id"),
        project_fields(landed, ExportOptions(fields=("has_attachment", "attachment_types", "attachment_count"))),
        an.attachment_inventory(landed),
    ]
    for query in queries:
        assert "parts" in read_columns(query)
        assert "bodies" not in read_columns(query) and "snippet" not in read_columns(query)
    assert "bodies" in read_columns(project_fields(landed, ExportOptions(fields=("body_text",))))


def test_links_and_threads_read_narrow_columns(landed):
    for query in (an.reply_links(landed), an.thread_summary(landed)):
        assert "parts" not in read_columns(query) and "bodies" not in read_columns(query)


def test_a_range_of_dates_reads_its_days(landed):
    chosen = pr.in_dates(landed, "2024-01-02", "2024-01-04")
    scan = [x for x in plan_of(chosen).splitlines() if x.startswith("PartitionFilters")]
    assert any("day" in x and "2024-01-02" in x and "2024-01-04" in x for x in scan)
    plain = landed.where(pr.date_range("2024-01-02", "2024-01-04"))
    assert sorted(r.id for r in chosen.select("id").collect()) == sorted(r.id for r in plain.select("id").collect())
    assert 0 < chosen.count() < landed.count()
    assert {str(r.day) for r in chosen.select("day").distinct().collect()} <= {f"2024-01-0{d}" for d in (2, 3)}


@pytest.mark.parametrize("zone,period", [("Asia/Tokyo", "day"), ("America/Los_Angeles", "day"), ("Asia/Tokyo", "month")])
def test_days_hold_in_other_time_zones(spark, tmp_path, zone, period):
    start = datetime(2024, 3, 9, tzinfo=timezone.utc)
    rows = [(f"m{i}", start + timedelta(hours=i), None, None, None, "{}") for i in range(96)] + [("x", *[None] * 4, "{}")]
    land_messages(spark.createDataFrame(rows, DUMP_SCHEMA), str(tmp_path), period=period)
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        mail = read_landed(spark, str(tmp_path))
        for bounds in (("2024-03-10", "2024-03-11"), (None, "2024-03-10"), ("2024-03-11", None), (None, None)):
            want = mail.where(pr.date_range(*bounds)).count()
            assert pr.in_dates(mail, *bounds).count() == want > 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def _mail(i, payload=None, at=datetime(2024, 5, 1)):
    return (f"m{i}", at, "t", ["INBOX"], "s", json.dumps({"headers": [{"name": "From", "value": f"a{i}@x.org"}]}) if payload is None else payload)


def test_payloads_are_parsed_once_for_both_tables(spark, tmp_path):
    rows = [_mail(1), _mail(2, "{broken"), ("", *_mail(3)[1:]), _mail(4, at=None)]
    land_messages(spark.createDataFrame(rows, DUMP_SCHEMA), str(tmp_path))
    assert sorted(r.id for r in read_landed(spark, str(tmp_path)).collect()) == ["m1", "m4"]
    aside = sorted((r.id, r.reason, r.payload) for r in read_quarantine(spark, str(tmp_path)).collect())
    assert aside == [("", "no id", rows[2][5]), ("m2", "bad payload", "{broken")]
    assert files.names(spark, f"{tmp_path}/_staging") == []


def test_nothing_landed(spark, tmp_path):
    land_messages(spark.createDataFrame([], DUMP_SCHEMA), str(tmp_path))
    assert read_landed(spark, str(tmp_path)).count() == read_quarantine(spark, str(tmp_path)).count() == 0


def test_a_batch_that_runs_twice_is_landed_once(spark, tmp_path):
    source, path, progress = (str(tmp_path / x) for x in ("in", "landed", "progress"))
    for rows in ([_mail(1), _mail(2, "{broken")], [_mail(3), _mail(1)]):
        spark.createDataFrame(rows, DUMP_SCHEMA).coalesce(1).write.mode("append").json(source)
    ingest(spark, source, path, progress, files_per_batch=1)
    want = ["m1", "m1", "m3"]
    assert sorted(r.id for r in read_landed(spark, path).collect()) == want
    last = max(int(n) for n in files.names(spark, f"{progress}/commits") if n.isdigit())
    files.remove(spark, f"{progress}/commits/{last}")  # as if the batch had failed after its renames
    spark.createDataFrame([_mail(9)], DUMP_SCHEMA).coalesce(1).write.mode("append").json(source)
    ingest(spark, source, path, progress, files_per_batch=1)
    assert sorted(r.id for r in read_landed(spark, path).collect()) == [*want, "m9"]
    assert [r.id for r in read_quarantine(spark, path).collect()] == ["m2"]


def test_a_failure_between_the_renames_is_mended(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([_mail(1), _mail(2, "{broken")], DUMP_SCHEMA)
    moves, real = [], files.move

    def failing(spark, source, target):
        moves.append(target)
        if len(moves) == 2:
            raise OSError("lost")
        real(spark, source, target)

    monkeypatch.setattr(files, "move", failing)
    with pytest.raises(OSError):
        land_messages(rows, str(tmp_path), 7)
    monkeypatch.setattr(files, "move", real)
    land_messages(rows, str(tmp_path), 7)
    assert [r.id for r in read_landed(spark, str(tmp_path)).collect()] == ["m1"]
    assert [r.id for r in read_quarantine(spark, str(tmp_path)).collect()] == ["m2"]


def test_phrase_search_on_landed_messages(spark, sf, landed):
    raw = with_parts(dump(spark, sf).drop("headers"))
    want = sorted(r.id for r in pr.phrase_search(raw, "ver die").select("id").collect())
    assert sorted(r.id for r in pr.phrase_search(landed, "ver die").select("id").collect()) == want


def test_job_folder_is_removed(spark):
    with job_folder(spark) as root:
        path = work_path(spark, "x")
        spark.range(3).write.parquet(path)
        assert path.startswith(root) and files.exists(spark, path)
    assert not files.exists(spark, root)


def test_a_plain_session_has_a_folder(tmp_path):
    """In a process of its own, without any Spark defaults."""
    code = (
        "from pyspark.sql import SparkSession; from mailsieve.sources.session import work_path;"
        "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate();"
        "assert s.conf.get('spark.checkpoint.dir', None) is None;"
        "p = work_path(s, 'x'); s.range(2).write.parquet(p);"
        "assert s.read.parquet(p).count() == 2 and work_path(s, 'y').rsplit('/', 1)[0] == p.rsplit('/', 1)[0]; print('fine')"
    )
    import os

    env = {k: v for k, v in os.environ.items() if not k.startswith("SPARK_") and k != "PYSPARK_SUBMIT_ARGS"}
    env["SPARK_CONF_DIR"] = str(tmp_path)
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=180, cwd=os.path.dirname(os.path.dirname(__file__)))
    assert out.stdout.strip().endswith("fine"), out.stderr[-2000:]


def test_scarce_mail_shares_folders(spark, tmp_path):
    start = datetime(2024, 1, 1, 12)
    rows = [_mail(i, at=start + timedelta(days=i)) for i in range(1000)]
    land_messages(spark.createDataFrame(rows[:20], DUMP_SCHEMA), str(tmp_path), 0)
    land_messages(spark.createDataFrame(rows[20:], DUMP_SCHEMA), str(tmp_path), 1)
    folders = [len(list((tmp_path / "messages").glob(f"batch={b}/span=*/day=*"))) for b in (0, 1)]
    assert folders[0] == 20 and 30 < folders[1] <= 65  # by day while days are few; 980 messages make no 980 folders
    mail = read_landed(spark, str(tmp_path))
    assert mail.count() == 1000
    for first, last in ((0, 3), (15, 25), (500, 501), (513, 600), (998, 1000)):
        bounds = [str((start + timedelta(days=d)).date()) for d in (first, last)]
        assert sorted(r.id for r in pr.in_dates(mail, *bounds).collect()) == sorted(f"m{i}" for i in range(first, last))
    scan = [x for x in plan_of(pr.in_dates(mail, "2025-01-01", "2025-01-02")).splitlines() if x.startswith("PartitionFilters")]
    assert any("day" in x and "span" in x and "2025-01-01" in x for x in scan)
    assert len(pr.in_dates(mail, "2025-01-01", "2025-01-02").inputFiles()) > 0


def test_bodies_land_decoded_and_read_the_same(spark, tmp_path):
    data = ["SGVsbG8", "=", "", "A", "SGk", None, "_-_-", "w7w=", "S G V s\nbG8=", "/+8"]
    parts = [{"mimeType": "text/plain", "body": {"data": d}, "parts": []} for d in data]
    payloads = [json.dumps({"headers": [], "parts": chosen}) for chosen in (parts, parts[:2], parts[1:5], parts[2:3], parts[6:])]
    dumped = spark.createDataFrame([_mail(i, p) for i, p in enumerate(payloads)], DUMP_SCHEMA)
    land_messages(dumped, str(tmp_path))
    mail = read_landed(spark, str(tmp_path))
    assert dict(mail.dtypes)["bodies"] == "array<binary>"
    options = ExportOptions(fields=("body_text", "body_html"), body_max_chars=0)
    raw = project_fields(with_parts(dumped), options, ("id",)).collect()
    assert sorted(project_fields(mail, options, ("id",)).collect()) == sorted(raw)
    assert any("\n\n" in r.body_text for r in raw)


def test_landed_bodies_are_read_as_they_are(spark, sf, landed):
    assert "base64.encode(" not in plan_of(an.body_search(landed, "que la")).lower()
    found = an.body_search(landed, "que la").collect()
    raw = an.body_search(with_parts(dump(spark, sf).drop("headers")), "que la").collect()
    assert len(found) and sorted(found) == sorted(raw)


def test_turns_meet_pages_in_even_tasks(spark, sf):
    rows = dump(spark, sf).select("payload")
    assert "Broadcast" not in plan_of(rows) and "SortMergeJoin" in plan_of(rows)
    assert rows.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
