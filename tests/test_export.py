"""Field choice, selection, the export job, and the plans behind them."""

import datetime

import pytest
from pyspark.sql import functions as F

from mailsieve.operators import predicates as pr
from mailsieve.operators.fields import FIELD_SETS, choose_fields, project_fields
from mailsieve.operators.options import ExportOptions, base_name
from mailsieve.plans.export import export_rows, run_export, select_messages
from mailsieve.plans.mailbox import dump
from mailsieve.sources.messages import read_messages, with_parts
from mailsieve.sources.session import work_path


@pytest.fixture(scope="module")
def landed(spark, sf):
    path = work_path(spark, "dump")
    dump(spark, sf).drop("headers").write.parquet(path)
    return path


@pytest.fixture(scope="module")
def mail(spark, landed):
    return read_messages(spark, landed, "parquet")


def plan_of(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_choose_fields():
    assert choose_fields(" subject , nonsense,date") == ["subject", "date"]
    assert choose_fields("nonsense") == list(FIELD_SETS["default"])
    assert len(FIELD_SETS["all"]) == 21 and len(FIELD_SETS["default"]) == 10
    with pytest.raises(ValueError):
        choose_fields(["date", "date"])


def test_names():
    now = datetime.datetime(2025, 1, 29, 14, 30, 52)
    assert base_name(ExportOptions(prefix="x"), now) == "x_20250129_143052"
    assert base_name(ExportOptions(prefix="x", include_timestamp=False), now) == "x"


def test_null_labels_survive_negation(spark):
    df = spark.createDataFrame([(1, None), (2, ["SPAM"]), (3, ["INBOX"])], "i int, label_ids array<string>")
    assert [r.i for r in df.where(pr.received()).collect()] == [1, 3]
    assert [r.i for r in df.where(~pr.has_label("INBOX")).collect()] == [1, 2]


def test_fields_are_never_null_strings(mail):
    rows = project_fields(mail, ExportOptions(fields=FIELD_SETS["all"]))
    assert rows.columns == list(FIELD_SETS["all"])
    assert {t for _, t in rows.dtypes} == {"string"}
    assert rows.where(" OR ".join(f"`{c}` IS NULL" for c in rows.columns)).count() == 0


def test_cap_takes_the_newest(mail):
    chosen = select_messages(mail, ExportOptions(selection="all_mail", max_messages=5))
    newest = mail.where(pr.all_mail()).orderBy(F.col("internal_date").desc(), "id").limit(5)
    assert {r.id for r in chosen.collect()} == {r.id for r in newest.collect()}
    plan = plan_of(chosen)
    assert "TakeOrderedAndProject" not in plan
    ranked = pr.row_cap(mail.where(pr.all_mail()), 5)
    assert {r.id for r in ranked.collect()} == {r.id for r in newest.collect()}


def test_run_export_files_hold_the_export(spark, mail):
    options = ExportOptions(
        fields=("message_id", "subject", "body_text"),
        where="array_contains(label_ids, 'INBOX')",
        sanitize=True,
        output_dir=work_path(spark, "out"),
        include_timestamp=False,
        max_bytes_per_file=10_000,
    )
    stats = run_export(mail, options).collect()
    assert len(stats) > 2 and all(s.bytes <= 10_000 for s in stats)
    lines = spark.read.text(options.output_dir).select("value", F.col("_metadata.file_name").alias("file")).collect()
    count = export_rows(mail, options).count()
    assert sum(s.rows for s in stats) == count == len(lines) - len(stats)
    assert {s.file for s in stats} == {r.file for r in lines}


def test_unsplit_export(spark, mail):
    options = ExportOptions(
        fields=FIELD_SETS["minimal"], output_dir=work_path(spark, "out"), include_timestamp=False, max_bytes_per_file=0
    )
    stats = run_export(mail, options).collect()
    assert [s.rows for s in stats] == [export_rows(mail, options).count()]
    assert stats[0].bytes > stats[0].rows * 3


def test_header_exports_stay_in_the_jvm(spark, landed):
    raw = spark.read.parquet(landed)
    plan = plan_of(project_fields(with_parts(raw), ExportOptions(fields=("thread_id", "labels"))))
    assert "Python" not in plan and "payload" not in plan.split("ReadSchema")[1].splitlines()[0]
    assert "Exchange" not in plan


def test_one_python_stage_for_all_text_fields(spark, landed):
    rows = project_fields(with_parts(spark.read.parquet(landed)), ExportOptions(fields=FIELD_SETS["all"], sanitize=True))
    tree = plan_of(rows).split("\n\n")[0]
    assert tree.count("ArrowEvalPython") == 1 and "Exchange" not in tree


def test_date_range_reaches_the_scan(spark, landed):
    rows = with_parts(spark.read.parquet(landed)).where(pr.date_range("2024-01-02", "2024-01-03"))
    assert "GreaterThanOrEqual(internal_date" in plan_of(export_rows(rows))
