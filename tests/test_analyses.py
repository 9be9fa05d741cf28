"""Analyses against brute force on a small mailbox with hot groups."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from mailsieve.operators import analyses as an
from mailsieve.streaming import runs

START = datetime.datetime(2024, 1, 1)
SCHEMA = (
    "id string, internal_date timestamp, thread_id string, label_ids array<string>, snippet string, "
    "headers array<struct<name:string,value:string>>, "
    "parts array<struct<path:string,mime_type:string,filename:string,attachment_id:string,size:bigint,data:string>>"
)


def messages(n=400):
    """Half of the mail in one thread, from one sender, with one Message-ID."""
    rng = random.Random(7)
    rows = []
    for i in range(n):
        hot = i % 2 == 0
        sender = "hot@x.io" if hot else f"s{rng.randrange(20)}@y{rng.randrange(3)}.org"
        message_id = "<hot>" if hot else ("" if rng.random() < 0.1 else f"<{rng.randrange(150)}>")
        answers = "<hot>" if rng.random() < 0.4 else ("" if rng.random() < 0.5 else f"<{rng.randrange(200)}>")
        at = START + datetime.timedelta(seconds=rng.randrange(10 * 86400))
        heads = [("From", sender), ("Message-ID", message_id), ("In-Reply-To", answers)]
        thread = "hot" if hot else f"t{rng.randrange(15)}"
        rows.append((f"m{i:04d}", at, thread, ["INBOX", f"L{i % 3}"], "", heads, []))
    return rows


@pytest.fixture(scope="module")
def rows():
    return messages()


@pytest.fixture(scope="module")
def mail(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def head(row, name):
    return dict(row[5])[name]


def seconds(t):
    return int((t - datetime.datetime(1970, 1, 1)).total_seconds())


def test_thread_summary(mail, rows):
    want = set()
    for thread in {r[2] for r in rows}:
        own = sorted((r for r in rows if r[2] == thread), key=lambda r: r[1])
        at = [seconds(r[1]) for r in own]
        gaps = [b - a for a, b in zip(at, at[1:])] or [0]
        want.add((thread, len(own), at[0], at[-1], max(gaps), len({head(r, "From") for r in own}), at[-1] - at[0]))
    columns = ["thread_id", "messages", "first_at", "last_at", "longest_gap", "participants", "span"]
    got = an.thread_summary(mail).select(*columns).collect()
    # Timestamps of local rows pass through the Python time zone.
    shift = {g.first_at - w[2] for g in got for w in want if g.thread_id == w[0]}
    assert len(shift) == 1
    d = shift.pop()
    assert {tuple(g) for g in got} == {(w[0], w[1], w[2] + d, w[3] + d, *w[4:]) for w in want}


def test_dedupe_keeps_the_earliest(mail, rows):
    first = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        key = head(r, "Message-ID") or r[0]
        first.setdefault(key, r[0])
    assert {r.id for r in an.dedupe_message_id(mail).collect()} == set(first.values())


def test_reply_links(mail, rows):
    first = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        first.setdefault(head(r, "Message-ID"), r[0])
    want = {(r[0], head(r, "In-Reply-To"), first.get(head(r, "In-Reply-To")) if head(r, "In-Reply-To") else None) for r in rows}
    assert {tuple(r) for r in an.reply_links(mail).collect()} == want


def test_sender_counts(mail, rows):
    senders = {head(r, "From") for r in rows}
    assert {r.from_email for r in an.unique_senders(mail).collect()} == senders
    estimate = an.unique_sender_count(mail, 0.01).first().senders
    assert abs(estimate - len(senders)) <= 0.05 * len(senders)


def test_label_names(spark, mail, rows):
    names = spark.createDataFrame([("L1", "Work")], "label_id string, label_name string")
    got = {r.label_id: (r.messages, r.label_name) for r in an.label_counts(mail, names).collect()}
    assert got["INBOX"] == (len(rows), "In inbox") and got["L1"][1] == "Work" and got["L2"][1] == "L2"


DATES = [
    ("Tue, 15 Jan 2025 09:30:00 -0500", 1736951400),
    ("5 Feb 2025 09:30:00 +0000 (UTC)", 1738747800),
    ("yesterday", None),
    ("", None),
]


def test_sent_at(spark):
    df = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(DATES)], "i int, d string").orderBy("i")
    got = [r[0] for r in df.select(F.unix_timestamp(an.sent_at(F.col("d")))).collect()]
    assert got == [t for _, t in DATES]


def test_stream_equals_batch_over_several_files(spark, sf):
    from mailsieve.operators.options import ExportOptions
    from mailsieve.plans.mailbox import dump
    from mailsieve.sources.messages import with_parts

    options = ExportOptions(fields=("from_email", "subject", "body_text"), sanitize=True)
    mailbox = dump(spark, sf).drop("headers").repartition(5)
    streamed = runs.arrived(lambda m: runs.export_stream(m, options), mailbox)
    batch = runs.export_stream(with_parts(mailbox), options)
    assert sorted(streamed.collect()) == sorted(batch.collect())


def test_sent_at_forms(spark):
    forms = {
        "Mon, 15 Jan 2024 10:30:00 +0100": "2024-01-15 09:30:00",
        "15 Jan 2024 10:30:00 GMT": "2024-01-15 10:30:00",
        "Mon, 15 Jan 2024 10:30 -0500 (EST)": "2024-01-15 15:30:00",
        "15 Jan 24 10:30:00 EST": "2024-01-15 15:30:00",
        "Tue, 5 Mar 99 01:02 PDT": "1999-03-05 08:02:00",
        "Mon,  15 Jan 2024 10:30:00 UT": "2024-01-15 10:30:00",
        "yesterday": None,
        "": None,
    }
    rows = spark.createDataFrame([(k,) for k in forms], "d string")
    got = {r.d: r.t and str(r.t) for r in rows.select("d", an.sent_at(F.col("d")).cast("string").alias("t")).collect()}
    assert got == forms
