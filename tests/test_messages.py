"""Headers, parts and bodies on literal messages."""

import base64
import json

from pyspark.sql import functions as F

from mailsieve.functions.headers import contacts, email_domain, header, parse_email
from mailsieve.functions.parts import (
    attachment_summary,
    body_html,
    body_text,
    decode_body,
    flatten_parts,
    truncate_chars,
)
from mailsieve.sources.messages import with_parts


def b64(text):
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def tree(spark, *roots):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(roots)], "i int, payload string")
    return df.select("i", flatten_parts(F.parse_json("payload")).alias("parts")).orderBy("i")


ADDRESSES = [
    ('"John Doe" <john@example.com>', "John Doe", "john@example.com"),
    ("you@mail.com", "", "you@mail.com"),
    ("John@Example.COM", "John@Example.COM", "john@example.com"),
    ("<a@b.co>", "", "a@b.co"),
    ("A <x> <Y@Z.org>", "A <x>", "y@z.org"),
    ("Foo <not an address>", "Foo", "not an address"),
    ("Jane jane@x.org (home)", "Jane  (home)", "jane@x.org"),
    ("no address", "", ""),
    ("", "", ""),
    (None, "", ""),
]


def test_parse_email(spark):
    df = spark.createDataFrame([(i, a[0]) for i, a in enumerate(ADDRESSES)], "i int, raw string").orderBy("i")
    got = df.select(parse_email(F.col("raw")).alias("e")).select("e.*").collect()
    assert [tuple(r) for r in got] == [(n, e) for _, n, e in ADDRESSES]


def test_domain_is_behind_the_first_at(spark):
    df = spark.createDataFrame([("a@b@C.com",), ("none",), ("",)], "e string")
    assert [r[0] for r in df.select(email_domain(F.col("e"))).collect()] == ["b@c.com", "", ""]


def test_first_header_wins_without_case(spark):
    df = spark.createDataFrame(
        [([("X", "1"), ("FROM", "a"), ("from", "b")],), ([("From", None)],), (None,)],
        "headers array<struct<name:string,value:string>>",
    )
    assert [r[0] for r in df.select(header(F.col("headers"), "From")).collect()] == ["a", "", ""]


def test_contacts_split_outside_quotes(spark):
    df = spark.createDataFrame([('"Doe, J" <a@b.co>, c@d.org, E F <g@h.i>',)], "x string")
    got = df.select(F.transform(contacts(F.col("x")), parse_email).alias("c")).first().c
    assert [tuple(c) for c in got] == [("Doe, J", "a@b.co"), ("", "c@d.org"), ("E F", "g@h.i")]


def test_attachments(spark):
    kids = [
        {"filename": "Report.PDF", "body": {"size": 10}},
        {"filename": "README", "mimeType": "Text/Plain", "body": {"attachmentId": "a"}},
        {"filename": "x.", "body": {"attachmentId": "b"}},
        {"filename": "", "body": {"attachmentId": "c"}},
        {"filename": "empty.png", "body": {"size": 0}},
    ]
    twice = [{"filename": "a.tar.gz", "body": {"attachmentId": "a"}}] * 2
    got = tree(spark, {"parts": kids}, {"parts": twice}, {}).select(attachment_summary(F.col("parts")).alias("a")).collect()
    assert [tuple(r.a) for r in got] == [
        (True, ["pdf", "text/plain", "unknown"], 3),
        (True, ["gz"], 2),
        (False, [], 0),
    ]


def test_parts_come_in_pre_order(spark):
    deep = {"mimeType": "0", "parts": [
        {"mimeType": "1", "parts": [{"mimeType": "2"}, {"mimeType": "3", "parts": [{"mimeType": "4"}]}]},
        {"mimeType": "5"},
    ]}
    wide = {"mimeType": "r", "parts": [{"mimeType": str(i)} for i in range(30)]}
    a, b = tree(spark, deep, wide).collect()
    assert [p.mime_type for p in a.parts] == list("012345")
    assert [p.mime_type for p in b.parts] == ["r"] + [str(i) for i in range(30)]


def test_trees_of_any_depth(spark):
    def nested(n):
        return {"mimeType": str(n), "parts": [nested(n - 1), {"mimeType": f"leaf {n}"}]} if n else {"mimeType": "0"}

    def expected(n):
        return [str(n), *expected(n - 1), f"leaf {n}"] if n else ["0"]

    depths = (0, 1, 16, 17, 40, 200)
    for n, row in zip(depths, tree(spark, *map(nested, depths)).collect()):
        assert [p.mime_type for p in row.parts] == expected(n)


def test_brackets_in_texts_are_harmless(spark):
    texts = {"headers": [{"name": "Subject", "value": "[[[[[[" * 50}], "parts": [{"mimeType": "[", "parts": []}]}
    assert [p.mime_type for p in tree(spark, texts).first().parts] == [None, "["]


def test_decode_body(spark):
    bad = base64.urlsafe_b64encode(b"a\xffb").decode()
    rows = ["SGVsbG8", "SGVs\r\nbG8=", "PGI-", bad, "SGVsb", "", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, d string").orderBy("i")
    got = [r[0] for r in df.select(decode_body(F.col("d"))).collect()]
    assert got == ["Hello", "Hello", "<b>", "a�b", "Hel", "", None]


def test_bodies(spark):
    plain = {"mimeType": "text/plain", "body": {"data": b64(" one  two ")}}
    more = {"mimeType": "TEXT/plain", "body": {"data": b64("three")}}
    html = {"mimeType": "text/HTML", "body": {"data": b64("<p>Hi <b>you</b></p>")}}
    attached = {"mimeType": "text/plain", "filename": "a.txt", "body": {"data": b64("no")}}
    by_id = {"mimeType": "text/plain", "body": {"data": b64("no"), "attachmentId": "x"}}
    roots = [
        {"parts": [plain, html, more, attached, by_id]},
        {"parts": [html, attached]},
        {"mimeType": "text/plain", "body": {"data": b64("pin: 12345678")}},
        {},
    ]
    rows = tree(spark, *roots).select(
        body_text(F.col("parts")).alias("t"),
        body_text(F.col("parts"), 3).alias("short"),
        body_text(F.col("parts"), 9, ("otp_codes",)).alias("cut"),
        body_html(F.col("parts"), 5).alias("h"),
    )
    assert [tuple(r) for r in rows.collect()] == [
        ("one two\nthree", "one", "one two\nt", "<p>Hi"),
        ("Hi you", "Hi ", "Hi you", "<p>Hi"),
        ("pin: 12345678", "pin", "[REDACTED_CODE]", ""),
        ("", "", "", ""),
    ]


def test_filters_on_body_text(spark):
    rows = tree(spark, {"mimeType": "text/plain", "body": {"data": b64("hello")}}, {})
    text = rows.select("i", body_text(F.col("parts")).alias("t"))
    assert [r.i for r in text.where("t like 'h%'").collect()] == [0]


def test_truncate_counts_characters(spark):
    df = spark.createDataFrame([("aé😀b",)], "s string")
    got = df.select(truncate_chars(F.col("s"), 3), truncate_chars(F.col("s"), 0)).first()
    assert tuple(got) == ("aé😀", "aé😀b")


def test_rows_without_id_are_skipped(spark):
    schema = "id string, internal_date timestamp, thread_id string, label_ids array<string>, snippet string, payload string"
    rows = [("m1", None, None, None, None, '{"headers":[{"name":"From","value":"x"}]}'), ("", *[None] * 4, "{}"), (None, *[None] * 5)]
    got = with_parts(spark.createDataFrame(rows, schema)).collect()
    assert [r.id for r in got] == ["m1"] and got[0].headers[0].value == "x"
