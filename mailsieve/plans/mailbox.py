"""A mailbox derived from the given tables: one message per conversation turn.

Bodies come from ``conversations`` (plain) and ``pages`` (HTML); senders, labels, dates
and attachments follow from the row's number ``k``, so that every rule of the
extraction functions has rows that exercise it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsieve.sources.tables import table

_NODE = "struct<mimeType:string,filename:string,body:struct<attachmentId:string,size:bigint,data:string>>"


def _base64url(c: Column) -> Column:
    code = F.base64(c.cast("binary"))
    for char, to in (("\r\n", ""), ("+", "-"), ("/", "_"), ("=", "")):  # translate looks every character up
        code = F.replace(code, F.lit(char), F.lit(to))
    return code


def _every(n: int, rest: int = 0) -> Column:
    return F.col("k") % n == rest


def _headers() -> Column:
    k, u, host = F.col("k"), F.col("u"), F.col("host")
    sender = (
        F.when(_every(37), "Foo <not an address>")
        .when(_every(41, 1), F.format_string("A <x> <User.%d@Z.org>", u))
        .when(_every(5), F.format_string('"User %d" <User.%d@%s>', u, u, host))
        .when(_every(5, 1), F.lower(F.format_string("User.%d@%s", u, host)))
        .when(_every(5, 2), F.format_string("User.%d@Example.com", u))
        .when(_every(5, 3), F.format_string("<u.%d@example.org>", u))
        .otherwise("")
    )
    sent = F.date_format("internal_date", "d MMM yyyy HH:mm:ss")
    weekday = F.when(_every(2), F.concat(F.date_format("internal_date", "EEE"), F.lit(", "))).otherwise("")
    zone = F.when(_every(3), " +0000").otherwise(" -0500")
    comment = F.when(_every(8), " (UTC)").otherwise("")
    values = [
        ("From", sender),
        (
            "Reply-To",
            F.when(_every(4), F.format_string("reply.%d@%s", u, F.lower(host))).when(
                _every(4, 1), "No Reply <No-Reply@notify.example.com>"
            ),
        ),
        ("Delivered-To", F.format_string("me+tag%d@example.com", k % 3)),
        ("To", F.format_string('"Doe, Jane %d" <Jane.%d@example.com>, team%d@example.org', u, u, u % 5)),
        ("Cc", F.when(_every(6), F.format_string("cc.%d@example.net", u % 11))),
        ("Bcc", F.when(_every(12, 5), F.format_string("hidden.%d@example.net", u % 3))),
        (
            "Subject",
            F.concat(
                F.when(_every(9), F.format_string("Order #AB-%06d ", k))
                .when(_every(9, 4), F.format_string("Re: ticket TCK-%05d ", k))
                .otherwise(""),
                F.col("text"),
            ),
        ),
        ("Date", F.when(_every(53), "yesterday").otherwise(F.concat(weekday, sent, zone, comment))),
        ("Message-ID", F.format_string("<%d@mail.example.com>", k - F.when(_every(29), 1).otherwise(0))),
        ("In-Reply-To", F.when(F.col("turn") > 0, F.format_string("<%d@mail.example.com>", k - 1))),
        (
            "List-Unsubscribe",
            F.when(_every(10), F.format_string("<mailto:unsub@%s>", F.lower(host))).when(_every(10, 1), " "),
        ),
        ("From", F.when(_every(11), "Second <second@example.net>")),
    ]
    pairs = F.array(
        *[
            F.struct(
                F.when(_every(3, 1), name.upper()).otherwise(name).alias("name"), v.alias("value")
            )
            for name, v in values
        ]
    )
    return F.filter(pairs, lambda h: h["value"].isNotNull())


def _node(mime: str | Column, filename=None, attachment=None, size=None, data=None) -> Column:
    def as_column(v):
        return v if isinstance(v, Column) else F.lit(v)

    body = F.struct(
        as_column(attachment).cast("string").alias("attachmentId"),
        as_column(size).cast("bigint").alias("size"),
        as_column(data).cast("string").alias("data"),
    )
    return F.struct(
        as_column(mime).cast("string").alias("mimeType"),
        as_column(filename).cast("string").alias("filename"),
        body.alias("body"),
    )


def _payload() -> Column:
    text, html = F.col("text"), F.col("html")
    plain = _node("text/plain", "", size=F.octet_length(text), data=_base64url(text))
    markup = _node(F.when(_every(3, 1), "TEXT/HTML").otherwise("text/html"), "", data=_base64url(html))
    nothing = F.lit(None).cast(_NODE)
    has_plain, has_html = ~_every(5, 2), html.isNotNull()
    bodies = F.array_compact(
        F.array(F.when(has_plain, plain).otherwise(nothing), F.when(has_html, markup).otherwise(nothing))
    )
    files = [
        (_every(4), _node("application/pdf", "Report.PDF", size=10)),
        (_every(6), _node("application/gzip", "archive.tar.gz", attachment="att-1", size=0)),
        (_every(12), _node("Text/Plain", " README ", attachment="att-2", data=_base64url(F.lit("read me")))),
        (_every(14), _node("image/png", "logo.png")),
        (_every(15), _node("text/plain", "", attachment="att-3", data=_base64url(F.lit("attached text")))),
        (_every(16), _node(None, "x.", attachment="att-4")),
        (_every(20), _node("application/pdf", "Second.pdf", size=20)),
    ]
    attached = F.array_compact(F.array(*[F.when(c, n).otherwise(nothing) for c, n in files]))
    inner = F.array().cast(f"array<{_NODE}>")
    children = F.transform(attached, lambda n: n.withField("parts", inner))
    alternative = _node("multipart/alternative", "", size=0).withField("parts", bodies)
    parts = F.concat(F.array(alternative), children)
    root = _node("multipart/mixed", "", size=0)
    leaf = plain.withField("headers", F.col("headers"))
    tree = root.withField("headers", F.col("headers")).withField("parts", parts)
    return F.when(_every(19), F.to_json(leaf)).otherwise(F.to_json(tree))


def _labels() -> Column:
    labels = F.array(
        F.when(F.col("role") == "assistant", "SENT").otherwise("INBOX"),
        F.when(_every(2), "UNREAD"),
        F.when(_every(7), "STARRED"),
        F.when(_every(13), "SPAM"),
        F.when(_every(17), "TRASH"),
        F.when(_every(5), F.format_string("Label_%d", F.col("k") % 3)),
    )
    return F.when(~_every(23), F.array_compact(labels))


def dump(spark: SparkSession, folder: str) -> DataFrame:
    """The mailbox in dump form (``sources.messages.DUMP_SCHEMA``) with ``headers``.

    Turns meet their page in a fixed number of even tasks: markup packs well, so that a small file may be much to
    broadcast, and few bytes that meet make much work."""
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    pages = table(spark, folder, "pages").select("page_id", "html")
    page_count = pages.agg(F.count(F.lit(1))).scalar()
    turns = (
        table(spark, folder, "conversations")
        .withColumn("k", F.col("conv_id") * 1000 + F.col("turn"))
        .withColumn("u", (F.col("conv_id") * 31 + F.col("turn")) % 997)
        .withColumn("page_id", (F.col("conv_id") * 31 + F.col("turn")) % page_count)
        .withColumn("host", F.format_string("Mail%d.Example.COM", F.col("u") % 7))
        .withColumn("internal_date", F.timestamp_seconds(F.lit(1704067200) + F.col("k") * 60))
        .repartition(tasks, "page_id")
        .join(pages.repartition(tasks, "page_id").hint("merge"), "page_id", "left")
        .withColumn("headers", _headers())
    )
    snippet = F.concat(
        F.replace("text", F.lit("&"), F.lit("&amp;")), F.when(_every(3), "&nbsp;").otherwise("")
    )
    return turns.select(
        F.format_string("m%d", "k").alias("id"),
        "internal_date",
        F.when(~_every(41), F.format_string("t%d", "conv_id")).alias("thread_id"),
        _labels().alias("label_ids"),
        snippet.alias("snippet"),
        "headers",
        _payload().alias("payload"),
    )
