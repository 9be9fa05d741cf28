"""Analyses of a mailbox: senders, threads, labels, attachments, newsletters.

All are ordinary DataFrame aggregations: partial sums before every shuffle, no window
without a partition key, and no list of a group's rows held in one place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailsieve.functions.headers import contacts, header, parse_email
from mailsieve.functions.parts import attachment_summary
from mailsieve.operators.fields import project_fields
from mailsieve.operators.options import ExportOptions
from mailsieve.operators.predicates import text_contains
from mailsieve.sources.messages import utc_day

# Local parts that announce an address nobody reads.
NO_REPLY = r"(?i)^(?:no-?reply|do-?not-?reply|donotreply|notifications?|mailer-daemon|postmaster)(?:\+[^@]*)?@"
# Order and ticket ids in subjects.
SUBJECT_ID = r"[A-Z]{2,4}-[0-9]{4,10}"


def _fields(messages: DataFrame, *names: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return project_fields(messages, ExportOptions(fields=names), keep)


def _flag(column: str) -> Column:
    return F.when(F.col(column) == "true", 1).otherwise(0)


def unique_senders(messages: DataFrame) -> DataFrame:
    return _fields(messages, "from_email").where("from_email != ''").distinct()


def unique_sender_count(messages: DataFrame, error: float = 0.05) -> DataFrame:
    """One row: an estimate of the number of senders, without moving their addresses."""
    senders = _fields(messages, "from_email").where("from_email != ''")
    return senders.agg(F.approx_count_distinct("from_email", error).alias("senders"))


def sender_count_check(messages: DataFrame, error: float = 0.05, within: float = 0.15) -> DataFrame:
    """One row: the exact number of senders, and whether the estimate lies that close to it."""
    exact = unique_senders(messages).agg(F.count("*").alias("senders"))
    estimate = unique_sender_count(messages, error).select(F.col("senders").alias("estimate"))
    near = F.abs(F.col("estimate") - F.col("senders")) <= F.col("senders") * within
    both = exact.withColumn("one", F.lit(1)).join(estimate.withColumn("one", F.lit(1)), "one")
    return both.select("senders", near.alias("estimate_is_near"))


def sender_sketches(messages: DataFrame, lg_k: int = 12) -> DataFrame:
    """``day, sketch``: the senders of each UTC day as a sketch of bounded size, which merges with others."""
    senders = _fields(messages, "from_email", keep=("internal_date",)).where("from_email != ''")
    per_day = senders.groupBy(utc_day(F.col("internal_date")).alias("day"))
    return per_day.agg(F.hll_sketch_agg("from_email", lg_k).alias("sketch"))


def senders_by_month(sketches: DataFrame) -> DataFrame:
    """``month, senders``: estimated from the sketches of its days, without reading mail again."""
    month = F.trunc("day", "month").alias("month")
    merged = sketches.groupBy(month).agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.select("month", F.hll_sketch_estimate("sketch").alias("senders"))


def sender_months_check(messages: DataFrame, sketches: DataFrame, within: float = 0.1) -> DataFrame:
    """``month, senders, estimate_is_near``: the exact number of senders, and whether the sketches come that close."""
    senders = _fields(messages, "from_email", keep=("internal_date",)).where("from_email != ''")
    month = F.trunc(utc_day(F.col("internal_date")), "month")
    pairs = senders.select(month.alias("month"), "from_email").distinct()
    exact = pairs.groupBy("month").agg(F.count("*").alias("senders"))
    estimate = senders_by_month(sketches).withColumnRenamed("senders", "estimate")
    both = exact.join(estimate, exact["month"].eqNullSafe(estimate["month"])).select(exact["month"], "senders", "estimate")
    near = F.abs(F.col("estimate") - F.col("senders")) <= F.greatest(F.col("senders") * within, F.lit(1.0))
    return both.select("month", "senders", near.alias("estimate_is_near"))


def mail_by_sender(messages: DataFrame) -> DataFrame:
    return _fields(messages, "from_email").groupBy("from_email").agg(F.count("*").alias("messages"))


def contact_list(messages: DataFrame) -> DataFrame:
    """One row per address seen in From, Reply-To, To or Cc, with its most used name."""
    lists = F.array(*[header(F.col("headers"), h) for h in ("From", "Reply-To", "To", "Cc")])
    entries = F.flatten(F.transform(lists, contacts))
    people = messages.select(F.explode(F.transform(entries, parse_email)).alias("p")).select("p.*")
    by_name = (
        people.where("email != ''").groupBy("email", "name").agg(F.count("*").alias("uses"))
    )
    # Names win over no name, then by use, then alphabetically.
    rank = F.struct((F.col("name") != "").cast("int"), F.col("uses"), F.col("name"))
    return by_name.groupBy("email").agg(
        F.max_by("name", rank).alias("name"), F.sum("uses").alias("uses")
    )


def mail_by_domain(messages: DataFrame) -> DataFrame:
    """Messages and newsletters per domain; the share in whole per mille."""
    per = _fields(messages, "sender_domain", "has_list_unsubscribe").groupBy("sender_domain")
    counted = per.agg(
        F.count("*").alias("messages"), F.sum(_flag("has_list_unsubscribe")).alias("newsletters")
    )
    share = F.expr("newsletters * 1000 div messages")
    return counted.withColumn("newsletter_per_mille", share)


def noreply_senders(messages: DataFrame) -> DataFrame:
    """Addresses in From or Reply-To that look unattended, with their messages."""
    both = _fields(messages, "from_email", "reply_to")
    each = both.select(F.explode(F.array_distinct(F.array("from_email", "reply_to"))).alias("email"))
    return each.where(F.col("email").rlike(NO_REPLY)).groupBy("email").agg(F.count("*").alias("messages"))


def reply_mismatch(messages: DataFrame) -> DataFrame:
    """Messages whose Reply-To leads to another domain than the sender's."""
    rows = _fields(messages, "sender_domain", "reply_to_domain", keep=("id",))
    return rows.where("reply_to_domain != '' AND reply_to_domain != sender_domain")


def alias_usage(messages: DataFrame) -> DataFrame:
    """Messages per receiving address and plus-tag."""
    rows = _fields(messages, "delivered_to")
    tag = F.regexp_extract("delivered_to", r"^[^@+]*\+([^@]*)@", 1)
    return rows.groupBy("delivered_to", tag.alias("tag")).agg(F.count("*").alias("messages"))


def subject_patterns(messages: DataFrame) -> DataFrame:
    """Order and ticket ids found in subjects, with the messages that carry them."""
    found = F.regexp_extract_all(header(F.col("headers"), "Subject"), F.lit(SUBJECT_ID), 0)
    ids = messages.select(F.explode(F.array_distinct(found)).alias("subject_id"))
    return ids.groupBy("subject_id").agg(F.count("*").alias("messages"))


def dedupe_message_id(messages: DataFrame) -> DataFrame:
    """The earliest message per Message-ID; messages without one are all kept.

    A minimum per key rather than a sorted window: copies of a popular message collapse
    before the shuffle, so one key with very many copies is no hot spot.
    """
    key = header(F.col("headers"), "Message-ID")
    keyed = messages.select(
        "id", "internal_date", F.when(key != "", key).otherwise(F.concat(F.lit("\u0000"), "id")).alias("key")
    )
    first = keyed.groupBy("key").agg(F.min(F.struct("internal_date", "id")).alias("first"))
    message_id = F.when(F.startswith("key", F.lit("\u0000")), "").otherwise(F.col("key"))
    return first.select(message_id.alias("message_id"), "first.id", "first.internal_date")


def reply_links(messages: DataFrame) -> DataFrame:
    """Each message with the message it answers, if that one is in the mailbox.

    Parents are unique per Message-ID. Rows that answer nothing get a key of their own,
    so they spread over the tasks instead of meeting under one empty key.
    """
    parents = dedupe_message_id(messages.where(header(F.col("headers"), "Message-ID") != ""))
    parents = parents.select(F.col("message_id").alias("key"), F.col("id").alias("parent_id"))
    replies = messages.select("id", header(F.col("headers"), "In-Reply-To").alias("in_reply_to"))
    own_key = F.concat(F.lit("\u0000"), "id")
    keyed = replies.withColumn("key", F.when(F.col("in_reply_to") != "", F.col("in_reply_to")).otherwise(own_key))
    return keyed.join(parents, "key", "left").select("id", "in_reply_to", "parent_id")


def thread_summary(messages: DataFrame) -> DataFrame:
    """Messages, participants, span and longest silence per thread.

    Gaps depend only on the distinct seconds at which a thread has mail. These are
    compared within a day (at most 86,400 rows), then the days of a thread with each
    other, so that no window grows with the size of a thread.
    """
    rows = _fields(messages, "from_email", "thread_id", keep=("internal_date",)).where("thread_id != ''")
    rows = rows.withColumn("at", F.unix_timestamp("internal_date"))
    seconds = (
        rows.groupBy("thread_id", "at").agg(F.count("*").alias("n")).withColumn("day", F.expr("at div 86400"))
    )
    in_day = W.partitionBy("thread_id", "day").orderBy("at")
    gap = F.col("at") - F.lag("at").over(in_day)
    days = (
        seconds.withColumn("gap", gap)
        .groupBy("thread_id", "day")
        .agg(
            F.sum("n").alias("n"),
            F.min("at").alias("first_at"),
            F.max("at").alias("last_at"),
            F.max("gap").alias("gap"),
        )
    )
    across = W.partitionBy("thread_id").orderBy("day")
    between = F.col("first_at") - F.lag("last_at").over(across)
    spans = (
        days.withColumn("between", between)
        .groupBy("thread_id")
        .agg(
            F.sum("n").alias("messages"),
            F.min("first_at").alias("first_at"),
            F.max("last_at").alias("last_at"),
            F.max(F.greatest("gap", "between")).alias("longest_gap"),
        )
    )
    # Distinct pairs first: the second count then sees each participant once.
    people = rows.select("thread_id", "from_email").distinct().groupBy("thread_id")
    participants = people.agg(F.count("*").alias("participants"))
    return (
        spans.join(participants, "thread_id")
        .withColumn("span", F.col("last_at") - F.col("first_at"))
        .withColumn("longest_gap", F.coalesce("longest_gap", F.lit(0)))
    )


# System labels and their readable names.
SYSTEM_LABELS = {
    "INBOX": "In inbox",
    "SENT": "Sent mail",
    "TRASH": "In trash",
    "SPAM": "Marked as spam",
    "DRAFT": "Draft message",
    "STARRED": "Starred",
    "IMPORTANT": "Marked important",
    "UNREAD": "Not read yet",
    "CATEGORY_PERSONAL": "Personal",
    "CATEGORY_SOCIAL": "Social",
    "CATEGORY_PROMOTIONS": "Promotions",
    "CATEGORY_UPDATES": "Updates",
    "CATEGORY_FORUMS": "Forums",
}


def label_counts(messages: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Messages per label with the label's name.

    ``names`` (label_id, label_name) adds user labels; unnamed ids stand for themselves.
    It joins the counts, one row per label, not the messages.
    """
    counts = (
        messages.select(F.explode("label_ids").alias("label_id"))
        .groupBy("label_id")
        .agg(F.count("*").alias("messages"))
    )
    system = reduce(
        lambda rest, item: F.when(F.col("label_id") == item[0], item[1]).otherwise(rest),
        SYSTEM_LABELS.items(),
        F.lit(None).cast("string"),
    )
    if names is None:
        return counts.withColumn("label_name", F.coalesce(system, "label_id"))
    joined = counts.join(names, "label_id", "left")
    return joined.withColumn("label_name", F.coalesce("label_name", system, "label_id"))


def attachment_inventory(messages: DataFrame) -> DataFrame:
    """Messages per attachment type, and the attachments of those messages."""
    rows = messages.select(attachment_summary(F.col("parts")).alias("a"))
    each = rows.select(F.explode("a.types").alias("attachment_type"), F.col("a.count").alias("parts"))
    return each.groupBy("attachment_type").agg(
        F.count("*").alias("messages"), F.sum("parts").cast("bigint").alias("attachments")
    )


# Zone names of mail dates and their offsets.
ZONES = {
    "UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600",
    "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}


def sent_at(date_header: Column) -> Column:
    """A Date header as timestamp; null if it is not one.

    Weekday and comments are ignored. Seconds may be missing, a year may have two digits
    (00-49 are 20xx, the others 19xx), and the zone may be one of ``ZONES``."""
    bare = F.regexp_replace(date_header, r"\s*\([^)]*\)", "")
    bare = F.regexp_replace(bare, r"^\s*[A-Za-z]{3,9},?\s+|\s+$", "")
    century = F.when(F.regexp_extract(bare, r"^[0-9]{1,2} [A-Za-z]{3} ([0-9]{2}) ", 1).between("00", "49"), "20")
    bare = F.regexp_replace(bare, F.lit(r"^([0-9]{1,2} [A-Za-z]{3} )([0-9]{2}) "), F.concat(F.lit("$1"), century.otherwise("19"), F.lit("$2 ")))
    zone = F.upper(F.regexp_extract(bare, r" ([A-Za-z]{1,3})$", 1))
    offset = F.element_at(F.create_map(*[F.lit(x) for item in ZONES.items() for x in item]), zone)
    bare = F.coalesce(F.concat(F.regexp_replace(bare, r" [A-Za-z]{1,3}$", " "), offset), bare)
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f"d MMM yyyy {t} Z")) for t in ("HH:mm:ss", "HH:mm")])


def newsletter_tracking(messages: DataFrame) -> DataFrame:
    """Senders of newsletters: messages with and without the unsubscribe header."""
    rows = _fields(messages, "from_email", "sender_domain", "has_list_unsubscribe")
    per = rows.groupBy("from_email", "sender_domain").agg(
        F.count("*").alias("messages"), F.sum(_flag("has_list_unsubscribe")).alias("newsletters")
    )
    return per.where("newsletters > 0")


def body_search(messages: DataFrame, phrase: str) -> DataFrame:
    """Messages whose readable body contains the phrase."""
    rows = project_fields(messages, ExportOptions(fields=("body_text",), body_max_chars=0), ("id",))
    return rows.where(text_contains(F.col("body_text"), phrase))
