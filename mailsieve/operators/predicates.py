"""Message selection: mailbox searches as composable boolean columns.

They combine with ``&`` and ``~``. A missing label list counts as empty, so that
negation does not lose rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailsieve.functions.headers import header
from mailsieve.functions.parts import attachment_summary, body_text
from mailsieve.operators.rollover import with_offsets
from mailsieve.sources.messages import PERIODS, period_of, whole_parts


def _labels() -> Column:
    return F.coalesce(F.col("label_ids"), F.array().cast("array<string>"))


def has_label(label: str) -> Column:
    return F.array_contains(_labels(), label)


def has_any_label(*labels: str) -> Column:
    return F.arrays_overlap(_labels(), F.array(*map(F.lit, labels)))


def received() -> Column:
    """The default selection: neither sent nor spam nor trash."""
    return ~has_any_label("SENT", "SPAM", "TRASH")


def all_mail() -> Column:
    return ~has_any_label("SPAM", "TRASH")


def inbox() -> Column:
    return has_label("INBOX")


def starred() -> Column:
    return has_label("STARRED")


def unread() -> Column:
    return has_label("UNREAD")


def text_contains(c: Column, phrase: str) -> Column:
    """Case-insensitive phrase search."""
    return F.contains(F.lower(c), F.lit(phrase.lower()))


def from_contains(phrase: str) -> Column:
    return text_contains(header(F.col("headers"), "From"), phrase)


def subject_contains(phrase: str) -> Column:
    return text_contains(header(F.col("headers"), "Subject"), phrase)


def phrase_search(messages: DataFrame, phrase: str) -> DataFrame:
    """Messages with the phrase in the subject or the readable body."""
    bodies = messages.withColumn("_body", body_text(whole_parts(messages), whole=True))
    hit = subject_contains(phrase) | text_contains(F.col("_body"), phrase)
    return bodies.where(hit).drop("_body")


def has_attachment() -> Column:
    return attachment_summary(F.col("parts"))["has"]


def date_range(after: str | None = None, before: str | None = None) -> Column:
    """Half-open range of ``internal_date``; reaches the Parquet scan."""
    bounds = [F.lit(True)]
    if after:
        bounds.append(F.col("internal_date") >= F.to_timestamp(F.lit(after)))
    if before:
        bounds.append(F.col("internal_date") < F.to_timestamp(F.lit(before)))
    keep = bounds[0]
    for bound in bounds[1:]:
        keep = keep & bound
    return keep


def in_dates(messages: DataFrame, after: str | None = None, before: str | None = None) -> DataFrame:
    """Messages of a half-open range of dates; of landed ones, only the folders that hold its days or months are read."""
    chosen = messages.where(date_range(after, before))
    for period in PERIODS:
        if period in messages.columns:
            if after:
                last = F.date_add(F.col(period), F.col("span") - 1)  # a folder begins with its first day
                chosen = chosen.where(last >= period_of(F.to_timestamp(F.lit(after)), period))
            if before:  # the range may end within this period
                chosen = chosen.where(F.col(period) <= period_of(F.to_timestamp(F.lit(before)), period))
    return chosen


# Presets by name; a free SQL predicate goes to ``DataFrame.where`` directly.
PRESETS = {
    "received": received,
    "all_mail": all_mail,
    "inbox": inbox,
    "starred": starred,
    "unread": unread,
}


def row_cap(messages: DataFrame, max_messages: int) -> DataFrame:
    """The newest ``max_messages`` rows, ties by id; all rows if not positive.

    Only distinct (date, id) pairs and their numbers of rows are sorted, in as many tasks as
    there are ranges. Rows then join the pairs that fit as a whole; of the one pair that
    fits in part (an id that was landed repeatedly) as many rows as there is room for.
    """
    if max_messages <= 0:
        return messages
    pairs = messages.groupBy("internal_date", "id").agg(F.count("*").alias("rows"))
    placed = with_offsets(pairs, (F.col("internal_date").desc(), F.col("id")), "rows")
    fitting = placed.where(F.col("start") < max_messages).select(
        F.col("internal_date").alias("_date"),
        F.col("id").alias("_id"),
        F.least("rows", max_messages - F.col("start")).alias("_room"),
        (F.col("end") <= max_messages).alias("_whole"),
    )
    same = F.col("internal_date").eqNullSafe(F.col("_date")) & F.col("id").eqNullSafe(F.col("_id"))
    whole = messages.join(fitting.where("_whole"), same, "left_semi")
    # At most one pair is cut, so its rows are few unless one id makes up the whole cap.
    cut = messages.join(fitting.where("NOT _whole"), same)
    numbered = cut.withColumn("_n", F.row_number().over(W.partitionBy("_date", "_id").orderBy("_id")))
    return whole.unionByName(numbered.where("_n <= _room").select(*messages.columns))
