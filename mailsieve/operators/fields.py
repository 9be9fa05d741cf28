"""The 21 export fields and the projection that selects them.

Every field is a string and never null. Only the requested expressions enter the plan,
so header-only exports never touch bodies.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.functions.headers import email_domain, header, join_list, parse_email
from mailsieve.functions.parts import attachment_summary, body_html, body_text
from mailsieve.functions.redaction import redact_text
from mailsieve.functions.text import clean_text
from mailsieve.functions.whitespace import trim_ws
from mailsieve.operators.options import ExportOptions
from mailsieve.sources.messages import whole_parts


@dataclass(frozen=True)
class Field:
    name: str
    category: str
    default: bool
    value: Callable[[ExportOptions], Column]


def _header(name: str) -> Column:
    return header(F.col("headers"), name)


def _mailbox(column: str, part: str):
    return lambda o: F.col(column)[part]


def _raw(name: str):
    return lambda o: _header(name)


def _free_text(raw: Callable[[], Column]):
    def value(o: ExportOptions) -> Column:
        return redact_text(clean_text(raw(), o.text_mode), o.categories, o.sanitize)

    return value


def _flag(c: Column) -> Column:
    return F.when(c, "true").otherwise("false")


def _body_html(o: ExportOptions) -> Column:
    return redact_text(body_html(F.col("_parts"), o.body_max_chars, whole=True), o.categories, o.sanitize, pinned=True)


def _body_text(o: ExportOptions) -> Column:
    categories = o.categories if o.sanitize else None
    return body_text(F.col("_parts"), o.body_max_chars, categories, o.text_mode, whole=True)


# Intermediate columns, added only if a requested field reads them.
_SHARED = {
    "_from": lambda messages: parse_email(_header("From")),
    "_reply_to": lambda messages: parse_email(_header("Reply-To")),
    "_delivered_to": lambda messages: parse_email(_header("Delivered-To")),
    "_attachments": lambda messages: attachment_summary(F.col("parts")),
    "_parts": whole_parts,
}
_READS = {
    "from_email": "_from",
    "from_name": "_from",
    "sender_domain": "_from",
    "reply_to": "_reply_to",
    "reply_to_domain": "_reply_to",
    "delivered_to": "_delivered_to",
    "has_attachment": "_attachments",
    "attachment_types": "_attachments",
    "attachment_count": "_attachments",
    "body_text": "_parts",
    "body_html": "_parts",
}

# Names, groups, defaults and order of the fields.
FIELDS: tuple[Field, ...] = (
    Field("from_email", "sender", True, _mailbox("_from", "email")),
    Field("from_name", "sender", True, _mailbox("_from", "name")),
    Field(
        "sender_domain", "sender", True,
        lambda o: email_domain(F.col("_from")["email"]),
    ),
    Field("reply_to", "sender", False, _mailbox("_reply_to", "email")),
    Field(
        "reply_to_domain", "sender", True,
        lambda o: email_domain(F.col("_reply_to")["email"]),
    ),
    Field("delivered_to", "recipient", True, _mailbox("_delivered_to", "email")),
    Field("to", "recipient", False, _raw("To")),
    Field("cc", "recipient", False, _raw("Cc")),
    Field("bcc", "recipient", False, _raw("Bcc")),
    Field("subject", "content", True, _free_text(lambda: _header("Subject"))),
    Field(
        "snippet", "content", True,
        _free_text(lambda: F.coalesce(F.col("snippet"), F.lit(""))),
    ),
    Field("body_text", "content", False, _body_text),
    Field("body_html", "content", False, _body_html),
    Field("date", "metadata", False, _raw("Date")),
    Field("message_id", "metadata", False, _raw("Message-ID")),
    Field("thread_id", "metadata", False, lambda o: F.coalesce(F.col("thread_id"), F.lit(""))),
    Field("labels", "metadata", False, lambda o: join_list(F.col("label_ids"))),
    Field("has_attachment", "attachments", True, lambda o: _flag(F.col("_attachments")["has"])),
    Field(
        "attachment_types", "attachments", True,
        lambda o: join_list(F.col("_attachments")["types"]),
    ),
    Field(
        "attachment_count", "attachments", False,
        lambda o: F.col("_attachments")["count"].cast("string"),
    ),
    Field(
        "has_list_unsubscribe", "attachments", True,
        lambda o: _flag(trim_ws(_header("List-Unsubscribe")) != ""),
    ),
)
BY_NAME = {f.name: f for f in FIELDS}

# Named field sets.
FIELD_SETS: dict[str, tuple[str, ...]] = {
    "default": tuple(f.name for f in FIELDS if f.default),
    "minimal": ("from_email", "subject", "date"),
    "all": tuple(f.name for f in FIELDS),
    "quick": ("from_email", "subject", "date", "snippet"),
    "newsletter": ("from_email", "sender_domain", "subject", "has_list_unsubscribe", "date"),
    "attachment": ("from_email", "subject", "date", "has_attachment", "attachment_types", "attachment_count"),
    "archive": (
        "from_email", "from_name", "to", "cc", "subject", "date", "message_id", "thread_id",
        "labels", "body_text", "has_attachment", "attachment_types",
    ),
    "contact": ("from_email", "from_name", "reply_to", "to", "cc"),
}


def choose_fields(names: str | Sequence[str], fallback: Sequence[str] = FIELD_SETS["default"]) -> list[str]:
    """Known names in the given order; unknown ones are dropped, none leaves the fallback.

    A comma-separated string is accepted. A repeated name is an error: two columns of
    one name cannot be written.
    """
    listed = names.split(",") if isinstance(names, str) else list(names)
    known = [n.strip() for n in listed if n.strip() in BY_NAME] or list(fallback)
    repeated = sorted({n for n in known if known.count(n) > 1})
    if repeated:
        raise ValueError(f"fields listed twice: {repeated}")
    return known


def project_fields(
    messages: DataFrame, options: ExportOptions = ExportOptions(), keep: Sequence[str] = ()
) -> DataFrame:
    """The requested fields in the requested order, after the ``keep`` columns."""
    names = choose_fields(options.fields or FIELD_SETS["default"])
    needed = dict.fromkeys(_READS[n] for n in names if n in _READS)
    with_shared = messages.withColumns({c: _SHARED[c](messages) for c in needed}) if needed else messages
    values = [BY_NAME[n].value(options).alias(n) for n in names]
    return with_shared.select(*keep, *values)
