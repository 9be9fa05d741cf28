"""Header lookups and address parsing as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsieve.functions.once import once
from mailsieve.functions.whitespace import trim_ws

# Address shapes. ``$`` would also match before a final newline on the
# JVM, and its ``.`` excludes other line ends than the reference semantics do.
BRACKET_FORM = r"\A([^\n\r\x{2028}\x{2029}]*)<([^>]+)>\z"
ADDRESS_FORM = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"

# One contact of an address list: a quoted or plain display name with an address in
# angle brackets, or a bare address. Commas inside quotes do not separate contacts.
CONTACT_FORM = r'"[^"]*"[^,<]*<[^>]*>|[^,<"]*<[^>]*>|[^,<>"\s]+@[^,<>"\s]+'


def header(headers: Column, name: str) -> Column:
    """Value of the first header of that name, ignoring case; empty if absent."""
    same_name = F.filter(headers, lambda h: F.lower(h["name"]) == name.lower())
    return F.coalesce(F.try_element_at(same_name, F.lit(1))["value"], F.lit(""))


def parse_email(raw: Column) -> Column:
    """``struct(name, email)`` of a single mailbox header."""

    def scan(s: Column) -> Column:
        found = F.when(F.contains(s, F.lit("@")), F.lower(F.regexp_extract(s, ADDRESS_FORM, 0)))
        return F.struct(
            s.alias("s"),
            F.regexp_extract(s, BRACKET_FORM, 1).alias("display"),
            F.regexp_extract(s, BRACKET_FORM, 2).alias("inside"),
            found.otherwise("").alias("found"),
        )

    def choose(t: Column) -> Column:
        s, found = t["s"], t["found"]
        # The lower-cased address is removed once and literally: if the text spells it in
        # capitals, it stays part of the name.
        at = F.instr(s, found)
        cut = F.concat(F.left(s, at - 1), F.substr(s, at + F.length(found)))
        rest = F.translate(F.when(at > 0, cut).otherwise(s), '<>"', "")
        bracketed = (t["display"] != "") & (t["inside"] != "")
        display = F.replace(t["display"], F.lit('"'), F.lit(""))
        return F.struct(
            trim_ws(F.when(bracketed, display).when(found != "", rest).otherwise("")).alias("name"),
            F.when(bracketed, F.lower(trim_ws(t["inside"]))).otherwise(found).alias("email"),
        )

    return once(once(trim_ws(F.coalesce(raw, F.lit(""))), scan), choose)


def email_domain(email: Column) -> Column:
    """Everything after the first ``@``, lower-cased; empty without one."""
    return F.lower(F.regexp_extract(email, r"(?s)@(.*)", 1))


def contacts(address_list: Column) -> Column:
    """The single contacts of an address-list header."""
    return F.regexp_extract_all(address_list, F.lit(CONTACT_FORM), 0)


def join_list(values: Column) -> Column:
    """Semicolon-joined list; empty for a missing list."""
    return F.array_join(F.coalesce(values, F.array().cast("array<string>")), ";")
