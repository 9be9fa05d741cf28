"""The derived mailbox and its extraction functions in SQL, independent of the Spark side."""

from __future__ import annotations

from checks.probes import quote
from checks.sql_text import Chain, add_clean, add_html, add_redaction, trim_ws


def _name(n: str) -> str:
    return f"CASE WHEN k % 3 = 1 THEN '{n.upper()}' ELSE '{n}' END"


_HEADERS = {
    "From": """CASE WHEN k % 37 = 0 THEN 'Foo <not an address>'
        WHEN k % 41 = 1 THEN 'A <x> <User.' || u || '@Z.org>'
        WHEN k % 5 = 0 THEN '"User ' || u || '" <User.' || u || '@' || host || '>'
        WHEN k % 5 = 1 THEN lower('User.' || u || '@' || host)
        WHEN k % 5 = 2 THEN 'User.' || u || '@Example.com'
        WHEN k % 5 = 3 THEN '<u.' || u || '@example.org>' ELSE '' END""",
    "Reply-To": """CASE WHEN k % 4 = 0 THEN 'reply.' || u || '@' || lower(host)
        WHEN k % 4 = 1 THEN 'No Reply <No-Reply@notify.example.com>' END""",
    "Delivered-To": "'me+tag' || (k % 3) || '@example.com'",
    "To": """'"Doe, Jane ' || u || '" <Jane.' || u || '@example.com>, team' || (u % 5) || '@example.org'""",
    "Cc": "CASE WHEN k % 6 = 0 THEN 'cc.' || (u % 11) || '@example.net' END",
    "Bcc": "CASE WHEN k % 12 = 5 THEN 'hidden.' || (u % 3) || '@example.net' END",
    "Subject": """CASE WHEN k % 9 = 0 THEN format('Order #AB-{:06d} ', k)
        WHEN k % 9 = 4 THEN format('Re: ticket TCK-{:05d} ', k) ELSE '' END || text""",
    "Date": """CASE WHEN k % 53 = 0 THEN 'yesterday' ELSE
        CASE WHEN k % 2 = 0 THEN strftime(internal_date, '%a, ') ELSE '' END
        || strftime(internal_date, '%-d %b %Y %H:%M:%S')
        || CASE WHEN k % 3 = 0 THEN ' +0000' ELSE ' -0500' END
        || CASE WHEN k % 8 = 0 THEN ' (UTC)' ELSE '' END END""",
    "Message-ID": "'<' || (k - CASE WHEN k % 29 = 0 THEN 1 ELSE 0 END) || '@mail.example.com>'",
    "In-Reply-To": "CASE WHEN turn > 0 THEN '<' || (k - 1) || '@mail.example.com>' END",
    "List-Unsubscribe": """CASE WHEN k % 10 = 0 THEN '<mailto:unsub@' || lower(host) || '>'
        WHEN k % 10 = 1 THEN ' ' END""",
}
_header_list = [(n, v) for n, v in _HEADERS.items()]
_header_list.append(("From", "CASE WHEN k % 11 = 0 THEN 'Second <second@example.net>' END"))


def _b64(expr: str) -> str:
    return f"replace(replace(replace(to_base64(encode({expr})), '+', '-'), '/', '_'), '=', '')"


def _part(mime: str, name: str, att: str = "NULL", size: str = "NULL", data: str = "NULL") -> str:
    return (
        f"{{'mime_type': {mime}::VARCHAR, 'filename': {name}::VARCHAR, 'attachment_id': {att}::VARCHAR, "
        f"'size': {size}::BIGINT, 'data': {data}::VARCHAR}}"
    )


_PLAIN = _part("'text/plain'", "''", size="strlen(text)", data=_b64("text"))
_HTML = _part("CASE WHEN k % 3 = 1 THEN 'TEXT/HTML' ELSE 'text/html' END", "''", data=_b64("html"))
_FILES = [
    ("k % 4 = 0", _part("'application/pdf'", "'Report.PDF'", size="10")),
    ("k % 6 = 0", _part("'application/gzip'", "'archive.tar.gz'", "'att-1'", "0")),
    ("k % 12 = 0", _part("'Text/Plain'", "' README '", "'att-2'", data=_b64("'read me'"))),
    ("k % 14 = 0", _part("'image/png'", "'logo.png'")),
    ("k % 15 = 0", _part("'text/plain'", "''", "'att-3'", data=_b64("'attached text'"))),
    ("k % 16 = 0", _part("NULL", "'x.'", "'att-4'")),
    ("k % 20 = 0", _part("'application/pdf'", "'Second.pdf'", size="20")),
]


def _some(items: list[tuple[str, str]]) -> str:
    cases = ", ".join(f"CASE WHEN {cond} THEN {node} END" for cond, node in items)
    return f"list_filter([{cases}], lambda p: p IS NOT NULL)"


def _placed(nodes: str, prefix: str, first: int) -> str:
    fields = ", ".join(f"'{f}': p.{f}" for f in ("mime_type", "filename", "attachment_id", "size", "data"))
    path = f"'{prefix}.' || lpad((i - 1 + {first})::VARCHAR, 6, '0')"
    return f"list_transform({nodes}, lambda p, i: {{'path': {path}, {fields}}})"


def _one(node: str, path: str) -> str:
    return f"[{node.replace('{', '{' + quote('path') + ': ' + quote(path) + ', ', 1)}]"


_TREE = " || ".join(
    [
        _one(_part("'multipart/mixed'", "''", size="0"), ""),
        _one(_part("'multipart/alternative'", "''", size="0"), ".000000"),
        _placed(_some([("k % 5 <> 2", _PLAIN), ("html IS NOT NULL", _HTML)]), ".000000", 0),
        _placed(_some(_FILES), "", 1),
    ]
)
_pairs = ", ".join(f"{{'name': {_name(n)}, 'value': {v}}}" for n, v in _header_list)

MAIL = f"""turns AS (
  SELECT c.conv_id, c.turn, c.role, c.text, p.html, c.conv_id * 1000 + c.turn AS k,
         (c.conv_id * 31 + c.turn) % 997 AS u
  FROM conversations c LEFT JOIN pages p
    ON p.page_id = (c.conv_id * 31 + c.turn) % (SELECT count(*) FROM pages)),
hosts AS (
  SELECT *, 'Mail' || (u % 7) || '.Example.COM' AS host,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(k) AS internal_date FROM turns),
mail AS MATERIALIZED (
  SELECT 'm' || k AS id, internal_date,
    CASE WHEN k % 41 <> 0 THEN 't' || conv_id END AS thread_id,
    CASE WHEN k % 23 <> 0 THEN list_filter([
        CASE WHEN role = 'assistant' THEN 'SENT' ELSE 'INBOX' END,
        CASE WHEN k % 2 = 0 THEN 'UNREAD' END, CASE WHEN k % 7 = 0 THEN 'STARRED' END,
        CASE WHEN k % 13 = 0 THEN 'SPAM' END, CASE WHEN k % 17 = 0 THEN 'TRASH' END,
        CASE WHEN k % 5 = 0 THEN 'Label_' || (k % 3) END], lambda x: x IS NOT NULL) END AS label_ids,
    replace(text, '&', '&amp;') || CASE WHEN k % 3 = 0 THEN '&nbsp;' ELSE '' END AS snippet,
    list_filter([{_pairs}], lambda h: h.value IS NOT NULL) AS headers,
    CASE WHEN k % 19 = 0 THEN {_one(_PLAIN, '')} ELSE {_TREE} END AS parts
  FROM hosts)"""


def header(name: str) -> str:
    return f"coalesce(list_filter(headers, lambda h: lower(h.name) = '{name.lower()}')[1].value, '')"


def email_struct(raw: str) -> str:
    """CASE pieces over a trimmed value; ``{{'name': …, 'email': …}}``."""
    s = trim_ws(raw)
    form = r"\A([^\n\r\x{2028}\x{2029}]*)<([^>]+)>\z"
    display, inside = (f"regexp_extract({s}, {quote(form)}, {g})" for g in (1, 2))
    found = f"lower(regexp_extract({s}, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{{2,}}'))"
    at = f"instr({s}, {found})"
    without = f"CASE WHEN {at} > 0 THEN left({s}, ({at} - 1)::BIGINT) || substr({s}, {at} + length({found})) ELSE {s} END"
    plain_name = trim_ws(f"replace(replace(replace({without}, '<', ''), '>', ''), chr(34), '')")
    quoted_name = trim_ws(f"replace({display}, chr(34), '')")
    bracketed = f"{display} <> '' AND {inside} <> ''"
    return (
        f"{{'name': CASE WHEN {bracketed} THEN {quoted_name} WHEN {found} <> '' THEN {plain_name} ELSE '' END, "
        f"'email': CASE WHEN {bracketed} THEN lower({trim_ws(inside)}) ELSE {found} END}}"
    )


def email(raw: str) -> str:
    return f"({email_struct(raw)}).email"


def domain(e: str) -> str:
    return f"CASE WHEN instr({e}, '@') > 0 THEN lower(substr({e}, instr({e}, '@') + 1)) ELSE '' END"


_NAME = trim_ws("coalesce(p.filename, '')")
_ATT = f"list_filter(parts, lambda p: {_NAME} <> '' AND (coalesce(p.attachment_id, '') <> '' OR coalesce(p.size, 0) > 0))"
_EXT = f"regexp_extract(lower({_NAME}), '\\.([a-z0-9]{{1,10}})\\z', 1)"
_KINDS = (
    f"list_transform({_ATT}, lambda p: CASE WHEN {_EXT} <> '' THEN {_EXT} "
    "WHEN coalesce(p.mime_type, '') <> '' THEN lower(p.mime_type) ELSE 'unknown' END)"
)
ATTACHMENT_TYPES = f"list_sort(list_distinct({_KINDS}))"
ATTACHMENT_COUNT = f"len({_ATT})"
DECODED = "decode(from_base64(rpad(replace(replace(p.data, '-', '+'), '_', '/'), ((length(p.data) + 3) // 4 * 4)::INTEGER, '=')))"


def bodies(mime: str) -> str:
    keep = f"{_NAME} = '' AND coalesce(p.attachment_id, '') = '' AND coalesce(p.data, '') <> '' AND lower(p.mime_type) = '{mime}'"
    return f"array_to_string(list_transform(list_filter(parts, lambda p: {keep}), lambda p: {DECODED}), chr(10))"


def joined(values: str) -> str:
    return f"array_to_string(coalesce({values}, []::VARCHAR[]), ';')"


def flag(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 'true' ELSE 'false' END"


# Field expressions that need no chain of replacements.
SIMPLE_FIELDS = {
    "from_email": email(header("From")),
    "from_name": f"({email_struct(header('From'))}).name",
    "sender_domain": domain(email(header("From"))),
    "reply_to": email(header("Reply-To")),
    "reply_to_domain": domain(email(header("Reply-To"))),
    "delivered_to": email(header("Delivered-To")),
    "to": header("To"),
    "cc": header("Cc"),
    "bcc": header("Bcc"),
    "date": header("Date"),
    "message_id": header("Message-ID"),
    "thread_id": "coalesce(thread_id, '')",
    "labels": joined("label_ids"),
    "has_attachment": flag(f"{ATTACHMENT_COUNT} > 0"),
    "attachment_types": joined(ATTACHMENT_TYPES),
    "attachment_count": f"({ATTACHMENT_COUNT})::VARCHAR",
    "has_list_unsubscribe": flag(f"{trim_ws(header('List-Unsubscribe'))} <> ''"),
    "body_html": trim_ws(bodies("text/html")),
}


def simple(name: str) -> str:
    return f'{SIMPLE_FIELDS[name]} AS "{name}"'


def mail_select(select: str, rest: str = "") -> str:
    return f"WITH {MAIL} SELECT {select} FROM mail {rest}"


def _text_chain(name: str, source: str, categories, limit: int = 0, html: bool = False) -> Chain:
    if html:
        chain = Chain("mail", f"id, {trim_ws(bodies('text/plain'))} AS plain, {trim_ws(bodies('text/html'))} AS t", name)
        add_html(chain).set("CASE WHEN plain = '' THEN t ELSE plain END", plain="''")
    else:
        chain = Chain("mail", f"id, {source} AS t", name)
    add_clean(chain)
    if limit:
        chain.set(f"left(t, {limit})")
    if categories:
        add_redaction(chain, categories, counts=False)
    return chain


def text_field(name: str, categories=(), limit: int = 0, prefix: str = "c") -> Chain:
    """The chain for subject, snippet, body_text or (redacted) body_html."""
    if name == "subject":
        return _text_chain(prefix, header("Subject"), categories)
    if name == "snippet":
        return _text_chain(prefix, "coalesce(snippet, '')", categories)
    if name == "body_text":
        return _text_chain(prefix, "", categories, limit, html=True)
    chain = Chain("mail", f"id, {trim_ws(bodies('text/html'))} AS t", prefix)
    if limit:
        chain.set(f"left(t, {limit})")
    return add_redaction(chain, categories, counts=False) if categories else chain


TEXT_FIELDS = ("subject", "snippet", "body_text")


def fields_sql(names, where: str = "true", categories=(), limit: int = 0, keep: str = "mail.id") -> str:
    """Any list of fields over the selected messages."""
    chained = [n for n in names if n in TEXT_FIELDS or (n == "body_html" and (categories or limit))]
    chains = {n: text_field(n, categories, limit, f"{n}_") for n in chained}
    ctes = [MAIL] + [c for chain in chains.values() for c in chain.ctes]
    columns = [f'{chains[n].last}.t AS "{n}"' if n in chains else simple(n) for n in names]
    joins = " ".join(f"JOIN {c.last} ON {c.last}.id = mail.id" for c in chains.values())
    return f"WITH {', '.join(ctes)} SELECT {', '.join([keep, *columns] if keep else columns)} FROM mail {joins} WHERE {where}"


LABELS = "coalesce(label_ids, []::VARCHAR[])"


def any_label(*labels: str) -> str:
    return f"list_has_any({LABELS}, [{', '.join(map(quote, labels))}])"


RECEIVED = f"NOT {any_label('SENT', 'SPAM', 'TRASH')}"
