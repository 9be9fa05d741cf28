"""Every operator as a query on the given tables, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsieve.functions import csv_lines, headers, parts, redaction, text
from mailsieve.functions.address_rules import named_address_patterns
from mailsieve.functions.redaction_rules import ALL_CATEGORIES, CATEGORIES, DEFAULT_CATEGORIES, rules_for
from mailsieve.functions.whitespace import WS, spell_out
from mailsieve.operators import analyses as an
from mailsieve.operators import predicates as pr
from mailsieve.operators.fields import FIELD_SETS, project_fields
from mailsieve.operators.options import ExportOptions
from mailsieve.operators.rollover import assign_parts
from mailsieve.operators.search_index import build_index, indexed_search
from mailsieve.plans.export import export_rows, export_totals, select_messages
from mailsieve.plans.mailbox import dump
from mailsieve.sources.csv_files import close_rolled, read_csv, roll_batch, write_csv, write_rolled_csv
from mailsieve.sources import files
from mailsieve.sources.messages import (
    ingest,
    land_messages,
    quarantine,
    read_landed,
    read_messages,
    with_parts,
)
from mailsieve.sources.session import work_path
from mailsieve.sources.tables import spread, table
from mailsieve.streaming import runs
from mailsieve.streaming.dedupe import dedupe_batch, read_deduped

from checks import sql_mail as m
from checks.probes import ADDRESS_PROBES, PROBES, quote, spark_probe, sql_probe
from checks.sql_text import (
    Chain,
    add_clean,
    add_decode_entities,
    add_html,
    add_links,
    add_redaction,
    collapse_ws,
    count_all,
    replace_all,
    zero_counts,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", *columns))


def raw_mailbox(spark: SparkSession, folder: str) -> DataFrame:
    return with_parts(dump(spark, folder))


_landed_at: dict[tuple[str, str], str] = {}


def mailbox(spark: SparkSession, folder: str) -> DataFrame:
    """The landed mailbox; a session lands a folder once."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _landed_at:
        path = work_path(spark, "mailbox")
        land_messages(dump(spark, folder).drop("headers"), path)
        _landed_at[key] = path
    return read_landed(spark, _landed_at[key])


# --- redaction ----------------------------------------------------------------------
def _probed(spark, folder, template):
    probe = F.concat(spark_probe(template), F.lit("\n"), F.col("text"))
    return documents(spark, folder, "text").select("doc_id", probe.alias("text"))


def _redact_query(template, categories):
    def query(spark, folder):
        rows = _probed(spark, folder, template) if template else documents(spark, folder, "text")
        return rows.select("doc_id", redaction.redact(F.col("text"), categories).alias("r")).select(
            "doc_id", F.col("r.n").alias("n"), F.col("r.text").alias("text")
        )

    return query


def _probed_text(template: str) -> str:
    return f"{sql_probe(template)} || chr(10) || text" if template else "text"


def _redact_sql(template, categories):
    chain = Chain("documents", f"doc_id, {_probed_text(template)} AS t, {zero_counts(categories)}")
    total = " + ".join(f"n_{c}" for c in categories)
    return add_redaction(chain, categories).sql(f"SELECT doc_id, ({total})::INTEGER AS n, t AS text FROM {{last}}")


_MIXED = "\n".join(PROBES.values())
register("redact_default", _redact_query(_MIXED, DEFAULT_CATEGORIES), _redact_sql(_MIXED, DEFAULT_CATEGORIES))
register("redact_all", _redact_query(_MIXED, ALL_CATEGORIES), _redact_sql(_MIXED, ALL_CATEGORIES))
register("redact_documents", _redact_query("", DEFAULT_CATEGORIES), _redact_sql("", DEFAULT_CATEGORIES))
for _c in ALL_CATEGORIES:
    register(f"redact_{_c}", _redact_query(PROBES[_c], (_c,)), _redact_sql(PROBES[_c], (_c,)))


def _redaction_counts(spark, folder):
    rows = documents(spark, folder, "text")
    return rows.select(
        "doc_id", F.explode(redaction.redact(F.col("text"), ALL_CATEGORIES)["by_category"]).alias("category", "n")
    )


_counted = add_redaction(Chain("documents", f"doc_id, text AS t, {zero_counts(ALL_CATEGORIES)}"), ALL_CATEGORIES)
_pairs = ", ".join(f"{{'category': '{c}', 'n': n_{c}}}" for c in ALL_CATEGORIES)
register(
    "redaction_counts",
    _redaction_counts,
    _counted.sql(
        f"SELECT doc_id, e.category, e.n::INTEGER AS n FROM (SELECT doc_id, unnest([{_pairs}]) AS e FROM {{last}} "
        "JOIN documents d USING (doc_id) WHERE d.text <> '')"
    ),
)


def _report_sql(categories):
    chain = Chain("documents", f"doc_id, text AS t, {zero_counts(categories)}")
    names = {c.key: c.name for c in CATEGORIES}
    enabled = [r.category for r in rules_for(categories)]
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS category, sum(n_{c})::BIGINT AS matches, count(*) FILTER (n_{c} > 0) AS texts, "
        f"{quote(names[c])} AS category_name FROM {{last}}"
        for c in enabled
    )
    return add_redaction(chain, categories).sql(rows)


register(
    "redaction_report",
    lambda s, f: redaction.redaction_report(documents(s, f, "text"), "text", ALL_CATEGORIES),
    _report_sql(ALL_CATEGORIES),
)
_SLICE = ("credit_cards", "phone_numbers", "ip_addresses", "email_addresses")
register(
    "redaction_report_four",
    lambda s, f: redaction.redaction_report(documents(s, f, "text"), "text", _SLICE),
    _report_sql(_SLICE),
)


def _redact_columns(spark, folder):
    rows = spread(table(spark, folder, "conversations"))
    return redaction.redact_columns(rows, ["text", "role"], ALL_CATEGORIES)


_two = Chain("conversations", "conv_id, turn, role AS r, text AS t, 0 AS zero", "a")
add_redaction(_two, ALL_CATEGORIES, counts=False)
_roles = Chain(_two.last, "conv_id, turn, t AS text, r AS t", "b")
add_redaction(_roles, ALL_CATEGORIES, counts=False)
register(
    "redact_columns",
    _redact_columns,
    f"WITH {', '.join(_two.ctes + _roles.ctes)} SELECT conv_id, turn, text, t AS role FROM {_roles.last}",
)


def _address_query(template, patterns=None):
    def query(spark, folder):
        r = redaction.redact_addresses(F.col("text"), patterns)
        return _probed(spark, folder, template).select("doc_id", r.alias("r")).select("doc_id", "r.n", "r.text")

    return query


def _address_sql(template, patterns):
    chain = Chain("documents", f"doc_id, {_probed_text(template)} AS t, 0::BIGINT AS n")
    token = "[REDACTED_ADDRESS]"
    for p in map(spell_out, patterns):
        chain.set(replace_all("t", p, token), n=f"n + {count_all('t', p)}")
    chain.set(replace_all("t", rf"(\[REDACTED_ADDRESS\]{WS}*)+", token + " "))
    return chain.sql("SELECT doc_id, n::INTEGER AS n, t AS text FROM {last}")


_ADDRESS_RULES = named_address_patterns()
_ALL_ADDRESSES = "\n".join(ADDRESS_PROBES.values())
register(
    "redact_addresses", _address_query(_ALL_ADDRESSES), _address_sql(_ALL_ADDRESSES, _ADDRESS_RULES.values())
)
for _n, _p in _ADDRESS_RULES.items():
    register(f"addr_{_n}", _address_query(ADDRESS_PROBES[_n], [_p]), _address_sql(ADDRESS_PROBES[_n], [_p]))


# --- text ---------------------------------------------------------------------------
# Markup, entities and links around the numbers of a row.
_MESSY = (
    "p{color:red} Note: buy {d2}; Tom &amp; Jerry&copy;&Eacute;&amp;lt; x&foo;y &#x20AC;&#{d3};&#65;&#x200B;"
    "&#x110000; &shy;&zwnj;a" + chr(0x200B) + "b" + chr(0xA0) + chr(0x2003) + "c\t\td \n \n \n e "
    "&AMP;#66; &ZeroWidthSpace;&nbsp;&hellip; q"
    '<a class="k" href="https://x.io/{d2}">Go <b>{d1}</b></a> <A HREF=\'/q\'></A> <a>t</a> <a href=/z/{d1}>/z/{d1} ok</a>'
    '<a href="https://x.io/?a=1&amp;b={d1}">Q</a> <li>x</li><div>y</div><br/>z<p>w</p> @media x { a {b:c} } /* c */'
    ' width=""1"" <td width="3">u</td> <!-- n --> <svg><a>no</a></svg> <a href="/open">never closed'
)


def _pages(spark, folder):
    return spread(table(spark, folder, "pages").select("page_id", "html"))


def _page_text(spark, folder, fn):
    body = F.concat(spark_probe(_MESSY, "page_id"), F.lit("\n"), F.col("html"))
    return _pages(spark, folder).select("page_id", fn(body).alias("text"))


def _page_chain() -> Chain:
    return Chain("pages", f"page_id, {sql_probe(_MESSY, 'page_id')} || chr(10) || html AS t")


_PAGE_ROWS = "SELECT page_id, t AS text FROM {last}"
for _n, _fn, _add in (
    ("decode_entities", text.decode_entities, add_decode_entities),
    ("clean_text", text.clean_text, add_clean),
    ("html_to_text", text.html_to_text, add_html),
    ("link_text", text.link_text, add_links),
):
    register(_n, lambda s, f, fn=_fn: _page_text(s, f, fn), _add(_page_chain()).sql(_PAGE_ROWS))
register(
    "html_clean_redact",
    lambda s, f: _page_text(s, f, lambda c: redaction.redact_text(text.clean_text(text.html_to_text(c)))),
    add_redaction(add_clean(add_html(_page_chain())), DEFAULT_CATEGORIES, counts=False).sql(_PAGE_ROWS),
)
register(
    "clean_documents",
    lambda s, f: documents(s, f, "text").select("doc_id", text.clean_text(F.col("text")).alias("text")),
    add_clean(Chain("documents", "doc_id, text AS t")).sql("SELECT doc_id, t AS text FROM {last}"),
)

# --- messages: scan, tree, functions ---------------------------------------------------
_HEAD_SQL = f"id, epoch(internal_date)::BIGINT AS received_at, coalesce(thread_id, '') AS thread_id, {m.joined('label_ids')} AS labels, len(headers)::INTEGER AS headers, len(parts)::INTEGER AS parts"


def _head(messages: DataFrame) -> DataFrame:
    return messages.select(
        "id",
        F.unix_timestamp("internal_date").alias("received_at"),
        F.coalesce("thread_id", F.lit("")).alias("thread_id"),
        headers.join_list(F.col("label_ids")).alias("labels"),
        F.size("headers").alias("headers"),
        F.size("parts").alias("parts"),
    )


def _scan_messages(spark, folder):
    path = work_path(spark, "dump")
    dump(spark, folder).drop("headers").write.json(path)
    return _head(read_messages(spark, path, "json"))


register("scan_messages", _scan_messages, m.mail_select(_HEAD_SQL))
register("stream_messages", lambda s, f: runs.arrived(_head, dump(s, f).drop("headers")), m.mail_select(_HEAD_SQL))


def _flatten_parts(spark, folder):
    rows = raw_mailbox(spark, folder)
    return rows.select("id", F.posexplode("parts").alias("position", "p")).select("id", "position", "p.*")


register(
    "flatten_parts",
    _flatten_parts,
    f"WITH {m.MAIL} SELECT id, (i - 1)::INTEGER AS position, parts[i].path AS path, parts[i].mime_type AS mime_type, "
    "parts[i].filename AS filename, parts[i].attachment_id AS attachment_id, parts[i].size AS size, "
    "parts[i].data AS data FROM (SELECT id, parts, unnest(range(1, len(parts) + 1)) AS i FROM mail)",
)


def on_mail(**columns):
    """A query of ``id`` and named columns over the mailbox."""
    return lambda s, f: mailbox(s, f).select("id", *[make().alias(n) for n, make in columns.items()])


def h(name: str):
    return headers.header(F.col("headers"), name)


register(
    "header_lookup",
    on_mail(sender=lambda: h("from"), message_id=lambda: h("MESSAGE-id"), none=lambda: h("X-None")),
    m.mail_select(f"id, {m.header('From')} AS sender, {m.header('Message-ID')} AS message_id, '' AS none"),
)
_LISTED = ("From", "Reply-To", "Delivered-To", "To")


def _parse_email(spark, folder):
    pick = {n: headers.parse_email(h(n)) for n in _LISTED}
    rows = mailbox(spark, folder).select("id", *[c.alias(f"h{i}") for i, c in enumerate(pick.values())])
    names = [F.col(f"h{i}")["name"].alias(f"name{i}") for i in range(4)]
    return rows.select("id", *names, *[F.col(f"h{i}")["email"].alias(f"email{i}") for i in range(4)])


_parsed = ", ".join(f"{m.email_struct(m.header(n))} AS h{i}" for i, n in enumerate(_LISTED))
_split_up = ", ".join(f"h{i}.name AS name{i}, h{i}.email AS email{i}" for i in range(4))
register(
    "parse_email", _parse_email, f"WITH {m.MAIL} SELECT id, {_split_up} FROM (SELECT id, {_parsed} FROM mail)"
)
register(
    "email_domain",
    on_mail(
        domain=lambda: headers.email_domain(headers.parse_email(h("From"))["email"]),
        of_raw=lambda: headers.email_domain(h("To")),
    ),
    m.mail_select(f"id, {m.domain(m.email(m.header('From')))} AS domain, {m.domain(m.header('To'))} AS of_raw"),
)
register(
    "attachment_summary",
    lambda s, f: mailbox(s, f).select("id", parts.attachment_summary(F.col("parts")).alias("a")).select(
        "id", "a.has", headers.join_list(F.col("a.types")).alias("types"), "a.count"
    ),
    m.mail_select(
        f"id, {m.ATTACHMENT_COUNT} > 0 AS has, {m.joined(m.ATTACHMENT_TYPES)} AS types, "
        f"({m.ATTACHMENT_COUNT})::INTEGER AS count"
    ),
)
register(
    "decode_bodies",
    lambda s, f: raw_mailbox(s, f)
    .select("id", F.explode("parts").alias("p"))
    .where("p.data is not null")
    .select("id", "p.path", parts.decode_body(F.col("p.data")).alias("body")),
    f"WITH {m.MAIL} SELECT id, p.path AS path, {m.DECODED} AS body FROM "
    "(SELECT id, unnest(parts) AS p FROM mail) WHERE p.data IS NOT NULL",
)
register(
    "join_list",
    on_mail(labels=lambda: headers.join_list(F.col("label_ids"))),
    m.mail_select(f"id, {m.joined('label_ids')} AS labels"),
)
register(
    "truncate_chars",
    lambda s, f: documents(s, f, "text").select(
        "doc_id", *[parts.truncate_chars(F.col("text"), n).alias(f"first_{n}") for n in (2000, 8000, 50000, 0)]
    ),
    "SELECT doc_id, left(text, 2000) AS first_2000, left(text, 8000) AS first_8000, "
    "left(text, 50000) AS first_50000, text AS first_0 FROM documents",
)
register(
    "body_text",
    lambda s, f: raw_mailbox(s, f).select("id", parts.body_text(F.col("parts")).alias("body_text")),
    m.text_field("body_text").sql("SELECT id, t AS body_text FROM {last}", m.MAIL),
)
register(
    "body_html",
    lambda s, f: raw_mailbox(s, f).select("id", parts.body_html(F.col("parts")).alias("body_html")),
    m.mail_select(f"id, {m.simple('body_html')}"),
)

# --- fields and projection --------------------------------------------------------------
_WHOLE = {"body_max_chars": 0}


def _field_query(*names, **options):
    return lambda s, f: project_fields(mailbox(s, f), ExportOptions(fields=names, **options), ("id",))


for _n in FIELD_SETS["all"]:
    if _n in m.SIMPLE_FIELDS:
        _sql = m.mail_select(f"id, {m.simple(_n)}")
    else:
        _sql = m.text_field(_n, DEFAULT_CATEGORIES).sql(f"SELECT id, t AS {_n} FROM {{last}}", m.MAIL)
    _sanitize = _n not in m.SIMPLE_FIELDS
    register(f"field_{_n}", _field_query(_n, sanitize=_sanitize, **_WHOLE), _sql)
for _set in ("default", "minimal", "all", "contact", "archive"):
    register(
        f"project_{_set}",
        _field_query(*FIELD_SETS[_set], **_WHOLE),
        m.fields_sql(FIELD_SETS[_set]),
    )
register(
    "project_all_redacted",
    _field_query(*FIELD_SETS["all"], sanitize=True),
    m.fields_sql(FIELD_SETS["all"], categories=DEFAULT_CATEGORIES, limit=8000),
)
register(
    "stream_export",
    lambda s, f: runs.arrived(
        lambda rows: runs.export_stream(rows, ExportOptions(sanitize=True)), dump(s, f).drop("headers")
    ),
    m.fields_sql(FIELD_SETS["default"], categories=DEFAULT_CATEGORIES),
)
register(
    "stream_dedupe",
    lambda s, f: runs.arrived(
        lambda rows: runs.dedupe_stream(rows).select("message_id"), dump(s, f).drop("headers")
    ),
    m.mail_select(f"DISTINCT {m.header('Message-ID')} AS message_id"),
)



def _landed(spark, folder):
    path = work_path(spark, "landed")
    land_messages(dump(spark, folder), path)
    return project_fields(read_landed(spark, path), ExportOptions(fields=FIELD_SETS["contact"]), ("id",))


def _quarantined(spark, folder):
    broken = F.when(F.endswith("id", F.lit("7")), F.lit("{broken")).otherwise(F.col("payload"))
    return quarantine(dump(spark, folder).withColumn("payload", broken))


def _ingested(spark, folder):
    """The mailbox landed batch by batch; the last batch runs a second time, as after a failure."""
    source, path, progress = (work_path(spark, n) for n in ("arriving", "ingested", "progress"))
    dump(spark, folder).drop("headers").repartition(3, "id").write.json(source)
    ingest(spark, source, path, progress, files_per_batch=1)
    last = max(int(n) for n in files.names(spark, f"{progress}/commits") if n.isdigit())
    files.remove(spark, f"{progress}/commits/{last}")
    ingest(spark, source, path, progress, files_per_batch=1)
    return project_fields(read_landed(spark, path), ExportOptions(fields=FIELD_SETS["attachment"]), ("id",))


register("land_messages", _landed, m.fields_sql(FIELD_SETS["contact"]))
register("ingest_messages", _ingested, m.fields_sql(FIELD_SETS["attachment"]))
register("quarantine", _quarantined, m.mail_select("id, 'bad payload' AS reason", "WHERE id LIKE '%7'"))

# --- selection ---------------------------------------------------------------------------
def _filter(predicate):
    return lambda s, f: mailbox(s, f).where(predicate()).select("id")


def _contains(expr: str, phrase: str) -> str:
    return f"contains(lower({expr}), {quote(phrase.lower())})"


_FILTERS = {
    "received": (pr.received, m.RECEIVED),
    "all_mail": (pr.all_mail, f"NOT {m.any_label('SPAM', 'TRASH')}"),
    "inbox": (pr.inbox, m.any_label("INBOX")),
    "starred": (pr.starred, m.any_label("STARRED")),
    "unread": (pr.unread, m.any_label("UNREAD")),
    "from_contains": (lambda: pr.from_contains("@MAIL3."), _contains(m.header("From"), "@MAIL3.")),
    "has_attachment": (pr.has_attachment, f"{m.ATTACHMENT_COUNT} > 0"),
    "date_range": (
        lambda: pr.date_range("2024-01-10", "2024-02-20"),
        "internal_date >= TIMESTAMP '2024-01-10' AND internal_date < TIMESTAMP '2024-02-20'",
    ),
    "has_label": (lambda: pr.has_label("Label_1"), m.any_label("Label_1")),
    "subject_contains": (lambda: pr.subject_contains("order #"), _contains(m.header("Subject"), "order #")),
    "conjunction": (
        lambda: pr.inbox() & pr.unread() & ~pr.starred() & ~pr.from_contains("example.com"),
        f"{m.any_label('INBOX')} AND {m.any_label('UNREAD')} AND NOT {m.any_label('STARRED')} "
        f"AND NOT {_contains(m.header('From'), 'example.com')}",
    ),
}
for _n, (_predicate, _where) in _FILTERS.items():
    register(f"filter_{_n}", _filter(_predicate), m.mail_select("id", f"WHERE {_where}"))
register(
    "filter_days",  # the same range on the landed mailbox, whose other days are not read
    lambda s, f: pr.in_dates(mailbox(s, f), "2024-01-10", "2024-02-20").select("id"),
    m.mail_select("id", f"WHERE {_FILTERS['date_range'][1]}"),
)
register(
    "filter_expression",
    lambda s, f: project_fields(
        mailbox(s, f), ExportOptions(fields=("sender_domain", "attachment_count", "labels")), ("id",)
    )
    .where("sender_domain LIKE 'mail%' AND cast(attachment_count AS int) >= 2 AND NOT labels LIKE '%SPAM%'"),
    f"SELECT * FROM ({m.fields_sql(['sender_domain', 'attachment_count', 'labels'])}) "
    "WHERE sender_domain LIKE 'mail%' AND attachment_count::INT >= 2 AND NOT labels LIKE '%SPAM%'",
)
register(
    "filter_phrase",
    lambda s, f: pr.phrase_search(mailbox(s, f), "ver die").select("id"),
    m.text_field("body_text").sql(
        f"SELECT mail.id FROM mail JOIN {{last}} b ON b.id = mail.id "
        f"WHERE {_contains(m.header('Subject'), 'ver die')} OR {_contains('b.t', 'ver die')}",
        m.MAIL,
    ),
)
register(
    "row_cap",
    lambda s, f: select_messages(mailbox(s, f), ExportOptions(max_messages=100)).select("id"),
    m.mail_select("id", f"WHERE {m.RECEIVED} ORDER BY internal_date DESC, id LIMIT 100"),
)

# --- CSV ---------------------------------------------------------------------------------
_COLUMNS = ("lang", "text")


def _escape(expr: str) -> str:
    v = collapse_ws(expr)
    return (
        f"CASE WHEN regexp_matches({v}, '[\",]') THEN chr(34) || replace({v}, chr(34), chr(34) || chr(34)) "
        f"|| chr(34) ELSE {v} END"
    )


_LINES = f"lines AS MATERIALIZED (SELECT doc_id, {_escape('lang')} || ',' || {_escape('text')} AS line FROM documents)"
_SIZES = f"{_LINES}, sizes AS MATERIALIZED (SELECT *, strlen(line) + 1 AS bytes, row_number() OVER (ORDER BY doc_id) AS r FROM lines)"
register(
    "csv_escape",
    lambda s, f: documents(s, f, *_COLUMNS).select("doc_id", csv_lines.csv_line(_COLUMNS).alias("line")),
    f"WITH {_LINES} SELECT doc_id, line FROM lines",
)
register(
    "csv_line_bytes",
    lambda s, f: documents(s, f, *_COLUMNS).select(
        "doc_id", csv_lines.csv_line_bytes(csv_lines.csv_line(_COLUMNS)).alias("bytes")
    ),
    f"WITH {_SIZES} SELECT doc_id, bytes FROM sizes",
)


def _write_csv(spark, folder):
    path = work_path(spark, "csv")
    rows = export_rows(mailbox(spark, folder), ExportOptions(fields=FIELD_SETS["all"], **_WHOLE))
    write_csv(rows, path)
    return read_csv(spark, path, rows.columns)


def _flat(name: str) -> str:
    return f'{collapse_ws(chr(34) + name + chr(34))} AS "{name}"'


register(
    "write_csv",
    _write_csv,
    f"SELECT {', '.join(map(_flat, FIELD_SETS['all']))} FROM "
    f"({m.fields_sql(FIELD_SETS['all'], where=m.RECEIVED, keep='')})",
)
_HEADER_BYTES = len(csv_lines.header_line(_COLUMNS)) + 1
_CAPS = {"": 200_000, "_small": 10_000, "_off": 0}


def _rollover(cap):
    def query(spark, folder):
        size = csv_lines.csv_line_bytes(csv_lines.csv_line(_COLUMNS))
        rows = documents(spark, folder, *_COLUMNS).select("doc_id", size.alias("size"))
        return assign_parts(rows, ["doc_id"], "size", cap, _HEADER_BYTES).select("doc_id", "part")

    return query


def _next_fit(cap: int) -> str:
    """One row after the other, as a single writer sees them."""
    if cap <= 0:
        return f"{_SIZES}, placed AS (SELECT doc_id, bytes, 1::BIGINT AS part FROM sizes)"
    full = f"p.filled + s.bytes > {cap}"
    first = f"{_HEADER_BYTES} + bytes > {cap}"
    return f"""{_SIZES}, placed AS (
      SELECT r, doc_id, bytes, (CASE WHEN {first} THEN 2 ELSE 1 END)::BIGINT AS part,
             ({_HEADER_BYTES} + bytes)::BIGINT AS filled FROM sizes WHERE r = 1
      UNION ALL
      SELECT s.r, s.doc_id, s.bytes, (p.part + CASE WHEN {full} THEN 1 ELSE 0 END)::BIGINT,
             (s.bytes + CASE WHEN {full} THEN {_HEADER_BYTES} ELSE p.filled END)::BIGINT
      FROM placed p JOIN sizes s ON s.r = p.r + 1)"""


register(
    "rollover_blocks",  # many blocks, whatever the size of the input
    lambda s, f: assign_parts(
        documents(s, f, *_COLUMNS).select(
            "doc_id", csv_lines.csv_line_bytes(csv_lines.csv_line(_COLUMNS)).alias("size")
        ),
        ["doc_id"], "size", 10_000, _HEADER_BYTES, 40_000,
    ).select("doc_id", "part"),
    f"WITH RECURSIVE {_next_fit(10_000)} SELECT doc_id, part FROM placed",
)
for _suffix, _cap in _CAPS.items():
    register(
        f"rollover{_suffix}", _rollover(_cap), f"WITH RECURSIVE {_next_fit(_cap)} SELECT doc_id, part FROM placed"
    )


def _rolled_files(spark, folder):
    """The lines of the written files, with the file that holds each."""
    path = work_path(spark, "rolled")
    rows = documents(spark, folder, *_COLUMNS)
    write_rolled_csv(rows, path, "docs", _COLUMNS, "doc_id", ["doc_id"], 200_000)
    return _lines_of(spark, path)


def _lines_of(spark, path):
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))


def _rolled_batches(spark, folder):
    """The same files from three batches, one of which runs twice."""
    path, state = work_path(spark, "rolled"), work_path(spark, "open")
    rows = documents(spark, folder, *_COLUMNS)
    third = rows.agg(F.max("doc_id")).first()[0] // 3 + 1
    for batch in (0, 1, 1, 2):
        own = rows.where(F.expr(f"doc_id div {third} = {batch}"))
        roll_batch(own, path, "docs", _COLUMNS, "doc_id", ["doc_id"], 200_000, state, batch)
    close_rolled(spark, path, "docs", _COLUMNS, state)
    return _lines_of(spark, path)


def _export_stats(spark, folder):
    path = work_path(spark, "rolled")
    rows = documents(spark, folder, *_COLUMNS)
    return write_rolled_csv(rows, path, "docs", _COLUMNS, "doc_id", ["doc_id"], 200_000)


_FILE = "'docs' || CASE WHEN part > 1 THEN '_part' || lpad(part::VARCHAR, 3, '0') ELSE '' END || '.csv'"
_ROLLED_SQL = (
    f"WITH RECURSIVE {_next_fit(200_000)}, files AS (SELECT unnest(range(1, (SELECT max(part) FROM placed) + 1)) AS part) "
    f"SELECT {_FILE} AS file, line FROM placed JOIN lines USING (doc_id) "
    f"UNION ALL SELECT {_FILE}, 'lang,text' FROM files"
)
register("write_rolled_csv", _rolled_files, _ROLLED_SQL)
register("roll_batches", _rolled_batches, _ROLLED_SQL)
_STATS_SQL = (
    f"WITH RECURSIVE {_next_fit(200_000)}, files AS (SELECT unnest(range(1, (SELECT max(part) FROM placed) + 1)) AS part) "
    f"SELECT part, {_FILE} AS file, count(bytes) AS rows, (coalesce(sum(bytes), 0) + {_HEADER_BYTES})::BIGINT AS bytes "
    "FROM files LEFT JOIN placed USING (part) GROUP BY part"
)
register("export_stats", _export_stats, _STATS_SQL)
register(
    "export_totals",
    lambda s, f: export_totals(_export_stats(s, f)),
    f"SELECT sum(rows)::BIGINT AS rows, sum(bytes)::BIGINT AS bytes, count(*) AS files FROM ({_STATS_SQL})",
)

# --- analyses -----------------------------------------------------------------------------
def _analysis(fn, *args):
    return lambda s, f: fn(mailbox(s, f), *args)


def _over(fields, select: str, rest: str = "", keep: str = "mail.id, mail.internal_date") -> str:
    return f"SELECT {select} FROM ({m.fields_sql(fields, keep=keep)}) {rest}"


register(
    "unique_senders",
    _analysis(an.unique_senders),
    _over(["from_email"], "DISTINCT from_email", "WHERE from_email <> ''"),
)
register(
    "unique_sender_count",
    _analysis(an.sender_count_check),
    _over(
        ["from_email"], "count(DISTINCT from_email) AS senders, true AS estimate_is_near", "WHERE from_email <> ''"
    ),
)
register(
    "mail_by_sender",
    _analysis(an.mail_by_sender),
    _over(["from_email"], "from_email, count(*) AS messages", "GROUP BY from_email"),
)
_contact = quote(headers.CONTACT_FORM)
_lists = " || ".join(
    f"regexp_extract_all({m.header(n)}, {_contact})" for n in ("From", "Reply-To", "To", "Cc")
)
register(
    "contact_list",
    _analysis(an.contact_list),
    f"WITH {m.MAIL}, entries AS (SELECT unnest({_lists}) AS e FROM mail), "
    f"people AS (SELECT {m.email_struct('e')} AS p FROM entries), "
    "uses AS (SELECT p.email AS email, p.name AS name, count(*) AS uses FROM people WHERE p.email <> '' GROUP BY ALL) "
    "SELECT email, name, total::BIGINT AS uses FROM (SELECT *, sum(uses) OVER (PARTITION BY email) AS total, "
    "row_number() OVER (PARTITION BY email ORDER BY (name <> '') DESC, uses DESC, name DESC) AS place FROM uses) "
    "WHERE place = 1",
)
register(
    "mail_by_domain",
    _analysis(an.mail_by_domain),
    _over(
        ["sender_domain", "has_list_unsubscribe"],
        "sender_domain, count(*) AS messages, count(*) FILTER (has_list_unsubscribe = 'true') AS newsletters, "
        "count(*) FILTER (has_list_unsubscribe = 'true') * 1000 // count(*) AS newsletter_per_mille",
        "GROUP BY sender_domain",
    ),
)
register(
    "noreply_senders",
    _analysis(an.noreply_senders),
    "SELECT email, count(*) AS messages FROM ("
    + _over(["from_email", "reply_to"], "unnest(list_distinct([from_email, reply_to])) AS email")
    + f") WHERE regexp_matches(email, {quote(an.NO_REPLY)}) GROUP BY email",
)
register(
    "reply_mismatch",
    _analysis(an.reply_mismatch),
    _over(
        ["sender_domain", "reply_to_domain"],
        "*",
        "WHERE reply_to_domain <> '' AND reply_to_domain <> sender_domain",
        keep="mail.id",
    ),
)
register(
    "alias_usage",
    _analysis(an.alias_usage),
    _over(
        ["delivered_to"],
        "delivered_to, regexp_extract(delivered_to, '^[^@+]*\\+([^@]*)@', 1) AS tag, count(*) AS messages",
        "GROUP BY ALL",
    ),
)
register(
    "subject_patterns",
    _analysis(an.subject_patterns),
    f"WITH {m.MAIL} SELECT subject_id, count(*) AS messages FROM (SELECT unnest(list_distinct("
    f"regexp_extract_all({m.header('Subject')}, {quote(an.SUBJECT_ID)}))) AS subject_id FROM mail) GROUP BY subject_id",
)
_FIRST = (
    f"SELECT {m.header('Message-ID')} AS message_id, id, internal_date, row_number() OVER "
    f"(PARTITION BY {m.header('Message-ID')} ORDER BY internal_date, id) AS place FROM mail"
)
register(
    "dedupe_message_id",
    lambda s, f: an.dedupe_message_id(mailbox(s, f)).select(
        "message_id", "id", F.unix_timestamp("internal_date").alias("received_at")
    ),
    f"WITH {m.MAIL} SELECT message_id, id, epoch(internal_date)::BIGINT AS received_at FROM ({_FIRST}) "
    "WHERE place = 1 OR message_id = ''",
)


def _deduped_rows(spark, folder):
    """The kept rows of batches that arrive out of order, the middle one twice."""
    path = work_path(spark, "deduped")
    rows = mailbox(spark, folder)
    for batch in (0, 1, 1, 2):
        own = rows.where(F.pmod(F.crc32(F.col("id").cast("binary")), F.lit(3)) == batch)
        dedupe_batch(own, path, batch)
    return read_deduped(spark, path).select(
        "message_id", "id", F.unix_timestamp("internal_date").alias("received_at")
    )


register("stream_dedupe_rows", _deduped_rows, ORACLE["dedupe_message_id"])


def _sender_months(spark, folder):
    path, mail = work_path(spark, "sketches"), mailbox(spark, folder)
    an.sender_sketches(mail).write.parquet(path)
    checked = an.sender_months_check(mail, spark.read.parquet(path))
    return checked.withColumn("month", F.col("month").cast("string"))


register(
    "senders_by_month",
    _sender_months,
    "SELECT strftime(date_trunc('month', internal_date), '%Y-%m-%d') AS month, count(DISTINCT from_email) AS senders, "
    f"true AS estimate_is_near FROM ({m.fields_sql(['from_email'], keep='mail.id, mail.internal_date')}) "
    "WHERE from_email <> '' GROUP BY 1",
)
register(
    "reply_links",
    _analysis(an.reply_links),
    f"WITH {m.MAIL}, first AS ({_FIRST}) SELECT r.id, r.in_reply_to, f.id AS parent_id FROM "
    f"(SELECT id, {m.header('In-Reply-To')} AS in_reply_to FROM mail) r "
    "LEFT JOIN first f ON f.message_id = r.in_reply_to AND f.place = 1 AND r.in_reply_to <> ''",
)
register(
    "thread_summary",
    _analysis(an.thread_summary),
    "WITH rows AS ("
    + _over(["from_email", "thread_id"], "*, epoch(internal_date)::BIGINT AS at_s", "WHERE thread_id <> ''")
    + "), gaps AS (SELECT *, at_s - lag(at_s) OVER (PARTITION BY thread_id ORDER BY at_s) AS gap FROM rows) "
    "SELECT thread_id, count(*) AS messages, min(at_s) AS first_at, max(at_s) AS last_at, "
    "coalesce(max(gap), 0) AS longest_gap, count(DISTINCT from_email) AS participants, "
    "max(at_s) - min(at_s) AS span FROM gaps GROUP BY thread_id",
)
_label_case = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in an.SYSTEM_LABELS.items())


def _label_counts(spark, folder):
    names = table(spark, folder, "nation").select(
        F.concat(F.lit("Label_"), "n_nationkey").alias("label_id"), F.col("n_name").alias("label_name")
    )
    return an.label_counts(mailbox(spark, folder), names)


register(
    "label_counts",
    _label_counts,
    f"WITH {m.MAIL}, counts AS (SELECT label_id, count(*) AS messages FROM (SELECT unnest(label_ids) AS label_id "
    "FROM mail) GROUP BY label_id) SELECT label_id, messages, coalesce(n_name, "
    f"CASE label_id {_label_case} END, label_id) AS label_name FROM counts "
    "LEFT JOIN nation ON label_id = 'Label_' || n_nationkey",
)
register(
    "attachment_inventory",
    _analysis(an.attachment_inventory),
    f"WITH {m.MAIL} SELECT attachment_type, count(*) AS messages, sum(n)::BIGINT AS attachments FROM "
    f"(SELECT unnest({m.ATTACHMENT_TYPES}) AS attachment_type, {m.ATTACHMENT_COUNT} AS n FROM mail) GROUP BY ALL",
)
_BARE = f"regexp_replace({m.header('Date')}, '^[A-Za-z]{{3}}, | \\([^)]*\\)$', '', 'g')"
register(
    "sent_at",
    on_mail(sent_at=lambda: F.unix_timestamp(an.sent_at(h("Date"))), received_at=lambda: F.unix_timestamp("internal_date")),
    m.mail_select(
        f"id, epoch(try_strptime({_BARE}, '%d %b %Y %H:%M:%S %z'))::BIGINT AS sent_at, "
        "epoch(internal_date)::BIGINT AS received_at"
    ),
)
register(
    "newsletter_tracking",
    _analysis(an.newsletter_tracking),
    _over(
        ["from_email", "sender_domain", "has_list_unsubscribe"],
        "from_email, sender_domain, count(*) AS messages, count(*) FILTER (has_list_unsubscribe = 'true') AS newsletters",
        "GROUP BY ALL HAVING newsletters > 0",
    ),
)
register(
    "body_search",
    _analysis(an.body_search, "Que La"),
    f"SELECT * FROM ({m.fields_sql(['body_text'])}) WHERE {_contains('body_text', 'Que La')}",
)


def _indexed_search(spark, folder):
    path = work_path(spark, "index")
    build_index(mailbox(spark, folder), path)
    return indexed_search(mailbox(spark, folder), path, "Que La")


register("indexed_search", _indexed_search, ORACLE["body_search"])
