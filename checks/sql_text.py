"""SQL for text steps: every replacement is one materialised CTE, in reference order."""

from __future__ import annotations

from collections.abc import Iterable

from mailsieve.functions.redaction_rules import rules_for
from mailsieve.functions.whitespace import WS, WS_MEMBERS, spell_out

from checks.probes import quote

BLANK = "[" + WS_MEMBERS.replace(r"\n", "") + "]"


def replace_all(expr: str, pattern: str, by: str) -> str:
    return f"regexp_replace({expr}, {quote(pattern)}, {quote(by)}, 'g')"


def count_all(expr: str, pattern: str) -> str:
    return f"len(regexp_extract_all({expr}, {quote(pattern)}))"


def trim_ws(expr: str) -> str:
    return replace_all(expr, rf"\A{WS}+|{WS}+\z", "")


def collapse_ws(expr: str) -> str:
    return f"trim({replace_all(expr, f'{WS}+', ' ')}, ' ')"


class Chain:
    """CTEs that rewrite column ``t`` of a relation step by step."""

    def __init__(self, source: str, select: str, name: str = "c"):
        self.name, self.ctes = name, []
        self._add(f"SELECT {select} FROM {source}")

    def _add(self, body: str) -> None:
        self.ctes.append(f"{self.name}{len(self.ctes)} AS MATERIALIZED ({body})")

    @property
    def last(self) -> str:
        return f"{self.name}{len(self.ctes) - 1}"

    def set(self, expr: str, **others: str) -> "Chain":
        extra = "".join(f", {v} AS {k}" for k, v in others.items())
        self._add(f"SELECT * REPLACE ({expr} AS t{extra}) FROM {self.last}")
        return self

    def steps(self, steps: Iterable[tuple[str, str]]) -> "Chain":
        for pattern, by in steps:
            self.set(replace_all("t", spell_out(pattern), by))
        return self

    def sql(self, select: str, before: str = "") -> str:
        head = f"{before}, " if before else ""
        return f"WITH RECURSIVE {head}{', '.join(self.ctes)} {select.replace('{last}', self.last)}"


def add_redaction(chain: Chain, categories, counts: bool = True) -> Chain:
    """Rewrites ``t``; with ``counts`` adds to the existing columns ``n_<category>``."""
    for rule in rules_for(categories):
        n = f"n_{rule.category}"
        for p in rule.patterns:
            more = {n: f"{n} + {count_all('t', p)}"} if counts else {}
            chain.set(replace_all("t", p, rule.token), **more)
    return chain


def zero_counts(categories) -> str:
    return ", ".join(f"0::BIGINT AS n_{c}" for c in categories)


# --- entities ---------------------------------------------------------------------
def _decode_numeric(pattern: str, base_prefix: str, visible: bool) -> str:
    code = f"coalesce(try_cast('{base_prefix}' || m AS BIGINT), 1114112)"
    bad = "c > 1114111 OR (c BETWEEN 55296 AND 57343)"
    hidden = "c < 32 OR (c BETWEEN 8203 AND 8207) OR c IN (847, 65279, 173)"
    skip = f"WHEN {hidden} THEN '' " if visible else ""
    text_of = f"CASE WHEN {bad} THEN chr(65533) {skip}ELSE chr(c::INTEGER) END"
    pieces = f"regexp_split_to_array(t, {quote(pattern)})"
    codes = f"list_transform(regexp_extract_all(t, {quote(pattern)}, 1), lambda m: {code})"
    signs = f"list_transform({codes}, lambda c: {text_of})"
    return (
        f"CASE WHEN contains(t, '&#') THEN array_to_string(list_transform({pieces}, "
        f"lambda s, i: s || coalesce(({signs})[i], '')), '') ELSE t END"
    )


HEX, DEC = "&#x([0-9a-fA-F]+);", "&#([0-9]+);"
BASIC = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")]
# Code points of the named signs, in decoding order.
SIGNS = [
    ("reg", 0xAE), ("copy", 0xA9), ("trade", 0x2122), ("bull", 0x2022), ("middot", 0xB7),
    ("ndash", 0x2013), ("mdash", 0x2014), ("lsquo", 0x2018), ("rsquo", 0x2019), ("ldquo", 0x201C),
    ("rdquo", 0x201D), ("hellip", 0x2026), ("dagger", 0x2020), ("Dagger", 0x2021), ("aacute", 0xE1),
    ("eacute", 0xE9), ("iacute", 0xED), ("oacute", 0xF3), ("uacute", 0xFA), ("ntilde", 0xF1),
    ("Aacute", 0xC1), ("Eacute", 0xC9), ("Iacute", 0xCD), ("Oacute", 0xD3), ("Uacute", 0xDA), ("Ntilde", 0xD1),
]


def _i(steps):
    return [(f"(?i){p}", by) for p, by in steps]


def add_decode_entities(chain: Chain) -> Chain:
    chain.set(_decode_numeric(HEX, "0x", False)).set(_decode_numeric(DEC, "", False))
    return chain.steps(_i(BASIC) + [("(?i)&zwnj;|&zwj;|&lrm;|&rlm;", "")])


# --- clean_text --------------------------------------------------------------------
def add_clean(chain: Chain) -> Chain:
    chain.steps(
        [
            (r"\{[^}]*\}", " "),
            (r"[\w\-]+\s*:\s*[^;{}]+;", " "),
            ("(?i)&zwnj;|&zwj;|&lrm;|&rlm;|&ZeroWidthSpace;", ""),
            ("(?i)&shy;", ""),
            (r"[\x{034F}\x{200B}-\x{200F}\x{2028}-\x{202F}\x{2060}\x{FEFF}\x{00AD}\x{180E}]", ""),
            ("<[^>]+>", " "),
        ]
    )
    chain.steps(_i(BASIC)).steps((f"(?i)&{name};", chr(code)) for name, code in SIGNS)
    chain.steps([("(?i)&#8203;|&#x200B;|&#847;|&#x34F;|&#65279;|&#xFEFF;|&#173;|&#xAD;", "")])
    chain.set(_decode_numeric(HEX, "0x", True)).set(_decode_numeric(DEC, "", True))
    # Unknown names become a blank; amp, lt and gt stay.
    found = "regexp_extract_all(t, '(?i)&[a-z]{2,10};')"
    kept = f"list_transform({found}, lambda e: CASE WHEN lower(e) IN ('&amp;', '&lt;', '&gt;') THEN e ELSE ' ' END)"
    pieces = "regexp_split_to_array(t, '(?i)&[a-z]{2,10};')"
    chain.set(
        f"CASE WHEN contains(t, '&') THEN array_to_string(list_transform({pieces}, "
        f"lambda s, i: s || coalesce(({kept})[i], '')), '') ELSE t END"
    )
    chain.steps([(r"[ \t]+", " "), (r"\n{3,}", "\n\n")])
    lines = f"list_transform(string_split(t, chr(10)), lambda s: {trim_ws('s')})"
    return chain.set(f"array_to_string({lines}, chr(10))").set(trim_ws("t"))


# --- html_to_text ------------------------------------------------------------------
def add_links(chain: Chain) -> Chain:
    link = r"(?i)<a\b[^>]*?>(?s:.)*?</a>"
    attrs = r"regexp_extract(m, '(?i)^<a\b([^>]*?)>', 1)"
    inner = r"regexp_extract(m, '(?i)^<a\b[^>]*?>((?s:.)*?)</a>', 1)"

    def href(value: str) -> str:
        pattern = spell_out(rf"(?i)\bhref\s*=\s*{value}")
        return f"nullif(regexp_extract({attrs}, {quote(pattern)}, 1), '')"

    first = f"coalesce({href(chr(34) + '([^' + chr(34) + ']+)' + chr(34))}, " + (
        f"{href(chr(39) + '([^' + chr(39) + ']+)' + chr(39))}, {href('([^' + chr(92) + 's>]+)')}, '')"
    )
    label = trim_ws(replace_all(replace_all(inner, "<[^>]+>", " "), f"{WS}+", " "))
    both = f"list_transform(regexp_extract_all(t, {quote(link)}), lambda m: {{'h': {first}, 'l': {label}}})"
    shown = (
        "CASE WHEN x.h = '' AND x.l = '' THEN 'link' WHEN x.h = '' THEN x.l WHEN x.l = '' THEN x.h "
        "WHEN contains(x.l, x.h) THEN x.l ELSE x.l || ' (' || x.h || ')' END"
    )
    signs = f"list_transform({both}, lambda x: {shown})"
    return chain.set(
        f"array_to_string(list_transform(regexp_split_to_array(t, {quote(link)}), "
        f"lambda s, i: s || coalesce(({signs})[i], '')), '')"
    )


def add_html(chain: Chain) -> Chain:
    block = "|".join(
        rf"<\s*{t}[^>]*>(?s:.)*?<\s*/\s*{t}\s*>" for t in ("script", "style", "noscript", "head", "svg")
    )
    nested = r"[^{]*\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"
    chain.steps(
        [
            (r"<!--(?s:.)*?-->", " "),
            (f"(?i){block}", " "),
            (r"/\*(?s:.)*?\*/", " "),
            (r"[.#]?[\w\-]+\s*\{[^}]*\}", " "),
            (f"(?i)@media{nested}", " "),
            (rf"@[\w\-]+{nested}", " "),
            (r"[\w\-]+\s*:\s*[^;{}]+;", " "),
            (r'\w+\s*=\s*""[^""]*""', " "),
            (
                r"(?i)(?:width|height|border|style|class|id|align|valign|bgcolor|cellpadding|cellspacing)"
                r"""\s*=\s*["'][^"']*["']""",
                " ",
            ),
        ]
    )
    add_links(chain)
    chain.steps(
        [
            (r"(?i)<\s*br\s*/?>", "\n"),
            (r"(?i)<\s*/p\s*>", "\n\n"),
            (r"(?i)<\s*/div\s*>", "\n"),
            (r"(?i)<\s*/li\s*>", "\n"),
            (r"(?i)<\s*li\s*>", "• "),
            (r"<[^>]+>", " "),
        ]
    )
    add_decode_entities(chain)
    lines = f"list_transform(string_split(t, chr(10)), lambda s: {trim_ws(replace_all('s', WS + '+', ' '))})"
    chain.set(f"array_to_string({lines}, chr(10))").steps([(r"\n{3,}", "\n\n")])
    return chain.set(trim_ws("t"))
