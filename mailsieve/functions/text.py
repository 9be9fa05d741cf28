"""Entity decoding, text cleaning and HTML to text, as Arrow UDFs.

The patterns, replacements and their order are fixed values: every step sees the
output of the previous one, and double-encoded entities depend on it.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsieve.functions.arrow_text import Step, map_rows, run_steps, where_present
from mailsieve.functions.whitespace import WS, WS_CHARS, WS_MEMBERS, spell_out

# White space other than the newline.
_BLANK = "[" + WS_MEMBERS.replace(r"\n", "") + "]"
_BLANK_NOT_SPACE = "[" + WS_MEMBERS.replace(r"\n", "").replace(r"\r ", r"\r") + "]"
_PY_WS = "[" + re.escape(WS_CHARS) + "]"

# A CSS-looking "name: value;". The plain form also eats prose and URL schemes; the
# bounded form stays on one line, outside tags and quotes, and leaves "://" alone.
PROPERTY_RULE = {
    "reference": spell_out(r"[\w\-]+\s*:\s*[^;{}]+;"),
    "bounded": r"""[\w\-]+[ \t]*:[ \t]*[^;{}<>"'\n/ \t][^;{}<>"'\n]*;""",
}

# --- entity tables ---------------------------------------------------------------
# Basic named entities, in decoding order.
BASIC_ENTITIES: tuple[Step, ...] = (
    ("nbsp", " "),
    ("amp", "&"),
    ("lt", "<"),
    ("gt", ">"),
    ("quot", '"'),
    ("apos", "'"),
)
# Typographic and accented entities; upper-case names decode to the
# lower-case sign because names are matched without case.
SIGN_ENTITIES: tuple[Step, ...] = (
    ("reg", "®"),
    ("copy", "©"),
    ("trade", "™"),
    ("bull", "•"),
    ("middot", "·"),
    ("ndash", "–"),
    ("mdash", "—"),
    ("lsquo", "‘"),
    ("rsquo", "’"),
    ("ldquo", "“"),
    ("rdquo", "”"),
    ("hellip", "…"),
    ("dagger", "†"),
    ("aacute", "á"),
    ("eacute", "é"),
    ("iacute", "í"),
    ("oacute", "ó"),
    ("uacute", "ú"),
    ("ntilde", "ñ"),
)
# Zero-width named entities, invisible numeric entities and code points.
ZERO_WIDTH_ENTITIES = r"(?i)&zwnj;|&zwj;|&lrm;|&rlm;"
ZERO_WIDTH_OR_SPACE_ENTITIES = ZERO_WIDTH_ENTITIES + "|&ZeroWidthSpace;"
INVISIBLE_NUMERIC = r"(?i)&#8203;|&#x200B;|&#847;|&#x34F;|&#65279;|&#xFEFF;|&#173;|&#xAD;"
INVISIBLE_CHARS = r"[\x{034F}\x{200B}-\x{200F}\x{2028}-\x{202F}\x{2060}\x{FEFF}\x{00AD}\x{180E}]"
# Named entities of 2 to 10 letters other than amp, lt and gt.
UNKNOWN_ENTITY = (
    r"(?i)&(?:[a-fh-km-z][a-z]|[gl][a-su-z]"
    r"|[b-z][a-z]{2}|a[a-ln-z][a-z]|am[a-oq-z]"
    r"|[a-z]{4,10});"
)

_HEX = re.compile(r"&#x([0-9a-fA-F]+);")
_DEC = re.compile(r"&#([0-9]+);")


def _named(entities) -> list[Step]:
    return [(f"(?i)&{name};", sign) for name, sign in entities]


def _char(digits: str, base: int) -> str:
    # The largest code point has 7 digits; longer runs need no conversion to be out of range.
    digits = digits.lstrip("0") or "0"
    code = int(digits, base) if len(digits) <= 7 else 0x110000
    return "\ufffd" if code > 0x10FFFF or 0xD800 <= code <= 0xDFFF else chr(code)


def _visible_char(digits: str, base: int) -> str:
    c = _char(digits, base)
    code = ord(c)
    # Control characters and invisible code points are dropped.
    hidden = code < 32 or 0x200B <= code <= 0x200F or code in (0x034F, 0xFEFF, 0x00AD)
    return "" if hidden else c


def _decode_numeric(text: str, to_char) -> str:
    text = _HEX.sub(lambda m: to_char(m[1], 16), text)
    return _DEC.sub(lambda m: to_char(m[1], 10), text)


def decode_numeric_batch(texts: pa.Array, to_char=_char) -> pa.Array:
    return where_present(
        texts, "&#", lambda part: map_rows(part, lambda t: _decode_numeric(t, to_char))
    )


def decode_entities_batch(texts: pa.Array) -> pa.Array:
    def decode(part: pa.Array) -> pa.Array:
        part = decode_numeric_batch(part)
        return run_steps(part, _named(BASIC_ENTITIES) + [(ZERO_WIDTH_ENTITIES, "")])

    return where_present(texts, "&", decode)


# --- clean_text ------------------------------------------------------------------
def clean_batch(texts: pa.Array, mode: str = "reference") -> pa.Array:
    def decode(part: pa.Array) -> pa.Array:
        part = run_steps(
            part, _named(BASIC_ENTITIES + SIGN_ENTITIES) + [(INVISIBLE_NUMERIC, "")]
        )
        part = decode_numeric_batch(part, _visible_char)
        return run_steps(part, [(UNKNOWN_ENTITY, " ")])

    texts = run_steps(
        texts,
        [
            (r"\{[^}]*\}", " "),
            (PROPERTY_RULE[mode], " "),
            (ZERO_WIDTH_OR_SPACE_ENTITIES, ""),
            (r"(?i)&shy;", ""),
            (INVISIBLE_CHARS, ""),
            (r"<[^>]+>", " "),
        ],
    )
    texts = where_present(texts, "&", decode)
    texts = run_steps(
        texts,
        [
            (r"[ \t]{2,}|\t", " "),
            (r"\n{3,}", "\n\n"),
            (rf"{_BLANK}+\n{_BLANK}*|\n{_BLANK}+", "\n"),
        ],
    )
    return pc.utf8_trim(texts, characters=WS_CHARS)


# --- html_to_text ----------------------------------------------------------------
_DROPPED_BLOCKS = "|".join(
    spell_out(rf"<\s*{tag}[^>]*>(?s:.)*?<\s*/\s*{tag}\s*>")
    for tag in ("script", "style", "noscript", "head", "svg")
)
_NESTED_BLOCK = r"[^{]*\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"
_LINK_OPEN = re.compile(r"<a\b[^>]*>", re.I | re.A)
_LINK_CLOSE = re.compile(r"</a>", re.I | re.A)
_HREFS = tuple(
    re.compile(p, re.I | re.A)
    for p in (
        rf"""\bhref{_PY_WS}*={_PY_WS}*"([^"]+)\"""",
        rf"""\bhref{_PY_WS}*={_PY_WS}*'([^']+)'""",
        rf"""\bhref{_PY_WS}*={_PY_WS}*([^>{_PY_WS[1:-1]}]+)""",
    )
)
_TAG = re.compile(r"<[^>]+>")
_WS_RUN = re.compile(f"{_PY_WS}+")


def _link(attributes: str, inner: str) -> str:
    href = next((m[1] for m in (p.search(attributes) for p in _HREFS) if m), "")
    label = _WS_RUN.sub(" ", _TAG.sub(" ", inner)).strip(" ")
    if not href:
        return label or "link"
    if not label:
        return href
    return label if href in label else f"{label} ({href})"


def _rewrite_links(text: str) -> str:
    """Every ``<a …>…</a>`` becomes its readable form; one pass over the text."""
    out, done, end = [], 0, text.rfind(">") + 1
    opening = _LINK_OPEN.search(text, 0, end)
    while opening:
        closing = _LINK_CLOSE.search(text, opening.end(), end)
        if not closing:
            break
        out.append(text[done : opening.start()])
        out.append(_link(opening[0][2:-1], text[opening.end() : closing.start()]))
        done = closing.end()
        opening = _LINK_OPEN.search(text, done, end)
    return "".join(out) + text[done:]


def rewrite_links_batch(texts: pa.Array) -> pa.Array:
    return where_present(
        texts, "</", lambda part: map_rows(part, _rewrite_links)
    )


def html_batch(html: pa.Array, mode: str = "reference") -> pa.Array:
    text = run_steps(
        html,
        [
            (r"<!--(?s:.)*?-->", " "),
            (f"(?i){_DROPPED_BLOCKS}", " "),
            (r"/\*(?s:.)*?\*/", " "),
            (spell_out(r"[.#]?[\w\-]+\s*\{[^}]*\}"), " "),
            (rf"(?i)@media{_NESTED_BLOCK}", " "),
            (rf"@[\w\-]+{_NESTED_BLOCK}", " "),
            (PROPERTY_RULE[mode], " "),
            (spell_out(r'\w+\s*=\s*""[^"]*""'), " "),
            (
                spell_out(
                    r"(?i)(?:width|height|border|style|class|id|align|valign|bgcolor|cellpadding|cellspacing)"
                    r"""\s*=\s*["'][^"']*["']"""
                ),
                " ",
            ),
        ],
    )
    text = rewrite_links_batch(text)
    text = run_steps(
        text,
        [
            (spell_out(r"(?i)<\s*br\s*/?>"), "\n"),
            (spell_out(r"(?i)<\s*/p\s*>"), "\n\n"),
            (spell_out(r"(?i)<\s*/(?:div|li)\s*>"), "\n"),
            (spell_out(r"(?i)<\s*li\s*>"), "• "),
            (r"<[^>]+>", " "),
        ],
    )
    text = decode_entities_batch(text)
    text = run_steps(
        text,
        [
            (rf"{_BLANK}+\n{_BLANK}*|\n{_BLANK}+", "\n"),
            (rf"{_BLANK}{{2,}}|{_BLANK_NOT_SPACE}", " "),
            (r"\n{3,}", "\n\n"),
        ],
    )
    return pc.utf8_trim(text, characters=WS_CHARS)


def body_text_batch(plain: pa.Array, html: pa.Array, mode: str = "reference") -> pa.Array:
    """Plain text if there is any, else the HTML as text; cleaned."""
    plain = pc.utf8_trim(plain, characters=WS_CHARS)
    from_html = html_batch(pc.utf8_trim(html, characters=WS_CHARS), mode)
    return clean_batch(pc.if_else(pc.equal(plain, ""), from_html, plain), mode)


# --- Column functions ------------------------------------------------------------
@F.arrow_udf(T.StringType())
def _decode_entities_udf(texts: pa.Array) -> pa.Array:
    return decode_entities_batch(texts)


@F.arrow_udf(T.StringType())
def _rewrite_links_udf(texts: pa.Array) -> pa.Array:
    return rewrite_links_batch(texts)


def decode_entities(c: Column) -> Column:
    """Numeric entities, then the basic named ones; zero-width names vanish."""
    return _decode_entities_udf(c)


def link_text(c: Column) -> Column:
    """Links as ``label (address)``, nothing else touched."""
    return _rewrite_links_udf(c)


def clean_text(c: Column, mode: str = "reference") -> Column:
    """Drop CSS, tags, invisible characters and unknown entities; tidy white space."""

    @F.arrow_udf("string")
    def clean_text_udf(texts: pa.Array) -> pa.Array:
        return clean_batch(texts, mode)

    return clean_text_udf(c)


def html_to_text(c: Column, mode: str = "reference") -> Column:
    """Readable text of an HTML document, links kept."""

    @F.arrow_udf("string")
    def html_to_text_udf(html: pa.Array) -> pa.Array:
        return html_batch(html, mode)

    return html_to_text_udf(c)
