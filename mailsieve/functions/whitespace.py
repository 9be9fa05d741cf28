"""One definition of white space for every engine the data passes through.

``\\s`` means something different on the JVM, in RE2 and in Python, so no pattern
in this package relies on an engine's own ``\\s``: patterns are written with
``\\s`` and ``spell_out`` replaces it by the explicit Unicode class below.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Members of the white-space class, for use inside ``[...]`` (JVM and RE2 syntax).
WS_MEMBERS = (
    r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
WS = f"[{WS_MEMBERS}]"

# The same set as characters, for trim functions.
WS_CHARS = "".join(
    map(
        chr,
        [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B)]
        + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF],
    )
)


def spell_out(pattern: str) -> str:
    """Replace ``\\s`` by the explicit class, inside or outside brackets."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        token = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        if token == r"\s":
            out.append(WS_MEMBERS if in_class else WS)
        else:
            in_class = (token == "[") or (in_class and token != "]")
            out.append(token)
        i += len(token)
    return "".join(out)


def trim_ws(c: Column) -> Column:
    """Trim Unicode white space at both ends (SQL ``trim`` only knows the blank)."""
    return F.btrim(c, F.lit(WS_CHARS))


def collapse_ws(c: Column) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    blanks = F.translate(c, WS_CHARS, " " * len(WS_CHARS))
    return F.trim(F.regexp_replace(blanks, "  +", " "))
