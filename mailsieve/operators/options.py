"""Options of an export job."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from mailsieve.functions.redaction_rules import DEFAULT_CATEGORIES

# Offered body limits (characters) and file sizes (bytes).
BODY_LIMITS = {"compact": 2_000, "default": 8_000, "full": 50_000, "unlimited": 0}
FILE_SIZES = {f"{mb}MB": mb * 1_000_000 for mb in (25, 30, 50, 100, 250)} | {"unsplit": 0}


@dataclass(frozen=True)
class ExportOptions:
    """Every knob of an export; the defaults are a complete, working set."""

    selection: str = "received"  # a preset of operators.predicates
    where: str | None = None  # an SQL predicate instead of the preset
    max_messages: int = 0  # 0 = all
    fields: tuple[str, ...] = ()  # () = the default set
    body_max_chars: int = BODY_LIMITS["default"]
    sanitize: bool = False
    categories: tuple[str, ...] = DEFAULT_CATEGORIES
    text_mode: str = "reference"  # or "bounded": see functions.text.PROPERTY_RULE
    output_dir: str = "./exports"
    prefix: str = "mail_export"
    include_timestamp: bool = True
    max_bytes_per_file: int = FILE_SIZES["250MB"]  # 0 = no splitting


def base_name(options: ExportOptions, now: datetime | None = None) -> str:
    """``prefix[_YYYYMMDD_HHMMSS]``."""
    stamp = (now or datetime.now()).strftime("_%Y%m%d_%H%M%S") if options.include_timestamp else ""
    return f"{options.prefix}{stamp}"
