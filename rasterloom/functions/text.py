"""String functions on Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\x0B\f\r]"


def glob(text: Column, pattern: str) -> Column:
    """Whether the whole text fits a pattern of * and ?."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return text.rlike(f"(?s)^{body}$")


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def ltrim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+", "")


def rtrim(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+$", "")


def join(parts: Column, mark: str) -> Column:
    """Parts with the mark between them; null parts count as empty ones."""
    return F.array_join(parts, mark, "")


def split(text: Column, mark: str) -> Column:
    """Parts between marks; an empty last part is dropped."""
    parts = F.split(text, re.escape(mark), -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def base64_encoded(text: Column) -> Column:
    """In one line."""
    return F.regexp_replace(F.base64(text.cast("binary")), r"[\r\n]", "")


def base64_lenient(code: Column) -> Column:
    """What the code spells up to the first character that isn't of the alphabet."""
    good = F.regexp_extract(code, "^[A-Za-z0-9+/]*", 0)
    whole = F.substring(good, F.lit(1), F.length(good) - F.when(F.length(good) % 4 == 1, 1).otherwise(0))
    return F.unbase64(F.rpad(whole, (F.ceil(F.length(whole) / 4) * 4).cast("int"), F.lit("=")))


def hex_decoded(code: Column) -> Column:
    """Bytes of hexadecimal digits; 0x in front and white space don't count; null where it isn't such."""
    digits = F.regexp_replace(F.regexp_replace(code, SPACE, ""), "^0[xX]", "")
    return F.when(digits.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(digits))
