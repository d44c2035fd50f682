"""Text normal forms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dash-like and dot-like characters, and odd spaces.
DASHES, DOTS, SPACES = "‐‑‒–—―−", "·•∙․", "    ​　﻿"


def norm(s: Column) -> Column:
    """Odd spaces and control characters to spaces, dashes, dots and colons to one form, marks of emphasis out, squeezed."""
    x = F.translate(s, SPACES, " " * len(SPACES))
    x = F.regexp_replace(x, r"[\x00-\x1F\x7F]", " ")
    x = F.translate(F.translate(x, DASHES, "-" * len(DASHES)), DOTS + "：", "." * len(DOTS) + ":")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[*_`]", ""), r"\s+", " "))


def norm_company(s: Column) -> Column:
    """norm, without brackets, cut where contact data start, without bullets."""
    return company(norm(s))


def company(n: Column) -> Column:
    """norm_company of a text that is in norm's form already."""
    x = F.regexp_replace(n, r"\([^)]*\)", " ")
    x = F.regexp_replace(x, r"(?i)\s*(tel|fax|phone|e-?mail|www\.|https?:|address|주소|전화|팩스).*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"^[\-.#>\s]+", ""), r"\s+", " "))


def norm_lower(s: Column) -> Column:
    """norm with full-width characters as usual ones, in lower case."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    return F.lower(F.translate(norm(s), wide, "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))))


def is_noise(line: Column) -> Column:
    """Blank lines, page counters, page markers and lone tags."""
    return line.rlike(r"^\s*$|^\s*\d+\s*/\s*\d+\s*$|^\s*>{2,}\s*page[ _-]\d+\s*$|^\s*</?[A-Za-z]+/?>\s*$")


def is_table_line(line: Column) -> Column:
    return line.rlike(r"^\s*\|.*\|\s*$")


def after_label(line: Column, labels: list[str]) -> Column:
    """The value of `label: value` where the left side is just a known label."""
    p = F.split(line, "[:：]", 2)
    known = F.lower(F.trim(F.get(p, 0))).isin([x.lower() for x in labels])
    return F.when(known, F.nullif(F.trim(F.get(p, 1)), F.lit("")))
