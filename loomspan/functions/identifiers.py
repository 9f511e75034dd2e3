"""Identifiers, loopback addresses and texts of part lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and address lists on which results depend.
IDENTIFIER = r"[a-zA-Z0-9][a-zA-Z0-9._:/-]{7,127}"
SHA256 = r"[a-f0-9]{64}"
LOOPBACK = ("127.0.0.1", "::1", "0:0:0:0:0:0:0:1", "::ffff:127.0.0.1")
DATABASE_HOSTS = ("127.0.0.1", "localhost", "::1")


def matches(value: Column, pattern: str) -> Column:
    """Whether the whole value has the pattern; a line feed at its end is part of it."""
    return F.rlike(value, F.lit(rf"^{pattern}\z"))


def is_loopback(address: Column) -> Column:
    """Whether an address, in brackets or not, is this machine's own."""
    return F.regexp_replace(F.lower(F.trim(address)), r"^\[|\]$", "").isin(*LOOPBACK)


def parts_text(parts: Column, separator: str) -> Column:
    """The texts of a list of parts in a row; a part without text counts as an empty one, null lists as none."""
    texts = F.transform(parts, lambda p: F.coalesce(p["text"], F.lit("")))
    return F.coalesce(F.array_join(texts, separator), F.lit(""))
