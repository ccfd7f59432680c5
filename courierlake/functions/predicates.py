"""Predicates, argument rules and time expressions shared by the operators."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from dateutil import parser
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LIMIT = 1000


class ToolError(Exception):
    """A bad argument; servers answer {"error": message}."""


def integer(value: object) -> int:
    """The leading integer of a value, else 0."""
    found = re.match(r"\s*[+-]?\d+", str(value)) if value is not None else None
    return int(found[0]) if found else 0


def limit_of(value: object, default: int, most: int = MAX_LIMIT) -> int:
    """A row limit: not positive or no number gives the default; never above `most`."""
    n = integer(value)
    return min(n if n > 0 else default, most if most > 0 else MAX_LIMIT)


def required(value: object, name: str) -> object:
    if value is None or value == "":
        raise ToolError(f"{name} is required")
    return value


ASCII_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def folded(column: Column, ascii_only: bool = False) -> Column:
    """Lower case of all letters, or of ASCII ones only, as SQLite has it."""
    return F.translate(column, ASCII_CAPITALS, ASCII_CAPITALS.lower()) if ascii_only else F.lower(column)


def contains(column: Column, term: str, ascii_only: bool = False) -> Column:
    """Case-insensitive literal containment; %, _ and backslash are ordinary characters."""
    low = term.translate(str.maketrans(ASCII_CAPITALS, ASCII_CAPITALS.lower())) if ascii_only else term.lower()
    return F.contains(folded(column, ascii_only), F.lit(low))


def from_domain(domain: str) -> Column:
    """Senders whose address contains @domain."""
    return contains(F.col("from_email"), "@" + domain.removeprefix("@"))


def filled(column: Column) -> Column:
    return column.isNotNull() & (column != "")


def epoch_of(text: str) -> int | None:
    """Epoch seconds of a date or time in any usual spelling, UTC unless it names an offset; what it leaves out is today's, at midnight. None if it can't be read."""
    for form in (str(text).strip().replace("Z", "+00:00"), str(text).strip()):
        try:
            when = datetime.fromisoformat(form)
        except ValueError:
            continue
        return int((when if when.tzinfo else when.replace(tzinfo=UTC)).timestamp())
    today = datetime.now(UTC).replace(hour=0, minute=0, second=0, microsecond=0, tzinfo=None)
    try:
        when = parser.parse(str(text).strip(), default=today)
    except (ValueError, OverflowError):
        return None
    return int((when if when.tzinfo else when.replace(tzinfo=UTC)).timestamp())


def moment() -> Column:
    """The server's receive time; the session is in UTC."""
    return F.timestamp_seconds("internaldate_epoch")


def iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ssXXX")
