"""Column helpers of the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\f\x0b"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Without blanks and line breaks at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def told(*items: tuple[Column, Column]) -> Column:
    """The values, in order, whose conditions hold."""
    return F.filter(F.array(*[F.when(cond, value) for cond, value in items]), lambda x: x.isNotNull())


def has_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def hits(text: Column, words: list[str]) -> Column:
    """How many of the words a text contains."""
    return sum((text.contains(w).cast("int") for w in words[1:]), text.contains(words[0]).cast("int"))


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def number_text(x: Column) -> Column:
    """A decimal as a number prints: no zeros that say nothing."""
    head = F.regexp_replace(x, "^0+([0-9])", "$1")
    return F.when(head.contains("."), F.regexp_replace(head, r"[.]?0*\z", "")).otherwise(head)


def all_of(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
