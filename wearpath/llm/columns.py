"""Column helpers shared by the DataFrame-only operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters between words: space, tab, line feed, vertical tab, form feed, carriage return.
GAPS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_of(column: str | Column) -> Column:
    """A text, empty where it is null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")
