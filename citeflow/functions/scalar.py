"""Scalar expressions whose edge cases differ from Spark's nearest built-in function."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Without any white space at either end; ``F.trim`` takes off blanks only."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def capitalise(text: Column) -> Column:
    """First letter in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.greatest(F.length(text) - 1, F.lit(0))))


def last_index(text: Column, part: str) -> Column:
    """Place of the last occurrence, from 1; -1 if there is none."""
    at = F.locate(part[::-1], F.reverse(text))
    return F.when(at == 0, F.lit(-1)).otherwise(F.length(text) - at - len(part) + 2)


def between(text: Column, first: Column | int, last: Column | int) -> Column:
    """Characters first to last, from 1, both included."""
    first, last = (x if isinstance(x, Column) else F.lit(x) for x in (first, last))
    return F.substring(text, first, F.greatest(last - first + 1, F.lit(0)))


def tail(items: Column) -> Column:
    """An array without its first element."""
    return F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0)))


def paste(*parts: Column, sep: str = " ") -> Column:
    """Parts joined by a separator; nulls are left out."""
    return F.concat_ws(sep, *parts)


def join_ordered(value: Column, order: Column, sep: str = " ") -> Column:
    """Aggregate: the values joined in order; nulls are left out."""
    rows = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v")))))
    return F.array_join(F.transform(rows, lambda x: x["v"]), sep)


def normalise_list(text: Column, split: str = ";", join: str = ",") -> Column:
    """A list in a string with trimmed items and another separator; one empty item at the end is dropped."""
    items = F.transform(F.split(text, split, -1), strip)
    items = F.when((F.size(items) > 1) & (F.element_at(items, -1) == ""), F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0)))).otherwise(items)
    return F.array_join(items, join)


def author_key(text: Column) -> Column:
    """Lower case without punctuation and white space."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"\p{Punct}", ""), r"\s+", "")


def request_timeout(characters: Column, base: int = 180, per_thousand: int = 18, most: int = 1200) -> Column:
    """Seconds to wait for a reply to so many characters, halves rounded to even."""
    return F.least(F.bround(base + characters / F.lit(1000) * per_thousand, 0), F.lit(float(most)))


#: Phrases that a model puts before its answer.
LEAD_INS = ["Here is", "Here's", "The theme is", "Theme:", "A theme could be"]


def clean_theme(reply: Column) -> Column:
    """A short theme out of a model's reply: without lead-in, outer quotes, further lines and sentences."""
    steps = [(rf"(?i)^(?:{'|'.join(LEAD_INS)}):?\s*", ""), (r"^[\"']|[\"']$", ""), (r"(?s)\n.*", ""), (r"\.$", "")]
    text = reduce(lambda x, s: F.regexp_replace(x, *s), steps, strip(reply))
    return strip(F.element_at(F.split(text, r"\.", -1), 1))


def windows_path(path: Column) -> Column:
    """A POSIX path as one on drive C."""
    return F.concat(F.lit("C:\\"), F.array_join(F.filter(F.split(path, "/"), lambda x: x != ""), "\\"))
