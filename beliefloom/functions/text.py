"""Text and time columns shared by the operators.  All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a maximal run of letters and digits.
WORD = r"[\p{L}\p{N}]+"
_ZONE = r"(?:[Zz]|[+-]\d{2}:?\d{2})$"


def instant_us(text: Column) -> Column:
    """Microseconds since 1970 UTC of an ISO 8601 text; null if it is null, blank or malformed.

    The text may use ``T`` or a blank, have a fraction or none, and end in ``Z``, an offset or neither (then UTC,
    whatever the session's time zone).
    """
    s = F.trim(text)
    s = F.when(F.length(s) == 10, F.concat(s, F.lit("T00:00:00Z"))).when(s.rlike(_ZONE), s).otherwise(F.concat(s, F.lit("Z")))
    return F.unix_micros(s.try_cast("timestamp"))


def words(text: Column) -> Column:
    """The lower-case words of a text in order; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1)), F.array().cast("array<string>"))


def word_set(text: Column) -> Column:
    return F.array_sort(F.array_distinct(words(text)))


def plain(text: Column) -> Column:
    """Without outer white space and case."""
    return F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))


def claim_key(ident: Column) -> Column:
    """A claim identifier as it is written canonically: ``C`` and lower-case hex; null if nothing is left."""
    s = plain(ident)
    return F.when(F.length(s) > 0, F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 20)))
