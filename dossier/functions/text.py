"""Text functions that follow Python's ``str`` methods on the whole of Unicode."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters for which ``str.isspace`` holds.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set inside a Java character class.
WHITESPACE_CLASS = r"\p{IsWhite_Space}\x1C-\x1F"
# The places where ``str.splitlines`` breaks. CR LF gives an empty line more than
# it should, which does not matter where blank lines are dropped.
LINE_BREAKS = r"[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"

_CASED = r"\p{Lu}\p{Ll}\p{Lt}"


# Decimal digits of all scripts but ASCII, and the ASCII digits they stand for.
_DIGITS = [chr(c) for c in range(0x80, 0x110000) if unicodedata.decimal(chr(c), None) is not None]
_ASCII_DIGITS = "".join(str(unicodedata.decimal(c)) for c in _DIGITS)


def ascii_digits(text: Column) -> Column:
    """Decimal digits of any script as ASCII digits, as Python's number types read them."""
    foreign = text.rlike(r"[\p{Nd}&&[^0-9]]")
    return F.when(foreign, F.translate(text, "".join(_DIGITS), _ASCII_DIGITS)).otherwise(text)


def strip(text: Column) -> Column:
    """Trim both ends; only the ends of the string are read, no regex runs."""
    return F.trim(text, F.lit(WHITESPACE))


def nonblank_lines(text: Column) -> Column:
    """array<string> of the stripped, non-blank lines in order."""
    return F.filter(
        F.transform(F.split(text, LINE_BREAKS), strip), lambda line: line != ""
    )


def or_else(text: Column, fallback: Column) -> Column:
    """``fallback`` where the text is null or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), fallback)


def _map_runs(text: Column, runs: str, change) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(runs), F.lit(0)), change), "")


def title_label(key: Column) -> Column:
    """Field key to label: blanks for underscores, then title case.

    A letter starts a new word after anything that is not a cased letter, so
    ``o'neil a1b`` becomes ``O'Neil A1B`` (``initcap`` splits on blanks only).
    """
    return _map_runs(
        F.replace(key, F.lit("_"), F.lit(" ")),
        f"([{_CASED}]+|[^{_CASED}]+)",
        lambda run: F.concat(F.upper(F.left(run, F.lit(1))), F.lower(F.substr(run, F.lit(2)))),
    )


def labelize(value: Column) -> Column:
    """Display label: blanks for underscores, first letter of each word raised.

    Words are runs of ASCII letters and digits; the other letters stay as they are.
    """
    return _map_runs(
        F.replace(value, F.lit("_"), F.lit(" ")),
        "([A-Za-z0-9]+|[^A-Za-z0-9]+)",
        lambda run: F.when(
            run.rlike("^[a-z]"),
            F.concat(F.upper(F.left(run, F.lit(1))), F.substr(run, F.lit(2))),
        ).otherwise(run),
    )


def stable_id(prefix: str, *natural_key: Column) -> Column:
    """``prefix_`` and 16 hex digits that depend only on the natural key.

    A retried task yields the same id, which a random one would not.
    """
    digest = F.sha2(F.to_json(F.array(*[part.cast("string") for part in natural_key])), 256)
    return F.concat(F.lit(f"{prefix}_"), F.left(digest, F.lit(16)))
