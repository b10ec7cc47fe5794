"""Text and date normalization as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The characters a Unicode-aware strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Accepted spellings of a reported boolean.
TRUE_WORDS = ("yes", "true", "1")
FALSE_WORDS = ("no", "false", "0")

_ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
_BASIC_DATE = r"^\d{8}$"
_WEEK_DATE = r"^(\d{4})-?W(0[1-9]|[1-4]\d|5[0-3])(?:-?([1-7]))?$"
_ISO_INSTANT = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,9})?)?)?"
_HOUR_ONLY = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2})(Z|[+-]\d{2}:?\d{2})$"
_MINUTE_ONLY = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})(Z|[+-]\d{2}:?\d{2})$"
_OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"


def strip(c: Column) -> Column:
    """Remove leading and trailing Unicode whitespace."""
    return F.btrim(c, F.lit(WHITESPACE))


def clean_text(c: Column) -> Column:
    """Stripped text; blank becomes NULL."""
    return F.nullif(strip(c.cast("string")), F.lit(""))


def to_bool(c: Column) -> Column:
    """yes/true/1 and no/false/0 in any case; anything else is NULL."""
    word = F.lower(strip(c.cast("string")))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def iso_date(c: Column) -> Column:
    """Strict date from `YYYY-MM-DD`, `YYYYMMDD` or an ISO week date, else NULL."""
    return (
        F.when(c.rlike(_ISO_DATE), c.try_cast("date"))
        .when(
            c.rlike(_BASIC_DATE),
            F.concat_ws("-", c.substr(1, 4), c.substr(5, 2), c.substr(7, 2)).try_cast("date"),
        )
        .when(c.rlike(_WEEK_DATE), week_date(c))
    )


def week_date(c: Column) -> Column:
    """Date of `YYYY-Www` or `YYYY-Www-D` (Monday if no day is given); NULL for a week 53 that a
    year does not have."""
    year, week = (F.regexp_extract(c, _WEEK_DATE, i).try_cast("int") for i in (1, 2))
    day = F.coalesce(F.nullif(F.regexp_extract(c, _WEEK_DATE, 3), F.lit("")).try_cast("int"), F.lit(1))
    # Week 1 holds January 4th; weeks start on Monday (0).
    fourth = F.make_date(year, F.lit(1), F.lit(4))
    found = F.date_add(fourth, (week - 1) * 7 + day - 1 - F.weekday(fourth))
    return F.when(F.weekofyear(found) == week, found)


def instant_utc_date(c: Column) -> Column:
    """UTC calendar date of an ISO instant (no offset means UTC), else NULL."""
    has_offset = c.rlike(_OFFSET)
    zoned = F.when(has_offset, c).otherwise(F.concat(c, F.lit("Z")))
    minutes = F.regexp_replace(zoned, _HOUR_ONLY, "$1:00$2")
    body = F.regexp_replace(minutes, _MINUTE_ONLY, "$1:00$2")
    seconds = F.unix_seconds(
        F.when(body.rlike(_ISO_INSTANT + _OFFSET), body).try_cast("timestamp")
    )
    # Integer days keep the result independent of the session time zone.
    return F.date_from_unix_date(F.floor(seconds / F.lit(86400)).cast("int"))


def normalize_source_date(c: Column) -> Column:
    """ISO date text of a source date; malformed text is kept verbatim."""
    raw = clean_text(c)
    parsed = F.when(F.contains(raw, F.lit("T")), instant_utc_date(raw)).otherwise(
        iso_date(F.left(raw, F.lit(10)))
    )
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), raw)


def utc_date(c: Column) -> Column:
    """Strict UTC date: blank is NULL, malformed text fails the job."""
    raw = clean_text(c)
    parsed = F.coalesce(iso_date(raw), instant_utc_date(raw))
    failure = F.raise_error(F.concat(F.lit("malformed ISO date: "), raw)).cast("date")
    return F.when(raw.isNotNull() & parsed.isNull(), failure).otherwise(parsed)


def is_ascii(c: Column) -> Column:
    return F.length(c) == F.octet_length(c)


def _compat_fold_udf():
    def fold(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            return " ".join(unicodedata.normalize("NFKC", text).casefold().split())

        return texts.map(one)

    return F.pandas_udf(fold, StringType())


def folded_text(c: Column) -> Column:
    """NFKC, casefold, whitespace runs collapsed to one space.

    ASCII text never leaves the JVM: only rows that need Unicode folding are
    shipped to the Arrow function, the others send it a NULL.
    """
    ascii_form = F.trim(F.regexp_replace(F.lower(c), r"[\s\x1c-\x1f]+", " "))
    other_form = _compat_fold_udf()(F.when(~is_ascii(c), c))
    return F.when(is_ascii(c), ascii_form).otherwise(other_form)


def narrative_group(c: Column) -> Column:
    """Identity of a narrative up to case, width and whitespace."""
    return F.sha2(folded_text(c), 256)


def _strip_accents_udf():
    def plain(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            split = unicodedata.normalize("NFKD", text)
            return "".join(c for c in split if not unicodedata.combining(c))

        return texts.map(one)

    return F.pandas_udf(plain, StringType())


def accent_free(c: Column) -> Column:
    """Lower case without accents; ASCII text stays in the JVM."""
    lowered = F.lower(c)
    other_form = _strip_accents_udf()(F.when(~is_ascii(c), lowered))
    return F.when(is_ascii(c), lowered).otherwise(other_form)


# Letters, digits and underscore, two or more in a row.
_WORD = r"[\p{L}\p{N}_]{2,}"


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(_WORD), F.lit(0))


def with_bigrams(tokens: Column) -> Column:
    """Tokens followed by pairs of neighbours joined by a space."""
    pairs = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.concat(
        tokens,
        F.zip_with(
            F.slice(tokens, F.lit(1), pairs),
            F.slice(tokens, F.lit(2), pairs),
            lambda a, b: F.concat(a, F.lit(" "), b),
        ),
    )
