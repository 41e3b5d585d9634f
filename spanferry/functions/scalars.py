"""Scalar expressions; all of them stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# A date, or a date and time with optional seconds, fraction and offset.
_DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}$"
_DATETIME_PATTERN = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?(Z|[+-]\d{2}:?\d{2}(:\d{2})?)?$"
_HAS_OFFSET = r"(Z|[+-]\d{2}:?\d{2}(:\d{2})?)$"

CURSOR_CHARS = 16
VALUE_CHARS = 160


def canonical_ts(col: Column, strict: bool = True) -> Column:
    """ISO-8601 text as a UTC text ending in ``Z``; a date is midnight, a time without offset is UTC.

    The fraction is written with six digits and left out when zero. Blank or invalid input raises, or
    gives null when ``strict`` is false.
    """
    text = F.trim(col)
    timed = F.regexp_replace(F.replace(text, F.lit(","), F.lit(".")), r"^(.{16})(Z|[+-].*)?$", r"$1:00$2")
    zoned = F.when(text.rlike(_HAS_OFFSET), timed).otherwise(F.concat(timed, F.lit("Z")))
    well_formed = F.when(text.rlike(_DATE_PATTERN), F.concat(text, F.lit("T00:00:00Z"))).when(
        text.rlike(_DATETIME_PATTERN), zoned
    )
    micros = F.unix_micros(well_formed.try_cast("timestamp"))
    # Built from the epoch so that the text is UTC whatever the session's zone is.
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(micros / F.lit(86_400_000_000)).cast("int"))
    left = F.pmod(micros, F.lit(86_400_000_000))
    seconds = F.floor(left / F.lit(1_000_000)).cast("long")
    fraction = F.pmod(left, F.lit(1_000_000))

    def two(value: Column) -> Column:
        return F.lpad(value.cast("long").cast("string"), 2, "0")

    clock = F.concat_ws(":", two(F.floor(seconds / 3600)), two(F.pmod(F.floor(seconds / 60), F.lit(60))), two(F.pmod(seconds, F.lit(60))))
    tail = F.when(fraction == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lpad(fraction.cast("string"), 6, "0")))
    canonical = F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), clock, tail, F.lit("Z"))
    if not strict:
        return canonical
    message = F.concat(F.lit("invalid date: "), F.coalesce(col, F.lit("null")))
    return F.coalesce(canonical, F.raise_error(message).cast("string"))


def norm_email(col: Column) -> Column:
    """Lower-cased and trimmed; blank becomes null."""
    return F.nullif(F.lower(F.trim(col)), F.lit(""))


def short_cursor(col: Column) -> Column:
    """The first 16 characters and an ellipsis, which is always appended; null stays null."""
    return F.concat(F.substring(col, 1, CURSOR_CHARS), F.lit("…"))


def reason_words(col: Column) -> Column:
    """``already_migrated`` as ``already migrated``."""
    return F.replace(col, F.lit("_"), F.lit(" "))


def reason_label(col: Column) -> Column:
    """A reason code as a heading: every run of letters is capitalised, also after digits and signs."""
    runs = F.regexp_extract_all(reason_words(col), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def truncate_value(col: Column, n: int = VALUE_CHARS) -> Column:
    """Text of more than ``n`` characters cut to ``n`` including a closing ``...``."""
    return F.when(F.char_length(col) > n, F.concat(F.substring(col, 1, n - 3), F.lit("..."))).otherwise(col)
