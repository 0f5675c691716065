"""Time arithmetic on zone-free timestamps and lenient time parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stayline.functions.typing import strip

_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?([+-]\d{2}:?\d{2})?)?$"
_PLAIN = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}$"
_HUMAN = r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{1,2}(:\d{1,2})?$"
_OFFSET = r"^\d{4}-\d{2}-\d{2}[T ][\d:.,]+([+-])(\d{2}):?(\d{2})$"


def seconds_between(start: Column, end: Column) -> Column:
    """Signed seconds from ``start`` to ``end`` with microsecond precision.

    The interval itself is cast, so no session time zone is involved and nothing is
    truncated to whole units.
    """
    gap = (end - start).cast("interval second").cast("decimal(20,6)")
    return gap.cast("double")


def hours_between(start: Column, end: Column) -> Column:
    return seconds_between(start, end) / F.lit(3600.0)


def days_between(start: Column, end: Column) -> Column:
    return seconds_between(start, end) / F.lit(86400.0)


def add_hours(ts: Column, hours: Column | float) -> Column:
    """Move a time by a signed, possibly fractional, number of hours."""
    amount = hours if isinstance(hours, Column) else F.lit(float(hours))
    seconds = (amount * F.lit(3600.0)).cast("decimal(18,6)")
    zero = F.lit(0)
    return ts + F.make_dt_interval(zero, zero, zero, seconds)


def study_window(anchor: Column, hours_before: float, hours_after: float) -> tuple[Column, Column]:
    """Closed window bounds around an anchor time."""
    return add_hours(anchor, -hours_before), add_hours(anchor, hours_after)


def earliest(*times: Column) -> Column:
    """Earliest non-NULL time.

    A date-only value is midnight, so it wins over an exact time on the same day.
    """
    return F.least(*times) if len(times) > 1 else times[0]


def lenient_time(c: Column) -> Column:
    """Second-level time from ISO-like text; NULL when it cannot be read.

    A trailing ``Z`` or offset is converted to UTC and the zone dropped.  The plain form
    is read directly; only other spellings pay for the closer look.
    """
    text = strip(c)
    plain = text.rlike(_PLAIN)
    zoned_text = _with_offset(text)
    tail = F.right(F.replace(F.right(zoned_text, F.lit(6)), F.lit(":"), F.lit("")), F.lit(5))
    sign = F.when(F.left(tail, F.lit(1)) == "-", F.lit(-1)).otherwise(F.lit(1))
    offset = F.make_dt_interval(
        F.lit(0),
        sign * F.substring(tail, 2, 2).try_cast("int"),
        sign * F.substring(tail, 4, 2).try_cast("int"),
    )
    naive = F.regexp_replace(zoned_text, r"[+-]\d{2}:?\d{2}$", "")
    return (
        F.when(plain, text.try_cast("timestamp_ntz"))
        .when(zoned_text.rlike(_OFFSET), F.when(zoned_text.rlike(_ISO), _whole_seconds(naive) - offset))
        .when(text.rlike(_ISO) | text.rlike(_HUMAN), _whole_seconds(text))
    )


def _with_offset(text: Column) -> Column:
    return F.replace(text, F.lit("Z"), F.lit("+00:00"))


def _whole_seconds(naive: Column) -> Column:
    """Cast without fractions; a bare hour gets its minutes."""
    seconds = F.regexp_replace(naive, r"[.,]\d+$", "")
    complete = F.when(seconds.rlike(r"[T ]\d{2}$"), F.concat(seconds, F.lit(":00"))).otherwise(seconds)
    return complete.try_cast("timestamp_ntz")


def has_offset(c: Column) -> Column:
    """True when the time text carries a zone, which label artifacts keep as UTC."""
    return _with_offset(strip(c)).rlike(_OFFSET)


def time_text(ts: Column) -> Column:
    """Second-level text of a time, as written to artifacts (fractions are cut)."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def label_time_text(c: Column) -> Column:
    """Normalised time text of a label field; zoned input keeps a ``+00:00`` suffix."""
    text = time_text(lenient_time(c))
    return F.when(has_offset(c), F.concat(text, F.lit("+00:00"))).otherwise(text)


def shift_label(hours: Column) -> Column:
    """Stable name of a signed shift: ``minus3h``, ``plus0p5h``."""
    size = F.abs(hours)
    whole = size == F.floor(size)
    digits = F.when(whole, size.cast("bigint").cast("string")).otherwise(
        F.replace(size.cast("string"), F.lit("."), F.lit("p"))
    )
    return F.concat(F.when(hours < 0, F.lit("minus")).otherwise(F.lit("plus")), digits, F.lit("h"))
