"""Safe typing of raw text columns and of human-entered values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

# Accepted spellings of human-entered booleans.
TRUE_WORDS = ("1", "true", "t", "yes", "y")
FALSE_WORDS = ("0", "false", "f", "no", "n")


def strip(c: Column) -> Column:
    """Remove all leading and trailing white space, line breaks included."""
    return F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def as_long(c: Column) -> Column:
    """Integer id from text; ids exported as decimals ('5.0') are rounded, not lost."""
    return F.coalesce(c.try_cast("bigint"), c.try_cast("decimal(38,0)").try_cast("bigint"))


def as_int(c: Column) -> Column:
    return as_long(c).try_cast("int")


def as_double(c: Column) -> Column:
    """Number from text: decimal or with an exponent, infinities and not-a-number by name.

    A plain cast also takes suffixes and hexadecimal digits ('5f', '0x1p3').
    """
    plain = c.cast("string").rlike(r"(?i)^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf(inity)?|nan)\s*$")
    return F.when(plain, c.try_cast("double"))


def as_time(c: Column) -> Column:
    """Zone-free timestamp from text.

    A plain cast also accepts '2150' or '10:00'; only text that starts with a full date
    counts here.
    """
    text = c.cast("string")
    return F.when(text.rlike(r"^\s*\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp_ntz"))


_CASTS = {"bigint": as_long, "int": as_int, "double": as_double, "timestamp_ntz": as_time}


def typed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Cast the named text columns once, at the silver step.

    ``columns`` maps a column to 'bigint', 'int', 'double', 'timestamp_ntz' or 'string'.
    Columns that already have the wanted type are passed on untouched, so join keys stay
    bare and filters still reach the Parquet scan.
    """
    have = {field.name: field.dataType for field in df.schema.fields}
    out = []
    for name in df.columns:
        wanted = columns.get(name)
        if wanted is None or have[name].simpleString() == wanted:
            out.append(F.col(name))
        elif wanted == "string":
            out.append(F.col(name).cast("string").alias(name))
        elif isinstance(have[name], T.StringType):
            out.append(_CASTS[wanted](F.col(name)).alias(name))
        else:
            out.append(F.col(name).try_cast(wanted).alias(name))
    return df.select(*out)


def optional_column(df: DataFrame, names: str | tuple[str, ...], kind: str = "string") -> Column:
    """The first of ``names`` the frame has, else a typed NULL."""
    for name in (names,) if isinstance(names, str) else names:
        if name in df.columns:
            return df[name].cast(kind)
    return F.lit(None).cast(kind)


def lenient_bool(c: Column) -> Column:
    """Boolean from human spellings; NULL when the text is none of them."""
    word = F.lower(strip(c))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def confidence(c: Column) -> Column:
    """Number in [0, 1]; NULL when missing, unparsable or out of range."""
    value = as_double(strip(c))
    return F.when(value.between(0.0, 1.0), value)


_SPLIT = 134217729.0  # 2**27 + 1: cuts a double into two halves of 26 bits
_MILLION_HIGH = _SPLIT * 1e6 - (_SPLIT * 1e6 - 1e6)
_MILLION_LOW = 1e6 - _MILLION_HIGH


def round6(c: Column) -> Column:
    """Round to six decimals: the exact binary value, true ties to even.

    Stored times and rates are rounded this way.  ``round`` works on the shortest decimal
    text instead, which puts about half of the values that print as a tie (one in 54 of
    all second-level durations in days) on the other side.  The product's rounding error
    tells on which side of the tie the value really is.
    """
    product = c * F.lit(1e6)
    high = c * F.lit(_SPLIT) - (c * F.lit(_SPLIT) - c)
    low = c - high
    error = (
        (high * F.lit(_MILLION_HIGH) - product) + high * F.lit(_MILLION_LOW) + low * F.lit(_MILLION_HIGH)
    ) + low * F.lit(_MILLION_LOW)
    down = F.floor(product)
    part = product - down
    odd = F.pmod(down, F.lit(2)) == 1
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & odd)))
    return (down + up.cast("bigint")).cast("double") / F.lit(1e6)
