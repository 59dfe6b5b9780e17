"""Scalar Column expressions (all JVM-side, inside whole-stage codegen; no Python UDF)."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C

INT_MIN, INT_MAX = -(2 ** 31), 2 ** 31 - 1
TWO_POW_32 = 4294967296.0
TIME_MIN_MS, TIME_MAX_MS = -62135596800000, 253402300700000   # years 1 to 9999


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# A string whose first character after leading blanks/control characters is a letter that cannot
# start a number ("inf"/"infinity"/"nan" aside), or that is blank, can never parse as a double.
NOT_A_NUMBER = r"^[\x00-\x20]*($|[a-hj-mo-zA-HJ-MO-Z]|[iI](?![nN][fF])|[nN](?![aA][nN]))"


def to_double(c, source_type: T.DataType | None = None) -> Column:
    """Cast to double; a value that does not parse becomes null (ANSI casts would raise).

    For strings, values that plainly are not numbers are nulled by a cheap anchored regex first:
    a failing parse costs an exception per row, which made categorical columns ~5x slower.
    """
    x = col_(c)
    if isinstance(source_type, (T.StringType, T.VarcharType, T.CharType)):
        return F.when(~x.rlike(NOT_A_NUMBER), x.try_cast(T.DoubleType()))
    return x.try_cast(T.DoubleType())


def binarize_status(c) -> Column:
    """Status code -> label: 0.0 (suspect) for codes 2 and 66 (bit 64 ignored) and codes >= 128, else 1.0.

    Works on the double value: the integer part must be 2 or 66, or the value at least 128.
    This equals ``((int) v & ~64) == 2 || (int) v >= 128`` for every finite v without an
    integer cast (which overflows under ANSI); NaN is normal, null stays null.
    """
    v = col_(c).cast("double")
    codes = (C.STATUS_SUSPECT, C.STATUS_SUSPECT | C.STATUS_IGNORED_BIT)
    suspect = (v >= C.STATUS_SUSPECT_FROM) & ~F.isnan(v)
    for code in codes:
        suspect = suspect | ((v >= code) & (v < code + 1))
    return F.when(v.isNull(), F.lit(None).cast("double")).when(suspect, C.LABEL_SUSPECT).otherwise(C.LABEL_NORMAL)


def key_part(c) -> Column:
    """One key column as text that no other value can produce: its length before it, `~` for null."""
    text = col_(c).cast("string")
    return F.coalesce(F.concat(F.char_length(text).cast("string"), F.lit(":"), text), F.lit("~"))


def md5_hex(key_cols, seed: int, name: str) -> Column:
    """Hex digest of (key columns, seed, name). Null-safe, and no separator can be forged by a value."""
    parts = [key_part(k) for k in key_cols] + [F.lit(str(seed)), F.lit(name)]
    return F.md5(F.concat_ws("|", *parts))


def row_key(df) -> list:
    """A key of every row when the caller names none: all its columns and its place in the scan, so that rows
    equal in any subset of columns, or in all, still draw separately. Arrays and the like go in by hash."""
    simple = (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    keys = [F.col(f"`{f.name}`") if isinstance(f.dataType, simple) else F.hash(F.col(f"`{f.name}`"))
            for f in df.schema.fields if not isinstance(f.dataType, (T.UserDefinedType, T.MapType))]
    return keys + [F.monotonically_increasing_id()]


def hex_word(digest: Column, slot: int) -> Column:
    """The 32-bit word `slot` (0..3) of an md5 hex digest, as 8 lowercase hex characters."""
    return F.substring(digest, 1 + 8 * slot, 8)


def unit_draw(digest: Column, slot: int) -> Column:
    """Uniform draw in [0, 1) from the 32-bit word `slot` (0..3) of an md5 hex digest.

    A pure function of the row key: independent of partitioning, task retries and recomputation.
    """
    return F.conv(hex_word(digest, slot), 16, 10).cast("bigint") / F.lit(TWO_POW_32)


def _threshold(fraction: float) -> int:
    return math.ceil(fraction * TWO_POW_32)


def word_below(word: Column, fraction: float) -> Column:
    """`unit value of word < fraction`, decided on the hex text itself.

    Fixed-width lowercase hex sorts like its number, and v / 2^32 < f  <=>  v < ceil(f * 2^32)
    exactly (the scaling by 2^32 is exact in binary), so no hex-to-number conversion is needed.
    """
    t = _threshold(fraction)
    if t <= 0:
        return F.lit(False)
    if t >= 1 << 32:
        return F.lit(True)
    return word < F.lit(f"{t:08x}")


def word_bucket(word: Column, k: int) -> Column:
    """floor(unit value * k) for a word, by k-1 text comparisons (exact, see `word_below`)."""
    out = F.lit(0)
    for j in range(1, k):
        out = out + (~word_below(word, j / k)).cast("int")
    return out


def trunc_to_int(c) -> Column:
    """Java-style (int) of a double: truncate toward zero, saturate at the int range, NaN -> 0."""
    v = col_(c)
    clamped = F.least(F.greatest(v, F.lit(float(INT_MIN))), F.lit(float(INT_MAX)))
    return F.when(F.isnan(v), F.lit(0)).otherwise(clamped.cast("int"))


def epoch_millis(c, data_type: T.DataType) -> Column:
    """Epoch milliseconds of a time column, independent of the session time zone.

    A TIMESTAMP is an instant (unix_millis). A TIMESTAMP_NTZ is a wall-clock reading taken as UTC:
    its millisecond distance from the NTZ epoch, so no cast through the session zone is involved.
    Whole milliseconds are kept (sub-millisecond digits are dropped, as unix_millis does).
    """
    x = col_(c)
    if isinstance(data_type, T.TimestampNTZType):
        return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), x)
    if isinstance(data_type, T.TimestampType):
        return F.unix_millis(x)
    if isinstance(data_type, T.DateType):
        return F.unix_date(x).cast("bigint") * F.lit(86400000)
    return x.cast("bigint")


def time_at_most(c, data_type: T.DataType, epoch_ms: int) -> Column:
    """`epoch_millis(c) <= epoch_ms`, written as a comparison of the column itself with a literal of its own
    type, so that it reaches the scan (pushed filters, partition pruning)."""
    x = col_(c)
    if not isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return x <= F.lit(int(epoch_ms))
    epoch_ms = min(max(int(epoch_ms), TIME_MIN_MS), TIME_MAX_MS)
    after = dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=int(epoch_ms) + 1)
    if isinstance(data_type, T.TimestampNTZType):
        return x < F.lit(after.isoformat(sep=" ")).cast("timestamp_ntz")
    if isinstance(data_type, T.TimestampType):
        return x < F.lit(after.replace(tzinfo=dt.timezone.utc))
    return x <= F.lit((dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=int(epoch_ms))).date())


def negate_int(c) -> Column:
    """Java int negation: MIN_INT stays itself instead of overflowing."""
    v = col_(c)
    return F.when(v == F.lit(INT_MIN), v).otherwise(-v)


def row_min(cols) -> Column:
    """Null-skipping minimum over columns of one row (all null -> null)."""
    return F.least(*[col_(c).cast("double") for c in cols]) if len(cols) > 1 else col_(cols[0]).cast("double")


def row_max(cols) -> Column:
    return F.greatest(*[col_(c).cast("double") for c in cols]) if len(cols) > 1 else col_(cols[0]).cast("double")


def is_finite(c) -> Column:
    v = col_(c)
    return ~F.isnan(v) & (v != F.lit(float("inf"))) & (v != F.lit(float("-inf")))
