"""Reading the store's mixed time spellings with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions.text import let

#: Date with '-' or '/', or compact; a time part down to minutes, seconds or fractions; an offset or Z. Groups: year,
#: month, day, hour, minute, second, fraction, sign and two parts of the offset.
SPELLING = (
    r"^(?<y>\d{4})(?<sep>[-/]?)(?<mo>\d{2})\k<sep>(?<d>\d{2})"
    r"(?:[T ](?<h>\d{2})(?<colon>:?)(?<mi>\d{2})(?:\k<colon>(?<s>\d{2})(?<f>(?<=:\d{2})[.]\d{1,9})?)?)?"
    r" ?(?:[Zz]|(?<sign>[+-])(?<oh>\d{2}):?(?<om>\d{2})?)?$"
)
_PARTS = "\u0001${y}-${mo}-${d}|${h}|${mi}|${s}|${f}|${sign}|${oh}|${om}"
_BLANKS = " \t\r\n\u00a0"


def parse_micros(text: Column) -> Column:
    """Microseconds since the epoch in UTC, or null where the text is no real time.

    No offset means UTC, a date alone its midnight. Days that don't exist (30 February) give null. The text is read
    by one pattern, once.
    """

    def micros(parts: Column) -> Column:
        # a nought before the digits: an empty part is 0, and no failed cast is paid for
        number = lambda i: F.concat(F.lit("0"), parts[i]).cast("bigint")
        day = F.unix_date(F.substring(parts[0], 2, 10).try_cast("date")).cast("bigint")
        h, mi, s, oh, om = (number(i) for i in (1, 2, 3, 6, 7))
        offset = (oh * 60 + om) * F.when(parts[5] == "-", -1).otherwise(1)
        fraction = F.rpad(F.substring(parts[4], 2, 6), 6, "0").cast("bigint")
        real = (h < 24) & (mi < 60) & (s < 60) & (oh <= 18) & (om < 60)
        return F.when(parts[0].startswith("\u0001"), F.when(real, (((day * 24 + h) * 60 + mi - offset) * 60 + s) * 1_000_000 + fraction))

    return let(F.split(F.regexp_replace(F.btrim(text, F.lit(_BLANKS)), SPELLING, _PARTS), r"\|"), micros)


def micros_of(ts: Column) -> Column:
    """Microseconds of a TIMESTAMP_NTZ meaning UTC, whatever the session's zone is."""
    return F.unix_micros(F.to_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def text_of(us: Column) -> Column:
    """'yyyy-MM-dd HH:mm:ss' in UTC."""
    return F.date_format(ntz_of(us), "yyyy-MM-dd HH:mm:ss")


def ntz_of(us: Column) -> Column:
    """TIMESTAMP_NTZ of microseconds since the epoch."""
    return F.timestamp_add("MICROSECOND", us, F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")))
