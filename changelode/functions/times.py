"""Times written in several spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_time(c: Column) -> Column:
    """An ISO 8601 time as TIMESTAMP (UTC unless it names a zone); null where it is none.

    Accepts a blank or ``T`` between date and time, fractions of any length (cut to
    microseconds), ``Z``, ``+hh:mm``, ``+hhmm`` and ``+hh``, a bare date, and outer white space.
    """
    s = F.btrim(c, F.lit(" \t\r\n"))
    s = F.regexp_replace(s, r"^(\d{4}-\d{2}-\d{2})[ tT]+(?=\d)", "$1T")
    s = F.regexp_replace(s, r"(\.\d{6})\d+", "$1")
    s = F.regexp_replace(s, r"(T[\d:.]+)\s*[zZ]$", "$1+00:00")
    s = F.regexp_replace(s, r"(T[\d:.]+)\s*([+-]\d{2}):?(\d{2})$", "$1$2:$3")
    s = F.regexp_replace(s, r"(T[\d:.]+)\s*([+-]\d{2})$", "$1$2:00")
    return s.try_cast("timestamp")


def exact_time(t: Column) -> Column:
    """A TIMESTAMP as ISO 8601 text in UTC, with as many digits of a fraction as it needs."""
    micros = F.unix_micros(t)
    rest = F.pmod(micros, F.lit(1_000_000))
    fraction = F.when(rest == 0, "").otherwise(F.concat(F.lit("."), F.regexp_replace(F.lpad(rest.cast("string"), 6, "0"), "0+$", "")))
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))
