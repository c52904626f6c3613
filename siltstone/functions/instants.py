"""Instants: the several spellings of one moment, as epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted spellings.
ZONED = r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{3}|\.\d{6})?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)"
BLANK = r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(\.\d{3}|\.\d{6})?"
EPOCH = r"\d{13}"
DAY_MS = 86_400_000


def instant_ms(text: Column) -> Column:
    """Epoch milliseconds (BIGINT) of an instant, NULL for anything that is none.

    Accepted: RFC 3339 text with ``Z`` or a numeric offset and 0, 3 or 6 fraction digits and a real date; the same with
    a blank instead of ``T`` and no zone, read as UTC; 13 digits, read as epoch milliseconds. A null, empty or any other
    text gives NULL. Digits beyond the millisecond are cut off. The session's time zone plays no part: the wall clock is
    read as UTC and the offset is taken off by arithmetic.
    """
    wall = F.unix_millis(F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8), F.lit("Z")).try_cast("timestamp"))
    fraction = F.when(F.substring(text, 20, 1) == ".", F.substring(text, 21, 3).try_cast("int")).otherwise(0)
    sign = F.substring(text, -6, 1)
    minutes = F.substring(text, -5, 2).try_cast("int") * 60 + F.substring(text, -2, 2).try_cast("int")
    offset = F.when(sign == "+", minutes).when(sign == "-", -minutes)
    zoned = F.when(F.substring(text, -1, 1) == "Z", F.lit(0)).otherwise(offset)
    return (
        F.when(text.rlike(rf"\A{EPOCH}\z"), text.try_cast("bigint"))
        .when(text.rlike(rf"\A{ZONED}\z"), wall + fraction - zoned * 60_000)
        .when(text.rlike(rf"\A{BLANK}\z"), wall + fraction)
    )


def utc_day(ms: Column) -> Column:
    """The UTC day (DATE) of epoch milliseconds; floors, so instants before 1970 fall on the right day."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / F.lit(DAY_MS)).cast("int"))


def duck_instant_ms(name: str) -> str:
    """The same reading in DuckDB's SQL, for the checks."""
    wall = f"epoch_ms(try_cast(substr({name}, 1, 10) || ' ' || substr({name}, 12, 8) as timestamp))"
    fraction = f"(case when substr({name}, 20, 1) = '.' then cast(substr({name}, 21, 3) as int) else 0 end)"
    minutes = f"(cast(substr({name}, -5, 2) as int) * 60 + cast(substr({name}, -2, 2) as int))"
    zoned = f"(case when {name} like '%Z' then 0 when substr({name}, -6, 1) = '+' then {minutes} else -{minutes} end)"
    return (
        f"(case when regexp_full_match({name}, '{EPOCH}') then cast({name} as bigint)"
        f" when regexp_full_match({name}, '{ZONED}') then {wall} + {fraction} - {zoned} * 60000"
        f" when regexp_full_match({name}, '{BLANK}') then {wall} + {fraction} end)"
    )
