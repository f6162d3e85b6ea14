"""Times as whole milliseconds since 1970."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def millis(ts: Column) -> Column:
    """Milliseconds on the clock that the timestamp shows: the same in every session time zone."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1000 + F.floor(F.extract(F.lit("SECOND"), ts) * 1000).cast("long")
