"""Times in any of the notations collectors use, as UTC timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def coerce_ts(text: Column) -> Column:
    """Seconds, ms, us or ns since 1970 by magnitude, or a date and time with - or /, blank or T.

    Without an offset the time is UTC. Null and unreadable text give null.
    """
    t = F.trim(text)
    n = t.try_cast("double")
    micros = F.when(F.abs(n) >= 1e17, n / 1000).when(F.abs(n) >= 1e14, n).when(F.abs(n) >= 1e11, n * 1000).otherwise(n * 1000000)
    iso = F.regexp_replace(F.regexp_replace(t, "/", "-"), r"^(\d{4}-\d{1,2}-\d{1,2})[tT ]+", "$1 ")
    zoned = F.when(iso.rlike(r"(?:[zZ]|UTC|GMT|[+-]\d{2}:?\d{0,2})$") & iso.contains(":"), F.regexp_replace(iso, r"([+-]\d{2})(\d{2})$", "$1:$2")).otherwise(F.concat(iso, F.lit("Z")))
    zoned = F.when(iso.contains(":"), zoned).otherwise(F.concat(iso, F.lit(" 00:00:00Z")))
    return F.when(n.isNotNull(), F.timestamp_micros(micros.cast("long"))).when(iso.rlike(r"^\d{4}-\d{1,2}-\d{1,2}( |$)"), zoned.try_cast("timestamp"))
