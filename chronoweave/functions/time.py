"""Column expressions over timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_utc(ts: Column) -> Column:
    """ISO text of a UTC instant; the fraction only when there is one."""
    ts = ts.cast("timestamp")
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    has_fraction = F.pmod(F.unix_micros(ts), F.lit(1_000_000)) != 0
    return F.concat(F.when(has_fraction, micros).otherwise(whole), F.lit("+00:00"))
