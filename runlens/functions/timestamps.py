"""Log and sampler clocks, always UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Timestamp formats of log lines and of the event CSV.
LOG_FORMAT = "yyyy-MM-dd HH:mm:ss,SSS"
CSV_FORMAT = "yyyy-MM-dd HH:mm:ss.SSS"


def log_timestamp(text: Column) -> Column:
    """Null where the text is no valid date."""
    return F.try_to_timestamp(text, F.lit(LOG_FORMAT))


def format_millis(ts: Column) -> Column:
    return F.date_format(ts, CSV_FORMAT)


def dstat_epoch(text: Column, strict_compat: bool = False) -> Column:
    """Instant of a ``seconds.fraction`` epoch; null unless there is exactly one dot.

    ``strict_compat`` reads the fraction as a whole number of milliseconds ('.5' is 5 ms).
    """
    parts = F.split(text, r"\.")
    one_dot = F.size(parts) == 2
    if strict_compat:
        millis = parts[0].try_cast("bigint") * 1000 + parts[1].try_cast("smallint")
    else:
        millis = F.round(text.try_cast("decimal(20,6)") * 1000, 0).cast("bigint")
    return F.when(one_dot, F.timestamp_millis(millis))
