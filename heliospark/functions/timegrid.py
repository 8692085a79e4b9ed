"""Time parsing, the regular grid and circular averages, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heliospark.schema import SLOT, STEP

# An ISO offset at the end of a time of day: Z, +hh, +hhmm or +hh:mm.
OFFSET_PATTERN = r"\d{1,2}:\d{2}.*(Z|[+-]\d{2}(:?\d{2})?)\s*$"

# Below this mean resultant length opposite winds cancel and no direction is left.
_NO_DIRECTION = 1e-9


def grid_slot(ts: str | Column, step: str = STEP) -> Column:
    """Start of the grid interval that holds ``ts``; keeps timestamp_ntz."""
    return F.window(ts, step).start


def local_time(text: str | Column, site_tz: str | None = None) -> Column:
    """Text to the site's wall-clock time; NULL where the text is no time.

    Text with an offset is an instant and needs ``site_tz``; without one, the
    first such row fails the job rather than being read in a wrong zone.
    """
    col = F.col(text) if isinstance(text, str) else text
    if site_tz is None:
        instant = F.raise_error("times with an offset need site_tz").cast("timestamp_ntz")
    else:
        utc = from_epoch(F.unix_micros(F.try_to_timestamp(col)) / F.lit(1_000_000))
        instant = F.convert_timezone(F.lit("UTC"), F.lit(site_tz), utc)
    return F.when(col.rlike(OFFSET_PATTERN), instant).otherwise(col.try_cast("timestamp_ntz"))


def utc_offset(wall: str | Column, text: str | Column, site_tz: str | None = None) -> Column:
    """Seconds that the wall clock is ahead of UTC; 0 without ``site_tz``.

    In the hour that a clock change repeats, text with an offset tells the two
    instants apart; text without one is taken as one of them, the same always.
    """
    col = F.col(text) if isinstance(text, str) else text
    ts = F.col(wall) if isinstance(wall, str) else wall
    if site_tz is None:
        return F.lit(0).cast("long")
    given = from_epoch(F.unix_micros(F.try_to_timestamp(col)) / F.lit(1_000_000))
    meant = F.convert_timezone(F.lit(site_tz), F.lit("UTC"), ts)
    return wall_seconds(ts) - wall_seconds(F.when(col.rlike(OFFSET_PATTERN), given).otherwise(meant))


def circular_mean(degrees: str | Column) -> Column:
    """Mean direction in [0, 360), an aggregate; NULL where directions cancel."""
    col = F.col(degrees) if isinstance(degrees, str) else degrees
    east = F.avg(F.sin(F.radians(col)))
    north = F.avg(F.cos(F.radians(col)))
    angle = F.round(F.degrees(F.atan2(east, north)), 9)
    mean = F.when(angle < 0, angle + 360).otherwise(angle)
    return F.when(F.hypot(east, north) > _NO_DIRECTION, mean)


def seconds_of(step: str) -> int:
    """Length of a step such as ``5 minutes`` or ``1 hour``."""
    count, unit = step.split()
    lengths = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
    return int(count) * lengths[unit.rstrip("s")]


def wall_seconds(ts: str | Column = SLOT) -> Column:
    """Whole seconds of a wall-clock time since 1970, whatever the session's zone."""
    day = F.unix_date(F.to_date(ts)).cast("long")
    return day * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def from_epoch(seconds: Column) -> Column:
    """The inverse of :func:`wall_seconds`; keeps microseconds."""
    zero = F.lit(0)
    length = F.make_dt_interval(zero, zero, zero, seconds.cast("decimal(18,6)"))
    return F.lit("1970-01-01").cast("timestamp_ntz") + length


def days_before(ts: Column, days: int) -> Column:
    return ts - F.expr(f"interval {int(days)} days")


def days_after(ts: Column, days: int) -> Column:
    return ts + F.expr(f"interval {int(days)} days")
