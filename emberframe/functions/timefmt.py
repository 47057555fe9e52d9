"""ISO-8601 text: checks, local times with offsets, and file-safe forms."""

from __future__ import annotations

from datetime import datetime, tzinfo
from zoneinfo import ZoneInfo

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

_DAY, _MINUTE, _SECOND, _ZONE = r"[0-9]{4}(?:-[0-9]{2}){2}", r"[0-9]{2}:[0-9]{2}", r":[0-9]{2}(?:[.][0-9]+)?", r"Z|[+-][0-9]{2}:[0-9]{2}"


def is_iso8601(text: Column) -> Column:
    """Day, T, time to the minute or finer, and a zone or none: the accepted forms of the standard's time text. Digits are not checked against the calendar."""
    return text.rlike(rf"\A{_DAY}T{_MINUTE}(?:{_SECOND})?(?:{_ZONE})?\z")


def sanitize(text: Column) -> Column:
    """A timestamp fit for file names."""
    return F.translate(text, "-:", "__")


def instant(local: Column, zone: Column, pattern: str = "yyyyMMddHHmmss") -> Column:
    """The moment of a wall-clock text in a zone, so that differences are elapsed time across clock changes."""
    return F.to_utc_timestamp(F.to_timestamp(local, pattern), zone)


def minutes_since_first(moment: Column, station: str, *order: str) -> Column:
    """Minutes of a UTC moment since a station's first one, in the order given; a window over each station's own rows."""
    at = F.unix_micros(moment.cast("timestamp"))
    return (at - F.first(at).over(Window.partitionBy(station).orderBy(*order))) / 60e6


def iso_with_offset(moment: Column, zone: Column) -> Column:
    """ISO text of a UTC moment in a zone, with that zone's offset."""
    local = F.from_utc_timestamp(moment, zone)
    minutes = ((F.unix_timestamp(local) - F.unix_timestamp(moment)) / 60).cast("int")
    offset = F.format_string("%s%02d:%02d", F.when(minutes < 0, "-").otherwise("+"), F.floor(F.abs(minutes) / 60).cast("int"), F.abs(minutes) % 60)
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), offset)


def to_iso(moment: datetime, zone: str | tzinfo | None = None, seconds: bool = True) -> str:
    """ISO text of a Python datetime: zone is attached to a naive one and converts an aware one."""
    tz = ZoneInfo(zone) if isinstance(zone, str) else zone
    if moment.tzinfo is None and tz is None:
        raise ValueError("a naive datetime needs a zone")
    moved = moment.replace(tzinfo=tz) if moment.tzinfo is None else moment.astimezone(tz) if tz else moment
    return moved.isoformat(timespec="seconds" if seconds else "minutes")


def now_iso(zone: str | tzinfo | None = None) -> str:
    return to_iso(datetime.now().astimezone(), zone)
