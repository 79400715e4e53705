"""Dates and times written in article pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom import constants as K
from newsloom.functions.text import _col, strip

BYLINE_FORMATS = ("MMMM d, yyyy", "MMM d, yyyy", "yyyy-MM-dd", "MM/dd/yyyy")


def is_recent(date_text: Column | str, cutoff: str = K.CUTOFF_DATE) -> Column:
    """First ten characters as an ISO date, not before the cutoff."""
    d = F.substring(_col(date_text), 1, 10)
    iso = F.when(d.rlike(r"\A\d{4}-\d{1,2}-\d{1,2}\z"), d.try_cast("date"))
    return F.coalesce(iso >= F.lit(cutoff).cast("date"), F.lit(False))


def _parsed(c: Column, fmt: str) -> Column:
    return F.try_to_timestamp(c, F.lit(fmt))


def byline_date(c: Column | str, formats: tuple[str, ...] = BYLINE_FORMATS) -> Column:
    """ISO date of a byline in the first format that fits, else null."""
    return F.coalesce(*[F.date_format(_parsed(_col(c), f), "yyyy-MM-dd") for f in formats])


def meta_date(content: Column | str) -> Column:
    """Date part of a meta tag's value."""
    c = _col(content)
    return F.when(F.contains(c, F.lit("T")), F.split_part(c, F.lit("T"), F.lit(1))).otherwise(
        F.substring(c, 1, 10)
    )


def iso_or_text_date(content: Column | str) -> Column:
    """ISO date of a full ISO time stamp, else the stripped text itself."""
    c = _col(content)
    ok = c.rlike(r"\A\d{4}-\d{2}-\d{2}(?:[T ].*)?\z") & c.try_cast("timestamp").isNotNull()
    return F.when(ok, F.substring(c, 1, 10)).otherwise(strip(c))


def _utc_iso(local: Column, zone: Column | str) -> Column:
    return F.date_format(F.to_utc_timestamp(local, zone), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def eastern_to_utc(c: Column | str) -> Column:
    """``January 14, 2026 4:47 PM ET`` as ISO time in UTC."""
    bare = F.regexp_replace(_col(c), r"\s+[A-Z]{2}$", "")
    return _utc_iso(_parsed(bare, "MMMM d, yyyy h:mm a"), K.DEFAULT_ZONE)


def suffixed_to_utc(c: Column | str) -> Column:
    """``Feb. 9 2026 5:37PM EST`` (space before the time optional) in UTC."""
    t = strip(c)
    suffix = F.regexp_extract(t, r"\s+(EST|EDT|PST|PDT|CST|CDT|MST|MDT)$", 1)
    zone = F.lit(K.DEFAULT_ZONE)
    for name, tz in K.ZONE_SUFFIXES.items():
        zone = F.when(suffix == name, F.lit(tz)).otherwise(zone)
    bare = F.regexp_replace(t, r"\s+(?:EST|EDT|PST|PDT|CST|CDT|MST|MDT)$", "")
    spaced = F.regexp_replace(bare, r"^([A-Za-z]+)\. (\d{1,2}) (\d{4})\s*(\d{1,2}:.*)$", "$1 $2 $3 $4")
    local = F.coalesce(_parsed(spaced, "MMM d yyyy h:mm:ssa"), _parsed(spaced, "MMM d yyyy h:mma"))
    return _utc_iso(local, zone)


def last_modified(c: Column | str) -> Column:
    """Sitemap time stamp; unreadable ones are null and sort last."""
    return _col(c).try_cast("timestamp")
