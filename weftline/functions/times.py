"""Time formats as column expressions: offsets in seconds (double) or milliseconds (long), never intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def _digits(n: Column, size: int) -> Column:
    text = n.cast("string")
    return F.lpad(text, size, "0") if size else text


def clock(seconds: Column, mark: str) -> Column:
    """``HH:MM:SS``, the mark, and milliseconds, each part cut off, not rounded."""
    hours, minutes, rest = F.floor(seconds / 3600).cast("long"), F.floor((seconds % 3600.0) / 60).cast("long"), F.floor(seconds % 60.0).cast("long")
    ms = F.floor((seconds % 1.0) * 1000).cast("long")
    wide = lambda n: F.when(n < 100, _two(n)).otherwise(n.cast("string"))
    return F.concat(wide(hours), F.lit(":"), _two(minutes), F.lit(":"), _two(rest), F.lit(mark), _digits(ms, 3))


def _parts(ms: Column) -> tuple[Column, Column, Column, Column]:
    def div(a: Column, n: int) -> Column:
        return F.floor(a / n).cast("long")

    return div(ms, 3_600_000), div(ms % 3_600_000, 60_000), div(ms % 60_000, 1000), ms % 1000


def srt_time(ms: Column, mark: str = ",") -> Column:
    h, m, s, rest = _parts(ms)
    return F.concat(F.when(h < 100, _two(h)).otherwise(h.cast("string")), F.lit(":"), _two(m), F.lit(":"), _two(s), F.lit(mark), _digits(rest, 3))


def ass_time(ms: Column) -> Column:
    h, m, s, rest = _parts(ms)
    return F.concat(h.cast("string"), F.lit(":"), _two(m), F.lit(":"), _two(s), F.lit("."), _two(F.floor(rest / 10).cast("long")))


def srt_ms(text: Column) -> Column:
    """``HH:MM:SS,mmm`` as milliseconds; null on anything else."""
    ok = text.rlike(r"^\d+:\d+:\d+,\d+$")
    p = F.split(text, "[:,]")
    n = lambda i: F.get(p, F.lit(i)).cast("long")
    return F.when(ok, n(0) * 3_600_000 + n(1) * 60_000 + n(2) * 1000 + n(3))


def _sum_units(text: Column, units: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(rf"(\d+)([{units}])"), F.lit(0))
    factor = lambda x: F.when(F.endswith(F.lower(x), F.lit("h")), 3600).when(F.endswith(F.lower(x), F.lit("m")), 60).otherwise(1)
    return F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + F.regexp_extract(x, r"(\d+)", 1).cast("long") * factor(x))


def iso_duration(text: Column) -> Column:
    """``PT1H30M`` in seconds; nothing counted gives null. A number with another mark after it does not count."""
    total = _sum_units(F.regexp_replace(text, "^(?:PT)+", ""), "HMS")
    return F.when(total > 0, total)


def spoken_duration(text: Column) -> Column:
    """``1h30m``, ``90`` or ``1m30`` (digits at the end are seconds) in seconds; nothing counted gives null."""
    low = F.lower(F.trim(text))
    tail = F.regexp_extract(low, r"(\d+)$", 1)
    total = _sum_units(low, "hms") + F.when(F.length(tail) > 0, tail.cast("long")).otherwise(0)
    return F.when(total > 0, total)


def to_ms(seconds: Column) -> Column:
    """Milliseconds, cut off; what is negative is 0."""
    return F.greatest(F.lit(0).cast("long"), (seconds * 1000).cast("long"))


def day(seconds: Column) -> Column:
    """``YYYY-MM-DD`` in UTC of seconds since 1970; years beyond 9999 have more digits and no sign."""
    date = F.date_from_unix_date(F.floor(seconds / 86400).cast("int"))
    return F.concat(F.when(F.year(date) > 9999, F.year(date).cast("string")).otherwise(_digits(F.year(date), 4)), F.lit("-"), _two(F.month(date)), F.lit("-"), _two(F.dayofmonth(date)))


def episode_label(season: Column, episode: Column, seconds: Column) -> Column:
    return F.concat(F.lit("S"), season.cast("string"), F.lit("E"), episode.cast("string"), F.lit(" "), F.floor(seconds / 60).cast("long").cast("string"), F.lit(":"), _two(seconds % 60))
