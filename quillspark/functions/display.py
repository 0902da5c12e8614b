"""Sizes, counts and times as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_YEAR_SECONDS = 6 * 30 * 86_400


def _whole(x: Column) -> Column:
    return F.floor(x).cast("long").cast("string")


def size_text(n: Column) -> Column:
    """Bytes as "n B", or KB, MB and GB with one digit; what lies halfway goes to the even digit, as in C and Rust, where Java's formats go up."""

    def unit(power: int, name: str) -> Column:
        bits, half = 10 * power, 1 << (10 * power - 1)
        whole, parts = F.shiftright(n.cast("long"), bits), n.cast("long").bitwiseAND(2 * half - 1) * 10
        tenths, rest = whole * 10 + F.shiftright(parts, bits), parts.bitwiseAND(2 * half - 1)
        tenths = tenths + ((rest > half) | ((rest == half) & (tenths % 2 == 1))).cast("long")
        return F.concat(_whole(tenths / 10), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {name}"))

    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, unit(1, "KB")).when(n < 1024**3, unit(2, "MB")).otherwise(unit(3, "GB"))


def count_text(n: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(n, 0)


def duration_text(seconds: Column) -> Column:
    """Seconds as "Ns", "Nm Ns" or "Nh Nm"."""
    s = lambda x: F.round(x).cast("long").cast("string")
    minutes = F.concat(_whole(seconds / 60), F.lit("m "), s(seconds % 60), F.lit("s"))
    hours = F.concat(_whole(seconds / 3600), F.lit("h "), _whole((seconds % 3600) / 60), F.lit("m"))
    return F.when(seconds < 60, F.concat(s(seconds), F.lit("s"))).when(seconds < 3600, minutes).otherwise(hours)


def epoch_of(rfc3339: Column) -> Column:
    """Seconds since 1970 of the first 19 characters of a timestamp; null if they are none."""
    return F.unix_timestamp(F.try_to_timestamp(F.left(F.replace(rfc3339, F.lit("T"), F.lit(" ")), F.lit(19)), F.lit("yyyy-MM-dd HH:mm:ss")))


def ago_text(rfc3339: Column, now: Column) -> Column:
    """How long ago, in the largest whole unit; "never" for no timestamp.  ``now`` is in seconds since 1970."""
    gone = now - epoch_of(rfc3339)
    part = lambda unit, name: F.concat((gone / unit).cast("long").cast("string"), F.lit(f"{name} ago"))
    return F.when(gone.isNull(), "never").when(gone < 60, part(1, "s")).when(gone < 3600, part(60, "m")).when(gone < 86_400, part(3600, "h")).otherwise(part(86_400, "d"))


def listing_time(rfc3339: Column, now: Column) -> Column:
    """Month and day with the time, or with the year if that is over half a year ago; "?" for no timestamp."""
    at = F.timestamp_seconds(epoch_of(rfc3339))
    day = F.concat(F.date_format(at, "MMM"), F.lit(" "), F.lpad(F.dayofmonth(at).cast("string"), 2, " "))
    old = F.concat(day, F.lit("  "), F.year(at).cast("string"))
    return F.when(at.isNull(), "?").when(now - epoch_of(rfc3339) > HALF_YEAR_SECONDS, old).otherwise(F.concat(day, F.date_format(at, " HH:mm")))


def model_text(model: Column) -> Column:
    """A model's name: the last segment of a hub address, else at most 56 characters."""
    last = F.substring_index(model, "/", -1)
    return F.when(model.startswith("hf:"), F.when(last == "", model).otherwise(last)).when(F.length(model) > 56, F.concat(F.left(model, F.lit(53)), F.lit("..."))).otherwise(model)
