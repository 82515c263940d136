"""Keys, dates and availability rules. Times are UTC; the races run in Japan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Tokyo"
POOL_SIZES = {"win": 6, "place": 6, "exacta": 30, "quinella": 15, "trifecta": 120, "trio": 20, "wide": 15}


def race_key(day: Column, venue: Column, number: Column) -> Column:
    """YYYY-MM-DD-VV-NN."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat_ws("-", F.date_format(day, "yyyy-MM-dd"), two(venue), two(number))


def valid_key(venue: Column, number: Column) -> Column:
    """Venue 1..24 and race 1..12, both present."""
    return F.coalesce(venue.cast("int").between(1, 24) & number.cast("int").between(1, 12), F.lit(False))


def deadline(day: Column, clock: Column) -> Column:
    """Date and local HH:MM to UTC; null if the clock is none."""
    return F.to_utc_timestamp(F.try_to_timestamp(F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), clock), F.lit("yyyy-MM-dd HH:mm")), ZONE)


def card_available(day: Column) -> Column:
    return F.to_utc_timestamp(day.cast("timestamp"), ZONE)


def next_day_available(day: Column) -> Column:
    """Results and weather: midnight after the day."""
    return F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), ZONE)


def period_available(year: Column, half: Column) -> Column:
    """First of January (half 1) or July (half 2)."""
    return F.to_utc_timestamp(F.make_date(year, F.when(half == 1, 1).otherwise(7), F.lit(1)).cast("timestamp"), ZONE)


def for_display(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, ZONE)


def filename_date(name: Column) -> Column:
    """The date of kYYMMDD or bYYMMDD."""
    return F.try_to_timestamp(F.concat(F.lit("20"), F.substring(name, 2, 6)), F.lit("yyyyMMdd")).cast("date")


def month(day: Column) -> Column:
    return F.trunc(day, "month")


def month_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def series_start(day: Column, counter: Column) -> Column:
    return F.date_sub(day, counter - 1)


def combination(*lanes: Column, ordered: bool = True) -> Column:
    """"a-b-c", as given or ascending."""
    if ordered:
        return F.concat_ws("-", *[c.cast("string") for c in lanes])
    return F.array_join(F.transform(F.array_sort(F.array(*[c.cast("int") for c in lanes])), lambda x: x.cast("string")), "-")


def code(*lanes: Column) -> Column:
    """10a + b, 100a + 10b + c."""
    out = F.lit(0)
    for c in lanes:
        out = out * 10 + c
    return out


def decode(value: Column, n: int) -> list[Column]:
    return [F.floor(value / 10 ** (n - 1 - k)) % 10 for k in range(n)]


def valid_code(value: Column, n: int) -> Column:
    lanes = F.array(*decode(value, n))
    return F.forall(lanes, lambda x: x.between(1, 6)) & (F.size(F.array_distinct(lanes)) == n)
