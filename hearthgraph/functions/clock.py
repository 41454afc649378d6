"""Calendar days and wall times in the owner's zone; the session zone itself stays UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def local_day(instant: Column, zone: Column | str) -> Column:
    """Calendar day of an instant as seen on a clock in `zone`."""
    return F.to_date(F.from_utc_timestamp(instant.cast("timestamp"), zone))


def wall_to_instant(wall: Column, zone: Column | str) -> Column:
    """Instant of a wall time in `zone`, its offset taken at that very instant."""
    return F.to_utc_timestamp(wall.cast("timestamp"), zone)


def with_offset(instant: Column, zone: Column | str) -> Column:
    """ISO text of an instant on a clock in `zone`, with milliseconds and offset."""
    local = F.from_utc_timestamp(instant.cast("timestamp"), zone)
    minutes = ((F.unix_micros(local) - F.unix_micros(instant.cast("timestamp"))) / 60000000).cast("int")
    sign = F.when(minutes >= 0, "+").otherwise("-")
    hh = F.lpad((F.abs(minutes) / 60).cast("int").cast("string"), 2, "0")
    mm = F.lpad((F.abs(minutes) % 60).cast("string"), 2, "0")
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss.SSS"), sign, hh, F.lit(":"), mm)


def parse_moment(text: Column, zone: Column | str) -> Column:
    """A date alone means local noon; anything longer is read as an instant."""
    noon = wall_to_instant(F.try_to_timestamp(F.concat(text, F.lit(" 12:00:00"))), zone)
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), noon).otherwise(F.try_to_timestamp(text))


def local_day_buckets(df: DataFrame, instant: str, zones: list[str]) -> DataFrame:
    """Every row once per zone, with its local day there."""
    z = df.withColumn("zone", F.explode(F.array(*[F.lit(x) for x in zones])))
    return z.withColumn("local_day", local_day(F.col(instant), F.col("zone")))
