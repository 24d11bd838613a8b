"""Hourly wind payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MS_TO_KMH = 3.6
PAYLOAD = "struct<WS10M: map<string,double>, WD10M: map<string,double>>"


def read_payload(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Two JSON maps keyed ``YYYYMMDDHH`` to rows ``hour_key, speed_ms, dir_deg``."""
    parsed = payloads.select(F.from_json(column, PAYLOAD).alias("p"))
    speed = parsed.select(F.explode("p.WS10M").alias("hour_key", "speed_ms"))
    bearing = parsed.select(F.explode("p.WD10M").alias("hour_key", "dir_deg"))
    return speed.join(bearing, "hour_key")


def write_payload(hours: DataFrame) -> DataFrame:
    """Hourly rows to one JSON payload per day (24 entries at most)."""
    day = F.substring("hour_key", 1, 8)

    def as_map(value: str):
        return F.map_from_entries(F.array_sort(F.collect_list(F.struct("hour_key", value))))

    maps = hours.groupBy(day.alias("day")).agg(as_map("speed_ms").alias("WS10M"), as_map("dir_deg").alias("WD10M"))
    return maps.select("day", F.to_json(F.struct("WS10M", "WD10M")).alias("payload"))


def usable_wind(hours: DataFrame) -> DataFrame:
    """Speed in km/h, without hours whose speed or direction is null or negative."""
    return hours.filter((F.col("speed_ms") >= 0) & (F.col("dir_deg") >= 0)).withColumn(
        "speed_kmh", F.col("speed_ms") * F.lit(MS_TO_KMH)
    )


def daily_wind(hours: DataFrame, fire_hour: int = 11) -> DataFrame:
    """Mean speed, values at the fire hour and hours without data, per day."""
    day, hour = F.substring("hour_key", 1, 8), F.substring("hour_key", 9, 2).cast("int")
    ok = (F.col("speed_ms") >= 0) & (F.col("dir_deg") >= 0)
    kmh = F.when(ok, F.col("speed_ms") * F.lit(MS_TO_KMH))
    at_fire = ok & (hour == fire_hour)
    return hours.groupBy(day.alias("day")).agg(
        F.avg(kmh).alias("mean_kmh"),
        F.max(F.when(at_fire, F.col("speed_ms") * F.lit(MS_TO_KMH))).alias("fire_kmh"),
        F.max(F.when(at_fire, F.col("dir_deg"))).alias("fire_dir"),
        F.count_if(~F.coalesce(ok, F.lit(False))).alias("missing_hours"),
    )
