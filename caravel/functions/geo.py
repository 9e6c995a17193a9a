"""Distances, grid cells and runway geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EARTH_KM = 6371.0
CELL = 0.005
NM_KM = 1.852


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def cell(coordinate: Column, size: float = CELL) -> Column:
    """The grid cell of a coordinate, an integer key for equi-joins."""
    return F.round(coordinate.cast("decimal(18,8)") / F.lit(size).cast("decimal(6,4)")).cast("int")


def approaches(states: DataFrame, runways: DataFrame) -> DataFrame:
    """The runway that an aircraft is on final approach to: within 6 nm of the airport on a
    local flat grid, at most 1.5 nm off its track and 0.5 nm past it, the track within 20
    degrees of the heading; at most 900 m high and descending 0.5 m/s or more, or on the
    ground within 3 nm at over 20 m/s. The smallest cross-track wins. A missing
    barometric altitude is the geometric one; below 30 m/s the time is that of 70 m/s.

    `states`: icao24, lat, lng, track, baro_m, geo_m, climb_ms, speed_ms, on_ground.
    `runways`: airport, runway, lat, lng, heading. States meet those of their band of
    latitude, an equi-join whatever the size of either.
    """
    r = runways.select("airport", "runway", F.col("lat").alias("r_lat"), F.col("lng").alias("r_lng"), "heading")
    north = (F.col("r_lat") - F.col("lat")) * 60
    east = (F.col("r_lng") - F.col("lng")) * 60 * F.cos(F.radians((F.col("r_lat") + F.col("lat")) / 2))
    ahead = lambda a, b: a * F.cos(F.radians("track")) + b * F.sin(F.radians("track"))
    turn = F.abs(F.pmod(F.col("track") - F.col("heading") + 180, F.lit(360.0)) - 180)
    altitude = F.coalesce("baro_m", "geo_m")
    band = lambda lat: F.floor(lat / 0.1)
    near = r.withColumn("__band", F.explode(F.sequence(band(F.col("r_lat") - 0.1), band(F.col("r_lat") + 0.1))))
    joined = states.withColumn("__band", band(F.col("lat"))).join(near, "__band").filter(F.abs(F.col("lat") - F.col("r_lat")) <= 0.1).drop("__band")
    joined = joined.withColumn("along_nm", ahead(north, east)).withColumn("cross_nm", F.abs(ahead(east, -north))).withColumn("dist_nm", F.sqrt(north * north + east * east))
    flying = ~F.col("on_ground") & (altitude <= 900) & (F.col("climb_ms") <= -0.5)
    landed = F.col("on_ground") & (F.col("dist_nm") <= 3) & (F.col("speed_ms") > 20)
    fits = joined.filter((flying | landed) & (F.col("dist_nm") <= 6) & (F.col("cross_nm") <= 1.5) & (F.col("along_nm") >= -0.5) & (turn <= 20))
    best = F.row_number().over(Window.partitionBy("icao24").orderBy(F.round("cross_nm", 2), "airport", "runway"))
    speed = F.when(F.col("speed_ms") > 30, F.col("speed_ms")).otherwise(70.0)
    eta = F.round(F.greatest(F.col("along_nm"), F.lit(0.0)) * NM_KM * 1000 / speed).cast("bigint")
    rounded = [F.round(c, 2).alias(c) for c in ("along_nm", "cross_nm", "dist_nm")]
    return fits.withColumn("__n", best).filter("__n = 1").select("icao24", "airport", "runway", *rounded, altitude.alias("alt_m"), eta.alias("eta_s"))
