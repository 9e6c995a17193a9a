"""Names of places: a ladder of evidence from an address down to the car's tracker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caravel.functions import geo, text

PLUS_CODE = r"\b([23456789CFGHJMPQRVWX]{4,8}\+[23456789CFGHJMPQRVWX]{2,7})\b"


def resolved(ends: DataFrame, cells: DataFrame, names: list[str]) -> DataFrame:
    """id, area, basis and reason of journey ends: the area that the address names, else one
    of `names` (a bounded vocabulary) in it, else the gazetteer's area at its plus code, at
    the booking's coordinates, or at the tracker's fix; else why there is none.

    `ends`: id (unique), addr, lat, lng, plate, at, cancelled, scheduled, fix_lat, fix_lng.
    `cells`: cell_lat, cell_lng, area. All positions are looked up in one join on the
    cell; the tracker is not asked about a ride that was scheduled, or has no car or time.
    """
    code = F.nullif(F.regexp_extract(F.upper("addr"), PLUS_CODE, 1), F.lit(""))
    tracked = F.col("plate").isNotNull() & F.col("at").isNotNull() & ~F.col("scheduled")
    placed = ends.withColumn("__centre", text.plus_code_centre(code))
    spot = lambda rank, basis, lat, lng: F.struct(F.lit(rank).alias("rank"), F.lit(basis).alias("basis"), lat.alias("lat"), lng.alias("lng"))
    spots = F.array(
        spot(1, "plus_code", F.col("__centre.lat"), F.col("__centre.lng")),
        spot(2, "coordinates", F.col("lat"), F.col("lng")),
        spot(3, "tracker", F.when(tracked, F.col("fix_lat")), F.when(tracked, F.col("fix_lng"))),
    )
    asked = placed.select("id", F.explode(F.filter(spots, lambda s: s["lat"].isNotNull() & s["lng"].isNotNull())).alias("s"))
    keyed = asked.select("id", "s.rank", "s.basis", geo.cell(F.col("s.lat")).alias("cell_lat"), geo.cell(F.col("s.lng")).alias("cell_lng"))
    found = keyed.join(cells.filter("area is not null"), ["cell_lat", "cell_lng"]).groupBy("id").agg(F.min(F.struct("rank", "basis", "area")).alias("cell"))
    address, named = text.place_area(F.col("addr")), text.vocabulary_area(F.col("addr"), names)
    positioned = F.col("lat").isNotNull() & F.col("lng").isNotNull() | F.col("__centre.lat").isNotNull()
    fixed = F.col("fix_lat").isNotNull() & F.col("fix_lng").isNotNull()
    basis = F.when(address.isNotNull(), "address").when(named.isNotNull(), "address_name").otherwise(F.col("cell.basis"))
    why = (
        F.when(positioned | tracked & fixed, "unnamed_cell")
        .when(F.col("plate").isNull(), "no_plate")
        .when(F.col("at").isNull(), F.when(F.col("cancelled"), "cancelled").otherwise("no_time"))
        .when(F.col("scheduled"), "scheduled")
        .otherwise("no_fix")
    )
    area = F.coalesce(address, named, F.col("cell.area"))
    return placed.join(found, "id", "left").select("id", area.alias("area"), basis.alias("basis"), F.when(area.isNull(), why).alias("reason"))
