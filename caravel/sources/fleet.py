"""The fleet relations over the driver's tables: bookings are orders, their telematics
twins are line items, and everything derived from them is a plain function of frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caravel.functions import money, text, time

TRIP_COLUMNS = [
    "platform", "external_id", "fleet_id", "plate", "driver_ext_id", "driver_name", "requested_at", "ended_at",
    "distance_km", "status", "product", "payment_type", "price",
]
PAYMENTS = ["cash", "pos-driver", "room-charge", "FOC", "apple_pay", None]


def bookings(t) -> DataFrame:
    """Orders as bookings. Small dimensions are joined by key; whether they are broadcast
    is the planner's choice by their size.
    """
    key = F.col("o_orderkey")
    people = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    at = F.col("o_orderdate") + F.make_interval(mins=((key * 7919) % 1440).cast("int"))
    return t.orders.join(people, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.lower("c_mktsegment").alias("platform"),
        key.alias("external_id"),
        F.nullif("r_name", F.lit("AFRICA")).alias("fleet_id"),
        F.concat(F.lit("V-"), key % 97).alias("plate"),
        F.col("o_custkey").alias("driver_ext_id"),
        F.col("c_name").alias("driver_name"),
        at.alias("requested_at"),
        (at + F.make_interval(mins=(5 + key % 55).cast("int"))).alias("ended_at"),
        (key % 600).cast("double").alias("distance_km"),
        F.when(F.col("o_orderstatus") == "F", "Optional_Ride_completed").when(F.col("o_orderstatus") == "P", "client_did_not_show").otherwise("in_progress").alias("status"),
        F.col("o_orderpriority").alias("product"),
        F.array(*map(F.lit, PAYMENTS))[(key % 6).cast("int")].alias("payment_type"),
        F.when(key % 11 != 0, F.col("o_totalprice").cast("decimal(12,2)")).alias("price"),
    )


def twins(t) -> DataFrame:
    """Line items as telematics journeys: odometer-sized distances, no driver, no fare."""
    at = F.col("l_shipdate") + F.make_interval(mins=((F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17) % 1440).cast("int"))
    return t.lineitem.select(
        F.lit("fms").alias("platform"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("external_id"),
        F.lit(None).cast("string").alias("fleet_id"),
        F.concat(F.lit("V-"), F.col("l_suppkey") % 97).alias("plate"),
        F.lit(None).cast("bigint").alias("driver_ext_id"),
        F.lit(None).cast("string").alias("driver_name"),
        at.alias("requested_at"),
        (at + F.make_interval(mins=F.col("l_quantity").cast("int"))).alias("ended_at"),
        (F.col("l_quantity") * 4000).alias("distance_km"),
        F.lit("ended").alias("status"),
        F.lit(None).cast("string").alias("product"),
        F.lit(None).cast("string").alias("payment_type"),
        F.lit(None).cast("decimal(12,2)").alias("price"),
    )


def trips(t) -> DataFrame:
    return bookings(t).unionByName(twins(t))


def trips_norm(trip: DataFrame) -> DataFrame:
    """The normalised view: outcome, local calendar columns, the guards has_fare and
    has_distance, and the folded person key. Column expressions only, so filters on the
    base columns still reach the scan.
    """
    booking = F.col("platform") != "fms"
    return trip.select(
        "*",
        booking.alias("is_booking"),
        F.when(booking, money.outcome(F.col("status"))).alias("outcome"),
        time.local_day(F.col("requested_at")).alias("local_day"),
        time.local_hour(F.col("requested_at")).alias("local_hour"),
        time.local_dow(F.col("requested_at")).alias("local_dow"),
        (F.col("price").isNotNull() & ~F.coalesce(F.lower("payment_type"), F.lit("")).isin(money.SETTLEMENT["complimentary"])).alias("has_fare"),
        F.coalesce((F.col("distance_km") > 0) & (F.col("distance_km") < 500), F.lit(False)).alias("has_distance"),
        text.person_fold(F.col("driver_name")).alias("person_key"),
    )


def trips_ext(norm: DataFrame) -> DataFrame:
    """The extended view: settlement class, daypart, who holds the money."""
    return norm.select(
        "*",
        money.settlement_class(F.col("payment_type")).alias("settlement_class"),
        F.lower("payment_type").isin(money.HELD_BY_DRIVER).alias("driver_holds_cash"),
        F.lower("payment_type").isin(money.RECEIVABLE).alias("is_receivable"),
        time.daypart(F.col("local_hour")).alias("daypart"),
    )


def listed(words: list[str]) -> str:
    return "({})".format(", ".join(f"'{w}'" for w in words))


#: The same relations for the oracle.
TRIP_SQL = f"""
trip AS (
  SELECT lower(c_mktsegment) AS platform, o_orderkey AS external_id, nullif(r_name, 'AFRICA') AS fleet_id,
         'V-' || (o_orderkey % 97) AS plate, o_custkey AS driver_ext_id, c_name AS driver_name,
         o_orderdate + to_minutes(CAST((o_orderkey * 7919) % 1440 AS INT)) AS requested_at,
         o_orderdate + to_minutes(CAST((o_orderkey * 7919) % 1440 + 5 + o_orderkey % 55 AS INT)) AS ended_at,
         CAST(o_orderkey % 600 AS DOUBLE) AS distance_km,
         CASE o_orderstatus WHEN 'F' THEN 'Optional_Ride_completed' WHEN 'P' THEN 'client_did_not_show' ELSE 'in_progress' END AS status,
         o_orderpriority AS product,
         (['cash', 'pos-driver', 'room-charge', 'FOC', 'apple_pay', NULL])[CAST(o_orderkey % 6 AS INT) + 1] AS payment_type,
         CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_totalprice AS DECIMAL(12,2)) END AS price
  FROM orders LEFT JOIN (customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) ON o_custkey = c_custkey
  UNION ALL
  SELECT 'fms', l_orderkey * 10 + l_linenumber, NULL, 'V-' || (l_suppkey % 97), NULL, NULL,
         l_shipdate + to_minutes(CAST((l_orderkey * 31 + l_linenumber * 17) % 1440 AS INT)),
         l_shipdate + to_minutes(CAST((l_orderkey * 31 + l_linenumber * 17) % 1440 + l_quantity AS INT)),
         l_quantity * 4000, 'ended', NULL, NULL, NULL
  FROM lineitem
), trip_norm AS (
  SELECT *, platform <> 'fms' AS is_booking,
         CASE WHEN platform = 'fms' THEN NULL
              WHEN regexp_replace(lower(trim(status)), '^optional_ride_', '') IN {listed(money.COMPLETED)} THEN 'completed'
              WHEN lower(status) LIKE '%cancel%' OR regexp_replace(lower(trim(status)), '^optional_ride_', '') IN
                   {listed(money.NOT_COMPLETED)} THEN 'not_completed'
              WHEN status IS NOT NULL THEN 'other' END AS outcome,
         CAST(requested_at + INTERVAL 4 HOUR AS DATE) AS local_day,
         CAST(hour(requested_at + INTERVAL 4 HOUR) AS INT) AS local_hour,
         CAST(dayofweek(requested_at + INTERVAL 4 HOUR) AS INT) AS local_dow,
         price IS NOT NULL AND coalesce(lower(payment_type), '') NOT IN {listed(money.SETTLEMENT["complimentary"])} AS has_fare,
         coalesce(distance_km > 0 AND distance_km < 500, FALSE) AS has_distance,
         trim(regexp_replace(lower(driver_name), '\\s+', ' ', 'g')) AS person_key
  FROM trip
)"""
WITH_TRIPS = f"WITH {TRIP_SQL}\n"
