"""Column functions against plain values."""

from __future__ import annotations

from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from caravel.functions import money, stats

DUBAI = [
    "Terminal 3 - Dubai Int'l Airport - Dubai - United Arab Emirates", "Dubai Int'l Airport - Dubai", "T2 Parking Exit - Dubai Int'l Airport - Dubai", "Launchpad Dubai Int'L Airport Dubai Int'L Airport AE",
    "Terminal 1, Dubai International Airport (DXB) - Al Garhoud - DU - AE", "Terminal 3, Dubai Airport (DXB)", "Terminal 1, Flughafen Dubai (DXB)", "مبنى 3, مطار دبي (DXB)", "Airport Terminal 3 AE",
    "Terminal 1 Airport Road Garhoud AE", "Terminal 3 Meeting Point- After Customs, at Exit 2 (inside the terminal) AE", "Terminal3 Arrivals", "69X2+7XF DXB Terminal 1 Car Park A2 - Dubai", "Terminal 3 - T3 - مطار دبي الدولي - دبي",
]
MAKTOUM = [
    "Madinat Al Mataar - AL Maktoum International Airport (DWC) - Dubai", "Sector 5, Al Maktoum International Airport, Departure Zone", "Al Maktoum International Air - Madinat Al Mataar - Dubai South",
    "Al Maktoum Airport - Madinat Al Mataar", "DWC Private Jets Terminal - دبي الجنوب - دبي",
]
ELSEWHERE = [
    "Airport Rd - Al Garhoud - Dubai", "Hamdan bin Mohammed Cruise Terminal 3, Arrivals - Mina Rashid - Dubai", "Le Meridien Dubai Airport Road Garhoud AE", "Flora Inn Hotel Dubai Airport - 24 Airport Rd", "Airport View Building - Al Garhoud",
    "شارع المطار - القرهود - دبي", "Al Awir Rd - Warsan First - Dubai International City - Dubai", "DXB30 Al Falak Street Dubai Internet City AE", "Dubai International Academic City - Dubai", "155 Al Quds St - Dubai Int'l Airport - Dubai Airport Free Zone - Dubai",
    "DAFZA, Block A701 ,West wing 5 - Dubai Int'l Airport", "Dubai Int'l Airport - Dubai Airport Free Zone - Dubai", "Garhoud Area - opposite to Airport Terminal 3 - Al Garhoud", "Oppo Dubai Int'L Airport Terminal 3", "Al Ittihad Rd - Dubai Int'l Airport - E11 - Dubai",
    "Al Ittihad Roundabout - Dubai Int'l Airport", "AE-DXB-YTS - Al Hebiah Second", "Boho Salon. DXB, Dubai", "Dubai Logistics City DWC, Building A2, Office #207", "Terminal A - Al Matar - Zayed International Airport - Abu Dhabi", "Sharjah International Airport, Sharjah",
    "Al Maktoum Rd - Deira - Dubai", "Terminal 1 Bus Station - Al Ghubaiba", "Al Safa Street Taxi Terminal, City Walk Mall", None, "", "   ",
]


def test_airports(spark):
    wanted = [(a, c) for c, rows in (("OMDB", DUBAI), ("OMDW", MAKTOUM), (None, ELSEWHERE)) for a in rows]
    rows = spark.createDataFrame(wanted, "address string, icao string")
    wrong = rows.select("address", "icao", money.airport_of(F.col("address")).alias("found")).filter("not icao <=> found").collect()
    assert not wrong, wrong


def test_normal_quantile(spark):
    ps = [1e-12, 1e-6, 0.001, 0.02, 0.0243, 0.3, 0.5, 0.77, 0.98, 0.999999]
    rows = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0, -1.0]], "p double")
    found = [r.z for r in rows.select(stats.normal_quantile(F.col("p")).alias("z")).collect()]
    assert found[-3:] == [None, None, None]
    assert found[:-3] == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-8, abs=1e-8)
    z = spark.range(0, 3).select(stats.family_z(F.col("id") * 50).alias("z")).collect()
    assert [r.z for r in z] == pytest.approx([2.0, stats.bonferroni_z(50), stats.bonferroni_z(100)], rel=1e-8)
