"""Clean-up jobs over whole tables, as projections of native expressions."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean_number, normalise_code, period_label, period_start


def clean_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text figures to doubles; suppression codes become NULL."""
    return df.withColumns({c: clean_number(c) for c in columns})


def clean_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Postcodes to one spelling."""
    return df.withColumns({c: normalise_code(c) for c in columns})


def label_periods(df: DataFrame, column: str) -> DataFrame:
    """Add ``period`` and ``period_label`` from a period text."""
    return (df.withColumn("period", period_start(column)).withColumn("period_label", period_label("period")))


def null_sentinels(df: DataFrame, columns: list[str], sentinels: list[str]) -> DataFrame:
    """Texts that mean "nothing" to NULL."""
    return df.withColumns({c: F.when(~F.col(c).isin(*sentinels), F.col(c)) for c in columns})


def null_unless_both_positive(df: DataFrame, first: str, second: str) -> DataFrame:
    """A coordinate pair with a value at or below zero is no location."""
    none = F.coalesce((F.col(first) <= 0) | (F.col(second) <= 0), F.lit(False))
    return df.withColumns({c: F.when(~none, F.col(c)) for c in (first, second)})


def parse_dates(df: DataFrame, columns: list[str], pattern: str = "dd-MM-yyyy") -> DataFrame:
    """Dates from text, NULL for text that is no date."""
    return df.withColumns({c: F.try_to_date(F.col(c), pattern) for c in columns})


def iso_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Dates to ``yyyy-MM-dd`` text for output."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in columns})


def unit_type(type_name: str, type_group: str) -> Column:
    """Many register types to seven; the first rule that holds decides."""
    name = F.lower(F.coalesce(F.col(type_name), F.lit("")))
    group = F.lower(F.coalesce(F.col(type_group), F.lit("")))
    free = ((group == "free schools") | name.contains("free school") | name.contains("university technical")
            | name.contains("studio"))
    return (F.when(name.contains("special") | (group == "special schools"), "Special")
            .when(group.startswith("independent"), "Independent")
            .when(name.contains("academy converter"), "Academy (converter)")
            .when(name.contains("sponsor led"), "Academy (sponsor led)")
            .when(free, "Free school / UTC / studio")
            .when(group.startswith("local authority maintained"), "LA maintained")
            .otherwise("Other"))


def categorise_units(df: DataFrame, type_name: str = "type_name", type_group: str = "type_group") -> DataFrame:
    return df.withColumn("unit_type", unit_type(type_name, type_group))


def rank_to_score(zones: DataFrame) -> DataFrame:
    """Where a release has ranks only: score ``100 * (n - rank) / (n - 1)``, decile ``ceil(10 * rank / n)``.

    A column is filled only if the whole table lacks it; three global aggregates decide.
    """
    facts = zones.agg(F.struct(F.max("zone_rank").alias("n"), F.count("zone_score").alias("scores"),
                               F.count("zone_decile").alias("deciles")).alias("facts")).scalar()
    n, rank = facts.getField("n"), F.col("zone_rank")
    score = F.try_divide(F.lit(100.0) * (n - rank), n - 1)
    decile = F.ceil(F.try_divide(F.lit(10.0) * rank, n)).try_cast("int")
    return zones.withColumns({
        "zone_score": F.when(facts.getField("scores") == 0, score).otherwise(F.col("zone_score")),
        "zone_decile": F.when(facts.getField("deciles") == 0, decile).otherwise(F.col("zone_decile"))})


# The national grid (Airy 1830 ellipsoid, scale, true and false origin), WGS84, and the datum shift
# between them (metres, parts, arc seconds).
AIRY = (6377563.396, 6356256.909)
GRID_SCALE, GRID_LAT, GRID_LON, GRID_NORTH, GRID_EAST = 0.9996012717, 49.0, -2.0, -100000.0, 400000.0
WGS84 = (6378137.000, 6356752.3142)
SHIFT, SHIFT_SCALE, SHIFT_TURN = (446.448, -125.157, 542.060), -20.4894e-6, (0.1502, 0.2470, 0.8421)


def grid_constants() -> dict[str, float]:
    """Series coefficients of the transverse Mercator projection in the third flattening (Krueger 1912)."""
    a, b = AIRY
    n = (a - b) / (a + b)
    e = math.sqrt(1 - b * b / (a * a))
    radius = GRID_SCALE * a / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64)
    forward = (n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 + 41 * n ** 4 / 180,
               13 * n ** 2 / 48 - 3 * n ** 3 / 5 + 557 * n ** 4 / 1440,
               61 * n ** 3 / 240 - 103 * n ** 4 / 140, 49561 * n ** 4 / 161280)
    phi = math.radians(GRID_LAT)
    conformal = math.atan(math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi))))
    origin = conformal + sum(c * math.sin(2 * (j + 1) * conformal) for j, c in enumerate(forward))
    inverse = (n / 2 - 2 * n ** 2 / 3 + 37 * n ** 3 / 96 - n ** 4 / 360,
               n ** 2 / 48 + n ** 3 / 15 - 437 * n ** 4 / 1440,
               17 * n ** 3 / 480 - 37 * n ** 4 / 840, 4397 * n ** 4 / 161280)
    latitude = (2 * n - 2 * n ** 2 / 3 - 2 * n ** 3 + 116 * n ** 4 / 45,
                7 * n ** 2 / 3 - 8 * n ** 3 / 5 - 227 * n ** 4 / 45,
                56 * n ** 3 / 15 - 136 * n ** 4 / 35, 4279 * n ** 4 / 630)
    turn = [math.radians(t / 3600) for t in SHIFT_TURN]
    a2, b2 = WGS84
    return {"radius": radius, "origin": origin, "e2": e * e, "a": a, "a2": a2, "b2": b2, "f2": 1 - b2 * b2 / (a2 * a2),
            "s2": a2 * a2 / (b2 * b2) - 1, "rx": turn[0], "ry": turn[1], "rz": turn[2],
            **{f"i{j + 1}": c for j, c in enumerate(inverse)}, **{f"d{j + 1}": c for j, c in enumerate(latitude)}}


def locate_points(df: DataFrame, easting: str = "easting", northing: str = "northing") -> DataFrame:
    """Add WGS84 latitude and longitude in degrees; NULL in, NULL out.

    Closed forms throughout, so each step is one native projection: the inverse projection as a series, the datum shift
    as a turn of the geocentric position, and the geodetic latitude by Bowring's formula.
    """
    k = grid_constants()
    steps = [
        {"_xi": (F.col(northing) - GRID_NORTH) / k["radius"] + k["origin"],
         "_eta": (F.col(easting) - GRID_EAST) / k["radius"]},
        {"_u": F.col("_xi") - sum(k[f"i{j}"] * F.sin(2 * j * F.col("_xi")) * F.cosh(2 * j * F.col("_eta"))
                                  for j in range(1, 5)),
         "_v": F.col("_eta") - sum(k[f"i{j}"] * F.cos(2 * j * F.col("_xi")) * F.sinh(2 * j * F.col("_eta"))
                                   for j in range(1, 5))},
        {"_chi": F.asin(F.sin("_u") / F.cosh("_v")),
         "_lon": F.lit(math.radians(GRID_LON)) + F.atan2(F.sinh("_v"), F.cos("_u"))},
        {"_lat": F.col("_chi") + sum(k[f"d{j}"] * F.sin(2 * j * F.col("_chi")) for j in range(1, 5))},
        {"_nu": k["a"] / F.sqrt(1 - k["e2"] * F.sin("_lat") * F.sin("_lat"))},
        {"_x": F.col("_nu") * F.cos("_lat") * F.cos("_lon"), "_y": F.col("_nu") * F.cos("_lat") * F.sin("_lon"),
         "_z": (1 - k["e2"]) * F.col("_nu") * F.sin("_lat")},
        {"_x2": SHIFT[0] + (1 + SHIFT_SCALE) * F.col("_x") - k["rz"] * F.col("_y") + k["ry"] * F.col("_z"),
         "_y2": SHIFT[1] + k["rz"] * F.col("_x") + (1 + SHIFT_SCALE) * F.col("_y") - k["rx"] * F.col("_z"),
         "_z2": SHIFT[2] - k["ry"] * F.col("_x") + k["rx"] * F.col("_y") + (1 + SHIFT_SCALE) * F.col("_z")},
        {"_p": F.sqrt(F.col("_x2") * F.col("_x2") + F.col("_y2") * F.col("_y2"))},
        {"_t": F.atan2(F.col("_z2") * k["a2"], F.col("_p") * k["b2"])},
        {"latitude": F.degrees(F.atan2(
            F.col("_z2") + k["s2"] * k["b2"] * F.sin("_t") * F.sin("_t") * F.sin("_t"),
            F.col("_p") - k["f2"] * k["a2"] * F.cos("_t") * F.cos("_t") * F.cos("_t"))),
         "longitude": F.degrees(F.atan2(F.col("_y2"), F.col("_x2")))},
    ]
    out = df
    for step in steps:
        out = out.withColumns(step)
    return out.drop("_xi", "_eta", "_u", "_v", "_chi", "_lon", "_lat", "_nu", "_x", "_y", "_z", "_x2", "_y2", "_z2",
                    "_p", "_t")
