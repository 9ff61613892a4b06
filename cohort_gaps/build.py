"""From a folder of published files to base tables and views."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.joins import filled_rate, match_rate
from .plans import areas, marts, odds, panel, trends, units
from .plans.params import params_table
from .session import cut_lineage, scratch
from .sources import layouts as lay
from .sources.files import newest_file
from .sources.register import read_directory, read_links, read_register, read_zones
from .sources.results import read_results
from .sources.sinks import write_table

# Views in the order they build on each other.
VIEWS = ("unit_base", "benchmark", "unit_gaps", "area_ranking", "odds", "beating_the_odds", "benchmark_trends",
         "area_trends", "unit_trends", "dash_units", "dash_areas")
# Views that are written whole.
FLAT = ("odds", "unit_trends", "dash_units", "dash_areas")
TABLES = ("units", "results", "zones", "areas", "params")


@dataclass
class Inputs:
    results: DataFrame
    register: DataFrame
    zones: DataFrame
    links: DataFrame | None = None
    directory: DataFrame | None = None


def read_inputs(spark: SparkSession, folder: str) -> Inputs:
    """The newest release of each kind of file below ``folder``; links and directory may be absent."""
    def path(place: tuple[str, str], required: bool, first: bool = False) -> str | None:
        found = newest_file(spark, f"{folder}/{place[0]}", place[1], first)
        if found is None and required:
            raise FileNotFoundError(f"no file {place[1]} in {folder}/{place[0]}")
        return found

    links, directory = path(lay.LINK_FILES, False), path(lay.DIRECTORY_FILES, False)
    return Inputs(results=read_results(spark, folder),
                  register=read_register(spark, path(lay.REGISTER_FILES, True)),
                  zones=read_zones(spark, path(lay.ZONE_FILES, True, first=True)),
                  links=read_links(spark, links) if links else None,
                  directory=read_directory(spark, directory) if directory else None)


def build_tables(spark: SparkSession, inputs: Inputs, warehouse: str, **thresholds: float) -> dict[str, DataFrame]:
    """Write the base tables and the unit-period base once; everything after reads them."""
    parsed = write_table(inputs.results.repartition("period", F.pmod(F.xxhash64("unit_id"), F.lit(32))),
                         f"{warehouse}/results", ["period"])
    results = parsed.drop("result_name", "result_postcode")
    register = write_table(inputs.register, f"{warehouse}/register")
    unit_dim = write_table(units.build_units(parsed, register, inputs.links, inputs.directory),
                           f"{warehouse}/units")
    zones = write_table(inputs.zones, f"{warehouse}/zones")
    area_dim = write_table(areas.build_areas(unit_dim, register, zones), f"{warehouse}/areas")
    params = write_table(params_table(spark, **thresholds), f"{warehouse}/params")
    base = write_table(panel.unit_base(results, unit_dim, zones, params), f"{warehouse}/unit_base", ["period"])
    return {"units": unit_dim, "results": results, "zones": zones, "areas": area_dim, "params": params, "base": base}


def coverage(tables: dict[str, DataFrame]) -> DataFrame:
    """How many units have a map point and how many a zone with a score; ``is_low`` warns below 90 %."""
    placed = filled_rate(tables["units"], "latitude").withColumn("is_low", F.lit(None).cast("boolean"))
    zoned = match_rate(tables["units"], tables["zones"], "zone_code")
    return (placed.select(F.lit("map point").alias("check"), "n_rows", "rate", "is_low")
            .unionByName(zoned.select(F.lit("zone").alias("check"), "n_rows", "rate", "is_low")))


def build_views(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The analysis views as plans over the base tables; the odds rows are written, as three views read them."""
    base = tables.get("base")
    if base is None:
        base = panel.unit_base(tables["results"], tables["units"], tables["zones"], tables["params"])
    bench = panel.benchmark(base)
    gaps = panel.unit_gaps(base, bench)
    ranked = panel.area_ranking(panel.area_period(base, bench))
    flagged = cut_lineage(odds.odds(gaps, tables["params"], base))
    area_moves, unit_moves = trends.area_trends(ranked), trends.unit_trends(gaps)
    built = (base, bench, gaps, ranked, odds.odds_ranked(flagged, written=True), odds.beating_the_odds(flagged),
             trends.benchmark_trends(bench), area_moves, unit_moves, marts.dash_units(unit_moves, flagged),
             marts.dash_areas(area_moves, tables["areas"]))
    return dict(zip(VIEWS, built, strict=True))


def create_views(tables: dict[str, DataFrame], prefix: str = "") -> dict[str, DataFrame]:
    """Register base tables and views for SQL, under names that begin with ``prefix``."""
    views = build_views(tables)
    register_views({**{n: tables[n] for n in TABLES}, **views}, prefix)
    return views


def register_views(found: dict[str, DataFrame], prefix: str = "") -> None:
    for name, df in found.items():
        df.createOrReplaceTempView(f"{prefix}{name}")


def drop_views(spark: SparkSession, prefix: str = "") -> None:
    """Views first, in reverse order, then the tables' names."""
    for name in [*reversed(VIEWS), *TABLES]:
        spark.catalog.dropTempView(f"{prefix}{name}")


def build(spark: SparkSession, folder: str, warehouse: str, prefix: str = "", **thresholds: float) -> dict[str, DataFrame]:
    """Read, join, write and register everything; returns tables and views by name.

    The flat tables, which readers ask again and again, are written too. What the steps in between kept in the checkpoint
    folder is removed, but for the rows that the odds views read.
    """
    with scratch(spark) as kept:
        tables = build_tables(spark, read_inputs(spark, folder), warehouse, **thresholds)
        views = build_views(tables)
        for name in FLAT:
            views[name] = write_table(views[name], f"{warehouse}/{name}")
        kept.keep_all_of(views.values())
    register_views({**{n: tables[n] for n in TABLES}, **views}, prefix)
    return {**tables, **views}
