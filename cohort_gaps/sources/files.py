"""Which file of a folder to read."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .layouts import WIDE_FILES, WIDE_PREFERENCE


def list_files(spark: SparkSession, folder: str, pattern: str, nested: bool = False) -> DataFrame | None:
    """``path``, ``name`` and ``parent`` of the files that match; None without the folder. No content is read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    try:
        files = reader.option("recursiveFileLookup", nested).load(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    parts = F.split("path", "/")
    return files.select("path", F.element_at(parts, -1).alias("name"), F.element_at(parts, -2).alias("parent"))


def newest_file(spark: SparkSession, folder: str, pattern: str, first: bool = False) -> str | None:
    """The last file by name, as names carry their date; or the first."""
    files = list_files(spark, folder, pattern)
    row = None if files is None else files.orderBy("name" if first else F.desc("name")).first()
    return row["path"] if row else None


def yearly_files(spark: SparkSession, folder: str) -> dict[str, str]:
    """One wide file per year folder: final before revised before provisional, then by name; no metadata files."""
    files = list_files(spark, f"{folder}/{WIDE_FILES[0]}", WIDE_FILES[1], nested=True)
    if files is None:
        return {}
    name = F.lower("name")
    place = F.coalesce(*[F.when(name.contains(word), i) for i, word in enumerate(WIDE_PREFERENCE)], F.lit(9))
    spec = Window.partitionBy("parent").orderBy(place, "name")
    best = (files.filter(~name.contains("meta") & (F.col("parent") != WIDE_FILES[0]))
            .withColumn("_row", F.row_number().over(spec)).filter("_row = 1"))
    return {row["parent"]: row["path"] for row in best.orderBy("parent").collect()}
