"""Header CSV scans and column lookup by name."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

ORDER = "_file_order"

# The bytes 0x80 to 0x9F mean printable characters in cp1252 and control characters in latin-1; five mean nothing.
_HIGH_LATIN = bytes(range(0x80, 0xA0)).decode("latin-1")
_HIGH_CP1252 = {c: c.encode("latin-1").decode("cp1252", errors="ignore") for c in _HIGH_LATIN}
_DEFINED = "".join(c for c in _HIGH_LATIN if _HIGH_CP1252[c])
_PRINTABLE = "".join(_HIGH_CP1252[c] for c in _DEFINED)
_UNDEFINED_BYTES = "^(..)*(81|8D|8F|90|9D)"
# A quoted cell between commas or at an end of its record.
_QUOTED_CELL = r'(\A|,)"[^"]*+(?:""[^"]*+)*+"(?=,|\z)'


def _quotes(text: str) -> Column:
    return F.length(F.regexp_replace(text, '[^"]', ""))


def inspect_file(spark: SparkSession, path: str) -> tuple[str, bool]:
    """The encoding of a file and whether cells of it have quoted line breaks, from one scan line by line.

    The encoding is ``utf-8``, else ``cp1252``, else ``latin-1`` where a byte has no meaning in cp1252. A line with an odd
    number of quotes opens or closes a cell that goes on over a line break.
    """
    odd = ~F.is_valid_utf8("value")
    found = spark.read.text(path).agg(
        F.count_if(odd).alias("n"),
        F.count_if(odd & F.hex(F.col("value").cast("binary")).rlike(_UNDEFINED_BYTES)).alias("undefined"),
        F.count_if(_quotes("value") % 2 == 1).alias("open")).first()
    return "utf-8" if found["n"] == 0 else "latin-1" if found["undefined"] else "cp1252", found["open"] > 0


def detect_encoding(spark: SparkSession, path: str) -> str:
    return inspect_file(spark, path)[0]


def _records(spark: SparkSession, path: str, encoding: str) -> DataFrame | None:
    """``(place, record)`` of a file whose cells may go on over line breaks, read by many tasks; None if its quotes cannot
    be told without reading it from the start.

    Whether a line begins inside a cell is the parity of the quotes before it. Each range of the file counts its own; the
    sums of the ranges in front, one number per range, say how it begins and which record its first lines belong to.
    This holds where every quote opens, closes or is doubled inside a quoted cell, which is checked for each record.
    ``place`` grows with the file: the byte where a range starts, and the number of the record's first line in it.
    """
    text = F.col("value") if encoding == "utf-8" else F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    in_range = Window.partitionBy("range").orderBy("line")
    before = F.coalesce(F.sum("quotes").over(in_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = (spark.read.text(path).select(text.alias("text"), F.col("_metadata.file_block_start").alias("range"),
                                          F.monotonically_increasing_id().alias("line"))
             .withColumn("quotes", _quotes("text")).withColumn("before", before)
             .withColumn("place", F.col("range") + F.row_number().over(in_range)))
    ranges = lines.groupBy("range").agg(
        F.sum("quotes").alias("quotes"), F.max(F.when(F.col("before") % 2 == 0, F.col("place"))).alias("even"),
        F.max(F.when(F.col("before") % 2 == 1, F.col("place"))).alias("odd"))
    # One row per range of the file, so one task orders them.
    in_front = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (ranges.withColumn("carried", F.coalesce(F.sum("quotes").over(in_front), F.lit(0)) % 2)
              .withColumn("latest", F.when(F.col("carried") == 0, F.col("even")).otherwise(F.col("odd")))
              .withColumn("open_since", F.last("latest", True).over(in_front)))
    ranges = cut_lineage(ranges.select("range", "quotes", "carried", "open_since"))
    if ranges.agg(F.sum("quotes")).first()[0] % 2 == 1:
        return None
    begins = F.when((F.col("before") + F.col("carried")) % 2 == 0, F.col("place"))
    placed = lines.join(ranges.drop("quotes"), "range").withColumn("record", F.coalesce(
        F.last(begins, True).over(in_range.rowsBetween(Window.unboundedPreceding, 0)), "open_since"))
    parts = F.sort_array(F.collect_list(F.struct("place", "text")))
    records = cut_lineage(placed.groupBy(F.col("record").alias("place")).agg(
        F.array_join(F.transform(parts, lambda part: part["text"]), "\n").alias("record")).filter("record <> ''"))
    stray = F.regexp_replace("record", F.lit(_QUOTED_CELL), F.lit("")).contains('"')
    return None if not records.filter(stray).isEmpty() else records


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text under their own headers, blanks kept as ``""``, plus the row's place in the file.

    Where headers differ in case only the last one is kept; an exact repeat is dropped. Files are read in parallel, those
    with line breaks inside quotes too; only where such a file also has quotes in the middle of a cell, or one that is
    never closed, one task reads it. A row with more cells than headers fails the job.
    """
    encoding, multi_line = inspect_file(spark, path)
    quoting = {"quote": '"', "escape": '"'}
    options = {"encoding": "UTF-8" if encoding == "utf-8" else "ISO-8859-1", "multiLine": multi_line, **quoting}
    header = spark.read.options(**options, header=False).csv(path).first()
    if header is None:
        return spark.createDataFrame([], f"{ORDER} bigint")
    names = [(h or "").lstrip("\ufeff") for h in header]
    if encoding == "cp1252":
        names = [n.encode("latin-1").decode("cp1252") for n in names]
    places: dict[str, int] = {}
    for i, name in enumerate(names):
        if name not in names[:i]:
            places[name.upper()] = i
    schema = ", ".join(f"_c{i} string" for i in range(len(names) + 1))
    records = _records(spark, path, encoding) if multi_line else None
    if records is None:
        table = spark.read.options(**options, header=True).schema(schema).csv(path).withColumn(
            ORDER, F.monotonically_increasing_id())
    else:
        first = records.agg(F.min("place")).first()[0]
        table = records.filter(F.col("place") > first).select(
            F.from_csv("record", schema, quoting).alias("row"), F.col("place").alias(ORDER)).select("row.*", ORDER)
    surplus = F.raise_error(F.concat(F.lit(f"more cells than headers in {path}: "), F.col(f"_c{len(names)}")))
    table = table.filter(F.when(F.col(f"_c{len(names)}").isNull(), True).otherwise(surplus.cast("boolean")))

    def cell(i: int) -> Column:
        text = F.coalesce(F.col(f"_c{i}"), F.lit(""))
        return (F.translate(text, _DEFINED, _PRINTABLE) if encoding == "cp1252" else text).alias(names[i])

    return table.select(*[cell(i) for i in sorted(places.values())], ORDER)


def pick(df: DataFrame, candidates: list[str]) -> str | None:
    """The first candidate that is a column, whatever its case."""
    lookup = {c.upper(): c for c in df.columns}
    return next((lookup[c.upper()] for c in candidates if c.upper() in lookup), None)


def pick_pattern(df: DataFrame, pattern: str) -> str | None:
    """The first column whose name matches."""
    return next((c for c in df.columns if re.search(pattern, c, re.IGNORECASE)), None)


def tidy_columns(df: DataFrame, headers: dict, required: list[str] = (), by_pattern: bool = False) -> DataFrame:
    """One select that brings any release to the tidy names; an absent column is NULL text, an absent key an error."""
    find = pick_pattern if by_pattern else pick
    actual = {name: find(df, wanted) for name, wanted in headers.items()}
    missing = [name for name in required if actual[name] is None]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}: expected {[headers[m] for m in missing]}")
    order = F.col(ORDER) if ORDER in df.columns else F.monotonically_increasing_id()
    return df.select(*[(F.col(f"`{c}`") if c else F.lit(None)).cast("string").alias(n) for n, c in actual.items()],
                     order.alias(ORDER))
