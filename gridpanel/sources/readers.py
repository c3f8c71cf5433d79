"""Reading tables, providers, roads and raster catalogues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpanel import constants as C
from gridpanel.functions.scalars import nan_to_null

FORMATS = ("parquet", "csv")


def format_of(path: str) -> str:
    """Format by extension; anything but Parquet and CSV is an error."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in FORMATS:
        raise ValueError(f"unsupported file type: {path}")
    return kind


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | None = None, **options
) -> DataFrame:
    """A table by its extension; NaN is read as NULL."""
    kind = format_of(path)
    reader = spark.read.options(**options)
    if kind == "csv":
        reader = reader.option("header", options.get("header", True))
        if schema is None:
            reader = reader.option("inferSchema", options.get("inferSchema", True))
    if schema is not None:
        reader = reader.schema(schema)
    return nan_to_null(reader.format(kind).load(path))


def read_existing(
    spark: SparkSession, paths: Sequence[str], schema: T.StructType | None = None
) -> DataFrame | None:
    """Union of the parts that exist; missing parts are skipped, none at all gives None."""
    parts = []
    for path in paths:
        if path_exists(spark, path):
            parts.append(read_table(spark, path, schema))
    return union_parts(parts)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, on whatever file system it names."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(system.exists(hadoop))


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a file or folder, if it is there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.delete(hadoop, True)


def union_parts(parts: Sequence[DataFrame]) -> DataFrame | None:
    """Union by name; columns a part lacks are NULL."""
    whole = None
    for part in parts:
        whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
    return whole


def providers(df: DataFrame) -> DataFrame:
    """Providers with `Lat`, `Lon` and `start_dte`; year 0 starts at the earliest date."""
    renamed = df.withColumnsRenamed({"GPSLatitud": "Lat", "GPSLongitu": "Lon"})
    dated = renamed.withColumn(
        "start_dte", F.when(F.col("year") > 0, F.make_date("year", "month", "day"))
    )
    first = dated.agg(F.min("start_dte").alias("d"))
    return dated.withColumn(
        "start_dte", F.when(F.col("year") == 0, first.scalar()).otherwise(F.col("start_dte"))
    )


def road_segments(
    df: DataFrame,
    geometry: str = "geometry",
    key: str = "road_id",
    class_col: str = "ROADCLASS",
) -> DataFrame:
    """Segments of LINESTRING and MULTILINESTRING text, numbered along the road.

    Roads without geometry are skipped; no segment joins two parts of a multi-line.
    """
    lines = F.regexp_extract_all(geometry, F.lit(r"\(([^()]+)\)"), 1)
    parts = df.filter(F.col(geometry).isNotNull()).select(
        key, class_col, F.posexplode(lines).alias("_part", "_line")
    )
    vertices = F.transform(
        F.split("_line", r"\s*,\s*"),
        lambda v: F.transform(F.slice(F.split(F.trim(v), r"\s+"), 1, 2), lambda n: n.cast("double")),
    )
    pairs = F.when(
        F.size("_v") > 1,
        F.transform(
            F.sequence(F.lit(1), F.size("_v") - 1),
            lambda i: F.struct(
                F.element_at("_v", i).alias("a"), F.element_at("_v", i + 1).alias("b")
            ),
        ),
    )
    steps = (
        parts.withColumn("_v", vertices)
        .select(key, class_col, "_part", F.posexplode(pairs).alias("_at", "_p"))
        .select(
            key,
            class_col,
            "_part",
            "_at",
            F.col("_p.a")[0].alias("x1"),
            F.col("_p.a")[1].alias("y1"),
            F.col("_p.b")[0].alias("x2"),
            F.col("_p.b")[1].alias("y2"),
        )
    )
    return steps.withColumnsRenamed({"_part": "part", "_at": "seg"}).select(
        key, "part", "seg", class_col, "x1", "y1", "x2", "y2"
    )


def population_year(path: Column) -> Column:
    """Third token of the path, split at underscores."""
    return F.get(F.split(path, "_"), F.lit(2)).try_cast("int")


def lights_year(path: Column) -> Column:
    """Year of a night-light file from its name.

    Names containing SVDNB carry it at the start of their third token, and such a file without a
    readable year is skipped (NULL). Other names of three tokens or more carry it in the
    first token that begins with four digits; 2015 if the name tells none.
    """
    name = F.element_at(F.split(path, "/"), -1)
    tokens = F.split(name, "_")
    dated = F.get(F.filter(tokens, lambda t: t.rlike(r"^\d{4}")), F.lit(0))
    other = F.when(F.size(tokens) > 2, F.substring(dated, 1, 4)).try_cast("int")
    return F.when(
        F.contains(name, F.lit("SVDNB")), F.substring(F.get(tokens, F.lit(2)), 1, 4).try_cast("int")
    ).otherwise(F.coalesce(other, F.lit(C.DEFAULT_RASTER_YEAR)))


def raster_catalogue(pixels: DataFrame, year: Column, path: str = "path") -> DataFrame:
    """Pixels with their year, if they have one; of several files for a year the last in name order counts."""
    dated = pixels.withColumn("year", year).filter(F.col("year").isNotNull())
    # One row per year.
    last = dated.groupBy("year").agg(F.max(path).alias(path))
    return dated.join(last, ["year", path], "left_semi")


def read_pixels(spark: SparkSession, path: str, year_of, schema: T.StructType | None = None) -> DataFrame:
    """Pixel files below a path, the year taken from each file's name."""
    pixels = spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    pixels = pixels.withColumn("path", F.col("_metadata.file_path"))
    return raster_catalogue(pixels, year_of(F.col("path"))).drop("path")
