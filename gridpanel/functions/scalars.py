"""Scalar transforms of the panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpanel import constants as C


def valid_coordinates(lat: Column, lon: Column, bounds: dict | None = None) -> Column:
    """Not NULL, on the globe and, if bounds are given, inside them (inclusive)."""
    box = {"min_lat": -90, "max_lat": 90, "min_lon": -180, "max_lon": 180}
    ok = (
        lat.isNotNull()
        & lon.isNotNull()
        & lat.between(box["min_lat"], box["max_lat"])
        & lon.between(box["min_lon"], box["max_lon"])
    )
    if bounds:
        box = {**box, **bounds}
        ok = (
            ok
            & lat.between(box["min_lat"], box["max_lat"])
            & lon.between(box["min_lon"], box["max_lon"])
        )
    return F.coalesce(ok, F.lit(False))


def pixel_class(value: Column) -> Column:
    """Settlement class of a raster value; NULL for other values."""
    out = None
    for number, name in C.RU_CLASSES.items():
        test = value == F.lit(number)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def binary_rural_urban(classification: Column) -> Column:
    """'Rural' if Rural, else 'Urban' (also for NULL and 'NA')."""
    return F.when(classification == "Rural", "Rural").otherwise("Urban")


def exponential_decay(x: Column, a, b, c) -> Column:
    return a * F.exp(-b * x) + c


def log_plus(value: Column, constant: float = C.LOG_CONSTANT) -> Column:
    """Natural log of value + constant; NULL where that is not positive."""
    return F.ln(value + constant)


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def plausible(population: Column | None = None, lights: Column | None = None) -> Column:
    """Opt-in plausibility limits on buffer population and night lights."""
    ok = F.lit(True)
    if population is not None:
        ok = ok & (population <= C.MAX_POPULATION)
    if lights is not None:
        ok = ok & (lights <= C.MAX_NIGHT_LIGHTS)
    return ok


def display_name(name: Column) -> Column:
    """Title-cased variable name with the usual abbreviations restored (first hit each)."""
    text = F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))
    for pattern, short in (("Fsp", "FSP"), ("Gdp", "GDP"), ("Mins?", "Min."), ("Kwh", "kWh")):
        text = F.regexp_replace(text, f"^(.*?){pattern}", f"$1{short}")
    return text


def variable_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(C.VARIABLE_LABELS.items()), "variable string, label string")


def to_long(
    df: DataFrame,
    columns: Sequence[str],
    ids: Sequence[str] = (),
    name: str = "variable",
    value: str = "value",
) -> DataFrame:
    """Wide to long: one row per input row and column, values as doubles."""
    doubles = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return doubles.unpivot(list(ids), list(columns), name, value)
