"""Input schemas, one per table."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


L, I, D, S, TS = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampType()

LOCATIONS = _schema(NIS_RAD=L, LAT=D, LON=D, installation=S)
BILLS = _schema(nis_rad=L, f_fact=S, period=S, csmo_fact=D)
CUSTOMERS = _schema(NIS_RAD=L, LAT=D, LON=D, installation=S)
TRANSFORMERS = _schema(tx_id=L, LAT=D, LON=D)
PROVIDERS = _schema(GPSLatitud=D, GPSLongitu=D, year=I, month=I, day=I, factype=S)
ROADS_WKT = _schema(road_id=L, ROADCLASS=S, geometry=S)
ROAD_SEGMENTS = _schema(road_id=L, seg=I, ROADCLASS=S, x1=D, y1=D, x2=D, y2=D)
PIXELS = _schema(year=I, py=I, px=I, lon_c=D, lat_c=D, value=D)
CLASS_PIXELS = _schema(Y=I, X=I, pixel_value=D)
GCP = _schema(nis_rad=L, Nof_Mths=I, GCP=S)
SEGMENTS = _schema(nis_rad=L, segment=S)
