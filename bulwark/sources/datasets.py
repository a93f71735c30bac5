"""Small classical datasets and the delimited-file reader behind them.

``load`` reads a delimited file with a fixed schema and keeps the features asked
for.  Telephone, stars and animals are short published tables and are kept
here; topgear and glass have to be given as files.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Dataset:
    data: DataFrame
    feature_names: tuple[str, ...]
    description: str
    categorical_features: tuple[str, ...] = field(default=())


def load(spark: SparkSession, path: str, schema: T.StructType, feature_names: Sequence[str] | None = None, description: str = "", delimiter: str = ",", categorical: Sequence[str] = ()) -> Dataset:
    """A delimited file with a header, read with ``schema`` (never inferred)."""
    names = tuple(feature_names or schema.fieldNames())
    df = spark.read.csv(path, header=True, schema=schema, sep=delimiter).select(*names)
    return Dataset(df, names, description, tuple(c for c in names if c in categorical))


# Published data: fixed values, in their published order.
# International calls from Belgium in tens of millions, by year.
_TELEPHONE_YEARS = range(50, 74)
_TELEPHONE_CALLS = (
    0.44, 0.47, 0.47, 0.59, 0.66, 0.73, 0.81, 0.88, 1.06, 1.2, 1.35, 1.49, 1.61, 2.12, 11.9, 12.4, 14.2, 15.9, 18.2, 21.2, 4.3, 2.4, 2.7, 2.9,
)
# Temperature and light (both logarithmic) of the stars of the cluster CYG OB1.
_STARS_TE = (
    4.37, 4.56, 4.26, 4.56, 4.3, 4.46, 3.84, 4.57, 4.26, 4.37, 3.49, 4.43, 4.48, 4.01, 4.29, 4.42, 4.23, 4.42, 4.23, 3.49, 4.29, 4.29, 4.42, 4.49,
    4.38, 4.42, 4.29, 4.38, 4.22, 3.48, 4.38, 4.56, 4.45, 3.49, 4.23, 4.62, 4.53, 4.45, 4.53, 4.43, 4.38, 4.45, 4.5, 4.45, 4.55, 4.45, 4.42,
)
_STARS_LIGHT = (
    5.23, 5.74, 4.93, 5.74, 5.19, 5.46, 4.65, 5.27, 5.57, 5.12, 5.73, 5.45, 5.42, 4.05, 4.26, 4.58, 3.94, 4.18, 4.18, 5.89, 4.38, 4.22, 4.42, 4.85,
    5.02, 4.66, 4.66, 4.9, 4.39, 6.05, 4.42, 5.1, 5.22, 6.29, 4.34, 5.62, 5.1, 5.22, 5.18, 5.57, 4.62, 5.06, 5.34, 5.34, 5.54, 4.98, 4.5,
)
# Body weight (kg) and brain weight (g) of animals.
_ANIMALS_BODY = (
    1.35, 465.0, 36.33, 27.66, 1.04, 11700.0, 2547.0, 187.1, 521.0, 10.0, 3.3, 529.0, 207.0, 62.0, 6654.0, 9400.0, 6.8, 35.0, 0.12, 0.023, 2.5, 55.5,
    100.0, 52.16, 0.28, 87000.0, 0.122, 192.0,
)
_ANIMALS_BRAIN = (
    8.1, 423.0, 119.5, 115.0, 5.5, 50.0, 4603.0, 419.0, 655.0, 115.0, 25.6, 680.0, 406.0, 1320.0, 5712.0, 70.0, 179.0, 56.0, 1.0, 0.4, 12.1, 175.0,
    157.0, 440.0, 1.9, 154.5, 3.0, 180.0,
)


def _table(spark: SparkSession, schema: str, *columns: Sequence) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(zip(*columns, strict=True))], f"row_id long, {schema}")


def load_telephone(spark: SparkSession) -> Dataset:
    """24 rows: Year, Calls.  The calls of 1964 to 1969 were recorded in minutes, which makes them outliers."""
    return Dataset(_table(spark, "Year int, Calls double", list(_TELEPHONE_YEARS), _TELEPHONE_CALLS), ("Year", "Calls"), "International calls from Belgium, 1950 to 1973")


def load_stars(spark: SparkSession) -> Dataset:
    """47 rows: Te, light.  Four giants are outliers."""
    return Dataset(_table(spark, "Te double, light double", _STARS_TE, _STARS_LIGHT), ("Te", "light"), "Stars of the cluster CYG OB1")


def load_animals(spark: SparkSession) -> Dataset:
    """28 rows: body, brain.  Three dinosaurs are outliers on the logarithmic scale."""
    return Dataset(_table(spark, "body double, brain double", _ANIMALS_BODY, _ANIMALS_BRAIN), ("body", "brain"), "Body and brain weights of animals")


_TOPGEAR_NUMBERS = ("Price", "Cylinders", "Displacement", "BHP", "Torque", "Acceleration", "TopSpeed", "MPG", "Weight", "Length", "Width", "Height", "Verdict")
TOPGEAR_CATEGORIES = (
    "Make", "Model", "Type", "Fuel", "DriveWheel", "AdaptiveHeadlights", "AdjustableSteering", "AlarmSystem", "Automatic", "Bluetooth", "ClimateControl",
    "CruiseControl", "ElectricSeats", "Leather", "ParkingSensors", "PowerSteering", "SatNav", "ESP", "Origin",
)


def load_topgear(spark: SparkSession, path: str, delimiter: str = ",") -> Dataset:
    """297 cars, 32 columns, from a file with a header in any column order."""
    header = spark.read.csv(path, header=True, sep=delimiter, inferSchema=False)
    known = [c for c in header.columns if c in _TOPGEAR_NUMBERS or c in TOPGEAR_CATEGORIES]
    df = header.select(*[F.col(c).cast("double").alias(c) if c in _TOPGEAR_NUMBERS else F.col(c) for c in known])
    return Dataset(df, tuple(known), "Cars reviewed by a television show", tuple(c for c in known if c in TOPGEAR_CATEGORIES))


def load_glass(spark: SparkSession, path: str, delimiter: str = ",") -> Dataset:
    """180 spectra of 750 channels V1 to V750."""
    schema = T.StructType([T.StructField(f"V{i}", T.DoubleType()) for i in range(1, 751)])
    return load(spark, path, schema, description="X-ray spectra of glass vessels", delimiter=delimiter)
