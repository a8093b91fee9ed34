"""JSON and Parquet sinks.  Spark's committer makes a finished write visible at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, is_dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _plain(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(column) & (F.abs(column) != F.lit(float("inf"))), column)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _plain(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*[_plain(column[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return column


def jsonable(df: DataFrame) -> DataFrame:
    """NaN and infinite numbers as null, also within arrays and structs."""
    return df.select(*[_plain(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a row, columns in the order of their names."""
    jsonable(df.select(*[f"`{c}`" for c in sorted(df.columns)])).write.mode("overwrite").json(path)


def with_config(df: DataFrame, config) -> DataFrame:
    """``df`` with the configuration (dataclass or dict of scalars) as a struct column."""
    values = asdict(config) if is_dataclass(config) else dict(config)
    return df.withColumn("config", F.struct(*[F.lit(v).alias(k) for k, v in sorted(values.items())]))


def fingerprint(config) -> str:
    """The first 16 hex digits of the SHA-256 of a configuration's JSON."""
    import hashlib
    import json

    values = asdict(config) if is_dataclass(config) else dict(config)
    return hashlib.sha256(json.dumps(values, sort_keys=True).encode()).hexdigest()[:16]


def write_run(outputs: DataFrame, folder: str, kind: str, name: str, config) -> str:
    """Outputs of a run, an evaluation or a calibration (``kind``), one row a video,
    with the configuration echoed in each, as JSON under ``folder``; the path."""
    path = f"{folder.rstrip('/')}/{kind}/{name}"
    write_json(with_config(outputs, config), path)
    return path


def remembered(spark: SparkSession, folder: str, config, build: Callable[[], DataFrame]) -> DataFrame:
    """The table of a configuration: read from the partition of its fingerprint
    under ``folder`` where it has been written, built and written once else."""
    path = f"{folder.rstrip('/')}/fingerprint={fingerprint(config)}"
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
