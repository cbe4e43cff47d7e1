"""CSV tables as they come from open-data portals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """A CSV with a header: rows with too many fields are left out, short rows are padded with nulls, infinite numbers are null.

    ``columns`` are read alone; ``rows`` is a sample's size.
    """
    plain = spark.read.csv(path, header=True, inferSchema=True)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in plain.schema.fields])
    # One more column than the header has takes what a too long row holds beyond it.
    wide = T.StructType(list(schema.fields) + [T.StructField("__extra", T.StringType())])
    df = spark.read.csv(path, header=True, schema=wide, enforceSchema=True, mode="PERMISSIVE").filter(F.col("__extra").isNull()).drop("__extra")
    for f in schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            df = df.withColumn(f.name, F.when(~F.col(f.name).isin(float("inf"), float("-inf")), F.col(f.name)))
    if columns:
        df = df.select(*columns)
    return df.limit(rows) if rows else df
