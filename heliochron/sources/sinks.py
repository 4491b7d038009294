"""Table sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_table(df: DataFrame, path: str, fmt: str = "parquet", digits: int | None = None,
                partition_by: Sequence[str] = (), mode: str = "errorifexists", **options) -> None:
    """Write as parquet, csv (with header) or json.

    ``digits`` rounds every fractional column first; rounding hours to 5 digits is felt in the
    day sums made from the file, so it is left to the caller.
    """
    if digits is not None:
        real = (T.DoubleType, T.FloatType)
        df = df.select(*[F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, real)
                         else F.col(f"`{f.name}`") for f in df.schema.fields])
    w = df.write.mode(mode).format(fmt).options(**options)
    if fmt == "csv":
        w = w.option("header", "true")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
