"""Reading tables and writing predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.sources.shared import freeze


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``folder`` as a stream of its files."""
    schema = read_table(spark, folder, name).schema
    # As a pattern, since a stream takes a plain path for a folder; a table may be one file.
    return spark.readStream.schema(schema).parquet(f"{folder.rstrip('/')}/{name}[.]parquet")


def write_predictions(
    df: DataFrame, path: str, id: str, score: str, format: str = "parquet"
) -> None:
    """Write ``id, score`` to ``path`` (csv with a header, or parquet).

    Refuses repeated ids, null ids, null or NaN scores and an existing ``path``. The
    predictions are computed once: checks and output both read the frozen table.
    """
    if format not in ("csv", "parquet"):
        raise ValueError(f"format must be csv or parquet, not {format!r}")
    predictions = freeze(df.select(id, score))
    per_id = predictions.groupBy(id).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(score).isNull() | F.isnan(F.col(score).cast("double"))).alias("empty")
    )
    found = per_id.agg(
        F.count_if(F.col("n") > 1).alias("repeated"),
        F.count_if(F.col(id).isNull()).alias("nameless"),
        F.coalesce(F.sum("empty"), F.lit(0)).alias("empty"),
    ).first()
    if found["repeated"] or found["nameless"] or found["empty"]:
        raise ValueError(
            f"predictions not written: {found['repeated']} repeated ids, "
            f"{found['nameless']} null ids, {found['empty']} null or NaN scores"
        )
    writer = predictions.write.mode("errorifexists")
    if format == "csv":
        writer = writer.option("header", True)
    writer.format(format).save(path)
