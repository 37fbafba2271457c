from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.sources.tables import read_table


@dataclass(frozen=True)
class Plan:
    """``run(spark, folder)`` and, where SQL can say it, the same result in SQL."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Labels with what is known of their documents; the texts are not read."""
    documents = read_table(spark, folder, "documents")
    return read_table(spark, folder, "labels").join(
        documents.select("doc_id", "lang", "source", "n_chars"), "doc_id"
    )


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    """Columns whose last bits depend on the order of summing or on a logarithm."""
    return df.withColumns({c: F.round(c, digits) for c in columns})
