"""Tables written once to the cluster's shared folder.

An aggregate that several later steps need is written as parquet to the folder
named by ``spark.checkpoint.dir`` and read back. That cuts its lineage, survives
the loss of any executor, and makes values that depend on physical row placement
(see ``operators.ordering.positions``) final.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Room a row and a value take in a hash table besides the bytes of strings.
_BYTES_PER_ROW, _BYTES_PER_VALUE = 32, 16


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, else the
    context's checkpoint folder. On a cluster it must be one that every machine sees, as a
    store or as a mounted folder. Only a local-mode session without either gets a
    temporary folder; a cluster without either is an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="riskloom-"))
    return context.getCheckpointDir().rstrip("/")


# Paths given out inside each open ``scratch``, innermost last. A thread sees only its own.
_kept: ContextVar[tuple[list[str], ...]] = ContextVar("riskloom_kept", default=())


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing uses yet, deleted at the end of the ``scratch`` around it."""
    path = f"{shared_dir(spark)}/riskloom-{uuid.uuid4().hex}"
    if _kept.get():
        _kept.get()[-1].append(path)
    return path


def freeze(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back from there, with ``by`` in a folder for
    each value of that column."""
    path = new_path(df.sparkSession)
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables frozen inside are deleted at the end. Results that read them must have been
    written or collected by then::

        with scratch(spark):
            rank_blend(df, scores, weights, "id").write.parquet(path)
    """
    paths: list[str] = []
    outer = _kept.set((*_kept.get(), paths))
    try:
        yield
    finally:
        _kept.reset(outer)
        for path in paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@dataclass(frozen=True)
class Frozen:
    """A frozen table with its measured size."""

    df: DataFrame
    rows: int
    size: int


def freeze_measured(df: DataFrame) -> Frozen:
    """``freeze``, then rows and bytes measured on what was written."""
    table = freeze(df)
    text = F.lit(0)
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            text = text + F.coalesce(F.octet_length(value), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            # Nested values by the length of their text, with room for what holds them.
            written = F.octet_length(F.to_json(F.struct(value)))
            text = text + 4 * F.coalesce(written, F.lit(0))
    seen = table.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(text.cast("bigint")).alias("text_bytes")
    ).first()
    room = _BYTES_PER_ROW + len(df.columns) * _BYTES_PER_VALUE
    size = seen["rows"] * room + (seen["text_bytes"] or 0)
    return Frozen(table, seen["rows"], size)
