"""What the corpus operators share: texts, words, splits and the model hand-over.

A *word* is a maximal run of anything but the six ASCII white spaces, with A-Z in lower case;
``bytes.lower`` and ``bytes.split`` mean exactly that on UTF-8.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: Odd multipliers of the mixing step; any odd 64-bit constants of high entropy do.
_MIX_A = np.uint64(0x9E3779B97F4A7C15)
_MIX_B = np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of the words, in order."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One 64-bit hash per pair (left, right); the order of the two matters."""
    x = left * _MIX_A + (right ^ (right >> np.uint64(31))) * _MIX_B
    return x ^ (x >> np.uint64(29))


def split_of(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % parts


def bounded_ids(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The distinct ids of at most ``rows`` rows, those of the lowest hashes of ``key``: the
    documented bound on what a classifier is fitted on, small enough to be sent to every task.
    Nothing else is ever sampled. Null ids are left out.

    Only ids are read. A count tells below which hash four times as many are to be expected;
    those alone are put in order."""
    number = F.xxhash64(F.col(key).cast("string"))
    ids = df.select(key).filter(F.col(key).isNotNull())
    n = ids.count()
    if n > 4 * rows:
        ids = ids.filter(number < F.lit(-(1 << 63) + (1 << 64) * 4 * rows // n))
    return ids.orderBy(number, key).limit(rows).distinct()


def bounded_ids_by_label(df: DataFrame, key: str, label: str, rows: int) -> DataFrame:
    """As ``bounded_ids``, with the same room for every label: all rows of a label that has no more than
    its share of ``rows``, and as many more of the others. Of more than ``rows`` labels the most frequent
    are taken. Null labels are left out.

    Only ids and labels are read. The hash of a row's id, stretched by what its label has too many, is its
    place; expected to be in front are as many of a label as there is room for. Nothing is shuffled by label."""
    ids = df.select(key, label).filter(F.col(key).isNotNull() & F.col(label).isNotNull())
    counts = ids.groupBy(label).count().orderBy(F.desc("count"), label).limit(rows).collect()
    room, left = [], rows
    for i, r in enumerate(reversed(counts)):
        share = min(r["count"], left // (len(counts) - i))
        left -= share
        room.append((r[label], 0.0 if share == r["count"] else r["count"] / share))
    kind = dict(ids.dtypes)[label]
    stretch = df.sparkSession.createDataFrame(room, f"`{label}` {kind}, __stretch double")
    number = F.xxhash64(F.col(key).cast("string"))
    place = (number / F.lit(2.0**64) + 0.5) * F.col("__stretch")
    near = ids.join(F.broadcast(stretch), label).withColumn("__place", place).filter("__place < 4")
    return near.orderBy("__place", number, key).limit(rows).select(key).distinct()


#: Bytes of text that a task holds as Python objects at a time; a longer text is alone.
SLICE_BYTES = 4 << 20


def sliced(batch: pa.RecordBatch, columns: Iterable[str], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of text in ``columns``, one row at least."""
    size = np.full(batch.num_rows, 16, np.int64)
    for c in columns:
        kind = batch.schema.field(c).type
        if pa.types.is_string(kind) or pa.types.is_binary(kind):
            size += pc.binary_length(batch.column(c)).fill_null(0).to_numpy(zero_copy_only=False)
    # A piece ends where the sum passes a multiple of the limit.
    ends = np.cumsum(size) // limit
    edges = [0, *(np.flatnonzero(np.diff(ends)) + 1), batch.num_rows]
    for start, end in zip(edges, edges[1:]):
        if end > start:
            yield batch.slice(start, end - start)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many more underscores in front as make it differ from every column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def map_batches(
    df: DataFrame,
    schema: str,
    rows: Callable[[dict[str, list]], dict[str, Iterable]],
    keep: Iterable[str] = (),
) -> DataFrame:
    """``rows`` applied to pieces of each Arrow batch as a dict of lists, without the columns ``keep``, which
    pass untouched; gives the columns ``keep``, then those of ``schema``. ``df`` has no other
    columns than these two need. Pieces are cut by bytes of text (``SLICE_BYTES``), so the Python objects of a
    task stay as small however many rows a batch has; each piece is sent on by itself."""
    keep = tuple(keep)
    kept = [StructField(c, df.schema[c].dataType) for c in keep]
    whole = StructType([*kept, *StructType.fromDDL(schema)])
    arrow = to_arrow_schema(whole)
    taken = [c for c in df.columns if c not in keep]

    def as_field(value, field: pa.Field) -> pa.Array:
        value = value if isinstance(value, pa.Array) else pa.array(value, type=field.type)
        return value if value.type == field.type else value.cast(field.type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in sliced(batch, taken):
                out = rows(piece.select(taken).to_pydict())
                columns = {**{k: piece.column(k) for k in keep}, **out}
                yield pa.RecordBatch.from_arrays([as_field(columns[f.name], f) for f in arrow], schema=arrow)
                del out, columns

    return df.mapInArrow(run, whole)


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of the UTF-8 bytes of the expression ``text``."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ 0xEDB88320 * (n & 1)
        table.append(n)
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || substring(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    step = f"xor(c >> 8, CAST({table}[(xor(c, b) & 255) + 1] AS BIGINT))"
    return f"xor(list_reduce({octets}, lambda c, b: {step}, CAST(4294967295 AS BIGINT)), 4294967295)"
