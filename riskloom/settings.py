"""Limits the operators read from the session, so a cluster can set its own.

========================================  =========  =====================================
setting                                   default    meaning
========================================  =========  =====================================
``spark.riskloom.broadcastBytes``         32 MiB     largest measured lookup sent to every
                                                     executor
``spark.riskloom.hotShare``               see below  share of rows from which a key is hot
``spark.riskloom.buckets``                see below  buckets of a global order
========================================  =========  =====================================

``hotShare`` follows ``spark.sql.shuffle.partitions``: a key is hot when it outweighs an
average shuffle partition, or a hundredth of the rows where partitions are fewer than that.
It is never under ``LEAST_HOT_SHARE``, since a sketch tracks a million items at most: with more
than 125,000 partitions a key may then outweigh an average one before it counts as hot.
A global order gets a bucket per partition, and more where ``ROWS_PER_BUCKET`` ask for them.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_bytes(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.riskloom.broadcastBytes", str(32 * 2**20)))


# Rows one task is to put in order within a bucket.
ROWS_PER_BUCKET = 1_000_000


# The least share for which ``sketching.frequent_items`` may track enough items.
LEAST_HOT_SHARE = 8e-6


def hot_share(spark: SparkSession) -> float:
    fallback = 1 / max(shuffle_partitions(spark), 100)
    return max(LEAST_HOT_SHARE, float(spark.conf.get("spark.riskloom.hotShare", str(fallback))))


def buckets(spark: SparkSession, rows: int = 0) -> int:
    fallback = max(shuffle_partitions(spark), 16, -(-rows // ROWS_PER_BUCKET))
    return int(spark.conf.get("spark.riskloom.buckets", str(fallback)))


def hash_digits(rows: int) -> int:
    """Hex digits of a hash that make a bucket: 65,536 buckets, or as many as the rows ask for."""
    digits = 4
    while rows > ROWS_PER_BUCKET * 16**digits:
        digits += 1
    return digits
