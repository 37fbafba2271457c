"""Document fingerprints of closed syncmers, in DataFrame functions only.

The letters of the alphabet are a text's tokens: words, and every other sign that is no white
space by itself. A k-mer is k tokens in a row. It is a closed syncmer where the least of the
hashes of its s-mers belongs to its first or its last one. That depends on the k-mer alone, not
on its neighbours, so texts that share a passage share its anchors, wherever they stand.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, S = 6, 2
#: A token: a run of letters and digits, or one other sign.
TOKEN = r"[\p{L}\p{N}]+|\S"
#: Hex digits of an anchor in a fingerprint.
DIGITS = 6
#: Buckets of ids per shuffle partition when each row meets the next one.
BUCKETS_PER_PARTITION = 8


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once for each row, also where ``body`` uses it in a loop."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _closed(tokens: Column, k: int, s: int) -> Column:
    """(position, anchor) of the closed syncmers; ``tokens`` are hashes, at least k of them."""
    n, span = F.size(tokens), k - s
    size = min(4, span)
    # Minima of stretches of ``size`` hashes; those at ``offsets`` cover all of ``span``.
    offsets = sorted({*range(0, span - size + 1, size), span - size})
    mer = lambda i, length: F.xxhash64(*[F.get(tokens, i + x) for x in range(length)])

    def stretches(h: Column) -> Column:
        least = lambda i: F.least(*[F.get(h, i + x) for x in range(size)])
        return F.transform(F.sequence(F.lit(0), n - s - (size - 1)), least) if size > 1 else h

    def marks(h: Column, low: Column) -> Column:
        def edge(i: Column) -> Column:
            # Where one edge is below all but the other edge, the least of all is at an edge.
            first, last = F.get(h, i), F.get(h, i + span)
            at_first = reduce(and_, [first <= F.get(low, i + x) for x in offsets])
            return at_first | reduce(and_, [last <= F.get(low, i + x) for x in offsets])

        return F.transform(
            F.filter(F.sequence(F.lit(0), n - k), edge),
            lambda i: F.struct(i.alias("position"), mer(i, k).alias("anchor")),
        )

    hashes = F.transform(F.sequence(F.lit(0), n - s), lambda i: mer(i, s))
    return _let(hashes, lambda h: _let(stretches(h), lambda low: marks(h, low)))


def with_anchors(df: DataFrame, text: str, into: str, k: int = K, s: int = S) -> DataFrame:
    """``df`` with ``into``: an array of (position, anchor) for the closed syncmers of ``text``, by
    position in tokens. A text without one (of fewer than k tokens, or by chance) has one anchor,
    the hash of the whole text, at -1; an empty or null one has none."""
    value = F.coalesce(F.col(text), F.lit(""))
    whole = F.array(F.struct(F.lit(-1).alias("position"), F.xxhash64(value).alias("anchor")))
    none = F.array().cast("array<struct<position:int,anchor:bigint>>")
    tokens = F.transform(F.regexp_extract_all(value, F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))
    closed = _let(tokens, lambda h: F.when(F.size(h) >= k, _closed(h, k, s)))
    chosen = lambda c: F.when(F.size(c) > 0, c).when(F.length(value) > 0, whole).otherwise(none)
    return df.withColumn(into, _let(closed, chosen))


def likeness(a: Column, b: Column) -> Column:
    """Distinct anchors shared, over those of the side that has more; two empty sides are alike."""
    x = F.array_distinct(F.transform(a, lambda m: m["anchor"]))
    y = F.array_distinct(F.transform(b, lambda m: m["anchor"]))
    more = F.greatest(F.size(x), F.size(y))
    return F.when(more == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / more)


def fingerprint(anchors: Column) -> Column:
    """The anchors by position as one string of hex digits, ``DIGITS`` of each."""
    low = lambda m: F.lpad(F.hex(m["anchor"].bitwiseAND(F.lit((1 << 4 * DIGITS) - 1))), DIGITS, "0")
    return F.lower(F.array_join(F.transform(anchors, low), ""))


def with_buckets(df: DataFrame, id: str) -> tuple[DataFrame, Window]:
    """``df`` dealt into ranges of ids, each range also holding the first rows of the next one
    (``__guest``), and the window over a range in order of the id, then of all its text.

    Ranges follow sketched quantiles. Only the ranges' first ids reach the driver, a few for
    each shuffle partition; they go back as a table of that size. After the last range comes
    the first. Null ids come last."""
    spark = df.sparkSession
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions")) * BUCKETS_PER_PARTITION
    numbered = df.withColumn("__place", F.col(id).cast("double"))
    marks = [i / wanted for i in range(1, wanted)]
    edges = numbered.approxQuantile("__place", marks, 0.25 / wanted) if marks else []
    cuts = [float("-inf"), *(sorted(set(edges)) or [0.0]), float("inf")]
    dealt = Bucketizer(splits=cuts, inputCol="__place", outputCol="__range", handleInvalid="keep").transform(numbered)
    dealt = dealt.drop("__place")
    first = dealt.select("__range", id).groupBy("__range").agg(F.min(id).alias("first")).orderBy("__range").collect()
    hosts = [(r["first"], first[i - 1]["__range"]) for i, r in enumerate(first)]
    kind = dict(df.dtypes)[id]
    table = spark.createDataFrame(hosts, f"__first {kind}, __host double")
    met = dealt.join(F.broadcast(table), F.col(id).eqNullSafe(F.col("__first")), "left").drop("__first")
    own = F.struct(F.col("__range").alias("range"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("__host").alias("range"), F.lit(True).alias("guest"))
    spread = met.withColumn(
        "__in", F.explode(F.when(F.col("__host").isNull(), F.array(own)).otherwise(F.array(own, guest)))
    )
    spread = spread.withColumns({"__bucket": F.col("__in.range"), "__guest": F.col("__in.guest")})
    return spread.drop("__range", "__host", "__in"), Window.partitionBy("__bucket")


def fingerprint_edits(df: DataFrame, id: str, text: str, k: int = K, s: int = S) -> DataFrame:
    """Each row's fingerprint beside that of its edited text and of the next row's text.

    The edited text: the last floor(n / 4) of n code points replaced by the first as many (or all)
    of the next row's, by ascending ``id``; after the last row comes the first. Returns ``id``, ``n_chars``,
    ``edited``, ``anchors``, ``edited_anchors``, ``next_anchors``. Null texts count as empty. Rows of equal id follow
    each other by text, so repeated rows have a defined next one; null ids come last. A single row
    is its own next. One shuffle carries the texts; anchors are made after it, once for each row."""
    narrow = df.select(F.col(id).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    dealt, bucket = with_buckets(narrow, "__id")
    window = bucket.orderBy("__guest", F.col("__id").asc_nulls_last(), "__text")
    ahead = dealt.withColumn("__next", F.lead("__text").over(window))
    ahead = with_anchors(ahead, "__text", "anchors", k, s)
    ahead = ahead.withColumn("next_anchors", F.lead("anchors").over(window)).filter(~F.col("__guest"))
    n = F.length("__text")
    cut = (n - F.floor(n / 4)).cast("int")
    edited = F.concat(F.substring("__text", F.lit(1), cut), F.substring("__next", F.lit(1), n - cut))
    out = with_anchors(ahead.withColumn("edited", edited), "edited", "edited_anchors", k, s)
    n_chars = n.cast("long").alias("n_chars")
    return out.select(F.col("__id").alias(id), n_chars, "edited", "anchors", "edited_anchors", "next_anchors")
