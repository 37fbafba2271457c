"""SimHash near-duplicates by deletion-variant signatures.

Two fingerprints of 64 bits that differ in at most ``DISTANCE`` bits, cut into ``SEGMENTS`` segments (fewer
than bits may differ), agree in one segment but for at most one bit. So each fingerprint is indexed under the
variants of its segments with one bit wiped out, a *wildcard*, and those that may be linked meet by equality of
a variant. Meetings are verified on whole fingerprints.

The plan, none of whose steps makes the pairs of a group:

1. Equal fingerprints collapse to one, with the least id of their documents.
2. Fingerprints of a variant are its *bucket*. All of a bucket are compared with its least one, the pivot.
   Linked ones form components.
3. In a bucket that still holds several components, members of the largest one need not be compared with each
   other. Are the others at most ``SMALL``, each of them is compared with all members, so no member makes more than
   ``SMALL`` pairs. Else the bucket's members are indexed again by variants of the bits that the bucket leaves
   open, and step 2 starts anew. From 64 open bits 33, 18, 10, 6 and 4 are left, and of the last there are no more
   than 16 values.
4. The components over all links are the classes.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import map_batches, words_of
from riskloom.llm.connected import components
from riskloom.operators.joining import lookup_join
from riskloom.sources import freeze

BITS, DISTANCE, SEGMENTS = 64, 3, 2
SHINGLE, SEED = 3, 42
#: Members outside a bucket's largest component up to which they are compared with all of the bucket.
SMALL = 32
#: Shingles whose bits are counted at a time.
_BLOCK = 1 << 14


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of the shingles, repeats included: ``size`` words joined by a space. A text of fewer words is one
    shingle, one without words none."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    size = min(size, len(words))
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    found = [digest(whole[i:j], SEED) for i, j in zip(starts, ends[size - 1 :].tolist())]
    return np.array(found, np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bit i is set where over half the hashes have it; 0 without hashes."""
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        octets = hashes[at : at + _BLOCK].astype(">u8").view(np.uint8).reshape(-1, BITS // 8)
        count += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, id: str, text: str, words: int = SHINGLE) -> DataFrame:
    """``(id, print)`` per row, the fingerprint as a signed bigint. Null and empty texts have 0."""

    def rows(batch):
        found = [fingerprint_of(shingle_hashes(t, words)) for t in batch["text"]]
        return {"id": batch["id"], "print": np.array(found, np.uint64).view(np.int64)}

    source = df.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
    return map_batches(source, "id long, print long", rows)


def submasks(mask: int) -> list[int]:
    """The bits known of two fingerprints that agree on ``mask`` and meet on a variant of the others: these are
    cut into ``SEGMENTS``, and one segment but for one bit is added to ``mask``."""
    rest = [b for b in range(BITS) if not mask >> b & 1]
    cuts = [len(rest) * i // SEGMENTS for i in range(SEGMENTS + 1)]
    out = []
    for low, high in zip(cuts, cuts[1:]):
        whole = sum(1 << b for b in rest[low:high])
        out += [mask | whole & ~(1 << b) for b in rest[low:high]]
    return out


def _signed(masks: list[int]) -> np.ndarray:
    return np.array(masks, np.uint64).view(np.int64)


def _first_variants(prints: DataFrame) -> DataFrame:
    """``(print, mask, value)``: each fingerprint under the variants of its segments."""
    masks = F.array(*[F.lit(int(m)).cast("bigint") for m in _signed(submasks(0))])
    every = prints.select("print", F.explode(masks).alias("mask"))
    return every.withColumn("value", F.col("print").bitwiseAND(F.col("mask")))


def _further_variants(members: DataFrame) -> DataFrame:
    """Members of buckets under the variants of the bits that their buckets leave open."""

    def rows(batch):
        subs = {m: _signed(submasks(m % (1 << BITS))) for m in set(batch["mask"])}
        kinds = [subs[m] for m in batch["mask"]]
        mask = np.concatenate(kinds) if kinds else np.zeros(0, np.int64)
        prints = np.repeat(np.array(batch["print"], np.int64), [len(k) for k in kinds])
        return {"print": prints, "mask": mask, "value": prints & mask}

    return map_batches(members.select("print", "mask"), "print long, mask long, value long", rows).distinct()


def _near(a: Column, b: Column, distance: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def _placed(met: DataFrame, links: DataFrame) -> DataFrame:
    """``met`` with ``component``, that of its fingerprint."""
    known = components(links).withColumnRenamed("node", "print")
    return met.join(known, "print", "left").withColumn("component", F.coalesce("component", "print"))


def links_between(prints: DataFrame, distance: int = DISTANCE, small: int = SMALL) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``prints(print)``, each of at most ``distance`` bits, that
    connect all those which links of that length connect. ``distance`` is below twice ``SEGMENTS``."""
    if not 0 <= distance < 2 * SEGMENTS:
        raise ValueError(f"distance must be from 0 to {2 * SEGMENTS - 1}, not {distance}")
    small = max(small, 16)  # as many as the last buckets can hold
    bucket = ["mask", "value"]
    members, links = _first_variants(prints), None
    while True:
        shared = members.groupBy(*bucket).agg(F.min("print").alias("pivot"), F.max("print").alias("last"))
        shared = shared.filter("pivot < last").drop("last")
        met = freeze(lookup_join(members, shared, bucket, "inner"))
        to_pivot = met.filter((F.col("print") != F.col("pivot")) & _near(F.col("print"), F.col("pivot"), distance))
        to_pivot = to_pivot.select(F.col("pivot").alias("a"), F.col("print").alias("b")).distinct()
        links = freeze(to_pivot if links is None else links.union(to_pivot).distinct())
        placed = freeze(_placed(met.drop("pivot"), links))
        sizes = placed.groupBy(*bucket, "component").agg(F.count(F.lit(1)).alias("n"))
        mixed = sizes.groupBy(*bucket).agg(
            F.max_by("component", F.struct("n", "component")).alias("main"),
            F.max("n").alias("most"),
            F.sum("n").alias("n"),
        )
        # Of the largest component no two members have to be compared, so others are what counts.
        mixed = mixed.filter("n > most").select(*bucket, "main", (F.col("n") - F.col("most") > small).alias("large"))
        inside = freeze(lookup_join(placed, mixed, bucket, "inner"))
        few = inside.filter("not large")
        side = lambda df, end: df.select(*bucket, *[F.col(c).alias(f"{c}_{end}") for c in ("print", "component")])
        met_inside = side(few.filter("component <> main"), "x").join(side(few, "y"), bucket)
        apart = F.col("component_x") != F.col("component_y")
        pairs = met_inside.filter(apart & _near(F.col("print_x"), F.col("print_y"), distance))
        a, b = F.least("print_x", "print_y"), F.greatest("print_x", "print_y")
        links = freeze(links.union(pairs.select(a.alias("a"), b.alias("b"))).distinct())
        many = inside.filter("large")
        if many.isEmpty():
            return links
        members = freeze(_further_variants(many))


def simhash_duplicates(
    df: DataFrame, id: str, text: str, words: int = SHINGLE, distance: int = DISTANCE, small: int = SMALL
) -> DataFrame:
    """One row per row of ``df``: ``id`` (as bigint), ``fingerprint`` (16 hex digits), ``component_id``.

    Rows are linked where their fingerprints differ in at most ``distance`` bits; ``component_id`` is the least id
    reachable. Null, empty and blank texts have the fingerprint 0 and are linked like any other. Rows of a null id
    link as others do and bear the least id of their component, null if it has none; a repeated id links all
    that any of its rows is equal to by its fingerprint, and its rows may have different components. No rows in,
    no rows out. Fingerprints are made once and written; after that only they and ids are shuffled."""
    marked = freeze(fingerprints(df, id, text, words))
    prints = freeze(marked.groupBy("print").agg(F.min("id").alias("least")))
    links = links_between(prints.select("print"), distance, small)
    known = components(links).withColumnRenamed("node", "print")
    rooted = prints.join(known, "print", "left").withColumn("component", F.coalesce("component", "print"))
    least = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = rooted.select("print", "component").join(least, "component").select("print", "component_id")
    hexed = F.lower(F.lpad(F.hex("print"), BITS // 4, "0")).alias("fingerprint")
    return lookup_join(marked, classes, ["print"]).select(F.col("id").alias(id), hexed, "component_id")
