"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

A shingle is hashed into the universe Z_D. One permutation, sigma, shuffles the universe once; a
second, pi, circularly shifted by k, gives coordinate k of the signature:
``min over s of pi[(sigma(s) + k) mod D]``. The K shifts of one element lie side by side in pi,
so a signature is the elementwise minimum of K-long windows of one table.

The plan:

1. Equal sets collapse to the row of the least id, their *representative*.
2. Representatives meet in buckets, one per band. Each bucket has a pivot, its least id; every
   member is compared with the pivot alone, on full sets. Linked ones form components.
3. Further rounds: the members of a pivot that are neither linked with it nor of one component get
   the least of them as next pivot and are compared with it alone, as long as a round links a tenth
   of what it compares. So a family that is short of its pivot collapses, in comparisons linear
   in its size. Components are contracted after each round.
4. Members of a pivot of step 2 that still lie in different components may be linked with each
   other, unless both are linked with the pivot. ``_crossing`` finds all those that can be from
   what each has more or less than the pivot; they are compared on full sets. Only this
   step decides what is left, so nothing rests on the rounds of step 3 but the work.
5. The components over all links are the classes.

Why 4 finds all: let x and y have a_x, a_y shingles less and b_x, b_y more than the pivot. They are linked at
similarity t only if their sets differ by at most q = (1-t)/(1+t) of both sizes together. They
differ by a_x + b_x + a_y + b_y less twice what their differences share. So the shingles that
both have more are at least (f(x) - h(y)) / 2 and at least (f(y) - h(x)) / 2, where
f = a + b - q * size and h = a - b + q * size. If both numbers are 0 or less, sizes alone do
not tell, and the pair is compared; else the two share one of the shingles they have more, even after the
most frequent ones but for that number are left out on both sides, in one order for all.

A pair at the threshold 0.8 shares no band with probability (1 - 0.8^6)^40 = 5e-6, a more
similar one still less often.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import fresh, hash_words, map_batches, mix, words_of
from riskloom.llm.connected import components
from riskloom.sources import freeze

BANDS, ROWS = 40, 6
UNIVERSE_BITS, SEED = 20, 7


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words. A text of fewer words
    is one shingle, one without words none."""
    h = hash_words(words_of(text))
    if len(h) == 0:
        return h
    n = max(1, len(h) - size + 1)
    out = h[:n]
    for i in range(1, min(size, len(h))):
        out = mix(out, h[i : i + n])
    # Shorter texts must not meet the shingles of longer ones.
    return np.unique(out if len(h) >= size else ~out)


@lru_cache(maxsize=1)
def _tables(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """sigma, and for each start the window of pi with its circular shifts 0 to K-1."""
    size = 1 << UNIVERSE_BITS
    draw = np.random.default_rng(SEED)
    sigma = draw.permutation(size).astype(np.int32)
    pi = draw.permutation(size).astype(np.int32)
    wide = np.concatenate([pi, pi[: bands * rows]])
    return sigma, np.lib.stride_tricks.sliding_window_view(wide, bands * rows)


def signature(shingles: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """The ``bands * rows`` coordinates of a set that is not empty."""
    sigma, windows = _tables(bands, rows)
    at = sigma[(shingles >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)]
    parts = [windows[at[i : i + 2048]].min(axis=0) for i in range(0, len(at), 2048)]
    return np.minimum.reduce(parts)


def band_keys(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    table = coordinates.reshape(bands, rows).astype(np.uint64)
    key = np.arange(bands, dtype=np.uint64)
    for i in range(rows):
        key = mix(key, table[:, i])
    return key.view(np.int64)


def _signed(df: DataFrame, id: str, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """Per row: id, n_shingles, set_key (16 bytes, null without words), bands."""

    def run(batch):
        sets = [shingle_set(t, size) for t in batch["text"]]
        keys = [
            band_keys(signature(s, bands, rows), bands, rows) if len(s) else np.zeros(0, np.int64)
            for s in sets
        ]
        offsets = np.cumsum([0, *map(len, keys)]).astype(np.int32)
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        return {
            "id": batch["id"],
            "n_shingles": [len(s) for s in sets],
            "set_key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
            "bands": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)).cast(
                pa.list_(pa.field("element", pa.int64()))
            ),
        }

    source = df.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
    return map_batches(source, "id long, n_shingles long, set_key binary, bands array<long>", run)


def _full_sets(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """``(id, shingles)`` of the rows that are in a pair, made once. The texts are shuffled to the
    ids, never the ids sent to all texts: they grow with the corpus."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().hint("merge")

    def sets(batch):
        return {"shingles": [shingle_set(t, size).tobytes() for t in batch["text"]]}

    met = texts.join(needed, "id", "left_semi")
    return freeze(map_batches(met, "shingles binary", sets, ["id"]))


def _compared(pairs: DataFrame, full: DataFrame, more: bool) -> DataFrame:
    """The pairs with the sizes of both full sets and of what they share; with ``more`` also the
    shingles that only ``b`` has."""

    def compare(batch):
        out = {k: [] for k in ("n_a", "n_b", "shared", *(["added"] if more else []))}
        for x, y in zip(batch["x"], batch["y"]):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.isin(q, p, assume_unique=True)
            out["n_a"].append(len(p))
            out["n_b"].append(len(q))
            out["shared"].append(int(both.sum()))
            if more:
                out["added"].append(q[~both].view(np.int64))
        return out

    met = pairs.join(full.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    met = met.join(full.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    schema = "n_a long, n_b long, shared long" + ", added array<long>" * more
    return freeze(map_batches(met.select("a", "b", "x", "y"), schema, compare, ["a", "b"]))


def _linked(percent: int) -> Column:
    union = F.col("n_a") + F.col("n_b") - F.col("shared")
    return F.col("shared") * 100 >= union * percent


def _crossing(canopies: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of members of a canopy that may be linked and are not known to be of one
    component; see the module's text. ``canopies``: pivot, id, n, less, added, far (not
    linked with the pivot), component. Numbers are whole, in units of 1 / (100 + percent)."""
    scale, q = 100 + percent, 100 - percent
    more = F.size("added")
    known = canopies.withColumns(
        {
            "f": (F.col("less") + more) * scale - F.col("n") * q,
            "h": (F.col("less") - more) * scale + F.col("n") * q,
        }
    )
    of = known.groupBy("pivot").agg(
        F.max("h").alias("h_max"),
        F.min(F.when(F.col("far"), F.col("f"))).alias("f_min"),
        F.min("component").alias("low"),
        F.max("component").alias("high"),
    )
    of = freeze(of.filter("low < high").select("pivot", "h_max", "f_min"))
    known = freeze(known.join(of, "pivot"))

    def side(df: DataFrame, end: str, *keys: str) -> DataFrame:
        renamed = [F.col(c).alias(f"{c}_{end}") for c in ("id", "n", "f", "h", "component")]
        return df.select(*keys, *renamed)

    def pairs(df: DataFrame) -> DataFrame:
        small, large = F.least("n_x", "n_y"), F.greatest("n_x", "n_y")
        may = (F.col("component_x") != F.col("component_y")) & (small * 100 >= large * percent)
        a, b = F.least("id_x", "id_y"), F.greatest("id_x", "id_y")
        return df.filter(may).select(a.alias("a"), b.alias("b"))

    far = known.filter("far")
    either = side(far.filter("f <= h_max"), "x", "pivot").join(
        side(known.filter("h >= f_min"), "y", "pivot"), "pivot"
    )
    by_size = pairs(either.filter("h_y >= f_x and h_x >= f_y"))

    spread = known.select("pivot", "id", "n", "f", "h", "h_max", "far", "component", F.explode("added").alias("s"))
    # Only shingles that a far member and one of another component have can join a pair.
    common = freeze(
        spread.groupBy("pivot", "s")
        .agg(F.count(F.lit(1)).alias("many"), F.min("component").alias("low"), F.max("component").alias("high"), F.max("far").alias("any"))
        .filter("low < high and any")
        .select("pivot", "s", "many")
    )
    # Of each side's shingles the most frequent ones are left out, one less than must be shared.
    must = F.greatest(F.lit(1), F.ceil((F.col("f") - F.col("h_max")) / (2 * scale)))
    rare = Window.partitionBy("pivot", "id").orderBy(F.col("many").desc(), "s")
    spread = spread.join(common, ["pivot", "s"]).withColumn("place", F.row_number().over(rare))
    spread = freeze(spread.filter(F.col("place") >= must))
    meeting = side(spread.filter("far"), "x", "pivot", "s").join(side(spread, "y", "pivot", "s"), ["pivot", "s"])
    return by_size.union(pairs(meeting)).distinct()


def _merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes(node, component)``, which hold every end of ``links(a, b)``, with the links contracted."""
    end = lambda c: classes.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))
    edges = links.join(end("a"), "a").join(end("b"), "b").select(F.col("a_of").alias("a"), F.col("b_of").alias("b"))
    to = components(edges).select(F.col("node").alias("component"), F.col("component").alias("to"))
    moved = classes.join(to, "component", "left")
    return freeze(moved.select("node", F.coalesce("to", "component").alias("component")))


def _further_pivots(far: DataFrame, full: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``classes`` after the rounds of step 3; ``far(canopy, id)`` are the members not linked with their pivot."""
    rest = far
    while True:
        placed = rest.join(classes.withColumnRenamed("node", "id"), "id")
        lead = placed.groupBy("canopy").agg(
            F.min("id").alias("next"),
            F.min_by("component", "id").alias("of_next"),
            F.min("component").alias("low"),
            F.max("component").alias("high"),
        )
        lead = lead.filter("low < high").select("canopy", "next", "of_next")
        rest = freeze(placed.join(lead, "canopy").filter("component <> of_next").select("canopy", "id", "next"))
        pairs = freeze(rest.select(F.col("next").alias("a"), F.col("id").alias("b")).distinct())
        linked = freeze(_compared(pairs, full, more=False).filter(_linked(percent)).select("a", "b"))
        tried, found = pairs.count(), linked.count()
        if found:
            classes = _merged(classes, linked)
        if found * 10 <= tried:
            return classes
        met = linked.select(F.col("a").alias("next"), F.col("b").alias("id"))
        rest = freeze(rest.join(met, ["next", "id"], "left_anti").select("canopy", "id"))


def near_duplicates(
    df: DataFrame, id: str, text: str, *,
    words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """One row per row of ``df``: ``id``, ``n_shingles``, ``component_id``, ``kept``.

    Rows are linked where their sets of ``words``-word shingles share at least ``percent`` per
    cent of their union; ``component_id`` is the least id reachable and ``kept`` marks rows of
    that id. Null and empty texts are linked with nothing. Rows of a null id keep a null
    component, are not kept and link nothing; a repeated id with equal texts gives repeated rows,
    with different texts one class. No rows in, no rows out.
    """
    signed = freeze(_signed(df, id, text, words, bands, rows))
    named = signed.filter("id is not null and set_key is not null")
    copies = freeze(
        named.groupBy("set_key")
        .agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("set_key", "rep")
    )
    member = signed.join(copies, "set_key", "left").select(
        "id", "n_shingles", "bands", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep")
    )
    member = freeze(member.withColumn("bands", F.when(F.col("id") == F.col("rep"), F.col("bands"))))
    banded = member.filter("bands is not null").select(
        "id", F.explode("bands").alias("key")
    )
    buckets = freeze(
        banded.groupBy("key")
        .agg(F.min("id").alias("pivot"), F.max("id").alias("last"))
        .filter("pivot < last")
        .select("key", "pivot")
    )
    met = banded.join(buckets.hint("merge"), "key")
    texts = df.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))

    to_pivot = met.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    to_pivot = freeze(to_pivot.distinct())
    full = _full_sets(to_pivot, texts, words)
    compared = _compared(to_pivot, full, more=True).withColumn("far", ~_linked(percent))
    links = compared.filter(~F.col("far")).select("a", "b")
    first = components(links).withColumnRenamed("node", "id")
    nodes = compared.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(first, "id", "left")
    classes = freeze(nodes.select(F.col("id").alias("node"), F.coalesce("component", "id").alias("component")))
    short = freeze(compared.filter("far").select(F.col("a").alias("canopy"), F.col("b").alias("id")))
    classes = _further_pivots(short, full, classes, percent)

    canopies = compared.select(
        F.col("a").alias("pivot"),
        F.col("b").alias("id"),
        F.col("n_b").alias("n"),
        (F.col("n_a") - F.col("shared")).alias("less"),
        "added",
        "far",
    )
    canopies = freeze(canopies.join(classes.withColumnRenamed("node", "id"), "id"))
    crossing = freeze(_crossing(canopies, percent))
    more = _compared(crossing, full, more=False).filter(_linked(percent)).select("a", "b")
    classes = _merged(classes, freeze(more))
    result = member.join(classes.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("id").alias(id),
        "n_shingles",
        F.coalesce("component", "rep").alias("component_id"),
    )
    return result.withColumn("kept", _is(F.col(id), F.col("component_id")))


def _is(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def drop_near_duplicates(df: DataFrame, id: str, text: str, **how) -> DataFrame:
    """``df`` with one row of each class, that of the least id; ``how`` as for ``near_duplicates``.
    Of rows that share an id the one of the least text stays, and of these the one whose other columns have
    the least hash. Rows of a null id all stay."""
    at, row = fresh(df, "__kept"), fresh(df, "__row")
    kept = near_duplicates(df, id, text, **how).filter("kept").select(F.col(id).alias(at)).distinct()
    others = F.to_json(F.struct(*[c for c in df.columns if c != text]))
    order = F.struct(F.coalesce(text, F.lit("")), F.xxhash64(others))
    named = df.join(kept, F.col(id) == F.col(at), "left_semi")
    first = named.groupBy(id).agg(F.min_by(F.struct(*df.columns), order).alias(row)).select(f"{row}.*")
    return first.unionByName(df.filter(F.col(id).isNull()))
