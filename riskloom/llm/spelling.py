"""Spelling variants: words one edit apart, found by k-d trees over letter-count vectors.

A word's vector says how often it has each letter. One letter more or less changes one count by one; another letter in
one place lowers one count and raises another one. So words one edit apart lie at an L1 distance of at most two, and
more exactly: from a word to one of the same length no more than one up and one down, to one a letter longer one up and
none down. These bounds prune a k-d tree, one per length: a query goes down a branch only while the branch's box is no
farther up or down than that. The points left are verified letter by letter.

The upper part of each tree, cut into *cells* of about ``CELL_WORDS`` words, is grown from a bounded sample of words; it
only says where words go. Each word is sent to its cell, and as a query to the cells of its own length and of the next
one that its box reaches. A cell is a group: its words make the lower part of the tree there. Beyond ``CELLS`` cells these
grow with the vocabulary, never the sample.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from riskloom.llm.common import crc32_sql, map_batches
from riskloom.operators.joining import lookup_join
from riskloom.sources import freeze

LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: A run of letters loses one where its crc32 is a multiple of this.
TYPO_EVERY = 199
#: Words of a cell and of a leaf; most cells; most words that the cells are grown from.
CELL_WORDS, LEAF_WORDS, CELLS, SAMPLE = 1 << 13, 32, 1 << 12, 1 << 16
#: A letter's place in a vector is its code point modulo this; letters up to U+00FF have places of their own.
PLACES = 256
#: Pairs that are compared at a time.
_PAIRS = 1 << 16


def runs(text: str | None, least: int = LEAST_LENGTH) -> list[str]:
    """The maximal runs of Latin-1 letters of at least ``least`` code points, A-Z lowered."""
    lowered = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    return re.findall(rf"[a-zÀ-ÿ]{{{least},}}", lowered)


def words_in(id, text: str | None, every: int = TYPO_EVERY, least: int = LEAST_LENGTH) -> Counter:
    """Runs of a document and how often they occur; some with a letter dropped, as the crc32 of ``id:run`` says."""
    found: Counter = Counter()
    start = zlib.crc32(f"{'' if id is None else id}:".encode())
    # What is left of a run may be another run of the document, whose own crc32 says nothing about it.
    for run, n in Counter(runs(text, least)).items():
        number = zlib.crc32(run.encode(), start)
        at = number % len(run)
        word = run[:at] + run[at + 1 :] if number % every == 0 else run
        if len(word) >= least:
            found[word] += n
    return found


def word_counts(df: DataFrame, id: str, text: str, least_count: int = LEAST_COUNT) -> DataFrame:
    """``(word, n)`` of the words of at least ``LEAST_LENGTH`` code points that occur ``least_count`` times in all."""

    def rows(batch):
        total: Counter = Counter()
        for i, t in zip(batch["id"], batch["text"]):
            total.update(words_in(i, t))
        return {"word": list(total), "n": list(total.values())}

    source = df.select(F.col(id).alias("id"), F.col(text).alias("text"))
    some = map_batches(source, "word string, n long", rows)
    return some.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def vectors(words: list[str]) -> np.ndarray:
    """Letter counts, a row per word."""
    lengths = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) % PLACES
    cell = np.repeat(np.arange(len(words)), lengths) * PLACES + codes
    counts = np.bincount(cell, minlength=len(words) * PLACES).reshape(-1, PLACES)
    return counts.astype(np.uint8 if lengths.max(initial=0) < 256 else np.int32)


@dataclass
class Node:
    """An inner node sends points under ``cut`` at ``place`` to ``low``; a leaf has ``points`` (or the number of a cell)."""

    points: np.ndarray | int | None = None
    place: int = 0
    cut: int = 0
    low: Node | None = None
    high: Node | None = None


def best_cut(x: np.ndarray) -> tuple[int, int] | None:
    """Place and cut that come nearest to halves; None where all vectors are equal. Ties go to the first place."""
    half, best, found = len(x) / 2, len(x), None
    for place in np.flatnonzero(x.min(axis=0) < x.max(axis=0)):
        under = np.cumsum(np.bincount(x[:, place]))[:-1]
        at = int(np.abs(under - half).argmin())
        if 0 < under[at] < len(x) and abs(under[at] - half) < best:
            best, found = abs(under[at] - half), (int(place), at + 1)
    return found


def grow(x: np.ndarray, points: np.ndarray, most: int) -> Node:
    """A k-d tree whose leaves have at most ``most`` points, more only where these are all alike."""
    if len(points) <= most or (split := best_cut(x[points])) is None:
        return Node(points)
    place, cut = split
    low = x[points, place] < cut
    return Node(None, place, cut, grow(x, points[low], most), grow(x, points[~low], most))


def reach(root: Node, x: np.ndarray, up: int, down: int) -> list[tuple[object, np.ndarray]]:
    """For each leaf, what it has and the rows of ``x`` from which its box is at most ``up`` counts up and ``down``
    down. A box is known by its sides that a cut has made."""
    out = []
    every = np.arange(len(x))
    zero = np.zeros(len(x), np.int32)
    stack = [(root, every, zero, zero, {})]
    while stack:
        node, rows, ups, downs, sides = stack.pop()
        if not len(rows):
            continue
        if node.points is not None:
            out.append((node.points, rows))
            continue
        value = x[rows, node.place].astype(np.int32)
        low, high = sides.get(node.place, (0, None))
        # Below the cut: as far down as the value is over cut - 1, instead of over the side before.
        over = np.maximum(value - high, 0) if high is not None else 0
        under = np.maximum(low - value, 0)
        fewer = downs - over + np.maximum(value - (node.cut - 1), 0)
        more = ups - under + np.maximum(node.cut - value, 0)
        left, right = fewer <= down, more <= up
        stack.append((node.low, rows[left], ups[left], fewer[left], {**sides, node.place: (low, node.cut - 1)}))
        stack.append((node.high, rows[right], more[right], downs[right], {**sides, node.place: (node.cut, high)}))
    return out


def _codes(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, length)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, whether words ``a`` and ``b``, as long or a letter longer, differ by exactly one edit."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(axis=1) == 1
    ahead = np.cumprod(a == b[:, :n], axis=1).sum(axis=1)
    behind = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return ahead + behind >= n


def pairs_in(points: list[str], queries: list[str]) -> list[tuple[int, int]]:
    """(query, point) of all that are one edit apart; points are of one length, queries of one that is the same, then a
    pair counts where the query comes first, or one shorter."""
    if not points or not queries:
        return []
    length, short = len(points[0]), len(queries[0])
    x, q = vectors(points), vectors(queries)
    used = np.flatnonzero(x.any(axis=0) | q.any(axis=0))
    x, q = x[:, used], q[:, used]
    px, qx = _codes(points, length), _codes(queries, short)
    tree = grow(x, np.arange(len(points)), LEAF_WORDS)
    # Between whole numbers whose sums differ by one or not at all, an L1 distance of at most 1 or 2 is a squared
    # distance of at most 1 or 2, which products of matrices give; exact in floats while squares of lengths are.
    kind = np.float32 if length < 2048 else np.float64
    x, fq = x.astype(kind), q.astype(kind)
    x_square, q_square = (x * x).sum(axis=1), (fq * fq).sum(axis=1)
    out: list[tuple[int, int]] = []
    for at, rows in reach(tree, q, 1, length == short):
        leaf, leaf_square = x[at].T, x_square[at]
        step = max(1, _PAIRS // len(at))
        for i in range(0, len(rows), step):
            some = rows[i : i + step]
            apart = q_square[some][:, None] + leaf_square - 2 * (fq[some] @ leaf) <= 1 + (length == short)
            of, to = np.nonzero(apart)
            a, b = some[of], at[to]
            near = one_edit(qx[a], px[b])
            out += [(int(i), int(j)) for i, j in zip(a[near], b[near]) if length != short or queries[i] < points[j]]
    return out


def _cells(vocabulary: DataFrame, cell_words: int, cells: int, sample: int) -> dict[int, Node]:
    """The upper part of the tree of each length, its leaves numbered; grown from the at most ``sample`` words of the
    lowest hashes, the only words that reach the driver."""
    sizes = {r["l"]: r["n"] for r in vocabulary.groupBy(F.length("word").alias("l")).agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    size = max(cell_words, -(-total // cells))
    chosen: dict[int, list[str]] = {}
    if total > size:
        for r in vocabulary.select("word").orderBy(F.xxhash64("word"), "word").limit(sample).collect():
            chosen.setdefault(len(r["word"]), []).append(r["word"])
    number, trees = 0, {}
    for length in sorted(sizes):
        words = sorted(chosen.get(length, []))
        most = max(1, len(words) * size // sizes[length])
        tree = grow(vectors(words), np.arange(len(words)), most) if sizes[length] > size and words else Node(np.arange(0))
        stack = [tree]
        while stack:
            node = stack.pop()
            if node.points is not None:
                node.points, number = number, number + 1
            else:
                stack += [node.high, node.low]
        trees[length] = tree
    return trees


def near_words(
    vocabulary: DataFrame, cell_words: int = CELL_WORDS, cells: int = CELLS, sample: int = SAMPLE
) -> DataFrame:
    """``(word, near, near_n)`` for all words of ``vocabulary(word, n)`` that are one edit apart, either way round. Words are
    distinct and not empty. No words, no rows. ``vocabulary`` is read several times, so freeze it."""
    spark = vocabulary.sparkSession
    trees = spark.sparkContext.broadcast(_cells(vocabulary, cell_words, cells, sample))  # at most some cells a length more than ``cells``

    def deal(batch):
        out = {"cell": [], "query": [], "word": [], "n": []}
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(batch["word"]):
            by_length.setdefault(len(w), []).append(i)
        for length, at in by_length.items():
            x = vectors([batch["word"][i] for i in at])
            goes = [(False, trees.value[length], 0, 0)]
            goes += [(True, trees.value[n], 1, n == length) for n in (length, length + 1) if n in trees.value]
            for query, tree, up, down in goes:
                for cell, rows in reach(tree, x, up, down):
                    for r in rows:
                        out["cell"].append(cell)
                        out["query"].append(query)
                        out["word"].append(batch["word"][at[r]])
                        out["n"].append(batch["n"][at[r]])
        return out

    dealt = map_batches(vocabulary.select("word", "n"), "cell int, query boolean, word string, n long", deal)
    schema = "word string, n long, near string, near_n long"
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def find(table: pa.Table) -> pa.Table:
        words, n, query = (table[c].to_pylist() for c in ("word", "n", "query"))
        points = [i for i, q in enumerate(query) if not q]
        found: list[tuple] = []
        lengths = {len(words[i]) for i in points}
        for length in {len(w) for w in words} if lengths else ():
            asked = [i for i, q in enumerate(query) if q and len(words[i]) == length]
            for a, b in pairs_in([words[i] for i in points], [words[i] for i in asked]):
                i, j = asked[a], points[b]
                found.append((words[i], n[i], words[j], n[j]))
        columns = zip(*found) if found else [[]] * 4
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    one_way = dealt.groupBy("cell").applyInArrow(find, schema)
    ways = F.explode(
        F.array(
            F.struct(F.col("word"), F.col("near"), F.col("near_n")),
            F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")),
        )
    )
    return one_way.select(ways.alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for each word of ``forms(word, form)``: the end of the way from form to form. Ways have no circles;
    each round doubles what has been gone, so rounds are the logarithm of the longest way."""
    jumps = freeze(forms.select("word", F.col("form").alias("root")))
    while True:
        further = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        met = freeze(lookup_join(jumps, further, ["root"]))
        if met.filter("next is not null").isEmpty():
            return jumps
        jumps = freeze(met.select("word", F.coalesce("next", "root").alias("root")))


def spelling_variants(vocabulary: DataFrame, ratio: int = RATIO, **how) -> DataFrame:
    """For each word of ``vocabulary(word, n)``: ``word``, ``n``, ``n_near`` (words one edit apart), ``form`` (the most
    frequent of these, of equal ones the least by code points, if it is ``ratio`` times as frequent as the word; else null),
    ``form_n`` and ``root`` (where forms of forms end, the word itself without a form). ``how`` as for ``near_words``."""
    vocabulary = freeze(vocabulary.select("word", "n"))
    near = near_words(vocabulary, **how)
    best = F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best")
    grouped = near.groupBy("word").agg(F.count("*").alias("n_near"), best)
    known = vocabulary.join(grouped, "word", "left")
    enough = -F.col("best.n") >= ratio * F.col("n")
    known = known.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n"),
    )
    known = freeze(known)
    ended = roots(known.filter("form is not null").select("word", "form"))
    return known.join(ended, "word", "left").withColumn("root", F.coalesce("root", "word"))


def oracle() -> str:
    """The thin query in DuckDB SQL."""
    number = crc32_sql("concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', run)")
    letters = "[A-Za-zÀ-ÿ]"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE
found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{letters}+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM found WHERE length(run) >= {LEAST_LENGTH} GROUP BY doc_id, run),
numbered AS (SELECT run, n, {number} AS h FROM counted),
spelt AS (
  SELECT CASE WHEN h % {TYPO_EVERY} = 0 THEN left(run, CAST(h % length(run) AS INT)) || substring(run, CAST(h % length(run) AS INT) + 2)
    ELSE run END AS word, n FROM numbered),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
gaps AS (SELECT word, i, left(word, i) AS head, substring(word, i + 2) AS tail FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
shorter AS (SELECT DISTINCT g.word, w.word AS near FROM gaps g JOIN words w ON w.word = g.head || g.tail),
near AS (
  SELECT word, near FROM shorter UNION ALL SELECT near, word FROM shorter UNION ALL
  SELECT a.word, b.word FROM gaps a JOIN gaps b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word),
best AS (
  SELECT near.word, count(*) AS n_near, min({{'n': -w.n, 'near': near.near}}) AS best FROM near JOIN words w ON w.word = near.near GROUP BY near.word),
known AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN -b.best.n >= {RATIO} * w.n THEN b.best.near END AS form,
    CASE WHEN -b.best.n >= {RATIO} * w.n THEN -b.best.n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
ways AS (
  SELECT word, word AS at, form FROM known UNION ALL
  SELECT ways.word, known.word, known.form FROM ways JOIN known ON known.word = ways.form)
SELECT known.word, known.form, ways.at AS root, known.n, CAST(known.n_near AS BIGINT) AS n_near, CAST(known.form_n AS BIGINT) AS form_n
FROM known JOIN ways ON ways.word = known.word AND ways.form IS NULL"""
