"""An interpolated modified Kneser-Ney n-gram model.

**Counting.** Tasks count the n-grams of their texts and send them, packed as arrays, to shards
given by context and word; a context is spread over up to eight shards, so a frequent one fills
none. Each shard merges what it gets, writes its n-grams, and sends on what lower orders and
contexts need: numbers of different left neighbours, totals and counts of counts. All is one
job; files are written under a name of their own and renamed, so a repeated task does no harm.

**Store.** Per order and shard one file of sorted 64-bit hashes with counts beside them, in the
shared folder. Workers map the files into memory and find hashes by binary search. Nothing is pruned; shards
are as many as the corpus asks for.

**Probability** of word w after context c, with c' the context without its first word:
``max(n(c,w) - D(n), 0) / n(c) + gamma(c) * p(w | c')``. Discounts D1, D2, D3+ and gamma follow
from the counts of counts; below the highest order n counts left neighbours. The lowest
order mixes in the uniform distribution over the V words and one unknown.
"""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import hash_words, mix, words_of
from riskloom.sources.shared import new_path

ORDER = 2
#: Bytes of training text for each shard, and of text that a task counts or scores at a time.
SHARD_BYTES, CHUNK_CHARS = 24 << 20, 8 << 20
START, END = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b"\x00start", b"\x00end"))
_U64 = np.dtype(np.uint64)
_LIST = "files.npz"


def token_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words and of the end."""
    return np.append(hash_words(words_of(text)), END)


def contexts(tokens: list[np.ndarray], order: int) -> list[np.ndarray]:
    """For each token of each text, hashes of the contexts of 1 .. order-1 words before it."""
    back = [
        np.concatenate([np.concatenate([np.full(min(i, len(t)), START), t[: len(t) - i]]) if i < len(t) else np.full(len(t), START) for t in tokens])
        for i in range(1, order)
    ]
    out = []
    for previous in back:
        out.append(mix(previous, out[-1]) if out else previous)
    return out


def shard_of(context: np.ndarray, word: np.ndarray, shards: int) -> np.ndarray:
    return (mix(context, word >> np.uint64(61)) % np.uint64(shards)).astype(np.int64)


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def _pack_rows(columns: list[np.ndarray], count: np.ndarray) -> bytes:
    """Hash columns as numbers in one dictionary, each as narrow as it can be."""
    names, numbers = np.unique(np.concatenate(columns), return_inverse=True)
    kind = np.uint16 if len(names) < 1 << 16 else np.uint32
    wide = np.uint8 if count.max(initial=0) < 1 << 8 else np.uint32
    return _pack(names=names, numbers=numbers.astype(kind).reshape(len(columns), -1), count=count.astype(wide))


def _unpack_rows(blobs: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    columns, counts = [], []
    for blob in blobs:
        with np.load(io.BytesIO(blob)) as a:
            columns.append(a["names"][a["numbers"].astype(np.int64)])
            counts.append(a["count"].astype(np.int64))
    return list(np.concatenate(columns, axis=1)), np.concatenate(counts)


def _merged(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys in order, the place of one row of each, and summed values."""
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
    return keys[order][first], order[first], [np.add.reduceat(v[order], first) for v in values]


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
        if len(part):
            yield int(shard[part[0]]), part


def _chunks(texts: list, limit: int = CHUNK_CHARS) -> Iterator[list[int]]:
    part, size = [], 0
    for i, t in enumerate(texts):
        part.append(i)
        size += len(t or "")
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


_SCHEMA = "kind string, level int, shard long, blob binary"
_ARROW = pa.schema([("kind", pa.string()), ("level", pa.int32()), ("shard", pa.int64()), ("blob", pa.binary())])


def _count(order: int, shards: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for part in _chunks(texts, 2 * CHUNK_CHARS):
                tokens = [token_hashes(texts[i]) for i in part]
                word = np.concatenate(tokens)
                columns = [*reversed(contexts(tokens, order)), word]
                ones = np.ones(len(word), np.int64)
                _, at, (count,) = _merged(mix(columns[0], word), ones)
                columns = [c[at] for c in columns]
                out = [
                    ("ngram", order, s, _pack_rows([c[p] for c in columns], count[p]))
                    for s, p in _by_shard(shard_of(columns[0], columns[-1], shards))
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)

    return run


def _write(folder: str, name: str, key: np.ndarray, *values: np.ndarray) -> None:
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{name}"
    width = 4 if all(v.max(initial=0) < 1 << 32 for v in values) else 8
    with open(draft := f"{path}.{uuid.uuid4().hex}", "wb") as f:
        np.array([width], _U64).tofile(f)
        key.astype(_U64).tofile(f)
        for v in values:
            v.astype(f"u{width}").tofile(f)
    os.replace(draft, path)


def _counts_of_counts(count: np.ndarray) -> np.ndarray:
    return np.array([(count == i).sum() for i in (1, 2, 3, 4)] + [count.sum(), len(count)], np.int64)


def _merge(order: int, shards: int, folder: str):
    """Merges the n-grams of one shard; what others have sent on passes."""

    def run(key, table):
        kind, level, shard = (k.as_py() for k in key)
        blobs = table.column("blob").to_pylist()
        out: list[tuple] = []
        if kind == "ngram":
            columns, count = _unpack_rows(blobs)
            hashed, at, (count,) = _merged(mix(columns[0], columns[-1]), count)
            columns = [c[at] for c in columns]
            _write(folder, f"ngram-{level}-{shard}", hashed, count)
            out.append(("stats", level, 0, _pack(stats=_counts_of_counts(count))))
            context, _, parts = _merged(columns[0], count, *((count == i).astype(np.int64) for i in (1, 2)), (count > 2).astype(np.int64))
            for s, p in _by_shard((context % np.uint64(shards)).astype(np.int64)):
                out.append(("context", level, s, _pack(key=context[p], values=_narrow(np.array([v[p] for v in parts])))))
            ones = np.ones(len(count), np.int64)
            if level > 2:
                _, at, (left,) = _merged(mix(columns[1], columns[-1]), ones)
                lower = [c[at] for c in columns[1:]]
                for s, p in _by_shard(shard_of(lower[0], lower[-1], shards)):
                    out.append(("ngram", level - 1, s, _pack_rows([c[p] for c in lower], left[p])))
            word, _, parts = _merged(columns[-1], ones if level == 2 else 0 * ones, count if level == order else 0 * count)
            if level in (2, order):
                for s, p in _by_shard((word % np.uint64(shards)).astype(np.int64)):
                    out.append(("word", 1, s, _pack(key=word[p], values=_narrow(np.array([v[p] for v in parts])))))
        else:
            out = [(kind, level, shard, b) for b in blobs]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)

    return run


def _finish(folder: str):
    """Writes contexts and words; gives the statistics that are left."""

    def run(key, table):
        kind, level, shard = (k.as_py() for k in key)
        blobs = table.column("blob").to_pylist()
        if kind == "stats":
            total = sum(_loaded(b)["stats"] for b in blobs)
        else:
            got = [_loaded(b) for b in blobs]
            values = np.concatenate([g["values"] for g in got], axis=1).astype(np.int64)
            names, _, values = _merged(np.concatenate([g["key"] for g in got]), *values)
            _write(folder, f"{kind}-{level}-{shard}", names, *values)
            if kind == "context":
                return _ARROW.empty_table()
            total = np.concatenate([_counts_of_counts(values[0]), [values[1].sum()]])
        row = [(kind, level, shard, _pack(stats=total))]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*row), _ARROW)], schema=_ARROW)

    return run


def _loaded(blob: bytes) -> dict:
    with np.load(io.BytesIO(blob)) as a:
        return {k: a[k] for k in a.files}


@dataclass(frozen=True)
class NgramModel:
    """Where the arrays lie, and what few numbers belong to them. ``discounts`` by order, lowest
    first: D1, D2, D3+; ``gamma`` and ``total`` are of the lowest order."""

    folder: str
    order: int
    shards: int
    discounts: tuple[tuple[float, float, float], ...]
    gamma: float
    total: int
    tokens: int
    words: int


def _discounts(n: np.ndarray) -> tuple[float, float, float]:
    """Chen and Goodman's estimates, kept within 0 and their count where classes are too small."""
    n1, n2, n3, n4 = (float(x) for x in n[:4])
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    raw = [k - (k + 1) * y * b / a if a else k * 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(float(np.clip(d, 0.05, k - 0.05)) for k, d in enumerate(raw, 1))


def mounted(uri: str) -> str:
    """The path under which machines see a folder of the shared file system."""
    at = urlparse(uri)
    if at.scheme not in ("", "file"):
        raise ValueError(f"files to be memory-mapped need a mounted shared folder, not {uri}")
    return at.path


def fit_ngrams(df: DataFrame, text: str, order: int = ORDER) -> NgramModel:
    """Counts the n-grams up to ``order`` (2 or more) of whole texts; null counts as empty, which is one
    end. To the driver come six numbers for each order and shard of words, and the names of the files, which it lists in one
    more. The folder is deleted by the ``scratch`` around the call, else it stays. Without rows the model knows no word."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = df.sparkSession
    folder = mounted(new_path(spark))
    size = df.agg(F.sum(F.octet_length(text)).alias("s")).first()["s"] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    flow = df.select(F.col(text).alias("text")).mapInArrow(_count(order, shards), _SCHEMA)
    for _ in range(order - 1):
        flow = flow.groupBy("kind", "level", "shard").applyInArrow(_merge(order, shards, folder), _SCHEMA)
    flow = flow.groupBy("kind", "level", "shard").applyInArrow(_finish(folder), _SCHEMA)
    stats: dict[tuple[str, int], np.ndarray] = {}
    for r in flow.collect():
        key = r["kind"], r["level"]
        stats[key] = stats.get(key, 0) + _loaded(bytes(r["blob"]))["stats"]
    _list_files(folder, shards)
    words = stats.get(("word", 1), np.zeros(7, np.int64))
    low = _discounts(words)
    more = int(words[5] - words[0] - words[1])
    gamma = (low[0] * words[0] + low[1] * words[1] + low[2] * more) / max(1, words[4]) if words[4] else 1.0
    return NgramModel(
        folder, order, shards,
        (low, *(_discounts(stats.get(("stats", m), np.zeros(6))) for m in range(2, order + 1))),
        float(gamma), int(words[4]), int(words[6]), int(words[5]),
    )


def _list_files(folder: str, shards: int) -> None:
    """Writes down which files the model has, a bit for each kind and shard, so that a lost one is not taken for one
    that never was."""
    present: dict[str, np.ndarray] = {}
    os.makedirs(folder, exist_ok=True)
    with os.scandir(folder) as entries:
        for entry in entries:
            if "." not in entry.name:
                kind, shard = entry.name.rsplit("-", 1)
                present.setdefault(kind, np.zeros(shards, bool))[int(shard)] = True
    np.savez(f"{folder}/{_LIST}", **{kind: np.packbits(bits) for kind, bits in present.items()})


@lru_cache(maxsize=16)
def _listed(folder: str) -> dict[str, np.ndarray]:
    with np.load(f"{folder}/{_LIST}") as kinds:
        return {kind: np.unpackbits(kinds[kind]).astype(bool) for kind in kinds.files}


@lru_cache(maxsize=4096)
def _mapped(path: str, values: int) -> tuple[np.ndarray, ...] | None:
    """Keys and columns of values of a file: the width of a value, the keys, the columns. None where the model has no such
    file; an error where it has lost it."""
    kind, shard = os.path.basename(path).rsplit("-", 1)
    listed = _listed(os.path.dirname(path))
    if kind not in listed or not listed[kind][int(shard)]:
        return None
    width = int(np.fromfile(path, _U64, 1)[0])
    n = (os.path.getsize(path) - 8) // (8 + width * values)
    if not n:
        return None
    at = 8 + 8 * n
    return (
        np.memmap(path, _U64, "r", 8, n),
        *(np.memmap(path, f"u{width}", "r", at + width * n * i, n) for i in range(values)),
    )


def _lookup(folder: str, name: str, key: np.ndarray, shard: np.ndarray, values: int) -> np.ndarray:
    """Values of each key, zeros where the arrays lack it. Repeated keys are looked up once, in order."""
    found = np.zeros((values, len(key)), np.int64)
    distinct, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    at_shard, part = shard[first], np.zeros((values, len(distinct)), np.int64)
    for s, rows in _by_shard(at_shard):
        arrays = _mapped(f"{folder}/{name}-{s}", values)
        if arrays is None:
            continue
        place = np.searchsorted(arrays[0], distinct[rows])
        place[place == len(arrays[0])] = 0
        hit = arrays[0][place] == distinct[rows]
        for i in range(values):
            part[i, rows[hit]] = arrays[i + 1][place[hit]]
    found[:] = part[:, inverse]
    return found


def _less(count: np.ndarray, discounts: tuple[float, float, float]) -> np.ndarray:
    return count - np.array([0.0, *discounts])[np.minimum(count, 3)]


def token_scores(model: NgramModel, tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each token, and its training count."""
    word = np.concatenate(tokens)
    by = lambda h: (h % np.uint64(model.shards)).astype(np.int64)
    left, raw = _lookup(model.folder, "word-1", word, by(word), 2)
    uniform = 1.0 / (model.words + 1)
    p = _less(left, model.discounts[0]) / max(1, model.total) + model.gamma * uniform
    for level, context in enumerate(contexts(tokens, model.order), 2):
        total, n1, n2, n3 = _lookup(model.folder, f"context-{level}", context, by(context), 4)
        (count,) = _lookup(model.folder, f"ngram-{level}", mix(context, word), shard_of(context, word, model.shards), 1)
        d = model.discounts[level - 1]
        gamma = (d[0] * n1 + d[1] * n2 + d[2] * n3) / np.maximum(1, total)
        p = np.where(total > 0, _less(count, d) / np.maximum(1, total) + gamma * p, p)
    return np.log10(p), raw


def score_texts(df: DataFrame, text: str, model: NgramModel, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep``, with ``n_tokens``, ``n_known``, ``base_score`` (smoothed unigram), ``score``
    (log10 probability) and ``perplexity``. Whole texts; null and empty ones are one end. Repeated rows are scored alike, no
    rows give none. A file of the model that is gone is an error."""
    source = df.select(*keep, F.col(text).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    schema = f"{fields}, n_tokens long, n_known long, base_score double, score double, perplexity double"
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    under = model.tokens + 0.5 * (model.words + 1)

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for part in _chunks(texts):
                tokens = [token_hashes(texts[i]) for i in part]
                lengths = np.array([len(t) for t in tokens])
                starts = np.cumsum(lengths) - lengths
                score, raw = token_scores(model, tokens)
                sums = np.add.reduceat(score, starts)
                columns = [
                    lengths, np.add.reduceat((raw > 0).astype(np.int64), starts),
                    np.add.reduceat(np.log10((raw + 0.5) / under), starts), sums, 10.0 ** (-sums / lengths),
                ]
                kept = batch.slice(part[0], len(part)).columns[:-1]
                yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, columns)], schema=arrow)

    return source.mapInArrow(run, schema)
