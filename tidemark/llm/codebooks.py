"""Vector code compression: each part of a vector becomes the number of its codebook's nearest entry.

Codebooks are bounded (entries x dimension), so each round sends a kd-tree of
each to all tasks. A batch of parts goes down the tree together; a branch is
left out only where its bounding box is farther than the best entry so far, so
boxes at equal distance are still visited and the lower index wins a tie. Tasks
return integer sums by entry, which Spark adds up; the driver divides them.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value, materialize

by_value(__name__)

#: Entries of a leaf of the tree.
LEAF = 8
#: Components from here on take no part: squared distances of parts up to 8,192 long then fit a long.
MOST = 1 << 24
#: Parts that go down a tree together.
ROWS = 4096


class Tree:
    """A kd-tree of a codebook's entries: boxes and leaves, nodes in arrays."""

    def __init__(self, book: np.ndarray):
        self.book = book
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.below: list[tuple[int, int] | None] = []
        self.entries: list[np.ndarray] = []
        self._add(np.arange(len(book)))

    def _add(self, entries: np.ndarray) -> int:
        points, node = self.book[entries], len(self.low)
        self.low.append(points.min(axis=0))
        self.high.append(points.max(axis=0))
        self.below.append(None)
        self.entries.append(entries)
        wide = int((self.high[node] - self.low[node]).argmax())
        if len(entries) > LEAF and self.high[node][wide] > self.low[node][wide]:
            order = np.sort(entries[np.argsort(points[:, wide], kind="stable")[: len(entries) // 2]])
            rest = np.setdiff1d(entries, order, assume_unique=True)
            self.below[node] = (self._add(order), self._add(rest))
        return node

    def _bound(self, node: int, x: np.ndarray) -> np.ndarray:
        out = np.maximum(np.maximum(self.low[node] - x, x - self.high[node]), 0)
        return (out * out).sum(axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the entry nearest to each row; ties go to the lower index."""
        best, index = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(self.book))

        def visit(node: int, rows: np.ndarray, bound: np.ndarray) -> None:
            rows = rows[bound <= best[rows]]  # equal ones may hold a lower index
            if not len(rows):
                return
            if self.below[node] is None:
                entries = self.entries[node]
                gap = x[rows][:, None, :] - self.book[entries]
                far = (gap * gap).sum(axis=2)
                k = far.argmin(axis=1)  # the first of equals, entries being in order
                d, e = far[np.arange(len(rows)), k], entries[k]
                better = (d < best[rows]) | ((d == best[rows]) & (e < index[rows]))
                best[rows[better]], index[rows[better]] = d[better], e[better]
                return
            a, b = self.below[node]
            to_a, to_b = self._bound(a, x[rows]), self._bound(b, x[rows])
            near = to_a <= to_b
            for first, then, own in ((a, b, near), (b, a, ~near)):
                f, t = (to_a, to_b) if first == a else (to_b, to_a)
                visit(first, rows[own], f[own])
                visit(then, rows[own], t[own])

        visit(0, np.arange(len(x)), np.zeros(len(x), np.int64))
        return index, best


@dataclass
class Compressed:
    """``rows``: the kept columns, code (binary, a byte for each part, two if there are over 256 entries), error long.
    ``codebooks``: parts x entries x part length; fewer entries where there were fewer rows."""

    rows: DataFrame
    codebooks: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and place, with commas between."""
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()

    def decoded(self, code: bytes) -> np.ndarray:
        """The vector that a code stands for."""
        width = len(code) // max(1, len(self.codebooks))
        at = np.frombuffer(code, ">u2" if width == 2 else np.uint8)
        return np.concatenate([b[k] for b, k in zip(self.codebooks, at, strict=True)]) if len(at) else np.zeros(0, np.int64)


def whole_components(vector: Column, scale: int, parts: int) -> Column:
    """floor(scale * x) of every component; null for vectors that take no part."""
    x_of = lambda x: x.cast("double") * scale
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x_of(x)) >= MOST))
    fits = vector.isNotNull() & (F.size(vector) > 0) & (F.size(vector) % parts == 0) & ~F.coalesce(bad, F.lit(True))
    return F.when(fits, F.transform(vector, lambda x: F.floor(x_of(x)).cast("long")))


def _parts(column: pa.Array, parts: int) -> np.ndarray:
    """A column of vectors as rows x parts x part length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), parts, -1)


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = (), parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Compressed:
    """Codes and errors of all vectors, by codebooks that are learned from them in ``rounds`` rounds.

    Vectors that are null, empty, hold null or non-finite components, or
    components whose scaled amount is ``MOST`` or more take no part; nor do those
    whose length isn't a multiple of ``parts`` or isn't that of the row of the
    smallest key. A codebook starts as that part of the rows of the smallest
    keys (nulls last, equal keys by vector), one row an entry, so rows that
    repeat make equal entries, of which the lowest is used. Entries that no part
    is nearest to stay. No rows: no codes, and codebooks without entries.
    """
    if entries > 65536:
        raise ValueError("a code has two bytes for a part at most")
    spark = df.sparkSession
    all_ = df.select(*(F.col(c) for c in dict.fromkeys((key, *keep))), whole_components(F.col(vector), scale, parts).alias("_whole"))
    all_ = materialize(all_.filter(F.col("_whole").isNotNull()), "codes-vectors")
    order = [F.col(key).asc_nulls_last(), F.col("_whole")]
    start = all_.orderBy(*order).select(F.size("_whole").alias("n")).limit(1).collect()
    n = start[0]["n"] if start else 0
    all_ = all_.filter(F.size("_whole") == n)
    first = np.array([r[0] for r in all_.orderBy(*order).select("_whole").limit(entries).collect()], np.int64)
    books = first.reshape(len(first), parts, n // parts).transpose(1, 0, 2).copy() if n else np.zeros((parts, 0, 0), np.int64)
    code_type = ">u2" if entries > 256 else np.uint8

    def found(trees, x):
        for p, tree in enumerate(trees):
            near = [tree.nearest(x[a : a + ROWS, p]) for a in range(0, len(x), ROWS)]
            yield np.concatenate([i for i, _ in near]), np.concatenate([d for _, d in near])

    for _ in range(rounds if n else 0):
        sent = spark.sparkContext.broadcast([Tree(b) for b in books])

        def sums(batches, sent=sent):
            trees = sent.value
            total, met = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
            for batch in batches:
                if batch.num_rows:
                    x = _parts(batch.column(0), parts)
                    for p, (index, _) in enumerate(found(trees, x)):
                        np.add.at(total[p], index, x[:, p])
                        met[p] += np.bincount(index, minlength=met.shape[1])
            part, entry = np.nonzero(met)
            if len(part):
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(met[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

        by_task = all_.select("_whole").mapInArrow(sums, "part int, entry int, n long, sums array<long>")
        added = by_task.select("part", "entry", "n", F.posexplode("sums").alias("at", "sum")).groupBy("part", "entry", "at").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"))
        got = added.toArrow()  # a row for each component of the codebooks at most
        part, entry, at, total, met = (got.column(c).to_numpy() for c in ("part", "entry", "at", "sum", "n"))
        books[part, entry, at] = total // met  # floors, below zero too
        sent.destroy()

    sent = spark.sparkContext.broadcast([Tree(b) for b in books] if n else [])
    kept = [c for c in all_.columns if c != "_whole"]
    fields = T.StructType([*(all_.schema[c] for c in kept), T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])

    def codes(batches):
        for batch in batches:
            if batch.num_rows:
                near = list(found(sent.value, _parts(batch.column(batch.num_columns - 1), parts)))
                code = np.stack([i for i, _ in near], axis=1).astype(code_type)
                error = sum(d for _, d in near)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([r.tobytes() for r in code], pa.binary()), pa.array(error)], names=fields.names)

    return Compressed(all_.select(*kept, "_whole").mapInArrow(codes, fields), books)
