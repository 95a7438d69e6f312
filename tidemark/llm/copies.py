"""Exact copies by counting quotient filters.

A fingerprint is 64 bits of a text. Its top bits name a range, the next ones
(the quotient) a home slot in the range's filter, the rest (the remainder) is
what a slot stores. Every task builds one filter a range of the fingerprints
it meets; a range's filters are merged in one pass over their sorted
remainders, which loses nothing. Fingerprints whose merged count is above one
go on to the comparison of whole texts; no other text is shuffled.
"""

from __future__ import annotations

import hashlib
import struct
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value, materialize

by_value(__name__)

BITS = 64
#: Share of home slots filled at most.
LOAD = 0.95
#: Bytes of a slot at least: a count must fit one (5 bytes: 10^12 copies).
LEAST_WIDTH = 5
#: The sent bitmap of repeated fingerprints has 2**CELL_BITS bits (16 MB), however many there are.
CELL_BITS = 27
#: A task's fingerprints are turned into filters whenever it holds so many.
HELD = 1 << 22
HEAD = "<BBBxQ"  # fingerprint bits, quotient bits, slot width, slots


def pack(prints: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """The counting quotient filter of sorted different fingerprints of ``bits`` bits.

    A run (the remainders of one quotient, ascending) begins at its home slot
    or where the run before it ends. A slot holds remainder + 1; a count above
    one follows its remainder in two more slots, zero and the count.
    """
    counts = counts.astype(np.uint64)
    per = np.where(counts > 1, 3, 1)
    n = int(per.sum())
    q = max(1, int(np.ceil(np.log2(max(n, 1) / LOAD))))
    r = bits - q
    first = np.cumsum(per) - per
    quotient = (prints >> np.uint64(r)).astype(np.int64)
    values = np.repeat((prints & np.uint64((1 << r) - 1)) + np.uint64(1), per)
    many = first[counts > 1]
    values[many + 1] = 0
    values[many + 2] = counts[counts > 1]
    homes, k = np.repeat(quotient, per), np.arange(n)
    at = np.maximum.accumulate(homes - k) + k if n else k
    size = max(1 << q, int(at[-1]) + 1 if n else 0)
    slots, occupied, ends = np.zeros(size, "<u8"), np.zeros(1 << q, bool), np.zeros(size, bool)
    slots[at] = values
    occupied[quotient] = True
    if n:
        ends[at[np.append(homes[1:] != homes[:-1], True)]] = True
    width = max(LEAST_WIDTH, -(-(r + 1) // 8))
    body = slots.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    return struct.pack(HEAD, bits, q, width, size) + np.packbits(occupied).tobytes() + np.packbits(ends).tobytes() + body


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of a filter, ascending, and their counts."""
    bits, q, width, size = struct.unpack_from(HEAD, blob)
    r, a = bits - q, struct.calcsize(HEAD)
    b = a + -(-(1 << q) // 8)
    c = b + -(-size // 8)
    homes = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, b - a, a), count=1 << q))
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, c - b, b), count=size))
    slots = np.zeros((size, 8), np.uint8)
    slots[:, :width] = np.frombuffer(blob, np.uint8, size * width, c).reshape(size, width)
    slots = slots.view("<u8").ravel()
    begins = np.maximum(homes, np.append(0, ends[:-1] + 1)) if len(ends) else homes
    lengths = ends - begins + 1
    at = np.arange(lengths.sum()) + np.repeat(begins - (np.cumsum(lengths) - lengths), lengths)
    values, run_home = slots[at], np.repeat(homes, lengths).astype(np.uint64)
    marks = np.flatnonzero(values == 0)
    counts, stays = np.ones(len(values), np.int64), np.ones(len(values), bool)
    counts[marks - 1] = values[marks + 1].astype(np.int64)
    stays[marks] = stays[marks + 1] = False
    return ((run_home << np.uint64(r)) | (values - np.uint64(1)))[stays], counts[stays]


def summed(prints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints ascending, each once, with the sum of its counts; runs that are sorted already are merged as such."""
    order = np.argsort(prints, kind="stable")
    prints, counts = prints[order], counts[order]
    starts = np.flatnonzero(np.append(True, prints[1:] != prints[:-1])) if len(prints) else np.zeros(0, np.int64)
    return prints[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def merge(blobs: list[bytes], bits: int) -> bytes:
    """One filter that counts what all of them count together."""
    found = [unpack(b) for b in blobs]
    return pack(*summed(np.concatenate([p for p, _ in found]), np.concatenate([c for _, c in found])), bits)


def normal(text: bytes | None) -> bytes:
    """A-Z in small letters, nothing else changed; null is empty."""
    return (text or b"").lower()


def _texts(df: DataFrame, text: str):
    return F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text")


def count_filters(df: DataFrame, text: str = "text", range_bits: int | None = None) -> DataFrame:
    """(range int, filter binary): the merged counting quotient filters of the texts' fingerprints.

    There are 2**range_bits ranges of even size; by default about as many as
    the session has shuffle partitions (16 at least, 4096 at most). A range's
    filter is held by one task. Empty tables give no row.
    """
    if range_bits is None:
        range_bits = min(12, max(4, (int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))
    rest = BITS - range_bits

    def cut(held):
        prints, counts = summed(np.frombuffer(held, np.uint64), np.ones(len(held), np.int64))
        ranges = (prints >> np.uint64(rest)).astype(np.int32)
        own = prints & np.uint64((1 << rest) - 1)
        starts = np.flatnonzero(np.append(True, ranges[1:] != ranges[:-1]))
        blobs = [pack(own[a:b], counts[a:b], rest) for a, b in zip(starts, np.append(starts[1:], len(own)), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(ranges[starts], pa.int32()), pa.array(blobs, pa.binary())], names=["range", "filter"])

    def build(batches):
        held = array("Q")
        for batch in batches:
            held.extend(xxhash.xxh3_64_intdigest(normal(t.as_py())) for t in batch.column(0))
            if len(held) >= HELD:
                yield cut(held)
                held = array("Q")
        if held:
            yield cut(held)

    def join_ranges(batches):
        own, blobs, size = None, [], 0

        def done():
            return pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([merge(blobs, rest)], pa.binary())], names=["range", "filter"])

        for batch in batches:
            for key, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if blobs and key != own:
                    yield done()
                    blobs, size = [], 0
                own = key
                blobs.append(blob)
                size += len(blob)
                if size > 1 << 26:  # what many tasks have in common is summed meanwhile
                    blobs = [merge(blobs, rest)]
                    size = 0
        if blobs:
            yield done()

    schema = "range int, filter binary"
    pieces = df.select(_texts(df, text)).mapInArrow(build, schema)
    return pieces.repartition("range").sortWithinPartitions("range").mapInArrow(join_ranges, schema).withMetadata("range", {"bits": range_bits})


def repeated_cells(filters: DataFrame) -> np.ndarray:
    """A bitmap of 2**CELL_BITS cells: which leading bits some fingerprint of count above one has."""
    range_bits = filters.schema["range"].metadata["bits"]

    def cells(batches):
        for batch in batches:
            for key, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                prints, counts = unpack(blob)
                whole = prints[counts > 1] | np.uint64(key << (BITS - range_bits))
                found = np.unique(whole >> np.uint64(BITS - CELL_BITS)).astype("<u4")
                part = 1 << (CELL_BITS - range_bits)  # this range's cells
                dense = 4 * len(found) > part // 8
                if dense:
                    map_ = np.zeros(part, bool)
                    map_[found - key * part] = True
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([dense]), pa.array([np.packbits(map_).tobytes() if dense else found.tobytes()], pa.binary())], names=["range", "dense", "cells"])

    out = np.zeros(1 << (CELL_BITS - 3), np.uint8)
    for row in filters.mapInArrow(cells, "range int, dense boolean, cells binary").toLocalIterator():  # 16 MB in all at most
        if row["dense"]:
            part = 1 << (CELL_BITS - range_bits - 3)
            out[row["range"] * part : (row["range"] + 1) * part] = np.frombuffer(row["cells"], np.uint8)
        else:
            found = np.frombuffer(row["cells"], "<u4")
            np.bitwise_or.at(out, found >> 3, (128 >> (found & 7)).astype(np.uint8))
    return out


def copy_groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256), one row per row of ``df``.

    Texts are equal when identical after lower-casing A-Z only; a null text is
    an empty one, and all empty texts are one group. The row of the largest key
    stays; null keys are smaller than any other, and a group with none but null
    keys keeps one row, with a null keep_id. Of rows that repeat key and text
    one stays. Empty tables give no rows; other columns are not looked at.

    Texts are read twice: once for the filters, once to route rows. A bitmap of
    bounded size (2**27 cells) tells which rows may have a fingerprint of count
    above one; a row that shares a cell by chance is compared in vain, no more.
    Of the routed texts, equal ones are summed before the shuffle, so a group of
    any size sends one row a task.
    """
    spark = df.sparkSession
    filters = materialize(count_filters(df, text), "copies-filters")
    cells = spark.sparkContext.broadcast(repeated_cells(filters))
    fields = [T.StructField("id", df.schema[key].dataType), T.StructField("print", T.LongType()), T.StructField("sha", T.StringType()), T.StructField("routed", T.BooleanType()), T.StructField("norm", T.BinaryType())]

    def route(batches):
        map_ = cells.value
        for batch in batches:
            norms = [normal(t.as_py()) for t in batch.column(1)]
            prints = np.fromiter(map(xxhash.xxh3_64_intdigest, norms), np.uint64, len(norms))
            cell = prints >> np.uint64(BITS - CELL_BITS)
            routed = (map_[(cell >> np.uint64(3)).astype(np.int64)] & (128 >> (cell & np.uint64(7)).astype(np.int64))) > 0
            shas = [hashlib.sha256(x).hexdigest() for x in norms]
            kept = [x if r else None for x, r in zip(norms, routed.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64)), pa.array(shas), pa.array(routed), pa.array(kept, pa.binary())], names=[f.name for f in fields])

    rows = materialize(df.select(F.col(key).alias("id"), _texts(df, text)).mapInArrow(route, T.StructType(fields)), "copies-rows")
    single = rows.filter(~F.col("routed")).select("id", F.col("id").alias("keep"), F.lit(1).cast("long").alias("size"), F.lit(True).alias("kept"), "sha")
    routed = rows.filter("routed")
    verified = routed.groupBy("print", "sha", "norm").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("size")).drop("norm")
    same = routed.groupBy("print", "sha", "id").agg(F.count(F.lit(1)).alias("n"))
    met = same.join(verified, ["print", "sha"]).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    met = met.select("id", "keep", "size", (F.col("id").eqNullSafe(F.col("keep")) & (F.col("k") == 1)).alias("kept"), "sha")
    out = single.unionByName(met)
    return out.select(F.col("id").alias(key), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))
