"""SimHash near-duplicates with deletion-variant signatures.

A 64-bit fingerprint is cut into three segments. Two fingerprints that differ
in at most four bits agree in some segment up to one bit, so they share the
signature that leaves out that bit. Every fingerprint is indexed under its 64
one-wildcard variants; fingerprints with an equal variant meet in one sorted
run, where the true distance is checked. A run reports a spanning forest of its
verified links, never all its pairs: components stay the same.

``near_copies`` is for texts whose word shingles have a Jaccard similarity of
0.8, which few bits of a fingerprint can't tell: MinHash bands add the
candidates, and every candidate is verified on the exact shingle sets.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import connected_components
from .common import by_value, materialize, small_batches

by_value(__name__)

#: First bit and width of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Four bits over three segments leave at most one in some segment.
MAX_BITS = 4
#: Texts longer than this are cut into words piecewise.
LONG = 1 << 22
#: Runs of more fingerprints are cut further; for shorter ones comparing all is quicker.
DENSE = 1 << 15
#: MinHash bands and the minima in each: a pair of Jaccard 0.8 shares no band with probability 0.00007.
BANDS, ROWS = 24, 5
#: Runs of more texts than this are linked to one text of theirs before the rest of their pairs is looked at.
FEW = 4
#: Of a long run's other pairs those are verified whose sketches of one bit a minimum agree in so many bits; a pair of Jaccard 0.8 agrees in fewer with probability 0.00001.
BITS, AGREE = 2048, 1785
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_ODD, _ODD_BITS = (np.random.default_rng(42).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for n in (BANDS * ROWS, BITS))


def _words(data: bytes) -> Iterator[list[bytes]]:
    if len(data) <= LONG:
        yield data.split()
        return
    block: list[bytes] = []
    for m in _WORD.finditer(data):
        block.append(m[0])
        if len(block) == 1 << 16:
            yield block
            block = []
    yield block


def _hashes(text: str | None, shingle: int, seed: int) -> Iterator[np.ndarray]:
    """Hashes of a text's word shingles, in pieces; of the whole text where it has fewer words."""
    tail, none = [], True
    hash_of = xxhash.xxh64_intdigest
    for words in _words((text or "").encode().lower()):
        words = tail + words
        hashes = [hash_of(b" ".join(s), seed) for s in zip(*(words[k:] for k in range(shingle)), strict=False)]
        tail = words[max(0, len(words) - shingle + 1) :]
        for at in range(0, len(hashes), 1 << 16):
            none = False
            yield np.array(hashes[at : at + (1 << 16)], dtype=np.uint64)
    if none and tail:
        yield np.array([hash_of(b" ".join(tail), seed)], dtype=np.uint64)


def _votes(pieces: Iterable[np.ndarray]) -> int:
    counts, total = np.zeros(64, np.int64), 0
    for part in pieces:
        counts += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        total += len(part)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big") if total else 0


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of a text's word shingles as an unsigned 64-bit number; 0 without words."""
    return _votes(_hashes(text, shingle, seed))


def fingerprints(df: DataFrame, key: str, text: str, shingle: int = 4) -> DataFrame:
    """(key, fp) per row; fp is the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            got = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got)], names=[key, "fp"])

    schema = T.StructType([df.schema[key], T.StructField("fp", T.LongType())])
    small_batches(df.sparkSession)
    return df.select(key, text).mapInArrow(run, schema)


def forest(fp: np.ndarray, most: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (distance <= most) among distinct fingerprints."""
    heads, ends = [], []
    rest = fp.view(np.uint64)
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= most
            if near.any():
                found = rest[near]
                heads.append(np.full(len(found), at))
                ends.append(found)
                queue.extend(found)
                rest = rest[~near]
    none = np.empty(0, np.uint64)
    return tuple(np.concatenate(x or [none]).view(np.int64) for x in (heads, ends))


def split_forest(fp: np.ndarray, most: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what ``forest`` connects, for long runs.

    The bits in which the run varies are cut into most + 1 groups. Two linked
    fingerprints agree in one of them, so only those that do are compared.
    """
    if len(fp) <= DENSE:
        return forest(fp, most)
    x = fp.view(np.uint64)
    varying = int(np.bitwise_or.reduce(x ^ x[0]))
    found = []
    for bits in np.array_split([k for k in range(64) if varying >> k & 1], most + 1):
        value = x & np.uint64(sum(1 << int(k) for k in bits))
        order = np.argsort(value, kind="stable")
        for group in np.split(x[order], np.flatnonzero(np.diff(value[order])) + 1):
            if len(group) > 1:
                found.append((forest if 2 * len(group) > len(x) else split_forest)(group.view(np.int64), most))
    return tuple(np.concatenate([np.empty(0, np.int64), *side]) for side in zip(*found, strict=True)) if found else forest(fp[:0], most)


def _run_links(batches, most: int):
    """Sorted (sig, fp) batches to links; a run of equal signatures may span batches."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(sig: np.ndarray, fp: np.ndarray):
        new = np.flatnonzero(np.diff(sig)) + 1
        starts = np.concatenate([[0], new])
        lengths = np.diff(np.concatenate([starts, [len(sig)]]))
        a, b = [], []
        small = np.repeat(lengths <= 8, lengths)
        for lag in range(1, 8):
            hit = (sig[lag:] == sig[:-lag]) & small[lag:] if len(sig) > lag else np.zeros(0, bool)
            if not hit.any():
                break
            i = np.flatnonzero(hit)
            i = i[np.bitwise_count((fp[i] ^ fp[i + lag]).view(np.uint64)) <= most]
            a.append(fp[i])
            b.append(fp[i + lag])
        for k in np.flatnonzero(lengths > 8):
            heads, ends = split_forest(fp[starts[k] : starts[k] + lengths[k]], most)
            a.append(heads)
            b.append(ends)
        if not a:
            return
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], schema=schema)

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        sig, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        if not len(sig):
            continue
        held.append((sig, fp))
        if sig[-1] != held[0][0][0]:
            sig, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = np.searchsorted(sig, sig[-1])  # the last run may go on
            yield from links(sig[:cut], fp[:cut])
            held = [(sig[cut:], fp[cut:])]
    if held:
        sig, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        yield from links(sig, fp)


def links(fps: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` within ``most`` (at most 4) bits."""
    if not 0 <= most <= MAX_BITS:
        raise ValueError("three segments with one wildcard find at most 4 bits")
    bit = F.col("bit")
    value = F.lit(None).cast("long")
    for first, width in SEGMENTS:
        cut = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))
        without = cut.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), bit - first)))
        value = F.when((bit >= first) & (bit < first + width), without).otherwise(value)
    sigs = fps.select("fp").distinct().select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    sigs = sigs.select((bit.cast("long") * (1 << 22) + value).alias("sig"), "fp")
    return sigs.repartition("sig").sortWithinPartitions("sig").mapInArrow(lambda it: _run_links(it, most), "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, most: int = MAX_BITS) -> DataFrame:
    """(key, fp, component_id): the fingerprint and the least key that can be reached over links of ``most`` bits.

    Null and empty texts, and texts of white space, have fingerprint 0 and are
    linked like any other. Rows with equal fingerprints, such as exact copies,
    are one node. Null keys are never a component's id unless it holds no
    other. An empty table gives an empty result; other columns are ignored.
    """
    fps = materialize(fingerprints(df, key, text, shingle), "simhash")
    nodes = fps.groupBy("fp").agg(F.min(key).alias("_least"))
    roots = connected_components(links(nodes, most)).withColumnRenamed("node", "fp")
    nodes = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = nodes.groupBy("root").agg(F.min("_least").alias("component_id"))
    nodes = nodes.join(ids, "root").select("fp", "component_id")
    return fps.join(nodes, "fp").select(key, "fp", "component_id")


def shingle_set(text: str | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *_hashes(text, shingle, seed)]))


def minima(hashes: np.ndarray, odd: np.ndarray = _ODD) -> np.ndarray:
    """The MinHash minima of a set, one for each odd factor; none for an empty one."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    least = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 9):
        least = np.minimum(least, (hashes[at : at + (1 << 9), None] * odd).min(axis=0))
    return least


def sketch(hashes: np.ndarray) -> bytes:
    """One bit of each of BITS minima."""
    return np.packbits((minima(hashes, _ODD_BITS) >> np.uint64(20) & np.uint64(1)).astype(np.uint8)).tobytes()


def bands(least: np.ndarray) -> np.ndarray:
    """One number for each band of minima."""
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(-1, ROWS))], np.uint64)


def _prints(df: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(key, hash, node, fp, n, bands) per row: hash tells equal texts, node equal shingle sets, n is the set's size."""

    def run(batches):
        for batch in batches:
            node, fp, n, band = [], [], [], []
            for t in batch.column(2).to_pylist():
                pieces = list(_hashes(t, shingle, 42))
                hashes = np.unique(np.concatenate([np.empty(0, np.uint64), *pieces]))
                node.append(xxhash.xxh64_intdigest(hashes.tobytes()))
                fp.append(_votes(pieces))
                n.append(len(hashes))
                band.append(bands(minima(hashes)).view(np.int64))
            long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), long(node), long(fp), pa.array(n, pa.int64()), pa.array(band, pa.list_(pa.int64()))], names=schema.names)

    schema = T.StructType([df.schema[key], *(T.StructField(c, T.LongType()) for c in ("hash", "node", "fp", "n")), T.StructField("bands", T.ArrayType(T.LongType()))])
    small_batches(df.sparkSession)
    return df.select(key, F.xxhash64(text).alias("hash"), text).mapInArrow(run, schema)


def _runs(batches) -> Iterator[pa.Table]:
    """The rows of each run of equal first values, from sorted batches; a run may span batches."""
    held: list[pa.RecordBatch] = []

    def cut(rows: pa.Table, last: bool):
        first = rows.column(0).to_numpy()
        ends = [0, *(np.flatnonzero(np.diff(first)) + 1).tolist(), len(first)]
        runs = list(zip(ends, ends[1:], strict=False))
        yield from (rows.slice(a, b - a) for a, b in (runs if last else runs[:-1]) if b - a > 1)
        if not last:
            held[:] = rows.slice(ends[-2]).to_batches()  # the last run may go on

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            if batch.column(0)[-1] != held[0].column(0)[0]:
                yield from cut(pa.Table.from_batches(held), False)
    if held:
        yield from cut(pa.Table.from_batches(held), True)


def _batches(pieces: Iterable[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Record batches of some thousand rows from pieces of long columns."""
    held, n = [], 0
    put = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=names)
    for piece in pieces:
        held.append(piece)
        n += len(piece[0])
        if n >= 1 << 14:
            yield put()
            held, n = [], 0
    if n:
        yield put()


def _band_pairs(batches, least: float):
    """Runs of (sig, node, n) to (a, b, sig): all pairs of short runs; a long run's texts with one of them, sig told.

    Which one differs from band to band, so a group of many near copies has as
    many chances to be linked as it shares bands.
    """

    def pieces():
        for run in _runs(batches):
            sig, node, n = (c.to_numpy() for c in run.columns)
            if len(sig) <= FEW:
                i, j = np.triu_indices(len(sig), 1)
                ok = np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j])
                yield node[i][ok], node[j][ok], np.zeros(int(ok.sum()), np.int64)
            else:  # that one with itself, too: it is one of the run's texts
                order = (node ^ sig).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                yield np.full(len(sig), node[order.argmin()]), node, sig

    return _batches(pieces(), ["a", "b", "sig"])


def _cross_pairs(batches, least: float):
    """Runs of (sig, root, node, n, bits) to pairs (a, b) of different roots whose sketches agree as those of near copies do."""

    def pieces():
        for run in _runs(batches):
            root, node, n = (run.column(k).to_numpy() for k in (1, 2, 3))
            if (root == root[0]).all():
                continue
            bits = np.frombuffer(b"".join(run.column(4).to_pylist()), np.uint64).reshape(len(root), -1)
            _, which, sizes = np.unique(root, return_inverse=True, return_counts=True)
            order = np.lexsort((which, sizes[which]))  # small components first: the largest is only compared with
            root, node, n, bits = root[order], node[order], n[order], bits[order]
            ends = [*(np.flatnonzero(np.diff(root)) + 1).tolist()]
            for a, b in zip([0, *ends], ends, strict=False):
                for k in range(a, b):
                    ok = np.minimum(n[b:], n[k]) >= least * np.maximum(n[b:], n[k])
                    ok[ok] = np.bitwise_count(bits[b:][ok] ^ bits[k]).sum(axis=1) <= BITS - AGREE
                    yield np.full(int(ok.sum()), node[k]), node[b:][ok]

    return _batches(pieces(), ["a", "b"])


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """(key, text_hash, root, component_id) per row: the least key that can be reached over links of ``least`` Jaccard similarity of word shingles.

    ``root`` tells components apart, where ``component_id`` can't because one
    key has several texts; ``text_hash`` is xxhash64 of the text.

    Candidates are what SimHash links within MAX_BITS and what shares a MinHash
    band; each is verified on the exact sets. Texts of fewer words than a
    shingle are one shingle; texts without words are equal. A long run's texts
    are compared with one of them, which differs from band to band, and then
    whatever isn't connected yet and agrees in AGREE bits of a sketch, so near
    copies in numbers cost no square. Null keys are never a component's id unless it holds no
    other.
    """
    prints = materialize(_prints(df, key, text, shingle), "near-prints")
    nodes = prints.groupBy("node").agg(F.min(key).alias("_least"), F.min("fp").alias("fp"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.min("hash").alias("hash"))
    nodes = materialize(nodes, "near-nodes")
    sigs = nodes.select(F.explode("bands").alias("sig"), "node", "n")
    met = materialize(sigs.repartition("sig").sortWithinPartitions("sig").mapInArrow(lambda it: _band_pairs(it, least), "a long, b long, sig long"), "near-met")
    heads = nodes.groupBy("fp").agg(F.min("node").alias("head"))
    same = nodes.join(heads, "fp").select(F.col("head").alias("a"), F.col("node").alias("b"))
    close = links(heads).join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))

    def distinct(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()

    first = materialize(distinct(met.select("a", "b").unionByName(same).unionByName(close)), "near-pairs")
    wanted = first.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = materialize(nodes.select("node", "hash", "n").join(wanted, "node", "left_semi"), "near-wanted")
    texts = df.select(F.xxhash64(text).alias("hash"), F.col(text).alias("_text"))
    texts = texts.join(wanted, "hash").groupBy("node", "n").agg(F.first("_text").alias("_text"))

    def sets_of(batches):
        for batch in batches:
            found = [shingle_set(t, shingle).view(np.int64) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["node", "n", "set"])

    sets = materialize(texts.select("node", "n", "_text").mapInArrow(sets_of, "node long, n long, set array<long>"), "near-sets")

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda c: sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("set").alias(f"s_{c}"))
        sizes = lambda c: sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"))
        fits = F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b")
        pairs = pairs.join(sizes("a"), "a").join(sizes("b"), "b").filter(fits).select("a", "b")
        both = F.size(F.array_intersect("s_a", "s_b"))
        return pairs.join(side("a"), "a").join(side("b"), "b").filter(both >= least * (F.col("n_a") + F.col("n_b") - both)).select("a", "b")

    edges = materialize(verified(first), "near-edges")
    roots = connected_components(edges)
    runs = met.filter("sig <> 0").select("sig", F.col("b").alias("node"))
    if not runs.isEmpty():
        runs = runs.join(roots, "node", "left").select("sig", F.coalesce("root", "node").alias("root"), "node")
        # A run whose texts are all connected by now needs nothing more.
        open_ = runs.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("sig")
        runs = materialize(runs.join(open_, "sig", "left_semi"), "near-runs")

        def sketches_of(batches):
            for batch in batches:
                found = [sketch(np.array(x, np.int64).view(np.uint64)) for x in batch.column(2).to_numpy(zero_copy_only=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["node", "n", "bits"])

        sketches = sets.join(runs.select("node").distinct(), "node", "left_semi").select("node", "n", "set").mapInArrow(sketches_of, "node long, n long, bits binary")
        runs = runs.join(sketches, "node").select("sig", "root", "node", "n", "bits")
        more = runs.repartition("sig").sortWithinPartitions("sig").mapInArrow(lambda it: _cross_pairs(it, least), "a long, b long")
        more = materialize(verified(materialize(distinct(more), "near-pairs")), "near-edges")
        if not more.isEmpty():
            roots = connected_components(edges.unionByName(more))
    placed = nodes.select("node", "_least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = placed.groupBy("root").agg(F.min("_least").alias("component_id"))
    placed = placed.join(ids, "root").select("node", "root", "component_id")
    return prints.join(placed, "node").select(key, F.col("hash").alias("text_hash"), "root", "component_id")
