"""Removal of byte strings that an earlier document has, by multi-document suffix sorting.

Every window of ``window`` bytes has an anchor: the place of the least hash among
its substrings of ANCHOR bytes. Around the anchor the window holds a longer key,
to the anchor's right if it stands in the window's first half and to its left
otherwise. Equal windows have equal anchors and keys, so windows whose key no
two documents share are out, and all occurrences of a repeated window meet under
one anchor. A run of neighbouring windows with one anchor is one short segment
of text; equal segments count once.

The segments of a bucket of anchors are sorted with all their suffixes column by
column: every round puts one more symbol in front of each segment, finds the new
suffixes' ranks from the collection's Burrows-Wheeler transform, and merges them
into the transform, the common-prefix lengths and the owners in one sequential
pass each. Suffixes whose common prefix reaches the window are occurrences of
one string; the least document among their owners is the one that keeps it.

Documents are dealt to blocks once, and all passes over texts read that one
exchange. Between passes go keys, segments and spans, each merged within its
block first, so that a string of very many documents adds at most one row per
block. Exact copies of an earlier document hold nothing of their own and are
told by their texts' digests beforehand.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value

by_value(__name__)

WINDOW = 50
ANCHOR = 12
#: Bytes of text in a block, about; bytes looked at together; segment bytes sorted together.
BLOCK, CHUNK, SORTED = 8 << 20, 1 << 19, 1 << 18
#: No byte of UTF-8 has this value: it stands for "no symbol before".
NONE = 255
#: Bits of a place in a chunk; the other bits of 64 are the hash that orders anchors.
PLACE = 28
#: A place of a segment in a block: the document's key, its rank in the block by row hash, and the first byte.
PLACES = np.dtype([("key", "<i8"), ("doc", "<i4"), ("start", "<i4")])


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).tobytes()
    return np.ndarray((len(data),), "<u8", padded, strides=(1,))


def _mixed(words: np.ndarray, at, length: int) -> np.ndarray:
    """A 64-bit hash of the ``length`` (8 or more) bytes at each place; at: places, or None for all."""
    h = None
    with np.errstate(over="ignore"):
        for k in sorted({*range(0, length - 7, 8), length - 8}):
            w = words[k : len(words) - length + 1 + k] if at is None else words[at + k]
            h = w * np.uint64(0x9E3779B97F4A7C15) if h is None else (h ^ (h >> np.uint64(29))) + w * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


class Runs:
    """The runs of windows of some texts: doc (index into the texts), first and last window, anchor, and the keys of both halves."""

    def __init__(self, texts: list[bytes], group: list[int], window: int):
        self.data = b"".join(texts[k] for k in group)
        ends = np.cumsum([len(texts[k]) for k in group])
        begins = np.concatenate([[0], ends[:-1]])
        words = _words(np.frombuffer(self.data, np.uint8))
        every = _mixed(words, None, ANCHOR)
        low = np.uint64((1 << PLACE) - 1)
        v = (every & ~low) | np.arange(len(every), dtype=np.uint64)
        width, have = window - ANCHOR + 1, 1
        while 2 * have <= width:
            v = np.minimum(v[:-have], v[have:])
            have *= 2
        if have < width:
            v = np.minimum(v[: len(v) - (width - have)], v[width - have :])
        place = (v & low).astype(np.int64)
        valid = np.ones(len(place), bool)
        for e in ends[:-1]:  # windows that reach into the next document
            valid[e - window + 1 : e] = False
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
        self.first = np.flatnonzero(new)
        self.last = np.flatnonzero(valid & np.concatenate([new[1:] | ~valid[1:], [True]]))
        at = place[self.first]
        self.anchor = every[at]
        side = (window - ANCHOR) // 2
        #: Windows from here on have the anchor in their first half.
        self.half = np.maximum(self.first, at - (window - ANCHOR - side))
        self.right, self.left = self.last >= self.half, self.first < self.half
        size = ANCHOR + side
        self.right_key, self.left_key = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        self.right_key[self.right] = _mixed(words, at[self.right], size)
        self.left_key[self.left] = _mixed(words, at[self.left] - side, size)
        k = np.searchsorted(begins, self.first, side="right") - 1
        self.doc, self.begin = np.array(group)[k], begins[k]


def runs(texts: list[bytes], window: int, skip=frozenset()):
    """The runs of all texts but those in ``skip``, some texts at a time."""
    group: list[int] = []
    total = 0
    for k, t in enumerate(texts):
        if len(t) >= window and k not in skip:
            if group and total + len(t) > CHUNK:
                yield Runs(texts, group, window)
                group, total = [], 0
            group.append(k)
            total += len(t)
    if group:
        yield Runs(texts, group, window)


class _Least:
    """Least of any stretch of small numbers, by a table of stretches of powers of two."""

    def __init__(self, values: np.ndarray):
        n, rows = len(values), [values]
        for k in range(max(0, n.bit_length() - 1)):
            half, row = 1 << k, rows[-1].copy()
            np.minimum(rows[-1][:-half], rows[-1][half:], out=row[:-half])
            rows.append(row)
        self.n, self.table = n, np.concatenate(rows)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least of values[a..b], both ends included."""
        level = np.frexp((b - a + 1).astype(np.float64))[1].astype(np.int64) - 1
        return np.minimum(self.table[level * self.n + a], self.table[level * self.n + b + 1 - (1 << level)])


def suffix_columns(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, length, prefix) of all non-empty suffixes of the strings in sorted order.

    ``prefix``: symbols in common with the suffix before. Strings end differently
    from one another, so equal suffixes stand side by side, in order of string.
    Built column by column: round r inserts every string's suffix of length r.
    """
    n = len(strings)
    sizes = np.array([len(s) for s in strings], np.int64)
    data, first = np.frombuffer(b"".join([*strings, b"\0"]), np.uint8), np.concatenate([[0], np.cumsum(sizes)[:-1]])

    def before(owner: np.ndarray, length: int) -> np.ndarray:
        """The symbol before each owner's suffix of that length."""
        at = sizes[owner] - length - 1
        return np.where(at >= 0, data[first[owner] + np.maximum(at, 0)], NONE).astype(np.uint8)

    owner = np.arange(n, dtype=np.int32)  # the empty suffixes
    small = np.uint8 if sizes.max(initial=0) < 255 else np.uint16 if sizes.max() < 65535 else np.int64
    length, prefix = np.zeros(n, small), np.zeros(n, small)
    bwt = before(owner, 0)
    last = np.arange(n)  # places of the suffixes that the last round put in
    for r in range(1, int(sizes.max(initial=0)) + 1):
        last = last[bwt[last] != NONE]
        order = np.argsort(bwt, kind="stable")  # the transform's symbols in order: the first column of what follows
        order = order[: len(order) - np.count_nonzero(bwt == NONE)]
        rank = np.empty(len(bwt), np.int64)
        rank[order] = np.arange(len(order))
        k = np.sort(rank[last])
        least, symbol = _Least(prefix), bwt[order]
        here = order[k]
        up, down = np.maximum(k - 1, 0), np.minimum(k + 1, len(order) - 1)
        has_up, has_down = (k > 0) & (symbol[up] == symbol[k]), (k + 1 < len(order)) & (symbol[down] == symbol[k])
        own = np.zeros(len(k), small)
        own[has_up] = 1 + least(order[up[has_up]] + 1, here[has_up])
        after = 1 + least(here[has_down] + 1, order[down[has_down]])
        new = np.zeros(n + len(order), bool)
        places = n + k
        new[places] = True
        who = owner[here]

        def merged(old: np.ndarray, added, new=new) -> np.ndarray:
            out = np.empty(len(new), old.dtype)
            out[~new] = old
            out[new] = added
            return out

        bwt, owner, length, prefix = merged(bwt, before(who, r)), merged(owner, who), merged(length, r), merged(prefix, own)
        prefix[n + down[has_down]] = after
        last = places
    return owner[n:], length[n:], prefix[n:]


def least_owners(strings: list[bytes], docs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, doc) for every window of the strings: the least of ``docs`` among the strings that have it."""
    owner, length, prefix = suffix_columns(strings)
    whole = length >= window
    if not whole.any():
        none = np.empty(0, np.int64)
        return none, none, none
    heads = np.flatnonzero(prefix < window)
    least = np.minimum.reduceat(docs[owner], heads)
    doc = np.repeat(least, np.diff(np.concatenate([heads, [len(owner)]])))[whole]
    sizes = np.array([len(s) for s in strings], np.int64)
    string = owner[whole].astype(np.int64)
    offset = sizes[string] - length[whole]
    order = np.lexsort((offset, string))
    return string[order], offset[order], doc[order]


class _Block:
    """A block's documents in order of row hash, which is the same in every pass; late: those with an earlier copy."""

    def __init__(self, table: pa.Table, late: pa.Table):
        rid = table.column("rid").to_numpy()
        order = np.argsort(rid, kind="stable")
        self.rid, self.key = rid[order], table.column("key").to_numpy()[order]
        self.table = table.take(order)
        self.texts = self.table.column("data").to_pylist()
        gone = np.isin(self.rid, late.column("rid").to_numpy()) if late.num_rows else np.zeros(len(rid), bool)
        self.late = frozenset(np.flatnonzero(gone).tolist())
        self.block = table.column("block")[0].as_py() if table.num_rows else 0


def _block_keys(table: pa.Table, late: pa.Table, window: int, bits: int) -> pa.Table:
    """The keys of a block's documents, each once, and whether two documents of the block have it."""
    schema = pa.schema([("hash", pa.int64()), ("entry", pa.int64())])
    if not table.num_rows:
        return schema.empty_table()
    b = _Block(table, late)
    seen, least, most = [], [], []
    for r in runs(b.texts, window, b.late):
        h = np.concatenate([r.right_key[r.right], r.left_key[r.left]]) >> np.uint64(64 - bits)
        k = b.key[np.concatenate([r.doc[r.right], r.doc[r.left]])]
        order = np.argsort(h, kind="stable")
        h, k = h[order], k[order]
        heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        seen.append(h[heads])
        least.append(np.minimum.reduceat(k, heads))
        most.append(np.maximum.reduceat(k, heads))
    if not seen:
        return schema.empty_table()
    h, lo, hi = np.concatenate(seen), np.concatenate(least), np.concatenate(most)
    order = np.argsort(h, kind="stable")
    h, lo, hi = h[order], lo[order], hi[order]
    heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    shared = np.minimum.reduceat(lo, heads) < np.maximum.reduceat(hi, heads)
    return pa.table([h[heads].view(np.int64), np.int64(b.block) * 2 + shared], schema=schema)


def _shared_keys(batches):
    """(hash, entry) rows of whole hashes to (block, hash) of those that two documents have."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    h, e = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in batches]) for k in (0, 1))
    order = np.argsort(h, kind="stable")
    h, e = h[order], e[order]
    heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    counts = np.diff(np.concatenate([heads, [len(h)]]))
    shared = np.repeat((counts > 1) | (np.maximum.reduceat(e & 1, heads) > 0), counts)
    yield pa.RecordBatch.from_arrays([pa.array(e[shared] >> 1), pa.array(h[shared])], names=["block", "hash"])


SEGMENTS = "anchor long, block long, seg binary, places binary"


def _segment_schema() -> pa.Schema:
    return pa.schema([("anchor", pa.int64()), ("block", pa.int64()), ("seg", pa.binary()), ("places", pa.binary())])


def _block_segments(table: pa.Table, wanted: pa.Table, window: int, bits: int) -> pa.Table:
    """The segments of windows with shared keys in a block, each once with its places.

    ``wanted``: (block, hash, rid) rows; those with a rid name late copies.
    """
    schema = _segment_schema()
    if not table.num_rows or not wanted.num_rows:
        return schema.empty_table()
    is_late = wanted.column("rid").is_valid()
    b = _Block(table, wanted.filter(is_late))
    keys = np.unique(wanted.filter(pa.compute.invert(is_late)).column("hash").to_numpy()).view(np.uint64)
    if not len(keys):
        return schema.empty_table()
    found: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
    has = lambda h: keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h
    for r in runs(b.texts, window, b.late):
        right, left = (side & has(h >> np.uint64(64 - bits)) for side, h in ((r.right, r.right_key), (r.left, r.left_key)))
        hit = np.flatnonzero(right | left)
        lo = np.where(left, r.first, r.half)[hit]
        hi = np.where(right, r.last, np.minimum(r.half - 1, r.last))[hit] + window
        for d, key, at, a, x, y in zip(*(v.tolist() for v in (r.doc[hit], b.key[r.doc[hit]], lo - r.begin[hit], r.anchor[hit].view(np.int64), lo, hi)), strict=True):
            found.setdefault((a, r.data[x:y]), []).append((key, d, at))
    return pa.table([[a for a, _ in found], [b.block] * len(found), [s for _, s in found], [np.array(v, PLACES).tobytes() for v in found.values()]], schema=schema)


def _bucket_spans(batches, window: int):
    """Segments of whole anchors to (block, doc, from, to) of the bytes that an earlier document has."""
    rows = pa.Table.from_batches(list(batches), _segment_schema())
    if not rows.num_rows:
        return
    rows = rows.take(np.argsort(rows.column("anchor").to_numpy(), kind="stable"))
    anchor = rows.column("anchor").to_numpy()
    sizes = np.cumsum(pa.compute.binary_length(rows.column("seg")).to_numpy().astype(np.int64))
    ends = np.concatenate([np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, [len(anchor)]])
    at = 0
    for e in ends.tolist():  # whole anchors, about SORTED bytes at a time
        if e == len(anchor) or sizes[e - 1] - (sizes[at - 1] if at else 0) >= SORTED:
            yield from _spans(rows.slice(at, e - at), window)
            at = e


def _spans(rows: pa.Table, window: int):
    index: dict[bytes, int] = {}
    string = np.array([index.setdefault(s, len(index)) for s in rows.column("seg").to_pylist()])
    blobs = rows.column("places").to_pylist()
    counts = np.array([len(p) for p in blobs]) // PLACES.itemsize
    places = np.frombuffer(b"".join(blobs), PLACES)
    key, rank, start = (np.ascontiguousarray(places[c]).astype(np.int64) for c in ("key", "doc", "start"))
    owner = np.repeat(string, counts)
    block = np.repeat(rows.column("block").to_numpy(), counts)
    least, most = np.full(len(index), np.iinfo(np.int64).max), np.full(len(index), np.iinfo(np.int64).min)
    np.minimum.at(least, owner, key)
    np.maximum.at(most, owner, key)
    s, offset, doc = least_owners(list(index), least, window)
    late = doc < most[s]
    s, offset, doc = s[late], offset[late], doc[late]
    if not len(s):
        return
    # Runs of neighbouring windows of a string with one least document.
    heads = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (doc[1:] != doc[:-1]) | (offset[1:] != offset[:-1] + 1)]))
    tails = np.concatenate([heads[1:], [len(s)]]) - 1
    run_s, run_doc, run_from, run_to = s[heads], doc[heads], offset[heads], offset[tails] + window
    nth = np.arange(len(run_s)) - np.searchsorted(run_s, run_s)
    out = []
    for k in range(int(nth.max()) + 1):  # the k-th run of every string, against all places of the string
        of = np.full(len(index), -1)
        of[run_s[nth == k]] = np.flatnonzero(nth == k)
        r = of[owner]
        hit = np.flatnonzero(r >= 0)
        hit = hit[key[hit] > run_doc[r[hit]]]
        out.append((block[hit], rank[hit], start[hit] + run_from[r[hit]], start[hit] + run_to[r[hit]]))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)]
    if len(cols[0]):
        yield pa.RecordBatch.from_arrays([pa.array(cols[0]), *(pa.array(c.astype(np.int32)) for c in cols[1:])], names=["block", "doc", "from", "to"])


def _cut(data: bytes, spans: np.ndarray) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal covered spans of a text and what is left of it."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    heads = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > reach[:-1]]))
    runs = list(zip(spans[heads, 0].tolist(), reach[np.concatenate([heads[1:], [len(spans)]]) - 1].tolist(), strict=True))
    edges = [0, *(x for r in runs for x in r), len(data)]
    return runs, b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _block_cut(table: pa.Table, found: pa.Table, window: int, schema: pa.Schema) -> pa.Table:
    """``found``: (block, doc, from, to, rid) rows; those with a rid name late copies, of which nothing is left."""
    if not table.num_rows:
        return schema.empty_table()
    is_late = found.column("rid").is_valid()
    b = _Block(table, found.filter(is_late))
    spans = found.filter(pa.compute.invert(is_late))
    doc = spans.column("doc").to_numpy()
    order = np.argsort(doc, kind="stable")
    pairs = np.stack([spans.column("from").to_numpy()[order], spans.column("to").to_numpy()[order]], axis=1)
    cuts = np.searchsorted(doc[order], np.arange(len(b.texts) + 1))
    # Rows with one row hash are repeats of one document and share its spans.
    first = np.searchsorted(b.rid, b.rid)
    kept, removed = [], []
    for k, data in enumerate(b.texts):
        x, y = cuts[first[k]], cuts[first[k] + 1]
        if k in b.late and len(data) >= window:
            got, left = [(0, len(data))], b""
        else:
            got, left = _cut(data, pairs[x:y]) if y > x else ([], data)
        removed.append([{"from": u, "to": v} for u, v in got])
        kept.append(left)
    return pa.table([b.table.column("_id"), pa.array([len(x) for x in b.texts], pa.int64()), pa.array(removed, schema.field("spans").type), pa.array(kept, pa.binary())], schema=schema)


def drop_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, n_bytes, spans, kept): texts without the bytes of any ``window``-byte string that a document of a smaller key has.

    Texts are UTF-8 bytes; null counts as empty. ``spans`` are the maximal
    removed runs (from, to), ``kept`` the bytes left. Strings are judged on the
    input and never cross documents. Documents of equal keys don't affect each
    other; a null key counts as larger than any. ``window`` is 20 to 150 bytes.
    An empty table gives an empty result.
    """
    if not 20 <= window <= 150:
        raise ValueError("window must be 20 to 150 bytes")
    spark = df.sparkSession
    data = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / (16 * BLOCK)))
    bits = min(64, max(32, total.bit_length() + 8))  # one key in some thousands looks shared by chance
    rid = F.xxhash64(key, text)
    order = F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1))
    rows = df.select(F.col(key).alias("_id"), order.alias("key"), data.alias("data"), rid.alias("rid"), F.pmod(rid, F.lit(blocks)).cast("long").alias("block")).repartition(parts, "block")
    # Exact copies of an earlier document.
    digests = df.filter(F.octet_length(text) >= window).select(order.alias("key"), rid.alias("rid"), F.sha2(data, 256).alias("digest"))
    least = digests.groupBy("digest").agg(F.min("key").alias("least"), F.max("key").alias("most")).filter("least < most")
    late = digests.join(least, "digest").filter("key > least").select(F.pmod("rid", F.lit(blocks)).cast("long").alias("block"), "rid")
    keys = rows.groupBy("block").cogroup(late.groupBy("block")).applyInArrow(lambda t, g: _block_keys(t, g, window, bits), "hash long, entry long")
    shared = keys.repartition(parts, "hash").mapInArrow(_shared_keys, "block long, hash long")
    wanted = shared.unionByName(late, allowMissingColumns=True)
    segs = rows.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(lambda t, w: _block_segments(t, w, window, bits), SEGMENTS)
    spans = segs.repartition(parts, "anchor").mapInArrow(lambda it: _bucket_spans(it, window), "block long, doc int, from int, to int")
    found = spans.unionByName(late, allowMissingColumns=True)
    out = T.StructType([T.StructField("_id", df.schema[key].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())]))), T.StructField("kept", T.BinaryType())])

    def cut(table, got):
        run = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        return _block_cut(table, got, window, pa.schema([("_id", table.schema.field("_id").type), ("n_bytes", pa.int64()), ("spans", run), ("kept", pa.binary())]))

    done = rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(cut, out)
    return done.withColumnRenamed("_id", key)
