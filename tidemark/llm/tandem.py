"""Periodic runs of words by tandem repeats of a suffix tree (Stoye and Gusfield).

A tandem repeat is a stretch followed by itself; it is branching if the word
after it isn't the one that would go on with the period. Every branching tandem
repeat of half length d begins at a leaf i of an inner node of depth d of which
i + d is a leaf, too. Walking, at each node, the leaves of all children but the
largest and trying both neighbours finds all of them in n log n steps. A
branching repeat can't be rotated to the right, so it ends where its maximal
run ends; rotating it to the left as far as words agree gives the run's start.
Repeats of one stretch (a period and its multiples) are merged into the run of
the least period.

The tree of a lot of texts is built at once as arrays: ranks of all stretches of
1, 2, 4, ... words (prefix doubling), the leaves in order, the common prefixes
of neighbours, and their intervals, which are the tree's inner nodes. Before
that, stretches that can't hold a run are left out: the four words from any
place of a run but its last three occur again in the same text.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value

by_value(__name__)

#: A run has so many words and so many periods at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Bytes of text that are looked at together, and leaves that are tried together.
LOT, LEAVES = 4_000_000, 2_000_000


def stretch_ranks(s: np.ndarray, longest: int) -> list[np.ndarray]:
    """For k = 0, 1, ...: the rank of the 2**k symbols from each place on, until all differ.

    ``s``: symbols such that none but the separators, each different, ends a
    string, so what reaches over an end differs from all else.
    """
    levels = [np.unique(s, return_inverse=True)[1].astype(np.int32)]
    n = len(s)
    while (1 << (len(levels) - 1)) <= longest:
        last, step = levels[-1], 1 << (len(levels) - 1)
        if last.max(initial=0) == n - 1:
            break
        after = np.zeros(n, np.int64)
        after[: n - step] = last[step:] + 1
        pair = last.astype(np.int64) * (n + 1) + after
        order = np.argsort(pair, kind="stable")
        sorted_ = pair[order]
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(np.append(0, sorted_[1:] != sorted_[:-1]))
        levels.append(rank)
    return levels


def common_prefixes(levels: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """How many symbols each leaf in order has in common with the one before it (the first: 0)."""
    a, b = order[:-1].copy(), order[1:].copy()
    n, total = len(order), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero(np.maximum(a, b) < n)
        same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
        a[same] += 1 << k
        b[same] += 1 << k
        total[same] += 1 << k
    return np.append(0, total)


def inner_nodes(prefixes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(depth, first leaf, end, parent or -1) of every inner node but the root, and each leaf's parent or -1.

    A node is a longest interval of leaves whose neighbours have its depth in common at least.
    """
    depths, begins, ends, parents = [], [], [], []
    leaf_parent = np.full(len(prefixes), -1, np.int64)
    open_: list[int] = []  # nodes whose end isn't known
    values = prefixes.tolist()
    values.append(0)
    owner = leaf_parent.tolist()
    for i in range(1, len(values)):
        d = values[i]
        if not d and not open_:
            continue
        begin, child = i - 1, -1
        if open_ and depths[open_[-1]] >= d:
            owner[i - 1] = open_[-1]
        while open_ and depths[open_[-1]] > d:
            child = open_.pop()
            ends[child] = i
            begin = begins[child]
            if open_ and depths[open_[-1]] >= d:
                parents[child] = open_[-1]
                child = -1
        if d and (not open_ or depths[open_[-1]] < d):
            depths.append(d)
            begins.append(begin)
            ends.append(-1)
            parents.append(-1)
            if child >= 0:
                parents[child] = len(depths) - 1
            open_.append(len(depths) - 1)
            if owner[i - 1] < 0 or depths[owner[i - 1]] < d:
                owner[i - 1] = len(depths) - 1
    return np.array(depths, np.int64), np.array(begins, np.int64), np.array(ends, np.int64), np.array(parents, np.int64), np.array(owner, np.int64)


def branching_repeats(s: np.ndarray, levels: list[np.ndarray], order: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, half length) of every branching tandem repeat. ``last``: the place of the separator that ends each place's string."""
    n = len(s)
    depth, begin, end, parent, leaf_parent = inner_nodes(common_prefixes(levels, order))
    none = np.zeros(0, np.int64)
    if not len(depth):
        return none, none
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    # Children of inner nodes: inner nodes, and leaves as intervals of one.
    leaves = np.flatnonzero(leaf_parent >= 0)
    inner = np.flatnonzero(parent >= 0)
    of = np.concatenate([parent[inner], leaf_parent[leaves]])
    first = np.concatenate([begin[inner], leaves])
    size = np.concatenate([end[inner] - begin[inner], np.ones(len(leaves), np.int64)])
    by = np.lexsort((-size, of))
    largest = by[np.append(True, of[by][1:] != of[by][:-1])]
    small = np.ones(len(of), bool)
    small[largest] = False
    of, first, size = of[small], first[small], size[small]
    starts, halves = [none], [none]
    cuts = np.flatnonzero(np.diff((np.cumsum(size) - 1) // LEAVES)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(of)], strict=True):
        w = size[a:b]
        node = np.repeat(of[a:b], w)
        i = order[np.arange(w.sum()) + np.repeat(first[a:b] - (np.cumsum(w) - w), w)]
        d = depth[node]
        for j, start in ((i + d, i), (i - d, i - d)):
            ok = (j >= 0) & (j < n) & (start + 2 * d <= last[i])
            ok[ok] = (place[j[ok]] >= begin[node[ok]]) & (place[j[ok]] < end[node[ok]])
            ok[ok] = s[start[ok] + d[ok]] != s[start[ok] + 2 * d[ok]]
            starts.append(start[ok])
            halves.append(d[ok])
    pairs = np.unique(np.stack([np.concatenate(starts), np.concatenate(halves)]), axis=1)
    return pairs[0], pairs[1]


def runs_of(strings: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Each string's (start, length, period) of every run, by start, then period."""
    lengths = np.array([len(x) for x in strings], np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in strings]
    if not lengths.sum():
        return out
    top = max(int(x.max()) for x in strings if len(x)) + 1
    # Each string is followed by a symbol of its own.
    s = np.concatenate([y for k, x in enumerate(strings) for y in (x, np.array([top + k], np.int64))])
    ends = np.cumsum(lengths + 1) - 1
    begins = ends - lengths
    owner = np.repeat(np.arange(len(strings)), lengths + 1)
    levels = stretch_ranks(s, int(lengths.max()))
    order = np.argsort(levels[-1], kind="stable")
    start, half = branching_repeats(s, levels, order, ends[owner])
    if not len(start):
        return out
    # To the left as far as the words one period apart agree, by stretches of falling length.
    end, left, first = start + 2 * half, start.copy(), begins[owner[start]]
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        while True:  # twice at most but for the longest stretches
            ok = np.flatnonzero(left - step >= first)
            ok = ok[levels[k][left[ok] - step] == levels[k][left[ok] - step + half[ok]]]
            if not len(ok):
                break
            left[ok] -= step
    by = np.lexsort((half, end, left))
    left, end, half = left[by], end[by], half[by]
    least = np.append(True, (left[1:] != left[:-1]) | (end[1:] != end[:-1]))  # the least period of a stretch
    left, end, half = left[least], end[least], half[least]
    length = end - left
    kept = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * half)
    left, length, half = left[kept], length[kept], half[kept]
    whose = owner[left]
    for w, a, n, q in zip(whose.tolist(), (left - begins[whose]).tolist(), length.tolist(), half.tolist(), strict=True):
        out[w].append((a, n, q))
    for x in out:
        x.sort(key=lambda r: (r[0], r[2]))
    return out


def repeating_stretches(ids: np.ndarray, whose: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the stretches outside of which no run lies: the four words from each place on, but the last three, occur twice in the text.

    The four words are told by a hash, so that a stretch may be longer than need be.
    """
    n = len(ids)
    if n < LEAST_WORDS:
        return []
    h = whose[: n - 3].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(4):
        h = (h ^ ids[k : n - 3 + k].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(n - 3, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    twice &= whose[: n - 3] == whose[3:]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], twice, [False]]).astype(np.int8)))
    out = [(a, b + 3) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= LEAST_WORDS - 3]
    return out


def word_runs(texts: list[list]) -> list[list[tuple[int, int, int]]]:
    """For texts given as lists of words: each one's runs (start, length, period), by start, then period."""
    number = defaultdict(count().__next__)
    lengths = np.array([len(x) for x in texts], np.int64)
    ids = np.fromiter((number[w] for x in texts for w in x), np.int64, int(lengths.sum()))
    whose = np.repeat(np.arange(len(texts)), lengths)
    begins = np.cumsum(lengths) - lengths
    # Places four words on from a text's end belong to the next one; such stretches never count.
    found = repeating_stretches(ids, whose)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    lot: list[tuple[int, int]] = []
    size = 0
    for k, (a, b) in enumerate(found):
        lot.append((a, b))
        size += b - a
        if size >= LOT // 8 or k == len(found) - 1:
            for (a2, _), runs in zip(lot, runs_of([ids[x:y] for x, y in lot]), strict=True):
                w = whose[a2]
                out[w].extend((a2 - int(begins[w]) + a3, n, q) for a3, n, q in runs)
            lot, size = [], 0
    return out


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words but those that a run contains after its first period."""
    if not runs:
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    for a, n, q in runs:
        cover[a + q] += 1
        cover[a + n] -= 1
    return list(compress(words, (np.cumsum(cover[:-1]) == 0).tolist()))


def periodic_runs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, runs array<struct<start, length, period>>, collapsed), one row per row of ``df``.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch of
    words with a smallest period q, at least six words and four periods long,
    which no neighbouring word extends. ``collapsed``: the words but those that
    a run contains after its first period, joined by single spaces. Null, empty
    and blank texts have no words, no runs and an empty ``collapsed``. Keys may
    be null or repeated; other columns are not looked at.

    A text is one task's work, some 60 + 4 log2(n) bytes for each of its n
    repeating words; nothing is shuffled.
    """
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    run_fields = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([T.StructField("id", df.schema[key].dataType), T.StructField("runs", T.ArrayType(run_fields)), T.StructField("collapsed", T.BinaryType())])

    def done(keys, texts):
        words = [t.split() for t in texts]  # of bytes: at blanks, tabs, line and page ends only
        runs = word_runs(words)
        cut = [b" ".join(collapsed(w, r)) for w, r in zip(words, runs, strict=True)]
        found = pa.array([[{"start": a, "length": n, "period": q} for a, n, q in r] for r in runs], run_type)
        return pa.RecordBatch.from_arrays([keys, found, pa.array(cut, pa.binary())], names=["id", "runs", "collapsed"])

    def run(batches):
        for batch in batches:
            at, texts, size = 0, [], 0
            for k, t in enumerate(batch.column(1)):
                texts.append(t.as_py())
                size += len(texts[-1])
                if size >= LOT or k == batch.num_rows - 1:
                    yield done(batch.column(0).slice(at, len(texts)), texts)
                    at, texts, size = k + 1, [], 0

    whole = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    out = df.select(F.col(key).alias("id"), whole.alias("text")).mapInArrow(run, schema)
    return out.select(F.col("id").alias(key), "runs", F.col("collapsed").cast("string").alias("collapsed"))
