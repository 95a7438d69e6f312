"""Packing of tokenized documents into as few fixed-length sequences as possible.

Pieces are counted by length. Over that histogram the configuration linear
program (how often to use each way of filling a sequence) is solved by
multiplicative weights: lengths carry weights, a knapsack over them prices the
best fillings, and lengths that these cover lose weight. The program's solution
is rounded down to whole sequences, and what is left is packed by best fit.

The program's size depends on the sequence length only, so it is solved on the
driver; which piece takes which place is decided in tasks, by each piece's
number among those of its length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value, fresh, materialize, small_batches

by_value(__name__)

MAX_LENGTH = 1024
END_ID = 2
#: Rounds of the multiplicative-weights method, its step, and how near the best a priced filling must be to count.
ROUNDS, STEP, NEAR = 100, 0.2, 0.01
#: The program is solved again for what a rounding leaves, so many times at most.
PHASES = 4


class Encoder:
    """Token ids by a file of the tokenizers library, their special strings being told as the library tells them.

    Byte-level BPE files whose ids are the merges' ranks are run by tiktoken on
    the same vocabulary, which is several times faster. The two could differ in
    what kind of character (letter, number, blank, other) they take a character
    for, so every character is tried on both when it is first met; texts that
    hold one they differ on, or a special string, go to the tokenizers library.
    So do all texts of any other file.
    """

    #: A character stands among each of these when it is tried.
    TRIALS = ("a{0}b", "1{0}2", " {0}x", "x {0}{0} ", "!{0}?", "'{0}e", "{0}'s", "\t{0}\n", "{0}")
    #: Texts with longer runs without any blank, or of nothing but blanks, go to the tokenizers library: there, time doesn't grow
    #: with the square of the former, nor the stack with the latter.
    SOLID = 100_000
    BLANKS = re.compile(r"\s+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        spec = json.load(open(path))
        added = [x["content"] for x in spec.get("added_tokens", ())]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.fast = self._fast(spec, set(added))
        self.known: set[str] = set()
        self.odd: set[str] = set()

    @staticmethod
    def _fast(spec: dict, special: set[str]):
        import tiktoken

        pre = spec.get("pre_tokenizer") or {}
        if spec["model"].get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            return None
        plain = [b for r in (range(33, 127), range(161, 173), range(174, 256)) for b in r]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(byte_of[c] for c in piece): k for piece, k in spec["model"]["vocab"].items() if piece not in special}
        # The usual split of byte-level BPE, as the library's ByteLevel has it.
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _slowly(self, text: str) -> list[int]:
        return self.slow.encode(text, add_special_tokens=False).ids

    def _try(self, chars: set[str]) -> None:
        for c in chars:
            if any(self._slowly(t.format(c)) != self.fast.encode_ordinary(t.format(c)) for t in self.TRIALS):
                self.odd.add(c)
        self.known |= chars

    def _long_run(self, text: str) -> bool:
        if len(text) <= self.SOLID:
            return False
        at = 0
        for blanks in self.BLANKS.finditer(text):
            if max(blanks.start() - at, blanks.end() - blanks.start()) > self.SOLID:
                return True
            at = blanks.end()
        return len(text) - at > self.SOLID

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or (self.special and self.special.search(text)):
            return np.array(self._slowly(text), dtype="<u4")
        chars = set(text)
        if new := chars - self.known:
            self._try(new)
        if not chars.isdisjoint(self.odd) or self._long_run(text):
            return np.array(self._slowly(text), dtype="<u4")
        return np.array(self.fast.encode_ordinary(text), dtype="<u4")


def pieces(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", max_length: int = MAX_LENGTH, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]): each text's ids and the end id, cut to ``max_length``.

    Only longer documents are cut, and their first piece is the one that may be
    shorter. Null and empty texts are the end id alone.
    """
    fields = [df.schema[key], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType(fields)

    def run(batches):
        encoder = Encoder(tokenizer)
        for batch in batches:
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                all_ids = np.append(encoder.ids(t or ""), np.uint32(end_id)).astype("<u4")
                n = len(all_ids)
                first = n % max_length or min(n, max_length)
                cuts = [0, *range(first, n, max_length), n]
                data = memoryview(all_ids.tobytes())
                for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append(k)
                    piece.append(p)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(data[4 * a : 4 * b]))
                    if keep_ids:
                        ids.append(all_ids[a:b].astype(np.int32))
            cols = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if keep_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    small_batches(df.sparkSession)
    return df.select(key, text).mapInArrow(run, schema)


def _priced(lengths: np.ndarray, value: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack with repetition: the best value within each capacity, and the item taken last (0: none)."""
    best, item = np.zeros(cap + 1), np.zeros(cap + 1, np.int64)
    fits = np.searchsorted(lengths, np.arange(cap + 1), side="right")
    for c in range(1, cap + 1):
        best[c] = best[c - 1]
        m = fits[c]
        if m:
            got = best[c - lengths[:m]] + value[:m]
            k = int(got.argmax())
            if got[k] > best[c]:
                best[c], item[c] = got[k], lengths[k]
    return best, item


def _filling(item: np.ndarray, best: np.ndarray, c: int) -> list[int]:
    out = []
    while c > 0:
        if item[c]:
            out.append(int(item[c]))
            c -= int(item[c])
        else:  # best[c] == best[c - 1]
            c -= 1
    return out


def fractional(counts: dict[int, int], cap: int, rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Near-optimal fractional uses of fillings (lengths, descending) for the configuration program."""
    lengths = np.array(sorted(counts), np.int64)
    need = np.array([counts[int(x)] for x in lengths], float)
    place = {int(x): k for k, x in enumerate(lengths)}
    log_w = np.zeros(len(lengths))
    uses: dict[tuple[int, ...], float] = defaultdict(float)
    for _ in range(rounds):
        value = lengths / cap * np.exp(log_w - log_w.max())
        best, item = _priced(lengths, value, cap)
        # The best filling that holds a given length, for each length; those near the best of all are priced in.
        total = value + best[cap - lengths]
        chosen = np.flatnonzero(total >= (1 - NEAR) * best[cap])
        gain, mix = np.zeros(len(lengths)), {}
        for k in chosen:
            filling = [int(lengths[k]), *_filling(item, best, cap - int(lengths[k]))]
            key = tuple(sorted(filling, reverse=True))
            share = need[k]
            mix[key] = mix.get(key, 0.0) + share
            for x in key:
                gain[place[x]] += share
        cover = gain / need
        step = 1 / cover.max()
        for key, share in mix.items():
            uses[key] += share * step
        log_w -= STEP * step * cover
        log_w -= log_w.max()
    held = sum(x * sum(f) for f, x in uses.items())
    scale = float(need @ lengths) / held
    return {f: x * scale for f, x in uses.items()}


def best_fit(left: dict[int, int], cap: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: (filling, times)."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for x in sorted((k for k, n in left.items() if n), reverse=True):
        n = left[x]
        space = x
        while n and space <= cap:
            if not room.get(space):
                space += 1
                continue
            filling, times = room[space].pop()
            fit = min(space // x, n)
            take = min(times, n // fit)
            if take < times:
                room[space].append((filling, times - take))
            room[space - fit * x].append((filling + (x,) * fit, take))
            n -= take * fit
        if n:
            each = cap // x
            if n // each:
                room[cap - each * x].append(((x,) * each, n // each))
            if n % each:
                room[cap - n % each * x].append(((x,) * (n % each), 1))
    return [b for bins in room.values() for b in bins]


def plan(counts: dict[int, int], cap: int = MAX_LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Whole uses of fillings that hold exactly the counted lengths.

    Uses are scaled so that next to no length is covered more often than it
    occurs, and rounded down; the program is solved again for the rest. The best
    point to hand over to best fit is kept.
    """
    left = {int(k): int(n) for k, n in counts.items() if n}
    done: list[tuple[tuple[int, ...], int]] = []
    found: list[tuple[tuple[int, ...], int]] | None = None
    for _ in range(PHASES):
        left = {k: n for k, n in left.items() if n}
        if not left:
            break
        uses, cover = fractional(left, cap), dict.fromkeys(left, 0.0)
        for filling, x in uses.items():
            for k in filling:
                cover[k] += x
        scale = 1 / max(1.0, float(np.quantile([cover[k] / n for k, n in left.items()], 0.98)))
        used = 0
        for filling, x in sorted(uses.items(), key=lambda kv: (-kv[1], kv[0])):
            per = {k: filling.count(k) for k in set(filling)}
            times = min([int(x * scale), *(left[k] // n for k, n in per.items())])
            if times > 0:
                done.append((filling, times))
                used += times * sum(filling)
                for k, n in per.items():
                    left[k] -= n * times
        now = done + best_fit(left, cap)
        if found is None or sum(n for _, n in now) < sum(n for _, n in found):
            found = now
        if used < 0.05 * sum(k * n for k, n in left.items()):
            break
    return found or []


def places(fillings: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first numbers, first sequences and offsets of runs of places."""
    got: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for filling, times in fillings:
        at = 0
        for x in filling:
            got[x].append((used[x], sequence, at))
            used[x] += times
            at += x
        sequence += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*runs, strict=True)) for x, runs in got.items()}


def pack(parts: DataFrame, key: str, max_length: int = MAX_LENGTH) -> DataFrame:
    """``parts`` (key, piece, length 1..max_length, ...) with sequence_id and offset.

    Every sequence is gapless from offset 0. Rows equal in key and piece (of
    repeated documents) are packed one by one. ``parts`` must give the same rows
    each time it is read. An empty table gives an empty result; columns named
    sequence_id or offset are replaced.
    """
    spark = parts.sparkSession
    counts = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}  # at most max_length rows
    sent = spark.sparkContext.broadcast(places(plan(counts, max_length)))
    # Number the pieces of each length; a length may be hot, so it is numbered in salted groups.
    parts = parts.drop("sequence_id", "offset")
    columns = parts.columns
    salt, size, order, before, number = fresh(columns, "_salt", "_n", "_order", "_before", "_number")
    salts = max(16, min(4096, sum(counts.values()) // 50_000))
    parts = parts.withColumn(salt, F.pmod(F.xxhash64(key, "piece"), F.lit(salts)).cast("int"))
    groups = parts.groupBy("length", salt).agg(F.count(F.lit(1)).alias(size))
    earlier = F.sum(size).over(Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.select("length", salt, F.coalesce(earlier, F.lit(0)).alias(before))
    nth = F.row_number().over(Window.partitionBy("length", salt).orderBy(key, "piece"))
    numbered = parts.withColumn(order, nth).join(groups, ["length", salt])
    numbered = numbered.select(*columns, (F.col(before) + F.col(order) - 1).alias(number))
    schema = T.StructType([*numbered.schema.fields[:-1], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at = columns.index("length")

    def run(batches):
        for batch in batches:
            length, number = (batch.column(k).to_numpy(zero_copy_only=False) for k in (at, batch.num_columns - 1))
            sequence, offset = np.empty(len(number), np.int64), np.empty(len(number), np.int64)
            for x in np.unique(length):
                rows = np.flatnonzero(length == x)
                first, base, place = sent.value[int(x)]
                k = np.searchsorted(first, number[rows], side="right") - 1
                sequence[rows], offset[rows] = base[k] + number[rows] - first[k], place[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=schema.names)

    return numbered.mapInArrow(run, schema)


def pack_documents(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", max_length: int = MAX_LENGTH, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack ``df``: the columns of ``pieces`` with sequence_id and offset. ``keep_ids``: with the ids themselves."""
    return pack(materialize(pieces(df, tokenizer, key, text, max_length, end_id, keep_ids), "pieces"), key, max_length)
