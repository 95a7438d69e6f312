"""Toxicity of texts after undoing obfuscation by a noisy-channel decoder.

Writers hide words by leetspeak (``1d10t``), spacing (``i d i o t``) and
repetition (``idiooot``). A span that looks so becomes a lattice of characters:
what each sign may stand for, what may be dropped, each at a channel cost.
Viterbi decoding under a character trigram model, counted over all documents,
gives the most likely reading. What the text says as written and as restored is
scored by words learned from labelled documents and by a few numbers of style.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_value, materialize, small_batches

by_value(__name__)

#: What a sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "£": "l"}
#: Channel costs (negative log probabilities): a sign for a letter; a letter's second and further copies, a separator and any other sign dropped.
SUBSTITUTE, DROP_SECOND, DROP_FURTHER, DROP_SEPARATOR, DROP_SIGN = 0.7, 4.0, 0.2, 0.3, 9.0
#: A vowel behind a star; a separator and any other sign that stand for the end of a word.
HIDDEN, SPLIT, SPLIT_SIGN = 1.6, 1.0, 3.0
#: Letters of the character model: a-z and Latin-1's small letters; all else is the boundary, class 0.
ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if chr(c).isalpha())
CLASSES = len(ALPHABET) + 1
#: Labelled documents to learn from, at most (by a hash of their id).
MAX_LABELLED = 100_000
#: Characters that are counted at once.
COUNTED = 1 << 18
#: A task holds the pieces of texts up to about so many before it hands them on.
MOST_HELD = 50_000
#: Words count with their beginnings of these lengths, so that inflected forms tell, too.
PREFIXES = (4, 5, 6, 7, 8)

_WORD = re.compile(r"[^\W\d_]{3,}")
_CHARS = r"(?:[^\W\d_]|[" + re.escape("".join(LEET)) + "])"
#: Single letters and signs with separators between, a letter among the first three. Possessive, so that long runs take no memory.
_SPACED = re.compile(rf"(?<![^\s])(?=(?:{_CHARS}[ .*_-]{{1,2}}){{0,2}}[^\W\d_]){_CHARS}(?:[ .*_-]{{1,2}}{_CHARS}(?![^\W_]|[@$!|+€£])){{2,}}+")
#: Where a span ends, and what is cut off its ends.
_EDGES, _TRIM = frozenset(" \t\n\r\x0b\x0c,;:?\"()"), ".!*_-"
#: Kinds of characters: others, letters, signs that stand for letters, separators, edges.
_LETTER, _SIGN, _SEPARATOR, _EDGE = 1, 2, 3, 4


def _kinds() -> np.ndarray:
    kinds = np.zeros(0x2100, np.uint8)
    for k in range(len(kinds)):
        c = chr(k)
        kinds[k] = _LETTER if c.isalpha() else _SIGN if c in LEET and c != "!" else _SEPARATOR if c in "!*_.-" else _EDGE if c in _EDGES else 0
    return kinds


_KINDS = _kinds()
_CAPITAL = np.array([chr(k).isupper() for k in range(0x250)])
_MARK = np.array([0x20 < k < 0x7F and not chr(k).isalnum() for k in range(0x250)])


def _codes(text: str) -> np.ndarray:
    """The classes of a text in small letters."""
    table = np.zeros(0x250, np.int64)
    for k, c in enumerate(ALPHABET):
        table[ord(c)] = k + 1
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(points < 0x250, table[np.minimum(points, 0x24F)], 0)


def char_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(gram, n): counts of character trigrams over all texts; gram packs three classes."""

    def count(batches):
        total = np.zeros(CLASSES**3, np.int64)

        def add(parts: list[tuple[str, str]]) -> None:
            # Two characters before each part are its context only: no trigram ends there.
            c = _codes("".join(a + b for a, b in parts))
            ends = np.ones(len(c), bool)
            starts = np.cumsum([0, *(len(b) + 2 for _, b in parts[:-1])])
            ends[starts] = ends[starts + 1] = False
            grams = (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
            total[:] += np.bincount(grams[ends[2:]], minlength=CLASSES**3)

        parts: list[tuple[str, str]] = []
        n = 0
        for batch in batches:
            for t in batch.column(0):
                t = (t.as_py() or "").lower()
                for at in range(0, len(t), COUNTED):
                    parts.append((t[at - 2 : at] if at else "\0\0", t[at : at + COUNTED]))
                    n += len(parts[-1][1])
                    if n >= COUNTED:
                        add(parts)
                        parts, n = [], 0
        if parts:
            add(parts)
        grams = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(total[grams])], names=["gram", "n"])

    small_batches(df.sparkSession)
    return df.select(text).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class CharModel:
    """Trigram costs with back-off to bigrams and single characters."""

    def __init__(self, grams: dict[int, int]):
        n3 = np.zeros(CLASSES**3)
        if grams:
            n3[np.fromiter(grams, np.int64)] = np.fromiter(grams.values(), np.float64)
        n3 = n3.reshape(CLASSES, CLASSES, CLASSES)
        n2, n1 = n3.sum(axis=0), n3.sum(axis=(0, 1))
        p1 = (n1 + 1) / (n1.sum() + CLASSES)
        p2 = (n2 + 5 * p1) / (n2.sum(axis=1, keepdims=True) + 5)
        p3 = (n3 + 5 * p2[None]) / (n3.sum(axis=2, keepdims=True) + 5)
        self.cost = (-np.log(p3)).astype(np.float32).reshape(-1).tolist()
        self.code = {c: k + 1 for k, c in enumerate(ALPHABET)}

    def _ways(self, x: str, last: str, before: str) -> list[tuple[str, float]]:
        """What a character may stand for, at what cost; a blank is a word's end."""
        if x in self.code:
            return [(x, 0.0), ("", DROP_FURTHER if x == before else DROP_SECOND)] if x == last else [(x, 0.0)]
        if x == "*":
            return [*((y, HIDDEN) for y in "aeiou"), ("", DROP_SEPARATOR), (" ", SPLIT)]
        if x in LEET:
            return [*((y, SUBSTITUTE) for y in LEET[x]), ("", DROP_SIGN), (" ", SPLIT_SIGN)]
        return [(x, 0.0)] if x.isalpha() else [("", DROP_SEPARATOR), (" ", SPLIT)]

    def decode(self, span: str) -> str:
        """The likeliest reading of an obfuscated span (lower case), its words separated by blanks."""
        code, cost, n = self.code, self.cost, CLASSES
        # A state's reading is a chain (reading before, character), so what readings share is held once, however long the span.
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        last = before = ""
        for x in span:
            ways = self._ways(x, last, before)
            last, before = x, last
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (c, out) in states.items():
                for y, w in ways:
                    if y:
                        k = code.get(y, 0)
                        state, total = (b, k), c + w + cost[(a * n + b) * n + k]
                        if state not in new or total < new[state][0]:
                            new[state] = (total, (out, y))
                    elif (a, b) not in new or c + w < new[a, b][0]:
                        new[a, b] = (c + w, out)
            states = new
        ends = [(c + cost[(a * n + b) * n], out) for (a, b), (c, out) in states.items()]
        least = min(c for c, _ in ends)
        return " ".join(min(self._reading(out) for c, out in ends if c == least).split())

    @staticmethod
    def _reading(out: tuple | None) -> str:
        chars = []
        while out:
            out, y = out
            chars.append(y)
        return "".join(reversed(chars))


class Restorer:
    """Replaces what looks obfuscated in a text by its decoded reading; keeps what it has decoded."""

    def __init__(self, model: CharModel, room: int = 100_000):
        self.model, self.room, self.seen = model, room, {}
        #: Spans decoded in the last text.
        self.spans = 0

    def _decoded(self, m: re.Match) -> str:
        return self.decode(m[0])

    def decode(self, span: str) -> str:
        self.spans += 1
        got = self.seen.get(span)
        if got is None:
            got = self.model.decode(span)
            if len(span) <= 64:  # longer ones hardly come again
                if len(self.seen) >= self.room:
                    self.seen.clear()
                self.seen[span] = got
        return got

    @staticmethod
    def _look(text: str) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        return points, _KINDS[np.minimum(points, 0x20FF)]

    def restore(self, text: str) -> str:
        """The text in lower case with its obfuscated spans decoded."""
        self.spans = 0
        text = text.lower()
        if len(text) < 3:
            return text
        points, kind = self._look(text)
        letter = kind == _LETTER
        told = letter | (kind == _SIGN) | (points == ord("!"))
        single = told.copy()
        single[1:] &= ~told[:-1]
        single[:-1] &= ~told[1:]
        at = np.flatnonzero(single)
        if len(at) > 2 and (at[2:] - at[:-2] <= 6).any():
            text = _SPACED.sub(self._decoded, text)
            points, kind = self._look(text)
            letter = kind == _LETTER
        # A sign beside a letter or beside another sign that is, a star or an exclamation mark between letters, a letter between separators, a letter three times.
        sign = kind == _SIGN
        hit = np.zeros(len(kind), bool)
        hit[:-1] = sign[:-1] & letter[1:]
        hit[1:] |= sign[1:] & letter[:-1]
        hit[1:-1] |= letter[:-2] & letter[2:] & ((points[1:-1] == ord("*")) | (points[1:-1] == ord("!")))
        hit[1:-1] |= letter[1:-1] & (kind[:-2] == _SEPARATOR) & (kind[2:] == _SEPARATOR)
        hit[2:] |= letter[2:] & (points[2:] == points[1:-1]) & (points[2:] == points[:-2])
        if not hit.any():
            return text
        edges = np.concatenate([[-1], np.flatnonzero(kind == _EDGE), [len(kind)]])
        first = np.unique(np.searchsorted(edges, np.flatnonzero(hit)))  # the edge that ends each hit's span
        out, done = [], 0
        for a, b in zip((edges[first - 1] + 1).tolist(), edges[first].tolist(), strict=True):
            span = text[a:b]
            core = span.strip(_TRIM)
            if core:
                at = a + span.index(core[0]) if len(core) < len(span) else a
                out += [text[done:at], self.decode(core)]
                done = at + len(core)
        return "".join([*out, text[done:]])


def _look_at(text: str | None, restorer: Restorer) -> tuple[set[str], list[float]]:
    """The words of a text, as written and as read, with their beginnings; and its style."""
    if not text:
        return set(), [0.0] * STYLES
    read = restorer.restore(text)
    said = _WORD.findall(read)
    words = set(said)
    if restorer.spans:
        words.update(_WORD.findall(text.lower()))
    pieces = set(words)
    for k in PREFIXES:
        pieces.update([w[:k] + "*" for w in words if len(w) > k])
    points = np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 0x24F)
    n, many = len(points), len(said)
    return pieces, [math.log1p(many), math.log1p(len(words)), np.count_nonzero(_CAPITAL[points]) / n, np.count_nonzero(_MARK[points]) / n, math.log1p(restorer.spans) - math.log1p(many)]


#: Numbers in a text's style: words, different words, capitals, marks, and spans decoded for each word.
STYLES = 5


def deobfuscated(df: DataFrame, grams: dict[int, int], text: str = "text") -> DataFrame:
    """``df`` with ``text`` lower-cased and its obfuscated spans decoded."""
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(grams)  # at most CLASSES ** 3 numbers
    at = df.columns.index(text)

    def run(batches):
        restorer = Restorer(CharModel(sent.value))
        for batch in batches:
            done = [t if t is None else restorer.restore(t) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(done, batch.schema.field(at).type))

    return df.mapInArrow(run, df.schema)


def _features(top: float, total: float, hits: int, style: list[float]) -> list[float]:
    return [1.0, top, math.log1p(total), math.log1p(hits), *style]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of a small logistic regression by Newton steps; the first column, of ones, isn't drawn to zero."""
    mean, spread = x.mean(axis=0), x.std(axis=0)
    mean[0], spread[spread == 0] = 0.0, 1.0
    z, w, pull = (x - mean) / spread, np.zeros(x.shape[1]), ridge * np.ones(x.shape[1])
    pull[0] = 1e-6
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull), z.T @ (p - y) + pull * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    w /= spread
    w[0] -= float(w[1:] @ mean[1:])
    return w


def telling(tally: DataFrame, pos: Column, neg: Column, n_pos: int, n_neg: int, n_pieces: int) -> dict[str, float]:
    """Log odds of the pieces that make a document likelier toxic than not.

    Chance must not explain a piece's lean to toxic documents, over all pieces
    tried, and even the lower end of its share of them must be above a half.
    Pieces come from a bounded sample of documents, so their number is bounded.
    """
    base = (n_pos + 0.5) / (n_pos + n_neg + 1)
    p = pos / (pos + neg)
    gain = pos * F.ln(p / base) + F.when(neg > 0, neg * F.ln((1 - p) / (1 - base))).otherwise(F.lit(0.0))
    odds = F.ln((pos + 0.5) / (n_pos + 1)) - F.ln((neg + 0.5) / (n_neg + 1))
    n, z = pos + neg, 1.645
    least = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)  # Wilson's bound
    found = tally.filter((F.col("piece") != "") & (pos > 0)).filter((p > base) & (gain >= math.log(max(n_pieces, 1)) + 3) & (least > 0.5))
    return {r[0]: r[1] for r in found.select("piece", odds).collect()}


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_labelled: int = MAX_LABELLED) -> dict:
    """Learn from labelled rows: the character model of all ``docs``, telling words, and weights for their hits.

    At most about ``max_labelled`` labelled rows are used, chosen by a hash of
    the key. Words (and beginnings of words) are learned on each half of them and
    the weights on their hits in the other half; then words are learned again on
    all. Rows with a null label are no labels; equal texts count once. Without labels of both kinds
    every score is the same, the share of toxic labels (or 0.5 without any).
    """
    spark = docs.sparkSession
    grams = {r[0]: r[1] for r in char_counts(docs, text).collect()}  # at most CLASSES ** 3 rows
    sent = spark.sparkContext.broadcast(grams)
    labels = labels.filter(F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    n = labels.count()
    if n > max_labelled:
        labels = labels.filter(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < int(1_000_000 * max_labelled / n))
    # Labels are some max_labelled small rows now, so they go to the texts and no text is exchanged.
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.length("t") > 0).join(F.broadcast(labels), "k")

    def look(batches):
        restorer = Restorer(CharModel(sent.value))
        for batch in batches:
            first, pieces, style, n = 0, [], [], 0
            for k, t in enumerate(batch.column(2)):
                found, numbers = _look_at(t.as_py(), restorer)
                pieces.append([*found, ""])
                style.append(numbers)
                n += len(found)
                if n >= MOST_HELD or k + 1 == batch.num_rows:
                    cols = [batch.column(0)[first : k + 1], batch.column(1)[first : k + 1], pa.array(pieces, pa.list_(pa.string())), pa.array(style, pa.list_(pa.float64()))]
                    yield pa.RecordBatch.from_arrays(cols, names=["h", "y", "pieces", "style"])
                    first, pieces, style, n = k + 1, [], [], 0

    # The empty piece counts documents.
    seen = texts.select(F.xxhash64("t").alias("h"), "y", "t").mapInArrow(look, "h long, y int, pieces array<string>, style array<double>")
    seen = materialize(seen, "labelled")
    once = seen.groupBy("h").agg(F.max("y").alias("y"), F.count(F.lit(1)).alias("copies"))
    copies = materialize(once.filter("copies > 1"), "labelled-copies")
    exploded = lambda rows: rows.select("h", "y", F.explode("pieces").alias("piece"))
    # Texts that come once need no further step; of the others one copy each is taken.
    single = seen.join(F.broadcast(copies.select("h")), "h", "left_anti")
    repeated = seen.join(F.broadcast(copies.select("h")), "h", "left_semi").groupBy("h").agg(F.max("y").alias("y"), F.first("pieces").alias("pieces"), F.first("style").alias("style"))
    rows = single.unionByName(repeated)
    case = lambda y, half: F.count_if((F.col("y") == y) & (F.col("h").bitwiseAND(F.lit(1)) == half))
    tally = exploded(rows).groupBy("piece").agg(case(1, 0).alias("p0"), case(0, 0).alias("n0"), case(1, 1).alias("p1"), case(0, 1).alias("n1"))
    tally = materialize(tally, "words")
    _, p0, n0, p1, n1 = tally.filter("piece = ''").first() or (None, 0, 0, 0, 0)
    n_pieces, total = tally.count(), p0 + n0 + p1 + n1
    model = {"grams": grams, "words": {}, "weights": [math.log((p0 + p1 + 0.5) / (n0 + n1 + 0.5)) if total else 0.0, *[0.0] * (3 + STYLES)]}
    if not (p0 + p1 and n0 + n1):
        return model
    held = []
    for k, pos, neg in ((0, p0, n0), (1, p1, n1)):
        half = telling(tally, F.col(f"p{k}"), F.col(f"n{k}"), pos, neg, n_pieces)
        other = rows.filter(F.col("h").bitwiseAND(F.lit(1)) == 1 - k)
        odds = spark.createDataFrame(list(half.items()), "piece string, odds double")
        hits = exploded(other).join(F.broadcast(odds), "piece").groupBy("h").agg(F.max("odds").alias("top"), F.sum("odds").alias("total"), F.count(F.lit(1)).alias("n"))
        held += other.select("h", "y", "style").join(F.broadcast(hits), "h", "left").select("y", "top", "total", "n", "style").collect()  # at most max_labelled rows of numbers
    x = np.array([_features(r["top"] or 0.0, r["total"] or 0.0, r["n"] or 0, r["style"]) for r in held])
    model["weights"] = _logistic(x, np.array([r["y"] for r in held], float)).tolist()
    model["words"] = telling(tally, F.col("p0") + F.col("p1"), F.col("n0") + F.col("n1"), p0 + p1, n0 + n1, n_pieces)
    return model


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with score: the probability that a text is toxic.

    Null and empty texts score as texts without any words. A column score is
    replaced.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # CLASSES ** 3 counts, and words of a bounded sample

    @F.arrow_udf("double")
    def scores(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        restorer, words, weights = Restorer(CharModel(m["grams"])), m["words"], m["weights"]
        for batch in texts:
            out = []
            for t in batch:
                pieces, style = _look_at(t.as_py(), restorer)
                odds = sorted(words[w] for w in pieces & words.keys())
                x = _features(odds[-1] if odds else 0.0, math.fsum(odds), len(odds), style)
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, math.fsum(a * b for a, b in zip(weights, x, strict=True)))))))
            yield pa.array(out, pa.float64())

    # Texts go to Python and scores come back; the rows wait in Spark.
    return docs.drop("score").withColumn("score", scores(F.col(text)))
