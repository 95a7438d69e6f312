"""Texts within a few edits of each other, by equi-joins on pieces.

A text cut into ``most`` + 1 pieces keeps one of them unharmed by ``most``
edits, so texts that near share a piece, at a place shifted by no more than the
edits allow. Pieces that many texts share say little (all names that begin
alike); texts that meet only there are joined on what is left of them without
some characters instead: texts of one length without those at the same places,
others (and texts with a part moved) without any few, as very near texts alone
have that in common. The first of these make by far the most pairs where names
differ by a number; each comes out once, so nothing has to gather them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialize

#: A piece that more texts share than this is busy.
BUSY = 200

#: Rows of one task where texts meet, however many there are in all.
ROWS = 250_000


def _pieces(texts: DataFrame, most: int) -> DataFrame:
    """(size, k, piece) beside the columns of every text longer than ``most``: its ``most`` + 1 pieces, the longer ones last."""
    n = F.length("t")
    short, rest = F.floor(n / (most + 1)).cast("int"), F.pmod(n, F.lit(most + 1))
    rows = texts.filter(n > most).select("*", n.alias("size"), F.explode(F.sequence(F.lit(0), F.lit(most))).alias("k"), short.alias("short"), rest.alias("rest"))
    at, width = _cut(F.col("k"), F.col("short"), F.col("rest"), most)
    return rows.select(*texts.columns, "size", "k", F.substring("t", at + 1, width).alias("piece"))


def _cut(k: Column, short: Column, rest: Column, most: int) -> tuple[Column, Column]:
    """Where piece k begins (from 0), and how long it is."""
    longer = F.greatest(k - (most + 1 - rest), F.lit(0))
    return (k * short + longer).cast("int"), (short + F.when(k >= most + 1 - rest, 1).otherwise(0)).cast("int")


def _windows(texts: DataFrame, most: int) -> DataFrame:
    """(size, k, piece) beside the columns of texts: what of each text may be piece k of a text of ``size`` characters, its own or up to ``most`` fewer."""
    n = F.length("t")
    least = F.greatest(F.lit(most + 1), n - most)
    sizes = texts.filter(n > most).select("*", n.alias("n"), F.explode(F.sequence(least, n)).alias("size"))
    rows = sizes.select("*", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("k"))
    at, width = _cut(F.col("k"), F.floor(F.col("size") / (most + 1)).cast("int"), F.pmod("size", F.lit(most + 1)), most)
    rows = rows.select("*", at.alias("at"), width.alias("width"))
    # Piece k has at most k edits before it and most - k behind it.
    gap = F.col("n") - F.col("size")
    low = F.greatest(F.lit(0), F.col("at") - F.col("k"), F.col("at") + gap - (most - F.col("k")))
    high = F.least(F.col("n") - F.col("width"), F.col("at") + F.col("k"), F.col("at") + gap + (most - F.col("k")))
    rows = rows.withColumns({"low": low, "high": high}).filter("low <= high")
    return rows.select(*texts.columns, "size", "k", "width", F.explode(F.sequence("low", "high")).alias("p")).select(*texts.columns, "size", "k", F.expr("substring(t, p + 1, width)").alias("piece"))


def _less(texts: DataFrame, fewer: int, same_places: bool = False) -> DataFrame:
    """(size, p1 .. p``fewer``, left) beside the columns of texts: each text without the characters at ``fewer`` places.

    Of characters alike beside each other only the first go, as the others leave
    the same, unless it's the places that count.
    """
    before, left = F.lit(0), F.col("t")
    rows = texts.select("*", F.length("t").alias("size"))
    for r in range(1, fewer + 1):
        rows = rows.withColumn(f"p{r}", F.explode(F.sequence(before + 1, F.greatest(before + 1, F.col("size") - (fewer - r)))))  # places behind the end take nothing
        p = F.col(f"p{r}")
        if not same_places:
            rows = rows.filter((p == before + 1) | (F.substring("t", p, F.lit(1)) != F.substring("t", p - 1, F.lit(1))))
        before = p
    for r in range(fewer, 0, -1):
        p = F.col(f"p{r}")
        left = F.concat(F.substring(left, F.lit(1), p - 1), F.substring(left, p + 1, F.col("size")))
    return rows.withColumn("left", left)


def _shortened(texts: DataFrame, most: int) -> DataFrame:
    """(size, d, left) beside the columns of texts: each text with up to ``most`` characters deleted."""
    parts = [_less(texts.filter(F.length("t") >= d), d).select(*texts.columns, "size", F.lit(d).alias("d"), "left") for d in range(most + 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _two(a: DataFrame, b: DataFrame, on: list[str], tasks: int) -> DataFrame:
    """(a, b): structs of rows that have ``on`` in common, by ``tasks`` tasks."""
    side = lambda df, name: df.select(*on, F.struct(*(c for c in df.columns if c not in on)).alias(name)).repartition(tasks, *on)
    return side(a, "a").join(side(b, "b"), on)


def _apart(places: int) -> Column:
    """Whether rows a and b, equal but for ``places`` places, meet nowhere before: places at which they are the same are the first ones."""
    char = lambda row, r: F.substring(F.col(row)["t"], F.col(f"p{r}"), F.lit(1))
    out = F.lit(True)
    for r in range(1, places + 1):
        out = out & ((F.col(f"p{r}") == r) | (char("a", r) != char("b", r)))
    return out


def _replaced(a: Column, b: Column, most: int) -> Column:
    """Whether texts have one length and differ at ``most`` places or fewer."""
    differ = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), F.lit(0), lambda n, k: n + (F.substring(a, k, F.lit(1)) != F.substring(b, k, F.lit(1))).cast("int"))
    return F.when(F.length(a) == F.length(b), differ <= most).otherwise(False)


def close_texts(df: DataFrame, text: str, most: int = 2, busy: int = BUSY, key: str | None = None, rows: int = ROWS) -> DataFrame:
    """(a, b, distance): different texts at most ``most`` edits apart, a < b.

    Every such pair comes once, whatever the number of rows that hold either
    text; null is no text, the empty text is one. Pieces shared by more than
    ``busy`` texts aren't joined on: their texts, and texts of 2 x ``most``
    characters or fewer, meet by what is left without up to ``most`` characters
    (some n**most rows a text), so the result doesn't depend on ``busy``.
    ``key``: a and b are the smallest ``key`` of each text's rows, not the texts.
    ``rows``: how many of these rows a task takes.
    """
    least = df.sparkSession.sparkContext.defaultParallelism
    own = "id" if key else "t"
    named = df.select(F.col(text).alias("t"), *([F.col(key).alias("id")] if key else [])).filter("t IS NOT NULL")
    texts = materialize((named.groupBy("t").agg(F.min("id").alias("id")) if key else named.distinct()).repartition(least), "spellings")
    place = ["size", "k", "piece"]
    crowded = materialize(_pieces(texts, most).groupBy(*place).count().filter(F.col("count") > busy).select(*place), "spellings-busy")
    names = texts.select("t")
    held = lambda df: df.join(crowded, place, "left_semi").select("t")
    crowd = held(_pieces(names, most)).union(held(_windows(names, most))).union(names.filter(F.length("t") <= 2 * most)).distinct()
    texts = materialize(texts.join(crowd.withColumn("crowd", F.lit(True)), "t", "left").withColumn("crowd", F.col("crowd").isNotNull()).repartition(least), "spellings-crowd")
    crowd = texts.filter("crowd")
    n = F.length("t")
    many = crowd.agg(F.coalesce(F.sum(F.pow(n.cast("double"), F.lit(most))), F.lit(0)).alias("x")).first()["x"] + texts.count()
    tasks = max(least, int(many / rows) + 1)
    # Texts of one length that differ at a few places only.
    same = _less(crowd.filter(n > 0), most, same_places=True)
    replaced = _two(same, same, ["size", *(f"p{r}" for r in range(1, most + 1)), "left"], tasks).filter("a.t < b.t").filter(_apart(most)).select("a", "b")
    # Others, by pieces, or by what any deletions leave.
    lengths = crowd.select(n.alias("n")).distinct()
    beside = lambda low, high: F.broadcast(lengths.select(F.explode(F.sequence(F.col("n") + low, F.col("n") + high)).alias("_n")).distinct())  # noqa: E731  as few rows as lengths
    pieces, windows = _pieces(texts, most).join(crowded, place, "left_anti"), _windows(texts, most)
    met = _two(pieces, windows, place, tasks).select("a", "b")
    moved = _less(crowd.filter(n >= most - 1), most - 1)
    moved = _two(moved, moved, ["size", "left"], tasks).select("a", "b")
    longer = _shortened(crowd.join(beside(1, most), n == F.col("_n"), "left_semi"), most).filter(F.col("d") == F.least(F.col("size"), F.lit(most)))
    shorter = _shortened(crowd.join(beside(-most, -1), n == F.col("_n"), "left_semi"), most - 1)
    uneven = _two(longer, shorter, ["left"], tasks).filter("a.size > b.size").select("a", "b")
    pick = lambda row: F.struct(*(F.col(row)[c].alias(c) for c in texts.columns)).alias(row)
    rest = met.select(pick("a"), pick("b")).union(moved.select(pick("a"), pick("b"))).union(uneven.select(pick("a"), pick("b")))
    rest = rest.filter("a.t <> b.t").filter(F.levenshtein("a.t", "b.t", most) >= 0)
    rest = rest.filter(~(F.col("a.crowd") & F.col("b.crowd") & _replaced(F.col("a.t"), F.col("b.t"), most)))
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).repartition(tasks, "a", "b").distinct()
    distance = F.levenshtein("a.t", "b.t", most).alias("distance")
    both = [F.col(f"a.{own}").alias("a"), F.col(f"b.{own}").alias("b"), distance]
    return replaced.select(*both).union(rest.select(*both)).filter("distance >= 0")
