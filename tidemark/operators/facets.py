"""Faceted listings: the filter grammar, its predicate, and option counts."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import parse_qs, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import hub_range
from ..functions.text import search_form
from .intervals import in_window

#: Price bands and time ranges of the grammar.
BANDS = ("free", "under-15", "15-30", "over-30")
RANGES = ("today", "weekend")


@dataclass(frozen=True)
class Filters:
    """A listing's filters, as a query string states them."""

    q: str = ""
    cat: str = ""
    area: str = ""
    price: str = ""
    when: str = ""
    kids: bool = False

    @classmethod
    def parse(cls, query: str) -> Filters:
        """Read a query string; values outside the grammar are dropped."""
        got = {k: v[0] for k, v in parse_qs(query.lstrip("?")).items()}
        word = lambda k: got[k] if re.fullmatch("[a-z-]{2,20}", got.get(k, "")) else ""
        price = got.get("price", "") if got.get("price") in BANDS else "free" if got.get("free") == "1" else ""
        when = got.get("when", "") if got.get("when") in RANGES else ""
        return cls(got.get("q", "").strip()[:80], word("cat"), word("area"), price, when, got.get("kids") == "1")

    def query(self) -> str:
        """The canonical query string, empty without filters."""
        pairs = [("q", self.q), ("when", self.when), ("price", self.price), ("kids", "1" if self.kids else ""), ("cat", self.cat), ("area", self.area)]
        text = urlencode([(k, v) for k, v in pairs if v])
        return f"?{text}" if text else ""

    def predicate(self, today: Column, roll_up: str = "music") -> Column:
        """The filters over columns sub, parent, area, band, kids, start, end, search."""
        tests = []
        if self.cat:
            same = F.col("sub") == self.cat
            tests.append(same | (F.col("parent") == roll_up) if self.cat == roll_up else same)
        if self.area:
            tests.append(F.col("area") == self.area)
        if self.price:
            tests.append(F.col("band") == self.price)
        if self.kids:
            tests.append(F.col("kids"))
        if self.when:
            r = hub_range(self.when, today)
            tests.append(in_window("start", "end", r["from"], r["to"]))
        if self.q:
            words = F.filter(F.split(search_form(F.lit(self.q)), " "), lambda w: w != "")
            tests.append(F.forall(words, lambda w: F.contains(F.col("search"), w)))
        out = F.lit(True)
        for test in tests:
            out = out & test
        return out


def facet_counts(df: DataFrame, value: str, parent: str, roll_up: str) -> DataFrame:
    """(value, n) of each option, and one of the roll-up's parent if two or more of its options occur."""
    options = df.groupBy(F.col(value).alias("value"), F.col(parent).alias("_p")).agg(F.count(F.lit(1)).alias("n"))
    total = options.filter(F.col("_p") == roll_up).groupBy(F.lit(roll_up).alias("value")).agg(F.sum("n").alias("n"), F.count_distinct("value").alias("_k"))
    return options.groupBy("value").agg(F.sum("n").alias("n")).unionByName(total.filter("_k > 1").drop("_k"))


def top_values(df: DataFrame, by: list, value: str, n: int) -> DataFrame:
    """The n commonest values of each group, ties by value, with their place."""
    from pyspark.sql import Window

    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), value)
    return counts.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
