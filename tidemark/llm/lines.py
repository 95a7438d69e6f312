"""Removal of lines that many sites share, by distinct-site sketches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, materialize

#: Log2 of the sketches' buckets; their relative error is about 0.83 / sqrt(2 ** LG_K).
LG_K = 12


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n")


def _hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def shared_lines(df: DataFrame, key: str, text: str, site: str, min_sites: int) -> tuple[DataFrame, DataFrame]:
    """(hits, boilerplate): (key, site, line) of lines in at least ``min_sites`` documents; (line, sites, keeper) of those on as many sites."""
    hashes = F.array_distinct(F.transform(F.filter(_lines(text), lambda x: F.trim(x) != ""), _hash))
    lines = df.select(F.col(key).alias("_key"), F.coalesce(F.concat(F.lit("="), F.col(site).cast("string")), F.lit("")).alias("_site"), F.explode(hashes).alias("line"))
    # A line of fewer documents has fewer sites: a plain count rules most lines out before any sketch is made.
    often = lines.groupBy("line").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_sites).select("line")
    often = materialize(often, "lines-often")  # a plain exchange on both sides, so that Spark can split a hot line in the join
    hits = materialize(lines.join(often, "line", "left_semi"), "lines")
    sketches = hits.groupBy("line").agg(F.hll_sketch_agg("_site", LG_K).alias("_sketch"), F.min("_key").alias("keeper"))
    spread = sketches.select("line", "keeper", F.hll_sketch_estimate("_sketch").alias("sites"))
    slack = max(1, math.ceil(5 * 0.83 / math.sqrt(1 << LG_K) * min_sites))
    spread = materialize(spread.filter(F.col("sites") >= min_sites - slack), "lines-spread")
    near = spread.filter(F.col("sites") <= min_sites + slack).select("line")
    exact = hits.join(near, "line", "left_semi").groupBy("line").agg(F.count_distinct("_site").alias("_exact"))
    boiler = spread.join(exact, "line", "left").withColumn("sites", F.coalesce("_exact", "sites")).drop("_exact")
    return hits, boiler.filter(F.col("sites") >= min_sites)


def _without(lines: Column, bad: Column) -> Column:
    """``lines`` without those whose hash is in ``bad``: the hashes are looked up in about sqrt(lines) buckets."""
    n = F.greatest(F.ceil(F.sqrt(F.size(lines))).cast("int"), F.lit(1))
    buckets = F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.filter(bad, lambda x: F.pmod(x, n) == b))
    known = lambda t: lambda h: F.array_contains(F.get(t, F.pmod(h, n).cast("int")), h)
    return let(buckets, lambda t: F.filter(lines, lambda x: (F.trim(x) == "") | ~let(_hash(x), known(t))))


def drop_shared_lines(df: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = 5) -> DataFrame:
    """``df`` with lines of ``min_sites`` or more sites taken out of ``text``, plus n_lines and n_removed.

    Lines are compared without outer blanks, by 64-bit hash; blank lines stay.
    A line's sites are counted by a HyperLogLog sketch per line; near the
    threshold they are counted exactly. The line stays in the document with the
    least key, so the corpus keeps one copy. A null site is a site of its own;
    null texts stay null; null keys are one document, never the least while
    there is another. Rows with one key are one document. Columns named n_lines
    or n_removed are replaced; any other column stays as it is.
    """
    df = df.drop("n_lines", "n_removed")
    doc, lost, kept = fresh(df.columns, "_doc", "_bad", "_kept")
    hits, boiler = shared_lines(df, key, text, site, min_sites)
    bad = hits.join(boiler, "line").filter(~F.col("_key").eqNullSafe(F.col("keeper")))
    bad = bad.groupBy(F.col("_key").alias(doc)).agg(F.collect_set("line").alias(lost))
    out = df.join(bad, F.col(key).eqNullSafe(F.col(doc)), "left")
    lines = _lines(text)
    out = out.withColumn(kept, F.when(F.col(lost).isNull(), lines).otherwise(_without(lines, F.col(lost))))
    total = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("int")
    gone = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines) - F.size(kept)).cast("int")
    return out.withColumns({"n_lines": total, "n_removed": gone, text: F.array_join(kept, "\n")}).drop(kept, lost, doc)
