"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, running

#: Words are separated by these characters only.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """One row per ``source`` of ``sized`` (source, size): source, source_size, target.

    Sources in code-point order (null last) weigh ``weights``, repeating, and
    share ``share`` times the total size. A target stops at ``cap`` times its
    source's size; what it leaves is shared again by weight among the others
    until none is above. A source of size 0 has target 0. If all stop, targets
    sum to less than the share.

    Sources stop in the order of limit over weight, so the level at which the
    rest share is found from running sums in that order.
    """
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = running(src, [F.col("source").asc_nulls_last()], {"nth": F.lit(1)}, "mixing-sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    src = src.select("source", "source_size", weight.alias("w"), (F.lit(float(cap)) * F.col("source_size")).alias("most"))
    src = materialize(src, "mixing-sources")
    totals = src.agg(F.sum("source_size").alias("all_size"), F.sum("w").alias("all_w"))  # one row
    sums = running(src, [F.col("most") / F.col("w"), F.col("source").asc_nulls_last()], {"upto": F.col("most"), "w_upto": F.col("w")}, "mixing-order").join(F.broadcast(totals))
    level = (F.lit(float(share)) * F.col("all_size") - (F.col("upto") - F.col("most"))) / (F.col("all_w") - (F.col("w_upto") - F.col("w")))
    own = F.col("most") / F.col("w")
    found = sums.select(F.when(level < own, own).alias("own"), level.alias("level")).agg(F.min_by("level", "own").alias("level"))  # the first that does not stop
    most, shared = F.col("most"), F.col("w") * F.col("level")
    target = F.when(F.col("level").isNull() | (most <= shared), most).otherwise(shared)
    return src.join(F.broadcast(found)).select("source", "source_size", target.cast("double").alias("target"))


def mix(df: DataFrame, key: str, text: str = "text", source: str = "source", weights: list[float] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, seed: str = "mix", keep: tuple = ()) -> DataFrame:
    """Per row of ``df``: key, source, size, source_size, target, copies, and the columns of ``keep``.

    Every row of a source expects target / source_size copies. Expected copies
    are summed along the source in order of size, one offset in [0, 1) drawn
    from the source's name is added, and a row is emitted once for each integer
    that its sum passes. So copies differ from the expected number by less than
    one, no row has more than ``cap`` (rounded up), and, as rows of like size
    stand together, the source's words come near its target.

    Null texts have size 0. Null keys and sources are values like any other;
    rows equal in key and size are interchangeable. Reruns agree, as nothing
    depends on Spark's partitions. Columns of ``keep`` named as a new column
    are an error; columns of df that aren't kept may have any names.
    """
    new = {"size", "source_size", "target", "copies"}
    if clash := new & {c.lower() for c in (key, source, *keep)}:
        raise ValueError(f"columns {sorted(clash)} are made here: rename yours")
    # All that is kept travels in one column, so that no name can meet one of these.
    rows = F.struct(F.lit(0).alias("_"), *(F.col(c) for c in keep)).alias("rest")
    sized = df.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(text).alias("size"), rows)
    sized = materialize(sized, "mixing")
    targets = source_targets(sized.select("source", "size"), list(weights), share, cap)
    # Size classes: the leading five bits of the size. Classes and sub-classes of a source are few, whatever its rows.
    bits = F.length(F.bin("size"))
    cls = F.when(F.col("size") < 32, F.col("size")).otherwise(bits * 32 + F.floor(F.col("size") / F.pow(F.lit(2.0), bits - 5))).cast("int")
    # 256 sub-classes by a hash of the key, so that no class holds a hot source's rows.
    tag = F.md5(F.encode(F.coalesce(F.col("key").cast("string"), F.lit("")), "UTF-8"))
    sized = sized.withColumns({"class": cls, "tag": tag, "sub": F.substring(tag, 1, 2)})
    classes = sized.groupBy("source", "class", "sub").agg(F.count(F.lit(1)).alias("n"))
    classes = running(classes, [F.col("source").asc_nulls_last(), F.col("class"), F.col("sub")], {"upto": F.col("n")}, "mixing-classes").withColumn("upto", F.col("upto") - F.col("n"))
    classes = materialize(classes, "mixing-classes")
    firsts = classes.groupBy("source").agg(F.min("upto").alias("base"))
    firsts = firsts.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    classes = classes.select(F.col("source").alias("s"), F.col("class").alias("c"), F.col("sub").alias("u"), "upto")
    classes = classes.join(firsts, F.col("s").eqNullSafe(F.col("source"))).select("s", "c", "u", (F.col("upto") - F.col("base")).alias("before"), "source_size", "target")
    rank = F.row_number().over(Window.partitionBy("source", "class", "sub").orderBy("size", "tag", "key"))
    ranked = sized.withColumn("rank", rank)
    out = ranked.join(classes, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")) & (F.col("sub") == F.col("u")))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.encode(F.concat(F.lit(seed), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))), "UTF-8")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    upto = lambda n: F.floor(n * each + offset)
    at = F.col("before") + F.col("rank")
    copies = (upto(at) - upto(at - 1)).alias("copies")
    return out.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", copies, *(F.col("rest")[c].alias(c) for c in keep))
