"""What runs in rounds or by pieces against plain passes: first fit, numbers across tables, close spellings."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators import clustering, reports, spellings
from tidemark.plans.ranks import numbered


def pass_in_order(rows, links, members):
    """{id: cluster} by one pass; rows are (id, place)."""
    near = defaultdict(set)
    for a, b in links:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    taken, nth = {}, {}
    for i, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        open_ = [taken[x] for x in near[i] if x in taken and (members or taken[x] == x)]
        taken[i] = min(open_, key=nth.__getitem__) if open_ else i
        if not open_:
            nth[i] = len(nth)
    return taken


def a_graph(kind, rng):
    n = 300
    rows = [(i, rng.randrange(40) if kind != "chain" else i) for i in range(n)]
    if kind == "random":
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(2 * n)]
    elif kind == "chain":
        links = [(i, i + 1) for i in range(n - 1)]
    elif kind == "ladder":
        rows = [(i, i) for i in range(n)]
        links = [(i, i + k) for i in range(n) for k in (1, 2, 7) if i + k < n]
    elif kind == "cliques":
        links = [(a, b) for c in range(0, n, 12) for a in range(c, c + 12) for b in range(a + 1, c + 12)]
    else:  # a hub with all, and groups around
        links = [(150, i) for i in range(n)] + [(rng.randrange(n), rng.randrange(n)) for _ in range(n)]
    return rows, [*links, (5, 5), (7, 100_000), (3, 4), (4, 3)]


@pytest.mark.parametrize("members", [True, False])
def test_first_fit_is_the_pass_in_order(spark, members):
    rows, links = [], []
    for k, kind in enumerate(["random", "chain", "ladder", "cliques", "hub"]):  # side by side
        own, near = a_graph(kind, random.Random(kind))
        rows += [(1000 * k + i, place) for i, place in own]
        links += [(1000 * k + a, 1000 * k + b) for a, b in near]
    ids = {i for i, _ in rows}
    df = spark.createDataFrame(rows, "id long, place int").repartition(3)
    edges = spark.createDataFrame(links, "a long, b long").repartition(3)
    got = clustering.first_fit(df, edges, "id", ["place"], members, rounds=3)
    assert {r["id"]: r["cluster"] for r in got.collect()} == pass_in_order(rows, [(a, b) for a, b in links if {a, b} <= ids], members)


@pytest.mark.parametrize("members", [True, False])
def test_one_large_component_lies_in_many_tasks(spark, members):
    n = 100_000
    rows = spark.range(n).withColumn("place", F.xxhash64("id"))
    edges = spark.range(2 * n).select((F.col("id") % n).alias("a"), F.pmod(F.xxhash64(F.col("id") + 1), F.lit(n)).alias("b"))
    edges = edges.unionByName(spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))  # one component
    got = clustering.first_fit(rows, edges, "id", ["place"], members)
    plan = got._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan
    want = pass_in_order([tuple(r) for r in rows.collect()], [tuple(r) for r in edges.collect()], members)
    assert {r["id"]: r["cluster"] for r in got.collect()} == want


def test_first_fit_of_nothing(spark):
    none = spark.createDataFrame([], "id long, place int")
    links = spark.createDataFrame([(1, 2)], "a long, b long")
    assert clustering.first_fit(none, links, "id", ["place"]).count() == 0
    one = spark.createDataFrame([(1, 5), (2, None)], "id long, place int")
    assert sorted(map(tuple, clustering.first_fit(one, links, "id", ["place"]).collect())) == [(1, 2), (2, 2)]  # nulls first
    assert sorted(map(tuple, clustering.first_fit(one, links.limit(0), "id", ["place"], members=False).collect())) == [(1, 1), (2, 2)]


@pytest.mark.parametrize("by", [[], ["kind"], ["kind", "more"]])
def test_numbers_across_a_table(spark, by):
    rng = random.Random(3)
    rows = [(k, rng.choice(["hot"] * 8 + ["a", None]), rng.randrange(2), rng.randrange(10_000)) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, kind string, more int, v int").repartition(7)
    got = numbered(df, [F.desc("v"), "id"], by)
    want, at = {}, defaultdict(int)
    for i, kind, more, _ in sorted(rows, key=lambda r: (-r[3], r[0])):
        group = (kind, more)[: len(by)]
        want[i] = at[group]
        at[group] += 1
    assert {r["id"]: r["n"] for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan or not by
    assert numbered(df.limit(0), ["id"], by).count() == 0


def test_batches_of_one_hot_group(spark):
    df = spark.range(1000).select("id", F.lit("x").alias("status"))
    got = reports.chunked(df, ["status"], ["id"], 64)
    assert {r["id"]: r["chunk"] for r in got.collect()} == {k: k // 64 for k in range(1000)}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize(("most", "busy"), [(1, 3), (2, 1), (2, 1000), (3, 3)])
def test_close_texts_are_all_pairs_within_the_edits(spark, most, busy):
    rng = random.Random(most)
    base = ["", "a", "é", "ab", "abc", "café rivoli", "cafe rivoli", "teatro são joão", "teatro sao joao", "Supplier#000000001"]
    texts = set(base)
    for _ in range(130):
        t = list(rng.choice([*base, *texts]))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(t) + 1)
            t[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "é", "1"])
        texts.add("".join(t))
    rows = [(t,) for t in texts for _ in range(2)] + [(None,)]
    got = spellings.close_texts(spark.createDataFrame(rows, "t string").repartition(3), "t", most, busy)
    texts = sorted(texts, key=lambda t: t.encode())
    want = {(a, b, d) for k, a in enumerate(texts) for b in texts[k + 1 :] if (d := edits(a, b)) <= most}
    found = list(map(tuple, got.collect()))
    assert len(found) == len(set(found))
    assert set(found) == want


def test_names_that_begin_alike_make_no_square(spark):
    """4,000 names share two of their three pieces; few are near each other."""
    df = spark.range(4_000).select(F.concat(F.lit("Fornecedor Numero "), F.left(F.sha2(F.col("id").cast("string"), 256), F.lit(9))).alias("t"))
    texts = df.select("t")
    place = ["size", "k", "piece"]
    busy = spellings._pieces(texts, 2).groupBy(*place).count().filter(F.col("count") > spellings.BUSY)
    assert busy.count() >= 2
    left = spellings._shortened(texts, 2).groupBy("left").count()
    assert left.agg(F.max("count")).first()[0] < 100
    assert spellings.close_texts(texts, "t", 2).count() < 100


def test_numbered_names_meet_once_and_are_not_gathered(spark):
    """Names that differ by a number only: each pair is made once, by tasks as many as the rows ask for, so that none has to hold the pairs."""
    names = [f"Supplier#{k:09d}" for k in range(260)]
    want = {(a, b, d) for k, a in enumerate(names) for b in names[k + 1 :] if (d := edits(a, b)) <= 2}
    df = spark.createDataFrame([(t,) for t in names], "t string")
    got = spellings.close_texts(df, "t", 2, rows=4_000)
    found = list(map(tuple, got.collect()))
    assert len(found) == len(set(found))
    assert set(found) == want
    plan = got._jdf.queryExecution().executedPlan().toString().split("AdaptiveSparkPlan isFinalPlan=false")[0]
    assert "hashpartitioning(size#" in plan and ", 22), REPARTITION_BY_NUM" in plan  # 260 names of 18**2 rows at most
    # What meets at the same places goes on to the result as it comes: of the two parts of the union, one has no aggregate over its join.
    depth = lambda line: len(line) - len(line.lstrip(" :+-|"))
    lines = plan.splitlines()
    union = next(k for k, line in enumerate(lines) if line.strip(" :+-*()0123456789").startswith("Union"))
    first = []
    for line in lines[union + 1 :]:
        if first and depth(line) <= depth(lines[union + 1]):
            break
        first.append(line)
    over = first[: next(k for k, line in enumerate(first) if "Join" in line)]
    assert not any("Aggregate" in line for line in over)


def test_close_names_by_the_smallest_key_of_each(spark):
    rows = [(9, "north hall"), (4, "north hall"), (2, "north hal"), (7, "south"), (1, None), (5, "mouth")]
    got = spellings.close_texts(spark.createDataFrame(rows, "k long, t string"), "t", 2, key="k")
    assert sorted(map(tuple, got.collect())) == [(2, 4, 1), (5, 7, edits("mouth", "south"))]
