"""Records mined from tag trees against a plain version, listings with dates, and hostile pages."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import date

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.sources import records as R


def some_tree(rng, depth=0):
    """A random element: (tag, link or None, children), texts as strings."""
    tag = rng.choice(["div", "section", "span", "b", "a"])
    kids = []
    if depth < 4:
        kind = some_tree(rng, depth + 1) if rng.random() < 0.8 else None
        for _ in range(rng.randint(depth == 0, 5)):
            kids.append(rng.choice(["x", "y z", ""]) if rng.random() < 0.4 else kind if kind and rng.random() < 0.7 else some_tree(rng, depth + 1))
    return tag, rng.choice([None, "/u"]) if tag == "a" else None, kids


def markup(node):
    if isinstance(node, str):
        return node
    tag, link, kids = node
    href = f' class="k" href="{link}"' if link else ""
    return f"<{tag}{href}>" + "".join(markup(k) if not isinstance(k, str) else k + "<!-- -->" for k in kids) + f"</{tag}>"


def plain_values(root):
    """(number, path, value, numbers of open elements), elements and values numbered together."""
    out, n = [], 0

    def walk(node, path, open_):
        nonlocal n
        n += 1
        tag, link, kids = node
        path, open_ = (*path, tag), (*open_, n)
        for v, kind in [(link, "@href"), *((k, "#text") if isinstance(k, str) else (k, None) for k in kids)]:
            if kind is None:
                walk(v, path, open_)
            elif v:
                n += 1
                out.append((n, (*path, kind), v, open_))

    walk(root, (), ())
    return out


def plain_records(root, least=3):
    values = plain_values(root)
    inside = defaultdict(dict)  # (group, record) -> (path inside, nth) -> (number, value)
    parents = {}
    for n, path, v, open_ in values:
        for d in range(1, len(open_)):
            own = inside[path[: d + 1], open_[d]]
            nth = 1 + sum(p == path[d + 1 :] for p, _ in own)
            own[path[d + 1 :], nth] = (n, v)
            parents[open_[d]] = open_[d - 1]
    groups = defaultdict(list)
    for g, r in inside:
        groups[g].append(r)
    out = set()
    for g, rs in groups.items():
        by_parent = defaultdict(int)
        for r in rs:
            by_parent[parents[r]] += 1
        if len(rs) < least or max(by_parent.values()) < 2:
            continue
        have, off = defaultdict(int), {}
        for r in rs:
            for place, (n, _) in inside[g, r].items():
                have[place] += 1
                off[place] = min(off.get(place, 10**9), n - r)
        template = sorted((p for p in have if 2 * have[p] >= len(rs)), key=lambda p: (off[p], R._hash(p[0]), p[1]))
        kept = [r for r in sorted(rs) if template and 2 * sum(p in inside[g, r] for p in template) >= len(template)]
        names = tuple("/".join(p) + f"#{k}" for p, k in template)
        for k, r in enumerate(kept):
            out.add(("/".join(g), k, tuple(inside[g, r].get(p, (0, None))[1] for p in template), names))
    return out


def test_mining_is_what_loops_over_trees_find(spark):
    rng = random.Random(4)
    trees = [some_tree(rng) for _ in range(150)]
    df = spark.createDataFrame([(k, markup(t)) for k, t in enumerate(trees)], "page_id long, html string").repartition(5)
    got = defaultdict(set)
    for r in R.mined_records(df).collect():
        got[r["page_id"]].add((r["group"], r["n"], tuple(r["fields"]), tuple(r["places"])))
    want = {k: plain_records(t) for k, t in enumerate(trees)}
    assert dict(got) == {k: v for k, v in want.items() if v}
    assert sum(map(len, want.values())) > 200


LISTING = """<!DOCTYPE html><html><head><title>Agenda <p> of</title><script>var x = "<li><a href='/no'>no</a>";</script></head><body>
<nav><ul><li><a href="/a">A</a><li><a href="/b">B</a><li><a href="/c">C</a></ul></nav>
<div class=grid>
 <div class=row><article><a href="/e/1"><img src=x.jpg><h3>First &amp; last</h3></a><p>12 jun<p>Hall One</article><article><a href='/e/2'><h3>Second</h3></a><p>20 nov – 3 fev<p>Hall Two</article></div>
 <div class=row><article><a href=/e/3><h3>Third</h3></a><p>MAR 2027<p>Hall One</article><article><a href="/e/1"><h3>Again</h3></a><p>13 jun<p>Hall One</article></div>
 <div class=row><article><a href="/e/5"><h3>No date</h3></a><p>soon</article><article><h3>No link</h3><p>14 jun<p>Hall</article></div>
</div><footer>2026</body>"""


def test_cards_of_a_listing_are_its_main_group(spark):
    df = spark.createDataFrame([(7, LISTING)], "page_id long, html string")
    got = R.main_groups(R.mined_records(df)).orderBy("n").collect()
    assert {r["group"] for r in got} == {"html/body/div/div/article"}
    assert got[0]["places"] == ["a/@href#1", "a/h3/#text#1", "p/#text#1", "p/#text#2"]
    assert [r["fields"] for r in got[:2]] == [["/e/1", "First & last", "12 jun", "Hall One"], ["/e/2", "Second", "20 nov – 3 fev", "Hall Two"]]
    assert got[4]["fields"] == ["/e/5", "No date", "soon", None]


@pytest.mark.parametrize("by_place", [False, True])
def test_dated_cards_keep_the_first_of_each_link(spark, by_place):
    df = spark.createDataFrame([(7, LISTING), (8, LISTING), (None, None), (9, "")], "page_id long, html string")
    places = {"title": 1, "when": 2, "venue": 3} if by_place else {}
    got = R.listed_events(R.main_groups(R.mined_records(df)), F.lit(date(2026, 6, 15)), **places)
    rows = {r["link"]: (r["page_id"], r["title"], r["venue"], r["start"], r["end"], r["month_only"]) for r in got.collect()}
    hall = lambda k: f"Hall {k}" if by_place else None
    assert rows == {
        "/e/1": (7, "First & last", hall("One"), date(2026, 6, 12), date(2026, 6, 12), False),
        "/e/2": (7, "Second", hall("Two"), date(2026, 11, 20), date(2027, 2, 3), False),
        "/e/3": (7, "Third", hall("One"), date(2027, 3, 1), date(2027, 3, 31), True),
    }


def test_fields_of_split_dates_are_read_together(spark):
    card = "<li><a href='/{0}'>T{0}</a><b>{1}</b><i>{2}</i><b>{3}</b><i>{4}</i></li>"
    html = "<ul>" + "".join(card.format(k, 3 + k, "dez", 2 + k, "jan") for k in range(4)) + "</ul>"
    got = R.listed_events(R.mined_records(spark.createDataFrame([(1, html)], "page_id long, html string")), F.lit(date(2026, 6, 15))).orderBy("link").collect()
    assert [(r["link"], r["title"], r["start"], r["end"]) for r in got] == [(f"/{k}", f"T{k}", date(2026, 12, 3 + k), date(2027, 1, 2 + k)) for k in range(4)]


@pytest.mark.parametrize(
    ("said", "start", "end", "time", "month_only"),
    [
        ("12 jun", date(2026, 6, 12), date(2026, 6, 12), None, False),
        ("3 jun", date(2027, 6, 3), date(2027, 6, 3), None, False),
        ("12 e 13 JUN 2026", date(2026, 6, 12), date(2026, 6, 13), None, False),
        ("JAN 2026 – MAR 2027", date(2026, 1, 1), date(2027, 3, 31), None, True),
        ("NOV – FEV 2027", date(2026, 11, 1), date(2027, 2, 28), None, True),
        ("12 dez – 5 jan", date(2026, 12, 12), date(2027, 1, 5), None, False),
        ("5 de maio de 2027, 9:30 pm", date(2027, 5, 5), date(2027, 5, 5), "21:30", False),
        ("12.06.2026 sex, 21h30", date(2026, 6, 12), date(2026, 6, 12), "21:30", False),
        ("June 20th, 2026", date(2026, 6, 20), date(2026, 6, 20), None, False),
        ("29 feb 2028", date(2028, 2, 29), date(2028, 2, 29), None, False),
    ],
)
def test_days_of_listings(spark, said, start, end, time, month_only):
    got = spark.range(1).select(R.listed_days(F.lit(said), F.lit(date(2026, 6, 15))).alias("x")).first()["x"]
    assert tuple(got) == (start, end, time, month_only)


@pytest.mark.parametrize("said", ["31 jun 2026", "maybe 12", "2026", "", None, "29 feb 2027", "45.45.2026", "20 mar 2026 – 1 mar 2026"])
def test_texts_without_days(spark, said):
    assert spark.range(1).select(R.listed_days(F.lit(said).cast("string"), F.lit(date(2026, 6, 15))).alias("x")).first()["x"] is None


@pytest.mark.parametrize("page", ["<div>" * 20000, "<p><b>x" * 5000, "<" * 50000, "</x>" * 20000, "<script>" * 1000, "<!--" * 20000, '<a href="' * 20000, "<li>x" * 20000, "&" * 50000, "<table>" + "<tr><td>a" * 5000])
def test_hostile_pages_take_time_in_their_length(page):
    import time

    began = time.time()
    for _ in R.page_values(page):
        pass
    assert time.time() - began < 3


def test_optional_end_tags_are_supplied():
    rows = [("/".join(p), v) for _, p, v, _ in R.page_values("<table><tr><td>a<td>b<tr><td>c<table><tr><td>d</table>e</table><dl><dt>x<dd>y<dt>z</dl><p>q<div>r</div></nothing>s")]
    assert rows == [
        ("table/tr/td/#text", "a"), ("table/tr/td/#text", "b"), ("table/tr/td/#text", "c"), ("table/tr/td/table/tr/td/#text", "d"), ("table/tr/td/#text", "e"),
        ("dl/dt/#text", "x"), ("dl/dd/#text", "y"), ("dl/dt/#text", "z"), ("p/#text", "q"), ("div/#text", "r"), ("#text", "s"),
    ]


def test_a_batch_of_pages_is_handed_on_in_lots():
    """What a worker holds doesn't grow with the pages of a batch, nor with the length of a page or the number of different paths."""
    import tracemalloc

    names = ["page_id", "page", "node", "path", "value", "up"]
    card = "<li><div><p><b>a{0}</b><i>x y</i></p><a href='/{0}'>t</a></div></li>"
    pages = ["<html><body><main><ul>" + "".join(card.format(k) for k in range(20)) + "</ul></main>"] * 1000 + ["<ul>" + card.format(1) * 20_000, "".join(f"<t{k}><u>" for k in range(60)) + "".join(f"<w{k}>x</w{k}>" for k in range(4_000)), "<p>" + "z" * 3_000_000, "", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(pages))), pa.array([9 * k for k in range(len(pages))]), pa.array(pages)], names=["page_id", "page", "html"])
    seen, sizes, peaks = 0, [], []
    want = {}
    for k in (0, 1001):
        want[k] = [(n, "/".join(p), v, [(st[d][0], st[d - 1][0], d + 1, R._hash(p[: d + 1]), R._hash(p[d + 1 :])) for d in range(max(1, len(st) - R.LEVELS), len(st))]) for n, p, v, st in R.page_values(pages[k])]
    got = {k: [] for k in want}
    tracemalloc.start()
    for lot in R.cell_batches(iter([batch]), names):
        peaks.append(tracemalloc.get_traced_memory()[1])
        sizes.append(lot.num_rows)
        seen += lot.num_rows
        ids = set(lot.column(0).to_pylist())
        if ids & set(got):
            for r in lot.to_pylist():
                if r["page_id"] in got:
                    assert r["page"] == 9 * r["page_id"]
                    got[r["page_id"]].append((r["node"], r["path"], r["value"], [tuple(u.values()) for u in r["up"]]))
        tracemalloc.reset_peak()
    tracemalloc.stop()
    assert seen == 1000 * 20 * 4 + 20_000 * 4 + 4_000 + 1
    assert got == want
    assert max(sizes) <= R.LOT
    assert max(peaks) < 60 << 20
