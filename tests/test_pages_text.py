"""Page snippets, HTML edits and scan runs case by case."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions import markup, snippets
from tidemark.operators import clustering, matching, scan


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1).coalesce(1)
    return lambda c: one.select(c.alias("x")).first()["x"]


def test_titles_shrink_until_they_fit(value):
    d, none = F.lit(date(2026, 11, 28)), F.lit(None).cast("date")
    title = lambda name, venue, lang="en", today=1: value(snippets.event_title(F.lit(name), d, none, F.lit(venue), F.lit(date(2026, 11, today)), lang))
    assert title("Duo", "Club, Porto") == "Duo · Sat 28 Nov 2026, Club · Tickets & Info"
    assert title("Duo", "Club", today=29) == "Duo · Sat 28 Nov 2026, Club"
    assert title("Duo at the Club 2026", "Club") == "Duo at the Club 2026 · Sat 28 Nov · Tickets & Info"
    assert title("Duo", "Clube", "pt") == "Duo · sáb 28 nov 2026, Clube · Bilhetes e Info"
    assert title("A name of some forty letters, no fewer", "Quite a hall") == "A name of some forty letters, no fewer · Sat 28 Nov 2026"
    long = title("word " * 20, "Hall")
    assert len(long) <= 77 and long.endswith("…")


def test_summaries(value):
    d, none = F.lit(date(2026, 11, 28)), F.lit(None).cast("string")
    got = snippets.event_summary(d, none.cast("date"), F.lit("21:30"), F.lit("Club"), none, F.lit("A night — loud. Then more."), "pt")
    assert value(got) == "Sábado, 28 de novembro de 2026, às 21:30, Club. A night, loud."
    run = snippets.event_summary(d, F.lit(date(2026, 12, 2)), F.lit("21:30"), F.lit("Club"), F.lit("Free"), none)
    assert value(run) == "28 November – 2 December 2026 at Club. Free."


def test_venues_without_events_to_come_tell_their_last(spark):
    rows = [("A", "Old", date(2026, 1, 1), None), ("A", "Older", date(2025, 1, 1), None), ("B", "Open", date(2026, 5, 1), date(2026, 6, 9)), ("B", "Next", date(2026, 6, 3), None)]
    events = spark.createDataFrame(rows, "venue string, name string, start date, end date")
    got = {r["venue"]: r for r in snippets.venue_summaries(events, F.lit(date(2026, 6, 1))).collect()}
    assert got["A"]["upcoming"] == 0
    assert got["A"]["summary"] == "Events at A, Porto. Most recent: Old (1 Jan 2026). Nothing listed right now. See what's on in Porto this week."
    assert got["B"]["summary"] == "B, Porto: next up Next (3 Jun) and Open (until 9 Jun). 2 upcoming events with dates, prices and tickets."


def test_html_edits(value):
    lit = F.lit
    assert value(markup.humanize_html(lit("<p>a — <b>b</b></p><style>x — y</style><p>c &mdash;</p>"))) == "<p>a, <b>b</b></p><style>x — y</style><p>c</p>"
    assert value(markup.split_before_second(lit("<h2>a</h2>"))) is None
    linked = markup.link_titles(lit('<h4>Tito Paris</h4><h4>Tito Paris and Friends</h4><p style="font-family:Georgia">Tito Paris</p><p>Tito Paris</p>'), F.create_map(lit("tito paris"), lit("t")), "https://x.pt")
    a = '<a href="https://x.pt/event/t" style="color:inherit;text-decoration:none;">Tito Paris</a>'
    assert value(linked) == f'<h4>{a}</h4><h4>Tito Paris and Friends</h4><p style="font-family:Georgia">{a}</p><p>Tito Paris</p>'
    page = '<a href="https://g.com">MORE INFO</a><a href="https://x.pt/event/s">S</a><a href="https://g.com" rel="noopener" class="k">MORE INFO</a>.'
    assert value(markup.more_info_links(lit(page), "https://x.pt")) == '<a href="https://g.com">MORE INFO</a><a href="https://x.pt/event/s">S</a><a href="https://x.pt/event/s" class="k">MORE INFO</a>.'
    foot = lambda h: value(markup.with_footer_line(lit(h), "<p>new</p>", "line.example", "api/out"))
    assert foot("<p>a</p>") == "<p>a</p>"
    assert foot("<p>a</p><p>api/out</p><p>old line.example</p>z") == "<p>a</p><p>api/out</p><p>new</p>z"
    assert foot("<p>api/out line.example</p>") == "<p>api/out line.example</p>"
    assert foot("<p>API/out</p>z") == "<p>API/out</p>\n<p>new</p>z"
    assert value(markup.humanize_html(lit(None).cast("string"))) is None


def test_only_accepted_rows_turn_others_down(spark):
    rows = spark.createDataFrame([(k, k) for k in range(1, 4)], "id long, n int")
    chain = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    heads = lambda members: sorted(r["id"] for r in clustering.first_fit(rows, chain, "id", ["n"], members).filter("id = cluster").collect())
    assert heads(False) == [1, 3] and heads(True) == [1]


def test_accept_new(spark):
    rule = [matching.Rule("k", ("k",))]
    corpus = spark.createDataFrame([(1, "a")], "id long, k string")
    batch = spark.createDataFrame([(7, "a"), (8, "b"), (9, "b"), (10, "c"), (11, None)], "id long, k string")
    assert sorted(r["id"] for r in scan.accept_new(batch, corpus, rule, ["id"]).collect()) == [8, 10, 11]
    assert scan.accept_new(batch.limit(0), corpus, rule, ["id"]).count() == 0


def test_glosses_that_say_nothing_new_go(spark):
    events = spark.createDataFrame([(1, "Noite", "s1", None), (2, "Night", "s2", "night"), (3, "Dia", None, None)], "id long, name string, slug string, name_en string")
    corpus = spark.createDataFrame([("s1", "x", "Night"), (None, "DIA", "Day")], "slug string, name string, name_en string")
    assert {(r["id"], r["gloss"]) for r in scan.glosses(events, corpus).collect()} == {(1, "Night"), (3, "Day")}


def test_events_of_one_start_and_name_go_by_ties(spark):
    rows = [(k, "A", "Same", date(2026, 6, 3), date(2026, 6, 3 + (k * 7) % 20), "Free") for k in range(20)]
    events = spark.createDataFrame(rows, "k int, venue string, name string, start date, end date, price string").repartition(7, "end")
    for k, ties in ((0, ("k",)), (0, ("end",))):
        first = rows[k][4]
        got = snippets.venue_answers(events, F.lit(date(2026, 6, 1)), ties=ties).first()
        assert got["next_dates"] == f"{first.day} June 2026"
    second = rows[1][4]
    got = snippets.venue_summaries(events, F.lit(date(2026, 6, 1)), ties=("k",)).first()["summary"]
    assert f"Same (3 Jun) and Same (3–{second.day} Jun)" in got
