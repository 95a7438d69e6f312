"""Quotes with edits against a plain alignment."""

from __future__ import annotations

import random

import pytest

from tidemark.functions import quotes


def plain(quote, text):
    """(edits, start, end) by the whole table."""
    row = [(0, -j) for j in range(len(text) + 1)]
    for c in quote:
        new = [(row[0][0] + 1, row[0][1])]
        for j, x in enumerate(text, 1):
            new.append(min((row[j - 1][0] + (c != x), row[j - 1][1]), (row[j][0] + 1, row[j][1]), (new[-1][0] + 1, new[-1][1])))
        row = new
    end = min(range(len(row)), key=lambda j: (row[j][0], j))
    return row[end][0], -row[end][1], end


def edited(rng, quote, n):
    q = list(quote)
    for _ in range(n):
        k = rng.randrange(len(q) + 1)
        q[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "é"])
    return "".join(q)


@pytest.mark.parametrize("seed", range(5))
def test_alignment_is_that_of_the_whole_table(seed):
    rng = random.Random(seed)
    for _ in range(60):
        text = "".join(rng.choice("abé ") for _ in range(rng.randint(1, 80)))
        quote = edited(rng, text[rng.randrange(len(text)) :][:30] or "ab", rng.randint(0, 6)) or "a"
        want = plain(quote, text)
        assert quotes._aligned(quotes._points(quote), quotes._points(text)) == want
        got = quotes.nearest(quote, text)
        if len(quote) > quotes.MOST:
            assert (got is None) == (want[0] > quotes.MOST)
            if got:
                assert got[0] == want[0]
                assert plain(quote, text[got[1] : got[2]])[0] == got[0]


def test_quotes_with_three_edits_are_found_on_their_pages(spark):
    page = "The <b>Night of the Museums</b> opens on Saturday, 23 May, at nine o'clock; entrance is free for residents of the city."
    said = ["Night of the Museums", "opens on saturdy, 23 Mai, at nine", "entrnce is fre for resdents", "entrnce s fre fr resdents", "no such words at all here", "", None, "on"]
    df = spark.createDataFrame([(q, page) for q in said] + [("x", None)], "q string, t string")
    got = [r["x"] and (r["x"]["edits"], r["x"]["said"]) for r in df.select(quotes.found_quote("q", "t").alias("x")).collect()]
    assert got[0] == (0, "night of the museums")
    assert got[2] == (3, "entrance is free for residents")
    assert got[1] is not None and got[1][0] <= 3
    assert got[3:] == [None, None, None, None, (0, "on"), None]


def test_long_pages_are_aligned_in_bands_only(monkeypatch):
    looked = []
    monkeypatch.setattr(quotes, "_aligned", lambda q, t, f=quotes._aligned: (looked.append(len(t)), f(q, t))[1])
    text = "lorem ipsum dolor sit amet " * 40_000 + "the quick brown fox jumps over the lazy dog"
    assert quotes.nearest("the quik brwn fox jumps ovr the lazy dog", text)[0] == 3
    assert sum(looked) < 1000


def test_a_record_s_quotes_may_be_a_few_edits_off(spark):
    from datetime import date

    from tidemark.operators import listing

    page = "Fado no Rivoli, 23 November 2026, doors 21:30, Teatro Rivoli. Tickets 12 euros."
    row = {"id": 1, "name": "Fado no Rivoli", "start": date(2026, 11, 23), "time": "21:30", "venue": "Teatro Rivoli", "price_from": 12.0}
    row |= {"page_name": "Fado no Rivoli", "page_name_quote": "Fado n Rivoli", "page_day": date(2026, 11, 23), "page_day_quote": "23 Novembr 2026", "page_time": "21:30", "page_time_quote": "dors 21:30"}
    row |= {"page_venue": "Teatro Rivoli", "page_venue_quote": "Teatro Rivoly", "page_price": 12.0, "page_price_quote": "Ticket 12 euros", "page_text": page}
    df = spark.createDataFrame([row], ", ".join(f"{k} {'date' if isinstance(v, date) else 'int' if k == 'id' else 'double' if isinstance(v, float) else 'string'}" for k, v in row.items()))
    assert listing.reconcile(df).first()["status"] == "hold"
    assert listing.reconcile(df, most_edits=1).first()["status"] == "ok"
