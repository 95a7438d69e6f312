"""Listings, catalogs, selections and reconciliation on small tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tidemark.functions import games
from tidemark.operators import listing


def test_canonical_venues(spark):
    known = ["casa-da-musica", "serralves", "teatro-rivoli"]
    aliases = spark.createDataFrame([(k, k) for k in known] + [("museu-de-serralves", "serralves"), ("rivoli", "teatro-rivoli")], "alias string, canonical string")
    cases = {
        "Casa da Música (Sala Suggia)": "casa-da-musica", "Sala 2, Casa da Música": "casa-da-musica", "Museu de Serralves": "serralves", "Rivoli Palco do Grande Auditório": "teatro-rivoli",
        "Rivoli Grande Auditório": "teatro-rivoli", "Sala Estúdio IG, Gaia": "sala-estudio-ig", "Hard Club": "hard-club",
    }
    df = spark.createDataFrame([(v,) for v in cases], "venue string")
    assert {r["venue"]: r["venue_slug"] for r in listing.canonical_venues(df, "venue", aliases).collect()} == cases


def test_listing_rows(spark):
    df = spark.createDataFrame([("s", "Fado", None, "Boavista", "2026-11-03T21:00", None, "Free", None, "x", "music")], "slug string, name string, name_pt string, venue string, start string, end string, price string, price_from double, description string, category string")
    r = listing.listing_rows(df).first()
    assert (r["meta"], r["sub"], r["parent"], r["area"], r["band"], r["kids"], r["start"], r["end"]) == ("3 Nov · Boavista · Free", "fado", "music", "boavista", "free", False, date(2026, 11, 3), date(2026, 11, 3))


def test_catalog_match_prefers_the_id(spark):
    d = date(2026, 10, 31)
    events = spark.createDataFrame([(1, "Candle Night", "v", d, "b"), (2, "Candle Night", "v", d, None), (3, "Other", "v", d, None)], "id int, name string, venue_slug string, day date, known string")
    catalog = spark.createDataFrame([("a", "Candle night", "v", [d]), ("b", "Else", "w", [d])], "item string, name string, venue_slug string, sessions array<date>")
    assert {tuple(r) for r in listing.catalog_match(events, catalog, F.col("known")).collect()} == {(1, "b"), (2, "a")}


def test_selection_keeps_quota_and_skips_recent_picks(spark):
    d = lambda n: date(2026, 11, n)
    rows = [("a", "A", d(2), None, True, "https://x.pt/a", "i", None), ("b", "B", d(3), None, False, None, None, None), ("c", "C", d(1), d(20), False, None, None, None), *((f"f{k}", f"F{k}", d(2 + k), None, False, None, None, "fever") for k in range(4)), ("z", "Z", d(25), None, True, None, None, None)]
    ev = spark.createDataFrame(rows, "slug string, name string, start date, end date, pick boolean, link string, image string, provider string")
    recent = spark.createDataFrame([("b!",)], "name string")
    got = {r["slug"]: (r["part"], r["place"]) for r in listing.select_edition(ev, F.lit(d(1)), F.lit(d(8)), recent, F.col("provider")).collect()}
    assert got == {"a": ("short", 1), "b": ("short", None), "c": ("long", None), "f0": ("short", 2), "f1": ("short", 3)}


def test_suggestions(spark):
    df = spark.createDataFrame([("Ribeira", ["Ribeira"]), ("Cais da Ribeira", ["Cais da Ribeira", "Pier"]), ("Foz", ["Foz"])], "name string, names array<string>")
    assert [r["name"] for r in listing.suggest(df, "RIB", F.col("names"), "name").collect()] == ["Ribeira", "Cais da Ribeira"]
    assert listing.suggest(df, "xyz", F.col("names"), "name").count() == 0


def test_link_scores_and_guides(spark):
    df = spark.createDataFrame([(1, "Jazz Festival", "https://a.pt/x", ["https://b.pt/jazz", "https://a.pt/jazz-festival", "https://c.pt/none"])], "id int, name string, url string, sources array<string>")
    assert [tuple(r) for r in listing.score_links(df).orderBy(F.desc("score")).collect()] == [(1, "https://a.pt/jazz-festival", 12), (1, "https://b.pt/jazz", 1)]
    topics = spark.createDataFrame([(1, ["jazz", "food", "none"])], "id int, topics array<string>")
    posts = spark.createDataFrame([("old", "jazz", "2026-01"), ("new", "jazz", "2026-02"), ("eat", "food", "2026-01")], "post string, topic string, published string")
    assert {tuple(r) for r in listing.guides_for(topics, posts, 3).collect()} == {(1, "new", 1), (1, "eat", 2)}


def test_reconciliation(spark):
    page = "Concerto: Ana Moura. Sex 13 de novembro, 21h30. Coliseu Porto. Bilhetes 15 €"
    base = dict(name="Ana Moura", start=date(2026, 11, 13), time="21:30", venue="Coliseu Porto", price_from=15.0, page_name="Ana Moura", page_name_quote="Ana Moura", page_day=date(2026, 11, 13), page_day_quote="13 de novembro", page_time="21:30", page_time_quote="21h30", page_venue="Coliseu", page_venue_quote="Coliseu Porto", page_price=15.0, page_price_quote="15 €", page_text=page)
    rows = [dict(base, id=1), dict(base, id=2, time="20:00"), dict(base, id=3, page_day=date(2026, 11, 14), page_day_quote="14 de novembro"), dict(base, id=4, page_venue="Hard Club"), dict(base, id=5, page_price_quote="99 €")]
    got = {r["id"]: r for r in listing.reconcile(spark.createDataFrame(rows)).collect()}
    assert [got[k]["status"] for k in range(1, 6)] == ["ok", "corrected", "hold", "hold", "corrected"]
    assert got[2]["corrections"] == ["time 20:00 to 21:30"] and got[5]["new_price"] is None


def test_drawn_choices(spark):
    ids = [f"p{k}" for k in range(9)]
    draw = games.generator(1)
    assert [round(draw(), 6) for _ in range(2)] == [0.627074, 0.002736]
    got = spark.range(1, 4).select(games.choices_for(F.col("id"), ids).alias("c")).collect()
    for n, r in enumerate(got, 1):
        assert r["c"] == games.choices(n, ids) and len(set(r["c"])) == 4 and f"p{n - 1}" in r["c"]


def test_catalog_match_compares_sets_of_words_once(spark):
    """As many names as there are, each in many copies: only different sets of words meet."""
    d, names = date(2026, 10, 31), ["Candle Night", "Night Candle", "Candle Night Queen Songs", "Organ Hour", "Organ", "2026"]
    events = spark.range(3000).select("id", F.element_at(F.array(*map(F.lit, names)), (F.col("id") % 6 + 1).cast("int")).alias("name"), F.lit("v").alias("venue_slug"), F.lit(d).alias("day"), F.when(F.col("id") == 4, 7).alias("known"))
    catalog = spark.range(3000).filter("id >= 6").select(F.col("id").alias("item"), F.element_at(F.array(*map(F.lit, names)), (F.col("id") % 6 + 1).cast("int")).alias("name"), F.lit("v").alias("venue_slug"), F.array(F.lit(d)).alias("sessions"))
    got = {r["id"]: r["item"] for r in listing.catalog_match(events, catalog, F.col("known")).collect()}
    first = {0: 6, 1: 6, 2: 6, 3: 9, 4: 10}  # contained names meet too; no words, no match
    assert got == {k: 7 if k == 4 else first[k % 6] for k in range(3000) if k % 6 < 5}
    plan = listing.catalog_match(events, catalog, F.col("known"))._jdf.queryExecution().optimizedPlan().toString()
    assert "item_name" not in plan
