"""Small predicates case by case."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tidemark.operators import matching, predicates


def test_predicates(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    lit = F.lit
    assert value(predicates.is_meta_copy(lit("The page lists no times"))) and not value(predicates.is_meta_copy(lit("A pageant")))
    like = lambda n, k=3: value(predicates.is_event_like(lit(n), lit("v"), lit("concerts"), lit(k), lit(True)))
    assert like("Candlelight") and not like("Gift card") and not like("River cruise") and not like("Candlelight", 9)
    assert value(predicates.is_home_match(lit("FC Porto vs. Rivals"), lit("g"), "porto", "g")) and not value(predicates.is_home_match(lit("Porto vs TBD"), lit("g"), "porto", "g"))
    assert value(predicates.needs_update(lit("https://x.pt"), lit(" "), lit("a"))) and not value(predicates.needs_update(lit("https://x.pt"), lit("b"), lit("a")))
    assert value(predicates.needs_translation(lit("a"), lit("b"), lit(""))) and not value(predicates.needs_translation(lit("a"), lit(None).cast("string"), lit(None).cast("string")))
    d = lambda n: lit(date(2026, 11, n))
    offer = lambda link, venue="v": value(predicates.organizer_offer(lit("music"), d(5), lit(None).cast("date"), lit(venue), lit(link), lit(False), lit(False), d(1)))
    assert offer("https://band.pt/x") and not offer("https://www.bol.pt/x") and not offer("https://band.pt/x", "various-places")
    assert value(predicates.toggled(F.array(lit("a")), lit("b"))) == ["a", "b"] and value(predicates.toggled(F.array(lit("a"), lit("b")), lit("a"))) == ["b"]
    assert value(predicates.first_match(lit("TMP -  Rivoli"), [("rivoli", "Rivoli Theatre")])) == "Rivoli Theatre" and value(predicates.first_match(lit(" A  b "), [("x", "y")])) == "A b"
    assert value(predicates.photo_credit(lit("https://www.agora.pt/i.jpg"), {"bol.pt": "BOL"})) == "Photo: Agora"
    rows = spark.createDataFrame([(1, date(2026, 11, 1), date(2026, 12, 1)), (2, date(2026, 11, 9), None), (3, date(2026, 11, 5), None), (4, date(2026, 11, 1), date(2026, 11, 6))], "k int, s date, e date")
    assert [r["k"] for r in predicates.still_on(rows, "s", "e", d(4), 2, 3).collect()] == [2, 4, 1]
    assert predicates.known(rows.select("k"), rows.select("k")).count() == 4


def test_same_listing(spark):
    rows = [(1, "Blue Moon Band", "Hard Club", "2026-11-05T21:00", None, "https://a.pt/x"), (2, "Blue Moon Band", "Various places", "2026-11-05", None, None), (3, "Blue Moon Band", "Hard Club", "2026-11-06", None, None), (4, "Else", "Else", "2026-01-01", None, "https://www.a.pt/x/")]
    df = matching.prepared(spark.createDataFrame(rows, "id long, name string, venue string, start string, end string, link string"))
    met = df.alias("a").join(df.alias("b"), F.col("a.id") < F.col("b.id")).filter(predicates.same_listing("a", "b"))
    assert {(r[0], r[1]) for r in met.select("a.id", "b.id").collect()} == {(1, 2), (1, 4)}
