"""Matching, clustering, merging, facets, sources, sinks and streams on small tables."""

from __future__ import annotations

import hashlib
import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.operators import classify, clustering, facets, intervals, matching, merging, sequences
from tidemark.sources import files, pages, sinks
from tidemark.streaming import state

EVENTS = "id long, name string, venue string, start string, end string, link string, age string"


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        (1, "Jenny Holzer: Wrong Answers", "Serralves", "2026-07-09", "2026-11-01", None, "a"),
        (2, '"Wrong Answers" Exhibition', "Serralves", "2026-08-27", "2026-11-01", None, "b"),
        (3, "Porto Contemporary Art", "Various Galleries", "2026-09-01", None, None, "c"),
        (4, "Porto Contemporary Art", "City Centre", "2026-09-01", None, None, "d"),
        (5, "Moonspell", "Hard Club", "2026-10-01T21:00", None, "https://www.hardclub.pt/e/moonspell", "e"),
        (6, "Noite de metal", "Hard Club", "2026-10-01T21:30", None, "https://hardclub.pt/e/moonspell/?utm_a=1", "f"),
        (7, "Irmãos Jussen", "Casa da Música", "2026-11-05T21:00", None, "https://casadamusica.com/event/irmaos", "g"),
        (8, "Jussen Brothers", "Casa da Música", "2026-11-05T21:00", None, "https://casadamusica.com/en/event/brothers", "h"),
        (9, "Porto/Post/Doc 2026 - Cochena", "Batalha", "2026-11-25T16:30", None, None, "i"),
        (10, "Cochena, de Diogo Allen", "Batalha", "2026-11-20", "2026-11-25", None, "j"),
        (11, "AFRO SALOYA", "Rivoli", "2026-11-06T19:30", None, None, "k"),
        (12, "Isabel Zuaa apresenta SALOYA", "Rivoli", "2026-11-06T19:30", None, None, "l"),
        (13, "Accordia", "Livraria de Serralves", "2026-11-08T18:00", None, "https://agenda-porto.pt/evento/x", "m"),
        (14, "Concerto Accordia em Serralves", "Serralves", "2026-11-08T18:00", None, "https://serralves.pt/evento/y", "n"),
        (15, "Quiz night", "Ferro Bar", "2026-11-01", None, None, "o"),
        (16, "Quiz night", "Ferro Bar", "2026-12-01", None, None, "p"),
    ]
    return spark.createDataFrame(rows, EVENTS)


def test_reasons(events):
    ready = matching.prepared(events)
    ready = matching.with_rare_words(ready, ready)
    rules = [f() for f in matching.STANDARD]
    got = {(r["a"], r["b"]): r["rule"] for r in matching.pairs(ready, ready, rules).collect()}
    assert got == {(1, 2): "same venue", (3, 4): "vague venue", (5, 6): "same page", (7, 8): "other language", (9, 10): "festival title", (11, 12): "rare word", (13, 14): "aggregator copy", (15, 16): "exact"}
    back = matching.pairs(ready, ready, rules, ordered=False).filter("a <> b")
    assert {(r["b"], r["a"]) for r in back.filter("a > b").collect()} == set(got)
    first = matching.first_tier(back, ready, rules, "age")
    assert {r["a"]: r["b"] for r in first.collect()}[6] == 5


def test_rescheduled(spark):
    rows = [(1, "Adiel - Switch", "Switch", "2026-11-07T23:00", None, "https://shotgun.live/events/adiel", "a"), (2, "Nova Data - Adiel", "Switch", "2027-01-22T23:00", None, "https://shotgun.live/events/adiel", "b")]
    ready = matching.prepared(spark.createDataFrame(rows, EVENTS))
    assert [r["rule"] for r in matching.pairs(ready, ready, [matching.rescheduled()]).collect()] == ["rescheduled"]


def test_first_fit_depends_on_order_inside_components(spark):
    rows = spark.createDataFrame([(k, k) for k in range(1, 8)], "id long, n int")
    edges = spark.createDataFrame([(1, 3), (2, 3), (5, 6), (6, 7)], "a long, b long")
    got = {r["id"]: r["cluster"] for r in clustering.first_fit(rows, edges, "id", ["n"]).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 5, 7: 5}
    got = {r["id"]: r["cluster"] for r in clustering.first_fit(rows, edges.limit(0), "id", ["n"]).collect()}
    assert got == {k: k for k in range(1, 8)}


def test_overlap_join_is_a_nested_loop_with_buckets(spark):
    rows = [(k, k % 3, date.fromordinal(738000 + 7 * k % 97), date.fromordinal(738000 + 7 * k % 97 + k % 40)) for k in range(60)]
    df = spark.createDataFrame(rows, "id int, g int, s date, e date")
    for slack in (0, 3):
        got = {(r["a_id"], r["b_id"]) for r in intervals.overlap_join(df, df, ["g"], "s", "e", slack, bucket_days=5).collect()}
        assert got == {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[2].toordinal() <= b[3].toordinal() + slack and b[2].toordinal() <= a[3].toordinal() + slack}
        assert intervals.overlap_join(df, df, ["g"], "s", "e", slack, bucket_days=5).count() == len(got)


def test_outcomes_and_members(spark):
    leads = spark.createDataFrame([(1, "pending", 0), (2, "pending", 2), (3, "pending", None), (4, "done", 1), (5, "pending", 0)], "k int, status string, attempts int")
    out = spark.createDataFrame([(1, "failed", "x"), (2, "failed", "x"), (3, "dropped", "x"), (5, "done", "x")], "k int, kind string, reason string")
    got = {r["k"]: (r["status"], r["attempts"]) for r in merging.apply_outcomes(leads, out, "k").collect()}
    assert got == {1: ("pending", 1), 2: ("rejected", 3), 4: ("done", 1), 5: ("done", 0)}
    m = spark.createDataFrame([("A@x", True), ("b@x", False)], "email string, unsubscribed boolean")
    j = spark.createDataFrame([("a@X",), ("c@x",)], "email string").withColumn("unsubscribed", F.lit(False))
    after = merging.subscribe(m, j, F.lower("email"))
    assert {(r["email"], r["unsubscribed"]) for r in after.collect()} == {("A@x", False), ("b@x", False), ("c@x", False)}
    assert {r["email"] for r in merging.unsubscribe(after, j.limit(1), F.lower("email")).filter("unsubscribed").collect()} == {"A@x"}
    both = files.members(m, j, address=F.lower("email"))
    assert sorted(r["email"] for r in both.collect()) == ["a@X", "b@x", "c@x"]


def test_fills_and_renewals(spark):
    old = spark.createDataFrame([(1, None, "p"), (2, "x", None)], "k int, a string, b string")
    new = spark.createDataFrame([(1, "n", "q"), (2, "m", None)], "k int, a string, b string")
    assert {tuple(r) for r in merging.fill_gaps(old, new, ["k"], ["a", "b"]).collect()} == {(1, "n", "p"), (2, "x", None)}
    assert {tuple(r) for r in merging.renew(old, new.filter("k = 1"), ["k"], ["b"]).collect()} == {(1, None, "q"), (2, "x", None)}


def test_streaks_have_a_day_of_grace(spark):
    days = spark.createDataFrame([(1, date(2026, 11, d)) for d in (1, 2, 5, 6, 7)], "u int, d date")
    for today, want in ((7, 3), (8, 3), (9, 0)):
        assert sequences.streak_stats(days, ["u"], "d", F.lit(date(2026, 11, today))).first()["current"] == want
    state = spark.range(1).select(sequences.game_state(F.array(F.lit("a"), F.lit("b")), F.lit("b")).alias("s")).first()["s"]
    assert (state["status"], state["misses"], state["solved_at"]) == ("won", 1, 2)


def test_filters_round_trip(spark):
    q = "?q=fado+ribeira&when=weekend&price=free&kids=1&cat=fado&area=ribeira"
    assert facets.Filters.parse(q).query() == q
    assert facets.Filters.parse("?price=x&when=later&cat=A&free=1") == facets.Filters(price="free")
    rows = [("concerts", "music", date(2026, 11, 7), date(2026, 11, 7), "musica ao vivo"), ("art", "art", date(2026, 11, 1), date(2026, 11, 30), "musica")]
    df = spark.createDataFrame(rows, "sub string, parent string, start date, end date, search string").withColumns({"area": F.lit("x"), "band": F.lit("free"), "kids": F.lit(False)})
    today = F.lit(date(2026, 11, 7))
    count = lambda f: df.filter(facets.Filters.parse(f).predicate(today)).count()
    assert [count(f) for f in ("", "?cat=music", "?q=Música", "?q=vivo musica", "?when=weekend", "?kids=1")] == [2, 1, 2, 1, 2, 0]


def test_kinds_areas_and_routes(spark):
    rows = [("Talk with the conductor", "", "", "music", "talks-workshops"), ("Há Fado no Mercado", "", "", "music", "fado"), ("Christmas market with DJs", "", "", "nightlife", "markets"), ("Porto Marathon", "", "", "sports", "outdoor-sport"), ("Candlelight: Queen hits", "", "", "music", "concerts"), ("Requiem de Mozart", "", "", "music", "classical"), ("Quarta", "techno night", "", "nightlife", "dj-club"), ("Banda", "", "Hot Five Jazz", "music", "jazz"), ("x", "", "", "weird", "other"), ("Corrida", "", "", "music", "concerts")]
    df = spark.createDataFrame(rows, "n string, d string, v string, c string, want string")
    got = df.select("n", "want", classify.subcategory(F.col("n"), F.col("d"), F.col("v"), F.col("c")).alias("got")).collect()
    assert [(r["n"], r["got"]) for r in got] == [(r["n"], r["want"]) for r in got]
    for venue, area in {"Casa da Música, Boavista": "boavista", "Vários & more": None, "Cais de Gaia": "gaia", "X": None}.items():
        assert df.limit(1).select(classify.area_of(F.lit(venue)).alias("a")).first()["a"] == area
    for code, inside in {"4000-102": True, "4580-670": False, "4480-001": False, "": None}.items():
        assert df.limit(1).select(classify.postal_in_area(F.lit(code)).alias("a")).first()["a"] == inside


def test_record_files(spark, tmp_path):
    (tmp_path / "r").mkdir()
    for k in range(3):
        (tmp_path / "r" / f"{k}.json").write_text(json.dumps({"slug": f"s{k}", "name": "x", "date": "2026-01-01", "image": {"url": "u"}}, indent=1))
    df = files.records(spark, str(tmp_path / "r"))
    assert sorted(r["slug"] for r in df.collect()) == ["s0", "s1", "s2"] and df.first()["nameEn"] is None
    (tmp_path / "w.json").write_text(json.dumps({"items": [{"id": "1", "sessions": ["a"]}, {"id": "2"}]}))
    assert files.wrapped(spark, str(tmp_path / "w.json"), "items", files.CATALOG).count() == 2
    ids = files.file_ids(spark, str(tmp_path / "r"))
    body = (tmp_path / "r" / "1.json").read_bytes()
    want = hashlib.sha1(b"blob %d\0" % len(body) + body).hexdigest()
    assert want in {r["id"] for r in ids.collect()}
    assert files.changed_files(ids, ids.filter(F.col("id") != want)).count() == 1
    led = files.ledger(spark.createDataFrame([('{"w1": {"research": "t1", "send": "t2"}}',)], "t string"), "t")
    wanted = spark.createDataFrame([("w1", "send"), ("w1", "post")], "week string, step string")
    assert [tuple(r) for r in merging.claim(led, wanted).collect()] == [("w1", "post")]
    bad = spark.createDataFrame([("{",), ('{"leads": []}',), ("[]",)], "t string")
    assert bad.filter(files.parsed_or_null(F.col("t"), f"leads array<struct<{files.LEAD}>>", "leads").isNotNull()).count() == 1


PAGE = """<html><head><title>A &amp; B</title><meta property="og:image" content="https://x.pt/i.jpg"><style>p{}</style>
<script type="application/ld+json">{"@graph": [{"@type": "MusicEvent", "name": "N", "startDate": "2026-01-02", "location": {"name": "V", "address": {"addressLocality": "Porto"}}, "offers": [{"price": 5}]}, {"@type": "Place"}]}</script>
</head><body><p>Hello&nbsp;<b>world</b></p><!-- FOOTER -->unsubscribe<!-- END FOOTER --><div class="card"><h3>One</h3><i>10</i></div><div class="card"><h3>Two</h3><i>20</i></div></body></html>"""


def test_pages(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "<script type='application/ld+json'>{bad</script>"), (3, None)], "k int, html string")
    got = pages.linked_events(df, "k", "html").collect()
    assert [(r["name"], r["start"], r["venue"], r["city"], r["price"]) for r in got] == [("N", "2026-01-02", "V", "Porto", "5")]
    r = df.select(pages.title_of(F.col("html")).alias("t"), pages.best_image(F.col("html")).alias("i"), pages.page_text(pages.strip_footer(F.col("html"))).alias("x")).first()
    assert (r["t"], r["i"], r["x"]) == ("A & B", "https://x.pt/i.jpg", "A & B Hello world One 10 Two 20")
    cards = pages.cards(df, "k", "html", r"<h3>(.*?)</h3><i>(\d+)</i>", ["name", "price"]).collect()
    assert [(c["n"], c["name"], c["price"]) for c in cards] == [(0, "One", "10"), (1, "Two", "20")]


def test_calendar_documents(spark):
    df = spark.createDataFrame([("s", "Árvore; a, b " + "ç" * 80, "d\nline", "V", "https://x.pt", "2026-07-01T21:00", None)], "slug string, title string, about string, place string, url string, start string, end string")
    c = F.col
    text = df.select(sinks.ics(c("slug"), c("title"), c("about"), c("place"), c("url"), c("start"), c("end"), F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"), "x.pt", "-//T//EN").alias("x")).first()["x"]
    lines = text.split("\r\n")
    assert all(len(x.encode()) <= 75 for x in lines) and lines[-1] == "" and "DTSTART:20260701T200000Z" in lines and "DTEND:20260701T220000Z" in lines
    assert "SUMMARY:Árvore\\; a\\, b " + "ç" * 80 in text.replace("\r\n ", "")
    got = df.select(sinks.split_messages(F.array(*(F.lit(x * 4) for x in "abcd")), 9).alias("m")).first()["m"]
    assert got == ["aaaa\nbbbb", "cccc\ndddd"]
    doc = json.loads(df.select(sinks.event_document(c("title"), c("start"), c("end"), c("place"), c("about"), F.lit(5.0), F.lit(None).cast("string"), c("url")).alias("d")).first()["d"])
    assert doc["@type"] == "Event" and doc["offers"]["priceCurrency"] == "EUR"


def test_digest(spark):
    pub = spark.createDataFrame([("bol",), ("bol",), ("dice",)], "source string")
    rev = spark.createDataFrame([("b", date(2026, 1, 2), "v", "u"), ("a", date(2026, 1, 1), "v", "u")], "name string, date date, venue string, url string")
    m = sinks.digest(pub, rev, "source").first()["messages"]
    assert m == ["3 new (bol 2, dice 1), 2 for review\n1. a | 2026-01-01 | v | u\n2. b | 2026-01-02 | v | u"]


def test_streams(spark, tmp_path):
    schema = "k string, ok boolean, at timestamp"
    src = tmp_path / "in"
    put = lambda n, rows: spark.createDataFrame(rows, "k string, ok boolean, at string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(src))
    put(0, [("a", False, "2026-01-01 10:00:00"), ("a", False, "2026-01-01 10:01:00"), ("b", True, "2026-01-01 10:00:00")])
    stream = lambda: spark.readStream.schema(schema).parquet(str(src))
    run = lambda df, name, mode: df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination(120)
    run(state.first_seen(stream(), ["k"], "at", "1 hour").select("k"), "seen", "append")
    assert sorted(r["k"] for r in spark.table("seen").collect()) == ["a", "b"]
    check = str(tmp_path / "c")
    go = lambda: state.retries(stream(), "k", "ok", "at").writeStream.outputMode("update").option("checkpointLocation", check).foreachBatch(lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out"))).trigger(availableNow=True).start().awaitTermination(120)
    assert go()
    put(1, [("a", False, "2026-01-01 11:00:00")])
    assert go()
    assert {(r["k"], r["attempts"], r["status"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", 2, "pending"), ("b", 0, "done"), ("a", 3, "rejected")}
    state.upsert_each_batch(stream(), str(tmp_path / "t"), ["k"], "at", str(tmp_path / "c2")).awaitTermination(120)
    last = spark.read.parquet(str(tmp_path / "t" / "version=0"))
    assert {(r["k"], r["at"].minute) for r in last.collect()} == {("a", 0), ("b", 0)}
