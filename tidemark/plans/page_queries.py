"""Page texts, predicates and scans on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import markup, snippets
from ..operators import matching, predicates, scan
from ..sources import pages
from .queries import day, lit_day, query
from .storage import table


def _runs(spark, d):
    """Parts as events: half of them runs of some days."""
    p = table(spark, d, "part")
    start = F.date_add(lit_day("1998-06-01"), (F.col("p_partkey") % 40).cast("int"))
    end = F.when(F.col("p_size") > 25, F.date_add(start, F.col("p_size") % 9))
    return p.select("p_partkey", F.col("p_brand").alias("venue"), F.col("p_name").alias("name"), start.alias("start"), end.alias("end"), F.when(F.col("p_size") % 4 == 0, "Free").otherwise(F.concat(F.col("p_size").cast("string"), F.lit("€"))).alias("price"))


RUNS = """runs AS (SELECT p_partkey, p_brand AS venue, p_name AS name, DATE '1998-06-01' + (p_partkey % 40)::INT AS "start",
  CASE WHEN p_size > 25 THEN DATE '1998-06-01' + (p_partkey % 40)::INT + (p_size % 9)::INT END AS "end",
  CASE WHEN p_size % 4 = 0 THEN 'Free' ELSE p_size || '€' END AS price FROM part)"""


def _short(a: str, b: str, year: bool) -> str:
    y = lambda x: f" || ' ' || year({x})" if year else ""
    return f"""CASE WHEN {a} = {b} THEN strftime({a}, '%-d %b'){y(a)} WHEN month({a}) = month({b}) THEN day({a}) || '–' || strftime({b}, '%-d %b'){y(b)}
  ELSE strftime({a}, '%-d %b') || ' – ' || strftime({b}, '%-d %b'){y(b)} END"""


def _long(a: str, b: str) -> str:
    return f"""CASE WHEN {a} = {b} THEN strftime({a}, '%-d %B %Y') WHEN month({a}) = month({b}) THEN day({a}) || '–' || strftime({b}, '%-d %B %Y')
  ELSE strftime({a}, '%-d %B') || ' – ' || strftime({b}, '%-d %B %Y') END"""


@query(f"""WITH {RUNS}, x AS (SELECT *, coalesce("end", "start") AS last FROM runs),
parts AS (SELECT *, CASE WHEN "start" = last THEN strftime("start", '%a ') ELSE '' END AS wd, {_short('"start"', "last", True)} AS dates, last >= DATE '1998-06-15' AS ahead FROM x),
tries AS (SELECT *, [CASE WHEN ahead THEN name || ' · ' || wd || dates || ', ' || venue || ' · Tickets & Info' END, CASE WHEN ahead THEN name || ' · ' || dates || ', ' || venue || ' · Tickets & Info' END,
  name || ' · ' || wd || dates || ', ' || venue, name || ' · ' || dates || ', ' || venue, CASE WHEN ahead THEN name || ' · ' || wd || dates || ' · Tickets & Info' END] AS t FROM parts)
SELECT p_partkey, list_filter(t, lambda s: length(s) <= 62)[1] AS title,
  CASE WHEN wd <> '' THEN strftime("start", '%A ') ELSE '' END || {_long('"start"', "last")} || CASE WHEN wd <> '' THEN ', 21:30,' ELSE '' END || ' at ' || venue || '. ' || CASE WHEN price = 'Free' THEN 'Free.' ELSE 'Tickets €' || rtrim(price, '€') || '.' END || ' First one.' AS summary FROM tries""")
def event_snippets(spark, d):
    r = _runs(spark, d)
    title = snippets.event_title("name", "start", "end", "venue", lit_day())
    summary = snippets.event_summary("start", "end", F.lit("21:30"), "venue", "price", F.lit("First one. Second one."))
    return r.select("p_partkey", title.alias("title"), summary.alias("summary"))


@query("""SELECT o_custkey, 'What''s on in Porto, 1–7 June: ' || array_to_string(list('order ' || o_orderkey ORDER BY o_totalprice DESC, o_orderkey)[1:3], ', ')
  || ' and more. Concerts, exhibitions, markets and festivals picked by Tidemark.' AS summary FROM orders GROUP BY 1""")
def edition_snippets(spark, d):
    """Customers as weeks, their dearest orders as picks."""
    first = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")  # Spark cuts each task's rows to three a customer before the shuffle
    o = table(spark, d, "orders").withColumn("rank", F.row_number().over(first)).filter("rank <= 3")
    o = o.groupBy("o_custkey").agg(F.collect_list(F.struct("rank", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"))).alias("picks"))
    return o.select("o_custkey", snippets.edition_summary(F.lit("1–7 June"), "picks", "Tidemark").alias("summary"))


@query(f"""WITH {RUNS}, x AS (SELECT *, coalesce("end", "start") >= DATE '1998-06-15' AS ahead, "start" < DATE '1998-06-15' AS open FROM runs),
items AS (SELECT *, name || ' (' || CASE WHEN open AND "end" IS NOT NULL THEN 'until ' || strftime("end", '%-d %b') ELSE {_short('"start"', 'coalesce("end", "start")', False)} END || ')' AS item FROM x WHERE ahead),
l AS (SELECT venue, count(*) AS upcoming, list(item ORDER BY open, "start", name) AS l FROM items GROUP BY 1)
SELECT venue, upcoming, venue || ': What''s On & Upcoming Events in Porto' AS title,
  venue || ', Porto: next up ' || CASE WHEN upcoming > 1 AND length(l[1] || ' and ' || l[2]) <= 95 THEN l[1] || ' and ' || l[2] ELSE l[1] END || '. ' ||
  CASE WHEN upcoming = 1 THEN 'Date, price and tickets.' ELSE upcoming || ' upcoming events with dates, prices and tickets.' END AS summary FROM l""")
def venue_snippets(spark, d):
    return snippets.venue_summaries(_runs(spark, d), lit_day(), ties=("p_partkey",)).filter("upcoming > 0")


@query(f"""WITH {RUNS}, e AS (SELECT *, price = 'Free' AS free, "start" < DATE '1998-06-15' AS open FROM runs WHERE coalesce("end", "start") >= DATE '1998-06-15'),
g AS (SELECT venue, count(*) AS upcoming, count(*) FILTER (free) AS free, first(name ORDER BY open, "start", name) AS next,
  first(CASE WHEN open AND "end" IS NOT NULL THEN 'on now, until ' || strftime("end", '%-d %B %Y') ELSE {_long('"start"', 'coalesce("end", "start")')} END ORDER BY open, "start", name, p_partkey) AS next_dates,
  coalesce(array_to_string((list(name ORDER BY "start", name) FILTER (free))[1:3], '; '), '') AS free_names FROM e GROUP BY 1)
SELECT *, CASE WHEN free = upcoming AND free = 1 THEN 'Yes, the upcoming event we list is free.' WHEN free = upcoming THEN 'Yes, all ' || upcoming || ' upcoming events we list are free.'
  WHEN free > 0 THEN free || ' of the ' || upcoming || ' upcoming events we list ' || CASE WHEN free = 1 THEN 'is' ELSE 'are' END || ' free: ' || free_names || CASE WHEN free > 3 THEN ' and more' ELSE '' END || '. The price of the others is shown in the list.'
  ELSE 'None of the upcoming events we list is marked as free. Where we have a price, it is shown next to each event.' END AS answer FROM g""")
def venue_answers(spark, d):
    return snippets.venue_answers(_runs(spark, d), lit_day(), ties=("p_partkey",))


@query("""SELECT p_partkey, replace(lower(p_name), ' ', '-') || '-' || lower(replace(p_brand, '#', '-')) || '-jun-5-1998' AS slug, '1998-06-05T21:00' AS "start",
  CASE WHEN p_size > 5 AND p_size % 20 <> 0 THEN '1998-06-' || lpad((5 + p_size % 20)::VARCHAR, 2, '0') END AS "end", p_size::DOUBLE AS price_from, p_size <= 5 OR p_size % 20 <= 7 AS pick_candidate FROM part""")
def scanned_records(spark, d):
    p = table(spark, d, "part")
    end = F.when(F.col("p_size") > 5, F.concat(F.lit("1998-06-"), F.lpad((F.col("p_size") % 20 + 5).cast("string"), 2, "0")))
    facts = p.select(F.col("p_name").alias("name"), F.col("p_brand").alias("venue"), F.lit("1998-06-05").alias("date"), F.lit("21:00").alias("time"), end.alias("end"), F.lit("x").alias("price"), F.col("p_size").cast("double").alias("price_from"), F.lit("other").alias("category"), F.lit("a").alias("description"), F.lit("b").alias("long_text"), F.lit(True).alias("candidate"), F.col("p_partkey").cast("string").alias("url"))
    return scan.records(facts, "scan").select(F.col("link").cast("long").alias("p_partkey"), "slug", "start", "end", "price_from", "pick_candidate")


@query("""SELECT o_orderkey, 'Home host ' || o_orderpriority || ' at the Ground on ' || strftime(o_orderdate, '%A, %-d %B') || CASE WHEN o_orderkey % 2 = 0 THEN ' at 20:30' ELSE ' (kickoff time to be confirmed)' END || '.' AS description,
  strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 2 = 0 THEN 'T20:30' ELSE '' END AS "start" FROM orders""")
def match_records(spark, d):
    o = table(spark, d, "orders")
    items = o.select(F.col("o_orderkey").alias("item"), F.col("o_orderpriority").alias("opponent"), day("o_orderdate").alias("date"), F.when(F.col("o_orderkey") % 2 == 0, "20:30").alias("kickoff"), F.lit(None).cast("string").alias("price"), F.lit("https://x.pt").alias("url"))
    return scan.match_records(items, "Home", "Ground", "scan").select(F.col("item").alias("o_orderkey"), "description", "start")


@query("""SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 'page does not confirm the event' WHEN p_size % 10 = 1 THEN 'not for this audience' WHEN p_size % 10 = 2 THEN 'no organiser, venue or ticketing page'
  WHEN p_size % 10 = 3 THEN 'name quote not on page' WHEN p_size % 10 = 4 THEN 'date quote lacks the day' WHEN p_size % 10 = 5 THEN 'date outside window' WHEN p_size % 10 = 6 THEN 'not in the area'
  WHEN p_size % 10 = 7 THEN 'meta copy' WHEN p_size % 10 = 8 THEN 'thin copy' END AS reason FROM part""")
def scan_rejections(spark, d):
    """Facts with one fault each, by the last digit of a part's size."""
    k = F.col("p_size") % 10
    text = F.when(k == 8, "short").otherwise(F.repeat(F.lit("word "), 80))
    facts = table(spark, d, "part").select(
        "p_partkey", (k != 0).alias("is_event"), (k != 1).alias("fits"), F.when(k == 2, "other").otherwise("venue").alias("source_type"), F.col("p_name").alias("name"), F.col("p_brand").alias("venue"),
        F.when(k == 6, "Lisboa").otherwise("Porto").alias("city"), F.when(k == 5, "1999-11-21").otherwise("1998-11-21").alias("date"), F.lit(None).cast("string").alias("end"),
        F.when(k == 7, "The page lists it").otherwise("An evening").alias("description"), text.alias("long_text"),
        F.when(k == 3, "something else").otherwise(F.col("p_name")).alias("name_quote"), F.when(k == 4, "NOV 1998").otherwise("21 NOV 1998").alias("date_quote"), F.col("p_brand").alias("venue_quote"),
        F.concat_ws(" ", F.upper("p_name"), F.lit(" 21  nov 1998 NOV 1998 at"), "p_brand").alias("page_text"),
    )
    return facts.select("p_partkey", scan.rejection(lit_day("1998-11-01"), lit_day("1998-12-01"), "Porto").alias("reason"))


@query("""SELECT DISTINCT o_custkey, o_orderdate::DATE AS day FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderdate::DATE = o.o_orderdate::DATE AND x.o_orderstatus = 'F')
  AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0)""")
def occurrences_not_listed(spark, d):
    o = table(spark, d, "orders").select("o_custkey", day("o_orderdate").alias("day"), "o_orderstatus")
    left = scan.not_listed(o.select("o_custkey", "day").distinct(), o.filter("o_orderstatus = 'F'"), [["o_custkey", "day"]])
    return scan.not_listed(left, table(spark, d, "customer").filter("c_custkey % 7 = 0").select(F.col("c_custkey").alias("o_custkey")), [["o_custkey"]])


@query("""WITH c AS (SELECT p_partkey, p_brand, p_name FROM part WHERE p_size > 10), k AS (SELECT DISTINCT p_brand, p_name FROM part WHERE p_size <= 10)
SELECT min(p_partkey) AS id FROM c LEFT JOIN k USING (p_brand, p_name) WHERE k.p_name IS NULL GROUP BY p_brand, p_name""")
def accepted_in_order(spark, d):
    """Parts that no small part and no earlier one equals in brand and name."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_name", "p_size")
    rules = [matching.Rule("equal", ("p_brand", "p_name"))]
    return scan.accept_new(p.filter("p_size > 10"), p.filter("p_size <= 10"), rules, ["id"]).select("id")


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'own ' || p_type WHEN p_partkey % 3 = 1 THEN 'slug ' || p_partkey ELSE 'name ' || p_name END AS gloss FROM part""")
def name_glosses(spark, d):
    p = table(spark, d, "part")
    none = F.lit(None).cast("string")
    e = p.select(F.col("p_partkey").alias("id"), "p_name", F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("slug"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("own "), "p_type")).alias("name_en")).withColumnRenamed("p_name", "name")
    by_slug = p.filter("p_partkey % 3 = 1").select(F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("slug"), F.lit("-").alias("name"), F.concat(F.lit("slug "), F.col("p_partkey").cast("string")).alias("name_en"))
    by_name = p.select(none.alias("slug"), F.upper("p_name").alias("name"), F.concat(F.lit("name "), "p_name").alias("name_en")).distinct()
    return scan.glosses(e, by_slug.unionByName(by_name))


@query("""SELECT page_id, url || ', a 1-2 "x"<b>y</b>, z' AS text FROM pages""")
def humanized_html(spark, d):
    h = F.concat(F.lit("<p title='—'>— "), F.col("url"), F.lit(" — a 1—2 “x”<b>y</b> — z —</p><!-- — -->"))
    out = markup.humanize_html(h)
    inner = F.regexp_extract(out, r"(?s)^<p title='—'>(.*)</p><!-- — -->$", 1)
    return table(spark, d, "pages").select("page_id", inner.alias("text"))


@query("""SELECT p_partkey, '<h2>' || p_type || '</h2><p>a</p>' AS head, '<h2>B</h2><h2>C</h2>' AS rest FROM part""")
def page_halves(spark, d):
    h = F.concat(F.lit("<h2>"), "p_type", F.lit("</h2><p>a</p><h2>B</h2><h2>C</h2>"))
    return table(spark, d, "part").select("p_partkey", markup.split_before_second(h).alias("s")).select("p_partkey", "s.*")


@query("""SELECT p_partkey, '<h3><a href="https://x.pt/event/e' || p_partkey || '" style="color:inherit;text-decoration:none;">' || p_name || '</a></h3><p>t</p><a href="https://x.pt/event/e' || p_partkey || '" class="c">More info →</a><h3>Else</h3>' AS html,
  '<a href="https://x.pt/pt/event/e">' AS moved, '<p>a</p><p>api/unsubscribe</p>' || chr(10) || '<p>line</p><i>' AS footer FROM part""")
def edition_links(spark, d):
    p = table(spark, d, "part")
    h = F.concat(F.lit("<h3> "), "p_name", F.lit('</h3><p>t</p><a href="https://g.com/?q" target="_blank" class="c">More info →</a><h3>Else</h3>'))
    slugs = F.create_map(F.lower("p_name"), F.concat(F.lit("e"), F.col("p_partkey").cast("string")))
    once = markup.link_titles(h, slugs, "https://x.pt")
    twice = markup.more_info_links(markup.link_titles(once, slugs, "https://x.pt"), "https://x.pt")
    foot = markup.with_footer_line(F.lit("<p>a</p><p>api/unsubscribe</p><i>"), "<p>line</p>", "line.example", "api/unsubscribe")
    return p.select("p_partkey", twice.alias("html"), markup.moved_links(F.lit('<a href="https://x.pt/event/e">'), "https://x.pt/event/", "https://x.pt/pt/event/").alias("moved"), foot.alias("footer"))


@query("""SELECT p_partkey, p_size <= 8 AND p_size > 0 AND p_type NOT IN ('ECONOMY', 'PROMO') AS eventlike, p_type = 'SMALL' AND p_size > 10 AS home, p_size % 2 = 0 OR p_size % 3 = 0 AS stale,
  p_size % 5 = 0 AS untranslated, p_type = 'LARGE' AS meta FROM part""")
def job_predicates(spark, d):
    p, s, kind = table(spark, d, "part"), F.col("p_size"), F.col("p_type")
    name = F.when(kind == "ECONOMY", "River cruise").when(kind == "PROMO", "Gift card").otherwise("Candlelight")
    like = predicates.is_event_like(name, F.col("p_brand"), F.lit("concerts"), s, F.lit(True))
    match = F.when((kind == "SMALL") & (s > 10), "FC Home vs. Rivals").when(kind == "SMALL", "Home vs TBD").otherwise("Rivals vs Home")
    stale = predicates.needs_update(F.when(s % 2 != 0, "https://band.pt/x"), F.when(s % 3 != 0, "long").otherwise(" "), F.lit("short"))
    open_ = predicates.needs_translation(F.when(s % 5 != 0, "curto"), F.lit("long"), F.lit("longo"))
    meta = predicates.is_meta_copy(F.when(kind == "LARGE", "This page lists it").otherwise("A pageant"))
    return p.select("p_partkey", like.alias("eventlike"), predicates.is_home_match(match, F.lit("ground"), "home", "ground").alias("home"), stale.alias("stale"), open_.alias("untranslated"), meta.alias("meta"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderstatus <> 'F' AND o_orderdate::DATE >= DATE '1998-06-15' AND o_custkey % 4 > 1 AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 6 = 0)""")
def organizer_offers(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_custkey") % 4
    link = F.when(k == 0, "https://www.bol.pt/x").otherwise("https://band.pt/x")
    ok = predicates.organizer_offer(F.when(F.col("o_orderpriority") == "5-LOW", "sports").otherwise("music"), day("o_orderdate"), F.lit(None).cast("date"), F.when(k == 1, "various-places").otherwise("club"), link, F.col("o_orderstatus") == "F", F.col("o_custkey") % 6 == 0, lit_day())
    return o.filter(ok).select("o_orderkey")


@query("""SELECT p_partkey, p_size * 10 AS shown FROM part WHERE p_size * 10 >= 40 AND p_retailprice / 100000.0 < 0.02 ORDER BY p_size DESC, p_partkey LIMIT 15""")
def low_click_rates(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 10).alias("shown"), (F.col("p_retailprice") / 100000).alias("rate"))
    return predicates.low_click_rate(p, "shown", "rate", ties=["p_partkey"]).select("p_partkey", "shown")


@query(f"""WITH {RUNS} SELECT p_partkey FROM runs WHERE coalesce("end", "start") >= DATE '1998-06-17'
ORDER BY CASE WHEN "start" >= DATE '1998-06-15' THEN 0 ELSE 1 END, CASE WHEN "start" >= DATE '1998-06-15' THEN "start" ELSE coalesce("end", "start") END, p_partkey LIMIT 5""")
def still_on(spark, d):
    return predicates.still_on(_runs(spark, d), "start", "end", lit_day(), 2, 5, ties=["p_partkey"]).select("p_partkey")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'b' ELSE 'a,b,c' END AS saved, CASE WHEN c_custkey % 3 = 0 THEN 'Rivoli Theatre' ELSE c_mktsegment END AS venue, 'Photo: Agora' AS credit FROM customer""")
def toggles_and_names(spark, d):
    item = F.when(F.col("c_custkey") % 2 == 0, "a").otherwise("c")
    said = F.when(F.col("c_custkey") % 3 == 0, "TM  Rivoli, Porto").otherwise(F.col("c_mktsegment"))
    saved = F.array_join(predicates.toggled(F.array(F.lit("a"), F.lit("b")), item), ",")
    return table(spark, d, "customer").select("c_custkey", saved.alias("saved"), predicates.first_match(said, [("rivoli", "Rivoli Theatre")]).alias("venue"), predicates.photo_credit(F.lit("https://www.agora.pt/i.jpg"), {"bol.pt": "BOL"}).alias("credit"))


@query("""SELECT url FROM pages UNION SELECT 'https://x.pt/' || doc_id FROM documents UNION SELECT 'https://x.pt/' || p_partkey FROM part""")
def known_urls(spark, d):
    page = lambda n, k: table(spark, d, n).select(F.concat(F.lit("https://x.pt/"), F.col(k).cast("string")).alias("url"))
    return predicates.known(table(spark, d, "pages").select("url"), page("documents", "doc_id"), page("part", "p_partkey"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'legacy' WHEN n >= 10 AND c_custkey % 2 = 0 THEN 'compose' WHEN c_custkey % 3 = 0 AND n >= 5 THEN 'compose' ELSE 'legacy' END AS path
FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)""")
def edition_paths(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").fillna(0, ["n"])
    k = F.col("c_custkey")
    path = scan.edition_path(F.when(k % 5 == 0, "legacy").when(k % 3 == 0, "compose"), F.lit(True), F.col("n"), F.when(k % 2 == 0, 9).otherwise(0), F.col("n"), 10, 5)
    return c.select("c_custkey", path.alias("path"))


#: Parts as events of listing pages, at most fifty a page, every seventh page without any.
_LISTED = """e AS (SELECT p_partkey AS id, p_partkey // 50 AS page, p_name AS name, p_brand AS venue, strftime(DATE '2026-01-01' + p_size::INT, '%Y-%m-%d') AS day, p_size AS price FROM part WHERE (p_partkey // 50) % 7 > 0)"""


def _listing_pages(spark, d):
    """(page, events) of parts as events, in order."""
    day = F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), F.col("p_size").cast("int")), "yyyy-MM-dd")
    e = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 50).alias("page"), F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("venue"), day.alias("day"), F.col("p_size").alias("price")).alias("e"))
    return e.groupBy("page").agg(F.array_sort(F.collect_list("e")).alias("events"))


def _page(*scripts):
    return F.concat(F.lit("<html><head><title>Agenda</title><script>var x = 1;</script>"), *scripts, F.lit("</head><body><p>Agenda</p></body></html>"))


@query(f"""WITH {_LISTED} SELECT page, name, day || 'T21:00' AS "start", venue, 'Porto' AS city, price::VARCHAR AS price FROM e""")
def linked_data_listings(spark, d):
    """Events of listing pages' linked data, nested in lists and graphs among other things, one broken script a page."""
    as_event = lambda x: F.struct(
        F.array(F.lit("Thing"), F.lit("MusicEvent")).alias("@type"), x["name"].alias("name"), F.concat(x["day"], F.lit("T21:00")).alias("startDate"),
        F.struct(F.lit("Place").alias("@type"), x["venue"].alias("name"), F.struct(F.lit("Porto").alias("addressLocality")).alias("address")).alias("location"),
        F.array(F.struct(F.lit("Offer").alias("@type"), x["price"].alias("price"))).alias("offers"),
    )
    graph = F.to_json(F.struct(F.struct(F.lit("WebPage").alias("@type"), F.struct(F.transform("events", as_event).alias("itemListElement")).alias("mainEntity")).alias("@graph")))
    script = lambda c: F.concat(F.lit('<script type="application/ld+json">'), c, F.lit("</script>"))
    html = _page(script(F.lit('{"@type": "Event", "name": ')), F.when(F.col("page") % 7 > 0, script(graph)).otherwise(""))
    return pages.linked_events(_listing_pages(spark, d).select("page", html.alias("html")), "page", "html").select("page", "name", "start", "venue", "city", "price")


@query(f"""WITH {_LISTED} SELECT page, id, name, venue, day FROM e WHERE id % 3 > 0""")
def page_state_listings(spark, d):
    """Events of the state that pages carry in a script, in sections."""
    sections = F.array(F.struct(F.filter("events", lambda x: x["id"] % 3 == 1).alias("events")), F.struct(F.filter("events", lambda x: x["id"] % 3 == 2).alias("events")))
    state = F.to_json(F.struct(F.struct(F.struct(sections.alias("sections")).alias("profile")).alias("props")))
    html = _page(F.when(F.col("page") % 7 > 0, F.concat(F.lit('<script id="__STATE__" type="application/json">'), state, F.lit("</script>"))).otherwise(F.lit('<script id="other">{}</script>')))
    kind = "props struct<profile struct<sections array<struct<events array<struct<id bigint, name string, venue string, day string>>>>>>"
    got = _listing_pages(spark, d).select("page", pages.page_state(html, "__STATE__", kind).alias("s"))
    return got.select("page", F.explode("s.props.profile.sections").alias("section")).select("page", F.inline("section.events"))
