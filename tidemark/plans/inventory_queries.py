"""One query for each smaller operator that shares none with others, with SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, games, prices, quotes, text, urls
from ..operators import classify, facets, intervals, listing, merging, predicates, reports
from ..sources import files, pages, records, sinks
from .queries import RUNS, day, lit_day, order_runs, query
from .ranks import numbered
from .storage import spread, table

# --- dates ---------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, o_orderdate::DATE + (o_custkey % 400)::INT AS later, o_orderdate::DATE - (o_custkey % 400)::INT AS sooner FROM orders""")
def day_addition(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", day("o_orderdate").alias("d"), (F.col("o_custkey") % 400).cast("int").alias("n"))
    return o.select("o_orderkey", F.date_add("d", F.col("n")).alias("later"), F.date_sub("d", F.col("n")).alias("sooner"))


@query(f"""WITH {RUNS} SELECT o_orderkey, date_diff('day', "start", "end")::INT AS days FROM runs""")
def run_lengths(spark, d):
    return order_runs(spark, d).select("o_orderkey", dates.span_days("start", "end").alias("days"))


@query(f"""WITH {RUNS} SELECT o_orderkey, NOT ("end" + 3 < DATE '1997-06-01' OR "start" > DATE '1997-06-30' + 3) AS near, NOT ("end" < DATE '1997-06-01' OR "start" > DATE '1997-06-30') AS met FROM runs""")
def overlap_with_slack(spark, d):
    near = lambda n: dates.overlaps("start", "end", lit_day("1997-06-01"), lit_day("1997-06-30"), n)
    return order_runs(spark, d).select("o_orderkey", near(3).alias("near"), near(0).alias("met"))


@query("""SELECT o_orderkey, (date_trunc('month', o_orderdate) + INTERVAL 13 MONTH)::DATE AS month FROM orders""")
def month_with_overflow(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.add_months(dates.month_start(day("o_orderdate")), 13).alias("month"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%dT10:00') END AS wall FROM orders""")
def midnight_dropped(spark, d):
    wall = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(F.col("o_orderkey") % 6 == 0, "T00:00").when(F.col("o_orderkey") % 3 == 0, "T00:00:00").otherwise("T10:00"))
    return table(spark, d, "orders").select("o_orderkey", dates.drop_midnight(wall).alias("wall"))


@query("""SELECT event_id, strftime(ts + INTERVAL 26 HOUR, '%Y-%m-%dT%H:%M') AS later FROM events""")
def wall_clock_plus_hours(spark, d):
    return table(spark, d, "events").select("event_id", dates.add_hours(F.date_format("ts", "yyyy-MM-dd'T'HH:mm"), 26).alias("later"))


@query("""SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN strftime(date_trunc('minute', ts) AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Lisbon', '%Y-%m-%dT%H:%M') END AS kickoff FROM events""")
def kickoffs(spark, d):
    at = F.when(F.col("event_id") % 4 == 0, F.date_trunc("day", "ts") + F.expr("INTERVAL 11 HOURS")).otherwise(F.col("ts"))
    return table(spark, d, "events").select("event_id", dates.kickoff(at).alias("kickoff"))


@query("""WITH m(k, pt) AS (VALUES (1, 'janeiro'), (2, 'fevereiro'), (3, 'março'), (4, 'abril'), (5, 'maio'), (6, 'junho'), (7, 'julho'), (8, 'agosto'), (9, 'setembro'), (10, 'outubro'), (11, 'novembro'), (12, 'dezembro')),
o AS (SELECT o_orderkey, o_orderdate::DATE AS a, o_orderdate::DATE + 6 AS b FROM orders)
SELECT o_orderkey, CASE WHEN month(a) = month(b) THEN day(a) || '-' || day(b) || ' de ' || x.pt || ' de ' || year(b) ELSE day(a) || ' de ' || x.pt || ' - ' || day(b) || ' de ' || y.pt || ' de ' || year(b) END AS week
FROM o JOIN m x ON x.k = month(a) JOIN m y ON y.k = month(b)""")
def week_range_text_pt(spark, d):
    return table(spark, d, "orders").select("o_orderkey", dates.week_range(day("o_orderdate"), "pt").alias("week"))


@query(f"""WITH {RUNS} SELECT o_orderkey, strftime("start", '%a %-d %b %Y') || CASE WHEN "end" > "start" THEN ' – ' || strftime("end", '%a %-d %b %Y') || CASE WHEN o_orderkey % 2 = 0 THEN ' (from 21:00)' ELSE '' END
  WHEN o_orderkey % 2 = 0 THEN ', 21:00' ELSE '' END AS said FROM runs""")
def long_when_texts(spark, d):
    return order_runs(spark, d).select("o_orderkey", dates.when_text("start", "end", F.when(F.col("o_orderkey") % 2 == 0, "21:00")).alias("said"))


@query("""SELECT o_orderkey, day(o_orderdate) = 1 + o_custkey % 28 AS has_day FROM orders""")
def quotes_with_a_day(spark, d):
    quote = F.concat(F.lit("on the "), (F.col("o_custkey") % 28 + 1).cast("string"), F.lit("th, 1998, room 412"))
    return table(spark, d, "orders").select("o_orderkey", dates.quote_has_day(quote, day("o_orderdate")).alias("has_day"))


@query("""SELECT o_orderkey, o_custkey % 4 <> 3 AND (o_custkey % 5 <> 0 OR o_custkey % 4 = 3) AS mentions FROM orders""")
def copy_that_names_the_day(spark, d):
    at = F.when(F.col("o_custkey") % 5 == 0, F.date_add(day("o_orderdate"), 1)).otherwise(day("o_orderdate"))
    pt = F.element_at(F.array(*map(F.lit, dates.MONTHS_PT)), F.month(at))
    said = F.when(F.col("o_custkey") % 4 == 0, F.date_format(at, "d MMMM")).when(F.col("o_custkey") % 4 == 1, F.concat(F.date_format(at, "MMMM d"), F.lit("th"))).when(F.col("o_custkey") % 4 == 2, F.concat(F.date_format(at, "d"), F.lit(" de "), pt)).otherwise("some day")
    return table(spark, d, "orders").select("o_orderkey", dates.mentions_day(F.concat(F.lit("Doors open "), said, F.lit(".")), day("o_orderdate")).alias("mentions"))


@query("""SELECT o_orderkey, greatest(1, date_diff('day', DATE '1996-01-01', o_orderdate::DATE) + 1)::INT AS number FROM orders""")
def launch_day_numbers(spark, d):
    return table(spark, d, "orders").select("o_orderkey", dates.day_number(day("o_orderdate"), "1996-01-01").alias("number"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%H:%M') WHEN 1 THEN '21:00' WHEN 2 THEN '00:05,12:30' WHEN 3 THEN '19:00' ELSE '' END AS times FROM events""")
def clock_times_in_text(spark, d):
    k = F.col("event_id") % 5
    said = F.when(k == 0, F.date_format("ts", "HH:mm")).when(k == 1, "9 pm, 9p.m.").when(k == 2, "12.05 am to 12:30pm").when(k == 3, "19h, rua 7").otherwise("100 people, 99:99")
    return table(spark, d, "events").select("event_id", F.array_join(dates.times_in(F.concat(F.lit("at "), said)), ",").alias("times"))


@query(f"""WITH {RUNS} SELECT o_orderkey, "start" <> "end" AND date_diff('day', "start", "end") > 1 AS all_day, CASE WHEN date_diff('day', "start", "end") > 1 THEN "start"::VARCHAR ELSE "start" || 'T20:30' END AS "start",
  CASE WHEN date_diff('day', "start", "end") > 1 THEN ("end" + 1)::VARCHAR WHEN "end" > "start" THEN "end" || 'T23:00' ELSE "start" || 'T22:30' END AS "end" FROM runs""")
def calendar_window_rules(spark, d):
    r = order_runs(spark, d)
    late = F.when(F.col("end") > F.col("start"), F.concat(F.col("end").cast("string"), F.lit("T23:00")))
    return r.select("o_orderkey", dates.calendar_window(F.concat(F.col("start").cast("string"), F.lit("T20:30")), late).alias("w")).select("o_orderkey", "w.*")


# --- texts ---------------------------------------------------------------------------------------


@query(r"""SELECT doc_id, trim(regexp_replace(strip_accents(lower(left(text, 300))), '[^a-z0-9]+', ' ', 'g')) AS form FROM documents""")
def game_normal_form(spark, d):
    return table(spark, d, "documents").select("doc_id", text.game_form(F.left("text", F.lit(300))).alias("form"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(strip_accents(lower(left(text, 300))), '[’''`"“”«»]', '', 'g'), '\s+', ' ', 'g')) AS form FROM documents""")
def quote_comparison_form(spark, d):
    return table(spark, d, "documents").select("doc_id", text.quote_form(F.left("text", F.lit(300))).alias("form"))


@query(r"""WITH q AS (SELECT item_id, trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[’''`"“”«»]', '', 'g'), '\s+', ' ', 'g')) AS q FROM benchmark)
SELECT item_id, length(q) >= 2 AND item_id % 2 = 0 AS found FROM q""")
def quotes_on_page(spark, d):
    page = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("A  «page» says:\n "), F.replace("text", F.lit(" "), F.lit("  ")), F.lit(" and more"))).otherwise("nothing of it")
    return table(spark, d, "benchmark").select("item_id", text.on_page("text", page).alias("found"))


_SAID = r"""trim(regexp_replace(regexp_replace(strip_accents(lower({})), '[’''`"“”«»]', '', 'g'), '\s+', ' ', 'g'))"""


@query(rf"""WITH q AS (SELECT doc_id, text, substr(text, 101, 20) || substr(text, 122, 19) || 'x' || substr(text, 141, 20) AS quote FROM documents WHERE length(text) >= 200)
SELECT doc_id, true AS found FROM q WHERE length({_SAID.format('quote')}) > 0""")
def quotes_with_edits(spark, d):
    """Quotes of every document, a character left out and one put in: all stand on their pages within four edits, as blanks may fold."""
    docs = table(spark, d, "documents").filter(F.length("text") >= 200)
    part = lambda a, n: F.substring("text", a, n)
    got = docs.select("doc_id", quotes.found_quote(F.concat(part(101, 20), part(122, 19), F.lit("x"), part(141, 20)), F.col("text"), 4).alias("x"))
    return got.select("doc_id", F.col("x").isNotNull().alias("found"))


@query("""SELECT doc_id, true AS same FROM documents""")
def kinds_by_automaton(spark, d):
    """Kinds of whole documents by one automaton of all signs, held against the cascade of patterns."""
    docs = table(spark, d, "documents")
    name, category = F.left("text", F.lit(60)), F.element_at(F.array(*map(F.lit, ("music", "nightlife", "other", "family", "sports"))), (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))
    none = F.lit("")
    signs = docs.select("doc_id", "text", category.alias("category"), classify.signs_in(name, F.col("text"), none).alias("s"))
    return signs.select("doc_id", (classify.subcategory_by_signs(F.col("s"), F.col("category")) == classify.subcategory(name, F.col("text"), none, F.col("category"))).alias("same"))


@query("""SELECT p_partkey, array_to_string(list_filter(['bright', 'symphony', string_split(p_name, ' ')[1], string_split(p_name, ' ')[2]], lambda w: w <> CASE WHEN p_partkey % 2 = 0 THEN 'symphony' ELSE '' END), ' ') AS words FROM part""")
def telling_name_words(spark, d):
    name = F.concat(F.lit("The Bright Sinfonia of 2026 no Porto: "), "p_name")
    words = text.name_tokens(name, F.when(F.col("p_partkey") % 2 == 0, "sala-sinfonia").otherwise("rivoli"))
    return table(spark, d, "part").select("p_partkey", F.array_join(words, " ").alias("words"))


@query("""SELECT p_partkey, 'bright sinfonia ' || p_name AS words FROM part""")
def unfolded_name_words(spark, d):
    words = text.name_tokens(F.concat(F.lit("The Bright Sinfonia concert 2026: "), "p_name"), stop=text.SCAN_STOP_WORDS, folded={})
    return table(spark, d, "part").select("p_partkey", F.array_join(words, " ").alias("words"))


PAIRS = """p AS (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split((SELECT p_name FROM part WHERE p_partkey = 0), ' ') AS b FROM part),
n AS (SELECT p_partkey, a || ['opus'] AS a, CASE p_partkey % 3 WHEN 0 THEN b || ['opus'] WHEN 1 THEN b || ['opus', 'encore', 'suite'] ELSE b END AS b FROM p),
c AS (SELECT p_partkey, len(list_intersect(a, b)) AS k, len(a) AS na, len(b) AS nb FROM n)"""


def _name_pairs(spark, d):
    """Each part's name, with a word more, beside the first part's, with none, one or three."""
    p = table(spark, d, "part")
    first = p.filter("p_partkey = 0").select(F.col("p_name").alias("other"))
    more = F.when(F.col("p_partkey") % 3 == 0, " opus").when(F.col("p_partkey") % 3 == 1, " opus encore suite").otherwise("")
    both = spread(p, "p_partkey").join(F.broadcast(first))  # one row
    return both.select("p_partkey", F.concat("p_name", F.lit(" opus")).alias("x"), F.concat(F.col("other"), more).alias("y"))


@query(f"""WITH {PAIRS} SELECT p_partkey, CASE WHEN k = na AND k = nb THEN 'equal' WHEN k / (na + nb - k) >= 0.6 THEN 'similar' WHEN k >= 2 AND k = least(na, nb) THEN 'contained' END AS match FROM c""")
def name_match_kinds(spark, d):
    return _name_pairs(spark, d).select("p_partkey", text.compare_tokens(text.name_tokens("x"), text.name_tokens("y")).alias("match"))


@query(f"""WITH {PAIRS} SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'equal' WHEN k = na AND k = nb THEN 'equal' WHEN k / (na + nb - k) >= 0.6 THEN 'similar' WHEN k >= 2 AND k = least(na, nb) THEN 'contained' END AS match FROM c""")
def best_variant_match(spark, d):
    same = F.when(F.col("p_partkey") % 2 == 0, F.col("x")).otherwise("entirely unlike")
    return _name_pairs(spark, d).select("p_partkey", text.compare_names(F.array("x", F.lit("nothing alike")), F.array("y", same)).alias("match"))


@query(f"""WITH {PAIRS} SELECT p_partkey, k / (na + nb - k) >= 0.6 AS same FROM c""")
def loose_name_equality(spark, d):
    return _name_pairs(spark, d).select("p_partkey", text.same_name("x", "y").alias("same"))


@query(f"""WITH {PAIRS} SELECT p_partkey, k / (na + nb - k) >= 0.6 OR (k = least(na, nb) AND (k >= 2 OR na = nb)) AS similar FROM c""")
def looser_similarity(spark, d):
    words = lambda c: text.name_tokens(c, stop=text.SCAN_STOP_WORDS, folded={})
    return _name_pairs(spark, d).select("p_partkey", text.similar_tokens(words("x"), words("y"), text.kebab("x"), text.kebab("y")).alias("similar"))


@query("""SELECT p_partkey, list_contains(string_split(p_name, ' '), 'bolt') AS whole FROM part""")
def whole_word_containment(spark, d):
    return table(spark, d, "part").select("p_partkey", text.contains_words(text.kebab("p_name"), F.lit("bolt")).alias("whole"))


@query("""SELECT p_partkey, len(list_filter(string_split(p_name, ' '), lambda w: len(w) >= 4 AND w <> 'bolt')) > 0 AS telling FROM part""")
def four_letter_words(spark, d):
    return table(spark, d, "part").select("p_partkey", text.has_distinctive_word(F.concat(text.kebab("p_name"), F.lit("-show-1998")), F.lit("the-bolt")).alias("telling"))


@query("""SELECT p_partkey, p_name || '|' || upper(p_name) || '|' || p_name || ' show' AS variants, p_name || '|' || upper(p_name) || '|' || p_name || ' show|Fest 2026 - ' || p_name AS bare FROM part""")
def name_variant_unions(spark, d):
    v = text.name_variants("p_name", F.upper("p_name"), F.lit("  "), F.col("p_name"), F.concat(F.lit(" "), "p_name", F.lit(" show ")))
    wide = text.with_bare_titles(F.array_append(v, F.concat(F.lit("Fest 2026 - "), "p_name")))
    return table(spark, d, "part").select("p_partkey", F.array_join(v, "|").alias("variants"), F.array_join(wide, "|").alias("bare"))


@query("""SELECT doc_id, text AS decoded FROM documents WHERE NOT regexp_matches(text, '(?i)&[a-z#0-9]+;')""")
def decoded_entities(spark, d):
    c = F.col("text")
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), ("€", "&euro;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    docs = table(spark, d, "documents").filter(~F.col("text").rlike("(?i)&[a-z#0-9]+;"))
    return docs.select("doc_id", text.decode_entities(c).alias("decoded"))


@query("""SELECT page_id, url AS heading FROM pages""")
def heading_texts(spark, d):
    return table(spark, d, "pages").select("page_id", pages.heading_text(F.concat(F.lit("<h1 class='x'>\n <b>"), "url", F.lit("</b>&nbsp;\n</h1>"))).alias("heading"))


@query("""SELECT page_id, '<p>' || url || '</p><div>end</div>' AS html FROM pages""")
def stripped_footers(spark, d):
    kinds = F.element_at(F.array(F.lit("<!-- FOOTER --><b>x</b><!-- END FOOTER -->"), F.lit('<td class="footer" id="f"><i>x</i></td>'), F.lit("<p style='s'>To unsubscribe write</p>"), F.lit("<p>You are receiving this email</p>")), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", pages.strip_footer(F.concat(F.lit("<p>"), "url", F.lit("</p>"), kinds, F.lit("<div>end</div>"))).alias("html"))


@query(r"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '<style>p{margin:0}</style>' || chr(10) || '<p>' || url || '</p>' ELSE '<p>' || url || '</p>' END AS fragment FROM pages""")
def embeddable_fragments(spark, d):
    head = F.concat(F.lit('<!DOCTYPE html><html lang="en"><head><title>t</title><style>p{margin:0}</style></head>'), F.when(F.col("page_id") % 2 == 0, "<body class='x'>").otherwise(""))
    html = F.concat(head, F.lit("<p>"), "url", F.lit("</p>"), F.when(F.col("page_id") % 2 == 0, "</body>").otherwise(""), F.lit("</html>"))
    return table(spark, d, "pages").select("page_id", pages.embeddable(html).alias("fragment"))


@query(r"""SELECT page_id, left(trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?s)<(?:script|style)>.*?</(?:script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')), 300) AS start FROM pages""")
def page_text_starts(spark, d):
    return table(spark, d, "pages").select("page_id", F.left(pages.page_text(F.col("html")), F.lit(300)).alias("start"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://i.pt/' || page_id || '/og.jpg' WHEN 1 THEN 'https://i.pt/tw.png' WHEN 2 THEN 'https://i.pt/a.webp?x=1' END AS image FROM pages""")
def best_images(spark, d):
    k = F.col("page_id") % 4
    og = F.concat(F.lit('<meta property="og:image" content="https://i.pt/'), F.col("page_id").cast("string"), F.lit('/og.jpg">'))
    tw, img = F.lit("<meta name='twitter:image' content='https://i.pt/tw.png'>"), F.lit('<img class="a" src="https://i.pt/a.webp?x=1">')
    html = F.when(k == 0, F.concat(img, tw, og)).when(k == 1, F.concat(img, tw)).when(k == 2, F.concat(F.lit('<img src="logo.svg">'), img)).otherwise('<img src="logo.svg">')
    return table(spark, d, "pages").select("page_id", pages.best_image(html).alias("image"))


@query(r"""SELECT p_partkey, 'a\b' || replace(p_name, ' ', '\, ') || '\;' || '\n' || p_brand AS line FROM part""")
def calendar_text(spark, d):
    said = F.concat(F.lit("a"), F.lit("\\b"), F.replace("p_name", F.lit(" "), F.lit(", ")), F.lit(";\n"), "p_brand")
    return table(spark, d, "part").select("p_partkey", F.replace(sinks.escaped(said), F.lit("\\\\"), F.lit("\\")).alias("line"))


@query("""SELECT doc_id, regexp_replace(left(text, 400), '[\\r\\n]', '', 'g') AS line, true AS narrow FROM documents""")
def folded_lines(spark, d):
    """Lines in pieces of at most 75 bytes; put together again they are the line."""
    f = sinks.folded(F.regexp_replace(F.left("text", F.lit(400)), "[\r\n]", ""))
    docs = table(spark, d, "documents").select("doc_id", f.alias("f"))
    return docs.select("doc_id", F.replace("f", F.lit("\r\n "), F.lit("")).alias("line"), F.coalesce(F.forall(F.split("f", "\r\n"), lambda x: F.octet_length(x) <= 75), F.col("f").isNull()).alias("narrow"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(p, '^/[A-Za-z0-9_./%-]*$') THEN p ELSE 'unknown' END AS path FROM (SELECT page_id, left(string_split(regexp_replace(url, '^https?://[^/]*', ''), '?')[1], 200) AS p FROM (SELECT page_id, string_split(url, '#')[1] AS url FROM pages))""")
def clean_paths(spark, d):
    return table(spark, d, "pages").select("page_id", text.clean_path(F.regexp_replace("url", "^https?://[^/]*", "")).alias("path"))


@query("""SELECT o_orderkey, lower(strftime(o_orderdate, '%B-%-d')) || '-' || day(o_orderdate + INTERVAL 6 DAY) || '-' || year(o_orderdate) AS slug FROM orders""")
def week_range_slugs(spark, d):
    said = F.concat(F.date_format("o_orderdate", "MMMM d"), F.lit(" – "), F.dayofmonth(F.date_add(day("o_orderdate"), 6)).cast("string"), F.lit(", "), F.year("o_orderdate").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", text.week_slug(said).alias("slug"))


@query(r"""SELECT doc_id, left(regexp_replace(regexp_replace(regexp_replace(lower(replace(left(text, 90), chr(10), ' ')), '[^a-z0-9_ -]', '', 'g'), ' +', '-', 'g'), '-+', '-', 'g'), 60) AS slug FROM documents""")
def post_slugs(spark, d):
    return table(spark, d, "documents").select("doc_id", text.post_slug(F.replace(F.left("text", F.lit(90)), F.lit("\n"), F.lit(" "))).alias("slug"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '<i>' || p_name || '</i><b>x</b>' || chr(10) || '<h2>a</h2><h2>b</h2>' WHEN 1 THEN '<i>' || p_name || '</i><b>x</b><h2>a</h2>' ELSE '<i>' || p_name || '</i>' END AS html FROM part""")
def blocks_before_anchors(spark, d):
    """Inserted before the first anchor, not twice, and not where there is none."""
    k = F.col("p_partkey") % 3
    page = F.concat(F.lit("<i>"), "p_name", F.lit("</i>"), F.when(k == 0, "<h2>a</h2><h2>b</h2>").when(k == 1, "<b>x</b><h2>a</h2>").otherwise(""))
    return table(spark, d, "part").select("p_partkey", text.insert_before(page, F.lit("<b>x</b>"), "<h2>", "<b>x").alias("html"))


@query("""SELECT p_partkey, '<u>t</u>' || chr(10) || '<h1>' || p_name || '</h1>' || '<u>m</u>' || chr(10) || '<p>body</p><u>n</u>' || chr(10) || '<hr>' AS html FROM part""")
def three_point_insertion(spark, d):
    page = F.concat(F.lit("<h1>"), "p_name", F.lit("</h1><p>body</p><hr>"))
    for anchor, block in (("<h1>", "<u>t</u>"), ("<p>", "<u>m</u>"), ("<hr>", "<u>n</u>")):
        page = text.insert_before(page, F.lit(block), anchor, block)
    return table(spark, d, "part").select("p_partkey", page.alias("html"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'a' || p_name || 'b<!-- s -->2<!-- e -->' ELSE 'a<!-- s -->1' END AS html FROM part""")
def marked_replacement(spark, d):
    page = F.when(F.col("p_partkey") % 2 == 0, "a<!-- s -->1<!-- e -->b<!-- s -->2<!-- e -->").otherwise("a<!-- s -->1")
    return table(spark, d, "part").select("p_partkey", text.replace_between(page, "<!-- s -->", "<!-- e -->", "p_name").alias("html"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'a' || p_name || 'c' WHEN 1 THEN 'a' || p_name || chr(10) || '</body>' ELSE 'a' END AS html FROM part""")
def placeholder_or_fallback(spark, d):
    """The placeholder's stretch is replaced; without one the block goes before the fallback anchor."""
    k = F.col("p_partkey") % 3
    page = F.when(k == 0, "a[[ x ]]c").when(k == 1, "a</body>").otherwise("a")
    placed = text.replace_between(page, "[[", "]]", "p_name")
    return table(spark, d, "part").select("p_partkey", F.when(placed != page, placed).otherwise(text.insert_before(page, "p_name", "</body>", "[[")).alias("html"))


@query("""SELECT p_partkey, 'a' || CASE WHEN p_partkey % 2 = 0 THEN 'b' ELSE '' END || p_name AS html FROM part""")
def marked_spans_removed(spark, d):
    page = F.concat(F.lit("a"), F.when(F.col("p_partkey") % 2 == 0, "<!--x-->gone<!--/x-->b").otherwise("<!--x--><!--/x-->"), "p_name")
    return table(spark, d, "part").select("p_partkey", text.replace_between(page, "<!--x-->", "<!--/x-->", F.lit("")).alias("html"))


# --- prices, links, kinds --------------------------------------------------------------------------


@query("""SELECT p_partkey, p_size % 4 <> 3 AS free FROM part""")
def free_price_texts(spark, d):
    price = F.element_at(F.array(F.lit("Free"), F.lit("Entrada livre"), F.lit("gratuito"), F.lit("5 €")), (F.col("p_size") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", prices.is_free(price).alias("free"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'Free' WHEN p_partkey % 3 = 0 THEN NULL ELSE 'From €' || p_size END AS price FROM part""")
def catalog_prices(spark, d):
    got = prices.catalog_price(F.col("p_size").cast("double"), F.when(F.col("p_partkey") % 3 == 0, "USD").otherwise("EUR"), F.col("p_size") % 4 == 0)
    return table(spark, d, "part").select("p_partkey", got.alias("price"))


@query(r"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_extract(url, '/([0-9]+)', 1) END AS number FROM pages""")
def numbers_after_hosts(spark, d):
    n = F.regexp_extract("url", "/([0-9]+)", 1)
    link = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://www.plan.pt/m/"), n, F.lit("?a=7"))).otherwise(F.concat(F.lit("https://other.pt/m/"), n))
    return table(spark, d, "pages").select("page_id", urls.number_after(link, "plan.pt", "/m/([0-9]*)").alias("number"))


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Serralves' WHEN 1 THEN 'Rivoli' END AS venue FROM pages""")
def venues_of_hosts(spark, d):
    host = F.element_at(F.array(F.lit("www.serralves.pt"), F.lit("rivoli.pt"), F.lit("else.pt")), (F.col("page_id") % 3 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", urls.host_venue(F.concat(F.lit("https://"), host, F.lit("/x?y=1")), {"serralves.pt": "Serralves", "rivoli.pt": "Rivoli"}).alias("venue"))


@query("""SELECT page_id, page_id % 3 = 0 AS same FROM pages""")
def pages_without_queries(spark, d):
    a = F.concat(F.lit("https://www.x.pt/A/"), F.col("page_id").cast("string"))
    b = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("http://x.pt/a/"), F.col("page_id").cast("string"), F.lit("/?q=1"))).when(F.col("page_id") % 3 == 1, F.lit("https://x.pt/a")).otherwise("https://y.pt/a/1")
    return table(spark, d, "pages").select("page_id", urls.same_page(a, b).alias("same"))


@query("""SELECT page_id, page_id % 4 < 2 AS real, page_id % 4 = 0 AS fetchable FROM pages""")
def real_and_fetchable_urls(spark, d):
    url = F.element_at(F.array(F.lit("https://band.pt/e/night"), F.lit("https://band.pt/search?q=x"), F.lit("https://www.google.com/search?q=x"), F.lit("mailto:a@b.pt")), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", urls.is_real(url).alias("real"), urls.is_fetchable(url).alias("fetchable"))


@query("""SELECT page_id, page_id % 3 = 1 AS guessed FROM pages""")
def guessed_urls(spark, d):
    url = F.element_at(F.array(F.lit("https://www.a.pt/x?utm=1"), F.lit("https://a.pt/made-up"), F.lit("https://c.pt/x")), (F.col("page_id") % 3 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", urls.is_guessed(url, F.array(F.lit("https://a.pt/x"), F.lit("https://b.pt/y"))).alias("guessed"))


@query("""SELECT s_suppkey, s_suppkey % 4 IN (0, 1) AS vague, s_suppkey % 4 <> 0 AS page FROM supplier""")
def placeholder_venues(spark, d):
    slug = F.element_at(F.array(F.lit("tbc"), F.lit("casa-various"), F.lit("rivoli"), F.lit("hard-club")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    page = F.when(F.col("s_suppkey") % 4 == 1, F.lit("casa")).otherwise(slug)
    return table(spark, d, "supplier").select("s_suppkey", text.is_vague_venue(slug).alias("vague"), text.has_venue_page(page).alias("page"))


@query("""SELECT s_suppkey, s_suppkey % 3 < 2 AS room FROM supplier""")
def room_only_names(spark, d):
    name = F.element_at(F.array(F.lit("Sala 2"), F.lit("Grande Auditório"), F.lit("Casa Azul")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return table(spark, d, "supplier").select("s_suppkey", text.is_generic_room(name).alias("room"))


# --- reports and selections ------------------------------------------------------------------------


@query("""WITH c AS (SELECT ts::DATE AS "day", event_type AS kind, count(*) AS n FROM events WHERE ts::DATE > DATE '2024-01-30' - 28 AND ts::DATE <= DATE '2024-01-30' GROUP BY 1, 2)
SELECT kind, "day", n FROM c QUALIFY row_number() OVER (PARTITION BY kind ORDER BY "day" DESC) <= 10""")
def recent_counts_by_type(spark, d):
    """Counts a day by type over the last 28 days, the last ten rows of each."""
    e = table(spark, d, "events").select(day("ts").alias("day"), F.col("event_type").alias("kind")).filter(F.col("day") > F.date_sub(lit_day("2024-01-30"), 28)).filter(F.col("day") <= lit_day("2024-01-30"))
    counts = e.groupBy("kind", "day").agg(F.count(F.lit(1)).alias("n"))
    return merging.keep_last(counts, ["kind"], [F.desc("day")], 10).select("kind", "day", "n")


@query("""SELECT o_custkey, max(o_orderdate)::DATE AS added FROM orders GROUP BY 1""")
def latest_added_per_venue(spark, d):
    """The latest day on which a venue's rows were added."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max(day("o_orderdate")).alias("added"))


@query("""WITH m AS (SELECT date_trunc('week', ts)::DATE AS week, event_type, max(ts) AS mark FROM events GROUP BY 1, 2)
SELECT week, max(mark) AS latest FROM m GROUP BY 1 ORDER BY week DESC LIMIT 8""")
def latest_mark_per_week(spark, d):
    """The latest of a week's marks, which stand in one map a week; the last eight weeks."""
    marks = table(spark, d, "events").groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week"), "event_type").agg(F.max("ts").alias("at"))
    weeks = marks.groupBy("week").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "at"))).alias("marks"))
    return weeks.select("week", F.array_max(F.map_values("marks")).alias("latest")).orderBy(F.desc("week")).limit(8)


@query("""SELECT replace(p_name, ' ', '-') AS key, string_agg(DISTINCT s, '|' ORDER BY s) AS spellings
FROM (SELECT p_name, unnest([p_name, upper(p_name), CASE WHEN p_partkey % 2 = 0 THEN p_name || '!' ELSE p_name END]) AS s FROM part) GROUP BY 1""")
def spellings_per_key(spark, d):
    """The raw spellings behind each canonical key."""
    said = F.explode(F.array(F.col("p_name"), F.upper("p_name"), F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))))
    s = table(spark, d, "part").select(said.alias("said"))
    return s.groupBy(text.kebab("said").alias("key")).agg(F.array_join(F.array_sort(F.collect_set("said")), "|").alias("spellings"))


@query("""SELECT date_trunc('week', o_orderdate)::DATE AS edition, count(*) OVER (PARTITION BY date_trunc('week', o_orderdate)) AS n,
  row_number() OVER (PARTITION BY date_trunc('week', o_orderdate) ORDER BY o_orderdate, o_orderkey) - 1 AS place, o_orderkey FROM orders""")
def rows_per_edition(spark, d):
    """Rows grouped by edition, in order: each with its place and its edition's size."""
    o = table(spark, d, "orders").select(F.to_date(F.date_trunc("week", "o_orderdate")).alias("edition"), "o_orderdate", "o_orderkey")
    placed = numbered(o, ["o_orderdate", "o_orderkey"], ["edition"], "place")
    return placed.join(placed.groupBy("edition").agg(F.count(F.lit(1)).alias("n")), "edition").select("edition", "n", "place", "o_orderkey")


@query("""SELECT 'customer' AS kind, c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier""")
def union_in_order(spark, d):
    """Two lists in one, sorted."""
    part = lambda n, k, s: table(spark, d, n).select(F.lit(n).alias("kind"), F.col(k).alias("key"), F.col(s).alias("name"))
    return part("customer", "c_custkey", "c_name").unionByName(part("supplier", "s_suppkey", "s_name")).orderBy("name", "kind")


@query(f"""WITH {RUNS}, k AS (SELECT *, CASE WHEN o_custkey % 3 = 0 THEN 'free' WHEN o_custkey % 3 = 1 THEN 'kids' ELSE 'music' END AS kind FROM runs WHERE "end" >= DATE '1998-06-15')
SELECT o_orderkey, kind, CASE WHEN "end" - "start" > 7 THEN 'long' ELSE 'main' END AS part FROM k WHERE kind IN ('free', 'kids')""")
def landing_lists(spark, d):
    """Each landing page's predicate on what is ahead, split into main and long runs."""
    kind = F.when(F.col("o_custkey") % 3 == 0, "free").when(F.col("o_custkey") % 3 == 1, "kids").otherwise("music")
    ahead = intervals.upcoming(order_runs(spark, d).withColumn("kind", kind), "start", "end", lit_day())
    return intervals.short_and_long(ahead.filter(F.col("kind").isin("free", "kids")), "start", "end").select("o_orderkey", "kind", "part")


@query("""SELECT p_partkey FROM part WHERE p_brand = 'Brand#7'""")
def rows_of_a_venue(spark, d):
    """Rows of one venue by its slug."""
    return table(spark, d, "part").filter(text.venue_slug("p_brand") == "brand-7").select("p_partkey")


@query("""SELECT o_orderkey, o_orderdate::DATE <= make_date(year(o_orderdate) - CASE WHEN month(o_orderdate) = 1 AND day(o_orderdate) <= 6 THEN 1 ELSE 0 END + 1, 1, 6) AND (month(o_orderdate) = 12 OR (month(o_orderdate) = 1 AND day(o_orderdate) <= 6)) AS in_season FROM orders""")
def days_in_season(spark, d):
    """Whether a day lies in the season that ends on 6 January (F32)."""
    o = table(spark, d, "orders").select("o_orderkey", day("o_orderdate").alias("d"), dates.season(day("o_orderdate")).alias("s"))
    return o.select("o_orderkey", F.col("d").between(F.make_date(F.col("s.year").cast("int"), F.lit(12), F.lit(1)), F.col("s.end")).alias("in_season"))


@query("""SELECT o.o_orderkey, l.l_linenumber FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'P'""")
def picks_of_editions(spark, d):
    """The picks that belong to the editions asked for."""
    picks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return table(spark, d, "orders").filter("o_orderstatus = 'P'").select("o_orderkey").join(picks, "o_orderkey")


@query("""SELECT event_type, "day", coalesce(views, 0)::BIGINT AS views FROM (SELECT * FROM (SELECT DISTINCT event_type FROM events), (SELECT unnest(generate_series(DATE '2024-01-25', DATE '2024-02-03', INTERVAL 1 DAY))::DATE AS "day"))
LEFT JOIN (SELECT event_type, ts::DATE AS "day", count(*) AS views FROM events GROUP BY 1, 2) USING (event_type, "day")""")
def traffic_by_day(spark, d):
    """Daily totals of a window, zero on days without rows."""
    e = table(spark, d, "events").select("event_type", day("ts").alias("day"))
    days = e.select("event_type").distinct().withColumn("day", F.explode(F.sequence(lit_day("2024-01-25"), lit_day("2024-02-03"))))
    return days.join(e.groupBy("event_type", "day").agg(F.count(F.lit(1)).alias("views")), ["event_type", "day"], "left").na.fill(0, ["views"])


@query("""SELECT count(DISTINCT user_id) FILTER (ts::DATE BETWEEN DATE '2024-01-24' AND DATE '2024-01-30') AS now, count(DISTINCT user_id) FILTER (ts::DATE BETWEEN DATE '2024-01-17' AND DATE '2024-01-23') AS before FROM events""")
def visitors_by_window(spark, d):
    """Different visitors of this week and the week before."""
    e = table(spark, d, "events").select("user_id", day("ts").alias("day"))
    seen = lambda a: F.count_if(F.array_contains("weeks", F.lit(a)))
    week = F.when(F.col("day").between(lit_day("2024-01-24"), lit_day("2024-01-30")), "2024-01-24").when(F.col("day").between(lit_day("2024-01-17"), lit_day("2024-01-23")), "2024-01-17")
    users = e.withColumn("week", week).groupBy("user_id").agg(F.collect_set("week").alias("weeks"))  # two weeks at most a user
    return users.agg(seen("2024-01-24").alias("now"), seen("2024-01-17").alias("before"))


@query("""SELECT user_id, max(ts)::DATE >= DATE '2024-01-29' AS fresh FROM events GROUP BY 1""")
def freshness_guard(spark, d):
    """Whether the latest row is at most two days old, by key."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.max(day("ts")).alias("last"))
    return e.select("user_id", (F.col("last") >= F.date_sub(lit_day("2024-01-31"), 2)).alias("fresh"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1998-06-15' - INTERVAL 120 DAY""")
def blocklist_retention(spark, d):
    """Entries of the last 120 days."""
    return files.recent(table(spark, d, "orders"), "o_orderdate", F.lit("1998-06-15").cast("timestamp"), 120).select("o_orderkey")


@query(f"""WITH {RUNS} SELECT o_orderkey, "end" AS last FROM runs WHERE "end" >= DATE '1998-06-15' - 60""")
def personal_horizon(spark, d):
    """Saved rows that ended at most 60 days ago."""
    return intervals.upcoming(order_runs(spark, d), "start", "end", F.date_sub(lit_day(), 60)).select("o_orderkey", F.col("end").alias("last"))


@query("""SELECT p_partkey FROM (SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS n FROM part WHERE p_type = 'PROMO') WHERE n <= 25""")
def untranslated_newest(spark, d):
    """Rows that lack a translated title, the newest first, capped."""
    open_ = table(spark, d, "part").withColumn("title_pt", F.when(F.col("p_type") != "PROMO", F.col("p_name"))).filter(predicates.blank(F.col("title_pt")))
    return open_.orderBy(F.desc("p_retailprice"), "p_partkey").limit(25).select("p_partkey")


@query("""SELECT o_orderkey, place, place > 250 AS deferred FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey)::INT AS place FROM orders)""")
def queue_with_the_rest_deferred(spark, d):
    """A queue by date of at most 250 rows; what is left is deferred, not lost."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("o_orderstatus").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", n.alias("place")).withColumn("deferred", F.col("place") > 250)


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 2 = 0) ORDER BY o_orderdate DESC, o_orderkey LIMIT 25""")
def unseen_for_review(spark, d):
    """The newest 25 rows for review that weren't shown yet."""
    o = table(spark, d, "orders")
    return o.filter("o_orderstatus = 'O'").join(o.filter("o_custkey % 2 = 0").select("o_orderkey"), "o_orderkey", "left_anti").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(25).select("o_orderkey")


@query(f"""WITH {RUNS} (SELECT o_orderkey FROM runs ORDER BY CASE WHEN "end" >= DATE '1998-06-15' THEN 0 ELSE 1 END, "start" DESC, o_orderkey LIMIT 40)""")
def link_check_queue(spark, d):
    """Links to check: what is ahead first, then by date, the latest first, capped."""
    ahead = F.when(F.col("end") >= lit_day(), 0).otherwise(1)
    return order_runs(spark, d).orderBy(ahead, F.desc("start"), "o_orderkey").limit(40).select("o_orderkey")


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderdate, o_orderkey)::INT AS place FROM orders""")
def scope_then_date(spark, d):
    """Order by scope, then by date."""
    from pyspark.sql import Window

    scope = F.array_position(F.array(F.lit("P"), F.lit("O"), F.lit("F")), F.col("o_orderstatus"))
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(scope, "o_orderdate", "o_orderkey")).alias("place"))


@query("""SELECT p_brand, string_agg(p_name, ', ' ORDER BY p_retailprice, p_partkey) FILTER (n <= 8) || CASE WHEN max(n) > 8 THEN ' and ' || (max(n) - 8) || ' more' ELSE '' END AS shown
FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS n FROM part) GROUP BY 1""")
def capped_lists(spark, d):
    """A rendered list of at most eight names and how many more there are."""
    from pyspark.sql import Window

    p = table(spark, d, "part").withColumn("n", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")))
    g = p.groupBy("p_brand").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.when(F.col("n") <= 8, F.struct("n", "p_name")))).alias("l"))
    more = F.when(F.col("n") > 8, F.concat(F.lit(" and "), (F.col("n") - 8).cast("string"), F.lit(" more"))).otherwise("")
    return g.select("p_brand", F.concat(F.array_join(F.transform("l", lambda x: x["p_name"]), ", "), more).alias("shown"))


@query("""SELECT o_orderkey FROM orders WHERE o_custkey IN (1, 5, 9)""")
def saved_rows(spark, d):
    """The rows of a saved list of slugs."""
    wanted = spark.createDataFrame([("c-1",), ("c-5",), ("c-9",)], "slug string")
    o = table(spark, d, "orders").withColumn("slug", F.concat(F.lit("c-"), F.col("o_custkey").cast("string")))
    return o.join(F.broadcast(wanted), "slug", "left_semi").select("o_orderkey")  # three rows


@query("""WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS m FROM orders GROUP BY 1 HAVING count(*) >= 150)
SELECT o_orderkey, lower(strftime(m.m, '%B-%Y')) AS page FROM orders LEFT JOIN m ON m.m = date_trunc('month', o_orderdate)::DATE""")
def hub_pages_of_months(spark, d):
    """The hub page of a row's month, where there is one."""
    o = table(spark, d, "orders").select("o_orderkey", dates.month_start(day("o_orderdate")).alias("month"))
    have = reports.at_least(o.select("month"), ["month"], 150).select("month", dates.month_slug("month").alias("page"))
    return o.join(have, "month", "left").select("o_orderkey", "page")


@query("""SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 400000) AND c_custkey % 10 <> 3""")
def not_listed_by_key_or_name(spark, d):
    """Rows that no listed row equals by key or by slug of the name."""
    from ..operators.scan import not_listed

    c = table(spark, d, "customer").select("c_custkey", text.kebab("c_name").alias("slug"))
    listed = table(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    named = table(spark, d, "customer").filter("c_custkey % 10 = 3").select(text.kebab(F.upper("c_name")).alias("slug"))
    return not_listed(not_listed(c, listed, [["c_custkey"]]), named, [["slug"]]).select("c_custkey")


@query("""SELECT p_partkey, p_size % 6 <> 5 AS found, CASE p_size % 6 WHEN 5 THEN 0 WHEN 4 THEN 2 ELSE 1 END AS n FROM part""")
def keyword_targets(spark, d):
    """The pages a title's keywords lead to, at most three, each once."""
    rules = [("(?i)jazz", ["jazz", "music"]), ("(?i)concert", ["music"]), ("(?i)fair", ["markets"]), ("(?i)kids", ["family"])]
    said = F.element_at(F.array(F.lit("a concert"), F.lit("The fair"), F.lit("KIDS"), F.lit("concert concert"), F.lit("jazz concert"), F.lit("talk")), (F.col("p_size") % 6 + 1).cast("int"))
    got = classify.all_matches(said, rules, 3)
    return table(spark, d, "part").select("p_partkey", (F.size(got) > 0).alias("found"), F.size(got).alias("n"))


@query("""SELECT p_partkey, replace(lower(p_type), ' ', '+') AS cat, string_split(p_name, ' ')[1] AS q FROM part""")
def filters_round_trip(spark, d):
    """A listing's filters to their query string and back."""
    kinds = {k: facets.Filters.parse(f"?cat={k.lower()}&q=x&nonsense=1").query() for k in ("ECONOMY", "SMALL", "PROMO", "LARGE", "STANDARD", "MEDIUM")}
    cat = F.create_map(*(F.lit(x) for k, v in kinds.items() for x in (k, dict(p.split("=") for p in v.lstrip("?").split("&")).get("cat", ""))))
    return table(spark, d, "part").select("p_partkey", F.try_element_at(cat, F.col("p_type")).alias("cat"), F.element_at(F.split("p_name", " "), 1).alias("q"))


@query("""SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size > 25 THEN 1 ELSE 0 END, p_retailprice, p_partkey) AS n FROM part) WHERE n <= 12""")
def candidates_for_ranking(spark, d):
    """Candidate lists for a ranker: short ones first, then by price, twelve a group."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.when(F.col("p_size") > 25, 1).otherwise(0), "p_retailprice", "p_partkey"))
    return table(spark, d, "part").withColumn("n", n).filter("n <= 12").select("p_brand", "p_partkey")


@query("""SELECT p_partkey, 'x.pt' AS host, 'TEMPLATE' AS action, replace(p_name, ' ', '+') AS title, '19980615/19980616' AS dates FROM part""")
def calendar_links(spark, d):
    """Links that add an event to a web calendar."""
    link = sinks.calendar_link("https://x.pt/r", F.col("p_name"), F.lit("about"), F.lit("Porto"), F.lit("1998-06-15"), F.lit(None).cast("string"), "Europe/Lisbon")
    p = table(spark, d, "part").select("p_partkey", link.alias("u"))
    arg = lambda k: F.regexp_extract("u", rf"[?&]{k}=([^&]*)", 1)
    return p.select("p_partkey", F.parse_url("u", F.lit("HOST")).alias("host"), arg("action").alias("action"), arg("text").alias("title"), F.replace(arg("dates"), F.lit("%2F"), F.lit("/")).alias("dates"))


@query("""SELECT o_orderkey, o_orderkey || '@x.pt' AS uid, strftime(o_orderdate, '%Y%m%d') AS "start", strftime(o_orderdate + INTERVAL 1 DAY, '%Y%m%d') AS "end", o_orderpriority AS title FROM orders""")
def calendar_fields(spark, d):
    """The fields of every iCalendar document, read back."""
    o = table(spark, d, "orders")
    c = sinks.ics(F.col("o_orderkey").cast("string"), F.col("o_orderpriority"), F.lit("an order"), F.col("o_orderstatus"), F.lit("https://x.pt"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(None).cast("string"), F.col("o_orderdate"), "x.pt", "-//x//EN")
    got = lambda k: F.regexp_extract("c", rf"\r\n{k}:([^\r]*)\r\n", 1)
    return o.select("o_orderkey", c.alias("c")).select("o_orderkey", got("UID").alias("uid"), got("DTSTART;VALUE=DATE").alias("start"), got("DTEND;VALUE=DATE").alias("end"), got("SUMMARY").alias("title"))


@query("""SELECT page_id, url AS name, '2026-01-01' AS "start" FROM pages""")
def linked_data_names(spark, d):
    """Events of a page's linked data."""
    ld = F.concat(F.lit('<script type="application/ld+json">{"@graph": [{"@type": ["Thing", "MusicEvent"], "name": "'), F.col("url"), F.lit('", "startDate": "2026-01-01"}]}</script>'))
    return pages.linked_events(table(spark, d, "pages").select("page_id", ld.alias("html")), "page_id", "html").select("page_id", "name", "start")


_DECODED = """replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&')"""


@query(rf"""WITH items AS (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>') AS i FROM pages),
one AS (SELECT page_id, unnest(i) AS i, unnest(range(len(i)))::INT AS place FROM items WHERE len(i) >= 3)
SELECT page_id, place, {_DECODED.format("regexp_extract(i, 'href=.([^>]*).>', 1)")} AS link, {_DECODED.format("regexp_extract(i, '>([^<>]+)</a>', 1)")} AS title FROM one""")
def cards_of_pages(spark, d):
    """The records of every page's linked group, mined from the pages as they are."""
    got = records.mined_records(table(spark, d, "pages").select("page_id", "html"))
    linked = got.filter(F.exists("places", lambda p: p.startswith("a/@href#")))
    return linked.select("page_id", F.col("n").alias("place"), F.get("fields", F.lit(0)).alias("link"), F.get("fields", F.lit(1)).alias("title"))


@query(f"""WITH {RUNS} SELECT o_orderkey, "start", CASE o_orderkey % 5 WHEN 0 THEN "end" WHEN 4 THEN last_day("end") ELSE least("end", last_day("start")) END AS "end",
  CASE WHEN o_orderkey % 5 = 3 THEN '21:30' END AS time, o_orderkey % 5 = 4 AS month_only FROM runs""")
def listed_date_ranges(spark, d):
    """Start and end of the date texts of cards: ranges, numeric days, two days of a month, ends without a day."""
    last = F.least("end", F.last_day("start"))
    said = lambda c, f: F.date_format(c, f)
    longer = lambda before, c, after: F.when(last > F.col("start"), F.concat(F.lit(before), c, F.lit(after))).otherwise("")
    text = (
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(said("start", "d MMM yyyy"), F.lit(" – "), said("end", "d MMM yyyy")))
        .when(F.col("o_orderkey") % 5 == 1, F.concat(said("start", "MMMM d, yyyy"), longer(" to ", said(last, "MMMM d, yyyy"), "")))
        .when(F.col("o_orderkey") % 5 == 2, F.concat(longer("", said("start", "d"), " e "), said(last, "d MMM. yyyy")))
        .when(F.col("o_orderkey") % 5 == 3, F.concat(said("start", "dd.MM.yyyy"), longer(" - ", said(last, "dd.MM.yyyy"), ""), F.lit(" sex, 21h30")))
        .otherwise(F.concat(said("start", "d MMM yyyy"), F.lit(" - "), said("end", "MMM yyyy")))
    )
    said = order_runs(spark, d).select("o_orderkey", text.alias("said"))
    read = spread(said.select("said").distinct()).select("said", records.listed_days("said", lit_day()).alias("x"))  # a text is read once, however many cards bear it
    return said.join(read, said["said"].eqNullSafe(read["said"])).select("o_orderkey", "x.*")


@query("""SELECT doc_id, n_chars FROM documents WHERE n_chars IS NOT NULL""")
def wrapped_records(spark, d):
    """Records parsed from texts, null where the shape is wrong."""
    rec = F.when(F.col("n_chars").isNotNull(), F.to_json(F.struct("doc_id", "n_chars"))).otherwise("{broken")
    got = table(spark, d, "documents").select(files.parsed_or_null(rec, "doc_id bigint, n_chars bigint", "n_chars").alias("r"))
    return got.filter("r IS NOT NULL").select("r.doc_id", "r.n_chars")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Bolt night' ELSE p_name END AS name, CASE p_size % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'under-15' ELSE 'over-30' END AS band FROM part""")
def listing_row_fields(spark, d):
    """Listing rows in a language, with fallback."""
    price = F.element_at(F.array(F.lit("Free"), F.lit("5 €"), F.lit("40 €")), (F.col("p_size") % 3 + 1).cast("int"))
    none = F.lit(None).cast("string")
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("slug"), F.when(F.col("p_partkey") % 2 == 0, "Noite").otherwise(F.col("p_name")).alias("name_pt"), F.when(F.col("p_partkey") % 2 == 0, "Bolt night").otherwise(F.col("p_name")).alias("name"), F.col("p_brand").alias("venue"), F.lit("1998-11-03T21:00").alias("start"), none.alias("end"), price.alias("price"), F.lit(None).cast("double").alias("price_from"), F.lit("x").alias("description"), F.lit("music").alias("category"))
    got = listing.listing_rows(p)
    return got.select(F.col("slug").cast("long").alias("p_partkey"), F.col("name"), "band")


@query("""SELECT n_nationkey, choices FROM (SELECT n_nationkey, 4 AS choices FROM nation)""")
def four_choices(spark, d):
    """A seeded draw gives four different choices, the right one among them."""
    ids = [f"NATION_{k}" for k in range(25)]
    c = games.choices_for(F.col("n_nationkey") + 1, ids)
    n = table(spark, d, "nation").select("n_nationkey", c.alias("c"))
    right = F.array_contains("c", F.concat(F.lit("NATION_"), F.col("n_nationkey").cast("string")))
    return n.select("n_nationkey", F.when(right, F.size(F.array_distinct("c"))).otherwise(0).alias("choices"))
