"""Listings: venues to canonical ones, rows for a page, catalog matches, selections, suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, prices, urls
from ..functions import text as t
from ..functions.quotes import found_quote
from ..plans.ranks import numbered
from . import classify, sequences
from .intervals import LONG_RUN_DAYS, in_window

#: Words of stages, of rooms before a venue's name, and of venues in general.
STAGE_WORD = "^(palco|sala|salao|auditorio|auditorium|stage|room|studio|estudio|foyer|terrace|terraco)$"
ROOM_FIRST = "^(sala|room|terrace|terraco|auditorio|auditorium|studio|estudio|stage|palco)(-|$)"
ROOM_FILLER = "^(grande|grand|pequeno|pequena|main|big|small|principal|do|da|de|the)$"


def canonical_venues(df: DataFrame, venue: str, aliases: DataFrame) -> DataFrame:
    """``df`` with venue_slug: the canonical slug of a venue text, its own slug if unknown.

    aliases: (alias, canonical), canonical slugs being aliases of themselves. A
    room in brackets goes; a room before a comma gives way to what follows; a
    known venue before a stage word counts as that venue.
    """
    bare = F.trim(F.regexp_replace(F.col(venue), r"\s*\([^)]*\)", ""))
    bare = F.when(bare == "", F.col(venue)).otherwise(bare)
    parts = F.filter(F.transform(F.split(bare, "[,/]"), lambda s: F.trim(s)), lambda s: s != "")
    own = t.venue_slug(bare)
    second = F.when((F.size(parts) > 1) & t.kebab(F.get(parts, F.lit(0))).rlike(ROOM_FIRST), t.venue_slug(F.get(parts, F.lit(1))))
    words = F.split(own, "-")

    def before_stage(i):
        """Words before a stage word at i, with and without fillers."""
        head = F.slice(words, F.lit(1), i)
        core = F.reverse(F.aggregate(F.reverse(head), F.array().cast("array<string>"), lambda acc, w: F.when((F.size(acc) == 0) & w.rlike(ROOM_FILLER), acc).otherwise(F.concat(acc, F.array(w)))))
        return F.when(F.get(words, i).rlike(STAGE_WORD), F.array(F.array_join(head, "-"), F.array_join(core, "-"))).otherwise(F.array().cast("array<string>"))

    stages = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), before_stage))
    tries = F.concat(F.array(second, own), stages)
    said = df.select(venue).filter(F.col(venue).isNotNull()).distinct()  # a venue is looked up once, however many rows name it
    found = said.select(F.col(venue).alias("_said"), F.posexplode(tries).alias("_n", "_try")).join(aliases.select(F.col("alias").alias("_try"), F.col("canonical").alias("_canonical")), "_try")
    best = found.groupBy("_said").agg(F.min_by("_canonical", "_n").alias("_canonical"))
    return df.join(best, F.col(venue) == F.col("_said"), "left").withColumn("venue_slug", F.coalesce("_canonical", own)).drop("_said", "_canonical")


def listing_rows(events: DataFrame, lang: str = "en") -> DataFrame:
    """Display rows of event records: what a page shows and filters by."""
    c = F.col
    name = F.coalesce(c("name_pt"), c("name")) if lang == "pt" else c("name")
    kind = classify.subcategory(c("name"), c("description"), c("venue"), c("category"))
    price = F.nullif(prices.price_label(c("price"), lang), F.lit(""))
    start, end = dates.day("start"), F.coalesce(dates.day("end"), dates.day("start"))
    return events.select(
        "slug",
        name.alias("name"),
        F.concat_ws(" · ", dates.short_dates(start, end, lang), "venue", price).alias("meta"),
        kind.alias("sub"),
        classify.parent_of(kind).alias("parent"),
        classify.area_of(c("venue")).alias("area"),
        prices.price_band(c("price"), c("price_from")).alias("band"),
        classify.is_for_kids(c("name"), c("description"), kind, c("category")).alias("kids"),
        start.alias("start"),
        end.alias("end"),
        t.search_form(F.concat_ws(" ", "name", "name_pt", "venue", "description")).alias("search"),
    )


def catalog_match(events: DataFrame, catalog: DataFrame, event_id: Column) -> DataFrame:
    """(id, item): the catalog item by id, else of the venue and session day with a matching name.

    events: id, name, venue_slug, day; catalog: item, name, venue_slug, sessions (dates).
    Only sets of words are compared, once for each venue and day and where they
    share a word; of a set's items the least stands for all.
    """
    by_id = events.select("id", event_id.alias("item")).join(catalog.select("item"), "item").select("id", "item", F.lit(0).alias("n"))
    place, words = ["venue_slug", "day"], F.array_sort(t.name_tokens("name", "venue_slug"))
    named = events.select("id", *place, words.alias("words"))
    sessions = catalog.select("item", "venue_slug", F.explode("sessions").alias("day"), words.alias("item_words")).groupBy(*place, "item_words").agg(F.min("item").alias("item"))
    asked = named.select(*place, "words").distinct().withColumn("word", F.explode("words"))
    met = asked.join(sessions.withColumn("word", F.explode("item_words")), [*place, "word"]).filter(t.compare_tokens("words", "item_words").isNotNull())
    found = met.groupBy(*place, "words").agg(F.min("item").alias("item"))
    by_name = named.join(found, [*place, "words"]).select("id", "item", F.lit(1).alias("n"))
    return by_id.unionByName(by_name).groupBy("id").agg(F.min(F.struct("n", "item")).alias("m")).select("id", "m.item")


def select_edition(events: DataFrame, first, last, recent: DataFrame, quota_class: Column, most: int = 2) -> DataFrame:
    """Events of a week: part short or long, in order, and the place among picks.

    events: slug, name, start, end, pick, link, image, and what ``quota_class``
    reads; of its class (not null) at most ``most`` stay. Recent picks' names
    (name) are not picked again.
    """
    met = events.filter(in_window("start", "end", first, last))
    free = met.filter(quota_class.isNull())
    kept = sequences.quota(met.filter(quota_class.isNotNull()), [quota_class], ["start", "name"], most).unionByName(free)
    long = F.datediff(F.coalesce("end", "start"), F.col("start")) > LONG_RUN_DAYS
    kept = kept.withColumns({"part": F.when(long, "long").otherwise("short"), "_key": t.kebab("name"), "score": prices.pick_score("pick", urls.is_real("link"), F.col("image").isNotNull())})
    pool = kept.filter("part = 'short'").join(recent.select(t.kebab("name").alias("_key")).distinct(), "_key", "left_anti")
    pool = numbered(pool.select("slug", "score", "start"), [F.desc("score"), "start", "slug"], name="place")
    return kept.join(pool.select("slug", (F.col("place") + 1).cast("int").alias("place")), "slug", "left").drop("_key")


def suggest(places: DataFrame, said: str, names: Column, shown: str, n: int = 6) -> DataFrame:
    """The n best places for what was typed: all words occur; names that start with the first word lead."""
    words = F.filter(F.split(t.game_form(F.lit(said)), " "), lambda w: w != "")
    first = F.get(words, F.lit(0))
    forms = F.transform(names, t.game_form)
    score = F.transform(
        F.filter(forms, lambda f: F.forall(words, lambda w: F.contains(f, w))),
        lambda f: F.when(F.startswith(f, first), 2).when(F.exists(F.split(f, " "), lambda w: F.startswith(w, first)), 1).otherwise(0),
    )
    scored = places.withColumn("score", F.array_max(score)).filter("score IS NOT NULL")
    return scored.orderBy(F.desc("score"), shown).limit(n)


def score_links(candidates: DataFrame, n: int = 3) -> DataFrame:
    """(id, url, score): the n sources whose path has most of a name's words; the candidate's own host leads.

    candidates: id, name, url, sources.
    """
    rows = candidates.select("id", t.name_tokens("name").alias("words"), "url", F.explode("sources").alias("source"))
    path = t.kebab(F.coalesce(F.try_parse_url("source", F.lit("PATH")), F.lit("")))
    hits = F.size(F.filter("words", lambda w: (F.length(w) > 2) & F.contains(path, w)))
    own = F.coalesce(urls.is_real("url") & (urls.bare_host("source") == urls.bare_host("url")), F.lit(False))
    scored = rows.select("id", F.col("source").alias("url"), F.when(hits > 0, hits + F.when(own, 10).otherwise(0)).otherwise(0).alias("score")).filter("score > 0").distinct()
    return sequences.quota(scored, ["id"], [F.desc("score"), "url"], n)


def guides_for(topics: DataFrame, posts: DataFrame, n: int) -> DataFrame:
    """(id, post, place): the newest post of each topic in order of topics, each post once, at most n.

    topics: id, topics (array); posts: post, topic, published.
    """
    newest = posts.groupBy("topic").agg(F.max_by("post", F.struct("published", "post")).alias("post"))
    met = topics.select("id", F.posexplode("topics").alias("n", "topic")).join(newest, "topic")
    once = met.groupBy("id", "post").agg(F.min("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("n"))
    return once.withColumn("place", place).filter(F.col("place") <= n).select("id", "post", "place")


def reconcile(rows: DataFrame, most_edits: int = 0) -> DataFrame:
    """Records held against their pages: status ok, corrected or hold, the record's new values, and why.

    rows: a record (id, name, start, time, venue, price_from) with what a reader
    found (page_name, page_day, page_time, page_venue, page_price, each with a
    ..._quote) and page_text. A quote may be off the page's words by up to
    ``most_edits`` characters.
    """
    c = F.col
    on = lambda f: found_quote(f"{f}_quote", "page_text", most_edits).isNotNull() if most_edits else t.on_page(f"{f}_quote", "page_text")
    day_ok = on("page_day") & c("page_day").isNotNull() & dates.quote_has_day("page_day_quote", "page_day")
    time_ok = on("page_time") & F.array_contains(dates.times_in("page_time_quote"), c("page_time"))
    price_ok = on("page_price") & F.array_contains(prices.numbers_in("page_price_quote"), c("page_price"))
    time = F.when(time_ok, c("page_time"))
    price = F.when(price_ok, c("page_price"))
    loose = lambda a, b: F.coalesce(t.contains_words(t.kebab(a), t.kebab(b)) | t.contains_words(t.kebab(b), t.kebab(a)) | t.compare_tokens(t.name_tokens(a), t.name_tokens(b)).isNotNull(), F.lit(False))
    problems = F.array_compact(
        F.array(
            F.when(~on("page_name"), "name not on the page").when(~loose("page_name", "name"), F.concat(F.lit("name: page says "), "page_name")),
            F.when(~F.coalesce(day_ok, F.lit(False)), "day not on the page").when(c("page_day") != c("start"), F.concat(F.lit("day: page says "), c("page_day").cast("string"))),
            F.when(~on("page_venue"), "venue not on the page").when(~loose("page_venue", "venue"), F.concat(F.lit("venue: page says "), "page_venue")),
        )
    )
    corrections = F.array_compact(
        F.array(
            F.when(~c("time").eqNullSafe(time), F.concat(F.lit("time "), F.coalesce("time", F.lit("none")), F.lit(" to "), F.coalesce(time, F.lit("none")))),
            F.when(~c("price_from").eqNullSafe(price), F.concat(F.lit("price "), F.coalesce(c("price_from").cast("string"), F.lit("none")), F.lit(" to "), F.coalesce(price.cast("string"), F.lit("none")))),
        )
    )
    out = rows.select("id", "name", "start", "venue", time.alias("new_time"), price.alias("new_price"), problems.alias("problems"), corrections.alias("corrections"))
    return out.withColumn("status", F.when(F.size("problems") > 0, "hold").when(F.size("corrections") > 0, "corrected").otherwise("ok"))
