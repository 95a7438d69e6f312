"""Documents made of rows: calendars, linked data, feeds, digests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.dates import calendar_window, to_utc
from ..plans.shipping import by_value

by_value(__name__)


def escaped(text: Column) -> Column:
    """Text for a calendar line."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"([\;,])", r"\\$1"), r"\r?\n", r"\\n")


def folded(line: Column) -> Column:
    """A calendar line in pieces of at most 75 bytes, characters whole."""

    @pandas_udf("string")
    def fold(lines: pd.Series) -> pd.Series:
        def one(s):
            if s is None:
                return None
            out, size, room = [""], 0, 75
            for ch in s:
                n = len(ch.encode())
                if size + n > room:
                    out.append("")
                    size, room = 0, 74
                out[-1] += ch
                size += n
            return "\r\n ".join(out)

        return lines.map(one)

    return fold(line)


def _compact(c: Column) -> Column:
    return F.regexp_replace(c, "[-:]", "")


def ics(slug: Column, title: Column, description: Column, location: Column, url: Column, start: Column, end: Column, added: Column, host: str, product: str) -> Column:
    """An iCalendar document of one event."""
    w = calendar_window(start, end)
    stamp = lambda c: F.date_format(to_utc(c.try_cast("timestamp_ntz")), "yyyyMMdd'T'HHmmss'Z'")
    at = lambda key, c: F.when(w["all_day"], F.concat(F.lit(f"{key};VALUE=DATE:"), _compact(c))).otherwise(F.concat(F.lit(f"{key}:"), stamp(c)))
    about = F.trim(F.concat(F.coalesce(description, F.lit("")), F.lit("\n\n"), url))
    lines = [
        F.lit("BEGIN:VCALENDAR"), F.lit("VERSION:2.0"), F.lit(f"PRODID:{product}"), F.lit("CALSCALE:GREGORIAN"), F.lit("METHOD:PUBLISH"), F.lit("BEGIN:VEVENT"),
        F.concat(F.lit("UID:"), slug, F.lit(f"@{host}")), F.concat(F.lit("DTSTAMP:"), F.date_format(added, "yyyyMMdd'T'HHmmss'Z'")), at("DTSTART", w["start"]), at("DTEND", w["end"]),
        F.concat(F.lit("SUMMARY:"), escaped(title)), F.concat(F.lit("DESCRIPTION:"), escaped(about)), F.concat(F.lit("LOCATION:"), escaped(location)), F.concat(F.lit("URL:"), url),
        F.lit("END:VEVENT"), F.lit("END:VCALENDAR"),
    ]
    return F.concat(F.concat_ws("\r\n", *(folded(x) for x in lines)), F.lit("\r\n"))


def calendar_link(base: str, title: Column, details: Column, location: Column, start: Column, end: Column, zone: str) -> Column:
    """A link that adds an event to a web calendar."""
    w = calendar_window(start, end)
    compact = lambda c: F.when(w["all_day"], _compact(c)).otherwise(F.concat(_compact(c), F.lit("00")))
    dates = F.concat(compact(w["start"]), F.lit("/"), compact(w["end"]))
    pairs = [("action", F.lit("TEMPLATE")), ("text", title), ("dates", dates), ("details", details), ("location", location), ("ctz", F.lit(zone))]
    return F.concat(F.lit(base + "?"), F.concat_ws("&", *(F.concat(F.lit(k + "="), F.url_encode(v)) for k, v in pairs)))


def event_document(name: Column, start: Column, end: Column, venue: Column, description: Column, price: Column, currency: Column, url: Column) -> Column:
    """A schema.org Event as JSON."""
    place = F.struct(F.lit("Place").alias("@type"), venue.alias("name"))
    offer = F.when(price.isNotNull(), F.struct(F.lit("Offer").alias("@type"), price.alias("price"), F.coalesce(currency, F.lit("EUR")).alias("priceCurrency"), url.alias("url")))
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("Event").alias("@type"), name.alias("name"), start.alias("startDate"), end.alias("endDate"), place.alias("location"), description.alias("description"), offer.alias("offers"), url.alias("url")))


def sitemap(*parts: DataFrame) -> DataFrame:
    """(url, lastmod, freq, priority) rows of several page kinds, each url once with its latest change."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("url").agg(F.max("lastmod").alias("lastmod"), F.min_by("freq", F.struct("priority", "freq")).alias("freq"), F.max("priority").alias("priority"))


def feed_item(title: Column, link: Column, at: Column, description: Column) -> Column:
    """An RSS item."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit("<item><title>"), esc(title), F.lit("</title><link>"), esc(link), F.lit("</link><pubDate>"), F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate><description>"), esc(description), F.lit("</description></item>"))


def split_messages(lines: Column, limit: int) -> Column:
    """Lines joined into messages of at most ``limit`` characters, longer lines cut."""
    cut = F.transform(lines, lambda x: F.when(F.length(x) > limit, F.concat(F.left(x, F.lit(limit - 1)), F.lit("…"))).otherwise(x))

    def add(acc, line):
        last = F.element_at(acc, -1)
        fits = F.length(last) + 1 + F.length(line) <= limit
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last, F.lit("\n"), line)))
        return F.when(F.size(acc) == 0, F.array(line)).when(fits, grown).otherwise(F.concat(acc, F.array(line)))

    return F.aggregate(cut, F.array().cast("array<string>"), add)


def digest(published: DataFrame, review: DataFrame, by: str, n: int = 25, limit: int = 1900) -> DataFrame:
    """One row of messages: a head with counts by source, then numbered review lines."""
    counts = published.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    head = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", by, F.col("n").cast("string")))), ", ").alias("parts"))
    first = review.orderBy("date", "name").limit(n).agg(F.array_sort(F.collect_list(F.struct("date", "name", "venue", "url"))).alias("rows"))
    total = review.agg(F.count(F.lit(1)).alias("waiting"))
    lines = F.transform("rows", lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), F.concat_ws(" | ", r["name"], r["date"].cast("string"), r["venue"], r["url"])))
    one = head.crossJoin(first).crossJoin(total)  # three one-row tables
    top = F.concat(F.col("total").cast("string"), F.lit(" new ("), F.col("parts"), F.lit("), "), F.col("waiting").cast("string"), F.lit(" for review"))
    return one.select(split_messages(F.concat(F.array(top), lines), limit).alias("messages"))
