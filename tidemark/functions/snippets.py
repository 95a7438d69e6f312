"""Titles and descriptions of pages, no longer than search results show them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import dates, prices
from . import text as t
from .text import col

#: Characters that results show of a title and of a description.
TITLE, DESCRIPTION = 62, 155
#: Names of months and, from Sunday on, of weekdays.
MONTHS = {
    "en": "January February March April May June July August September October November December".split(),
    "pt": "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro".split(),
}
WEEKDAYS = {"en": "Sun Mon Tue Wed Thu Fri Sat".split(), "pt": "dom seg ter qua qui sex sáb".split()}
WEEKDAYS_LONG = {
    "en": "Sunday Monday Tuesday Wednesday Thursday Friday Saturday".split(),
    "pt": "Domingo Segunda-feira Terça-feira Quarta-feira Quinta-feira Sexta-feira Sábado".split(),
}


def _nth(names: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), n)


def _cat(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def shown(name: Column | str) -> Column:
    """A name without outer blanks and long dashes."""
    return F.regexp_replace(F.trim(col(name)), r"\s*—\s*", ", ")


def long_dates(start: Column | str, end: Column | str, lang: str = "en") -> Column:
    """3 October 2026, 10–11 October 2026, 29 September – 2 October 2026; 10–11 de outubro de 2026."""
    a = col(start)
    b = F.coalesce(col(end), a)
    of = " de " if lang == "pt" else " "
    month = lambda d: _nth(MONTHS[lang], F.month(d))
    dm = lambda d: _cat(F.dayofmonth(d).cast("string"), of, month(d))
    y = lambda d: _cat(of, F.year(d).cast("string"))
    return (
        F.when(a == b, _cat(dm(a), y(a)))
        .when(F.year(a) != F.year(b), _cat(dm(a), y(a), " – ", dm(b), y(b)))
        .when(F.month(a) == F.month(b), _cat(F.dayofmonth(a).cast("string"), "–", dm(b), y(b)))
        .otherwise(_cat(dm(a), " – ", dm(b), y(b)))
    )


def event_title(name: Column | str, start: Column | str, end: Column | str, venue: Column | str, today: Column, lang: str = "en", most: int = TITLE) -> Column:
    """The fullest title that fits: name, weekday of a single day, dates, place, and what people look for while it is to come."""
    n, a = shown(name), col(start)
    b = F.coalesce(col(end), a)
    when = F.when(n.rlike(r"\b20[0-9]{2}\b"), dates.short_dates(a, b, lang)).otherwise(dates.short_dates(a, b, lang, year=True))
    place = shown(F.element_at(F.split(col(venue), "[,/]"), 1))
    day = F.when(a == b, _cat(_nth(WEEKDAYS[lang], F.dayofweek(a)), " ")).otherwise("")
    told, ahead = ~F.contains(F.lower(n), F.lower(place)), b >= today
    tail = " · Bilhetes e Info" if lang == "pt" else " · Tickets & Info"
    full, plain = _cat(n, " · ", day, when), _cat(n, " · ", when)
    tries = F.array(
        *(F.when(told & ahead, _cat(x, ", ", place, tail)) for x in (full, plain)),
        *(F.when(told, _cat(x, ", ", place)) for x in (full, plain)),
        *(F.when(ahead, _cat(x, tail)) for x in (full, plain)),
        full,
    )
    fits = F.get(F.filter(tries, lambda x: F.length(x) <= most), F.lit(0))
    return F.coalesce(fits, t.clip(plain, most + 15))


def event_summary(start: Column | str, end: Column | str, time: Column | str, venue: Column | str, price: Column | str, about: Column | str, lang: str = "en", most: int = DESCRIPTION) -> Column:
    """Day, time, place and price, then the first sentence of the text."""
    a, clock = col(start), col(time)
    b = F.coalesce(col(end), a)
    one = a == b
    at = F.when(one & clock.isNotNull() & (clock != "00:00"), clock)
    day = F.when(one, _nth(WEEKDAYS_LONG[lang], F.dayofweek(a)))
    if lang == "pt":
        said = _cat(F.coalesce(_cat(day, ", "), F.lit("")), long_dates(a, b, lang), F.coalesce(_cat(", às ", at), F.lit("")), ", ", col(venue), ".")
    else:
        said = _cat(F.coalesce(_cat(day, " "), F.lit("")), long_dates(a, b, lang), F.coalesce(_cat(", ", at, ","), F.lit("")), " at ", col(venue), ".")
    label = F.nullif(prices.price_label(price, lang), F.lit(""))
    cost = F.when(label.startswith("€"), _cat("Bilhetes " if lang == "pt" else "Tickets ", label, ".")).otherwise(_cat(label, "."))
    first = F.nullif(F.element_at(F.split(F.coalesce(col(about), F.lit("")), r"(?<=[.!?])\s"), 1), F.lit(""))
    return t.clip(shown(F.concat_ws(" ", said, cost, first)), most)


def edition_summary(week: Column | str, picks: Column | str, brand: str, lang: str = "en", n: int = 3) -> Column:
    """What a week's page holds: its first picks by name (P09). picks: array of struct(rank, name)."""
    first = F.transform(F.slice(F.array_sort(picks), 1, n), lambda p: shown(p["name"]))
    names = F.array_join(first, ", ")
    if lang == "pt":
        out = _cat("O que fazer no Porto na semana de ", col(week), F.when(names != "", _cat(": ", names, " e mais")).otherwise(""), ". Concertos, exposições, mercados e festivais escolhidos pela ", brand, ".")
    else:
        out = _cat("What's on in Porto, ", col(week), F.when(names != "", _cat(": ", names, " and more")).otherwise(""), ". Concerts, exhibitions, markets and festivals picked by ", brand, ".")
    return t.clip(out, DESCRIPTION)


def _fitted(first: Column, *more: Column, most: int = DESCRIPTION) -> Column:
    """Further sentences while the whole still fits."""
    out = first
    for m in more:
        longer = F.concat_ws(" ", out, m)
        out = F.when(F.length(longer) <= most, longer).otherwise(out)
    return out


def venue_summaries(events: DataFrame, today: Column, lang: str = "en", ties: tuple[str, ...] = ("end",)) -> DataFrame:
    """(venue, upcoming, title, summary): what is next at each venue, runs already open last; else the last event there (P10).

    events: venue, name, start, end (dates). Only two rows of a venue are looked
    at for the text; ties go by name, then by the columns ``ties``.
    """
    last = F.coalesce("end", "start")
    rows = events.select(*dict.fromkeys(("venue", "name", "start", "end", *ties)), (last >= today).alias("ahead"), (F.col("start") < today).alias("open"))
    key = lambda c: F.when(F.col("ahead"), c)
    order = [F.when(F.col("ahead"), 0).otherwise(1), key(F.col("open")), key(F.col("start")), F.desc("start"), "name", *ties]
    n = F.row_number().over(Window.partitionBy("venue").orderBy(*order))
    first = rows.withColumn("n", n).filter("n <= 2")
    counts = rows.groupBy("venue").agg(F.count_if("ahead").alias("upcoming"))
    until = _cat("até " if lang == "pt" else "until ", dates.short_dates("end", "end", lang))
    when = F.when(F.col("open") & F.col("end").isNotNull(), until).otherwise(dates.short_dates("start", "end", lang))
    when = F.when(F.col("ahead"), when).otherwise(dates.short_dates("start", "end", lang, year=True))
    items = first.withColumn("item", _cat(shown("name"), " (", when, ")"))
    at = lambda k, *also: F.max(F.when((F.col("n") == k) & also[0] if also else F.col("n") == k, F.col("item")))
    got = items.groupBy("venue").agg(at(1).alias("one"), at(2, F.col("ahead")).alias("two")).join(counts, "venue")
    both = F.concat_ws(" e " if lang == "pt" else " and ", "one", "two")
    both = F.when(F.length(both) <= 95, both).otherwise(F.col("one"))
    v, k = F.col("venue"), F.col("upcoming").cast("string")
    if lang == "pt":
        title = _cat(v, ": agenda e próximos eventos no Porto")
        ahead = _fitted(_cat(v, " (Porto): a seguir, ", both, "."), F.when(F.col("upcoming") == 1, "Data, preço e bilhetes.").otherwise(_cat(k, " eventos com datas, preços e bilhetes.")))
        past = _fitted(_cat(v, " (Porto): o último evento na nossa agenda foi ", F.col("one"), "."), F.lit("Nada anunciado por agora."), F.lit("Veja o que há no Porto esta semana."))
    else:
        title = _cat(v, ": What's On & Upcoming Events in Porto")
        ahead = _fitted(_cat(v, ", Porto: next up ", both, "."), F.when(F.col("upcoming") == 1, "Date, price and tickets.").otherwise(_cat(k, " upcoming events with dates, prices and tickets.")))
        past = _fitted(_cat("Events at ", v, ", Porto. Most recent: ", F.col("one"), "."), F.lit("Nothing listed right now."), F.lit("See what's on in Porto this week."))
    return got.select("venue", "upcoming", t.clip(title, TITLE + 8).alias("title"), t.clip(F.when(F.col("upcoming") > 0, ahead).otherwise(past), DESCRIPTION).alias("summary"))


def venue_answers(events: DataFrame, today: Column, ties: tuple[str, ...] = ("end",)) -> DataFrame:
    """(venue, upcoming, free, next, next_dates, free_names, answer): what a venue's questions are answered from.

    events: venue, name, start, end, price. ``answer`` tells whether its events
    are free; ``free_names`` are the first three of them. Events of one start
    and name go by the columns ``ties``.
    """
    e = events.filter(F.coalesce("end", "start") >= today).withColumns({"free": prices.is_free("price"), "open": F.col("start") < today})
    by = Window.partitionBy("venue")
    e = e.withColumns({"n": F.row_number().over(by.orderBy("open", "start", "name", *ties)), "k": F.row_number().over(Window.partitionBy("venue", "free").orderBy("start", "name", *ties))})
    running = F.col("open") & F.col("end").isNotNull()
    when = F.when(running, _cat("on now, until ", long_dates("end", "end"))).otherwise(long_dates("start", "end"))
    got = e.groupBy("venue").agg(
        F.count(F.lit(1)).alias("upcoming"),
        F.count_if("free").alias("free"),
        F.max(F.when(F.col("n") == 1, t.humanize(F.trim("name")))).alias("next"),
        F.max(F.when(F.col("n") == 1, when)).alias("next_dates"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("free") & (F.col("k") <= 3), F.struct("k", F.trim("name").alias("name"))))), lambda x: t.humanize(x["name"])), "; ").alias("free_names"),
    )
    n, m = F.col("upcoming").cast("string"), F.col("free").cast("string")
    answer = (
        F.when((F.col("free") == F.col("upcoming")) & (F.col("free") == 1), "Yes, the upcoming event we list is free.")
        .when(F.col("free") == F.col("upcoming"), _cat("Yes, all ", n, " upcoming events we list are free."))
        .when(F.col("free") > 0, _cat(m, " of the ", n, " upcoming events we list ", F.when(F.col("free") == 1, "is").otherwise("are"), " free: ", F.col("free_names"), F.when(F.col("free") > 3, " and more").otherwise(""), ". The price of the others is shown in the list."))
        .otherwise("None of the upcoming events we list is marked as free. Where we have a price, it is shown next to each event.")
    )
    return got.withColumn("answer", answer)
