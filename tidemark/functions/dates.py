"""Wall-clock dates and times; "now" is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

ZONE = "Europe/Lisbon"
#: Month and weekday names.
MONTHS_EN = "January February March April May June July August September October November December".split()
MONTHS_PT = "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro".split()
SHORT_PT = "jan fev mar abr mai jun jul ago set out nov dez".split()


def day(c: Column | str) -> Column:
    """The date of a date or date-and-time text."""
    return F.to_date(F.left(col(c), F.lit(10)))


def clock(c: Column | str) -> Column:
    """HH:MM of a date-and-time text, null without one."""
    got = F.regexp_extract(col(c), "T([0-9]{2}:[0-9]{2})", 1)
    return F.when(got != "", got)


def local_wall(instant: Column | str, zone: str = ZONE) -> Column:
    """An instant (timestamp without zone, in UTC) as wall-clock text."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), col(instant).cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm")


def local_day(instant: Column | str, zone: str = ZONE) -> Column:
    """An instant's local date."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), col(instant).cast("timestamp_ntz")))


def to_utc(wall: Column | str, zone: str = ZONE) -> Column:
    """A wall-clock timestamp in UTC (D15). Times that occur twice in autumn are the later ones."""
    w = col(wall).cast("timestamp_ntz")
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), w)
    later = utc + F.expr("INTERVAL 1 HOUR")
    return F.when(F.convert_timezone(F.lit("UTC"), F.lit(zone), later) == w, later).otherwise(utc)


def span_days(start: Column | str, end: Column | str) -> Column:
    """Days from start to end."""
    return F.datediff(col(end), col(start))


def overlaps(a_start, a_end, b_start, b_end, slack: int = 0) -> Column:
    """Closed intervals that meet within ``slack`` days."""
    return (col(a_start) <= F.date_add(col(b_end), slack)) & (col(b_start) <= F.date_add(col(a_end), slack))


def hub_range(kind: str, today: Column) -> Column:
    """struct(from, to) of today or of this weekend, Friday to Sunday."""
    if kind == "today":
        return F.struct(today.alias("from"), today.alias("to"))
    wd = F.weekday(today)  # 0 = Monday
    return F.struct(F.when(wd >= 4, today).otherwise(F.date_add(today, 4 - wd)).alias("from"), F.date_add(today, 6 - wd).alias("to"))


def month_start(d: Column | str) -> Column:
    return F.trunc(col(d), "MM").cast("date")


def month_slug(d: Column | str, lang: str = "en") -> Column:
    """october-2026, outubro-2026."""
    names = [m.lower().replace("ç", "c") for m in (MONTHS_EN if lang == "en" else MONTHS_PT)]
    return F.concat_ws("-", F.element_at(F.array(*map(F.lit, names)), F.month(col(d))), F.year(col(d)).cast("string"))


def month_of_slug(slug: Column | str, lang: str = "en") -> Column:
    """First day of the month a slug names, null for other texts."""
    names = [m.lower().replace("ç", "c") for m in (MONTHS_EN if lang == "en" else MONTHS_PT)]
    name, year = F.regexp_extract(col(slug), "^([a-z]+)-([0-9]{4})$", 1), F.regexp_extract(col(slug), "^([a-z]+)-([0-9]{4})$", 2)
    at = F.array_position(F.array(*map(F.lit, names)), name)
    return F.when(at > 0, F.make_date(year.try_cast("int"), at.cast("int"), F.lit(1)))


def season(today: Column | str) -> Column:
    """struct(year, end): a Christmas season lasts to 6 January."""
    d = col(today)
    year = F.year(d) - F.when((F.month(d) == 1) & (F.dayofmonth(d) <= 6), 1).otherwise(0)
    return F.struct(year.alias("year"), F.make_date(year + 1, F.lit(1), F.lit(6)).alias("end"))


def snap_back(d: Column | str, weekday: int) -> Column:
    """The last such weekday on or before a date; 0 = Monday (D11: 3, D13: 1)."""
    return F.date_sub(col(d), F.pmod(F.weekday(col(d)) - weekday, F.lit(7)))


def week_key(d: Column | str) -> Column:
    """blog-tue-nov-3-2026."""
    t = snap_back(d, 1)
    return F.concat_ws("-", F.lit("blog-tue"), F.lower(F.date_format(t, "MMM")), F.dayofmonth(t).cast("string"), F.year(t).cast("string"))


def edition_windows(today: Column | str) -> Column:
    """struct(next_from, next_to, current_from, current_to): weeks from Thursday to Wednesday."""
    d = col(today)
    thursday = F.next_day(F.date_sub(d, 1), "THU")
    first, last = F.date_add(d, 1), F.date_sub(thursday, 1)
    open_ = (thursday != d) & (first <= last)
    return F.struct(thursday.alias("next_from"), F.date_add(thursday, 6).alias("next_to"), F.when(open_, first).alias("current_from"), F.when(open_, last).alias("current_to"))


def scan_window(today: Column | str, days: int = 70) -> Column:
    """struct(from, to) that a scan covers."""
    w = edition_windows(today)
    return F.struct(F.least(w["next_from"], F.date_add(col(today), 1)).alias("from"), F.date_add(col(today), days).alias("to"))


def week_range(start: Column | str, lang: str = "en") -> Column:
    """July 2-8, 2026; 2-8 de julho de 2026."""
    a, b = col(start), F.date_add(col(start), 6)
    name = lambda d: F.element_at(F.array(*map(F.lit, MONTHS_EN if lang == "en" else MONTHS_PT)), F.month(d))
    num = lambda d: F.dayofmonth(d).cast("string")
    year = F.year(b).cast("string")
    one = F.month(a) == F.month(b)
    if lang == "en":
        return F.when(one, F.concat(name(a), F.lit(" "), num(a), F.lit("-"), num(b), F.lit(", "), year)).otherwise(F.concat(name(a), F.lit(" "), num(a), F.lit(" - "), name(b), F.lit(" "), num(b), F.lit(", "), year))
    return F.when(one, F.concat(num(a), F.lit("-"), num(b), F.lit(" de "), name(a), F.lit(" de "), year)).otherwise(F.concat(num(a), F.lit(" de "), name(a), F.lit(" - "), num(b), F.lit(" de "), name(b), F.lit(" de "), year))


def short_dates(start: Column | str, end: Column | str, lang: str = "en", year: bool = False) -> Column:
    """3 Nov, 3–5 Nov, 30 Nov – 2 Dec."""
    a, b = col(start), F.coalesce(col(end), col(start))
    names = [m[:3] for m in MONTHS_EN] if lang == "en" else SHORT_PT
    mon = lambda d: F.element_at(F.array(*map(F.lit, names)), F.month(d))
    dm = lambda d: F.concat(F.dayofmonth(d).cast("string"), F.lit(" "), mon(d))
    y = lambda d: F.concat(F.lit(" "), F.year(d).cast("string")) if year else F.lit("")
    return (
        F.when(a == b, F.concat(dm(a), y(a)))
        .when(F.year(a) != F.year(b), F.concat(dm(a), y(a), F.lit(" – "), dm(b), y(b)))
        .when(F.month(a) == F.month(b), F.concat(F.dayofmonth(a).cast("string"), F.lit("–"), F.dayofmonth(b).cast("string"), F.lit(" "), mon(a), y(b)))
        .otherwise(F.concat(dm(a), F.lit(" – "), dm(b), y(b)))
    )


def when_text(start: Column | str, end: Column | str, time: Column | str) -> Column:
    """Tue 3 Nov 2026, 21:00; Tue 3 Nov 2026 – Thu 5 Nov 2026 (from 21:00)."""
    f = lambda d: F.concat(F.date_format(d, "E "), F.dayofmonth(d).cast("string"), F.date_format(d, " MMM yyyy"))
    a, b, t = col(start), col(end), col(time)
    run = F.concat(f(a), F.lit(" – "), f(b), F.when(t.isNotNull(), F.concat(F.lit(" (from "), t, F.lit(")"))).otherwise(""))
    return F.when(b > a, run).otherwise(F.concat(f(a), F.when(t.isNotNull(), F.concat(F.lit(", "), t)).otherwise("")))


def calendar_window(start: Column | str, end: Column | str) -> Column:
    """struct(all_day, start, end) of date or date-and-time texts; an all-day end is exclusive."""
    a, b = col(start), F.when(col(end) != "", col(end))
    timed, last = clock(a).isNotNull(), F.coalesce(b, a)
    all_day = (F.coalesce(F.datediff(day(b), day(a)), F.lit(0)) > 1) | ~timed
    own_end = b.isNotNull() & clock(b).isNotNull() & (b > a)
    later = F.date_format(F.left(a, F.lit(16)).try_cast("timestamp_ntz") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm")
    return F.struct(
        all_day.alias("all_day"),
        F.when(all_day, F.left(a, F.lit(10))).otherwise(F.left(a, F.lit(16))).alias("start"),
        F.when(all_day, F.date_add(day(last), 1).cast("string")).when(own_end, F.left(b, F.lit(16))).otherwise(later).alias("end"),
    )


def add_hours(wall: Column | str, hours: int) -> Column:
    """Wall-clock text plus hours, without zones."""
    return F.date_format(F.left(col(wall), F.lit(16)).try_cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(hours)), "yyyy-MM-dd'T'HH:mm")


def drop_midnight(wall: Column | str) -> Column:
    """Without a time of 00:00."""
    return F.regexp_replace(col(wall), "T00:00(:00)?$", "")


def infer_year(month: Column, dom: Column, today: Column) -> Column:
    """The date of a day and month that is not more than a week past."""
    this = F.make_date(F.year(today), month, dom)
    return F.when(this >= F.date_sub(today, 7), this).otherwise(F.make_date(F.year(today) + 1, month, dom))


def quote_has_day(quote: Column | str, d: Column | str) -> Column:
    """Whether a text has the day of the month as a number."""
    return F.exists(F.regexp_extract_all(col(quote), F.lit("[0-9]+"), F.lit(0)), lambda n: (F.length(n) <= 2) & (n.try_cast("int") == F.dayofmonth(col(d))))


def mentions_day(text: Column | str, d: Column | str) -> Column:
    """Whether a text names the day, as 3 November, November 3rd or 3 de novembro."""
    from .text import quote_form

    n = F.dayofmonth(col(d)).cast("string")
    en = F.lower(F.element_at(F.array(*map(F.lit, MONTHS_EN)), F.month(col(d))))
    pt = F.regexp_replace(F.element_at(F.array(*map(F.lit, MONTHS_PT)), F.month(col(d))), "ç", "c")
    pattern = F.concat(F.lit(r"\b"), n, F.lit("(st|nd|rd|th)?( of)? "), en, F.lit(r"\b|\b"), en, F.lit(" "), n, F.lit(r"(st|nd|rd|th)?\b|\b"), n, F.lit(" de "), pt, F.lit(r"\b"))
    return F.regexp_like(quote_form(text), pattern)


def times_in(text: Column | str) -> Column:
    """The distinct clock times a text states, as HH:MM."""
    pattern = r"(?i)[0-9]{1,2}(?:\s*[:h.]\s*[0-9]{2}\s*(?:a\.?m\.?|p\.?m\.?)?|\s*(?:a\.?m\.?|p\.?m\.?|h(?![a-z])))"

    def read(m):
        hour, minute = F.regexp_extract(m, "^([0-9]+)", 1).cast("int"), F.coalesce(F.regexp_extract(m, r"[:hH.]\s*([0-9]{2})", 1).try_cast("int"), F.lit(0))
        h = F.when(m.rlike("(?i)p") & (hour < 12), hour + 12).when(m.rlike("(?i)a") & (hour == 12), 0).otherwise(hour)
        return F.when((h <= 23) & (minute <= 59), F.format_string("%02d:%02d", h, minute))

    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(col(text), F.lit(pattern), F.lit(0)), read), lambda t: t.isNotNull()))


def day_number(d: Column | str, launch: str) -> Column:
    """Days since the launch, from 1."""
    return F.greatest(F.lit(1), F.datediff(col(d), F.lit(launch).cast("date")) + 1)


def minutes_to_midnight(instant: Column | str, zone: str = ZONE) -> Column:
    """Minutes left of the local day."""
    w = F.convert_timezone(F.lit("UTC"), F.lit(zone), col(instant).cast("timestamp_ntz"))
    return 1440 - (F.hour(w) * 60 + F.minute(w))


def kickoff(instant: Column | str, placeholder: str = "11:00:00", zone: str = ZONE) -> Column:
    """A start as wall-clock text, null for the UTC slot that stands for none, to the microsecond."""
    return F.when(F.date_format(col(instant).cast("timestamp_ntz"), "HH:mm:ss.SSSSSS") != f"{placeholder}.000000", local_wall(instant, zone))


def last_fire(now: Column | str, weekday: int, minute: int) -> Column:
    """The last weekly slot at or before an instant; 0 = Monday."""
    n = col(now).cast("timestamp_ntz")
    slot = snap_back(F.to_date(n), weekday).cast("timestamp_ntz") + F.make_dt_interval(mins=F.lit(minute))
    return F.when(slot > n, slot - F.expr("INTERVAL 7 DAYS")).otherwise(slot)


def in_freeze(now: Column | str, weekday: int = 3, first: int = 450, last: int = 1020) -> Column:
    """Whether an instant is in the weekly half-open window of minutes."""
    n = col(now).cast("timestamp_ntz")
    minute = F.hour(n) * 60 + F.minute(n)
    return (F.weekday(n) == weekday) & (minute >= first) & (minute < last)
