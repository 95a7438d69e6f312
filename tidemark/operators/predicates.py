"""Small predicates and lookups of single pages and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import urls
from ..functions.text import js_regex

#: Copy that talks about the page rather than the event.
META_COPY = js_regex(
    r"\b(?:the|this) (?:web ?)?(?:page|site|website|webpage|listing|text)\b|\bweb ?page\b|\b(?:is|are|was|were) not "
    r"(?:mentioned|stated|specified|provided|given|listed)\b|\bno (?:further |other |more )?(?:details|information) (?:is |are )?(?:given|provided|available|stated)\b"
)
#: Catalog items that are no dated events.
NOT_AN_EVENT = "(?iu)cruise|cruzeiro|boat|barco|tour|visita|passeio|game|jogo|escape|pub crawl|admission|bilhete de entrada|ingresso|menú|menu"
NOT_AN_EVENT_KIND = "(?iu)gift cards|cruises|city tours|tourism|games"
GIFT_CARD = "(?iu)cart[ãa]o[- ](oferta|presente)|gift ?card|vale[- ]presente"
#: Sites that sell tickets themselves.
BIG_TICKETING = (
    r"(^|\.)(ticketline\.pt|ticketline\.sapo\.pt|blueticket\.pt|blueticket\.meo\.pt|bol\.pt|seetickets\.com|eventbrite\.[a-z.]+|feverup\.com|"
    r"livenation\.[a-z.]+|ticketmaster\.[a-z.]+|dice\.fm|xistickets\.com|imperdivel\.pt)$"
)


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def is_meta_copy(text: Column) -> Column:
    """Copy about the page."""
    return text.rlike(META_COPY)


def is_event_like(name: Column, venue: Column, kind: Column, sessions: Column, sold: Column, most: int = 8) -> Column:
    """A catalog item that is a dated event of at most so many sessions."""
    from .classify import is_adult

    return sold & sessions.between(1, most) & ~name.rlike(GIFT_CARD) & ~is_adult(name, venue, kind) & ~name.rlike(NOT_AN_EVENT) & ~kind.rlike(NOT_AN_EVENT_KIND)


def is_home_match(name: Column, venue_slug: Column, team: str, ground: str) -> Column:
    """A home match whose opponent is known."""
    return name.rlike(rf"(?iu)^(fc\s+)?{team}\s+vs\.?\s+") & ~name.rlike(js_regex(r"\bTBD\b|to be (confirmed|decided)")) & (venue_slug == ground)


def needs_update(link: Column, long_text: Column, short_text: Column) -> Column:
    """No real link or a copy missing."""
    return ~urls.is_real(link) | blank(long_text) | blank(short_text)


def needs_translation(short_pt: Column, long_text: Column, long_pt: Column) -> Column:
    """A translation missing."""
    empty = lambda c: F.coalesce(c == "", F.lit(True))
    return empty(short_pt) | (~empty(long_text) & empty(long_pt))


def organizer_offer(category: Column, start: Column, end: Column, venue_slug: Column, link: Column, sold_here: Column, excluded: Column, today: Column) -> Column:
    """Whether an event's page may carry the organizers' offer: eight exclusions."""
    last = F.coalesce(end, start)
    big = F.coalesce(urls.is_real(link) & urls.bare_host(link).rlike(BIG_TICKETING), F.lit(False))
    return ~sold_here & (category != "sports") & (last >= today) & (F.datediff(last, start) <= 3) & ~excluded & ~t.is_vague_venue(venue_slug) & ~big


def low_click_rate(df: DataFrame, impressions: str, rate: str, least: int = 40, most: float = 0.02, n: int = 15, ties: list[str] = ()) -> DataFrame:
    """Pages often shown and seldom opened, the most shown first, then by ``ties``."""
    return df.filter((F.col(impressions) >= least) & (F.col(rate) < most)).orderBy(F.desc(impressions), *ties).limit(n)


def still_on(df: DataFrame, start: str, end: str, today: Column, buffer_days: int, n: int, ties: list[str] = ()) -> DataFrame:
    """Rows still on some days from now: those that start first, then ongoing ones that end soonest."""
    last = F.coalesce(F.col(end), F.col(start))
    later = F.col(start) >= today
    return df.filter(last >= F.date_add(today, buffer_days)).orderBy(F.when(later, 0).otherwise(1), F.when(later, F.col(start)).otherwise(last), *ties).limit(n)


def toggled(items: Column, item: Column) -> Column:
    """A set with an item taken out if it is in, else put in."""
    return F.when(F.array_contains(items, item), F.array_remove(items, item)).otherwise(F.array_append(items, item))


def known(*parts: DataFrame) -> DataFrame:
    """The distinct union of one-column tables."""
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def first_match(value: Column, rules: list[tuple[str, str]]) -> Column:
    """The name of the first pattern a text meets, else the text with single blanks."""
    plain = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " "))
    out = F
    for pattern, name in rules:
        out = out.when(plain.rlike("(?iu)" + pattern), name)
    return out.otherwise(plain)


def photo_credit(url: Column, names: dict[str, str]) -> Column:
    """Whom to credit for a photo: the host's name, else the bare host with a capital."""
    host = urls.bare_host(url)
    bare = F.regexp_replace(host, r"\.[a-z]{2,}$", "")
    shown = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), host), F.concat(F.upper(F.left(bare, F.lit(1))), F.substring(bare, F.lit(2), F.length(bare))))
    return F.concat(F.lit("Photo: "), shown)


def same_listing(a: str, b: str) -> Column:
    """Two listings of one event: one page, or days that meet at one place (or a vague one) with matching names.

    a, b: aliases of tables with the columns of ``matching.prepared``.
    """
    from ..functions.dates import overlaps

    c = lambda p, x: F.col(f"{p}.{x}")
    runs = c(a, "end").isNotNull() & c(b, "end").isNotNull()
    days = F.when(runs, overlaps(c(a, "first_day"), c(a, "last_day"), c(b, "first_day"), c(b, "last_day"), 0)).otherwise(c(a, "first_day") == c(b, "first_day"))
    one = c(a, "venue_key") == c(b, "venue_key")
    m = t.compare_names(c(a, "names"), c(b, "names"), F.when(one, c(a, "venue_key")), F.when(one, c(b, "venue_key")))
    place = one | c(a, "vague") | c(b, "vague")
    return F.coalesce(c(a, "page") == c(b, "page"), F.lit(False)) | F.coalesce(days & place & (m.isin("equal", "similar") | ((m == "contained") & one)), F.lit(False))
