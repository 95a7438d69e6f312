"""URLs: canonical forms, sites and languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: Last path words of listing pages, parameters of trackers, and language segments.
LISTING_WORD = r"^(agenda|programa|programacao|programação|programme|program|eventos?|events?|calendar|calendario|whats-on|concertos|concerts|espetaculos|bilheteira|tickets?|pt|en)$"
TRACKER = r"^(utm_|fbclid|gclid|mc_|ref=|ref$)"
LANGUAGE = r"^(en|pt|es|fr|de)(-[a-z]{2})?$"
#: Sites that list many venues.
LISTING_HOSTS = (
    "agenda-porto.pt visitporto.travel cm-porto.pt portoalive.pt cm-matosinhos.pt cm-gaia.pt bol.pt ticketline.pt blueticket.pt feverup.com "
    "shotgun.live 3cket.com seetickets.com eventbrite.com eventbrite.pt viralagenda.com xceed.me dice.fm ra.co"
).split()
#: Sites that copy other sites' events.
AGGREGATORS = "agenda-porto.pt viralagenda.com agendaculturalporto.org e-cultura.pt rottacuradoria.com.br portoalive.pt visitporto.travel sustainableliving.pt".split()
_LISTING_PATH = (
    r"(?i)^/(?:[a-z]{2}(?:-[a-z]{2})?/)?(?:agenda|eventos?|events?|programa(?:cao|ção)?|program(?:me)?|calend[aá]rio|calendar|bilheteira|tickets?|"
    r"pesquisa|procurar|search|espetaculos|espectaculos|concertos|shows|whats-on|what-s-on)?/?$"
)


def _part(url: Column | str, part: str) -> Column:
    return F.try_parse_url(col(url), F.lit(part))


def bare_host(url: Column | str) -> Column:
    """Host in lower case without www. (null where the text is no URL)."""
    return F.regexp_replace(F.lower(_part(url, "HOST")), r"^www\.", "")


def _segments(path: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(path, F.lit(""))), "/"), lambda s: s != "")


def normalize_url(url: Column | str) -> Column:
    """host/path?sorted parameters without trackers; null for homepages, listings and other protocols."""
    segs = _segments(_part(url, "PATH"))
    last = F.element_at(segs, -1)
    kept = F.array_sort(F.filter(F.split(F.coalesce(_part(url, "QUERY"), F.lit("")), "&"), lambda p: (p != "") & ~p.rlike(TRACKER)))
    query = F.array_join(kept, "&")
    page = F.concat(bare_host(url), F.lit("/"), F.array_join(segs, "/"), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    web = F.lower(_part(url, "PROTOCOL")).isin("http", "https")
    return F.when(web & (F.size(segs) > 0), F.when(~last.rlike(LISTING_WORD), page))


def site_of(url: Column | str) -> Column:
    """The registrable domain: two labels, three under com, org, gov, edu, co and net."""
    labels = F.split(bare_host(url), "[.]")
    three = (F.size(labels) >= 3) & F.element_at(labels, -2).isin("com", "org", "gov", "edu", "co", "net")
    n = F.when(three, 3).otherwise(F.least(F.lit(2), F.size(labels)))
    return F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")


def url_language(url: Column | str) -> Column:
    """struct(lang, page): the language a URL states, and the page without that mark."""
    segs = _segments(_part(url, "PATH"))
    marks, rest = F.filter(segs, lambda s: s.rlike(LANGUAGE)), F.filter(segs, lambda s: ~s.rlike(LANGUAGE))
    query = F.coalesce(*(F.try_parse_url(col(url), F.lit("QUERY"), F.lit(k)) for k in ("lang", "language", "locale")))
    last = F.coalesce(F.try_element_at(rest, F.lit(-1)), F.lit(""))
    stem, tail = F.regexp_extract(last, "^(.+?)[-_](en|pt)$", 1), F.regexp_extract(last, "^(.+?)[-_](en|pt)$", 2)
    lang = F.coalesce(F.lower(F.left(query, F.lit(2))), F.left(F.try_element_at(marks, F.lit(-1)), F.lit(2)), F.when(tail != "", tail), F.lit(""))
    pages = F.when(stem != "", F.concat(F.slice(rest, F.lit(1), F.size(rest) - 1), F.array(stem))).otherwise(rest)
    return F.when(bare_host(url).isNotNull(), F.struct(lang.alias("lang"), F.concat(site_of(url), F.lit("/"), F.array_join(pages, "/")).alias("page")))


def number_after(url: Column | str, host: str, pattern: str) -> Column:
    """An id in the path of a host's URL."""
    got = F.regexp_extract(F.coalesce(_part(url, "PATH"), F.lit("")), pattern, 1)
    return F.when(F.lower(_part(url, "HOST")).rlike(rf"(^|\.){host}$") & (got != ""), got)


def with_parameter(url: Column | str, name: str, value: str) -> Column:
    """Without utm_ parameters and with one set."""
    base = F.element_at(F.split(F.element_at(F.split(col(url), "#"), 1), r"\?"), 1)
    kept = F.filter(F.split(F.coalesce(_part(url, "QUERY"), F.lit("")), "&"), lambda p: (p != "") & ~p.rlike(rf"^(utm_|{name}=)"))
    return F.concat(base, F.lit("?"), F.array_join(F.concat(kept, F.array(F.lit(f"{name}={value}"))), "&"))


def host_venue(url: Column | str, venues: dict[str, str]) -> Column:
    """The venue a single-venue site belongs to."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in venues.items() for x in kv)), bare_host(url))


def same_page(a: Column | str, b: Column | str) -> Column:
    """One host and path, whatever the query."""
    page = lambda u: F.concat(bare_host(u), F.regexp_replace(F.lower(F.coalesce(_part(u, "PATH"), F.lit(""))), "/+$", ""))
    return page(a) == page(b)


def is_listing(url: Column | str) -> Column:
    """Listing, search and home pages, and texts that are no URL."""
    path, query = F.coalesce(_part(url, "PATH"), F.lit("")), F.coalesce(_part(url, "QUERY"), F.lit(""))
    hit = path.rlike(_LISTING_PATH) | (path == "") | path.rlike(r"(?i)/(?:pesquisa|search)(?:/|$)") | query.rlike(r"(?i)(^|&)(?:q|s|search|query|pesquisa|keyword)=")
    return F.coalesce(F.when(_part(url, "HOST").isNull(), F.lit(True)).otherwise(hit), F.lit(True))


def is_real(url: Column | str) -> Column:
    """An http(s) URL that is no search engine's."""
    host, path = F.lower(_part(url, "HOST")), F.coalesce(_part(url, "PATH"), F.lit(""))
    engine = host.rlike(r"(^|\.)google\.(com|pt)$") | (F.contains(host, F.lit("google.")) & F.startswith(path, F.lit("/search")))
    return F.coalesce(F.lower(_part(url, "PROTOCOL")).isin("http", "https") & ~engine, F.lit(False))


def is_fetchable(url: Column | str) -> Column:
    """Real and no listing."""
    return is_real(url) & ~is_listing(url)


def is_guessed(url: Column | str, sources: Column | str) -> Column:
    """The host is among the sources, the page isn't."""
    host = F.exists(col(sources), lambda s: bare_host(s) == bare_host(url))
    return host & ~F.exists(col(sources), lambda s: same_page(s, url))
