"""Prices and numbers in texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: Price texts in the two languages.
FREE_EN = {"gratuito": "Free", "entrada livre": "Free entry", "entrada gratuita": "Free entry", "grátis": "Free"}
LABELS_PT = {
    "free": "Gratuito", "free entry": "Entrada gratuita", "free to explore": "Entrada gratuita", "ticketed": "Com bilhete", "tickets": "Com bilhete",
    "ticket": "Com bilhete", "tickets required": "Com bilhete", "varies": "Preço variável", "price varies": "Preço variável", "check site": "Ver site",
    "check website": "Ver site", "see venue": "Ver local", "mostly free": "Maioritariamente gratuito", "sold out": "Esgotado", "various": "Vários",
    "booking required": "Reserva obrigatória", "registration required": "Inscrição obrigatória",
}
_NUMBER = r"([0-9]+(?:[.,][0-9]{1,2})?)"


def is_free(price: Column | str) -> Column:
    """Free, free entry, entrada livre...; not "free with" (M01)."""
    p = F.lower(F.trim(col(price)))
    return F.coalesce(p.rlike("^(free|entrada (livre|gratuita)|gr[aá]tis|gratuit[oa])") & ~p.rlike(r"^free\s*(with|&)"), F.lit(False))


def lowest_price(price: Column | str, known: Column | str | None = None) -> Column:
    """The known price, else the first number of a text in euros."""
    p = col(price)
    first = F.replace(F.regexp_extract(p, _NUMBER, 1), F.lit(","), F.lit(".")).try_cast("double")
    euros = F.when(~p.rlike(r"US\$|\$|£") & p.rlike("(?i)€|eur"), first)
    return euros if known is None else F.coalesce(col(known).cast("double"), euros)


def price_band(price: Column | str | None, known: Column | str | None = None) -> Column:
    """free, under-15, 15-30, over-30, or null."""
    text = F.lit(None).cast("string") if price is None else col(price)
    n = lowest_price(text, known)
    return F.when(is_free(text) | (n == 0), "free").when(n < 15, "under-15").when(n <= 30, "15-30").when(n > 30, "over-30")


def numbers_in(text: Column | str) -> Column:
    """All numbers of a text."""
    return F.transform(F.regexp_extract_all(col(text), F.lit(_NUMBER), F.lit(1)), lambda n: F.replace(n, F.lit(","), F.lit(".")).try_cast("double"))


def tidy_euros(price: Column | str) -> Column:
    """Euro amounts as €5, ranges as €5–€10."""
    n = r"([0-9]+(?:[.,][0-9]{1,2})?)"
    out = F.trim(col(price))
    out = F.regexp_replace(out, rf"(?i)^€?\s?{n}\s?€?\s*(?:–|-|a|to)\s*€?\s?{n}\s?(?:€|euros?)$", "€$1–€$2")
    out = F.regexp_replace(out, rf"€\s?{n}\s*(?:–|-)\s*€\s?{n}", "€$1–€$2")
    out = F.regexp_replace(out, rf"(?i)(^|\s){n}\s?(?:€|euros?\b)", "$1€$2")
    out = F.regexp_replace(out, rf"€\s{n}", "€$1")
    return F.regexp_replace(out, r"(€[0-9]+)[.,]00(?![0-9])", "$1")


def price_label(price: Column | str, lang: str) -> Column:
    """A price text in the page's language."""
    p = F.coalesce(tidy_euros(price), F.lit(""))
    table = FREE_EN if lang == "en" else LABELS_PT
    known = F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.lower(p))
    if lang == "en":
        rest = F.when(p.rlike("(?i)^tickets?$"), "Ticketed").otherwise(F.regexp_replace(p, r"(?i)^A partir de\s+", "From "))
    else:
        rest = F.regexp_replace(F.regexp_replace(p, r"(?i)^Tickets from\s+", "Bilhetes a partir de "), r"(?i)^From\s+", "A partir de ")
    return F.coalesce(known, rest)


def catalog_price(price: Column | str, currency: Column | str, free: Column | str) -> Column:
    """Free, an amount in euros, or null for other currencies."""
    n = col(price).cast("double")
    amount = F.concat(F.lit("€"), F.when(n % 1 == 0, n.cast("long").cast("string")).otherwise(F.format_string("%.2f", n)))
    return F.when(col(free), "Free").when(col(price).isNotNull() & (col(currency) == "EUR"), F.concat(F.lit("From "), amount))


def pick_score(candidate: Column | str, real_link: Column | str, image: Column | str) -> Column:
    """4, 2 and 1 points."""
    points = lambda c, n: F.when(col(c), n).otherwise(0)
    return points(candidate, 4) + points(real_link, 2) + points(image, 1)


def rounded(x: Column) -> Column:
    """Half up towards positive infinity, as percentages are rounded (§ rounding)."""
    return F.floor(x + 0.5)


def percent_change(now: Column | str, before: Column | str) -> Column:
    """+12%, -3%, "new" from nothing, a dash for nothing from nothing."""
    n, b = col(now), col(before)
    p = rounded((n - b) / F.nullif(b, F.lit(0)) * 100)
    return F.when((b == 0) & (n > 0), "new").when(b == 0, "—").otherwise(F.concat(F.when(p >= 0, "+").otherwise(""), p.cast("string"), F.lit("%")))
