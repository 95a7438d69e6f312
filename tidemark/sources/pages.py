"""Web pages: text, cards, linked data, images."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import decode_entities
from ..plans.shipping import by_value

by_value(__name__)

#: Texts longer than MOST are cut; of LEAST characters or fewer they count as none.
MOST, LEAST = 40_000, 200


def page_text(html: Column, most: int | None = MOST) -> Column:
    """Visible text of a page."""
    out = F.regexp_replace(html, r"(?is)<(script|style|noscript).*?</\1>", " ")
    out = F.regexp_replace(out, r"(?is)<[^>]+>", " ")
    out = F.trim(F.regexp_replace(decode_entities(out), r"\s+", " "))
    return F.left(out, F.lit(most)) if most else out


def page_record(html: Column) -> Column:
    """struct(text, reason): the text, or why there is none (S26, E02's gate)."""
    t = page_text(html)
    return F.when(F.length(t) > LEAST, F.struct(t.alias("text"), F.lit(None).cast("string").alias("reason"))).otherwise(F.struct(F.lit(None).cast("string").alias("text"), F.concat(F.lit("too little text ("), F.length(t).cast("string"), F.lit(")")).alias("reason")))


def title_of(html: Column, decode: Callable[[Column], Column] = decode_entities) -> Column:
    """The title element's text. ``decode``: which entities are read as characters."""
    return F.trim(decode(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def heading_text(html: Column) -> Column:
    """Text of a heading without tags."""
    return F.trim(F.regexp_replace(decode_entities(F.regexp_replace(html, r"(?is)<[^>]+>", "")), r"\s+", " "))


def best_image(html: Column) -> Column:
    """The page's image: og:image, else twitter:image, else image_src, else the first jpg, png or webp."""
    meta = lambda key: F.regexp_extract(html, rf"(?is)<meta[^>]+(?:property|name)=[\"']{key}[\"'][^>]+content=[\"']([^\"']+)", 1)
    found = [meta("og:image"), meta("twitter:image"), F.regexp_extract(html, r"(?is)<link[^>]+rel=[\"']image_src[\"'][^>]+href=[\"']([^\"']+)", 1), F.regexp_extract(html, r"(?is)<img[^>]+src=[\"']([^\"']+\.(?:jpe?g|png|webp)[^\"']*)", 1)]
    return F.coalesce(*(F.when(x != "", x) for x in found))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)<a[^>]+href=[\"']([^\"'#][^\"']*)"), F.lit(1))


def embeddable(html: Column) -> Column:
    """Style elements and the body's content of a document."""
    head = F.regexp_extract(html, r"(?is)<head[^>]*>(.*?)</head>", 1)
    styles = F.array_join(F.regexp_extract_all(head, F.lit(r"(?is)<style[^>]*>.*?</style>"), F.lit(0)), "\n")
    body = F.regexp_extract(html, r"(?is)<body[^>]*>(.*?)</body>", 1)
    return F.when(body != "", F.concat(styles, F.lit("\n"), body)).otherwise(F.regexp_replace(html, r"(?is)<!DOCTYPE[^>]*>|</?html[^>]*>|<head[^>]*>.*?</head>|</?body[^>]*>", ""))


def strip_footer(html: Column) -> Column:
    """Without e-mail footers."""
    out = html
    for pattern in (r"(?is)<!--\s*FOOTER\s*-->.*?<!--\s*END\s+FOOTER\s*-->", r"(?is)<(td|div)\s+class=\"footer\"[^>]*>.*?</\1>", r"(?is)<p[^>]*>[^<]{0,200}(?:unsubscribe|manage\s+your\s+preferences|receiving\s+this\s+email)[^<]{0,200}</p>"):
        out = F.regexp_replace(out, pattern, "")
    return out


def cards(df: DataFrame, key: str, html: str, pattern: str, fields: list[str]) -> DataFrame:
    """One row per match of a card pattern, its groups as fields, in order."""
    whole = F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(0))
    rows = df.select(key, F.posexplode(whole).alias("n", "_card"))
    return rows.select(key, "n", *(F.trim(F.regexp_extract("_card", pattern, k + 1)).alias(f) for k, f in enumerate(fields)))


def _events(node) -> list[dict]:
    """Event objects anywhere in linked data."""
    if isinstance(node, list):
        return [e for x in node for e in _events(x)]
    if not isinstance(node, dict):
        return []
    kinds = node.get("@type") or ""
    mine = [node] if any(str(k).endswith("Event") or str(k) == "Festival" for k in (kinds if isinstance(kinds, list) else [kinds])) else []
    return mine + [e for v in node.values() if isinstance(v, dict | list) for e in _events(v)]


def _of(node, *path) -> str | None:
    for k in path:
        if isinstance(node, list):
            node = node[0] if node else None
        node = node.get(k) if isinstance(node, dict) else None
    return node if isinstance(node, str) else str(node) if isinstance(node, int | float) else None


def linked_events(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, name, start, end, venue, city, price, description) of a page's JSON-LD events."""
    script = re.compile(r"<script[^>]+application/ld\+json[^>]*>(.*?)</script>", re.I | re.S)

    def rows(batches):
        for pdf in batches:
            out = []
            for k, text in zip(pdf[key], pdf[html], strict=True):
                for block in script.findall(text or ""):
                    try:
                        found = _events(json.loads(block))
                    except ValueError:
                        continue
                    out += [(k, _of(e, "name"), _of(e, "startDate"), _of(e, "endDate"), _of(e, "location", "name"), _of(e, "location", "address", "addressLocality"), _of(e, "offers", "price"), _of(e, "description")) for e in found]
            yield pd.DataFrame(out, columns=[key, "name", "start", "end", "venue", "city", "price", "description"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, html).mapInPandas(rows, f"{key} {kind}, name string, start string, end string, venue string, city string, price string, description string")


def page_state(html: Column, script_id: str, schema: str) -> Column:
    """The state that a page carries as JSON in a script of some id, by schema; null where it has none or it is no JSON."""
    text = F.regexp_extract(html, rf"(?is)<script[^>]+id=[\"']{script_id}[\"'][^>]*>(.*?)</script>", 1)
    return F.when(text != "", F.from_json(text, schema, {"mode": "PERMISSIVE"}))
