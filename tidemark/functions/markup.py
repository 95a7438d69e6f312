"""Edits of HTML as column expressions: text between tags, headings, anchors and footers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as t
from .text import col

#: Comments, whole elements that hold no prose, tags, and text between them.
_TOKEN = r"(?is)<!--.*?-->|<style.*?</style>|<script.*?</script>|<title.*?</title>|<[^>]+>|[^<]++|<"
#: Tags inside a line of text.
_INLINE = r"(?i)^</?\s*(a|abbr|b|bdi|cite|code|em|i|mark|q|s|small|span|strong|sub|sup|time|u)(?![a-z0-9])"


def humanize_html(html: Column | str) -> Column:
    """As ``text.humanize`` in the text between tags only; a long dash at a block's edge goes."""
    tokens = F.regexp_extract_all(col(html), F.lit(_TOKEN), F.lit(0))

    def edit(x: Column, i: Column) -> Column:
        inline = lambda at: F.coalesce(F.get(tokens, at).rlike(_INLINE), F.lit(False))
        said = F.regexp_replace(F.regexp_replace(x, "(?i)&mdash;|&#8212;|&#x2014;|―", "—"), r"(\S) -- (\S)", "$1 — $2")
        said = F.when(inline(i - 1), said).otherwise(F.regexp_replace(said, r"^(\s*)—\s*", "$1"))
        said = F.when(inline(i + 1), said).otherwise(F.regexp_replace(said, r"\s*—(\s*)$", "$1"))
        return F.when(x.startswith("<"), x).otherwise(t.humanize(said, html=True))

    return F.array_join(F.transform(tokens, edit), "")


def split_before_second(html: Column | str, tag: str = "<h2") -> Column:
    """struct(head, rest), cut before the second ``tag``; null with fewer."""
    h = col(html)
    first = F.instr(h, tag)
    again = F.instr(F.substring(h, first + len(tag), F.length(h)), tag)
    at = first + len(tag) + again - 1
    return F.when((first > 0) & (again > 0), F.struct(F.substring(h, F.lit(1), at - 1).alias("head"), F.substring(h, at, F.length(h)).alias("rest")))


def moved_links(html: Column | str, old: str, new: str) -> Column:
    """Links that begin with ``old`` begin with ``new``; others stay."""
    return F.replace(col(html), F.lit(old), F.lit(new))


def link_titles(html: Column | str, slugs: Column | str, base: str) -> Column:
    """Headings whose whole text is an event's name get a link to its page (X28). slugs: map of lower-case names.

    Titles that are linked already hold a tag, so a second run changes nothing.
    """
    pieces = F.split(col(html), r"(?i)(?=<h[1-6][\s>])|(?<=</h[1-6]>)|(?=<p\b[^>]{0,400}font-family:\s?Georgia)|(?<=</p>)")
    heading = r"(?is)^(<(?:h[1-6]|p)\b[^>]*>)\s*([^<]+?)\s*(</(?:h[1-6]|p)>)$"

    def edit(x: Column) -> Column:
        said = F.regexp_extract(x, heading, 2)
        slug = F.try_element_at(col(slugs), F.lower(t.decode_entities(said)))
        ours = x.rlike(r"(?i)^<h[1-6]|^<p\b[^>]*font-family:\s*Georgia") & (said != "")
        linked = F.concat(F.regexp_extract(x, heading, 1), F.lit(f'<a href="{base}/event/'), slug, F.lit('" style="color:inherit;text-decoration:none;">'), said, F.lit("</a>"), F.regexp_extract(x, heading, 3))
        return F.when(ours & slug.isNotNull(), linked).otherwise(x)

    return F.array_join(F.transform(pieces, edit), "")


def more_info_links(html: Column | str, base: str) -> Column:
    """"More info" anchors lead to the event linked last before them."""
    pieces = F.split(col(html), r"(?i)(?=<a\s)")
    more = r'(?is)^<a\s+href="[^"]+"([^>]*)>\s*(more\s+info[^<]*?)\s*</a>'

    def step(state: Column, x: Column) -> Column:
        own = F.regexp_extract(x, rf'^<a\s+href="{re.escape(base)}/event/([^"]+)"', 1)
        rest = F.regexp_replace(F.regexp_extract(x, more, 1), r"""(?i)\s+(target|rel)\s*=\s*("[^"]*"|'[^']*')""", "")
        moved = F.concat(F.lit(f'<a href="{base}/event/'), state["slug"], F.lit('"'), rest, F.lit(">"), F.regexp_extract(x, more, 2), F.lit("</a>"), F.regexp_replace(x, more, ""))
        put = F.when(x.rlike(more) & state["slug"].isNotNull(), moved).otherwise(x)
        return F.struct(F.array_append(state["out"], put).alias("out"), F.when(own != "", own).otherwise(state["slug"]).alias("slug"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("slug"))
    return F.aggregate(pieces, start, step, lambda s: F.array_join(s["out"], ""))


def with_footer_line(html: Column | str, line: str, mark: str, opt_out: str) -> Column:
    """One line with ``mark`` after the paragraph of the opt-out link: added, or in place of another one; that paragraph itself stays.

    Pages without an opt-out link stay as they are.
    """
    h = col(html)
    at = F.instr(F.lower(h), opt_out.lower())
    before = F.substring(h, F.lit(1), at - 1)
    back = F.instr(F.reverse(before), "p<")
    start = F.when(back > 0, F.length(before) - back).otherwise(at)
    head, tail = F.substring(h, F.lit(1), start - 1), F.substring(h, start, F.length(h))
    old = F.regexp_substr(tail, F.lit(rf"(?is)<p\b[^>]*>(?:(?!</p>).)*{re.escape(mark)}(?:(?!</p>).)*</p>"))
    where, close = F.instr(tail, old), F.instr(tail, "</p>")
    swapped = F.concat(head, F.substring(tail, F.lit(1), where - 1), F.lit(line), F.substring(tail, where + F.length(old), F.length(tail)))
    added = F.concat(head, F.substring(tail, F.lit(1), close + 3), F.lit("\n" + line), F.substring(tail, close + 4, F.length(tail)))
    return F.when(at == 0, h).when(old.isNotNull(), F.when(F.contains(F.lower(old), F.lit(opt_out.lower())), h).otherwise(swapped)).when(close > 0, added).otherwise(h)
