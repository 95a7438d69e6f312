"""Repeated records of listing pages: cards, rows and items mined from a page's own tag tree.

A page's elements are told by their tag paths. Elements of one path that stand
beside each other are taken for records of a group; what they hold (texts,
links, dates) is aligned by the path inside the record and its number there.
Places that at least half of the records have make the group's template, and a
record is one of the group if it has half of the template. Fields are read by
place, so nothing about a site has to be known but which place is which.

Only the reading of tags is Python; groups, templates and alignment are
DataFrame aggregates of ids, and texts are joined to the records at the end.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import MONTHS_EN, MONTHS_PT
from ..functions.text import col, let
from ..plans.shipping import by_value

by_value(__name__)

#: Fixed values of HTML: elements without content, elements whose content is no markup, and which start tags end which open elements.
VOID = "area base br col embed hr img input link meta param source track wbr".split()
RAW = "script style noscript template textarea title".split()
BLOCKS = "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
ENDS = {"li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "option": ["option"], "tr": ["tr", "td", "th"], "td": ["td", "th"], "th": ["td", "th"], "tbody": ["tr", "td", "th", "tbody", "thead"], **{b: ["p"] for b in BLOCKS}}
#: An open element of these isn't ended from inside of another such one.
WALLS = {"ul", "ol", "menu", "dl", "table", "select", "html", "body", "td", "th", "caption", "button"}
#: Attributes that are values, beside the texts.
ATTRIBUTES = ("href", "datetime")
#: Elements nested deeper count as children of the last one that isn't; a record reaches so many levels above its values at most.
DEEPEST, LEVELS = 128, 8
#: Records that make a group.
LEAST = 3
#: Values, and characters of them and their paths, that are handed on at once; tags of the paths whose hashes are kept.
LOT, LOT_CHARS, KEPT_TAGS = 2_000, 1 << 20, 200_000

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>|<![^<>]*>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


def _hash(parts: tuple[str, ...]) -> int:
    return int.from_bytes(hashlib.blake2b("/".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def page_values(text: str) -> Iterator[tuple[int, tuple[str, ...], str, list[tuple[int, str]]]]:
    """(number, path, value, open elements) of every text and link of a page, in order.

    Elements and values are numbered together. Optional end tags are supplied,
    end tags of nothing open are passed over, contents of scripts and the like
    are left out.
    """
    stack: list[tuple[int, str]] = []
    number = at = 0
    low = None

    def value(kind: str, found: str):
        nonlocal number
        found = " ".join(entities.unescape(found).split())
        if found:
            number += 1
            yield number, (*(t for _, t in stack), kind), found, stack

    pos = 0
    while m := _TAG.search(text, pos):
        yield from value("#text", text[at : m.start()])
        at = pos = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][1] == tag:
                    del stack[k:]
                    break
            continue
        ends = ENDS.get(tag)
        if ends:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][1] in ends:
                    del stack[k:]
                    if "td" not in ends:  # a row ends its cell and the row before
                        break
                elif stack[k][1] in WALLS:
                    break
        number += 1
        held = len(stack) < DEEPEST
        if held:
            stack.append((number, tag))
        if "=" in m[3]:
            for a in _ATTRIBUTE.finditer(m[3]):
                if a[1].lower() in ATTRIBUTES:
                    yield from value("@" + a[1].lower(), a[2] or a[3] or a[4] or "")
        if tag in RAW and not m[3].endswith("/"):
            low = low if low is not None else text.lower()
            end = low.find("</" + tag, pos)
            at = pos = len(text) if end < 0 else end
        if held and (tag in VOID or m[3].endswith("/")):
            stack.pop()
    yield from value("#text", text[at:])


_UP = pa.struct([("record", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("group", pa.int64()), ("inside", pa.int64())])


def cell_batches(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The cells of batches of (key, page, html), in lots: a batch of pages holds thousands of times the rows of a page, and a page has no bound."""
    hashes: dict[tuple[str, ...], int] = {}
    tags = 0

    def of(parts: tuple[str, ...]) -> int:
        nonlocal tags
        if (found := hashes.get(parts)) is None:
            tags += len(parts) + 1
            if tags > KEPT_TAGS:
                hashes.clear()
                tags = len(parts) + 1
            found = hashes[parts] = _hash(parts)
        return found

    for batch in batches:
        columns: tuple[list, ...] = ([], [], [], [], [])
        ends, ups, chars = [0], ([], [], [], [], []), 0

        def lot() -> pa.RecordBatch:
            nonlocal columns, ends, ups, chars
            rows, page, node, path, value = columns
            up = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(ups, _UP, strict=True)], fields=list(_UP)))
            own = batch.column(0).take(pa.array(rows, pa.int64()))
            out = pa.RecordBatch.from_arrays([own, pa.array(page, pa.int64()), pa.array(node, pa.int32()), pa.array(path, pa.string()), pa.array(value, pa.string()), up], names=names)
            columns, ends, ups, chars = ([], [], [], [], []), [0], ([], [], [], [], []), 0
            return out

        for k in range(batch.num_rows):
            own = batch.column(1)[k].as_py()
            for n, parts, found, stack in page_values(batch.column(2)[k].as_py() or ""):
                path = "/".join(parts)
                rows, page, node, paths, value = columns
                rows.append(k)
                page.append(own)
                node.append(n)
                paths.append(path)
                value.append(found)
                record, parent, depth, group, inside = ups
                deep = len(stack)
                for d in range(max(1, deep - LEVELS), deep):  # the root is nobody's sibling
                    record.append(stack[d][0])
                    parent.append(stack[d - 1][0])
                    depth.append(d + 1)
                    group.append(of(parts[: d + 1]))
                    inside.append(of(parts[d + 1 :]))
                ends.append(len(record))
                chars += len(path) + len(found)
                if len(ends) > LOT or chars > LOT_CHARS:
                    yield lot()
        if len(ends) > 1:
            yield lot()


def page_cells(df: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, page, node, path, value, up): one row per value of each page.

    ``up``: the elements around it, as what a record would be: its number, its
    parent's, its depth, the hash of its path and of the path inside it.
    """
    up = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("record", T.IntegerType()), ("parent", T.IntegerType()), ("depth", T.IntegerType()), ("group", T.LongType()), ("inside", T.LongType()))]))
    schema = T.StructType([df.schema[key], T.StructField("page", T.LongType()), T.StructField("node", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("value", T.StringType()), T.StructField("up", up)])
    names = schema.names
    return df.select(key, F.xxhash64(F.col(key), F.col(html)).alias("page"), F.col(html)).mapInArrow(lambda batches: cell_batches(batches, names), schema)


def mined_records(df: DataFrame, key: str = "page_id", html: str = "html", least: int = LEAST) -> DataFrame:
    """(key, group, n, fields, places): the records of every group of every page.

    ``group``: the records' tag path. ``n``: a record's number in its group, from
    0. ``fields``: its values by the template's places in order, null where it
    has none. ``places``: what each place is, as path inside the record and
    number there. A group has ``least`` records or more, two of one parent at
    least. A place belongs to the template if half of the records have it; a
    record with less than half of the template is left out. Groups may lie
    inside each other: ``main_groups`` picks one a page. Null and empty pages
    have none; rows that repeat key and page are one page.
    """
    cells = page_cells(df, key, html)
    tried = cells.select("page", "node", F.explode("up").alias("u")).select("page", "node", "u.*")
    nth = F.dense_rank().over(Window.partitionBy("page", "record", "inside").orderBy("node"))
    tried = tried.withColumn("nth", nth).groupBy("page", "group", "record", "inside", "nth").agg(F.min("node").alias("node"), F.first("parent").alias("parent"), F.first("depth").alias("depth"))
    # A record has any number of places: count each record once, by its first one.
    once = tried.groupBy("page", "group", "parent", "record").agg(F.lit(1).alias("one"))
    groups = once.groupBy("page", "group", "parent").agg(F.count("one").alias("siblings")).groupBy("page", "group").agg(F.sum("siblings").alias("n_records"), F.max("siblings").alias("most"))
    groups = groups.filter((F.col("n_records") >= least) & (F.col("most") >= 2)).select("page", "group", "n_records")
    kept = tried.join(groups, ["page", "group"])
    places = kept.groupBy("page", "group", "inside", "nth").agg(F.count(F.lit(1)).alias("have"), F.first("n_records").alias("n_records"), F.min(F.col("node") - F.col("record")).alias("off"))
    places = places.filter(2 * F.col("have") >= F.col("n_records"))
    at = Window.partitionBy("page", "group")
    places = places.withColumn("place", F.row_number().over(at.orderBy("off", "inside", "nth"))).withColumn("n_places", F.count(F.lit(1)).over(at))
    found = kept.join(places.select("page", "group", "inside", "nth", "place", "n_places"), ["page", "group", "inside", "nth"])
    values = cells.select(F.col(key).alias("_key"), "page", "node", "path", "value").dropDuplicates(["page", "node"])
    found = found.join(values, ["page", "node"])
    path = F.split("path", "/")
    cell = F.struct("place", "value", F.concat(F.array_join(F.slice(path, F.col("depth") + 1, F.size(path)), "/"), F.lit("#"), F.col("nth").cast("string")).alias("name")).alias("cell")
    path_of = F.array_join(F.slice(path, F.lit(1), F.col("depth")), "/")
    records = found.groupBy("page", "group", "record").agg(F.first("_key").alias(key), F.min(path_of).alias("path"), F.first("n_places").alias("n_places"), F.collect_list(cell).alias("cells"))
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform("cells", lambda c: F.struct(c["place"], c["name"]))).over(at))))
    records = records.withColumn("names", names).filter(2 * F.size("cells") >= F.col("n_places"))
    by_place = F.map_from_entries(F.transform("cells", lambda c: F.struct(c["place"], c["value"])))
    slots = F.sequence(F.lit(1), F.col("n_places").cast("int"))
    n = (F.row_number().over(at.orderBy("record")) - 1).cast("int")
    return records.select(
        key, F.col("path").alias("group"), n.alias("n"), F.transform(slots, lambda k: F.try_element_at(by_place, k)).alias("fields"), F.transform("names", lambda c: c["name"]).alias("places")
    )


def main_groups(records: DataFrame, key: str = "page_id") -> DataFrame:
    """The records of each page's main group: the one of the most values in different places.

    A place that repeats inside a record counts once, so a row of cards doesn't
    beat the cards. Ties go to the shorter path, then by path.
    """
    kinds = F.size(F.array_distinct(F.transform("places", lambda p: F.regexp_replace(p, "#[0-9]+$", ""))))
    sized = records.groupBy(key, "group").agg((F.count(F.lit(1)) * F.max(kinds)).alias("size"))
    first = Window.partitionBy(key).orderBy(F.desc("size"), F.length("group"), "group")
    best = sized.withColumn("k", F.row_number().over(first)).filter("k = 1").select(F.col(key).alias("_key"), F.col("group").alias("_group"))
    return records.join(best, F.col(key).eqNullSafe(F.col("_key")) & (F.col("group") == F.col("_group")), "left_semi")


def _month_numbers() -> dict[str, int]:
    """Months by their names and shortened names, English and Portuguese."""
    pairs = [(n.lower(), k % 12 + 1) for k, n in enumerate(MONTHS_EN + MONTHS_PT)]
    return {**{n: k for n, k in pairs}, **{n[:3]: k for n, k in pairs}, "sept": 9}


def listed_days(text: Column | str, today: Column) -> Column:
    """struct(start, end, time, month_only) of a listing's date text; null if it names none.

    Read are day and month in either order, numeric days (12.06.2026), ranges of
    two days of a month (12 e 13 jun) or of two months (12 jan – 3 mar 2027,
    also 12 jan 3 mar), with a year or without. A start without a month has that
    of the end, one without a year that of the end or, if its month is later,
    the year before. An end without a year is the next such day, at most a week
    past (D18). A month alone begins at its first day and ends at its last, and
    month_only says that the end's day isn't known.
    """
    number = _month_numbers()
    months = F.create_map(*(F.lit(x) for kv in number.items() for x in kv))
    word = "(?:" + "|".join(sorted(number, key=lambda n: (-len(n), n))) + r")(?![a-zç])\.?"
    # A point is a numeric day, a day with a month, a month with a day, or a month with a year. Groups: d m y, d m y, m d y, m y.
    point = "|".join((
        r"\b([0-9]{1,2})[./-]([0-9]{1,2})[./-]([0-9]{4})\b",
        rf"\b([0-9]{{1,2}})(?:st|nd|rd|th|º)? ?(?:de |of )?({word})(?:,? (?:de )?([0-9]{{4}})\b)?",
        rf"\b({word}) ([0-9]{{1,2}})(?:st|nd|rd|th)?\b(?![:h])(?:,? ([0-9]{{4}})\b)?",
        rf"\b({word})(?: (?:de )?([0-9]{{4}})\b| ?(?=[–—-]|$))",
    ))
    lone = rf"\b([0-9]{{1,2}}) ?(?:e|a|and|to|&|–|—|-) ?[0-9]{{1,2}}(?:st|nd|rd|th|º)? ?(?:de |of )?{word}"

    def read(p):
        group = lambda *ks: F.coalesce(*(F.when(F.regexp_extract(p, point, k) != "", F.regexp_extract(p, point, k)) for k in ks))
        named = F.try_element_at(months, F.rtrim(group(5, 7, 10), F.lit(".")))
        return F.struct(group(1, 4, 8).cast("int").alias("d"), F.coalesce(group(2).cast("int"), named).alias("m"), group(3, 6, 9, 11).cast("int").alias("y"))

    real = lambda y, m, d: F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")  # noqa: E731  31 June is none

    def with_end(x):
        a, b = x["a"], x["b"]
        coming = lambda: F.when(real(F.year(today), b["m"], b["d"]) >= F.date_sub(today, 7), real(F.year(today), b["m"], b["d"])).otherwise(real(F.year(today) + 1, b["m"], b["d"]))
        last = F.when(b["d"].isNull(), F.last_day(real(b["y"], b["m"], F.lit(1)))).when(b["y"].isNotNull(), real(b["y"], b["m"], b["d"])).otherwise(coming())
        return F.struct(a.alias("a"), last.alias("end"), b["d"].isNull().alias("month_only"))

    def with_start(x, t, two):
        a, end = x["a"], x["end"]
        year = F.coalesce(a["y"], F.when(a["m"] <= F.month(end), F.year(end)).otherwise(F.year(end) - 1))
        before = F.when(~two, F.regexp_extract(t, lone, 1).try_cast("int"))
        start = real(year, a["m"], F.coalesce(before, a["d"], F.lit(1)))
        return let(F.struct(start.alias("start"), x["end"].alias("end"), clock_of(t).alias("time"), x["month_only"].alias("month_only")), lambda r: F.when(r["start"] <= r["end"], r))

    def clock_of(t):
        part = lambda k: F.regexp_extract(t, r"\b([01]?[0-9]|2[0-3])[:h]([0-5][0-9])(?: ?([ap])\.?m)?", k)
        h = part(1).try_cast("int")
        hour = F.when((part(3) == "p") & (h < 12), h + 12).when((part(3) == "a") & (h == 12), 0).otherwise(h)
        return F.when(h.isNotNull(), F.format_string("%02d:%s", hour, part(2)))

    def of_text(t):
        ends = F.transform(F.slice(F.regexp_extract_all(t, F.lit(point), F.lit(0)), 1, 2), read)
        pair = lambda e: F.struct(F.get(e, 0).alias("a"), F.coalesce(F.get(e, 1), F.get(e, 0)).alias("b"), (F.size(e) > 1).alias("two"))
        return let(let(ends, pair), lambda x: let(with_end(x), lambda y: with_start(y, t, x["two"])))

    return let(F.lower(F.regexp_replace(col(text), r"\s+", " ")), of_text)


def listed_events(records: DataFrame, today: Column, key: str = "page_id", title: int | None = None, venue: int | None = None, when: int | None = None) -> DataFrame:
    """(key, n, link, title, venue, start, end, time, month_only): dated cards of mined records, the first of each link.

    ``title``, ``venue``, ``when``: their places in ``fields``, from 0. Without
    them, the date is the first field that names one (or, where day, month and
    year have places of their own, all fields together), and the title the first
    other text. Records without a link or a date are none.
    """
    links = F.filter(F.arrays_zip("places", "fields"), lambda x: x["places"].rlike("@href#"))
    link = F.get(F.transform(links, lambda x: x["fields"]), 0)
    texts = F.filter(F.transform(F.filter(F.arrays_zip("places", "fields"), lambda x: x["places"].rlike("#text#|@datetime#")), lambda x: x["fields"]), lambda x: x.isNotNull())
    at = lambda k: F.get("fields", k)
    if when is None:
        own = F.get(F.filter(F.transform(texts, lambda x: listed_days(x, today)), lambda x: x.isNotNull()), 0)
        days = F.coalesce(own, listed_days(F.array_join(texts, " "), today))
        named = F.get(F.filter(texts, lambda x: listed_days(x, today).isNull() & ~x.rlike(r"^[0-9]{1,4}$")), 0)
    else:
        days, named = listed_days(at(when), today), F.get(texts, 0)
    cut = records.select(key, "n", link.alias("link"), (at(title) if title is not None else named).alias("title"), (at(venue) if venue is not None else F.lit(None).cast("string")).alias("venue"), days.alias("_days"))
    cut = cut.filter(F.col("link").isNotNull() & F.col("_days").isNotNull()).select("*", "_days.*").drop("_days")
    first = Window.partitionBy("link").orderBy(F.col(key).asc_nulls_last(), "n", "title")
    return cut.withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k")
