"""Names, slugs and tokens as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that don't tell one event from another.
STOP_WORDS = (
    "the a an and of in at on for with by to o os as de da do das dos e em no na nos nas com um uma el la los las del y en con "
    "porto oporto exhibition exhibit exposicao exposicion expo mostra show retrospective retrospectiva "
    "opening inauguracao vernissage final last days chance closing"
).split()
#: The shorter list of the looser name test.
SCAN_STOP_WORDS = "the a and of in at porto o de da do das dos e em no na live tour festival concert concerto exhibition exposicao".split()
#: Spellings folded to one form.
FOLDED = {
    "sinfonia": "symphony", "sinfonica": "symphony", "symphonic": "symphony", "orgao": "organ", "orquestra": "orchestra", "orquesta": "orchestra",
    "coro": "choir", "maratona": "marathon", "natal": "christmas", "noite": "night", "mercado": "market", "feira": "fair", "danca": "dance",
    "teatro": "theatre", "theater": "theatre", "jardim": "garden", "luz": "light", "concerto": "concert", "concertos": "concert", "concerts": "concert",
    "bailado": "ballet",
}
#: Words of rooms; a venue named by them alone is no venue of its own.
ROOM_WORDS = (
    "library biblioteca auditorium auditorio garden gardens jardim jardins sala salao room hall foyer lobby terrace terraco cafe bar lounge "
    "museum museu gallery galeria park parque studio estudio stage palco cinema chapel capela cloister claustro courtyard patio atrium main grand "
    "great small big little pequeno pequena grande principal upper lower ground floor piso the do da de dos das of at"
).split()
#: Placeholders that stand for no single venue.
PLACEHOLDER_VENUE = r"^(tbc|tbd|tba|venue-tb[acd]|porto|online|downtown|downtown-porto|central-porto)$|^(various|multiple|city)-|-various$"
VAGUE_VENUE = r"(^|-)(various|multiple|varies|vary|tbc|tbd)(-|$)"
VAGUE_FOR_IDENTITY = r"(^|-)(varios|diversos)-(locais|lugares|espacos)(-|$)"


def js_regex(pattern: str, ignore_case: bool = True) -> str:
    """A pattern with ASCII word borders and, if asked for, case folding over all letters."""
    edge = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    return ("(?iu)" if ignore_case else "") + pattern.replace(r"\b", edge)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _base_letters() -> tuple[str, str]:
    """Letters of the Latin blocks that decompose to one ASCII letter plus marks, and those letters."""
    pairs = []
    for point in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(point)) if not 0x300 <= ord(c) <= 0x36F)
        if len(base) == 1 and base != chr(point):
            pairs.append((chr(point), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _base_letters()


def strip_marks(c: Column | str) -> Column:
    """Drop diacritics; letters that don't decompose stay."""
    return F.regexp_replace(F.translate(col(c), _FROM, _TO), "[\\u0300-\\u036f]", "")


def kebab(c: Column | str) -> Column:
    """Lower case without diacritics and apostrophes, all else than a-z and 0-9 to single dashes."""
    plain = F.regexp_replace(strip_marks(F.lower(col(c))), "['’]", "")
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def search_form(c: Column | str) -> Column:
    """As kebab with single spaces, euro sign kept."""
    return F.trim(F.regexp_replace(strip_marks(F.lower(col(c))), "[^a-z0-9€]+", " "))


def game_form(c: Column | str) -> Column:
    """As kebab with single spaces."""
    return F.trim(F.regexp_replace(strip_marks(F.lower(col(c))), "[^a-z0-9]+", " "))


def quote_form(c: Column | str) -> Column:
    """The form in which quotes are looked up on a page."""
    bare = F.regexp_replace(strip_marks(F.lower(col(c))), "[’'`\"“”«»]", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def on_page(quote: Column | str, page: Column | str) -> Column:
    """Whether a quote of two or more characters stands on the page."""
    q = quote_form(quote)
    return F.coalesce((F.length(q) >= 2) & F.contains(quote_form(page), q), F.lit(False))


def venue_slug(c: Column | str) -> Column:
    """Slug of a venue without what follows a comma or slash and without a room at the end."""
    root = F.trim(F.element_at(F.split(col(c), "[,/]"), 1))
    return kebab(F.trim(F.regexp_replace(root, r"(?iu)\s+(Café|Cafe|Sala\s+\w+|Main\s+Hall|Auditorium\s+\w+)$", "")))


def has_venue_page(slug: Column | str) -> Column:
    """Whether a slug stands for a place of its own."""
    return F.coalesce((col(slug) != "") & ~col(slug).rlike(PLACEHOLDER_VENUE), F.lit(False))


def is_vague_venue(slug: Column | str, for_identity: bool = False) -> Column:
    """Whether a slug is a placeholder or several places."""
    vague = ~has_venue_page(slug) | F.coalesce(col(slug).rlike(VAGUE_VENUE), F.lit(True))
    return vague | F.coalesce(col(slug).rlike(VAGUE_FOR_IDENTITY), F.lit(False)) if for_identity else vague


def is_generic_room(venue: Column | str) -> Column:
    """Whether a name consists of room words and numbers only."""
    words = F.filter(F.split(kebab(venue), "-"), lambda w: w != "")
    return (F.size(words) > 0) & F.forall(words, lambda w: w.isin(ROOM_WORDS) | w.rlike("^[0-9]+$"))


def _lookup(word: Column, table: Mapping[str, str]) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, word), word)


def name_tokens(name: Column | str, venue: Column | str | None = None, stop=STOP_WORDS, folded: Mapping[str, str] = FOLDED) -> Column:
    """Distinct telling words of a name; words of the venue go unless none would be left."""
    words = F.filter(F.split(kebab(name), "-"), lambda t: (F.length(t) > 1) & ~t.isin(list(stop)) & ~t.rlike("^[0-9]{4}$"))
    if folded:
        words = F.transform(words, lambda t: _lookup(t, folded))
    words = F.array_distinct(words)
    if venue is None:
        return words
    of_venue = F.split(F.coalesce(col(venue), F.lit("")), "-")
    if folded:
        of_venue = F.transform(of_venue, lambda t: _lookup(t, folded))
    rest = F.array_except(words, of_venue)
    return F.when(F.size(rest) > 0, rest).otherwise(words)


def compare_tokens(a: Column | str, b: Column | str) -> Column:
    """equal, similar (Jaccard 0.6 or more), contained (two or more shared, one within the other) or null."""
    a, b = col(a), col(b)
    na, nb = F.size(a), F.size(b)
    kind = lambda both: F.when((both == na) & (na == nb), "equal").when(both / (na + nb - both) >= 0.6, "similar").when((both == F.least(na, nb)) & (both >= 2), "contained")
    return F.when((na > 0) & (nb > 0), let(F.size(F.array_intersect(a, b)), kind))


#: Order of the matches.
MATCH_RANK = {"equal": 3, "similar": 2, "contained": 1}


def name_variants(*names: Column | str) -> Column:
    """The distinct titles of an event in order, blank ones left out."""
    trimmed = [col(names[0]), *(F.trim(col(n)) for n in names[1:])]
    return F.array_distinct(F.filter(F.array(*trimmed), lambda n: n.isNotNull() & (n != "")))


def with_bare_titles(variants: Column | str) -> Column:
    """Variants and those without their festival prefix."""
    bare = F.filter(F.transform(col(variants), strip_festival_prefix), lambda n: n.isNotNull())
    return F.array_union(col(variants), bare)


def compare_names(a: Column | str, b: Column | str, venue_a: Column | str | None = None, venue_b: Column | str | None = None) -> Column:
    """The best match over all pairs of name variants (X11); a, b: arrays of names."""
    words = lambda names, venue: F.transform(col(names), lambda n: name_tokens(n, venue))
    return let(words(a, venue_a), lambda x: let(words(b, venue_b), lambda y: compare_words(x, y)))


def compare_words(a: Column, b: Column) -> Column:
    """The best match over all pairs of sets of words; a, b: arrays of what ``name_tokens`` gives."""
    kinds = lambda m: F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: m(x, y))))
    best = lambda k: F.when(F.array_contains(k, "equal"), "equal").when(F.array_contains(k, "similar"), "similar").when(F.array_contains(k, "contained"), "contained")
    return let(kinds(compare_tokens), best)


def same_name(a: Column | str, b: Column | str) -> Column:
    """Equal slugs, or equal or similar words."""
    return F.coalesce((kebab(a) == kebab(b)) | compare_tokens(name_tokens(a), name_tokens(b)).isin("equal", "similar"), F.lit(False))


def similar_tokens(a: Column | str, b: Column | str, slug_a: Column | str, slug_b: Column | str) -> Column:
    """The scan's looser test: Jaccard 0.6 or more, two or more shared with one within the other, or equal; without words, equal slugs."""
    a, b = col(a), col(b)
    na, nb = F.size(a), F.size(b)

    def similar(both: Column) -> Column:
        within = both == F.least(na, nb)
        return (both / (na + nb - both) >= 0.6) | (within & (both >= 2)) | (within & (na == nb))

    return F.when((na <= 0) | (nb <= 0), col(slug_a) == col(slug_b)).otherwise(let(F.size(F.array_intersect(a, b)), similar))


def _group(c: Column, pattern: str, k: int) -> Column:
    """A group of a match; null where there is none."""
    got = F.regexp_extract(c, pattern, k)
    return F.when(got != "", got)


def strip_festival_prefix(name: Column | str) -> Column:
    """The title after "<festival> <year> - ", null without one."""
    title = F.trim(_group(F.trim(col(name)), r"^(.{3,60}?)\s+(?:19|20)[0-9]{2}\s*[–—-]\s+(\S.*)$", 2))
    return F.when(kebab(title).rlike("[a-z]"), title)


def festival_prefix(name: Column | str) -> Column:
    """What stands before " - ", " – ", " — " or " | ", 5 to 60 characters, null without one."""
    return F.trim(_group(col(name), r"^(.{5,60}?)\s+[|–—-]\s+\S", 1))


#: Marks of a moved date.
MOVED = r"(?:nova\s+data\s+confirmada|nova\s+data|novas\s+datas|new\s+dates?|adiado|adiada|reagendado|reagendada|postponed|rescheduled)"


def strip_reschedule_marker(name: Column | str) -> Column:
    """The name without a leading or closing mark of a moved date, null without one."""
    lead = _group(col(name), rf"(?iu)^\s*[\[(]?\s*{MOVED}\s*[\])]?\s*(?:[-–—:|]\s*|\s+)(\S.*)$", 1)
    tail = _group(col(name), rf"(?iu)^(.*\S)\s*(?:[-–—|]\s*|[\[(]\s*){MOVED}\s*[\])]?\s*$", 1)
    found = F.coalesce(lead, tail)
    return F.when(found.rlike("(?i)[a-z]"), F.trim(found))


def contains_words(big: Column | str, small: Column | str) -> Column:
    """Whole-word containment of slugs."""
    return F.contains(F.concat(F.lit("-"), col(big), F.lit("-")), F.concat(F.lit("-"), col(small), F.lit("-")))


def has_distinctive_word(slug: Column | str, venue: Column | str) -> Column:
    """A word of four or more letters that is no stop word, number or venue word."""
    words = F.array_except(F.split(col(slug), "-"), F.split(F.coalesce(col(venue), F.lit("")), "-"))
    return F.exists(words, lambda t: (F.length(t) >= 4) & ~t.isin(STOP_WORDS) & ~t.rlike("^[0-9]+$"))


def close_spelling(a: Column | str, b: Column | str, most: int = 2) -> Column:
    """Edit distance of at most ``most``."""
    return F.levenshtein(col(a), col(b), most) >= 0


def clip(text: Column | str, most: int) -> Column:
    """Cut on a word border where that keeps over 60 %, with an ellipsis."""
    cut = F.substring(col(text), 1, most - 1)
    at = F.length(cut) - F.instr(F.reverse(cut), " ")
    at = F.when(F.instr(cut, " ") > 0, at).otherwise(F.lit(-1))
    body = F.when(at > most * 0.6, F.substring(cut, F.lit(1), at.cast("int"))).otherwise(cut)
    return F.when(F.length(col(text)) <= most, col(text)).otherwise(F.concat(F.regexp_replace(body, r"[\s,.;:—–-]+$", ""), F.lit("…")))


def humanize(text: Column | str, title: bool = False, html: bool = False) -> Column:
    """Straight quotes, and long dashes to commas, colons or hyphens (X21); in HTML line breaks are no borders."""
    steps = [
        (r"[“”„‟″]|&ldquo;|&rdquo;|&bdquo;|&#822[01];", '"'),
        (r"[‘’‚‛′]|&lsquo;|&rsquo;|&sbquo;|&#821[67];", "'"),
        (r"(?i)&mdash;|&#8212;|&#x2014;|―", "—"),
        (r"(\S) -- (\S)", "$1 — $2"),
        (r"([0-9])\s*—\s*([€\$£]?[0-9])", "$1-$2"),
        (r"(?m)^([ \t]*)—[ \t]*", "$1- "),
        (r"(?m)[ \t]*—[ \t]*$", ""),
        (r"\s*—\s*(?=[.,;:!?)\]])", ""),
        (r"\(\s*—\s*", "("),
    ]
    out = col(text)
    for pattern, to in steps:
        if not (html and pattern.startswith("(?m)")):
            out = F.regexp_replace(out, pattern, to)
    if title:
        single = F.length(out) - F.length(F.replace(out, F.lit("—"), F.lit(""))) == 1
        out = F.when(single, F.regexp_replace(out, r"\s*—\s*", ": ")).otherwise(out)
    for pattern, to in ((r"([.,;:!?])\s*—\s*", "$1 "), (r"\s*—\s*", ", "), (r",\s*,", ","), (r",\s*([.;:!?])", "$1")):
        out = F.regexp_replace(out, pattern, to)
    return out


def week_slug(text: Column | str) -> Column:
    """A week range as a slug."""
    plain = F.replace(F.regexp_replace(F.lower(col(text)), "[–—]", "-"), F.lit(","), F.lit(""))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\s+", "-"), "-+", "-"))


def post_slug(title: Column | str, most: int = 60) -> Column:
    """A title as a slug of at most ``most`` characters; other letters than a-z go."""
    bare = F.regexp_replace(F.lower(col(title)), r"[^a-z0-9_\s-]", "")
    return F.left(F.trim(F.regexp_replace(F.regexp_replace(bare, r"\s+", "-"), "-+", "-")), F.lit(most))


def clean_path(source: Column | str) -> Column:
    """A local path without query and fragment, at most 200 characters; unknown for anything else."""
    path = F.left(F.element_at(F.split(col(source), "[?#]"), 1), F.lit(200))
    return F.when(path.rlike(r"^/[A-Za-z0-9_./%-]*$"), path).otherwise("unknown")


def lead_key(day: Column | str, name: Column | str, venue: Column | str) -> Column:
    """Day, name and venue as one key."""
    return F.concat_ws("|", F.left(col(day), F.lit(10)), kebab(name), venue_slug(venue))


def event_slug(name: Column | str, venue: Column | str, day: Column | str) -> Column:
    """name-venue-mon-day-year, empty parts left out."""
    d = F.to_date(F.left(col(day), F.lit(10)))
    parts = F.array(kebab(name), venue_slug(venue), F.lower(F.date_format(d, "MMM")), F.dayofmonth(d).cast("string"), F.year(d).cast("string"))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), "-")


def spoiler_free(status: Column, solved_at: Column, misses: Column, guesses: Column, skip: str = "__skip", most: int = 5) -> Column:
    """A row of squares that tells a game without its answer."""

    def square(i):
        won = (status == "won") & (i == solved_at - 1)
        missed = F.when(F.get(guesses, i) == skip, F.lit("⬛")).otherwise(F.lit("🟥"))
        return F.when(won, F.lit("🟩")).when(i < misses, missed).otherwise(F.lit("⬜"))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), square), "")


def insert_before(page: Column | str, block: Column | str, anchor: str, marker: str) -> Column:
    """``block`` before the first match of ``anchor``, unless ``marker`` is there already or nothing matches."""
    page, block = col(page), col(block)
    at = F.regexp_instr(page, F.lit(anchor))
    put = F.concat(F.substring(page, F.lit(1), at - 1), block, F.lit("\n"), F.substring(page, at, F.length(page)))
    return F.when(F.contains(page, F.lit(marker)) | (at == 0), page).otherwise(put)


def replace_between(page: Column | str, start: str, end: str, block: Column | str) -> Column:
    """The first stretch from ``start`` to ``end`` replaced by ``block``."""
    page = col(page)
    a = F.instr(page, start)
    after = F.substring(page, a + len(start), F.length(page))
    b = F.instr(after, end)
    put = F.concat(F.substring(page, F.lit(1), a - 1), col(block), F.substring(after, b + len(end), F.length(page)))
    return F.when((a > 0) & (b > 0), put).otherwise(page)


def decode_entities(c: Column | str) -> Column:
    """The common named and numeric HTML entities as characters."""
    out = col(c)
    for name, char in (("&nbsp;|&#160;", " "), ("&quot;|&#34;", '"'), ("&#39;|&#x27;|&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&ndash;|&#8211;", "–"), ("&mdash;|&#8212;", "—"), ("&euro;", "€"), ("&amp;|&#38;", "&")):
        out = F.regexp_replace(out, "(?i)" + name, char)
    return out
