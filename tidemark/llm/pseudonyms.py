"""Format-preserving pseudonyms for validated numbers, dates and addresses.

Every value is permuted within its own format by a keyed Feistel network, so
equal values get equal pseudonyms in all documents, different ones different
pseudonyms, and whoever holds the key can undo it. E-mail addresses that differ
in the case of their local parts are one value; undoing gives small letters.
All of it is column expressions: no shuffle, no Python.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let

ROUNDS = 8
#: Dates are permuted within blocks of so many days from 1900-01-01 (730 x 100: two factors for the network).
DATE_PARTS = (730, 100)
EPOCH = "1900-01-01"

#: What may be private, in order of preference. Which of it is valid is decided after. No value is unbounded but an
#: e-mail's domain, whose labels are matched possessively: a matched group that could be taken back costs stack.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "secret": r"(?<![0-9A-Za-z])(?=[0-9]*[a-f])[0-9a-f]{32,64}(?![0-9A-Za-z])",
    "isodate": r"(?<!\d)\d{4}-\d{2}-\d{2}(?!\d)",
    "date": r"(?<!\d)\d{2}[/.]\d{2}[/.]\d{4}(?!\d)",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    "ssn": r"(?<!\d)(?<!\d-)\d{3}-\d{2}-\d{4}(?!\d)(?!-\d)",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<!\d)\d{3}-\d{3}-\d{4}(?!\d)",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
}
ANY = "|".join(KINDS.values())


def _mix(key: str, kind: str, *parts: Column) -> Column:
    """52 keyed bits of the parts."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 13), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: str, extra: Column, undo: bool = False) -> Column:
    """Permute (left in 0..a-1, right in 0..b-1): struct(l, r)."""
    sign = -1 if undo else 1
    order = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if undo else F.sequence(F.lit(1), F.lit(ROUNDS))

    def step(s, i):
        l, r = s["l"], s["r"]  # noqa: E741
        new_l = F.pmod(l + sign * F.pmod(_mix(key, kind, extra, i, r), a), a)
        new_r = F.pmod(r + sign * F.pmod(_mix(key, kind, extra, i, l), b), b)
        odd = i % 2 == 1
        return F.struct(F.when(odd, new_l).otherwise(l).alias("l"), F.when(odd, r).otherwise(new_r).alias("r"))

    return F.aggregate(order, F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def permute_chars(chars: Column, base: int, key: str, kind: str, undo: bool = False) -> Column:
    """Permute a string of base-``base`` digits among those of its length, in pieces whose halves fit a long."""
    half = {10: 9, 16: 12, 36: 11}[base]
    powers = F.array(*(F.lit(base**k).cast("long") for k in range(half + 1)))

    def piece(k):
        def permuted(s):
            n = F.length(s)
            u = F.floor(n / 2).cast("int")
            number = lambda x: F.coalesce(F.conv(F.when(x != "", x), base, 10).cast("long"), F.lit(0).cast("long"))
            made = feistel(number(F.substring(s, F.lit(1), u)), number(F.substring(s, u + 1, n)), F.element_at(powers, u + 1), F.element_at(powers, n - u + 1), key, kind, F.concat_ws(",", n.cast("string"), k.cast("string")), undo)
            text = lambda x, w: F.lpad(F.lower(F.conv(x.cast("string"), 10, base)), w, F.lit("0"))
            return let(made, lambda m: F.concat(F.when(u > 0, text(m["l"], u)).otherwise(""), text(m["r"], n - u)))

        return let(F.substring(chars, k * (2 * half) + 1, F.lit(2 * half)), permuted)

    pieces = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(chars) - 1) / (2 * half)).cast("int")))
    return F.when(chars == "", "").otherwise(F.array_join(F.transform(pieces, piece), ""))


def _refill(form: Column, chars: Column, others: str) -> Column:
    """Put ``chars`` in order into ``form``, whose characters in ``others`` stay."""

    def one(i):
        c = F.substring(form, i, F.lit(1))
        return F.when(F.instr(F.lit(others), c) > 0, c).otherwise(F.substring(chars, F.length(F.translate(F.substring(form, F.lit(1), i), others, "")), F.lit(1)))

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), one), "")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    """The Luhn sum of a digit string, last digit undoubled."""

    def add(s, i):
        x = F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int")
        return s + F.when(i % 2 == 1, x).otherwise(F.when(x > 4, 2 * x - 9).otherwise(2 * x))

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add)


def _mod97(s: Column) -> Column:
    """An IBAN's remainder: the first four characters last, letters as two digits."""
    turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))

    def add(r, i):
        c = F.substring(turned, i, F.lit(1))
        v = F.conv(c, 36, 10).cast("int")
        return F.when(v > 9, (r * 100 + v) % 97).otherwise((r * 10 + v) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add)


def _card(m, key, undo):
    def made(d):
        body = permute_chars(F.substring(d, F.lit(1), F.length(d) - 1), 10, key, "card", undo)
        return let(body, lambda x: F.concat(x, F.pmod(10 - _luhn(F.concat(x, F.lit("0"))) % 10, F.lit(10)).cast("string")))

    return let(_digits(m), lambda d: F.when((_luhn(d) % 10 == 0) & (d.rlike("[1-9]")), _refill(m, made(d), " -")))


def _phone(m, key, undo):
    def made(d):
        keep = F.greatest(F.length(d) - 10, F.lit(0))
        return F.concat(F.substring(d, F.lit(1), keep), permute_chars(F.substring(d, keep + 1, F.lit(10)), 10, key, "phone", undo))

    return let(_digits(m), lambda d: F.when(F.length(d).between(8, 15), _refill(m, made(d), "+ .-()")))


def _ssn(m, key, undo):
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    at = (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1
    made = feistel(at, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn", F.lit(""), undo)

    def text(p):
        index = F.floor(p["l"] / 99)
        number = index + F.when(index >= 665, 2).otherwise(1)
        return F.format_string("%03d-%02d-%04d", number.cast("long"), (p["l"] % 99 + 1).cast("long"), p["r"] + 1)

    return F.when(valid, let(made, text))


def _ip(m, key, undo):
    def made(o):
        valid = F.forall(o, lambda x: x <= 255)
        perm = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ip", F.lit(""), undo)
        return F.when(valid, let(perm, lambda p: F.concat_ws(".", *(x.cast("long").cast("string") for x in (F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256)))))

    return let(F.transform(F.split(m, "[.]"), lambda x: x.cast("long")), made)


def _date(day: Column, text, key, undo):
    """A valid date's pseudonym within its block of days; text: date to its format."""
    a, b = DATE_PARTS

    def made(n):
        block, within = F.floor(n / (a * b)), F.pmod(n, F.lit(a * b))
        perm = feistel(F.floor(within / b), within % b, F.lit(a), F.lit(b), key, "date", block, undo)
        return let(perm, lambda p: text(F.date_add(F.lit(EPOCH).cast("date"), (block * (a * b) + p["l"] * b + p["r"]).cast("int"))))

    # Whole blocks of four-digit years only, so that pseudonyms are such dates again.
    inside = day.between(F.lit("1700-03-01").cast("date"), F.lit("9000-01-01").cast("date"))
    return F.when(inside, let(F.datediff(day, F.lit(EPOCH).cast("date")).cast("long"), made))


def _iban(m, key, undo):
    def made(s):
        tail = F.substring(s, F.lit(5), F.length(s))
        body = _refill(tail, permute_chars(_digits(tail), 10, key, "iban", undo), string.ascii_uppercase)
        head = F.substring(s, 1, 2)
        full = let(body, lambda x: F.concat(head, F.lpad((98 - _mod97(F.concat(head, F.lit("00"), x))).cast("string"), 2, "0"), x))
        return F.when(_mod97(s) == 1, _refill(m, full, " "))

    return let(F.replace(m, F.lit(" "), F.lit("")), made)


def _email(m, key, undo):
    local = F.substring_index(m, "@", 1)
    alnum = F.regexp_replace(local, "[^A-Za-z0-9]", "")
    return F.concat(_refill(local, permute_chars(F.lower(alnum), 36, key, "email", undo), "._%+-"), F.substring(m, F.length(local) + 1, F.length(m)))


def pseudonym(m: Column, key: str, undo: bool = False) -> Column:
    """struct(kind, text) for a candidate; kind is null, and text as it was, where it isn't valid."""
    whole = lambda k: m.rlike("^(?:" + KINDS[k] + ")$")
    made = {
        "email": _email(m, key, undo),
        "iban": _iban(m, key, undo),
        "secret": permute_chars(m, 16, key, "secret", undo),
        "isodate": _date(F.try_to_date(m, "yyyy-MM-dd"), lambda d: F.date_format(d, "yyyy-MM-dd"), key, undo),
        "date": _date(F.try_to_date(F.regexp_replace(m, "[.]", "/"), "dd/MM/yyyy"), lambda d: F.regexp_replace(F.date_format(d, "dd/MM/yyyy"), "/", F.substring(m, 3, 1)), key, undo),
        "ip": _ip(m, key, undo),
        "ssn": _ssn(m, key, undo),
        "phone": _phone(m, key, undo),
        "card": _card(m, key, undo),
    }
    told = lambda kind: lambda v: F.struct(F.when(v.isNotNull(), F.lit(kind)).alias("kind"), F.coalesce(v, m).alias("text"))
    out = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("text"))
    for kind, value in reversed(made.items()):
        out = F.when(whole(kind), let(value, told(kind))).otherwise(out)
    return out


def pseudonymize(df: DataFrame, key: str, text: str = "text", undo: bool = False) -> DataFrame:
    """``df`` with the valid private values of ``text`` replaced, and ``kinds``: their kinds in order of place.

    Valid: cards by Luhn, IBANs by mod 97, calendar dates (years 1700 to 8999),
    IPv4 octets, social security areas, telephone lengths; e-mail local parts
    (at most 64 characters) and long hexadecimal secrets are permuted too.
    Values that fail stay as they are. ``undo``: turn pseudonyms back. Null
    texts stay null with kinds null; texts without candidates stay as they are.
    A column kinds is replaced; any other column stays as it is.
    """
    df = df.drop("kinds")
    (found,) = fresh(df.columns, "_found")
    df = df.withColumn(found, F.transform(F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0)), lambda m: pseudonym(m, key, undo)))
    gaps = F.split(F.col(text), ANY)
    filled = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(F.col(found), i)["text"], F.lit("")))), "")
    kinds = F.filter(F.transform(found, lambda x: x["kind"]), lambda k: k.isNotNull())
    return df.withColumns({text: F.when(F.size(found) > 0, filled).otherwise(F.col(text)), "kinds": kinds}).drop(found)
