"""Quotes against pages when a few characters differ: where a quote stands, and how many edits it is off."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.shipping import by_value
from .text import col, quote_form

by_value(__name__)

#: Edits up to which a quote counts as found.
MOST = 3
#: More than any text is long, so that edits and a place fit one number.
PLACES = 1 << 32


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _aligned(quote: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the stretch of a text nearest to a quote: the fewest edits, then the first end, then the latest start.

    A row for each character of the quote holds, for every end, edits and start
    as one number, so the least of them is the best; inserted characters spread
    along the row by a running minimum.
    """
    n = len(text)
    along = np.arange(n + 1, dtype=np.int64)
    row = -along  # nothing of the quote read: no edits, from here
    for c in quote:
        new = np.empty(n + 1, np.int64)
        new[0] = row[0] + PLACES
        np.minimum(row[:-1] + np.where(text == c, 0, PLACES), row[1:] + PLACES, out=new[1:])
        row = np.minimum.accumulate(new - along * PLACES) + along * PLACES
    edits = -(-row // PLACES)
    end = int(edits.argmin())
    return int(edits[end]), int(edits[end] * PLACES - row[end]), end


def nearest(quote: str, text: str, most: int = MOST) -> tuple[int, int, int] | None:
    """(edits, start, end) of the nearest stretch of at most ``most`` edits, None if there is none.

    Of ``most`` + 1 pieces of the quote one stands in such a stretch unharmed, so
    only the bands around the pieces' places are aligned. Quotes of ``most``
    characters or fewer have to stand there as they are.
    """
    at = text.find(quote)
    if at >= 0:
        return 0, at, at + len(quote)
    if len(quote) <= most:
        return None
    cuts = [len(quote) * k // (most + 1) for k in range(most + 2)]
    bands: list[list[int]] = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        at = text.find(quote[a:b])
        while at >= 0:
            bands.append([max(0, at - a - most), min(len(text), at - a + len(quote) + most)])
            at = text.find(quote[a:b], at + 1)
    if not bands:
        return None
    bands.sort()
    joined = [bands[0]]
    for low, high in bands[1:]:
        if low <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], high)
        else:
            joined.append([low, high])
    best, q = None, _points(quote)
    for low, high in joined:
        edits, start, end = _aligned(q, _points(text[low:high]))
        if edits <= most and (best is None or edits < best[0]):
            best = edits, low + start, low + end
    return best


def found_quote(quote: Column | str, text: Column | str, most: int = MOST) -> Column:
    """struct(edits, start, end, said): where a page says what a quote says, up to ``most`` edits (J25, E02); null where it doesn't.

    Both are compared in their quote forms (X05), whose characters ``start`` and
    ``end`` count. Of several places that with the fewest edits counts, then the
    first. Null and empty quotes are nowhere.
    """

    @F.arrow_udf("edits int, start int, end int, said string")
    def look(quotes: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for q, t in zip(quotes, texts, strict=True):
            quote, text = q.as_py(), t.as_py()
            got = nearest(quote, text, most) if quote and text else None
            out.append(got and {"edits": got[0], "start": got[1], "end": got[2], "said": text[got[1] : got[2]]})
        return pa.array(out, pa.struct([("edits", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("said", pa.string())]))

    return look(quote_form(col(quote)), quote_form(col(text)))
