"""A seeded generator and the choices drawn with it, bit for bit."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..plans.shipping import by_value

by_value(__name__)


def generator(seed: int):
    """Mulberry32: 32-bit state, numbers in [0, 1)."""
    mask, state = 0xFFFFFFFF, seed & 0xFFFFFFFF

    def draw() -> float:
        nonlocal state
        state = (state + 0x6D2B79F5) & mask
        x = ((state ^ state >> 15) * (state | 1)) & mask
        x ^= (x + ((x ^ x >> 7) * (x | 61))) & mask
        return (x ^ x >> 14) / 4294967296

    return draw


def shuffled(items: list, draw) -> list:
    """Fisher-Yates from the end."""
    out = list(items)
    for i in range(len(out) - 1, 0, -1):
        j = int(draw() * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out


def choices(number: int, ids: list[str]) -> list[str]:
    """The day's answer and three others, in drawn order."""
    answer, draw = ids[(number - 1) % len(ids)], generator(number * 7919 + 17)
    return shuffled([answer, *shuffled([i for i in ids if i != answer], draw)[:3]], draw)


def choices_for(number: Column, ids: list[str]) -> Column:
    """``choices`` of a column of day numbers."""

    @pandas_udf("array<string>")
    def drawn(n: pd.Series) -> pd.Series:
        return n.map(lambda k: choices(int(k), ids))

    return F.when(number.isNotNull(), drawn(F.coalesce(number, F.lit(1))))

