"""Wide rows looked up by the ids of many narrow ones, without shuffling the wide rows.

Up to the broadcast bound the narrow side is broadcast. Beyond it the narrow side is cut into slices that each fit: by
ranges of the id, and a range that one id fills by a hash of its rows. Slices are joined one after the other, so one
of them is in memory at a time. A slice's range is a filter of the scan: tables that are sorted by id inside their
files are read about once in all.
"""

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from kbspark.operators.limits import MAX_BROADCAST_ROWS, in_slices, max_broadcast_bytes, pin


class Slice(NamedTuple):
    """Ids above ``low`` up to ``high`` (none: no end); of these rows the ``part``-th of ``parts`` by hash."""

    low: int | None
    high: int | None
    part: int
    parts: int

    def ids(self, key: str) -> Column:
        above = F.col(key) > self.low if self.low is not None else F.col(key).isNotNull()
        return above & (F.col(key) <= self.high) if self.high is not None else above

    def rows(self, wanted: DataFrame, key: str) -> DataFrame:
        inside = wanted.filter(self.ids(key))
        return inside.filter(F.pmod(F.xxhash64(*wanted.columns), F.lit(self.parts)) == self.part) if self.parts > 1 else inside


def slices(wanted: DataFrame, key: str, most: int) -> list[Slice]:
    """Slices of about ``most`` rows at most that together hold every row of ``wanted`` with an id once."""
    rows = wanted.filter(F.col(key).isNotNull()).count()
    count = math.ceil(rows / most)
    if count <= 1:
        return [Slice(None, None, 0, 1)] if rows else []
    shares = [n / count for n in range(1, count)]
    ends = sorted(set(wanted.agg(F.percentile_approx(key, shares, 100 * count)).first()[0]))
    number = F.size(F.filter(F.array(*map(F.lit, ends)), lambda end: end < F.col(key)))
    sizes = dict(wanted.filter(F.col(key).isNotNull()).groupBy(number.alias("n")).count().collect())
    out = []
    for n, (low, high) in enumerate(zip([None, *ends], [*ends, None], strict=True)):
        parts = math.ceil(sizes.get(n, 0) / most)
        out += [Slice(low, high, part, parts) for part in range(parts)]
    return out


def looked_up(rows: DataFrame, wanted: DataFrame, key: str, most_rows: int, row_bytes: int,
              also: tuple[str, ...] = (), then: Callable[[DataFrame], DataFrame] = lambda joined: joined) -> DataFrame:
    """``rows`` joined with ``wanted`` on ``key``, an integer column of both; ``rows`` are scanned and not shuffled.

    ``most_rows`` is an upper bound of the rows of ``wanted``, whose rows take about ``row_bytes`` when broadcast.
    Columns in ``also`` have to be equal too; where tables are partitioned by one, Spark prunes directories by it. ``then``
    keeps of the joined rows what is needed of them, before those of a slice are written.
    """
    on = [key, *also]
    fit = max(1, min(MAX_BROADCAST_ROWS, max_broadcast_bytes(rows.sparkSession) // row_bytes))
    if most_rows <= fit:
        return then(rows.join(F.broadcast(wanted), on))
    wanted = pin(wanted, "wanted")
    some = slices(wanted, key, fit)
    if len(some) == 1:
        return then(rows.join(F.broadcast(wanted), on))
    joined = then(rows.join(wanted, on))
    parts = [lambda one=one: then(rows.filter(one.ids(key)).join(F.broadcast(one.rows(wanted, key)), on)) for one in some]
    return in_slices(parts, joined.schema, rows.sparkSession, "looked-up")
