"""Fill-in-middle: texts rearranged so that a model learns to write the middle from both sides.

Cuts fall between units, a unit being a word with the gap before it (or the gap at the end of a text). To find the
byte and the code point where the k-th unit of a text ends, its bytes are divided into blocks of fixed size. A Fenwick
tree over the blocks holds how many units end and how many code points start in each; binary lifting descends it to
the block of a cut, and only that block is searched for the place. So a text never becomes a list of its units, and a
long one costs eight bytes or so for every hundred of its own beside the bytes that are counted at a time.

Python only counts: it returns the numbers of units and code points, and the text is put together in the JVM. A row is
judged by its own key and text, so nothing is shuffled.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from kbspark.llm.common import binary_values, free_name

BLOCK = 1024

# Blocks that are counted at a time.
_BLOCKS_AT_A_TIME = 1024

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_GAPS = np.zeros(256, dtype=bool)
_GAPS[[32, *range(9, 14)]] = True


def _unit_ends(codes: np.ndarray, more: bool) -> np.ndarray:
    """Whether a unit ends at each byte; with ``more`` the last byte is only looked at, to see if a word goes on."""
    gaps = _GAPS[codes]
    ends = np.empty(len(codes), dtype=bool)
    np.logical_and(~gaps[:-1], gaps[1:], out=ends[:-1])
    ends[-1] = True
    return ends[:-1] if more else ends


def _points(codes: np.ndarray) -> np.ndarray:
    """Whether a code point starts at each byte."""
    return (codes & 0xC0) != 0x80


def _tree(counts: np.ndarray) -> np.ndarray:
    """The Fenwick tree of ``counts``; node i, from 1, holds the sum of the last ``i & -i`` of the first i counts."""
    sums = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    nodes = np.arange(len(sums))
    return sums - sums[nodes - (nodes & -nodes)]


class UnitIndex:
    """Finds where units of a text end."""

    def __init__(self, text: bytes):
        self._codes = np.frombuffer(text, dtype=np.uint8)
        units, points, step = [], [], BLOCK * _BLOCKS_AT_A_TIME
        for start in range(0, len(text), step):
            piece = self._codes[start:start + step + 1]
            ends = _unit_ends(piece, len(piece) > step)
            cuts = np.arange(0, len(ends), BLOCK)
            units.append(np.add.reduceat(ends, cuts, dtype=np.int64))
            points.append(np.add.reduceat(_points(piece[:len(ends)]), cuts, dtype=np.int64))
        empty = np.zeros(0, dtype=np.int64)
        units = np.concatenate(units) if units else empty
        self.units = int(units.sum())
        self._units, self._points = _tree(units), _tree(np.concatenate(points) if points else empty)

    def end(self, unit: int) -> tuple[int, int]:
        """Bytes and code points before the end of the ``unit``-th unit, counted from 1; nothing is before unit 0."""
        if not unit:
            return 0, 0
        node, points, blocks = 0, 0, len(self._units) - 1
        step = 1 << blocks.bit_length()
        while step:
            if node + step <= blocks and self._units[node + step] < unit:
                node += step
                unit -= int(self._units[node])
                points += int(self._points[node])
            step >>= 1
        start = node * BLOCK
        piece = self._codes[start:start + BLOCK + 1]
        place = int(np.flatnonzero(_unit_ends(piece, len(piece) > BLOCK))[unit - 1]) + 1
        return start + place, points + int(np.count_nonzero(_points(piece[:place])))


_CUTS = StructType([StructField(name, LongType()) for name in ("n", "prefix_chars", "middle_chars")])


@F.arrow_udf(_CUTS)
def _cut(text: pa.Array, one: pa.Array, other: pa.Array) -> pa.Array:
    out = []
    for value, first, second in zip(binary_values(text), one.to_pylist(), other.to_pylist(), strict=True):
        index = UnitIndex(value)
        low, high = sorted((first % (index.units + 1), second % (index.units + 1)))
        before = index.end(low)[1]
        out.append((index.units, before, index.end(high)[1] - before))
    return pa.StructArray.from_arrays(
        [pa.array([row[n] for row in out], pa.int64()) for n in range(3)], names=_CUTS.names)


def with_middles(docs: DataFrame, into: str, key: str = "doc_id", text: str = "text", seed: int = 42,
                 rate: int = 50, suffix_first: int = 80) -> DataFrame:
    """``docs`` with a struct column ``into`` of ``form``, ``n``, ``prefix_chars``, ``middle_chars`` and ``output``.

    Four numbers are drawn from the SHA-256 of the seed and the key. Of 100 texts ``rate`` are rearranged, of 100 of
    these ``suffix_first`` in the form ``spm`` and the others as ``psm``; the rest stay as they are (``plain``), as do
    empty texts and those that hold one of the three marks. ``n`` counts the units of any text; the two lengths are
    null in plain rows. A null text counts as empty, a null key as an empty one. Rows that repeat key and text get
    equal results. All columns and rows stay; ``into`` must be a new name.
    """
    drawn, cuts, value = (free_name(docs, name) for name in ("drawn", "cuts", "whole"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[key].cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(F.col(drawn), 8 * n + 1, 8), 16, 10).cast("long") for n in range(4)]
    marked = docs.withColumns({drawn: digest, value: F.coalesce(docs[text].cast("string"), F.lit(""))})
    found = marked.withColumn(cuts, _cut(F.col(value), h[0], h[1]))
    whole, cut = F.col(value), F.col(cuts)
    as_it_is = (whole == "") | (h[2] % 100 >= rate)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        as_it_is |= F.contains(whole, F.lit(mark))
    form = F.when(as_it_is, "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    low, middle = cut["prefix_chars"].cast("int"), cut["middle_chars"].cast("int")
    parts = [F.lit(PREFIX), F.substr(whole, F.lit(1), low), F.lit(SUFFIX), F.substr(whole, low + middle + 1), F.lit(MIDDLE),
             F.substr(whole, low + 1, middle)]
    output = F.when(form == "plain", whole).when(form == "psm", F.concat(*parts)).otherwise(
        F.concat(*parts[2:4], *parts[:2], *parts[4:]))
    moved = form != "plain"
    return found.select(*docs.columns, F.struct(
        form.alias("form"), cut["n"].alias("n"), F.when(moved, cut["prefix_chars"]).alias("prefix_chars"),
        F.when(moved, cut["middle_chars"]).alias("middle_chars"), output.alias("output")).alias(into))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from."""
    parts = F.split(output, "<[PSM]>", -1)
    one, other, middle = (F.get(parts, F.lit(n)) for n in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, other)).otherwise(
        F.concat(other, middle, one))
