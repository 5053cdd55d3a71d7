"""Pairs of 64-bit codes within a Hamming distance, by a Gray-ordered hierarchical index.

Upper nodes are masked bit patterns. The 64 bits are cut into ``distance + 2`` blocks; codes that differ in at most
``distance`` bits agree in two whole blocks, so both lie under a common node ``(mask, pattern)`` for one of the 15
masks (distance 4). A node with more codes than ``SPLIT`` is factored again over its free bits. This is repeated twice,
which leaves at most 2**15 different codes under a node, so there is no cap and nothing is dropped.

Below an upper node the codes are sorted by Gray rank, and every ``FAN`` neighbours form a node that keeps the bits
they share. A join of the tree with itself goes down pairs of nodes; the bits shared on either side that differ are
the distance accumulated so far, and pairs of whole groups beyond the limit are dropped unseen.
"""

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kbspark.llm.common import small_side, stored, unsigned
from kbspark.llm.union_find import unite

SPLIT = 16_384
FAN = 8
LEVELS = 3

# Pairs of nodes that are opened at a time, and codes that are indexed at a time (groups are never cut).
PAIRS = 1 << 14
CODES = 1 << 17


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks(fixed: int, distance: int) -> list[int]:
    """``fixed`` with each choice of two of the ``distance + 2`` blocks into which its free bits are cut."""
    free = [bit for bit in range(64) if not fixed >> bit & 1]
    blocks = [sum(1 << bit for bit in part.tolist()) for part in np.array_split(np.array(free, dtype=int), distance + 2)]
    return [fixed | one | other for one, other in combinations(blocks, 2)]


def gray_rank(code: Column) -> Column:
    """The place of ``code`` in the Gray order: the exclusive or of its right shifts."""
    return reduce(lambda rank, by: rank.bitwiseXOR(F.shiftrightunsigned(rank, by)), (1, 2, 4, 8, 16, 32), code)


def _under(codes: DataFrame, masks: Column) -> DataFrame:
    return codes.select("code", F.explode(masks).alias("mask")).select(
        "code", "mask", F.col("mask").bitwiseAND(F.col("code")).alias("pattern"))


def _nodes(codes: DataFrame, distance: int) -> DataFrame:
    """``(code, mask, pattern)``: every code under all of its upper nodes."""
    level = [_masks(0, distance)]
    rows = _under(codes, F.array(*[F.lit(_signed(mask)) for mask in level[0]]))
    done = []
    for depth in range(1, LEVELS):
        hot = stored(rows.groupBy("mask", "pattern").count().filter(F.col("count") > SPLIT)
                     .select("mask", "pattern"), "hot-nodes")
        if hot.isEmpty():
            break
        hot = small_side(hot, 32)
        done.append(rows.join(hot, ["mask", "pattern"], "left_anti").select("code", "mask", "pattern"))
        finer = {mask: _masks(mask, distance) for masks in level for mask in masks}
        level = list(finer.values())
        choose = F.create_map(*[item for mask, parts in finer.items() for item in (
            F.lit(_signed(mask)), F.array(*[F.lit(_signed(part)) for part in parts]))])
        rows = _under(rows.join(hot, ["mask", "pattern"], "left_semi"), F.element_at(choose, F.col("mask"))).distinct()
    return reduce(DataFrame.unionByName, done, rows)


class _Tree:
    """The shared bits of every ``FAN`` neighbours, level above level, for many groups of sorted codes at once."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray):
        sizes = np.diff(np.append(starts, len(codes)))
        group = np.repeat(np.arange(len(starts)), sizes)
        self.both, self.either = [codes], [codes]
        self.first, self.count, self.tops = [None], [None], []
        while True:
            alone = sizes == 1
            self.tops.append(starts[alone] if len(self.both) > 1 else starts[:0])
            if alone.all():
                return
            place = np.arange(len(group)) - np.repeat(starts, sizes)
            heads = np.flatnonzero((place % FAN == 0) & ~alone[group])
            tall = np.flatnonzero(~alone)
            ends = np.minimum(heads + FAN, (starts + sizes)[group[heads]])
            # reduceat runs to the next head, so groups that are already a single node must not lie between: they are
            # cut off by an extra head of their own and dropped.
            cuts = np.sort(np.concatenate([heads, starts[alone]]))
            keep = np.isin(cuts, heads, assume_unique=True)
            self.both.append(np.bitwise_and.reduceat(self.both[-1], cuts)[keep])
            self.either.append(np.bitwise_or.reduceat(self.either[-1], cuts)[keep])
            self.first.append(heads)
            self.count.append(ends - heads)
            renumber = np.cumsum(~alone) - 1
            group = renumber[group[heads]]
            sizes = np.bincount(group, minlength=len(tall))
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])

    def apart(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits in which every code under ``a`` differs from every code under ``b``."""
        both, either = self.both[level], self.either[level]
        return np.bitwise_count((both[a] & ~either[b]) | (both[b] & ~either[a]))

    def pairs(self, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions ``a < b`` of codes of one group within ``distance``, a bounded part at a time."""
        work = [(level, top, top) for level, top in enumerate(self.tops) if len(top)]
        while work:
            level, a, b = work.pop()
            if level == 0:
                yield a, b
                continue
            if len(a) > PAIRS:
                work.append((level, a[PAIRS:], b[PAIRS:]))
                a, b = a[:PAIRS], b[:PAIRS]
            first, count = self.first[level], self.count[level]
            n = count[a] * count[b]
            pair = np.repeat(np.arange(len(a)), n)
            place = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
            wide = count[b][pair]
            one, other = first[a][pair] + place // wide, first[b][pair] + place % wide
            wanted = one < other if level == 1 else one <= other
            one, other = one[wanted], other[wanted]
            near = self.apart(level - 1, one, other) <= distance
            if near.any():
                work.append((level - 1, one[near], other[near]))


def _links(codes: np.ndarray, starts: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links: for every linked code the first code of its class within its group."""
    parent = np.arange(len(codes))
    for a, b in _Tree(codes, starts).pairs(distance):
        parent = unite(parent, a, b)
    linked = np.flatnonzero(parent != np.arange(len(codes)))
    return codes[parent[linked]].view(np.int64), codes[linked].view(np.int64)


def _join(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by upper node and Gray rank; only whole upper nodes are indexed."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held, size = [], 0

    def found(columns: list[np.ndarray]) -> pa.RecordBatch:
        codes, mask, pattern = columns
        new = np.flatnonzero((np.diff(mask) != 0) | (np.diff(pattern) != 0)) + 1
        starts = np.concatenate([[0], new])
        a, b = _links(codes.view(np.uint64), starts, distance)
        return pa.record_batch([pa.array(a), pa.array(b)], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([np.asarray(column) for column in batch.columns])
        size += batch.num_rows
        if size < CODES:
            continue
        columns = [np.concatenate(parts) for parts in zip(*held, strict=True)]
        same = (columns[1] == columns[1][-1]) & (columns[2] == columns[2][-1])
        cut = len(same) - int(same[::-1].argmin()) if not same.all() else 0
        if cut:
            yield found([column[:cut] for column in columns])
        held, size = [[column[cut:] for column in columns]], len(same) - cut
    if size:
        yield found([np.concatenate(parts) for parts in zip(*held, strict=True)])


def near_codes(codes: DataFrame, distance: int = 4) -> DataFrame:
    """Links ``(a, b)`` that connect the same codes as all pairs within ``distance`` bits do.

    ``codes`` has one long column ``code`` without nulls or repeats, and should be a stored table. Per upper node only
    a spanning forest of the links is put out, so a class of n codes gives fewer than 15 n rows and never n * n.
    """
    nodes = _nodes(codes, distance).select("code", "mask", "pattern")
    rank = unsigned(gray_rank(F.col("code")))
    # A hash of the node spreads the nodes; their sizes are bounded.
    dealt = nodes.repartition("mask", "pattern").sortWithinPartitions("mask", "pattern", rank)
    return dealt.mapInArrow(lambda batches: _join(batches, distance), "a long, b long").distinct()

