"""Embedding near-duplicates by an exact metric range join.

Unit vectors with cosine c are ``sqrt(2 - 2 c)`` apart, so links are pairs within a radius. Pivots cut each label's
vectors into cells (nearest pivot). A pair from two cells is compared in the higher one: a vector is copied to a cell
when the triangle inequality leaves room for a partner there, that is when it is within the radius of the border
between the two pivots and of the ball around the cell's own vectors. Cells are then joined independently, block by
block: ``BLOCK_ROWS`` vectors are held, all others of the cell stream past them, and large cells have more blocks.

Equal vectors are joined as one class, and only link counts and spanning forests are put out, never all pairs.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kbspark.llm.common import stored, text_key
from kbspark.llm.components import components
from kbspark.llm.union_find import unite

COSINE = 0.98
CELL_ROWS = 1_000
BLOCK_ROWS = 2_048
STREAM_ROWS = 512

# Pivots are broadcast: a fixed number at most; more vectors mean larger cells, which are cut into blocks.
MAX_PIVOTS = 2_048
_DRAWS = 4

_SLACK = 1e-9


def _units(rows: DataFrame) -> DataFrame:
    """``(vec_id, label, dim, raw, unit)``: the vector in double precision, scaled to length 1; unit null if invalid."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws, units, dims = [], [], []
            for values in batch.column(2).to_pylist():
                vector = np.array(values if values and None not in values else [], dtype=float)
                length = math.sqrt(float(vector @ vector)) if len(vector) and np.isfinite(vector).all() else 0.0
                if not math.isfinite(length) or length < 1e-150:  # the squares leave the range of doubles
                    top = np.abs(vector).max() if len(vector) and np.isfinite(vector).all() else 0.0
                    vector = vector / top if top > 0 else vector[:0]
                    length = math.sqrt(float(vector @ vector)) if top > 0 else 0.0
                raws.append(vector.tobytes())
                units.append((vector / length).tobytes() if length else None)
                dims.append(len(vector))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(dims, pa.int32()),
                                   pa.array(raws, pa.binary()), pa.array(units, pa.binary())],
                                  names=["vec_id", "label", "dim", "raw", "unit"])

    schema = rows.select("vec_id", "label").schema.add("dim", "integer").add("raw", "binary").add("unit", "binary")
    return rows.mapInArrow(scale, schema)


def _spread(vectors: np.ndarray, wanted: int) -> np.ndarray:
    """Of the drawn vectors, ``wanted`` that lie far apart: each next one is the farthest from those before."""
    chosen, nearest = [0], np.full(len(vectors), np.inf)
    while len(chosen) < min(wanted, len(vectors)):
        nearest = np.minimum(nearest, 2 - 2 * (vectors @ vectors[chosen[-1]]))
        far = int(nearest.argmax())
        if nearest[far] <= 1e-12:
            break
        chosen.append(far)
    return vectors[chosen]


def _pivots(classes: DataFrame) -> list[tuple[object, int, np.ndarray]]:
    """``(label, dim, pivots)`` per kind of vector; drawn by hash, about ``_DRAWS`` candidates for each pivot."""
    counts = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(row["n"] for row in counts)
    cell = max(CELL_ROWS, math.ceil(total / MAX_PIVOTS))
    share = min(1.0, _DRAWS / cell)
    limit = min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))
    drawn = classes.filter(F.xxhash64("key") <= limit).select("label", "dim", "unit", "key").orderBy("key").collect()
    out = []
    for row in counts:
        mine = [np.frombuffer(r["unit"]) for r in drawn if (r["label"], r["dim"]) == (row["label"], row["dim"])]
        if not mine:  # few vectors: their mean direction would do as well as any; the first axis is always there
            mine = [np.eye(1, row["dim"])[0]]
        out.append((row["label"], row["dim"], _spread(np.array(mine), math.ceil(row["n"] / cell))))
    return out


def _by_kind(batch: pa.RecordBatch, kinds: dict) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """The batch's rows by kind: positions and unit vectors."""
    labels, dims = batch.column("label").to_pylist(), batch.column("dim").to_pylist()
    units = batch.column("unit").to_pylist()
    places = {}
    for place, kind in enumerate(zip(labels, dims, strict=True)):
        places.setdefault(kind, []).append(place)
    for kind, rows in places.items():
        yield kind, np.array(rows), np.frombuffer(b"".join(units[row] for row in rows)).reshape(len(rows), kind[1])


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (vectors @ pivots.T), 0))


def _homes(classes: DataFrame, held) -> DataFrame:
    """``(key, label, dim, unit, size, cell, away)``: the cell of the nearest pivot and the distance to it."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, pivots = held.value
        for batch in batches:
            cell, away = np.zeros(batch.num_rows, dtype=np.int32), np.zeros(batch.num_rows)
            for kind, rows, vectors in _by_kind(batch, pivots):
                far = _distances(vectors, pivots[kind])
                cell[rows], away[rows] = first[kind] + far.argmin(axis=1), far.min(axis=1)
            yield pa.record_batch([*batch.columns, pa.array(cell), pa.array(away)],
                                  names=[*batch.schema.names, "cell", "away"])

    schema = classes.select("*").schema.add("cell", "integer").add("away", "double")
    return classes.mapInArrow(assign, schema)


def _dealt(homes: DataFrame, held, cells, radius: float) -> DataFrame:
    """``(cell, block, visitor, key, size, unit)``: each vector in the block that holds it and wherever it visits."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, pivots = held.value
        reach, n_blocks = cells.value
        for batch in batches:
            keys = batch.column("key").to_pylist()
            home = np.asarray(batch.column("cell"))
            rows_out, cells_out, blocks_out, visitor_out = [], [], [], []

            def put(row, cell, block, visits):
                rows_out.append(row)
                cells_out.append(cell)
                blocks_out.append(block)
                visitor_out.append(visits)

            for kind, rows, vectors in _by_kind(batch, pivots):
                centres, start = pivots[kind], first[kind]
                far = _distances(vectors, centres)
                between = _distances(centres, centres)
                for row, own, away in zip(rows, home[rows] - start, far, strict=True):
                    cell, count = start + own, n_blocks[start + own]
                    block = int.from_bytes(keys[row][:4], "big") % count
                    put(row, cell, block, False)
                    for later in range(block + 1, count):
                        put(row, cell, later, True)
                    other = np.arange(own + 1, len(centres))
                    border = (away[other] ** 2 - away[own] ** 2) / (2 * np.maximum(between[own, other], 1e-12))
                    ball = away[other] - reach[start + other]
                    for visited in other[(border <= radius + _SLACK) & (ball <= radius + _SLACK)]:
                        for later in range(n_blocks[start + visited]):
                            put(row, start + visited, later, True)
            taken = pa.array(rows_out, pa.int64())
            yield pa.record_batch(
                [pa.array(cells_out, pa.int32()), pa.array(blocks_out, pa.int32()), pa.array(visitor_out, pa.bool_()),
                 *[batch.column(name).take(taken) for name in ("key", "size", "unit")]],
                names=["cell", "block", "visitor", "key", "size", "unit"])

    return homes.mapInArrow(deal, "cell int, block int, visitor boolean, key binary, size long, unit binary")


class _Block:
    """The vectors held for one block: link counts of all that pass, and a spanning forest of the links."""

    def __init__(self, cosine: float):
        self.cosine, self.keys, self.sizes, self.units = cosine, [], [], []

    def hold(self, keys: list[bytes], sizes: np.ndarray, units: list[bytes]) -> None:
        self.keys += keys
        self.sizes.append(sizes)
        self.units += units

    def close(self) -> Iterator[tuple[list, list, list]]:
        """Compare the held vectors with each other, in strips."""
        self.matrix = np.frombuffer(b"".join(self.units)).reshape(len(self.keys), -1 if self.keys else 0)
        self.size = np.concatenate(self.sizes) if self.sizes else np.zeros(0, dtype=np.int64)
        self.counts, self.parent = np.zeros(len(self.keys), dtype=np.int64), np.arange(len(self.keys))
        for start in range(0, len(self.keys), STREAM_ROWS):
            near = self.matrix[start:start + STREAM_ROWS] @ self.matrix.T >= self.cosine
            place = np.arange(len(near))
            near[place, place + start] = False
            self.counts[start:start + len(near)] = near @ self.size
            row, other = np.nonzero(near)
            self.parent = unite(self.parent, row + start, other)
        linked = np.flatnonzero(self.counts)
        yield [self.keys[i] for i in linked], [None] * len(linked), self.counts[linked].tolist()
        self.counts[:] = 0

    def meet(self, keys: list[bytes], sizes: np.ndarray, units: list[bytes]) -> Iterator[tuple[list, list, list]]:
        for start in range(0, len(keys) if self.keys else 0, STREAM_ROWS):
            part = slice(start, start + STREAM_ROWS)
            vectors = np.frombuffer(b"".join(units[part])).reshape(-1, self.matrix.shape[1])
            near = vectors @ self.matrix.T >= self.cosine
            linked = np.flatnonzero(near.any(axis=1))
            if not len(linked):
                continue
            near, names = near[linked], [keys[start + i] for i in linked]
            first = near.argmax(axis=1)
            row, other = np.nonzero(near)
            self.parent = unite(self.parent, first[row], other)
            self.counts += sizes[part][linked] @ near
            yield names, [None] * len(names), (near @ self.size).tolist()
            yield names, [self.keys[i] for i in first], [0] * len(names)

    def rest(self) -> Iterator[tuple[list, list, list]]:
        linked = np.flatnonzero(self.counts)
        yield [self.keys[i] for i in linked], [None] * len(linked), self.counts[linked].tolist()
        below = np.flatnonzero(self.parent != np.arange(len(self.keys)))
        yield [self.keys[i] for i in below], [self.keys[i] for i in self.parent[below]], [0] * len(below)


def _joined(dealt: DataFrame, cosine: float) -> DataFrame:
    """``(a, b, links)``: partial link counts of ``a`` where ``b`` is null, else a link of the spanning forest."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found):
            for a, b, links in found:
                if a:
                    yield pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary()),
                                           pa.array(links, pa.int64())], names=["a", "b", "links"])

        now, block, held = None, None, True
        for batch in batches:
            cells, blocks = np.asarray(batch.column("cell")), np.asarray(batch.column("block"))
            visits = np.asarray(batch.column("visitor").cast(pa.int8()))
            cuts = np.flatnonzero(np.diff(cells) | np.diff(blocks) | np.diff(visits)) + 1
            for start, stop in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if start == stop:
                    continue
                part = batch.slice(start, stop - start)
                rows = (part.column("key").to_pylist(), np.asarray(part.column("size")), part.column("unit").to_pylist())
                if now != (cells[start], blocks[start]):
                    if block:
                        yield from out(block.close() if held else ())
                        yield from out(block.rest())
                    now, block, held = (cells[start], blocks[start]), _Block(cosine), True
                if not visits[start]:
                    block.hold(*rows)
                else:
                    if held:
                        yield from out(block.close())
                        held = False
                    yield from out(block.meet(*rows))
        if block:
            yield from out(block.close() if held else ())
            yield from out(block.rest())

    order = dealt.repartition("cell", "block").sortWithinPartitions("cell", "block", "visitor")
    return order.mapInArrow(join, "a binary, b binary, links long")


def near_vectors(rows: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding",
                 label: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``rows``.

    Two rows are linked when their labels are equal and not null, their vectors have equal length, and the cosine is
    at least ``cosine``. Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing. Rows
    that repeat a key are vectors of their own, linked when their vectors are. A null key is put out as null and is
    larger than any other; it is kept when its whole class has none. Other columns are not read. An empty table gives
    an empty result.
    """
    units = stored(_units(rows.select(F.col(key).alias("vec_id"), F.col(label).alias("label"),
                                      F.col(vector).cast("array<double>").alias("vector")))
                   .withColumn("key", F.when(F.col("label").isNotNull() & F.col("unit").isNotNull(), text_key(
                       F.concat(F.col("label").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("raw")))))
                   .drop("raw"), "unit-vectors")
    classes = stored(units.filter(F.col("key").isNotNull()).groupBy("key").agg(
        F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("unit").alias("unit"),
        F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("first_id")), "vector-classes")
    context = rows.sparkSession.sparkContext
    first, pivots, cells = {}, {}, 0
    for kind_label, dim, chosen in _pivots(classes):
        first[kind_label, dim], pivots[kind_label, dim] = cells, chosen
        cells += len(chosen)
    held = context.broadcast((first, pivots))
    homes = stored(_homes(classes.drop("first_id"), held), "home-cells")
    reach, n_blocks = np.zeros(cells), np.ones(cells, dtype=int)
    for row in homes.groupBy("cell").agg(F.max("away").alias("away"), F.count(F.lit(1)).alias("n")).collect():
        reach[row["cell"]], n_blocks[row["cell"]] = row["away"], math.ceil(row["n"] / BLOCK_ROWS)
    radius = math.sqrt(max(0.0, 2 - 2 * cosine))
    found = stored(_joined(_dealt(homes, held, context.broadcast((reach, n_blocks)), radius), cosine), "vector-links")
    counts = found.filter(F.col("b").isNull()).groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    roots = components(found.filter(F.col("b").isNotNull()).select("a", "b"))
    named = stored(classes.select("key", "size", "first_id").join(counts, "key", "left").join(
        roots.withColumnRenamed("node", "key"), "key", "left").select(
        "key", "first_id", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("root", "key").alias("root")), "vector-classes")
    lowest = stored(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "lowest")
    named = stored(named.join(lowest, "root").select("key", "n_links", "component_id"), "vector-classes")
    linked = units.filter(F.col("key").isNotNull()).select("vec_id", "key").join(named, "key").select(
        "vec_id", "n_links", "component_id")
    alone = units.filter(F.col("key").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                                       F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
