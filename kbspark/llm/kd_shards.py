"""Sharding by a k-d tree over metadata: recursive weighted medians along the widest dimension.

Only column expressions, groupings, windows and joins are used, and the tree is a table of cuts per level, so it may
have any number of leaves. Rows carry the node they are in and are written once a level; a level finds the cuts of all
its nodes together. A median is found over all rows, not a sample. Where a node has more than ``SORTED_ROWS``, a
histogram of its weights is narrowed until its bucket holds one value, first along the dimension and then, among rows
with that same value, along a hash of the key; a running sum over each node's buckets finds the next one. Smaller nodes
are sorted, each by one task. Texts are read once and never shuffled; of the tree nothing passes through the driver but
how many nodes are open.
"""

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from kbspark.llm.common import free_name, small_side, stored, utf8_size

# Buckets of a node's histogram, and rows of the histograms of all nodes.
BUCKETS = 2048
HISTOGRAM_ROWS = 8_000_000

# Rows of a node that one task sorts.
SORTED_ROWS = 20_000

# Rows of a shard that one task numbers.
SLOT_ROWS = 20_000

# Nodes whose cuts are in one file.
NODES_PER_FILE = 50_000

# Bytes of a broadcast cut, and of one with a text.
_CUT_BYTES = 120
_TEXT_CUT_BYTES = 400

# Ties are hashes; as doubles they lie between these.
_LOWEST_TIE, _HIGHEST_TIE = -float(1 << 63), float(1 << 63)


def ordinal(column: Column, kind: str) -> Column:
    """What orders as the column does: a number, or a text under which null comes first. Null numbers come first."""
    if kind == "string":
        return F.coalesce(F.concat(F.lit("+"), column), F.lit(""))
    if kind in ("timestamp", "timestamp_ntz", "date"):
        number = F.unix_micros(column.cast("timestamp")).cast("double")
    else:
        number = F.nanvl(column.cast("double"), F.lit(float("inf")))
    return F.coalesce(number, F.lit(-float("inf")))


def _ranks(values: DataFrame) -> DataFrame:
    """``(value, rank)`` of the different values of a one-column table, in their order from 0."""
    name = values.columns[0]
    parts = stored(values.select(F.col(name).alias("value")).distinct().repartitionByRange("value").select(
        "value", F.spark_partition_id().alias("part")), "values")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = parts.groupBy("part").count()
    offsets = counts.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(W.partitionBy("part").orderBy("value"))
    return stored(parts.withColumn("place", place).join(F.broadcast(offsets), "part").select(
        "value", (F.col("offset") + F.col("place") - 1).cast("double").alias("rank")), "ranks")


def _few(rows: DataFrame, nodes: int, purpose: str) -> DataFrame:
    """A stored table of a row per node, in few files."""
    return stored(rows.repartition(1 + nodes // NODES_PER_FILE), purpose)


class Tree(NamedTuple):
    """``levels``: a stored table ``(node, dim, at, at_text, cut_tie, half)`` each; a node is named by its first leaf."""

    dimensions: list[str]
    levels: list[DataFrame]


def _pick(dim: Column, values: list[Column]) -> Column:
    """The value of the dimension with number ``dim``."""
    return F.get(F.array(*values), dim)


def _open_nodes(rows: DataFrame, dimensions: list[str], whole: dict, leaves: int) -> DataFrame:
    """At most ``leaves`` nodes: those that still owe leaves, with the dimension to cut, its ends, and the weight to leave below the cut."""
    finite = {d: F.when(F.abs(d) == float("inf"), None).otherwise(F.col(d)) for d in dimensions}
    stats = rows.filter("owes > 1").groupBy("node", "owes").agg(
        F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("rows"),
        *[(F.max(finite[d]) - F.min(finite[d])).alias(f"width{n}") for n, d in enumerate(dimensions)],
        *[F.min(d).alias(f"low{n}") for n, d in enumerate(dimensions)],
        *[F.max(d).alias(f"high{n}") for n, d in enumerate(dimensions)])
    names = sorted(range(len(dimensions)), key=lambda n: dimensions[n])
    widths = [F.struct((F.coalesce(F.col(f"width{n}"), F.lit(0.0)) / whole[dimensions[n]] if whole[dimensions[n]] else F.lit(0.0))
                       .alias("width"), F.lit(place).alias("place"), F.lit(n).alias("n")) for place, n in enumerate(names)]
    dim, half = F.array_max(F.array(*widths))["n"], F.floor(F.col("owes") / 2).cast("int")
    chosen = stats.withColumns({"dim": dim, "half": half})
    ends = [_pick(F.col("dim"), [F.col(f"{end}{n}") for n in range(len(dimensions))]).alias(end) for end in ("low", "high")]
    goal = F.col("weight").cast("double") * F.col("half") / F.col("owes")
    return _few(chosen.select("node", "rows", "dim", "half", goal.alias("goal"), *ends), leaves, "open-nodes")


def _bucket(value: Column, low: Column, high: Column, buckets: int) -> Column:
    """The place of ``value`` among equal parts of ``low .. high``; the ends have buckets of their own."""
    inner = F.floor((value / 2 - low / 2) / (high / 2 - low / 2) * (buckets - 2)).cast("int") + 1
    return F.when(value <= low, 0).when(value >= high, buckets - 1).otherwise(
        F.least(F.greatest(inner, F.lit(1)), F.lit(buckets - 2)))


def _cuts_by_histograms(rows: DataFrame, nodes: DataFrame, dimensions: list[str], count: int) -> DataFrame:
    """``(node, dim, at, cut_tie, half)``: the smallest place, then tie, at which the running weight reaches the goal."""
    buckets = max(16, min(BUCKETS, HISTOGRAM_ROWS // max(1, count)))
    place, low, high = _pick(F.col("dim"), [F.col(d) for d in dimensions]), F.col("low"), F.col("high")
    value = F.when(F.col("at").isNull(), place).otherwise(F.col("tie").cast("double"))

    def narrowed(state: DataFrame) -> DataFrame:
        """Where the place is found, go on with the ties."""
        found = F.col("at").isNull() & (low == high)
        return state.select(
            "node", "dim", "half", "goal", "before", F.when(found, low).otherwise(F.col("at")).alias("at"),
            F.when(found, _LOWEST_TIE).otherwise(low).alias("low"), F.when(found, _HIGHEST_TIE).otherwise(high).alias("high"))

    state = narrowed(nodes.select("node", "dim", "half", "goal", F.lit(0.0).alias("before"), F.lit(None).cast("double").alias("at"),
                                  "low", "high"))
    state, done = _few(state, count, "cuts"), None
    while True:
        open_state = state.filter("low < high")
        finished = state.filter("low = high")
        done = finished if done is None else done.unionByName(finished)
        if not open_state.take(1):
            return done.select("node", "dim", "at", low.alias("cut_tie"), "half")
        inside = rows.join(small_side(open_state, _CUT_BYTES), "node").filter(
            (F.col("at").isNull() | (place == F.col("at"))) & value.between(low, high))
        kept = ["node", "dim", "half", "goal", "before", "at"]
        histogram = inside.groupBy(*kept, _bucket(value, low, high, buckets).alias("bucket")).agg(
            F.sum("weight").alias("weight"), F.min(value).alias("low"), F.max(value).alias("high"))
        by_bucket = W.partitionBy("node").orderBy("bucket")
        running = F.col("before") + F.sum("weight").over(by_bucket.rowsBetween(W.unboundedPreceding, W.currentRow))
        # Rounding may put a goal beyond the total: then it is the last bucket.
        last = F.lead("bucket").over(by_bucket).isNull()
        reached = histogram.withColumns({"running": running, "last": last}).filter((F.col("running") >= F.col("goal")) | F.col("last"))
        first = F.row_number().over(by_bucket) == 1
        state = _few(narrowed(reached.withColumn("first", first).filter("first").withColumn(
            "before", F.col("running") - F.col("weight"))), count, "cuts")


def _cuts_by_sorting(rows: DataFrame, nodes: DataFrame, dimensions: list[str]) -> DataFrame:
    """The same for nodes that a task can sort."""
    placed = rows.join(small_side(nodes.drop("low", "high", "rows"), _CUT_BYTES), "node").select(
        "node", "dim", "half", "goal", "weight", _pick(F.col("dim"), [F.col(d) for d in dimensions]).alias("at"),
        F.col("tie").cast("double").alias("cut_tie"))
    in_order = W.partitionBy("node").orderBy("at", "cut_tie").rangeBetween(W.unboundedPreceding, W.currentRow)
    reached = F.sum("weight").over(in_order) >= F.col("goal")
    cut = F.struct("at", "cut_tie")
    found = placed.withColumn("reached", reached).groupBy("node", "dim", "half").agg(
        F.coalesce(F.min(F.when(F.col("reached"), cut)), F.max(cut)).alias("cut"))
    return found.select("node", "dim", "cut.at", "cut.cut_tie", "half")


def _down(rows: DataFrame, cuts: DataFrame, dimensions: list[str], texts: frozenset[str] = frozenset()) -> DataFrame:
    """``rows`` with the ``node`` below; dimensions in ``texts`` are compared as texts. Rows with ``owes`` keep it up."""
    tie = F.col("tie").cast("double")
    ats = [F.col("at_text") if d in texts else F.col("at") for d in dimensions]
    above = [(F.col(d) > at) | ((F.col(d) == at) & (tie > F.col("cut_tie"))) for d, at in zip(dimensions, ats, strict=True)]
    above, half, columns = F.coalesce(_pick(F.col("dim"), above), F.lit(False)), F.col("half"), rows.columns
    side = small_side(cuts if texts else cuts.drop("at_text"), _TEXT_CUT_BYTES if texts else _CUT_BYTES)
    moved = rows.join(side, "node", "left").withColumn("above", above)
    new = {"node": F.when(F.col("above"), F.col("node") + half).otherwise(F.col("node"))}
    if "owes" in columns:
        new["owes"] = F.when(half.isNull(), F.col("owes")).when(F.col("above"), F.col("owes") - half).otherwise(half)
    return moved.select(*[new[name].alias(name) if name in new else F.col(name) for name in columns])


def _grown(rows: DataFrame, dimensions: list[str], leaves: int, ranks: dict[str, DataFrame]) -> tuple[Tree, DataFrame]:
    """The tree, and the rows with their leaf as ``node``."""
    finite = [F.when(F.abs(d) == float("inf"), None).otherwise(F.col(d)) for d in dimensions]
    widths = rows.agg(*[(F.max(f) - F.min(f)).alias(d) for f, d in zip(finite, dimensions, strict=True)]).first().asDict()
    current, levels = rows.withColumns({"node": F.lit(0), "owes": F.lit(leaves)}), []
    while True:
        nodes = _open_nodes(current, dimensions, widths, min(leaves, 1 << len(levels)))
        count, largest = nodes.agg(F.count(F.lit(1)), F.max("rows")).first()
        if not count:
            return Tree(dimensions, levels), current
        cuts = (_cuts_by_sorting(current, nodes, dimensions) if largest <= SORTED_ROWS
                else _cuts_by_histograms(current, nodes, dimensions, count))
        text = F.lit(None).cast("string")
        for n, d in enumerate(dimensions):
            if d in ranks:
                side = ranks[d].select(F.lit(n).alias("dim"), F.col("rank").alias("at"), F.col("value").alias(f"text{n}"))
                cuts, text = cuts.join(side, ["dim", "at"], "left"), F.coalesce(text, F.col(f"text{n}"))
        levels.append(_few(cuts.select("node", "dim", "at", text.alias("at_text"), "cut_tie", "half"), count, "tree-level"))
        current = stored(_down(current, levels[-1], dimensions), "tree-rows")


def kd_tree(rows: DataFrame, dimensions: list[str], leaves: int) -> Tree:
    """The cuts of a k-d tree with ``leaves`` leaves of nearly equal ``weight``.

    ``rows`` is a stored table with a double column per dimension, a long ``weight`` and a long ``tie`` that breaks
    ties. A node that still owes n leaves is split at the median that gives n // 2 leaves their share of its weight,
    along the dimension whose values are spread widest compared with the whole table; equal values go by ``tie``.
    """
    return _grown(rows, dimensions, leaves, {})[0]


def descended(rows: DataFrame, tree: Tree, into: str, texts: frozenset[str] = frozenset()) -> DataFrame:
    """``rows`` with the leaf that the cuts lead to, as the column ``into``.

    Cuts are broadcast where they fit the bound. Of the dimensions named in ``texts`` the rows have the texts themselves.
    """
    rows = rows.withColumn("node", F.lit(0))
    for cuts in tree.levels:
        rows = _down(rows, cuts, tree.dimensions, texts)
    return rows.withColumnRenamed("node", into)


def with_slots(rows: DataFrame, shard: str, key: str, total: int) -> DataFrame:
    """``rows`` with a long ``slot`` that numbers each shard's rows from 0 without gaps.

    Rows are numbered in hashed buckets of about ``SLOT_ROWS`` and moved up by the counts of the buckets before, so no
    task sorts a whole shard.
    """
    buckets = max(8, math.ceil(total / SLOT_ROWS))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*rows.columns), F.lit(buckets)))
    counts = rows.groupBy(shard, "bucket").count()
    before = W.partitionBy(shard).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(shard, "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inner = W.partitionBy(shard, "bucket").orderBy(key)
    return rows.withColumn("place", F.row_number().over(inner) - 1).join(offsets, [shard, "bucket"]).withColumn(
        "slot", (F.col("place") + F.col("offset")).cast("long")).drop("bucket", "place", "offset")


def _names(dimensions: list[str]) -> list[str]:
    return [f"d{n}" for n in range(len(dimensions))]


def _texts(docs: DataFrame, dimensions: list[str]) -> frozenset[str]:
    """Those of ``_names`` that are ordered as texts."""
    return frozenset(name for d, name in zip(dimensions, _names(dimensions), strict=True)
                     if docs.schema[d].dataType.typeName() == "string")


def _measured(docs: DataFrame, dimensions: list[str], key: str, text: str) -> list[Column]:
    """Weight, checksum, tie and coordinates of a row."""
    kinds = {field.name: field.dataType.typeName() for field in docs.schema.fields}
    crc = F.crc32(docs[text].cast("binary"))
    return [(utf8_size(docs[text]) + 1).alias("weight"), crc.alias("text_crc32"), F.xxhash64(docs[key], crc).alias("tie"),
            *[ordinal(docs[d], kinds[d]).alias(name) for d, name in zip(dimensions, _names(dimensions), strict=True)]]


def _ranked(rows: DataFrame, texts: frozenset[str]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """``rows`` with the ranks of texts in their place, and the ranks."""
    ranks = {name: _ranks(rows.select(name)) for name in sorted(texts)}
    for name, known in ranks.items():
        size = known.agg(F.max(F.octet_length("value"))).first()[0] or 0
        side = small_side(known.select(F.col("value").alias(name), F.col("rank").alias("rank_")), 100 + size)
        rows = rows.join(side, name).withColumn(name, F.col("rank_")).drop("rank_")
    return (stored(rows, "ranked-rows") if ranks else rows), ranks


def kd_shards(docs: DataFrame, dimensions: list[str], leaves: int | None = 8, target_bytes: int | None = None,
              key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` for every row of ``docs``; the law is ``bytes``.

    ``size`` is the UTF-8 length of the text plus 1, so a null text has size 1 and a null crc32. The number of shards
    is ``leaves``, or with ``target_bytes`` the total size over it. Each split is an exact weighted median, so the
    sizes of shards differ by a few documents at most. Dimensions are metadata columns of any type with an order;
    nulls come first, and texts are placed by their rank among all different values. Ties go by a hash of the key, then
    of key and text; rows that repeat key, text and dimensions stay together in a shard. Columns that are not named are
    not read. With fewer rows than shards some shards are empty; an empty table gives an empty result.
    """
    rows = stored(docs.select(docs[key].alias("doc_id"), *_measured(docs, dimensions, key, text)), "shard-rows")
    totals = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum("weight").alias("size")).first()
    if target_bytes:
        leaves = max(1, math.ceil((totals["size"] or 0) / target_bytes))
    rows, ranks = _ranked(rows, _texts(docs, dimensions))
    placed = _grown(rows, _names(dimensions), leaves, ranks)[1]
    narrow = placed.select("doc_id", F.col("weight").alias("size"), "text_crc32", F.col("node").cast("int").alias("shard"))
    return with_slots(narrow, "shard", "doc_id", totals["rows"])


def kd_sharded(docs: DataFrame, dimensions: list[str], leaves: int = 8, key: str = "doc_id",
               text: str = "text") -> DataFrame:
    """All columns of ``docs`` and the column ``shard`` of the k-d tree; repeated rows share a shard.

    The cuts of the tree are applied to each row, so texts are scanned again and not shuffled while the cuts of a level
    fit the broadcast bound.
    """
    measured, texts = _measured(docs, dimensions, key, text), _texts(docs, dimensions)
    rows, ranks = _ranked(stored(docs.select(*measured), "shard-rows"), texts)
    tree = _grown(rows, _names(dimensions), leaves, ranks)[0]
    whole, name = free_name(docs, "whole_row"), free_name(docs, "shard")
    carried = docs.select(F.struct(*[docs[column] for column in docs.columns]).alias(whole), *measured)
    return descended(carried, tree, "leaf", texts).select(f"{whole}.*", F.col("leaf").cast("int").alias(name))
