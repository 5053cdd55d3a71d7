"""Substring recall from a stored table of grams, so that a search reads postings and not all texts.

The table ``chunk_gram`` has rows for every different gram of a partition's texts in lower case, with the ids of the
chunks that have it: ``GRAM`` characters from every place, fewer at the end of a text. Several runs of texts may make up a
partition; a gram has a row in each of them, with the lowest id of the run, and all grams of a text are in its run. Lists
are packed (``gram_lists.packed``). The table lies beside the chunks in the same partitions, sorted by gram; a list has at
most the chunks of its run. A feed that rewrites a partition of chunks rewrites its grams in the same version.

A term of up to ``GRAM`` characters is in a text exactly when a gram starts with it. Of a longer term the ``RAREST``
rarest grams are looked up; chunks that have them all are the candidates, and only these are read and checked. Lists
are shuffled as they are packed, and only what a run's lists share becomes rows.
"""

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from kbspark.functions import gram_lists
from kbspark.operators.contains import GRAM, full_grams
from kbspark.operators.limits import GROUP_LIMIT_MAX, broadcast_if, pin
from kbspark.operators.lookup import looked_up
from kbspark.sources.versions import Part, Versions

RAREST = 2

# Rows of lists that a task puts out at a time.
_GRAM_ROWS = 4096

# Lowest ids of a short term that are looked at first.
FIRST_IDS = GROUP_LIMIT_MAX

# Shares of a longer term's candidates up to which they are read before all are, each about as exact as the other number
# tells; a share has so many candidates at least for each chunk that the term needs.
SHARES = (1 / 512, 1 / 64, 1 / 8)
FIRST_TIMES = 8
_SHARE_ACCURACY = 2000

# Ids of lists that are looked at together.
_IDS = 1 << 20

# Bytes of a broadcast term, and of a candidate.
_TERM_BYTES = 400
_CANDIDATE_BYTES = 400


def _grams(text: Column) -> Column:
    """The different grams of a text, with the shorter ones at its end."""
    tails = [F.substring(text, -size, size) for size in range(1, GRAM)]
    return F.array_distinct(F.concat(full_grams(text), F.filter(F.array(*tails), lambda tail: F.length(tail) > 0)))


def grams_of(chunks: DataFrame, block_documents: int, packed: bool = False) -> DataFrame:
    """Rows of ``chunk_gram`` of chunks of any status, which have their ``block``; the ids as lists, or ``packed``.

    Every task lists the grams of the texts that it reads; a partition that several batches hold has several rows of a
    gram. So no row is made for a gram and a text, and nothing is shuffled.
    """
    texts = chunks.filter("id IS NOT NULL AND content IS NOT NULL").select("space_id", "block", "id", F.lower("content").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place: dict[tuple, list[int]] = {}
            for n, part in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                place.setdefault(part, []).append(n)
            ids = batch.column(2).to_numpy(zero_copy_only=False)
            for (space, block), own in place.items():
                for grams, found in gram_lists.lists(ids[own], batch.column(3).take(pa.array(own)).to_pylist()):
                    lowest = int(found.values.to_numpy().min())
                    for first in range(0, len(grams), _GRAM_ROWS):
                        some, few = grams[first:first + _GRAM_ROWS], found.slice(first, _GRAM_ROWS)
                        yield pa.RecordBatch.from_arrays([
                            *[pa.array([one] * len(some), pa.int64()) for one in (space, block)], pa.array(some, pa.string()),
                            pc.list_value_length(few).cast(pa.int64()), pa.array([lowest] * len(some), pa.int64()),
                            gram_lists.packed(few, lowest) if packed else few],
                            names=["space_id", "block", "gram", "chunks", "lowest", "chunk_ids"])

    kind = "binary" if packed else "array<long>"
    lists = texts.mapInArrow(run, f"space_id long, block long, gram string, chunks long, lowest long, chunk_ids {kind}")
    # A partition's rows go by its blocks, which are ranges of document ids.
    return lists.select("space_id", (F.col("block") * block_documents).alias("document_id"), "gram", "chunks", "lowest", "chunk_ids")


def build(store: Versions) -> int:
    """Stores the grams of all chunks of the newest version."""
    base = store.current()
    grams = grams_of(store.read("kb_chunk", base), store.block_documents, packed=True)
    return store.commit(base, {"chunk_gram": grams}, placed=["chunk_gram"])


def _chosen(store: Versions, version: int, spaces: Callable[[DataFrame], DataFrame], terms: DataFrame) -> DataFrame:
    """``(space_id, key, term, n, needed)``: the rarest grams of each term that is longer than a gram, numbered."""
    keys = ["space_id", "key"]
    asked = pin(terms.filter(F.length("term") > GRAM).select(
        "space_id", "term", F.explode(full_grams(F.col("term"))).alias("key")), "asked-grams")
    wanted = pin(asked.select(*keys).distinct(), "wanted-grams")
    counts = spaces(store.read("chunk_gram", version)).select("space_id", F.col("gram").alias("key"), "chunks").join(
        broadcast_if(wanted, wanted.count(), _TERM_BYTES), keys).groupBy(*keys).agg(F.sum("chunks").alias("chunks"))
    of_term = Window.partitionBy("space_id", "term")
    place = F.row_number().over(of_term.orderBy(F.coalesce("chunks", F.lit(0)), "key"))
    return pin(asked.join(counts, keys, "left").withColumn("n", place).filter(F.col("n") <= RAREST).select(
        *keys, "term", "n", F.max("n").over(of_term).alias("needed")), "rarest-grams")


def _between(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of grams that may start with a key."""
    # Grams lie sorted: where few are asked for, the ends of their range keep most files and pages unread.
    # The last end is not that of the last key: what starts with "a" goes on beyond what starts with "ab".
    low, high = keys.agg(F.min("key"), F.max(F.concat("key", F.lit(chr(0x10FFFF))))).first()
    return rows if low is None else rows.filter((F.col("gram") >= low) & (F.col("gram") <= high))


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``_IDS`` bytes of lists, or one row."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + _IDS, "right")))
        yield first, last
        first = last


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(space_id, term, chunk_id, block)`` of ``(space_id, term, block, lowest, needed, found)``, the lists of a run:
    ids that are in lists of all grams needed."""
    for batch in batches:
        found = batch.column(5)
        of_row, held = pc.list_value_length(found).to_numpy(zero_copy_only=False).astype(np.int64), found.flatten()
        place, lists = (held.field(n) for n in range(2))
        bytes_of = np.add.reduceat(pc.binary_length(lists).to_numpy(zero_copy_only=False), np.append(0, np.cumsum(of_row)[:-1])) if len(of_row) else of_row
        bounds = np.append(0, np.cumsum(of_row))
        lowest, needed = (batch.column(n).to_numpy(zero_copy_only=False) for n in (3, 4))
        for first, last in _slices(bytes_of):
            some, row = slice(bounds[first], bounds[last]), np.repeat(np.arange(first, last), of_row[first:last])
            ids, sizes = gram_lists.unpacked(lists[some], lowest[row])
            row, key = np.repeat(row, sizes), np.repeat(place[some].to_numpy(zero_copy_only=False), sizes)
            order = np.lexsort((key, ids, row))
            row, key, ids = row[order], key[order], ids[order]
            pair = np.append(True, (row[1:] != row[:-1]) | (ids[1:] != ids[:-1]))[:len(ids)]
            new = pair.copy()
            new[1:] |= key[1:] != key[:-1]
            starts = np.flatnonzero(pair)
            met = starts[np.add.reduceat(new.astype(np.int64), starts) == needed[row[starts]]] if len(starts) else starts
            at = pa.array(row[met])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(ids[met]), batch.column(2).take(at)],
                                             names=["space_id", "term", "chunk_id", "block"])


def _candidates(store: Versions, version: int, spaces: Callable[[DataFrame], DataFrame], chosen: DataFrame) -> DataFrame:
    """``(space_id, term, chunk_id, block)`` of the chunks that have the chosen grams of a term."""
    lists = _between(spaces(store.read("chunk_gram", version)), chosen).withColumnRenamed("gram", "key").join(
        broadcast_if(chosen, chosen.count(), _TERM_BYTES), ["space_id", "key"])
    # Runs of different texts may share their lowest id, where ids repeat; then they are looked at as one.
    run = lists.groupBy("space_id", "term", "block", "lowest").agg(
        F.any_value("needed").alias("needed"), F.collect_list(F.struct("n", "chunk_ids")).alias("found"))
    met = run.filter(F.size("found") >= F.col("needed")).select("space_id", "term", "block", "lowest", "needed", "found")
    rows = met.mapInArrow(_common, "space_id long, term string, chunk_id long, block long")
    return pin(rows.groupBy("space_id", "term", "chunk_id").agg(F.any_value("block").alias("block")), "candidates")


def _postings(store: Versions, version: int, spaces: Callable[[DataFrame], DataFrame], keys: DataFrame,
              most: int | None = None) -> DataFrame:
    """``(space_id, key, chunk_id, block)`` of the chunks that have a gram which starts with a key; one scan.

    With ``most`` only the ``most`` lowest chunk ids of a key, cut in every task before anything is shuffled.
    """
    keys = pin(keys.select("space_id", "key").distinct(), "gram-keys")
    sizes = sorted(row[0] for row in keys.select(F.length("key")).distinct().collect())
    rows = _between(spaces(store.read("chunk_gram", version)), keys)
    starts = F.array_distinct(F.array(*[F.substring("gram", 1, size) for size in sizes]).cast("array<string>"))
    # The outer form keeps Spark from adding a filter on the array's size, which would build the array twice.
    some = rows.select("space_id", "block", "lowest", "chunk_ids", F.explode_outer(starts).alias("key"))
    met = some.join(broadcast_if(keys, keys.count(), _TERM_BYTES), ["space_id", "key"]).select("space_id", "key", "block", "lowest", "chunk_ids")

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lowest = batch.column(3).to_numpy(zero_copy_only=False)
            spaces_of, keys_of = (batch.column(n).dictionary_encode().indices.to_numpy(zero_copy_only=False) for n in range(2))
            key = spaces_of.astype(np.int64) << 32 | keys_of
            for first, last in _slices(pc.binary_length(batch.column(4)).to_numpy(zero_copy_only=False)):
                ids, sizes = gram_lists.unpacked(batch.column(4)[first:last], lowest[first:last])
                row = np.repeat(np.arange(first, last), sizes)
                if most is not None:
                    # What is beyond the lowest of some lists is beyond the lowest of all.
                    order = np.lexsort((ids, key[row]))
                    row, ids = row[order], ids[order]
                    new_key = np.append(True, key[row][1:] != key[row][:-1])[:len(ids)]
                    kept = new_key | np.append(True, ids[1:] != ids[:-1])[:len(ids)]
                    row, ids, new_key = row[kept], ids[kept], new_key[kept]
                    starts = np.flatnonzero(new_key)
                    kept = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids)))) < most
                    row, ids = row[kept], ids[kept]
                yield pa.RecordBatch.from_arrays([*[batch.column(n).take(pa.array(row)) for n in range(3)], pa.array(ids)],
                                                 names=["space_id", "key", "block", "chunk_id"])

    met = met.mapInArrow(ids_of, "space_id long, key string, block long, chunk_id long")
    if most is not None:
        place = F.dense_rank().over(Window.partitionBy("space_id", "key").orderBy("chunk_id"))
        met = met.withColumn("n", place).filter(F.col("n") <= most).drop("n")
    # A chunk may have several grams that start with a short key.
    return pin(met.distinct(), "postings")


def recall(store: Versions, searchable: Callable[[DataFrame], DataFrame], version: int | None = None,
           spaces: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Callable[[DataFrame, int | None], DataFrame]:
    """A function of distinct ``(space_id, term)``, in lower case, and of how many chunks a term needs (none: all).

    It gives ``(space_id, term, chunk_id)``: the lowest ids of chunks that ``searchable`` keeps and whose text in lower
    case contains the term. ``spaces`` keeps rows of the spaces that are searched.
    """
    version = store.current() if version is None else version

    def texts(parts: list[Part]) -> DataFrame:
        return searchable(store.read("kb_chunk", version, parts)).select(
            F.col("id").alias("chunk_id"), F.lower("content").alias("text"))

    def starting(short: DataFrame, most: int | None) -> DataFrame:
        """Chunks of terms that no gram is shorter than: no text is read.

        Many chunks have such a term, so only the lowest ids are looked at first. Where too few of a term's lowest ids
        can be returned, and there are more, all of its chunks are.
        """
        live = spaces(searchable(store.read("kb_chunk", version))).select(F.col("id").alias("chunk_id"))

        def of(keys: DataFrame, first: int | None) -> tuple[DataFrame, DataFrame]:
            postings = _postings(store, version, spaces, keys, first).withColumnRenamed("key", "term")
            return postings, pin(postings.select("space_id", "term", "chunk_id").distinct().join(live, "chunk_id", "left_semi"), "short-terms")

        keys = short.select("space_id", F.col("term").alias("key"))
        if most is None or most > FIRST_IDS:
            return of(keys, None)[1].select("space_id", "term", "chunk_id")
        looked, kept = of(keys, FIRST_IDS)
        some = looked.groupBy("space_id", "term").agg(F.count_distinct("chunk_id").alias("looked")).join(
            kept.groupBy("space_id", "term").agg(F.count("*").alias("kept")), ["space_id", "term"], "left")
        open_ = pin(some.filter((F.col("looked") >= FIRST_IDS) & (F.coalesce("kept", F.lit(0)) < most)).select("space_id", "term"), "open-terms")
        if open_.isEmpty():
            return kept.select("space_id", "term", "chunk_id")
        rest = of(open_.withColumnRenamed("term", "key"), None)[1]
        return kept.join(open_, ["space_id", "term"], "left_anti").unionByName(rest).select("space_id", "term", "chunk_id")

    def holding(candidates: DataFrame) -> DataFrame:
        """Candidates whose text has the term; texts are read where one lies."""
        parts = [Part(row["space_id"], row["block"]) for row in candidates.select("space_id", "block").distinct().collect()]
        return looked_up(
            texts(parts), candidates.drop("block"), "chunk_id", candidates.count(), _CANDIDATE_BYTES,
            then=lambda joined: joined.filter(F.contains("text", F.col("term"))).select("space_id", "term", "chunk_id"))

    def lowest_holding(candidates: DataFrame, most: int) -> DataFrame:
        """The same, as far as ``most`` of a term are needed.

        Candidates of a term are read in the order of their ids, a share of them first. Only where too few of a share have
        the term, the next share is read, up to all.
        """
        of_term = ["space_id", "term"]
        first, shares = F.lit(FIRST_TIMES * most), [F.lit(share) for share in SHARES]
        counted = candidates.groupBy(*of_term).agg(
            F.count("*").alias("n"), F.percentile_approx("chunk_id", F.array(*shares), _SHARE_ACCURACY).alias("ends"))
        # A share of too few candidates is left out; the last one has no end.
        ends = F.array(*[F.when(F.col("n") * share >= first, F.col("ends")[n]) for n, share in enumerate(shares)])
        open_ = pin(counted.select(*of_term, ends.alias("ends"), F.lit(None).cast("long").alias("after")), "open-terms")
        looked, found = [], None
        for n in range(len(SHARES) + 1):
            end = F.col("ends")[n] if n < len(SHARES) else F.lit((1 << 63) - 1)
            inside = (F.col("after").isNull() | (F.col("chunk_id") > F.col("after"))) & (F.col("chunk_id") <= end)
            some = pin(candidates.join(broadcast_if(open_, open_.count(), _TERM_BYTES), of_term).filter(inside).select(
                *candidates.columns), "some-candidates")
            if some.isEmpty():
                continue
            looked.append(pin(holding(some), "some-found"))
            found = reduce(DataFrame.unionByName, looked)
            enough = found.groupBy(*of_term).agg(F.count("*").alias("n")).filter(F.col("n") >= most)
            if n < len(SHARES):
                open_ = pin(open_.join(enough, of_term, "left_anti").withColumn("after", F.coalesce(end, "after")), "open-terms")
        return holding(candidates) if found is None else found

    def find(terms: DataFrame, most: int | None) -> DataFrame:
        terms = pin(terms.select("space_id", "term").filter(F.length("term") > 0), "terms")
        short = terms.filter(F.length("term") <= GRAM)
        chosen = _chosen(store, version, spaces, terms)
        candidates = _candidates(store, version, spaces, chosen)
        found = holding(candidates) if most is None else lowest_holding(candidates, most)
        if not short.isEmpty():
            found = found.unionByName(starting(short, most))
        if most is None:
            return found
        order = Window.partitionBy("space_id", "term").orderBy("chunk_id")
        return found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")

    return find
