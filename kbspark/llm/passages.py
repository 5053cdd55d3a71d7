"""Removal of repeated passages with sharded Aho-Corasick automata.

A window is ``WINDOW`` consecutive words. Each window is named by an anchor: the ``GRAM`` words inside it whose hash is
lowest (leftmost of equals). Equal windows have equal anchors, and neighbouring windows mostly share theirs, so a text
has one anchor per seven words or so.

1. Texts are streamed for their anchors; anchors seen twice are kept. Anchors are counted, not gathered.
2. The stretch of text around each kept anchor that holds its windows is dealt out by anchor. An anchor of more than
   ``PART_ROWS`` stretches is salted over several parts.
3. In a shard, a bounded run of anchors, windows that recur are confirmed by hash and compiled word by word into an
   Aho-Corasick automaton. The stretches are streamed through it, which finds every occurrence, word for word. All but
   the earliest occurrence are marked. Parts of a salted anchor also put out their earliest occurrences, and all but
   the earliest of these are marked after a grouping by window.
4. Marked spans go back to their documents, which are streamed once more.

Texts that are equal as a whole are not searched: all but the first are copies from their first window to the last.
"""

import hashlib
import math
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, Window as W

from kbspark.llm.common import binary_values, blocks, small_side, stored, text_key
from kbspark.llm.decontaminate import merged
from kbspark.llm.word_hash import GAP, word_hashes

WINDOW = 20
GRAM = 8
PART_ROWS = 512

# Words per symbol of the automata: a power of two that divides the window.
BLOCK = 4
DIGITS = 64

# Bytes of text compiled and streamed at a time.
SHARD_BYTES = 4 << 20

_LAST_ID = (1 << 63) - 1

_SEGMENT = 1 << 16


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words between ASCII gaps, unchanged, in lists of bounded size."""
    for block in blocks(text, GAP):
        yield block.split()


def _grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` words in a row."""
    out = np.zeros(len(hashes) - width + 1, dtype=np.uint64)
    for place in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[place:place + len(out)]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(32)


def anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per anchor of a text, given its words' hashes: name, first window, number of windows, and how often it stands there.

    The windows of an anchor follow each other; together all windows are covered once. Where the same few words are
    said over and over, all windows of the run share one anchor, which then stands there many times.
    """
    if len(hashes) < WINDOW:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    grams = _grams(hashes, GRAM)
    windows = np.lib.stride_tricks.sliding_window_view(grams, WINDOW - GRAM + 1)
    lowest = np.concatenate([windows[at:at + _SEGMENT].argmin(axis=1) + np.arange(at, min(at + _SEGMENT, len(windows)))
                             for at in range(0, len(windows), _SEGMENT)])
    moved = np.concatenate([[True], np.diff(lowest) != 0])
    first = np.flatnonzero(np.concatenate([[True], np.diff(grams[lowest]) != 0]))
    count = np.diff(np.append(first, len(windows)))
    return grams[lowest[first]], first, count, np.add.reduceat(moved.astype(np.int64), first)


def _anchored(docs: DataFrame) -> DataFrame:
    """``(anchor, doc, twin, first, count, times)`` for every anchor of every text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [], []
            for value in binary_values(batch.column(2)):
                found.append(anchors(word_hashes(value)))
                sizes.append(len(found[-1][0]))
            place = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            names, first, count, times = [np.concatenate(column) for column in zip(*found, strict=True)]
            yield pa.record_batch(
                [pa.array(names.view(np.int64)), batch.column(0).take(place), batch.column(1).take(place),
                 pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(times.astype(np.int32))],
                names=["anchor", "doc", "twin", "first", "count", "times"])

    return docs.select("doc", "twin", "text").mapInArrow(
        read, "anchor long, doc long, twin long, first int, count int, times int")


def _stretches(docs: DataFrame) -> DataFrame:
    """``(anchor, part, parts, doc, twin, first, text)``: for each kept anchor the words of its windows.

    ``docs`` has the kept anchors of a text as the list ``kept``.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[] for _ in range(7)]
            for doc, twin, value, kept in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                              binary_values(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                kept.sort(key=lambda one: one["first"])
                held, start, place = [], 0, 0
                for words in words_of(value):
                    held += words
                    # The stretches that end within the words read so far.
                    while place < len(kept):
                        one = kept[place]
                        first = one["first"] - start
                        if first + one["count"] + WINDOW - 1 > len(held):
                            break
                        part = xxhash.xxh32_intdigest(f"{doc}:{twin}:{one['first']}") % one["parts"]
                        for column, item in zip(rows, (
                                one["anchor"], part, one["parts"], doc, twin, one["first"],
                                b" ".join(held[first:first + one["count"] + WINDOW - 1])), strict=True):
                            column.append(item)
                        place += 1
                    drop = len(held) if place == len(kept) else min(len(held), kept[place]["first"] - start)
                    held, start = held[drop:], start + drop
            yield pa.record_batch(
                [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()),
                 pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.int64()),
                 pa.array(rows[5], pa.int32()), pa.array(rows[6], pa.binary())],
                names=["anchor", "part", "parts", "doc", "twin", "first", "text"])

    return docs.select("doc", "twin", "text", "kept").mapInArrow(
        cut, "anchor long, part int, parts int, doc long, twin long, first int, text binary")


class _Shard:
    """Stretches of some whole anchors: finds all occurrences of the windows that recur among them.

    The automaton reads blocks of ``BLOCK`` words as one symbol, which makes it a quarter as large. A window is five
    symbols in a row; the stretches are streamed once for each place of a first block.
    """

    def __init__(self, salted: np.ndarray, docs: np.ndarray, twins: np.ndarray, firsts: np.ndarray, texts: list[bytes]):
        self.salted, self.docs, self.twins, self.firsts = salted, docs, twins, firsts
        numbers, lists = {}, []
        for text in texts:
            lists.append([numbers.setdefault(word, len(numbers)) for word in text.split(b" ")])
        self.words, self.lists = list(numbers), lists

    def _line(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All stretches in one line, each followed by a mark that is no word; their starts and sizes."""
        sizes = np.array([len(one) for one in self.lists])
        starts = np.cumsum(sizes + 1) - sizes - 1
        line = np.full(int(sizes.sum()) + len(sizes), len(self.words), dtype=np.int64)
        line[np.arange(sizes.sum()) + np.repeat(np.arange(len(sizes)), sizes)] = np.fromiter(
            chain.from_iterable(self.lists), np.int64, int(sizes.sum()))
        return line, starts, sizes

    def occurrences(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pattern, stretch and place of every occurrence of a recurring window."""
        line, starts, sizes = self._line()
        # Confirmed by hash; windows that reach over a mark are left out.
        hashes = _grams((line.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), WINDOW)
        stretch = np.repeat(np.arange(len(sizes)), sizes + 1)
        places = np.flatnonzero((np.arange(len(line)) - starts[stretch] <= (sizes - WINDOW)[stretch])[:len(hashes)])
        order = places[np.argsort(hashes[places], kind="stable")]
        same = hashes[order][1:] == hashes[order][:-1]
        recurring = order[np.flatnonzero(np.diff(np.concatenate([[False], same]).astype(np.int8)) == 1)]
        if not len(recurring):
            return (np.zeros(0, np.int64),) * 3
        symbols, size = line, 1
        while size < BLOCK:  # numbers of pairs, and of pairs of pairs: equal numbers are equal words
            pairs = symbols[:-size] * (symbols.max() + 1) + symbols[size:]
            symbols, size = np.unique(pairs, return_inverse=True)[1], 2 * size
        # A symbol is written in digits, so that no node of the automaton has many branches.
        digits = max(1, math.ceil(math.log(int(symbols.max()) + 1, DIGITS)))
        written = (symbols[:, None] // DIGITS ** np.arange(digits) % DIGITS).astype(np.uint8) + np.uint8(48)
        text = written[recurring[:, None] + np.arange(0, WINDOW, BLOCK)].tobytes().decode("latin-1")
        automaton, width = ahocorasick.Automaton(ahocorasick.STORE_INTS), WINDOW // BLOCK * digits
        for number in range(len(recurring)):
            automaton.add_word(text[number * width:(number + 1) * width], number)
        automaton.make_automaton()
        found = []
        for phase in range(BLOCK):
            hits = automaton.iter(written[phase::BLOCK].tobytes().decode("latin-1"))
            hits = np.fromiter(chain.from_iterable(hits), np.int64).reshape(-1, 2)
            hits = hits[(hits[:, 0] + 1) % digits == 0]  # others begin inside a symbol
            found.append((hits[:, 1], phase + BLOCK * ((hits[:, 0] + 1) // digits) - WINDOW))
        pattern, at = [np.concatenate(column) for column in zip(*found, strict=True)]
        return pattern, stretch[at], at - starts[stretch[at]]

    def spans(self) -> Iterator[tuple[np.ndarray, ...]]:
        """``(doc, twin, start, stop, window)``: spans to remove, and with a window's name the earliest of a part."""
        pattern, where, place = self.occurrences()
        start = self.firsts[where] + place
        order = np.lexsort((start, self.twins[where], self.docs[where], pattern))
        later = np.concatenate([[False], pattern[order][1:] == pattern[order][:-1]])[:len(order)]
        marked = order[later]
        marked = marked[np.lexsort((start[marked], where[marked]))]
        if len(marked):  # consecutive windows of a stretch make one span
            one, begin = where[marked], start[marked]
            heads = np.flatnonzero(np.concatenate([[True], (np.diff(one) != 0) | (np.diff(begin) > WINDOW)]))
            tails = np.append(heads[1:], len(marked)) - 1
            yield (self.docs[one[heads]], self.twins[one[heads]], begin[heads], begin[tails] + WINDOW,
                   [None] * len(heads))
        if not self.salted.any():
            return
        dropped = set(zip(where[marked].tolist(), place[marked].tolist(), strict=True))
        rows = []
        for number in np.flatnonzero(self.salted).tolist():
            one, first = self.lists[number], int(self.firsts[number])
            for at in range(len(one) - WINDOW + 1):
                if (number, at) not in dropped:
                    name = hashlib.md5(b" ".join([self.words[word] for word in one[at:at + WINDOW]])).digest()
                    rows.append((self.docs[number], self.twins[number], first + at, first + at + WINDOW, name))
        if rows:
            yield tuple(zip(*rows, strict=True))


def _marked(stretches: DataFrame) -> DataFrame:
    """``(doc, twin, start, stop, window)`` over all shards; a shard is a run of whole parts of anchors."""

    def out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        shard = _Shard(np.asarray(table["parts"]) > 1, *[np.asarray(table[name]) for name in ("doc", "twin", "first")],
                       table["text"].to_pylist())
        for columns in shard.spans():
            yield pa.record_batch([pa.array(column, kind) for column, kind in zip(
                columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)],
                names=["doc", "twin", "start", "stop", "window"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < SHARD_BYTES:
                continue
            keys = [np.concatenate([np.asarray(one.column(name)) for one in held]) for name in ("anchor", "part")]
            last = (keys[0] == keys[0][-1]) & (keys[1] == keys[1][-1])
            cut = len(last) - int(last[::-1].argmin()) if not last.all() else 0
            if cut:
                table = pa.Table.from_batches(held).combine_chunks()
                yield from out(table.slice(0, cut).to_batches())
                held = table.slice(cut).to_batches()
                size = sum(one.nbytes for one in held)
        if held:
            yield from out(held)

    dealt = stretches.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    return dealt.mapInArrow(search, "doc long, twin long, start int, stop int, window binary")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``(doc, twin, spans)``: the spans of words that repeat an earlier window, per text that has any.

    ``docs`` has ``doc``, ``twin`` (together the order of texts and their key, not null) and ``text``.
    """
    found = stored(_anchored(docs), "anchors")
    again = stored(found.groupBy("anchor").agg(F.sum("times").alias("n")).filter("n > 1").select(
        "anchor", F.ceil(F.col("n") / PART_ROWS).cast("int").alias("parts")), "recurring-anchors")
    # A list is no longer than its text.
    kept = stored(found.join(again, "anchor").groupBy("doc", "twin").agg(
        F.collect_list(F.struct("anchor", "first", "count", "parts")).alias("kept")), "kept-anchors")
    # The lists are a good part of the texts, so both sides are shuffled at any size.
    marks = stored(_marked(_stretches(docs.join(kept, ["doc", "twin"]))), "spans")
    order = W.partitionBy("window").orderBy("doc", "twin", "start")
    over_parts = marks.filter("window IS NOT NULL").withColumn("place", F.row_number().over(order)).filter("place > 1")
    spans = marks.filter("window IS NULL").select("doc", "twin", "start", "stop").unionByName(
        over_parts.select("doc", "twin", "start", "stop"))
    lists = spans.groupBy("doc", "twin").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return stored(lists.mapInArrow(_merged_lists, lists.schema), "spans")


def _merged_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's spans, those that touch as one; a text has few then."""
    for batch in batches:
        spans = [[{"start": a, "stop": b} for a, b in merged([(s["start"], s["stop"]) for s in one])]
                 for one in batch.column(2).to_pylist()]
        yield pa.record_batch([*batch.columns[:2], pa.array(spans, batch.schema.types[2])], names=batch.schema.names)


def _cut(value: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, list[bytes]]:
    """Words, removed words, and the words that are left."""
    words = [word for part in words_of(value) for word in part]
    if not spans:
        return len(words), 0, words
    left, at = [], 0
    for start, stop in sorted(spans):
        if start > at:
            left += words[at:start]
        at = max(at, stop)
    left += words[at:]
    return len(words), len(words) - len(left), left


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` for every row of ``docs``, and ``kept_text`` on demand.

    Removed is each word of a window whose words also start earlier: in a smaller key, or earlier in the same text.
    Null texts have no words; texts shorter than a window lose none. A null key comes after all others. Rows that
    repeat key and text are one document and get one result each; different texts of one key are taken in the order of
    a hash. Left words are joined by one space. Other columns are not read. An empty table gives an empty result.
    """
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    doc = F.coalesce("doc_id", F.lit(_LAST_ID)).alias("doc")
    names = stored(rows.select(doc, text_key(F.col("text")).alias("name"), F.xxhash64("text").alias("twin"))
                   .filter("name IS NOT NULL").distinct(), "text-names")
    # The hash orders texts only where a key has several.
    repeated = not names.groupBy("doc").count().filter("count > 1").isEmpty()
    twin = (F.coalesce(F.xxhash64("text"), F.lit(0)) if repeated else F.lit(0).cast("long")).alias("twin")
    if not repeated:
        names = names.withColumn("twin", F.lit(0).cast("long"))
    first = stored(names.groupBy("name").agg(F.min(F.struct("doc", "twin")).alias("first"), F.count(F.lit(1)).alias("n"))
                   .filter("n > 1"), "first-copies")
    copies = stored(names.join(small_side(first, 64), "name").filter(
        (F.col("first.doc") != F.col("doc")) | (F.col("first.twin") != F.col("twin"))).select("doc", "twin"), "copies")
    copied = small_side(copies, 32)
    keyed = rows.select("doc_id", doc, twin, "text")
    singles = keyed.filter("text IS NOT NULL").join(copied, ["doc", "twin"], "left_anti")
    if docs.isEmpty():
        spans = rows.sparkSession.createDataFrame([], "doc long, twin long, spans array<struct<start:int,stop:int>>")
    else:
        spans = repeated_spans(singles.dropDuplicates(["doc", "twin"]) if _has_repeats(keyed) else singles)
    marks = spans.select("doc", "twin", "spans", F.lit(False).alias("copy")).unionByName(copies.select(
        "doc", "twin", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"), F.lit(True).alias("copy")))
    marks = stored(marks, "marks")
    size = marks.agg(F.sum(F.coalesce(F.size("spans"), F.lit(0))).alias("n")).first()["n"] or 0
    joined = keyed.join(small_side(marks, 96 + 32 * max(0, size) // max(1, marks.count())), ["doc", "twin"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, spans, copy in zip(binary_values(batch.column(1)), batch.column(2).to_pylist(),
                                          batch.column(3).to_pylist(), strict=True):
                whole = [(0, len(value) + 1)] if copy else []
                n_words, n_removed, left = _cut(value, whole or [(s["start"], s["stop"]) for s in spans or ()])
                if copy and n_words < WINDOW:
                    n_words, n_removed, left = _cut(value, [])
                joined = b" ".join(left)
                out.append((n_words, n_removed, hashlib.sha256(joined).hexdigest(),
                            joined.decode() if with_text else None))
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.record_batch([batch.column(0), *[pa.array(column, kind) for column, kind in zip(
                columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    found = joined.select("doc_id", "text", "spans", "copy").mapInArrow(
        cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return found if with_text else found.drop("kept_text")


def _has_repeats(keyed: DataFrame) -> bool:
    """Whether a document stands in several rows."""
    return not keyed.filter("text IS NOT NULL").groupBy("doc", "twin").count().filter("count > 1").isEmpty()
