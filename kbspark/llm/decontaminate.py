"""Benchmark decontamination by a generalised suffix automaton over words.

The automaton accepts every run of words of every test item. Training texts are streamed through it; the longest run
that ends at each word is known at every step, and all of its words are hit as soon as it holds a whole window.

The test items are read in slices of at most ``SLICE_BYTES`` of text, which is what an automaton may hold; more test
items mean more passes chained over the same scan of the texts, and nothing is shuffled.
"""

import math
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from kbspark.llm.common import binary_values, blocks, free_name

WINDOW = 13
SLICE_BYTES = 1 << 20

_GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
PLAIN = bytes(code + 32 if 0x41 <= code <= 0x5A else code if code >= 0x80 or 0x30 <= code <= 0x39
               or 0x61 <= code <= 0x7A else 0x20 for code in range(256))


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists of bounded size: A-Z in lower case, digits and all beyond ASCII."""
    for block in blocks(text.translate(PLAIN), _GAP):
        yield block.split()


class Automaton:
    """A generalised suffix automaton; ``items`` are lists of words."""

    def __init__(self, items: list[list[bytes]], window: int):
        self.window = window
        self.go, self.link, self.length = [{}], [-1], [0]
        ends, self.whole = [], {}
        for number, words in enumerate(items):
            last = 0
            for word in words:
                last = self._extend(last, word)
                ends.append((last, number))
        self.items = [set() for _ in self.go]
        for state, number in ends:
            self.items[state].add(number)
        for state in sorted(range(1, len(self.go)), key=self.length.__getitem__, reverse=True):
            if self.length[self.link[state]] >= window:
                self.items[self.link[state]] |= self.items[state]
        # An item shorter than a window counts where all of it occurs.
        for number, words in enumerate(items):
            if 0 < len(words) < window:
                state = 0
                for word in words:
                    state = self.go[state][word]
                self.whole.setdefault(state, []).append((len(words), number))

    def _extend(self, last: int, word: bytes) -> int:
        go, link, length = self.go, self.link, self.length

        def copy(state: int, target: int) -> int:
            go.append(dict(go[target]))
            link.append(link[target])
            length.append(length[state] + 1)
            clone = len(go) - 1
            link[target] = clone
            while state != -1 and go[state].get(word) == target:
                go[state][word] = clone
                state = link[state]
            return clone

        target = go[last].get(word)
        if target is not None:
            return target if length[target] == length[last] + 1 else copy(last, target)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        new, state = len(go) - 1, last
        while state != -1 and word not in go[state]:
            go[state][word] = new
            state = link[state]
        if state != -1:
            target = go[state][word]
            link[new] = target if length[target] == length[state] + 1 else copy(state, target)
        return new

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Words of the text, merged spans ``[start, end)`` of hit words, and the items with an occurring window."""
        go, link, length, window, whole = self.go, self.link, self.length, self.window, self.whole
        spans, items, state, size, place = [], set(), 0, 0, 0
        for words in words_of(text):
            for word in words:
                place += 1
                target = go[state].get(word)
                if target is None:
                    while state and target is None:
                        state = link[state]
                        target = go[state].get(word)
                    if target is None:
                        size = 0
                        continue
                    size = length[state]
                state = target
                size += 1
                if size >= window:
                    spans.append((place - size, place))
                    low = state
                    while length[link[low]] >= window:
                        low = link[low]
                    items |= self.items[low]
                if whole:
                    low = state
                    while low:
                        for words_needed, number in whole.get(low, ()):
                            if words_needed <= size:
                                spans.append((place - words_needed, place))
                                items.add(number)
                        low = link[low]
        return place, merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


_COMPILED = {}


def _compiled(name: str, items: list[bytes], window: int) -> Automaton:
    """The automaton of a slice, compiled once per Python worker."""
    if name not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[name] = Automaton([[word for part in words_of(text) for word in part] for text in items], window)
    return _COMPILED[name]


def slices(items: DataFrame, key: str, text: str) -> Iterator[tuple[list[str], list[bytes]]]:
    """Names and texts of the test items that have words, in parts whose texts fill at most about ``SLICE_BYTES``."""
    rows = items.select(F.col(key).cast("string").alias("name"), F.col(text).cast("binary").alias("text")).filter(
        F.col("text").isNotNull())
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size / SLICE_BYTES))
    for number in range(parts):
        part = rows.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == number) if parts > 1 else rows
        found = part.collect()
        yield [row["name"] for row in found], [bytes(row["text"]) for row in found]


_SPAN = StructType([StructField("start", LongType()), StructField("stop", LongType())])
FOUND = StructType([StructField("n_words", LongType()), StructField("spans", ArrayType(_SPAN)),
                    StructField("items", ArrayType(StringType()))])


def with_hits(docs: DataFrame, items: DataFrame, into: str, text: str = "text", item_key: str = "item_id",
              item_text: str = "text", window: int = WINDOW, cut: int | None = None) -> DataFrame:
    """``docs`` with a struct column ``into``: words, spans of hit words, and the sorted names of items found.

    A window is ``window`` consecutive words of an item, or the whole item when it has fewer words but some. Null and
    empty texts have no words; items without words, or with a null text, are never found; a null item key is put out
    as an empty name. Items with equal texts are all named; repeated names are named once. All columns and rows of
    ``docs`` stay; ``into`` must be a new name. Without items nothing is hit.
    With ``cut`` the last pass takes spans of at least so many words out of the text; ``into`` is of the text before.
    """
    context = docs.sparkSession.sparkContext
    parts = [context.broadcast(part) for part in slices(items, item_key, item_text)]
    for number, part in enumerate(parts):
        docs = _scanned(docs, part, into, text, window, number > 0, cut if number == len(parts) - 1 else None)
    return docs


def _scanned(docs: DataFrame, part, into: str, text: str, window: int, again: bool, cut: int | None) -> DataFrame:
    compiled_as = uuid.uuid4().hex
    kept = [column for column in docs.columns if not again or column != into]
    schema = StructType([*docs.select(*kept).schema.fields, StructField(into, FOUND)])
    kind = to_arrow_type(FOUND)

    def scan(batches):
        names, texts = part.value
        automaton = _compiled(compiled_as, texts, window)
        for batch in batches:
            columns = batch.schema.names
            before = batch.column(columns.index(into)).to_pylist() if again else None
            out, changed, place = [], {}, columns.index(text)
            for number, value in enumerate(binary_values(batch.column(place))):
                n_words, spans, items = automaton.scan(value)
                found = {names[item] or "" for item in items}
                if again:
                    spans = merged(spans + [(s["start"], s["stop"]) for s in before[number]["spans"]])
                    found |= set(before[number]["items"])
                out.append({"n_words": n_words, "spans": [{"start": a, "stop": b} for a, b in spans],
                            "items": sorted(found)})
                if cut is not None and (long := [span for span in spans if span[1] - span[0] >= cut]):
                    changed[number] = without_spans(value, long).decode()
            arrays = [batch.column(columns.index(name)) for name in kept]
            if changed:
                arrays[kept.index(text)] = pc.replace_with_mask(
                    batch.column(place), pa.array([number in changed for number in range(batch.num_rows)]),
                    pa.array(list(changed.values()), batch.column(place).type))
            yield pa.record_batch([*arrays, pa.array(out, kind)], names=[*kept, into])

    return docs.mapInArrow(scan, schema)


def n_hit(found):
    return F.aggregate(found["spans"], F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["start"])


def contaminated(found, coverage: int = 20):
    """At least one word in ``coverage`` is hit."""
    return (n_hit(found) > 0) & (coverage * n_hit(found) >= found["n_words"])


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without the words of ``spans`` and what stands between them; the rest stays as it is."""
    out, place, at, spans = [], 0, 0, list(spans)
    for match in re.finditer(rb"[\x30-\x39\x41-\x5A\x61-\x7A\x80-\xFF]+", text):
        if spans and place == spans[0][0]:
            out.append(text[at:match.start()])
        if spans and place == spans[0][1] - 1:
            at = match.end()
            spans.pop(0)
        place += 1
    return b"".join(out) + text[at:]


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", span_words: int | None = None,
                   coverage: int = 20, window: int = WINDOW, **names) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all columns.

    A row goes when at least one word in ``coverage`` is hit. Of the rest, hit spans of at least ``span_words`` words
    are cut out of the text when that is given; else texts stay as they are.
    """
    found = free_name(docs, "found")
    marked = with_hits(docs, items, found, text, window=window, cut=span_words, **names)
    return marked.filter(~contaminated(F.col(found), coverage)).select(*docs.columns)
