"""Toxicity by two class-conditional Kneser-Ney models.

One model is counted on toxic documents, one on ordinary ones. Both are over words given the word before. A pair's count
is discounted by ``DISCOUNT``; what is taken off goes to the lower order, which has Kneser-Ney's continuation counts: a word counts once for each different word before it, so a phrase that is copied a thousand times counts once.
Each count is discounted by ``DISCOUNT``, and what is taken off goes to a backoff in which words share counts: all
words with the same stem (first four bytes) have one, which counts the different words a class has with it. What the
discount takes off there goes to counts that both classes share: a stem counts once for each class it was seen in.

A text is judged by two values, each by words alone and by words given the word before: the difference of the two
log-likelihoods of all of it per word, and its most toxic expression, which is of all windows of ``EXPRESSION`` words
the highest such difference. So a few toxic
words in a long text are not diluted. The highest of many windows is higher by chance alone, so what it rises with the
logarithm of the number of words in ordinary texts is taken off before the values go into one logistic curve.

The difference at a word is a term of its stem plus a correction of the word, a term of the word before and a correction
of the pair. So the model is four look-up tables. Most pairs occur once in all counted texts. Their correction follows
from the likelihood of the word and from the number of words that follow the one before, so it is enough to know that a
pair is one of them, and of which class. They are not put into a table but into two Bloom filters of ``SINGLE_BITS`` bits
a pair, which executors build; one pair in some thousand that was never seen is taken for one that was seen once. Tables
and filters are cut into slices of at most about ``SLICE_ROWS`` rows, each a broadcast; a task reads them one after the
other for every ``BLOCK_WORDS`` words of its texts, so it holds one slice and one block at a time and one scan of the
texts is enough. Words are read as 32-bit hashes; words that collide share their counts.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from kbspark.llm.common import binary_values, small_side, stored
from kbspark.llm.decontaminate import PLAIN
from kbspark.llm.word_hash import word_hashes, word_stems
from kbspark.operators.limits import max_broadcast_bytes

DISCOUNT = 0.75
EXPRESSION = 2
SLICE_ROWS = 4_000_000

# Rows that the driver gathers at a time, also where a slice could have more.
GATHERED_ROWS = 1_000_000

# Bytes of a side that is broadcast to the pairs. The driver builds the whole table of such a side, some times as large,
# beside what it gathers of the model; larger ones are shuffled with the pairs, which are narrow rows.
JOINED_BYTES = 4 << 20

# Bits of a filter for each pair that occurs once, the bits that a pair sets, and the segments that a filter has.
SINGLE_BITS = 16
SINGLE_HASHES = 6
SEGMENTS = 4096

# Segments that a task puts out together.
SEGMENTS_AT_A_TIME = 64

# Words of texts whose terms a task holds together, and of those the ones that it looks up at a time.
BLOCK_WORDS = 2_000_000
STEP_WORDS = 1 << 17

# Pairs counted in a task before they are put out.
FLUSH_PAIRS = 1 << 18

# Newton steps of the calibration at most, and the prior that keeps its weights finite.
STEPS = 30
PRIOR = 1e-2

# Keys of the tables of a model.
KEYS = (np.uint32, np.uint32, np.uint32, np.uint64)

_START = np.zeros(1, dtype=np.uint64)


def hashed(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """32-bit hashes of the words and of the words before them (the first follows the start mark 0), and stems."""
    plain = text.translate(PLAIN)
    hashes = np.maximum(word_hashes(plain) >> np.uint64(32), np.uint64(1))
    return hashes, np.concatenate([_START, hashes[:-1]])[:len(hashes)], word_stems(plain)


def _counted(docs: DataFrame) -> DataFrame:
    """``(stemmed, pair, ordinary, toxic)``: how often each pair stands in documents of either class.

    A pair is a word after another word or, where ``stemmed``, after its own stem.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = ([], [], [], []), 0

        def out(stemmed: int):
            pairs = [np.concatenate(part) if part else np.zeros(0, np.uint64) for part in parts[2 * stemmed:][:2]]
            keys, place = np.unique(np.concatenate(pairs), return_inverse=True)
            cut = len(pairs[0])
            counts = [np.bincount(p, minlength=len(keys)) for p in (place[:cut], place[cut:])]
            return pa.record_batch(
                [pa.array(np.full(len(keys), bool(stemmed))), pa.array(keys.view(np.int64)),
                 *[pa.array(c.astype(np.int64)) for c in counts]], names=["stemmed", "pair", "ordinary", "toxic"])

        for batch in batches:
            for value, toxic in zip(binary_values(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                words, before, stems = hashed(value)
                parts[toxic].append(before << np.uint64(32) | words)
                parts[2 + toxic].append(np.unique(stems << np.uint64(32) | words))
                size += len(words)
                if size >= FLUSH_PAIRS:
                    yield out(0)
                    yield out(1)
                    parts, size = ([], [], [], []), 0
        if size:
            yield out(0)
            yield out(1)

    rows = docs.select("text", "toxic").mapInArrow(count, "stemmed boolean, pair long, ordinary long, toxic long")
    return rows.groupBy("stemmed", "pair").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def _classes(by: str) -> list[Column]:
    """Different pairs per class, and in all."""
    return [F.sum((F.col("ordinary") > 0).cast("long")).alias(f"{by}0"), F.sum((F.col("toxic") > 0).cast("long")).alias(f"{by}1"),
            F.count(F.lit(1)).alias(by)]


def _rest(counts: DataFrame, by: str) -> tuple[list[int], list[int], list[float]]:
    """Per class: all counts, entries that are not zero, and the share that the discount takes off."""
    sums = counts.agg(*[F.coalesce(F.sum(value), F.lit(0)) for c in "01" for value in (
        F.col(by + c), (F.col(by + c) > 0).cast("long"))]).first()
    total, seen = [sums[0], sums[2]], [sums[1], sums[3]]
    return total, seen, [DISCOUNT * v / n if n else 1.0 for n, v in zip(total, seen, strict=True)]


def _kept(by: str, c: int, total: list[int]) -> Column:
    return F.greatest(F.col(f"{by}{c}") - DISCOUNT, F.lit(0.0)) / max(1, total[c])


def _joined(rows: DataFrame, row_bytes: int) -> DataFrame:
    """A stored table that meets the pairs: broadcast up to ``JOINED_BYTES``, else merged with them."""
    small = rows.count() * row_bytes <= min(JOINED_BYTES, max_broadcast_bytes(rows.sparkSession))
    return F.broadcast(rows) if small else rows.hint("merge")


def _segment(pair: Column) -> Column:
    return pair.bitwiseXOR(F.shiftrightunsigned(pair, 32)).bitwiseAND(SEGMENTS - 1)


def _bits_of(pairs: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The bits of each pair within its segment of ``size`` bits, one hash after the other."""
    mixed = pairs * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    one, step = mixed >> np.uint64(32), (mixed & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    for n in range(SINGLE_HASHES):
        yield (one + np.uint64(n) * step) % np.uint64(size)


class Filter:
    """Whether pairs are among those that were put in: always yes for these, seldom yes for others."""

    def __init__(self, size: int, segments: dict[int, bytes]):
        """``size`` bits per segment, whose bytes are in ``segments`` where any bit is set."""
        self.size = size
        self.bits = np.zeros(SEGMENTS * size // 8 if segments else 0, dtype=np.uint8)
        for number, data in segments.items():
            self.bits[number * size // 8:(number + 1) * size // 8] = np.frombuffer(data, dtype=np.uint8)

    def has(self, pairs: np.ndarray) -> np.ndarray:
        out = np.full(len(pairs), bool(len(self.bits)))
        if not len(self.bits):
            return out
        start = ((pairs ^ pairs >> np.uint64(32)) & np.uint64(SEGMENTS - 1)) * np.uint64(self.size)
        for bit in _bits_of(pairs, self.size):
            place = start + bit
            out &= (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def _filters(singles: DataFrame, sizes: dict[tuple[int, int], int]) -> DataFrame:
    """``(part, toxic, segment, bits)`` of ``(part, toxic, pair)``; a segment is filled by one task.

    Pairs come to a task in the order of segments, so it holds one segment and one batch at a time.
    """
    names, schema = ["part", "toxic", "segment"], "part int, toxic int, segment int, bits binary"

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, marks, done = None, np.zeros(0, dtype=bool), []

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([*[pa.array([one[0][n] for one in done], pa.int32()) for n in range(3)],
                                               pa.array([one[1] for one in done], pa.binary())], names=[*names, "bits"])
            done.clear()
            return rows

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = np.stack([batch.column(name).to_numpy() for name in names])
            pairs = batch.column("pair").to_numpy().view(np.uint64)
            starts = np.flatnonzero(np.any(np.diff(columns, prepend=-1), axis=0))
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
                if key != (new := tuple(columns[:, start].tolist())):
                    if key is not None:
                        done.append((key, np.packbits(marks, bitorder="little").tobytes()))
                    key, marks = new, np.zeros(sizes[new[:2]], dtype=bool)
                for bit in _bits_of(pairs[start:end], len(marks)):
                    marks[bit] = True
                if len(done) >= SEGMENTS_AT_A_TIME:
                    yield out()
        if key is not None:
            done.append((key, np.packbits(marks, bitorder="little").tobytes()))
            yield out()

    return singles.select("part", "toxic", _segment(F.col("pair")).cast("int").alias("segment"), "pair").repartition(
        *names).sortWithinPartitions(*names).mapInArrow(fill, schema)


class Model:
    """``tables``: stored terms of stems, corrections of words, terms of the words before, corrections of pairs that
    occur more than once; ``unknown``: the term of any other stem; ``singles``: the other pairs.

    Terms are differences of log-likelihoods. Of what neither class has, only the ratio of the backoff shares is left.
    """

    def __init__(self, docs: DataFrame):
        """``docs`` has the columns ``text`` and ``toxic`` (0 or 1)."""
        pairs = stored(_counted(docs), "pairs")
        word, head = F.col("pair").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("pair", 32)
        words = stored(pairs.filter("NOT stemmed").groupBy(word.alias("word")).agg(*_classes("n")), "continuations")
        stems = stored(pairs.filter("stemmed").groupBy(head.alias("stem")).agg(*_classes("m")), "stems")
        (n, _, off), (m, seen, off_stems) = _rest(words, "n"), _rest(stems, "m")
        shared = ((F.col("m0") > 0).cast("long") + (F.col("m1") > 0).cast("long")) / max(1, sum(seen))
        backoff = stored(stems.select("stem", "m", *[
            (off[c] * (_kept("m", c, m) + off_stems[c] * shared)).alias(f"b{c}") for c in (0, 1)]), "backoff")
        term = F.log("b1") - F.log("b0")
        self.unknown = sum(math.log(share[1] / share[0]) for share in (off, off_stems))
        # Words of one stem share its backoff evenly.
        of_stem = pairs.filter("stemmed").select(head.alias("stem"), word.alias("word")).join(backoff, "stem")
        likely = [_kept("n", c, n) + F.col(f"b{c}") / F.col("m") for c in (0, 1)]
        lowest = stored(of_stem.join(words, "word").groupBy("word").agg(
            F.first(likely[0]).alias("p0"), F.first(likely[1]).alias("p1"),
            F.first(F.log(likely[1]) - F.log(likely[0]) - term).alias("term")), "lowest")
        follows = pairs.filter("NOT stemmed").select("pair", head.alias("before"), word.alias("word"), "ordinary", "toxic")
        before = stored(follows.groupBy("before").agg(*[one for c, name in enumerate(("ordinary", "toxic")) for one in (
            F.sum(name).alias(f"h{c}"), F.sum((F.col(name) > 0).cast("long")).alias(f"f{c}"))]).select(
            "before", "h0", "h1", "f0", "f1", *[F.when(F.col(f"h{c}") > 0, DISCOUNT * F.col(f"f{c}") / F.col(f"h{c}")).otherwise(1.0)
                                    .alias(f"o{c}") for c in (0, 1)]), "before")
        off_term = F.log("o1") - F.log("o0")
        given = [F.greatest(F.col(name) - DISCOUNT, F.lit(0.0)) / F.greatest(F.col(f"h{c}"), F.lit(1))
                 + F.col(f"o{c}") * F.col(f"p{c}") for c, name in enumerate(("ordinary", "toxic"))]
        often = F.col("ordinary") + F.col("toxic") > 1
        self.singles = follows.filter(~often).select("pair", F.col("toxic").cast("int"))
        of_pairs = follows.filter(often).join(_joined(lowest.select("word", "p0", "p1"), 24), "word").join(
            _joined(before, 40), "before").select("pair", (
                F.log(given[1]) - F.log(given[0]) - off_term - F.log("p1") + F.log("p0")).alias("term"))
        self.tables = [stored(rows.select(key.cast("long").alias("key"), *[F.col(name).cast("float") for name in names]), "terms")
                       for rows, key, names in ((backoff.withColumn("term", term - self.unknown), F.col("stem"), ["term"]),
                                                (lowest, F.col("word"), ["term", "p0", "p1"]),
                                                (before.withColumn("term", off_term), F.col("before"), ["term", "f0", "f1"]),
                                                (of_pairs, F.col("pair"), ["term"]))]

    def slices(self) -> Iterator[tuple[list[tuple[np.ndarray, list[np.ndarray]]], list[Filter]]]:
        """One after the other: of each table the sorted keys of a slice and their values; and the filters of its pairs.

        The first item is the number of slices.
        """
        single = self.singles.agg(F.count(F.lit(1))).first()[0]
        rows = sum(table.count() for table in self.tables) + single * SINGLE_BITS // 96
        parts = max(1, math.ceil(rows / min(SLICE_ROWS, GATHERED_ROWS)))
        yield parts
        singles = self.singles.withColumn("part", F.pmod("pair", F.lit(parts)).cast("int"))
        sizes = {(row["part"], row["toxic"]): max(64, math.ceil(row["count"] * SINGLE_BITS / SEGMENTS / 64) * 64)
                 for row in singles.groupBy("part", "toxic").count().collect()}
        filters = stored(_filters(singles, sizes), "single-pairs")
        for number in range(parts):
            tables = []
            for table, kind in zip(self.tables, KEYS, strict=True):
                found = (table.filter(F.pmod("key", F.lit(parts)) == number) if parts > 1 else table).toArrow()
                keys = found.column("key").to_numpy().view(np.uint64).astype(kind)
                order = np.argsort(keys)
                tables.append((keys[order], [found.column(name).to_numpy().astype(np.float32)[order] for name in found.column_names[1:]]))
                del found, keys, order
            own = filters.filter(F.col("part") == number).collect()
            held = [Filter(sizes.get((number, toxic), 64), {row["segment"]: bytes(row["bits"]) for row in own if row["toxic"] == toxic})
                    for toxic in (0, 1)]
            del own
            pa.default_memory_pool().release_unused()
            yield tables, held


def _add_values(into: list[np.ndarray], table: tuple[np.ndarray, list[np.ndarray]], keys: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Adds to ``into`` the values of ``keys[own]``, nothing where the table does not have a key; tells where it has."""
    known, values = table
    if not len(known) or not len(own):
        return np.zeros(len(own), dtype=bool)
    keys, back = np.unique(keys[own], return_inverse=True)
    keys = keys.astype(known.dtype)
    place = np.searchsorted(known, keys)
    place[place == len(known)] = 0
    has = known[place] == keys
    for array, value in zip(into, values, strict=True):
        array[own] += np.where(has, value[place], np.float32(0))[back]
    return has[back]


def _single_terms(values: list[np.ndarray], seen: np.ndarray) -> np.ndarray:
    """The corrections of pairs that were ``seen`` once in class 0, once in class 1, or (-1) otherwise.

    ``values``: likelihoods of the words by themselves, and how many words follow the ones before, of either class.
    """
    out = np.zeros(len(seen), np.float32)
    for c, sign in ((0, -1), (1, 1)):
        own = np.flatnonzero((seen == c) & (values[c] > 0) & (values[2 + c] > 0))
        rest = DISCOUNT * values[2 + c][own].astype(float) * values[c][own]
        out[own] = sign * np.log1p((1 - DISCOUNT) / rest)
    return out


def strongest(terms: np.ndarray, width: int = EXPRESSION) -> float:
    """The highest mean of ``width`` terms in a row, or of all when there are fewer."""
    if not len(terms):
        return 0.0
    width = min(width, len(terms))
    sums = np.concatenate([[0.0], np.cumsum(terms, dtype=float)])
    return float((sums[width:] - sums[:-width]).max() / width)


# What is found in a text: its strongest expression and the mean of all words, by words alone and given the words before.
FOUND = ("evidence", "sequence", "whole", "whole_given")


def evidence(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` but ``text``, those of ``FOUND``, and the number of ``words``; without words all are 0."""
    kept = [column for column in docs.columns if column != "text"]
    context, unknown = docs.sparkSession.sparkContext, model.unknown
    gathered = model.slices()
    parts = next(gathered)
    slices = [context.broadcast(one) for one in gathered]

    def judged(texts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[float, float, float, float, int]]:
        sizes = [len(text[0]) for text in texts]
        words, before, stems = (np.concatenate(arrays) for arrays in zip(*texts, strict=True))
        texts.clear()
        alone, given = np.zeros(len(words), np.float32), np.zeros(len(words), np.float32)
        likely = [np.zeros(len(words), np.float32) for _ in range(4)]
        # The class in which a pair was seen once.
        seen = np.full(len(words), -1, np.int8)
        for number, held in enumerate(slices):
            tables, singles = _value(held, parts > 1)
            for start in range(0, len(words), STEP_WORDS):
                step = slice(start, start + STEP_WORDS)
                pairs = before[step].astype(np.uint64) << np.uint64(32) | words[step]
                values = [array[step] for array in likely]
                into = [[alone[step]], [alone[step], *values[:2]], [given[step], *values[2:]], [given[step]]]
                for array, key, table in zip(into, (stems[step], words[step], before[step], pairs), tables, strict=True):
                    # In Spark a key is a signed number.
                    own = (np.flatnonzero(key.astype(np.uint64).view(np.int64) % parts == number) if parts > 1
                           else np.arange(len(key)))
                    known = _add_values(array, table, key, own)
                # The last table is that of the pairs; the others may be pairs that occur once.
                rest = own[~known]
                for toxic in (1, 0):
                    seen[step][rest[singles[toxic].has(pairs[rest])]] = toxic
        for start in range(0, len(words), STEP_WORDS):
            step = slice(start, start + STEP_WORDS)
            given[step] += alone[step] + _single_terms([array[step] for array in likely], seen[step])
        start = 0
        for size in sizes:
            one, other = alone[start:start + size], given[start:start + size]
            yield (*[value + unknown for value in (strongest(one), strongest(other), float(one.mean(dtype=float)),
                                                   float(other.mean(dtype=float)))], size) if size else (0.0, 0.0, 0.0, 0.0, 0)
            start += size

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches() if kept else []
            found = list(judged(texts))
            columns = [pa.array([one[n] for one in found], kind) for n, kind in enumerate(
                [pa.float64()] * len(FOUND) + [pa.int64()])]
            return pa.record_batch([*(rows[0].columns if rows else []), *columns], names=[*kept, *FOUND, "words"])

        held, texts, size = [], [], 0
        for batch in batches:
            start = 0
            for number, value in enumerate(binary_values(batch.column("text")), 1):
                texts.append(tuple(array.astype(np.uint32) for array in hashed(value)))
                size += len(texts[-1][0])
                if size >= BLOCK_WORDS:
                    held.append(batch.select(kept).slice(start, number - start))
                    yield out()
                    held, texts, size, start = [], [], 0, number
            if start < batch.num_rows:
                held.append(batch.select(kept).slice(start))
        if texts:
            yield out()

    schema = docs.select(*kept).schema
    for name in FOUND:
        schema = schema.add(name, "double")
    return docs.select(*kept, "text").mapInArrow(judge, schema.add("words", "long"))


def _value(held: Broadcast, again: bool) -> tuple:
    """A broadcast value; where it is one of many a worker does not keep it."""
    value = held.value
    if again:
        held.__dict__.pop("_value", None)
    return value


def drift(marked: DataFrame, value: str) -> float:
    """What ``value`` of ordinary texts rises by with the logarithm of the number of words, by least squares."""
    rise = marked.filter("toxic = 0").agg(F.regr_slope(value, F.log1p("words"))).first()[0]
    return max(0.0, rise) if rise is not None and math.isfinite(rise) else 0.0


def _line(values: list[Column], weights: np.ndarray) -> Column:
    line = sum((value * float(weight) for value, weight in zip(values, weights[1:], strict=True)), F.lit(float(weights[0])))
    return F.greatest(F.least(line, F.lit(30.0)), F.lit(-30.0))


def calibration(marked: DataFrame, values: list[Column]) -> np.ndarray:
    """Offset and weights of the logistic curve from ``values`` to the share of toxic documents.

    Fitted by Newton steps with a weak prior; a step that does not help is halved. Each step sums over all rows.
    """
    n = len(values) + 1
    inputs, toxic = [F.lit(1.0), *values], F.col("toxic")
    pairs = [(i, j) for i in range(n) for j in range(i + 1)]
    weights, step, best = np.zeros(n), np.zeros(n), math.inf
    for _ in range(STEPS):
        line = _line(values, weights + step)
        p = 1 / (1 + F.exp(-line))
        sums = marked.agg(F.sum(F.log1p(F.exp(-F.abs(line))) + F.greatest(line, F.lit(0.0)) - toxic * line),
                          *[F.sum((toxic - p) * one) for one in inputs],
                          *[F.sum(p * (1 - p) * inputs[i] * inputs[j]) for i, j in pairs]).first()
        if sums[0] is None:
            break
        loss = sums[0] + PRIOR / 2 * ((weights + step) ** 2).sum()
        if loss > best:
            step = step / 2
        else:
            weights, best = weights + step, loss
            curvature = np.eye(n) * PRIOR
            for (i, j), value in zip(pairs, sums[n + 1:], strict=True):
                curvature[i, j] += value
                curvature[j, i] = curvature[i, j]
            step = np.linalg.solve(curvature, np.array(sums[1:n + 1], dtype=float) - PRIOR * weights)
            step *= min(1.0, 20 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    return weights


def scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, score)`` for every row of ``docs``.

    ``labels`` has ``doc_id`` and ``toxic``; where a key is labelled twice the highest label counts, null keys and null
    labels are left out. Rows whose ``crc32`` of the key as text leaves 2 modulo 4 are held out. Of the other labelled
    rows, remainders 0 and 1 are counted and remainder 3 calibrates the curve, so no row is judged by its own counts
    there. Null and empty texts have no words and get what the curve says at zero. Rows with equal texts get equal
    scores. Without labels all scores are one half. Other columns are not read; an empty table gives an empty result.
    """
    rest = F.pmod(F.crc32(F.coalesce(docs[key].cast("string"), F.lit("")).cast("binary")), F.lit(4))
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"), rest.alias("rest"))
    known = stored(labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic")), "toxic-labels")
    side = small_side(known, 16)
    model = Model(rows.filter("rest < 2").join(side, "doc_id"))
    judged = stored(evidence(rows, model), "evidence")
    marked = stored(judged.filter("rest = 3").join(side, "doc_id").select(*FOUND, "words", "toxic"), "marked")
    values = [*[F.col(name) - drift(marked, name) * F.log1p("words") for name in FOUND[:2]],
              *[F.col(name) for name in FOUND[2:]]]
    line = _line(values, calibration(marked, values))
    return judged.select("doc_id", (F.col("rest") == 2).alias("held_out"), (1 / (1 + F.exp(-line))).alias("score"))
