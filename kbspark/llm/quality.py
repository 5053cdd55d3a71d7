"""Quality classifier from weak labels: no true label is read.

1. Overlapping heuristics vote bad, good or not at all on every document.
2. Documents are counted by their pattern of votes (at most ``3 ** len(HEURISTICS)`` patterns), and expectation
   maximisation over the patterns estimates how often each heuristic is right about either class.
3. The posterior of a document's pattern is its soft label. A linear scorer over hashed features is fitted to a bounded
   sample of labelled documents (about ``SAMPLE_ROWS``, the lowest hashes) and applied to all.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kbspark.llm.common import binary_values, blocks, free_name, stored

# The fitting sample: the documents whose hash of key and text lies in the share that so many are expected in.
SAMPLE_ROWS = 8_000
FEATURES = 1 << 12
ROUNDS = 50

# Documents are rejected only on clear evidence.
THRESHOLD = 0.2

SHORT_BYTES, SHORT_WORDS = 200, 20

GOOD, BAD, NONE = 1, 0, -1

_GAP = re.compile(rb"[\x20\x09-\x0D]")

# Frequent small words of the languages read.
SMALL_WORDS = frozenset(
    b"the of and to in is that it for was with as on be at by this are or an he from "
    b"der die und in den von zu das mit sich des auf ist im dem nicht ein eine als "
    b"de la le et les des en un du une que est pour qui dans par sur pas plus "
    b"el los las se por con una su para es al lo como".split())

# Byte classes: small letter, capital, digit, gap, line end, beyond ASCII; every other byte is its own class.
_CLASS = np.arange(256, dtype=np.int64)
_CLASS[ord("a"):ord("z") + 1] = ord("a")
_CLASS[ord("A"):ord("Z") + 1] = ord("A")
_CLASS[ord("0"):ord("9") + 1] = ord("0")
_CLASS[128:] = ord("a")
_CLASS[9:14] = 32
_CLASS[10] = 10


def _among(*codes: int) -> np.ndarray:
    flags = np.zeros(256, dtype=bool)
    flags[list(codes)] = True
    return flags


_LETTERS = _among(*range(65, 91), *range(97, 123), *range(128, 256))
_CAPITALS = _among(*range(65, 91))
_GAPS = _among(32, *range(9, 14))
_MARKS = _among(*b"#$%&*+/<=>@[]^_`{|}~\\")
_END_MARKS = _among(*b"#$%&*+<=>@^_|~")
_BARE_MARKS = _among(*b"|*#-+=~_<>")

# Of a feature row: first the hashed class trigrams, last the shares below in steps.
_SHARES = ("distinct words", "words that repeat the one before", "small words", "words without letters")
_STEPS = 16
_GRAMS = FEATURES - len(_SHARES) * _STEPS


class Profile:
    """What the heuristics and the scorer read of a text; counted block by block over the whole text."""

    def __init__(self, text: bytes):
        self.bytes = np.zeros(256, dtype=np.int64)
        self.grams = np.zeros(_GRAMS, dtype=np.int64)
        self.words = self.repeats = self.small = self.bare = self.marked = 0
        seen, last = set(), None
        for block in blocks(text, _GAP):
            codes = np.frombuffer(block, dtype=np.uint8)
            gap = np.concatenate([[True], _GAPS[codes], [True]])
            last_of_word = gap[2:] & ~gap[1:-1]
            self.marked += int(_END_MARKS[codes[last_of_word]].sum())
            self.bare += int(_BARE_MARKS[codes[last_of_word & gap[:-2]]].sum())
            self.bytes += np.bincount(codes, minlength=256)
            kinds = _CLASS[codes]
            if len(kinds) > 2:
                gram = (kinds[:-2] * 65_599 + kinds[1:-1]) * 65_599 + kinds[2:]
                self.grams += np.bincount(gram % 1_000_003 % _GRAMS, minlength=_GRAMS)
            words = block.split()
            self.words += len(words)
            seen.update(words)
            self.small += sum(map(SMALL_WORDS.__contains__, words))
            if words:
                self.repeats += (words[0] == last) + sum(map(bytes.__eq__, words[1:], words))
                last = words[-1]
        self.distinct = len(seen)

    def share(self, which: int) -> float:
        count = (self.distinct, self.repeats, self.small, self.bare)[which]
        return count / self.words if self.words else 0.0

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of the features that are not zero; class trigrams as roots of their shares.

        The shorter a text, the less its features say: trigrams are scaled down, shares are left out.
        """
        places = np.flatnonzero(self.grams)
        total = self.grams.sum()
        values = np.sqrt(self.grams[places] / max(1, total)) * total / (total + SHORT_BYTES)
        steps = [] if self.words < SHORT_WORDS else [_GRAMS + n * _STEPS + min(_STEPS - 1, int(self.share(n) * _STEPS)) for n in range(len(_SHARES))]
        return np.concatenate([places, np.array(steps, dtype=np.int64)]), np.concatenate([values, np.ones(len(steps))])


def _between(value: float, good: float, bad: float) -> int:
    """Good up to ``good``, bad from ``bad`` on (or the other way round when ``bad`` is the smaller one)."""
    if good > bad:
        value, good, bad = -value, -good, -bad
    return GOOD if value <= good else BAD if value >= bad else NONE


def _letters(p: Profile) -> int:
    seen = p.bytes.sum() - p.bytes[_GAPS].sum()
    return _between(p.bytes[_LETTERS].sum() / seen, .85, .75) if p.words >= SHORT_WORDS else NONE


def _marks(p: Profile) -> int:
    seen = p.bytes.sum()
    return _between(p.bytes[_MARKS].sum() / seen, .02, .06) if p.words >= SHORT_WORDS else NONE


def _capitals(p: Profile) -> int:
    letters = p.bytes[_LETTERS].sum()
    return _between(p.bytes[_CAPITALS].sum() / letters, .15, .4) if letters else NONE


def _distinct(p: Profile) -> int:
    return _between(p.share(0), .45, .25) if p.words >= 30 else NONE


def _repeats(p: Profile) -> int:
    return _between(p.share(1), .05, .25) if p.words >= 10 else NONE


def _small_words(p: Profile) -> int:
    return _between(p.share(2), .08, .01) if p.words >= 20 else NONE


def _bare_marks(p: Profile) -> int:
    return _between(p.share(3), .03, .2) if p.words >= 5 else NONE


def _marked_words(p: Profile) -> int:
    return _between(p.marked / p.words, .05, .3) if p.words else NONE


HEURISTICS = (_letters, _marks, _capitals, _distinct, _repeats, _small_words, _bare_marks, _marked_words)


def votes(text: bytes) -> list[int]:
    profile = Profile(text)
    return [vote(profile) for vote in HEURISTICS]


def fit_labellers(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Expectation maximisation over ``(votes, documents)``: the posterior of good per pattern.

    Each heuristic has, per class, a probability of voting bad, given that it votes. Heuristics are taken to see
    different faults: at the start each votes bad on half of the bad documents and on few of the good ones.
    """
    if not patterns:
        return {}
    cast = np.array([pattern for pattern, _ in patterns])
    count = np.array([n for _, n in patterns], dtype=float)
    bad, good = (cast == BAD).astype(float), (cast == GOOD).astype(float)
    prior, says_bad = np.array([.2, .8]), np.array([[.5], [.01]]) * np.ones(cast.shape[1])
    for _ in range(rounds):
        log = np.log(prior) + bad @ np.log(says_bad.T) + good @ np.log(1 - says_bad.T)
        log -= log.max(axis=1, keepdims=True)
        posterior = np.exp(log) / np.exp(log).sum(axis=1, keepdims=True)
        weight = posterior * count[:, None]
        prior = (weight.sum(axis=0) + 1) / (count.sum() + 2)
        # A little smoothing keeps a heuristic that is never wrong from deciding alone.
        says_bad = (weight.T @ bad + [[1.0], [.1]]) / (weight.T @ (bad + good) + 2.0)
    return {pattern: float(p) for (pattern, _), p in zip(patterns, posterior[:, 1], strict=True)}


def fit_scorer(rows: list[tuple[list[int], list[float], float]], rounds: int = 300, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic scorer for soft labels, the last one the bias; by gradient steps with momentum."""
    weights = np.zeros(FEATURES + 1)
    if not rows:
        return weights
    ends = np.cumsum([len(places) for places, _, _ in rows])
    row = np.repeat(np.arange(len(rows)), np.diff(np.concatenate([[0], ends])))
    places = np.concatenate([np.asarray(p, dtype=np.int64) for p, _, _ in rows])
    values = np.concatenate([np.asarray(v, dtype=float) for _, v, _ in rows])
    target = np.array([t for _, _, t in rows])
    moment = np.zeros_like(weights)
    for _ in range(rounds):
        score = np.bincount(row, weights[places] * values, minlength=len(rows)) + weights[-1]
        error = (1 / (1 + np.exp(-score)) - target) / len(rows)
        slope = np.append(np.bincount(places, error[row] * values, minlength=FEATURES), error.sum()) + ridge * weights
        moment = .9 * moment - slope
        weights = weights + moment
    return weights


def _profiles(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(pattern, spot, places, vals)``: votes as text, a hash of key and text, and the features of every document."""
    schema = "pattern string, spot long, places array<int>, vals array<float>"
    rows = docs.select(F.col(text).alias("text"), F.xxhash64(F.col(key), F.col(text)).alias("spot"))
    share = min(1.0, SAMPLE_ROWS / max(1, docs.count()))
    lowest = min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots, out = batch.column(1).to_pylist(), []
            for value, spot in zip(binary_values(batch.column(0)), spots, strict=True):
                profile = Profile(value)
                pattern = "".join("?-+"[vote(profile) + 1] for vote in HEURISTICS)
                wanted = spot <= lowest
                places, values = profile.features() if wanted else (None, None)
                out.append((pattern, spot if wanted else None, None if places is None else places.astype(np.int32),
                            None if places is None else values.astype(np.float32)))
            yield pa.record_batch([pa.array([row[0] for row in out], pa.string()),
                                   pa.array([row[1] for row in out], pa.int64()),
                                   pa.array([row[2] for row in out], pa.list_(pa.int32())),
                                   pa.array([row[3] for row in out], pa.list_(pa.float32()))],
                                  names=["pattern", "spot", "places", "vals"])

    return rows.mapInArrow(read, schema)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """Weights of the scorer, from the documents alone. Without documents all weights are zero."""
    if docs.isEmpty():
        return np.zeros(FEATURES + 1)
    profiles = stored(_profiles(docs, key, text), "profiles")
    patterns = [(tuple("?-+".index(mark) - 1 for mark in row["pattern"]), row["count"])
                for row in profiles.groupBy("pattern").count().orderBy("pattern").collect()]
    labels = fit_labellers(patterns)
    # One row per key and text: repeated rows would not bound the sample.
    sample = profiles.filter(F.col("spot").isNotNull()).dropDuplicates(["spot"]).orderBy("spot").toArrow()
    rows = [(row["places"], row["vals"], labels[tuple("?-+".index(mark) - 1 for mark in row["pattern"])])
            for row in sample.to_pylist()]
    return fit_scorer(rows)


def with_score(docs: DataFrame, weights: np.ndarray, into: str, text: str = "text") -> DataFrame:
    """``docs`` with the probability ``into`` that a document is good; all columns and rows stay."""
    context = docs.sparkSession.sparkContext
    held = context.broadcast(weights.astype(np.float32))
    schema = docs.select("*").schema.add(into, "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = held.value.astype(float)
        for batch in batches:
            names, out = batch.schema.names, []
            for value in binary_values(batch.column(names.index(text))):
                places, values = Profile(value).features()
                out.append(1 / (1 + np.exp(-float(scale[places] @ values + scale[-1]))))
            yield pa.record_batch([*batch.columns, pa.array(out, pa.float64())], names=[*names, into])

    return docs.mapInArrow(score, schema)


def scored(docs: DataFrame, into: str = "quality_score", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the score of a classifier fitted to them.

    Null and empty texts have no votes and no features but the steps of their shares; their score is what the bias
    says. Rows with equal texts get equal scores. ``into`` must be a new name; other columns are passed on unread. An
    empty table gives an empty result.
    """
    return with_score(docs, fit(docs, key, text), into, text)


def accepted(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all columns."""
    name = free_name(docs, "quality_score")
    return scored(docs, name, key, text).filter(F.col(name) >= threshold).select(*docs.columns)
