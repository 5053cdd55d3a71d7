"""The quality classifier against its definition, written out for single documents and dense rows."""

import math
import re

import numpy as np
import pytest

from kbspark.llm import quality
from tests.llm.samples import awkward, documents, prose


def slow_posteriors(cast):
    """Expectation maximisation document by document: the probability of good for each."""
    classes, heuristics = (0, 1), range(len(cast[0]))
    prior, says_bad = [.2, .8], [[.5 for _ in heuristics], [.01 for _ in heuristics]]
    for _ in range(quality.ROUNDS):
        posterior = []
        for votes in cast:
            weight = [prior[c] * math.prod({quality.BAD: says_bad[c][h], quality.GOOD: 1 - says_bad[c][h]}.get(vote, 1.0)
                                           for h, vote in enumerate(votes)) for c in classes]
            posterior.append([one / sum(weight) for one in weight])
        prior = [(sum(p[c] for p in posterior) + 1) / (len(cast) + 2) for c in classes]
        says_bad = [[(sum(p[c] for p, votes in zip(posterior, cast) if votes[h] == quality.BAD) + (1.0, .1)[c])
                     / (sum(p[c] for p, votes in zip(posterior, cast) if votes[h] != quality.NONE) + 2.0)
                     for h in heuristics] for c in classes]
    return [p[1] for p in posterior]


def kind(code):
    char = chr(code)
    if code >= 128 or "a" <= char <= "z":
        return ord("a")
    if "A" <= char <= "Z":
        return ord("A")
    if "0" <= char <= "9":
        return ord("0")
    return code if code == 10 else 32 if 9 <= code <= 13 else code


def slow_features(text):
    grams, steps = quality.FEATURES - 64, 16
    row, kinds = np.zeros(quality.FEATURES + 1), [kind(code) for code in text]
    counts = {}
    for a, b, c in zip(kinds, kinds[1:], kinds[2:]):
        place = ((a * 65_599 + b) * 65_599 + c) % 1_000_003 % grams
        counts[place] = counts.get(place, 0) + 1
    total = sum(counts.values())
    for place, count in counts.items():
        row[place] = np.float32(math.sqrt(count / total) * total / (total + quality.SHORT_BYTES))
    words = re.findall(rb"[^\x20\x09-\x0D]+", text)
    if len(words) >= quality.SHORT_WORDS:
        bare = sum(word in {bytes([mark]) for mark in b"|*#-+=~_<>"} for word in words)
        repeats = sum(a == b for a, b in zip(words, words[1:]))
        small = sum(word in quality.SMALL_WORDS for word in words)
        for n, count in enumerate((len(set(words)), repeats, small, bare)):
            row[grams + n * steps + min(steps - 1, int(count / len(words) * steps))] = 1
    row[-1] = 1
    return row


def slow_scores(rows):
    """Scores of (key, text) rows: labels from all rows, weights from the different ones."""
    texts = [(text or "").encode() for _, text in rows]
    labels = slow_posteriors([quality.votes(text) for text in texts])
    table = np.array([slow_features(text) for text in texts])
    first = {(key, text): n for n, (key, text) in reversed(list(enumerate(rows)))}
    fitted = sorted(first.values())
    x, target = table[fitted], np.array(labels)[fitted]
    weights, moment = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(300):
        slope = x.T @ (1 / (1 + np.exp(-x @ weights)) - target) / len(fitted) + 1e-3 * weights
        moment = .9 * moment - slope
        weights = weights + moment
    return 1 / (1 + np.exp(-table @ weights))


@pytest.mark.parametrize("seed", [1, 2])
def test_scores_are_those_of_the_definition(spark, seed):
    bad = [(900 + n, "buy### now$$$ cheap%%% " * (n + 3)) for n in range(12)] + [(950 + n, "again and " * (20 + n)) for n in range(8)]
    fine = [(1000 + n, f"The story of the house {n} and the garden is told in it, and that was all for the day we were there.") for n in range(20)]
    rows = awkward() + prose(seed, 60) + bad + fine
    found = quality.scored(documents(spark, rows).repartition(5)).select("doc_id", "text", "quality_score").collect()
    wanted = sorted(zip(((repr(key), repr(text)) for key, text in rows), slow_scores(rows)))
    got = sorted(((repr(row["doc_id"]), repr(row["text"])), row["quality_score"]) for row in found)
    assert [key for key, _ in got] == [key for key, _ in wanted]
    assert np.abs(np.array([score for _, score in got]) - np.array([score for _, score in wanted])).max() < 1e-4
