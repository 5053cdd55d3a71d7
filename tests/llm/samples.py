"""Small tables with the awkward rows that every operator has to take."""

import random

LONG = " ".join(f"word{n % 977} and" for n in range(60_000))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Found string, shard int, code string"


def documents(spark, rows):
    """``rows`` of (doc_id, text), with extra columns whose names clash with those the operators make."""
    return spark.createDataFrame(
        [(key, text, ("en", "de", None)[n % 3], ("src0", "src1", "src0", None)[n % 4], None if text is None else len(text),
          "x", 3, "y") for n, (key, text) in enumerate(rows)], SCHEMA)


def awkward():
    """Nulls, empty and long texts, repeated rows, a repeated key, gaps only."""
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two three four five"), (6, LONG), (7, "ONE two Three four five"),
            (8, "one two three four five"), (8, "one two three four five"), (None, "some text of a row without a key"),
            (None, "some text of a row without a key"), (9, "first text of this key " * 8), (9, "other text of this key " * 8),
            (-3, "één twee drie vier é ü ß " * 5)]
    return rows


def prose(seed, n_docs, vocabulary=400, length=60):
    chance = random.Random(seed)
    words = ["".join(chance.choices("abcdefghij", k=chance.randint(1, 7))) for _ in range(vocabulary)]
    return [(n, " ".join(chance.choices(words, k=chance.randint(1, 2 * length)))) for n in range(n_docs)]


def as_set(rows):
    return sorted((tuple(row) for row in rows), key=repr)
