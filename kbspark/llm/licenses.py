"""License scans: lines of text against templates by the Dice coefficient over word bigrams.

Only column expressions are used. A line is normalised (small letters and digits, one space between words) and turned
into its set of word bigrams. With a threshold t, two sets of sizes a and b can only reach it when
``a >= t / (2 - t) * b`` and the other way round; templates outside these bounds are pruned before sets are compared,
and lines outside the bounds of all templates before their bigrams are formed.
"""

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

SIMILARITY = 0.8

# Short notices of common licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0": "This work is licensed under the Mozilla Public License, version 2.0.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Released into the public domain under CC0 1.0.",
    "proprietary": "All rights reserved.",
}


def normalised(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.translate({code: code + 32 for code in range(65, 91)}))


def bigrams_of(words: list[str]) -> list[str]:
    """The set of bigrams; a single word is its own."""
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])] or words
    return sorted(set(pairs))


def _bigrams(words: Column) -> Column:
    # The last of the shifted words is null, and so is its pair.
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(words) == 1, words).otherwise(F.array_distinct(F.filter(pairs, lambda pair: pair.isNotNull())))


def smallest(size: int, similarity: float) -> int:
    """The smallest set that can reach the similarity with a set of ``size``."""
    return math.ceil(size * similarity / (2 - similarity) - 1e-9)


def largest(size: int, similarity: float) -> int:
    return math.floor(size * (2 - similarity) / similarity + 1e-9)


def license_lines(docs: DataFrame, templates: dict[str, str] | None = None, similarity: float = SIMILARITY,
                  key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, line, license, dice)``: each line (from 0) with each template it is similar enough to.

    Letters beyond ASCII separate words, as all other marks do. Lines end at line feeds. Null and empty texts and
    lines without words match nothing; templates without words are ignored. Repeated rows give repeated matches.
    Templates are literals of the plan: some dozens of notices, not a table. Other columns are not read.
    """
    sets = {name: grams for name, notice in (TEMPLATES if templates is None else templates).items()
            if (grams := bigrams_of(normalised(notice)))}
    low = min((smallest(len(grams), similarity) for grams in sets.values()), default=0)
    lines = docs.select(docs[key].alias("doc_id"), F.posexplode(F.split(docs[text], "\n", -1)).alias("line", "notice"))
    small = F.translate("notice", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(small, "[^a-z0-9]+", -1), lambda word: word != "")
    worded = lines.select("doc_id", "line", words.alias("words")).filter(
        (F.size("words") >= F.greatest(F.lit(1), F.lit(low + 1 if low > 1 else 1))))
    gramed = worded.select("doc_id", "line", _bigrams(F.col("words")).alias("grams"))
    size = F.size("grams")
    candidates = []
    for name, grams in sets.items():
        shared = F.size(F.array_intersect("grams", F.array(*[F.lit(gram) for gram in grams])))
        dice = 2.0 * shared / (size + len(grams))
        fits = size.between(smallest(len(grams), similarity), largest(len(grams), similarity))
        candidates.append(F.when(fits, F.struct(F.lit(name).alias("license"), dice.alias("dice"))))
    if not candidates:
        return gramed.select("doc_id", "line", F.lit("").alias("license"), F.lit(0.0).alias("dice")).filter("false")
    found = F.filter(F.array(*candidates), lambda one: one["dice"] >= similarity - 1e-12)
    return gramed.select("doc_id", "line", F.explode(found).alias("found")).select(
        "doc_id", "line", "found.license", "found.dice")
