"""Exact substring join of many patterns against many texts, without comparing every pair.

Up to a measured bound the patterns are broadcast and texts are not shuffled. Patterns are met by their gram, the one of
their ``GRAM`` bytes in a row that is rarest among all patterns: every place of a text's bytes looks up the hash of its
gram, and a meeting is verified in the bytes around it. Equal bytes are equal letters in UTF-8. Shorter patterns are
verified against every text of their group, in the same pass: texts are read once, in one generated stage in the JVM.
With ``by_bytes`` every task looks for all patterns in batches of its texts instead (``substrings.py``).

``meetings`` keeps columns of the texts beside the patterns. It cuts a text at its spaces into words; a pattern without a
space lies inside one of them, and is met and verified there by a gram of ``GRAM`` characters. Patterns with spaces are met
by a gram of one of their words and verified in the text.

Beyond the bound nothing is broadcast. Texts are cut into runs of ``s`` characters, side by side. An occurrence of a
pattern of at least ``2s - 1`` characters covers one whole run, which is then one of the pattern's first ``s``
substrings of that length, its anchors. So an equi join of runs with anchors meets every occurrence; each meeting is
verified against the text, and of several occurrences only the first counts.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from kbspark.functions.substrings import Patterns, lowest
from kbspark.operators.limits import max_broadcast_bytes, pin

GRAM = 4

# Longer words are cut into pieces of so many characters, each with the head of the next: looking for the place of a
# character walks through the piece.
PIECE = 32

# Run lengths; a pattern uses the longest its own length allows.
RUN_SIZES = (8, 4, 2, 1)

# Bytes of a broadcast pattern beyond its text.
_ROW_BYTES = 160


def contains_join(texts: DataFrame, patterns: DataFrame, text: str, pattern: str, group: str, key: str,
                  most: int | None = None, by_bytes: bool = False) -> DataFrame:
    """``(key, *patterns)`` for every pattern that occurs in a text of its group.

    ``key`` is the unique long id of a text; ``group`` is a column of both sides; ``(group, pattern)`` should be
    distinct. Matching is literal; lower-case both sides beforehand to ignore case. With ``most``, only the lowest
    ``most`` keys of each pattern and group are kept. ``by_bytes`` looks for broadcast patterns with the NumPy kernel
    instead of in the JVM, which suits long patterns: they have many grams.
    """
    texts = texts.select(key, group, text)
    usable = patterns.filter(F.length(pattern) > 0)
    size = usable.agg(F.sum(F.octet_length(pattern) * 2 + _ROW_BYTES)).first()[0] or 0
    if size <= max_broadcast_bytes(texts.sparkSession):
        found = (_by_bytes(texts, usable, text, pattern, group, key, most) if by_bytes
                 else _by_places(texts, usable, text, pattern, group, key))
    else:
        found = _by_runs(texts, usable, text, pattern, group, key)
    if most is None:
        return found
    order = Window.partitionBy(group, pattern).orderBy(key)
    return found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")


def _same(one: Column, other: Column) -> Column:
    """Equal, as a condition that a join does not take for a key: with one long key its look-up is several times as fast."""
    return (one >= other) & (one <= other)


def _placed(patterns: DataFrame, pattern: str, group: str) -> DataFrame:
    """Patterns with ``_offset``, the place of their rarest gram in their bytes from 1, and its ``_code``.

    Patterns shorter than a gram are numbered downwards from 0 in their group, and met by that number.
    """
    held, short = F.col(pattern).cast("binary"), F.octet_length(pattern) < GRAM
    gram = F.substring(held, F.col("_offset"), F.lit(GRAM))
    grams = patterns.filter(~short).select(
        "*", F.explode(F.sequence(F.lit(1), F.octet_length(pattern) - (GRAM - 1))).alias("_offset")).withColumn("_gram", gram)
    often = grams.groupBy(group, "_gram").agg(F.count("*").alias("_often"))
    rarest = grams.join(often, [group, "_gram"]).groupBy(*patterns.columns).agg(
        F.min_by(F.struct("_gram", "_offset"), F.struct("_often", "_gram", "_offset")).alias("_best"))
    long = rarest.select(*patterns.columns, F.col("_best._offset").alias("_offset"), F.xxhash64(group, "_best._gram").alias("_code"))
    number = (1 - F.row_number().over(Window.partitionBy(group).orderBy(pattern))).alias("_offset")
    return long.unionByName(patterns.filter(short).select("*", number).withColumn("_code", F.xxhash64(group, "_offset")))


def _by_places(texts: DataFrame, patterns: DataFrame, text: str, pattern: str, group: str, key: str) -> DataFrame:
    """``(key, *patterns)``, made in the tasks that scan the texts. The patterns are broadcast: the caller has measured them."""
    placed = pin(_placed(patterns, pattern, group), "placed-patterns")
    lowest_place = placed.agg(F.least(F.coalesce(F.min("_offset"), F.lit(1)), F.lit(1))).first()[0]
    held = texts.select(key, F.col(group).alias("_group"), text, F.col(text).cast("binary").alias("_bytes"))
    last = F.greatest(F.octet_length("_bytes") - (GRAM - 1), F.lit(1))
    # The outer form keeps Spark from adding a filter on the array's size, which would build the array twice.
    places = held.select("*", F.explode_outer(F.sequence(F.lit(lowest_place), last, F.lit(1))).alias("_place"))
    code = F.when(F.col("_place") > 0, F.xxhash64("_group", F.substring("_bytes", F.col("_place"), F.lit(GRAM)))).otherwise(
        F.xxhash64("_group", "_place"))
    met = places.withColumn("_code", code).join(F.broadcast(placed), "_code").filter(_same(F.col("_group"), F.col(group)))
    start = F.col("_place") - F.col("_offset") + 1
    there = F.substring("_bytes", start, F.octet_length(pattern)) == F.col(pattern).cast("binary")
    # Of several occurrences the first one counts. Nothing here may be a lambda, which Spark runs outside generated code.
    first = F.octet_length(F.call_function("substring_index", F.col(text), F.col(pattern), F.lit(1))) == start - 1
    return met.filter(F.when(
        F.col("_place") > 0, (F.col("_offset") > 0) & (start > 0) & there & first).otherwise(
        (F.col("_place") == F.col("_offset")) & F.contains(text, F.col(pattern)))).select(key, *patterns.columns)


def full_grams(text: Column) -> Column:
    """The different grams of a text, by cutting it ``GRAM`` times into pieces, each time one character later."""
    pieces = [F.regexp_extract_all(F.substring(text, start, 1 << 30), F.lit(f"(?s).{{{GRAM}}}"), F.lit(0))
              for start in range(1, GRAM + 1)]
    return F.array_distinct(F.concat(*pieces))


def _places(text: Column) -> Column:
    """All places of a text where a gram may start, from 1."""
    return F.sequence(F.lit(1), F.greatest(F.length(text) - (GRAM - 1), F.lit(1)))


def _rarest(patterns: DataFrame, pattern: str, group: str) -> DataFrame:
    """Patterns with ``_needle``, what a word has to hold, the place ``_offset`` of their gram in it, and its ``_code``.

    The gram has no space; patterns without one are left out.
    """
    gram = F.substr(F.col(pattern), F.col("_offset"), F.lit(GRAM))
    grams = (patterns.select("*", F.explode(_places(F.col(pattern))).alias("_offset")).withColumn("_gram", gram)
             .filter((F.length("_gram") == GRAM) & ~F.contains("_gram", F.lit(" "))))
    often = grams.groupBy(group, "_gram").agg(F.count("*").alias("_often"))
    rarest = grams.join(often, [group, "_gram"]).groupBy(*patterns.columns).agg(
        F.min_by(F.struct("_gram", "_offset"), F.struct("_often", "_gram", "_offset")).alias("_best"))
    spaced = F.contains(F.col(pattern), F.lit(" "))
    return rarest.select(
        *patterns.columns, F.when(spaced, F.col("_best._gram")).otherwise(F.col(pattern)).alias("_needle"),
        F.when(spaced, 1).otherwise(F.col("_best._offset")).alias("_offset"), F.xxhash64(group, "_best._gram").alias("_code"))


def meetings(texts: DataFrame, patterns: DataFrame, text: str, pattern: str, group: str, keep: list[str]) -> DataFrame:
    """``(*keep, *patterns)``, a row per text and pattern in it, made in the tasks that scan the texts.

    ``keep`` are columns of the texts. The patterns are broadcast: the caller has measured them.
    """
    has_gram = F.col(pattern).rlike(f"[^ ]{{{GRAM}}}")
    rarest = pin(_rarest(patterns.filter(has_gram), pattern, group), "rarest-grams")
    kept = list(dict.fromkeys([*keep, text]))
    # The outer forms keep Spark from adding a filter on the array's size, which would build the array twice.
    words = texts.select(*kept, group, F.posexplode_outer(F.split(F.col(text), " ")).alias("_nth", "_word")).filter(
        F.octet_length("_word") >= GRAM)
    overlapping = F.regexp_extract_all("_word", F.lit(f"(?s)(?=(.{{1,{PIECE + GRAM - 1}}})).{{1,{PIECE}}}"), F.lit(1))
    pieces = words.select("*", F.posexplode_outer(
        F.when(F.octet_length("_word") <= 2 * PIECE, F.array("_word")).otherwise(overlapping)).alias("_part", "_piece"))
    places = pieces.select("*", F.explode_outer(_places(F.col("_piece"))).alias("_place"))
    code = F.xxhash64(group, F.substr(F.col("_piece"), F.col("_place"), F.lit(GRAM)))
    met = (places.withColumn("_code", code).withColumnRenamed(group, "_group").join(F.broadcast(rarest), "_code")
           .filter(_same(F.col("_group"), F.col(group))))
    # Of several occurrences the first one counts: the text before it has as many spaces as words. A word is asked whether
    # it holds the pattern before anything else. Nothing here may be a lambda, which Spark runs outside generated code, so
    # that every place would become a row with the whole text.
    first = F.instr("_word", F.col("_needle")) == F.col("_part") * PIECE + F.col("_place") - F.col("_offset") + 1
    before = F.call_function("substring_index", F.col(text), F.col("_needle"), F.lit(1))
    spaces = F.octet_length(before) - F.octet_length(F.replace(before, F.lit(" "), F.lit("")))
    met = met.filter(F.contains("_word", F.col("_needle")) & first & (spaces == F.col("_nth")))
    whole = (F.col("_needle") == F.col(pattern)) | F.contains(F.col(text), F.col(pattern))
    brief = texts.join(F.broadcast(patterns.filter(~has_gram)), group).filter(F.contains(F.col(text), F.col(pattern)))
    columns = [*keep, *patterns.columns]
    return met.filter(whole).select(*columns).unionByName(brief.select(*columns))


def _by_bytes(texts: DataFrame, patterns: DataFrame, text: str, pattern: str, group: str, key: str, most: int | None) -> DataFrame:
    """``(key, *patterns)``: every task looks for the broadcast patterns in its batches of texts.

    Only keys and numbers of patterns leave a task, of a batch at most the ``most`` lowest keys of a pattern.
    """
    short = F.length(pattern) < GRAM
    patterns = pin(patterns.filter(~short).distinct().unionByName(patterns.filter(short)), "patterns")
    table = patterns.select(group, pattern).filter(F.col(group).isNotNull()).distinct().toArrow()
    table = table.append_column("_number", pa.array(range(table.num_rows), pa.int64()))
    held = patterns.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Patterns(held.value)
        for batch in batches:
            place, number = known.found(batch.column(2), batch.column(1))
            keys = batch.column(0)
            if most is not None and len(place):
                kept = lowest(keys.to_numpy(zero_copy_only=False)[place], number, most)
                place, number = place[kept], number[kept]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(place)), pa.array(number)], names=[key, "_number"])

    kind = texts.schema[key].dataType.simpleString()
    met = texts.filter(F.col(key).isNotNull()).select(key, group, text).mapInArrow(run, f"{key} {kind}, _number long")
    numbers = patterns.sparkSession.createDataFrame(table)
    return met.join(F.broadcast(patterns.join(F.broadcast(numbers), [group, pattern])), "_number").select(key, *patterns.columns)


def _run_size(pattern: Column) -> Column:
    size = F.lit(None).cast("int")
    for known in reversed(RUN_SIZES):
        size = F.when(F.length(pattern) >= 2 * known - 1, known).otherwise(size)
    return size


def _runs(text: Column, size: int) -> Column:
    """The runs of one size with the position of their first character."""
    runs = F.regexp_extract_all(text, F.lit(f"(?s).{{{size}}}"), F.lit(0))
    return F.transform(runs, lambda run, i: F.struct((i * size).alias("at"), run.alias("run")))


def _by_runs(texts: DataFrame, patterns: DataFrame, text: str, pattern: str, group: str, key: str) -> DataFrame:
    size = _run_size(F.col(pattern))
    sizes = patterns.agg(F.collect_set(size)).first()[0]
    runs = [_runs(F.col(text), known) for known in sorted(sizes or RUN_SIZES[-1:])]
    # The outer form keeps Spark from adding a filter on the array's size, which would build the array twice.
    cut = texts.select(
        F.col(key), F.col(group), F.explode_outer(F.concat(*runs)).alias("_run")).select(
        key, group, "_run.at", "_run.run")
    offset = F.explode(F.sequence(F.lit(0), size - 1))
    anchored = patterns.select("*", size.alias("_size"), offset.alias("_offset")).withColumn(
        "run", F.substr(F.col(pattern), F.col("_offset") + 1, F.col("_size")))
    # Texts stay out of this shuffle; a run that many texts or patterns share is split by the skew join.
    meetings = (cut.join(anchored, [group, "run"]).filter(F.col("at") >= F.col("_offset"))
                .withColumn("_first", F.col("at") - F.col("_offset") + 1)
                .select(key, "_first", *patterns.columns))
    # One occurrence meets by the first whole run inside it, so each (text, pattern) pair is verified once.
    return (texts.select(key, text).join(meetings, key)
            .filter(F.instr(text, F.col(pattern)) == F.col("_first")).select(key, *patterns.columns))
