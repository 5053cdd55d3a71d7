"""SimHash near-duplicate classes: fingerprints of word shingles, joined by the Gray-ordered index."""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from kbspark.llm.common import binary_values, blocks, free_name, small_side, stored
from kbspark.llm.components import components
from kbspark.llm.gray_index import near_codes

SHINGLE_WORDS = 4
DISTANCE = 4
SEED = 42

# Hashes whose bits are counted at a time.
HASHES = 1 << 15

_GAP = re.compile(rb"[\x20\x09-\x0D]")


def _shingle_hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """XXH64 of every run of ``width`` words, the words joined by one space; of all words when there are fewer."""
    digest, left, any_shingle = xxhash.xxh64_intdigest, [], False
    for block in blocks(text.lower(), _GAP):
        words = left + block.split()
        if len(words) < width:
            left = words
            continue
        any_shingle = True
        line = b" ".join(words)
        starts = [0]
        at = 0
        for word in words:
            at += len(word) + 1
            starts.append(at)
        yield np.array([digest(line[a:b - 1], SEED) for a, b in zip(starts, starts[width:])], dtype=np.uint64)
        left = words[1 - width:] if width > 1 else []
    if not any_shingle and left:
        yield np.array([digest(b" ".join(left), SEED)], dtype=np.uint64)


def fingerprint(text: bytes, width: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of a text; a bit is set when more than half of the hashes have it."""
    ones, total = np.zeros(64, dtype=np.int64), 0
    for hashes in _shingle_hashes(text, width):
        total += len(hashes)
        for start in range(0, len(hashes), HASHES):
            part = hashes[start:start + HASHES].astype(">u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def with_fingerprint(rows: DataFrame, text: str, into: str, width: int = SHINGLE_WORDS) -> DataFrame:
    """``rows`` with the fingerprint of column ``text`` as the long column ``into`` in place of the text."""
    kept = [column for column in rows.columns if column != text]
    schema = rows.select(*kept).schema.add(into, "long")

    def add(batches):
        for batch in batches:
            names = batch.schema.names
            texts = binary_values(batch.column(names.index(text)))
            codes = np.array([fingerprint(value, width) for value in texts], dtype=np.uint64).view(np.int64)
            columns = [batch.column(names.index(name)) for name in kept]
            yield pa.record_batch([*columns, pa.array(codes)], names=[*kept, into])

    return rows.mapInArrow(add, schema)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS,
                    distance: int = DISTANCE) -> DataFrame:
    """``(doc_id, code, component_id)`` for every row of ``docs``.

    ``code`` is the fingerprint as a signed long. Rows whose fingerprints differ in at most ``distance`` bits are
    linked, and ``component_id`` is the smallest key that can be reached over links, the row itself included.

    Null and empty texts, or texts of gaps only, have fingerprint zero and are linked like any other. Rows with equal
    texts share a fingerprint; repeated rows stay rows. Null keys are put out as null and are larger than any key: a
    class of null keys only has a null component. Other columns of ``docs`` are not read. An empty table gives an
    empty result.
    """
    marked = stored(with_fingerprint(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "text",
                                     "code", width), "fingerprints")
    codes = stored(marked.groupBy("code").agg(F.min("doc_id").alias("first_id")), "codes")
    links = stored(near_codes(codes.select("code"), distance), "near-codes")
    roots = components(links)
    classes = codes.join(roots.withColumnRenamed("node", "code"), "code", "left").select(
        "code", "first_id", F.coalesce("root", "code").alias("root"))
    classes = stored(classes, "classes")
    lowest = stored(classes.groupBy("root").agg(F.min("first_id").alias("component_id")), "lowest")
    named = stored(classes.join(lowest, "root").select("code", "component_id"), "classes")
    return marked.join(named, "code").select("doc_id", "code", "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with one row left of each near-duplicate class: the one with the smallest key.

    All columns are kept, whatever their names. Rows that repeat a key or have none are told apart by their
    fingerprints; of rows that share key and class one stays.
    """
    marks = near_duplicates(docs, key, text, **options)
    per_key = stored(marks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("first")), "marks")
    lone = (F.col("rows") == 1) & F.col("doc_id").isNotNull()
    name = free_name(docs, "marked_id")
    plain = per_key.filter(lone & F.col("first")).select(F.col("doc_id").alias(name))
    plain = small_side(stored(plain, "first-ids"), 32)
    kept = docs.join(plain, docs[key] == plain[name], "left_semi")
    shared = per_key.filter(~lone)
    if shared.isEmpty():
        return kept
    code, copy, lowest = (free_name(docs, base) for base in ("code", "text_copy", "component_id"))
    shared = shared.select(F.col("doc_id").alias(name))
    repeated = docs.join(shared, docs[key].eqNullSafe(shared[name]), "left_semi")
    repeated = with_fingerprint(repeated.withColumn(copy, F.col(text)), copy, code, options.get("width", SHINGLE_WORDS))
    named = marks.select(F.col("code").alias(code), F.col("component_id").alias(lowest)).distinct()
    first = repeated.join(named, code).filter(F.col(key).eqNullSafe(F.col(lowest))).dropDuplicates([key, lowest])
    return kept.unionByName(first.select(*docs.columns))
