import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from kbspark.llm import kd_shards, mixing
from kbspark.llm.queries import mixture_domain, mixture_weights
from tests.llm.samples import awkward, documents, prose


def weights(spark, rows):
    return spark.createDataFrame(rows, "domain string, lang string, source string, domain_weight int, lang_weight int, source_weight int")


def budgets(spark, rows, budget, epochs=1):
    leaves = weights(spark, [row[:6] for row in rows]).join(
        spark.createDataFrame([(*row[:3], row[6], 1) for row in rows], "domain string, lang string, source string, tokens long, docs long"),
        ["domain", "lang", "source"])
    found = mixing.leaf_budgets(leaves, F.lit(budget), epochs).collect()
    return {(r["domain"], r["lang"], r["source"]): r["budget"] for r in found}


def test_shortage_goes_to_siblings_first(spark):
    rows = [("a", "en", "x", 1, 1, 1, 10), ("a", "en", "y", 1, 1, 1, 500), ("a", "de", "x", 1, 1, 1, 500),
            ("b", "en", "x", 1, 1, 1, 500)]
    got = budgets(spark, rows, 400)
    # x is short by 40 of its 50; its sibling y takes that, and neither the other language nor the other domain.
    assert got == {("a", "en", "x"): 10, ("a", "en", "y"): 90, ("a", "de", "x"): 100, ("b", "en", "x"): 200}


def test_shortage_of_a_family_goes_up(spark):
    rows = [("a", "en", "x", 1, 1, 1, 10), ("a", "en", "y", 1, 1, 1, 20), ("a", "de", "x", 1, 1, 1, 30),
            ("b", "en", "x", 1, 1, 3, 900), ("b", "en", "y", 1, 1, 1, 900)]
    assert budgets(spark, rows, 400) == {("a", "en", "x"): 10, ("a", "en", "y"): 20, ("a", "de", "x"): 30,
                                         ("b", "en", "x"): 255, ("b", "en", "y"): 85}
    got = budgets(spark, rows, 10_000)
    assert got == {row[:3]: row[6] for row in rows}
    assert budgets(spark, rows, 10_000, epochs=3) == {row[:3]: 3 * row[6] for row in rows}


def test_mixture_keeps_budgets(spark):
    docs = documents(spark, prose(1, 900) + awkward())
    taken = mixing.mixture(docs, mixture_weights(docs), mixture_domain(docs), F.floor(F.col("total") * 13 / 10), 2, seed=4)
    rows = taken.collect()
    assert rows and all(1 <= r["n_epochs"] <= 2 for r in rows)
    total = docs.select(F.sum(mixing.tokens_in(docs["text"]))).first()[0]
    spent = sum(r["n_tokens"] * r["n_epochs"] for r in rows)
    assert spent <= total * 13 // 10
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mixture(
        docs.repartition(7), mixture_weights(docs), mixture_domain(docs), F.floor(F.col("total") * 13 / 10), 2, seed=4).collect()), key=repr)


def test_prefix_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 5)
    rows = prose(2, 300)
    docs = documents(spark, rows)
    leaf = spark.createDataFrame([("d", lang, source, 1, 1, 1) for lang in ("en", "de", "") for source in ("src0", "src1", "")],
                                 "domain string, lang string, source string, domain_weight int, lang_weight int, source_weight int")
    planned = mixing.mixed(docs, leaf, F.lit("d"), F.lit(5_000), seed=9)
    assert planned.columns == docs.columns
    kept = {r["doc_id"] for r in planned.collect()}
    counted = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
                          mixing.tokens_in(docs["text"]).alias("n"),
                          mixing.order_of(F.lit(9), F.lit(0), F.col("doc_id")).alias("order")).collect()
    leaves = leaf.join(docs.groupBy(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).agg(
        F.sum(mixing.tokens_in(F.col("text"))).alias("tokens"), F.count(F.lit(1)).alias("docs")), ["lang", "source"])
    budget = {(r["lang"], r["source"]): r["budget"] for r in mixing.leaf_budgets(leaves, F.lit(5_000), 1).collect()}
    wanted = set()
    for name, share in budget.items():
        running = 0
        for r in sorted((r for r in counted if (r["lang"], r["source"]) == name), key=lambda r: r["order"]):
            running += r["n"]
            if running > share:
                break
            wanted.add(r["doc_id"])
    assert kept == wanted


def test_mixing_of_nothing(spark):
    docs = documents(spark, [])
    assert mixing.mixture(docs, mixture_weights(docs), mixture_domain(docs), F.col("total")).collect() == []
    docs = documents(spark, [(1, None), (2, "")])
    assert mixing.mixed(docs, mixture_weights(docs), mixture_domain(docs), F.col("total")).collect() == []


def slow_tree(rows, n_dimensions, leaves):
    """Leaf by row number; rows are (coordinates, tie, weight)."""
    def wide(members, d):
        finite = [rows[m][0][d] for m in members if math.isfinite(rows[m][0][d])]
        return max(finite) - min(finite) if finite else 0

    span = [wide(range(len(rows)), d) for d in range(n_dimensions)]
    out = {}

    def split(members, first, owed):
        if owed == 1 or not members:
            out.update(dict.fromkeys(members, first))
            return
        width = [wide(members, d) / span[d] if span[d] else 0 for d in range(n_dimensions)]
        d = max(range(n_dimensions), key=lambda d: (width[d], f"d{d}"))
        goal, running, low = sum(rows[m][2] for m in members) * (owed // 2) / owed, 0, []
        for m in sorted(members, key=lambda m: (rows[m][0][d], float(rows[m][1]))):
            if running >= goal:
                break
            running += rows[m][2]
            low.append(m)
        split(low, first, owed // 2)
        split([m for m in members if m not in set(low)], first + owed // 2, owed - owed // 2)

    split(list(range(len(rows))), 0, leaves)
    return out


def test_tree_matches_brute_force(spark):
    chance = random.Random(5)
    rows = [((float(chance.randint(0, 9)), chance.random() * 100), chance.getrandbits(40), chance.randint(1, 30)) for _ in range(400)]
    table = spark.createDataFrame([(n, *r[0], r[1], r[2]) for n, r in enumerate(rows)], "n int, d0 double, d1 double, tie long, weight long")
    for leaves in (1, 3, 8):
        tree = kd_shards.kd_tree(table, ["d0", "d1"], leaves)
        got = {r["n"]: r["leaf"] for r in kd_shards.descended(table, tree, "leaf").collect()}
        assert got == slow_tree(rows, 2, leaves)


@pytest.mark.parametrize("sorted_rows", [20, 300, 20_000])
@pytest.mark.parametrize("leaves", [64, 300])
def test_many_leaves_match_brute_force(spark, monkeypatch, leaves, sorted_rows):
    monkeypatch.setattr(kd_shards, "SORTED_ROWS", sorted_rows)
    chance = random.Random(6)
    rows = [((float(chance.randint(0, 5)), chance.random() * 100, math.inf if n % 50 == 0 else chance.random()), chance.getrandbits(60),
             chance.randint(1, 30)) for n in range(1500)]
    table = spark.createDataFrame([(n, *[c if math.isfinite(c) else -c for c in r[0]], r[1], r[2]) for n, r in enumerate(rows)],
                                  "n int, d0 double, d1 double, d2 double, tie long, weight long")
    tree = kd_shards.kd_tree(table, ["d0", "d1", "d2"], leaves)
    got = {r["n"]: r["leaf"] for r in kd_shards.descended(table, tree, "leaf").collect()}
    # An infinite coordinate has a place in the order but does not widen a dimension.
    flat = [(tuple(-math.inf if math.isinf(c) else c for c in r[0]), r[1], r[2]) for r in rows]
    assert got == slow_tree(flat, 3, leaves)


def test_texts_with_a_common_start_are_split(spark):
    docs = documents(spark, prose(4, 400)).withColumn("lang", F.lit("en")).withColumn("n_chars", F.lit(1)).withColumn(
        "source", F.when(F.col("doc_id") % 50 != 0, F.concat(F.lit("common_crawl_"), (F.col("doc_id") % 16).cast("string"))))
    got = kd_shards.kd_sharded(docs, ["lang", "source", "n_chars"], leaves=4).collect()
    ends = [sorted({r["source"] or "" for r in got if r["shard_"] == n}) for n in range(4)]
    assert all(one[-1] <= other[0] for one, other in zip(ends, ends[1:]))
    narrow = kd_shards.kd_shards(docs, ["lang", "source", "n_chars"], leaves=4).select("doc_id", "shard").collect()
    assert sorted(map(tuple, narrow)) == sorted((r["doc_id"], r["shard_"]) for r in got)


def shards_of(spark, rows, **options):
    return kd_shards.kd_shards(documents(spark, rows), ["lang", "source", "n_chars"], **options).collect()


def test_shards(spark):
    rows = [row for row in prose(3, 700) + awkward() if row[0] != 6]
    got = shards_of(spark, rows)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == sorted(
        ((key, len((text or "").encode()) + 1, None if text is None else zlib.crc32(text.encode())) for key, text in rows), key=repr)
    sizes = [sum(r["size"] for r in got if r["shard"] == n) for n in range(8)]
    assert max(sizes) - min(sizes) <= 4 * max(r["size"] for r in got)
    for n in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == n)
        assert slots == list(range(len(slots)))


def test_shards_by_target_size(spark):
    got = shards_of(spark, prose(3, 700), target_bytes=20_000)
    total = sum(r["size"] for r in got)
    assert len({r["shard"] for r in got}) == -(-total // 20_000)


def test_sharded_keeps_columns(spark):
    docs = documents(spark, prose(3, 100) + awkward())
    got = kd_shards.kd_sharded(docs, ["lang", "source", "n_chars"])
    assert got.columns == [*docs.columns, "shard_"]
    assert got.count() == docs.count()
    assert "Python" not in got._jdf.queryExecution().toString()


def test_shards_of_little(spark):
    assert shards_of(spark, []) == []
    assert len(shards_of(spark, [(1, "a"), (None, None)])) == 2
    one = documents(spark, [(1, "same")])
    same = kd_shards.kd_shards(one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(20)))).drop("copy"), ["lang", "n_chars"])
    assert len({r["shard"] for r in same.collect()}) == 1
