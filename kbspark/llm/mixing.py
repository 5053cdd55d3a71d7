"""Mixing sources to target weights: a token budget handed down a domain, language, source tree.

A node's budget is shared among its children by weight. A child that cannot use its share, because all its documents
taken ``max_epochs`` times hold fewer tokens, takes what it has, and its brothers and sisters take the rest by weight.
Only when the whole family is used up does the shortage reach the parent's own siblings: every node's capacity is the
capacity of its family, so the same sharing one level up settles it.

A leaf spends its budget in epochs: whole passes over its documents, then the prefix of one more pass whose tokens fit,
in an order drawn from the seed and the number of the epoch. The prefix is found from token totals per hash bucket, so
only the documents of one small bucket per leaf are ever sorted, however hot the leaf.
"""

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from kbspark.llm.common import free_name, stored

LEVELS = ["domain", "lang", "source"]

# Documents of a leaf that share a bucket of the order, about.
BUCKET_ROWS = 512
MAX_BUCKETS = 1 << 20

_ORDER_BITS = 60


def order_of(seed: Column, epoch: Column, key: Column) -> Column:
    """A place in 0 .. 2**60 - 1 drawn from seed, epoch and key: the first 15 hex digits of their MD5."""
    mixed = F.concat_ws(":", seed.cast("string"), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(mixed.cast("binary")), 1, 15), 16, 10).cast("long")


def shares(children: DataFrame, family: list[str], budget: str, capacity: str, weight: str, into: str) -> DataFrame:
    """``children`` with a long ``into``: the family's ``budget`` shared by ``weight``, never above ``capacity``.

    Children are filled in the order of capacity over weight. Before each, what is left over the weights left is the
    level to which all the rest could be filled; the highest of these levels is the one that uses the budget up.
    """
    order = W.partitionBy(*family).orderBy(F.col(capacity) / F.col(weight), *[c for c in LEVELS if c not in family][:1])
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    left = F.col(budget) - F.coalesce(F.sum(capacity).over(before), F.lit(0))
    level = (left / F.sum(weight).over(after)).cast("double")
    filled = children.withColumn("level", level)
    top = F.greatest(F.max("level").over(W.partitionBy(*family)), F.lit(0.0))
    return filled.withColumn(into, F.least(F.col(capacity), F.floor(F.col(weight) * top)).cast("long")).drop("level")


def leaf_budgets(leaves: DataFrame, budget: Column, max_epochs: int) -> DataFrame:
    """``(domain, lang, source, tokens, docs, budget)`` per leaf.

    ``leaves`` has the levels, positive integer weights ``domain_weight``, ``lang_weight``, ``source_weight`` (the same
    on all leaves under a node), ``tokens`` and ``docs``. It has a row per leaf, not per document.
    """
    tree = leaves.withColumn("capacity", F.col("tokens") * max_epochs).filter(F.col("tokens") > 0)
    langs = tree.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"), F.first("lang_weight").alias("weight"),
                                               F.first("domain_weight").alias("domain_weight"))
    domains = langs.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.first("domain_weight").alias("weight"))
    domains = shares(domains.withColumn("all", budget.cast("long")), ["all"], "all", "capacity", "weight", "domain_budget")
    langs = langs.join(domains.select("domain", "domain_budget"), "domain")
    langs = shares(langs, ["domain", "domain_budget"], "domain_budget", "capacity", "weight", "lang_budget")
    tree = tree.join(langs.select("domain", "lang", "lang_budget"), ["domain", "lang"])
    tree = shares(tree, ["domain", "lang", "lang_budget"], "lang_budget", "capacity", "source_weight", "budget")
    return tree.select(*LEVELS, "tokens", "docs", "budget")


def _place() -> Column:
    """A row's place in the order of its leaf's last pass."""
    return F.struct("order", "key", "twin")


def _thresholds(rows: DataFrame, budgets: DataFrame, seed: int) -> DataFrame:
    """``(domain, lang, source, passes, last)`` per leaf: whole passes, and the last place of the prefix after them.

    ``last`` is null where no document fits into what the whole passes leave of the budget.
    """
    buckets = F.least(F.lit(MAX_BUCKETS), F.greatest(F.lit(1), (F.col("docs") / BUCKET_ROWS).cast("long") + 1))
    wanted = budgets.select(*LEVELS, F.floor(F.col("budget") / F.col("tokens")).cast("long").alias("passes"),
                            (F.col("budget") % F.col("tokens")).alias("rest"), buckets.alias("buckets"))
    drawn = rows.join(F.broadcast(wanted.filter("rest > 0")), LEVELS).withColumn(
        "order", order_of(F.lit(seed), F.col("passes"), F.col("key"))).withColumn(
        "bucket", (F.col("order") / F.lit(float(1 << _ORDER_BITS)) * F.col("buckets")).cast("long"))
    drawn = stored(drawn, "drawn")
    per_bucket = drawn.groupBy(*LEVELS, "bucket", "rest").agg(
        F.sum("n_tokens").alias("n_tokens"), F.max(_place()).alias("end"))
    running = W.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = per_bucket.withColumn("before", F.coalesce(F.sum("n_tokens").over(running), F.lit(0)))
    # All buckets that fit whole, and the one in which the prefix ends.
    starts = stored(starts.filter(F.col("before") <= F.col("rest")), "buckets")
    whole = starts.filter(F.col("before") + F.col("n_tokens") <= F.col("rest")).select(*LEVELS, F.col("end").alias("place"))
    last = starts.filter(F.col("before") + F.col("n_tokens") > F.col("rest")).select(*LEVELS, "bucket", "before")
    inner = W.partitionBy(*LEVELS).orderBy("order", "key", "twin").rowsBetween(W.unboundedPreceding, 0)
    cut = drawn.join(F.broadcast(last), [*LEVELS, "bucket"]).withColumn(
        "running", F.sum("n_tokens").over(inner) + F.col("before")).filter(F.col("running") <= F.col("rest"))
    ends = whole.unionByName(cut.select(*LEVELS, _place().alias("place"))).groupBy(*LEVELS).agg(
        F.max("place").alias("last"))
    return stored(wanted.select(*LEVELS, "passes").join(ends, LEVELS, "left"), "thresholds")


def _taken(rows: DataFrame, thresholds: DataFrame, seed: int) -> DataFrame:
    """``rows`` (with the levels, ``key`` and ``twin``) that are taken at least once, and ``n_epochs``."""
    at = rows.join(F.broadcast(thresholds), LEVELS).withColumn(
        "order", order_of(F.lit(seed), F.col("passes"), F.col("key")))
    part = F.coalesce(_place() <= F.col("last"), F.lit(False)).cast("long")
    return at.withColumn("n_epochs", F.col("passes") + part).filter("n_epochs > 0").drop("passes", "last", "order")


def tokens_in(text: Column) -> Column:
    """Words between gaps of ASCII white space, of the whole text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def _rows(docs: DataFrame, domain: Column, key: str, text: str, lang: str, source: str) -> list[Column]:
    empty = F.lit("")
    return [docs[key].alias("key"), F.xxhash64(docs[text]).alias("twin"), F.coalesce(domain, empty).alias("domain"),
            F.coalesce(docs[lang], empty).alias("lang"), F.coalesce(docs[source], empty).alias("source")]


def _planned(rows: DataFrame, weights: DataFrame, budget: Column, max_epochs: int, seed: int) -> DataFrame:
    sums = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    leaves = sums.join(F.broadcast(weights), LEVELS)
    total = rows.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total")).select(budget.cast("long")).first()[0]
    return _thresholds(rows, stored(leaf_budgets(leaves, F.lit(total), max_epochs), "leaf-budgets"), seed)


def mixture(docs: DataFrame, weights: DataFrame, domain: Column, budget: Column, max_epochs: int = 1, seed: int = 0,
            key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``(key, twin, domain, lang, source, n_tokens, n_epochs)`` for every row that is taken at least once.

    ``weights`` names the leaves: the levels and their positive integer weights; rows whose leaf has no weight are not
    taken. A null domain, language or source counts as the empty name. ``budget`` is an expression over the sum of all
    tokens, the column ``total``. Null and empty texts have no tokens: they come along with every whole pass and
    wherever they stand in a prefix; a leaf without any tokens is not taken. Rows that repeat a key are told apart by
    ``twin``, a hash of the text; rows that repeat both count one by one, and the place of the last that fits decides
    for all of them. Leaves are as many as the weights, not as the rows, and are broadcast. Other columns are not read.
    An empty table gives an empty result.
    """
    rows = stored(docs.select(*_rows(docs, domain, key, text, lang, source), tokens_in(docs[text]).alias("n_tokens")),
                  "mixture-rows")
    return _taken(rows, _planned(rows, weights, budget, max_epochs, seed), seed)


def mixed(docs: DataFrame, weights: DataFrame, domain: Column, budget: Column, seed: int = 0, key: str = "doc_id",
          text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that the mixture takes, each once, with all columns.

    A row's own values and its leaf's threshold decide, so texts are scanned again and not shuffled.
    """
    wanted = _rows(docs, domain, key, text, lang, source)
    rows = stored(docs.select(*wanted, tokens_in(docs[text]).alias("n_tokens")), "mixture-rows")
    whole = free_name(docs, "whole_row")
    carried = docs.select(F.struct(*[docs[column] for column in docs.columns]).alias(whole), *wanted)
    return _taken(carried, _planned(rows, weights, budget, 1, seed), seed).select(f"{whole}.*")
