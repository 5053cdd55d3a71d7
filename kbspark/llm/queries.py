"""Named queries of this package, and the SQL that states them where SQL can."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from kbspark.llm import (decontaminate, fill_in_middle, kd_shards, licenses, mixing, passages, personal_data, quality,
                         range_join, simhash, token_counts, toxicity, whitening)
from kbspark.llm.common import stored, table
from kbspark.sources.folders import shared_folder

# The mixture of the queries: domains by source number, integer weights per node of the tree.
DOMAINS = ["web", "reference", "books"]
DOMAIN_WEIGHTS = {"web": 5, "reference": 3, "books": 2}
LANG_WEIGHTS = {"en": 6, "de": 2, "fr": 1, "es": 1}
SEED = 17


def _weight_of(column, weights):
    return reduce(lambda rest, item: F.when(column == item[0], item[1]).otherwise(rest), weights.items(), F.lit(1))


def mixture_domain(docs: DataFrame):
    """The domain of a source by its number; sources without a number are web."""
    number = F.coalesce(F.regexp_extract(F.coalesce(docs["source"], F.lit("")), "([0-9]{1,9})$", 1).try_cast("int"),
                        F.lit(0))
    return F.element_at(F.array(*[F.lit(name) for name in DOMAINS]), (number % len(DOMAINS) + 1).cast("int"))


def mixture_weights(docs: DataFrame) -> DataFrame:
    empty = F.lit("")
    leaves = docs.select(mixture_domain(docs).alias("domain"), F.coalesce(docs["lang"], empty).alias("lang"),
                         F.coalesce(docs["source"], empty).alias("source")).distinct()
    return leaves.select(
        "domain", "lang", "source", _weight_of(F.col("domain"), DOMAIN_WEIGHTS).alias("domain_weight"),
        _weight_of(F.col("lang"), LANG_WEIGHTS).alias("lang_weight"),
        (F.length("source") % 3 + 1).alias("source_weight"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    taken = mixing.mixture(docs, mixture_weights(docs), mixture_domain(docs),
                           F.floor(F.col("total") * 6 / 10), max_epochs=2, seed=SEED)
    return taken.select(F.col("key").alias("doc_id"), "domain", "lang", "source", "n_tokens", "n_epochs")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.with_hits(docs, table(spark, sf_dir, "benchmark"), "found")
    found = F.col("found")
    return marked.select(
        "doc_id", found["n_words"].alias("n_words"), decontaminate.n_hit(found).alias("n_hit"),
        F.size(found["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", found["items"]), 256).alias("items_sha256"),
        decontaminate.contaminated(found).alias("contaminated"))


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.without_repeats(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str, tokenizer_dir: str = "/opt/tokenizers") -> DataFrame:
    """Totals after two batches: all documents come; then some are revised and some deleted, and that is sent twice."""
    versions = {name: f"{tokenizer_dir}/{name}.tiktoken" for name in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    docs = table(spark, sf_dir, "documents")
    rollup = token_counts.Rollup(spark, shared_folder(spark, "token-totals"))
    counted = stored(token_counts.per_document(docs, versions), "token-counts")
    rollup.commit("first", token_counts.changes(None, counted))
    revised = docs.filter(F.col("doc_id") % 10 == 3).withColumn("text", F.concat("text", F.lit("\n"), "source"))
    deleted = docs.filter(F.col("doc_id") % 10 == 7)
    gone = token_counts.counts_of(counted, revised.select("doc_id").unionByName(deleted.select("doc_id")))
    for _ in range(2):
        rollup.commit("second", token_counts.changes(gone, token_counts.per_document(revised, versions)))
    return rollup.totals()


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.scored(docs).select("doc_id", "quality_score", (F.col("quality_score") >= quality.THRESHOLD).alias("accepted"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = kd_shards.kd_shards(table(spark, sf_dir, "documents"), ["lang", "source", "n_chars"], leaves=8)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return marks.select("doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_lines(table(spark, sf_dir, "documents"))


def op7_embedding_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_join.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = fill_in_middle.with_middles(docs, "made")
    back = fill_in_middle.restored(F.col("made.output"), F.col("made.form"))
    return made.select("doc_id", "made.n", "made.form", "made.prefix_chars", "made.middle_chars",
                       F.sha2("made.output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = personal_data.with_spans(docs, "found")
    known = F.filter("found", lambda s: s["known"])
    kinds = F.transform(known, lambda s: s["kind"])

    def count(kind: str):
        return F.size(F.filter(kinds, lambda one: one == kind)).cast("long").alias(f"n_{kind}")

    return marked.select("doc_id", *map(count, personal_data.KINDS), F.sha2(personal_data.written(known), 256).alias("base_sha256"),
                         personal_data.written(F.col("found")).alias("spans"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model, fit = whitening.fitted(vectors)
    error = whitening.identity_error(fit, model)
    made = whitening.whitened(vectors, model, "made")
    share = [float(value / model.trace) if model.trace else 0.0 for value in model.values]
    # The outer form keeps Spark from adding a filter on the array's size, which would project every vector twice.
    rows = made.select("vec_id", "made.deviation", F.posexplode_outer("made.whitened").alias("place", "whitened"))
    return rows.filter("place IS NOT NULL").select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(F.array(*map(F.lit, share)).cast("array<double>"), F.col("place")).alias("explained"),
        F.lit(error).alias("identity_error"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_decontamination": op2_decontamination,
    "op3_passages": op3_passages,
    "op4_token_counts": op4_token_counts,
    "op5_quality": op5_quality,
    "op6_licenses": op6_licenses,
    "op7_embedding_range": op7_embedding_range,
    "op8_sharding": op8_sharding,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_personal_data": op12_personal_data,
    "op13_whitening": op13_whitening,
}

_CASES = lambda column, weights: (
    "CASE " + " ".join(f"WHEN {column} = '{name}' THEN {weight}" for name, weight in weights.items()) + " ELSE 1 END")


def _shares_sql(rows, family, child, weight, budget, into):
    """Water filling of one level of the tree, as in ``mixing.shares``."""
    order = f"PARTITION BY {family} ORDER BY capacity / {weight}, {child}"
    return f"""(SELECT *, CAST(least(capacity, floor({weight} * greatest(max(fill) OVER (PARTITION BY {family}), 0.0)))
        AS BIGINT) AS {into} FROM (SELECT *, CAST({budget} - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED
        PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) / CAST(sum({weight}) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED
        FOLLOWING) AS DOUBLE) AS fill FROM {rows}))"""


def _order_sql(epoch):
    return f"CAST('0x' || substr(md5('{SEED}:' || {epoch} || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)"


_TEMPLATE_ROWS = ", ".join(f"('{name}', '{notice}')" for name, notice in licenses.TEMPLATES.items())


def _grams_sql(words):
    return (f"CASE WHEN len({words}) = 1 THEN {words} ELSE list_distinct([{words}[j] || ' ' || {words}[j + 1] "
            f"FOR j IN range(1, len({words}))]) END")


def _drawn_sql(n):
    return f"CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), {8 * n + 1}, 8) AS BIGINT)"


ORACLES = {
    "op11_fill_in_middle": rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, {", ".join(f"{_drawn_sql(n)} AS h{n + 1}" for n in range(4))}
  FROM documents),
cut AS (SELECT *, regexp_extract_all(text, '[ 	-
]*[^ 	-
]+|[ 	-
]+') AS units FROM docs),
placed AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS low,
  greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS high,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
    WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (SELECT *, coalesce(array_to_string(units[1:low], ''), '') AS prefix, coalesce(array_to_string(units[low + 1:high], ''), '') AS middle,
  coalesce(array_to_string(units[high + 1:], ''), '') AS suffix FROM placed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts""",
    "op3_passages": r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
places AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS pos FROM docs WHERE len(words) >= 20),
windows AS (SELECT doc_id, pos, md5(array_to_string(words[pos:pos + 19], ' ')) AS phrase FROM places),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY phrase ORDER BY doc_id, pos) AS nth FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS place FROM ranked WHERE nth > 1),
removed AS (SELECT doc_id, list(place) AS places, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN places IS NULL THEN words
    ELSE [words[j] FOR j IN range(1, len(words) + 1) IF NOT list_contains(places, j)] END, ' '), '')) AS kept_sha256
FROM docs LEFT JOIN removed USING (doc_id)""",
    "op6_licenses": f"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
numbered AS (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS n FROM split),
words AS (SELECT doc_id, CAST(n - 1 AS INTEGER) AS line, regexp_extract_all(translate(lines[n],
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w FROM numbered),
grams AS (SELECT doc_id, line, {_grams_sql("w")} AS g FROM words WHERE len(w) > 0),
templates AS (SELECT license, regexp_extract_all(lower(notice), '[a-z0-9]+') AS w FROM (VALUES {_TEMPLATE_ROWS}) t(license, notice)),
sets AS (SELECT license, {_grams_sql("w")} AS g FROM templates),
compared AS (SELECT doc_id, line, license, CAST(2.0 AS DOUBLE) * len(list_intersect(grams.g, sets.g)) / (len(grams.g) + len(sets.g)) AS dice
  FROM grams, sets)
SELECT doc_id, line, license, dice FROM compared WHERE dice >= 0.8 - 1e-12""",
    "op7_embedding_range": """
WITH RECURSIVE vectors AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
sized AS (SELECT *, sqrt(list_sum([x * x FOR x IN v])) AS size FROM vectors WHERE len(v) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sized a JOIN sized b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND len(a.v) = len(b.v) WHERE a.size > 0 AND b.size > 0 AND list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.98),
reach AS (SELECT vec_id AS start, vec_id AS node FROM embeddings
  UNION SELECT start, b FROM reach JOIN pairs ON node = a),
lowest AS (SELECT start, min(node) AS component_id FROM reach GROUP BY start),
counts AS (SELECT a, count(*) AS n_links FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN lowest ON start = vec_id LEFT JOIN counts ON a = vec_id""",
    "op1_mixing": f"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens,
    coalesce(TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS INTEGER), 0) % 3 AS number
  FROM documents),
rows AS (SELECT * EXCLUDE (number), CASE number WHEN 0 THEN 'web' WHEN 1 THEN 'reference' ELSE 'books' END AS domain FROM words),
whole AS (SELECT CAST(floor(sum(n_tokens) * 6 / 10) AS BIGINT) AS budget FROM rows),
sums AS (
  SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(2 * sum(n_tokens) AS BIGINT) AS capacity,
    {_CASES("domain", DOMAIN_WEIGHTS)} AS domain_weight, {_CASES("lang", LANG_WEIGHTS)} AS lang_weight,
    length(source) % 3 + 1 AS source_weight
  FROM rows GROUP BY ALL HAVING sum(n_tokens) > 0),
langs AS (SELECT domain, lang, CAST(sum(capacity) AS BIGINT) AS capacity, any_value(lang_weight) AS lang_weight,
  any_value(domain_weight) AS domain_weight FROM sums GROUP BY domain, lang),
domains AS (SELECT domain, CAST(sum(capacity) AS BIGINT) AS capacity, any_value(domain_weight) AS domain_weight,
  (SELECT budget FROM whole) AS budget FROM langs GROUP BY domain),
domain_budgets AS (SELECT domain, domain_budget FROM {_shares_sql("domains", "budget", "domain", "domain_weight", "budget", "domain_budget")}),
lang_rows AS (SELECT * FROM langs JOIN domain_budgets USING (domain)),
lang_budgets AS (SELECT domain, lang, lang_budget FROM {_shares_sql("lang_rows", "domain", "lang", "lang_weight", "domain_budget", "lang_budget")}),
leaf_rows AS (SELECT * FROM sums JOIN lang_budgets USING (domain, lang)),
leaves AS (SELECT domain, lang, source, tokens, leaf_budget // tokens AS passes, leaf_budget % tokens AS rest
  FROM {_shares_sql("leaf_rows", "domain, lang", "source", "source_weight", "lang_budget", "leaf_budget")}),
ordered AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY {_order_sql("passes")}, doc_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM rows JOIN leaves USING (domain, lang, source)),
counted AS (SELECT *, passes + CASE WHEN rest > 0 AND running <= rest THEN 1 ELSE 0 END AS n FROM ordered)
SELECT doc_id, domain, lang, source, n_tokens, CAST(n AS BIGINT) AS n_epochs FROM counted WHERE n > 0""",
    "op2_decontamination": r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
starts AS (SELECT item_id, words, least(13, len(words)) AS width, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS pos
  FROM items WHERE len(words) > 0),
wanted AS (SELECT DISTINCT item_id, width, array_to_string(words[pos:pos + width - 1], ' ') AS phrase FROM starts),
widths AS (SELECT DISTINCT width FROM wanted),
places AS (SELECT doc_id, words, width, unnest(range(1, len(words) - width + 2)) AS pos FROM docs, widths
  WHERE len(words) >= width),
windows AS (SELECT doc_id, width, pos, array_to_string(words[pos:pos + width - 1], ' ') AS phrase FROM places),
found AS (SELECT doc_id, width, pos, item_id FROM windows JOIN wanted USING (width, phrase)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM
  (SELECT doc_id, unnest(range(pos, pos + width)) AS place FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM
  (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""",
}
