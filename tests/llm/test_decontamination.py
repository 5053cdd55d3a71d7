import random
import re

from pyspark.sql import functions as F

from kbspark.llm import decontaminate
from tests.llm.samples import awkward, documents, prose


def words(text):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def slow(text, items, window):
    own, hit, names = words(text), set(), set()
    for name, item in items:
        item = words(item)
        width = min(window, len(item))
        wanted = {tuple(item[n:n + width]) for n in range(len(item) - width + 1)} if width else set()
        for n in range(len(own) - width + 1):
            if tuple(own[n:n + width]) in wanted:
                hit.update(range(n, n + width))
                names.add(str(name))
    return len(own), sorted(hit), sorted(names)


def sample(seed):
    chance = random.Random(seed)
    docs = prose(seed, 60, vocabulary=40)
    items = [(n, text) for n, text in prose(seed + 1, 12, vocabulary=40, length=9)] + [(50, None), (51, " . "), (52, "lone")]
    texts = [words(text) for _, text in items]
    for n in range(40):
        one, other = chance.choice(texts), docs[n][1].split()
        cut = chance.randint(0, len(one))
        docs[n] = (docs[n][0], " ".join(other[:3] + [w.upper() for w in one[cut:]] + ["?!"] + other[3:] + one[:cut]))
    return docs + awkward(), items + [(60, items[0][1])]


def check(spark, docs, items):
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("found", F.lit(1))
    rows = decontaminate.with_hits(documents(spark, docs), table, "hits", window=5).collect()
    assert len(rows) == len(docs)
    got = sorted(((r["doc_id"], r["text"], r["hits"]["n_words"], [n for s in r["hits"]["spans"] for n in range(s[0], s[1])],
                   r["hits"]["items"]) for r in rows), key=repr)
    assert got == sorted(((key, text, *slow(text, items, 5)) for key, text in docs), key=repr)


def test_hits_match_brute_force(spark):
    for seed in (1, 2):
        check(spark, *sample(seed))


def test_many_slices(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 100)
    docs, items = sample(3)
    assert len(list(decontaminate.slices(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text"))) > 3
    check(spark, docs, items)


def test_empty_tables(spark):
    check(spark, awkward(), [])
    check(spark, [], [(1, "a b c")])


def test_decontaminated_keeps_clean_rows(spark):
    docs, items = sample(4)
    table = documents(spark, docs)
    clean = decontaminate.decontaminated(table, spark.createDataFrame(items, "item_id long, text string"), window=5)
    assert clean.columns == table.columns
    wanted = []
    for key, text in docs:
        n_words, hit, _ = slow(text, items, 5)
        if not (hit and 20 * len(hit) >= n_words):
            wanted.append((key, text))
    assert sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=repr) == sorted(wanted, key=repr)


def test_spans_are_cut_out(spark):
    text = "Start here. " + "plain words " * 100 + "the Secret, benchmark question! and on"
    docs = documents(spark, [(1, text), (2, None)])
    items = spark.createDataFrame([(1, "the secret benchmark question")], "item_id long, text string")
    rows = {r["doc_id"]: r["text"] for r in decontaminate.decontaminated(docs, items, span_words=4, window=4).collect()}
    assert rows == {1: text.replace("the Secret, benchmark question", ""), 2: None}
