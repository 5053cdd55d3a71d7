import random

import numpy as np
import pytest
import xxhash

from kbspark.llm import gray_index, simhash
from kbspark.llm.components import components
from tests.llm.samples import awkward, documents, prose


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[n:n + 4]) for n in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(one, 42) for one in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def slow_classes(nodes, linked):
    root = {node: node for node in nodes}

    def find(node):
        while root[node] != node:
            node = root[node]
        return node

    for n, a in enumerate(nodes):
        for b in nodes[:n]:
            if linked(a, b):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {node: find(node) for node in nodes}


def test_fingerprint():
    for _, text in awkward() + prose(1, 30):
        assert simhash.fingerprint((text or "").encode()) == slow_fingerprint(text)


def test_fingerprint_over_blocks(monkeypatch):
    from kbspark.llm import common

    monkeypatch.setattr(common, "BLOCK_BYTES", 64)
    for _, text in prose(2, 10):
        assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def near_rows(seed):
    chance = random.Random(seed)
    rows = []
    for key, text in prose(seed, 60):
        words = text.split()
        rows.append((key, text))
        for copy in range(chance.randint(0, 3)):
            other = list(words)
            other[chance.randrange(len(other))] = "changed"
            rows.append((1000 + 10 * key + copy, " ".join(other)))
    return rows + awkward()


def test_near_duplicates_match_brute_force(spark):
    rows = near_rows(3)
    marks = [slow_fingerprint(text) for _, text in rows]
    root = slow_classes(sorted(set(marks)), lambda a, b: (a ^ b).bit_count() <= 4)
    lowest = {}
    for (key, _), mark in zip(rows, marks):
        if key is not None:
            lowest[root[mark]] = min(key, lowest.get(root[mark], key))
    wanted = sorted(((key, mark, lowest.get(root[mark])) for (key, _), mark in zip(rows, marks)), key=repr)
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["code"] % (1 << 64), r["component_id"]) for r in got), key=repr) == wanted


def test_keep_first(spark):
    rows = near_rows(4)
    docs = documents(spark, rows)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    marks = {row["code"]: row["component_id"] for row in simhash.near_duplicates(docs).collect()}
    found = [(row["doc_id"], row["text"]) for row in kept.collect()]
    classes = [marks[int(np.uint64(slow_fingerprint(text)).view(np.int64))] for _, text in found]
    assert len(found) == len(set(zip(classes, [key is None for key, _ in found])))
    assert all(key == component for (key, _), component in zip(found, classes))
    assert {c for c in marks.values()} == set(classes)


def test_empty_table(spark):
    assert simhash.near_duplicates(documents(spark, [])).collect() == []
    assert simhash.keep_first(documents(spark, [])).collect() == []


@pytest.mark.parametrize("split", [3, 20, 16_384])
def test_index_finds_all_links(spark, monkeypatch, split):
    monkeypatch.setattr(gray_index, "SPLIT", split)
    chance = random.Random(split)
    codes = set()
    for _ in range(25):
        base = chance.getrandbits(64)
        for _ in range(chance.randint(1, 40)):
            code = base
            for bit in chance.sample(range(64), chance.randint(0, 5)):
                code ^= 1 << bit
            codes.add(code)
    codes = sorted(codes | {0, (1 << 64) - 1, 1 << 63})
    signed = {code: code - (1 << 64) if code >> 63 else code for code in codes}
    root = slow_classes(codes, lambda a, b: (a ^ b).bit_count() <= 4)
    links = gray_index.near_codes(spark.createDataFrame([(signed[c],) for c in codes], "code long"))
    got = {row["node"]: row["root"] for row in components(links).collect()}
    groups = {}
    for code in codes:
        groups.setdefault(root[code], set()).add(got.get(signed[code], signed[code]))
    assert all(len(group) == 1 for group in groups.values())
    assert len({min(group) for group in groups.values()}) == len(groups)
    assert links.count() < 15 * len(codes)


def test_components_of_paths_and_stars(spark):
    path = [(n, n + 1) for n in range(100, 160)]
    star = [(500, n) for n in range(501, 560)]
    odd = [(7, 7), (None, 3), (9, 8), (8, 9), (9, 8)]
    got = {row["node"]: row["root"] for row in components(spark.createDataFrame(path + star + odd, "x long, y long")).collect()}
    wanted = {n: 100 for n in range(100, 161)} | {n: 500 for n in range(500, 560)} | {8: 8, 9: 8}
    assert got == wanted
    assert components(spark.createDataFrame([], "x long, y long")).collect() == []
