import hashlib
import random

import pytest

from kbspark.llm import passages
from tests.llm.samples import awkward, documents, prose


def slow(rows):
    """Expected rows; documents are the different pairs of key and text."""
    order = sorted({(key is None, key or 0, text) for key, text in rows if text is not None}, key=lambda one: one[:2])
    seen, gone = {}, {}
    for doc in order:
        words = doc[2].encode().split()
        removed = set()
        for n in range(len(words) - 19):
            window = tuple(words[n:n + 20])
            if seen.setdefault(window, (doc, n)) != (doc, n):
                removed.update(range(n, n + 20))
        gone[doc] = removed
    out = []
    for key, text in rows:
        words = (text or "").encode().split()
        removed = gone.get((key is None, key or 0, text), set())
        left = b" ".join(word for n, word in enumerate(words) if n not in removed)
        out.append((key, len(words), len(removed), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def sample(seed):
    chance = random.Random(seed)
    rows = prose(seed, 40, vocabulary=3_000, length=80)
    passage = " ".join(f"p{n}" for n in range(70))
    for n in range(40):
        words = rows[n][1].split()
        at = chance.randint(0, len(words))
        if n % 2:
            cut = passage.split()[chance.randint(0, 30):chance.randint(40, 70)]
            words = words[:at] + cut + words[at:]
        if n % 5 == 0:
            words += rows[(n + 7) % 40][1].split()[:chance.randint(15, 60)]
        if n % 8 == 3:
            words += ["same", "old"] * chance.randint(5, 60) + ["x"] * chance.randint(1, 90)
        rows[n] = (rows[n][0], "\n".join(words))
    return rows + [(200 + n, rows[n][1]) for n in range(0, 40, 6)] + awkward()


@pytest.mark.parametrize("part_rows", [2, 512])
def test_removed_words_match_brute_force(spark, monkeypatch, part_rows):
    monkeypatch.setattr(passages, "PART_ROWS", part_rows)
    for seed in (1, 2):
        rows = [row for row in sample(seed) if row[0] != 9]
        got = passages.without_repeats(documents(spark, rows)).collect()
        assert sorted((tuple(row) for row in got), key=repr) == slow(rows)


def test_shards_are_cut_between_anchors(spark, monkeypatch):
    monkeypatch.setattr(passages, "SHARD_BYTES", 500)
    rows = [row for row in sample(3) if row[0] != 9]
    got = passages.without_repeats(documents(spark, rows)).collect()
    assert sorted((tuple(row) for row in got), key=repr) == slow(rows)


def test_texts_of_one_key_are_ordered(spark):
    shared = " ".join(f"w{n}" for n in range(30))
    rows = [(9, shared + " a"), (9, shared + " b"), (10, shared)]
    got = {(r["n_words"], r["doc_id"], r["n_removed"]) for r in passages.without_repeats(documents(spark, rows)).collect()}
    assert (30, 10, 30) in got and sorted(one[2] for one in got) == [0, 30, 30]


def test_anchors_cover_all_windows():
    for _, text in awkward() + prose(5, 20):
        hashes = passages.word_hashes((text or "").encode())
        assert len(hashes) == len((text or "").encode().split())
        _, first, count, _ = passages.anchors(hashes)
        covered = [n for a, c in zip(first, count) for n in range(a, a + c)]
        assert covered == list(range(max(0, len(hashes) - 19)))


def test_kept_text_and_empty_table(spark):
    rows = [(1, "a  b\tc"), (2, None)]
    got = passages.without_repeats(documents(spark, rows), with_text=True).collect()
    assert {(r["doc_id"], r["kept_text"]) for r in got} == {(1, "a b c"), (2, "")}
    assert passages.without_repeats(documents(spark, [])).collect() == []
