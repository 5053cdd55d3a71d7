import hashlib
import random
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from kbspark.llm import fill_in_middle as fim
from tests.llm.samples import LONG, awkward, documents

UNITS = re.compile("[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def slow(key, text):
    text = text or ""
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * n:8 * n + 8], 16) for n in range(4)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def sample():
    chance = random.Random(5)
    alphabet = ["a", "é", "ß", "𝄞", " ", "\n", "\t", "\x1c", " ", "<P", ">", "<", "S>", "word ", "\x0b", "<M"]
    rows = [(n, "".join(chance.choices(alphabet, k=chance.randint(0, 400)))) for n in range(300)]
    rows += [(n, LONG[:chance.randint(900, 5000)] + chance.choice(["", " ", "x" * 3000, " " * 3000])) for n in range(300, 400)]
    return rows + [(1000, "a <P> b"), (1001, "<S>"), (1002, "x" * 100_000), (1003, " " * 100_000), (1004, "é " * 40_000)] + awkward()


def test_rows_match_brute_force(spark):
    rows = sample()
    found = fim.with_middles(documents(spark, rows), "made").withColumn(
        "back", fim.restored(F.col("made.output"), F.col("made.form"))).collect()
    got = sorted(((r["doc_id"], r["text"], *(r["made"][name] for name in ("n", "form", "prefix_chars", "middle_chars", "output")))
                  for r in found), key=repr)
    assert got == sorted(((key, text, *slow(key, text)) for key, text in rows), key=repr)
    assert all(r["back"] == (r["text"] or "") for r in found)
    assert {r["made"]["form"] for r in found} == {"plain", "spm", "psm"}


def test_columns_stay_and_the_text_passes_python_once(spark):
    docs = documents(spark, awkward())
    made = fim.with_middles(docs, "made")
    assert made.columns == [*docs.columns, "made"]
    plan = made.select("doc_id", F.sha2("made.output", 256), "made.n", "made.form")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert "Exchange" not in plan


def test_empty_table(spark):
    assert fim.with_middles(documents(spark, []), "made").collect() == []


@pytest.mark.parametrize("block", [1, 2, 7])
@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet="ab é𝄞\n\t\x1f", max_size=60))
def test_index(block, text):
    size, fim.BLOCK = fim.BLOCK, block
    try:
        index = fim.UnitIndex(text.encode())
        units = UNITS.findall(text)
        assert index.units == len(units)
        for n in range(len(units) + 1):
            head = "".join(units[:n])
            assert index.end(n) == (len(head.encode()), len(head))
    finally:
        fim.BLOCK = size
