import math
import random

import numpy as np
import pytest

from kbspark.llm import range_join

SCHEMA = "vec_id long, embedding array<float>, label int, unit string, Key int"


def slow(rows, cosine):
    def linked(a, b):
        (_, x, p), (_, y, q) = a, b
        if p is None or p != q or not x or not y or len(x) != len(y) or None in x or None in y:
            return False
        x, y = np.array(x, np.float32).astype(float), np.array(y, np.float32).astype(float)
        size = math.sqrt(x @ x) * math.sqrt(y @ y)
        return bool(np.isfinite(size) and size > 0 and x @ y / size >= cosine)

    near = [[n for n, other in enumerate(rows) if n != m and linked(row, other)] for m, row in enumerate(rows)]
    out, root = [], list(range(len(rows)))
    for _ in rows:
        for m, others in enumerate(near):
            for n in others:
                root[m] = root[n] = min(root[m], root[n])
    lowest = {}
    for m, row in enumerate(rows):
        if row[0] is not None:
            lowest[root[m]] = min(row[0], lowest.get(root[m], row[0]))
    for m, row in enumerate(rows):
        component = lowest.get(root[m])
        out.append((row[0], len(near[m]), component, row[0] == component))
    return sorted(out, key=repr)


def sample(seed, size=8):
    chance = random.Random(seed)
    rows = []
    for centre in range(14):
        middle = [chance.gauss(0, 1) for _ in range(size)]
        for _ in range(chance.randint(1, 22)):
            wide = chance.choice([0.0, .05, .12, .3])
            rows.append((len(rows), [x + chance.gauss(0, wide) for x in middle], centre % 3 if centre % 5 else 0))
    nan = float("nan")
    odd = [None, [], [0.0] * size, [1.0, None] + [0.0] * (size - 2), [nan] + [1.0] * (size - 1), [float("inf")] * size, [1.0, 0.0]]
    rows += [(1000 + n, one, 1) for n, one in enumerate(odd * 2)]
    rows += [(2000, rows[0][1], None), (2001, rows[0][1], None), (5, rows[5][1], rows[5][2]), (None, rows[0][1], rows[0][2]),
             (None, [5.0] * size, 2), (3000, [1e-30] * size, 1), (3001, [1e30] * size, 1), (3002, [2.0] * size, 1)]
    return rows


@pytest.mark.parametrize("cell,block", [(5, 3), (30, 2_048), (1_000, 16)])
def test_links_match_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(range_join, "CELL_ROWS", cell)
    monkeypatch.setattr(range_join, "BLOCK_ROWS", block)
    rows = sample(cell)
    table = spark.createDataFrame([(*row, "u", 1) for row in rows], SCHEMA)
    got = range_join.near_vectors(table).collect()
    assert sorted((tuple(row) for row in got), key=repr) == slow(rows, .98)


def test_no_rows(spark):
    assert range_join.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
