"""Hard negatives against brute force, with ties, odd vectors and many blocks of anchors."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilspark.llm import negatives

ROWS = "id long, label long, vec array<double>, anchor long, score string"


def plain(rows, is_anchor, rule):
    """All answers by sorting all rows for each anchor."""
    good = {}
    for i, label, vec, *_ in rows:
        if None not in (i, label, vec) and all(x is not None and math.isfinite(x) for x in vec):
            good[i, label, tuple(math.floor(rule.steps * x) for x in vec)] = None
    out = set()
    for i, label, vec in good:
        if not is_anchor(i):
            continue
        scored = {(sum(p * q for p, q in zip(vec, w)), j, m == label) for j, m, w in good if j != i and len(w) == len(vec)}
        near = sorted({(-s, j) for s, j, same in scored if same})[: rule.positives]
        for s, j in near:
            fits = sorted({(-t, k) for t, k, same in scored if not same and rule.low * -s <= 100 * t <= rule.high * -s})
            out |= {(i, j, rank, k, -s, -t) for rank, (t, k) in enumerate(fits[: rule.negatives], 1)}
    return sorted(out)


def answers(spark, rows, rule, most=negatives.BLOCK_BYTES):
    got = negatives.mine(spark.createDataFrame(rows, ROWS), F.col("id") % 10 == 0, rule, most).collect()
    return sorted(tuple(r) for r in got)


@pytest.mark.parametrize("seed,rule", [(1, negatives.Rule()), (2, negatives.Rule(3, 4, 10, 95, 4)), (3, negatives.Rule(2, 1, 0, 100, 1))])
def test_equals_brute_force_with_ties_and_many_blocks(spark, seed, rule):
    rng = random.Random(seed)
    vector = lambda: [round(rng.uniform(-1, 2), rng.choice([0, 1, 3])) for _ in range(4)]
    some = [vector() for _ in range(60)]
    rows = [(i, rng.randint(0, 2), rng.choice(some) if rng.random() < 0.5 else vector(), 1, "x") for i in range(220)]
    want = plain(rows, lambda i: i % 10 == 0, rule)
    assert want and answers(spark, rows, rule) == want
    if seed == 2:
        assert answers(spark, rows, rule, most=500) == want


def test_odd_rows_take_no_part_and_repeated_rows_count_once(spark):
    rule = negatives.Rule(steps=1)
    nan, inf = float("nan"), float("inf")
    rows = [(10, 1, [3.0, 4.0]), (11, 1, [5.0, 5.0]), (11, 1, [5.0, 5.0]), (12, 2, [2.0, 2.0]), (12, 2, [2.0, 2.0]), (13, 2, [2.5, 2.0]),
            (14, None, [2.0, 2.0]), (15, 2, None), (16, 2, [None, 2.0]), (17, 2, [nan, 2.0]), (18, 2, [inf, 2.0]), (19, 2, [2.0]), (21, 2, []),
            (None, 2, [2.0, 2.0]), (10, 1, [3.0, 4.0]), (20, 3, []), (22, 2, [1e300, 2.0])]
    rows = [(*r, None, None) for r in rows]
    assert answers(spark, rows, rule) == [(10, 11, 1, 12, 35, 14), (10, 11, 2, 13, 35, 14)]
    assert answers(spark, rows[13:14], rule) == answers(spark, [], rule) == []


def test_products_are_exact_where_doubles_are_not(spark):
    big = float(negatives.LARGEST)
    rows = [(10, 1, [big, big, 1.0]), (1, 1, [big, big, 1.0]), (2, 2, [big, -1.0, 1.0]), (3, 2, [big, -2.0, big])]
    rows = [(*r, 0, "") for r in rows]
    rule = negatives.Rule(low=0, high=100, steps=1)
    want = plain(rows, lambda i: i % 10 == 0, rule)
    assert want[0][4] > 2**53 and answers(spark, rows, rule) == want


def test_a_slot_list_keeps_the_best_over_many_batches():
    rng = np.random.default_rng(4)
    best = negatives.Best(3, 5)
    lists, scores, ids = rng.integers(0, 3, 5000), rng.integers(0, 40, 5000), rng.integers(0, 900, 5000)
    for a in range(0, 5000, 100):
        best.add(lists[a : a + 100], scores[a : a + 100], ids[a : a + 100])
        if a % 700 == 0:
            best.cut()
    got = list(zip(*(c.tolist() for c in best.cut())))
    every = sorted({(a, -s, i) for a, s, i in zip(lists.tolist(), scores.tolist(), ids.tolist())})
    assert got == [(a, -s, i) for x in range(3) for a, s, i in [e for e in every if e[0] == x][:5]]
    assert pa.array(got[0]).type == pa.int64()
