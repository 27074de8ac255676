import itertools
import random

import numpy as np
import pytest

from tallyframe.operators.diff import annotation_differences, diff_copies, hungarian, transport


def brute(left, right):
    """Least total of differing fields over all pairings of the leftovers of one key."""
    l, r = list(left), list(right)
    for x in list(l):
        if x in r:
            l.remove(x)
            r.remove(x)
    if len(l) > len(r):
        l, r = r, l
    return min((sum(sum(a != b for a, b in zip(x, y)) for x, y in zip(l, p)) for p in itertools.permutations(r, len(l))), default=0)


def test_hungarian_is_least():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, m = rng.integers(1, 5, 2)
        cost = rng.integers(0, 4, (n, m)).astype(float)
        small = cost if n <= m else cost.T
        best = min(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(small.shape[1]), small.shape[0]))
        assert sum(cost[a, b] for a, b in hungarian(cost)) == best


@pytest.mark.parametrize("exact_limit", [400, 0])
def test_copies_against_brute_force(spark, exact_limit):
    rng = random.Random(3)
    rows = [[(k, *(rng.choice(["x", "y", None]) for _ in range(3))) for k in "abcdef" for _ in range(rng.randint(0, 4))] for _ in range(2)]
    schema = "k string, f string, g string, h string"
    frames = [spark.createDataFrame(r + [(None, "x", "x", "x")], schema) for r in rows]
    got = diff_copies(*frames, ["k"], ["f", "g", "h"], exact_limit).collect()
    for k in "abcdef":
        l, r = [x[1:] for x in rows[0] if x[0] == k], [x[1:] for x in rows[1] if x[0] == k]
        mine = [x for x in got if x.k == k]
        missing = sum(x.n for x in mine if x.difference != "differs")
        assert missing == abs(len(l) - len(r))
        cost = sum(x.n for x in mine if x.difference == "differs")
        assert cost == brute(l, r) if exact_limit else cost >= brute(l, r)


def annotated(spark, rows):
    full = [(c, {"invoice_number": n, "total_amount": t} if n != "absent" else {}, e, at) for c, n, t, e, at in rows]
    return spark.createDataFrame(full, "case_id string, invoice map<string,string>, expected_needs_review boolean, annotated_at timestamp_ntz")


def test_annotations(spark):
    import datetime as dt

    d = [dt.datetime(2025, 1, i) for i in range(1, 5)]
    left = annotated(spark, [("a", "INV-1", "10.00", True, d[0]), ("a", "old", "1", None, None), ("b", "absent", None, None, d[0]), ("c", "X 1", "1,234.50", False, d[0]), ("c", "X 1", "1,234.50", False, d[0]), ("only", "1", "1", None, d[1]), (None, "1", "1", True, d[0])])
    right = annotated(spark, [("a", "inv-1 ", "10", None, d[1]), ("b", " ", "", True, d[0]), ("c", "X1", "1234,50", False, d[2]), ("new", "1", "1", None, d[1])])
    got = sorted(tuple(r) for r in annotation_differences(left, right).collect())
    assert got == [("a", "differs", "expected_needs_review"), ("b", "differs", "expected_needs_review"), ("new", "only_in_copy", ""), ("only", "only_in_annotations", "")]
    assert annotation_differences(left.limit(0), right.limit(0)).count() == 0


def test_large_keys_have_least_total(spark):
    # L1 shares two fields with both right rows, L2 only with R1.
    schema = "k string, f string, g string, h string"
    left = [("a", "x", "y", "z")] * 300 + [("a", "x", "q", "w")] * 300
    right = [("a", "x", "y", "w")] * 300 + [("a", "p", "y", "z")] * 300
    got = diff_copies(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"], ["f", "g", "h"]).collect()
    assert {x.difference for x in got} == {"differs"} and sum(x.n for x in got) == 600


def test_transport_is_least():
    rng = random.Random(5)
    for _ in range(300):
        width = rng.randint(1, 4)
        sides = [[tuple(rng.choice("xyz") if rng.random() < 0.9 else None for _ in range(width)) for _ in range(rng.randint(1, 9))] for _ in range(2)]
        l, r = [sorted(set(s), key=str) for s in sides]
        n_l, n_r = [sides[0].count(x) for x in l], [sides[1].count(x) for x in r]
        found = transport(l, n_l, r, n_r)
        cost = np.array([[sum(a != b for a, b in zip(x, y)) for y in sides[1]] for x in sides[0]], dtype=float)
        assert sum(n for _, _, n in found) == min(len(sides[0]), len(sides[1]))
        assert sum(n * sum(a != b for a, b in zip(l[i], r[j])) for i, j, n in found) == sum(cost[a, b] for a, b in hungarian(cost))
        assert all(sum(n for a, _, n in found if a == i) <= n_l[i] for i in range(len(l))) and all(sum(n for _, b, n in found if b == j) <= n_r[j] for j in range(len(r)))
