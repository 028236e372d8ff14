"""Pairs across groups with disjoint sources."""

import random

import pytest

from rillmark.operators.pairing import cross_pairs


def _check(spark, items, local_rows):
    df = spark.createDataFrame(items, "k string, g string, s array<string>")
    pairs = [tuple(r) for r in cross_pairs(df, "k", "g", "s", local_rows=local_rows).collect()]
    of = {k: (g, set(s or [])) for k, g, s in items}

    def may(a, b):
        return of[a][0] != of[b][0] and of[a][1].isdisjoint(of[b][1])

    used = [k for p in pairs for k in p]
    assert len(used) == len(set(used)) and all(may(a, b) for a, b in pairs)
    rest = sorted(set(of) - set(used))
    assert not [(a, b) for a in rest for b in rest if may(a, b)]
    return len(pairs)


@pytest.mark.parametrize("local_rows", [6, 2000])
def test_pairs_leave_no_possible_pair(spark, local_rows):
    rng = random.Random(3)
    items = [(f"q{i}", rng.choice("aaabc"), rng.choice([None, [], [f"d{rng.randint(0, 6)}", f"d{rng.randint(0, 6)}"]])) for i in range(80)]
    assert _check(spark, items, local_rows) > 20


def test_only_the_surplus_of_a_majority_is_left(spark):
    items = [(f"q{i}", "a" if i < 30 else "bc"[i % 2], [f"d{i}"]) for i in range(48)]
    assert _check(spark, items, 4) == 18


def test_one_document_for_all_gives_no_pair(spark):
    assert _check(spark, [(f"q{i}", "ab"[i % 2], ["d"]) for i in range(10)], 4) == 0
