import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import types as T

from silvaframe.llm import q_pairs
from silvaframe.llm.pairs import PairTable, strong

ROW = "basket long, grp string, item int, a string"


def brute(state):
    n, one, two = Counter(), Counter(), Counter()
    for grp, items in state.values():
        if not items:
            continue
        for g in {grp, "all"} - {None}:
            n[g] += 1
            one.update((g, i) for i in items)
            two.update((g, *p) for p in itertools.combinations(sorted(items), 2))
    return {(g, a, b): (c, one[g, a], one[g, b], n[g]) for (g, a, b), c in two.items()}


def got(table, **k):
    return {(r["grp"], r["a"], r["b"]): (r["nab"], r["na"], r["nb"], r["n"]) for r in table.scores(**k).collect()}


@pytest.mark.parametrize("wide", [512, 2])
def test_batches_against_brute_force(spark, wide):
    rng = random.Random(wide)
    table = PairTable(spark, T.LongType(), T.IntegerType(), wide=wide)
    state = {}
    for batch in range(2):
        rows = [(rng.randrange(30), rng.choice(["x", "y", "z"]) if batch else None, rng.randrange(7), "extra") for _ in range(60)]
        rows += rows[:10] + [(None, "x", 1, ""), (99, "x", None, "")]
        table.apply(spark.createDataFrame(rows, ROW))
        for b, g, i, _ in rows:
            if b is None or i is None:
                continue
            old = state.get(b, (None, set()))
            state[b] = (min(filter(None, (old[0], g)), default=None), old[1] | {i})
        assert got(table) == brute(state)
    # whole baskets replaced, one of them emptied
    new = [(1, "q", 3, ""), (1, "q", 4, ""), (2, "q", None, "")]
    table.apply(spark.createDataFrame(new, ROW), replace=True)
    state[1], state[2] = ("q", {3, 4}), (None, set())
    assert got(table) == brute(state)
    assert {k[0] for k in got(table, only_changed=True)} >= {"q", "all"}
    before = table.version, dict(table.live["counts"])
    table.apply(spark.createDataFrame(new[:2], ROW))  # nothing new in it
    assert table.live["counts"] == before[1]


def test_state_is_opened_again(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    make = lambda: PairTable(spark, T.LongType(), T.IntegerType(), path=path)
    make().apply(spark.createDataFrame([(1, "g", 1, ""), (1, "g", 2, "")], ROW))
    table = make().apply(spark.createDataFrame([(1, "g", 3, ""), (2, "g", 1, "")], ROW))
    want = brute({1: ("g", {1, 2, 3}), 2: ("g", {1})})
    assert got(table) == want and {k[0] for k in got(make(), only_changed=True)} == {"g", "all"}
    assert table.vacuum() > 0 and table.vacuum() == 0 and got(make()) == want
    with pytest.raises(ValueError):
        PairTable(spark, T.LongType(), T.IntegerType(), path=path, buckets=3)


def test_hot_group_and_duplicates(spark):
    rows = [(b, "hot" if b % 3 else f"g{b}", i, "") for b in range(90) for i in (1, 2, b % 5 + 3)] * 2
    table = PairTable(spark, T.LongType(), T.IntegerType()).apply(spark.createDataFrame(rows, ROW))
    s = got(table)
    assert s["hot", 1, 2] == (60, 60, 60, 60) and s["all", 1, 2] == (90, 90, 90, 90)
    assert strong(table.scores(), 8).where("grp = 'hot' and a = 1 and b = 2").count() == 0  # chance itself


def test_own_group_comes_before_the_weak_one(spark):
    row = "basket long, grp string, weak string, item int"
    table = PairTable(spark, T.LongType(), T.IntegerType())
    table.apply(spark.createDataFrame([(1, None, "a", 1), (1, None, "a", 2), (2, "z", "a", 1), (2, None, "a", 2)], row))
    assert set(got(table)) == {("a", 1, 2), ("z", 1, 2), ("all", 1, 2)}
    table.apply(spark.createDataFrame([(1, "z", "a", 2)], row))
    assert got(table) == {("z", 1, 2): (2, 2, 2, 2), ("all", 1, 2): (2, 2, 2, 2)}


def test_empty(spark):
    table = PairTable(spark, T.LongType(), T.IntegerType()).apply(spark.createDataFrame([], ROW))
    assert got(table) == {}
    assert got(PairTable(spark, T.LongType(), T.IntegerType()).apply(spark.createDataFrame([(1, "g", 5, "")], ROW))) == {}


def test_strings_as_items(spark):
    t = spark.createDataFrame([("s1", "g", "b"), ("s1", "g", "a")], "basket string, grp string, item string")
    assert got(PairTable(spark, T.StringType(), T.StringType()).apply(t))["g", "a", "b"] == (1, 1, 1, 1)


@pytest.mark.parametrize("name", sorted(q_pairs.SQL))
def test_against_sql(spark, same, name):
    same(spark, q_pairs.QUERIES[name], q_pairs.SQL[name], "/root/testdata/sf0.01")
