import random
from collections import Counter

import pytest

from silvaframe.llm import mixing as M
from silvaframe.llm import packing as P
from silvaframe.llm import tokens as K
from silvaframe.llm.q_mixing import plain_source


def contents(runs):
    bins: dict[int, list[int]] = {}
    for r in runs:
        if r.size:
            for i in range(r.bins):
                bins.setdefault(r.first + i, []).extend([r.size] * r.each)
    return bins


def test_plans_are_whole_and_fit():
    rng = random.Random(0)
    for _ in range(300):
        cap = rng.choice([7, 30, 100, 256])
        sizes = Counter(rng.randint(0, cap) if rng.random() < 0.7 else rng.randint(cap // 3, cap // 2 + 1) for _ in range(rng.randint(0, 200)))
        runs, n = P.plan(sizes, cap)
        bins = contents(runs)
        assert all(sum(b) <= cap for b in bins.values())
        assert Counter(s for b in bins.values() for s in b) == Counter({s: c for s, c in sizes.items() if s})
        assert all(sum(3 * s > cap for s in b) <= 2 for b in bins.values())
        assert n == (max(len(bins), 1) if sizes.get(0) else len(bins)) and set(bins) <= set(range(n))
        for s in sizes:  # ranks of a size are dealt out once
            at = sorted((r.rank, r.bins * r.each) for r in runs if r.size == s and s)
            assert [a for a, _ in at] == [sum(x for _, x in at[:i]) for i in range(len(at))]
        volume = -(-sum(s * c for s, c in sizes.items()) // cap)
        assert n <= max(1.5 * volume + 2, sum(c for s, c in sizes.items() if 2 * s > cap) + volume + 1)


def test_best_fit_takes_the_tightest_gap():
    runs, n = P.plan({60: 1, 70: 1, 30: 1}, 100)
    assert n == 2 and sorted(map(sorted, contents(runs).values())) == [[30, 70], [60]]


def test_pack(spark):
    rng = random.Random(1)
    docs = [(i, 5 if i % 3 else rng.choice([0, 3, 40, 99, 100, 101, 250])) for i in range(400)]
    t = spark.createDataFrame(docs, "doc_id long, n_tokens long")
    out = P.pack(t, {"s": 100, "l": 1000}).collect()
    for c, cap in (("s", 100), ("l", 1000)):
        own = [r for r in out if r["container"] == c]
        per = Counter()
        for r in own:
            per[r["bin_no"]] += r["size"]
        assert max(per.values()) <= cap
        whole = Counter()
        for r in own:
            whole[r["doc_id"]] += r["size"]
            assert r["first_token"] == r["piece_no"] * cap
        assert dict(whole) == dict(docs)
        assert {d: sum(1 for r in own if r["doc_id"] == d) for d, n in docs if n <= cap} == {d: 1 for d, n in docs if n <= cap}
        total = sum(n for _, n in docs)
        assert len(per) <= 1.1 * total / cap + 2
    assert P.pack(t.where("false"), {"s": 100}).count() == 0
    with pytest.raises(ValueError):
        P.pack(t, {})


def test_token_counts(spark):
    long = "palabra " * 20000
    t = spark.createDataFrame([(1, "hello <|endoftext|>", "a"), (1, "hello <|endoftext|>", "a"), (2, "", None), (3, None, "b"), (4, long, "c"), (None, "x", "d"), (5, "日本 ñ", "e")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["n_tokens"] for r in K.token_counts(t, "doc_id", "text", ("source",)).collect()}
    enc = K.encoding(K.VOCABULARY)
    assert got == {1: len(enc.encode_ordinary("hello <|endoftext|>")), 2: 0, 3: 0, 4: len(enc.encode_ordinary(long)), 5: len(enc.encode_ordinary("日本 ñ"))}
    assert enc.decode(enc.encode_ordinary("日本 ñ")) == "日本 ñ"


def test_fit_is_optimal_with_repeats():
    rng = random.Random(4)
    for seed in range(300):
        counts = Counter(rng.randint(1, 30) * rng.choice([1, 1, 3]) for _ in range(rng.randint(1, 9)))
        repeats, budget = rng.randint(1, 4), rng.randint(0, 400)
        plan = M.plan_source("s", dict(counts), budget, repeats, seed)
        reach = {0}
        for s, c in counts.items():
            reach = {r + s * k for r in reach for k in range(c * repeats + 1)}
        assert plan.planned == max(r for r in reach if r <= budget)
        assert all(0 < u <= counts[s] * repeats for s, u in plan.uses.items())
    assert M.plan_source("actas", {464: 1, 346: 1, 89: 1}, 3300, 6).planned == 3300


def test_fit_of_a_large_budget_is_exact_and_proportional():
    rng = random.Random(5)
    counts = Counter(rng.randint(20, 2000) for _ in range(50000))
    whole = sum(s * c for s, c in counts.items())
    plan = M.plan_source("s", dict(counts), whole // 3, 1)
    assert plan.planned == whole // 3
    assert all(c <= counts[s] for s, c in plan.uses.items())
    short = sum(c for s, c in plan.uses.items() if s < 500) / sum(c for s, c in counts.items() if s < 500)
    long = sum(c for s, c in plan.uses.items() if s > 1500) / sum(c for s, c in counts.items() if s > 1500)
    assert abs(short - 1 / 3) < 0.02 and abs(long - 1 / 3) < 0.02


def test_small_budget_takes_short_and_long_documents():
    counts = {x: 1 for x in range(20, 1020)}
    share = [0, 0]
    for seed in range(20):
        uses = M.plan_source("s", counts, 60000, 1, seed).uses
        for x in uses:
            share[x > 520] += 1
    assert 0.6 < share[0] / share[1] < 1.7
    assert M.plan_source("s", counts, 60000, 1, 1).uses != M.plan_source("s", counts, 60000, 1, 2).uses


def test_large_capacities(spark):
    t = spark.createDataFrame([(i, n) for i, n in enumerate([1 << 22, (1 << 21) + 7, 1 << 21, 5, 5, 0])], "doc_id long, n_tokens long")
    out = P.pack(t, {"x": 1 << 22}).collect()
    per = Counter()
    for r in out:
        per[r["bin_no"]] += r["size"]
    assert len(out) == 6 and max(per.values()) <= 1 << 22 and len(per) == 3


def test_mix(spark):
    rng = random.Random(6)
    docs = [(i, ("big", "big", "mid", "tiny", "none")[i % 5] if i % 11 else None, rng.randint(0, 60)) for i in range(2000)]
    t = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    have = Counter()
    for _, s, n in docs:
        have[s] += n
    targets = [("big", 5000, 1), ("mid", int(have["mid"] * 2.5), 4), ("tiny", have["tiny"] * 9, 3), ("gone", 100, 2)]
    out, plans = M.mix(t, targets)
    rows = out.collect()
    use = {s: sum(r["n_tokens"] * r["uses"] for r in rows if r["source"] == s) for s in ("big", "mid", "tiny")}
    assert use == {"big": 5000, "mid": int(have["mid"] * 2.5), "tiny": have["tiny"] * 3}
    assert {p.source: p.planned for p in plans} == use | {"gone": 0}
    assert max(r["uses"] for r in rows if r["source"] == "mid") in (3, 4) and {r["uses"] for r in rows if r["source"] == "tiny"} == {3}
    assert len({r["doc_id"] for r in rows}) == len(rows)
    other = {r["doc_id"] for r in M.mix(t, targets[:1], seed=7)[0].collect()}
    assert other != {r["doc_id"] for r in rows if r["source"] == "big"}
    assert M.mix(t.where("false"), targets)[0].count() == 0


def test_source_names(spark):
    t = spark.createDataFrame([("Notas-Anotador ",), (" notas  anotador",), ("",), (None,)], "s string")
    assert [r[0] for r in t.select(plain_source(t["s"])).collect()] == ["notas_anotador", "notas_anotador", None, None]
