"""Sources mixed to target shares of a total size.

Method: subset-sum budget fitting.  Per source the documents are counted by exact token
length; a length of ``c`` documents may be used ``c * max_repeats`` times.  A seeded
systematic draw takes the same share of the uses of every length, up to a budget that falls
short of the target by a few maximal lengths; a bounded knapsack over the uses that remain
fits the rest, its lengths in a seeded order.  The uses of a length are dealt to its
documents evenly, by rank in a seeded order.

Exactness.  The total is never above the budget.  If the knapsack misses the greatest
total that the lengths' common divisor allows, the part left to it is doubled, at last to
the whole budget, where it is the exact optimum of the bounded knapsack.  So the size of the budget
changes how the total is found, never how near it comes.

Scale.  The driver sees counts per (source, length): at most sources times distinct
lengths.  The dynamic program runs over a few maximal lengths as a rule.  The plan goes
back as a table of a row per (source, length) that is joined.  Ranks come from ``runtime.ranked``, so a
source or a length with a third of all rows is spread over many tasks.

Defined cases.  Documents without tokens, with a null source, with a source that has no
target or longer than their source's budget are not used.  Doubled rows count once.  A
source that cannot reach its target is used as often as allowed and its shortfall reported;
nobody else fills in for it.  Ties go by document id.  A source without documents reports zeros.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime as R

#: The knapsack begins with so many times the greatest length.
LENGTHS_LEFT = 8


@dataclass(frozen=True)
class Plan:
    """``uses``: length -> uses of all its documents together."""

    source: str
    budget: int
    uses: dict[int, int]
    planned: int


def fit(most: dict[int, int], budget: int, rng: np.random.Generator) -> dict[int, int]:
    """Uses per length whose total is as near to the budget as can be, from below.

    ``most``: length -> the greatest number of uses.  If all of them fit, all are taken.
    """
    lengths = np.array(sorted(x for x, n in most.items() if 0 < x <= budget and n > 0), np.int64)
    n = np.array([most[int(x)] for x in lengths], np.int64)
    whole = int((lengths.astype(object) * n).sum()) if len(n) else 0
    if whole <= budget:
        return dict(zip(lengths.tolist(), n.tolist(), strict=True))
    step = gcd(*lengths.tolist())
    bound = budget // step * step
    left, theta, order = LENGTHS_LEFT * int(lengths[-1]), rng.random(), rng.permutation(len(lengths))
    while True:
        bulk = max(0, budget - left)
        # the same share of every length; in order of length, so the total is off by one length at most
        edge = np.floor(np.concatenate([[0], np.cumsum(n)]) * (bulk / whole) + (theta if bulk else 0)).astype(np.int64)
        take = np.minimum(np.diff(edge), n)
        rest = budget - int((lengths.astype(object) * take).sum())
        if rest >= 0:
            add = _knapsack(lengths, n - take, rest, order)
            take = take + add
            total = int((lengths.astype(object) * take).sum())
            if total == bound or not bulk:
                return {int(x): int(c) for x, c in zip(lengths, take, strict=True) if c}
        left *= 2


def _knapsack(lengths: np.ndarray, spare: np.ndarray, budget: int, order: np.ndarray) -> np.ndarray:
    """Bounded subset sum: numbers with the greatest total up to the budget.

    Each length's count is split into powers of two; ``by`` remembers which part first
    reached a total, so that the choice can be walked back.  Ends as soon as the budget is reached.
    """
    by = np.full(budget + 1, -1, np.int32)
    reach = np.zeros(budget + 1, bool)
    reach[0] = True
    parts: list[tuple[int, int]] = []
    for i in order:
        size = int(lengths[i])
        most = min(int(spare[i]), budget // size)
        step = 1
        while most > 0:
            k = min(step, most)
            most -= k
            step *= 2
            w = k * size
            new = np.zeros(budget + 1, bool)
            new[w:] = reach[: budget + 1 - w]
            new &= ~reach
            by[new] = len(parts)
            reach |= new
            parts.append((int(i), k))
        if reach[budget]:
            break
    out = np.zeros(len(lengths), np.int64)
    total = int(np.flatnonzero(reach)[-1])
    while total > 0:
        i, k = parts[by[total]]
        out[i] += k
        total -= k * int(lengths[i])
    return out


def plan_source(source: str, counts: dict[int, int], budget: int, max_repeats: int, seed: int = 42) -> Plan:
    """How often the documents of one source are used."""
    most = {int(s): int(c) * max_repeats for s, c in counts.items()}
    uses = fit(most, int(budget), np.random.default_rng([seed, *source.encode()]))
    return Plan(source, budget, uses, sum(s * c for s, c in uses.items()))


def mix(docs: DataFrame, targets: list[tuple[str, int, int]], seed: int = 42) -> tuple[DataFrame, list[Plan]]:
    """(doc_id, source, n_tokens, uses) and the plans, for (doc_id, source, n_tokens).

    ``targets``: source, budget in tokens, greatest number of uses.
    """
    names = [t[0] for t in targets]
    docs = docs.where((F.col("n_tokens") > 0) & F.col("source").isin(names)).select("doc_id", "source", "n_tokens")
    hist = docs.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")).toPandas()
    plans, rows = [], []
    for source, budget, repeats in targets:
        own = hist[hist["source"] == source]
        counts = dict(zip(own["n_tokens"].tolist(), own["n"].tolist(), strict=True))
        p = plan_source(source, counts, budget, repeats, seed)
        plans.append(p)
        rows += [(source, s, *divmod(u, counts[s])) for s, u in p.uses.items()]
    plan = docs.sparkSession.createDataFrame(rows, "source string, n_tokens long, each long, more long")
    t = docs.withColumn("o", F.struct(F.xxhash64(F.lit(seed), "doc_id").alias("h"), "doc_id"))
    t = R.ranked(t, ["source", "n_tokens"], "o", uniform="o.h").drop("o").join(plan, ["source", "n_tokens"])
    return t.select("doc_id", "source", "n_tokens", (F.col("each") + (F.col("rank") < F.col("more")).cast("long")).alias("uses")).where("uses > 0"), plans
