"""Items of varying size into containers of fixed capacity.

Method: large-item matching.  Items above a third of the capacity go at most two
to a bin, by greedy matching: the largest is paired with the largest that still
fits.  Smaller items, largest first, go where the gap is tightest (best fit).
Items above the capacity are cut into full pieces and a rest; no other is split.

Scale.  Sizes are whole numbers up to the capacity, so the items are packed as a
*histogram*: one step places all items of a size into all bins of a gap at once.
The driver sees at most ``capacity`` counts, and the plan has a few runs per
size, however many items there are; the result is one global packing.
An item finds its bin from its size and its rank among equals; ranks come from
``runtime.ranked``, which spreads the rows of one size over many tasks.

Defined cases.  Items of size 0 (empty or null texts) lie in bin 0.  Doubled rows
count once.  Ties go by the item's id.  An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime as R


@dataclass(frozen=True)
class Run:
    """Items of ``size`` with ranks from ``rank`` on lie ``each`` to a bin in ``bins`` bins from ``first`` on."""

    size: int
    rank: int
    first: int
    bins: int
    each: int


def plan(sizes: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """The packing of a histogram size -> count, and its number of bins."""
    left = {s: int(n) for s, n in sizes.items() if 0 < s <= capacity and n > 0}
    used = dict.fromkeys(left, 0)
    runs: list[Run] = []
    gaps: list[int] = []  # sorted; open bins by what is free
    at: dict[int, list[tuple[int, int]]] = {}  # gap -> [(first bin, bins)]
    total = 0

    def put(size: int, first: int, bins: int, each: int) -> None:
        runs.append(Run(size, used[size], first, bins, each))
        used[size] += bins * each
        left[size] -= bins * each

    def free(gap: int, first: int, bins: int) -> None:
        if gap > 0 and bins > 0:
            if gap not in at:
                insort(gaps, gap)
                at[gap] = []
            at[gap].append((first, bins))

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        i = bisect_left(large, capacity - a + 1) - 1
        while i >= 0 and not left[large[i]]:
            large.pop(i)
            i -= 1
        b = large[i] if i >= 0 else None
        if b is None or (a == b and left[a] == 1):
            m = left[a]
            put(a, total, m, 1)
            free(capacity - a, total, m)
        elif a == b:
            m = left[a] // 2
            put(a, total, m, 2)
            free(capacity - 2 * a, total, m)
        else:
            m = min(left[a], left[b])
            put(a, total, m, 1)
            put(b, total, m, 1)
            free(capacity - a - b, total, m)
        total += m

    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            i = bisect_left(gaps, s)
            if i == len(gaps):  # no gap is wide enough: new bins
                each = min(capacity // s, left[s])
                m = left[s] // each
                put(s, total, m, each)
                free(capacity - each * s, total, m)
                total += m
                continue
            gap = gaps[i]
            first, m = at[gap].pop()
            if not at[gap]:
                del at[gap], gaps[i]
            each = min(gap // s, left[s])
            take = min(m, left[s] // each)
            put(s, first, take, each)
            free(gap - each * s, first, take)
            free(gap, first + take, m - take)
    if sizes.get(0):
        runs.append(Run(0, 0, 0, 1, 2**60))
        total = max(total, 1)
    return runs, total


def items(counts: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """(container, doc_id, piece_no, first_token, size): every text once per container, cut only where it must be."""
    every = F.explode(F.array(*[F.struct(F.lit(c).alias("container"), F.lit(n).cast("long").alias("cap")) for c, n in sorted(capacities.items())])).alias("c")
    t = counts.select("doc_id", "n_tokens", every).select("doc_id", "n_tokens", "c.*")
    last = F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / F.col("cap")) - 1)
    t = t.select("container", "doc_id", "n_tokens", "cap", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("piece_no"))
    first = F.col("piece_no") * F.col("cap")
    return t.select("container", "doc_id", "piece_no", first.alias("first_token"), F.least(F.col("cap"), F.col("n_tokens") - first).alias("size"))


def pack(counts: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """(container, doc_id, piece_no, first_token, size, bin_no) for (doc_id, n_tokens)."""
    if not capacities:
        raise ValueError("no container")
    it = items(counts, capacities)
    hist = it.groupBy("container", "size").agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most the sum of the capacities
    plans = {}
    for c, cap in capacities.items():
        own = hist[hist["container"] == c]
        runs, _ = plan(dict(zip(own["size"], own["n"], strict=True)), cap)
        runs.sort(key=lambda r: (r.size, r.rank))
        arr = np.array([(r.size, r.rank, r.first, r.each) for r in runs], np.int64).reshape(-1, 4)
        # runs in order of (place of the size among the sizes, rank): 2**23 sizes of 2**40 items each fit
        of = np.unique(arr[:, 0])
        if len(of) >= 1 << 23:
            raise ValueError(f"{len(of)} different sizes are too many for one plan")
        plans[c] = (of, (np.searchsorted(of, arr[:, 0]) << 40) + arr[:, 1], arr)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            bins = np.zeros(len(f), np.int64)
            for c, rows in f.groupby("container").indices.items():
                of, keys, arr = plans[c]
                rank = f["rank"].to_numpy()[rows]
                i = np.searchsorted(keys, (np.searchsorted(of, f["size"].to_numpy()[rows]) << 40) + rank, "right") - 1
                bins[rows] = arr[i, 2] + (rank - arr[i, 1]) // arr[i, 3]
            yield f.drop(columns=["rank"]).assign(bin_no=bins)

    t = it.withColumn("o", F.struct(F.xxhash64("doc_id", "piece_no").alias("h"), "doc_id", "piece_no"))
    t = R.ranked(t, ["container", "size"], "o", uniform="o.h").drop("o")
    kind = dict(counts.dtypes)["doc_id"]
    return t.mapInPandas(place, f"container string, doc_id {kind}, piece_no long, first_token long, size long, bin_no long")
