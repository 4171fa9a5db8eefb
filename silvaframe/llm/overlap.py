"""Same or near-same records across splits.

Method: winnowing fingerprints.  A record is a sequence of tokens.  The rolling
hashes of its ``k``-grams are mixed, and of each window of ``w`` consecutive ones the
least is selected (the rightmost of equals), so two records that share a run of
``k + w - 1`` tokens share a fingerprint.  Fingerprints are joined across the splits
(never within one); the seeds of a candidate pair are chained collinearly, each
chain is extended by alignment, and the share of each record that the
alignment covers is reported.

Scale.  Equal sequences are collapsed first: the join runs between *distinct*
sequences, so a third of all rows being one record costs one row there.
Records come back by a join on the sequence's key, which adaptive execution
splits where it is skewed.  No bucket is capped.

Defined cases.  A null or empty sequence has no fingerprint and no partner.  A
sequence shorter than ``k`` is one gram.  Doubled rows count once.  Empty splits
give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values, so that the least hash is no function of the token order."""
    h = h.copy()
    for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(mult)
    return h ^ (h >> np.uint64(31))


def winnow(tokens: np.ndarray, sizes: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Selected fingerprints of many sequences at once: (sequence, position, hash).

    ``tokens`` holds the sequences one after the other, ``sizes`` their lengths.
    """
    tokens, sizes = tokens.astype(np.uint64), sizes.astype(np.int64)
    some = np.flatnonzero(sizes > 0)
    sizes = sizes[some]
    if not len(sizes):
        return some, some.astype(np.int64), np.zeros(0, np.uint64)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    end = begin + sizes
    grams = np.maximum(sizes - k + 1, 1)
    of = np.repeat(np.arange(len(sizes)), grams)
    pos = np.arange(len(of)) - np.repeat(np.cumsum(grams) - grams, grams)
    at = begin[of] + pos
    h = np.zeros(len(of), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):  # Horner's rule over all grams of all sequences
            inside = at + j < end[of]
            token = tokens[np.minimum(at + j, len(tokens) - 1)] + np.uint64(1)
            h = np.where(inside, h * _BASE + token, h)
        h = _mix(h)
    # the least hash of each window; <= makes the rightmost of equals win
    windows = np.maximum(grams - w + 1, 1)
    wof = np.repeat(np.arange(len(sizes)), windows)
    start = np.repeat(np.cumsum(grams) - grams, windows) + np.arange(len(wof)) - np.repeat(np.cumsum(windows) - windows, windows)
    last = (np.cumsum(grams) - 1)[wof]
    best = start.copy()
    for j in range(1, w):
        here = np.minimum(start + j, last)
        best = np.where(h[here] <= h[best], here, best)
    best = np.unique(best)
    return some[of[best]], pos[best], h[best]


def chain(seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest collinear chain: positions rise strictly in both sequences."""
    seeds = sorted(set(seeds), key=lambda s: (s[0], -s[1]))
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(seeds)
    for i, (_, b) in enumerate(seeds):
        lo = int(np.searchsorted(tails, b))
        back[i] = ends[lo - 1] if lo else -1
        if lo == len(tails):
            tails.append(b), ends.append(i)
        else:
            tails[lo], ends[lo] = b, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(seeds[i])
        i = back[i]
    return out[::-1]


def extend(a: np.ndarray, b: np.ndarray, seeds: list[tuple[int, int]], k: int, drop: int = 4) -> tuple[int, int]:
    """Tokens of a and of b that the extended chain aligns.

    Each seed grows to both sides along its diagonal while the score (+1 a match, -1 a
    mismatch) is at most ``drop`` behind its best; what follows the best score counts only
    where the walk came to an end of a sequence.  Matching tokens are marked.
    """
    ma, mb = np.zeros(len(a), bool), np.zeros(len(b), bool)
    for pa, pb in seeds:
        if ma[pa] and mb[pb] and ma[min(pa + k, len(a)) - 1]:
            continue  # inside a run that is there already
        for step in (1, -1):
            x, y = (a[pa:], b[pb:]) if step > 0 else (a[:pa][::-1], b[:pb][::-1])
            n = min(len(x), len(y))
            if not n:
                continue
            same = x[:n] == y[:n]
            score = np.cumsum(np.where(same, 1, -1))
            best = np.maximum(np.maximum.accumulate(score), 0)
            far = np.flatnonzero(best - score > drop)
            end = n if not len(far) else int(np.flatnonzero(score[: far[0]] == best[far[0]])[-1]) + 1 if best[far[0]] > 0 else 0
            hit = np.flatnonzero(same[:end])
            ma[pa + hit if step > 0 else pa - 1 - hit] = True
            mb[pb + hit if step > 0 else pb - 1 - hit] = True
    return int(ma.sum()), int(mb.sum())


def fingerprints(seqs: DataFrame, k: int, w: int) -> DataFrame:
    """(seq_id, pos, hash) of the columns seq_id, tokens array<int>."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f[f["tokens"].notna()]
            sizes = f["tokens"].map(len).to_numpy(np.int64)
            flat = np.concatenate([np.asarray(x, np.int64) for x in f["tokens"]]) if len(f) else np.zeros(0, np.int64)
            of, pos, h = winnow(flat, sizes, k, w)
            yield pd.DataFrame({"seq_id": f["seq_id"].to_numpy()[of], "pos": pos.astype(np.int32), "hash": h.view(np.int64)})

    return seqs.select("seq_id", "tokens").mapInPandas(run, "seq_id long, pos int, hash long")


def overlaps(left: DataFrame, right: DataFrame, k: int, w: int, least: float = 0.8, drop: int = 4) -> DataFrame:
    """Pairs of sequences of two sides: (seq_a, seq_b, cover_a, cover_b).

    Both sides: (seq_id long, tokens array<int>), distinct by seq_id.  ``least``: the
    greater of both coverages that a pair needs; ``drop``: see ``extend``.
    """
    fa, fb = fingerprints(left, k, w), fingerprints(right, k, w)
    seeds = fa.select(F.col("seq_id").alias("seq_a"), F.col("pos").alias("pa"), "hash").join(fb.select(F.col("seq_id").alias("seq_b"), F.col("pos").alias("pb"), "hash"), "hash")
    cand = seeds.groupBy("seq_a", "seq_b").agg(F.collect_set(F.struct("pa", "pb")).alias("seeds"))
    cand = cand.join(left.select(F.col("seq_id").alias("seq_a"), F.col("tokens").alias("ta")), "seq_a")
    cand = cand.join(right.select(F.col("seq_id").alias("seq_b"), F.col("tokens").alias("tb")), "seq_b")

    def align(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for s, a, b in zip(f["seeds"], f["ta"], f["tb"], strict=True):
                a, b = np.asarray(a), np.asarray(b)
                x, y = extend(a, b, chain([(p["pa"], p["pb"]) for p in s]), k, drop)
                rows.append((x / len(a), y / len(b)))
            cover = np.array(rows, float).reshape(-1, 2)
            out = pd.DataFrame({"seq_a": f["seq_a"], "seq_b": f["seq_b"], "cover_a": cover[:, 0], "cover_b": cover[:, 1]})
            yield out[np.maximum(cover[:, 0], cover[:, 1]) >= least - 1e-9] if len(out) else out

    return cand.select("seq_a", "seq_b", "seeds", "ta", "tb").mapInPandas(align, "seq_a long, seq_b long, cover_a double, cover_b double")
