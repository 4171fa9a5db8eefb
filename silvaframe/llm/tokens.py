"""Token counts of texts by a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Byte-level BPE for many languages; any .tiktoken rank file will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer, once per Python worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, doc_id: str, text: str, extra: tuple[str, ...] = (), vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, *extra): tokens of each whole text; a null text has none.

    Only ids and counts leave the Python workers.  Doubled rows come once.
    """
    t = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), *extra)
    kinds = [f"{c} {dict(t.dtypes)[c]}" for c in ("doc_id", *extra)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(vocabulary)
        for f in frames:
            n = [0 if x is None else len(enc.encode_ordinary(x)) for x in f.pop("_text")]
            yield f.assign(n_tokens=n)[["doc_id", *extra, "n_tokens"]]

    out = t.mapInPandas(run, ", ".join([*kinds, "n_tokens long"]))
    rest = [F.first(c).alias(c) for c in extra]
    return out.where("doc_id is not null").groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"), *rest)
