"""Exact token counts by byte-pair merges: a second backend beside the estimate by characters."""

from __future__ import annotations

import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import ESTIMATOR, estimate_tokens

#: How a text is cut into words before its bytes are merged: a fixed value of byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=1)
def _merges(path: str):
    """The vocabulary of a .tiktoken file (token in base64 and rank, a line each), kept by the Python worker from task to task."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def label(vocabulary: str = "") -> str:
    """What results say about how their tokens are counted."""
    return f"tiktoken ({os.path.basename(vocabulary).removesuffix('.tiktoken')})" if vocabulary else ESTIMATOR


def count_tokens(text: Column, vocabulary: str = "") -> Column:
    """The tokens of a text under a vocabulary's file, which every machine sees at this path; without one, the estimate. Null: none. Texts
    come in Arrow batches and are merged whole; special tokens are ordinary text."""
    text = F.coalesce(text, F.lit(""))
    if not vocabulary:
        return estimate_tokens(text)

    @F.pandas_udf("int")
    def counted(texts: pd.Series) -> pd.Series:
        merges = _merges(vocabulary)
        return pd.Series([len(merges.encode_ordinary(t)) for t in texts], dtype="int32")

    return counted(text)
