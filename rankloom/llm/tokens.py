"""Token counts of whole texts by a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Default vocabulary, a byte-level BPE for many languages.  The file must be there on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how byte-level BPE vocabularies of this kind cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY):
    """The tokenizer of a rank file; made once in each process."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(vocabulary: str = VOCABULARY):
    """Column function: tokens of a text; 0 for null and empty ones."""

    @F.pandas_udf(T.LongType())
    def count(s: pd.Series) -> pd.Series:
        e = encoder(vocabulary)
        return pd.Series([len(e.encode_ordinary(x)) if x else 0 for x in s], dtype="int64")

    # deterministic, but marked so that a filter on the result isn't pushed below it, which would count twice
    return count.asNondeterministic()


def with_tokens(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """df with n_tokens instead of the text."""
    return df.withColumn("n_tokens", count_tokens(vocabulary)(F.col(text))).drop(text)
