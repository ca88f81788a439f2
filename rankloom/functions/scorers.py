"""Pluggable scorers: a name stands for a function of (instruction, query, doc) columns that gives a score column."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sampling import packed_batches
from .scalar import lexical_score, sanitize_score
from .text import prompt, word_set

Scorer = Callable[[Column, Column, Column], Column]
_scorers: dict[str, Scorer] = {}


def register(name: str, scorer: Scorer) -> None:
    _scorers[name] = scorer


def scorer(name: str) -> Scorer:
    try:
        return _scorers[name]
    except KeyError:
        raise ValueError(f"no scorer {name!r}; there are {', '.join(sorted(_scorers))}") from None


register("lexical", lambda instruction, query, doc: lexical_score(word_set(query), word_set(doc)))


def model_scorer(load: Callable[[], Callable[[Sequence[str]], Sequence[float]]], batch_size: int = 64, most_chars: int = 0) -> Scorer:
    """A scorer around a model: ``load`` runs once in each Python worker and gives a function of a list of prompts.

    Prompts of an Arrow batch are sorted by length, scored in batches bounded by number and characters, and the scores
    go back into the order of the rows.  NaN becomes 0 and infinities 1 or 0.
    """

    @F.pandas_udf(T.DoubleType())
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in parts:
            order = texts.str.len().sort_values(kind="stable").index
            inputs, scores = texts.loc[order].tolist(), []
            for batch in packed_batches(map(len, inputs), batch_size, most_chars):
                got = list(model([inputs[i] for i in batch]))
                if len(got) != len(batch):
                    raise ValueError(f"the model gave {len(got)} scores for {len(batch)} prompts")
                scores += map(float, got)
            yield pd.Series(scores, index=order, dtype="float64").reindex(texts.index)

    return lambda instruction, query, doc: sanitize_score(run.asNondeterministic()(prompt(instruction, query, doc)))


def score(df: DataFrame, name: str, out: str = "score") -> DataFrame:
    return df.withColumn(out, scorer(name)(F.col("instruction"), F.col("query"), F.col("doc")))
