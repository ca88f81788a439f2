"""Ids out of loosely shaped values: strings, lists, objects of scores, nested or as JSON text."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fields of a query row that may hold its positives.
POSITIVE_FIELDS = (
    "positive_doc_ids", "positive_docids", "positive_docs", "positive", "positives", "relevant_doc_ids", "relevant_docs", "relevant",
    "doc_ids", "docids", "doc_id", "docid", "corpus_id", "pid", "pids",
)
#: Fields of an object that hold its id; fields of an evidence object, and those that hold more evidence.
ID_FIELDS = ("id", "_id", "doc_id", "docid", "pid", "corpus_id")
EVIDENCE_FIELDS, INNER_EVIDENCE = ("dia_id", "dialog_id", "turn_id", "id"), ("evidence", "evidences")


@dataclass(frozen=True)
class Shape:
    """How ids are written: what separates them in text, whether text may be JSON, and what an object stands for.

    ``inside`` gives the values to look into, or strings of type Id that are ids as they stand.
    """

    separators: str
    json_text: bool
    inside: Callable[[dict], Iterable[object]]


class Id(str):
    """An id that isn't divided any more."""


def _scored(obj: dict) -> Iterable[object]:
    """The id of an object, else its keys but for those with a number that isn't above 0."""
    named = [obj[k] for k in ID_FIELDS if k in obj]
    if named:
        return [Id(x) for x in named[:1] if x is not None]
    worthless = {k for k, v in obj.items() if pd.notna(n := pd.to_numeric(v if isinstance(v, (str, int, float)) else None, errors="coerce")) and n <= 0}
    return [Id(k) for k in obj if k not in worthless]


def _pointing(obj: dict) -> Iterable[object]:
    """The turns an evidence object names, and only without any of those what its inner evidence names."""
    for fields in (EVIDENCE_FIELDS, INNER_EVIDENCE):
        found = list(evidence_in([obj[k] for k in fields if k in obj]))
        if found:
            return map(Id, found)
    return []


DOCUMENTS = Shape(",", True, _scored)
EVIDENCE = Shape(",;", False, _pointing)


def ids_of(value: object, shape: Shape) -> Iterator[str]:
    """The ids in a value, in order of writing: a walk over what it holds, from a stack of what is still to be seen."""
    ahead = [value]
    while ahead:
        x = ahead.pop()
        more: Iterable[object] = ()
        if isinstance(x, Mapping):
            more = shape.inside(x)
        elif isinstance(x, (list, tuple)):
            more = x
        elif isinstance(x, str) and not isinstance(x, Id):
            opened = _opened(x) if shape.json_text else None
            more = [opened] if opened is not None else map(Id, re.split(f"[{shape.separators}]", x))
        elif x is not None and x == x and str(x).strip():
            yield str(x).strip()
        ahead.extend(reversed(list(more)))


def _opened(text: str) -> object:
    """The JSON array or object that a text is, else None."""
    if not text.lstrip().startswith(("[", "{")):
        return None
    try:
        return json.loads(text)
    except ValueError:
        return None


def ids_in(value: object) -> Iterator[str]:
    """Document ids: of an object its id or its keys, of text the JSON in it or its parts between commas."""
    return ids_of(value, DOCUMENTS)


def evidence_in(value: object) -> Iterator[str]:
    """Turn ids in evidence: parts between commas and semicolons, elements of lists, the id fields of objects."""
    return ids_of(value, EVIDENCE)


def _distinct(find):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: list(dict.fromkeys(find(x))), na_action=None)

    return run


def extract_ids(c: Column) -> Column:
    """Ordered distinct document ids of a string column.

    Nesting has no bound, which built-in functions can't follow, so this is an Arrow-batched function.
    """
    return _distinct(ids_in)(c)


def extract_evidence(c: Column) -> Column:
    """Ordered distinct turn ids of a column that holds evidence as text, or as the JSON of a list or object."""

    def found(x: object) -> Iterator[str]:
        opened = _opened(x) if isinstance(x, str) else None
        return evidence_in(x if opened is None else opened)

    return _distinct(found)(c)


def positives(fields: Sequence[Column]) -> Column:
    """Ordered distinct ids of all fields."""
    return F.array_distinct(F.flatten(F.array(*[extract_ids(c) for c in fields])))


def join_ids(c: Column, sep: str = "，") -> Column:
    return F.array_join(c, sep)


def id_scores(ids: Column, scores: Column, sep: str = "，") -> Column:
    """``id:score`` list with six places."""
    return F.array_join(F.zip_with(ids, scores, lambda i, s: F.concat(i, F.lit(":"), F.format_string("%.6f", s))), sep)


def category_name(category: Column, mapped: Column) -> Column:
    """Mapped name, else the category itself, and ``unknown`` for none."""
    c = F.coalesce(category.cast("string"), F.lit(""))
    return F.when(c == "", F.lit("unknown")).otherwise(F.coalesce(mapped, c))
