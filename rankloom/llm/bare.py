"""Bare forms: what is left of a query or doc once its formatting is taken away.

The bare form of a string is its NFKC form in folded case without anything but letters and digits.  A doc that
consists of two or more named fields (``name: value`` or a JSON object) is first put into the order of its field
names, so that two spellings of one record have one bare form.

Python's Unicode tables are needed here (Spark SQL has no NFKC and no full case folding), so these are Arrow-batched
pandas UDFs; everything after them works on 128-bit keys and stays in the JVM.
"""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of a doc's fields.
FIELD_NAMES = ("abstract", "content", "memory", "text", "title", "type")

_ASCII_OUT = bytes(b for b in range(128) if not chr(b).isalnum())
_INVISIBLE = re.compile(r"[­͏؜᠎​-‏‪-‮⁠-⁤⁦-⁩︀-️﻿]+")
_FIRST_FIELD = re.compile(rf"[\W_]*(?:{'|'.join(FIELD_NAMES)})[\"']?\s*:", re.I)
#: Punctuation and spaces that NFKC turns into nothing with a letter or digit.  They go first: NFKC is quick on what
#: is left of most texts, and slow on full-width punctuation.
_SURELY_OUT = re.compile(
    "[%s]+"
    % "".join(
        re.escape(c)
        for c in map(chr, [*range(0x100), *range(0x2000, 0x2070), *range(0x3000, 0x3040), *range(0xFF00, 0xFFF0)])
        if not c.isalnum() and not unicodedata.combining(c) and not any(map(str.isalnum, unicodedata.normalize("NFKC", c)))
    )
)
_LONGEST = max(map(len, FIELD_NAMES))
_WORD = re.compile(r"[^\W_]")
#: The first two letters of a name, with what may stand between them before invisible marks are taken out.
_MAYBE_NAME = re.compile("|".join(rf"{a}[^\w\s]*{b}" for a, b in sorted({n[:2] for n in FIELD_NAMES})), re.I)


def bare_text(s: str | None) -> str:
    """Bare form of one string; null gives the empty string."""
    if not s:
        return ""
    if s.isascii():
        return s.lower().encode().translate(None, _ASCII_OUT).decode()
    s = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", _SURELY_OUT.sub("", s)).casefold())
    return s if s.isalnum() else "".join(filter(str.isalnum, s))


def _marks(t: str) -> list[tuple[int, int, str]]:
    """(start of the name, start of the value, name) of each place where a field seems to begin."""
    found, p = [], t.find(":")
    while p >= 0:
        end = p
        while end > 0 and t[end - 1].isspace():
            end -= 1
        low = max(0, end - _LONGEST - 4)
        head = t[low:end].rstrip("\"'")
        head = head.lower() if head.isascii() else "".join(c.lower() if c.isascii() else "\0" for c in head)
        for name in FIELD_NAMES:
            if head.endswith(name):
                q = low + len(head) - len(name)
                if q <= 0 or not t[q - 1].isalnum():
                    found.append((q, p + 1, name))
                break
        p = t.find(":", p + 1)
    return found


def named_fields(s: str) -> list[tuple[str, str]] | None:
    """(name, value) of each field in order of writing if the doc consists of two or more named fields, else None."""
    t = s.strip()
    if t[:1] == "{":
        try:
            obj = json.loads(t)
        except ValueError:
            obj = None
        if isinstance(obj, dict) and len(obj) >= 2:
            pairs = [(str(k).strip().lower(), v) for k, v in obj.items()]
            if all(k in FIELD_NAMES for k, _ in pairs):
                return [(k, v if isinstance(v, str) else "" if v is None else json.dumps(v, ensure_ascii=False)) for k, v in pairs]
    # a name must be the first word; what stands before it may be long, but its letters show soon in most texts
    if t.isascii():
        if not _FIRST_FIELD.match(t):
            return None
    else:
        first = _WORD.search(t)
        if not first or not _MAYBE_NAME.match(unicodedata.normalize("NFKC", t[first.start() : first.start() + 8 * _LONGEST])):
            return None
        t = _INVISIBLE.sub("", unicodedata.normalize("NFKC", t))
        if not _FIRST_FIELD.match(t):
            return None
    marks = _marks(t)
    if len(marks) < 2:
        return None
    ends = [m[0] for m in marks[1:]] + [len(t)]
    return [(name, t[start:end]) for (_, start, name), end in zip(marks, ends)]


def bare_doc(s: str | None) -> str:
    """Bare form of one doc; its fields, if it has two or more, in the order of their names."""
    if not s:
        return ""
    fields = named_fields(s)
    if not fields:
        return bare_text(s)
    values = sorted((n, bare_text(v)) for n, v in fields)
    return "".join(n + v for n, v in values) if any(v for _, v in values) else ""


@F.pandas_udf(T.StringType())
def _bare_text_udf(s: pd.Series) -> pd.Series:
    return s.map(bare_text, na_action=None)


@F.pandas_udf(T.StringType())
def _bare_doc_udf(s: pd.Series) -> pd.Series:
    return s.map(bare_doc, na_action=None)


# Marked as not deterministic, though they are: else a filter on their result is pushed below them and they run twice.
def bare_text_col(c: Column) -> Column:
    return _bare_text_udf.asNondeterministic()(c)


def bare_doc_col(c: Column) -> Column:
    return _bare_doc_udf.asNondeterministic()(c)
