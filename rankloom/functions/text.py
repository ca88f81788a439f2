"""Column functions for text: Unicode-aware trimming, documents from fields, prompts, snippets, tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fields that make up a document without a doc field, in this order.
DOC_FIELDS = ("title", "type", "abstract", "content", "text", "memory")


def utrim(c: Column) -> Column:
    """Strip white space of any script, not only U+0020."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | c.rlike(r"(?U)^\s*$")


def clean_text(c: Column) -> Column:
    """White space runs become one space."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def first_non_empty(*cols: Column) -> Column:
    """First value that isn't null or blank, trimmed; empty if there is none."""
    return F.coalesce(*[F.nullif(utrim(c.cast("string")), F.lit("")) for c in cols], F.lit(""))


def snippet(c: Column, n: int) -> Column:
    """Collapsed text, cut to n characters with an ellipsis in them."""
    t = clean_text(c)
    return F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n - 3)), F.lit("..."))).otherwise(t)


def compact(c: Column, n: int) -> Column:
    """Text cut after n characters, with an ellipsis behind them."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def truncate(c: Column, n: int) -> Column:
    """First n characters; 0 keeps all."""
    return F.left(c, F.lit(n)) if n > 0 else c


def synthesize_doc(doc: Column, fields: dict[str, Column]) -> Column:
    """The doc, else its named fields as ``name: value`` joined by commas."""
    parts = [F.when(F.nullif(v, F.lit("")).isNotNull(), F.concat(F.lit(f"{k}: "), utrim(v))) for k, v in fields.items()]
    return utrim(F.coalesce(F.nullif(doc, F.lit("")), F.concat_ws(", ", *parts)))


#: The template of a pair, and the frame of chat prompts for yes/no answers.
PAIR_TEMPLATE = ("<Instruct>: ", "\n<Query>: ", "\n<Document>: ")
CHAT_SYSTEM = (
    "Judge whether the Document meets the requirements based on the Query and the Instruct provided. "
    'Note that the answer can only be "yes" or "no".'
)
CHAT_START, CHAT_USER = "<|im_start|>system\n", "<|im_end|>\n<|im_start|>user\n"
CHAT_END = "<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\n"


def prompt(instruction: Column, query: Column, doc: Column) -> Column:
    """Input text of a pointwise scorer."""
    parts = [(F.lit(t), utrim(F.coalesce(c, F.lit("")))) for t, c in zip(PAIR_TEMPLATE, (instruction, query, doc))]
    return F.concat(*[x for pair in parts for x in pair])


def instruction_query(instruction: Column, query: Column, prefix: str = "") -> Column:
    """Query with its instruction in front, if there is one; ``prefix`` names the query."""
    i, q = (utrim(F.coalesce(c, F.lit(""))) for c in (instruction, query))
    return F.when(i == "", F.concat(F.lit(prefix if prefix else ""), q)).otherwise(F.concat(i, F.lit(f"\n\n{prefix}"), q))


def chat_prompt(instruction: Column, query: Column, doc: Column, system: str = CHAT_SYSTEM, gap: str = "\n") -> Column:
    """Chat-form prompt whose next token is yes or no; ``gap`` goes before query and document, once more than in the pair template."""
    values = [F.coalesce(c, F.lit("")) for c in (instruction, query, doc)]
    marks = [t.replace("\n", "\n" + gap) for t in PAIR_TEMPLATE]
    body = [x for m, v in zip(marks, values) for x in (F.lit(m), v)]
    return F.concat(F.lit(CHAT_START + system + CHAT_USER), *body, F.lit(CHAT_END))


def chat_pair(instruction: Column, query: Column, doc: Column, system: str = " " + CHAT_SYSTEM) -> Column:
    """struct(query, document): the two halves of a chat prompt for scorers that take a pair."""
    i, q, d = (F.coalesce(c, F.lit("")) for c in (instruction, query, doc))
    first = F.concat(F.lit(CHAT_START + system + CHAT_USER + PAIR_TEMPLATE[0]), i, F.lit(PAIR_TEMPLATE[1]), q, F.lit("\n"))
    return F.struct(first.alias("query"), F.concat(F.lit(PAIR_TEMPLATE[2].lstrip()), d, F.lit(CHAT_END)).alias("document"))


def fill_template(template: str, query: Column) -> Column:
    """A template with one ``{query}`` place."""
    if "{query}" not in template:
        raise ValueError("the template needs a {query} field")
    return F.replace(F.lit(template), F.lit("{query}"), query)


def pair_length(instruction: Column, query: Column, doc: Column) -> Column:
    """Characters of the filled pair template, its parts not trimmed."""
    total = F.lit(sum(map(len, PAIR_TEMPLATE)))
    for c in (instruction, query, doc):
        total = total + F.coalesce(F.length(c), F.lit(0))
    return total


def turn_doc(
    session: Column, session_time: Column, speaker: Column, said: Column, speaker_a: Column | None = None, speaker_b: Column | None = None,
    caption: Column | None = None, image_query: Column | None = None,
) -> Column:
    """Document text of one dialogue turn: its filled fields by name behind the session; empty if none is filled."""
    none = F.lit(None).cast("string")
    filled = lambda c: F.nullif(clean_text(none if c is None else c), F.lit(""))
    both = F.nullif(F.concat_ws(", ", filled(speaker_a), filled(speaker_b)), F.lit(""))
    fields = [("time", filled(session_time)), ("speaker", filled(speaker)), ("participants", both), ("text", filled(said))]
    fields += [("image_caption", filled(caption)), ("image_search_query", filled(image_query))]
    parts = F.concat_ws(", ", *[F.concat(F.lit(f"{k}: "), c) for k, c in fields])
    return F.when(parts == "", F.lit("")).otherwise(F.concat(F.lit("session: "), session, F.lit(", "), parts))


def clean_cell(c: Column) -> Column:
    """Cell of a spreadsheet as text: null, NaN and blanks become empty, whole numbers lose their fraction."""
    t = utrim(F.coalesce(c.cast("string"), F.lit("")))
    whole = F.regexp_replace(t, r"^(-?\d+)\.0+$", "$1")
    return F.when(F.lower(t).isin("nan", "none"), F.lit("")).otherwise(whole)


def split_ids(c: Column) -> Column:
    """Ordered distinct ids of a cell; separators are commas, semicolons, enumeration commas, tabs and line ends."""
    parts = F.split(F.coalesce(c, F.lit("")), "[,，、;；\\n\\r\\t]+")
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.regexp_replace(x, "^[ \\u3000]+|[ \\u3000]+$", "")), lambda x: x != ""))


def unique_keep_order(c: Column) -> Column:
    return F.array_distinct(F.filter(c, lambda x: x.isNotNull() & (x != "")))


def normalize_list(c: Column) -> Column:
    """Array of a JSON list in a string, else of a comma-separated string."""
    as_json = F.from_json(c, "array<string>")
    csv = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[,;]"), lambda x: utrim(x)), lambda x: x != "")
    return F.when(c.rlike(r"^\s*\["), F.coalesce(as_json, csv)).otherwise(csv)


def normalize_doc(title: Column, text: Column) -> Column:
    """Corpus text; the title goes before it if it isn't part of it."""
    t, x = utrim(F.coalesce(title, F.lit(""))), utrim(F.coalesce(text, F.lit("")))
    both = utrim(F.concat(F.lit("title: "), t, F.lit("\ntext: "), x))
    return F.when((t != "") & (F.instr(x, t) == 0), both).otherwise(x)


def bm25_tokens(c: Column) -> Column:
    """Lower-case ASCII words, each CJK ideograph, then the bigrams of the ideographs in a row, gaps left out."""
    t = F.lower(F.coalesce(c, F.lit("")))
    words = F.regexp_extract_all(t, F.lit("[a-z0-9]+"), F.lit(0))
    chars = F.regexp_extract_all(t, F.lit("[\\u4e00-\\u9fff]"), F.lit(0))
    pairs = F.zip_with(F.slice(chars, 1, F.greatest(F.size(chars) - 1, F.lit(0))), F.slice(chars, 2, F.greatest(F.size(chars), F.lit(1))), lambda a, b: F.concat(a, b))
    return F.concat(words, chars, F.when(F.size(chars) > 1, pairs).otherwise(F.array().cast("array<string>")))


def word_set(c: Column) -> Column:
    """Distinct lower-case words of letters and digits."""
    t = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.array_distinct(F.filter(F.split(t, " "), lambda x: x != ""))


def stringify(v: Column, path: str) -> Column:
    """Text of a VARIANT leaf; null and absent are empty, objects and arrays their JSON with sorted keys."""
    return F.coalesce(F.try_variant_get(v, path, "string"), F.to_json(F.try_variant_get(v, path, "variant")), F.lit(""))


def group_key(query_id: Column, query: Column) -> Column:
    """query_id, or the query where that is null or blank."""
    return F.when(is_blank(query_id), query).otherwise(query_id)


def prefixed_key(fields: Sequence[tuple[str, Column]], fallback: Column) -> Column:
    """``name:value`` of the first filled field, else a key of its own for the row."""
    return F.coalesce(*[F.when(~is_blank(c), F.concat(F.lit(f"{k}:"), c)) for k, c in fields], F.concat(F.lit("row:"), fallback.cast("string")))
