"""JSON lines and JSON documents as VARIANT records, and records as examples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import coerce_label
from ..functions.text import DOC_FIELDS, group_key, synthesize_doc, utrim
from ..schemas import ALIASES
from .order import with_place


def read_json_lines(spark: SparkSession, path: str | Sequence[str], on_bad: str = "raise") -> DataFrame:
    """(source_index, record): one VARIANT a line, in the order of file and line; blank lines are skipped, a BOM too.

    on_bad is "raise" for an error that names file and line, "drop" to leave out what isn't a JSON object, or "any" to
    take every JSON value and leave out only what can't be parsed.
    """
    lines = with_place(spark.read.text(path), path).select("file", "source_index", F.regexp_replace("value", "^\\ufeff", "").alias("line"))
    lines = lines.where(utrim(F.col("line")) != "").withColumn("record", F.try_parse_json("line"))
    is_object = F.coalesce(F.schema_of_variant("record").startswith("OBJECT"), F.lit(False))
    if on_bad == "raise":
        text = F.concat(F.lit("not a JSON object in "), F.col("file"), F.lit(" at row "), F.col("source_index").cast("string"))
        return lines.select("source_index", F.when(is_object, F.col("record")).otherwise(F.raise_error(text).cast("variant")).alias("record"))
    keep = is_object if on_bad == "drop" else F.col("record").isNotNull()
    return lines.where(keep).select("source_index", "record")


def read_json_document(spark: SparkSession, path: str | Sequence[str], keys: Sequence[str] = ("data", "records", "examples", "items"), values: bool = False) -> DataFrame:
    """(source_index, record) of JSON files, each an array, an object with an array under one of the keys, or one
    object; with ``values`` the values of an object of objects are the records.  Elements that aren't objects are left out.
    """
    files = with_place(spark.read.text(path, wholetext=True), path, "place")
    doc = files.select("place", F.try_parse_json(F.regexp_replace("value", "^\\ufeff", "")).alias("v"))
    array = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>"))
    for k in keys:
        array = F.coalesce(array, F.try_variant_get("v", f"$.{k}", "array<variant>"))
    if values:
        array = F.coalesce(array, F.map_values(F.try_variant_get("v", "$", "map<string, variant>")))
    array = F.coalesce(array, F.array("v"))
    rows = doc.select("place", F.posexplode(array).alias("i", "record")).where(F.schema_of_variant("record").startswith("OBJECT"))
    return rows.select((F.col("place") + F.col("i")).alias("source_index"), "record")


def present(v: str, name: str) -> Column:
    """Whether a record has a key, also with a null value."""
    return F.try_variant_get(v, f"$['{name}']", "variant").isNotNull()


def text_of(v: str, name: str) -> Column:
    """Text of a key's value; objects and arrays as JSON, null and absent ones null."""
    return F.coalesce(F.try_variant_get(v, f"$['{name}']", "string"), F.nullif(F.to_json(F.try_variant_get(v, f"$['{name}']", "variant")), F.lit("null")))


def first_present(v: str, names: Sequence[str]) -> Column:
    """Text of the first key that is there; null if its value is null."""
    out = F.lit(None).cast("string")
    for name in reversed(names):
        out = F.when(present(v, name), text_of(v, name)).otherwise(out)
    return out


def first_filled(v: str, names: Sequence[str]) -> Column:
    """Text of the first key whose value isn't null, blank, false, or the number zero; the text "0" is a value."""

    def filled(name: str) -> Column:
        text = F.nullif(utrim(text_of(v, name)), F.lit(""))
        is_text = F.schema_of_variant(F.try_variant_get(v, f"$['{name}']", "variant")) == "STRING"
        nothing = text.isin("false", "[]", "{}") | (text.try_cast("double") == 0)
        return F.when(is_text | ~F.coalesce(nothing, F.lit(False)), text)

    return F.coalesce(*map(filled, names))


def to_examples(records: DataFrame, default_instruction: str = "", require_label: bool = True) -> DataFrame:
    """Canonical examples of VARIANT records; rows without query, doc or (if required) label are left out."""
    v = "record"
    fields = ("labels", "raw_label", "label", "score", "instruction", "doc", "reason", *DOC_FIELDS)
    # Each value is taken out once, in a projection of its own: what follows names them several times.  The number keeps
    # the optimiser from moving the filter below it, where it would take them out again.
    raw = records.select(
        "source_index",
        (F.lit(0) if records.isStreaming else F.monotonically_increasing_id()).alias("_no"),  # a stream has no such number
        *[text_of(v, n).alias(f"_{n}") for n in fields],
        *[present(v, n).alias(f"_has_{n}") for n in ("labels", "raw_label", "label")],
        *[first_present(v, ALIASES[n]).alias(n) for n in ("query", "query_id", "doc_id")],
    )
    at = {n: F.col(f"_{n}") for n in fields}
    has = [F.col(f"_has_{n}") for n in ("labels", "raw_label", "label")]
    raw = raw.withColumn("_value", F.when(has[0], at["labels"]).when(has[1], at["raw_label"]).when(has[2], at["label"]).otherwise(at["score"]).try_cast("double"))
    label = coerce_label(*[F.col("_value")] * 4, *has)
    got = raw.select(
        "source_index",
        "_no",
        F.coalesce(F.nullif(utrim(F.coalesce(at["instruction"], F.lit(""))), F.lit("")), F.lit(default_instruction)).alias("instruction"),
        utrim(F.coalesce("query", F.lit(""))).alias("query"),
        "query_id",
        "doc_id",
        synthesize_doc(at["doc"], {k: at[k] for k in DOC_FIELDS}).alias("doc"),
        label.alias("_l"),
        at["reason"].alias("reason"),
    )
    got = got.where((F.col("query") != "") & (F.col("doc") != "") & (F.col("_no") >= 0))
    if require_label:
        got = got.where(F.col("_l").isNotNull())
    return got.select(
        "source_index", group_key(F.col("query_id"), F.col("query")).alias("group_key"), "instruction", "query", "query_id", "doc_id", "doc",
        F.col("_l.label").alias("label"), F.col("_l.raw").alias("raw_label"), "reason",
    )


def read_assignment(spark: SparkSession, path: str) -> DataFrame:
    """(key, index, split) of a split file: rows with split and a key, or an object with three lists.

    In the object form, lists of whole numbers name row numbers, others keys.
    """
    doc = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    rows = doc.select(F.explode(F.try_variant_get("v", "$", "array<variant>")).alias("r"))
    key = F.coalesce(*[F.try_variant_get("r", f"$.{k}", "string") for k in ("group_key", "query_id", "query")])
    a = rows.select(key.alias("key"), F.try_variant_get("r", "$.index", "long").alias("index"), F.try_variant_get("r", "$.split", "string").alias("split"))
    for name in ("train", "dev", "test"):
        items = doc.select(F.explode(F.try_variant_get("v", f"$.{name}", "array<variant>")).alias("r"))
        whole = F.schema_of_variant("r") == "BIGINT"
        b = items.select(F.when(~whole, F.try_variant_get("r", "$", "string")).alias("key"), F.when(whole, F.try_variant_get("r", "$", "long")).alias("index"), F.lit(name).alias("split"))
        a = a.unionByName(b)
    return a.where(F.col("key").isNotNull() | F.col("index").isNotNull())
