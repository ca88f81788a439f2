"""Duplicates hidden by formatting differences: an incremental ledger of canonical keys."""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..skew import bucket_of, join_counted, key128
from ..storage import drop, hadoop, materialize, session_folder
from .bare import bare_doc_col, bare_text_col

#: Keys that one bucket should hold; the number of buckets of a new ledger is a power of two by its first batch.
KEYS_OF_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 1_000_000, 16, 8192


def canonical_keys(df: DataFrame, id_col: str = "example_id", also: tuple[str, ...] = ()) -> DataFrame:
    """(id, key, *also) of every record that isn't void; key is 128 bits of the bare forms of query and doc.

    Void records - query or doc null, or without a letter or digit - have no key and are left out.
    """
    b = df.select(F.col(id_col), *also, bare_text_col(F.col("query")).alias("_q"), bare_doc_col(F.col("doc")).alias("_d"))
    b = b.where((F.col("_q") != "") & (F.col("_d") != ""))
    return b.select(id_col, *also, key128(F.col("_q"), F.col("_d")).alias("key"))


class Ledger:
    """Counts of canonical keys in a folder of bucket tables: (bucket, key, n, keep_id).

    ``merge`` adds a batch.  Only the buckets that have keys in the batch are read, full-outer-joined with the batch's
    own counts and written again, each to a new place; the manifest (one short entry a bucket, their number fixed by
    the first batch) is then replaced by a rename that overwrites, so that there is always one whole manifest.  A
    failed merge leaves the ledger as it was, and merging batches in any order gives the same counts; keep_id is the
    earliest representative, the smallest id of all.  A batch must not be merged twice.  An empty batch changes
    nothing.  Versions that the manifest names no more are removed, but for those of the merge before, which a reader
    may still hold.  Without ``path`` the ledger ends with the application.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None) -> None:
        self.spark, self.wanted = spark, buckets
        self.path = path or f"{session_folder(spark)}/ledger-{uuid.uuid4().hex}"
        self.schema = "key binary, n long, keep_id long"

    def state(self) -> dict:
        """{"buckets": their number, "at": {bucket: version}, "before": versions of the merge before}."""
        p, fs = hadoop(self.spark, f"{self.path}/manifest.json")
        if not fs.exists(p):
            return {"buckets": 0, "at": {}, "before": []}
        got = self.spark.read.text(f"{self.path}/manifest.json", wholetext=True).first()
        return json.loads(got[0])

    def _point(self, state: dict) -> None:
        new, fs = hadoop(self.spark, f"{self.path}/manifest-{uuid.uuid4().hex}")
        out = fs.create(new)
        out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        out.close()
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(new, hadoop(self.spark, f"{self.path}/manifest.json")[0], options)

    def read(self, buckets: list[str] | None = None) -> DataFrame:
        """The ledger, or some of its buckets."""
        at = self.state()["at"]
        paths = sorted(f"{self.path}/version={v}/bucket={b}" for b, v in at.items() if buckets is None or b in buckets)
        if not paths:
            return self.spark.createDataFrame([], f"bucket int, {self.schema}")
        parts = f"{self.schema}, version string, bucket int"
        return self.spark.read.option("basePath", self.path).schema(parts).parquet(*paths).select("bucket", "key", "n", "keep_id")

    def merge(self, batch: DataFrame, id_col: str = "example_id") -> None:
        """Add a batch of canonical_keys."""
        new = materialize(batch.groupBy("key").agg(F.count(F.lit(1)).alias("bn"), F.min(id_col).alias("bid")), "batch")
        state = self.state()
        keys = 0 if state["buckets"] else new.count()
        by_size = 1 << max(0, math.ceil(keys / KEYS_OF_BUCKET) - 1).bit_length()
        buckets = state["buckets"] or self.wanted or min(MOST_BUCKETS, max(LEAST_BUCKETS, by_size))
        new = new.withColumn("bucket", bucket_of(F.col("key"), buckets=buckets, seed=3))
        touched = [str(r["bucket"]) for r in new.select("bucket").distinct().collect()]  # at most MOST_BUCKETS
        if not touched:
            return
        both = self.read(touched).join(new, ["bucket", "key"], "full_outer").select(
            "bucket",
            "key",
            (F.coalesce("n", F.lit(0)) + F.coalesce("bn", F.lit(0))).alias("n"),
            F.least("keep_id", "bid").alias("keep_id"),
        )
        version = f"v{uuid.uuid4().hex}"
        both.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/version={version}")
        at = state["at"] | {b: version for b in touched}
        self._point({"buckets": buckets, "at": at, "before": sorted(set(state["at"].values()))})
        for old in set(state["before"]) - set(at.values()) - set(state["at"].values()):
            drop(self.spark, f"{self.path}/version={old}")


def arrival_batches(df: DataFrame, when: str, batches: int) -> list[DataFrame]:
    """Cut df into batches by time of arrival; rows without one come first, an empty table is one batch."""
    shares = [i / batches for i in range(1, batches)]
    t = F.unix_micros(F.col(when).cast("timestamp"))
    edges = sorted(set(df.agg(F.percentile_approx(t, shares, 500).alias("e")).first()["e"] or [])) if shares else []
    batch = F.lit(0)
    for e in edges:
        batch = batch + F.coalesce((t > F.lit(e)).cast("int"), F.lit(0))
    return [df.where(batch == i) for i in range(len(edges) + 1)]


def ledger_of(df: DataFrame, batches: int = 3) -> tuple[DataFrame, Ledger]:
    """(keys, ledger) of the whole table, taken in as batches by loaded_at."""
    keys = materialize(canonical_keys(df, also=("loaded_at",)), "keys")
    ledger = Ledger(df.sparkSession)
    for batch in arrival_batches(keys, "loaded_at", batches):
        ledger.merge(batch)
    return keys.drop("loaded_at"), ledger


def records(df: DataFrame) -> DataFrame:
    """(keep_id, n_copies): one row for each record that isn't void, with how many rows are this record."""
    _, ledger = ledger_of(df)
    return ledger.read().select("keep_id", F.col("n").alias("n_copies"))


def copies(df: DataFrame) -> DataFrame:
    """(keep_id, copy_id): each row that repeats an earlier one, beside the smallest id of the same record.

    Repeated ids within a record are kept as they stand; a record that occurs once gives no row.
    """
    keys, ledger = ledger_of(df)
    repeated = ledger.read().where(F.col("n") > 1).drop("bucket")
    total = keys.count()
    got = join_counted(keys, repeated, "key", "n", total)
    return got.where(F.col("example_id") != F.col("keep_id")).select("keep_id", F.col("example_id").alias("copy_id"))
