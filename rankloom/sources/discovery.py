"""Finding the files of a dataset, and tables kept under the hash of their settings."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

#: Where the files of a split lie in a dataset's folder; where those of relevance judgements lie in it, and
#: in a folder of their own.
SPLIT_PATTERNS = ("{s}.jsonl", "{s}.json", "{s}-*.jsonl", "{s}-*.json", "{s}*.parquet", "data/{s}*.parquet", "data/{s}-*.parquet")
QRELS_INSIDE = tuple(f"{at}.{kind}" for at in ("qrels/*", "*qrels*") for kind in ("tsv", "txt", "csv", "parquet"))
QRELS_APART = tuple(f"{at}.{kind}" for at in ("*", "data/*", "qrels/*") for kind in ("tsv", "txt", "csv", "parquet"))


def glob(spark: SparkSession, patterns: Sequence[str]) -> list[str]:
    """Files that match, in order of the patterns and by name, each once; any file system that Hadoop knows."""
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), {}
    for pattern in patterns:
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        for status in path.getFileSystem(conf).globStatus(path) or []:
            if status.isFile():
                out[status.getPath().toString()] = None
    return list(out)


def split_files(spark: SparkSession, folder: str, split: str) -> list[str]:
    return glob(spark, [f"{folder}/{p.format(s=split)}" for p in SPLIT_PATTERNS])


def qrels_files(spark: SparkSession, folder: str, suffix: str = "-qrels") -> list[str]:
    """Files of relevance judgements in the folder and in the one beside it with the suffix, sorted by name."""
    folder = folder.rstrip("/")
    return sorted(glob(spark, [*(f"{folder}/{p}" for p in QRELS_INSIDE), *(f"{folder}{suffix}/{p}" for p in QRELS_APART)]))


def cached_table(spark: SparkSession, folder: str, settings: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """A table made once for its settings: read if it was finished before, else made, written and read."""
    name = hashlib.sha1(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()
    path = f"{folder.rstrip('/')}/{name}"
    if not glob(spark, [f"{path}/_SUCCESS"]):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
