"""Cutting lineage through tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes up to which a table that grows with the data is broadcast.
MOST_ROWS, MOST_BYTES = 500_000, 32 << 20
_watched: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset (tests, one machine), a temporary one is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="rankloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def session_folder(spark: SparkSession) -> str:
    """The folder of this application below the shared one; it is removed when the application ends.

    The file system removes it, with the file systems of the JVM or on ``spark.stop()``, whichever comes first.
    """
    app = spark.sparkContext.applicationId
    path = f"{shared_folder(spark).rstrip('/')}/rankloom/{app}"
    if app not in _watched:
        _watched.add(app)
        p, fs = hadoop(spark, path)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _before_stop(spark, path)
    return path


def _before_stop(spark: SparkSession, path: str) -> None:
    """Let spark.stop(), and the end of the process, drop the folder first."""
    stop, context = spark.sparkContext.stop, spark.sparkContext

    def drop_and_stop() -> None:
        try:
            p, fs = hadoop(spark, path)
            fs.delete(p, True)
        except Exception:  # the JVM has gone already, and has dropped the folder itself
            pass
        _watched.discard(context.applicationId)
        context.stop = stop
        stop()

    context.stop = drop_and_stop


def hadoop(spark: SparkSession, path: str):
    """(path, file system) of the JVM."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop(spark: SparkSession, path: str) -> None:
    p, fs = hadoop(spark, path)
    fs.delete(p, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once as a Parquet table in the shared folder and return a scan of it.

    Later stages read the table instead of running df again, column by column, and the loss of an executor loses
    nothing of it.  The tables are removed when the application ends.
    """
    spark = df.sparkSession
    path = f"{session_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def rows_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table of one scale factor."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_or_shuffled(df: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """A broadcast hint if df, which is counted and measured, has at most most_rows rows and most_bytes bytes.

    Beyond that df goes back without a hint, and the same join runs by shuffle.
    """
    n, size = F.count(F.lit(1)), F.lit(0).cast("long")
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.sum(F.octet_length(F.col(f"`{f.name}`"))), F.lit(0)) + 16 * n
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            size = size + F.coalesce(F.sum(F.length(F.to_json(F.struct(F.col(f"`{f.name}`"))))), F.lit(0)) + 32 * n
        else:
            size = size + 8 * n
    rows, size = df.agg(n, size).first()
    return F.broadcast(df) if rows <= most_rows and size <= most_bytes else df
