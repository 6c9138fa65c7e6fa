"""What Python code on the executors needs: this package, bounded Arrow batches, and a folder that all share."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch: some very long texts must not fill a worker's memory.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20
#: Bytes that one row group, which one task reads, may well have.
ROW_GROUP = 128 << 20
_shipped: set[str] = set()
_own: str | None = None


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches and sends the package's source to the executors, once an application.

    Called before a Python column is made: it takes along the sources that are known at that time.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        with tempfile.TemporaryDirectory() as at:
            sources = shutil.copytree(package, f"{at}/sources/{os.path.basename(package)}", ignore=shutil.ignore_patterns("__pycache__"))
            kept = tempfile.mkdtemp(prefix="tidemark-")
            spark.sparkContext.addPyFile(shutil.make_archive(f"{kept}/{os.path.basename(package)}", "zip", os.path.dirname(sources)))
        _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder if all tasks run in the driver's process (tests); a cluster's executors would
    not see each other's files there, so that is an error.
    """
    global _own
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="tidemark-")
    return _own


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def own_dir(spark: SparkSession, kind: str) -> str:
    """A new path below the shared folder; what is there is deleted when the interpreter ends."""

    def forget() -> None:
        try:
            delete(spark, path)
        except Exception:  # the session is gone: its owner cleans the folder
            pass

    path = f"{shared_dir(spark)}/tidemark-{kind}-{uuid.uuid4().hex}"
    atexit.register(forget)
    return path


def spread(df: DataFrame) -> DataFrame:
    """A table read from files, with work for every core if it is small.

    A file is often a single row group, which a single task reads. Where there are fewer files than cores and so few
    bytes that this may be the case, rows are dealt out before the work; a large table is left as it is.
    """
    context, files = df.sparkSession.sparkContext, df.inputFiles()
    cores, jvm = context.defaultParallelism, context._jvm
    if len(files) >= cores:
        return df
    size = 0
    for file in files:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        size += path.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return df.repartition(cores) if size < cores * ROW_GROUP else df
