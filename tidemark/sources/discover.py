"""Which files there are."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

FILES = "file string, size long, modified timestamp"


def discover(spark: SparkSession, globs: list[str]) -> DataFrame:
    """``(file, size, modified)`` of all files that match, each once; contents are not read.

    ``**`` stands for one level of folders, as ``*`` does. Empty files count, folders do not. A pattern that nothing
    matches adds nothing. The listing comes from the file system's own glob, as Spark's would.
    """
    found = {}
    for pattern in globs:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern.replace("**", "*"))
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for s in fs.globStatus(path) or []:
            if not s.isDirectory():
                name = s.getPath().toString()
                found[name] = (name, s.getLen(), datetime.fromtimestamp(s.getModificationTime() / 1000, timezone.utc))
    return spark.createDataFrame(list(found.values()), FILES)
