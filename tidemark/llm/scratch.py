"""Tables that cut a job's lineage, written below the cluster's shared folder.

A step that is read more than once (or that ends a round of an iteration) is written as Parquet to
``spark.checkpoint.dir`` and read back, so that a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..workers import shared_dir


class Scratch:
    """The tables of one operator call.

    ``cut`` writes and rereads a frame, ``drop`` deletes one that nothing reads any more. What the returned frame
    still reads stays until the interpreter ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: list[tuple[DataFrame, str]] = []  # frames are held, so that none is taken for another
        atexit.register(self._delete, self.root)

    def cut(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths.append((out, path))
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        for path in [path for df, path in self._paths if any(df is x for x in frames)]:
            self._delete(path)
        self._paths = [(df, path) for df, path in self._paths if not any(df is x for x in frames)]

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session is gone: its owner cleans the folder
            pass
