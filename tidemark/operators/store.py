"""The engine's tables: generations of Parquet folders below one root, and a manifest that says which ones count.

Every change writes new folders and then one manifest; it happens wholly or not at all, and readers keep what their
manifest names. Rows are never changed: a segment that goes is named in ``dropped``. How many files there are depends on
how much is written at a time, not on how many logs there are.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Schemas; ``modified`` is in milliseconds since the epoch. ``files`` and ``rejects`` are written anew with each generation; the others add up.
TABLES = {
    "files": "file string, size long, modified long",
    "rejects": "file string, size long, modified long, reason string",
    "segments": "file string, segment_id long, pos_from long, pos_to long, date_min timestamp, date_max timestamp, messages long",
    "messages": "file string, pos_from long, pos_to long, date_from long, date_to long, date_text string, date_at int, is_tail boolean, body string, segment_id long, date timestamp",
    "postings": "term string, segment_id long",
    "dropped": "segment_id long",
}
SNAPSHOTS = ("files", "rejects")
#: Of messages, bytes of a row group: a segment should not need much more than itself to be read.
ROW_GROUP = 32 << 20
EMPTY = {"version": 0, "next_segment": 0, "tables": {name: [] for name in TABLES}, "complete": True}


class Conflict(RuntimeError):
    """Another process has changed the tables since this one looked."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def create_exclusively(self, path: str) -> bool:
        """Whether this call made the (empty) file: of several at once only one does."""
        fs, p = self._fs(path)
        try:
            return fs.createNewFile(p)
        except Exception:
            if fs.exists(p):  # another call made it since it was looked for
                return False
            raise

    def read_text(self, path: str) -> str:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        """Fails if the file exists."""
        fs, p = self._fs(path)
        stream = fs.create(p, False)
        stream.write(bytearray(text.encode()))
        stream.close()

    def manifest(self) -> dict:
        """The newest manifest that was written to its end."""
        for version in sorted((int(n[:-5]) for n in self.names(f"{self.root}/manifests") if n.endswith(".json") and n[:-5].isdigit()), reverse=True):
            try:
                found = json.loads(self.read_text(f"{self.root}/manifests/{version}.json"))
            except ValueError:  # a process died while it wrote
                continue
            if found.get("complete"):
                return found
        return json.loads(json.dumps(EMPTY))

    def write(self, name: str, rows: DataFrame) -> str:
        """A new folder of a table's rows; they count once a manifest names it."""
        folder = f"data/{name}-{uuid.uuid4().hex}"
        columns = [c.split()[0] for c in TABLES[name].split(", ")]
        rows.select(*columns).write.option("parquet.block.size", ROW_GROUP).parquet(f"{self.root}/{folder}")
        return folder

    def read_folders(self, name: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*[f"{self.root}/{x}" for x in folders])

    def read(self, name: str, manifest: dict | None = None) -> DataFrame:
        """The rows that count: of segments that have not been dropped."""
        tables = (manifest or self.manifest())["tables"]
        rows = self.read_folders(name, tables[name])
        if name in (*SNAPSHOTS, "dropped") or not tables["dropped"]:
            return rows
        return rows.join(self.read_folders("dropped", tables["dropped"]), "segment_id", "left_anti").select(*rows.columns)

    def commit(self, before: dict, add: dict[str, list[str]] | None = None, replace: dict[str, list[str]] | None = None, next_segment: int | None = None) -> dict:
        """The manifest after ``before``, with folders added to some tables and in place of others'; ``Conflict`` if there is one already."""
        tables = {name: (replace or {}).get(name, folders + (add or {}).get(name, [])) for name, folders in before["tables"].items()}
        used = [int(n[:-5]) for n in self.names(f"{self.root}/manifests") if n.endswith(".json") and n[:-5].isdigit()]
        if before["version"] != self.manifest()["version"]:
            raise Conflict("the tables have been changed by another process")
        after = {"version": max([*used, before["version"]]) + 1, "next_segment": before["next_segment"] if next_segment is None else next_segment, "tables": tables, "complete": True}
        try:
            self.write_text(f"{self.root}/manifests/{after['version']}.json", json.dumps(after))
        except Exception as e:
            if self.exists(f"{self.root}/manifests/{after['version']}.json"):
                raise Conflict("the tables have been changed by another process") from e
            raise
        return after

    def clean(self, keep: int = 5) -> None:
        """Deletes folders and manifests that none of the ``keep`` newest manifests names: what readers may still read stays."""
        newest = sorted((int(n[:-5]) for n in self.names(f"{self.root}/manifests") if n.endswith(".json") and n[:-5].isdigit()), reverse=True)
        named: set[str] = set()
        for version in newest[:keep]:
            try:
                named |= {x for folders in json.loads(self.read_text(f"{self.root}/manifests/{version}.json"))["tables"].values() for x in folders}
            except ValueError:
                pass
        for name in self.names(f"{self.root}/data"):
            if f"data/{name}" not in named:
                self.delete(f"{self.root}/data/{name}")
        for version in newest[keep:]:
            self.delete(f"{self.root}/manifests/{version}.json")
