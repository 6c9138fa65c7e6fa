"""Index building: brings the tables to what the files on disk hold now, reading only what is new.

A file is read from its first byte that no kept segment covers. Which segments of a file that grew may be kept is told by
reading the lines that they begin with: a message must still begin there. Its last segment is always read again, as the
message that ended the file now ends before another, or goes on. Files that executors cannot open by their path are
read by Spark's reader instead, whole, and their segments are compared with all their messages.
"""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.tokenize import MAX_TERM, MIN_TERM
from ..sources.discover import discover
from ..sources.ranges import opens, read_ranges, split_bytes, splits_of, still_starts
from ..sources.scan import scan_messages
from .postings import compact, postings
from .segments import SEGMENT_LENGTH, assign_segments, misaligned_files, segment_bounds
from .store import TABLES, Store

log = logging.getLogger("tidemark.ingest")

NO_START, NO_DATE = "no message start found", "a date cannot be read"


def plain(path: Column) -> Column:
    """One spelling for the paths that listings and scans give."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def changes(disk: DataFrame, known: DataFrame) -> DataFrame:
    """``(file, size, modified, before, state)`` of every file on disk or known, before its size when last read.

    ``state``: gone, new, same (size and time), grown, or rewritten: shorter, or as long but written since.
    """
    old = known.select("file", F.col("size").alias("before"), F.col("modified").alias("read_at"))
    same = (F.col("size") == F.col("before")) & F.col("modified").eqNullSafe(F.col("read_at"))
    state = F.when(F.col("size").isNull(), "gone").when(F.col("before").isNull(), "new").when(same, "same").when(F.col("size") > F.col("before"), "grown").otherwise("rewritten")
    return disk.join(old, "file", "full").select("file", "size", "modified", "before", state.alias("state"))


def kept_ends(segments: DataFrame, grown: DataFrame, start_re: str) -> DataFrame:
    """``(file, end, drop)`` of files that grew: up to where their segments are kept, and the last one's id, which is not.

    All but the last are kept if messages still begin where segments do; none (``end`` 0) where one does not, as the file
    has been written anew. The last one goes even if it is full: its last message is marked as the file's end.
    """
    own = segments.join(grown.select("file", "size"), "file").select("file", "segment_id", "pos_from", "pos_to", "size")
    probed = still_starts(own.sortWithinPartitions("file", "pos_from"), start_re)
    last = F.max_by(F.struct("segment_id", "pos_from"), "pos_to")
    by_file = probed.groupBy("file").agg(F.min(F.col("ok").cast("int")).alias("ok"), last.alias("l"))
    end = F.when(F.col("ok") == 0, 0).otherwise(F.col("l.pos_from"))
    return by_file.select("file", end.cast("long").alias("end"), F.when(F.col("ok") == 1, F.col("l.segment_id")).alias("drop"))


def ingest(
    spark: SparkSession, store: Store, globs: list[str], start_re: str, date_layout: str, segment_length: int = SEGMENT_LENGTH, shortest: int = MIN_TERM, longest: int = MAX_TERM
) -> dict[str, int]:
    """Reconciles the tables with the files; returns how many files were indexed, rejected, removed and left as they were.

    * Files that are gone lose their rows; files of the size and time that are indexed are not read.
    * A file that grew keeps the segments that still begin at messages, but for the last one; that and what follows is
      indexed. One whose segments do not, or that was written anew, is indexed from its beginning.
    * A file with a date that cannot be read, or without any message, is set aside, with all its messages and the reason,
      until it changes.

    The driver holds the listing of files and a few numbers of each that changed, as Spark's own readers do.
    """
    manifest = store.manifest()
    disk = discover(spark, globs).select(plain(F.col("file")).alias("file"), "size", F.unix_millis("modified").alias("modified"))
    rejects = store.read("rejects", manifest)
    known = store.read("files", manifest).unionByName(rejects.drop("reason"))
    seen = changes(disk, known).join(rejects.select("file", "reason"), "file", "left").collect()
    gone, same = ([r for r in seen if r.state == x] for x in ("gone", "same"))
    todo = sorted((r for r in seen if r.state not in ("gone", "same")), key=lambda r: r.file)
    counts = {"indexed": 0, "rejected": 0, "removed": len(gone), "unchanged": len(same)}
    if not todo and not gone:
        return counts
    segments = store.read("segments", manifest)
    grown = [r for r in todo if r.state == "grown" and r.reason is None]
    direct = {r.file for r in todo if opens(r.file)}
    start, drop = dict.fromkeys((r.file for r in todo), 0), []
    scanned = None
    if any(r.file in direct for r in grown):
        ends = kept_ends(segments, spark.createDataFrame([(r.file, r["size"]) for r in grown if r.file in direct], "file string, size long"), start_re).collect()
        start |= {r.file: r.end for r in ends}
        drop += [r["drop"] for r in ends if r["drop"] is not None]
    others = [r for r in todo if r.file not in direct]
    if others:
        scanned = _staged(store, scan_messages(spark, [r.file for r in others], start_re, date_layout, _staging(store)).withColumn("file", plain(F.col("file"))))
        ends = _kept_by_scan(spark, segments, scanned, [r for r in others if r in grown])
        start |= {r.file: r.end for r in ends}
        drop += [r["drop"] for r in ends if r["drop"] is not None]
    whole = [r.file for r in (*gone, *todo) if start.get(r.file, 0) == 0]  # whatever is known of these goes
    ranges = [(r.file, start[r.file], r["size"]) for r in todo if r.file in direct]
    splits = splits_of(ranges, manifest["next_segment"], split_bytes(spark, ranges))
    next_segment = max([manifest["next_segment"], *(s.first_segment + s.end - s.start for s in splits)])
    new = read_ranges(spark, splits, start_re, date_layout, segment_length)
    if scanned is not None:
        first = {}
        for r in others:
            first[r.file], next_segment = next_segment, next_segment + r["size"]
        new = new.unionByName(_numbered(spark, scanned, start, first, segment_length))
    written = store.write("messages", new)
    messages = store.read_folders("messages", [written])
    per_segment = segment_bounds(messages.withColumn("bad", F.col("date").isNull()), F.max("bad").alias("bad"))
    made = _staged(store, per_segment)
    per_file = {r.file: r.bad for r in made.groupBy("file").agg(F.max("bad").alias("bad")).collect()}  # a row for each file that was read
    reasons = {r.file: NO_DATE if per_file.get(r.file) else NO_START for r in todo if per_file.get(r.file, start[r.file] == 0)}
    bad = spark.createDataFrame([(f,) for f in sorted({*whole, *reasons})], "file string")
    dropped = segments.join(bad, "file", "left_semi").select("segment_id")
    dropped = dropped.unionByName(made.join(spark.createDataFrame([(f,) for f in sorted(reasons)], "file string"), "file", "left_semi").select("segment_id"))
    dropped = dropped.unionByName(spark.createDataFrame([(d,) for d in drop], "segment_id long")).distinct()
    good = made.join(spark.createDataFrame([(f,) for f in sorted(reasons)], "file string"), "file", "left_anti")
    now = {r.file: r for r in seen if r.state != "gone"}
    rejected = {r.file: r.reason for r in same if r.reason is not None} | reasons
    files = [(f, r["size"], r.modified) for f, r in sorted(now.items()) if f not in rejected]
    set_aside = [(f, now[f]["size"], now[f].modified, reason) for f, reason in sorted(rejected.items())]
    terms = postings(messages, F.col("body"), shortest, longest).sortWithinPartitions("term", "segment_id")
    add = {"messages": [written], "segments": [store.write("segments", good)], "postings": [store.write("postings", terms)]}
    known_before = {r.file for r in seen if r.before is not None}
    if drop or reasons or known_before & set(whole):
        add["dropped"] = [store.write("dropped", dropped)]
    replace = {"files": [store.write("files", spark.createDataFrame(files, TABLES["files"]).coalesce(1))]}
    replace["rejects"] = [store.write("rejects", spark.createDataFrame(set_aside, TABLES["rejects"]).coalesce(1))] if set_aside else []
    store.commit(manifest, add, replace, next_segment)
    store.clean()
    counts |= {"rejected": len(reasons), "indexed": len(todo) - len(reasons)}
    for f, reason in sorted(reasons.items()):
        log.warning("%s: %s", f, reason)
    log.info("ingest: %s", counts)
    return counts


def _staging(store: Store) -> str:
    """A folder that the next cleaning deletes."""
    return f"{store.root}/data/staged-{uuid.uuid4().hex}"


def _staged(store: Store, df: DataFrame) -> DataFrame:
    """A written copy of what is read more than once."""
    path = _staging(store)
    df.write.parquet(path)
    return store.spark.read.schema(df.schema).parquet(path)


def _kept_by_scan(spark: SparkSession, segments: DataFrame, scanned: DataFrame, grown: list) -> list:
    """The same as ``kept_ends``, by comparison with all messages of the files."""
    files = spark.createDataFrame([(r.file,) for r in grown], "file string")
    own = segments.join(files, "file", "left_semi")
    last = own.groupBy("file").agg(F.max_by(F.struct("segment_id", "pos_from"), "pos_to").alias("l"))
    body = own.join(last.select("file", F.col("l.segment_id").alias("segment_id")), ["file", "segment_id"], "left_anti")
    wrong = misaligned_files(body, scanned).select("file", F.lit(True).alias("wrong"))
    moved = last.select("file", F.col("l.pos_from").alias("pos_from")).join(scanned.select("file", "pos_from"), ["file", "pos_from"], "left_anti").select("file", F.lit(True).alias("moved"))
    ok = F.col("wrong").isNull() & F.col("moved").isNull()
    every = last.join(wrong, "file", "left").join(moved, "file", "left")
    return every.select("file", F.when(ok, F.col("l.pos_from")).otherwise(0).cast("long").alias("end"), F.when(ok, F.col("l.segment_id")).alias("drop")).collect()


def _numbered(spark: SparkSession, scanned: DataFrame, start: dict[str, int], first: dict[str, int], segment_length: int) -> DataFrame:
    """The scanned messages from where each file is to be read, with segment ids."""
    where = spark.createDataFrame([(f, start[f], n) for f, n in first.items()], "file string, _start long, _first long")
    new = scanned.join(F.broadcast(where), "file").where("pos_from >= _start")  # a row a file
    ends = assign_segments(new.select("file", "pos_from", "pos_to"), segment_length).select("file", "pos_from", "segment_no")
    out = new.join(ends, ["file", "pos_from"]).withColumn("segment_id", F.col("_first") + F.col("segment_no"))
    return out.drop("_start", "_first", "segment_no").orderBy("segment_id", "pos_from")


def compacted(store: Store, bytes_a_file: int = 128 << 20) -> dict:
    """Merges the postings and segments of all generations, sorted by term, and leaves out what was dropped."""
    manifest = store.manifest()
    terms, segments = store.read("postings", manifest), store.read("segments", manifest)
    partitions = max(1, -(-terms.count() * 16 // bytes_a_file))
    replace = {"postings": [store.write("postings", compact(terms, partitions))], "segments": [store.write("segments", segments.repartitionByRange(partitions, "segment_id").sortWithinPartitions("segment_id"))]}
    after = store.commit(manifest, replace=replace)
    store.clean()
    return after


def rewritten(store: Store) -> dict:
    """``compacted`` of all tables: messages of dropped segments leave the disk too."""
    manifest = compacted(store)
    messages = store.read("messages", manifest)
    after = store.commit(manifest, replace={"messages": [store.write("messages", messages.repartitionByRange("segment_id").sortWithinPartitions("segment_id", "pos_from"))], "dropped": []})
    store.clean()
    return after
