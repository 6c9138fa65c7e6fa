import os
import pathlib
import re
import subprocess
import sys
import threading
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.config import Config
from tidemark.engine import PRUNING, Engine
from tidemark.operators.segments import assign_segments, incomplete_trailing, misaligned_files
from tidemark.sources.discover import discover
from tidemark.operators import ingest as ingest_module
from tidemark.operators.search import of_segments
from tidemark.operators.store import Conflict
from tidemark.sources import ranges
from tidemark.sources.scan import raw_body, rejected_files, scan_messages
from tidemark.streaming.tail import hits_by_time, standing_query, tail

from .samples import ENDS1, ENDS2, LAYOUT, LOG1, LOG2, START


@pytest.fixture
def logs(tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "store").mkdir()
    (tmp_path / "logs" / "1.log").write_text(LOG1)
    (tmp_path / "logs" / "2.log").write_text(LOG2)
    return tmp_path


def config(path, **more):
    return Config(files_glob_pattern=f"{path}/logs/*.log", storage_path=f"{path}/store", message_start_re=START, date_format=LAYOUT, **more)


def name(file):
    return os.path.basename(file)


def test_scan_positions(spark, logs):
    rows = scan_messages(spark, [f"{logs}/logs/1.log", f"{logs}/logs/2.log"], START, LAYOUT).orderBy("file", "pos_from").collect()
    for file, ends in (("1.log", ENDS1), ("2.log", ENDS2)):
        own = [r for r in rows if name(r.file) == file]
        assert [(r.pos_from, r.pos_to) for r in own] == list(zip(ends, ends[1:]))
        assert all((r.date_from, r.date_to) == (r.pos_from + 1, r.pos_from + 33) for r in own)
        assert [r.is_tail for r in own] == [False] * (len(own) - 1) + [True]
    assert rows[0].date.replace(tzinfo=timezone.utc) == datetime(2024, 7, 29, 0, 2, 49, 231231, tzinfo=timezone.utc)
    assert rows[0].body == "[] User login successful\nsrc: 127.0.0.1:5000\n"


@pytest.mark.parametrize("split", ["40b", "100b", "1g"])
def test_scan_across_splits(spark, tmp_path, split):
    """The same messages however files are cut, with bytes that are no text, other line ends and no last line end."""
    raw = b"\n\nno message\n" + "".join(f"[2024-07-29T00:00:{i:02}] ключ é {i}\r\nmore\n\n" for i in range(30)).encode() + b"[2024-07-29T01:00:00] \xff\xfe tail"
    (tmp_path / "a.log").write_bytes(raw)
    (tmp_path / "none.log").write_bytes(b"no message at all\n")
    (tmp_path / "empty.log").write_bytes(b"")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        rows = scan_messages(spark, [f"{tmp_path}/{n}.log" for n in ("a", "none", "empty")], r"^\[(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)\]", "2006-01-02T15:04:05").orderBy("pos_from").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    starts = [i for i in range(len(raw)) if raw[i : i + 5] == b"[2024"]
    assert [(r.pos_from, r.pos_to) for r in rows] == list(zip(starts, [*starts[1:], len(raw)]))
    for r in rows[:-1]:
        text = raw[r.pos_from : r.pos_to].decode()
        assert r.body == text.replace(r.date_text, "", 1) and raw[r.date_from : r.date_to].decode() == r.date_text


def test_start_in_the_middle_of_a_line(spark, tmp_path):
    (tmp_path / "a.log").write_text("x <1> é one <2> two\nthree <3>\n")
    rows = scan_messages(spark, [f"{tmp_path}/a.log"], r"<(\d)>").orderBy("pos_from").collect()
    assert [(r.pos_from, r.pos_to, r.date_text) for r in rows] == [(2, 13, "1"), (13, 27, "2"), (27, 31, "3")]
    assert [r.body for r in rows] == ["<> é one ", "<> two\nthree ", "<>\n"]


def test_many_messages(spark, tmp_path):
    (tmp_path / "a.log").write_text(LOG1 * 300)
    df = scan_messages(spark, [f"{tmp_path}/a.log"], START, LAYOUT)
    assert df.count() == 3000 and rejected_files(df).count() == 0
    whole = df.select("pos_from", raw_body(F.col("body"), F.col("date_text"), F.col("date_at")).alias("t")).orderBy("pos_from").collect()
    assert "\n" + "".join(r.t for r in whole) == LOG1 * 300


def test_discover(spark, logs):
    (logs / "logs" / "sub").mkdir()
    (logs / "logs" / "sub" / "x.txt").write_text("x")
    (logs / "logs" / "e.txt").write_text("")
    names = lambda *g: sorted((name(r.file), r["size"]) for r in discover(spark, [f"{logs}/logs/{x}" for x in g]).collect())
    assert names("*.txt") == [("e.txt", 0)] and names("**/*.txt") == [("x.txt", 1)]
    assert names("*.*", "*.txt") == [("1.log", 623), ("2.log", 764), ("e.txt", 0)] and names("nothing*") == []


LAYOUTS = "file string, pos_from long, pos_to long"


@pytest.mark.parametrize(
    "length,messages,want",
    [
        (50, [(0, 30), (30, 60), (60, 90)], [0, 0, 1]), (50, [(0, 90)], [0]), (50, [(0, 50), (50, 100)], [0, 1]), (100, [(0, 40), (60, 100)], [0, 1]), (100, [(0, 60), (50, 80)], [0, 1]),
        (10**9, [(i, i + 1) for i in range(50)], [0] * 50), (1, [(i, i + 1) for i in range(5)], [0, 1, 2, 3, 4]),
    ],
)
def test_segments(spark, length, messages, want):
    df = spark.createDataFrame([(f, a, b) for f in ("x", "y") for a, b in messages], LAYOUTS).repartition(3)
    for f in ("x", "y"):
        assert [r.segment_no for r in assign_segments(df, length).where(F.col("file") == f).orderBy("pos_from").collect()] == want


def test_misaligned_and_incomplete(spark):
    layouts = spark.createDataFrame([(f, a, b) for f in ("a", "b", "c") for a, b in ((0, 30), (30, 60), (60, 90))], LAYOUTS)
    segments = spark.createDataFrame([("a", 0, 60), ("a", 60, 90), ("b", 0, 55), ("c", 1, 60), ("d", 0, 10)], LAYOUTS).withColumn("segment_id", F.monotonically_increasing_id())
    assert sorted(r.file for r in misaligned_files(segments, layouts).collect()) == ["b", "c", "d"]
    files = spark.createDataFrame([("a", 90), ("b", 90), ("d", 100)], "file string, size long")
    assert sorted(r.file for r in incomplete_trailing(segments, files, 50).collect()) == ["d"]
    assert sorted(r.file for r in incomplete_trailing(segments, files, 60).collect()) == ["b", "d"]


GOLDEN = {"unknown": [], "Permission": [("1.log", 469)], "backup": [("1.log", 571), ("2.log", 646)], "~conn": [("1.log", 78), ("1.log", 235)], "@conn": [("1.log", 235)], "error config": [("1.log", 302)]}


def snapshot(engine):
    rows = engine.store.read("messages").orderBy("file", "pos_from").collect()
    return [(name(r.file), r.pos_from, r.pos_to) for r in rows]


ALL1, ALL2 = ([(f, a, b) for a, b in zip(e, e[1:])] for f, e in (("1.log", ENDS1), ("2.log", ENDS2)))


def test_ingest_search_and_results(spark, logs):
    engine = Engine(spark, config(logs, segment_length=150))
    assert engine.test_config().endswith("1.log")
    assert engine.ingest() == {"indexed": 2, "rejected": 0, "removed": 0, "unchanged": 0}
    assert snapshot(engine) == ALL1 + ALL2
    for pruning in PRUNING:
        for q, want in GOLDEN.items():
            assert [(name(r.file), r.pos_from) for r in engine.search(q, pruning=pruning).collect()] == want, q
    assert [r.text for r in engine.bodies(engine.search("Permission")).collect()] == ["[2024-07-30T04:25:27.789664+00:00] Permission denied\n"]
    one_day = engine.search("~.", "2024-07-30T00:00:00Z", "2024-07-30T23:59:59Z")
    assert one_day.count() == 7
    terms = sorted(map(tuple, engine.store.read("postings").collect()))
    engine.compact()
    assert sorted(map(tuple, engine.store.read("postings").collect())) == terms
    assert engine.ingest() == {"indexed": 0, "rejected": 0, "removed": 0, "unchanged": 2}  # nothing is read again

    first = engine.submit("backup")
    second = engine.submit("user", "2024-07-30T00:00:00Z", None, wait=False)
    engine.results.wait(second)
    said = engine.results.list().collect()
    assert [(r.query_id, r.messages, r.finished) for r in said] == [(second, 4, True), (first, 2, True)] or [r.query_id for r in said] == [second, first]
    assert [name(r.file) for r in engine.results.page(first).collect()] == ["1.log", "2.log"]
    assert [name(r.file) for r in engine.results.page(first, 1, 1000).collect()] == ["2.log"] and engine.results.page(first, 0, 1).count() == 1
    assert engine.results.page(99).count() == 0 and engine.results.list([first]).count() == 1
    engine.results.wipe(first)
    assert engine.results.page(first).count() == 0 and [r.query_id for r in engine.results.list().collect()] == [second]


@pytest.mark.parametrize("direct", [True, False])
def test_reconcile(spark, logs, monkeypatch, direct):
    if not direct:  # as if only Spark's readers reached the files
        monkeypatch.setattr(ingest_module, "opens", lambda file: False)
    engine = Engine(spark, config(logs, segment_length=200))
    engine.ingest()
    before = {r.segment_id for r in engine.store.read("segments").collect()}
    one, two = logs / "logs" / "1.log", logs / "logs" / "2.log"
    one.write_text(LOG1 + LOG1)  # grows
    assert engine.ingest() == {"indexed": 1, "rejected": 0, "removed": 0, "unchanged": 1}
    # the second copy begins with an empty line, which the last message of the first gets
    second = [("1.log", a + 623, b + 623) for _, a, b in ALL1]
    assert snapshot(engine) == [*ALL1[:-1], ("1.log", 571, 624), *second, *ALL2]
    assert len(before & {r.segment_id for r in engine.store.read("segments").collect()}) >= 3  # full segments stay
    assert engine.ingest()["indexed"] == 0
    one.write_text("changed\n" + LOG1)  # rewritten: boundaries moved
    engine.ingest()
    assert snapshot(engine) == [("1.log", a + 8, b + 8) for _, a, b in ALL1] + ALL2
    two.unlink()
    assert engine.ingest()["removed"] == 1 and {s[0] for s in snapshot(engine)} == {"1.log"}
    two.write_text(LOG2 + "[2024-99-31T00:02:49.231231+00:00] no date\n")
    assert engine.ingest()["rejected"] == 1 and {s[0] for s in snapshot(engine)} == {"1.log"}
    assert engine.ingest() == {"indexed": 0, "rejected": 0, "removed": 0, "unchanged": 2}
    two.write_text(LOG2)
    assert engine.ingest()["indexed"] == 1 and snapshot(engine)[-7:] == ALL2
    one.write_text("no start here\n")
    (logs / "logs" / "3.log").write_text("")
    assert engine.ingest() == {"indexed": 0, "rejected": 2, "removed": 0, "unchanged": 1} and snapshot(engine) == ALL2
    assert {name(r.file): r.reason for r in engine.store.read("rejects").collect()} == {"1.log": ingest_module.NO_START, "3.log": ingest_module.NO_START}
    one.write_text("no start here\n" + LOG1)
    assert engine.ingest()["indexed"] == 1 and snapshot(engine) == [("1.log", a + 14, b + 14) for _, a, b in ALL1] + ALL2
    assert [name(r.file) for r in engine.store.read("rejects").collect()] == ["3.log"]
    assert terms_of(engine) == terms_of(engine, fresh=f"{logs}/fresh")


def terms_of(engine, fresh=None):
    """The index as (term, file, messages' positions), of the engine or of one that reads everything anew."""
    if fresh:
        os.mkdir(fresh)
        other = Engine(engine.spark, Config(**{**engine.config.__dict__, "storage_path": fresh}))
        other.ingest()
        engine = other
    inside = engine.store.read("postings").join(engine.store.read("messages"), "segment_id")
    inside = inside.where(F.lower("body").contains(F.col("term")))
    return sorted({(r.term, name(r.file), r.pos_from) for r in inside.collect()})


def test_appends_read_and_write_only_what_is_new(spark, logs, monkeypatch):
    planned = []
    monkeypatch.setattr(ingest_module, "read_ranges", lambda spark, splits, *a: planned.append(splits) or ranges.read_ranges(spark, splits, *a))
    engine = Engine(spark, config(logs, segment_length=100))
    log = logs / "logs" / "1.log"
    log.write_text(LOG1 * 50)
    engine.ingest()
    ids = {r.segment_id for r in engine.store.read("segments").collect()}
    last = engine.store.read("segments").where("file LIKE '%1.log'").orderBy(F.desc("pos_to")).first()
    log.write_text(LOG1 * 50 + "more of the last message\n" + LOG1)
    assert engine.ingest()["indexed"] == 1
    (split,) = planned[-1]
    assert split.start == last.pos_from and split.end == split.size == 51 * 623 + 25
    new = engine.store.read_folders("messages", engine.store.manifest()["tables"]["messages"][-1:])
    assert new.count() <= 13 and new.agg(F.min("pos_from")).first()[0] == last.pos_from
    now = {r.segment_id for r in engine.store.read("segments").collect()}
    assert ids - now == {last.segment_id}
    assert terms_of(engine) == terms_of(engine, fresh=f"{logs}/fresh")
    got = [x for x in snapshot(engine) if x[0] == "1.log"]
    assert len(got) == 510 and all(a[2] == b[1] for a, b in zip(got, got[1:])) and got[-1][2] == split.size
    # of the same size, but written anew
    log.write_text((LOG1 * 51 + "more of the last message\n").replace("login", "LOGIN"))
    assert engine.ingest() == {"indexed": 1, "rejected": 0, "removed": 0, "unchanged": 1} and engine.search("@LOGIN").count() == 51
    engine.merge()
    engine.compact()
    before = snapshot(engine)
    ingest_module.rewritten(engine.store)
    assert snapshot(engine) == before and engine.store.manifest()["tables"]["dropped"] == [] and engine.search("@LOGIN").count() == 51


@pytest.mark.parametrize("direct", [True, False])
def test_only_the_last_message_of_a_file_that_grew_is_its_end(spark, logs, monkeypatch, direct):
    if not direct:
        monkeypatch.setattr(ingest_module, "opens", lambda file: False)
    engine = Engine(spark, config(logs, segment_length=50))  # every message but one fills a segment: the last one too
    engine.ingest()
    one, line = logs / "logs" / "1.log", "[2024-07-31T00:00:0{}.000000+00:00] more than fifty bytes\n".format
    ends = lambda: [r.pos_from for r in engine.store.read("messages").where("file LIKE '%1.log' AND is_tail").collect()]
    assert ends() == [571]
    kept = {r.segment_id for r in engine.store.read("segments").where("file LIKE '%1.log'").collect()}
    for k in range(2):
        one.write_text(one.read_text() + line(k))
        assert engine.ingest() == {"indexed": 1, "rejected": 0, "removed": 0, "unchanged": 1}
        assert ends() == [623 + k * len(line(k))]
    assert snapshot(engine) == [*ALL1, *[("1.log", 623 + k * len(line(k)), 623 + (k + 1) * len(line(k))) for k in range(2)], *ALL2]
    assert len(kept - {r.segment_id for r in engine.store.read("segments").collect()}) == 1  # the others stay
    assert terms_of(engine) == terms_of(engine, fresh=f"{logs}/fresh")


def test_a_crash_changes_nothing(spark, logs, monkeypatch):
    engine = Engine(spark, config(logs, segment_length=100))
    engine.ingest()
    before = snapshot(engine), terms_of(engine)
    (logs / "logs" / "1.log").write_text(LOG1 * 2)
    (logs / "logs" / "2.log").unlink()
    (logs / "logs" / "3.log").write_text("no start")
    write = engine.store.write
    for step in ("messages", "segments", "postings", "dropped", "files", "rejects", "commit"):
        with monkeypatch.context() as m:
            if step == "commit":
                m.setattr(engine.store, "write_text", lambda path, text: (_ for _ in ()).throw(KeyboardInterrupt()))
            else:
                m.setattr(engine.store, "write", lambda name, rows, step=step: (_ for _ in ()).throw(KeyboardInterrupt()) if name == step else write(name, rows))
            with pytest.raises(KeyboardInterrupt):
                engine.ingest()
        assert (snapshot(engine), terms_of(engine)) == before, step
    (logs / "store" / "manifests" / "99.json").write_text('{"version": 99, "tab')  # cut short
    assert snapshot(engine) == before[0]
    assert engine.ingest() == {"indexed": 1, "rejected": 1, "removed": 1, "unchanged": 0} and len(snapshot(engine)) == 20
    stale = engine.store.manifest()
    engine.compact()
    with pytest.raises(Conflict):
        engine.store.commit(stale)


def test_many_logs_are_few_files(spark, tmp_path):
    (tmp_path / "store").mkdir()
    (tmp_path / "logs").mkdir()
    for k in range(300):
        (tmp_path / "logs" / f"{k}.log").write_text(LOG1)
    engine = Engine(spark, config(tmp_path))
    assert engine.ingest()["indexed"] == 300 and engine.store.read("messages").count() == 3000
    assert sum(len([f for f in fs if f.endswith(".parquet")]) for _, _, fs in os.walk(tmp_path / "store")) < 40


def test_ranges_equal_a_plain_reading(tmp_path, monkeypatch):
    raw = b"\n\nno message\n" + "".join(f"[2024-07-29T00:00:{i:02}] ключ é {i}\r\nmore\n\n" for i in range(30)).encode() + b"[2024-07-29T01:00:00] \xff\xfe tail"
    (tmp_path / "x.log").write_bytes(raw)
    pattern = re.compile(rb"^\[(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)\]", re.M)
    starts = [i for i in range(len(raw)) if raw[i : i + 5] == b"[2024"]
    every = list(zip(starts, [*starts[1:], len(raw)]))
    for longest in (1, 3, 40, 1000):
        for read in (1, 5, 64, 4096):
            monkeypatch.setattr(ranges, "READ", read)
            for begin in (0, 13, 14, 40):
                got = [m for s in ranges.splits_of([(f"file:{tmp_path}/x.log", begin, len(raw))], 7, longest) for m in ranges.split_messages(s, pattern, 50)]
                want = [m for m in every if m[0] >= begin]
                assert [m[1:3] for m in got] == want and [m[7] for m in got] == [False] * (len(want) - 1) + [True]
                assert all(raw[m[3] : m[4]].decode() == m[5] for m in got)
                assert [m[9] for m in got] == sorted(m[9] for m in got) and got[0][9] >= 7
    with open(tmp_path / "x.log", "rb") as file:
        assert [i for i in range(len(raw)) if ranges.is_start(file, i, len(raw), pattern)] == starts and ranges.is_start(file, len(raw), len(raw), pattern)


def test_exact_pruning_loses_nothing(spark, logs):
    engine = Engine(spark, config(logs, segment_length=60))
    engine.ingest()
    for q in ("onnection", "'gin successful'", "'user login'", "'.test'", "'failed login attempts' OR backup", "!'user login' ~a", "'127.0.0.1:5000'", "'ser registration complete'", "nosuch", "' nosuchword '"):
        none = engine.search(q, pruning="none").collect()
        assert engine.search(q, pruning="exact").collect() == none, q
        assert set(engine.search(q).collect()) <= set(none)
    assert engine.search("onnection").count() == 0 < engine.search("onnection", pruning="exact").count()
    assert engine.kept_share("' nosuchword '", "exact") == 0 < engine.kept_share("backup") < 0.3 and engine.kept_share("~x") == 1


def test_segments_are_looked_up_in_the_scan(spark, logs):
    engine = Engine(spark, config(logs, segment_length=60))
    engine.ingest()
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = engine.search("permission")._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[[^\]]*(EqualTo|GreaterThanOrEqual)\(segment_id", plan)
    few = engine.store.read("segments").select("segment_id")
    assert of_segments(engine.store.read("messages"), few).count() == 17
    assert of_segments(engine.store.read("messages"), few.limit(0)).count() == 0


def test_results_appear_by_parts(spark, logs, monkeypatch):
    monkeypatch.setattr("tidemark.engine.REPORT_BYTES", 200)
    engine = Engine(spark, config(logs, segment_length=60))
    engine.ingest()
    seen = []
    describe = engine.results._describe
    monkeypatch.setattr(engine.results, "_describe", lambda *row: (describe(*row), seen.append((row[4], row[5], engine.results.page(row[0]).count()))))
    query = engine.submit("user OR error OR backup")
    assert len(seen) > 3 and [m for m, _, _ in seen] == sorted(m for m, _, _ in seen) and all(m == shown for m, _, shown in seen)
    assert [f for _, f, _ in seen] == [False] * (len(seen) - 1) + [True]
    assert engine.results.list([query]).first().messages == engine.search("user OR error OR backup").count() == engine.results.page(query).count()


def test_workers_get_the_package(tmp_path):
    """Started from another folder, with the package on the driver's path alone."""
    (tmp_path / "a.log").write_text(LOG1)
    code = f"""
import sys; sys.path.insert(0, {str(pathlib.Path(__file__).parent.parent)!r})
from pyspark.sql import SparkSession
from tidemark.operators.segments import assign_segments
from tidemark.plans.match import matches
from tidemark.qlang.parser import parse
from tidemark.sources.ranges import read_ranges, splits_of
from tidemark.sources.scan import scan_messages
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
a = scan_messages(spark, [{str(tmp_path / "a.log")!r}], {START!r})
b = read_ranges(spark, splits_of([({str(tmp_path / "a.log")!r}, 0, 623)]), {START!r})
print(a.count(), b.count(), assign_segments(b.select("file", "pos_from", "pos_to"), 100).count(), b.where(matches(parse("~u.*r"), b.body)).count())
"""
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert said.stdout.split() == ["10", "10", "10", "3"], said.stderr[-2000:]


def test_parallel_submissions_get_their_own_ids(spark, logs):
    engine = Engine(spark, config(logs))
    ids, lock = [], threading.Lock()

    def put():
        i = engine.results._new_id()
        with lock:
            ids.append(i)

    threads = [threading.Thread(target=put) for _ in range(100)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(set(ids)) == 100


def test_config(tmp_path, capsys):
    c = config(tmp_path, min_term_len=3)
    (tmp_path / "store").mkdir()
    assert Config.from_yaml(c.to_yaml()) == c == c.checked()
    assert Config.from_yaml("# x\nmin_term_len: 2 # two\nfiles_glob_pattern: './a''b'\n", max_term_len=9, date_format=None).max_term_len == 9
    for bad in ({"message_start_re": "("}, {"message_start_re": "x"}, {"date_format": ""}, {"storage_path": "/no/such"}, {"min_term_len": 9}, {"min_term_len": 0}):
        with pytest.raises(ValueError):
            Config(**{**c.__dict__, **bad}).checked()
    with pytest.raises(ValueError):
        Config.from_yaml("nope: 1")
    assert cli.main(["--config", "/none", "--min-term-len", "5", "gen"]) == 0 and "min_term_len: 5" in capsys.readouterr().out


def test_streams(spark, logs):
    engine = Engine(spark, config(logs, segment_length=200))
    query = tail(engine, "1 second", f"{logs}/check")
    try:
        for _ in range(60):
            if snapshot(engine):
                break
            query.awaitTermination(1)
    finally:
        query.stop()
    assert snapshot(engine) == ALL1 + ALL2
    rows = spark.createDataFrame([("a", datetime(2024, 1, 1, 0, 10), "Error x"), ("a", datetime(2024, 1, 1, 0, 50), "error y"), ("a", datetime(2024, 1, 1, 5), "error"), ("a", datetime(2024, 1, 1, 0, 1), "fine")], "file string, date timestamp, body string")
    rows.write.parquet(f"{logs}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{logs}/in")
    for df, table in ((standing_query(stream, "error"), "hits"), (hits_by_time(stream, "error"), "hours")):
        q = df.writeStream.format("memory").queryName(table).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("hits").count() == 3
    assert [(r.window_start.hour, r.messages) for r in spark.table("hours").collect()] == [(0, 2)]
