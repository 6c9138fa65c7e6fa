"""The registered queries over the driver's tables, each with the SQL that it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .config import Config
from .engine import Engine
from .functions.dates import bound, from_micros, micros, parse_date
from .functions.tokenize import distinct_terms, query_terms, sure_terms, terms
from .operators import intervals as iv
from .operators.ingest import NO_START, changes
from .operators.postings import compact, document_frequency, postings, prefix_lookup, without_segments
from .operators.rank import ranked
from .operators.results import history, hits_page, page_count as pages_of
from .operators.search import date_range, histogram, page, search, summary
from .operators.segments import assign_segments, incomplete_trailing, misaligned_files, near_even, ranges_by_file, segment_bounds as bounds_of
from .plans.prune import candidates, full_scan
from .qlang.ast import digest
from .qlang.parser import parse
from .sources.adapters import table_messages
from .sources.discover import discover
from .sources.ranges import read_ranges, splits_of
from .sources.scan import scan_messages
from .streaming.tail import hits_by_time, standing_query
from .workers import delete, own_dir, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Messages of one segment in the queries over documents.
PER_SEGMENT = 50


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_messages(spark, sf_dir, "documents").withColumn("segment_id", F.floor(F.col("pos_from") / PER_SEGMENT))


def _lit(word: str, column: str = "text") -> str:
    return f"contains(lower(coalesce({column}, '')), '{word}')"


#: name: (query, condition in SQL) over documents
DOCUMENT_SEARCHES = {
    "lit_single": ("license", _lit("license")),
    "lit_case_insensitive": ("LICENSE", _lit("license")),
    "lit_substring": ("icens", _lit("icens")),
    "lit_quoted_phrase": ("'of the'", _lit("of the")),
    "lit_unicode": ("für", _lit("für")),
    "and_implicit": ("license the", f"{_lit('license')} AND {_lit('the')}"),
    "and_explicit": ("rights AND reserved", f"{_lit('rights')} AND {_lit('reserved')}"),
    "or_any": ("license OR reserved", f"{_lit('license')} OR {_lit('reserved')}"),
    "not_single": ("!the", f"NOT {_lit('the')}"),
    "not_not": ("!!license", _lit("license")),
    "not_group": ("!(the OR le)", f"NOT ({_lit('the')} OR {_lit('le')})"),
    "precedence_or_over_and": ("the license OR rights", f"{_lit('the')} AND ({_lit('license')} OR {_lit('rights')})"),
    "nested_groups": ("(license OR (rights AND reserved)) AND !(le OR die)", f"({_lit('license')} OR ({_lit('rights')} AND {_lit('reserved')})) AND NOT ({_lit('le')} OR {_lit('die')})"),
    "regex_ci": ("~LICEN[cs]E", "regexp_matches(text, '(?i)LICEN[cs]E')"),
    "regex_cs": ("@Licen[cs]e", "regexp_matches(text, 'Licen[cs]e')"),
    "regex_parens": ("~(all rights|license)", "regexp_matches(text, '(?i)(all rights|license)')"),
    "regex_line_end": (r"@[a-z]+\.$", r"regexp_matches(text, '[a-z]+\.$')"),
    "regex_word_edge": (r"~\bthe\b", r"regexp_matches(text, '(?i)\bthe\b')"),
    "regex_posix_class": (r"@[[:upper:]]{3}", "regexp_matches(text, '[[:upper:]]{3}')"),
    "regex_and_literal": ("~[0-9]{4} the", f"regexp_matches(text, '[0-9]{{4}}') AND {_lit('the')}"),
    "not_regex": ("!~[0-9]", "NOT regexp_matches(text, '[0-9]')"),
}


def _document_search(text: str) -> Query:
    return lambda spark, sf_dir: search(table_messages(spark, sf_dir, "documents"), text).select("file", "pos_from")


for _name, (_text, _sql) in DOCUMENT_SEARCHES.items():
    QUERIES[_name] = _document_search(_text)
    ORACLE[_name] = f"SELECT source AS file, doc_id AS pos_from FROM documents WHERE {_sql}"


@query(f"SELECT conv_id::VARCHAR AS file, turn AS pos_from FROM conversations WHERE {_lit('the')} AND NOT {_lit('and')}")
def search_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table_messages(spark, sf_dir, "conversations"), "the !'and'").select("file", "pos_from")


@query(f"SELECT url AS file, page_id AS pos_from FROM pages WHERE {_lit('<nav>', 'html')} AND regexp_matches(html, '(?i)href=./the.')")
def search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table_messages(spark, sf_dir, "pages"), "'<nav>' ~href=./the.").select("file", "pos_from")


EVENT_BODY = "event_type || ' user_' || user_id || ' ' || props"
LO, HI = "2024-01-05T00:00:00+00:00", "2024-01-12T12:30:00+00:00"
SQL_LO, SQL_HI = "TIMESTAMP '2024-01-05 00:00:00'", "TIMESTAMP '2024-01-12 12:30:00'"
_EVENTS = f"SELECT event_type AS file, event_id AS pos_from, ts AS date FROM events WHERE "


def _dates(lo: str | None, hi: str | None) -> Query:
    return lambda spark, sf_dir: date_range(table_messages(spark, sf_dir, "events"), bound(lo), bound(hi)).select("file", "pos_from", "date")


for _name, _lo, _hi, _sql in (
    ("date_range_closed", LO, HI, f"ts BETWEEN {SQL_LO} AND {SQL_HI}"),
    ("date_range_from", LO, None, f"ts >= {SQL_LO}"),
    ("date_range_to", None, HI, f"ts <= {SQL_HI}"),
):
    QUERIES[_name], ORACLE[_name] = _dates(_lo, _hi), _EVENTS + _sql


@query(_EVENTS + f"ts BETWEEN {SQL_LO} AND {SQL_HI} AND contains(lower({EVENT_BODY}), 'purchase') AND NOT contains(lower({EVENT_BODY}), 'user_1')")
def search_with_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table_messages(spark, sf_dir, "events"), "purchase !user_1", LO, HI).select("file", "pos_from", "date")


@query(f"SELECT * FROM ({_EVENTS} contains(lower({EVENT_BODY}), 'purchase') ORDER BY date, file, pos_from LIMIT 20 OFFSET 10)")
def ordered_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(search(table_messages(spark, sf_dir, "events"), "purchase", sort=False).select("file", "pos_from", "date"), 10, 20)


@query(f"SELECT * FROM ({_EVENTS} contains(lower({EVENT_BODY}), 'error') ORDER BY date, file, pos_from LIMIT 100)")
def first_page_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(search(table_messages(spark, sf_dir, "events"), "error", sort=False).select("file", "pos_from", "date"))


@query(f"SELECT count(*) AS messages, min(ts) AS date_min, max(ts) AS date_max FROM events WHERE contains(lower({EVENT_BODY}), 'click')")
def hits_min_max_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(search(table_messages(spark, sf_dir, "events"), "click", sort=False))


@query(f"SELECT count(*) AS messages FROM documents WHERE {_lit('the')}")
def count_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(search(table_messages(spark, sf_dir, "documents"), "the", sort=False)).select("messages")


@query(f"SELECT date_trunc('hour', ts) AS window_start, count(*) AS messages FROM events WHERE contains(lower({EVENT_BODY}), 'view') GROUP BY 1")
def hits_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = histogram(search(table_messages(spark, sf_dir, "events"), "view", sort=False))
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "messages")


_SPLIT = r"""'[ \r\n\t!()\-\[\]{};:`''"\\,<>./?@#$%^&*_~]+'"""


def _sql_terms(text: str = "text") -> str:
    return f"list_transform(list_filter(string_split_regex(lower({text}), {_SPLIT}), lambda x: length(x) >= 4), lambda x: substr(x, 1, 8))"


_POSTINGS = f"SELECT DISTINCT unnest({_sql_terms()}) AS term, doc_id // {PER_SEGMENT} AS segment_id FROM documents"


@query(f"SELECT doc_id, array_to_string({_sql_terms()}, ' ') AS terms FROM documents")
def tokenize_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "documents")).select("doc_id", F.array_join(terms(F.col("text")), " ").alias("terms"))


@query(f"SELECT doc_id, len(list_distinct({_sql_terms()}))::BIGINT AS n FROM documents")
def distinct_terms_per_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "documents")).select("doc_id", F.size(distinct_terms(F.col("text"))).cast("long").alias("n"))


@query(f"SELECT segment_id, count(*) AS n FROM ({_POSTINGS}) GROUP BY 1")
def distinct_terms_per_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(_documents(spark, sf_dir)).groupBy("segment_id").agg(F.count("*").alias("n"))


@query(f"SELECT term, count(*) AS messages FROM (SELECT DISTINCT doc_id, unnest({_sql_terms()}) AS term FROM documents) GROUP BY 1")
def term_doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_frequency(table_messages(spark, sf_dir, "documents"), F.col("body"))


@query(f"SELECT term, segment_id FROM ({_POSTINGS}) WHERE starts_with(term, 'lic')")
def prefix_lookup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_lookup(postings(_documents(spark, sf_dir)), "lic")


_kept: dict[tuple[str, str, str], object] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], object]):
    """What several queries share is made once an application and table folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings of documents as they are stored: sorted by term."""

    def make() -> str:
        path = own_dir(spark, "index")
        compact(postings(_documents(spark, sf_dir)), 4).write.parquet(path)
        return path

    return spark.read.parquet(_once(spark, sf_dir, "index", make))


def _candidates(text: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        messages = _documents(spark, sf_dir)
        found = candidates(_index(spark, sf_dir), parse(text), query_terms)
        return messages.select("segment_id").distinct() if found is None else found

    return run


_FLAGS = f"SELECT segment_id, bool_or(starts_with(term, 'license')) AS a, bool_or(starts_with(term, 'reserved')) AS b, bool_or(starts_with(term, 'rights')) AS c FROM ({_POSTINGS}) GROUP BY 1"
_ALL = f"SELECT DISTINCT doc_id // {PER_SEGMENT} AS segment_id FROM documents"
for _name, _text, _sql in (
    ("candidates_single", "license", f"SELECT segment_id FROM ({_FLAGS}) WHERE a"),
    ("candidates_and", "license reserved", f"SELECT segment_id FROM ({_FLAGS}) WHERE a AND b"),
    ("candidates_or", "license OR reserved", f"SELECT segment_id FROM ({_FLAGS}) WHERE a OR b"),
    ("candidates_multi_token", "'rights reserved'", f"SELECT segment_id FROM ({_FLAGS}) WHERE c AND b"),
    ("candidates_and_not", "license !reserved", f"SELECT segment_id FROM ({_FLAGS}) WHERE a"),
    ("candidates_not_is_all", "!license", _ALL),
    ("candidates_regex_is_all", "~license OR reserved", _ALL),
    ("candidates_none", "nosuchterm", f"SELECT segment_id FROM ({_FLAGS}) WHERE false"),
    ("short_term_fullscan", "the", _ALL),
):
    QUERIES[_name], ORACLE[_name] = _candidates(_text), _sql


@query(f"SELECT source AS file, doc_id AS pos_from FROM documents WHERE {_lit('rights')} AND {_lit('reserved')} AND doc_id // {PER_SEGMENT} IN (SELECT segment_id FROM ({_FLAGS}) WHERE c AND b)")
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_documents(spark, sf_dir), "rights reserved", index=_index(spark, sf_dir)).select("file", "pos_from")


@query(f"SELECT source AS file, doc_id AS pos_from FROM documents WHERE {_lit('ights reserved')}")
def indexed_search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A literal that begins amid a term: of its terms only the others are looked up."""
    segments = candidates(_index(spark, sf_dir), parse("'ights reserved'"), sure_terms)
    return search(_documents(spark, sf_dir), "'ights reserved'", segments=segments).select("file", "pos_from")


@query(f"SELECT term, segment_id FROM ({_POSTINGS}) WHERE segment_id NOT IN (SELECT doc_id // {PER_SEGMENT} FROM documents WHERE {_lit('license')})")
def postings_without_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_segments(_index(spark, sf_dir), search(_documents(spark, sf_dir), "license", sort=False))


_SPANS = "SELECT source AS file, doc_id, strlen(text) AS n, sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id) AS pos_to FROM documents"
SEGMENT_LENGTH = 20_000


def _layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source as messages of a file, one behind the other."""
    n = F.octet_length("text").cast("long")
    end = F.sum(n).over(Window.partitionBy("source").orderBy("doc_id"))
    return _table(spark, sf_dir, "documents").select(F.col("source").alias("file"), "doc_id", (end - n).alias("pos_from"), end.alias("pos_to"))


@query(
    f"""WITH RECURSIVE m AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY doc_id) AS k FROM ({_SPANS})),
w(file, k, doc_id, filled, segment_no) AS (
  SELECT file, k, doc_id, n, 0::BIGINT FROM m WHERE k = 1
  UNION ALL
  SELECT m.file, m.k, m.doc_id, CASE WHEN w.filled >= {SEGMENT_LENGTH} THEN m.n ELSE w.filled + m.n END, w.segment_no + (w.filled >= {SEGMENT_LENGTH})::INT
  FROM w JOIN m ON m.file = w.file AND m.k = w.k + 1)
SELECT file, doc_id, segment_no::BIGINT AS segment_no FROM w"""
)
def segment_assign_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_segments(_layouts(spark, sf_dir), SEGMENT_LENGTH).select("file", "doc_id", "segment_no")


@query(f"SELECT file, doc_id // 100 AS segment_id, min(pos_to - n)::BIGINT AS pos_from, max(pos_to)::BIGINT AS pos_to, count(*) AS messages FROM ({_SPANS}) GROUP BY 1, 2")
def segment_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _layouts(spark, sf_dir).withColumn("segment_id", F.floor(F.col("doc_id") / 100)).withColumn("date", F.lit(None).cast("timestamp"))
    return bounds_of(parts).drop("date_min", "date_max")


_SEGMENTS = f"SELECT file, doc_id // 100 AS segment_id, min(pos_to - n)::BIGINT AS pos_from, max(pos_to)::BIGINT AS pos_to FROM ({_SPANS}) GROUP BY 1, 2"


@query(f"SELECT DISTINCT s.file FROM ({_SEGMENTS}) s WHERE s.file = 'src3' AND NOT EXISTS (SELECT 1 FROM ({_SPANS}) m WHERE m.file = s.file AND m.pos_to - m.n = s.pos_from + 1)")
def misaligned_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    shift = F.when(F.col("file") == "src3", 1).otherwise(0)
    segments = QUERIES["segment_bounds"](spark, sf_dir).select("file", "segment_id", (F.col("pos_from") + shift).alias("pos_from"), "pos_to")
    return misaligned_files(segments, _layouts(spark, sf_dir))


@query(f"SELECT file, arg_max(segment_id, pos_to)::BIGINT AS segment_id FROM ({_SEGMENTS}) GROUP BY file HAVING max(pos_to) - arg_max(pos_from, pos_to) < 5000")
def incomplete_trailing_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = QUERIES["segment_bounds"](spark, sf_dir)
    return incomplete_trailing(segments, segments.groupBy("file").agg((F.max("pos_to") + 1).alias("size")), 5000)


_RANGES = "SELECT l_orderkey AS k, (l_partkey % 1000)::BIGINT AS pos_from, (l_partkey % 1000 + l_quantity * 4)::BIGINT AS pos_to FROM lineitem"


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_partkey") % 1000
    return _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), start.alias("pos_from"), (start + F.col("l_quantity") * 4).cast("long").alias("pos_to"))


_MERGED = f"""SELECT k, min(pos_from) AS pos_from, max(pos_to) AS pos_to FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY pos_from, pos_to ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN pos_from <= max(pos_to) OVER (PARTITION BY k ORDER BY pos_from, pos_to ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh
    FROM ({_RANGES}))) GROUP BY k, island"""


@query(_MERGED)
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.merge_rows(_ranges(spark, sf_dir), ["k"])


@query(_MERGED)
def interval_merge_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = _ranges(spark, sf_dir).groupBy("k").agg(iv.merge(F.collect_list(iv.location(F.col("pos_from"), F.col("pos_to")))).alias("m"))
    return merged.select("k", F.explode("m").alias("m")).select("k", "m.pos_from", "m.pos_to")


_GAPS = f"""WITH m AS ({_MERGED}),
g AS (SELECT k, pos_to AS pos_from, lead(pos_from, 1, 1200) OVER (PARTITION BY k ORDER BY pos_from) AS pos_to FROM m
      UNION ALL SELECT k, 0, min(pos_from) FROM m GROUP BY k)
SELECT k, pos_from, pos_to FROM g WHERE pos_to > pos_from"""


@query(_GAPS)
def interval_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = _ranges(spark, sf_dir)
    whole = ranges.select("k").distinct().select("k", F.lit(0).cast("long").alias("pos_from"), F.lit(1200).cast("long").alias("pos_to"))
    return iv.difference_rows(whole, ranges, ["k"])


@query(_GAPS)
def interval_exclude_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_key = _ranges(spark, sf_dir).groupBy("k").agg(F.collect_list(iv.location(F.col("pos_from"), F.col("pos_to"))).alias("r"))
    left = by_key.select("k", F.explode(iv.exclude(iv.location(F.lit(0), F.lit(1200)), F.col("r"))).alias("x"))
    return left.select("k", "x.pos_from", "x.pos_to")


@query(f"SELECT k, unnest(range(pos_from, pos_to, 30)) AS pos_from, least(unnest(range(pos_from, pos_to, 30)) + 30, pos_to) AS pos_to FROM ({_RANGES})")
def interval_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = _ranges(spark, sf_dir).select("k", F.explode(iv.split(iv.location(F.col("pos_from"), F.col("pos_to")), 30)).alias("x"))
    return pieces.select("k", "x.pos_from", "x.pos_to")


@query(
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos_from, pos_to) AS i FROM ({_RANGES}))
SELECT a.k, a.i AS i, b.i AS j, a.pos_from <= b.pos_to AND a.pos_to >= b.pos_from AS intersects, a.pos_from < b.pos_to AND a.pos_to > b.pos_from AS overlaps,
  a.pos_from <= b.pos_from AND b.pos_from < a.pos_to AS contains FROM r a JOIN r b ON a.k = b.k AND b.i = a.i + 1"""
)
def interval_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _ranges(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("pos_from", "pos_to")).cast("long"))
    a = r.select("k", "i", iv.location(F.col("pos_from"), F.col("pos_to")).alias("a"))
    b = r.select("k", F.col("i").alias("j"), (F.col("i") - 1).alias("i"), iv.location(F.col("pos_from"), F.col("pos_to")).alias("b"))
    x, y = F.col("a"), F.col("b")
    return a.join(b, ["k", "i"]).select("k", "i", "j", iv.intersects(x, y).alias("intersects"), iv.overlaps(x, y).alias("overlaps"), iv.contains(x, y["pos_from"]).alias("contains"))


@query(f"SELECT k, coalesce(min(pos_from), 0)::BIGINT AS pos_from, coalesce(arg_min(least(500 + 40, pos_to), pos_from), 0)::BIGINT AS pos_to FROM (SELECT k, CASE WHEN pos_from <= 500 AND 500 < pos_to THEN 500 END AS pos_from, pos_to FROM ({_MERGED})) GROUP BY k")
def interval_pick_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_key = _ranges(spark, sf_dir).groupBy("k").agg(iv.merge(F.collect_list(iv.location(F.col("pos_from"), F.col("pos_to")))).alias("m"))
    picked = by_key.select("k", iv.pick_next(F.col("m"), F.lit(500).cast("long"), 40).alias("p"))
    return picked.select("k", "p.pos_from", "p.pos_to")


@query(f"SELECT e.event_id FROM events e WHERE EXISTS (SELECT 1 FROM ({_RANGES}) r WHERE r.k = e.user_id AND e.event_id % 1000 >= r.pos_from AND e.event_id % 1000 < r.pos_to)")
def range_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("k"), (F.col("event_id") % 1000).alias("pos_from"))
    return iv.within(rows, _ranges(spark, sf_dir), ["k"]).select("event_id")


@query(f"SELECT k, pos_from, pos_to, pos_to - pos_from AS length FROM ({_RANGES})")
def interval_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _ranges(spark, sf_dir).select("k", iv.checked_location(F.col("pos_from"), F.col("pos_to")).alias("x"))
    return made.select("k", "x.pos_from", "x.pos_to", iv.length(F.col("x")).alias("length"))


@query("""WITH d AS (SELECT source AS file, count(*) FILTER (doc_id % 3 > 0) AS size, count(*) FILTER (doc_id % 2 > 0 OR doc_id < 500) AS before FROM documents GROUP BY 1),
disk AS (SELECT file, size FROM d WHERE file <> 'src1'), known AS (SELECT file, before FROM d WHERE file <> 'src2')
SELECT file, CASE WHEN size IS NULL THEN 'gone' WHEN before IS NULL THEN 'new' WHEN size = before THEN 'same' WHEN size > before THEN 'grown' ELSE 'rewritten' END AS state
FROM disk FULL JOIN known USING (file)""")
def file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").groupBy(F.col("source").alias("file"))
    sized = docs.agg(F.count_if(F.expr("doc_id % 3 > 0")).alias("size"), F.count_if(F.expr("doc_id % 2 > 0 OR doc_id < 500")).alias("before"), F.lit(None).cast("timestamp").alias("modified"))
    known = sized.where("file <> 'src2'").select("file", F.col("before").alias("size"), "modified")
    return changes(sized.where("file <> 'src1'").select("file", "size", "modified"), known).select("file", "state")


_A, _B = (f"SELECT DISTINCT segment_id FROM ({_POSTINGS}) WHERE starts_with(term, '{t}')" for t in ("license", "reserved"))
for _name, _op in (("set_union", "UNION"), ("set_intersect", "INTERSECT"), ("set_difference", "EXCEPT")):

    def _sets(spark: SparkSession, sf_dir: str, op: str = _op) -> DataFrame:
        index = _index(spark, sf_dir)
        a, b = (prefix_lookup(index, t).select("segment_id").distinct() for t in ("license", "reserved"))
        return {"UNION": lambda: a.union(b).distinct(), "INTERSECT": lambda: a.intersect(b), "EXCEPT": lambda: a.subtract(b)}[op]()

    QUERIES[_name], ORACLE[_name] = _sets, f"{_A} {_op} {_B}"


@query(f"SELECT file, count(*) AS ranges, sum(n)::BIGINT AS covered, max(pos_to)::BIGINT AS last FROM ({_SPANS}) GROUP BY 1")
def locations_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = ranges_by_file(_layouts(spark, sf_dir))
    covered = F.aggregate("ranges", F.lit(0).cast("long"), lambda a, x: a + iv.length(x))
    return grouped.select("file", F.size("ranges").cast("long").alias("ranges"), covered.alias("covered"), F.element_at("ranges", -1)["pos_to"].alias("last"))


@query("SELECT event_id AS query_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS nth FROM events")
def history_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as submitted queries: all of them, with their place in the history."""
    queries = _table(spark, sf_dir, "events").select(F.col("event_id").alias("query_id"), F.col("ts").alias("built_at"))
    return ranked(history(queries), [F.desc("built_at"), F.desc("query_id")]).select("query_id", "nth")


@query("SELECT event_type AS query_id, ceil(count(*) / 100.0)::BIGINT AS pages FROM events GROUP BY 1")
def page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_of(_table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("query_id")).agg(F.count("*").alias("messages")), 100)


@query("SELECT o_orderkey, ntile(7) OVER (ORDER BY o_orderkey) AS chunk FROM orders")
def near_even_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_even(_table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 7)


@query(f"SELECT event_type AS file, event_id AS pos, ts AS date FROM events WHERE contains(lower({EVENT_BODY}), 'purchase') ORDER BY ts, event_type, event_id LIMIT 30 OFFSET 40")
def results_page_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table_messages(spark, sf_dir, "events"), "purchase", sort=False)
    return hits_page(found.select("file", F.col("pos_from").alias("pos"), "date"), 40, 30)


@query("SELECT event_id, epoch_us(ts) AS us, make_timestamp(epoch_us(ts)) AS back FROM events")
def micros_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = micros(F.col("ts"))
    return _table(spark, sf_dir, "events").select("event_id", us.alias("us"), from_micros(us).cast("timestamp_ntz").alias("back"))


@query("SELECT event_id, date_trunc('second', ts) AS parsed FROM events")
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss")
    parsed = parse_date(F.concat(text, F.lit(" +0000")), "02/Jan/2006:15:04:05 -0700")
    return _table(spark, sf_dir, "events").select("event_id", parsed.cast("timestamp_ntz").alias("parsed"))


# Documents as logs: a file for each source, a message for each document, in order of their ids.

START = r"^\[(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)\] "
LAYOUT = "2006-01-02T15:04:05"
_DATE = "TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 SECOND"
_LINE = f"'[' || strftime({_DATE}, '%Y-%m-%dT%H:%M:%S') || '] ' || doc_id || ' ' || coalesce(text, '') || chr(10)"
_BODY = "'[] ' || doc_id || ' ' || coalesce(text, '') || chr(10)"


def _log_sql(where: str = "true") -> str:
    """``(source, doc_id, line, body, date, pos_from, pos_to, is_tail)`` of the documents' messages."""
    return f"""SELECT *, pos_to - strlen(line) AS pos_from FROM (
  SELECT source, doc_id, {_LINE} AS line, {_BODY} AS body, {_DATE} AS date, (sum(strlen({_LINE})) OVER w)::BIGINT AS pos_to, lead(doc_id) OVER w IS NULL AS is_tail
  FROM documents WHERE {where} WINDOW w AS (PARTITION BY source ORDER BY doc_id))"""


def _write_logs(spark: SparkSession, docs: DataFrame, folder: str) -> None:
    """Writes ``folder/SOURCE.log`` for every source; a file that is there is written anew."""
    stamp = F.date_format(F.expr("timestampadd(SECOND, doc_id, TIMESTAMP_NTZ'2024-01-01')"), "yyyy-MM-dd'T'HH:mm:ss")
    line = F.concat(F.lit("["), stamp, F.lit("] "), F.col("doc_id").cast("string"), F.lit(" "), F.coalesce("text", F.lit("")))
    at = own_dir(spark, "text")
    docs.repartition("source").sortWithinPartitions("source", "doc_id").select("source", line.alias("value")).write.partitionBy("source").text(at)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    for made in fs.globStatus(path(f"{at}/source=*/part-*")):
        to = path(f"{folder}/{made.getPath().getParent().getName().partition('=')[2]}.log")
        fs.delete(to, False)
        fs.rename(made.getPath(), to)
    delete(spark, at)


def _engine(spark: SparkSession, folder: str) -> Engine:
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/store")
    fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(fs_path)
    store = f"{folder}/store" if "://" in folder or ":" not in folder else f"file://{folder.partition(':')[2]}/store"
    return Engine(spark, Config(f"{folder}/logs/*.log", store, START, LAYOUT, segment_length=20_000))


def _logs(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine that has indexed the documents' logs."""

    def make() -> Engine:
        folder = own_dir(spark, "logs")
        _write_logs(spark, _table(spark, sf_dir, "documents"), f"{folder}/logs")
        engine = _engine(spark, folder)
        engine.ingest()
        return engine

    return _once(spark, sf_dir, "logs", make)


def _named(rows: DataFrame, body: str = "body") -> DataFrame:
    """``rows`` with the source and id of the document that a message is of."""
    source = F.regexp_extract("file", r"([^/]+)\.log$", 1)
    return rows.withColumn("source", source).withColumn("doc_id", F.regexp_extract(body, r"^\[[^\]]*\] (-?\d+) ", 1).cast("long"))


def _files(engine: Engine) -> list:
    return sorted((r.file, r["size"]) for r in discover(engine.spark, engine.globs).collect())


def _positions(messages: DataFrame) -> DataFrame:
    return _named(messages).select("source", "doc_id", "pos_from", "pos_to", "is_tail", F.col("date").cast("timestamp_ntz").alias("date"), F.md5(F.col("body").cast("binary")).alias("body"))


_POSITIONS = f"SELECT source, doc_id, pos_from, pos_to, is_tail, date, md5(body) AS body FROM ({_log_sql()})"


@query(_POSITIONS)
def log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positions(scan_messages(spark, [f for f, _ in _files(_logs(spark, sf_dir))], START, LAYOUT))


@query(_POSITIONS)
def log_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by byte ranges, in splits that cut messages."""
    return _positions(read_ranges(spark, splits_of([(f, 0, n) for f, n in _files(_logs(spark, sf_dir))], 0, 100_000), START, LAYOUT))


@query(f"SELECT source, sum(strlen(line))::BIGINT AS size, count(*) AS messages FROM ({_log_sql()}) GROUP BY 1")
def discover_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _logs(spark, sf_dir)
    counted = read_ranges(spark, splits_of([(f, 0, n) for f, n in _files(engine)]), START).groupBy("file").agg(F.count("*").alias("messages"))
    listed = discover(spark, engine.globs).select(F.regexp_replace("file", "^file:/+", "file:/").alias("file"), "size")
    counted = counted.withColumn("file", F.regexp_replace("file", "^file:/+", "file:/"))
    return listed.join(counted, "file").select(F.regexp_extract("file", r"([^/]+)\.log$", 1).alias("source"), "size", "messages")


@query(f"SELECT doc_id, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS next_id, is_tail FROM ({_log_sql()})")
def message_end_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message ends where the next one of its file begins; the last one at the file's end."""
    own = _named(_logs(spark, sf_dir).store.read("messages"))
    nxt = own.select("file", F.col("pos_from").alias("pos_to"), F.col("doc_id").alias("next_id"))
    return own.join(nxt, ["file", "pos_to"], "left").select("doc_id", "next_id", "is_tail")


@query(_POSITIONS)
def ingest_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positions(_logs(spark, sf_dir).store.read("messages"))


@query(f"SELECT source, min(pos_from) AS pos_from, max(pos_to) AS pos_to, sum(strlen(line))::BIGINT AS covered, count(*) AS messages, min(date) AS date_min, max(date) AS date_max FROM ({_log_sql()}) GROUP BY 1")
def ingest_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of a file cover it without gaps, whatever their number."""
    s = _logs(spark, sf_dir).store.read("segments").withColumn("source", F.regexp_extract("file", r"([^/]+)\.log$", 1))
    dates = [F.min("date_min").cast("timestamp_ntz").alias("date_min"), F.max("date_max").cast("timestamp_ntz").alias("date_max")]
    return s.groupBy("source").agg(F.min("pos_from").alias("pos_from"), F.max("pos_to").alias("pos_to"), F.sum(F.col("pos_to") - F.col("pos_from")).alias("covered"), F.sum("messages").alias("messages"), *dates)


_LOG_TERMS = f"SELECT DISTINCT unnest({_sql_terms('body')}) AS term, source FROM ({_log_sql()})"


def _terms_by_source(engine: Engine) -> DataFrame:
    named = engine.store.read("segments").select("segment_id", F.regexp_extract("file", r"([^/]+)\.log$", 1).alias("source"))
    return engine.store.read("postings").join(named, "segment_id").select("term", "source").distinct()


@query(_LOG_TERMS)
def ingest_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms_by_source(_logs(spark, sf_dir))


_HALF = "(doc_id < 300 OR doc_id % 5 = 0)"


def _reconciled(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine that has seen its logs grow, one of them vanish, one appear and one be written anew; merged afterwards."""

    def make() -> Engine:
        folder, docs = own_dir(spark, "logs"), _table(spark, sf_dir, "documents")
        _write_logs(spark, docs.where("source <> 'src3' AND doc_id < 300"), f"{folder}/logs")
        engine = _engine(spark, folder)
        engine.ingest()
        store = engine.store
        store.delete(f"{folder}/logs/src2.log")
        _write_logs(spark, docs.where(f"source <> 'src2' AND (doc_id < 300 OR {_HALF} OR source <> 'src1') AND (source <> 'src4' OR doc_id % 2 = 0)"), f"{folder}/logs")
        store.write_text(f"{folder}/logs/nothing.log", "a line without a start\n")
        engine.ingest()
        engine.compact()
        return engine

    return _once(spark, sf_dir, "reconciled", make)


_NOW = f"source <> 'src2' AND (doc_id < 300 OR {_HALF} OR source <> 'src1') AND (source <> 'src4' OR doc_id % 2 = 0)"


@query(f"SELECT source, doc_id, pos_from, pos_to, is_tail, date, md5(body) AS body FROM ({_log_sql(_NOW)})")
def ingest_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positions(_reconciled(spark, sf_dir).store.read("messages"))


@query(f"SELECT DISTINCT unnest({_sql_terms('body')}) AS term, source FROM ({_log_sql(_NOW)})")
def compacted_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms_by_source(_reconciled(spark, sf_dir))


@query(f"SELECT 'nothing' AS source, '{NO_START}' AS reason")
def rejected_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reconciled(spark, sf_dir).store.read("rejects").select(F.regexp_extract("file", r"([^/]+)\.log$", 1).alias("source"), "reason")


@query(f"SELECT source, doc_id, pos_from, date FROM ({_log_sql()}) WHERE contains(lower(body), 'license') AND NOT contains(lower(body), 'reserved')")
def log_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _logs(spark, sf_dir).search("license !reserved")
    return _named(found).select("source", "doc_id", "pos_from", F.col("date").cast("timestamp_ntz").alias("date"))


@query(f"SELECT source, doc_id, pos_from FROM ({_log_sql()}) WHERE contains(lower(body), 'icens') AND regexp_matches(body, '(?i)[a-z]+s\\b') AND date BETWEEN TIMESTAMP '2024-01-01 00:01:00' AND TIMESTAMP '2024-01-01 00:15:00'")
def log_search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _logs(spark, sf_dir).search(r"icens ~[a-z]+s\b", "2024-01-01T00:01:00Z", "2024-01-01T00:15:00Z", pruning="exact")
    return _named(found).select("source", "doc_id", "pos_from")


@query(f"SELECT doc_id, md5(line) AS text FROM ({_log_sql()}) WHERE contains(lower(body), 'reserved')")
def log_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits as they are in the file, dates included."""
    engine = _logs(spark, sf_dir)
    return _named(engine.bodies(engine.search("reserved")), "text").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text"))


def _submitted(spark: SparkSession, sf_dir: str) -> tuple[Engine, list[int]]:
    engine = _logs(spark, sf_dir)
    return engine, _once(spark, sf_dir, "submitted", lambda: [engine.submit(q) for q in ("license", "reserved", "nosuchterm")])


@query(f"SELECT 'license' AS query, source, pos_from AS pos, pos_to - pos_from AS len, date FROM ({_log_sql()}) WHERE contains(lower(body), 'license')")
def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query's metadata with all its hits."""
    engine, ids = _submitted(spark, sf_dir)
    hits = engine.results.page(ids[0], 0, 2**31 - 1).withColumn("query_id", F.lit(ids[0]))
    rows = engine.results.list(ids[:1]).select("query_id", F.col("text").alias("query")).join(hits, "query_id")
    return rows.select("query", F.regexp_extract("file", r"([^/]+)\.log$", 1).alias("source"), "pos", "len", F.col("date").cast("timestamp_ntz").alias("date"))


@query(f"SELECT q AS query, true AS finished, (SELECT count(*) FROM documents WHERE contains(lower(coalesce(text, '')), q)) AS messages FROM (VALUES ('license'), ('reserved'), ('nosuchterm')) t(q)")
def stored_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, ids = _submitted(spark, sf_dir)
    return engine.results.list(ids).select(F.col("text").alias("query"), "finished", "messages")


@query(f"SELECT 'rights' AS query, count(*) AS hits FROM documents WHERE {_lit('rights')}")
def wiped_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _logs(spark, sf_dir)
    gone, left = engine.submit("license"), engine.submit("rights")
    engine.results.wipe(gone)
    listed = engine.results.list([gone, left]).select(F.col("text").alias("query"))
    return listed.withColumn("hits", F.lit(engine.results.page(left, 0, 2**31 - 1).count() + engine.results.page(gone).count()))


@query(f"SELECT source, pos_from AS pos FROM ({_log_sql()}) WHERE contains(lower(body), 'reserved') ORDER BY date, source, pos_from LIMIT 5 OFFSET 1")
def http_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON interface: a query is started, waited for, and a page of its hits asked for."""
    import json
    import threading
    import urllib.request

    from .http_api import server

    engine = _logs(spark, sf_dir)
    http = server(engine)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{http.server_port}/api/query"
        with urllib.request.urlopen(urllib.request.Request(url, json.dumps({"query": "reserved"}).encode())) as said:
            query_id = json.load(said)["query"]["query_id"]
        engine.results.wait(query_id)
        with urllib.request.urlopen(f"{url}/{query_id}?skip=1&limit=5") as said:
            shown = json.load(said)["messages"]
    finally:
        http.shutdown()
    rows = spark.createDataFrame([(m["file"], m["pos"]) for m in shown], "file string, pos long")
    return rows.select(F.regexp_extract("file", r"([^/]+)\.log$", 1).alias("source"), "pos")


def _streamed(spark: SparkSession, sf_dir: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream of the events ends in."""
    events = table_messages(spark, sf_dir, "events").withColumn("date", F.col("date").cast("timestamp"))
    folder = own_dir(spark, "stream")
    events.write.parquet(f"{folder}/in")
    out = make(spark.readStream.schema(events.schema).parquet(f"{folder}/in"))
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


@query(_EVENTS + f"contains(lower({EVENT_BODY}), 'signup') AND regexp_matches({EVENT_BODY}, 'user_[0-9]+7 ')")
def stream_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _streamed(spark, sf_dir, lambda messages: standing_query(messages, "signup ~'user_[0-9]+7 '"))
    return hits.select("file", "pos_from", F.col("date").cast("timestamp_ntz").alias("date"))


@query(f"""SELECT date_trunc('hour', ts) AS window_start, count(*) AS messages FROM events WHERE contains(lower({EVENT_BODY}), 'error') GROUP BY 1
HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events WHERE contains(lower({EVENT_BODY}), 'error')) - INTERVAL 10 MINUTE""")
def stream_hits_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed."""
    found = _streamed(spark, sf_dir, lambda messages: hits_by_time(messages, "error"))
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "messages")


#: Queries, their trees, and whether the index cannot rule out any segment for them.
TREES = [
    ("A", "AND(A)", True), ("192.168.0.2", "AND(192.168.0.2)", True), ("error failure", "AND(error,failure)", False), ("error And failure", "AND(error,failure)", False), ("!A", "NOT(A)", True),
    ("!A !B", "AND(NOT(A),NOT(B))", True), ("(A) (B C)", "AND(A,B,C)", True), ("A Or B OR C", "OR(A,B,C)", True), ("A OR (B AND C)", "OR(A,AND(B,C))", True), ("error B OR C", "AND(error,OR(B,C))", False),
    ("~(a) qwert", "AND(~(a),qwert)", False), ("@a", "AND(@a)", True), ("a OR !~a", "OR(a,NOT(~a))", True), ("error OR failure", "OR(error,failure)", False), ("error OR ~err", "OR(error,~err)", True),
]


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


@query("SELECT * FROM (VALUES " + ", ".join(f"({_text(q)}, {_text(t)}, {f})" for q, t, f in TREES) + ") t(query, tree, full_scan)")
def query_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(q, str(parse(q)), full_scan(parse(q), query_terms)) for q, _, _ in TREES]
    return spark.createDataFrame(rows, "query string, tree string, full_scan boolean")


@query("SELECT * FROM (VALUES ('a b', 'b AND a', true), ('a OR b', 'b or a', true), ('a b', 'a OR b', false), ('a', '~a', false), ('~a', '@a', false), ('a (b OR c)', '(c OR b) a', true), ('!a', 'a', false)) t(x, y, same)")
def query_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [("a b", "b AND a"), ("a OR b", "b or a"), ("a b", "a OR b"), ("a", "~a"), ("~a", "@a"), ("a (b OR c)", "(c OR b) a"), ("!a", "a")]
    return spark.createDataFrame([(x, y, digest(parse(x)) == digest(parse(y))) for x, y in pairs], "x string, y string, same boolean")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A boolean search over documents, pruned by the index."""
    return search(_documents(spark, sf_dir), "license OR reserved", index=_index(spark, sf_dir)).select("file", "pos_from", "segment_id")
