import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import intervals as iv

RANGE = "struct<pos_from:bigint,pos_to:bigint>"


def lit(r):
    return iv.location(F.lit(r[0]), F.lit(r[1]))


def many(rs):
    return F.array(*map(lit, rs)) if rs else F.array().cast(f"array<{RANGE}>")


def got(spark, column):
    out = spark.range(1).select(column.alias("x")).first().x
    return [tuple(r) for r in out] if isinstance(out, list) else tuple(out) if isinstance(out, tuple) else out


@pytest.mark.parametrize("a,b,touch,share", [((0, 50), (50, 100), True, False), ((0, 25), (50, 75), False, False), ((0, 50), (25, 75), True, True), ((10, 20), (0, 100), True, True)])
def test_relations(spark, a, b, touch, share):
    assert got(spark, iv.intersects(lit(a), lit(b))) is touch and got(spark, iv.overlaps(lit(a), lit(b))) is share


def test_contains_and_length(spark):
    assert got(spark, iv.contains(lit((0, 100)), F.lit(0))) is True and got(spark, iv.contains(lit((0, 100)), F.lit(100))) is False
    assert got(spark, iv.length(lit((5, 9)))) == 4


@pytest.mark.parametrize("a,n,want", [((0, 95), 30, [(0, 30), (30, 60), (60, 90), (90, 95)]), ((0, 30), 30, [(0, 30)]), ((5, 5), 3, []), ((7, 9), 100, [(7, 9)])])
def test_split(spark, a, n, want):
    assert got(spark, iv.split(lit(a), n)) == want


@pytest.mark.parametrize("a,b,want", [((0, 100), (40, 60), [(0, 40), (60, 100)]), ((0, 100), (0, 100), []), ((0, 100), (100, 150), [(0, 100)]), ((50, 150), (0, 100), [(100, 150)]), ((50, 60), (0, 10), [(50, 60)])])
def test_remove(spark, a, b, want):
    assert got(spark, iv.remove(lit(a), lit(b))) == want


def test_remove_all_exclude_merge(spark):
    assert got(spark, iv.remove_all(lit((0, 100)), many([(10, 30), (20, 40), (35, 45)]))) == [(0, 10), (45, 100)]
    assert got(spark, iv.remove_all(lit((0, 100)), many([(0, 60), (50, 100)]))) == []
    assert got(spark, iv.remove_all(lit((0, 100)), many([]))) == [(0, 100)]
    assert got(spark, iv.exclude(lit((10, 20)), many([(0, 15), (17, 18)]))) == [(15, 17), (18, 20)]
    assert got(spark, iv.merge(many([(75, 100), (0, 25), (20, 50)]))) == [(0, 50), (75, 100)]
    assert got(spark, iv.merge(many([(0, 10), (10, 20)]))) == [(0, 20)] and got(spark, iv.merge(many([]))) == []


def test_pick_next(spark):
    ranges = many([(0, 50), (75, 100)])
    assert got(spark, iv.pick_next(ranges, F.lit(25), 40)) == (25, 50) and got(spark, iv.pick_next(ranges, F.lit(0), 40)) == (0, 40)
    assert got(spark, iv.pick_next(ranges, F.lit(100), 40)) == (0, 0)


def test_checked_location(spark):
    assert got(spark, iv.checked_location(F.lit(50), F.lit(50))) == (50, 50)
    with pytest.raises(Exception, match="ends before"):
        got(spark, iv.checked_location(F.lit(100), F.lit(99)))


def test_tables_equal_arrays(spark):
    rng = random.Random(0)
    rows = [(k, a, a + rng.randint(0, 12)) for k in range(40) for a in (rng.randint(0, 90) for _ in range(rng.randint(1, 8)))]
    df = spark.createDataFrame(rows, "k long, pos_from long, pos_to long")
    by_key = df.groupBy("k").agg(F.collect_list(iv.location(F.col("pos_from"), F.col("pos_to"))).alias("r"))
    flat = lambda c: sorted(map(tuple, by_key.select("k", F.explode(c).alias("x")).select("k", "x.*").collect()))
    assert sorted(map(tuple, iv.merge_rows(df, ["k"]).select("k", "pos_from", "pos_to").collect())) == flat(iv.merge(F.col("r")))
    whole = by_key.select("k", F.lit(0).cast("long").alias("pos_from"), F.lit(100).cast("long").alias("pos_to"))
    solid = df.where("pos_to > pos_from")
    kept = solid.groupBy("k").agg(F.collect_list(iv.location(F.col("pos_from"), F.col("pos_to"))).alias("r"))
    want = sorted(map(tuple, by_key.select("k").join(kept, "k", "left").select("k", F.explode(iv.exclude(lit((0, 100)), F.coalesce("r", many([])))).alias("x")).select("k", "x.*").collect()))
    assert sorted(map(tuple, iv.difference_rows(whole, solid, ["k"]).collect())) == want


def test_semi_joins_keep_each_row_once(spark):
    rows = spark.createDataFrame([("f", 1, 125), ("f", 125, 620), ("f", 620, 885)], "file string, pos_from long, pos_to long")
    cases = {((0, 1),): [], ((2000, 10000),): [], ((0, 10000),): [1, 125, 620], ((0, 20),): [1], ((0, 50),): [1], ((0, 50), (610, 700)): [1, 620], ((0, 5), (1, 3)): [1]}
    for ranges, want in cases.items():
        r = spark.createDataFrame([("f", a, b) for a, b in ranges], "file string, pos_from long, pos_to long")
        assert sorted(x.pos_from for x in iv.within(rows, r, ["file"]).collect()) == want
    r = spark.createDataFrame([("f", 0, 50), ("f", 60, 100), ("f", 125, 125)], "file string, pos_from long, pos_to long")
    assert [x.pos_from for x in iv.touched(rows, r, ["file"]).collect()] == [1]


def test_range_joins_across_bins(spark):
    import random

    rng = random.Random(3)
    ranges = [(f"k{rng.randrange(3)}", a, a + rng.randrange(0, 90)) for a in (rng.randrange(1000) for _ in range(60))]
    rows = [(f"k{rng.randrange(4)}", a, a + rng.randrange(0, 70), i) for i, a in enumerate(rng.randrange(1000) for _ in range(300))]
    r = spark.createDataFrame(ranges, "k string, pos_from long, pos_to long")
    df = spark.createDataFrame([*rows, *rows[:5]], "k string, pos_from long, pos_to long, n int")
    for width in (7, 64, 10**6):
        want = sorted(x[3] for x in [*rows, *rows[:5]] if any(k == x[0] and a <= x[1] < b for k, a, b in ranges))
        assert sorted(x.n for x in iv.within(df, r, ["k"], width).collect()) == want
        want = sorted(x[3] for x in [*rows, *rows[:5]] if any(k == x[0] and max(a, x[1]) < min(b, x[2]) for k, a, b in ranges))
        assert sorted(x.n for x in iv.touched(df, r, ["k"], width).collect()) == want
