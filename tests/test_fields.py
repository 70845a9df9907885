import math

from pyspark.sql import functions as F

from spikeframe.operators import curation as K
from spikeframe.operators import firing_fields as P
from spikeframe.operators import responses as R
from spikeframe.operators import sessions as T

MAP = "k int, bin_x int, bin_y int, rate double"


def bump(centres, n=20):
    return [(1, x, y, 10 * sum(math.exp(-((x - a) ** 2 + (y - b) ** 2) / 8) for a, b in centres)) for x in range(n) for y in range(n)]


def test_two_fields(spark):
    got = P.firing_fields(spark.createDataFrame(bump([(5, 5), (14, 14)]), MAP), ["k"], least_bins=5).collect()
    assert {r.field_id for r in got} == {0, 1}
    assert {(r.bin_x, r.bin_y) for r in got if abs(r.bin_x - 5) + abs(r.bin_y - 5) <= 1} >= {(5, 5), (5, 6), (4, 5)}


def test_flat_and_empty_maps_have_no_field(spark):
    flat = spark.createDataFrame([(1, x, y, 1.0) for x in range(5) for y in range(5)], MAP)
    assert P.firing_fields(flat, ["k"]).count() == 0
    assert P.firing_fields(flat.where("false"), ["k"]).count() == 0
    assert P.firing_fields(flat.withColumn("rate", F.lit(None).cast("double")), ["k"]).count() == 0


def test_hexagon_has_a_high_grid_score(spark):
    ring = [(0.0, 0.0), *((12 * math.cos(math.radians(a)), 12 * math.sin(math.radians(a))) for a in range(0, 360, 60))]
    far = (20.0, 20.0)
    rows = [(1, x, y, max(math.exp(-((x - a) ** 2 + (y - b) ** 2) / 8) for a, b in [*ring, far])) for x in range(-24, 25) for y in range(-24, 25)]
    c = spark.createDataFrame(rows, "k int, dx int, dy int, r double")
    peaks = P.correlogram_peaks(c, ["k"])
    assert peaks.count() == 8
    assert abs(P.grid_spacing(peaks, ["k"]).first().spacing - 30) < 1
    assert P.grid_score(c, peaks, ["k"]).first().grid_score > 0.8


def test_sequential_jumps(spark):
    df = spark.createDataFrame([(1, i, x, 0.0, float(i)) for i, x in enumerate([0.0, 1.0, 50.0, 51.0, 2.0, None])], "k int, i int, x double, y double, t double")
    assert [r.accepted for r in R.sequential_jumps(df, ["k"], "i", "x", "y", "t", 5.0).orderBy("i").collect()] == [True, True, False, False, True, False]


def test_lag(spark):
    a = spark.createDataFrame([(1, i) for i in (10, 40, 75)], "k int, i long")
    assert tuple(R.best_lag(a, a.withColumn("i", F.col("i") + 7), ["k"], "i", 20).first()) == (1, 7, 3)


def test_circular_gap_takes_the_short_way(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, 170.0), (1, 2, None), (1, 3, -170.0), (1, 4, None)], "k int, idx int, hd double")
    got = [r.hd for r in T.interpolate_circular(df, ["k"], ["idx"], "hd").orderBy("idx").collect()]
    assert got == [170.0, 170.0, -180.0, -170.0, -170.0]


def test_direction_flip_is_turned_back(spark):
    df = spark.createDataFrame([(1, i, v, float(i)) for i, v in enumerate([10.0, 12.0, -166.0, 16.0])], "k int, i int, hd double, t double")
    assert [r.hd for r in T.repaired_direction(df, ["k"], "i", "hd", "t", 90.0).orderBy("i").collect()] == [10.0, 12.0, 14.0, 16.0]


def test_square_arena(spark):
    df = spark.createDataFrame([(1, float(x), float(y)) for x in range(6) for y in range(4)] + [(1, 0.0, 0.0)], "k int, x double, y double")
    r = K.square_arena(df, ["k"], "x", "y").agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    assert r[1] - r[0] == r[3] - r[2] == 3


def test_listed_and_zones_with_nulls(spark):
    df = spark.createDataFrame([("a", 80.0), ("b", None)], "k string, x double")
    assert {r.zone for r in K.zones(df, "x", {"u": (30, 90), "v": (70, 90)}).collect()} == {"u", "v"}
    assert [r.t for r in K.tag_listed(df, df.where("k = 'a'"), [F.col("k")], "k", "t").orderBy("k").collect()] == [True, False]
