import datetime as dt


from dockcast.functions import (
    horizon_guard,
    occupancy_decile,
    parse_int,
    round_half_up_float,
    steps_to_target,
)


def test_parse_int_is_strict(spark):
    vals = ["1", "+7", "-3", "01", " 1", "1.0", "x", "", None, "99999999999"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(parse_int("s")).collect()]
    assert got == [1, 7, -3, 1, None, None, None, None, None, None]


def test_round_half_up_through_float(spark):
    vals = [2.5, -2.5, 2.4999, 0.49999997, 3.5, -0.5, 10.0]
    df = spark.createDataFrame([(v,) for v in vals], "p double")
    got = [r[0] for r in df.select(round_half_up_float("p")).collect()]
    # Math.round(float): ties go up (-2.5 -> -2); 0.49999997 is a float tie case
    assert got == [3, -2, 2, 0, 4, 0, 10]


def test_steps_and_guard(spark):
    rows = [(14, 14), (15, 14), (13, 14), (23, 0), (0, 23), (20, 19)]
    df = spark.createDataFrame(rows, "target int, now int")
    bcn = [r[0] for r in df.select(horizon_guard(steps_to_target("target", "now", 3), 9)).collect()]
    snt = [r[0] for r in df.select(horizon_guard(steps_to_target("target", "now", 5), 5)).collect()]
    # hour - now: 0 ->1 step, 1 -> 1, 23 -> 8/5, 23 -> 8/5, 1 -> 1, 1 -> 1
    assert bcn == [1, 1, 8, 8, 1, 1]
    assert snt == [1, 1, 5, 5, 1, 1]


def test_occupancy_decile(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.25,), (0.96,)], "a double")
    got = [r[0] for r in df.select(occupancy_decile("a")).collect()]
    assert got == [10, 0, 8, 0]


def test_minus_seconds_and_epoch(spark):
    from dockcast.functions import epoch_micros, iso_utc, minus_seconds

    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 9, 0, 0),)], "ts timestamp_ntz")
    r = df.select(
        iso_utc(minus_seconds("ts", 9 * 3600)).alias("a"), epoch_micros("ts").alias("b")
    ).first()
    assert r.a == "2024-01-01T00:00:00Z"
    assert r.b == 1704099600 * 1_000_000
