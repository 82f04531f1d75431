"""Single rules on hand-made rows."""

import random
import re
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from hackney.functions.casts import to_double, to_timestamp
from hackney.functions.dayparts import datetime_attributes, time_of_day
from hackney.functions.keys import datetime_key, location_key
from hackney.functions.measures import minutes_between, round_half_away, round_to_cents
from hackney.functions.places import borough, borough_of_trip, grid_bucket
from hackney.functions.totals import average, group_moments, group_parts, regroup_parts, summed_moments, total, with_correlations
from hackney.operators import metrics, quality, staging, trips
from hackney.plans.model import Model
from hackney.schemas import RAW_COLUMNS, RAW_SCHEMA
from hackney.sources import lookups


def values(spark, texts, expression, kind="string"):
    frame = spark.createDataFrame([(i, text) for i, text in enumerate(texts)], f"i int, x {kind}")
    rows = frame.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()
    return [row.y for row in rows]


def test_numbers_to_refuse(spark):
    texts = ["1.5d", "1f", "NaN", "Infinity", "1,000", "", "abc", "0x1p3", "1 2", "--1", "1.2.3", "e5", ".", None]
    assert values(spark, texts, to_double) == [None] * len(texts)


def test_numbers_to_accept(spark):
    texts = [" 1.5 ", "1e2", "-0.5", "+3", ".5", "7.", "1E-3"]
    assert values(spark, texts, to_double) == [1.5, 100.0, -0.5, 3.0, 0.5, 7.0, 0.001]


def test_times_to_refuse(spark):
    texts = ["2016", "bad", "", "2016-03", "2016-13-01", "2016-3-1", "2016-03-01 25:00:00", "10:00:00", None]
    assert values(spark, texts, to_timestamp) == [None] * len(texts)


def test_times_to_accept(spark):
    texts = ["2016-03-01", "2016-03-01 10:11:12", "2016-03-01T10:11:12", "2016-03-01 10:11:12.5"]
    expected = [
        datetime(2016, 3, 1),
        datetime(2016, 3, 1, 10, 11, 12),
        datetime(2016, 3, 1, 10, 11, 12),
        datetime(2016, 3, 1, 10, 11, 12, 500000),
    ]
    assert values(spark, texts, to_timestamp) == expected


@pytest.mark.parametrize(
    "start, end, expected",
    [
        ("2016-03-01 00:00:59", "2016-03-01 00:01:00", 1),
        ("2016-03-01 00:00:01", "2016-03-01 00:00:59", 0),
        ("2016-02-29 23:59:59", "2016-03-01 00:00:00", 1),
        ("2016-03-01 10:00:00", "2016-03-01 09:59:59", -1),
        ("1969-12-31 23:58:30", "1970-01-01 00:00:00", 2),
        ("2016-03-01 10:00:00", None, None),
    ],
)
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_minutes_count_boundaries(spark, start, end, expected, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        frame = spark.createDataFrame([(start, end)], "a string, b string")
        minutes = minutes_between(to_timestamp(F.col("a")), to_timestamp(F.col("b")))
        assert frame.select(minutes).first()[0] == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_minutes_over_a_clock_change(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        frame = spark.createDataFrame([("2016-03-13 01:30:00", "2016-03-13 03:30:00")], "a string, b string")
        assert frame.select(minutes_between(to_timestamp(F.col("a")), to_timestamp(F.col("b")))).first()[0] == 120
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_rounding(spark):
    assert values(spark, [2.01 / 2.00, 1.234, -1.235, 2.5, None], round_to_cents, "double") == [1.0, 1.23, -1.24, 2.5, None]
    halves = [0.5, 1.5, -0.5, -2.5, 0.49999999999999994, 4503599627370497.5, 1e300]
    assert values(spark, halves, round_half_away, "double") == [1.0, 2.0, -1.0, -3.0, 0.0, 4503599627370498.0, 1e300]


def test_grid_bucket_has_no_negative_zero(spark):
    assert str(values(spark, [-0.001], grid_bucket, "double")[0]) == "0.0"


def test_days(spark):
    frame = spark.createDataFrame([("2016-03-06 00:00:00",), ("2016-03-05 23:59:00",), ("2016-01-01 12:30:00",)], "x string")
    timed = frame.select(to_timestamp(F.col("x")).alias("t"))
    attributes = datetime_attributes(F.col("t"))
    rows = timed.select(*(column.alias(name) for name, column in attributes.items())).collect()
    sunday, saturday, new_year = rows
    assert (sunday.day_of_week_number, sunday.day_of_week_name, sunday.is_weekend) == (0, "Sun", True)
    assert (saturday.day_of_week_number, saturday.day_of_week_name, saturday.is_weekend) == (6, "Sat", True)
    assert (new_year.week_of_year, new_year.trip_quarter, new_year.trip_month_name) == (53, 1, "Jan")
    assert (new_year.day_of_week_number, new_year.is_weekend) == (5, False)
    assert (new_year.pickup_hour, new_year.pickup_minute, new_year.trip_year) == (12, 30, 2016)


def test_time_of_day(spark):
    texts = [f"2016-03-01 {hour:02d}:59:59" for hour in (5, 6, 9, 10, 15, 16, 19, 20, 23)] + [None]
    expected = ["Late Night"] + ["Morning Rush"] * 2 + ["Midday"] * 2 + ["Evening Rush"] * 2 + ["Night"] * 2 + ["Late Night"]
    assert values(spark, texts, lambda text: time_of_day(to_timestamp(text))) == expected


@pytest.mark.parametrize(
    "latitude, longitude, expected",
    [
        (40.72, -73.98, "Manhattan"),
        (40.75, -73.93, "Manhattan"),
        (40.70, -74.02, "Manhattan"),
        (40.60, -73.95, "Brooklyn"),
        (40.75, -73.80, "Queens"),
        (40.90, -73.80, "Bronx"),
        (40.55, -74.10, "Staten Island"),
        (41.00, -74.00, "NYC Metro Area"),
        (0.0, 0.0, "Outside NYC"),
        (None, -73.98, "Outside NYC"),
    ],
)
def test_borough(spark, latitude, longitude, expected):
    frame = spark.createDataFrame([(latitude, longitude)], "lat double, lon double")
    row = frame.select(
        borough(F.col("lat"), F.col("lon")).alias("place"), borough_of_trip(F.col("lat"), F.col("lon")).alias("trip")
    ).first()
    assert row.place == expected
    assert row.trip == (expected if latitude is not None else None)


def test_keys(spark):
    frame = spark.createDataFrame([(40.5, None), (0.0, 1.0), (-0.0, 1.0)], "lat double, lon double")
    missing, zero, negative_zero = [row[0] for row in frame.select(location_key(F.col("lat"), F.col("lon"))).collect()]
    assert missing is None and zero == negative_zero and len(zero) == 32
    assert values(spark, ["bad"], lambda text: datetime_key(to_timestamp(text))) == [None]


DEFAULTS = {
    "raw_id": "r",
    "vendor_id": "1",
    "pickup_datetime": "2016-03-01 10:00:00",
    "dropoff_datetime": "2016-03-01 10:10:00",
    "passenger_count": "1",
    "trip_distance": "2.0",
    "pickup_longitude": "-73.98",
    "pickup_latitude": "40.75",
    "rate_code_id": "1",
    "store_fwd_flag": "N",
    "dropoff_longitude": "-73.95",
    "dropoff_latitude": "40.78",
    "payment_type": "1",
    "fare_amount": "10.0",
    "tip_amount": "2.0",
    "total_amount": "12.0",
}


def model(spark, *changes):
    rows = []
    for number, change in enumerate(changes):
        row = {**DEFAULTS, "raw_id": f"r{number}", **change}
        rows.append(tuple(row.get(name) for name in RAW_COLUMNS))
    return Model(spark, spark.createDataFrame(rows, RAW_SCHEMA))


def reasons(spark, **change):
    one = model(spark, change)
    assert one.fact_trip.count() + one.quarantine_trips.count() == 1
    rejected = one.quarantine_trips.first()
    return rejected.reject_reasons if rejected else "valid"


def test_valid_and_rejected_trips(spark):
    assert reasons(spark) == "valid"
    assert reasons(spark, dropoff_datetime="2016-03-01 14:59:00") == "valid"
    assert reasons(spark, dropoff_datetime="2016-03-01 15:00:00") == ["duration_too_long"]
    assert reasons(spark, dropoff_datetime="2016-03-01 10:00:59") == ["duration_too_short"]
    assert reasons(spark, dropoff_datetime="2016-03-01 09:00:00") == ["invalid_timestamps", "duration_too_short"]
    assert reasons(spark, dropoff_datetime="bad") == ["missing_duration"]
    assert reasons(spark, trip_distance="0.0") == ["zero_distance"]
    assert reasons(spark, passenger_count="0", fare_amount="-1") == ["zero_passengers", "negative_fare"]
    assert reasons(spark, trip_distance="abc") == "valid"
    assert reasons(spark, fare_amount="x") == "valid"
    assert reasons(spark, rate_code_id="99") == "valid"


def test_measures_of_odd_trips(spark):
    odd = model(spark, {"trip_distance": "abc"}, {"fare_amount": "x"}, {"fare_amount": "0"}).stg_trips.orderBy("raw_id")
    no_distance, no_fare, free = odd.collect()
    assert no_distance.fare_per_mile is None and no_distance.tip_percentage == 20.0 and not no_distance.is_zero_distance
    assert no_fare.fare_per_mile is None and no_fare.tip_percentage is None
    assert free.fare_per_mile == 0.0 and free.tip_percentage is None and not free.has_negative_fare


def test_codes_are_trimmed(spark):
    row = model(spark, {"vendor_id": " 2 ", "store_fwd_flag": "Y "}).stg_trips.first()
    assert (row.vendor_id, row.store_fwd_flag) == ("2", "Y")


def test_locations_of_both_ends_are_distinct(spark):
    places = model(spark, {}, {}, {"pickup_latitude": "x"}, {"pickup_latitude": None}).stg_locations.collect()
    pairs = sorted((row.latitude or 0.0, row.longitude) for row in places)
    assert pairs == [(0.0, -73.98), (40.75, -73.98), (40.78, -73.95)]


def failures(tables):
    return {row.check_name: row.failures for row in quality.report(tables).collect() if row.failures}


def test_clean_trips_pass_all_checks(spark):
    tables = model(spark, {}, {"pickup_datetime": "2016-03-01 10:01:00"}).marts()
    assert quality.report(tables).count() == 19 and failures(tables) == {}
    quality.require_all_passed(quality.report(tables))


def test_each_planted_fault_is_found(spark):
    marts = model(
        spark,
        {"raw_id": "same"},
        {"raw_id": "same"},
        {"fare_amount": "x"},
        {"total_amount": "x"},
        {"pickup_latitude": None},
        {"dropoff_latitude": "x"},
        {"pickup_datetime": "x"},
    ).marts()
    assert failures(marts) == {
        "unique_fact_trip_trip_key": 1,
        "not_null_fact_trip_fare_amount": 1,
        "not_null_fact_trip_total_amount": 1,
        "not_null_fact_trip_pickup_location_key": 1,
        "not_null_fact_trip_dropoff_location_key": 1,
        "not_null_dim_datetime_datetime_key": 1,
        "not_null_dim_location_location_key": 1,
    }
    with pytest.raises(quality.QualityCheckFailed, match="unique_fact_trip_trip_key: 1"):
        quality.require_all_passed(quality.report(marts))


def test_faults_that_only_a_changed_table_can_have(spark):
    marts = model(spark, {}, {}).marts()
    broken = marts["fact_trip"].withColumn("fare_amount", F.lit(-1.0)).withColumn("trip_key", F.lit(None).cast("string"))
    broken = broken.withColumn("dropoff_datetime", F.expr("pickup_datetime - interval 1 hour"))
    doubled = {name: table.union(table) for name, table in marts.items() if name != "fact_trip"}
    found = failures({**doubled, "fact_trip": broken})
    assert found["not_negative_fact_trip_fare_amount"] == 2
    assert found["not_before_pickup_fact_trip_dropoff_datetime"] == 2
    assert found["not_null_fact_trip_trip_key"] == 2
    assert "unique_fact_trip_trip_key" not in found
    assert found["unique_dim_vendor_vendor_key"] == 2 and found["unique_dim_payment_type_payment_type_key"] == 6
    rows = quality.failing_rows(quality.NO_NEGATIVE_FARES, broken)
    assert rows.count() == 2
    assert quality.failing_rows(quality.UNIQUE[3], doubled["dim_vendor"]).count() == 2


def test_orphans_are_found(spark):
    marts = model(
        spark, {}, {"payment_type": "9"}, {"payment_type": "8"}, {"payment_type": "9", "vendor_id": None}, {"rate_code_id": " "}
    ).marts()
    found = {row.check_name: row for row in quality.relationships(marts).collect()}
    assert len(found) == 6
    payments = found["relationship_fact_trip_payment_type_key"]
    assert (payments.dimension, payments.failures, payments.failing_keys, payments.rows_without_key) == ("dim_payment_type", 3, 2, 0)
    vendors, rates = found["relationship_fact_trip_vendor_key"], found["relationship_fact_trip_rate_code_key"]
    assert (vendors.failures, vendors.failing_keys, vendors.rows_without_key) == (0, 0, 1)
    assert (rates.failures, rates.failing_keys) == (1, 1)
    # A place, a time and a dropoff place that the dimensions lose.
    fewer = marts | {"dim_datetime": marts["dim_datetime"].limit(0), "dim_location": marts["dim_location"].filter("latitude > 40.76")}
    lost = {row.check_name: row.failures for row in quality.relationships(fewer).collect()}
    assert lost["relationship_fact_trip_datetime_key"] == 5
    assert lost["relationship_fact_trip_pickup_location_key"] == 5 and lost["relationship_fact_trip_dropoff_location_key"] == 0


def test_hot_orphan_is_one_row_in_the_join(spark):
    """Half of the trips refer to one missing key: it is counted in the tasks, so that the shuffle sees a row of it per task."""
    fact = spark.range(100_000, numPartitions=4).select(
        *(F.when(F.col("id") % 2 == 0, F.lit("gone")).otherwise(F.col("id").cast("string")).alias(name) for name in quality.REFERENCES)
    )
    keys = spark.range(100_000).filter("id % 2 = 1").select(F.col("id").cast("string").alias("k"))
    tables = {name: keys.select(F.col("k").alias(key)) for name, key in quality.KEYS.items()} | {"fact_trip": fact}
    found = quality.relationships(tables)
    assert {(row.failures, row.failing_keys) for row in found.collect()} == {(50_000, 1)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_totals(spark):
    frame = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("a", None), ("b", 2e9), ("b", 0.5), ("c", None)], "g string, x double")
    parts = group_parts(frame, [F.col("g")], ["x"])
    rows = {row.g: row for row in parts.select("g", "trips", total("x").alias("s"), average("x").alias("m")).collect()}
    assert (rows["a"].trips, rows["a"].s, rows["a"].m) == (3, 0.3, 0.15)
    assert rows["b"].s == 2000000000.5 and rows["c"].s is None and rows["c"].m is None
    whole = regroup_parts(parts, [], ["x"]).select("trips", total("x").alias("s")).first()
    assert (whole.trips, whole.s) == (6, 2000000000.8)


def test_totals_keep_every_digit(spark):
    frame = spark.createDataFrame([(1.00004,), (1.00004,), (3e6 + 0.123456,), (1e-9,)], "x double")
    assert group_parts(frame, [], ["x"]).select(total("x")).first()[0] == 3000002.123536001
    unfit = spark.createDataFrame([(1.0,), (1e21,)], "x double")
    assert group_parts(unfit, [], ["x"]).select(total("x"), average("x")).first() == (None, None)


def test_totals_of_large_and_long_amounts_add_up(spark):
    """Amounts of all kinds in one group: ten-thousandths, more places, beyond the limbs, negative; in any order and regrouped."""
    rng = random.Random(7)
    amounts = [str(rng.randrange(-10**6, 10**6) / 10**k) for k in (0, 1, 2, 4, 5, 9) for _ in range(40)]
    amounts += ["7036874417766.4", "-7036874417.7664", "1e15", "-1e19", "2.5e-7"]
    frame = spark.createDataFrame([(i % 3, float(x)) for i, x in enumerate(amounts)], "g int, x double")
    wanted = float(sum(Decimal(repr(float(x))) for x in amounts))
    for parts in (1, 5):
        grouped = group_parts(frame.repartition(parts), [F.col("g")], ["x"])
        assert regroup_parts(grouped, [], ["x"]).select(total("x")).first()[0] == wanted
    over = spark.createDataFrame([(i, 9e19) for i in range(3)], "g int, x double")
    assert group_parts(over, [], ["x"]).select(total("x")).first()[0] is None
    assert regroup_parts(group_parts(over, [F.col("g")], ["x"]), [], ["x"]).select(total("x")).first()[0] is None


def moments_of(spark, rows):
    frame = spark.createDataFrame([("g", *row) for row in rows], "g string, x double, y double")
    found = {}
    for parts in (1, 4):
        moments = group_moments(frame.repartition(parts), ["g"], ["x", "y"])
        sums = summed_moments(moments, "g", ["x", "y"], {"r": ("x", "y")}).filter("is_all_trips")
        row = with_correlations(sums, ["r"]).select(average("x"), average("y"), "r", "trips")
        found[parts] = set(row.collect())
    assert found[1] == found[4] and len(found[1]) == 1
    return found[1].pop()


def exactly(rows):
    """Correlation in fractions, of the decimals that the numbers are written as."""
    both = [(Fraction(repr(x)), Fraction(repr(y))) for x, y in rows if x is not None and y is not None]
    n = len(both)
    mean_x, mean_y = (sum(values) / n for values in zip(*both))
    xy = sum((x - mean_x) * (y - mean_y) for x, y in both)
    xx, yy = sum((x - mean_x) ** 2 for x, _ in both), sum((y - mean_y) ** 2 for _, y in both)
    return float(xy) / (float(xx) * float(yy)) ** 0.5


@pytest.mark.parametrize(
    "scale, places, shift", [(100, 2, 0), (100, 7, 0), (1000, 2, 2e5), (1, 4, 2e5), (3e6, 2, 0), (100, 2, 1e9), (10, 9, 5e6)]
)
def test_correlation_is_exact(spark, scale, places, shift):
    rng = random.Random(scale + places)
    rows = [(round(shift + rng.random() * scale, places), round(shift + rng.random() * scale, 2)) for _ in range(60)]
    rows = [(x, round(y + x / 2, 2)) for x, y in rows] + [(None, 3.0), (4.0, None), (None, None)]
    x, y, r, trips = moments_of(spark, rows)
    assert trips == 63 and r == pytest.approx(exactly(rows), abs=1e-6)
    given = [Decimal(repr(row[0])) for row in rows if row[0] is not None]
    assert x == pytest.approx(float(sum(given) / len(given)), rel=1e-15)


def test_one_huge_trip_keeps_the_correlation(spark):
    rows = [(float(i), float(2 * i % 7)) for i in range(50)] + [(1e12, 5.0), (1e10, 1e10)]
    assert moments_of(spark, rows)[2] == pytest.approx(exactly(rows), abs=1e-6)
    assert moments_of(spark, [(1.0, 2.0), (2.0, 5.0), (1e18, 1.0)])[2] is None  # its square has no exact sum
    assert moments_of(spark, [(1.00004, 2.0), (1.00004, 5.0), (1.00004, 7.0)])[2] is None
    assert moments_of(spark, [(1.0, None), (None, 5.0)])[2] is None


def test_efficiency_does_not_depend_on_the_partitions(spark):
    trips_given = [{"fare_amount": f"{i % 97}.{i % 90 + 10}", "trip_distance": f"{i % 31}.1{i % 7}"} for i in range(400)]
    trips_given += [{"trip_distance": "1e12"}, {"trip_distance": "3.141592653"}, {"total_amount": "1e10"}]
    located = metrics.located_trips(model(spark, *trips_given).valid_trips).cache()
    found = {tuple(sorted(map(str, metrics.trip_efficiency(located.repartition(n)).collect()))) for n in (1, 2, 3, 7, 13)}
    located.unpersist()
    assert len(found) == 1


def test_number_too_large_is_missing(spark):
    texts = ["1e400", "-1e400", "1e300", "1"]
    frame = spark.createDataFrame([(text,) for text in texts], "t string")
    assert [row[0] for row in frame.select(to_double(F.col("t"))).collect()] == [None, None, 1e300, 1.0]


def test_lookups_as_written_down(spark):
    assert sorted(map(tuple, lookups.stg_vendors(spark).collect())) == [
        ("1", "Creative Mobile Technologies (CMT)"),
        ("2", "VeriFone Inc."),
    ]
    assert sorted(map(tuple, lookups.stg_rate_codes(spark).collect())) == [
        ("1", "Standard Rate"),
        ("2", "JFK Airport"),
        ("3", "Newark Airport"),
        ("4", "Nassau or Westchester"),
        ("5", "Negotiated Fare"),
        ("6", "Group Ride"),
    ]
    assert sorted(map(tuple, lookups.stg_payment_types(spark).collect())) == [
        ("1", "Credit Card"),
        ("2", "Cash"),
        ("3", "No Charge"),
        ("4", "Dispute"),
        ("5", "Unknown"),
        ("6", "Voided Trip"),
    ]


def test_joined_and_derived_boroughs_agree(spark):
    m = model(
        spark,
        *[{"pickup_latitude": lat} for lat in ("40.72", "40.60", "40.90", "0", None, "41.05")] * 3,
        {"pickup_longitude": "x"},
    )
    located = metrics.located_trips(m.valid_trips)
    joined = {row.borough: row.trips for row in metrics.trips_by_borough(m.fact_trip, m.dim_location).collect()}
    derived = {row.borough: row.trips for row in located.groupBy("borough").count().toDF("borough", "trips").collect()}
    assert joined == derived and sum(joined.values()) == m.fact_trip.count() and None in joined


def test_time_of_day_agrees_with_the_dimension(spark):
    m = model(spark, *[{"pickup_datetime": f"2016-03-01 {h:02d}:00:00", "dropoff_datetime": f"2016-03-01 {h:02d}:30:00"} for h in range(24)])
    joined = m.fact_trip.join(m.dim_datetime, "datetime_key").groupBy("time_of_day").count()
    direct = metrics.trips_by_time_of_day(m.fact_trip).select("time_of_day", "trips")
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, direct.collect()))


def test_hot_place_keeps_all_trips(spark):
    m = model(spark, *[{}] * 60, *[{"pickup_latitude": str(40.5 + i / 1000)} for i in range(20)])
    routes = metrics.trip_route_boroughs(m.fact_trip, m.dim_location)
    assert routes.agg(F.sum("trips")).first()[0] == 80


def test_all_trips_are_in_fact_or_quarantine(spark):
    from tables import DATA
    from hackney.sources.event_trips import trips_from_events

    m = Model(spark, trips_from_events(spark, f"{DATA}/sf0.01"))
    assert (m.raw.count(), m.fact_trip.count(), m.quarantine_trips.count()) == (10_000, 9_242, 758)
    summary = {row.issue: row.trips for row in trips.reject_summary(m.stg_trips).collect()}
    assert summary == {
        "zero_distance": 59,
        "zero_passengers": 25,
        "negative_fare": 70,
        "invalid_timestamps": 199,
        "missing_duration": 31,
        "duration_too_short": 386,
        "duration_too_long": 200,
        "rejected": 758,
        "valid": 9_242,
    }
    assert m.dim_datetime.count() == 9_961 and m.dim_location.count() == 13_976
    assert metrics.kpi_summary(m.fact_trip).first().total_revenue == 383_334.52


def test_staged_columns(spark):
    m = model(spark, {})
    assert len(m.stg_trips.columns) == 30 and len(m.fact_trip.columns) == 26
    assert len(m.stg_datetime.columns) == 14 and len(m.dim_datetime.columns) == 16
    assert m.stg_locations.columns == ["longitude", "latitude", "lat_bucket", "lon_bucket"]
    assert staging.NUMBERS[0] == "pickup_longitude"


def test_efficiency_of_trips_that_do_not_vary(spark):
    one, every = metrics.trip_efficiency(metrics.located_trips(model(spark, {}).valid_trips)).orderBy("is_all_trips").collect()
    assert (one.borough, one.trips, one.average_trip_distance, one.corr_distance_fare) == ("Manhattan", 1, 2.0, None)
    assert (every.borough, every.is_all_trips, every.trips) == (None, True, 1)


def test_efficiency_leaves_out_pairs_with_a_missing_value(spark):
    trips_given = [{"trip_distance": d, "total_amount": t} for d, t in (("1", "10"), ("2", "20"), ("3", "30"), ("x", "500"), ("9", "x"))]
    rows = metrics.trip_efficiency(metrics.located_trips(model(spark, *trips_given).valid_trips)).collect()
    assert {row.corr_distance_fare for row in rows} == {1.0}
    assert {row.average_trip_distance for row in rows} == {3.75}


def test_metrics_of_no_trips(spark):
    m = model(spark, {"trip_distance": "0"})
    kpi = metrics.kpi_summary(m.fact_trip).first()
    assert (kpi.total_trips, kpi.total_revenue, kpi.average_fare, kpi.tip_percentage_of_fares) == (0, None, None, None)
    assert metrics.trips_by_borough(m.fact_trip, m.dim_location).count() == 0
    assert metrics.fare_by_borough(metrics.located_trips(m.valid_trips)).count() == 0


def test_metrics_of_free_trips(spark):
    m = model(spark, {"fare_amount": "0", "tip_amount": "1"})
    kpi = metrics.kpi_summary(m.fact_trip).first()
    assert (kpi.total_trips, kpi.average_tip_percentage, kpi.tip_percentage_of_fares) == (1, None, None)


def test_random_texts_as_numbers(spark):
    chance = random.Random(1)
    texts = ["".join(chance.choice("0123456789.+-eE dfxN") for _ in range(chance.randint(1, 6))) for _ in range(4000)]
    number = re.compile(r"\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d{1,2})?\s*", re.ASCII)
    expected = [float(text) if number.fullmatch(text) else None for text in texts]
    given = [(text, want) for text, want in zip(texts, expected) if not re.search(r"[eE][+-]?\d{3}", text)]
    assert sum(want is not None for _, want in given) > 300
    assert values(spark, [text for text, _ in given], to_double) == [want for _, want in given]


def test_random_numbers_rounded(spark):
    chance = random.Random(2)
    numbers = [chance.choice([1, -1]) * chance.randint(0, 10**6) / 8 for _ in range(1000)]
    numbers += [chance.uniform(-1e9, 1e9) for _ in range(1000)]
    expected = [float(Decimal(number).quantize(Decimal(1), rounding=ROUND_HALF_UP)) for number in numbers]
    assert values(spark, numbers, round_half_away, "double") == expected


def test_random_durations(spark):
    chance = random.Random(3)
    start = datetime(1965, 1, 1)
    times = [start + timedelta(seconds=chance.randint(0, 2_000_000_000)) for _ in range(1000)]
    pairs = [(time, time + timedelta(seconds=chance.randint(-20_000, 20_000))) for time in times]
    frame = spark.createDataFrame([(i, str(a), str(b)) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    minutes = minutes_between(to_timestamp(F.col("a")), to_timestamp(F.col("b")))
    found = [row.m for row in frame.select("i", minutes.alias("m")).orderBy("i").collect()]

    def whole_minutes(time):
        return (time - start) // timedelta(minutes=1)

    assert found == [whole_minutes(b) - whole_minutes(a) for a, b in pairs]
