import datetime as dt
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from placewise.functions import numbers
from placewise.operators import compare, evaluate, history, pairs, profiles, sampling, spatial
from placewise.operators.filters import clean_trips, first_per_key, without_pairs
from placewise.operators.trip_stats import origin_hour_stats, trip_counts
from placewise.plans import friendship, levels, next_place, reviews
from placewise.sources import checkins as ci

T0 = dt.datetime(2024, 1, 1)
CHECKIN = "user_id bigint, ts timestamp_ntz, event_id bigint, location_id int, latitude double, longitude double"


def hours(*values):
    return [T0 + dt.timedelta(hours=h) for h in values]


def make_checkins(spark, rows):
    """rows: (user, hours after start, place, lat, lon)"""
    data = [(u, T0 + dt.timedelta(hours=h), i, p, float(la), float(lo)) for i, (u, h, p, la, lo) in enumerate(rows)]
    return spark.createDataFrame(data, CHECKIN)


# -- sources -----------------------------------------------------------------


def test_edges_are_canonical_and_bad_lines_dropped(spark):
    lines = spark.createDataFrame([("5 2",), ("2\t5",), ("# 1 2",), ("1 2 3",), ("7",)], "value string")
    assert [tuple(r) for r in ci.parse_edges(lines).collect()] == [(2, 5)]


def test_checkin_line_with_four_fields_is_dropped(spark):
    good = "3\t2010-10-19T23:55:27Z\t30.2\t-97.7\t22"
    lines = spark.createDataFrame([(good,), ("3\t2010-10-19T23:55:27Z\t30.2\t22",)], "value string")
    rows = ci.parse_checkins(lines).collect()
    assert len(rows) == 1 and rows[0]["ts"] == dt.datetime(2010, 10, 19, 23, 55, 27)


# -- history -------------------------------------------------------------------


def sessions_of(spark, times, **kw):
    data = [(1, t, i) for i, t in enumerate(times)]
    df = spark.createDataFrame(data, "user_id bigint, ts timestamp_ntz, event_id bigint")
    out = history.sessionise(df, "user_id", "ts", "event_id", **kw)
    return [r["session_no"] for r in out.orderBy("event_id").collect()]


def test_session_gap_border(spark):
    exact = hours(0, 24)
    assert sessions_of(spark, exact, min_length=1) == [1, 1]
    late = [exact[0], exact[1] + dt.timedelta(seconds=1)]
    assert sessions_of(spark, late, min_length=1) == [1, 2]


def test_short_sessions_are_dropped(spark):
    assert sessions_of(spark, hours(0, 1, 100, 101, 102)) == [2, 2, 2]


def test_sessions_match_a_plain_loop_for_any_slice(spark):
    rng = random.Random(7)
    times, t = [], 0.0
    for _ in range(200):
        t += rng.choice([0.5, 3, 20, 24, 24.001, 30])
        times.append(t)
    want, n = [], 1
    for i, x in enumerate(times):
        if i and round((x - times[i - 1]) * 3600) > 24 * 3600:
            n += 1
        want.append(n)
    for unit in ("HOUR", "DAY", "MONTH"):
        assert sessions_of(spark, hours(*times), min_length=1, slice_unit=unit) == want


def test_last_n_of_a_short_history_is_everything(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 5)], "k int, o int")
    assert history.last_n(df, ["k"], ["o"], 5).count() == 3
    arr = history.last_n_array(df, ["k"], ["o"], 2, ["o"], "x").filter("k = 1").first()["x"]
    assert [r["o"] for r in arr] == [1, 2]


def test_hold_out_splits_completely(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("k"), F.col("id").alias("o"))
    held, past = history.hold_out(df, ["k"], ["o"], 3)
    assert held.count() == 21 and past.count() == 79
    top = held.groupBy("k").agg(F.min("o").alias("lo"))
    assert past.join(top, "k").filter("o >= lo").count() == 0


@pytest.mark.parametrize("n,spread", [(10, 3600), (37, 1), (50, 0), (101, 86400)])
def test_chronological_split_is_exact(spark, n, spread):
    rng = random.Random(n)
    data = [(i, T0 + dt.timedelta(seconds=rng.randint(0, 20) * spread)) for i in range(n)]
    df = spark.createDataFrame(data, "id int, ts timestamp_ntz")
    got = {r["id"]: r["split"] for r in history.chronological_split(df, "ts", ["id"]).collect()}
    # Equal times fall in the order of a hash of the tie column.
    order = [i for i, _ in sorted(data, key=lambda r: (r[1], hashlib.md5(f"order|{r[0]}".encode()).hexdigest()))]
    a, b = int(n * 0.8), int(n * 0.9)
    want = {i: "train" if k < a else "val" if k < b else "test" for k, i in enumerate(order)}
    assert got == want


def test_time_cuts_shuffle_no_rows_and_stand_hot_moments(spark):
    """Half of all rows at one moment, some without a time; the labelled table is one pass over the rows."""
    rows = [(i, T0 if i % 2 else T0 + dt.timedelta(minutes=i)) for i in range(300)] + [(1000, None)]
    df = spark.createDataFrame(rows, "id int, ts timestamp_ntz")
    out = history.chronological_split(df, "ts", ["id"], (("train", 0.3), ("val", 0.1)))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts == {"train": 90, "val": 30, "test": 181}
    assert history.chronological_split(df.where("false"), "ts", ["id"]).collect() == []


def test_array_statistics(spark):
    row = spark.range(1).select(
        history.array_slope(F.array(F.lit(1), F.lit(5))).alias("short"),
        history.array_slope(F.array(*map(F.lit, (1, 3, 5, 7)))).alias("slope"),
        history.array_std(F.array(F.lit(4))).alias("single"),
        history.array_std(F.array(F.lit(1), F.lit(3))).alias("std"),
        history.streak(F.array(*map(F.lit, (5, 1, 4, 5))), lambda x: x >= 4).alias("streak"),
        history.streak(F.array(*map(F.lit, (5, 4))), lambda x: x >= 4).alias("all"),
        history.streak(F.array(*map(F.lit, (5, 1))), lambda x: x >= 4).alias("none"),
    ).first()
    assert (row["short"], row["slope"], row["single"], row["std"]) == (0.0, 2.0, 0.0, 1.0)
    assert (row["streak"], row["all"], row["none"]) == (2, 2, 0)


# -- profiles ----------------------------------------------------------------------


def test_region_tie_goes_to_the_first_seen(spark):
    c = make_checkins(spark, [(1, 0, 1, 10.0, 10.0), (1, 1, 2, 20.0, 20.0)])
    row = profiles.profile_users(profiles.visit_counts(c)).first()
    assert row["primary_region"] == "10.0,10.0" and row["unique_locations"] == 2 and row["active_days"] == 1


def test_profile_spread(spark):
    c = make_checkins(spark, [(1, 0, 1, 0.0, -1.0), (1, 1, 2, 0.0, 1.0)])
    row = profiles.profile_users(profiles.visit_counts(c)).first()
    assert row["geo_spread_km"] == pytest.approx(111.19, abs=0.01)


def test_entropy_and_concentration(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (2, 5)], "u int, n int")
    got = {r["u"]: (r["h"], r["c"]) for r in df.groupBy("u").agg(
        profiles.entropy_bits("n").alias("h"), profiles.concentration("n").alias("c")).collect()}
    assert got[1] == (pytest.approx(1.0), pytest.approx(0.5)) and got[2] == (0.0, 1.0)


def test_single_trip_has_zero_deviation(spark):
    df = spark.createDataFrame([(1, 2, 3, 5, 10.0)], "pu_zone int, do_zone int, pickup_date int, pickup_hour int, duration_min double")
    assert origin_hour_stats(trip_counts(df)).first()["hour_std"] == 0.0


def test_upper_median(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (4, 1, 3, 2)], "k string, v double")
    assert profiles.upper_median(df, "k", "v").first()["upper_median"] == 3.0


# -- spatial --------------------------------------------------------------------------


def brute_nearest(points, pois, radius):
    def km(a, b, c, d):
        p, q = math.radians(a), math.radians(c)
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(min(h, 1)))

    out = {}
    for k, la, lo in points:
        near = [(km(la, lo, x, y), i, c) for i, c, x, y in pois if c is not None and km(la, lo, x, y) <= radius]
        out[k] = min(near)[2] if near else "unknown"
    return out


@pytest.mark.parametrize("lat0,lon0", [(40.0, -74.0), (-0.0002, 179.9999), (71.9, 10.0), (89.9995, 0.0)])
def test_nearest_category_matches_brute_force(spark, lat0, lon0):
    rng = random.Random(3)
    wrap = lambda x: (x + 180) % 360 - 180
    width = 0.002 / max(math.cos(math.radians(min(abs(lat0), 89.9))), 0.002)
    spot = lambda: (min(lat0 + rng.uniform(-0.002, 0.002), 90.0), wrap(lon0 + rng.uniform(-width, width)))
    points = [(i, *spot()) for i in range(120)]
    pois = [(i, rng.choice(["bar", "park", None]), *spot()) for i in range(150)]
    p = spark.createDataFrame(points, "location_id int, lat double, lon double")
    o = spark.createDataFrame(pois, "poi_id int, category string, lat double, lon double").withColumn("name", F.lit("x"))
    got = {r["location_id"]: r["category"] for r in spatial.nearest_category(p, o).collect()}
    assert got == brute_nearest(points, pois, 0.05)


def test_spatial_join_is_an_equi_join(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0)], "location_id int, lat double, lon double")
    o = spark.createDataFrame([(1, "bar", "x", 0.0001, 0.0)], "poi_id int, category string, name string, lat double, lon double")
    plan = spatial.nearest_category(p, o)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Cartesian" not in plan
    physical = spatial.nearest_category(p, o)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in physical and "Cartesian" not in physical and "Python" not in physical


def test_nearest_category_makes_its_points_once(spark):
    spots = spark.range(40).withColumn("text", F.concat(F.lit("k"), F.col("id").cast("string")))
    k = F.regexp_extract("text", "([0-9]+)", 1).cast("int")
    p = spots.select(k.alias("location_id"), (40 + k * 0.01).alias("lat"), (k * 0.01 - 74).alias("lon"))
    o = spots.select(k.alias("poi_id"), F.lit("n").alias("name"), F.when(k % 2 == 0, "bar").alias("category"),
                     (40 + k * 0.01).alias("lat"), (k * 0.01 - 74).alias("lon"))
    found = spatial.nearest_category(p, o)
    # Conditions on cells would else be pushed to the scan, with the text taken apart many times per row.
    assert "regexp" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {r["location_id"]: r["category"] for r in found.collect()} == {i: "bar" if i % 2 == 0 else "unknown" for i in range(40)}


# -- pairs --------------------------------------------------------------------------------


def pair_setup(spark, rows, cats):
    c = make_checkins(spark, rows)
    v = profiles.visit_counts(c)
    p = profiles.profile_users(v)
    k = spark.createDataFrame(cats, "location_id int, category string")
    counts = profiles.category_counts(v, k)
    return c, v, p, k, counts, profiles.profile_categories(counts, p)


def test_pair_measures_by_hand(spark):
    rows = [(1, 0, 1, 0, 0), (1, 5, 2, 0, 1), (2, 0.5, 1, 0, 0), (2, 0.7, 1, 0, 0), (2, 9, 3, 0, 2)]
    c, v, p, *_ = pair_setup(spark, rows, [(1, "bar")])
    both = spark.createDataFrame([(1, 2), (2, 1)], "user_a bigint, user_b bigint")
    got = {r["user_a"]: r for r in pairs.pair_features(both, c, v, p).collect()}
    # Two check-ins of user 2 meet one of user 1, but only one the other way round.
    assert got[1]["temporal_co_occurrences"] == 2 and got[2]["temporal_co_occurrences"] == 1
    assert got[1]["shared_locations"] == 1 and got[1]["jaccard_locations"] == pytest.approx(0.3333)
    assert got[1]["jaccard_locations"] == got[2]["jaccard_locations"]


@pytest.mark.parametrize("cats,js,cosine", [
    ([(1, "a"), (2, "b"), (3, "a"), (4, "b")], 0.0, 1.0),
    ([(1, "a"), (2, "a"), (3, "b"), (4, "b")], 1.0, 0.0),
])
def test_divergence_of_equal_and_disjoint_tastes(spark, cats, js, cosine):
    rows = [(1, 0, 1, 0, 0), (1, 1, 2, 0, 0), (2, 2, 3, 0, 0), (2, 3, 4, 0, 0)]
    _, v, _, k, counts, prof = pair_setup(spark, rows, cats)
    pair = spark.createDataFrame([(1, 2)], "user_a bigint, user_b bigint")
    row = pairs.pair_category_features(pair, v, k, counts, prof).first()
    assert row["category_js_divergence"] == js and row["category_cosine"] == cosine


def test_nothing_left_outside_shared_places(spark):
    rows = [(1, 0, 1, 0, 0), (2, 2, 1, 0, 0), (3, 1, 9, 0, 0)]
    _, v, _, k, counts, prof = pair_setup(spark, rows, [(1, "a")])
    pair = spark.createDataFrame([(1, 2), (1, 3)], "user_a bigint, user_b bigint")
    got = {r["user_b"]: r for r in pairs.pair_category_features(pair, v, k, counts, prof).collect()}
    assert got[2]["non_shared_category_jaccard"] == 0.0 and got[2]["non_shared_category_cosine"] == 0.0
    assert got[2]["category_jaccard"] == 1.0 and got[3]["shared_categories"] == 0


# -- sampling and cases -------------------------------------------------------------------------


def test_positions_are_dense_per_group(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3).alias("g"))
    rows = sampling.shuffled_position(df, ["id"], "s", ["g"]).collect()
    for g in range(3):
        mine = sorted(r["pos"] for r in rows if r["g"] == g)
        assert mine == list(range(len(mine)))
        assert {r["pool_size"] for r in rows if r["g"] == g} == {len(mine)}


@pytest.mark.parametrize("n", [10, 1500, 4000, 9000])
def test_take_shuffled_is_exact_and_repeatable(spark, n):
    df = spark.range(5000)
    got = {r["id"] for r in sampling.take_shuffled(df, ["id"], n, "s").collect()}
    assert len(got) == min(n, 5000)
    assert got == {r["id"] for r in sampling.take_shuffled(df.repartition(7), ["id"], n, "s").collect()}
    small = {r["id"] for r in df.orderBy(F.md5(F.concat_ws("|", F.lit("s"), "id"))).limit(n).collect()}
    assert got == small


def test_probes_are_distinct_and_cover_the_pool_when_wanted(spark):
    df = spark.createDataFrame([(1, 30), (2, 7), (3, 0)], "c int, size bigint")
    rows = sampling.probe(df, ["c"], "size", F.lit(10), "s", "pos").collect()
    of = lambda c: sorted(r["pos"] for r in rows if r["c"] == c)
    assert len(of(1)) == len(set(of(1))) == 11 and of(1)[0] == -1 and max(of(1)) < 30
    assert of(2) == [-1, *range(7)] and of(3) == [-1]


def test_keyed_permutations_meet_every_number_once(spark):
    sizes = [1, 2, 3, 7, 64, 65, 1000]
    rows = spark.createDataFrame([(c, n) for c in range(4) for n in sizes], "c int, n bigint")
    rows = rows.withColumn("j", F.explode(F.expr("sequence(0L, n - 1)"))).withColumn("k", numbers.permutation_keys("s", "c", "n"))
    found = rows.select("c", "n", numbers.permuted("j", "n", "k").alias("p")).collect()
    for c in range(4):
        for n in sizes:
            assert sorted(r["p"] for r in found if (r["c"], r["n"]) == (c, n)) == list(range(n))


def test_probes_of_two_cases_are_independent(spark):
    """Every ordered pair of pool members is met as often as chance says, within a case and across two cases."""
    pool, cases = 12, 12_000
    df = spark.range(cases).select(F.col("id").alias("c"), F.lit(pool).cast("long").alias("size"))
    rows = sampling.probe(df, ["c"], "size", F.lit(2), "s", "pos").where("pos >= 0")
    sets = rows.groupBy("c").agg(F.sort_array(F.collect_list("pos")).alias("s")).withColumn("other", (F.col("c") / 2).cast("int"))
    within = sets.groupBy("s").count().collect()
    wanted = cases / (pool * (pool - 1) / 2)
    chi = sum((r["count"] - wanted) ** 2 / wanted for r in within)
    assert len(within) == 66 and chi < 65 + 4 * (2 * 65) ** 0.5
    across = sets.groupBy("other").agg(F.min_by("s", "c").alias("a"), F.max_by("s", "c").alias("b"))
    met = across.groupBy(F.size(F.array_intersect("a", "b")).alias("shared")).count().collect()
    chance = {0: 45 / 66, 1: 20 / 66, 2: 1 / 66}
    chi = sum((r["count"] - cases / 2 * chance[r["shared"]]) ** 2 / (cases / 2 * chance[r["shared"]]) for r in met)
    assert chi < 14  # two degrees of freedom


def test_slices_shrink_in_proportion(spark):
    rows = sampling.split_in_proportion(spark.range(77), ["id"], {"train": 1000, "test": 200}, "s").collect()
    assert len(rows) == 77 and sum(r["split"] == "test" for r in rows) == 13
    rows = sampling.split_in_proportion(spark.range(100), ["id"], {"a": 30, "b": 50}, "s").collect()
    assert sum(r["split"] == "a" for r in rows) == 30 and len(rows) == 80


def test_long_ranges_are_built_in_blocks(spark):
    df = spark.createDataFrame([(1, 5000)], "k int, n bigint")
    rows = [r["i"] for r in sampling.explode_range(df, "n", "i").collect()]
    assert sorted(rows) == list(range(5000))


def test_bands_are_disjoint(spark):
    rows = sampling.split_bands(spark.range(100), ["id"], {"a": 30, "b": 50}, "s").collect()
    assert len({r["id"] for r in rows}) == 80 and sum(r["split"] == "a" for r in rows) == 30


def test_random_negatives_are_no_friends(spark):
    users = spark.range(60).select(F.col("id").alias("user_id"))
    edges = spark.range(59).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    cases = friendship.friendship_cases(edges, users, 40, "s").collect()
    friends = {(i, i + 1) for i in range(59)}
    neg = {(r["user_a"], r["user_b"]) for r in cases if r["label"] == 0}
    assert len(neg) == 40 and not neg & friends and all(a < b for a, b in neg)


def test_next_business_negatives_are_unseen_even_for_a_heavy_user(spark):
    rng = random.Random(1)
    rows = []
    for u, n in ((1, 400), (2, 30), (3, 21)):
        for i in range(n):
            b = rng.randint(0, 480) if u == 1 else rng.randint(0, 499)
            rows.append((f"{u}-{i:04d}", u, b, dt.date(2020, 1, 1) + dt.timedelta(days=i)))
    rows += [(f"9-{b}", 9, b, dt.date(2021, 1, 1)) for b in range(500)]
    df = spark.createDataFrame(rows, "review_id string, user_id int, business_id int, review_date date")
    df = df.withColumns({"business_name": F.lit("n"), "categories": F.lit("c"), "city": F.lit("x"),
                         "latitude": F.lit(1.0), "longitude": F.lit(1.0), "stars": F.lit(3)})
    users = spark.createDataFrame([(1,), (2,), (3,), (9,)], "user_id int")
    cands, _ = reviews.next_business_cases(df, users, "s")
    got = cands.collect()
    seen = {(r[1], r[2]) for r in rows}
    for u in (1, 2, 3):
        mine = [r for r in got if r["user_id"] == u]
        assert len(mine) == 20 and sum(r["label"] for r in mine) == 1
        assert sorted(r["pos"] for r in mine) == list(range(20))
        assert not {(u, r["business_id"]) for r in mine if r["label"] == 0} & seen
    # User 9 has reviewed everything: no negatives are left, so there is no case.
    assert not [r for r in got if r["user_id"] == 9]


def test_later_rows_do_not_leak_into_the_history(spark):
    rng = random.Random(5)
    base = [(u, h, rng.randint(0, 60), 40 + rng.random() * 0.1, -74 + rng.random() * 0.1) for u in range(8) for h in range(30)]
    points = {p: (la, lo) for _, _, p, la, lo in base}
    base = [(u, h, p, *points[p]) for u, h, p, _, _ in base]
    users = spark.range(8).select(F.col("id").alias("user_id"))

    def profile_of(rows):
        _, past = next_place.next_place_cases(make_checkins(spark, rows), users, 4, 4, "s", 5)
        return {tuple(r) for r in past.select("user_id", "ts", "location_id").collect()}

    before = profile_of(base)
    moved = [(u, h, (p + 1) % 60 if h == 29 else p, la, lo) for u, h, p, la, lo in base]
    assert before == profile_of(moved)


def test_no_nested_loop_in_pair_and_candidate_plans(spark):
    rows = [(u, h, h % 5, 0.01 * h, 0.0) for u in range(4) for h in range(6)]
    c = make_checkins(spark, rows)
    v = profiles.visit_counts(c)
    pair = spark.createDataFrame([(1, 2)], "user_a bigint, user_b bigint")
    plan = pairs.pair_features(pair, c, v, profiles.profile_users(v))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
    users = spark.range(4).select(F.col("id").alias("user_id"))
    cases, _ = next_place.next_place_cases(c, users, 2, 2, "s", 2)
    plan = cases._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_last_n_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = history.last_n(df, ["k"], ["id"], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


# -- evaluation ------------------------------------------------------------------------------------


def test_all_negative_predictions(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (1, None)], "label int, prediction int")
    row = evaluate.binary_metrics(df).first()
    assert (row["precision"], row["recall"], row["f1"], row["accuracy"], row["n_valid"]) == (0.0, 0.0, 0.0, 0.5, 2)


def test_ranking_metrics_treat_missing_truth_and_missing_ranking(spark):
    df = spark.createDataFrame([([2, 0, 1], 0), ([1], 0), (None, 1)], "ranking array<int>, truth_pos int")
    row = evaluate.ranking_metrics(df).first()
    assert (row["mrr"], row["acc_at_1"], row["acc_at_5"], row["n_valid"], row["n_parse_failures"]) == (0.25, 0.0, 0.5, 2, 1)


def test_bootstrap_brackets_the_mean(spark):
    df = spark.range(400).withColumn("hit", (F.col("id") % 4 == 0).cast("double"))
    row = evaluate.bootstrap_interval(df, F.col("hit"), 300).first()
    assert 0.18 < row["ci_lower"] < 0.25 < row["ci_upper"] < 0.32 and row["n_resamples"] == 300


@pytest.mark.parametrize("count", [1, 5, 63, 64, 200, 5003])
def test_poisson_weights_have_their_mean_variance_and_skew(spark, count):
    n = 4000
    draws = spark.range(n).select(evaluate.poisson_weight(F.lit(count), evaluate.eight_draws("s", "id")).cast("long").alias("w"))
    row = draws.agg(F.avg("w").alias("m"), F.var_samp("w").alias("v"), F.skewness("w").alias("s"), F.min("w").alias("low")).first()
    assert row["low"] >= 0 and abs(row["m"] - count) < 4.5 * math.sqrt(count / n)
    assert abs(row["v"] / count - 1) < 5 * math.sqrt((2 + 1 / count) / n) + 0.01
    assert abs(row["s"] - count**-0.5) < 0.25


def test_bootstrap_explodes_no_rows(spark):
    df = spark.range(5000).withColumn("hit", (F.col("id") % 2).cast("double"))
    plan = evaluate.bootstrap_interval(df, F.col("hit"), 100)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Range")  # the plan is read from its end: rows are counted before
    assert plan.count("Aggregate") == 3 and "Aggregate" in plan[plan.index("Generate"):]


def test_rating_cases_read_the_reviews_once(spark):
    rows = [(u, f"r{u}-{i}", dt.date(2024, 1, 1 + i), 3, "bar") for u in range(4) for i in range(6)]
    df = spark.createDataFrame(rows, "user_id long, review_id string, review_date date, stars int, business_name string")
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    cases, history = reviews.rating_cases(df, users)
    # The users' reviews are handed over in a table: no later step joins with all reviews again.
    assert "LeftSemi" not in cases._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in history._jdf.queryExecution().optimizedPlan().toString()
    assert {r["review_id"] for r in cases.collect()} == {"r1-5", "r2-5"}
    assert {r["review_id"] for r in history.collect()} == {f"r{u}-{i}" for u in (1, 2) for i in range(3)}


def test_row_bootstrap_draws_a_weight_for_every_row(spark):
    rows = [(m, i, float((i + len(m)) % 3 == 0)) for m in ("a", "bb") for i in range(120)] + [("a", 7, 1.0), ("a", 8, None), ("a", None, 1.0)]
    df = spark.createDataFrame(rows, "model string, id long, hit double")
    found = {r["model"]: r for r in evaluate.row_bootstrap_interval(df, ["id"], F.col("hit"), 50, by=["model"]).collect()}
    # The same by hand: every row exploded, its weight counted from its own digest.
    borders = evaluate.poisson_thresholds()
    for m in ("a", "bb"):
        means = []
        for b in range(50):
            total = hits = 0
            for model, i, hit in rows:
                if model == m and hit is not None:
                    text = "|".join(["boot", *([] if i is None else [str(i)]), str(b)])
                    d = int(hashlib.md5(text.encode()).hexdigest()[:8], 16)
                    w = sum(d >= x for x in borders)
                    total, hits = total + w, hits + w * hit
            means.append(hits / total)
        means.sort()
        low = 0.025 * 49
        expected = means[int(low)] + (means[int(low) + 1] - means[int(low)]) * (low - int(low))
        assert found[m]["n_resamples"] == 50 and abs(found[m]["ci_lower"] - expected) < 2e-6


def test_ranking_intervals_hold_the_metrics(spark):
    rows = [("m", f"G{i % 2}", [i % 3, (i + 1) % 3, (i + 2) % 3] if i % 7 else None, 0) for i in range(300)]
    df = spark.createDataFrame(rows, "model string, level string, ranking array<int>, truth_pos int")
    told = {r["level"]: r for r in evaluate.ranking_metrics(df, by=["level"]).collect()}
    found = evaluate.ranking_intervals(df, by=["model", "level"], n_resamples=200).collect()
    assert len(found) == 6
    for r in found:
        assert r["ci_lower"] <= told[r["level"]][r["metric"]] <= r["ci_upper"]


def test_level_correlations_are_subsets_of_one_matrix(spark):
    rng = random.Random(4)
    rows = [tuple(rng.gauss(0, 1) for _ in range(3)) for _ in range(60)]
    df = spark.createDataFrame([(a, b, a + b + 0.1 * c, c) for a, b, c in rows], "a double, b double, e double, d double")
    levels = {"G0": ([], ["a", "b"]), "G1": (["e"], ["a", "e"]), "G2": (["e", "d"], ["a", "b", "e", "d"])}
    found = compare.level_correlations(df, levels)
    assert sorted((r["level"], r["first"], r["second"]) for r in found.collect()) == [
        ("G1", "e", "a"), ("G2", "d", "a"), ("G2", "d", "b"), ("G2", "e", "a"), ("G2", "e", "b")
    ]
    top = [(r["level"], r["position"], r["first"]) for r in compare.top_correlations(found, 2).orderBy("level", "position").collect()]
    assert top == [("G1", 1, "e"), ("G2", 1, "e"), ("G2", 2, "e")]


def test_random_line_is_the_expectation():
    line = evaluate.random_line(20)
    assert line["acc_at_1"] == 0.05 and line["mrr"] == pytest.approx(0.17989, abs=1e-4)


def test_correlation_with_a_constant_column_is_zero(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("a"), F.lit(3.0).alias("b"), (F.col("id") * -2.0).alias("c"))
    got = {(r["first"], r["second"]): r["r"] for r in compare.cross_correlations(df, ["a"], ["b", "c"]).collect()}
    assert got[("a", "b")] == 0.0 and got[("a", "c")] == pytest.approx(-1.0)


def test_level_sizes_are_as_documented():
    want = {
        ("friendship", "venue_id"): (3, 6, 10, 14, 17), ("friendship", "latlng"): (3, 6, 12, 14, 17),
        ("friendship", "enriched"): (3, 10, 22, 26, 31), ("next_place", "venue_id"): (3, 5, 10, 13, 16),
        ("next_place", "enriched"): (3, 8, 16, 20, 23), ("od_ranking", "zone_id"): (3, 5, 10, 13, 16),
        ("od_ranking", "enriched"): (3, 8, 16, 20, 23), ("duration", "zone_id"): (4, 8, 13, 16, 20),
        ("duration", "enriched"): (4, 11, 19, 23, 27), ("rating", "reviews"): (3, 6, 11, 18, 23),
    }
    for (task, tier), sizes in want.items():
        got = tuple(len(levels.feature_names(task, tier, g)) for g in levels.LEVELS)
        assert got == sizes
        for lo, hi in zip(levels.LEVELS, levels.LEVELS[1:]):
            assert set(levels.feature_names(task, tier, lo)) <= set(levels.feature_names(task, tier, hi))
    assert len(levels.enriched_names("friendship")) == 14


def test_first_row_and_edge_exclusion(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "k int, o int, v string")
    assert first_per_key(df, ["k"], ["o"]).first()["v"] == "a"
    pairs_df = spark.createDataFrame([(5, 2), (1, 3)], "x bigint, y bigint")
    known = spark.createDataFrame([(2, 5)], "a bigint, b bigint")
    assert [tuple(r) for r in without_pairs(pairs_df, known, "x", "y").collect()] == [(1, 3)]


def test_trip_limits(spark):
    rows = [(1, 2, T0, T0 + dt.timedelta(minutes=m), d) for m, d in ((1, 1.0), (120, 1.0), (121, 1.0), (0.5, 1.0), (10, 0.0))]
    rows.append((9, 2, T0, T0 + dt.timedelta(minutes=10), 1.0))
    df = spark.createDataFrame(rows, "pu_zone int, do_zone int, pickup_ts timestamp_ntz, dropoff_ts timestamp_ntz, trip_distance double")
    got = clean_trips(df, [9]).collect()
    assert sorted(r["duration_min"] for r in got) == [1.0, 120.0] and got[0]["pickup_dow"] == 0


def _placed_profiles(spark, regions):
    rows = [(u, r, 0, f"r{r}") for r, users in regions.items() for u in users]
    return spark.createDataFrame(rows, "user_id long, region_lat int, region_lon int, primary_region string")


def test_negatives_are_complete_in_a_dense_graph(spark):
    """Nearly everybody is a friend of everybody: every non-friend pair is found, none twice, none beyond."""
    people = range(30)
    missing = {(0, 7), (3, 21), (28, 29), (5, 6), (11, 13)}
    edges = spark.createDataFrame([(a, b) for a in people for b in people if a < b and (a, b) not in missing], "a long, b long")
    users = spark.createDataFrame([(u,) for u in people], "user_id long")
    for n in (2, 5, 400):
        found = [tuple(r) for r in friendship.random_non_friends(users, edges, n, "s").collect()]
        assert len(found) == len(set(found)) == min(n, 5) and set(found) <= missing


def test_regional_negatives_take_all_regions(spark):
    profiles = _placed_profiles(spark, {1: range(6), 2: range(10, 30), 3: range(40, 43)})
    edges = spark.createDataFrame([(0, 1), (10, 11)], "a long, b long")
    found = {tuple(r) for r in friendship.regional_non_friends(profiles, edges, 10**6, "s").collect()}
    want = {(a, b) for users in (range(6), range(10, 30)) for a in users for b in users if a < b} - {(0, 1), (10, 11)}
    assert found == want
    few = [tuple(r) for r in friendship.regional_non_friends(profiles, edges, 20, "s").collect()]
    # Regions take turns: the small one, with 14 pairs, is not drowned by the large one.
    assert len(few) == 20 and sum(a < 6 for a, _ in few) >= 9
    alone = spark.createDataFrame([], edges.schema)
    assert friendship.random_non_friends(profiles.select("user_id").limit(1), alone, 5, "s").count() == 0


def test_cuts_have_no_single_task(spark):
    from placewise.operators.sampling import balanced, ordered_position, take_first, take_shuffled

    df = spark.range(5000).withColumn("label", (F.col("id") % 3).cast("int"))
    cut = {
        "shuffled": take_shuffled(df, ["id"], 2000, "s"),
        "first": take_first(df, ["id"], 2000),
        "balanced": balanced(df, "label", ["id"], 2000, "s"),
    }
    for rows in cut.values():
        assert "TakeOrdered" not in rows._jdf.queryExecution().executedPlan().toString()
    assert cut["shuffled"].distinct().count() == 2000
    assert sorted(r["id"] for r in cut["first"].collect()) == list(range(2000))
    assert {r["count"] for r in cut["balanced"].groupBy("label").count().collect()} == {1000}
    named = df.select(F.concat(F.lit("request-with-a-long-common-prefix-"), F.lpad("id", 6, "0")).alias("k"))
    placed = ordered_position(named, "k").collect()
    assert all(int(r["k"][-6:]) == r["pos"] for r in placed)


def test_few_shot_examples_are_not_asked(spark):
    from catalog.registry import all_queries

    rows = all_queries()["few_shot_texts"].build(spark, "/root/testdata/sf0.001").where("level = 'G4'").collect()
    shown = rows[0]["text"].split("--- Now predict for this new pair ---")[0]
    assert rows and shown.count("--- Example") > 1
    for r in rows:
        assert r["text"].split("--- Now predict for this new pair ---")[1].strip().rsplit("\n\n", 1)[0] not in shown


def test_few_shot_requests_of_every_other_pair(spark):
    from catalog import texts
    from catalog.registry import all_queries

    sf = "/root/testdata/sf0.001"
    asked = all_queries()["few_shot_texts"].build(spark, sf).where("level = 'G4'").select("user_a", "user_b").collect()
    known = {(r["user_a"], r["user_b"]) for r in texts.pair_rows(spark, sf).collect()}
    assert len(asked) == len(set(asked)) == len(known) - texts._SHOTS and {tuple(r) for r in asked} < known


def test_next_place_training_is_not_cut_to_fifty_users(spark):
    from catalog import next_place

    users = next_place.cases(spark, "/root/testdata/sf0.01").filter("split = 'train'").select("user_id").distinct().count()
    assert next_place.N_TRAIN == 1000 and 50 < users <= 1000
    assert next_place.cases(spark, "/root/testdata/sf0.01").filter("split = 'test'").select("user_id").distinct().count() == 13


def _halves(spark, folder):
    """Check-ins in two files, the second with later rows, earlier rows and a new user."""
    rows = [(u, p, t, 10 * t + u) for t in range(9) for u in (1, 2) for p in (u * t % 3,)]
    rows += [(7, 1, t, 1000 + t) for t in range(400)] + [(3, 2, 5, 999), (None, 0, 1, 998)]
    schema = "user_id int, location_id int, ts int, event_id int"
    parts = [[r for i, r in enumerate(rows) if i % 3 == 1], [r for i, r in enumerate(rows) if i % 3 != 1]]
    return rows, [lambda p=p: spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(folder) for p in parts], schema


def test_rolling_state_goes_on_after_a_restart(spark, tmp_path):
    from placewise.streaming.rolling import last_rows_stream, popularity_stream, read_last_rows, read_popularity, start

    source = str(tmp_path / "in")
    rows, writes, schema = _halves(spark, source)
    seen = 0
    for write in writes:
        write()
        stream = spark.readStream.schema(schema).parquet(source)
        start(popularity_stream(stream), str(tmp_path / "counts")).awaitTermination()
        start(last_rows_stream(stream, 3), str(tmp_path / "rows")).awaitTermination()
        now = read_popularity(spark, str(tmp_path / "counts")).collect()
        assert sum(r["popularity"] for r in now) > seen
        seen = sum(r["popularity"] for r in now)
    assert {r["location_id"]: r["popularity"] for r in now} == {p: sum(r[1] == p for r in rows) for p in range(3)}
    wanted = {r for u in {r[0] for r in rows} for r in sorted((x for x in rows if x[0] == u), key=lambda x: (x[2], x[3]))[-3:]}
    found = [tuple(r) for r in read_last_rows(spark, str(tmp_path / "rows")).collect()]
    assert set(found) == wanted and len(found) == len(wanted)
    # Nothing new: the same state after one more start.
    start(last_rows_stream(spark.readStream.schema(schema).parquet(source), 3), str(tmp_path / "rows")).awaitTermination()
    assert {tuple(r) for r in read_last_rows(spark, str(tmp_path / "rows")).collect()} == wanted


def test_rolling_changes_reach_a_writer(spark, tmp_path):
    from placewise.streaming.rolling import ROCKSDB, last_rows_stream

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    source, out = str(tmp_path / "in"), []
    rows, writes, schema = _halves(spark, source)
    for write in writes:
        write()
    stream = last_rows_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), 2)
    query = stream.writeStream.outputMode("update").foreachBatch(lambda b, i: out.append([tuple(r) for r in b.collect()])).option(
        "checkpointLocation", str(tmp_path / "state")
    ).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(out) == 2 and {(7, 1, 399, 1399), (7, 1, 398, 1398)} <= {r for b in out for r in b}


def test_result_files_of_every_shape(spark, tmp_path):
    import json

    from placewise.sources.requests import read_results, result_counts

    records = [
        {"index": 0, "label": 1, "prediction": 1, "usage": {"total_tokens": 7}, "cached": True},
        {"index": 1, "label": 0},
        {"index": 2, "ranking": [2, 0, 1], "ground_truth_idx": 0, "usage": None, "cached": False},
        {"index": 3, "ranking": None, "ground_truth_idx": 4},
        {"index": "four", "ranking": "none", "extra": [1]},
    ]
    (tmp_path / "lines").mkdir()
    (tmp_path / "whole").mkdir()
    lines = [json.dumps(r) for r in records] + ["{broken", "[]", "17", ""]
    (tmp_path / "lines" / "m-one__G1.json").write_text("\n".join(lines) + "\n")
    (tmp_path / "whole" / "m-one__G2.json").write_text(json.dumps(records, indent=2))
    (tmp_path / "whole" / "m_two__G0.json").write_text(json.dumps(records[0]))
    (tmp_path / "whole" / "m_two__G3.json").write_text("[{]")
    by_line = read_results(spark, str(tmp_path / "lines"))
    whole = read_results(spark, str(tmp_path / "whole"), whole_files=True)
    good = [tuple(r)[2:-1] for r in by_line.where("not is_bad").collect()]
    assert good == [tuple(r)[2:-1] for r in whole.where("model = 'm-one'").collect()]
    assert good[0] == (0, 1, 1, None, None, 7, True) and good[2] == (2, None, None, [2, 0, 1], 0, None, False)
    assert good[4] == (None,) * 7
    counts = {(r["model"], r["level"]): tuple(r)[2:] for r in result_counts(by_line.union(whole)).collect()}
    assert counts == {("m-one", "G1"): (5, 3, 3, 7, 1), ("m-one", "G2"): (5, 3, 0, 7, 1), ("m_two", "G0"): (1, 0, 0, 7, 1), ("m_two", "G3"): (0, 0, 1, 0, 0)}


def _shapefile(folder, name, records):
    """A hand-made .shp and .dbf pair from (id, rings) records."""
    import struct

    body = b""
    for i, (_, rings) in enumerate(records):
        points = [p for ring in rings for p in ring]
        starts = [sum(map(len, rings[:k])) for k in range(len(rings))]
        shape = struct.pack("<i4d2i", 5, 0, 0, 0, 0, len(rings), len(points)) + struct.pack(f"<{len(starts)}i", *starts)
        shape += b"".join(struct.pack("<2d", *p) for p in points)
        shape = shape if rings else struct.pack("<i", 0)
        body += struct.pack(">ii", i + 1, len(shape) // 2) + shape
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8)
    (folder / f"{name}.shp").write_bytes(head + body)
    fields = [(b"Shape_Area", b"N", 8), (b"LocationID", b"N", 9)]
    table = struct.pack("<4BIHH20x", 3, 24, 1, 1, len(records), 32 + 32 * len(fields) + 1, 18)
    table += b"".join(struct.pack("<11sc4xBB14x", n, t, size, 0) for n, t, size in fields) + b"\r"
    table += b"".join(b" " + b"1.5".rjust(8) + str(i).encode().rjust(9) for i, _ in records) + b"\x1a"
    (folder / f"{name}.dbf").write_bytes(table)


def test_polygon_files_and_their_centroids(spark, tmp_path):
    from placewise.sources.polygons import polygon_centroids, read_polygons

    square = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)]  # clockwise, closed
    hole = [(2.0, 1.0), (3.0, 1.0), (3.0, 3.0), (2.0, 3.0), (2.0, 1.0)]
    far = [(10.0, 0.0), (10.0, 2.0), (12.0, 2.0), (12.0, 0.0), (10.0, 0.0)]
    _shapefile(tmp_path, "a", [(7, [square]), (8, [square, hole]), (9, [square, far]), (0, [square]), (11, [])])
    _shapefile(tmp_path, "b", [(5, [[(1.0, 1.0), (3.0, 1.0), (1.0, 1.0)]])])
    (tmp_path / "readme.txt").write_text("not a shape")
    vertices = read_polygons(spark, str(tmp_path))
    assert vertices.count() == 5 + 10 + 10 + 3
    found = {r["zone_id"]: (r["lon"], r["lat"], r["area"]) for r in polygon_centroids(vertices).collect()}
    assert set(found) == {5, 7, 8, 9}
    assert found[7] == (2.0, 2.0, 16.0)
    assert found[8] == (pytest.approx((16 * 2 - 2 * 2.5) / 14, abs=1e-6), 2.0, 14.0)
    assert found[9] == (pytest.approx((16 * 2 + 4 * 11) / 20, abs=1e-6), pytest.approx((16 * 2 + 4 * 1) / 20, abs=1e-6), 20.0)
    assert found[5] == (pytest.approx(5 / 3, abs=1e-6), 1.0, 0.0)
    # A ring that does not repeat its first vertex is the same ring.
    open_ring = vertices.where("zone_id = 8 and seq < 4")
    assert tuple(polygon_centroids(open_ring).first())[1:] == (2.0, found[8][0], 14.0)


def test_contributions_add_up_and_are_shapley_values(spark):
    """Against the definition: all subsets of columns, with the tree's expectation where a column is not known."""
    from itertools import combinations

    from placewise.operators import contributions as co, models

    rng = random.Random(6)
    rows = [(i, rng.random(), rng.random(), rng.random(), rng.choice([0.0, 1.0])) for i in range(300)]
    df = spark.createDataFrame([(*r, int(r[1] + 0.5 * r[2] + 0.3 * r[4] > 0.8)) for r in rows], "id int, a double, b double, c double, d double, label int")
    names = ["a", "b", "c", "d"]
    for fit, label in ((models.boosted_classifier, "label"), (models.boosted_regressor, "a")):
        model = fit(df, names, ["id"], label, maxIter=4, maxDepth=3)
        found = co.contributions(model, df, names, ["id"])
        gap = co.largest_gap(found).first()
        assert gap["largest_gap"] < 1e-6 and gap["n"] == 300
        path = str(spark.conf.get("spark.checkpoint.dir")) + f"/tree-{label}"
        model.write().save(path)
        trees = {}
        for r in spark.read.parquet(path + "/data").select("treeID", "nodeData.*").collect():
            trees.setdefault(r["treeID"], {})[r["id"]] = r

        def expect(nodes, x, known, at=0):
            n = nodes[at]
            if n["leftChild"] < 0:
                return n["prediction"]
            c, border = n["split"]["featureIndex"], n["split"]["leftCategoriesOrThreshold"][0]
            sides = [n["leftChild"], n["rightChild"]]
            if c in known:
                return expect(nodes, x, known, sides[x[c] > border])
            return sum(nodes[s]["rawCount"] / n["rawCount"] * expect(nodes, x, known, s) for s in sides)

        got = {r["id"]: r["contributions"] for r in found.collect()}
        for row in rows[:6]:
            x = row[1:]
            for j in range(4):
                value = 0.0
                for size in range(4):
                    for s in combinations([k for k in range(4) if k != j], size):
                        w = math.factorial(size) * math.factorial(3 - size) / 24
                        value += w * sum(model.treeWeights[t] * (expect(n, x, {*s, j}) - expect(n, x, set(s))) for t, n in trees.items())
                assert got[row[0]][j] == pytest.approx(value, abs=1e-9)
    shares = co.contribution_shares(found, names, ["d"]).collect()
    assert max(shares, key=lambda r: r["importance"])["name"] == "a" and sum(r["is_enrichment"] for r in shares) == 1


def test_silhouette_is_euclidean(spark):
    from placewise.operators import models

    rng = random.Random(8)
    rows = [(i, rng.gauss(0, 1) + 3 * (i % 2), rng.gauss(0, 2), i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, a double, b double, label int")
    table = {r["name"]: (r["mean"], r["std"]) for r in models.column_moments(df, ["a", "b"]).collect()}
    points = [(((a - table["a"][0]) / table["a"][1], (b - table["b"][0]) / table["b"][1]), y) for _, a, b, y in rows]

    def score(sample):
        out = []
        for p, y in sample:
            means = [sum(math.dist(p, q) for q, z in sample if z == c) / (sum(z == c for _, z in sample) - (c == y)) for c in (0, 1)]
            out.append((means[1 - y] - means[y]) / max(means))
        return sum(out) / len(out)

    assert models.separation(df, ["a", "b"], ["id"]) == pytest.approx(score(points), abs=1e-9)
    drawn = {r["id"] for r in sampling.take_shuffled(df, ["id"], 50, "separation").collect()}
    assert models.separation(df, ["a", "b"], ["id"], rows=50) != models.separation(df, ["a", "b"], ["id"])
    assert len(drawn) == 50 and models.separation(df.where("label = 1"), ["a", "b"], ["id"]) == 0.0


def test_trip_counts_grow_with_zones_and_calendar(spark):
    from placewise.operators import trip_stats as ts

    # One trip for each of 2 destinations, 24 hours and 30 days: the counts must be far fewer than the trips.
    trips = spark.range(1440).select(
        F.lit(1).alias("pu_zone"), (F.col("id") % 2).cast("int").alias("do_zone"),
        F.concat(F.lit("2000-01-"), F.lpad((F.floor(F.col("id") / 48) + 1).cast("string"), 2, "0")).alias("pickup_date"),
        (F.floor(F.col("id") / 2) % 24).cast("int").alias("pickup_hour"), (F.col("id") % 5 + 1.0).alias("duration_min"),
    )
    counts = trip_counts(trips)
    assert counts.count() == 2 * 24 + 30
    row = ts.origin_stats(counts).first()
    assert (row["pu_count"], row["unique_dropoffs"], row["active_days"], row["pu_mean_dur"], row["mean_hour"]) == (1440, 2, 30, 3.0, 11.5)
    assert [r["od_count"] for r in ts.od_stats(counts).collect()] == [720, 720]
    assert [r["do_count"] for r in ts.destination_stats(counts).collect()] == [720, 720]
    assert {r["hour_mean"] for r in origin_hour_stats(counts).collect()} == {3.0} and origin_hour_stats(counts).count() == 24


def test_recent_trips_order_the_last_days_only(spark):
    from placewise.operators.trip_stats import recent_trips

    rng = random.Random(4)
    rows = []
    for i in range(300):
        at = dt.datetime(2000, 1, 1) + dt.timedelta(days=rng.choice((0, 0, 1, 5, 9)), hours=rng.randrange(3))
        rows.append((f"t{i:04d}", rng.choice((1, 1, 1, 2)), i, at, at.strftime("%Y-%m-%d"), at.hour, rng.random() * 9 + 1))
    rows += [("x", 3, 7, dt.datetime(2000, 1, 1), "2000-01-01", 0, 2.0), ("y", 3, 8, dt.datetime(2000, 3, 1), "2000-03-01", 0, 2.0)]
    trips = spark.createDataFrame(
        rows, "trip_id string, pu_zone int, do_zone int, pickup_ts timestamp_ntz, pickup_date string, pickup_hour int, duration_min double"
    )
    want = {z: [r[2] for r in sorted((r for r in rows if r[1] == z), key=lambda r: (r[3], r[0]))[-5:]] for z in (1, 2, 3)}
    for counts in (None, trip_counts(trips)):
        recent = recent_trips(trips, counts=counts)
        assert {r["pu_zone"]: [t["do_zone"] for t in r["recent"]] for r in recent.collect()} == want
        plan = recent._jdf.queryExecution().executedPlan().toString()
        # Rows are cut by day before they are sorted for the window.
        assert "LeftSemi" in plan[plan.rindex("WindowGroupLimit"):]


def test_trip_ids_are_those_of_the_formatter(spark):
    from catalog.roles import padded

    df = spark.createDataFrame([(0,), (7,), (99,), (100,), (12345,), (-3,), (None,)], "k long")
    for r in df.select(padded("k", 2).alias("a"), F.format_string("%02d", "k").alias("b")).collect():
        assert r["a"] == r["b"]


def test_cut_rows_are_not_shuffled_before_the_cut(spark):
    df = spark.range(5000).select("id", F.concat(F.lit("text"), "id").alias("text"))
    plan = sampling.take_shuffled(df, ["id"], 50, "s")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_history_profile_reads_a_written_history(spark, tmp_path):
    from catalog.registry import all_queries

    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(hours=i // 2), i % 3, f'{{"k": {i % 5}}}') for i in range(40)] + [(90, start, 9, '{"k": 1}')]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, props string")
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = all_queries()["history_profile_without_last"].build(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "events.parquet" not in plan and "WindowGroupLimit" not in plan
    want = {}
    for user in (0, 1, 2):
        past = [r for r in rows if r[2] == user][:-1]
        want[user] = (len(past), len({r[3] for r in past}))
    assert {r["user_id"]: (r["total_checkins"], r["unique_locations"]) for r in got.collect()} == want
