import math

import pytest
from pyspark.sql import functions as F

from placewise.functions import geo, numbers, parsing, texts, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("x,places,want", [(2.675, 2, 2.68), (0.285, 2, 0.29), (1.0, 4, 1.0), (-0.25, 1, -0.2), (12.35, 1, 12.4)])
def test_rounding_is_half_up_on_the_written_value(spark, x, places, want):
    assert one(spark, numbers.round_to(F.lit(x), places)) == pytest.approx(want)


def test_fixed_text(spark):
    assert one(spark, numbers.fixed(F.lit(12.35), 1)) == "12.4"
    assert one(spark, numbers.fixed(F.lit(12.5), 0)) == "13"
    assert one(spark, numbers.thousands(F.lit(1234567))) == "1,234,567"


def test_finite_values(spark):
    for value, want in ((float("nan"), 0.0), (float("inf"), 1e6), (float("-inf"), -1e6), (2.5, 2.5)):
        assert one(spark, numbers.finite_or_zero(F.lit(value), 1e6)) == want
    assert one(spark, numbers.finite_or_zero(F.lit(None).cast("double"))) == 0.0


def test_star_prediction_rounds_halves_to_even_and_clips(spark):
    got = [one(spark, numbers.star_prediction(F.lit(x))) for x in (2.5, 3.5, 0.2, 7.0)]
    assert got == [2, 4, 1, 5]


def test_ratio_with_empty_denominator(spark):
    assert one(spark, numbers.ratio_or_zero(F.lit(3), F.lit(0))) == 0.0
    assert one(spark, numbers.floored_ratio(F.lit(1.0), F.lit(0.0))) == pytest.approx(100.0)


def test_haversine_quarter_circle(spark):
    km = one(spark, geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)))
    assert km == pytest.approx(6371.0 * math.pi / 2)
    assert one(spark, geo.haversine_km(F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(2.0))) == 0.0
    assert one(spark, geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) == pytest.approx(6371.0 * math.pi)


def test_distance_to_a_missing_point_is_missing(spark):
    nothing = F.lit(None).cast("double")
    assert one(spark, geo.haversine_km(F.lit(1.0), F.lit(2.0), nothing, nothing)) is None


def test_cells_have_no_negative_zero(spark):
    assert one(spark, geo.cell(F.lit(-0.04), 1)) == 0
    assert one(spark, geo.cell_pair_label(F.lit(407), F.lit(-740), 1)) == "40.7,-74.0"


def test_lists_and_titles(spark):
    assert one(spark, texts.split_list(F.lit(" Bars,  Food,,Bars "))) == ["Bars", "Food", "Bars"]
    assert one(spark, texts.split_set(F.lit("7up, 2go"))) == ["7up", "2go"]
    assert one(spark, texts.split_list(F.lit(None).cast("string"))) == []
    assert one(spark, texts.category_title(F.lit("fast_food_restaurant"))) == "Fast Food Restaurant"
    assert one(spark, texts.category_title(F.lit("unknown"))) == "Unknown Venue"
    assert one(spark, texts.overlap_share(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 0.5
    assert one(spark, texts.day_name(F.lit(0))) == "Monday"
    assert one(spark, texts.day_name(F.lit(9))) == "Unknown"


def test_content_key_does_not_depend_on_field_order(spark):
    a = one(spark, texts.content_key([("m", F.lit("x")), ("a", F.lit(1))]))
    b = one(spark, texts.content_key([("a", F.lit(1)), ("m", F.lit("x"))]))
    assert a == b and len(a) == 64


@pytest.mark.parametrize(
    "text,want",
    [
        ("[3, 1, 99]", [2, 0]),
        ("rank: 2 then 2 then 1", [1, 0]),
        ("", None),
        ("none", None),
        ("[2, 2, 1]", [1, 1, 0]),
        ("Order: [2,1,3] done", [1, 0, 2]),
        ("[]", []),
        ("Best is [3,] then 1", [2, 0]),
        ("99", None),
        ('["a", 2]', [1]),
    ],
)
def test_parse_ranking(spark, text, want):
    assert one(spark, parsing.parse_ranking(F.lit(text), 3)) == want


def test_other_answers(spark):
    assert one(spark, parsing.parse_star(F.lit("I say 4 stars, not 5"))) == 4
    assert one(spark, parsing.parse_star(F.lit("42"))) is None
    assert one(spark, parsing.parse_yes_no(F.lit("  YES!"))) == 1
    assert one(spark, parsing.parse_yes_no(F.lit("Nope"))) == 0
    assert one(spark, parsing.parse_yes_no(F.lit("maybe"))) is None
    assert one(spark, parsing.parse_minutes(F.lit("about 12.5 min"))) == 12.5
    assert one(spark, parsing.parse_minutes(F.lit("unknown"))) == 15.0
    assert one(spark, parsing.parse_minutes(F.lit("1.2.3"))) == 15.0


def test_pair_vector(spark):
    a, b = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(5.0))
    assert one(spark, vectors.pair_vector(a, b, F.array(F.lit(9.0)))) == [1, 2, 3, 5, -2, -3, 3, 10, 9]


def test_white_space_of_any_kind_is_stripped(spark):
    from placewise.functions.parsing import parse_yes_no
    from placewise.sources.checkins import count_bad_checkins, parse_checkins, parse_edges

    answers = spark.createDataFrame([(i, a) for i, a in enumerate(["\nYes", "\tNo.", " \r\nyes\t", "maybe", None])], "i int, a string")
    assert [r["v"] for r in answers.orderBy("i").select(parse_yes_no("a").alias("v")).collect()] == [1, 0, 1, None, None]
    edges = spark.createDataFrame([("\t1\t2",), ("5\t6\t",), ("7 8 9",), ("# 1 2",), ("a b",), ("4   3",)], "value string")
    assert {tuple(r) for r in parse_edges(edges).collect()} == {(1, 2), (5, 6), (3, 4)}
    good = "1\t2010-10-19T23:55:27Z\t30.2\t-97.7\t22847"
    lines = spark.createDataFrame([(good + "\t",), ("\n" + good,), (good.rsplit("\t", 1)[0] + "\t",), (good.replace("30.2", "north"),), ("",)], "value string")
    assert parse_checkins(lines).count() == 2
    assert tuple(count_bad_checkins(lines).first()) == (5, 3)
