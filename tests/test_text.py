import pytest
from pyspark.sql import functions as F

from incidentlens.functions import text as T

PAIRS = "array<struct<value:string,count:bigint>>"


def one(spark, expr, **columns):
    names = list(columns)
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{n} STRING" for n in names))
    return df.select(expr.alias("out")).first()["out"]


@pytest.mark.parametrize("text, want", [
    ("40.7580, -73.9855", (40.758, -73.9855)), ("at 40,-73 please", (40.0, -73.0)),
    ("Apt 5, 350 5th Ave", None), ("School, Brooklyn", None), ("", None), ("95, 10", None)])
def test_direct_coordinates(spark, text, want):
    got = one(spark, T.direct_coordinates(F.col("t")), t=text)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize("text, word, rest", [
    ("Restaurant, Times Square, New York", "Restaurant", "Times Square, New York"),
    ("Times Square", None, None), (",x", "", "x"), (" a ,", "a", "")])
def test_request_parts(spark, text, word, rest):
    assert one(spark, T.before_comma(F.col("t")), t=text) == word
    assert one(spark, T.after_comma(F.col("t")), t=text) == rest


def test_business_word(spark):
    for text, want in (("CAFE,  Main St", "Main St"), ("Bar, Main St", "Bar, Main St"),
                       ("my cafe, x", "my cafe, x")):
        assert one(spark, T.without_business_word(F.col("t")), t=text) == want


@pytest.mark.parametrize("text, people, counts, groups, races", [
    ("3 white women + 2 black men", 5, {"women": 3, "men": 2}, ["women"], ["Black", "White"]),
    ("1 queer couple men", 1, {}, ["lgbtq"], []),
    ("2 asian women, 1 hispanic man", 3, {"women": 2, "men": 1}, ["women"],
     ["Asian", "Hispanic/Latino"]),
    ("family with 2 children", 2, {"children": 2}, ["children"], []),
    ("two friends", 1, {}, [], []), ("10 people", 10, {}, [], []),
    ("gold transit riders", 1, {}, ["elderly", "lgbtq"], []), ("0 women", 1, {"women": 0},
                                                              ["women"], [])])
def test_parse_group(spark, text, people, counts, groups, races):
    got = one(spark, T.parse_group(F.col("t")), t=text)
    assert got.total_people == people
    assert {d["type"]: d["count"] for d in got.demographics} == counts
    assert got.vulnerable_groups == groups and got.races == races


def test_parse_group_empty_and_whole_words(spark):
    assert one(spark, T.parse_group(F.col("t")), t="") is None
    got = one(spark, T.parse_group(F.col("t"), whole_words=True), t="gold transit riders")
    assert got.vulnerable_groups == []


def test_repeated_risk_factors_are_kept(spark):
    got = one(spark, T.parse_group(F.col("t")), t="2 black and asian kids")
    assert got.risk_factors == ["racial_bias", "racial_bias", "child_safety"]


def report(spark, score, amenity, top, offenses, peak=None):
    df = spark.createDataFrame(
        [(score, "Park, Main St", amenity, top, 7, offenses, peak, 1, [("park", 1)])],
        f"s DOUBLE, a STRING, m STRING, t {PAIRS}, n BIGINT, o {PAIRS}, "
        f"p struct<bucket:string,percent:double>, c BIGINT, k {PAIRS}")
    return df.select(T.safety_report(*[F.col(c) for c in "samtnopck"])).first()[0]


def test_report_snapshot(spark):
    text = report(spark, 55.5, "Park", [("ROBBERY", 4), ("THEFT", 2)],
                  [("FELONY ASSAULT", 3), ("ASSAULT", 2)], ("night", 62.5))
    assert text == "\n".join([
        "📍 SAFETY ANALYSIS", "Location: Park, Main St",
        "\n🛡️ SAFETY SCORE: 55.5/100 (Moderate)", "\n⚠️ TOP CRIME CONCERNS:",
        "  1. ROBBERY: 4 incidents", "  2. THEFT: 2 incidents", "\nNEARBY ACTIVITY",
        "Total Nearby Crimes: 7", "\n⏰ HIGHEST RISK TIME: Night (62% of crimes)",
        "\nNEARBY AMENITIES", "Total amenities within 1 km: 1", "Amenities by type:",
        "  - Park: 1", "\n👥 FOR FAMILIES AND OUTDOOR ENTHUSIASTS", "⚠️ Specific Concerns:",
        "  • FELONY ASSAULT: 3 incidents", "  • ASSAULT: 2 incidents",
        "\n💡 SAFETY RECOMMENDATIONS", "\n⚠️ MODERATE RISK:", "• Stay aware of surroundings",
        "• Take normal precautions"])


@pytest.mark.parametrize("score, amenity, line", [
    (59.9, "School", "• Ensure constant adult supervision"), (60.0, "School",
     "• Maintain supervision during activities"), (39.9, None, "• Avoid walking alone"),
    (70.0, None, "• Standard precautions recommended"), (30.0, "Nightclub",
     "• Use rideshare services")])
def test_report_bands(spark, score, amenity, line):
    assert line in report(spark, score, amenity, [], []).split("\n")


def test_group_advice(spark):
    df = spark.createDataFrame([("6 black kids", 45.0, [("HARASSMENT", 3), ("CHILD ABUSE", 1)])],
                               f"t STRING, s DOUBLE, o {PAIRS}")
    text = df.select(T.group_advice(T.parse_group(F.col("t")), F.col("s"), F.col("o"))).first()[0]
    assert text == "\n".join([
        "\n🔒 CUSTOM GROUP ANALYSIS", "Group: 6 people", "Race: Black", "Includes: Children",
        "\n👶 CHILDREN: ⚠️ HIGH RISK", "  • Keep within arm's reach",
        "  • Consider alternative locations", "  ⚠️ CHILD ABUSE: 1 incidents",
        "\n🛡️ RACIAL SAFETY CONSIDERATIONS:", "  ⚠️ HARASSMENT: 3 incidents",
        "  • Be aware of surroundings", "  • Document any incidents",
        "  • Know emergency contacts", "\n👥 LARGE GROUP: ✓ Safety in numbers",
        "  • Designate leader", "  • Don't split up"])
