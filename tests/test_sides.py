"""Joins of sides without a bound, and names that are normalised once."""

import pytest

from driver import adapters as ad
from echelon.operators import matching
from echelon.operators.spread import shuffled, skew_join

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("build", [ad.programme, ad.season_points])
def test_tables_that_grow_are_never_sent_whole(spark, build):
    assert "SortMergeJoin" in plan(build(spark, DATA)) and "Broadcast" not in plan(build(spark, DATA))


def test_joins_of_matches_send_nothing_whole(spark):
    names = spark.createDataFrame([("a", 2024, "Tour X", "tour x")], "team_slug string, planning_year int, source_race_name string, normalized_name string")
    planning = spark.createDataFrame([(1, 2024, "Tour X", "tour x")], "race_id long, planning_year int, race_name string, normalized_race_name string")
    aliases = matching.prepare_aliases(spark.createDataFrame([("Tour X", 7)], "source_race_name string, race_id long"))
    assert "Broadcast" not in plan(matching.alias_matches(names, aliases))
    assert "Broadcast" not in plan(matching.variant_matches(names, planning))
    left, right = spark.range(9), spark.range(3)
    assert "Broadcast" not in plan(skew_join(left, right, ["id"], "inner"))
    assert left.join(shuffled(right), ["id"]).count() == 3


def test_a_spelling_is_normalised_before_it_meets_teams_and_dates(spark):
    rows = [("a", "Grand Prix É", "x"), ("b", "Grand Prix É", "y"), ("b", "Tour / Étape", "y")]
    found = matching.spelled(spark.createDataFrame(rows, "team_slug string, source_race_name string, observed_date string"), with_variants=True)
    assert sorted((r["team_slug"], r["normalized_name"], r["variants"]) for r in found.collect()) == [
        ("a", "grand prix e", ["grand prix e"]), ("b", "grand prix e", ["grand prix e"]), ("b", "tour etape", ["tour etape", "tour"]),
    ]
    assert "regexp" not in plan(found)
