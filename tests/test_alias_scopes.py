"""Aliases are looked up in four scopes only for names that have any."""

from echelon.operators import matching


def test_names_without_an_alias_are_not_multiplied_by_scopes(spark):
    names = spark.createDataFrame(
        [("a", 2024, "tour x"), ("b", 2025, "tour x"), ("a", 2024, "tour y"), *[("a", 2024, f"other {i}") for i in range(50)]],
        "team_slug string, planning_year int, normalized_name string",
    )
    aliases = matching.prepare_aliases(
        spark.createDataFrame([("", None, "Tour X", 7), ("a", 2024, "Tour X", 5), ("b", None, "Tour Y", 9)], "team_slug string, planning_year int, source_race_name string, race_id long")
    )
    found = matching.alias_matches(names, aliases)
    assert {(r["team_slug"], r["planning_year"], r["normalized_name"], r["alias_race_id"]) for r in found.collect()} == {("a", 2024, "tour x", 5), ("b", 2025, "tour x", 7)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan[plan.index("Generate"):]
