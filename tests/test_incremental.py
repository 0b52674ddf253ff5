"""Snapshots appear whole or not at all, and builds do again only what changed."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from echelon import schemas
from echelon.constants import ARCHETYPES
from echelon.operators import matching, team_calendar as cal
from echelon.plans import incremental, season
from echelon.sources import snapshots
from tests.test_calendar import NO_ALIAS, PLANNED
from tests.test_value import HISTORY, profile

SLUGS = ["alpha", "beta", "gamma", "lost"]
POINTS = "team_slug string, planning_year int, pcs_race_slug string, actual_points double, rider_count int, has_rows boolean, error string, source_url string"
NOW = "2026-02-15"


@pytest.fixture(scope="module")
def inputs(spark):
    races = [(1, "Alpha Classic", 2025, 2, "1.1", "One-day", 100.0, 40.0, 20.0, 0.0, 0, 5.0), (2, "Beta Tour", 2025, 3, "2.1", "Stage race", 400.0, 90.0, 25.0, 250.0, 5, 9.0)]
    weights = ARCHETYPES["gc_development"]["strength_weight_prior"]
    profiles = profile(spark, weights, key="", team="alpha")
    for slug in SLUGS[1:]:
        profiles = profiles.unionByName(profile(spark, weights, key="", team=slug))
    rows = [(s, s, 2026, "team_program_live", n, "2026-02-01", x) for s in SLUGS[:3] for n, x in (("Alpha Classic ME", "a"), ("Beta Tour", "b"))] + [("lost", "l", 2026, "team_program_live", "Unknown", "", "x")]
    return {
        "teams": spark.createDataFrame([(s, 2026, s.title()) for s in SLUGS], "team_slug string, planning_year int, team_name string"),
        "programme": spark.createDataFrame(rows, "team_slug string, team_name string, planning_year int, source string, source_race_name string, observed_date string, pcs_race_slug string"),
        "planning": cal.prepare_planning(spark.createDataFrame([(1, "Alpha Classic", "1.1", "01.02", 2, 2026), (2, "Beta Tour", "2.1", "01.03-03.03", 3, 2026)], PLANNED)),
        "aliases": matching.prepare_aliases(spark.createDataFrame([], NO_ALIAS)),
        "editions": spark.createDataFrame(races, HISTORY),
        "profiles": profiles,
        "race_points": points(spark, 30.0),
    }


def points(spark, of_alpha):
    return spark.createDataFrame([(s, 2026, "a", of_alpha if s == "alpha" else 7.0, 4, True, None, "u") for s in SLUGS[:3]], POINTS)


@pytest.fixture(scope="module")
def first(spark, inputs, tmp_path_factory):
    """The first build, and where it is."""
    root = tmp_path_factory.mktemp("season") / "first"
    return refresh(spark, root, inputs), root


@pytest.fixture
def root(first, tmp_path):
    """A copy of the first build."""
    return shutil.copytree(first[1], tmp_path / "season")


def refresh(spark, root, inputs, **options):
    return incremental.refresh_season(spark, str(root), *inputs.values(), 2026, NOW, F.lit(NOW).cast("timestamp"), **options)


def values(spark, root, **where):
    rows = incremental.season_table(spark, str(root), "team_calendar_ev", **where)
    return sorted((r.team_slug, r.race_id, r.expected_points, r.actual_points) for r in rows.collect())


def rebuilt(result):
    return sorted(row.team_slug for row in result["rebuilt"].collect())


def test_only_changed_teams_are_built_again(spark, inputs, first, root, monkeypatch):
    assert first[0]["version"] == 1 and rebuilt(first[0]) == sorted(SLUGS)
    whole = season.build_season(*inputs.values(), None, 2026, NOW, F.lit(NOW).cast("timestamp"))["team_calendar_ev"]
    before = values(spark, root)
    assert before == sorted((r.team_slug, r.race_id, r.expected_points, r.actual_points) for r in whole.collect()) and len(before) == 6
    outcome = {r.team_slug: r.error for r in incremental.season_table(spark, str(root), "outcomes").collect()}
    assert outcome == {"alpha": "", "beta": "", "gamma": "", "lost": "No team calendar rows were built for lost."}

    with monkeypatch.context() as patched:
        patched.setattr(incremental, "build_season", lambda *args, **kwargs: pytest.fail("nothing changed"))
        again = refresh(spark, root, inputs)
    assert again["version"] == 1 and rebuilt(again) == [] and values(spark, root) == before

    # new points of one team: its calendar stays as it is, no name is matched again
    seen = []
    matched = season.calendar_from_programme
    monkeypatch.setattr(season, "calendar_from_programme", lambda rows, *rest: seen.append(rows.count()) or matched(rows, *rest))
    second = refresh(spark, root, inputs | {"race_points": points(spark, 99.0)})
    assert second["version"] == 2 and rebuilt(second) == ["alpha"] and seen == [0]
    after = values(spark, root)
    assert [row for row in after if row[0] != "alpha"] == [row for row in before if row[0] != "alpha"]
    assert {row[1]: row[3] for row in after if row[0] == "alpha"} == {1: 99.0, 2: None}
    places = {(r.artifact, r.team_slug): r.folder.split("-")[0] for r in snapshots.manifest(spark, str(root)).collect()}
    assert places["team_calendar_ev", "alpha"] == "v2" and places["team_calendar_ev", "beta"] == "v1"
    assert values(spark, root, version=1) == before

    # a team that is no longer tracked leaves, its old version stays
    third = refresh(spark, root, inputs | {"race_points": points(spark, 99.0), "teams": inputs["teams"].where("team_slug != 'beta'")})
    assert third["version"] == 3 and rebuilt(third) == []
    assert {row[0] for row in values(spark, root)} == {"alpha", "gamma"}


def test_saved_points_can_be_kept(spark, inputs, root):
    changed = inputs | {"race_points": points(spark, 99.0), "programme": inputs["programme"].withColumn("source", F.lit("observed_startlist"))}
    kept = refresh(spark, root, changed, refresh_actual_points=False)
    assert rebuilt(kept) == sorted(SLUGS)
    got = {(row[0], row[1]): row[3] for row in values(spark, root)}
    assert got["alpha", 1] == 30.0 and got["beta", 1] == 7.0
    rows = incremental.season_table(spark, str(root), "team_calendar", team_slug="alpha")
    assert {r.source for r in rows.collect()} == {"observed_startlist"}


def test_saved_calendars_can_be_kept(spark, inputs, root):
    changed = inputs | {"programme": inputs["programme"].withColumn("source", F.lit("other"))}
    assert refresh(spark, root, changed, refresh_calendar=False)["version"] == 2
    rows = incremental.season_table(spark, str(root), "team_calendar")
    assert {r.source for r in rows.collect()} == {"team_program_live"}


def test_fingerprints_ignore_order_and_see_each_change(spark):
    rows = [("t", 1, 1.5, {"a": 1.0, "b": 2.0}), ("t", 1, 1.5, {"b": 2.0, "a": 1.0}), ("t", 2, None, None), ("u", 2, None, {})]
    df = spark.createDataFrame(rows, "team string, n int, x double, m map<string,double>")
    digests = lambda one: {r.team: r.digest for r in incremental.digest(one, ["team"]).collect()}
    assert digests(df) == digests(df.repartition(3).orderBy(F.desc("n"))) == digests(df.select("m", "x", "team", "n"))
    assert digests(df)["t"] != digests(df.dropDuplicates(["team", "n"]))["t"]
    assert digests(df)["u"] != digests(df.withColumn("n", F.col("n") + 1))["u"]
    assert digests(df)["u"] != digests(df.withColumnRenamed("x", "y"))["u"]


def test_aliases_change_the_teams_they_reach(spark, inputs):
    def fingerprints(aliases):
        made = incremental.season_inputs(inputs["teams"], inputs["programme"], inputs["planning"], matching.prepare_aliases(aliases), inputs["editions"], inputs["profiles"], inputs["race_points"], NOW)
        return {r.team_slug: r.calendar_input for r in made.collect()}

    none = fingerprints(spark.createDataFrame([], schemas.ALIAS))
    one = fingerprints(spark.createDataFrame([("beta", "2026", "X", "", "1")], schemas.ALIAS))
    every = fingerprints(spark.createDataFrame([("", "2026", "X", "", "1")], schemas.ALIAS))
    other = fingerprints(spark.createDataFrame([("beta", "2025", "X", "", "1")], schemas.ALIAS))
    assert {slug for slug in SLUGS if none[slug] != one[slug]} == {"beta"}
    assert {slug for slug in SLUGS if none[slug] != every[slug]} == set(SLUGS) and other == none


def test_a_killed_build_leaves_the_version_before(spark, inputs, root):
    before = values(spark, root)
    rows = spark.createDataFrame([("alpha", 2026, 1)], "team_slug string, planning_year int, race_id long")
    broken = rows.select("team_slug", "planning_year", F.raise_error(F.lit("killed")).cast("long").alias("race_id"))
    with pytest.raises(Exception, match="killed"):
        snapshots.publish(spark, str(root), {"team_calendar_ev": rows, "team_ev_summary": broken}, replaced=rows)
    assert snapshots.current_version(spark, str(root)) == 1 and values(spark, root) == before
    assert refresh(spark, root, inputs)["version"] == 1
    # a second writer of the same version is turned away
    os.makedirs(root / "manifest" / "version=2")
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        refresh(spark, root, inputs | {"race_points": points(spark, 1.0)})
    assert values(spark, root) == before


def test_catalog_skips_seasons_that_cannot_be_read(spark, root):
    catalog = lambda: [(r.team_slug, r.label) for r in snapshots.published_catalog(spark, str(root)).collect()]
    assert catalog() == [(s, f"{s.title()} (2026)") for s in SLUGS[:3]]
    for name, slug, content in (("team_calendar_ev", "alpha", b"not a table"), ("team_ev_summary", "beta", None)):
        (file,) = (root / "data").glob(f"*/{name}/planning_year=2026/team_slug={slug}/*.parquet")
        os.remove(file.with_name(f".{file.name}.crc"))
        if content is None:
            os.remove(file)
        else:
            file.write_bytes(content)
    assert catalog() == [("gamma", "Gamma (2026)")]
    assert snapshots.published_catalog(spark, str(root / "nothing")).collect() == []
