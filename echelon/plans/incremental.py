"""Season builds that do again only what changed.

Every team-season has fingerprints of what its tables are made of: its programme, the planning calendar, the aliases that can
reach it, the editions behind the history, its profile and its points pages. They are published with the tables. The next
build compares them: team-seasons with equal fingerprints keep their tables, teams whose calendar has the same inputs keep it
without matching any name again, and saved points are used where points are not to be refreshed.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from echelon import schemas
from echelon.operators.spread import checkpointed, few
from echelon.plans.season import TEAM_KEYS, build_season
from echelon.sources import snapshots
from echelon.sources.tables import typed

INPUTS = "team_slug string, planning_year int, calendar_input string, history_input string, profile_input string, points_input string"
OUTCOMES = "team_slug string, planning_year int, races long, error string, success boolean"
#: Schemas of the tables of a season that are read back.
TABLES = {
    "team_calendar": schemas.TEAM_CALENDAR, "team_calendar_ev": schemas.EV, "team_ev_summary": schemas.EV_SUMMARY, "schedule_changelog": schemas.CHANGELOG,
    "team_actual_points": schemas.ACTUAL_POINTS, "outcomes": OUTCOMES, "team_inputs": INPUTS,
}


def _plain(field: T.StructField) -> Column:
    """A column as something that can be hashed: maps as sorted entries."""
    value = F.col(f"`{field.name}`")
    return F.array_sort(F.map_entries(value)) if isinstance(field.dataType, T.MapType) else value


def digest(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One fingerprint per key (or one row without keys) of the rows in any order, repeats included.

    It is made of the number of rows and the sums of two hashes of each row, so it is summed up in parallel.
    """
    columns = [_plain(field) for field in sorted(df.schema.fields, key=lambda field: field.name) if field.name not in keys]
    names = F.lit(",".join(sorted(c for c in df.columns if c not in keys)))
    one, two = F.xxhash64(names, *columns), F.xxhash64(F.lit(1), names, *columns)
    summed = [F.sum(one.cast("decimal(38,0)")), F.sum(two.cast("decimal(38,0)"))]
    return df.groupBy(*keys).agg(F.concat_ws(":", F.count(F.lit(1)), *summed).alias("digest"))


def season_inputs(
    teams: DataFrame, programme: DataFrame, planning: DataFrame, aliases: DataFrame, editions: DataFrame, profiles: DataFrame,
    race_points: DataFrame | None, as_of_date: str | date,
) -> DataFrame:
    """The fingerprints of what each team-season is built from."""
    base = few(teams.select(*TEAM_KEYS, "team_name").dropDuplicates(TEAM_KEYS))

    def own(df: DataFrame, name: str) -> DataFrame:
        return digest(df.join(base.select(*TEAM_KEYS), TEAM_KEYS, "left_semi"), TEAM_KEYS).withColumnRenamed("digest", name)

    # an alias may leave team or season open, so a team-season is reached from four scopes
    scoped = aliases.withColumns({"team_slug": F.coalesce("team_slug", F.lit("")), "planning_year": F.coalesce("planning_year", F.lit(-1))})
    of_scope = digest(scoped, TEAM_KEYS).select(F.col("team_slug").alias("_team"), F.col("planning_year").alias("_year"), "digest")
    scopes = F.array(*[F.struct(team.alias("t"), year.alias("y")) for team in (F.col("team_slug"), F.lit("")) for year in (F.col("planning_year"), F.lit(-1))])
    reached = base.select(*TEAM_KEYS, F.explode(F.array_distinct(scopes)).alias("s")).select(*TEAM_KEYS, F.col("s.t").alias("_team"), F.col("s.y").alias("_year"))
    by_alias = reached.join(of_scope, ["_team", "_year"]).groupBy(*TEAM_KEYS).agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "_team", "_year", "digest"))), ",").alias("_aliases")  # four at most
    )
    by_year = digest(planning, ["planning_year"]).withColumnRenamed("digest", "_planning")
    joined = base.join(own(programme, "_programme"), TEAM_KEYS, "left").join(by_alias, TEAM_KEYS, "left").join(by_year, ["planning_year"], "left")
    joined = joined.join(own(profiles, "_profile"), TEAM_KEYS, "left")
    joined = joined.withColumn("_points", F.lit(None).cast("string")) if race_points is None else joined.join(own(race_points, "_points"), TEAM_KEYS, "left")
    filled = lambda *columns: F.sha2(F.to_json(F.array(*[F.coalesce(c, F.lit("-")) for c in columns])), 256)
    today = F.lit(str(as_of_date))
    return joined.select(
        *TEAM_KEYS,
        filled(F.col("team_name"), F.col("_programme"), F.col("_aliases"), F.col("_planning"), today).alias("calendar_input"),
        filled(digest(editions).scalar(), today).alias("history_input"),
        filled(F.col("_profile")).alias("profile_input"),
        filled(F.col("_points")).alias("points_input"),
    )


def compared(inputs: DataFrame, saved: DataFrame) -> DataFrame:
    """Team-seasons with what is unchanged: `same` (everything), `same_calendar` and `same_points`."""
    kinds = [c for c in inputs.columns if c not in TEAM_KEYS]
    before = saved.select(*TEAM_KEYS, *[F.col(c).alias(f"_{c}") for c in kinds])
    equal = {c: F.coalesce(F.col(c) == F.col(f"_{c}"), F.lit(False)) for c in kinds}
    met = inputs.join(before, TEAM_KEYS, "left")
    everything = equal["calendar_input"] & equal["history_input"] & equal["profile_input"] & equal["points_input"]
    return met.select(*TEAM_KEYS, everything.alias("same"), equal["calendar_input"].alias("same_calendar"), (equal["calendar_input"] & equal["points_input"]).alias("same_points"))


def refresh_season(
    spark: SparkSession,
    root: str,
    teams: DataFrame,
    programme: DataFrame,
    planning: DataFrame,
    aliases: DataFrame,
    editions: DataFrame,
    profiles: DataFrame,
    race_points: DataFrame | None,
    planning_year: int,
    as_of_date: str | date,
    run_at: Column,
    refresh_calendar: bool = True,
    refresh_actual_points: bool = True,
) -> dict[str, object]:
    """Build what changed since the newest snapshot under `root` and publish the next one.

    Returns the version, the team-seasons that were built again (`rebuilt`) and the tables of this build. Nothing is built
    and no version is published if nothing changed. With `refresh_calendar` off, a team with a saved calendar keeps it; with
    `refresh_actual_points` off, one with saved points keeps those: its points pages are not looked at. Teams without saved
    rows are built from their inputs either way. A team that is no longer tracked is in no table of the new version.
    """
    if teams.isEmpty():
        raise ValueError("there is no tracked team to build")
    version = snapshots.current_version(spark, root)
    saved_inputs = snapshots.read_artifact(spark, root, "team_inputs", INPUTS)
    inputs = checkpointed(season_inputs(teams, programme, planning, aliases, editions, profiles, race_points, as_of_date))
    state = checkpointed(compared(inputs, saved_inputs))
    changed = few(state.where(~F.col("same")).select(*TEAM_KEYS))
    gone = saved_inputs.select(*TEAM_KEYS).join(teams.select(*TEAM_KEYS), TEAM_KEYS, "left_anti")
    if changed.isEmpty():
        if not gone.isEmpty():
            version = snapshots.publish(spark, root, {}, replaced=changed, tracked=teams)
        return {"version": version, "rebuilt": changed, "tables": {}}
    calendar = snapshots.read_artifact(spark, root, "team_calendar", schemas.TEAM_CALENDAR)
    points = snapshots.read_artifact(spark, root, "team_actual_points", schemas.ACTUAL_POINTS)
    keep_calendar = few(state.where(F.col("same_calendar") if refresh_calendar else F.lit(True)).select(*TEAM_KEYS))
    keep_points = few(state.where(F.col("same_points") if refresh_actual_points else F.lit(True)).select(*TEAM_KEYS))
    some = teams.join(changed, TEAM_KEYS, "left_semi")
    tables = build_season(
        some, programme, planning, aliases, editions, profiles, race_points, calendar.join(changed, TEAM_KEYS, "left_semi"), planning_year, as_of_date, run_at,
        saved_calendar=calendar.join(keep_calendar, TEAM_KEYS, "left_semi"), saved_actuals=points.join(keep_points, TEAM_KEYS, "left_semi"),
    )
    written: dict[str, DataFrame] = {**tables, "team_inputs": inputs.join(changed, TEAM_KEYS, "left_semi")}
    written = {name: typed(df, TABLES[name]) if name in TABLES else df for name, df in written.items()}
    version = snapshots.publish(spark, root, written, replaced=changed, tracked=teams)
    return {"version": version, "rebuilt": changed, "tables": tables}


def season_table(spark: SparkSession, root: str, name: str, schema: str | None = None, **where) -> DataFrame:
    """A table of the newest snapshot."""
    return snapshots.read_artifact(spark, root, name, schema or TABLES[name], **where)


__all__ = ["compared", "digest", "refresh_season", "season_inputs", "season_table"]
