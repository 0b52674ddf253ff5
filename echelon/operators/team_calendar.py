"""Team calendars: planning dates, overlap groups, assembly from matched programmes, schedule diffs."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from echelon.constants import CHANGELOG_COLUMNS, TEAM_CALENDAR_COLUMNS, TRACKED_CHANGES
from echelon.functions.columns import first_filled, nulls_last, text, with_defaults
from echelon.functions.dates import label_dates, status_as_of
from echelon.functions.text import normalise_name
from echelon.operators.matching import match_programme
from echelon.operators.spread import arrange, checkpointed, first_rows, shuffled

TEAM_KEYS = ["team_slug", "planning_year"]


def prepare_planning(planning: DataFrame) -> DataFrame:
    """Planning calendar with the comparable name, parsed dates and a date error column."""
    dated = planning.withColumn("_d", label_dates(F.col("date_label"), F.col("year")))
    return dated.select(
        *planning.columns,
        F.col("year").alias("planning_year"),
        normalise_name(F.col("race_name")).alias("normalized_race_name"),
        F.col("_d.start_date").alias("start_date"),
        F.col("_d.end_date").alias("end_date"),
        F.col("_d.error").alias("date_error"),
    )


def with_overlap_groups(
    races: DataFrame, keys: Sequence[str] = TEAM_KEYS, start: str = "start_date", end: str = "end_date", race: str = "race_id"
) -> DataFrame:
    """Label races that overlap in time: `overlap_<size>` or empty, plus an id per group.

    Races in (start, end, id) order, unknown dates last. A race opens a new group when a date of
    its own is unknown, when the end of the group so far is unknown, or when it starts after it.
    """
    order = [nulls_last(F.col(start)), nulls_last(F.col(end)), F.col(race)]
    open_ended = F.col(end).isNull().cast("int")
    placed = arrange(races, keys, order)
    # Groups restart behind a race without an end, so the latest end is kept per stretch.
    placed = placed.running("_stretch", "sum", open_ended, inclusive=False)
    placed = placed.running("_latest", "max", F.col(end), inclusive=False, within=["_stretch"])
    opens = F.col(start).isNull() | F.col(end).isNull() | F.col("_latest").isNull() | (F.col(start) > F.col("_latest"))
    placed = placed.running("overlap_group_id", "sum", opens.cast("int"))
    placed = placed.whole("_size", "sum", F.lit(1), within=["overlap_group_id"])
    label = F.when(F.col("_size") > 1, F.concat(F.lit("overlap_"), F.col("_size").cast("string"))).otherwise(F.lit(""))
    return placed.with_columns({"overlap_group": label}).done("_stretch", "_latest", "_size")


def calendar_from_programme(
    programme: DataFrame,
    planning: DataFrame,
    aliases: DataFrame,
    as_of_date: str | date,
    scraped_at_utc: Column | None = None,
) -> DataFrame:
    """Calendars of all teams from their observed programmes.

    `programme` rows carry team_slug, team_name, planning_year, source and the observed race;
    `planning` is prepared. Unmatched rows drop out, a race matched twice keeps its first row.
    """
    observed = with_defaults(
        programme, {"source_url": "", "pcs_race_slug": "", "observed_date": None, "category": None, "date_label": None}
    )
    matched = match_programme(observed, planning, aliases).where("match_status = 'matched'")
    # one row per race before the planned columns come along, of a race that is planned twice as well; written, so that what
    # led there has left the disks before the calendars are sorted
    matched = first_rows(matched.drop("month", "start_date", "end_date"), [*TEAM_KEYS, "matched_race_id"], [F.asc_nulls_last("source_race_name"), F.asc_nulls_last("source_url")])
    matched = checkpointed(matched)
    planned = planning.select(
        F.col("race_id").alias("matched_race_id"),
        "planning_year",
        F.col("race_name").alias("_name"),
        F.col("category").alias("_category"),
        F.col("date_label").alias("_label"),
        F.col("month").alias("month"),
        "start_date",
        "end_date",
    )
    planned = first_rows(planned, ["matched_race_id", "planning_year"], [F.asc_nulls_last(c) for c in ("_name", "_category", "_label", "month", "start_date", "end_date")])
    joined = matched.join(shuffled(planned), ["matched_race_id", "planning_year"], "left")
    via = F.col("matched_via")
    assembled = joined.select(
        *TEAM_KEYS,
        F.col("matched_race_id").alias("race_id"),
        "team_name",
        "source",
        (F.lit(None).cast("timestamp") if scraped_at_utc is None else scraped_at_utc).alias("scraped_at_utc"),
        first_filled(F.col("_name"), F.col("canonical_race_name")).alias("race_name"),
        first_filled(F.col("_category"), F.col("category")).alias("category"),
        first_filled(F.col("_label"), F.col("date_label")).alias("date_label"),
        "month",
        "start_date",
        "end_date",
        status_as_of(F.col("end_date"), as_of_date).alias("status"),
        F.lit("active").alias("team_calendar_status"),
        "source_url",
        text(F.col("pcs_race_slug")).alias("pcs_race_slug"),
        F.col("source_race_name").alias("observed_race_name"),
        "matched_via",
        F.concat(F.lit("matched_via="), via).alias("notes"),
    )
    return with_overlap_groups(assembled).select(*TEAM_CALENDAR_COLUMNS, "overlap_group_id")


def schedule_changes(
    previous: DataFrame,
    latest: DataFrame,
    detected_at_utc: Column,
    source: str = "team_calendar_refresh",
    keys: Sequence[str] = TEAM_KEYS,
) -> DataFrame:
    """What changed between two snapshots: races added, removed, and values that differ."""
    ids = [*keys, "race_id"]
    kept = ["race_name", "notes", *TRACKED_CHANGES]
    side = lambda df, mark: with_defaults(df, {"notes": ""}).select(
        *ids, F.struct(*kept, F.lit(True).alias("there")).alias(mark)
    )
    both = side(previous, "old").join(side(latest, "new"), ids, "full_outer")
    was, now = F.col("old.there").isNotNull(), F.col("new.there").isNotNull()
    entry = lambda kind, order, name, old, new, notes: F.struct(
        F.lit(order).alias("change_order"), F.lit(kind).alias("change_type"), name.alias("race_name"),
        old.alias("old_value"), new.alias("new_value"), text(notes).alias("notes"),
    )
    empty = F.lit("")
    changed = [
        F.when(
            was & now & (text(F.col(f"old.{c}")) != text(F.col(f"new.{c}"))),
            entry(kind, i + 2, F.col("new.race_name"), text(F.col(f"old.{c}")), text(F.col(f"new.{c}")), F.col("new.notes")),
        )
        for i, (c, kind) in enumerate(TRACKED_CHANGES.items())
    ]
    added = F.when(now & ~was, entry("race_added", 0, F.col("new.race_name"), empty, text(F.col("new.status")), F.col("new.notes")))
    removed = F.when(was & ~now, entry("race_removed", 1, F.col("old.race_name"), text(F.col("old.status")), empty, F.col("old.notes")))
    events = both.select(*ids, F.explode(F.array_compact(F.array(added, removed, *changed))).alias("c"))
    return events.select(
        *ids, "c.*", detected_at_utc.alias("detected_at_utc"), F.lit(source).alias("source")
    ).select(*dict.fromkeys([*keys, *[c for c in CHANGELOG_COLUMNS if c not in TEAM_KEYS]]), "change_order")
