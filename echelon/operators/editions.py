"""Race editions: result, startlist and stage summaries and the ratios derived from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from echelon.constants import STAGE_DEFAULTS
from echelon.functions.columns import ratio_or_zero, with_defaults
from echelon.operators.spread import first_rows, top_rows

_RESULT_MEASURES = ("finishers", "scoring_places", "winner_points", "top10_points", "total_points")


def summarise_lists(rows: DataFrame, keys: Sequence[str], value: Column, order: Sequence[Column], extra: Sequence[Column] = (), k: int = 10) -> DataFrame:
    """Per list: rows, rows with a positive value, the value's total, first, sum and mean over the first `k` in `order`.

    Lists of several kinds go through together when `keys` tells them apart, so their source is read twice in all: for
    the totals, combined before the shuffle, and for the leading rows, of which each map task sends at most `k` per list.
    """
    prepared = rows.withColumn("_value", F.coalesce(value.try_cast("double"), F.lit(0.0)))
    totals = prepared.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_value") > 0).alias("positive"), F.sum("_value").alias("total"), *extra
    )
    leading = top_rows(prepared, keys, order, k).groupBy(*keys).agg(
        F.max(F.when(F.col("_rank") == 1, F.col("_value"))).alias("first"), F.sum("_value").alias("leading"), F.avg("_value").alias("mean_leading")
    )
    return totals.join(leading, list(keys))


def result_measures(lists: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Summarised result lists under the names of a result summary."""
    names = ("rows", "positive", "first", "leading", "total")
    return lists.select(*keys, *[F.col(a).alias(b) for a, b in zip(names, _RESULT_MEASURES, strict=True)])


def summarise_results(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], points: Column) -> DataFrame:
    """Per result list: finishers, scoring places, points of the first, the first ten and all rows.

    `order` is the page order. Points that are no number count as 0.
    """
    return result_measures(summarise_lists(rows, keys, points, order), keys)


def rider_form(starts: Column, wins: Column, podiums: Column, top10s: Column) -> Column:
    """Form of a rider: a win counts 5, another podium 2, another top ten 1, a start 0.1."""
    value = lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0))
    other_podiums = F.greatest(value(podiums) - value(wins), F.lit(0.0))
    other_top10s = F.greatest(value(top10s) - value(podiums), F.lit(0.0))
    return F.lit(5.0) * value(wins) + F.lit(2.0) * other_podiums + other_top10s + F.lit(0.1) * value(starts)


_CAREER = ("starts", "wins", "podiums", "top10s")


def career_sums(starts: Column, wins: Column, podiums: Column, top10s: Column) -> list[Column]:
    values = zip(_CAREER, (starts, wins, podiums, top10s), strict=True)
    return [F.sum(F.coalesce(c.try_cast("double"), F.lit(0.0))).alias(f"total_startlist_{name}") for name, c in values]


def startlist_measures(lists: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Summarised startlists, valued by form, under the names of a startlist summary."""
    return lists.select(
        *keys, F.col("rows").alias("startlist_size"), F.col("positive").alias("experienced_riders"), *[f"total_startlist_{n}" for n in _CAREER],
        F.col("total").alias("total_field_form"), F.col("leading").alias("top10_field_form"), F.col("mean_leading").alias("avg_top10_field_form"),
    )


def summarise_startlist(
    rows: DataFrame, keys: Sequence[str], starts: Column, wins: Column, podiums: Column, top10s: Column, unique: Sequence[str]
) -> DataFrame:
    """Per startlist: size, experienced riders, career sums and field form in total and of the ten best."""
    valued = rows.withColumn("_form", rider_form(starts, wins, podiums, top10s))
    order = [F.desc("_form"), *[F.col(u) for u in unique]]
    return startlist_measures(summarise_lists(valued, keys, F.col("_form"), order, career_sums(starts, wins, podiums, top10s)), keys)


def summarise_stages(stage_results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per edition: sums over its parsed stage pages. `stage_results` has one row per stage page;
    a page without a result table has null `finishers` and counts as missing."""
    parsed = F.col("finishers").isNotNull()
    summed = lambda name: F.coalesce(F.sum(F.when(parsed, F.col(name))), F.lit(0))
    return stage_results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("stage_count"),
        F.count_if(parsed).alias("stage_pages_parsed"),
        F.count_if(~parsed).alias("stage_pages_missing"),
        summed("scoring_places").alias("stage_scoring_places"),
        summed("winner_points").alias("stage_winner_points"),
        summed("top10_points").alias("stage_top10_points"),
        summed("total_points").alias("stage_total_points"),
    )


def event_columns() -> dict[str, Column]:
    """Event sums of the final classification (`gc_*`) and the stages (`stage_*`), and the share of each part."""
    summed = [m for m in _RESULT_MEASURES if m != "finishers"]
    everything = F.col("gc_total_points") + F.col("stage_total_points")
    return {
        **{m: F.col(f"gc_{m}") + F.col(f"stage_{m}") for m in summed},
        "gc_points_share": ratio_or_zero(F.col("gc_total_points"), everything),
        "stage_points_share": ratio_or_zero(F.col("stage_total_points"), everything),
    }


def with_stage_columns(editions: DataFrame) -> DataFrame:
    """Add the optional stage columns that older edition tables lack."""
    return with_defaults(editions, STAGE_DEFAULTS)


def with_ratios(editions: DataFrame) -> DataFrame:
    """Finish rate and points per field form; 0 where the denominator is 0."""
    return editions.withColumns(
        {
            "finish_rate": ratio_or_zero(F.col("finishers"), F.col("startlist_size")),
            "points_per_top10_form": ratio_or_zero(F.col("top10_points"), F.col("top10_field_form")),
            "points_per_total_form": ratio_or_zero(F.col("total_points"), F.col("total_field_form")),
        }
    )


def race_type(category: Column) -> Column:
    return F.when(F.startswith(category, F.lit("1")), F.lit("One-day")).otherwise(F.lit("Stage race"))


def assemble_editions(
    entries: DataFrame, gc_results: DataFrame, startlists: DataFrame, stages: DataFrame, keys: Sequence[str] = ("race_id", "year")
) -> tuple[DataFrame, DataFrame]:
    """(editions, errors): calendar entries joined with their parsed pages.

    An entry without a result or startlist table goes to the error table. One-day races have no stage part.
    """
    gc = gc_results.withColumnsRenamed({m: f"gc_{m}" for m in _RESULT_MEASURES if m != "finishers"})
    joined = entries.join(gc, list(keys), "left").join(startlists, list(keys), "left").join(stages, list(keys), "left")
    joined = joined.withColumn("race_type", race_type(F.col("category")))
    complete = F.col("finishers").isNotNull() & F.col("startlist_size").isNotNull()
    staged = F.col("race_type") == "Stage race"
    stage_part = {c: F.when(staged, F.coalesce(c, F.lit(0))).otherwise(F.lit(0)) for c in stages.columns if c not in keys}
    editions = joined.where(complete).withColumns(stage_part).withColumns(event_columns())
    message = F.when(F.col("finishers").isNull(), F.lit("Could not find a results table")).otherwise(
        F.lit("Could not find an extended startlist table")
    )
    errors = joined.where(~complete).select(*keys, "race_name", message.alias("error"))
    return with_ratios(editions), errors


def balanced_by_year(entries: DataFrame, limit: int) -> DataFrame:
    """At most `limit` entries spread over the years.

    Each year gets an equal quota, the earliest years one more for the remainder, and what
    short years leave unused is filled with the other entries in calendar order.
    """
    order = [F.col("month"), F.col("race_name"), F.col("race_id")]
    years = [row["year"] for row in entries.select("year").distinct().orderBy("year").collect()]
    if not years:
        return entries
    share, extra = divmod(limit, len(years))
    generous = F.col("year").isin(years[:extra]) if extra else F.lit(False)
    quota = F.lit(share) + generous.cast("int")
    # Beyond its quota no year can contribute more than `limit` rows.
    candidates = top_rows(entries, ["year"], order, max(limit, share + 1), "_place")
    chosen = candidates.where(F.col("_place") <= quota)
    counts = entries.groupBy("year").agg(F.count(F.lit(1)).alias("_rows"))
    free = counts.agg(F.lit(limit) - F.sum(F.least(F.col("_rows"), quota))).first()[0]
    spare = candidates.where(F.col("_place") > quota).orderBy("year", *order).limit(max(int(free), 0))
    return chosen.unionByName(spare).drop("_place")


def latest_per_race(calendar: DataFrame, keys: Sequence[str] = ("race_id",)) -> DataFrame:
    """One calendar row per race: the last by (year, month, name)."""
    order = [F.col(c).desc_nulls_last() for c in ("year", "month", "race_name")]
    return first_rows(calendar, keys, order)
