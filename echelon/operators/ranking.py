"""Ranks, percentile scores, min-max scaling and rank correlation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from echelon.functions.columns import nulls_last
from echelon.operators.spread import arrange, checkpointed


def _score(value: Column, average_rank: Column, filled: Column, flat: Column, reverse: bool) -> Column:
    percent = average_rank / filled * F.lit(100.0)
    scored = F.lit(100.0) - percent if reverse else percent
    return F.when(flat, F.lit(50.0)).when(value.isNotNull(), scored)


def _ranked(df: DataFrame, columns: Sequence[str], unique: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, unique, _component, _value) with `_average`, the average rank of each value among those of its component.

    All columns are ranked in one pass over narrow rows, cut into slices once, whatever their number. With it come, for the
    whole group, `_filled` and `_rows` (values and rows) and `_low` and `_high`.
    """
    ids = list(dict.fromkeys([*keys, *unique]))
    narrow = df.select(*ids, *[F.col(c).cast("double").alias(f"_v_{c}") for c in columns]).unpivot(
        ids, [f"_v_{c}" for c in columns], "_component", "_value"
    )
    placed = arrange(narrow, [*keys, "_component"], [nulls_last(F.col("_value")), *[F.col(u) for u in unique]])
    position, value = F.col("_position"), F.col("_value")
    placed = placed.running("_position", "sum", F.lit(1)).wholes({"_first": ("min", position), "_last": ("max", position)}, within=["_o0"])
    placed = placed.wholes(
        {"_filled": ("sum", value.isNotNull().cast("long")), "_rows": ("sum", F.lit(1)), "_low": ("min", value), "_high": ("max", value)}
    )
    return placed.df.withColumn("_average", (F.col("_first") + F.col("_last")) / F.lit(2.0))


def percentile_scores(
    df: DataFrame,
    scores: Mapping[str, tuple[str, bool]],
    unique: Sequence[str],
    keys: Sequence[str] = (),
) -> DataFrame:
    """Add percentile scores: name -> (value column, reverse).

    Average rank among the non-null values of the group, as percent of their number;
    reversed scores are 100 minus that; a group with one distinct value (a null counts
    as one) scores 50 throughout. `unique` names columns that identify a row. All components
    are ranked in one pass over narrow rows and pivoted back.
    """
    df = checkpointed(df)  # read twice
    ids = list(dict.fromkeys([*keys, *unique]))
    sources = list(dict.fromkeys(c for c, _ in scores.values()))
    flat = (F.col("_filled") == 0) | (
        (F.col("_filled") == F.col("_rows")) & F.col("_low").eqNullSafe(F.col("_high"))
    )
    ranked = _ranked(df, sources, unique, keys).select(
        *ids, "_component", _score(F.col("_value"), F.col("_average"), F.col("_filled"), flat, False).alias("_pct"), flat.alias("_flat")
    )
    wide = ranked.groupBy(*ids).agg(
        *[
            F.max(F.when(F.col("_component") == f"_v_{c}", F.struct("_pct", "_flat"))).alias(f"_s_{c}")
            for c in sources
        ]
    )
    joined = df.join(wide, ids, "left")
    result = joined.withColumns(
        {
            name: F.when(
                F.lit(rev) & ~F.col(f"_s_{c}._flat"), F.lit(100.0) - F.col(f"_s_{c}._pct")
            ).otherwise(F.col(f"_s_{c}._pct"))
            for name, (c, rev) in scores.items()
        }
    )
    return result.drop(*[f"_s_{c}" for c in sources])


def minmax_scaled(value: Column, low: Column, high: Column, invert: bool = False) -> Column:
    """Scale into [0, 1] by given bounds; null scores 0.

    With equal bounds every value scores 1 and every null 0, and inverting swaps the two.
    Without any value everything scores 0, inverted or not.
    """
    if invert:
        flat = F.when(value.isNotNull(), F.lit(0.0)).otherwise(F.lit(1.0))
        spread = F.lit(1.0) - (value - low) / (high - low)
    else:
        flat = F.when(value.isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0))
        spread = (value - low) / (high - low)
    return F.when(low.isNull(), F.lit(0.0)).when(low == high, flat).otherwise(F.coalesce(spread, F.lit(0.0)))


def with_bounds(df: DataFrame, columns: Sequence[str], name: str = "_bounds") -> DataFrame:
    """Attach the table-wide min and max of `columns` as one struct (a scalar subquery)."""
    bounds = df.agg(
        F.struct(*[f(F.col(c).cast("double")).alias(f"{c}_{side}") for c in columns for side, f in (("low", F.min), ("high", F.max))]).alias("b")
    )
    return df.withColumn(name, bounds.scalar())


def minmax_columns(df: DataFrame, scaled: Mapping[str, tuple[str, bool]]) -> DataFrame:
    """Add min-max scaled columns: name -> (source column, invert)."""
    sources = list(dict.fromkeys(c for c, _ in scaled.values()))
    bounded = with_bounds(df, sources)
    return bounded.withColumns(
        {
            name: minmax_scaled(F.col(c).cast("double"), F.col(f"_bounds.{c}_low"), F.col(f"_bounds.{c}_high"), inv)
            for name, (c, inv) in scaled.items()
        }
    ).drop("_bounds")


def expanding_percentile_scores(
    df: DataFrame, scores: Mapping[str, tuple[str, bool]], unique: Sequence[str], year: str, test_years: Sequence[int]
) -> DataFrame:
    """The percentile scores of each row in the expanding window before each test year, without a row per window.

    The result has `unique`, `year` and, for each name of `scores` (value column, reverse), an array along `test_years`: the
    percentile score of the row among all rows of years before that one, as `percentile_scores` defines it; only the places
    of test years after the row's own mean anything. Values are counted once per component and value, with a count for
    each window; the counts are summed along the values in one pass over slices, and every window's ranks follow from them.
    """
    ids = list(dict.fromkeys([*unique, year]))
    sources = list(dict.fromkeys(c for c, _ in scores.values()))
    narrow = df.select(*ids, *[F.col(c).cast("double").alias(f"_v_{c}") for c in sources]).unpivot(ids, [f"_v_{c}" for c in sources], "_component", "_value")
    windows = range(len(test_years))
    # one row per distinct value, however many rows share it and however many windows there are
    counts = narrow.groupBy("_component", "_value").agg(*[F.count_if(F.col(year) < test_years[k]).alias(f"_n{k}") for k in windows])
    placed = arrange(counts, ["_component"], [nulls_last(F.col("_value"))]).runnings({f"_upto{k}": F.col(f"_n{k}") for k in windows})
    value, whole = F.col("_value"), {}
    for k in windows:
        whole[f"_filled{k}"] = ("sum", F.when(value.isNotNull(), F.col(f"_n{k}")).otherwise(0))
        whole[f"_kinds{k}"] = ("sum", (F.col(f"_n{k}") > 0).cast("int"))  # null is a kind, too
    placed = placed.wholes(whole)

    def score(k: int, reverse: bool) -> Column:
        average = F.col(f"_upto{k}") - (F.col(f"_n{k}") - 1) / F.lit(2.0)
        return _score(value, average, F.nullif(F.col(f"_filled{k}"), F.lit(0)), F.col(f"_kinds{k}") <= 1, reverse)

    of_value = checkpointed(placed.df.select("_component", "_value", *[F.array(*[score(k, r) for k in windows]).alias(f"_{r}".lower()) for r in (False, True)]))
    both = narrow.alias("a").join(of_value.alias("b"), (F.col("a._component") == F.col("b._component")) & F.col("a._value").eqNullSafe(F.col("b._value")))
    found = both.select(*[F.col(f"a.{c}").alias(c) for c in ids], F.col("a._component").alias("_component"), F.struct("_false", "_true").alias("_scores"))
    wide = found.groupBy(*ids).agg(*[F.max(F.when(F.col("_component") == f"_v_{c}", F.col("_scores"))).alias(f"_s_{c}") for c in sources])
    return wide.select(*ids, *[F.col(f"_s_{c}.{'_true' if reverse else '_false'}").alias(name) for name, (c, reverse) in scores.items()])


def average_ranks(df: DataFrame, ranks: Mapping[str, str], unique: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The rows by their key and `unique` columns with ascending average ranks: name -> value column (values must not be null).

    Other columns of `df` are not in the result; all values are ranked in one pass.
    """
    ids = list(dict.fromkeys([*keys, *unique]))
    ranked = _ranked(df, list(dict.fromkeys(ranks.values())), unique, keys)
    return ranked.groupBy(*ids).agg(*[F.max(F.when(F.col("_component") == f"_v_{source}", F.col("_average"))).alias(name) for name, source in ranks.items()])


def medians(df: DataFrame, columns: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Exact medians of all non-null values per key: name -> value. A key without a value has null, no rows give none.

    Equal values are counted first, so a group of few values is small. The counts are summed in order over slices, and the
    values at the two middle places are picked where the sum passes them: no group is ever held in one task.
    """
    slim = df.select(*keys, *[value.cast("double").alias(name) for name, value in columns.items()])
    each = slim.unpivot(list(keys), list(columns), "_column", "_value")
    counts = each.groupBy(*keys, "_column", "_value").agg(F.count("_value").alias("_n"))
    placed = arrange(counts, [*keys, "_column"], [nulls_last(F.col("_value"))])
    placed = placed.running("_upto", "sum", F.col("_n")).wholes({"_total": ("sum", F.col("_n"))})
    at = lambda place: F.max(F.when((F.col("_upto") >= place) & (F.col("_upto") - F.col("_n") < place), F.col("_value")))
    low, high = F.floor((F.col("_total") + 1) / 2), F.floor(F.col("_total") / 2) + 1
    middle = placed.df.groupBy(*keys, "_column").agg((0.5 * at(low) + 0.5 * at(high)).alias("_median"))
    return middle.groupBy(*keys).agg(*[F.max(F.when(F.col("_column") == name, F.col("_median"))).alias(name) for name in columns])


def rank_correlation(left_rank: Column, right_rank: Column) -> Column:
    """Aggregate: Pearson correlation of ranks; 0 for fewer than two rows or a constant side."""
    usable = (
        (F.count(left_rank) >= 2)
        & (F.min(left_rank) < F.max(left_rank))
        & (F.min(right_rank) < F.max(right_rank))
    )
    spread = F.nullif(F.stddev_pop(left_rank) * F.stddev_pop(right_rank), F.lit(0.0))
    return F.when(usable, F.covar_pop(left_rank, right_rank) / spread).otherwise(F.lit(0.0))


def spearman(df: DataFrame, left: str, right: str, unique: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Spearman correlation of two columns per group, over rows where both are known.

    Groups without such a row are kept with 0.
    """
    narrow = df.select(*dict.fromkeys([*keys, *unique, left, right]))
    paired = narrow.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    ranked = average_ranks(paired, {"_left": left, "_right": right}, unique, keys)
    result = ranked.groupBy(*keys).agg(rank_correlation(F.col("_left"), F.col("_right")).alias("spearman"))
    if not keys:
        return result
    return (
        df.select(*keys).distinct().join(result, list(keys), "left").withColumn("spearman", F.coalesce("spearman", F.lit(0.0)))
    )


__all__ = [
    "average_ranks", "expanding_percentile_scores", "medians", "minmax_columns", "minmax_scaled", "percentile_scores", "rank_correlation", "spearman", "with_bounds",
]
