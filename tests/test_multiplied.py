"""Rows that are multiplied."""

from pyspark.sql import functions as F

from echelon.operators import backtest


def test_fold_rows_are_dealt_out_before_they_meet_the_candidates(spark, monkeypatch):
    """Few bytes of folds were one task, which then made the rows of all candidates."""
    scores = {name: (F.col("id") * (i + 3) % 17).cast("double") for i, name in enumerate(backtest.COMPONENT_SCORES.values())}
    folds = spark.range(200).select(
        (F.lit(2000) + F.col("id") % 3).cast("int").alias("test_year"), F.col("id").cast("string").alias("target_history_id"), F.lit(5).cast("long").alias("top_k"),
        F.lit(67).cast("long").alias("races_compared"), (F.col("id") * 7 % 31).cast("double").alias("actual_points_efficiency"), *[value.alias(name) for name, value in scores.items()],
    )
    parts, arrange = [], backtest.arrange

    def watched(df, keys, *rest, **more):
        if "candidate_id" in keys:
            parts.append(df.rdd.glom().map(len).collect())
        return arrange(df, keys, *rest, **more)

    monkeypatch.setattr(backtest, "arrange", watched)
    scored = backtest.scored_folds(folds, backtest.distinct_candidates(backtest.weight_candidates(0)))
    assert len(parts[0]) == 4 and max(parts[0]) < sum(parts[0]) / 2
    assert scored.count() == sum(parts[0])
