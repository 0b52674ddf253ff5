"""Sliced scans, skewed joins, ranks and overlap groups against plain Python."""

import random
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from echelon.operators import ranking, spread
from echelon.operators.team_calendar import with_overlap_groups


def hot_rows(n=300, seed=3):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.5 else f"k{rng.randrange(20)}", i, rng.choice([None, *range(15)])) for i in range(n)]


def pandas_percentile(values, reverse):
    if values.nunique(dropna=False) <= 1:
        return pd.Series(50.0, index=values.index)
    ranked = values.rank(method="average", pct=True) * 100
    return 100 - ranked if reverse else ranked


def test_running_and_whole_values(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, i int, v int")
    placed = spread.arrange(df, ["k"], [F.col("i")])
    assert placed.df.select("_slice").distinct().count() > 2
    out = (
        placed.running("s", "sum", F.col("v")).running("m", "max", F.col("v"), inclusive=False).whole("t", "sum", F.lit(1)).done().toPandas()
    )
    pdf = pd.DataFrame(rows, columns=["k", "i", "v"]).sort_values(["k", "i"])
    expected = pdf.assign(
        s=pdf.groupby("k").v.transform(lambda v: v.fillna(0).cumsum()),
        m=pdf.groupby("k").v.transform(lambda v: v.cummax().ffill().shift()),
        t=pdf.groupby("k").i.transform("size"),
    )
    out = out.sort_values(["k", "i"]).reset_index(drop=True)
    expected = expected.reset_index(drop=True)
    assert out.s.tolist() == expected.s.tolist()
    assert out.t.tolist() == expected.t.tolist()
    np.testing.assert_array_equal(out.m.astype(float), expected.m.astype(float))


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_percentiles_match_pandas(spark, keys):
    rows = hot_rows()
    pdf = pd.DataFrame(rows, columns=["k", "i", "v"]).assign(w=7.0, n=np.nan)
    df = spark.createDataFrame([(k, i, v, 7.0, None) for k, i, v in rows], "k string, i int, v int, w double, n double")
    scores = {"a": ("v", False), "b": ("v", True), "c": ("w", True), "d": ("n", True)}
    out = ranking.percentile_scores(df, scores, ["i"], keys).toPandas().set_index("i").sort_index()
    pdf = pdf.set_index("i").sort_index()
    for name, (column, reverse) in scores.items():
        if keys:
            wanted = pd.concat([pandas_percentile(g[column], reverse) for _, g in pdf.groupby("k")]).sort_index()
        else:
            wanted = pandas_percentile(pdf[column], reverse)
        np.testing.assert_allclose(out[name].astype(float), wanted.astype(float), atol=1e-9)


def test_percentiles_average_without_nulls(spark):
    df = spark.range(40).select("id", (F.col("id") % 13).alias("v"))
    out = ranking.percentile_scores(df, {"p": ("v", False)}, ["id"])
    assert out.agg(F.avg("p")).first()[0] == pytest.approx(50 + 50 / 40)


def test_skewed_join_keeps_every_row(spark):
    left = spark.createDataFrame(hot_rows() + [(None, 1000 + i, i) for i in range(60)], "k string, i int, v int")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("zz", 3)], "k string, r int")
    joined = spread.skew_join(left, right, ["k"])
    plain = left.join(right, ["k"], "left")
    assert sorted(map(str, joined.select("k", "i", "v", "r").collect())) == sorted(map(str, plain.select("k", "i", "v", "r").collect()))


def test_one_key_is_dealt_to_many_tasks(spark, tmp_path):
    """Small compressed files with very many rows of one key: what matters is rows, and no switch looks at bytes."""
    spark.range(2_000_000).select(F.lit("hot").alias("k"), F.col("id").alias("i"), F.lit(1).alias("v")).write.parquet(str(tmp_path / "rows"))
    placed = spread.arrange(spark.read.parquet(str(tmp_path / "rows")), ["k"], [F.col("i")]).running("s", "sum", F.col("v"))
    sizes = [r["count"] for r in placed.df.groupBy("_slice").count().collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 1_000_000
    assert placed.df.where("s != i + 1").isEmpty()


def test_hot_groups_are_limited_before_the_shuffle(spark):
    df = spark.createDataFrame(hot_rows(), "k string, i int, v int")
    top = spread.top_rows(df, ["k"], [F.desc("i")], 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert top.groupBy("k").count().agg(F.max("count")).first()[0] == 3


def loop_overlaps(rows):
    """Group sizes by the plain loop: rows are (id, start, end)."""
    last = date(9999, 1, 1)
    ordered = sorted(rows, key=lambda r: (r[1] is None, r[1] or last, r[2] is None, r[2] or last, r[0]))
    groups, group, until = [], 0, None
    for _, start, end in ordered:
        if start is None or end is None or until is None or start > until:
            group, until = group + 1, end
        else:
            until = max(until, end)
        groups.append(group)
    sizes = pd.Series(groups).map(pd.Series(groups).value_counts())
    return {r[0]: "" if s <= 1 else f"overlap_{s}" for r, s in zip(ordered, sizes)}


def test_overlap_groups_match_the_loop(spark):
    rng = random.Random(5)
    teams = {}
    for i in range(400):
        team = "hot" if rng.random() < 0.5 else f"t{rng.randrange(6)}"
        start = date(2026, 1, 1) + timedelta(days=rng.randrange(365)) if rng.random() > 0.05 else None
        end = start + timedelta(days=rng.randrange(6)) if start and rng.random() > 0.05 else None
        teams.setdefault(team, []).append((i, start, end))
    rows = [(t, 2026, *r) for t, rs in teams.items() for r in rs]
    df = spark.createDataFrame(rows, "team_slug string, planning_year int, race_id int, start_date date, end_date date")
    got = {r.race_id: r.overlap_group for r in with_overlap_groups(df).collect()}
    wanted = {}
    for rs in teams.values():
        wanted.update(loop_overlaps(rs))
    assert got == wanted


def test_spearman(spark):
    rows = [("up", i, 10.0 * i, float(i)) for i in range(4)] + [("down", i, 10.0 * i, -float(i)) for i in range(4)]
    rows += [("flat", i, 10.0 * i, 1.0) for i in range(4)] + [("short", 0, 1.0, 2.0), ("null", 0, 1.0, None), ("null", 1, None, 1.0)]
    df = spark.createDataFrame(rows, "g string, i int, a double, b double")
    got = {r.g: r.spearman for r in ranking.spearman(df, "a", "b", ["i"], ["g"]).collect()}
    assert got == {"up": pytest.approx(1), "down": pytest.approx(-1), "flat": 0, "short": 0, "null": 0}


def test_minmax_of_constant_and_missing_columns(spark):
    df = spark.createDataFrame([(1, 5.0, 5.0, None, 1.0), (2, 5.0, None, None, 3.0), (3, 5.0, 5.0, None, None)], "i int, a double, b double, c double, d double")
    out = ranking.minmax_columns(df, {f"{c}_{int(inv)}": (c, inv) for c in "abcd" for inv in (False, True)}).orderBy("i").collect()
    take = lambda name: [r[name] for r in out]
    assert take("a_0") == [1, 1, 1] and take("a_1") == [0, 0, 0]
    assert take("b_0") == [1, 0, 1] and take("b_1") == [0, 1, 0]
    assert take("c_0") == [0, 0, 0] and take("c_1") == [0, 0, 0]
    assert take("d_0") == [0, 1, 0] and take("d_1") == [1, 0, 0]


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_medians_match_pandas(spark, keys):
    rows = hot_rows() + [("none", 5000, None)]
    pdf = pd.DataFrame(rows, columns=["k", "i", "v"])
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = ranking.medians(df, {"v": F.col("v"), "w": F.col("i") % 3, "z": F.lit(None).cast("double")}, keys).toPandas()
    pdf["w"] = pdf.i % 3
    if not keys:
        assert got.v.tolist() == [pdf.v.median()] and got.w.tolist() == [pdf.w.median()] and got.z.isna().all()
        return
    wanted = pdf.groupby("k")[["v", "w"]].median()
    got = got.set_index("k")
    assert sorted(got.index) == sorted(wanted.index) and got.z.isna().all()
    for name in ("v", "w"):
        np.testing.assert_array_equal(got[name].loc[wanted.index].astype(float), wanted[name].astype(float))


def test_average_ranks_of_several_columns(spark):
    rows = hot_rows()
    pdf = pd.DataFrame(rows, columns=["k", "i", "v"]).dropna()
    pdf["w"] = -pdf.i % 7
    df = spark.createDataFrame([(k, i, int(v), -i % 7) for k, i, v in rows if v is not None], "k string, i int, v int, w int")
    got = ranking.average_ranks(df, {"a": "v", "b": "w"}, ["i"], ["k"]).toPandas().set_index("i").sort_index()
    pdf = pdf.set_index("i").sort_index()
    assert got.a.tolist() == pdf.groupby("k").v.rank().tolist() and got.b.tolist() == pdf.groupby("k").w.rank().tolist()


def test_percentiles_in_expanding_windows(spark):
    """Against the plain percentiles of the rows before each test year; nulls, ties, a constant and an empty window."""
    rows = [(k, i, v, 2000 + i % 6) for k, i, v in hot_rows()]
    df = spark.createDataFrame([(i, y, v, 7.0, None) for _, i, v, y in rows], "i int, year int, v int, w double, n double")
    scores = {"a": ("v", False), "b": ("v", True), "c": ("w", True), "d": ("n", False)}
    years = [1999, 2001, 2003, 2004, 2009]
    got = ranking.expanding_percentile_scores(df, scores, ["i"], "year", years).toPandas().set_index("i")
    pdf = pd.DataFrame([(i, y, v) for _, i, v, y in rows], columns=["i", "year", "v"]).assign(w=7.0, n=np.nan).set_index("i")
    assert len(got) == len(pdf)
    for k, year in enumerate(years):
        window = pdf[pdf.year < year].sort_index()
        for name, (column, reverse) in scores.items():
            found = got.loc[window.index, name].map(lambda values, k=k: values[k])
            np.testing.assert_allclose(found.astype(float), pandas_percentile(window[column], reverse).astype(float), atol=1e-9)
