"""What the plans read and where they put one key."""

from driver import adapters as ad

FOLDER = "/root/testdata/sf0.001"


def test_line_items_are_read_twice_for_all_lists(spark, monkeypatch):
    monkeypatch.setattr(ad, "checkpointed", lambda df: df)
    plan = ad.list_summaries(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and "WindowGroupLimit" in plan and "partial_sum" in plan


def test_no_plan_looks_at_sizes():
    import inspect

    from echelon.operators import ranking, spread

    source = inspect.getsource(spread) + inspect.getsource(ranking)
    assert "sizeInBytes" not in source and "rowsPerTask" not in source
