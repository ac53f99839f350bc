"""The physical plans are those meant for large inputs."""

import pytest

from tidemark.operators import sequence
from tidemark.plans import catalog
from tidemark.sources import tables as T


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_no_nested_loops(spark, sf, name):
    text = plan(catalog.queries()[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(T.clock(spark, sf, "click"))
    assert "EqualTo(event_type,click)" in text and "props" not in text.split("ReadSchema")[1]


def test_asof_needs_one_exchange(spark, sf):
    clicks, views = T.clock(spark, sf, "click"), T.clock(spark, sf, "view").withColumnRenamed("us", "prev_us")
    text = plan(sequence.asof(clicks, views, "us", "prev_us", ["series"], ["prev_us"]))
    assert text.count("Exchange hashpartitioning(series") <= 1 and "Join" not in text


def test_ranked_pairs_keep_a_budget_per_side(spark, sf):
    assert "WindowGroupLimit" in plan(catalog.queries()["ranked_pairs"](spark, sf))


def test_no_row_is_repeated_for_each_shift(spark, sf):
    text = plan(catalog.queries()["circular_xcorr"](spark, sf))
    assert "Generate explode(" not in text and "MapInArrow" in text


def test_bars_are_planned_once(spark, sf):
    """What gives the asked bars is one subtree of the plan: 23 scans, not 391, which filled the driver's heap."""
    assert plan(catalog.queries()["required_bars"](spark, sf)).count("FileScan") <= 40


def test_exploded_bars_are_not_broadcast(spark, sf):
    """Bars exploded from a row per series count as its size: they would be sent to the driver, whatever their number."""
    lines = plan(catalog.queries()["required_bars"](spark, sf)).splitlines()
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = lines[k + 1 :]
            ends = [i for i, x in enumerate(below) if any(w in x for w in ("Exchange", "Join", "Aggregate", "Window", "Scan"))]
            assert not any("explode(sequence(0," in x for x in below[: ends[0]])
