"""The driver contract, a sample of the SQL checks, and the shape of the plans."""

import pytest
from harness import compare, duck

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "t_bars_daily", "w01_sma", "w05_macd", "w10_obv", "w16_indicator_snapshot", "j15_asof_backward", "j17_price_window", "c16_des_scores",
    "a09_des_with_peers", "c03_novelty", "c14_theme_leaders", "p14_decisions", "c05_signal_outcomes", "c06_one_position", "a11_run_metrics",
    "c09_horizon_outcomes", "a01_calendar", "j06_verdict_queue", "w25_as_of_records", "t02_dedup_stream", "t03_monotone_gate_stream",
]


def test_every_check_belongs_to_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert len(entry_module.queries()) > 120


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    ok, n, _, _, msg = compare(spark, duck(SF), name, entry_module.queries()[name], entry_module.oracle_sql()[name], SF)
    assert ok, msg
    assert n > 0


@pytest.mark.parametrize("name", ["w17_indicator_series", "c01_technical_snapshot", "j15_asof_backward", "j17_price_window", "c16_des_scores", "j20_evidence_scores", "c03_novelty", "p14_decisions"])
def test_plans_have_no_cartesian_product_or_python_rows(spark, name):
    plan = entry_module.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan


def test_scans_read_only_needed_columns(spark):
    plan = entry_module.queries()["w12_trend_strength"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in plan and "l_discount" not in plan
