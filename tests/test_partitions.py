"""Tasks of queries over lines keep their size: partitions grow with the files, and no paper's leaves meet in one task."""

import re

import pytest

from tessera.operators import evidence_state as V
from tessera.plans import model as M
from tessera.plans import scoring, validation
from tessera.sources import tables


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", [scoring.a03_rows_and_occurrences, validation.q17_validation_issues])
def test_partitions_grow_with_the_files(spark, sf_dir, monkeypatch, query):
    monkeypatch.setattr(tables, "PARTITION_BYTES", 4096)
    n = tables.partitions(spark, sf_dir, "lineitem")
    assert n > int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = [int(c) for c in re.findall(r"hashpartitioning\([^\n]*?, (\d+)\)", _plan(query(spark, sf_dir)))]
    assert counts and min(counts) >= n


def test_explanations_need_no_window(spark, sf_dir):
    assert "Window" not in _plan(scoring.q09_why(spark, sf_dir))


def test_an_order_s_attempt_is_formed_once(spark, sf_dir):
    plan = M.tags(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[plan.index("date_format") :]  # below both joins


def test_a_state_s_rows_have_the_attempts_of_its_sums(spark, sf_dir):
    rows = scoring.state(spark, sf_dir)
    for target in (M.TARGET, M.TARGET - 6):
        sums = V.at(rows, scoring.CONFIG, scoring.BASE, scoring.HORIZON, target)
        want, got = (sorted(tuple(r) for r in V.window_of(x, 5).select("paper", "attempt").collect()) for x in (sums, V.until(rows, target)))
        assert got == want and got
