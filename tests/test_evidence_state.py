"""The rolled evidence state equals a full recompute, for any split into generations and any later target."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import evidence_state as V
from tessera.operators import scoring as S

CONFIG, BASE, HORIZON = S.ScoringConfig(), 24_000, 24_010
TAGS = "paper string, leaf long, signal string, month int, attempt string, marks double, share double, cross_paper boolean, stale boolean, generation int"


@pytest.fixture(scope="module")
def tags(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(400):
        month = rng.randint(23_980, 24_020)
        rows.append((rng.choice("PQ"), rng.randint(1, 9), rng.choice(["exam", "practice"]), month, f"{(month - 1) // 12}-{(month - 1) % 12 + 1:02}", rng.choice([None, 4.0, 10.0]), rng.choice([1.0, 0.5]), rng.random() < 0.3, rng.random() < 0.3, rng.randint(0, 2)))
    return spark.createDataFrame(rows, TAGS)


def plain(rows):
    out = {}
    for r in rows.collect():
        attempts = sorted(r["exam_attempts"])
        out[r["paper"], r["leaf"]] = (*(round(r[c], 9) for c in ("exam_score", "practice_score", "exam_marks_total", "exam_count", "practice_count")), r["first_exam_attempt"], r["last_exam_attempt"], attempts)
    return out


@pytest.mark.parametrize("target", [24_010, 24_013, 24_030])
def test_rolled_state_equals_recompute(tags, target):
    parts = [V.evidence(tags.where(F.col("generation") == g), CONFIG, BASE, HORIZON) for g in range(3)]
    got = plain(V.at(V.rolled(parts[2], V.rolled(parts[0], parts[1])), CONFIG, BASE, HORIZON, target))
    assert got == plain(S.contributions(tags.withColumn("age", target - F.col("month")), CONFIG))


def test_a_target_before_the_horizon_is_refused(tags):
    with pytest.raises(ValueError):
        V.at(V.evidence(tags, CONFIG, BASE, HORIZON), CONFIG, BASE, HORIZON, HORIZON - 1)


def test_no_half_life_means_no_decay(spark, tags):
    config = S.ScoringConfig(half_life_exam=0.0)
    got = plain(V.at(V.evidence(tags, config, BASE, HORIZON), config, BASE, HORIZON, 24_020))
    assert got == plain(S.contributions(tags.withColumn("age", 24_020 - F.col("month")), config))


def test_windows_come_from_the_sums(spark):
    sums = spark.createDataFrame([("P", 1, ["2020-01", "2020-03"]), ("P", 2, ["2020-02", "2020-03"]), ("Q", 3, [])], "paper string, leaf long, exam_attempts array<string>")
    assert {tuple(r) for r in V.window_of(sums, 2).collect()} == {("P", "2020-03"), ("P", "2020-02")}
