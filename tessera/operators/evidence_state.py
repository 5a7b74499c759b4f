"""Evidence sums as a state that rolls on: a new generation is an addition, a later target month a multiplication.

Decay is exponential, so sums kept relative to a fixed base month hold for every target: 2^((month - base) / half-life) is
summed once, and a target multiplies by 2^(-(target - base) / half-life).  Rows dated after the state's horizon don't
count for targets before them; they stay apart by month until a target reaches them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.scoring import ScoringConfig, attributed_marks, frequency_window

_SUMS = ("exam_score", "practice_score", "exam_marks_total", "exam_count", "practice_count")


def _growth(months: Column, half_life: float) -> Column:
    return F.pow(F.lit(2.0), months.cast("double") / half_life) if half_life > 0 else F.lit(1.0)


def evidence(tags: DataFrame, config: ScoringConfig, base: int, horizon: int) -> DataFrame:
    """The state of one generation's tags: a row per paper and leaf, and one per month after the horizon.

    ``tags``: paper, leaf, signal, month (a month's index), attempt, marks, share, cross_paper, stale.
    """
    marks = attributed_marks(F.col("marks"), F.col("share"), F.col("cross_paper"), F.col("stale"), config)
    exam, practice = F.col("signal") == "exam", F.col("signal") == "practice"
    plain = F.coalesce(F.col("marks").cast("double"), F.lit(0.0)) * F.col("share")
    since = F.col("month") - base
    later = F.when(F.col("month") > horizon, F.col("month")).cast("int")
    return tags.groupBy("paper", "leaf", later.alias("later")).agg(
        F.sum(F.when(exam, marks * _growth(since, config.half_life_exam)).otherwise(0.0)).alias("exam_score"),
        F.sum(F.when(practice, marks * _growth(since, config.half_life_practice)).otherwise(0.0)).alias("practice_score"),
        F.sum(F.when(exam, plain).otherwise(0.0)).alias("exam_marks_total"),
        F.count_if(exam).alias("exam_count"),
        F.count_if(practice).alias("practice_count"),
        F.collect_set(F.when(exam, F.col("attempt"))).alias("exam_attempts"),  # at most one a month
    )


def rolled(state: DataFrame, more: DataFrame) -> DataFrame:
    """Two states of one base and horizon as one; each generation must come once (see ``sources.sinks`` for guarded runs)."""
    attempts = F.array_distinct(F.flatten(F.collect_list("exam_attempts")))
    return state.unionByName(more).groupBy("paper", "leaf", "later").agg(*(F.sum(c).alias(c) for c in _SUMS), attempts.alias("exam_attempts"))


def until(state: DataFrame, target: int) -> DataFrame:
    """The state's rows that count for a target month."""
    return state.where(F.col("later").isNull() | (F.col("later") <= target))


def at(state: DataFrame, config: ScoringConfig, base: int, horizon: int, target: int) -> DataFrame:
    """Evidence sums for a target month not before the horizon, as ``scoring.contributions`` has them."""
    if target < horizon:
        raise ValueError(f"the state holds evidence up to {horizon}, after the target {target}")
    shrink = {"exam_score": _growth(F.lit(base - target), config.half_life_exam), "practice_score": _growth(F.lit(base - target), config.half_life_practice)}
    attempts = F.array_distinct(F.flatten(F.collect_list("exam_attempts")))
    sums = until(state, target).groupBy("paper", "leaf").agg(*(F.sum(c).alias(c) for c in _SUMS), attempts.alias("exam_attempts"))
    return sums.withColumns({c: F.col(c) * by for c, by in shrink.items()} | {"first_exam_attempt": F.array_min("exam_attempts"), "last_exam_attempt": F.array_max("exam_attempts")})


def window_of(sums: DataFrame, n: int) -> DataFrame:
    """The last ``n`` exam attempts of each paper, from the sums' own attempts."""
    return frequency_window(sums.select("paper", F.explode("exam_attempts").alias("attempt")).distinct(), n)
