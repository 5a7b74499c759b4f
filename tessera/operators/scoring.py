"""Time-decayed, share-weighted scoring of topics: column formulas and the plans built from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ScoringConfig:
    """Fixed defaults of the scoring model."""

    half_life_exam: float = 24.0
    half_life_practice: float = 12.0
    cross_paper_factor: float = 0.5
    stale_factor: float = 0.5
    window_attempts: int = 5
    weak_min_hits: int = 3
    weight_exam: float = 0.6
    weight_practice: float = 0.2
    weight_prior: float = 0.2
    per_chapter_cap: int = 3
    weak_boost: float = 0.25
    in_progress_boost: float = 0.10


def month_index(year: Column, month: Column) -> Column:
    return year * 12 + month


def decay(age: Column, half_life: float) -> Column:
    """2^(-age / half_life); 1 where the half-life isn't positive."""
    return F.pow(F.lit(2.0), -age.cast("double") / half_life) if half_life > 0 else F.lit(1.0)


def attributed_marks(marks: Column, share: Column, cross_paper: Column, stale: Column, config: ScoringConfig) -> Column:
    """marks x share x cross-paper factor x stale-law factor; null marks count as 0."""
    kappa = F.when(cross_paper, config.cross_paper_factor).otherwise(1.0)
    lam = F.when(stale, config.stale_factor).otherwise(1.0)
    return F.coalesce(marks.cast("double"), F.lit(0.0)) * share * kappa * lam


def normalised(value: Column, paper: str) -> Column:
    """Value over its paper's maximum, 0 where that isn't positive."""
    top = F.max(value).over(Window.partitionBy(paper))
    return F.when(top > 0, value / top).otherwise(0.0)


def component(value: Column, top: Column, available: Column) -> Column:
    """A nullable component: null where unavailable, 0 of a non-positive maximum."""
    return F.when(available, F.when(top > 0, value / top).otherwise(0.0))


def contributions(tags: DataFrame, config: ScoringConfig) -> DataFrame:
    """Evidence sums by leaf in one partial-then-final aggregation.

    ``tags``: leaf, paper, signal (exam or practice), age (months), attempt, marks, share, cross_paper, stale.
    Rows later than the target (age < 0) are ignored.
    """
    marks = attributed_marks(F.col("marks"), F.col("share"), F.col("cross_paper"), F.col("stale"), config)
    exam, practice = F.col("signal") == "exam", F.col("signal") == "practice"
    plain = F.coalesce(F.col("marks").cast("double"), F.lit(0.0)) * F.col("share")
    return tags.where("age >= 0").groupBy("paper", "leaf").agg(
        F.sum(F.when(exam, marks * decay(F.col("age"), config.half_life_exam)).otherwise(0.0)).alias("exam_score"),
        F.sum(F.when(practice, marks * decay(F.col("age"), config.half_life_practice)).otherwise(0.0)).alias("practice_score"),
        F.sum(F.when(exam, plain).otherwise(0.0)).alias("exam_marks_total"),
        F.count_if(exam).alias("exam_count"),
        F.count_if(practice).alias("practice_count"),
        F.min(F.when(exam, F.col("attempt"))).alias("first_exam_attempt"),
        F.max(F.when(exam, F.col("attempt"))).alias("last_exam_attempt"),
        F.collect_set(F.when(exam, F.col("attempt"))).alias("exam_attempts"),  # at most one a month
    )


def frequency_window(coverage: DataFrame, n: int) -> DataFrame:
    """The last ``n`` attempts of each paper: ``coverage`` is (paper, attempt), distinct, not after the target."""
    latest = F.row_number().over(Window.partitionBy("paper").orderBy(F.desc("attempt")))
    return coverage.withColumn("place", latest).where(F.col("place") <= n).drop("place")


def frequency_hits(seen: DataFrame, window: DataFrame) -> DataFrame:
    """(paper, leaf, freq_hits): how many attempts of the paper's window a leaf appears in."""
    return seen.join(window, ["paper", "attempt"]).groupBy("paper", "leaf").agg(F.count_distinct("attempt").alias("freq_hits"))


def with_frequency(leaves: DataFrame, window: DataFrame) -> DataFrame:
    """``leaves`` (paper, exam_attempts) with freq_hits and freq_window, without another pass over the facts."""
    by_paper = window.groupBy("paper").agg(F.collect_list("attempt").alias("__window"))
    rows = leaves.join(by_paper, "paper", "left").withColumn("__window", F.coalesce("__window", F.array().cast("array<string>")))
    attempts = F.coalesce("exam_attempts", F.array().cast("array<string>"))
    hits = F.size(F.array_intersect(attempts, "__window")).cast("long")
    return rows.withColumn("freq_hits", hits).withColumn("freq_window", F.size("__window").cast("long")).drop("__window")


def section_prior(leaves: DataFrame, sections: DataFrame) -> DataFrame:
    """``leaves`` (paper, section, leaf, applicable) with weight_prior: the section's midpoint marks over its applicable leaves."""
    n = F.count_if("applicable").over(Window.partitionBy("section"))
    rows = leaves.withColumn("n", n).join(sections, "section", "left")
    midpoint = (F.col("min_pct") + F.col("max_pct")) / 2.0 / 100.0 * F.col("paper_max")
    return rows.withColumn("weight_prior", F.when(F.col("applicable") & midpoint.isNotNull(), midpoint / F.col("n")).otherwise(0.0)).drop("n", "min_pct", "max_pct", "paper_max")


def importance(scores: DataFrame, config: ScoringConfig) -> DataFrame:
    """Max-normalised weighted sum per paper over applicable leaves; 0 for the others.

    Papers' maxima are a row a paper, joined back: no window puts a paper's leaves in one task.
    """
    parts = {"exam_score": config.weight_exam, "practice_score": config.weight_practice, "weight_prior": config.weight_prior}
    tops = scores.where("applicable").groupBy("paper").agg(*(F.max(c).alias(f"__{c}") for c in parts))
    total = sum((w * F.when(F.col(f"__{c}") > 0, F.col(c) / F.col(f"__{c}")).otherwise(0.0) for c, w in parts.items()), F.lit(0.0))
    rows = scores.join(tops, "paper", "left").withColumn("importance", F.when(F.col("applicable"), total).otherwise(0.0))
    return rows.select(*scores.columns, "importance")


def weak(hits: Column, window: Column, status: Column, applicable: Column, config: ScoringConfig) -> Column:
    """Applicable, often asked over a full window, and not started."""
    return applicable & (hits >= config.weak_min_hits) & (window >= config.window_attempts) & (status == "not_started")
