"""Gates of publication and review as rule tables: each rule is a code and a condition, evaluated over joined rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Issue codes by the quality dimension that they concern, and dimensions that a published revision passes.
CONCERNS = {
    "questions": ("empty_extraction", "missing_question_parts", "V5_UNIT_EMPTY", "V6_MCQ_OPTIONS_MISSING"),
    "answers": ("V4_MISSING_ANSWER", "V4_MISSING_ANSWERS_ERROR", "V4_AMBIGUOUS_ANSWER", "V6_MCQ_KEY_MISSING"),
    "ordering": ("AMBIGUOUS_REPEATED_LABEL", "V1_QUESTION_GAP", "V1_PART_GAP", "V7_PAGE_SPAN_INVALID"),
}
DIMENSIONS = ("metadata", "questions", "answers", "pairing", "ordering", "marks_choices", "readability", "human_review")
UNDATED = ("model_question", "model_answer", "case_scenarios", "ibs_case_study")
DATED = ("mtp_question", "mtp_answer", "rtp", "question_paper", "suggested_answer")
LEVELS = ("Foundation", "Intermediate", "Final")


def codes(rules: list[tuple[str, Column]]) -> Column:
    """The codes of the rules that hold, in the rules' order; an unknown condition doesn't hold."""
    return F.filter(F.array(*(F.when(holds, F.lit(code)) for code, holds in rules)), lambda c: c.isNotNull())


def blockers(rules: list[tuple[str, Column, bool]]) -> Column:
    """struct(blockers: sorted distinct codes, stale: whether a rule that marks stale evidence holds, eligible: no rule holds)."""
    found = F.array_sort(F.array_distinct(codes([(code, holds) for code, holds, _ in rules])))
    stale = F.size(codes([(code, holds) for code, holds, marks in rules if marks])) > 0
    return F.struct(found.alias("blockers"), stale.alias("stale"), (F.size(found) == 0).alias("eligible"))


def publication_exclusions(status: Column, mappings: Column, allocations: Column, issues: Column) -> Column:
    """Why a publication isn't counted: unfinished, a label open and not excluded, or marks not all reviewed.

    ``mappings``: array of (outcome, excluded); ``allocations``: of (allocation_status, marks); ``issues``: array, any counts.
    """
    return codes([
        ("question_scope_incomplete", status != "complete"),
        ("labels_unresolved_without_explicit_exclusion", F.exists(mappings, lambda m: (m["outcome"] != "matched") & ~m["excluded"])),
        ("marks_allocation_unresolved", (F.size(allocations) == 0) | (F.size(issues) > 0) | ~F.forall(allocations, lambda a: (a["allocation_status"] == "reviewed") & a["marks"].isNotNull())),
    ])


def quality_dimensions(issues: Column, confirmed: Column, role: Column, expects_answers: Column, scanned: Column) -> Column:
    """struct of the eight dimensions: passed, concern, pending or not_applicable, from an extraction's issue codes."""
    hit = lambda name: F.arrays_overlap(issues, F.array(*map(F.lit, CONCERNS[name])))
    concern = lambda holds: F.when(holds, "concern").otherwise("pending")
    answers = F.when(expects_answers, concern(hit("answers"))).otherwise("not_applicable")
    values = {
        "metadata": F.when(confirmed, "passed").otherwise("pending"),
        "questions": F.when(role == "answers", "not_applicable").otherwise(concern(hit("questions"))),
        "answers": answers,
        "pairing": answers,
        "ordering": concern(hit("ordering")),
        "marks_choices": concern(F.exists(issues, lambda c: c.rlike("^V[23]_"))),
        "readability": concern(scanned),
        "human_review": F.lit("pending"),
    }
    return F.struct(*(values[d].alias(d) for d in DIMENSIONS))


def overlaid(quality: Column, reviews: Column) -> Column:
    """``quality`` with each dimension that ``reviews`` (a map of dimension to outcome) names replaced."""
    return F.struct(*(F.coalesce(reviews[d], quality[d]).alias(d) for d in DIMENSIONS))


def unready(quality: Column) -> Column:
    """Dimensions that are neither passed nor not applicable, prefixed as blocker codes."""
    return codes([(f"extraction_{d}", ~F.coalesce(quality[d].isin("passed", "not_applicable"), F.lit(False))) for d in DIMENSIONS])


def route(level: Column, kind: Column, attempt: Column) -> Column:
    """final_queue or outside_corpus; an unknown level or kind, or a dated kind without its attempt, is an error code."""
    wrong = F.when(~level.isin(*LEVELS) | level.isNull(), "error_level").when(~kind.isin(*UNDATED, *DATED) | kind.isNull(), "error_type").when(attempt.isNull() & kind.isin(*DATED), "error_attempt")
    return F.coalesce(wrong, F.when(level == "Final", "final_queue").otherwise("outside_corpus"))


def editions(expected: DataFrame, sections: DataFrame, target: str, fallback: str = "2026-01", strict: bool = True) -> DataFrame:
    """(section_key, section_id, is_fallback, reason) of every expected section.

    ``sections``: section_key, section_id, verified, attempts (array).  Verified material of the target attempt comes
    first, then that of ``fallback``; several of the better kind are ambiguous: an error, or where not ``strict`` a reason instead of a section.
    """
    rows = sections.where("verified").select("section_key", "section_id", F.when(F.array_contains("attempts", target), 0).when(F.array_contains("attempts", fallback), 1).alias("rank")).where("rank is not null")
    best = rows.groupBy("section_key").agg(F.min("rank").alias("rank"), F.min(F.struct("rank", "section_id"))["section_id"].alias("section_id"), F.count_if(F.col("rank") == 0).alias("n0"), F.count_if(F.col("rank") == 1).alias("n1"))
    several = F.when(F.col("rank") == 0, F.col("n0")).otherwise(F.col("n1")) > 1
    if strict:
        best = best.withColumn("rank", F.when(several, F.raise_error(F.concat(F.lit("ambiguous edition of "), "section_key")).cast("int")).otherwise(F.col("rank")))
    best = best.select("section_key", F.when(~several, F.col("section_id")).alias("section_id"), "rank", several.alias("several"))
    found = expected.join(best, "section_key", "left")
    reason = F.when(F.col("several"), "ambiguous edition").when(F.col("section_id").isNull(), "no verified section")
    return found.select("section_key", "section_id", F.coalesce(F.col("rank") == 1, F.lit(False)).alias("is_fallback"), reason.alias("reason"))


def first_rule(text: Column, bold: Column, x: Column, rules: list[tuple[str, str, bool, float | None, float | None]]) -> Column:
    """The name of the first rule (name, pattern, needs bold, least and most x) that a line meets, or null."""
    out = None
    for name, pattern, needs_bold, low, high in rules:
        holds = text.rlike(pattern) & (bold if needs_bold else F.lit(True)) & (x >= low if low is not None else F.lit(True)) & (x <= high if high is not None else F.lit(True))
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return out if out is not None else F.lit(None).cast("string")


def boosted(base: Column, text: Column, keywords: Column, anchors: Column, keyword_points: float, anchor_points: float) -> Column:
    """A candidate's score: ``base``, points for every keyword the text contains and for the weights of its anchors (array)."""
    hits = F.size(F.filter(keywords, lambda k: F.contains(F.lower(text), F.lower(k))))
    return base + hits * F.lit(keyword_points) + F.aggregate(anchors, F.lit(0.0), lambda a, w: a + w) * F.lit(anchor_points)


def with_runner_up(scored: DataFrame, keys: list[str], order: list[str], share: float = 0.85) -> DataFrame:
    """The best candidate of each key, and the second if its score is ``share`` of the best's or more."""
    by = Window.partitionBy(*keys).orderBy(F.desc("score"), *order)
    placed = scored.withColumn("place", F.row_number().over(by)).where("place <= 2")
    best = F.max("score").over(Window.partitionBy(*keys))
    return placed.withColumn("best", best).where((F.col("place") == 1) | (F.col("score") >= share * F.col("best"))).drop("best")


def search_text(*parts: Column) -> Column:
    """All parts, strings or arrays of them, joined by blanks; nulls are left out."""
    return F.concat_ws(" ", *parts)


def conflicts(fields: list[tuple[str, Column, Column]]) -> Column:
    """Names of fields whose hint and observed value are both known and differ."""
    return codes([(name, hint.isNotNull() & seen.isNotNull() & (hint != seen)) for name, hint, seen in fields])


def page_of(rows: DataFrame, order: list, page: int, size: int, most: int = 100) -> DataFrame:
    """One page of already filtered rows; arguments out of bounds raise ValueError."""
    if page < 1 or not 1 <= size <= most:
        raise ValueError(f"page from 1, size from 1 to {most}")
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)
