"""Validation of extracted units, of label mappings and of imported results: rules as column expressions and joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.gates import codes

#: Issue codes that send a document to review; the others only warn.
ERRORS = ("V1_QUESTION_GAP", "V2_MISSING_MARKS", "V3_TOTAL_MARKS_MISMATCH", "V4_AMBIGUOUS_ANSWER", "V4_MISSING_ANSWERS_ERROR", "V5_UNIT_EMPTY", "V5_UNIT_TOO_LONG", "V7_PAGE_SPAN_INVALID")


@dataclass(frozen=True)
class Bounds:
    """Limits of a unit's text, of a multiple-choice unit's options and of the share of units without an answer."""

    shortest: int = 15
    longest: int = 15000
    options: int = 4
    unanswered: float = 0.10


def unit_issues(units: DataFrame, bounds: Bounds = Bounds(), answered: bool = True) -> DataFrame:
    """(document, unit, code) of every broken rule; unit is null where the rule concerns the whole document.

    ``units``: document, scope, unit, number, gradable, marks, chars, mcq, options, has_key, answer (found, ambiguous or null),
    first_page, last_page.  Null numbers aren't part of a sequence; a null condition breaks no rule.  Numbers of a scope run from
    1 without gaps.  ``answered``: whether the document comes with answers at all.
    """
    here, chars = F.col("gradable"), F.col("chars")
    own = [
        ("V2_MISSING_MARKS", here & F.col("marks").isNull()),
        ("V5_UNIT_EMPTY", here & (chars == 0)),
        ("V5_UNIT_TOO_SHORT", here & (chars > 0) & (chars < bounds.shortest)),
        ("V5_UNIT_TOO_LONG", chars > bounds.longest),
        ("V6_MCQ_OPTIONS_MISSING", F.col("mcq") & (F.coalesce("options", F.lit(0)) < bounds.options)),
        ("V7_PAGE_SPAN_INVALID", F.col("first_page") > F.col("last_page")),
    ]
    unpaired = here & ~F.coalesce(F.col("answer") == "found", F.lit(False))
    if answered:
        own += [("V4_AMBIGUOUS_ANSWER", here & (F.col("answer") == "ambiguous")), ("V4_MISSING_ANSWER", unpaired), ("V6_MCQ_KEY_MISSING", F.col("mcq") & ~F.coalesce("has_key", F.lit(False)))]
    each = units.select("document", "unit", F.explode(codes(own)).alias("code"))
    numbered = units.where("number is not null").groupBy("document", "scope", "number").agg(F.min("unit").alias("unit"))
    expected = F.row_number().over(Window.partitionBy("document", "scope").orderBy("number"))
    gaps = numbered.withColumn("expected", expected).where("number != expected").select("document", "unit", F.lit("V1_QUESTION_GAP").alias("code"))
    found = each.unionByName(gaps)
    if not answered:
        return found
    share = units.groupBy("document").agg(F.count_if(unpaired).alias("missing"), F.count_if(here).alias("all"))
    bare = share.where(F.col("missing") > F.col("all") * bounds.unanswered).select("document", F.lit(None).cast(units.schema["unit"].dataType).alias("unit"), F.lit("V4_MISSING_ANSWERS_ERROR").alias("code"))
    return found.unionByName(bare)


def total_issue(attemptable: Column, raw: Column, paper_max: Column, picks: Column) -> Column:
    """The code of a total off its paper's maximum, or null: up to two marks warn, and so does a raw total of an unparsed choice."""
    off = F.abs(attemptable - paper_max)
    loose = picks.isNull() & (raw >= paper_max) & (raw <= F.floor(paper_max * 1.6))
    return F.when(off == 0, F.lit(None)).when(off <= 2, "V3_TOTAL_MARKS_WARN").when(loose, "V3_TOTAL_MARKS_RAW_WARN").otherwise("V3_TOTAL_MARKS_MISMATCH")


def outcome(found: Column) -> Column:
    """needs_review, ok_with_warnings or ok from a document's array of codes (null: none)."""
    return F.when(F.arrays_overlap(found, F.array(*map(F.lit, ERRORS))), "needs_review").when(F.size(found) > 0, "ok_with_warnings").otherwise("ok")


def mapping_errors(expected: Column, given: Column, candidates: Column, home: Column, open_paper: str) -> Column:
    """Codes of a unit's label mapping that can't stand: each part once, labels among candidates, of its paper, with evidence.

    ``given``: array of (part, label, paper, evidence); units of ``open_paper`` may take labels of any paper.
    """
    parts = F.transform(given, lambda g: g["part"])
    return codes([
        ("part_missing", F.size(F.array_except(expected, parts)) > 0),
        ("part_unknown", F.size(F.array_except(parts, expected)) > 0),
        ("part_repeated", F.size(parts) > F.size(F.array_distinct(parts))),
        ("label_not_candidate", F.exists(given, lambda g: ~F.array_contains(candidates, g["label"]))),
        ("label_of_other_paper", (home != open_paper) & F.exists(given, lambda g: g["paper"] != home)),
        ("evidence_missing", F.exists(given, lambda g: F.coalesce(g["evidence"], F.lit("")) == "")),
    ])


def import_actions(incoming: DataFrame, known: DataFrame, stored: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, action): duplicate, unknown, inserted, skipped (stored alike) or conflict (stored otherwise).

    One row a key of ``incoming``; digests compare null-safe.  A run is accepted if no action is duplicate, unknown or conflict.
    """
    once = incoming.groupBy(key).agg(F.count("*").alias("__n"), F.max(digest).alias("__new"))
    rows = once.join(known.select(key, F.lit(True).alias("__known")).distinct(), key, "left").join(stored.select(key, F.col(digest).alias("__old"), F.lit(True).alias("__stored")), key, "left")
    action = F.when(F.col("__n") > 1, "duplicate").when(F.col("__known").isNull(), "unknown").when(F.col("__stored").isNull(), "inserted").when(F.col("__old").eqNullSafe(F.col("__new")), "skipped").otherwise("conflict")
    return rows.select(key, action.alias("action"))


def manifest_errors(entries: DataFrame, batch: str, key: str, content: str, expected: DataFrame) -> DataFrame:
    """(batch, unique, intact): ids of a batch are distinct, and its digest is the one that ``expected`` (batch, digest) states.

    The digest is a sum of hashes of (key, content), so order doesn't matter and large batches combine in partial sums.
    """
    found = entries.groupBy(batch).agg(F.count("*").alias("__n"), F.count_distinct(key).alias("__k"), digest_sum(key, content).alias("__d"))
    return found.join(expected, batch, "left").select(batch, (F.col("__n") == F.col("__k")).alias("unique"), F.col("__d").eqNullSafe(F.col("digest")).alias("intact"))


def digest_sum(key: str, content: str) -> Column:
    """An order-insensitive digest of (key, content) rows: the sum of 60-bit pieces of their MD5 as an exact decimal."""
    piece = F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col(content).cast("string"))), 1, 15)
    return F.sum(F.conv(piece, 16, 10).cast("decimal(20,0)")).cast("string")


def scoped(documents: DataFrame, scopes: DataFrame, families: dict[str, str]) -> DataFrame:
    """Documents within a scope: its attempt, a kind that maps to its family, and a page inside one of its ranges; no answers.

    ``documents``: id, kind, attempt, page; ``scopes``: attempt, family, ranges (array of (first, last)).
    """
    family = F.element_at(F.create_map(*(F.lit(x) for pair in families.items() for x in pair)), F.col("kind"))
    rows = documents.where(~F.col("kind").endswith("answer")).withColumn("family", family).where("family is not null")
    inside = F.exists("ranges", lambda r: (F.col("page") >= r["first"]) & (F.col("page") <= r["last"]))
    return rows.join(scopes, ["attempt", "family"]).where(inside).select("id", "attempt", "family")


def evidence_errors(evidence: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, code) of evidence that its source doesn't bear out: no span, a withdrawn one, another digest, or pages outside it.

    ``evidence``: id, span, digest, first, last; ``spans``: span, state, span_digest, span_first, span_last.
    """
    rows = evidence.join(spans, "span", "left")
    code = (
        F.when(F.col("state").isNull(), "source_missing").when(F.col("state") != "current", "source_stale").when(~F.col("digest").eqNullSafe(F.col("span_digest")), "source_changed")
        .when((F.col("first") < F.col("span_first")) | (F.col("last") > F.col("span_last")) | (F.col("first") > F.col("last")), "pages_outside")
    )
    return rows.select("id", code.alias("code")).where("code is not null")


def choice_rule(text: Column) -> tuple[Column, Column]:
    """(compulsory question numbers, how many of the others to pick) from an instruction line; null without one."""
    low = F.lower(text)
    named = F.regexp_extract(low, r"questions?\s+(?:nos?\.?\s*)?((?:\d+)(?:\s*(?:,|and)\s*\d+)*)\s+(?:is|are)\s+compulsory", 1)
    compulsory = F.transform(F.regexp_extract_all(named, F.lit(r"(\d+)"), F.lit(1)), lambda n: n.cast("int"))
    number = F.regexp_extract(low, r"any\s+(\w+)\s+(?:questions?\s+)?(?:out\s+of|from)", 1)
    words = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
    spelt = F.array_position(F.array(*map(F.lit, words)), number).cast("int")
    return compulsory, F.when(number.rlike(r"^\d+$"), number.try_cast("int")).when(spelt > 0, spelt)


def reconciled(headings: DataFrame, reference: DataFrame) -> DataFrame:
    """(id, state, target) of headings by their path: exact (one such path), title_only (one such last title), ambiguous, missing.

    Both have path (array of titles); ``reference`` has target.  Titles compare in lower case with blanks collapsed.
    """
    clean = lambda p: F.transform(p, lambda t: F.trim(F.regexp_replace(F.lower(t), r"\s+", " ")))
    by = lambda rows, key, name: rows.groupBy(key).agg(F.count("*").alias(f"__{name}_n"), F.min("target").alias(f"__{name}"))
    paths = reference.select(F.to_json(clean("path")).alias("__path"), F.element_at(clean("path"), -1).alias("__title"), "target")
    rows = headings.select("id", F.to_json(clean("path")).alias("__path"), F.element_at(clean("path"), -1).alias("__title"))
    rows = rows.join(by(paths, "__path", "exact"), "__path", "left").join(by(paths, "__title", "last"), "__title", "left")
    n, m = F.coalesce("__exact_n", F.lit(0)), F.coalesce("__last_n", F.lit(0))
    state = F.when(n == 1, "exact").when((n > 1) | (m > 1), "ambiguous").when(m == 1, "title_only").otherwise("missing")
    return rows.select("id", state.alias("state"), F.when(n == 1, F.col("__exact")).when((n == 0) & (m == 1), F.col("__last")).alias("target"))
