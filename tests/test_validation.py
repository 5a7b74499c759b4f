"""Validation operators on the shapes they are for, with nulls, empty arrays and repeats."""

from pyspark.sql import functions as F

from tessera.operators import validation as V

UNIT = "document int, scope string, unit string, number int, gradable boolean, marks double, chars int, mcq boolean, options int, has_key boolean, answer string, first_page int, last_page int"


def test_unit_issues(spark):
    units = spark.createDataFrame(
        [
            (1, "", "Q1", 1, True, 5.0, 100, False, None, None, "found", 1, 1),
            (1, "", "Q3", 3, True, None, 0, True, None, None, None, 4, 2),
            (1, "", "Q3.alt2", 3, False, None, 20000, False, None, None, None, 4, 4),
            (2, "", "Q1", 1, True, 1.0, 5, True, 4, True, "ambiguous", 1, None),
            (3, "", "stem", None, None, None, None, None, None, None, None, None, None),
        ],
        UNIT,
    )
    got = {tuple(r) for r in V.unit_issues(units).collect()}
    assert got == {
        (1, "Q3", "V1_QUESTION_GAP"), (1, "Q3", "V2_MISSING_MARKS"), (1, "Q3", "V5_UNIT_EMPTY"), (1, "Q3", "V6_MCQ_OPTIONS_MISSING"), (1, "Q3", "V6_MCQ_KEY_MISSING"), (1, "Q3", "V7_PAGE_SPAN_INVALID"),
        (1, "Q3", "V4_MISSING_ANSWER"), (1, None, "V4_MISSING_ANSWERS_ERROR"), (1, "Q3.alt2", "V5_UNIT_TOO_LONG"),
        (2, "Q1", "V5_UNIT_TOO_SHORT"), (2, "Q1", "V4_AMBIGUOUS_ANSWER"), (2, "Q1", "V4_MISSING_ANSWER"), (2, None, "V4_MISSING_ANSWERS_ERROR"),
    }
    bare = {r["code"] for r in V.unit_issues(units, answered=False).collect()}
    assert not any(c.startswith("V4") or c == "V6_MCQ_KEY_MISSING" for c in bare) and "V1_QUESTION_GAP" in bare
    assert V.unit_issues(units.limit(0)).count() == 0


def test_outcomes_and_totals(spark):
    rows = spark.createDataFrame([(["V5_UNIT_TOO_SHORT"], 100, 100, 100, 5), (["V5_UNIT_EMPTY"], 98, 98, 100, None), ([], 140, 140, 100, None), (None, 161, 161, 100, None), ([], 80, 120, 100, 5)], "c array<string>, a int, r int, m int, k int")
    got = [tuple(r) for r in rows.select(V.outcome(F.col("c")), V.total_issue(F.col("a"), F.col("r"), F.col("m"), F.col("k"))).collect()]
    assert got == [("ok_with_warnings", None), ("needs_review", "V3_TOTAL_MARKS_WARN"), ("ok", "V3_TOTAL_MARKS_RAW_WARN"), ("ok", "V3_TOTAL_MARKS_MISMATCH"), ("ok", "V3_TOTAL_MARKS_MISMATCH")]


def test_mapping_errors(spark):
    shape = "e array<int>, g array<struct<part:int,label:string,paper:string,evidence:string>>, c array<string>, h string"
    rows = [([1, 2], [(1, "a", "P1", "x"), (2, "b", "P1", "y")], ["a", "b"], "P1"), ([1, 2], [(1, "a", "P2", None), (1, "z", "P1", "y"), (3, "a", "P1", "y")], ["a"], "P1"), ([], [], [], "P6"), ([1], [(1, "a", "P2", "x")], ["a"], "P6")]
    got = [r[0] for r in spark.createDataFrame(rows, shape).select(V.mapping_errors(*map(F.col, "egch"), "P6")).collect()]
    assert got == [[], ["part_missing", "part_unknown", "part_repeated", "label_not_candidate", "label_of_other_paper", "evidence_missing"], [], []]


def test_import_actions(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "id int, digest string")
    got = V.import_actions(rows((1, "a"), (2, "b"), (3, "c"), (3, "c"), (4, "d"), (9, "x"), (5, None)), rows(*((i, "") for i in range(1, 7))), rows((2, "b"), (4, "old"), (5, None)), "id", "digest")
    assert {r["id"]: r["action"] for r in got.collect()} == {1: "inserted", 2: "skipped", 3: "duplicate", 4: "conflict", 5: "skipped", 9: "unknown"}


def test_manifest_errors(spark):
    entries = spark.createDataFrame([("b1", 1, "x"), ("b1", 2, "y"), ("b2", 1, "x"), ("b2", 1, "x")], "b string, k int, c string")
    stated = entries.orderBy(F.desc("k")).groupBy("b").agg(V.digest_sum("k", "c").alias("digest")).where("b = 'b1'")
    assert {tuple(r) for r in V.manifest_errors(entries, "b", "k", "c", stated).collect()} == {("b1", True, True), ("b2", False, False)}


def test_choice_rule(spark):
    lines = ["Question No. 1 is compulsory. Attempt any four questions out of the remaining five.", "Questions 1, 2 and 3 are compulsory. Attempt any 2 from the rest", "Answer all questions", None, "Attempt any several questions out of ten"]
    c, k = V.choice_rule(F.col("t"))
    got = [(r[0], r[1]) for r in spark.createDataFrame([(t,) for t in lines], "t string").select(c, k).collect()]
    assert got == [([1], 4), ([1, 2, 3], 2), ([], None), (None, None), ([], None)]


def test_scopes_evidence_and_headings(spark):
    documents = spark.createDataFrame([(1, "rtp", "2027-05", 4), (2, "rtp_answer", "2027-05", 4), (3, "rtp", "2027-05", 9), (4, "odd", "2027-05", 4), (5, "rtp", None, 4)], "id int, kind string, attempt string, page int")
    scopes = spark.createDataFrame([("2027-05", "revision", [(1, 3), (4, 5)])], "attempt string, family string, ranges array<struct<first:int,last:int>>")
    assert [r["id"] for r in V.scoped(documents, scopes, {"rtp": "revision"}).collect()] == [1]
    evidence = spark.createDataFrame([(1, "s", "d", 2, 3), (2, "s", "x", 2, 3), (3, "s", "d", 2, 9), (4, "old", "d", 1, 1), (5, "none", "d", 1, 1)], "id int, span string, digest string, first int, last int")
    spans = spark.createDataFrame([("s", "current", "d", 1, 5), ("old", "superseded", "d", 1, 5)], "span string, state string, span_digest string, span_first int, span_last int")
    assert {tuple(r) for r in V.evidence_errors(evidence, spans).collect()} == {(2, "source_changed"), (3, "pages_outside"), (4, "source_stale"), (5, "source_missing")}
    reference = spark.createDataFrame([(["A", "B"], 1), (["A", "C"], 2), (["D", "C"], 3), (["E", "F"], 4)], "path array<string>, target int")
    headings = spark.createDataFrame([(1, ["a ", "b"]), (2, ["x", "c"]), (3, ["x", "F"]), (4, ["x", "y"])], "id int, path array<string>")
    assert {tuple(r) for r in V.reconciled(headings, reference).collect()} == {(1, "exact", 1), (2, "ambiguous", None), (3, "title_only", 4), (4, "missing", None)}
