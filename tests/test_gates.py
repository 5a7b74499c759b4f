"""Gate operators on the shapes they are for, with nulls, empty arrays and errors."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import gates as G

MAPPING = "status string, mappings array<struct<outcome:string,excluded:boolean>>, allocations array<struct<allocation_status:string,marks:double>>, issues array<string>"


def test_publication_exclusions(spark):
    rows = [
        ("complete", [("matched", False), ("none_fits", True)], [("reviewed", 4.0)], []),
        ("partial", [("needs_review", False)], [], []),
        ("complete", [], [("reviewed", None)], []),
        ("complete", [("matched", False)], [("reviewed", 2.0)], ["sum"]),
        ("complete", [("matched", False)], [("proposed", 2.0), ("reviewed", 1.0)], []),
    ]
    got = [r["x"] for r in spark.createDataFrame(rows, MAPPING).select(G.publication_exclusions(*map(F.col, ("status", "mappings", "allocations", "issues"))).alias("x")).collect()]
    marks = "marks_allocation_unresolved"
    assert got == [[], ["question_scope_incomplete", "labels_unresolved_without_explicit_exclusion", marks], [marks], [marks], [marks]]


def test_quality_reviews_and_blockers(spark):
    rows = [(["V3_X", "V1_PART_GAP"], True, "questions", True, None), ([], False, "answers", False, {"human_review": "passed", "metadata": "passed"})]
    frame = spark.createDataFrame(rows, "issues array<string>, confirmed boolean, role string, expects boolean, reviews map<string,string>")
    quality = G.quality_dimensions(F.col("issues"), F.col("confirmed"), F.col("role"), F.col("expects"), F.lit(False))
    one, two = (r["q"].asDict() for r in frame.select(G.overlaid(quality, F.col("reviews")).alias("q")).collect())
    assert one == {"metadata": "passed", "questions": "pending", "answers": "pending", "pairing": "pending", "ordering": "concern", "marks_choices": "concern", "readability": "pending", "human_review": "pending"}
    assert two["metadata"] == two["human_review"] == "passed" and two["questions"] == two["pairing"] == "not_applicable"
    first = frame.select(G.blockers([("b", F.lit(True), False), ("a", F.col("confirmed"), True), ("b", F.lit(True), False), ("z", F.lit(None).cast("boolean"), True)]).alias("b")).collect()
    assert [(r["b"]["blockers"], r["b"]["stale"], r["b"]["eligible"]) for r in first] == [(["a", "b"], True, False), (["b"], False, False)]


def test_editions_routes_rules_and_pages(spark):
    sections = [("s1", "x", True, ["2027-05"]), ("s1", "y", True, ["2026-01"]), ("s2", "z", True, ["2026-01"]), ("s3", "w", False, ["2027-05"])]
    schema = "section_key string, section_id string, verified boolean, attempts array<string>"
    expected = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "section_key string")
    got = {r["section_key"]: (r["section_id"], r["is_fallback"], r["reason"]) for r in G.editions(expected, spark.createDataFrame(sections, schema), "2027-05").collect()}
    assert got == {"s1": ("x", False, None), "s2": ("z", True, None), "s3": (None, False, "no verified section")}
    with pytest.raises(Exception, match="ambiguous"):
        G.editions(expected, spark.createDataFrame([*sections, ("s1", "v", True, ["2027-05"])], schema), "2027-05").collect()
    routes = spark.createDataFrame([("Final", "rtp", "2024-05"), ("Final", "rtp", None), ("Foundation", "case_scenarios", None), (None, "rtp", "x"), ("Final", "leaflet", "x")], "a string, b string, c string")
    assert [r["r"] for r in routes.select(G.route(F.col("a"), F.col("b"), F.col("c")).alias("r")).collect()] == ["final_queue", "error_attempt", "outside_corpus", "error_level", "error_type"]
    for page, size in ((0, 5), (1, 0), (1, 101)):
        with pytest.raises(ValueError):
            G.page_of(routes, ["a"], page, size)


def test_boosts_and_runner_up(spark):
    rows = [("p", "a", 60.0, "Lease and IND AS", ["lease", "none"], [0.5]), ("p", "b", 80.0, "Lease", [], []), ("p", "c", 10.0, "Lease", ["lease"], [])]
    frame = spark.createDataFrame(rows, "paper string, node string, base double, text string, words array<string>, weights array<double>")
    scored = frame.withColumn("score", G.boosted(F.col("base"), F.col("text"), F.col("words"), F.col("weights"), 15.0, 35.0))
    assert [(r["node"], r["score"], r["place"]) for r in G.with_runner_up(scored, ["paper"], ["node"]).orderBy("place").collect()] == [("a", 92.5, 1), ("b", 80.0, 2)]
    assert G.with_runner_up(scored.where("node != 'b'"), ["paper"], ["node"]).count() == 1
