"""The stemmer, the positional index and its queries, against published stems and a scan of whole texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions.stemming import STOP_WORDS, stem
from tessera.operators import search as S
from tessera.operators.retrieval import candidates
from tessera.sources.stored import stored

PUBLISHED = """consign consign consigned consign consignment consign consistency consist consistently consist consolation consol consolatory consolatori consolidating consolid
conspicuously conspicu conspiracy conspiraci conspirators conspir constables constabl constancy constanc knackeries knackeri knavish knavish kneeling kneel knightly knight
knitting knit knives knive knockers knocker generate generat generally general generously generous communism communism communication communic arsenal arsenal skies sky dying die
only onli innings inning proceeded proceed hopping hop hoping hope tied tie ties tie cries cri gas gas gaps gap kiwis kiwi this this by by say say happily happili
relational relat conditional condit rational ration vietnamization vietnam operator oper feudalism feudal hopefulness hope callousness callous sensitivity sensit
analogy analog triplicate triplic formative format formalize formal electrical electr goodness good airliner airlin adjustable adjust replacement replac adoption adopt
effective effect probate probat rate rate cease ceas controll control agreed agre feed feed bled bled motoring motor sing sing conflated conflat troubling troubl sized size
falling fall hissing hiss fizzed fizz filing file youth youth boyish boyish employing employ flying fli beautiful beauti exceedingly exceed yearly year a a""".split()


def test_published_stems(spark):
    pairs = list(zip(PUBLISHED[::2], PUBLISHED[1::2]))
    got = spark.createDataFrame([(w, s) for w, s in pairs] + [(None, None), ("", ""), ("été", "été")], "w string, s string").withColumn("got", stem(F.col("w")))
    assert [tuple(r) for r in got.where(~F.col("s").eqNullSafe(F.col("got"))).collect()] == []


def test_a_stem_is_one_small_expression(spark):
    plan = spark.createDataFrame([("w",)], "w string").select(stem(F.col("w")).alias("s")).where("s <> ''")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 40_000  # and doesn't grow when predicates are pushed through it


TEXTS = [
    (1, "Audits of listed companies"), (2, "listing company audit risk"), (3, "risk only"), (4, "the risk of audit; the audit of a risk"), (5, None), (6, ""), (7, "of the"),
    (70_000, "Risks, AUDITED"), (70_001, "risk of the audits"), (3, "second row of three"), (-5, "audit risk"),
]


@pytest.fixture(scope="module")
def idx(spark):
    return S.index(spark.createDataFrame(TEXTS, "i long, t string"), "i", "t").persist()


@pytest.mark.parametrize(
    "q, want",
    [
        ("audits risk", {2, 4, 70_000, 70_001, -5}), ("audit -risk", {1}), ('"risk of audit"', {4}), ('"risk of the audit"', {70_001}), ("listed or only", {1, 2}), ("", set()), ("of the", set()),
        ('"of the"', set()), ("-audit", {3, 5, 6, 7}), ('-"audit risk" audit', {1, 4, 70_000, 70_001}), ('"audit risk" or three', {2, 3, -5}), ("nowhere", set()), ('"!" risk -nowhere second', {3}), ("or", set()), ("COMPANIES'", {1, 2}),
    ],
)
def test_queries(idx, q, want):
    assert {r["doc"] for r in S.search(idx, q).collect()} == want


def test_queries_equal_a_scan(spark):
    rng = random.Random(7)
    words = ["audit", "audited", "risk", "risks", "the", "of", "tax", "taxing", "été", "x1", "lease"]
    rows = [(i * 97, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(400)]
    stems = dict(zip(words, ["audit", "audit", "risk", "risk", None, None, "tax", "tax", "été", "x1", "leas"]))
    index = S.index(spark.createDataFrame(rows, "i long, t string"), "i", "t", block=1000, buckets=5).persist()

    def literal(text, phrase):
        have, want = [stems[w] for w in text.split()], [stems[w] for w in phrase.split()]
        while want and want[0] is None:
            want = want[1:]
        return any(all(w is None or i + d < len(have) and have[i + d] == w for d, w in enumerate(want)) for i in range(len(have)))

    for _ in range(6):
        groups = [[(rng.random() < 0.3, " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))) for _ in range(rng.randint(1, 2))] for _ in range(rng.randint(1, 2))]
        q = " or ".join(" ".join(("-" if no else "") + f'"{phrase}"' for no, phrase in group) for group in groups)
        counts = [[(no, p) for no, p in group if not set(p.split()) <= set(STOP_WORDS)] for group in groups]
        want = {i for i, t in rows if any(g and all(literal(t, p) != no for no, p in g) for g in counts)}
        assert {r["doc"] for r in S.search(index, q, buckets=5).collect()} == want, q


def test_pages(spark):
    found = spark.createDataFrame([(i,) for i in range(60)], "doc long").repartition(7)
    page = lambda n: [(r["doc"], r["total"]) for r in S.page(found, n, 25).orderBy("doc").collect()]
    assert page(1) == [(i, 60) for i in range(25)] and page(3) == [(i, 60) for i in range(50, 60)] and page(4) == []


def test_queries_read_their_own_buckets(spark, tmp_path):
    rows = spark.createDataFrame(TEXTS, "i long, t string")
    S.index(rows, "i", "t").write.options(**S.OPTIONS).partitionBy("bucket").parquet(str(tmp_path / "x"))
    found = S.search(spark.read.parquet(str(tmp_path / "x")), "audit risk")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[.*In\(stem", plan)
    assert {r["doc"] for r in found.collect()} == {2, 4, 70_000, 70_001, -5}


def test_stored_tables_follow_their_inputs(spark, tmp_path):
    path, built = str(tmp_path / "in"), []
    spark.range(3).write.parquet(path)

    def read():
        rows = spark.read.parquet(path)
        return stored(spark, "test", [rows], lambda: built.append(1) or rows).count()

    assert (read(), read(), len(built)) == (3, 3, 1)
    spark.range(2).write.mode("append").parquet(path)
    assert (read(), len(built)) == (5, 2)


def test_frequent_elements_make_no_pairs_by_themselves(spark):
    rows = [(i, ["hot", f"own{i % 50}"] + ["hot pair"] * (i % 7 == 0)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc long, elements array<string>")
    items = spark.createDataFrame([(0, ["hot", "own3", "own4"]), (1, ["hot"]), (2, ["none"]), (3, ["hot pair", "own5", "hot"])], "item long, elements array<string>")
    got = {}
    for r in candidates(items, docs, 10, "item", "doc").collect():
        got.setdefault(r["item"], []).append((-r["score"], r["doc"]))
    score = lambda asked, e: sum(10 if " " in x else 1 for x in set(asked) & set(e))
    want = {i: sorted((-score(a, e), d) for d, e in rows if score(a, e))[:10] for i, a in [(0, ["hot", "own3", "own4"]), (1, ["hot"]), (3, ["hot pair", "own5", "hot"])]}
    assert {k: sorted(v) for k, v in got.items()} == want


def test_texts_are_split_once_and_occurrences_combined_before_the_shuffle(spark):
    rows = spark.createDataFrame(TEXTS, "i long, t string")
    plan = S.index(rows, "i", "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    assert re.search(r"ObjectHashAggregate\(keys=\[word[^\n]*partial_collect_list[^\n]*\n[^\n]*(Project|Filter)[^\n]*\n(?:[^\n]*(Project|Filter)[^\n]*\n)*[^\n]*Generate", plan)


def test_places_keep_documents_and_positions(spark):
    texts = [(-70_000, "risk a risk"), (65_535, "risk"), (65_536, "tax risk"), (2**53 + 1, "risk")]
    rows = S.index(spark.createDataFrame(texts, "i long, t string"), "i", "t").where("stem = 'risk'").select("block", F.explode("places").alias("p"))
    got = rows.select((F.col("block") + S.offset_of(F.col("p"))).alias("doc"), S.position_of(F.col("p")).alias("at")).collect()
    assert {tuple(r) for r in got} == {(-70_000, 0), (-70_000, 2), (65_535, 0), (65_536, 1), (2**53 + 1, 0)}


def test_a_pair_is_scored_without_the_whole_document(spark):
    docs = spark.createDataFrame([(i, [f"w{i}", "hot"] + [f"own{i}x{j}" for j in range(50)]) for i in range(60)] + [(60, None)], "doc long, elements array<string>")
    items = spark.createDataFrame([(0, ["hot", "w3"])], "item long, elements array<string>")
    got = candidates(items, docs, 5, "item", "doc")
    assert [r["doc"] for r in got.orderBy("place" if "place" in got.columns else "score", ascending=False).collect()][:1] == [3]
    assert "own3x1" not in str(spark.read.parquet(*got.inputFiles()).collect())  # what no item has isn't read again
