"""Fixed values of the scoring model, trees, windows, text, sinks and the stream, on hand-made frames."""

import collections
import datetime as dt
import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import nested as N
from tessera.functions import text as T
from tessera.operators import compare as C
from tessera.operators import joins as J
from tessera.operators import scoring as S
from tessera.operators import tree
from tessera.operators import windows as W
from tessera.plans import curation, joins, texts, windows
from tessera.sources import sinks, tables
from tessera.streaming import feed


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_decay_and_marks(spark):
    assert [value(spark, S.decay(F.lit(a), h)) for a, h in ((0, 24.0), (24, 24.0), (48, 24.0), (12, 12.0), (5, 0.0))] == [1, 0.5, 0.25, 0.5, 1]
    marks = lambda m, share, cross, stale: value(spark, S.attributed_marks(F.lit(m).cast("double"), F.lit(share), F.lit(cross), F.lit(stale), S.ScoringConfig()))
    assert [marks(10, 0.5, False, False), marks(10, 1.0, False, True), marks(10, 1.0, True, False), marks(10, 1.0, False, False), marks(None, 1.0, False, False)] == [5, 5, 5, 10, 0]


def test_weak_truth_table(spark):
    rows = [(3, 5, "not_started", True), (3, 4, "not_started", True), (2, 5, "not_started", True), (3, 5, "in_progress", True), (3, 5, "done", True), (3, 5, "not_started", False)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, h int, w int, s string, a boolean")
    got = frame.select("i", S.weak(F.col("h"), F.col("w"), F.col("s"), F.col("a"), S.ScoringConfig()).alias("v")).orderBy("i")
    assert [r["v"] for r in got.collect()] == [True, False, False, False, False, False]


def test_component_null_is_not_zero(spark):
    assert value(spark, S.component(F.lit(0.0), F.lit(0.0), F.lit(True))) == 0 and value(spark, S.component(F.lit(0.0), F.lit(0.0), F.lit(False))) is None


def test_importance_is_one_at_the_top_and_zero_where_inapplicable(spark):
    rows = spark.createDataFrame([("P", 1, True, 4.0, 2.0, 1.0), ("P", 2, True, 2.0, 0.0, 1.0), ("P", 3, False, 9.0, 9.0, 0.0)], "paper string, leaf long, applicable boolean, exam_score double, practice_score double, weight_prior double")
    got = {r["leaf"]: round(r["importance"], 6) for r in S.importance(rows, S.ScoringConfig()).collect()}
    assert got == {1: 1.0, 2: 0.5, 3: 0.0}


def test_ranks_and_spearman(spark):
    frame = spark.createDataFrame([(1, 0, 10), (1, 1, 20), (1, 2, 20), (1, 3, 5)], "g int, i int, v int")
    assert [r["p"] for r in frame.select("i", W.average_rank(["g"], F.desc("v"), ["v"]).alias("p")).orderBy("i").collect()] == [3, 1.5, 1.5, 4]
    pairs = spark.createDataFrame([("same", i, i) for i in range(4)] + [("back", i, -i) for i in range(4)] + [("one", 1, 1), ("flat", 1, 1), ("flat", 1, 1), ("half", 1, 1), ("half", 1, 2)], "k string, x int, y int")
    assert {r["k"]: r["rho"] for r in C.spearman(pairs, ["k"], "x", "y").collect()} == {"same": 1, "back": -1, "one": 1, "flat": 1, "half": 0}


def test_streak_reset(spark):
    rows = [(1, t, t, o) for t, o in enumerate(["ok", "shaky", "ok", "seen", "ok"])] + [(2, 0, 0, "shaky"), (3, 0, 0, "ok")]
    frame = spark.createDataFrame(rows, "u int, ts int, id int, outcome string")
    assert {r["u"]: r["k"] for r in W.streak(frame, ["u"], ["ts", "id"], "ok", "shaky").collect()} == {1: 2, 2: 0, 3: 1}


def test_plan_cap_and_budget(spark):
    frame = spark.createDataFrame([(c, i, float(100 - i)) for i in range(60) for c in [i // 10]], "c int, i int, p double")
    got = W.capped(frame, "c", [F.desc("p"), F.asc("i")], 3, 20).collect()
    assert len(got) == 18 and max(sum(r["c"] == c for r in got) for c in range(6)) == 3


def test_retention_keeps_a_snapshot_of_each_period(spark):
    days = [dt.datetime(2024, 1, 1) + dt.timedelta(days=i) for i in range(90)]
    kept = {r["at"]: r["kept_by"] for r in W.retained(spark.createDataFrame(list(enumerate(days)), "id long, at timestamp"), "at", 7, 4, 6).collect()}
    assert sum("day" in k for k in kept.values()) == 7 and sum("week" in k for k in kept.values()) == 4 and sum("month" in k for k in kept.values()) == 3


def test_retention_query_considers_every_order(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(days=i // 3)) for i in range(1, 271)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    want = {}
    for rule, bucket, n in (("day", lambda t: t.date(), 7), ("week", lambda t: t.isocalendar()[:2], 4), ("month", lambda t: (t.year, t.month), 6)):
        newest = {bucket(t): i for i, t in rows}
        for b in sorted(newest, reverse=True)[:n]:
            want.setdefault(newest[b], []).append(rule)
    got = {r["id"]: r["kept_by"] for r in windows.q24_snapshot_retention(spark, str(tmp_path)).collect()}
    assert got == {i: ",".join(sorted(v)) for i, v in want.items()}


def test_identity_and_spans_cover_every_row(spark, tmp_path):
    events = [(i, i % 3, ["view", "click", None][i % 7 % 3]) for i in range(80)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    key = lambda i, u, e: (u, None if e == "view" else e, i % 5 if i % 3 else None)
    answers = collections.Counter(key(*e) for e in events if e[0] % 2 == 0)
    want = {e[0]: answers[key(*e)] for e in events if e[0] % 2 and answers[key(*e)]}
    assert {r["paper_id"]: r["answers"] for r in joins.j18_null_safe_identity(spark, str(tmp_path)).collect()} == want
    parts, nations = [(i, i * 7 % 50 + 1) for i in range(200)], [0, 0, 2, 3]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(i, n) for i, n in enumerate(nations)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    inside = {p: sum(n * 40 <= p and p + size <= n * 40 + 40 for n in nations) for p, size in parts}
    assert {r["p_partkey"]: r["inside"] for r in curation.n10_spans_inside(spark, str(tmp_path)).collect()} == inside


def test_tree(spark):
    nodes = spark.createDataFrame([("m", None, "module", "active"), ("c", "m", "chapter", "active"), ("s", "c", "subtopic", "active"), ("t", "c", "subtopic", "retired")], "id string, parent_id string, level string, status string")
    closed = tree.closure(nodes)
    assert {r["id"]: r["path"] for r in tree.chains(closed).collect()} == {"m": "m", "c": "m/c", "s": "m/c/s", "t": "m/c/t"}
    assert {r["id"] for r in tree.applicable(closed, nodes, nodes.where("id = 'c'").select("id")).collect()} == {"m"}
    with pytest.raises(tree.CycleError):
        tree.closure(spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent_id string"))


def test_or_groups_count_once(spark):
    units = spark.createDataFrame([("q", None, 1, 10.0), ("q", None, 2, 10.0), ("q", "g", 3, 5.0), ("q", "g", 4, 7.0)], "root string, or_group string, unit int, marks double")
    assert tree.folded_marks(units).first()["marks"] == 27


def test_as_of_prefers_dated_then_latest(spark):
    right = spark.createDataFrame([("k", None, "u"), ("k", "2020-01", "a"), ("k", "2021-01", "b"), ("x", "2021-01", "c")], "k string, valid_from string, id string")
    left = spark.createDataFrame([("k", "2019-05", 1), ("k", "2020-06", 2), ("k", "2021-01", 3), ("z", "2021-01", 4)], "k string, at string, n int")
    assert {r["n"]: r["id"] for r in J.as_of(left, right, ["k"], "at", "valid_from").collect()} == {1: "u", 2: "a", 3: "b", 4: None}


def test_digest_ignores_order_and_sees_repeats(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "i int, s string"), spark.createDataFrame([(2, None), (1, "x")], "i int, s string")
    digest = lambda f: C.multiset_digest(f).first()["digest"]
    assert digest(a) == digest(b) != digest(a.union(a)) and C.equal_multisets(a, b) and not C.equal_multisets(a, a.union(a))
    assert C.schema_diff(a, b.withColumn("s", F.lit(1)).withColumn("z", F.lit(1))) == [("s", "changed"), ("z", "unexpected")]


def test_text_functions(spark):
    frame = spark.createDataFrame([("ﬁne  Text\n12", "http://h/a/b", '<a href="../c#x">1</a><iframe src="http://o/p"></iframe><a href="../c">2</a>')], "t string, u string, h string")
    row = frame.select(T.nfkc("t").alias("n"), T.masked(F.col("t")).alias("m"), T.links("h", "u").alias("l"), T.partial_ratio(F.lit("tax law"), F.lit("income tax law of 2025")).alias("p"), T.token_set_ratio(F.lit("law tax"), F.lit("tax law act")).alias("s")).first()
    assert row["n"] == "fine  Text\n12" and row["m"] == "ﬁne  text\n#" and row["l"] == ["https://h/c", "https://o/p"] and row["p"] == 100 and row["s"] == 100


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        row, old = [0], row
        for j, d in enumerate(b):
            row.append(old[j] + 1 if c == d else max(old[j + 1], row[j]))
    return row[-1]


def brute_partial(a, b):
    def best(short, long):
        m, n = len(short), len(long)
        windows = [long[max(0, i) : i + m] for i in range(1 - m, n)]
        return max(2 * brute_lcs(short, w) / (m + len(w)) for w in windows)

    short, long = sorted((a, b), key=len)
    return round(100 * max([best(short, long)] + [best(long, short)] * (len(short) == len(long))), 4)


def brute_token_set(a, b):
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    one, two = (" ".join([*sorted(x & y), *sorted(s)]) for s in (x - y, y - x))
    ratio = lambda p, q: 2 * brute_lcs(p, q) / (len(p) + len(q)) if p or q else 0.0
    if both and (one == both or two == both):
        return 100.0
    return round(100 * max(ratio(both, one), ratio(both, two), ratio(one, two)), 4)


def test_fuzzy_ratios_match_brute_force_over_every_window():
    rng = random.Random(3)
    some = lambda n, letters="abc d": "".join(rng.choice(letters) for _ in range(n))
    pairs = [(some(rng.randint(1, 14)), some(rng.randint(1, 60))) for _ in range(120)] + [(some(9), some(9)) for _ in range(10)] + [("é😀x", "ab😀éx y"), ("abc", "xyz"), ("a", "b")]
    for a, b in pairs:
        assert T._partial(a, b) == T._partial(b, a) == brute_partial(a, b)
        assert T._token_set(a, b) == brute_token_set(a, b)
    assert T._partial("", "") == 100 and T._partial("", "x") == 0


def test_fuzzy_query_scores_whole_texts(spark, tmp_path):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    item, other = text(150), text(150)
    spark.createDataFrame([(1, item), (2, item), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, text(900) + item), (2, item[:120] + other[:30]), (3, "x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["partial"] for r in texts.t05_fuzzy_ratios(spark, str(tmp_path)).collect()}
    assert got[1] == 100 and got[2] < 100 and got[3] is None


def test_text_queries_cover_all_languages(spark, tmp_path):
    rows = [(1, "Étude 12 of the Tax law", "fr", "a"), (2, "étude  12 of the tax LAW", "fr", None), (3, "Étude 12 of the tax law", None, "a"), (4, "trash of the bin", "de", "b"), (5, None, "en", "b"), (6, None, "de", "b"), (7, "théorème", "fr", "b")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda q: q(spark, str(tmp_path)).collect()
    folded = lambda t: re.sub(r"\s+", " ", t).strip().lower()
    md5 = lambda t: None if t is None else hashlib.md5(re.sub(r"\d+", "#", t.lower()).encode()).hexdigest()
    assert {r["doc_id"]: r["mask"] for r in run(texts.t02_digit_mask)} == {i: md5(t) for i, t, *_ in rows}
    joined = lambda t, lang, source: "|".join(x for x in (source, lang, t and folded(t)) if x is not None)
    assert {r["doc_id"]: r["fingerprint"] for r in run(texts.t16_fingerprint)} == {i: hashlib.sha1(joined(*x).encode()).hexdigest() for i, *x in rows}
    assert [tuple(r) for r in run(texts.t19_duplicate_key)] == [(hashlib.sha256(folded(rows[0][1]).encode()).hexdigest(), 3, 1)]


def test_candidates_rank_by_phrases_then_overlap(spark, tmp_path):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta1", "the", "with", "of", "Omega", "été", "l2xx", "fall"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items, found = [(i, text(8)) for i in range(3)], [(i, text(rng.randint(0, 12)), rng.choice(["en", "de", None])) for i in range(70)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(found, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")

    def parts(t):
        all_words = re.findall(r"\w+", t.lower())
        good = lambda w: re.fullmatch("[a-z][a-z0-9]{3,}", w) and w not in T.STOPWORDS
        return {w for w in all_words if good(w)}, {p for p in zip(all_words, all_words[1:]) if all(map(good, p))}

    want = set()
    for i, t in items:
        scores = [(len(parts(t)[1] & parts(u)[1]), len(parts(t)[0] & parts(u)[0]), d) for d, u, _ in found]
        best = sorted((-10 * p - o, d, p, o) for p, o, d in scores if p or o)[:40]
        want |= {(i, d, p, o, -s) for s, d, p, o in best}
    got = texts.t09_candidate_retrieval(spark, str(tmp_path)).select("item_id", "doc_id", "phrases", "overlap", "score").collect()
    assert {tuple(r) for r in got} == want


def test_nested(spark):
    shares = value(spark, N.split_shares(F.lit("a"), F.array(F.lit("b"), F.lit("c"))))
    assert [(s["node"], s["share"]) for s in shares] == [("a", 0.5), ("b", 0.25), ("c", 0.25)]
    assert [value(spark, N.json_kind(F.lit('{"a": null, "b": 1.5, "c": [1], "d": "x", "e": true, "f": {}}'), k)) for k in "abcdefg"] == ["null", "number", "array", "string", "boolean", "object", "absent"]


def test_readers(spark, tmp_path):
    (tmp_path / "tree.json").write_text(json.dumps([{"id": "m", "name": "M", "children": [{"id": "c", "children": [{"id": "t"}]}]}]))
    assert [(r["id"], r["parent_id"], r["level"]) for r in tables.read_tree(spark, str(tmp_path / "tree.json")).orderBy("level").collect()] == [("c", "m", "chapter"), ("m", None, "module"), ("t", "c", "topic")]
    (tmp_path / "c.toml").write_text("half_life_exam_months = 36\n[weights]\nexam = 0.5\n")
    config = tables.read_config(str(tmp_path / "c.toml"))
    assert (config.half_life_exam, config.weight_exam, config.half_life_practice) == (36, 0.5, 12.0)
    assert tables.read_files(spark, str(tmp_path), "*.toml").count() == 1
    assert tables.read_manifest(spark, [str(tmp_path / "tree.json")], "id string, name string").first()["id"] == "m"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0)], "leaf string, score double")
    for run in (1, 2):
        sinks.write_run(rows, f"{tmp_path}/runs", run)
    assert spark.read.parquet(f"{tmp_path}/runs").where("score_run_id = 2").count() == 1
    assert sinks.current_run(spark, f"{tmp_path}/now") is None
    assert [sinks.promote(spark, f"{tmp_path}/now", r, g) for r, g in ((1, 5), (2, 4), (2, 5), (2, 5))] == [True, False, True, False]
    assert sinks.current_run(spark, f"{tmp_path}/now")["run_id"] == 2
    old = spark.createDataFrame([("k", 1)], "key string, at int")
    assert [tuple(r) for r in sinks.appended_once(old, spark.createDataFrame([("k", 2), ("n", 3), ("n", 4)], "key string, at int"), ["key"], "at").collect()] == [("n", 4)]
    sinks.export_user({"p": spark.createDataFrame([(1, "x"), (2, "y")], "user_id int, v string")}, 1, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out/p").count() == 1


def test_stream_of_streaks_equals_batch(spark, tmp_path):
    rows = [(u, leaf, ["ok", "shaky", "seen"][(u * 7 + leaf * 3 + i * 5) % 3], i, i) for u in range(3) for leaf in range(3) for i in range(20)]
    schema = "user_id int, leaf int, outcome string, ts int, event_id int"
    frame = spark.createDataFrame(rows, schema)
    for part in range(4):
        frame.where(f"ts between {part * 5} and {part * 5 + 4}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = feed.source(spark, f"{tmp_path}/in", frame.schema)
    feed.streaks(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = {(r["user_id"], r["leaf"]): r["k"] for r in feed.merged_streaks(spark, f"{tmp_path}/out").collect()}
    assert got == {(r["user_id"], r["leaf"]): r["k"] for r in W.streak(frame, ["user_id", "leaf"], ["ts", "event_id"], "ok", "shaky").collect()}


def test_closures_of_deep_trees_and_long_pointer_chains(spark):
    deep = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else None) for i in range(11)] + [("lost", "gone")], "id string, parent_id string")
    got = {(r["ancestor"], r["id"], r["depth"]) for r in tree.closure(deep).collect()}
    assert got == {(f"n{j}", f"n{i}", i - j) for i in range(11) for j in range(i + 1)} | {("lost", "lost", 0)}
    with pytest.raises(tree.CycleError):
        tree.closure(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "id string, parent_id string"))
    chain = spark.createDataFrame([(i, max(0, i - 1), int(i > 0)) for i in range(150)], "id long, origin long, hops int")
    assert {(r["id"], r["origin"], r["hops"]) for r in tree.chased(chain).collect()} == {(i, 0, i) for i in range(150)}


def test_closure_plans_dont_grow_with_depth(spark, tmp_path):
    scans = []
    for depth in (8, 30, 100):
        path = str(tmp_path / f"d{depth}")
        spark.createDataFrame([(i, i - 1 if i else None) for i in range(depth)], "id long, parent_id long").write.parquet(path)
        closed = tree.closure(spark.read.parquet(path))
        scans.append(closed._jdf.queryExecution().optimizedPlan().toString().count("parquet"))
        assert closed.count() == depth * (depth + 1) // 2
    assert scans[0] == scans[1] == scans[2]


def test_preorder_of_large_sequence_numbers(spark):
    nodes = spark.createDataFrame([("r", None, 0), ("a", "r", 9999), ("b", "r", 10000), ("c", "r", 123456), ("d", "b", 2), ("e", "b", 10)], "id string, parent_id string, seq int")
    order = tree.preorder_keys(tree.closure(nodes), nodes).orderBy("k").collect()
    assert [r["id"] for r in order] == ["r", "a", "b", "d", "e", "c"]


def test_digests_tell_fields_and_nulls_apart(spark):
    rows = [("a\x1fb", "c"), ("a", "b\x1fc"), (None, "x"), ("\x00", "x"), ("", "x"), ("-", "x"), ("1:a", ""), ("", "1:a")]
    digests = {C.multiset_digest(spark.createDataFrame([r], "x string, y string")).first()["digest"] for r in rows}
    assert len(digests) == len(rows)


def test_the_core_stands_without_the_optional_subpackage(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    ignore = shutil.ignore_patterns("llm", ".git", "__pycache__", "spark-warehouse")
    ask = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op1_') or k == 'pipeline' for k in e.queries()))"
    for leave_pipeline in (False, True):
        copy = shutil.copytree(root, tmp_path / str(leave_pipeline), ignore=ignore)
        if not leave_pipeline:
            os.remove(copy / "corpus_pipeline.py") if (copy / "corpus_pipeline.py").exists() else None
        out = subprocess.run([sys.executable, "-c", ask], cwd=copy, capture_output=True, text=True, check=True).stdout.split()
        assert int(out[0]) > 150 and int(out[1]) > 150 and out[2] == "False"


def test_mock_score_adds_in_order_of_events(spark, tmp_path):
    from tessera.plans import listings

    values = [120.2, 32.07, 56.28, 24.5, 106.95, 51.33, 12.8, 48.38, 9.64, 24.76, 100.79, 26.91, 17.68, 75.41]
    rows = spark.createDataFrame([(i, 1, "purchase", v) for i, v in enumerate(values)], "event_id long, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds("event_id"))
    total = 0.0
    for v in values:
        total += v
    for way, dealt in {"one": rows.coalesce(1), "back": rows.coalesce(1).sortWithinPartitions(F.desc("event_id")), "many": rows.repartition(5)}.items():
        dealt.write.parquet(f"{tmp_path}/{way}/events.parquet")
        got = listings.m16_mock_score(spark, f"{tmp_path}/{way}").first()
        assert (got["tries"], got["pct"]) == (14, 50.5), (way, total)


def test_mock_score_rounds_doubles_beside_a_tie_as_the_sql_does(spark, tmp_path):
    import duckdb

    from tessera.plans import listings
    from tessera.plans.registry import ORACLE_SQL

    users = [[54.01, 3.18, 19.76], [73.79, 3.8, 10.76], [48.82, 18.79, 94.61, 80.52, 74.01], [50.45], [0.05], [None, None]]
    rows = [(10 * u + i, u, "purchase", v) for u, values in enumerate(users) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds("event_id"))
    frame.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = sorted(con.execute(ORACLE_SQL["m16_mock_score"]).fetchall())
    assert sorted(tuple(r) for r in listings.m16_mock_score(spark, str(tmp_path)).collect()) == want
    assert [pct for _, _, pct in want[:3]] == [25.6, 29.4, 63.4]


def test_chased_rounds_do_not_run_again(spark):
    chain = spark.range(20).selectExpr("id", "greatest(id - 1, 0) as origin", "cast(id > 0 as int) as hops")
    plan = tree.chased(chain)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Range" not in plan
