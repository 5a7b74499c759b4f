"""The pipeline's stages against brute force over a small table."""

import base64
import collections
import hashlib
import random
import re

import pytest

from tessera.llm import mixing, pipeline, secrets, toxicity

STAGES = dict(pipeline.STAGES)


def library(text):
    import tiktoken

    public_tokenizers = pytest.importorskip("public_tokenizers")
    if not hasattr(library, "own"):
        with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        library.own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = library.own.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder whose documents have nulls, empty, long and repeated rows, and columns with the stages' own names."""
    rng, folder = random.Random(3), tmp_path_factory.mktemp("odd")
    text = lambda n: " ".join(rng.choice("alpha beta gamma delta kappa".split()) + str(rng.randrange(300)) for _ in range(n))
    rows = [(i, text(30), "en", rng.choice(["a", "b", None]), 1, "x", 0.5, 1, "t") for i in range(40)]
    rows += [(100, text(20000), "en", "a", None, None, None, None, None), (101, None, None, None, None, None, None, None, None), (102, "", "en", "b", 0, "", 0.0, 0, ""), (None, text(9), "de", "a", 1, "y", 1.0, 2, "u"), (None, None, None, None, None, None, None, None, None)]
    rows += [rows[0], rows[0], (7, rows[1][1], "fr", "b", 3, "z", 2.0, 3, "v")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans string, toxicity double, times int, component string"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(0, 40, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns_and_take_odd_rows(spark, odd, name):
    folder, rows = odd
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = STAGES[name](spark, docs, folder)
    found = out.collect()
    if name == "byte-level BPE":
        assert len(found) == len(rows) and sum(r["n_tokens"] == 0 for r in found) == 3
    else:
        assert out.columns == docs.columns
        known = collections.Counter(map(str, docs.collect()))
        assert all(str(r) in known for r in found if name != "secret scans")
    if name == "secret scans":
        assert len(found) == len(rows)
    if name == "n-gram Jaccard join":
        # the copies of row 0 repeat its id and stay with it; the null ids stay; the copy of row 1 goes
        assert sum(r["doc_id"] == 0 for r in found) == 3 and sum(r["doc_id"] is None for r in found) == 2 and len(found) == len(rows) - 2
    empty = docs.where("false")
    assert STAGES[name](spark, empty, folder).count() == 0


def test_stages_and_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "n-gram Jaccard join", "secret scans", "mixing sources to target weights", "byte-level BPE"]
    now = docs
    for name, stage in pipeline.STAGES:
        before = {r["doc_id"]: r for r in now.collect()}
        out = pipeline.stash(stage(spark, now, sf_dir))
        rows = out.collect()
        if name != "byte-level BPE":
            assert out.columns == docs.columns
        if name == "toxicity":
            lexicon = toxicity.learn(docs, toxicity.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
            assert {r["doc_id"] for r in rows} == {i for i, r in before.items() if lexicon.score(r["text"]) < toxicity.THRESHOLD}
        elif name == "n-gram Jaccard join":
            sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, r in before.items() if (w := r["text"].lower().split())}
            kept = {r["doc_id"] for r in rows}
            near = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
            assert not any(near(a, b) for a in kept for b in kept if a < b and a in sets and b in sets)
            assert all(any(near(a, b) for b in sets if b < a) for a in before.keys() - kept)
        elif name == "secret scans":
            assert {r["doc_id"]: r["text"] for r in rows} == {i: secrets.redacted(r["text"], secrets.spans(r["text"])) for i, r in before.items()}
            assert not any(re.search("password=[0-9a-f]{8}", r["text"]) for r in rows)
        elif name.startswith("mixing"):
            mixed = mixing.mixed(now).collect()
            taken = {r["doc_id"]: int(r["taken"] / max(1, r["size"]) + 0.5) for r in mixed}
            assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter({i: n for i, n in taken.items() if n})
            words, target = collections.Counter(), {r["source"]: r["target"] for r in mixed}
            for r in rows:
                words[r["source"]] += len(r["text"].split())
            most = max(r["size"] for r in mixed)
            assert all(abs(words[k] - target[k]) <= most for k in target)
        else:
            assert {(r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in rows} == {(i, *library(r["text"])) for i, r in before.items()}
            assert all(r["decoded_sha256"] == hashlib.sha256(before[r["doc_id"]]["text"].encode()).hexdigest() for r in rows)
        now = out
    assert sorted(map(str, pipeline.run(spark, sf_dir).collect())) == sorted(map(str, now.collect()))
