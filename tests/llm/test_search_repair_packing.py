"""Lexical search, conversation repair and packing against brute force and round trips, on odd and hot inputs."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import conversations, lexical_search, packing

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string"


def texts(rng, n):
    words = ["alpha", "Beta", "gamma's", "o'neill", "naïve", "日本語", "x1", "2024", "ZETA", "été", "--", "\t\n"]
    return [" ".join(rng.choice(words[: rng.randint(1, len(words))]) for _ in range(rng.randint(0, 40))) for _ in range(n)]


# -- lexical search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = {}
    for item, wanted in asked.items():
        scores = []
        for doc, c in counts:
            m = 10 + 90 * sum(c.values()) * n_docs // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if c[t])
            scores.append((-score, doc is None, doc or 0))
        out[item] = [(None if none else d, -s) for s, none, d in sorted(scores)[:k] if s]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r[0], r[1])):
        out.setdefault(r[0], []).append((r[2], r[3]))
        assert len(out[r[0]]) == r[1]
    return {k: v for k, v in out.items()}


def test_search_equals_brute_force(spark):
    rng = random.Random(5)
    docs = list(enumerate(texts(rng, 300))) + [(None, "alpha zeta"), (400, None), (401, ""), (402, "-- !"), (403, "alpha " * 30000), (7, "beta"), (7, "beta")]
    docs += [(1000 + i, "same words again") for i in range(50)]
    items = [(1, "Alpha BETA, gamma"), (2, "same again"), (2, "x1"), (3, None), (4, "nowhere"), (5, ""), (None, "alpha"), (6, " ".join(texts(rng, 3))), (7, "日本語 naïve")]
    idx = lexical_search.index(spark.createDataFrame(docs, DOCS).repartition(3), shard_bytes=600)
    assert idx.where("term is null").count() > 10  # many shards
    want = {k: v for k, v in brute_search(docs, items).items() if v}
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert found(lexical_search.search(idx, asked)) == want
    assert found(lexical_search.search(idx, asked, block_items=2)) == want  # blocks of items give the same


def test_search_ties_extra_columns_and_other_ids(spark):
    docs = spark.createDataFrame([("b", "w w", 1, "t"), ("a", "w w", 2, "u"), ("c", "w", 3, None)], "doc_id string, text string, shard long, term string")
    docs = docs.unionByName(spark.createDataFrame([("d", "other", 4, "x")], docs.schema))
    got = lexical_search.search(lexical_search.index(docs), spark.createDataFrame([("i", "w")], "item_id string, text string"), k=2).collect()
    assert [(r.rank, r.doc_id) for r in sorted(got, key=lambda r: r.rank)] == [(1, "a"), (2, "b")]


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert lexical_search.search(lexical_search.index(docs), spark.createDataFrame([(1, "a")], items.schema)).count() == 0
    assert lexical_search.search(lexical_search.index(spark.createDataFrame([(1, "a")], DOCS)), items).count() == 0


def test_leb128_round_trip_and_best_against_sorting():
    rng = np.random.default_rng(2)
    values = np.concatenate([[0, 127, 128, 16383, 16384, 2**40], rng.integers(0, 2**20, 500)])
    data, cuts = lexical_search.leb128(values)
    assert (lexical_search.from_leb128(data) == values).all() and cuts[-1] == len(data)
    for seed in range(200):
        r = random.Random(seed)
        lists, total = [], Counter()
        for _ in range(r.randint(1, 8)):
            places = sorted(r.sample(range(60), r.randint(1, 50)))
            scores = [r.randint(1, 5) for _ in places]
            total.update(dict(zip(places, scores)))
            lists.append((places, scores, max(scores)))
        k = r.randint(1, 12)
        assert lexical_search.best(lists, k) == sorted(((s, p) for p, s in total.items()), key=lambda x: (-x[0], x[1]))[:k]


# -- conversation repair


def after_damage(conv, rows):
    out = []
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def cheapest(rows):
    """By a search over (cost, letters): uniform in cost, so the first way to an accepting end is the least."""
    held = [t for t, *_ in rows if t is not None]
    seen, faults = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, closed = [(0, "", 0, "", ())], set()
    while True:
        cost, letters, i, state, turns = heapq.heappop(heap)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        if i == len(rows) and state in ("", "a"):
            break
        for role in ("user", "assistant"):
            if to := step.get((state, role[0])):
                heapq.heappush(heap, (cost + 2, letters + "I", i, to, (*turns, (role, ""))))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, letters + "D", i + 1, state, turns))
            if faults[i] in ("", "truncated"):
                more = faults[i] == "truncated"
                if to := step.get((state, role[:1])):
                    heapq.heappush(heap, (cost + more, letters + "K", i + 1, to, (*turns, (role, text))))
                for new in ("user", "assistant"):
                    if to := step.get((state, new[0])):
                        heapq.heappush(heap, (cost + 2 + more, letters + "R", i + 1, to, (*turns, (new, text))))
    gaps = max(held) - min(held) + 1 - len(set(held)) if held else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in turns).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, letters, digest)


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def odd_conversations():
    rng = random.Random(1)
    roles, said = ["user", "assistant", "system", "user", "assistant", "tool", "", None], ["a.", "b", "  ", "c!", "hello there.", None, "", "x?"]
    data = [(c or None, rng.choice([t, t, t, t + 1, None]), rng.choice(roles), rng.choice(said)) for c in range(150) for t in range(rng.randint(1, 9))]
    return data + [(9999, t // 2, rng.choice(roles[:3]), rng.choice(["a.", "b"]) + str(rng.randrange(200)) + rng.choice(["", "."])) for t in range(300)] + [(5, 1, "user", "again.")] * 40


@pytest.mark.parametrize("block_rows", [20_000, 7])
def test_repair_equals_brute_force(spark, block_rows):
    data = odd_conversations()
    df = spark.createDataFrame([(*r, 1, "x") for r in data], CONVERSATIONS + ", block long, audit string").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in conversations.summary(conversations.damaged(df), block_rows).collect()}
    want = {c: cheapest(after_damage(c, [r[1:] for r in data if r[0] == c])) for c in {r[0] for r in data}}
    assert got == want


def test_repair_of_rows_as_they_are(spark):
    rows = spark.createDataFrame([(1, 1, "user", "Hi there."), (1, 2, "user", "Hi there."), (1, 3, "assistant", "Yes"), (2, None, "system", "Be kind.")], CONVERSATIONS)
    got = {r.conv_id: r for r in conversations.repaired(rows).collect()}
    assert (got[1].audit, got[1].cost, [tuple(t) for t in got[1].turns]) == ("KDK", 4, [("user", "Hi there."), ("assistant", "Yes")])
    assert (got[2].audit, got[2].cost, got[2].turns) == ("D", 3, [])
    assert (got[1].duplicate, got[1].truncated, got[1].illegal, got[2].gaps) == (1, 1, 1, 0)


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], CONVERSATIONS)
    assert conversations.summary(conversations.damaged(empty)).count() == 0
    gone = next(i for i in range(10**4) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    (row,) = conversations.summary(conversations.damaged(spark.createDataFrame([(gone, 1, "user", "Hi.")], CONVERSATIONS))).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# -- packing


def one_by_one(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(30))
def test_plan_equals_best_fit_one_by_one(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 37, 100])
    lengths = [min(capacity, max(1, int(rng.paretovariate(0.7)))) for _ in range(rng.randint(0, 300))] + [rng.randint(1, capacity)] * rng.randint(0, 200)
    plan = packing.best_fit(Counter(lengths), capacity)
    used, placed = {}, Counter()
    for s in plan:
        placed[s.length] += s.each * s.count
        for b in range(s.first, s.first + s.count):
            used.setdefault(b, []).append((s.offset, s.offset + s.each * s.length))
    assert placed == Counter(lengths)
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] <= capacity
    assert sorted(capacity - spans[-1][1] for spans in used.values()) == one_by_one(lengths, capacity)


def test_plan_depends_on_lengths_not_on_pieces():
    few, many = Counter({n: 7 for n in range(1, 500)}), Counter({n: 7 * 10**9 for n in range(1, 500)})
    assert len(packing.best_fit(many, 512)) < 20 * len(packing.best_fit(few, 512))
    with pytest.raises(ValueError):
        packing.best_fit({513: 1}, 512)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    rows = [(i, t) for i, t in enumerate(texts(rng, 120))] + [(None, "null id"), (3, "repeated"), (3, "repeated"), (500, None), (501, ""), (502, "long text " * 3000), (503, "<|endoftext|> literal")]
    rows += [(600 + i, "the same") for i in range(200)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], DOCS + ", length long, offset long").repartition(4)
    placed = packing.packed(docs, WORD_BPE, capacity=64, keep=True)
    got = [r.asDict() for r in placed.collect()]
    tokenizer = Tokenizer.from_file(WORD_BPE)
    want = Counter()
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want[i, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    rooms, by_sequence = [], {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["ids"]))
    for parts in by_sequence.values():
        parts.sort()
        at = 0
        for offset, length, _ in parts:
            assert offset == at
            at += length
        rooms.append(64 - at)
    assert sorted(rooms) == one_by_one([r["length"] for r in got], 64)
    whole = {r.sequence_id: r for r in packing.sequences(placed).collect()}
    assert {k: [t for *_, ids in v for t in ids] for k, v in by_sequence.items()} == {k: r.ids for k, r in whole.items()}
    assert all(r.n_tokens == len(r.ids) and r.parts[0].offset == 0 for r in whole.values())


def test_packing_of_nothing(spark):
    assert packing.packed(spark.createDataFrame([], DOCS), WORD_BPE).count() == 0


def test_tokens_of_sliced_arrays():
    given = pa.array(["zero", "One two", None, "two!three"]).slice(1)
    places, codes, names = lexical_search.tokens(given)
    assert [(int(p), names[int(c)].as_py()) for p, c in zip(places, codes)] == [(0, "one"), (0, "two"), (2, "two"), (2, "three")]
