"""Segmentation against a reader that goes line by line and keeps its state in variables."""

import hashlib
import random
import re

import pytest

from tessera.operators import segmentation as G

LINES = "doc long, n int, page int, text string"


def read(lines, p):
    """The units of one document's (n, page, text), as a fold."""
    order = ["case", "question", "part", "subpart", "mcq"]
    units, index, current = [], {}, dict.fromkeys(order)
    paper = section = ""
    answers, region, pending, ors, fresh_parts, nominal = False, "question", None, 0, set(), ""
    match = lambda k, t: (m := re.search(getattr(p, k), t)) and m[1]

    def deepest():
        return next((current[k] for k in reversed(order) if current[k]), None)

    for n, page, text in sorted(lines):
        text = text or ""
        if (t := match("paper", text)) or match("section", text):
            if t:
                paper, section = f"P{t}", ""
            else:
                section = "S" + match("section", text)
            current = dict.fromkeys(order)
            continue
        if match("answer", text):
            region = "answer"
            if p.sectioned:
                answers, current = True, dict.fromkeys(order)
            continue
        if match("separator", text):
            if prev := deepest():
                ors += 1
                prev["or_group"] = pending = prev["or_group"] or f"{prev['parent'] or 'root'}.or{ors}"
            continue
        scope = ".".join(x for x in (paper, section) if x)
        kind, option = None, None
        for k in order if not current["mcq"] else ["case", "mcq", "question"]:
            if k == "mcq" and (not current["case"] or answers):
                continue
            if k in ("part", "subpart"):
                k = "subpart" if match("subpart", text) else "part"
            if match(k, text) and not (k == "question" and current["case"] and not answers and match("mcq", text)):
                kind = k
                break
        if kind is None and current["mcq"]:
            option = match("option", text)
        if kind:
            token = {"case": "CS", "question": "Q", "mcq": "M"}.get(kind, "") + match(kind, text)
            token = token if kind in ("case", "question", "mcq") else token.lower()
            parent = {"case": [], "question": ["case"], "mcq": ["case"], "part": ["question", "case"], "subpart": ["part", "question", "case"]}[kind]
            parent = next((current[k] for k in parent if current[k]), None)
            base = f"{parent['label_path']}.{token}" if parent else ".".join(x for x in (scope, token) if x)
            if kind == "case":
                region, answers = "question", False
            elif kind in ("question", "mcq"):
                region = region if answers else "question"
            else:
                above = next((current[k]["label_path"] for k in ("question", "case") if current[k]), scope)
                name = ".".join(x for x in (nominal if kind == "subpart" and current["part"] else above, token) if x)
                if name not in fresh_parts and not answers:
                    region = "question"
                fresh_parts.add(name)
                nominal = name if kind == "part" else nominal
            merge = base in index and (answers if kind == "question" else region == "answer" if kind in ("part", "subpart") else False)
            path, again = base, 1
            if not merge:
                while path in index:
                    again += 1
                    path = f"{base}.{'alt' if pending else 'repeat'}{again}"
                unit = {"label_path": path, "kind": kind, "parent": parent and parent["label_path"], "page_start": page, "page_end": page, "first_line": n, "marks": None, "or_group": pending, "asked": [], "answered": [], "options": [], "correct": None, "children": []}
                index[path] = unit
                (parent["children"] if parent else units).append(unit)
            pending = None
            for k in order[order.index(kind) :]:
                current[k] = None
            current[kind] = index[path]
        target = deepest()
        if target is None:
            continue
        target["page_end"], target["last_line"] = max(target["page_end"], page), n
        if target["marks"] is None and (m := match("marks", text)):
            target["marks"] = int(m)
        if option:
            if region == "question":
                target["options"].append(text)
            else:
                target["correct"] = target["correct"] or option.upper()
        target["answered" if region == "answer" else "asked"].append(text)

    def attemptable(u):
        if not u["children"]:
            return u["marks"] or 0
        groups = {}
        for c in u["children"]:
            groups.setdefault(c["or_group"] or c["label_path"], []).append(attemptable(c))
        return sum(map(max, groups.values()))

    def close(u):
        u["marks"] = p.mcq_marks if u["kind"] == "mcq" and u["marks"] is None else u["marks"]
        for c in u["children"]:
            close(c)
        if u["children"]:
            u["page_start"], u["page_end"] = min(u["page_start"], u["children"][0]["page_start"]), max(u["page_end"], u["children"][-1]["page_end"])
            if all(c["marks"] is not None for c in u["children"]):
                u["marks"] = attemptable(u)

    for u in units:
        close(u)
    return index


def digest(u):
    return hashlib.sha256(("\n".join(u["asked"]) + "\n" + "\n".join(u["answered"])).encode()).hexdigest()


def compare(spark, rows, profile):
    got = {(r["doc"], r["label_path"]): r.asDict() for r in G.units(spark.createDataFrame(rows, LINES).repartition(3), profile).collect()}
    want = {(d, path): u for d in {r[0] for r in rows} for path, u in read([r[1:] for r in rows if r[0] == d], profile).items()}
    assert got.keys() == want.keys()
    for key, u in want.items():
        r = got[key]
        assert {k: r[k] for k in ("kind", "parent", "page_start", "page_end", "first_line", "last_line", "marks", "or_group", "options")} == {k: u[k] for k in ("kind", "parent", "page_start", "page_end", "first_line", "last_line", "marks", "or_group", "options")}, key
        assert (r["correct_option"], r["content_digest"], r["gradable"]) == (u["correct"], digest(u), not u["children"] and u["kind"] != "case"), key


PAPER = """Instructions
Question 1 Leases
(a) Explain. (4 marks)
more of it
(i) first (2 marks)
(ii) second (3 marks)
(b) Describe. (6 marks)
OR
(b) Outline. (8 marks)
Answer
(a) Because
(i) so
(c) a new part (1 mark)
SECTION B
Case Scenario 1 A company
1. Which one?
(A) this
(B) that
2. And?
(A) x
Question 1 again (5 marks)
OR
Question 2 instead (5 marks)
OR
Question 3 or this (7 marks)
Question 1 repeats"""


def test_a_paper(spark):
    rows = [(1, i, i // 6 + 1, t) for i, t in enumerate(PAPER.split("\n"))]
    compare(spark, rows, G.Profile())
    got = {r["label_path"]: r for r in G.units(spark.createDataFrame(rows, LINES)).collect()}
    assert got["Q1"]["marks"] == 5 + 8 + 1 and got["Q1"]["marks_source"] == "summed" and got["Q1.b"]["or_group"] == got["Q1.b.alt2"]["or_group"] == "Q1.or1"
    assert got["SB.CS1.M1"]["options"] == ["(A) this", "(B) that"] and got["SB.CS1.M2"]["marks_source"] == "mcq_default"
    assert got["SB.CS1.Q1.repeat2"]["repeated"] and got["Q1.a"]["answer_text"] == "(a) Because" and got["Q1.a.i"]["answer_text"] == "(i) so"
    assert {got[f"SB.CS1.Q{i}"]["or_group"] for i in (1, 2, 3)} == {"SB.CS1.or2"}


@pytest.mark.parametrize("sectioned", [False, True])
def test_random_papers(spark, sectioned):
    rng = random.Random(11)
    some = ["Paper 1", "Section A", "Section B", "Case Scenario 1 x", "Case Scenario 2", "Question 1 (4 marks)", "Question 2", "Question 2 (3 marks)", "(a) part (2 marks)", "(a) again", "(b) other", "(b) more (5 Marks)", "(i) one (1 mark)", "(ii) two", "1. Item", "2. Item (3 marks)", "(A) option", "(B) option", "Answer", "OR", "text", "text (9 marks)", None]
    rows = [(d, n, n // 5, rng.choice(some)) for d in range(120) for n in range(rng.randint(0, 30))]
    compare(spark, rows, G.Profile(sectioned=sectioned))


def test_documents_over_many_batches(spark):
    key, old = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = [(d, n, n // 6 + 1, t) for d in range(7) for n, t in enumerate(PAPER.split("\n")[: 40 - 5 * d])] + [(9, 0, 1, "no unit")]
    try:
        for size in (1, 3, 37):
            spark.conf.set(key, str(size))
            compare(spark, rows, G.Profile())
    finally:
        spark.conf.set(key, old)


def test_a_line_that_several_patterns_match(spark):
    profile = G.Profile(mcq=r"^Question (\d+) x\s*$|^(?:\d+)\.\s", part=r"^\(([a-iA-D])\)", option=r"^\(([A-Di])\)\s")
    rows = [(1, n, 1, t) for n, t in enumerate(["Question 1 x", "(i) sub", "(A) part", "Case Scenario 2 x", "Question 4 x", "(i) option ", "(A) option", "Question 5 y", "(i) sub", "(b) part", "Answer", "Question 4 x", "(A) right"])]
    got = {r["label_path"]: (r["kind"], r["options"], r["correct_option"]) for r in G.units(spark.createDataFrame(rows, LINES), profile).collect()}
    want = {"Q1": "question", "Q1.i": "subpart", "Q1.a": "part", "CS2": "case", "CS2.M4": "mcq", "CS2.Q5": "question", "CS2.Q5.i": "subpart", "CS2.Q5.b": "part", "CS2.M4.repeat2": "mcq"}
    assert {k: v[0] for k, v in got.items()} == want and got["CS2.M4"][1] == ["(i) option ", "(A) option"]


def test_lines_are_sorted_once_in_partitions_by_the_files(spark, sf_dir, monkeypatch):
    from tessera.plans import papers
    from tessera.sources import tables

    monkeypatch.setattr(tables, "PARTITION_BYTES", 4096)
    plan = papers.d06_paper_units(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    counts = [int(c) for c in re.findall(r"hashpartitioning\([^\n]*?, (\d+)\)", plan)]
    assert counts == [tables.partitions(spark, sf_dir, "lineitem")] and counts[0] > 4
    assert len(re.findall(r"\bSort \[", plan)) == 2  # an order's lines, then the lines of its text


def test_no_lines(spark):
    assert G.units(spark.createDataFrame([], LINES)).count() == 0
