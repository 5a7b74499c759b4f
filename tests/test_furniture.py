"""Headers, footers and page numbers against a plain two-pass fold over pages."""

import random
import re
from collections import defaultdict

import pytest

from tessera.operators import furniture

SCHEMA = "doc long, page long, height double, y double, text string, extra string"
TEXTS = ["Final Course 2024", "Page 3", "- 12 -", "7 of 9", "Question No. 4", "(a) Explain", "Case scenario 2", "Discuss.", "", None, "1234", "FINAL COURSE 7"]


def brute(rows):
    guard = re.compile(r"^\s*(?:question\s*(?:no\.?)?\s*\d+|case\s+scenario\b|\([a-h]\))", re.I)
    number = re.compile(r"^\s*(?:page\s*)?[-–—]?\s*\d{1,3}(?:\s*(?:of|/)\s*\d{1,3})?\s*[-–—]?\s*$", re.I)
    mask = lambda t: re.sub(r"\d+", "#", t.lower())
    near = lambda r, s: None not in (r[2], r[3]) and (r[3] <= s * r[2] or r[3] >= (1 - s) * r[2])
    pages, seen = defaultdict(set), defaultdict(set)
    for r in rows:
        pages[r[0]].add(r[1])
        if r[4] is not None and not guard.search(r[4]) and near(r, 0.08):
            seen[r[0], mask(r[4])].add(r[1])
    out = []
    for r in rows:
        n = len(pages[r[0]])
        if r[4] is None or guard.search(r[4]) or n == 1:
            out.append(r)
        elif not (near(r, 0.08) and len(seen[r[0], mask(r[4])]) >= max(2, n // 2)) and not (near(r, 0.1) and number.match(r[4])):
            out.append(r)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_cleaned_equals_fold(spark, seed):
    rng = random.Random(seed)
    rows = [(d, p, 100.0 if rng.random() < 0.95 else None, rng.choice([2.0, 8.0, 9.0, 10.0, 50.0, 90.0, 92.0, 99.0, None]), rng.choice(TEXTS), "x") for d in range(12) for p in range(d % 6 + 1) for _ in range(6)]
    rows += rows[:5]
    got = furniture.cleaned(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(rows)))
    assert len(got) < len(rows)


def test_empty_and_blank_pages(spark):
    assert furniture.cleaned(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = spark.createDataFrame([(1, p, 100.0, 1.0, f"Header {p}", None) for p in range(3)], SCHEMA)
    assert furniture.cleaned(rows).count() == 0
    # eight pages, of which three have lines: not half of them
    assert furniture.cleaned(rows, pages=spark.createDataFrame([(1, 8)], "doc long, n_pages long")).count() == 3
