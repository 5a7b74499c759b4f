"""Text functions: normalisation, keys, tokens, fuzzy ratios, anchors, links."""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StringType

#: Words that carry no topic, left out of retrieval.
STOPWORDS = ("that", "this", "with", "from", "have", "will", "which", "their", "there", "been", "were")


@pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode NFKC; no built-in does it."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def masked(text: Column) -> Column:
    """Lower case with runs of digits as #: the fingerprint of running headers."""
    return F.regexp_replace(F.lower(text), r"\d+", "#")


def retrieval_tokens(text: Column) -> Column:
    """The words (runs of letters, digits and _) in order, lower case; null in the place of one that isn't a retrieval token.

    A token is a letter and three or more letters or digits, and no stop word.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.transform(words, lambda w: F.when(w.rlike(f"^(?!(?:{'|'.join(STOPWORDS)})$)[a-z][a-z0-9]{{3,}}$"), w))


def tokens(marked: Column) -> Column:
    """Distinct tokens of ``retrieval_tokens``."""
    return F.array_distinct(F.filter(marked, lambda w: w.isNotNull()))


def phrases(marked: Column) -> Column:
    """Distinct pairs of tokens side by side, joined by a blank."""
    pairs = F.zip_with(marked, F.slice(marked, F.lit(2), F.size(marked)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.filter(pairs, lambda p: p.isNotNull()))


def whole_phrase(text: Column, phrase: str) -> Column:
    """The phrase bounded by non-word characters."""
    return text.rlike(rf"(?<!\w){re.escape(phrase)}(?!\w)")


def gist(text: Column, words: int = 25) -> Column:
    """The first line, cut after so many words."""
    parts = F.split(collapsed(F.element_at(F.split(text, "\n"), 1)), " ")
    return F.concat(F.array_join(F.slice(parts, 1, words), " "), F.when(F.size(parts) > words, "...").otherwise(""))


def fingerprint(*parts: Column) -> Column:
    """SHA-1 of the parts joined by bars, the last one collapsed and lowered."""
    return F.sha1(F.concat_ws("|", *parts[:-1], F.lower(collapsed(parts[-1]))))


def canonical_digest(*columns: str) -> Column:
    """SHA-256 of compact JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by one wide word whose zero bits mark it."""
    short, long = sorted((a, b), key=len)
    places: dict[str, int] = {}
    for i, c in enumerate(short):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(short)) - 1
    row = full
    for c in long:
        if at := places.get(c):
            hit = row & at
            row = (row + hit | row - hit) & full
    return len(short) - row.bit_count()


#: Code points of windows that are combed at once, at least one pair of them.
_COMB = 1 << 20


def _window_lcs(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """The longest common subsequence of ``short`` with every window of its length in ``long``.

    Semi-local alignment: ``long`` is cut into overlapping pieces of two lengths, and all pieces are combed together
    along anti-diagonals.  A piece's strands that run from its top edge to its bottom edge then give all its windows
    at once: each strand inside a window takes one from its length.  Time is the product of the lengths, memory
    their sum.
    """
    m = len(short)
    starts = len(long) - m + 1
    pieces = -(-starts // m)
    long = np.append(long, np.zeros(pieces * m + m - len(long), long.dtype))
    kind = np.int16 if 3 * m < 2**15 else np.int32
    back, out = short[::-1], []
    for first in range(0, pieces, step := max(1, _COMB // m)):
        rows = min(step, pieces - first)
        piece = np.lib.stride_tricks.sliding_window_view(long[first * m : (first + rows + 1) * m], 2 * m)[::m].copy()
        across = np.tile(np.arange(m, dtype=kind), (rows, 1))
        down = np.tile(np.arange(m, 3 * m, dtype=kind), (rows, 1))
        for d in range(3 * m - 1):
            low, high = max(0, d - 2 * m + 1), min(m - 1, d)
            h, v = across[:, m - 1 - high : m - low], down[:, d - high : d - low + 1]
            bend = (back[m - 1 - high : m - low] == piece[:, d - high : d - low + 1]) | (h > v)
            turned = np.where(bend, v, h)
            v[:] = np.where(bend, h, v)
            h[:] = turned
        begin, end = down.astype(np.int64) - m, np.arange(2 * m)
        since, until = np.maximum(0, end - m + 1) + np.zeros_like(begin), np.minimum(begin, m - 1)
        row = np.arange(rows)[:, None] * (m + 1) + np.zeros_like(begin)
        held = (begin >= 0) & (since <= until)
        change = np.bincount((row + since)[held], minlength=rows * (m + 1)) - np.bincount((row + until + 1)[held], minlength=rows * (m + 1))
        out.append(m - np.cumsum(change.reshape(rows, m + 1), axis=1)[:, :m].ravel())
    return np.concatenate(out)[:starts]


def _best_window(short: str, long: str) -> float:
    if short in long:
        return 1.0
    m, n = len(short), len(long)
    a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (short, long))
    known = np.unique(a)
    code = lambda t: np.where(known[np.minimum(np.searchsorted(known, t), len(known) - 1)] == t, np.searchsorted(known, t) + 1, 0).astype(np.int32)
    none = np.zeros(m, np.int32)
    common = _window_lcs(code(a), np.concatenate([none, code(b), none]))
    start = np.arange(len(common)) - m
    held = np.minimum(start + m, n) - np.maximum(start, 0)
    return float(np.max(2 * common / (m + held)))


def _partial(a: str, b: str) -> float:
    """Best ratio of the shorter text with a window of the longer one (shorter ones at its ends), 0 to 100.

    A ratio is twice the longest common subsequence over both lengths; every window of the whole text counts.
    """
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    best = _best_window(short, long)
    if len(short) == len(long):
        best = max(best, _best_window(long, short))
    return round(100 * best, 4)


def _token_set(a: str, b: str) -> float:
    """Ratio of the common words against each side's words, 0 to 100."""
    x, y = set(a.split()), set(b.split())
    if x & y and (not x - y or not y - x):
        return 100.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    head = len(both) + 1 if both else 0  # what both sides begin with
    sizes = [(len(both), head + len(left), len(both)), (len(both), head + len(right), len(both)), (head + len(left), head + len(right), head + _lcs(left, right))]
    return round(100 * max(2 * common / (p + q) if p + q else 0.0 for p, q, common in sizes), 4)


@pandas_udf(DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _partial(x, y) for x, y in zip(a, b)], dtype="float64")


@pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _token_set(x, y) for x, y in zip(a, b)], dtype="float64")


class _Links(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.found: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        name = {"a": "href", "iframe": "src", "embed": "src", "object": "data"}.get(tag)
        self.found += [v for k, v in attrs if k == name and v]


@pandas_udf(ArrayType(StringType()))
def links(html: pd.Series, base: pd.Series) -> pd.Series:
    """Absolute targets of a, iframe, embed and object, without fragments, http as https, in order, distinct."""

    def of(page: str | None, url: str | None) -> list[str]:
        parser = _Links()
        parser.feed(page or "")
        out = [urldefrag(urljoin(url or "", v)).url for v in parser.found]
        return list(dict.fromkeys("https" + u[4:] if u.startswith("http:") else u for u in out))

    return pd.Series([of(h, b) for h, b in zip(html, base)])
