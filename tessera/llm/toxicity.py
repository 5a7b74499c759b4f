"""Toxicity: a learned weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, maps homoglyphs to Latin letters and digit substitutions inside words to the
letters they stand for.  The lexicon holds words and word stems whose log-odds of appearing in toxic
rather than clean training documents are high; of near copies (one minhash of five-word runs) only one
document counts towards a pattern.  Phrases of a lexicon word and a neighbour that are found in clean
documents alone, more often than chance lets them, are exceptions.  A document's feature is its hits' summed weights, exception
phrases aside, over its length in words; one logistic curve turns that into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import appended, lookup, slices, stash, takes_worker, text_column

#: Letters that look like Latin ones, and digits or signs that stand for letters.
HOMOGLYPHS = {"а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ո": "n", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɑ": "a", "ı": "i"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
#: Phrases in which a lexicon word is harmless.
EXCEPTIONS = ("clown fish", "clown car", "trash can", "trash bin", "trash bag", "pond scum", "soap scum", "trash talk")

#: At most about so many labelled documents are read to learn the lexicon.
TRAIN_ROWS = 12_000
LOG_ODDS, SURPRISE, MOST_WEIGHT, THRESHOLD = 3.0, 11.5, 8.0, 0.7
#: Nats against a phrase's being clean by chance, given how often its lexicon word is, that make it an exception.
SPARED = 7.0

_FOLD = str.maketrans(HOMOGLYPHS | {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)} | dict.fromkeys(map(chr, (0x200B, 0x200C, 0x200D, 0xAD)), ""))
_ODD = re.compile("[" + "".join(HOMOGLYPHS) + "\uff01-\uff5e\u200b-\u200d\u00ad]")
_LEET = re.compile(r"(?<=[^\W\d_])[013457 8@$]+(?=[^\W\d_])|(?<!\w)[013457 8@$]+(?=[^\W\d_])".replace(" ", ""))
_UNLEET = str.maketrans(SUBSTITUTES)
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    text = text.lower()
    if _ODD.search(text):
        text = text.translate(_FOLD).lower()
    return _LEET.sub(lambda m: m[0].translate(_UNLEET), text)


@dataclass
class Lexicon:
    """Words and stems (matched at a word's start) by weight, exception phrases, and the curve's two parameters."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    bias: float = -4.0
    slope: float = 2.0

    def key(self) -> tuple:
        return (tuple(sorted(self.words.items())), tuple(sorted(self.stems.items())), self.exceptions)

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight), leftmost longest, without those inside an exception phrase."""
        machine = _machine(self.key())
        if machine is None:
            return []
        found, spared = [], []
        for end, (kind, size, weight) in machine.iter(folded):
            start, end = end - size + 1, end + 1
            if start and folded[start - 1].isalpha() or kind != "stem" and end < len(folded) and folded[end].isalpha():
                continue
            (spared if kind == "spare" else found).append((start, end, weight))
        out, at = [], 0
        for start, end, weight in sorted(found, key=lambda x: (x[0], -x[1])):
            if start >= at and not any(s <= start and end <= e for s, e, _ in spared):
                out.append((start, end, weight))
                at = end
        return out

    def feature(self, text: str) -> float:
        folded = fold(text)
        return math.log1p(100 * sum(w for _, _, w in self.hits(folded)) / (len(folded.split()) + 20))

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.bias + self.slope * self.feature(text)))))


@lru_cache(maxsize=4)
def _machine(key: tuple):
    words, stems, spared = key
    machine = ahocorasick.Automaton()
    for phrase in spared:
        machine.add_word(phrase, ("spare", len(phrase), 0.0))
    for kind, part in (("stem", stems), ("word", words)):
        for text, weight in part:
            machine.add_word(text, (kind, len(text), weight))
    if not len(machine):
        return None
    machine.make_automaton()
    return machine


def _patterns(words: set[str]) -> set[str]:
    """Words, and stems of 4 to 6 letters with a star."""
    return words | {f"{w[:n]}*" for w in words for n in (4, 5, 6) if len(w) >= n}


def _copy_key(words: list[str]) -> int:
    runs = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    return min(xxhash.xxh64_intdigest(r) for r in runs) - (1 << 63)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts = [fold(t) for t in text_column(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([pa.array([_copy_key(_WORD.findall(t)) for t in texts], pa.int64()), batch.column("label"), pa.array(texts, pa.string())], ["key", "label", "text"])


def _counted(only: frozenset[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in text_column(batch.column("text")):
                own = _patterns(set(_WORD.findall(text)))
                seen.update(own if only is None else own & only)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pattern", "n"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Bias and slope by Newton's steps on a lightly penalised likelihood."""
    w, design = np.zeros(2), np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + 0.05 * w
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 0.0))


def _surprise(toxic: int, clean: int, prior: float) -> float:
    """Nats against such a split by chance (Chernoff's bound): rare words that fell to one class by luck have few."""
    n = toxic + clean
    return sum(k * math.log(k / n / q) for k, q in ((toxic, prior), (clean, 1 - prior)) if k)


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Fit a lexicon to ``docs`` (doc_id, text) and ``labels`` (doc_id, label 0 or 1).

    About ``rows`` labelled documents, chosen by a hash of their id, are read, whole and with all their patterns;
    null ids and labels other than 0 and 1 are left out, null texts count as empty, repeated ids as documents each.
    Without both classes the lexicon is empty and every score is the prior's.
    """
    marked = labels.where("doc_id is not null and label in (0, 1)").select("doc_id", F.col("label").cast("long").alias("label"))
    total = marked.count()
    if total > rows:
        marked = marked.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < int(1e6 * rows / total))
    marked = stash(marked)
    sample = docs.select("doc_id", "text").join(lookup(marked), "doc_id").select("label", "text")
    kept = stash(sample.mapInArrow(_folded, "key long, label long, text string"))
    one = stash(kept.dropDuplicates(["key", "label"]))
    sizes = {r["label"]: r["n"] for r in one.groupBy("label").agg(F.count("*").alias("n")).collect()}
    out, n_toxic, n_clean = Lexicon(exceptions=exceptions), sizes.get(1, 0), sizes.get(0, 0)
    if n_toxic and n_clean:
        least = max(3, n_toxic // 300)
        toxic = one.where("label = 1").select("text").mapInArrow(_counted(None), "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        t = {r["pattern"]: r["n"] for r in toxic.collect()}  # bounded by the sample's documents
        clean = one.where("label = 0").select("text").mapInArrow(_counted(frozenset(t)), "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
        c = {r["pattern"]: r["n"] for r in clean.collect()}
        odds = {p: math.log((n + 0.5) / (n_toxic + 1)) - math.log((c.get(p, 0) + 0.5) / (n_clean + 1)) for p, n in t.items()}
        prior = n_toxic / (n_toxic + n_clean)
        good = {p: min(w, MOST_WEIGHT) for p, w in odds.items() if w >= LOG_ODDS and _surprise(t[p], c.get(p, 0), prior) >= SURPRISE}
        longest: dict[str, int] = {}
        for p in t:
            if not p.endswith("*"):
                for n in (4, 5, 6):
                    longest[f"{p[:n]}*"] = max(longest.get(f"{p[:n]}*", 0), t[p])
        for p in sorted((p for p in good if p.endswith("*")), key=len):
            if t[p] >= 1.5 * longest.get(p, 0) and not any(p.startswith(s) for s in out.stems):
                # the longest stem that keeps nine tenths of the support harms the fewest other words
                best = max((q for q in good if q.endswith("*") and q.startswith(p[:-1]) and t[q] >= 0.9 * t[p]), key=lambda q: (len(q), q))
                out.stems[best[:-1]] = good[best]
        out.words = {p: w for p, w in good.items() if not p.endswith("*") and not any(p.startswith(s) for s in out.stems)}
        out.exceptions = (*exceptions, *_exceptions(one, out, t, c))
    seen = kept.select("label", "text").mapInArrow(_features(out), "x double, label long").toPandas()
    if n_toxic and n_clean:
        out.bias, out.slope = _logistic(seen["x"].to_numpy(), seen["label"].to_numpy(float))
    elif len(seen):
        out.bias, out.slope = (4.0 if n_toxic else -4.0), 0.0
    return out


def _exceptions(one: DataFrame, lexicon: Lexicon, toxic: dict[str, int], clean: dict[str, int]) -> list[str]:
    """Phrases of two words around a hit that no toxic document has and that clean ones have against its word's odds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text, label in zip(text_column(batch.column("text")), batch.column("label").to_pylist()):
                own = set()
                for start, end, _ in lexicon.hits(text):
                    stop = next((m.end() for m in [_WORD.match(text, start)] if m), end)
                    key = text[start:stop] if text[start:stop] in lexicon.words else next((f"{s}*" for s in lexicon.stems if text.startswith(s, start)), "")
                    before, behind = re.search(r"[^\W\d_]+ $", text[max(0, start - 40) : start]), re.match(r" [^\W\d_]+", text[stop : stop + 40])
                    own |= {(text[start - len(before[0]) : stop], key)} if before else set()
                    own |= {(text[start : stop + len(behind[0])], key)} if behind else set()
                seen.update((phrase, key, label) for phrase, key in own)
        rows = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))] + [pa.array(list(seen.values()), pa.int64())], ["phrase", "pattern", "label", "n"])

    counts = one.select("text", "label").mapInArrow(run, "phrase string, pattern string, label long, n long").groupBy("phrase", "pattern").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean"))
    found = []
    for r in counts.where("toxic = 0 and clean >= 3").collect():
        share = toxic.get(r["pattern"], 0) / max(1, toxic.get(r["pattern"], 0) + clean.get(r["pattern"], 0))
        if -r["clean"] * math.log(max(1 - share, 1e-9)) >= SPARED:
            found.append(r["phrase"])
    return sorted(found)


def _features(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.feature(t) for t in text_column(batch.column("text"))], pa.float64()), batch.column("label")], ["x", "label"])

    return run


def scored(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """All rows and columns, plus ``name`` (0 to 1), which replaces a column of that name. A null or empty text scores as text without hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        takes_worker("toxicity")
        for batch in slices(batches, text_col):
            score = pa.array([lexicon.score(t) for t in text_column(batch.column(text_col))], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, name])

    left, schema = appended(docs, name, "double")
    return left.mapInArrow(run, schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """The rows of ``labels`` whose crc32 of the id's decimal text is not 1 modulo 3."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1).select("doc_id", F.col("toxic").alias("label"))
