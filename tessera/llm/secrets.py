"""Secret scans: fixed patterns, plus character Markov models compared by log-likelihood ratio.

Bigram models over a 65-symbol alphabet are trained from labelled samples: random strings drawn by a seeded
generator, one model for each alphabet that keys are written in (base64 and base64url, base 36, capitals with
digits, small letters, hex), and ordinary identifiers, names, paths and compounds built from everyday words.
Candidates are runs of [A-Za-z0-9+/_=-].  In a run, the stretch whose log-likelihood ratio of random over
ordinary, less ``DRIFT`` nats a character, is largest is a ``markov`` span if it reaches ``THRESHOLD`` nats; what
lies left and right of it is searched likewise.  So keys in paths, after names or between separators are found,
with or without digits.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import slices, text_column

#: Fixed patterns of the base kinds and the least length of what must be that long.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "markov")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: Least length of a markov span and of runs that may hold one, its least different characters, and the two levels (see above).
LEAST_RANDOM, LEAST_KINDS, THRESHOLD, DRIFT = 16, 6, 12.0, 0.1
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_RANDOM)
ALPHABET = string.ascii_letters + string.digits + "+/_="
KEY_ALPHABETS = (
    (string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_", string.ascii_letters + string.digits),
    (string.ascii_lowercase + string.digits,),
    (string.ascii_uppercase + string.digits,),
    (string.ascii_lowercase,),
    ("0123456789abcdef",),
)
SAMPLES, SEED = 6000, 11
#: Everyday words that identifiers are built from.
WORDS = (
    "account article batch block buffer change channel check city class client close code column company config content control "
    "country create current data date default document domain email engine error export field file filter format function game group header history home house image import index "
    "international language library list local machine message method model morning name number object option order output page parameter people price product project "
    "record report request research result search section server service session setting source string student system table through time together transaction update user "
    "version website where which window without world year "
    "arbeit ausgabe beispiel bereich deutsch eigentlich einheit entwicklung gesellschaft geschichte herausforderung jahrhundert kirche leistung menschen möglichkeit nachricht schreiben schule sprache stadt verbindung verwaltung wirtschaft wissenschaft zeitung zwischen "
    "administration aujourd beaucoup bonjour chapitre chemin communication développement environnement gouvernement histoire information jamais lumière maison montagne nouvelle pendant peuple quelque toujours travail universitaire vraiment "
    "actualmente ayuntamiento biblioteca camino ciudad comunidad conocimiento desarrollo después ejemplo entonces gobierno historia investigación mientras montaña mundo naturaleza pregunta pueblo siempre sociedad tiempo trabajo universidad verdadero"
).split()

_CODE = np.full(128, len(ALPHABET), np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
_CODE[ord("-")] = ALPHABET.index("_")


def labelled_samples(n: int = SAMPLES, seed: int = SEED) -> tuple[list[list[str]], list[str]]:
    """(random strings of each kind of alphabet, ordinary identifiers), n of each; the same for the same arguments."""
    rng = random.Random(seed)
    noise = [["".join(rng.choices(kinds[i % len(kinds)], k=rng.randint(16, 64))) for i in range(n)] for kinds in KEY_ALPHABETS]
    words = [re.sub("[^a-z]", lambda m: {"ö": "o", "é": "e", "è": "e", "ó": "o", "ñ": "n"}.get(m[0], ""), w) for w in WORDS]
    spell = (lambda w: "_".join(w), lambda w: "-".join(w), lambda w: "".join(x.title() for x in w), lambda w: "_".join(w).upper(), lambda w: "/".join(w), "".join, lambda w: w[0] + "".join(x.title() for x in w[1:]), lambda w: "=".join(w), lambda w: "/" + "/".join(w) + "/", lambda w: "".join(x[: rng.randint(2, 9)] for x in w))
    plain = []
    for i in range(n):
        own = rng.choices(words, k=rng.randint(2, 6))
        if rng.random() < 0.3:
            own.insert(rng.randint(1, len(own)), str(rng.choice([rng.randint(0, 99), rng.randint(1990, 2035), rng.randint(10**6, 10**12)])))
        plain.append(spell[i % len(spell)](own))
    return noise, plain


def train(samples: list[str]) -> np.ndarray:
    """log P(next | previous) with add-half smoothing; row -1 is the start of a string."""
    size = len(ALPHABET) + 1
    counts = np.full((size + 1, size), 0.5)
    for s in samples:
        code = _CODE[np.frombuffer(s.encode("ascii"), np.uint8)]
        np.add.at(counts, (np.append(size, code[:-1]), code), 1)
    return np.log(counts / counts.sum(axis=1, keepdims=True))


@functools.cache
def model() -> np.ndarray:
    """Log-likelihood ratios of transitions less DRIFT, random over ordinary, for each kind of alphabet."""
    noise, plain = labelled_samples()
    ordinary = train(plain)
    return np.stack([train(own) - ordinary for own in noise]) - DRIFT


def _stretches(gain: np.ndarray, run: str, at: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches of a run that reach the threshold; ``gain``: kinds x characters."""
    if len(run) < LEAST_RANDOM:
        return []
    sums = np.concatenate([np.zeros((len(gain), 1)), np.cumsum(gain, axis=1)], axis=1)
    # the best stretch that ends at each place, at least LEAST_RANDOM long
    low = np.minimum.accumulate(sums, axis=1)[:, : len(run) + 1 - LEAST_RANDOM]
    best = sums[:, LEAST_RANDOM:] - low
    kind, end = np.unravel_index(int(best.argmax()), best.shape)
    if best[kind, end] < THRESHOLD:
        return []
    end += LEAST_RANDOM
    start = int(sums[kind, : end + 1 - LEAST_RANDOM].argmin())
    own = run[start:end]
    core = own.strip("=/_-+")
    inner = (start + own.index(core), start + own.index(core) + len(core)) if core else (start, end)
    out = _stretches(gain[:, :start], run[:start], at) + _stretches(gain[:, end:], run[end:], at + end)
    if len(core) >= LEAST_RANDOM and len(set(core)) >= LEAST_KINDS and 8 * sum(map(str.isalpha, core)) >= len(core):
        out.append((at + inner[0], at + inner[1]))
    return out


def random_stretches(runs: list[str], ratios: np.ndarray) -> dict[str, list[tuple[int, int]]]:
    """The random stretches of each run that has any; all runs' gains are looked up together."""
    if not runs:
        return {}
    code = _CODE[np.frombuffer("".join(runs).encode("ascii"), np.uint8)]
    cuts = np.cumsum([0, *map(len, runs)])
    before = np.concatenate([[0], code[:-1]])
    before[cuts[:-1]] = len(ALPHABET) + 1
    gain = ratios[:, before, code]
    # no stretch gains more than all gains together
    hopeful = np.flatnonzero((np.add.reduceat(np.maximum(gain, 0), cuts[:-1], axis=1) >= THRESHOLD).any(axis=0))
    return {runs[i]: found for i in hopeful.tolist() if (found := _stretches(gain[:, cuts[i] : cuts[i + 1]], runs[i], 0))}


def spans_of(texts: list[str], ratios: np.ndarray) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) in code points of each text, by start and then kind; spans of different kinds may overlap.

    Base kinds are leftmost non-overlapping matches of their pattern, those too short dropped; a markov
    span that lies within a base span adds nothing and is left out.
    """
    runs = [list(CANDIDATE.finditer(t)) for t in texts]
    noisy = random_stretches(list({m[0] for own in runs for m in own}), ratios)
    out = []
    for text, own in zip(texts, runs):
        found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]] if ":" in text or "=" in text else []
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
        # a hex match of 24 characters lies in a candidate run, so only those are searched
        for run in own:
            if run.end() - run.start() >= LEAST["hex"]:
                found += [("hex", *m.span()) for m in HEX.finditer(text, *run.span()) if m.end() - m.start() >= LEAST["hex"]]
        base = [(s, e) for _, s, e in found]
        for run in own:
            for s, e in noisy.get(run[0], ()):
                s, e = s + run.start(), e + run.start()
                if not any(a <= s and e <= b for a, b in base):
                    found.append(("markov", s, e))
        out.append(sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))
    return out


def spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of one text."""
    return spans_of([text], model())[0]


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def redacted(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with every span (overlapping ones merged) replaced by ``[SECRET]``."""
    out, at = [], 0
    for _, s, e in sorted(found, key=lambda x: x[1]):
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, n_markov, base_sha256, spans of every row's whole text.

    A null text counts as empty; rows without a secret have zeros, the digest of the empty string
    and an empty string.  Ids may be null or repeat; an empty table gives an empty result; further columns are
    left out, whatever their names.
    """
    kind, ratios = docs.schema[id_col].dataType.simpleString(), model()  # one small model, trained here and sent with the tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            found = spans_of(text_column(batch.column(text_col)), ratios)
            counts = [pa.array([sum(k == kind for k, _, _ in f) for f in found], pa.int64()) for kind in KINDS]
            base = [hashlib.sha256(joined([x for x in f if x[0] != "markov"]).encode()).hexdigest() for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *counts, pa.array(base, pa.string()), pa.array([joined(f) for f in found], pa.string())], [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns, secrets in the text replaced; a character count column follows the new text. Null texts stay null."""
    ratios = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts = batch.column(text_col).to_pylist()
            new = [t if t is None else redacted(t, found) for t, found in zip(texts, spans_of(["" if t is None else t for t in texts], ratios))]
            columns = {n: c for n, c in zip(batch.schema.names, batch.columns)}
            columns[text_col] = pa.array(new, batch.schema.field(text_col).type)
            if chars_col in columns:
                old = columns[chars_col]
                columns[chars_col] = pa.array([o if a == b else len(b) for o, a, b in zip(old.to_pylist(), texts, new)], old.type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(run, docs.schema)
