"""Lines of a paper to its tree of units: cases, questions, parts, subparts and multiple-choice items.

Spark deals the documents out, puts their lines in order and extracts the tokens of each line; tasks then read their
lines in Arrow batches of whole documents.  State that a reader would carry from line to line (the scope, the open unit
of each level, whether answers are being read, a pending OR) is the position of the last line that set it, a running
maximum over the batch.  Lines are shuffled and sorted once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Profile:
    """Patterns of a layout, each with its token (or marks) as group 1; they look at a line's text."""

    paper: str = r"(?i)^paper\s+(\d+)\b"
    section: str = r"(?i)^section\s+([A-Z])\b"
    case: str = r"(?i)^case\s+scenario\s+(\d+)\b"
    question: str = r"(?i)^question\s*(?:no\.?)?\s*(\d+)\b"
    part: str = r"^\(([a-hA-H])\)"
    subpart: str = r"^\(([ivx]+)\)"
    mcq: str = r"^(\d+)\.\s"
    option: str = r"^\(([A-D])\)\s"
    answer: str = r"(?i)^((?:suggested\s+)?answers?)\b"
    separator: str = r"^(OR)$"
    marks: str = r"(?i)\((\d+)\s+marks?\)"
    #: Answers follow in a section of their own, after all questions, instead of under each one.
    sectioned: bool = False
    mcq_marks: int = 2


LEVELS = ("case", "question", "part", "subpart", "mcq")
CASE, QUESTION, PART, SUBPART, MCQ = range(5)
#: What a line opens with, in the order in which patterns are tried: a control (of no unit), a case or a question.
HEADS = ("paper", "section", "answer", "separator", "case", "question")
IS_PAPER, IS_SECTION, IS_ANSWER, IS_SEPARATOR, IS_CASE, IS_QUESTION = range(1, 7)
#: ``state`` of a line: the number of its head, and bits for a subpart's token and for the first line of a document.
HAS_SUBPART, FIRST = 8, 16
NO_PAGE = np.iinfo(np.int64).max


def _joined(above: pa.Array, below: pa.Array) -> pa.Array:
    """Both with a point between, or the one that isn't null."""
    return pc.coalesce(pc.binary_join_element_wise(above, below, "."), above, below)


def _taken(values: pa.Array, at: np.ndarray) -> pa.Array:
    """Values by position, null at -1."""
    return values.take(pa.array(at, mask=at < 0))


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


class _Lines:
    """Lines of whole documents in order; ``last`` and ``open`` give positions of lines within the same document."""

    def __init__(self, first: np.ndarray):
        self.at = np.arange(len(first))
        self.start = np.maximum.accumulate(np.where(first, self.at, 0))
        self.doc = np.cumsum(first)

    def last(self, where: np.ndarray, before: bool = False) -> np.ndarray:
        """The last line up to each one (or before it) where it holds, else -1."""
        found = np.maximum.accumulate(np.where(where, self.at, -1))
        if before:
            found = np.concatenate(([-1], found[:-1]))
        return np.where(found >= self.start, found, -1)

    def open(self, begins: np.ndarray, ends: np.ndarray, before: bool = False) -> np.ndarray:
        """The last line that begins something, unless a later one ended it, else -1."""
        found = self.last(begins | ends, before)
        return np.where((found >= 0) & begins[found], found, -1)

    def keys(self, at: np.ndarray, names: pa.Array) -> np.ndarray:
        """Numbers of (document, name) of some lines."""
        codes = names.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        return self.doc[at] * (len(self.at) + 1) + codes


class _Paths:
    """Paths of the lines that begin a unit, as they become known level by level."""

    def __init__(self, n: int):
        self.slot, self.values, self.new = np.full(n, -1), pa.array([], pa.string()), np.zeros(n, bool)

    def of(self, at: np.ndarray) -> pa.Array:
        return _taken(self.values, np.where(at >= 0, self.slot[at], -1))

    def add(self, lines: _Lines, at: np.ndarray, base: pa.Array, creates: np.ndarray, pending: np.ndarray) -> None:
        """Units begin at these lines under a path each; a path that is taken gets the next .repeatN or .altN."""
        if len(at) == 0:
            return
        key = lines.keys(at, base)
        o = np.argsort(key, kind="stable")
        starts = _starts(key[o])
        group = np.repeat(starts, np.diff(np.append(starts, len(o))))

        def sofar(where: np.ndarray) -> np.ndarray:
            """How many lines of the same path so far."""
            total = np.cumsum(where)
            return total - total[group] + where[group]

        new = creates[o].copy()
        new[starts] = True
        again = new & (sofar(new) > 1)
        alt = again & pending[at][o]
        nth = np.where(alt, sofar(alt), sofar(again & ~alt)) + 1
        back = np.empty(len(o), np.int64)
        back[o] = np.arange(len(o))
        again, alt, nth = again[back], alt[back], nth[back]
        suffix = pc.binary_join_element_wise(pc.if_else(pa.array(alt[again]), ".alt", ".repeat"), pc.cast(pa.array(nth[again]), pa.string()), "")
        path = pc.replace_with_mask(base, pa.array(again), pc.binary_join_element_wise(base.filter(pa.array(again)), suffix, ""))
        self.slot[at], self.new[at] = len(self.values) + np.arange(len(at)), new[back]
        self.values = pa.concat_arrays([self.values, path])


def _units(t: pa.RecordBatch, profile: Profile) -> pa.RecordBatch:
    """The units of whole documents, whose lines are in order: columns of ``read`` below."""
    column = {f.name: t.column(i) for i, f in enumerate(t.schema)}
    flag = lambda x: x.to_numpy(zero_copy_only=False)
    n, state = t.num_rows, flag(column["state"])
    lines, paths, head = _Lines(state & FIRST > 0), _Paths(n), state & (HAS_SUBPART - 1)
    has_sub, has_mcq, has_option, has_minor = state & HAS_SUBPART > 0, *(flag(column[k].is_valid()) for k in ("mcq", "option", "minor"))

    # what each line is
    plain, is_answer, is_case = (head == 0) | (head >= IS_CASE), head == IS_ANSWER, head == IS_CASE
    answer_section = is_answer & profile.sectioned
    reset = (head == IS_PAPER) | (head == IS_SECTION) | answer_section
    answers = lines.open(answer_section, is_case) >= 0
    is_mcq = plain & ~is_case & (lines.open(is_case, reset) >= 0) & ~answers & has_mcq
    is_question = ~is_mcq & (head == IS_QUESTION)
    closes_mcq = is_question | is_case | reset
    mcq_open = lines.open(is_mcq, closes_mcq) >= 0
    other = plain & ~is_case & ~is_mcq & ~is_question
    is_option, other = other & mcq_open & has_option, other & ~mcq_open & has_minor
    is_sub, is_part = other & has_sub, other & ~has_sub
    begins = is_case | is_mcq | is_question | is_sub | is_part
    kind = np.select([is_case, is_question, is_part, is_sub, is_mcq], range(5), -1)

    # an OR is pending for the next unit if some unit was open before it
    is_or = (head == IS_SEPARATOR) & (lines.open(begins, reset, before=True) >= 0)
    pending = lines.open(is_or, begins, before=True) >= 0

    # the line that began the open unit of each level
    closes_part = reset | is_case | is_question
    case_at, question_at, mcq_at = lines.open(is_case, reset), lines.open(is_question, reset | is_case), lines.open(is_mcq, closes_mcq)
    part_at, sub_at = lines.open(is_part, closes_part), lines.open(is_sub, closes_part | is_part)
    paper_at, section_at = lines.last(head == IS_PAPER), lines.open(head == IS_SECTION, head == IS_PAPER)

    token = lambda at, name: _taken(column[name], at)
    lettered = lambda at, name, letter: pc.binary_join_element_wise(letter, token(at, name), "")
    scope = lambda at: _joined(lettered(paper_at[at], "major", "P"), lettered(section_at[at], "major", "S"))
    under_case = lambda at: pc.coalesce(paths.of(case_at[at]), scope(at))
    above_part = lambda at: pc.coalesce(paths.of(question_at[at]), under_case(at))
    cases, questions, parts, subs, mcqs = map(np.flatnonzero, (is_case, is_question, is_part, is_sub, is_mcq))
    labels = [lettered(cases, "major", "CS"), lettered(mcqs, "mcq", "M"), lettered(questions, "major", "Q"), token(parts, "minor"), token(subs, "minor")]
    paths.add(lines, cases, _joined(scope(cases), labels[0]), np.ones(len(cases), bool), pending)
    paths.add(lines, mcqs, _joined(paths.of(case_at[mcqs]), labels[1]), np.ones(len(mcqs), bool), pending)
    paths.add(lines, questions, _joined(under_case(questions), labels[2]), ~answers[questions], pending)

    # answers end where a question, or a part that wasn't there before, begins
    named_parts = _joined(above_part(parts), labels[3])
    slot = np.full(n, -1)
    slot[parts] = np.arange(len(parts))
    nominal = _taken(named_parts, np.where(part_at[subs] >= 0, slot[part_at[subs]], -1))
    both, fresh = np.concatenate((parts, subs)), np.zeros(n, bool)
    if len(both):
        key = lines.keys(both, pa.concat_arrays([named_parts, _joined(pc.coalesce(nominal, above_part(subs)), labels[4])]))
        o = np.lexsort((both, key))
        fresh[both[o[_starts(key[o])]]] = True
    asks = lines.open(is_answer, is_case | (begins & ~answers & (is_question | is_mcq | fresh))) < 0
    paths.add(lines, parts, named_parts, asks[parts], pending)
    paths.add(lines, subs, _joined(pc.coalesce(paths.of(part_at[subs]), above_part(subs)), labels[4]), asks[subs], pending)
    labels = pa.concat_arrays(labels)  # in the slots of their paths
    first_of = lambda *ats: np.select([a >= 0 for a in ats], ats, -1)
    own = first_of(mcq_at, sub_at, part_at, question_at, case_at)
    parent = np.select([is_mcq | is_question, is_part, is_sub], [case_at, first_of(question_at, case_at), first_of(part_at, question_at, case_at)], -1)

    # OR groups: a chain of ORs with one unit between is one group, named after the first
    unit_before, or_before = lines.last(begins, before=True), lines.last(is_or, before=True)
    started, ors = np.cumsum(begins), np.cumsum(is_or)
    heads = np.flatnonzero(is_or & ((or_before < 0) | (started - started[or_before] > 1)))
    numbers = (ors - (ors - is_or)[lines.start])[heads]
    names = pc.binary_join_element_wise(pc.fill_null(paths.of(parent[unit_before[heads]]), "root"), pc.cast(pa.array(numbers), pa.string()), ".or")
    different = pc.unique(names).sort() if len(heads) else names
    rank = np.full(n, n)
    rank[heads] = flag(pc.index_in(names, different))
    names_group = np.zeros(n, bool)
    names_group[heads] = True
    head_at = lines.last(names_group)
    or_group = np.where((is_or | (begins & pending & paths.new)) & (head_at >= 0), rank[head_at], n)

    # lines by unit: a path names one in its document
    began = np.flatnonzero(begins)
    if len(began) == 0:
        return None
    unit = np.full(n, -1)
    unit[began] = np.unique(lines.keys(began, paths.of(began)), return_inverse=True)[1]
    at = np.where(is_or, unit_before, np.where(plain, own, -1))
    rows = np.flatnonzero(at >= 0)
    rows = rows[np.argsort(unit[at[rows]], kind="stable")]
    starts = _starts(unit[at[rows]])
    line = ~is_or[rows]
    first, last = rows[starts], np.maximum.reduceat(np.where(line, rows, -1), starts)
    earliest = lambda where: np.minimum.reduceat(np.where(where, rows, n), starts)
    page = flag(pc.fill_null(pc.cast(column["page"], pa.int64()), NO_PAGE))
    page_start, page_end = page[first], np.maximum.reduceat(np.where(line & (page[rows] != NO_PAGE), page[rows], -NO_PAGE), starts)

    def texts(where: np.ndarray) -> pa.Array:
        ends = np.cumsum(np.add.reduceat(where.astype(np.int64), starts))
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), column["text"].take(pa.array(rows[where])))

    kinds, above, mcq = kind[first], parent[first], kind[first] == MCQ
    above = np.where(above >= 0, unit[above], -1)
    given = flag(column["marks"].is_valid())
    marks_at = earliest(line & given[rows])
    explicit = marks_at < n
    marks = np.where(explicit, flag(pc.fill_null(column["marks"], 0)).astype(np.int64)[np.minimum(marks_at, n - 1)], np.where(mcq, profile.mcq_marks, 0))
    marked, source = explicit | mcq, np.where(explicit, 0, np.where(mcq, 1, -1))
    attemptable, gradable = marks.copy(), kinds != CASE
    or_of = np.minimum.reduceat(or_group[rows], starts)

    # marks and pages from a unit's parts; these are of deeper kinds, so they are done
    choice = np.where(or_of < n, or_of, n + 1 + np.arange(len(first)))
    for level in (PART, QUESTION, CASE):
        of = np.flatnonzero((above >= 0) & (kinds[above] == level))
        if len(of) == 0:
            continue
        of = of[np.lexsort((choice[of], above[of]))]
        choices, whole = _starts(above[of], choice[of]), _starts(above[of])
        up = above[of][whole]
        total = np.add.reduceat(np.maximum.reduceat(attemptable[of], choices), np.searchsorted(choices, whole))
        summed = np.logical_and.reduceat(marked[of], whole)
        page_start[up] = np.minimum(page_start[up], page_start[unit[np.minimum.reduceat(first[of], whole)]])
        page_end[up] = np.maximum(page_end[up], page_end[unit[np.maximum.reduceat(first[of], whole)]])
        marks[up], source[up], marked[up] = np.where(summed, total, marks[up]), np.where(summed, 2, source[up]), summed | marked[up]
        attemptable[up], gradable[up] = total, False

    correct = earliest(is_option[rows] & ~asks[rows])
    pages = lambda x: pc.cast(pa.array(x, mask=np.abs(x) == NO_PAGE), column["page"].type)
    ints = lambda x, mask=None: pa.array(x.astype(np.int32), pa.int32(), mask=mask)
    named = lambda values, x: _taken(pa.array(values, pa.string()), x)
    out = {
        "doc": t.column(0).take(pa.array(first)), "label_path": paths.of(first), "kind": named(LEVELS, kinds), "display_label": _taken(labels, paths.slot[first]), "parent": paths.of(parent[first]),
        "page_start": pages(page_start), "page_end": pages(page_end), "first_line": column["n"].take(pa.array(first)), "last_line": column["n"].take(pa.array(last)),
        "marks": ints(marks, ~marked), "marks_source": named(("explicit", "mcq_default", "summed"), source), "attemptable": ints(attemptable), "or_group": _taken(different, np.where(or_of < n, or_of, -1)), "gradable": pa.array(gradable),
        "question_text": pc.binary_join(texts(line & asks[rows]), "\n"), "answer_text": pc.binary_join(texts(line & ~asks[rows]), "\n"), "options": texts(is_option[rows] & asks[rows]),
        "correct_option": token(np.where(correct < n, correct, -1), "option"),
    }
    return pa.RecordBatch.from_pydict(out)


def _whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that none ends within a document."""
    held: list[pa.RecordBatch] = []
    one = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for batch in batches:
        starts = np.flatnonzero(batch.column(batch.schema.get_field_index("state")).to_numpy(zero_copy_only=False) & FIRST)
        if len(starts):
            held.append(batch.slice(0, starts[-1]))
            if sum(b.num_rows for b in held):
                yield one()
            held, batch = [], batch.slice(starts[-1])
        held.append(batch)
    if sum(b.num_rows for b in held):
        yield one()


def units(lines: DataFrame, profile: Profile = Profile(), doc: str = "doc") -> DataFrame:
    """A row per unit: path, kind, parent, pages, lines, marks rolled up, OR group, texts, options and digest.

    ``lines``: ``doc``, n (their order, unique in a document), page, text; a null text is an empty line.  Lines before the first unit belong to none.
    A label that begins again is a unit of its own (.repeatN, or .altN after an OR) while questions are read; among
    answers it is the unit that it names.  Marks of a unit whose parts all have them are the sum over its OR groups of
    their greatest.  An empty table gives no units.  Option patterns are tried on lines that begin nothing.
    A task holds a batch of lines, or one document where that is longer.
    """
    c = F.col
    # a window shuffles only lines that aren't dealt by document yet, and leaves them in order
    first = F.row_number().over(Window.partitionBy(doc).orderBy("n")) == 1
    rows = lines.select(doc, "n", "page", F.coalesce("text", F.lit("")).alias("text")).withColumn("__first", first)
    names = (*HEADS, "part", "subpart", "mcq", "option", "marks")
    rows = rows.withColumns({f"t_{k}": F.nullif(F.regexp_extract("text", getattr(profile, k), 1), F.lit("")) for k in names})
    has = lambda k: c(f"t_{k}").isNotNull()
    head = reduce(lambda a, k: a.when(has(k), HEADS.index(k) + 1), HEADS[1:], F.when(has(HEADS[0]), 1)).otherwise(0)
    state = head + F.when(has("subpart"), HAS_SUBPART).otherwise(0) + F.when(c("__first"), FIRST).otherwise(0)
    # a line needs the token of its head only, and a part's only if it isn't a subpart
    major, minor = F.coalesce(*(c(f"t_{k}") for k in HEADS)), F.lower(F.coalesce("t_subpart", "t_part"))
    rows = rows.select(doc, "n", "page", "text", state.alias("state"), major.alias("major"), minor.alias("minor"), c("t_mcq").alias("mcq"), F.upper("t_option").alias("option"), c("t_marks").cast("int").alias("marks"))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole(batches):
            if (found := _units(batch, profile)) is not None:
                yield found

    kind = {f.name: f.dataType.simpleString() for f in lines.schema}
    found = rows.mapInArrow(read, f"doc {kind[doc]}, label_path string, kind string, display_label string, parent string, page_start {kind['page']}, page_end {kind['page']}, first_line {kind['n']}, last_line {kind['n']}, marks int, marks_source string, attemptable int, or_group string, gradable boolean, question_text string, answer_text string, options array<string>, correct_option string")
    return found.select(
        c("doc").alias(doc), "label_path", "kind", "display_label", "parent", "page_start", "page_end", "first_line", "last_line", "marks", "marks_source", "attemptable", "or_group", "gradable",
        F.col("label_path").rlike(r"\.repeat\d+$").alias("repeated"), "question_text", "answer_text", "options", "correct_option", F.sha2(F.concat("question_text", F.lit("\n"), "answer_text"), 256).alias("content_digest"),
    )
