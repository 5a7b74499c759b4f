"""Byte-level BPE encoding and decoding by DuckDB recursive queries, one engine per Python worker.

A text is cut into runs of white space and runs of other characters with one leading blank at most; the
split pattern's matches never cross such a cut.  Distinct matches of a batch, as token-position rows, join
the merge table again and again: each round contracts every word's leftmost pair of least rank, until no
word has a pair left.  Results are kept per worker in a bounded cache, so frequent words are encoded once.
Every text's ids are then decoded by an ordered aggregation of their bytes, and the digest of the decoded
text comes from that.

In long words a round contracts, besides the leftmost pair of least rank, every pair that this order must
reach unchanged: one that ranks before all merges which its text allows and which would take either half
away.  So rounds follow the depth of the merges, not their number.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices, takes_worker, text_column

#: Unicode's White_Space, which is what \s means to the split pattern.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Words in a generation of a worker's cache (two are kept), words a query encodes at once, bytes above which a word counts as long,
#: bytes of long words encoded at once (one word at least), and bytes of text that are encoded together.
CACHE_WORDS, BATCH_WORDS, LONG, LONG_BYTES, SLICE_BYTES = 200_000, 10_000, 96, 60_000, 3 << 20
MEMORY = "160MB"

#: Words as lists of ids; each round replaces one pair a word. Lists only get shorter, so the shortest is final.
_ENCODE = """
WITH RECURSIVE state AS (
  SELECT w, list(id ORDER BY p) AS ids FROM start_rows GROUP BY w
  UNION ALL
  SELECT state.w, list_concat(ids[1:place - 1], [merged], ids[place + 2:len(ids)])
  FROM state JOIN (
    SELECT w, min(best) >> 24 AS merged, min(best) & 16777215 AS place
    FROM (
      SELECT w, (merged::BIGINT << 24) | place AS best
      FROM (SELECT w, unnest(ids[1:len(ids) - 1])::BIGINT * 4294967296 + unnest(ids[2:len(ids)]) AS pair, unnest(range(1, len(ids))) AS place FROM state)
      JOIN merges USING (pair))
    GROUP BY w) AS chosen ON state.w = chosen.w
),
final AS (SELECT w, arg_min(ids, len(ids)) AS ids FROM state GROUP BY w)
"""

#: All places of tokens in long words, by walking the tokens' prefixes; positions count over all words, with a gap between two.
_SPANS = """
CREATE OR REPLACE TEMP TABLE spans AS
WITH RECURSIVE walk AS (
  SELECT p, p + 1 AS e, prefix, token FROM start_rows JOIN prefixes ON edge = id
  UNION ALL
  SELECT walk.p, walk.e + 1, prefixes.prefix, prefixes.token
  FROM walk JOIN start_rows ON start_rows.p = walk.e JOIN prefixes ON edge = walk.prefix * 256 + start_rows.id
)
SELECT p, e, token FROM walk WHERE token >= 0
"""

#: All merges that the text allows: tokens whose two parts are tokens.
_ALLOWED = """
CREATE OR REPLACE TEMP TABLE allowed AS
SELECT a.p, b.p AS middle, b.e, c.token FROM spans AS a JOIN spans AS b ON a.e = b.p JOIN spans AS c ON c.p = a.p AND c.e = b.e
"""

#: Long words as rows, keyed so that only a row's latest state is held; an eaten row ends at -1.  ``before`` and ``behind`` are
#: the least ranks of allowed merges between present boundaries that would take a token away leftwards or rightwards.  Of equal
#: pairs that overlap in a chain every other one is contracted.
_ENCODE_LONG = """
WITH RECURSIVE state(p, w, e) USING KEY (p) AS (
  SELECT p, w, p + 1 FROM start_rows
  UNION ALL
  SELECT p, w, CASE WHEN lag(taken, 1, false) OVER (ORDER BY p) THEN -1 WHEN taken THEN far ELSE e END
  FROM (
    SELECT *, fits AND head % 2 = 1 AND (n - head // 2) % 2 = 0 AS taken
    FROM (
      SELECT *, max(CASE WHEN fits AND NOT coalesce(lag_fits AND lag_token = token, false) THEN 2 * n + sure::INT END) OVER (ORDER BY p) AS head
      FROM (
        SELECT *, lag(fits) OVER (ORDER BY p) AS lag_fits, lag(token) OVER (ORDER BY p) AS lag_token, row_number() OVER (ORDER BY p) AS n
        FROM (
          SELECT *, coalesce(token <= before AND token <= behind OR place = first, false) AS fits, coalesce(token < before OR place = first, false) AS sure
          FROM (
            SELECT *, token::BIGINT * 4294967296 + p AS place, min(token::BIGINT * 4294967296 + p) OVER (PARTITION BY w) AS first
            FROM (
              SELECT own.p, own.w, own.e, far, spans.token, coalesce(l.least, 2147483647) AS before, coalesce(r.least, 2147483647) AS behind
              FROM (SELECT p, w, e, CASE WHEN lead(p) OVER (ORDER BY p) = e THEN lead(e) OVER (ORDER BY p) END AS far FROM state WHERE e >= 0) AS own
              LEFT JOIN spans ON spans.p = own.p AND spans.e = far
              LEFT JOIN (
                SELECT middle AS p, min(token) AS least FROM allowed JOIN state AS a ON a.p = allowed.p AND a.e >= 0 JOIN state AS b ON b.p = middle AND b.e = allowed.e GROUP BY middle
              ) AS l ON l.p = own.p
              LEFT JOIN (
                SELECT allowed.p, min(token) AS least FROM allowed JOIN state AS b ON b.p = allowed.p AND b.e = middle JOIN state AS c ON c.e = allowed.e GROUP BY allowed.p
              ) AS r ON r.p = own.e))
          WHERE first IS NOT NULL))))
),
final AS (SELECT w, list(token ORDER BY p) AS ids FROM state JOIN spans USING (p, e) GROUP BY w)
"""

_IDS = "SELECT w, ids FROM final"
_DECODE = "SELECT w, string_agg(bytes, '' ORDER BY p) AS bytes FROM given JOIN vocabulary USING (id) GROUP BY w"


class Tokenizer:
    """Ranks, merge table and cache over one in-memory DuckDB."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))
        self.bytes_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.names = pa.array([f"{i}," for i in range(max(self.ranks.values()) + 1)], pa.large_string())
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        left, right, merged = [], [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self._table("merges", pair=np.array(left, np.int64) * 4294967296 + np.array(right, np.int64), merged=np.array(merged, np.int32))
        self._table("vocabulary", id=np.array(list(self.ranks.values()), np.int32), bytes=pa.array([t.hex() for t in self.ranks]))
        self.long_ready = False

    def _table(self, name: str, **columns) -> None:
        self.con.register("given", pa.table(columns))
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def _prepare_long(self) -> None:
        """The table of prefixes: edge (prefix before * 256 + byte), prefix, token or -1.

        Contracting ahead of the order is right if every token's own bytes give that token alone, which is tried here.
        """
        number: dict[bytes, int] = {b"": 0}
        edges, tokens = [], []
        for token in sorted(self.ranks):
            for i in range(1, len(token) + 1):
                if token[:i] not in number:
                    number[token[:i]] = len(number)
                    edges.append(number[token[: i - 1]] * 256 + token[i - 1])
                    tokens.append(self.ranks.get(token[:i], -1))
        self._table("prefixes", edge=np.array(edges, np.int64), prefix=np.arange(1, len(edges) + 1), token=np.array(tokens, np.int32))
        tokens = list(self.ranks)
        for at in range(0, len(tokens), BATCH_WORDS):
            part = tokens[at : at + BATCH_WORDS]
            if any(np.frombuffer(ids, np.int32).tolist() != [self.ranks[t]] for t, ids in zip(part, self._query(part, _ENCODE, whole=False))):
                raise ValueError("a token isn't what its own bytes merge to")
        self.long_ready = True

    def _query(self, part: list[bytes], query: str, whole: bool = True) -> list[bytes]:
        """Ids of each word as 32-bit integers; a word that is a token stays ``whole``."""
        ready = np.array([self.ranks.get(b, -1) if whole else -1 for b in part], np.int32)
        rest = np.flatnonzero(ready < 0)
        w = np.concatenate([np.flatnonzero(ready >= 0), np.repeat(rest, [len(part[i]) for i in rest])]).astype(np.int32)
        ids = np.concatenate([ready[ready >= 0], self.bytes_id[np.frombuffer(b"".join([part[i] for i in rest]), np.uint8)]]).astype(np.int32)
        return self._fetched(query, len(part), pa.table({"w": w, "p": np.arange(len(w), dtype=np.int32), "id": ids}))

    def _long(self, part: list[bytes]) -> list[bytes]:
        if not self.long_ready:
            self._prepare_long()
        sizes = np.array([len(b) for b in part])
        w = np.repeat(np.arange(len(part)), sizes)
        raw = np.frombuffer(b"".join(part), np.uint8)
        # memory for the rows of words of any length
        self.con.execute(f"SET memory_limit = '{max(int(MEMORY[:-2]), len(raw) // 600)}MB'")
        self.con.register("start_rows", pa.table({"w": w.astype(np.int32), "p": (np.arange(len(raw)) + w).astype(np.int32), "id": raw.astype(np.int32)}))
        self.con.execute(_SPANS)
        self.con.execute(_ALLOWED)
        out = self._fetched(_ENCODE_LONG, len(part))
        self.con.execute(f"DROP TABLE spans; DROP TABLE allowed; SET memory_limit = '{MEMORY}'")
        return out

    def _fetched(self, query: str, n: int, start: pa.Table | None = None) -> list[bytes]:
        if start is not None:
            self.con.register("start_rows", start)
        got = self.con.sql(query + _IDS).to_arrow_table().combine_chunks()
        out = [b""] * n
        ids = got.column("ids").combine_chunks()
        raw, cuts = ids.flatten().to_numpy().astype(np.int32).tobytes(), (4 * (ids.offsets.to_numpy().astype(np.int64) - ids.offsets[0].as_py())).tolist()
        for w, a, b in zip(got.column("w").to_numpy().tolist(), cuts, cuts[1:]):
            out[w] = raw[a:b]
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each match (see ``_query``)."""
        raw = [w.encode() for w in words]
        out = [b""] * len(words)
        short = [i for i, b in enumerate(raw) if len(b) <= LONG]
        for at in range(0, len(short), BATCH_WORDS):
            which = short[at : at + BATCH_WORDS]
            for i, own in zip(which, self._query([raw[i] for i in which], _ENCODE)):
                out[i] = own
        which, held = [], 0
        for i in [*(i for i, b in enumerate(raw) if len(b) > LONG), -1]:
            if which and (i < 0 or held + len(raw[i]) > LONG_BYTES):
                for k, own in zip(which, self._long([raw[k] for k in which])):
                    out[k] = own
                which, held = [], 0
            which.append(i)
            held += len(raw[i]) if i >= 0 else 0
        return out

    def known(self, words: set[str]) -> dict[str, bytes]:
        """Ids of the words, from two generations of cache."""
        fresh = words - self.young.keys()
        older = fresh & self.old.keys()
        if len(self.young) + len(fresh) > CACHE_WORDS:
            found = {w: self.young[w] for w in words - fresh}
            self.old, self.young = self.young | {w: self.old[w] for w in older}, found
        self.young.update((w, self.old[w]) for w in older)
        fresh = list(fresh - older)
        self.young.update(zip(fresh, self.encode_words(fresh)))
        return self.young

    def encode(self, texts: list[str]) -> list[tuple[bytes, np.ndarray]]:
        """(decimal ids joined by commas, the ids) of whole texts; an empty text has none."""
        pieces = [_CHUNK.findall(t) for t in texts]
        cuts = np.cumsum([0, *map(len, pieces)])
        runs = pa.array(chain.from_iterable(pieces), pa.string(), size=int(cuts[-1])).dictionary_encode()
        chunks = runs.dictionary.to_numpy(zero_copy_only=False).tolist()
        words, split = set(), {}
        for c in chunks:
            # letters after one blank at most are one match whole
            if (c[1:] if c[0] == " " else c).isalpha():
                words.add(c)
            else:
                parts = split[c] = self.split.findall(c)
                if sum(map(len, parts)) != len(c):
                    raise ValueError("the split pattern leaves characters out")
        known = self.known(words.union(*split.values()))
        packed = pa.array([b"".join([known[w] for w in split[c]]) if c in split else known[c] for c in chunks], pa.large_binary()).take(runs.indices)
        ids = np.frombuffer(packed.buffers()[2] or b"", np.int32)
        places = (np.frombuffer(packed.buffers()[1], np.int64)[cuts] // 4).tolist()
        written = self.names.take(pa.array(ids))
        text, stops = memoryview(written.buffers()[2] or b""), np.frombuffer(written.buffers()[1], np.int64)[places].tolist()
        # every id is written with a comma behind it, of which a text's last one goes
        return [(bytes(text[a : max(a, b - 1)]), ids[c:d]) for a, b, c, d in zip(stops, stops[1:], places, places[1:])]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of id sequences, by one ordered aggregation."""
        sizes = [len(own) for own in ids]
        if not sum(sizes):
            return [b""] * len(ids)
        flat = np.concatenate(ids).astype(np.int32)
        self.con.register("given", pa.table({"w": np.repeat(np.arange(len(ids), dtype=np.int32), sizes), "p": np.arange(len(flat), dtype=np.int32), "id": flat}))
        got = self.con.sql(_DECODE).to_arrow_table()
        found = dict(zip(got.column("w").to_pylist(), got.column("bytes").to_pylist()))
        return [bytes.fromhex(found.get(i, "")) for i in range(len(ids))]


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    return Tokenizer(path, pattern)


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 and, with ``keep``, ids and decoded of every row's whole text.

    ``path`` is a rank file that every executor has, ``pattern`` the split pattern.  Digests are of the
    decimal ids joined by commas and of the bytes decoded from the ids.  A null text counts as empty: no ids,
    and both digests are the empty string's.  Ids of rows may be null or repeat; an empty table gives an empty
    result; further columns are left out, whatever their names.  A word without blanks of n bytes takes some
    600 bytes of memory for each of them beyond 100 KB.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        takes_worker("byte_bpe", tokenizer.cache_clear)
        own = tokenizer(path, pattern)
        for batch in slices(batches, text_col, SLICE_BYTES):
            found = own.encode(text_column(batch.column(text_col)))
            decoded = own.decode([ids for _, ids in found])
            columns = [batch.column(id_col), pa.array([len(ids) for _, ids in found], pa.int64())]
            columns += [pa.array([hashlib.sha256(x).hexdigest() for x in own], pa.string()) for own in ([text for text, _ in found], decoded)]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                columns += [pa.array([ids for _, ids in found], pa.list_(pa.int32())), pa.array(decoded, pa.binary())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    more = ", ids array<int>, decoded binary" if keep else ""
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
