"""Full-text queries over the stored index of documents, and over a user's own notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.stemming import STOP_WORDS
from tessera.operators import search as S
from tessera.plans.registry import query
from tessera.sources.stored import stored
from tessera.sources.tables import table

#: A search with words that are all needed, an exclusion, an alternative, and a phrase with a stop word in it.
QUERY = 'erly oned -ering or "thanedble the anea" or inghe thes'
NOTES_QUERY = 'oned -ering or "there are"'


def documents_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all documents' whole texts, built once for a state of the table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return stored(spark, "documents-index-2", [docs], lambda: S.index(docs, "doc_id", "text"), ["bucket"], **S.OPTIONS)


_V, _C, _DOUBLE = "[aeiouy]", "[^aeiouy]", "(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"
_SHORT = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"
#: The published stemmer once more, as SQL over a table ``vocab`` (word), to hold the index against: ``stems`` (word, stem).
STEMS = rf"""y AS (SELECT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\1Y', 'g') AS w FROM vocab),
one AS (SELECT *, CASE WHEN regexp_matches(w, '^(gener|arsen)') THEN 5 WHEN w LIKE 'commun%' THEN 6 WHEN regexp_matches(w, '{_V}{_C}') THEN length(regexp_extract(w, '^.*?{_V}{_C}')) ELSE length(w) END AS r1 FROM y),
two AS (SELECT *, CASE WHEN regexp_matches(w[r1 + 1:], '{_V}{_C}') THEN r1 + length(regexp_extract(w[r1 + 1:], '^.*?{_V}{_C}')) ELSE length(w) END AS r2 FROM one),
plural AS (SELECT word, r1, r2, CASE WHEN w LIKE '%sses' THEN w[:-3] WHEN regexp_matches(w, '.(ied|ies)$') AND length(w) > 4 THEN w[:-3] WHEN regexp_matches(w, '(ied|ies)$') AND length(w) = 4 THEN w[:-2]
  WHEN regexp_matches(w, '(ied|ies)$') THEN 'ie' WHEN regexp_matches(w, '(us|ss)$') THEN w WHEN regexp_matches(w, '{_V}.+s$') THEN w[:-2] ELSE w END AS w FROM two),
kept AS (SELECT word, w FROM plural WHERE w IN ('inning', 'outing', 'canning', 'herring', 'earring', 'proceed', 'exceed', 'succeed')),
past AS (SELECT *, CASE WHEN w LIKE '%eedly' OR w LIKE '%eed' THEN NULL WHEN w LIKE '%ingly' THEN w[:-6] WHEN w LIKE '%edly' THEN w[:-5] WHEN w LIKE '%ing' THEN w[:-4] WHEN w LIKE '%ed' THEN w[:-3] END AS base FROM plural),
mended AS (SELECT word, r1, r2, CASE WHEN w LIKE '%eedly' THEN CASE WHEN length(w) - 5 >= r1 THEN w[:-4] ELSE w END WHEN w LIKE '%eed' THEN CASE WHEN length(w) - 3 >= r1 THEN w[:-2] ELSE w END
  WHEN base IS NULL OR NOT regexp_matches(base, '{_V}') THEN w WHEN regexp_matches(base, '(at|bl|iz)$') THEN base || 'e' WHEN regexp_matches(base, '{_DOUBLE}') THEN base[:-2]
  WHEN regexp_matches(base, '{_SHORT}') AND length(base) <= r1 THEN base || 'e' ELSE base END AS w FROM past),
final_y AS (SELECT word, r1, r2, CASE WHEN regexp_matches(w, '.{_C}[yY]$') THEN w[:-2] || 'i' ELSE w END AS w FROM mended),
s2 AS (SELECT *, regexp_extract(w, '(tional|enci|anci|abli|entli|izer|ization|ational|ation|ator|alism|aliti|alli|fulness|ousli|ousness|iveness|iviti|biliti|bli|ogi|fulli|lessli|li)$', 1) AS s FROM final_y),
b2 AS (SELECT *, w[:length(w) - length(s)] AS b FROM s2),
t2 AS (SELECT word, r1, r2, CASE WHEN s = '' OR length(b) < r1 OR s = 'ogi' AND b NOT LIKE '%l' OR s = 'li' AND NOT regexp_matches(b, '[cdeghkmnrt]$') THEN w
  WHEN s IN ('enci', 'anci', 'abli') THEN w[:-2] || 'e' WHEN s IN ('tional', 'entli', 'alism', 'aliti', 'alli', 'fulness', 'ousli', 'ousness', 'iveness', 'iviti', 'ogi', 'fulli', 'lessli')
  THEN b || regexp_extract(s, '^(tion|ent|al|ful|ous|iv|og|less)') || CASE WHEN s IN ('iveness', 'iviti') THEN 'e' ELSE '' END
  WHEN s IN ('izer', 'ization') THEN b || 'ize' WHEN s IN ('ational', 'ation', 'ator') THEN b || 'ate' WHEN s IN ('biliti', 'bli') THEN b || 'ble' ELSE b END AS w FROM b2),
s3 AS (SELECT *, regexp_extract(w, '(tional|ational|alize|icate|iciti|ical|ful|ness|ative)$', 1) AS s FROM t2),
b3 AS (SELECT *, w[:length(w) - length(s)] AS b FROM s3),
t3 AS (SELECT word, r1, r2, CASE WHEN s = '' OR length(b) < r1 OR s = 'ative' AND length(b) < r2 THEN w WHEN s = 'tional' THEN b || 'tion' WHEN s = 'ational' THEN b || 'ate' WHEN s = 'alize' THEN b || 'al'
  WHEN s IN ('icate', 'iciti', 'ical') THEN b || 'ic' ELSE b END AS w FROM b3),
s4 AS (SELECT *, regexp_extract(w, '(al|ance|ence|er|ic|able|ible|ant|ement|ment|ent|ism|ate|iti|ous|ive|ize|ion)$', 1) AS s FROM t3),
b4 AS (SELECT *, w[:length(w) - length(s)] AS b FROM s4),
t4 AS (SELECT word, r1, r2, CASE WHEN s = '' OR length(b) < r2 OR s = 'ion' AND NOT regexp_matches(b, '[st]$') THEN w ELSE b END AS w FROM b4),
t5 AS (SELECT word, CASE WHEN w LIKE '%e' AND (length(w) - 1 >= r2 OR length(w) - 1 >= r1 AND NOT regexp_matches(w[:-2], '{_SHORT}')) THEN w[:-2] WHEN w LIKE '%ll' AND length(w) - 1 >= r2 THEN w[:-2] ELSE w END AS w FROM t4),
odd AS (SELECT * FROM (VALUES ('skis', 'ski'), ('skies', 'sky'), ('dying', 'die'), ('lying', 'lie'), ('tying', 'tie'), ('idly', 'idl'), ('gently', 'gentl'), ('ugly', 'ugli'), ('early', 'earli'), ('only', 'onli'), ('singly', 'singl'),
  ('sky', 'sky'), ('news', 'news'), ('howe', 'howe'), ('atlas', 'atlas'), ('cosmos', 'cosmos'), ('bias', 'bias'), ('andes', 'andes')) AS o (word, stem)),
stems AS (SELECT t5.word, coalesce(odd.stem, CASE WHEN length(t5.word) <= 2 THEN t5.word END, kept.w, lower(t5.w)) AS stem FROM t5 LEFT JOIN odd USING (word) LEFT JOIN kept USING (word))"""

_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _occurrences(rows: str) -> str:
    """Tables occ (doc, pos, word), vocab, stems and s (doc, pos, stem) of ``rows`` (doc, text)."""
    return rf"""w AS (SELECT doc, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS l FROM ({rows})),
occ AS (SELECT doc, unnest(l) AS word, generate_subscripts(l, 1) AS pos FROM w),
vocab AS (SELECT DISTINCT word FROM occ WHERE word NOT IN ({_STOPS})), {STEMS}, s AS (SELECT doc, pos, stem FROM occ JOIN stems USING (word))"""


@query(rf"""WITH {_occurrences('SELECT doc_id AS doc, text FROM documents')}
SELECT stem, count(DISTINCT doc) AS documents, count(*) AS occurrences, CAST(sum(pos - 1) AS BIGINT) AS places FROM s GROUP BY 1""")
def t12_index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stem of the stored index with its documents, its occurrences and the sum of their positions."""
    rows = documents_index(spark, sf_dir).where("stem <> ''")
    ats = F.aggregate("places", F.lit(0).cast("long"), lambda a, p: a + S.position_of(p))
    docs = F.array_distinct(F.transform("places", S.offset_of))
    # a document's words of one stem lie in one block, so its lists tell the documents apart and no row per document is made
    of_blocks = rows.groupBy("stem", "block").agg(F.flatten(F.collect_list(docs)).alias("docs"), F.sum(F.size("places")).alias("n"), F.sum(ats).alias("places"))
    return of_blocks.groupBy("stem").agg(F.sum(F.size(F.array_distinct("docs"))).alias("documents"), F.sum("n").alias("occurrences"), F.sum("places").alias("places"))


@query(rf"""WITH {_occurrences('SELECT doc_id AS doc, text FROM documents')}, has AS (SELECT doc, list(DISTINCT stem) AS l FROM s GROUP BY 1),
phrase AS (SELECT DISTINCT a.doc FROM s a JOIN s b ON a.doc = b.doc AND b.pos = a.pos + 2 WHERE a.stem = 'thanedbl' AND b.stem = 'anea'),
found AS (SELECT doc FROM has WHERE list_contains(l, 'er') AND list_contains(l, 'one') AND NOT list_contains(l, 'ere') OR list_contains(l, 'ingh') AND list_contains(l, 'thes') OR doc IN (SELECT doc FROM phrase))
SELECT doc AS doc_id, (SELECT count(*) FROM found) AS total FROM found ORDER BY 1 LIMIT 25""")
def q11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page one of a search of all documents with all-of, exclusion, alternatives and a phrase, and the total."""
    return S.page(S.search(documents_index(spark, sf_dir), QUERY)).select(F.col("doc").alias("doc_id"), "total")


_NOTES = "SELECT conv_id * 1000 + turn AS doc, text FROM conversations WHERE role = 'user'"


@query(rf"""WITH {_occurrences(_NOTES)}, has AS (SELECT doc, list(DISTINCT stem) AS l FROM s GROUP BY 1)
SELECT doc // 1000 AS conv_id, doc % 1000 AS turn FROM has WHERE list_contains(l, 'one') AND NOT list_contains(l, 'ere')""")
def q11_notes_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search of the users' own turns, indexed as they are read; a phrase of stop words alone asks for nothing."""
    notes = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    found = S.search(S.index(notes, "id", "text"), NOTES_QUERY)
    return found.select(F.floor(F.col("doc") / 1000).alias("conv_id"), (F.col("doc") % 1000).alias("turn"))
