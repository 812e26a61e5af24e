"""Registered query of the license scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardmill.llm.common import table
from rewardmill.llm.licenses import _TERM, LINE_END, PARAGRAPH_END, SENTENCE_END, STOP_WORDS, TEMPLATES, THRESHOLD, Vectors, scan_licenses

# The documents get paths: source / thousand / fifty, and the first of every fifty is its directory's licence file.
PATH = "concat(coalesce({source}, ''), '/', {id} {div} 1000, '/', {id} {div} 50, '/', CASE WHEN {id} % 50 = 0 THEN 'LICENSE' ELSE concat({id}, '.txt') END)"


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License of every document, its own or inherited."""
    docs = table(spark, sf_dir, "documents")
    path = F.expr(PATH.format(source="source", id="doc_id", div="div"))
    found = scan_licenses(docs.select("doc_id", path.alias("path"), "text"))
    return found.drop("text")


def _oracle() -> str:
    v = Vectors(TEMPLATES, THRESHOLD)
    idf = ", ".join(f"('{t}', CAST({w!r} AS DOUBLE))" for t, w in v.idf.items())
    units = ", ".join(f"({number}, '{name}', '{t}', CAST({w!r} AS DOUBLE))" for number, name, t, w in v.rows)
    sentences = f"string_split(regexp_replace({{}}, '{SENTENCE_END}', '\\1' || chr(10), 'g'), chr(10))"
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    path = PATH.format(source="source", id="doc_id", div="//")
    return rf"""
WITH idf(term, idf) AS (VALUES {idf}),
units(template, license, term, unit) AS (VALUES {units}),
files AS (
  SELECT doc_id, text, path, regexp_replace(path, '/?[^/]*$', '') AS dir, regexp_extract(path, '[^/]*$') = 'LICENSE' AS is_file
  FROM (SELECT doc_id, text, {path} AS path FROM documents)
),
said AS (
  SELECT path, unnest(list_concat({sentences.format("text")}, flatten(list_transform(unwrapped, lambda p: {sentences.format("p")})),
    CASE WHEN is_file THEN [text] ELSE [] END)) AS said
  FROM (SELECT *, list_transform(list_filter(string_split_regex(text, '{PARAGRAPH_END}'), lambda p: contains(p, chr(10))),
                                 lambda p: regexp_replace(p, '{LINE_END}', ' ', 'g')) AS unwrapped FROM files)
  WHERE text IS NOT NULL
),
numbered AS (SELECT path, row_number() OVER () AS segment, said FROM said WHERE said <> ''),
found AS (
  SELECT path, segment, unnest(regexp_extract_all(regexp_replace(lower(said), 'licen[cs]ed?', 'license', 'g'), '{_TERM}')) AS term
  FROM numbered
),
weighed AS (
  SELECT path, segment, f.term, count(*) * coalesce(any_value(idf), CAST({v.unknown!r} AS DOUBLE)) AS weight
  FROM found f LEFT JOIN idf ON idf.term = f.term WHERE f.term NOT IN ({stop}) GROUP BY path, segment, f.term
),
norms AS (
  SELECT segment, sqrt(sum(weight * weight)) AS norm FROM weighed w LEFT JOIN idf ON idf.term = w.term
  GROUP BY segment HAVING count(idf) > 1
),
scored AS (
  SELECT path, w.segment, license, round(sum(weight * unit) / any_value(norm), 6) AS score
  FROM weighed w JOIN units u ON u.term = w.term JOIN norms n ON n.segment = w.segment GROUP BY path, w.segment, template, license
),
own AS (
  SELECT path, license, score FROM scored WHERE score >= {THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, license) = 1
),
by_dir AS (
  SELECT f.dir, o.license, o.score FROM files f JOIN own o ON o.path = f.path WHERE f.is_file
  QUALIFY row_number() OVER (PARTITION BY f.dir ORDER BY o.score DESC, o.license) = 1
),
nearest AS (
  SELECT d.dir, b.dir AS above, b.license, b.score FROM (SELECT DISTINCT dir FROM files) d
  JOIN by_dir b ON d.dir = b.dir OR starts_with(d.dir, b.dir || '/')
  QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(b.dir) DESC) = 1
)
SELECT f.doc_id, f.path, coalesce(o.license, n.license) AS license, coalesce(o.score, n.score) AS score,
  CASE WHEN o.license IS NOT NULL THEN 'own' WHEN n.dir IS NOT NULL THEN 'inherited' END AS origin,
  CASE WHEN o.license IS NULL THEN n.above END AS license_dir
FROM files f LEFT JOIN own o ON o.path = f.path LEFT JOIN nearest n ON n.dir = f.dir
"""


QUERIES = {"op3_license_scan": op3_license_scan}
ORACLES = {"op3_license_scan": _oracle()}
