"""Queries that find names: the table of given names is the words of ``benchmark``, the texts are the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.operators import names
from veilframe.plans.registry import query
from veilframe.plans.texts import _category_sql
from veilframe.tables import spread, table


def _given(spark, sf_dir) -> DataFrame:
    """A word table of benchmark words that begin with a to p, by their lower case."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"[^\p{L}]+")).alias("word"))
    return words.select(F.initcap("word").alias("name")).where(F.lower("word").between("a", "p")).distinct()


def _docs(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


_SPANS_SQL = r"""
given AS (SELECT DISTINCT lower(w) AS given FROM (SELECT unnest(string_split_regex(text, '[^\p{L}]+')) AS w FROM benchmark) WHERE w <> '' AND lower(w) BETWEEN 'a' AND 'p'),
tokens AS (
  SELECT doc_id, unnest(m) AS token, unnest(g[1:len(m)]) AS gap, generate_subscripts(m, 1) AS n
  FROM (SELECT doc_id, regexp_extract_all(text, '\p{Lu}\p{Ll}+') AS m, string_split_regex(text, '\p{Lu}\p{Ll}+') AS g FROM documents)),
placed AS (SELECT *, sum(length(gap) + length(token)) OVER (PARTITION BY doc_id ORDER BY n) AS upto, lead(token) OVER w AS surname, lead(gap) OVER w AS between_them FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
spans AS (
  SELECT doc_id, (upto - length(token))::INT AS start, (upto + length(between_them) + length(surname))::INT AS "end", lower(token) AS given, token || between_them || surname AS value
  FROM placed WHERE surname IS NOT NULL AND regexp_full_match(between_them, '[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+') AND lower(token) IN (SELECT given FROM given))"""


@query(f'WITH {_SPANS_SQL} SELECT doc_id, start, "end", given, value FROM spans')
def name_spans(spark, sf_dir):
    return names.name_spans(_docs(spark, sf_dir), _given(spark, sf_dir))


@query(f"""WITH {_SPANS_SQL}
SELECT doc_id, coalesce(category, CASE WHEN doc_id IN (SELECT doc_id FROM spans) THEN 'name' END) AS category
FROM (SELECT doc_id, {_category_sql('text')} AS category FROM documents) WHERE category IS NOT NULL OR doc_id IN (SELECT doc_id FROM spans)""")
def classify_with_names(spark, sf_dir):
    return names.categorised_with_names(_docs(spark, sf_dir), _given(spark, sf_dir)).select("doc_id", "category")


@query(f"""WITH RECURSIVE {_SPANS_SQL},
ranked AS (SELECT doc_id, value, row_number() OVER (PARTITION BY doc_id ORDER BY -length(value), value) AS n FROM (SELECT DISTINCT doc_id, value FROM spans)),
steps AS (SELECT doc_id, text, 0::BIGINT AS n FROM documents UNION ALL SELECT s.doc_id, replace(s.text, r.value, '[NAME]'), r.n FROM steps s JOIN ranked r ON r.doc_id = s.doc_id AND r.n = s.n + 1)
SELECT doc_id, sha256(text) AS scrubbed_sha256 FROM steps QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) = 1""")
def scrub_names(spark, sf_dir):
    done = names.scrubbed(_docs(spark, sf_dir), _given(spark, sf_dir))
    return done.select("doc_id", F.sha2("text", 256).alias("scrubbed_sha256"))
