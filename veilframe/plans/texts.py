"""Queries over documents and conversations: matches, classes, tallies, scrubbing, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.checks import digits, luhn_valid, verhoeff_valid
from veilframe.functions.patterns import CONTENT_PATTERNS, CUES, ID_PATTERNS, PLACEHOLDER, java, re2
from veilframe.functions.text import classify_text, found_ids, phone_credible, scrub_content, scrub_text, strongest_id
from veilframe.operators import redact, score
from veilframe.operators.detect import categorised, detect_texts
from veilframe.plans.registry import query
from veilframe.tables import spread, table


def _q(pattern: str) -> str:
    return "'" + re2(pattern).replace("'", "''") + "'"


_CREDIBLE = "(len(regexp_replace({m}, '[^0-9]', '', 'g')) >= CASE WHEN starts_with(trim({m}), '+') THEN 8 ELSE 10 END)"
# Aadhaar and UPI look ahead, which DuckDB's expressions can't. Texts with an Aadhaar's form alone, followed by more digits, have a card's or an account's form too.
_ANY_ID = " OR ".join(f"regexp_matches(t, {_q(p.split('(?!')[0])})" for k, p in ID_PATTERNS.items() if k != "upi")


def _category_sql(text: str) -> str:
    cases = ["WHEN " + _ANY_ID.replace("regexp_matches(t,", f"regexp_matches({text},") + " THEN 'id_number'"]
    for category, pattern in CONTENT_PATTERNS.items():
        fits = f"regexp_matches({text}, {_q(pattern)})"
        if category == "phone":
            fits += " AND " + _CREDIBLE.format(m=f"regexp_extract({text}, {_q(pattern)})")
        cases.append(f"WHEN {fits} THEN '{category}'")
    return "CASE " + " ".join(cases) + " END"


def _scrub_sql(text: str) -> str:
    for category, pattern in CONTENT_PATTERNS.items():
        if category == "phone":
            m = f"regexp_extract_all({text}, {_q(pattern)})"
            g = f"string_split_regex({text}, {_q(pattern)})"
            kept = f"list_transform({m}, lambda m: CASE WHEN {_CREDIBLE.format(m='m')} THEN '[PHONE]' ELSE m END)"
            text = f"array_to_string(list_transform(list_zip({g}, {kept}), lambda p: p[1] || coalesce(p[2], '')), '')"
        else:
            text = f"regexp_replace({text}, {_q(pattern)}, '{PLACEHOLDER[category]}', 'g')"
    return text


def _matches(category: str):
    return F.regexp_extract_all("text", F.lit(java(CONTENT_PATTERNS[category])), F.lit(0))


def _hits(spark: SparkSession, sf_dir: str, category: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike(java(CUES[category])))
    found = _matches(category)
    if category == "phone":
        found = F.filter(found, phone_credible)
    return docs.select("doc_id", F.size(found).cast("long").alias("hits")).where("hits > 0")


def _hits_sql(category: str) -> str:
    found = f"regexp_extract_all(text, {_q(CONTENT_PATTERNS[category])})"
    if category == "phone":
        found = f"list_filter({found}, lambda m: {_CREDIBLE.format(m='m')})"
    return f"SELECT doc_id, hits FROM (SELECT doc_id, len({found})::BIGINT AS hits FROM documents) WHERE hits > 0"


@query(_hits_sql("email"))
def email_hits(spark, sf_dir):
    return _hits(spark, sf_dir, "email")


@query(_hits_sql("phone"))
def phone_hits_credible(spark, sf_dir):
    return _hits(spark, sf_dir, "phone")


@query(_hits_sql("other"))
def money_hits(spark, sf_dir):
    return _hits(spark, sf_dir, "other")


@query(_hits_sql("password"))
def password_hits(spark, sf_dir):
    return _hits(spark, sf_dir, "password")


_LUHN = "list_sum(list_transform(range(1, len({d}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse({d}), i, 1)::INT ELSE (2 * substr(reverse({d}), i, 1)::INT) // 10 + (2 * substr(reverse({d}), i, 1)::INT) % 10 END)) % 10 = 0"


@query(f"""
SELECT doc_id, run, ({_LUHN.format(d="d")}) AS valid
FROM (SELECT doc_id, run, regexp_replace(run, '[^0-9]', '', 'g') AS d FROM (SELECT doc_id, unnest(regexp_extract_all(text, {_q(ID_PATTERNS["card"])})) AS run FROM documents))
""")
def card_runs_luhn(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"\d{4}"))
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(java(ID_PATTERNS["card"])), F.lit(0))).alias("run"))
    return runs.select("doc_id", "run", luhn_valid(digits(F.col("run"))).alias("valid"))


def _verhoeff_sql(number: str) -> str:
    """The check by its tables: the group of five's turns and mirrors, and the powers of one permutation of the digits."""
    turn = lambda a, b: (a + b) % 5 if a < 5 and b < 5 else 5 + (a + b) % 5 if a < 5 else 5 + (a - b) % 5 if b < 5 else (a - b) % 5
    group = [[turn(a, b) for b in range(10)] for a in range(10)]
    step, powers = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4], [list(range(10))]
    while len(powers) < 8:
        powers.append([step[x] for x in powers[-1]])
    digits = f"list_transform(range(12), lambda i: {powers}[i % 8 + 1][substr({number}, (12 - i)::INT, 1)::INT + 1])"
    return f"list_reduce(list_prepend(0, {digits}), lambda c, d: {group}[c + 1][d + 1]) = 0"


@query(f"""SELECT o_orderkey, {_verhoeff_sql("n")} AS valid FROM (SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 12, '2') AS n FROM orders)""")
def verhoeff_check(spark, sf_dir):
    number = F.lpad(F.col("o_orderkey").cast("string"), 12, "2")
    return table(spark, sf_dir, "orders").select("o_orderkey", verhoeff_valid(number).alias("valid"))


@query(None)
def id_spans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"\d{4}|@"))
    rows = docs.select("doc_id", F.explode(found_ids(F.col("text"))).alias("id"))
    return rows.select("doc_id", "id.kind", "id.start", "id.end", "id.verified", F.array_join("id.alternatives", ",").alias("alternatives"))


@query(None)
def strongest_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"\d{4}|@"))
    best = docs.select("doc_id", strongest_id(found_ids(F.col("text"))).alias("id")).where("id is not null")
    return best.select("doc_id", "id.kind", "id.value", "id.verified")


@query(f"SELECT doc_id, category FROM (SELECT doc_id, {_category_sql('text')} AS category FROM documents) WHERE category IS NOT NULL")
def classify_documents(spark, sf_dir):
    return categorised(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "category")


@query(f"SELECT conv_id, turn, category FROM (SELECT conv_id, turn, {_category_sql('text')} AS category FROM conversations) WHERE category IS NOT NULL")
def classify_turns(spark, sf_dir):
    return categorised(spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))).select("conv_id", "turn", "category")


def _tally_sql(key: str) -> str:
    return f"SELECT {key}, category, count(*) AS docs FROM (SELECT {key}, {_category_sql('text')} AS category FROM documents) WHERE category IS NOT NULL GROUP BY ALL"


def _tally(spark, sf_dir, key: str) -> DataFrame:
    found = categorised(spread(table(spark, sf_dir, "documents").select(key, "text")))
    return found.groupBy(key, "category").agg(F.count(F.lit(1)).alias("docs"))


@query(_tally_sql("lang"))
def category_by_lang(spark, sf_dir):
    return _tally(spark, sf_dir, "lang")


@query(_tally_sql("source"))
def category_by_source(spark, sf_dir):
    return _tally(spark, sf_dir, "source")


@query(f"SELECT doc_id, sha256({_scrub_sql('text')}) AS scrubbed_sha256 FROM documents")
def scrub_documents_content(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.sha2(scrub_content(F.col("text")), 256).alias("scrubbed_sha256"))


@query(f"SELECT conv_id, turn, sha256({_scrub_sql('text')}) AS scrubbed_sha256 FROM conversations")
def scrub_turns_content(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(scrub_content(F.col("text")), 256).alias("scrubbed_sha256"))


@query(None)
def scrub_documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.sha2(scrub_text(F.col("text")), 256).alias("scrubbed_sha256"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document as a text element of a page."""
    split = F.posexplode(F.split("text", "\n", -1)).alias("ord", "value")
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("page_id"), split)
    place = F.struct(F.lit(0.0).alias("x"), (F.col("ord") * 22.0).alias("y"), F.lit(520.0).alias("width"), F.lit(22.0).alias("height"))
    text = lambda name: F.lit(None).cast("string").alias(name)
    return rows.select("page_id", "ord", F.concat(F.lit("e"), F.col("ord").cast("string")).alias("element_id"), F.lit("text").alias("element_type"), text("label"), "value", *map(text, ("input_type", "autocomplete", "name", "placeholder", "column_header")), place.alias("position"))


def _regions(spark, sf_dir) -> DataFrame:
    found = detect_texts(_lines(spark, sf_dir), "value")
    return found.select("page_id", "ord", F.concat(F.lit("dom-"), "element_id").alias("region_id"), "category", F.lit("dom").alias("source"), "confidence", "element_id", "reason", "position")


@query(f"""
SELECT page_id, ord, 'dom-e' || ord AS region_id, category, 'dom' AS method FROM (
  SELECT page_id, ord, {_category_sql("value")} AS category FROM (
    SELECT doc_id AS page_id, unnest(string_split(text, chr(10))) AS value, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS ord FROM documents))
WHERE category IS NOT NULL
""")
def manifest(spark, sf_dir):
    found = categorised(_lines(spark, sf_dir), "value")
    return redact.manifest(found.withColumns({"region_id": F.concat(F.lit("dom-"), "element_id"), "source": F.lit("dom")}))


@query(None)
def redacted_rows(spark, sf_dir):
    out = redact.redact(_lines(spark, sf_dir), _regions(spark, sf_dir))
    return out.select("page_id", "ord", "element_id", "value", "filled")


@query(None)
def leak_check(spark, sf_dir):
    """Raw values that a page's own payload still holds: other lines of a page may repeat what one line's region hides."""
    elements, regions = _lines(spark, sf_dir), _regions(spark, sf_dir)
    sent = redact.payloads(redact.redact(elements, regions), regions)
    return redact.leaks(sent, redact.flagged_values(elements, regions)).select("page_id", F.size("leaked").alias("leaked"))


_PAIRS_SQL = f"""
SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'toxic' END AS expected, CASE WHEN {_category_sql("d.text")} IS NOT NULL THEN 'toxic' END AS claimed
FROM documents d JOIN labels l USING (doc_id)
"""


@query(f"""
SELECT tp AS true_positives, fn AS false_negatives, fp AS false_positives, tp AS right_category, recall, "precision",
  CASE WHEN "precision" + recall > 0 THEN 2 * "precision" * recall / ("precision" + recall) ELSE 0.0::DOUBLE END AS f1, 1.0::DOUBLE AS category_accuracy
FROM (SELECT *, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0::DOUBLE END AS recall, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0::DOUBLE END AS "precision"
  FROM (SELECT count_if(expected IS NOT NULL AND claimed IS NOT NULL) AS tp, count_if(expected IS NOT NULL AND claimed IS NULL) AS fn, count_if(expected IS NULL AND claimed IS NOT NULL) AS fp FROM ({_PAIRS_SQL})))
""")
def detector_score(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    truth = labels.where("toxic = 1").select(F.col("doc_id").alias("page_id"), F.lit("e0").alias("element_id"), F.lit(0).alias("ord"), F.lit("toxic").alias("category"))
    covered = docs.select("doc_id", "text").join(labels, "doc_id", "left_semi")
    found = categorised(spread(covered)).select(F.col("doc_id").alias("page_id"), F.lit("e0").alias("element_id"), F.lit(0).alias("ord"), F.lit("toxic").alias("category"))
    return score.scored(score.compared(truth, found))


def _statements(spark, sf_dir) -> DataFrame:
    """Lines of an account's statement, from ``customer``: what they hold follows from the key."""
    k, c = F.col("c_custkey"), F.col("c_custkey").cast("string")
    line = (
        F.when(k % 7 == 0, F.concat(F.lit("Balance: Rs. "), k * 13, F.lit(".50 due")))
        .when(k % 7 == 1, F.concat(F.lit("password: s3cret"), c))
        .when(k % 7 == 2, F.concat(F.lit("call +49 "), F.lpad((k * 7919) % 100000, 5, "1"), F.lit(" "), F.lpad((k * 31) % 10000, 4, "2")))
        .when(k % 7 == 3, F.concat(F.lit("mail to user"), c, F.lit("@bank.example")))
        .when(k % 7 == 4, F.concat(F.lit("account "), F.lpad(c, 11, "7")))
        .when(k % 7 == 5, F.concat(F.lit("lives at "), k % 300, F.lit(" Long Hill Road, flat")))
        .otherwise(F.concat(F.lit("nothing to see in "), k % 100))
    )
    return table(spark, sf_dir, "customer").select(k.alias("line_id"), line.alias("text"))


_STATEMENTS_SQL = """(SELECT k AS line_id, CASE k % 7 WHEN 0 THEN 'Balance: Rs. ' || k * 13 || '.50 due' WHEN 1 THEN 'password: s3cret' || k WHEN 2 THEN 'call +49 ' || lpad(((k * 7919) % 100000)::VARCHAR, 5, '1') || ' ' || lpad(((k * 31) % 10000)::VARCHAR, 4, '2')
  WHEN 3 THEN 'mail to user' || k || '@bank.example' WHEN 4 THEN 'account ' || lpad(k::VARCHAR, 11, '7') WHEN 5 THEN 'lives at ' || k % 300 || ' Long Hill Road, flat' ELSE 'nothing to see in ' || k % 100 END AS text FROM (SELECT c_custkey AS k FROM customer))"""


@query(f"SELECT line_id, category FROM (SELECT line_id, {_category_sql('text')} AS category FROM {_STATEMENTS_SQL}) WHERE category IS NOT NULL")
def classify_statements(spark, sf_dir):
    return detect_texts(_statements(spark, sf_dir)).select("line_id", "category")


@query(f"SELECT line_id, {_scrub_sql('text')} AS scrubbed FROM {_STATEMENTS_SQL}")
def scrub_statements(spark, sf_dir):
    return _statements(spark, sf_dir).select("line_id", scrub_content(F.col("text")).alias("scrubbed"))


def _statement_hits(category: str) -> str:
    return f"SELECT line_id, unnest(regexp_extract_all(text, {_q(CONTENT_PATTERNS[category])})) AS value FROM {_STATEMENTS_SQL}"


@query(_statement_hits("other"))
def money_values(spark, sf_dir):
    return _statements(spark, sf_dir).select("line_id", F.explode(_matches("other")).alias("value"))


@query(_statement_hits("password"))
def password_values(spark, sf_dir):
    return _statements(spark, sf_dir).select("line_id", F.explode(_matches("password")).alias("value"))
