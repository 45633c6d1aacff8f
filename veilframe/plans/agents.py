"""Queries over form pages that follow from the keys of ``customer``, and over replies and runs from ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions import geom
from veilframe.operators import decide, guards, replies
from veilframe.plans.registry import query
from veilframe.tables import table

#: What stands on a form page, by (key * 7) mod 11: element type, value, label.
ENTRIES = (
    ("input", "[PASSWORD]", "Password"),
    ("input", "[PASSWORD]", "Repeat"),
    ("input", "[EMAIL]", "Mail"),
    ("input", "[NAME]", "Name"),
    ("input", "[PHONE]", "Phone"),
    ("button", None, "Sign in"),
    ("button", None, " Create account"),
    ("button", None, "Continue"),
    ("input", "unchecked", "I agree to the terms"),
    ("input", "unchecked", "I agree to receive offers"),
    ("text", "Fee pending", None),
)


def _pick(n, which: int):
    out = F.when(n == 0, F.lit(ENTRIES[0][which]))
    for k, e in enumerate(ENTRIES[1:], 1):
        out = out.when(n == k, F.lit(e[which]))
    return out


def _elements(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    n = (k * 7) % 11
    return table(spark, sf_dir, "customer").select(
        F.floor(k / 8).alias("page_id"),
        k.alias("ord"),
        F.concat(F.lit("e"), k.cast("string")).alias("element_id"),
        _pick(n, 0).alias("element_type"),
        _pick(n, 1).alias("value"),
        _pick(n, 2).alias("label"),
        (k % 3 != 0).alias("filled"),
        F.when(k % 2 == 0, F.floor(k / 4)).alias("row"),
        geom.rect(F.lit(0), (k * 53) % 600, F.lit(80), F.lit(20) + (k * 13) % 30).alias("position"),
    )


def _case(which: int) -> str:
    text = lambda v: "NULL" if v is None else f"'{v}'"
    return "CASE n " + " ".join(f"WHEN {k} THEN {text(e[which])}" for k, e in enumerate(ENTRIES)) + " END"


_E = f"""(SELECT page_id, k, id, t, v, l, filled, "row", y, y + h AS bottom, t = 'input' AND v = '[PASSWORD]' AS pw, t = 'input' AND v IN ('[EMAIL]', '[NAME]', '[PHONE]') AS who FROM (
  SELECT c_custkey // 8 AS page_id, c_custkey AS k, 'e' || c_custkey AS id, {_case(0)} AS t, {_case(1)} AS v, {_case(2)} AS l, c_custkey % 3 <> 0 AS filled,
    CASE WHEN c_custkey % 2 = 0 THEN c_custkey // 4 END AS "row", ((c_custkey * 53) % 600)::DOUBLE AS y, (20 + (c_custkey * 13) % 30)::DOUBLE AS h
  FROM (SELECT c_custkey, (c_custkey * 7) % 11 AS n FROM customer)))"""


@query(f"""
WITH facts AS (
  SELECT page_id, count(*) FILTER (pw) AS pws, count(*) FILTER (pw AND filled) AS set_pws, arg_min(id, k) FILTER (pw AND NOT filled) AS empty_pw, count(*) FILTER (who) AS whos,
    count(DISTINCT v) FILTER (who) AS kinds, count(*) FILTER (who AND NOT filled) AS blank, max(bottom) FILTER (pw) AS pw_bottom, max(bottom) FILTER (pw OR who) AS all_bottom,
    arg_min(id, k) FILTER (l = 'I agree to the terms') AS consent, arg_max(id, struct_pack(b := bottom, o := -k)) AS lowest FROM {_E} GROUP BY page_id),
kinds AS (SELECT *, CASE WHEN pws > 0 AND whos > 0 THEN CASE WHEN pws >= 2 OR kinds >= 3 THEN 'signup' ELSE 'login' END END AS form FROM facts),
under AS (SELECT f.page_id, f.form, e.id, e.l, e.y, e.k FROM kinds f JOIN {_E} e ON f.page_id = e.page_id WHERE e.t = 'button' AND e.bottom >= CASE f.form WHEN 'login' THEN pw_bottom WHEN 'signup' THEN all_bottom END - 8),
submit AS (SELECT page_id, coalesce(arg_min(id, struct_pack(y := y, k := k)) FILTER (l = CASE form WHEN 'login' THEN 'Sign in' ELSE ' Create account' END), arg_min(id, struct_pack(y := y, k := k)) FILTER (l = 'Continue')) AS submit FROM under GROUP BY page_id),
steps AS (SELECT k.*, submit, CASE WHEN form = 'login' THEN CASE WHEN empty_pw IS NOT NULL THEN 'type' WHEN submit IS NOT NULL THEN 'click' END
  WHEN form = 'signup' AND (empty_pw IS NULL OR set_pws >= 2) THEN CASE WHEN consent IS NOT NULL THEN 'tick' WHEN submit IS NOT NULL THEN 'click' ELSE 'scroll' END END AS step FROM kinds k LEFT JOIN submit USING (page_id))
SELECT page_id, form, CASE step WHEN 'tick' THEN 'click' ELSE step END AS action, CASE step WHEN 'type' THEN empty_pw WHEN 'tick' THEN consent WHEN 'click' THEN submit WHEN 'scroll' THEN lowest END AS element_id,
  CASE step WHEN 'type' THEN '[USE_SAVED_CREDENTIAL]' END AS value, (CASE WHEN step IS NULL THEN 0 WHEN step = 'scroll' THEN 0.6 WHEN form = 'login' THEN 0.9 ELSE 0.85 END)::DOUBLE AS confidence,
  CASE WHEN form = 'signup' AND step = 'click' THEN CASE blank WHEN 0 THEN '' WHEN 1 THEN ' One personal field is still empty; no value will be invented for it.' ELSE ' ' || blank || ' personal fields are still empty; no values will be invented for them.' END ELSE '' END AS note
FROM steps
""")
def login_signup_decision(spark, sf_dir):
    return decide.decisions(_elements(spark, sf_dir))


@query(f"SELECT page_id, id AS element_id, coalesce(l = 'I agree to receive offers', false) AS optional, coalesce(l = 'I agree to the terms', false) AS required, coalesce(l IN ('Sign in', ' Create account'), false) AS final FROM {_E}")
def consent_boxes(spark, sf_dir):
    final = (F.col("element_type") == "button") & decide.final_click(F.col("label"), F.col("value"))
    return _elements(spark, sf_dir).select("page_id", "element_id", decide.optional_opt_in().alias("optional"), decide.required_consent().alias("required"), final.alias("final"))


def _replies(spark, sf_dir) -> DataFrame:
    """A reply for each order: what is wrong with it follows from its key."""
    o, pages = F.col("o_orderkey"), 64
    m = o % 16
    target = (o % pages) * 8 + (F.floor(o / 64) % 8)
    selector = F.concat(F.lit("e"), target.cast("string"))
    act = F.when(m.isin(7, 8, 9, 10), "type").when(m == 4, "upload").when(m == 12, "scroll").otherwise("click")
    typed = F.when(m == 5, "text").when(m == 7, "").when(m == 8, "[USE_SAVED_CREDENTIAL]").when(m == 9, "someone").when(m == 10, "[NAME]")
    cited = F.when(m == 13, F.concat(F.lit("e"), (target + 1).cast("string"))).otherwise(selector)
    said = F.when(m == 14, "no such words").otherwise("fee   Pending")
    evidence = F.when(m >= 13, F.array(F.struct(cited.alias("elementId"), said.alias("text"))))
    body = F.to_json(F.struct(
        F.when(m == 2, "needs_more_context").when(m == 3, "ready").otherwise("action_ready").alias("status"),
        F.struct(act.alias("type"), F.when(m == 6, "nowhere").otherwise(selector).alias("selector"), typed.alias("value")).alias("action"),
        F.when(m == 11, 7.5).otherwise(0.75).alias("confidence"), F.lit("  done \n it ").alias("reasoning_summary"), evidence.alias("evidence"),
    ))
    reply = F.when(m == 0, F.concat(F.lit("<think>{no}"), body)).when(m == 1, F.lit("no object here")).when(m % 2 == 0, F.concat(F.lit("<think>{a</think> ```json "), body, F.lit(" ```"))).otherwise(body)
    task = F.when(o % 3 == 0, "those with a pending fee").otherwise("pay the fee")
    return table(spark, sf_dir, "orders").select(o.alias("reply_id"), (o % pages).alias("page_id"), task.alias("task"), reply.alias("reply"))


@query(f"""
WITH asked AS (SELECT o_orderkey AS o, o_orderkey % 16 AS m, o_orderkey % 64 AS page_id, 'e' || ((o_orderkey % 64) * 8 + (o_orderkey // 64) % 8) AS sel, 'e' || ((o_orderkey % 64) * 8 + (o_orderkey // 64) % 8 + 1) AS after FROM orders),
met AS (SELECT a.*, e.id, e.v, e.l, e."row", c.id AS cited, c."row" AS cited_row, CASE WHEN c.t = 'text' THEN true ELSE false END AS says_it FROM asked a LEFT JOIN {_E} e ON e.page_id = a.page_id AND e.id = a.sel AND m <> 6
  LEFT JOIN {_E} c ON c.page_id = a.page_id AND c.id = CASE m WHEN 13 THEN a.after ELSE a.sel END),
judged AS (SELECT *, CASE WHEN m IN (7, 8, 9, 10) THEN 'type' WHEN m = 12 THEN 'scroll' ELSE 'click' END AS act, CASE
  WHEN m = 0 THEN 'ended inside its reasoning' WHEN m = 1 THEN 'no object' WHEN m = 2 THEN NULL WHEN m = 3 THEN 'no recognised status' WHEN m = 4 THEN 'action not allowed'
  WHEN id IS NULL THEN 'element not in the page' WHEN m = 5 THEN 'value for an action that takes none' WHEN m = 7 THEN 'nothing to type'
  WHEN m IN (9, 10) AND starts_with(v, '[') THEN 'literal for a redacted field' WHEN m = 10 THEN 'placeholder typed'
  WHEN m IN (11, 13, 14, 15) AND l = 'I agree to receive offers' THEN 'optional box'
  WHEN m = 11 AND "row" IS NOT NULL THEN 'no evidence'
  WHEN m >= 13 AND "row" IS NOT NULL THEN CASE WHEN cited IS NULL THEN 'cited element not on the page' WHEN cited_row IS DISTINCT FROM "row" THEN 'evidence from another row'
    WHEN m = 14 OR NOT says_it THEN 'quoted words not there' WHEN o % 3 <> 0 THEN 'evidence shows an unmet condition' END END AS refused FROM met)
SELECT o AS reply_id, page_id, CASE WHEN refused IS NULL AND m <> 2 THEN act END AS action, CASE WHEN refused IS NULL AND m <> 2 THEN sel END AS element_id,
  CASE WHEN refused IS NULL AND m = 8 THEN '[USE_SAVED_CREDENTIAL]' WHEN refused IS NULL AND m = 9 THEN 'someone' END AS value,
  (CASE WHEN refused IS NOT NULL THEN NULL WHEN m = 2 THEN 0 WHEN m = 11 THEN 0.5 ELSE 0.75 END)::DOUBLE AS confidence, CASE WHEN refused IS NULL THEN 'done it' END AS summary, refused FROM judged
""")
def reply_validation(spark, sf_dir):
    return replies.interpreted(_replies(spark, sf_dir), _elements(spark, sf_dir))


@query("""
WITH steps AS (SELECT o_custkey AS run, o_orderkey AS step, (o_orderkey * 7) % 3 AS what, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
marked AS (SELECT *, what = 2 AND n > 3 AS final, coalesce(what = lag(what) OVER (PARTITION BY run ORDER BY n), false) AS again FROM steps),
cut AS (SELECT run, least(5, coalesce(min(n) FILTER (final), 99), coalesce(min(n) FILTER (again) - 1, 99), max(n)) AS last FROM marked GROUP BY run)
SELECT m.run AS run_id, step, CASE WHEN n = last THEN CASE WHEN final THEN 'final' WHEN EXISTS (SELECT 1 FROM marked x WHERE x.run = m.run AND x.n = m.n + 1 AND x.again) THEN 'repeat' WHEN n = 5 THEN 'most steps' ELSE 'done' END END AS stop
FROM marked m JOIN cut c ON m.run = c.run WHERE n <= last
""")
def task_steps(spark, sf_dir):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    what = (F.col("o_orderkey") * 7) % 3
    steps = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("step"), guards.signature(F.lit("click"), what.cast("string"), F.lit(None)).alias("signature"), ((what == 2) & (n > 3)).alias("final"))
    return guards.taken_steps(steps).select("run_id", "step", "stop")


@query("""
WITH e AS (SELECT *, (epoch_us(ts) // 1000) AS "at", lead((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS newer FROM events)
SELECT user_id AS device_id, event_id AS request_id, CASE WHEN event_id % 4 < 2 AND delay <= least(60000, coalesce(newer - "at", 60000)) THEN CASE WHEN event_id % 4 = 0 THEN 'approved' ELSE 'declined' END
  WHEN newer - "at" <= 60000 THEN 'stale' ELSE 'timed-out' END AS outcome FROM (SELECT *, (event_id * 37) % 90000 AS delay FROM e)
""")
def consent_outcomes(spark, sf_dir):
    e = F.col("event_id")
    requests = table(spark, sf_dir, "events").select(F.col("user_id").alias("device_id"), e.alias("request_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    r = F.col("request_id")
    answered = requests.where(r % 4 < 2).select("device_id", "request_id", (F.col("at") + (r * 37) % 90000).alias("at"), (r % 4 == 0).alias("approved"))
    return guards.consents(requests, answered).select("device_id", "request_id", "outcome")


@query("""
WITH s AS (SELECT l_orderkey AS run, l_linenumber AS step, CASE WHEN (l_orderkey + l_linenumber) % 5 = 0 THEN 0 ELSE l_linenumber - l_orderkey % 2 END AS hit, 1 + l_orderkey % 3 AS need FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step, hit) AS n FROM s),
f AS (WITH RECURSIVE f AS (SELECT run, 0::BIGINT AS n, 0::BIGINT AS met FROM (SELECT DISTINCT run FROM r)
  UNION ALL SELECT f.run, r.n, CASE WHEN f.met < r.need AND r.n <= r.need + 3 AND r.hit = f.met + 1 THEN f.met + 1 ELSE f.met END FROM f JOIN r ON r.run = f.run AND r.n = f.n + 1) SELECT * FROM f)
SELECT f.run AS run_id, max(met)::INT AS met, (least(max(f.n), max(r.need) + 3) - max(met))::INT AS wrong, max(met) = max(r.need) AS passed FROM f JOIN r ON r.run = f.run AND r.n = f.n GROUP BY f.run
""")
def run_verdicts(spark, sf_dir):
    o, n = F.col("l_orderkey"), F.col("l_linenumber").cast("long")
    steps = table(spark, sf_dir, "lineitem").select(o.alias("run_id"), n.alias("step"), F.when((o + n) % 5 == 0, F.lit(0)).otherwise(n - o % 2).alias("matches"), (1 + o % 3).cast("int").alias("expected"))
    return guards.verdicts(steps)


@query("""
WITH a AS (SELECT event_id // 3 AS request, event_id AS attempt, CASE event_id % 3 WHEN 0 THEN 'model' WHEN 1 THEN 'backup' ELSE 'rules' END AS path, CASE WHEN event_id % 5 < 3 THEN event_type END AS refused FROM events)
SELECT request AS request_id, arg_min(path, attempt) FILTER (refused IS NULL) AS path, coalesce(string_agg(refused, '; ' ORDER BY attempt), '') AS fell_back_because FROM a GROUP BY request
""")
def answer_path(spark, sf_dir):
    e = F.col("event_id")
    path = F.when(e % 3 == 0, "model").when(e % 3 == 1, "backup").otherwise("rules")
    tried = table(spark, sf_dir, "events").select(F.floor(e / 3).alias("request_id"), e.alias("attempt"), path.alias("path"), F.when(e % 5 < 3, F.col("event_type")).alias("refused"))
    return replies.first_answer(tried)


@query("""
SELECT doc_id, n_chars > 944 AS partial, CASE WHEN n_chars > 944 THEN n_chars / 920.0::DOUBLE ELSE 1 END::DOUBLE AS screens,
  CASE WHEN n_chars > 944 THEN 'about ' || printf('%.1f', floor(n_chars / 920.0::DOUBLE * 10 + 0.5) / 10) || ' screens, one of them examined' || CASE WHEN doc_id % 3 > 0 THEN '; outside it are ' || doc_id % 3 || CASE WHEN doc_id % 3 = 1 THEN ' element' ELSE ' elements' END ELSE '' END ELSE 'all of the page examined' END AS message FROM documents
""")
def coverage_notes(spark, sf_dir):
    note = guards.coverage_note(F.col("n_chars"), F.lit(920), F.col("doc_id") % 3)
    return table(spark, sf_dir, "documents").select("doc_id", note.alias("n")).select("doc_id", "n.*")


@query("""
SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...(truncated)' ELSE text END AS shown, regexp_matches(text, 'AIza[0-9A-Za-z_-]{27,}|sk-[A-Za-z0-9_-]{20,}') AS credential FROM documents WHERE text IS NOT NULL
""")
def credential_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", replies.truncated(F.col("text")).alias("shown"), replies.holds_credential(F.col("text")).alias("credential"))
