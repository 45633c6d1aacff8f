"""URL filter: rules first, then trust and distrust spread over the links between hosts.

Rules name a host and a path; one fits its host and all subdomains where the url's path begins with
its path, and the longest that fits decides. For urls that no rule fits, the host decides: trust
flows along links from hosts whose pages the rules allow, distrust flows against them from hosts
whose pages they block (who links to a blocked host is suspect), each by a fixed number of rounds of
personalised PageRank. A host is blocked if its balance, (trust - distrust) / (trust + distrust + 1 / hosts),
is below a threshold; hosts that nothing reaches have balance 0.

Host: what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased (a port or user
stays part of it); path: then up to `?`, `#` or the end. Null urls, or ones without `://`, have an
empty host and path, fit no rule and belong to no host: the method allows them. Links are the
absolute and protocol-relative href values of the html; null html has none, links within a host
carry nothing. Of equally long rules that fit the first by text decides. Repeated pages count each
time in a host's share of allowed and blocked pages; repeated links count as often. Extra columns
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.shared import discard, written

#: (verdict, host, path), the production rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Share of a host's rank that follows its links, rounds, balance below which a host is blocked, rows up to which a host table is broadcast.
DAMPING, ROUNDS, THRESHOLD, BROADCAST_ROWS = 0.85, 8, -0.5, 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"(?i)href\s*=\s*[\x22']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#\x22'<>\s]+)"


def _rest(url: str) -> Column:
    return F.when(F.col(url).contains("://"), F.substring_index(F.col(url), "://", 1))


def host(url: str = "url") -> Column:
    after = F.substring(F.col(url), F.length(_rest(url)) + 4, F.length(F.col(url)))
    return F.coalesce(F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: str = "url") -> Column:
    after = F.substring(F.col(url), F.length(_rest(url)) + 4, F.length(F.col(url)))
    return F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(rules: Sequence[tuple[str, str, str]], host: str = "host", path: str = "path") -> Column:
    """STRUCT<rule, verdict> of the longest rule that fits, else null. Rules are a parameter list; a
    url's host is looked up by its suffixes, not compared with every rule."""
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, h, p in rules:
        by_host.setdefault(h, []).append((p, h + p, verdict))
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    entry = lambda p, r, v: F.struct(F.lit(p).alias("path"), (F.lit(-len(r))).alias("short"), F.lit(r).alias("rule"), F.lit(v).alias("verdict"))
    table = F.create_map(*[x for h, own in sorted(by_host.items()) for x in (F.lit(h), F.array(*[entry(*o) for o in sorted(own)]))])
    labels = F.split(F.col(host), r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    near = F.filter(F.transform(suffixes, lambda s: F.try_element_at(table, s)), lambda x: x.isNotNull())
    fits = F.filter(F.flatten(near), lambda r: F.startswith(F.col(path), r["path"]))
    best = F.array_min(F.transform(fits, lambda r: F.struct(r["short"], r["rule"], r["verdict"])))
    return F.when(F.col(host) != "", F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict"))))


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts. Added up per host pair, and before the shuffle."""
    to = F.explode(F.array_compact(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))))
    found = pages.select("host", "html").where("host <> '' and html like '%//%'").select(F.col("host").alias("src"), to.alias("_to"))
    return found.select("src", F.translate("_to", UPPER, LOWER).alias("dst")).where("dst <> '' and dst <> src").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def balances(judged: DataFrame, links: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, balance) for every host of ``judged`` (host, verdict) and of the links."""
    pages = judged.where("host <> ''").groupBy("host").agg(F.avg(F.when(F.col("verdict") == "allow", 1.0).otherwise(0.0)).alias("trust"), F.avg(F.when(F.col("verdict") == "block", 1.0).otherwise(0.0)).alias("distrust"))
    named = pages.unionByName(links.select(F.explode(F.array("src", "dst")).alias("host")).distinct().select("host", F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust")))
    seeds = written(named.groupBy("host").agg(F.max("trust").alias("trust"), F.max("distrust").alias("distrust")), "seeds")
    whole = seeds.agg(F.count(F.lit(1)).alias("hosts"), F.sum("trust").alias("t"), F.sum("distrust").alias("d")).first()
    start = lambda c, total: F.col(c) / F.lit(total or 1.0)
    seeds = seeds.select("host", start("trust", whole.t).alias("s_trust"), start("distrust", whole.d).alias("s_distrust"))
    ahead = links.join(links.groupBy("src").agg(F.sum("n").alias("out")), "src").select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("n") / F.col("out")).alias("w"), F.lit(True).alias("forward"))
    back = links.join(links.groupBy("dst").agg(F.sum("n").alias("out")), "dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), (F.col("n") / F.col("out")).alias("w"), F.lit(False).alias("forward"))
    edges = written(ahead.union(back), "host-edges")
    ranks = seeds.select("host", F.col("s_trust").alias("trust"), F.col("s_distrust").alias("distrust"))
    if edges.limit(1).count():
        for _ in range(rounds):
            flow = edges.join(ranks, edges["a"] == ranks["host"]).groupBy("b").agg(F.sum(F.when(F.col("forward"), F.col("w") * F.col("trust"))).alias("in_trust"), F.sum(F.when(~F.col("forward"), F.col("w") * F.col("distrust"))).alias("in_distrust"))
            moved = lambda c: ((1 - damping) * F.col(f"s_{c}") + damping * F.coalesce(f"in_{c}", F.lit(0.0))).alias(c)
            new = written(seeds.join(flow, F.col("host") == F.col("b"), "left").select("host", moved("trust"), moved("distrust")), "ranks")
            discard(ranks)
            ranks = new
    total = ranks.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d")).first()  # what leaks at hosts without links returns in proportion
    t, d = start("trust", total.t), start("distrust", total.d)
    return ranks.select("host", ((t - d) / (t + d + F.lit(1.0 / max(1, whole.hosts)))).alias("balance"))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, damping: float = DAMPING, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every page."""
    parsed = pages.select("page_id", "html", host().alias("host"), path().alias("path")).withColumn("_r", rule_for(rules))
    narrow = parsed.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("verdict"))
    links = written(host_links(parsed), "host-links")
    scores = written(balances(narrow.select("host", "verdict"), links, damping, rounds).where(F.col("balance") < threshold).select(F.col("host").alias("_bad")), "blocked-hosts")
    if scores.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        scores = F.broadcast(scores)  # a checked size; more hosts are joined by a shuffle, which AQE splits at hot ones
    by_host = F.when(F.col("_bad").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return narrow.join(scores, F.col("host") == F.col("_bad"), "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", by_host).alias("verdict"))


def oracle(rules: Sequence[tuple[str, str, str]] = RULES, damping: float = DAMPING, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for ``judged`` over pages."""
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    steps = "".join(
        f""", r{i + 1} AS MATERIALIZED (SELECT s.host, {1 - damping}::DOUBLE * s_t + {damping}::DOUBLE * coalesce(it, 0) AS t, {1 - damping}::DOUBLE * s_d + {damping}::DOUBLE * coalesce(id, 0) AS d
  FROM seeds s LEFT JOIN (SELECT b, sum(CASE WHEN forward THEN w * t END) AS it, sum(CASE WHEN NOT forward THEN w * d END) AS id FROM edges JOIN r{i} ON a = host GROUP BY b) f ON s.host = f.b)"""
        for i in range(rounds)
    )
    link = LINK.replace("'", "''")
    lower = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    return f"""
WITH cut AS (SELECT row_number() OVER () AS k, page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parsed AS (SELECT k, page_id, html, coalesce({lower("regexp_extract(rest, '^[^/?#]*')")}, '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
rules(verdict, h, p) AS (VALUES {values}),
fit AS (SELECT k, arg_min(struct_pack(rule := h || p, verdict := verdict), struct_pack(short := -length(h || p), rule := h || p)) AS r
  FROM parsed JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k),
narrow AS (SELECT k, page_id, host, path, r.rule AS rule, r.verdict AS verdict FROM parsed LEFT JOIN fit USING (k)),
links AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, {lower(f"unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1))")} AS dst FROM parsed WHERE host <> '') WHERE dst <> '' AND dst <> src GROUP BY 1, 2),
seeded AS (SELECT host, max(t) AS t, max(d) AS d FROM (SELECT host, avg((verdict IS NOT DISTINCT FROM 'allow')::INT) AS t, avg((verdict IS NOT DISTINCT FROM 'block')::INT) AS d FROM narrow WHERE host <> '' GROUP BY host
  UNION ALL SELECT src, 0, 0 FROM links UNION ALL SELECT dst, 0, 0 FROM links) GROUP BY host),
seeds AS MATERIALIZED (SELECT host, t / coalesce(nullif(sum(t) OVER (), 0), 1) AS s_t, d / coalesce(nullif(sum(d) OVER (), 0), 1) AS s_d FROM seeded),
edges AS MATERIALIZED (SELECT src AS a, dst AS b, n / sum(n) OVER (PARTITION BY src) AS w, true AS forward FROM links UNION ALL SELECT dst, src, n / sum(n) OVER (PARTITION BY dst), false FROM links),
r0 AS (SELECT host, s_t AS t, s_d AS d FROM seeds){steps},
shares AS (SELECT host, t / coalesce(nullif(sum(t) OVER (), 0), 1) AS t, d / coalesce(nullif(sum(d) OVER (), 0), 1) AS d, count(*) OVER () AS hosts FROM r{rounds}),
bad AS (SELECT host FROM shares WHERE (t - d) / (t + d + 1.0::DOUBLE / hosts) < {threshold})
SELECT page_id, n.host, path, rule, coalesce(verdict, CASE WHEN bad.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM narrow n LEFT JOIN bad ON n.host = bad.host
"""
