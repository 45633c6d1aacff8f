"""DuckDB SQL for folds that depend on order: a recursive query that takes one row of each group at a time."""

from __future__ import annotations


def kept_sql(items: str, order: str, clash: str, most: int | None = None) -> str:
    """Rows of ``items`` (g, k, ...), in ``order``, that clash with none kept before in their group g. ``clash`` is of rows a and b."""
    return f"""
WITH RECURSIVE i AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY {order}) AS n FROM ({items})),
c AS (SELECT b.k, list(a.k) AS foes FROM i a JOIN i b ON a.g = b.g AND a.n < b.n AND {clash} GROUP BY b.k),
f AS (SELECT g, 0::BIGINT AS n, []::BIGINT[] AS kept, false AS took FROM (SELECT DISTINCT g FROM i)
  UNION ALL SELECT f.g, i.n, CASE WHEN list_has_any(f.kept, coalesce(c.foes, [])) THEN f.kept ELSE list_append(f.kept, i.k) END, NOT list_has_any(f.kept, coalesce(c.foes, []))
  FROM f JOIN i ON i.g = f.g AND i.n = f.n + 1 LEFT JOIN c ON c.k = i.k)
SELECT i.* FROM i JOIN f ON f.g = i.g AND f.n = i.n WHERE took{f" QUALIFY row_number() OVER (PARTITION BY i.g ORDER BY i.n) <= {most}" if most else ""}"""


def matched_sql(pairs: str) -> str:
    """Pairs (page_id, a, b, weight) by weight, then a, then b, whose ends no pair before has taken."""
    return f"""
WITH RECURSIVE i AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY -weight, a, b) AS n FROM ({pairs})),
f AS (SELECT page_id, 0::BIGINT AS n, []::BIGINT[] AS ends, []::BIGINT[] AS others, false AS took FROM (SELECT DISTINCT page_id FROM i)
  UNION ALL SELECT page_id, n, CASE WHEN free THEN list_append(ends, a) ELSE ends END, CASE WHEN free THEN list_append(others, b) ELSE others END, free FROM (
    SELECT f.page_id, i.n, f.ends, f.others, i.a, i.b, NOT list_contains(f.ends, i.a) AND NOT list_contains(f.others, i.b) AS free FROM f JOIN i ON i.page_id = f.page_id AND i.n = f.n + 1))
SELECT i.* FROM i JOIN f ON f.page_id = i.page_id AND f.n = i.n WHERE took"""


def lined_sql(words: str) -> str:
    """``words`` (g, k, x, y, w, h, ...) with ``line``: the number of the line that a word joins or opens."""
    return f"""
WITH RECURSIVE i AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY y, x, k) AS n, y + h / 2.0 AS c FROM ({words})),
f AS (SELECT g, 0::BIGINT AS n, []::STRUCT(c DOUBLE, h DOUBLE)[] AS heads, NULL::BIGINT AS line FROM (SELECT DISTINCT g FROM i)
  UNION ALL SELECT g, n, CASE WHEN line > len(heads) THEN list_append(heads, {{'c': c::DOUBLE, 'h': h::DOUBLE}}) ELSE heads END, line FROM (
    SELECT i.g, i.n, i.c, i.h, f.heads, coalesce(nullif(list_position(list_transform(f.heads, lambda q: abs(q.c - i.c) <= 0.6 * greatest(q.h, i.h)), true), 0), len(f.heads) + 1) AS line FROM f JOIN i ON i.g = f.g AND i.n = f.n + 1))
SELECT i.*, f.line FROM i JOIN f ON f.g = i.g AND f.n = i.n"""
