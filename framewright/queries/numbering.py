"""SQL text of the collision numbering, shared by several oracles."""

from __future__ import annotations


def numbering_sql(requests: str, taken: str, order: str) -> str:
    """CTEs ending in `numbered`: rows of `requests` with the number of their first free name."""
    key = "lower(folder) AS lf, lower(stem) AS ls, lower(suffix) AS lx"
    return f"""
asked AS (SELECT *, {key}, row_number() OVER (PARTITION BY lower(folder), lower(stem), lower(suffix) ORDER BY {order}) - 1 AS turn FROM {requests}),
there AS (SELECT DISTINCT {key} FROM {taken}),
every AS (SELECT DISTINCT lf, ls, lx FROM asked UNION SELECT lf, ls, lx FROM there),
occupied AS (
  SELECT lf, ls, lx, 0 AS num FROM there
  UNION SELECT lf, regexp_extract(ls, '^(.+)_([1-9][0-9]*)$', 1), lx, CAST(regexp_extract(ls, '^(.+)_([1-9][0-9]*)$', 2) AS BIGINT)
  FROM every WHERE regexp_matches(ls, '^(.+)_([1-9][0-9]*)$')),
sizes AS (SELECT lf, ls, lx, count(*) + (SELECT count(*) FROM occupied o WHERE o.lf = a.lf AND o.ls = a.ls AND o.lx = a.lx) AS upto FROM asked a GROUP BY lf, ls, lx),
free AS (
  SELECT lf, ls, lx, num, row_number() OVER (PARTITION BY lf, ls, lx ORDER BY num) - 1 AS turn
  FROM (SELECT lf, ls, lx, unnest(range(0, upto + 1)) AS num FROM sizes) c ANTI JOIN occupied USING (lf, ls, lx, num)),
numbered AS (SELECT asked.*, free.num AS number FROM asked JOIN free USING (lf, ls, lx, turn))"""
