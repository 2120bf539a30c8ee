"""Operator 13 in SQL: the damage, the faults and the fold as a recursive query over turns.

A way of the fold is one text: twelve digits of cost, then the letters, so that the least text is the least way.
"""

from __future__ import annotations


def _add(way: str, cost: str, letter: str) -> str:
    return f"(lpad(CAST(CAST(left({way}, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || substr({way}, 13) || {letter})"


def _never() -> str:
    return "'900000000000'"


def _closed(names: str = "e, s, u, a") -> str:
    """Select lists that add free insertions to the columns e, s, u, a of a subquery."""
    user = f"least(u, {_add('least(e, s, a)', '3', chr(39) + 'J' + chr(39))})"
    return f"e, s, {user} AS u, least(a, {_add(user, '3', chr(39) + 'I' + chr(39))}) AS a"


def _letter(role: str, rename: str) -> str:
    return f"CASE WHEN t.i = '{role}' THEN 'K' ELSE '{rename}' END"


def _price(role: str) -> str:
    return f"(t.stays + CASE WHEN t.i = '{role}' THEN 0 ELSE 3 END)"


_GONE = {x: _add(f"w.{x}", "4", "'D'") for x in "esua"}
_SYSTEM = _add("w.e", "(t.stays + CASE WHEN t.i = 's' THEN 0 ELSE 900000000000 END)", "'K'")
_USER = _add("least(w.e, w.s, w.a)", _price("u"), _letter("u", "S"))
_ASSISTANT = _add("w.u", _price("a"), _letter("a", "R"))
_BYTE = "list_reduce(list_prepend(xor(c, b), range(8)), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))"

SQL = rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hit AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(k) + 1), lambda j: CAST(ascii(substr(k, CAST(j AS INTEGER), 1)) AS BIGINT))), lambda c, b: {_BYTE}), 4294967295) % 20 AS h FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hit WHERE h <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, lag(role) OVER (PARTITION BY conv_id ORDER BY pos) AS role_before FROM placed),
turns AS (
  SELECT *, left(role, 1) AS i, CASE WHEN fault IN (1, 2) THEN 900000000000 WHEN fault = 3 THEN 3 ELSE 0 END AS stays FROM (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN again THEN 2
      WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 0 ELSE 3 END AS fault FROM seen)),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, {_closed()} FROM (SELECT DISTINCT conv_id, '000000000000' AS e, {_never()} AS s, {_never()} AS u, {_never()} AS a FROM turns)
  UNION ALL
  SELECT conv_id, pos, {_closed()} FROM (
    SELECT t.conv_id, t.pos, {_GONE['e']} AS e, least({_GONE['s']}, {_SYSTEM}) AS s, least({_GONE['u']}, {_USER}) AS u, least({_GONE['a']}, {_ASSISTANT}) AS a
    FROM walk w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.pos = w.pos + 1)),
ends AS (SELECT conv_id, least(e, a) AS way FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1),
edits AS (SELECT conv_id, unnest(string_split(substr(way, 13), '')) AS x, generate_subscripts(string_split(substr(way, 13), ''), 1) AS nth FROM ends WHERE length(way) > 12),
placed_edits AS (SELECT *, sum(CASE WHEN x IN ('I', 'J') THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY nth) AS pos FROM edits),
lines AS (
  SELECT p.conv_id, p.nth, CASE x WHEN 'J' THEN 'user:' WHEN 'I' THEN 'assistant:' WHEN 'S' THEN 'user:' || t.text WHEN 'R' THEN 'assistant:' || t.text ELSE t.role || ':' || t.text END AS line
  FROM placed_edits p LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.pos = p.pos WHERE x <> 'D'),
texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY nth) AS repaired FROM lines GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pos > 1 AND left(role_before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id)
SELECT i.conv_id, CAST(coalesce(c.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(c.blank, 0) AS BIGINT) AS blank, CAST(coalesce(c.duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(c.truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(c.illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(CAST(left(e.way, 12) AS BIGINT), 0) AS BIGINT) AS cost,
  coalesce(translate(substr(e.way, 13), 'JS', 'IR'), '') AS audit, sha256(coalesce(t.repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id
  LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM i.conv_id"""
