"""SQL for DuckDB that checks conversation repair and periodic runs by plainer ways: sums over states, and all pairs of equal words."""

from __future__ import annotations

#: Table of the checksum's 256 steps; 3988292384 is its reversed polynomial.
CRC_TABLE = """crc AS (SELECT list(x ORDER BY n) AS steps FROM (
  SELECT n, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n) AS x FROM range(256) r(n)))"""
SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def crc32(key: str) -> str:
    """Checksum of an ASCII text, with `crc` in FROM."""
    codes = f"list_transform(string_split({key}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda c, b: xor(steps[xor(c, b) % 256 + 1], c // 256), 4294967295), 4294967295)"


def _step(state: str, cost: str, edit: str, line: str | None = None) -> str:
    more = f" || {line} || chr(10)" if line else ""
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 'r': {state}.r{more}}}"


def _least(*states: str) -> str:
    return f"list_min([{', '.join(states)}])"


def _if(condition: str, state: str) -> str:
    """The state if the condition holds, else one that costs too much to be chosen."""
    return f"CASE WHEN {condition} THEN {state} ELSE {{'c': 1000000::BIGINT, 'a': '', 'r': ''}} END"


def _renamed(state: str, role: str) -> str:
    return _if("kind < 2", _step(state, "1 + 5 * kind", "R", f"'{role}:' || text"))


def _kept(state: str, initial: str) -> str:
    return _if(f"kind < 2 AND initial = '{initial}'", _step(state, "5 * kind", "K", "role || ':' || text"))


def _inserted(source: str) -> str:
    """States after inserts: user after anything but user, then assistant after user."""
    users = _least("u", *(_step(s, "5", "I", "'user:'") for s in ("e", "s", "a")))
    return f"SELECT * REPLACE ({_least('a', _step('u', '5', 'I', repr('assistant:')))} AS a) FROM (SELECT * REPLACE ({users} AS u) FROM ({source}))"


#: States: e nothing, s system, u user, a assistant; each with its cheapest cost, edits and text.
CONVERSATIONS = f"""WITH RECURSIVE {CRC_TABLE},
hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations, crc),
harmed AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM hit WHERE k <> 0),
shown AS (
  SELECT *, left(role, 1) AS initial, rtrim(text, {SPACES}) AS seen, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM harmed),
judged AS (
  SELECT *, CASE WHEN seen = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM shown),
marked AS (SELECT *, CASE fault WHEN '' THEN 0 WHEN 'truncated' THEN 1 ELSE 2 END AS kind FROM judged),
ids AS (SELECT DISTINCT conv_id FROM conversations),
far AS (SELECT {{'c': 1000000::BIGINT, 'a': '', 'r': ''}} AS x),
states AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'r': ''}} AS e, x AS s, x AS u, x AS a FROM ids, far
  UNION ALL
  SELECT conv_id, i,
         {_step('e', '2', 'D')} AS e,
         {_least(_step('s', '2', 'D'), _kept('e', 's'))} AS s,
         {_least(_step('u', '2', 'D'), *(_kept(x, 'u') for x in 'esa'), *(_renamed(x, 'user') for x in 'esa'))} AS u,
         {_least(_step('a', '2', 'D'), _kept('u', 'a'), _renamed('u', 'assistant'))} AS a
  FROM ({_inserted('SELECT states.conv_id, m.i, e, s, u, a, m.role, m.text, m.initial, m.kind FROM states JOIN marked m ON m.conv_id IS NOT DISTINCT FROM states.conv_id AND m.i = states.i + 1')})),
ended AS (SELECT conv_id, {_least('e', 'a')} AS best FROM ({_inserted('SELECT * FROM states QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1')})),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id)
SELECT ended.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.c::BIGINT AS cost, best.a AS audit,
       sha256(left(best.r, greatest(length(best.r) - 1, 0))) AS repaired_sha256
FROM ended LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ended.conv_id"""

#: Every pair of equal words at most a quarter of the text apart; neighbouring pairs of one distance are a stretch; its smallest distance is the period.
PERIODIC = f"""WITH {CRC_TABLE},
split AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
drawn AS (SELECT doc_id, w, len(w) AS n, {crc32("coalesce(doc_id::VARCHAR, ' ')")} AS h FROM split, crc),
picked AS (SELECT doc_id, w, n, h % 10 = 0 AND n > 0 AND doc_id IS NOT NULL AS hit, CASE WHEN n > 0 THEN h // 10 % n END AS a, 3 + h // 10 % 8 AS parts FROM drawn),
planted AS (
  SELECT doc_id, n, CASE WHEN hit THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // parts) + 1] END) ELSE w END AS w FROM picked),
words AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM planted),
pairs AS (SELECT a.doc_id, a.i, b.i - a.i AS p FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND (b.i - a.i) * 4 <= a.n),
stretches AS (
  SELECT doc_id, p, min(i) AS s, max(i) + p + 1 AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM pairs)
  GROUP BY doc_id, p, island HAVING max(i) + p + 1 - min(i) >= greatest(6, 4 * p)),
runs AS (SELECT doc_id, s, e, min(p) AS p FROM stretches GROUP BY ALL),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + p, e)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
told AS (SELECT doc_id, count(*) AS n, string_agg(s || ',' || (e - s) || ',' || p || chr(10), '' ORDER BY s, p) AS text FROM runs GROUP BY doc_id),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY (e - s)::DOUBLE / p DESC, s, p) = 1)
SELECT d.doc_id, coalesce(told.n, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, (best.e - best.s)::BIGINT AS length, best.p::BIGINT AS period,
       (1000 * (best.e - best.s) // best.p)::BIGINT AS exponent_milli, sha256(coalesce(told.text, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN told USING (doc_id) LEFT JOIN best USING (doc_id)"""
