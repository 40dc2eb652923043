"""The queries on step sequences in SQL: an independent check of labels, patterns, runs and pairs."""

from __future__ import annotations

_WIDE = "".join(chr(0xFF21 + i) for i in range(26)) + "".join(chr(0xFF41 + i) for i in range(26))
_NARROW = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_KEY = "regexp_replace(regexp_replace(lower(translate({0}, '" + _WIDE + "', '" + _NARROW + r"')), '^[^a-z0-9]*step *[0-9]+ *:|\bv[0-9]+\b|, *attempt *[0-9]+', ' ', 'g'), '[^a-z]', '', 'g')"
#: step(workflow_id, language, pos, label): the labels of the latest row of each workflow.
_STEPS = rf"""
    last AS (SELECT DISTINCT ON (workflow_id) workflow_id, language, sequence_id FROM processed_workflows WHERE workflow_id IS NOT NULL ORDER BY workflow_id, processed_at DESC),
    bare AS (SELECT workflow_id, language, regexp_replace(replace(sequence_id, chr(226) || chr(134) || chr(146), '→'), '\([^()]*\)|\[[^\[\]]*\]', ' ', 'g') AS s FROM last),
    part AS (SELECT workflow_id, language, unnest(string_split_regex(s, '→|⟶|➔|->|=>|>|;')) AS p, generate_subscripts(string_split_regex(s, '→|⟶|➔|->|=>|>|;'), 1) AS i FROM bare),
    spelt AS (SELECT workflow_id, language, i, {_KEY.format("p")} AS k FROM part),
    key AS (SELECT display_label AS label, {_KEY.format("display_label")} AS k FROM step_labels),
    letter AS (SELECT label, k, unnest(range(1, len(k) + 1)) AS i FROM key),
    slip AS (SELECT label, k[:i - 1] || k[i + 1:] AS k FROM letter UNION SELECT label, k[:i] || k[i:] FROM letter UNION SELECT label, k[:i - 1] || k[i + 1] || k[i] || k[i + 2:] FROM letter WHERE i < len(k)),
    known AS (SELECT k, label FROM key UNION SELECT k, any_value(label) FROM slip WHERE k NOT IN (SELECT k FROM key) GROUP BY k HAVING count(DISTINCT label) = 1),
    step AS (SELECT workflow_id, CASE lower(trim(language, E' \t\n\r')) WHEN 'python' THEN 'Python' WHEN 'java' THEN 'Java' WHEN 'c++' THEN 'C++' WHEN 'cpp' THEN 'C++' END AS language,
             row_number() OVER (PARTITION BY workflow_id ORDER BY i) AS pos, label FROM spelt LEFT JOIN known USING (k) WHERE k <> '')"""

ORACLES = {
    "p1_patterns": f"""
        WITH {_STEPS},
        t AS (SELECT language, count(DISTINCT workflow_id) AS n FROM step WHERE language IS NOT NULL GROUP BY 1),
        often AS (SELECT language, label FROM step JOIN t USING (language) GROUP BY ALL HAVING count(DISTINCT workflow_id) >= greatest(5, 0.08 * any_value(n))),
        e AS (SELECT * FROM step SEMI JOIN often USING (language, label)),
        w2 AS (SELECT a.workflow_id, a.language, a.label AS l1, b.label AS l2, min(b.pos) AS pos FROM e a JOIN e b ON a.workflow_id = b.workflow_id AND a.pos < b.pos AND a.label <> b.label GROUP BY ALL),
        f2 AS (SELECT language, l1, l2 FROM w2 JOIN t USING (language) GROUP BY ALL HAVING count(*) >= greatest(5, 0.08 * any_value(n))),
        k2 AS (SELECT * FROM w2 SEMI JOIN f2 USING (language, l1, l2)),
        w3 AS (SELECT a.workflow_id, a.language, l1, l2, b.label AS l3, min(b.pos) AS pos FROM k2 a JOIN e b ON a.workflow_id = b.workflow_id AND a.pos < b.pos AND b.label NOT IN (l1, l2) GROUP BY ALL),
        f3 AS (SELECT language, l1, l2, l3, count(*) AS c FROM w3 JOIN t USING (language) GROUP BY ALL HAVING count(*) >= greatest(5, 0.08 * any_value(n))),
        k3 AS (SELECT * FROM w3 SEMI JOIN f3 USING (language, l1, l2, l3)),
        w4 AS (SELECT DISTINCT a.workflow_id, a.language, l1, l2, l3, b.label AS l4 FROM k3 a JOIN e b ON a.workflow_id = b.workflow_id AND a.pos < b.pos AND b.label NOT IN (l1, l2, l3)),
        f4 AS (SELECT language, l1, l2, l3, l4, count(*) AS c FROM w4 JOIN t USING (language) GROUP BY ALL HAVING count(*) >= greatest(5, 0.08 * any_value(n))),
        f AS (SELECT language, concat_ws(' → ', l1, l2, l3) AS pattern, c FROM f3 UNION ALL SELECT language, concat_ws(' → ', l1, l2, l3, l4), c FROM f4)
        SELECT language, pattern, c AS workflows, round(c / n, 6) AS share FROM f JOIN t USING (language)""",
    "p2_found": f"""
        WITH {_STEPS},
        g AS (SELECT *, pos - row_number() OVER (PARTITION BY workflow_id, label ORDER BY pos) AS run FROM step)
        SELECT workflow_id, min(pos) AS first_pos, max(pos) AS last_pos FROM g GROUP BY workflow_id, label, run HAVING count(*) >= 2""",
    "p2_runs": f"""
        WITH {_STEPS},
        l AS (SELECT DISTINCT ON (workflow_id) workflow_id, step_seconds FROM processed_workflows WHERE workflow_id IS NOT NULL ORDER BY workflow_id, processed_at DESC),
        g AS (SELECT step.*, step_seconds[pos] AS s, pos - row_number() OVER (PARTITION BY workflow_id, label ORDER BY pos) AS run FROM step JOIN l USING (workflow_id))
        SELECT workflow_id, label, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS events, sum(s)::BIGINT AS seconds FROM g GROUP BY workflow_id, label, run""",
    "p2_event_runs": """
        WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
        g AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id, event_type ORDER BY pos) AS run FROM e)
        SELECT user_id, event_type, min(ts) AS first_at, max(ts) AS last_at, count(*) AS events, round(sum(value), 4) AS total FROM g GROUP BY user_id, event_type, run""",
    "p6_pairs": f"""
        WITH {_STEPS},
        d AS (SELECT DISTINCT workflow_id, label FROM step),
        n AS (SELECT count(DISTINCT workflow_id) AS n FROM d),
        s AS (SELECT label, count(*) AS k FROM d GROUP BY 1),
        c AS (SELECT x.label AS step_a, y.label AS step_b, count(*) AS c FROM d x JOIN d y ON x.workflow_id = y.workflow_id AND x.label < y.label GROUP BY ALL)
        SELECT step_a, step_b, c, a.k AS a, b.k AS b, n, round(c * n / (a.k::DOUBLE * b.k), 6) AS lift, round(CASE WHEN c = n THEN 1 ELSE ln(c * n / (a.k::DOUBLE * b.k)) / -ln(c / n) END, 6) AS npmi
        FROM c JOIN s a ON a.label = step_a JOIN s b ON b.label = step_b, n""",
}
ORACLES["p6_found"] = f"SELECT step_a, step_b FROM ({ORACLES['p6_pairs']}) WHERE c >= 5 AND c * 1000 >= 4 * n AND c * n >= 3 * a * b"
ORACLES["p1_found"] = f"SELECT language, pattern FROM ({ORACLES['p1_patterns']})"
