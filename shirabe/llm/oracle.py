"""ANSI SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

from shirabe.oracle import nfkc

_FREQUENCIES = f"""
numbered AS (SELECT id, extraction_run_id, term_id, coalesce(frequency, 1) AS n, row_number() OVER (PARTITION BY id ORDER BY extraction_run_id, term_id, frequency) AS k FROM term_candidates),
cand AS (SELECT * FROM numbered WHERE k = 1 AND id IS NOT NULL),
named AS (SELECT id AS term_id, regexp_replace({nfkc("normalized_text")}, '^\\s+|\\s+$', '', 'g') AS term_value FROM terms WHERE normalized_text IS NOT NULL),
total AS (SELECT count(DISTINCT extraction_run_id) AS runs FROM term_candidates),
f AS (SELECT term_value, CAST(coalesce(sum(c.n), 0) AS BIGINT) AS total_frequency, count(DISTINCT c.extraction_run_id) AS n_runs, count(c.id) AS n_rows FROM named v LEFT JOIN cand c ON c.term_id = v.term_id GROUP BY term_value),
m AS (SELECT term_value, total_frequency, n_runs, CASE WHEN n_rows = 0 THEN NULL WHEN total_frequency <= 2 THEN 'rare' WHEN n_runs > runs / 2.0 THEN 'common' END AS mark FROM f, total)"""


def bare(expr: str) -> str:
    """Bare text, for the characters that the test tables hold."""
    unmarked = f"regexp_replace(replace({expr}, chr(65279), ''), '(?m)^[ \\t\\r]*\\[\\[PAGE\\s+[0-9]+\\]\\][ \\t\\r]*$', '', 'g')"
    return f"regexp_replace(lower({nfkc(unmarked)}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


# Every item's stretches of the needed length, looked for in every text.
_LEAKS = f"""WITH docs AS (SELECT doc_id, {bare("text")} AS b FROM documents WHERE text IS NOT NULL AND text <> ''),
items AS (SELECT item_id, {bare("text")} AS b FROM eval_items),
needs AS (SELECT *, CAST(greatest(1, ceil(0.4 * length(b) - 1e-9)) AS BIGINT) AS need FROM items WHERE b <> ''),
stretches AS (SELECT DISTINCT item_id, substr(b, i, need) AS s FROM needs, unnest(range(1, length(b) - need + 2)) AS r(i))
SELECT DISTINCT doc_id, item_id FROM docs JOIN stretches ON contains(docs.b, stretches.s)"""

# All pairs that share a piece and are of like size; then the documents in their order, each against those not refused before it.
_REPEATS = f"""WITH RECURSIVE docs AS (SELECT d.doc_id, r.created_at AS came, {bare("d.text")} AS b FROM documents d JOIN extraction_runs r ON r.id = d.extraction_run_id WHERE d.text IS NOT NULL AND d.text <> ''),
there AS (SELECT *, row_number() OVER (ORDER BY came, doc_id) AS place FROM docs WHERE b <> ''),
pieces AS (SELECT DISTINCT place, substr(b, i, 5) AS piece FROM there, unnest(range(1, greatest(length(b) - 4, 1) + 1)) AS r(i)),
sizes AS (SELECT place, count(*) AS n FROM pieces GROUP BY place),
numbers AS (SELECT piece, row_number() OVER () AS number FROM pieces GROUP BY piece HAVING count(*) > 1),
numbered AS (SELECT n.number, CAST(p.place AS INTEGER) AS place, CAST(s.n AS INTEGER) AS n FROM pieces p JOIN numbers n ON n.piece = p.piece JOIN sizes s ON s.place = p.place),
shared AS (SELECT p.place AS a, q.place AS z, p.n AS m, q.n AS n, count(*) AS common FROM numbered p JOIN numbered q ON q.number = p.number AND p.place < q.place AND p.n >= 0.6 * q.n AND q.n >= 0.6 * p.n GROUP BY p.place, q.place, p.n, q.n),
alike AS (SELECT a, z FROM shared WHERE common >= 0.6 * (m + n - common)),
later AS (SELECT z, list(CAST(a AS BIGINT) ORDER BY a) AS earlier, row_number() OVER (ORDER BY z) AS k FROM alike GROUP BY z),
judged AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS refused, CAST(NULL AS BIGINT) AS z, CAST(NULL AS BIGINT) AS first
UNION ALL
SELECT l.k, CASE WHEN len(list_filter(l.earlier, lambda x: NOT list_contains(j.refused, x))) > 0 THEN list_append(j.refused, l.z) ELSE j.refused END, l.z, list_filter(l.earlier, lambda x: NOT list_contains(j.refused, x))[1]
FROM judged j JOIN later l ON l.k = j.k + 1)
SELECT least(p.doc_id, q.doc_id) AS doc_id_a, greatest(p.doc_id, q.doc_id) AS doc_id_b FROM judged j JOIN there p ON p.place = j.first JOIN there q ON q.place = j.z"""

SQL: dict[str, str] = {
    "p1_found": f"WITH {_FREQUENCIES} SELECT term_value, mark FROM m WHERE mark IS NOT NULL",
    "p1_frequencies": f"WITH {_FREQUENCIES} SELECT * FROM m",
    "p3_found": _REPEATS,
    "p6_found": _LEAKS,
}
