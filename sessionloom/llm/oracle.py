"""DuckDB counterparts of the queries that SQL can express; written against the contracts, on whole tables."""

from __future__ import annotations

from . import mixing, quality_rules, urls

#: Java's and DuckDB's regular expressions both know this class.
_BLANK = r"[ \t\n\x0B\f\r]+"
_WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '{_BLANK}'), lambda w: w <> '')"


def _pareto_mix(weights=mixing.DEFAULT_WEIGHTS, most=mixing.MAX_REPEATS, seed=1) -> str:
    listed = ", ".join(f"{w}::DOUBLE" for w in weights)
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM s),
w AS (SELECT *, [{listed}][(turn % {len(weights)} + 1)::INT] AS w, source_size::DOUBLE * {most} AS cap FROM r),
l AS (SELECT *, cap / w AS fill FROM w),
-- every level at which some set of sources is capped; the right one caps exactly those whose fill lies below it
c AS (SELECT a.turn, ((SELECT sum(source_size) FROM l)::DOUBLE - coalesce((SELECT sum(b.cap) FROM l b WHERE (b.fill, b.turn) < (a.fill, a.turn)), 0))
             / ((SELECT sum(w) FROM l) - coalesce((SELECT sum(b.w) FROM l b WHERE (b.fill, b.turn) < (a.fill, a.turn)), 0)) AS level, a.fill FROM l a),
v AS (SELECT max(level) AS level FROM c WHERE fill >= level),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * w) END AS target FROM l, v),
e AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN least({most}.0::DOUBLE, target / source_size) ELSE 0.0::DOUBLE END AS expected
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, floor(round(expected, 9))::BIGINT AS certain, greatest(0.0, expected - floor(round(expected, 9))) AS share,
        (('0x' || substr(sha256('{seed}|' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u FROM e),
g AS (SELECT *, CASE WHEN share > 1e-9 THEN (u / (1 - u)) / (share / (1 - share)) END AS k FROM f),
h AS (SELECT *, target - sum(size * certain) OVER (PARTITION BY source) AS wanted, row_number() OVER () AS rid FROM g),
-- the draw: each turn takes the order up to the first document that passes the target; what fits behind it goes on to the next turn
p AS (SELECT rid, doc_id, source, size, k, wanted, 0::BIGINT AS done,
        sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size, rid ROWS UNBOUNDED PRECEDING) <= wanted AS taken
      FROM h WHERE k IS NOT NULL AND size > 0 AND size <= wanted
      UNION ALL
      SELECT rid, doc_id, source, size, k, wanted, done,
        done + sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size, rid ROWS UNBOUNDED PRECEDING) <= wanted AS taken
      FROM (SELECT * REPLACE (done + coalesce(sum(size) FILTER (taken) OVER (PARTITION BY source), 0)::BIGINT AS done) FROM p)
      WHERE NOT taken AND size + done <= wanted),
x AS (SELECT DISTINCT rid FROM p WHERE taken),
j AS (SELECT source, any_value(wanted) - coalesce(sum(size) FILTER (rid IN (SELECT rid FROM x)), 0) AS short FROM h WHERE k IS NOT NULL GROUP BY source),
m AS (SELECT first(rid ORDER BY abs(short - size), doc_id, rid) AS rid FROM h JOIN j ON h.source IS NOT DISTINCT FROM j.source
      WHERE k IS NOT NULL AND rid NOT IN (SELECT rid FROM x) AND short > 0 AND abs(short - size) < short GROUP BY h.source)
SELECT doc_id, size, source_size, target,
       (certain + (rid IN (SELECT rid FROM x))::INT + (rid IN (SELECT rid FROM m))::INT) * size AS taken FROM h"""


PARETO_MIX = _pareto_mix()


def _rules_sql(rules=quality_rules.DEFAULT_RULES) -> str:
    parts = []
    for rule in rules:
        if rule.low is not None:
            parts.append(f"{rule.numerator} + {rule.slack}::DOUBLE >= {rule.denominator} * {rule.low}::DOUBLE")
        if rule.high is not None:
            parts.append(f"{rule.numerator} <= {rule.denominator} * {rule.high}::DOUBLE")
    return " AND ".join(parts)


def _quality_measures() -> str:
    """CTEs ending in ``judged``: doc_id, the counts, base_failed and kept."""
    stop = ", ".join(f"'{form}'" for group in quality_rules.STOP_WORDS.values() for w in group for form in sorted({w, w.capitalize()}))
    return f"""
p AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS lines FROM documents),
win AS (SELECT doc_id, pos, list_slice(w, pos, pos + 4) AS five FROM p, range(1, len(w) - 3) AS t(pos) WHERE len(w) >= 5),
twice AS (SELECT doc_id, pos FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, five) > 1),
cover AS (SELECT doc_id, count(DISTINCT pos + o) AS n FROM twice, range(0, 5) AS t(o) GROUP BY doc_id),
counts AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        len(list_filter(w, lambda x: x IN ({stop})))::BIGINT AS n_stop_words, coalesce(n, 0)::BIGINT AS n_repeat_words
      FROM p LEFT JOIN cover USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND {_rules_sql()} AS kept FROM counts)"""


QUALITY_RULES = f"""WITH {_quality_measures()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"""


def _url_vocabulary() -> str:
    def hit(term: str) -> str:
        return f"regexp_matches(u, '(^|[^\\p{{L}}]){term}($|[^\\p{{L}}])')"

    strict = " OR ".join(hit(t) for t in urls.STRICT_TERMS)
    soft = " + ".join(f"{hit(t)}::INT" for t in urls.SOFT_TERMS)
    ordered = sorted(urls.RULES, key=lambda r: (-len(r.name), r.name))
    fits = "\n".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}'" for r in ordered)
    by_rule = " ".join(f"WHEN '{r.name}' THEN '{r.verdict}'" for r in urls.RULES)
    return f"""
WITH a AS (SELECT page_id, lower(coalesce(url, '')) AS u,
        CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, u, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, CASE {fits} END AS rule FROM b)
SELECT page_id, host, path, rule, CASE rule {by_rule} ELSE CASE WHEN {strict} OR {soft} >= {urls.SOFT_NEEDED} THEN 'block' ELSE 'allow' END END AS verdict FROM c"""


URL_VOCABULARY = _url_vocabulary()

HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

#: The cheapest audit by a walk over the turns of every conversation at once: `st` holds the best (cost, audit) of each state after each turn.
DIALOGUE_REPAIR = r"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations),
crc AS (
  SELECT *, xor(list_reduce(list_transform(range(1, length(place) + 1), lambda i: ascii(substr(place, i, 1))::BIGINT),
                            lambda acc, b: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, xor(acc, b)),
                            4294967295::BIGINT), 4294967295) % 20 AS kind FROM src),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM crc WHERE kind <> 0),
faults AS (
  SELECT *, rtrim(text, E' \t\n\x0B\x0C\r') AS core, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos FROM hurt),
turns AS (
  SELECT *, left(role, 1) AS initial, core = '' AS blank, core <> '' AND again AS dup, core <> '' AND NOT again AND right(core, 1) NOT IN ('.', '!', '?') AS cut,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) NOT IN ('su', 'ua', 'au') AS odd FROM faults),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
         count(*) FILTER (cut) AS truncated, count(*) FILTER (odd) AS illegal, count(*) AS n FROM turns GROUP BY conv_id),
ins(s, s1, price, letters) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 2, 'I'), (1, 2, 2, 'I'), (2, 3, 2, 'I'), (3, 2, 2, 'I'),
                                      (0, 3, 4, 'II'), (1, 3, 4, 'II')),
st AS (
  SELECT conv_id, 0::BIGINT AS pos, 0 AS s, 0 AS c, '' AS a FROM facts
  UNION ALL
  SELECT conv_id, pos, s, min((c, a))[1], min((c, a))[2] FROM (
    SELECT st.conv_id, t.pos, CASE op WHEN 'D' THEN s1 WHEN 'R' THEN CASE WHEN s1 = 2 THEN 3 ELSE 2 END
                                      ELSE CASE WHEN initial = 's' AND s1 = 0 THEN 1 WHEN initial = 'u' AND s1 <> 2 THEN 2 WHEN initial = 'a' AND s1 = 2 THEN 3 END END AS s,
           st.c + price + CASE op WHEN 'D' THEN 3 WHEN 'R' THEN 2 + cut::INT ELSE cut::INT END AS c, st.a || letters || op AS a
    FROM st JOIN ins USING (s) JOIN turns t ON t.conv_id IS NOT DISTINCT FROM st.conv_id AND t.pos = st.pos + 1, (VALUES ('D'), ('R'), ('K')) o(op)
    WHERE op = 'D' OR NOT (blank OR dup)) WHERE s IS NOT NULL GROUP BY conv_id, pos, s),
done AS (
  SELECT st.conv_id, min((st.c + price, st.a || letters)) AS best FROM st JOIN facts f ON f.conv_id IS NOT DISTINCT FROM st.conv_id AND f.n = st.pos JOIN ins USING (s)
  WHERE s1 IN (0, 3) GROUP BY st.conv_id),
walk AS (
  SELECT conv_id, best[2] AS audit, 0 AS k, 0::BIGINT AS pos, 0 AS s, NULL::VARCHAR AS told FROM done
  UNION ALL
  SELECT conv_id, audit, k + 1, pos, CASE edit WHEN 'D' THEN s WHEN 'K' THEN CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE nxt END,
         CASE edit WHEN 'D' THEN told ELSE coalesce(told || chr(10), '') || CASE edit WHEN 'K' THEN role WHEN 'R' THEN nrole ELSE nrole END || ':' || CASE edit WHEN 'I' THEN '' ELSE text END END
  FROM (SELECT w.*, t.role, t.text, t.initial, CASE WHEN s = 2 THEN 3 ELSE 2 END AS nxt, CASE WHEN s = 2 THEN 'assistant' ELSE 'user' END AS nrole
        FROM (SELECT conv_id, audit, k, s, told, substr(audit, k + 1, 1) AS edit, pos + (substr(audit, k + 1, 1) <> 'I')::INT AS pos FROM walk WHERE k < length(audit)) w
             LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.pos = w.pos)),
ended AS (SELECT conv_id, audit, told FROM walk WHERE k = length(audit))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best[1], 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(told, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
     LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
