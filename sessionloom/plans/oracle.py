"""Independent SQL for the registered queries, written for a columnar SQL engine over the same parquet tables."""

from __future__ import annotations

from ..operators.sampling import MODES, EpisodePart
from .tables import BLOCK_SECONDS, EVENT_DATA, SLICE_DIM, SLICES

VECTORS = f"""
vec AS (
  SELECT vec_id AS session_id, label::BIGINT AS identity, embedding::DOUBLE[] AS z,
         'bw' || ([1,2,4,8])[(vec_id % 4 + 1)::INT] AS condition, (['L','T','H'])[(vec_id % 3 + 1)::INT] AS mode,
         list_transform(range({SLICES}), lambda i: list_transform(
             list_slice(embedding::DOUBLE[], i*{SLICE_DIM}+1, i*{SLICE_DIM}+{SLICE_DIM}),
             lambda x: x / greatest(sqrt(list_dot_product(
                 list_slice(embedding::DOUBLE[], i*{SLICE_DIM}+1, i*{SLICE_DIM}+{SLICE_DIM}),
                 list_slice(embedding::DOUBLE[], i*{SLICE_DIM}+1, i*{SLICE_DIM}+{SLICE_DIM}))), 1e-12))) AS v
  FROM embeddings)"""

EVENT_ROWS = f"""
ev AS (
  SELECT user_id * 4294967296 + block AS session_id, user_id AS identity, block, (us - block*{BLOCK_SECONDS * 1000000}) / 1e6 AS t,
         event_id AS seq, event_type, value
  FROM (SELECT *, epoch_us(ts) - 1704067200000000 AS us, (epoch_us(ts) - 1704067200000000) // {BLOCK_SECONDS * 1000000}
               AS block FROM events))"""

PACKETS = EVENT_ROWS + """,
pk AS (SELECT session_id, identity, block, seq, t, CASE WHEN event_type IN ('click','purchase','signup') THEN 1 ELSE 0 END
              AS direction, value AS length FROM ev)"""


def hash_number(text: str) -> str:
    return f"('0x' || substr(sha256({text}), 1, 12))::BIGINT"


def draws(count: str, take: str, key: str, prior: str = "[]::BIGINT[]") -> str:
    """Distinct draws without replacement, one list fold."""
    numbers = f"list_transform(range({take}), lambda i: [{hash_number(key + ' || chr(124) || i')}])"
    step = f"list_reduce(list_sort(acc), lambda x, y: CASE WHEN x >= y THEN x + 1 ELSE x END, e[1] % ({count} - len(acc)))"
    folded = f"list_reduce({numbers}, lambda acc, e: list_append(acc, {step}), {prior})"
    return f"list_slice({folded}, len({prior}) + 1, len({prior}) + {take})"


def members(parts: list[EpisodePart], seeds, source: str = "vec") -> str:
    """CTEs ending in mem(seed, scenario, partition, episode, role, identity, label, session_id)."""
    rows, first = [], {}
    quote = lambda v: "NULL" if v is None else f"'{v}'"
    for i, p in enumerate(parts):
        rows.append(f"({i}, '{p.scenario}', {p.partition}, {p.count}, {p.ways}, {p.shots}, {p.queries}, "
                    f"{quote(p.support_mode)}, {quote(p.query_mode)}, {quote(p.support_condition)}, "
                    f"{quote(p.query_condition)}, {p.balanced}, {first.get(p.scenario, 0)})")
        first[p.scenario] = first.get(p.scenario, 0) + p.count
    seed_rows = ", ".join(f"({s})" for s in seeds)
    per_mode = ", ".join(f"count(*) FILTER (pool = '{m}') AS n_{m}" for m in MODES)
    balanced = " UNION ALL ".join(
        f"SELECT *, '{role}' AS role, '{m}' AS pool, "
        f"[({draws('n_' + m, '2', f'''key || '|{m}' ''')})[{pos}]] AS places FROM drawn WHERE balanced"
        for m in MODES for role, pos in (("support", 1), ("query", 2)))
    return f"""
spec(part, scenario, partition, cnt, ways, shots, queries, sm, qm, sc, qc, balanced, first_episode) AS (
  VALUES {', '.join(rows)}),
seeds(seed) AS (VALUES {seed_rows}),
pooled AS (
  SELECT part, identity, session_id, CASE WHEN balanced THEN mode WHEN in_a THEN 'a' ELSE 'b' END AS pool,
         CASE WHEN NOT balanced AND in_a AND NOT in_b THEN '1' ELSE '0' END AS solo
  FROM (SELECT s.*, spec.part, spec.balanced, (sm IS NULL OR s.mode = sm) AND (sc IS NULL OR s.condition = sc) AS in_a,
               (qm IS NULL OR s.mode = qm) AND (qc IS NULL OR s.condition = qc) AS in_b FROM {source} s, spec)
  WHERE balanced OR in_a OR in_b),
pools AS (
  SELECT *, row_number() OVER (PARTITION BY part, identity, pool ORDER BY solo || sha256(session_id::VARCHAR)) - 1 AS place
  FROM pooled),
sizes AS (
  SELECT part, identity, count(*) FILTER (pool = 'a') AS n_a, count(*) FILTER (pool = 'b') AS n_b,
         count(*) FILTER (pool = 'a' AND solo = '0') AS n_ab, {per_mode} FROM pools GROUP BY ALL),
elig AS (
  SELECT sizes.*, shots, queries, balanced,
         row_number() OVER (PARTITION BY part ORDER BY sha256('identity|' || identity)) - 1 AS id_place,
         count(*) OVER (PARTITION BY part) AS n_ids
  FROM sizes JOIN spec USING (part)
  WHERE CASE WHEN balanced THEN least(n_L, n_T, n_H) >= 2
             ELSE n_a >= shots AND n_ab + n_b >= queries AND n_a + n_b >= shots + queries END),
eps AS (
  SELECT part, scenario, partition, ways, seed, first_episode + k AS episode,
         seed || '|' || scenario || '|' || partition || '|' || k AS ekey,
         (SELECT max(n_ids) FROM elig WHERE elig.part = spec.part) AS n_ids
  FROM spec, seeds, LATERAL (SELECT unnest(range(cnt)) AS k)),
chosen AS (SELECT *, {draws('n_ids', 'ways', "ekey || '|identity'")} AS ids FROM eps),
chosen_long AS (SELECT part, seed, scenario, partition, episode, ekey, unnest(ids) AS id_place,
                       unnest(range(len(ids))) AS label FROM chosen),
drawn AS (SELECT c.*, e.* EXCLUDE (part, id_place, n_ids), ekey || '|' || identity AS key
          FROM chosen_long c JOIN elig e USING (part, id_place)),
q_draw AS (SELECT *, least(n_b, queries) AS k_only,
                  {draws('n_b', 'least(n_b, queries)', "key || '|query'")} AS q_only,
                  {draws('n_ab', '(queries - least(n_b, queries))', "key || '|shared'")} AS q_shared
           FROM drawn WHERE NOT balanced),
s_draw AS (SELECT *, {draws('n_a', 'shots', "key || '|support'", 'q_shared')} AS s_places FROM q_draw),
picks AS (
  SELECT part, seed, scenario, partition, episode, label, identity, role, pool, places FROM (
    SELECT *, 'query' AS role, 'b' AS pool, q_only AS places FROM s_draw
    UNION ALL SELECT *, 'query', 'a', q_shared FROM s_draw
    UNION ALL SELECT *, 'support', 'a', s_places FROM s_draw)
  UNION ALL
  SELECT part, seed, scenario, partition, episode, label, identity, role, pool, places FROM ({balanced})),
mem AS (
  SELECT seed, scenario, partition, episode, role, identity, label, session_id
  FROM (SELECT * EXCLUDE (places), unnest(places) AS place FROM picks) JOIN pools USING (part, identity, pool, place))"""


PROTOTYPES = """
support_dims AS (
  SELECT seed, scenario, partition, episode, label, i, avg(z[i]) AS m
  FROM mem JOIN vec USING (session_id), LATERAL (SELECT unnest(range(1, len(z) + 1)) AS i)
  WHERE role = 'support' GROUP BY ALL),
protos AS (
  SELECT seed, scenario, partition, episode, label, list(m ORDER BY i) AS p, sqrt(sum(m*m)) AS n FROM support_dims GROUP BY ALL),
cand AS (
  SELECT q.seed, q.scenario, q.partition, q.episode, q.session_id AS query_id, p.label,
         list_dot_product(v.z, p.p) / greatest(p.n, 1e-12) AS candidate
  FROM mem q JOIN vec v USING (session_id)
       JOIN protos p ON (q.seed, q.scenario, q.partition, q.episode) = (p.seed, p.scenario, p.partition, p.episode)
  WHERE q.role = 'query')"""

PREDICT = """
best AS (
  SELECT *, row_number() OVER (PARTITION BY seed, scenario, partition, episode, query_id ORDER BY candidate DESC, label) AS rn
  FROM cand),
pred AS (SELECT seed, scenario, partition, episode, query_id, label AS prediction, candidate AS confidence FROM best WHERE rn = 1),
acc AS (
  SELECT p.seed, p.scenario, p.partition, p.episode, avg((p.prediction = m.label)::INT) AS accuracy, count(*) AS queries
  FROM pred p JOIN mem m ON (p.seed, p.scenario, p.partition, p.episode, p.query_id, 'query')
                          = (m.seed, m.scenario, m.partition, m.episode, m.session_id, m.role) GROUP BY ALL)"""


def rounded(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name}"


# --- trace features ----------------------------------------------------------------------------------------------

def split_ctes(seed: int, source: str = "sess") -> str:
    """split(identity, split) by a seeded order of the identities of ``source``."""
    return f"""
ids AS (SELECT DISTINCT identity FROM {source}),
ranked_ids AS (SELECT identity, row_number() OVER (ORDER BY sha256('{seed}|' || identity)) - 1 AS rk, count(*) OVER () AS n FROM ids),
split AS (SELECT identity, CASE WHEN rk < greatest(1, n // 2) THEN 'train'
                                WHEN rk < greatest(1, n // 2) + n // 5 THEN 'validation' ELSE 'test' END AS split
          FROM ranked_ids)"""


SESSIONS = """
sess AS (SELECT DISTINCT session_id, identity, block, 'bw' || block AS condition, (['L','T','H'])[(block % 3 + 1)::INT] AS mode FROM ev)"""


def grid_ctes(until: float | None = None, start: float = 0.0, tag: str = "") -> str:
    """dense{tag}(session_id, scale, bin, c0..c4, mask) over all sessions."""
    until = EVENT_DATA.window if until is None else until
    scales = ", ".join(f"({s}, {EVENT_DATA.bins(s)})" for s in EVENT_DATA.scales)
    return f"""
sc{tag}(scale, nbins) AS (VALUES {scales}),
sums{tag} AS (
  SELECT session_id, scale, floor((t - {start}) * 1000 / scale + 1e-9)::BIGINT AS bin,
         coalesce(sum(length) FILTER (direction = 0), 0) AS c0, coalesce(sum(length) FILTER (direction = 1), 0) AS c1,
         count(*) FILTER (direction = 0)::DOUBLE AS c2, count(*) FILTER (direction = 1)::DOUBLE AS c3
  FROM pk, sc{tag} WHERE t - {start} >= 0 AND t - {start} < {until} GROUP BY ALL),
dense{tag} AS (
  SELECT session_id, scale, g.bin, coalesce(c0, 0) AS c0, coalesce(c1, 0) AS c1, coalesce(c2, 0) AS c2, coalesce(c3, 0) AS c3,
         CASE WHEN coalesce(c2, 0) > 0 THEN c0 / c2 ELSE 0 END AS c4,
         CASE WHEN (g.bin + 0.5) * scale / 1000 <= {until} THEN 1 ELSE 0 END AS mask
  FROM (SELECT session_id, scale, unnest(range(nbins)) AS bin FROM (SELECT DISTINCT session_id FROM pk), sc{tag}) g
       LEFT JOIN sums{tag} USING (session_id, scale, bin))"""


STATS = """
fit AS (SELECT dense.* FROM dense JOIN sess USING (session_id) JOIN split USING (identity)
        WHERE split = 'train' AND condition <> 'bw4' AND mask > 0),
stats AS (
  SELECT scale, channel, avg(x) AS mean, CASE WHEN stddev_pop(x) < 1e-6 THEN 1 ELSE stddev_pop(x) END AS std
  FROM (SELECT scale, unnest(range(5)) AS channel, unnest([ln(1+c0), ln(1+c1), ln(1+c2), ln(1+c3), ln(1+c4)]) AS x FROM fit)
  GROUP BY ALL)"""


def norm_ctes(tag: str = "") -> str:
    """norm{tag}(session_id, scale, bin, channel, x, mask), long over channels."""
    return f"""
norm{tag} AS (
  SELECT session_id, scale, bin, channel, CASE WHEN mask > 0 THEN (x - mean) / std ELSE 0 END AS x, mask
  FROM (SELECT session_id, scale, bin, mask, unnest(range(5)) AS channel,
               unnest([ln(1+c0), ln(1+c1), ln(1+c2), ln(1+c3), ln(1+c4)]) AS x FROM dense{tag})
       JOIN stats USING (scale, channel))"""


def token_ctes(tag: str = "") -> str:
    """tok{tag}(session_id, scale, token, channel, x, r) by adaptive mean pooling."""
    m = EVENT_DATA.tokens
    return f"""
tok{tag} AS (
  SELECT session_id, scale, token, channel, avg(x) AS x, avg(mask) AS r
  FROM norm{tag} JOIN (SELECT scale, nbins, unnest(range({m})) AS token FROM sc{tag}) k USING (scale)
  WHERE bin >= token * nbins // {m} AND bin < ((token + 1) * nbins + {m} - 1) // {m} GROUP BY ALL)"""


def print_ctes(tag: str = "") -> str:
    """fp{tag}(session_id, z, v, r): uniform fusion, token normalisation, pooled global vector."""
    return f"""
fw{tag} AS (SELECT *, r / (sum(r) OVER (PARTITION BY session_id, token, channel) + 1e-8) AS w FROM tok{tag}),
fu{tag} AS (SELECT session_id, token, channel, sum(w * x) AS u, max(r) AS r FROM fw{tag} GROUP BY ALL),
fz{tag} AS (SELECT session_id, channel, coalesce(sum(u * r) / (sum(r) + 1e-8), 0) AS mean_u,
                   coalesce(max(u) FILTER (r > 0), 0) AS max_u FROM fu{tag} GROUP BY ALL),
fzz{tag} AS (SELECT session_id, list(x ORDER BY i) AS raw FROM (
  SELECT session_id, channel AS i, mean_u AS x FROM fz{tag} UNION ALL SELECT session_id, channel + 5, max_u FROM fz{tag}) GROUP BY ALL),
fv{tag} AS (SELECT session_id, token, list(u ORDER BY channel) AS raw, max(r) AS r FROM fu{tag} GROUP BY ALL),
fvv{tag} AS (SELECT session_id, list(list_transform(raw, lambda x: x / greatest(sqrt(list_dot_product(raw, raw)), 1e-12)) ORDER BY token) AS v,
                    list(r ORDER BY token) AS r FROM fv{tag} GROUP BY ALL),
fp{tag} AS (SELECT session_id, list_transform(raw, lambda x: x / greatest(sqrt(list_dot_product(raw, raw)), 1e-12)) AS z, v, r
            FROM fzz{tag} JOIN fvv{tag} USING (session_id))"""


# --- alignment of pairs, unrolled per anti-diagonal ----------------------------------------------------------------

def pairs_cte(prints: str = "vec", r: str = "NULL", query_prints: str | None = None) -> str:
    """pr: query x support rows of each episode with their vectors."""
    return f"""
pr AS (
  SELECT q.seed, q.scenario, q.partition, q.episode, q.session_id AS query_id, s.session_id AS support_id, s.label,
         list_dot_product(a.z, b.z) AS g, a.v AS qv, b.v AS sv, {r.format('a')} AS qr, {r.format('b')} AS sr
  FROM mem q JOIN mem s ON (q.seed, q.scenario, q.partition, q.episode) = (s.seed, s.scenario, s.partition, s.episode)
       JOIN {query_prints or prints} a ON a.session_id = q.session_id JOIN {prints} b ON b.session_id = s.session_id
  WHERE q.role = 'query' AND s.role = 'support')"""


def _cells(m: int, n: int, d: int):
    return [(i, d - i) for i in range(max(0, d - n + 1), min(m - 1, d) + 1)]


def pma_ctes(m: int, n: int, delta=0.2, gap=0.1, gamma=0.1, lam=0.5, holes: bool = False, tag: str = "pma",
             source: str = "pr") -> str:
    """{tag}(pr columns, local, overlap, score): the recurrence in the exponential domain and its adjoint."""
    sims = ", ".join(f"list_dot_product(qv[{i+1}], sv[{j+1}]) AS s_{i}_{j}" for i in range(m) for j in range(n))
    ok = lambda i, j: f" * (qr[{i+1}] > 0 AND sr[{j+1}] > 0)::INT" if holes else ""
    expo = ", ".join(f"exp((s_{i}_{j} - {delta}) / {gamma}){ok(i, j)} AS x_{i}_{j}" for i in range(m) for j in range(n))
    ctes = [f"{tag}_s AS (SELECT *, {sims} FROM {source})",
            f"{tag}_f AS (SELECT *, {expo}, exp(-{gap} / {gamma}) AS e FROM {tag}_s)"]
    previous = f"{tag}_f"
    g = lambda i, j: f"g_{i}_{j}" if i >= 0 and j >= 0 else "1.0"
    for d in range(m + n - 1):
        cols = ", ".join(f"1 + {g(i-1, j-1)} * x_{i}_{j} + e * ({g(i-1, j)} + {g(i, j-1)}) AS g_{i}_{j}" for i, j in _cells(m, n, d))
        ctes.append(f"{tag}_f{d} AS (SELECT *, {cols} FROM {previous})")
        previous = f"{tag}_f{d}"
    for d in reversed(range(m + n - 1)):
        cols = []
        for i, j in _cells(m, n, d):
            terms = ["1.0"]
            if i + 1 < m:
                terms.append(f"e * b_{i+1}_{j}")
            if j + 1 < n:
                terms.append(f"e * b_{i}_{j+1}")
            if i + 1 < m and j + 1 < n:
                terms.append(f"x_{i+1}_{j+1} * b_{i+1}_{j+1}")
            cols.append(f"{' + '.join(terms)} AS b_{i}_{j}")
        ctes.append(f"{tag}_b{d} AS (SELECT *, {', '.join(cols)} FROM {previous})")
        previous = f"{tag}_b{d}"
    total = " + ".join(f"g_{i}_{j}" for i in range(m) for j in range(n))
    mass = {(i, j): f"b_{i}_{j} * {g(i-1, j-1)} * x_{i}_{j}" for i in range(m) for j in range(n)}
    least = (lambda i, j: f"least(qr[{i+1}], sr[{j+1}])") if holes else (lambda i, j: "1.0")
    sums = (f"({' + '.join(mass.values())}) / tot AS mm, ({' + '.join(f'{x} * s_{i}_{j}' for (i, j), x in mass.items())}) / tot AS ms, "
            f"({' + '.join(f'{x} * {least(i, j)}' for (i, j), x in mass.items())}) / tot AS mo")
    floor = "least(list_sum(qr), list_sum(sr))" if holes else f"{min(m, n)}"
    ctes.append(f"{tag}_t AS (SELECT *, {total} AS tot FROM {previous})")
    ctes.append(f"{tag}_m AS (SELECT *, {sums} FROM {tag}_t)")
    ctes.append(f"{tag} AS MATERIALIZED (SELECT * EXCLUDE (mm, ms, mo), ms / (mm + 1e-8) AS local, mo / ({floor} + 1e-8) AS overlap, "
                f"{lam} * g + (1 - {lam}) * ms / (mm + 1e-8) AS score FROM {tag}_m)")
    return ",\n".join(ctes)


def soft_dtw_ctes(m: int, n: int, gamma: str = "0.1", lam=0.5, source: str = "pr", tag: str = "sdtw") -> str:
    """{tag}(pr columns, local, score) on token lists already free of dropped tokens; scaled per anti-diagonal."""
    sims = ", ".join(f"list_dot_product(qv[{i+1}], sv[{j+1}]) AS s_{i}_{j}" for i in range(m) for j in range(n))
    expo = ", ".join(f"exp((s_{i}_{j} - 1) / {gamma}) AS x_{i}_{j}" for i in range(m) for j in range(n))
    ctes = [f"{tag}_s AS (SELECT *, {sims} FROM {source})",
            f"{tag}_f AS (SELECT *, {expo}, exp(0.5 / {gamma}) AS c FROM {tag}_s)"]
    previous = f"{tag}_f"
    for d in range(m + n - 1):
        cols = []
        for i, j in _cells(m, n, d):
            terms = ["1.0"] if (i, j) == (0, 0) else []
            if i and j:
                terms.append(f"c * c * g_{i-1}_{j-1}")
            if i:
                terms.append(f"c * g_{i-1}_{j}")
            if j:
                terms.append(f"c * g_{i}_{j-1}")
            cols.append(f"x_{i}_{j} * ({' + '.join(terms)}) AS g_{i}_{j}")
        ctes.append(f"{tag}_f{d} AS (SELECT *, {', '.join(cols)} FROM {previous})")
        previous = f"{tag}_f{d}"
    for d in reversed(range(m + n - 1)):
        cols = []
        for i, j in _cells(m, n, d):
            terms = ["1.0"] if (i, j) == (m - 1, n - 1) else []
            if i + 1 < m and j + 1 < n:
                terms.append(f"c * c * x_{i+1}_{j+1} * b_{i+1}_{j+1}")
            if i + 1 < m:
                terms.append(f"c * x_{i+1}_{j} * b_{i+1}_{j}")
            if j + 1 < n:
                terms.append(f"c * x_{i}_{j+1} * b_{i}_{j+1}")
            cols.append(f"{' + '.join(terms)} AS b_{i}_{j}")
        ctes.append(f"{tag}_b{d} AS (SELECT *, {', '.join(cols)} FROM {previous})")
        previous = f"{tag}_b{d}"
    occ = {(i, j): f"g_{i}_{j} / g_{m-1}_{n-1} * b_{i}_{j}" for i in range(m) for j in range(n)}
    ctes.append(f"{tag}_m AS (SELECT *, {' + '.join(occ.values())} AS mm, "
                f"{' + '.join(f'{x} * s_{i}_{j}' for (i, j), x in occ.items())} AS ms FROM {previous})")
    ctes.append(f"{tag} AS MATERIALIZED (SELECT *, ms / (mm + 1e-8) AS local, {lam} * g + (1 - {lam}) * ms / (mm + 1e-8) AS score FROM {tag}_m)")
    return ",\n".join(ctes)


PAIR_KEYS = "seed::BIGINT AS seed, scenario, partition, episode::BIGINT AS episode, query_id"


def class_scores(rule: str, source: str = "pma") -> str:
    """cand from pair scores by one of the pair rules (tau_c .2, tau_s .1)."""
    keys = "seed, scenario, partition, episode, query_id, label"
    if rule == "mean":
        return f"cand AS (SELECT {keys}, avg(score) AS candidate FROM {source} GROUP BY ALL)"
    if rule == "support_max":
        return f"cand AS (SELECT {keys}, max(score) AS candidate FROM {source} GROUP BY ALL)"
    c = {"uniform_lse": "0", "similarity": "local", "overlap": "overlap", "compatibility": "local + overlap"}[rule]
    return f"""
cw AS (SELECT *, exp(({c}) / 0.2) / sum(exp(({c}) / 0.2)) OVER (PARTITION BY {keys}) AS omega FROM {source}),
cand AS (SELECT {keys}, 0.1 * ln(sum(omega * exp(score / 0.1))) AS candidate FROM cw GROUP BY ALL)"""


# --- players -------------------------------------------------------------------------------------------------------

from .tables import FRONTIER_GAP, FRONTIER_TARGETS, INITIAL_GAP, STEP  # noqa: E402

SERIES = """
pl AS (SELECT session_id, t, seq, CASE WHEN event_type = 'view' THEN value END AS quality,
              CASE WHEN event_type = 'purchase' THEN value / 100 END AS buffer,
              CASE WHEN event_type = 'error' THEN 1.0::DOUBLE WHEN event_type = 'view' THEN 0.0 END AS stalled,
              CASE WHEN event_type = 'signup' THEN 1.0::DOUBLE WHEN event_type = 'click' THEN 0.0 END AS state FROM ev)"""


def samples_cte(column: str, initial: str, tag: str) -> str:
    """{tag}(session_id, k, t, x): for each target the latest observation, by an as-of join."""
    return f"""
{tag}_o AS (SELECT session_id, t, seq, {column} AS x FROM pl WHERE {column} IS NOT NULL),
{tag}_u AS (SELECT session_id, t, arg_max(x, seq) AS x FROM {tag}_o GROUP BY ALL),
{tag}_first AS (SELECT session_id, arg_min(x, (t, seq)) AS x0, min(t) AS t0 FROM {tag}_o GROUP BY ALL),
{tag}_k AS (SELECT session_id, unnest(range(30)) AS k, x0, t0 FROM {tag}_first),
{tag} AS (SELECT k.session_id, k.k, (k.k + 0.5) * {STEP} AS t, coalesce(o.x, {initial}) AS x, t0
          FROM {tag}_k k ASOF LEFT JOIN {tag}_u o ON k.session_id = o.session_id AND (k.k + 0.5) * {STEP} >= o.t)"""


MODES_A = f"""
good AS (SELECT session_id, k, x FROM smp WHERE t0 - {STEP / 2} <= {INITIAL_GAP}),
lq AS (SELECT session_id, k, ln(1 + x) AS q, lag(x) OVER (PARTITION BY session_id ORDER BY k) AS before, x FROM good),
ma AS (SELECT session_id, avg(q) AS f30, stddev_pop(q) AS f31, max(q) FILTER (k = 0) AS f32, max(q) FILTER (k = 29) AS f33,
              avg((x <> before)::INT) AS f34, quantile_cont(q, 0.25) AS qq, stddev_pop(q) FILTER (k >= 25) AS f36 FROM lq GROUP BY ALL),
mb AS (SELECT lq.session_id, avg((q <= qq)::INT) AS f35 FROM lq JOIN ma USING (session_id) GROUP BY ALL)"""

MODES_B = """
j AS (SELECT session_id, k, sq.x AS q, sb.x AS b, ss.x AS s, sp.x AS p, lag(sq.x) OVER (PARTITION BY session_id ORDER BY k) AS before
      FROM sq JOIN sb USING (session_id, k) JOIN ss USING (session_id, k) JOIN sp USING (session_id, k)),
feat AS (SELECT session_id, [avg(s), avg((b < 1)::INT), median(b), avg(b) FILTER (k >= 25), avg(p), avg((q <= 360)::INT), avg(ln(1 + q)),
                             avg((q <> before)::INT)] AS f FROM j GROUP BY ALL)"""


def kmeans_ctes(ks, seed: int, width: int, held_out: str, restarts: int = 20) -> str:
    """std(session_id, x, train) and best(k, centres) from feat(session_id, f), sess and split: seeded draws, rounds and restarts."""
    most = max(ks)
    moments = ", ".join(f"avg(f[{i}]) AS m{i}, CASE WHEN stddev_pop(f[{i}]) < 1e-6 THEN 1 ELSE stddev_pop(f[{i}]) END AS s{i}" for i in range(1, width + 1))
    scaled = ", ".join(f"(f[{i}] - m{i}) / s{i}" for i in range(1, width + 1))
    means = ", ".join(f"avg(x[{i}])" for i in range(1, width + 1))
    spread = " + ".join(f"var_pop(x[{i}])" for i in range(1, width + 1))
    luck = hash_number(f"'{seed}|' || r || '|' || step || '|' || session_id") + " / 281474976710656.0"
    return f"""
tr AS (SELECT session_id FROM sess JOIN split USING (identity) WHERE split = 'train' AND condition <> '{held_out}'),
mom AS (SELECT {moments} FROM feat JOIN tr USING (session_id)),
std AS (SELECT session_id, [{scaled}] AS x, session_id IN (SELECT session_id FROM tr) AS train FROM feat, mom),
pts AS (SELECT session_id, x FROM std WHERE train),
lim AS (SELECT 1e-4 * ({spread}) / {width} AS least FROM pts),
chain AS (
  SELECT r, 0 AS step, [arg_min(x, (-ln(u), session_id))] AS centres
  FROM (SELECT r, session_id, x, {luck.replace("step", "0")} AS u FROM pts, range({restarts}) t(r)) GROUP BY r
  UNION ALL
  SELECT r, step, list_append(centres, arg_min(x, (CASE WHEN d > 0 THEN -ln(u) / d ELSE 'inf'::DOUBLE END, session_id)))
  FROM (SELECT r, step, centres, session_id, x, {luck} AS u, pow(list_min(list_transform(centres, lambda m: list_distance(m, x))), 2) AS d
        FROM (SELECT r, step + 1 AS step, centres FROM chain WHERE step < {most - 1}), pts) GROUP BY r, step, centres),
lloyd AS (
  SELECT k, r, 0 AS it, centres[1:k] AS centres, 'inf'::DOUBLE AS shift FROM chain, (VALUES {", ".join(f"({k})" for k in ks)}) t(k) WHERE step = {most - 1}
  UNION ALL
  (WITH live AS (SELECT lloyd.* FROM lloyd, lim WHERE shift > least AND it < 300),
   asg AS (SELECT k, r, x, list_position(d, list_min(d)) AS c
           FROM (SELECT k, r, x, list_transform(centres, lambda m: list_distance(m, x)) AS d FROM live, pts)),
   mean AS (SELECT k, r, c, [{means}] AS m FROM asg GROUP BY k, r, c),
   fresh AS (SELECT k, r, it, any_value(centres) AS old, list(coalesce(m, centres[c]) ORDER BY c) AS centres
             FROM (SELECT *, unnest(range(1, k + 1)) AS c FROM live) LEFT JOIN mean USING (k, r, c) GROUP BY k, r, it)
   SELECT k, r, it + 1, centres, list_sum(list_transform(range(1, k + 1), lambda i: pow(list_distance(centres[i], old[i]), 2))) FROM fresh)),
ended AS (SELECT k, r, arg_max(centres, it) AS centres FROM lloyd GROUP BY k, r),
priced AS (SELECT k, r, round(sum(pow(list_min(list_transform(centres, lambda m: list_distance(m, x))), 2)), 6) AS cost FROM ended, pts GROUP BY k, r),
best AS (SELECT k, arg_min(centres, (cost, r)) AS centres FROM ended JOIN priced USING (k, r) GROUP BY k)"""


FRONTIER = f"""
st AS (SELECT session_id, t, seq, CASE WHEN event_type = 'view' THEN 'on' WHEN event_type = 'error' THEN 'off'
              WHEN event_type = 'signup' AND value < 3 THEN 'seek' END AS name FROM ev WHERE event_type IN ('view', 'error')
              OR (event_type = 'signup' AND value < 3)),
rt AS (SELECT session_id, t, seq, (seq % 4)::DOUBLE AS rate FROM ev WHERE event_type = 'click'),
bf AS (SELECT session_id, t, seq, value AS buf FROM ev WHERE event_type = 'purchase'),
fs AS (SELECT s.session_id, s.block, (SELECT count(*) FROM rt WHERE rt.session_id = s.session_id) AS nr,
              (SELECT count(*) FROM bf WHERE bf.session_id = s.session_id) AS nb,
              (SELECT count(*) FROM st WHERE st.session_id = s.session_id) AS ns FROM sess s),
fgood AS (SELECT * FROM fs WHERE nr >= 2 AND nb >= 2 AND ns >= 1),
tg AS (SELECT session_id, block, unnest(range({len(FRONTIER_TARGETS)})) AS k, unnest({FRONTIER_TARGETS}::DOUBLE[]) AS t FROM fgood),
line AS (
  SELECT session_id, t, 0 AS kind, seq, rate, NULL AS name FROM rt UNION ALL SELECT session_id, t, 1, seq, NULL, name FROM st
  UNION ALL SELECT session_id, t, 3, k, NULL, NULL FROM tg),
steps AS (
  SELECT *, coalesce(t - lag(t) OVER w, 0) * coalesce(last_value(rate IGNORE NULLS) OVER p, 1)
            * coalesce(last_value(CASE name WHEN 'on' THEN 1.0 WHEN 'off' THEN 0.0 END IGNORE NULLS) OVER p, 0) AS step
  FROM line WHERE t <= {FRONTIER_TARGETS[-1]} AND session_id IN (SELECT session_id FROM fgood)
  WINDOW w AS (PARTITION BY session_id ORDER BY t, kind, seq),
         p AS (PARTITION BY session_id ORDER BY t, kind, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
prog AS (SELECT *, sum(step) OVER (PARTITION BY session_id ORDER BY t, kind, seq ROWS UNBOUNDED PRECEDING) AS progress FROM steps),
seeks AS (SELECT session_id, count(*) AS n, arg_min(progress, (t, kind, seq)) AS at_progress, min(t) AS at_t FROM prog WHERE name = 'seek' GROUP BY ALL),
fr AS (
  SELECT tg.session_id, tg.k, tg.t, tg.block * 60 + p.progress - CASE WHEN at_t <= tg.t THEN at_progress ELSE 0 END + b.buf AS raw,
         coalesce(n, 0) AS n_seeks, at_progress, b.t AS bt, b.buf,
         (SELECT count(*) FROM rt WHERE rt.session_id = tg.session_id AND rt.t <= tg.t) AS rates_seen
  FROM tg JOIN prog p ON p.session_id = tg.session_id AND p.kind = 3 AND p.seq = tg.k
       LEFT JOIN seeks ON seeks.session_id = tg.session_id
       ASOF LEFT JOIN bf b ON tg.session_id = b.session_id AND tg.t >= b.t),
chk AS (SELECT *, raw - lag(raw) OVER (PARTITION BY session_id ORDER BY k) AS move FROM fr),
verdict AS (
  SELECT session_id, CASE WHEN max(n_seeks) > 1 OR max(at_progress) > 2 THEN 'unannotated_seek'
      WHEN bool_or(bt IS NULL OR t - bt > {FRONTIER_GAP} OR buf < 0) THEN 'buffer_gap'
      WHEN bool_or(rates_seen = 0) THEN 'no_rate_before_window' WHEN min(move) < -2 THEN 'nonmonotone_frontier' END AS reason
  FROM chk GROUP BY ALL)"""


# --- reports -------------------------------------------------------------------------------------------------------

REPORT_ACC = """
rep AS (SELECT seed, scenario, count(*) AS episodes, avg(accuracy) AS accuracy, coalesce(stddev_samp(accuracy), 0) AS episode_std,
               coalesce(stddev_samp(accuracy), 0) / sqrt(count(*)) AS episode_sem FROM acc GROUP BY ALL)"""


def closed_set_ctes(fractions) -> str:
    """acc_all(fraction, episode, accuracy) of session recognition with truncated queries and full supports."""
    out = [grid_ctes(), STATS, norm_ctes(), token_ctes(), print_ctes()]
    union = []
    for i, f in enumerate(fractions):
        tag = f"_t{i}"
        out += [grid_ctes(EVENT_DATA.window * f, 0.0, tag), norm_ctes(tag), token_ctes(tag), print_ctes(tag),
                pairs_cte("fp", r="{0}.r", query_prints=f"fp{tag}").replace("pr AS", f"pr{tag} AS", 1),
                pma_ctes(8, 8, holes=True, tag=f"pma{tag}", source=f"pr{tag}"),
                f"""cw{tag} AS (SELECT *, exp((local + overlap) / 0.2) / sum(exp((local + overlap) / 0.2)) OVER (PARTITION BY seed, scenario, partition, episode, query_id, label) AS omega FROM pma{tag}),
cand{tag} AS (SELECT seed, scenario, partition, episode, query_id, label, 0.1 * ln(sum(omega * exp(score / 0.1))) AS candidate FROM cw{tag} GROUP BY ALL)"""]
        union.append(f"SELECT {f} AS fraction, * FROM cand{tag}")
    out.append(f"""allc AS ({' UNION ALL '.join(union)}),
top AS (SELECT *, row_number() OVER (PARTITION BY fraction, seed, scenario, partition, episode, query_id ORDER BY candidate DESC, label) AS rn FROM allc),
acc_all AS (SELECT fraction, t.seed, t.scenario, t.partition, t.episode, avg((t.label = m.label)::INT) AS accuracy FROM top t JOIN mem m
  ON (t.seed, t.scenario, t.partition, t.episode, t.query_id, 'query') = (m.seed, m.scenario, m.partition, m.episode, m.session_id, m.role)
  WHERE rn = 1 GROUP BY ALL)""")
    return ",\n".join(out)


# --- views -----------------------------------------------------------------------------------------------------------

def view_ctes(seed: int, window: float = 60.0, low: float = 0.3, warp: float = 0.3) -> str:
    """pr with two visible, warped views of every fingerprint, long over tokens and packed again."""
    u = lambda name: f"(({hash_number(f'''{chr(39)}{seed}|{chr(39)} || session_id || {chr(39)}|{name}|0{chr(39)}''')} + 0.5) / {float(1 << 48)!r}::DOUBLE)"
    return f"""
vl AS (SELECT *, {low} + {1 - low} * {u('length0')} AS la, {low} + {1 - low} * {u('length1')} AS lb FROM vec),
vs AS (SELECT *, {u('start0')} * (1 - la) AS sa FROM vl),
vw AS (SELECT session_id, v, {{'la': la, 'lb': lb, 'sa': sa,
         'sb': greatest(0, sa - lb) + {u('start1')} * (least(1 - lb, sa + la) - greatest(0, sa - lb))}} AS d,
         {2 * warp} * {u('warp0')} - {warp} AS e0, {2 * warp} * {u('warp1')} - {warp} AS e1 FROM vs),
sd AS (SELECT session_id, 0 AS side, v, d.sa AS s, d.la AS l, e0 AS eta FROM vw UNION ALL SELECT session_id, 1, v, d.sb, d.lb, e1 FROM vw),
""" + warp_ctes(window) + f""",
pr AS (SELECT a.session_id, a.v AS qv, a.r AS qr, a.c AS ca, b.v AS sv, b.r AS sr, b.c AS cb, 0.0 AS g,
              greatest(d.sa, d.sb) AS c0, least(d.sa + d.la, d.sb + d.lb) AS c1,
              (least(d.sa + d.la, d.sb + d.lb) - greatest(d.sa, d.sb)) / least(d.la, d.lb) AS reference
       FROM packed a JOIN packed b ON a.session_id = b.session_id AND a.side = 0 AND b.side = 1 JOIN vw ON vw.session_id = a.session_id)"""


def warp_ctes(window: float) -> str:
    """packed(session_id, side, v, r, c) from sd(session_id, side, v, s, l, eta)."""
    w = float(window)
    return f"""
tk AS (SELECT session_id, side, v, s, l, j, CASE WHEN t <= {w} / 2 THEN t * m / ({w} / 2) ELSE m + (t - {w} / 2) * ({w} - m) / ({w} / 2) END AS c
       FROM (SELECT *, (j + 0.5) * {w} / 8 AS t, {w} * (0.5 + eta) AS m FROM (SELECT *, unnest(range(8)) AS j FROM sd))),
tp AS (SELECT *, floor(p)::INT AS lo, least(floor(p)::INT + 1, 7) AS hi, p - floor(p) AS f FROM (SELECT *, greatest(0, least(7, c * 8 / {w} - 0.5)) AS p FROM tk)),
tr AS (SELECT *, ((lo + 0.5) / 8 >= s AND (lo + 0.5) / 8 < s + l)::INT AS rl, ((hi + 0.5) / 8 >= s AND (hi + 0.5) / 8 < s + l)::INT AS rh FROM tp),
tv AS (SELECT session_id, side, j, c, rl * (1 - f) + rh * f AS r, list_transform(range(1, 9), lambda k: v[lo + 1][k] * rl * (1 - f) + v[hi + 1][k] * rh * f) AS raw FROM tr),
packed AS (SELECT session_id, side, list(list_transform(raw, lambda x: CASE WHEN r > 0 THEN x / greatest(sqrt(list_dot_product(raw, raw)), 1e-12) ELSE 0 END) ORDER BY j) AS v,
                  list(r ORDER BY j) AS r, list(c ORDER BY j) AS c FROM tv GROUP BY ALL)"""


def _mass(i: int, j: int) -> str:
    return f"(b_{i}_{j} * {f'g_{i-1}_{j-1}' if i and j else '1.0'} * x_{i}_{j} / tot)"


def correspondence_ctes(near: float, window: float = 60.0) -> str:
    """er(session_id, e, overlap, reference): one row per valid token of every view pair."""
    items = []
    for j in range(8):
        column = " + ".join(_mass(i, j) for i in range(8))
        mapped = " + ".join(f"{_mass(i, j)} * ca[{i+1}]" for i in range(8))
        items.append(f"{{'e': abs(({mapped}) / ({column} + 1e-8) - cb[{j+1}]), 'ok': cb[{j+1}] >= c0 * {window} AND cb[{j+1}] <= c1 * {window} AND sr[{j+1}] > 0 AND ({column}) > 0}}")
    return f"""
er0 AS MATERIALIZED (SELECT session_id, overlap, reference, [{', '.join(items)}] AS items FROM pma),
er AS (SELECT session_id, overlap, reference, it.e AS e FROM (SELECT session_id, overlap, reference, unnest(items) AS it FROM er0) WHERE it.ok)"""


def entropy_ctes(sigma: float = 2.0, window: float = 60.0) -> str:
    """en(session_id, loss, ok): column losses of the mass against the Gaussian target of a warped copy."""
    items = []
    for j in range(8):
        column = " + ".join(_mass(i, j) for i in range(8))
        weight = lambda i: f"(qr[{i+1}] * sr[{j+1}] * exp(-(power(({i} + 0.5) * {window} / 8 - cb[{j+1}], 2)) / {2 * sigma * sigma}))"
        total = " + ".join(weight(i) for i in range(8))
        loss = " + ".join(f"{weight(i)} / greatest({total}, 1e-8) * ln({_mass(i, j)} / ({column} + 1e-8) + 1e-8)" for i in range(8))
        items.append(f"{{'l': -({loss}), 'ok': sr[{j+1}] > 0 AND ({total}) > 0}}")
    return f"""
en0 AS MATERIALIZED (SELECT session_id, [{', '.join(items)}] AS items FROM pma),
en AS (SELECT session_id, it.l AS l FROM (SELECT session_id, unnest(items) AS it FROM en0) WHERE it.ok)"""


# --- logs ----------------------------------------------------------------------------------------------------------

LOG_ROWS = EVENT_ROWS + """,
lg AS (SELECT *, round(t * 1000000)::BIGINT AS us, (event_type IN ('click','purchase','signup'))::INT AS up FROM ev),
ends AS (SELECT session_id, min(us) AS u0, max(us) AS u1 FROM lg GROUP BY ALL)"""
