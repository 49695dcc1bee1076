"""Token alignment of many pairs at once with NumPy, called from Arrow batches.

Tables are padded by one row and column and filled along anti-diagonals; a step touches one anti-diagonal of every
pair of the batch.
"""

from __future__ import annotations

import numpy as np

from ..config import MatchConfig


#: Pairs whose tables are filled at once without logarithms.
LINEAR_PAIRS = 1024


def _diagonals(m: int, n: int):
    for d in range(m + n - 1):
        rows = np.arange(max(0, d - n + 1), min(m - 1, d) + 1)
        yield rows, d - rows


def _log_sum_exp(stack: np.ndarray) -> np.ndarray:
    top = stack.max(axis=0)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(stack - safe).sum(axis=0)) + safe


def partial_monotone(affinity: np.ndarray, valid: np.ndarray, gap: float, gamma: float):
    """Soft endpoint score (P,) and correspondence mass (P, m, n) of a local monotone alignment.

    Each cell either starts afresh, extends the diagonal by its affinity (valid cells only) or pays ``gap`` to come
    from above or the left; anything outside the grid counts as zero. The mass is the derivative of the score with
    respect to the affinity, found by running the transition shares backwards.
    """
    if gamma <= 0 or gap < 0:
        raise ValueError("gamma must be positive and gap not negative")
    pairs, m, n = affinity.shape
    table = np.zeros((pairs, m + 1, n + 1))
    share_diag, share_up, share_left = (np.zeros((pairs, m + 1, n + 1)) for _ in range(3))
    for i, j in _diagonals(m, n):
        diag = np.where(valid[:, i, j], table[:, i, j] + affinity[:, i, j], -np.inf)
        options = np.stack([np.zeros_like(diag), diag, table[:, i, j + 1] - gap, table[:, i + 1, j] - gap]) / gamma
        total = _log_sum_exp(options)
        table[:, i + 1, j + 1] = gamma * total
        share_diag[:, i, j] = np.exp(options[1] - total)
        share_up[:, i, j] = np.exp(options[2] - total)
        share_left[:, i, j] = np.exp(options[3] - total)
    cells = table[:, 1:, 1:]
    score = gamma * _log_sum_exp(cells.reshape(pairs, -1).T / gamma)
    flow = np.zeros((pairs, m + 1, n + 1))
    flow[:, :m, :n] = np.exp((cells - score[:, None, None]) / gamma)
    for i, j in reversed(list(_diagonals(m, n))):
        flow[:, i, j] += (flow[:, i + 1, j] * share_up[:, i + 1, j] + flow[:, i, j + 1] * share_left[:, i, j + 1] +
                          flow[:, i + 1, j + 1] * share_diag[:, i + 1, j + 1])
    return score, flow[:, :m, :n] * share_diag[:, :m, :n]


def partial_monotone_local(similarity: np.ndarray, valid: np.ndarray, config: MatchConfig) -> np.ndarray:
    """Local score (P,) of a partial monotone alignment from token similarities (P, m, n) and valid cells.

    The recurrence of ``partial_monotone`` without logarithms: tables hold exp(cell / gamma), so a cell is a sum of
    products. Pairs lie along the last axis and are taken some at a time. Where such numbers could overflow, the
    logarithmic form is used.
    """
    pairs, m, n = similarity.shape
    longest = min(m, n) * max(0.0, 1.0 - config.delta) / config.gamma + (m + n + 1) * np.log(3.0)
    out = np.empty(pairs)
    skip = np.exp(-config.gap / config.gamma)
    for lo in range(0, pairs, LINEAR_PAIRS):
        part = slice(lo, lo + LINEAR_PAIRS)
        if longest > 600 or similarity[part].max(initial=0.0) > 1.0 + 1e-6:
            _, mass = partial_monotone(similarity[part] - config.delta, valid[part], config.gap, config.gamma)
            out[part] = (mass * similarity[part]).sum((1, 2)) / (mass.sum((1, 2)) + config.epsilon)
            continue
        sims = np.ascontiguousarray(np.moveaxis(similarity[part], 0, 2))
        step = np.exp((sims - config.delta) / config.gamma) * np.moveaxis(valid[part], 0, 2)
        count = sims.shape[2]
        table, flow = np.ones((m + 1, n + 1, count)), np.zeros((m + 1, n + 1, count))
        room = np.empty(count)
        for i in range(m):
            for j in range(n):
                cell = np.add(table[i, j + 1], table[i + 1, j], out=table[i + 1, j + 1])
                cell *= skip
                cell += np.multiply(table[i, j], step[i, j], out=room)
                cell += 1.0
        total = table[1:, 1:].sum(axis=(0, 1))
        for i in reversed(range(m)):
            for j in reversed(range(n)):
                cell = np.add(flow[i + 1, j], flow[i, j + 1], out=flow[i, j])
                cell *= skip
                if i + 1 < m and j + 1 < n:
                    cell += np.multiply(flow[i + 1, j + 1], step[i + 1, j + 1], out=room)
                cell += 1.0
        mass = flow[:m, :n] * table[:m, :n] * step / total
        out[part] = (mass * sims).sum(axis=(0, 1)) / (mass.sum(axis=(0, 1)) + config.epsilon)
    return out


def soft_dtw_occupancy(similarity: np.ndarray, keep_a: np.ndarray, keep_b: np.ndarray, gamma: float):
    """Soft cost (P,) and expected path occupancy (P, m, n) of a global alignment over the kept tokens only.

    Kept tokens are moved to the front of their axis, so all pairs share one padded grid; a pair's path ends at its
    own last kept cell, cells behind it stay out of reach, and the occupancy is moved back to the original places.
    Pairs with an empty side get zero.
    """
    if gamma <= 0:
        raise ValueError("gamma must be positive")
    pairs, m, n = similarity.shape
    place_a, place_b = (np.argsort(~keep.astype(bool), axis=1, kind="stable") for keep in (keep_a, keep_b))
    cell = (np.arange(pairs)[:, None, None], place_a[:, :, None], place_b[:, None, :])
    cost = 1.0 - similarity[cell]
    last_a, last_b = keep_a.astype(bool).sum(1) - 1, keep_b.astype(bool).sum(1) - 1
    table = np.full((pairs, m + 1, n + 1), np.inf)
    table[:, 0, 0] = 0.0
    shares = np.zeros((3, pairs, m + 1, n + 1))
    for i, j in _diagonals(m, n):
        inside = (i[None] <= last_a[:, None]) & (j[None] <= last_b[:, None])
        options = np.where(inside, -np.stack([table[:, i, j], table[:, i, j + 1], table[:, i + 1, j]]) / gamma, 0.0)
        total = _log_sum_exp(options)
        table[:, i + 1, j + 1] = np.where(inside, cost[:, i, j] - gamma * total, np.inf)
        shares[:, :, i, j] = np.where(inside, np.exp(options - total), 0.0)
    some = np.flatnonzero((last_a >= 0) & (last_b >= 0))
    flow = np.zeros((pairs, m + 1, n + 1))
    flow[some, last_a[some], last_b[some]] = 1.0
    for i, j in reversed(list(_diagonals(m, n))):
        flow[:, i, j] += (flow[:, i + 1, j + 1] * shares[0][:, i + 1, j + 1] +
                          flow[:, i + 1, j] * shares[1][:, i + 1, j] + flow[:, i, j + 1] * shares[2][:, i, j + 1])
    occupancy, score = np.zeros((pairs, m, n)), np.zeros(pairs)
    occupancy[cell] = flow[:, :m, :n]
    score[some] = table[some, last_a[some] + 1, last_b[some] + 1]
    return score, occupancy


def align_pairs(tokens, start: int, stop: int, config: MatchConfig, gamma: float | None = None,
                keep_mass: bool = False):
    """(local, overlap, mass) of query rows ``start:stop`` against all supports, flattened pair by pair."""
    if config.alignment == "none":
        return None, None, None
    q_v, q_r, s_v, s_r = tokens
    q_v, q_r = q_v[start:stop], q_r[start:stop]
    m, n = q_r.shape[1], s_r.shape[1]
    similarity = np.einsum("qik,sjk->qsij", q_v, s_v, optimize=True).reshape(-1, m, n)
    return align_stack(similarity, np.repeat(q_r, len(s_r), axis=0), np.tile(s_r, (len(q_r), 1)), config, gamma, keep_mass)


def align_stack(similarity: np.ndarray, left: np.ndarray, right: np.ndarray, config: MatchConfig, gamma: float | None = None,
                keep_mass: bool = False):
    """(local, overlap, mass) of pairs given by their token similarities (P, m, n) and reliabilities (P, m) and (P, n)."""
    m, n = similarity.shape[1:]
    valid = (left > 0)[:, :, None] & (right > 0)[:, None, :]
    overlap = None
    if config.alignment == "pma":
        _, mass = partial_monotone(similarity - config.delta, valid, config.gap, config.gamma)
        shared = (mass * np.minimum(left[:, :, None], right[:, None, :])).sum((1, 2))
        overlap = shared / (np.minimum(left.sum(1), right.sum(1)) + config.epsilon)
    elif config.alignment == "diagonal":
        mass = np.eye(m, n)[None] * valid
    else:
        _, mass = soft_dtw_occupancy(similarity, left > 0, right > 0, gamma or config.soft_dtw_gamma)
    local = (mass * similarity).sum((1, 2)) / (mass.sum((1, 2)) + config.epsilon)
    return local, overlap, mass if keep_mass else None
