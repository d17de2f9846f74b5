"""A small causal self-attention language model over subword ids, in numpy.

Each next token is drawn from a mixture of Z token distributions. The mixing weights come from the
current token and from one attention head over the window before it, so the whole vocabulary is
normalised by construction and scoring needs Z exponentials per token instead of one per vocabulary entry.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WINDOW = 24
STRIDE = 18
KEY_WIDTH = 8
PARTS = 24
# Share of each token's probability that is spread evenly over the vocabulary.
FLOOR = 1e-4
_MASKED = -1e4
_CLIP = 30.0


@dataclass
class Attention:
    """Tables per token (the last row is padding): query, key, value, now; parts[t, z] = P(t | part z).

    ``query`` and ``key`` have one more column, by which padding is masked; ``value`` one of ones, which
    sums the attention weights.
    """

    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    now: np.ndarray
    near: np.ndarray
    parts: np.ndarray

    @property
    def pad(self) -> int:
        return len(self.query) - 1


def _bias(near: np.ndarray, window: int = WINDOW, rows: int = STRIDE) -> np.ndarray:
    """Bias by distance for the last ``rows`` queries of a window; later keys are masked."""
    q, k = np.arange(window - rows, window)[:, None], np.arange(window)[None, :]
    return np.where(k <= q, near[np.clip(q - k, 0, window - 1)], _MASKED).astype(np.float32)


def windows_of(length: int, window: int = WINDOW, stride: int = STRIDE) -> np.ndarray:
    """Positions of the inputs of each overlapping window, -1 before the start and past the end.

    The last ``stride`` places of all windows hold each input exactly once.
    """
    first = np.arange(0, length, stride)[:, None] - (window - stride)
    at = first + np.arange(window)[None, :]
    return np.where((at >= 0) & (at < length), at, -1)


def _all_windows(lengths: np.ndarray) -> np.ndarray:
    """``windows_of`` the inputs (all but the last token) of sequences that lie one after another, as positions there."""
    inputs = np.maximum(lengths - 1, 0)
    n = -(-inputs // STRIDE)
    own = np.repeat(np.arange(len(lengths)), n)
    first = (np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE - (WINDOW - STRIDE)
    at = first[:, None] + np.arange(WINDOW)
    return np.where((at >= 0) & (at < inputs[own][:, None]), at + (np.cumsum(lengths) - lengths)[own][:, None], -1)


def _mixing(model: Attention, inputs: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Unnormalised mixing weights after the last STRIDE inputs of each window (rows of ``inputs``)."""
    rows = bias.shape[0]
    tail = inputs[:, -rows:]
    s = np.matmul(model.query[tail], model.key[inputs].swapaxes(1, 2))
    s += bias
    np.minimum(s, _CLIP, out=s)
    np.exp(s, out=s)
    seen = np.matmul(s, model.value[inputs])
    mixed = seen[:, :, :-1]
    mixed /= np.maximum(seen[:, :, -1:], 1e-30)
    mixed += model.now[tail]
    np.minimum(mixed, _CLIP, out=mixed)
    return np.exp(mixed, out=mixed)


def token_log_probs(
    model: Attention, sequences: list[np.ndarray], group: np.ndarray, batch: int = 256
) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Natural log-probabilities of all tokens after the first of each sequence, and at the same
    places that of any token for which ``group`` is true.

    Windows of all sequences are scored together in batches of fixed size, so memory does not depend
    on the length of a text.
    """
    flat = np.concatenate([*sequences, np.array([model.pad])]).astype(np.int64)
    starts = np.cumsum([0, *map(len, sequences)])
    index = _all_windows(np.diff(starts))
    in_group = model.parts[: len(group)][group].sum(axis=0)
    out, of_group = np.zeros(len(flat), np.float32), np.zeros(len(flat), np.float32)
    if len(index):
        bias = _bias(model.near)
        for i in range(0, len(index), batch):
            at = index[i : i + batch]
            w = _mixing(model, flat[at], bias)
            target = at[:, -STRIDE:]
            ok = target >= 0
            p = model.parts[flat[target + 1]]
            top, all_of_it = np.einsum("bsz,bsz->bs", w, p), w.sum(axis=2)
            whole = np.log(all_of_it[ok])
            out[target[ok] + 1] = np.log(top[ok]) - whole
            of_group[target[ok] + 1] = np.log(np.maximum((w @ in_group)[ok], 1e-30)) - whole
    return tuple([x[s + 1 : s + len(q)] for s, q in zip(starts, sequences)] for x in (out, of_group))


class _Adam:
    """Adam on rows of a table of which a step touches few.

    A row that no step touches has zero gradients and coasts on its moments: the way it went and what is left of
    the moments are made up for when it is next read. So a step costs its own rows, not the table.
    """

    def __init__(self, table: np.ndarray):
        self.table, self.first, self.second = table, np.zeros_like(table), np.zeros_like(table)
        self.last = np.zeros(len(table), np.int64)

    def read(self, own: np.ndarray, step: int, rate: float) -> np.ndarray:
        """The rows ``own`` as they are before step ``step``."""
        missed = np.maximum(step - 1 - self.last[own], 0)[:, None].astype(np.float32)
        ratio = np.float32(0.9 / 0.99**0.5)
        coasted = rate * ratio * (1 - ratio**missed) / (1 - ratio)
        table, first, second = self.table[own], self.first[own], self.second[own]
        # Corrected for their start as of the step before; rows of which nothing is known stay.
        began = np.maximum(self.last[own], 1)[:, None].astype(np.float32)
        coasted *= np.sqrt(1 - np.float32(0.99) ** began) / (1 - np.float32(0.9) ** began)
        table -= coasted * first / (np.sqrt(second) + np.float32(1e-6))
        first *= np.float32(0.9) ** missed
        second *= np.float32(0.99) ** missed
        self._now = own, table, first, second
        return table

    def write(self, g: np.ndarray, step: int, rate: float) -> None:
        """A step on the rows read last, with gradients ``g``."""
        own, table, first, second = self._now
        first *= np.float32(0.9)
        first += np.float32(0.1) * g
        g *= g
        second *= np.float32(0.99)
        second += np.float32(0.01) * g
        root = np.sqrt(second)
        root *= np.float32((1 - 0.99**step) ** -0.5)
        root += np.float32(1e-6)
        np.divide(first, root, out=root)
        root *= np.float32(rate / (1 - 0.9**step))
        table -= root
        self.table[own], self.first[own], self.second[own], self.last[own] = table, first, second, step


def _sums(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct indexes and the sum of the rows of each, added in pairs."""
    # Narrow integers are sorted by radix.
    order = np.argsort(index.astype(np.uint16) if index.max(initial=0) < 1 << 16 else index, kind="stable")
    ordered, out = index[order], rows.take(order, axis=0)
    first = np.flatnonzero(np.diff(ordered, prepend=-1))
    place = np.arange(len(ordered)) - np.repeat(first, np.diff(np.append(first, len(ordered))))
    while len(odd := np.flatnonzero(place & 1)):
        out[odd - 1] += out.take(odd, axis=0)
        even = np.flatnonzero(place & 1 == 0)
        out, place = out.take(even, axis=0), place[even] >> 1
    return ordered[first], out


@dataclass
class Learned:
    """What a fit has learned: rows of q, k, v, u and the shares of the parts, side by side, for its tokens.

    ``weight`` says how often each of ``tokens`` stood in the sequences; fits that started alike are
    joined as means by it. ``near`` and ``usual`` (the parts of tokens without a row) belong to the whole.
    """

    tokens: np.ndarray
    weight: np.ndarray
    rows: np.ndarray
    near: np.ndarray
    usual: np.ndarray

    def spread(self, n_tokens: int) -> np.ndarray:
        """Rows of all tokens; those without one are neutral and have the usual parts."""
        out = np.zeros((n_tokens, self.rows.shape[1]), np.float32)
        out[:, -PARTS:] = self.usual
        out[self.tokens] = self.rows
        return out


class Sums:
    """Means by weight of fits that started alike, added up one at a time."""

    def __init__(self, n_tokens: int):
        self.n_tokens, self.any = n_tokens, False

    def add(self, fit: Learned) -> None:
        total = fit.weight.sum()
        if not self.any:
            self.any, self.weight, self.rows = True, np.zeros(self.n_tokens), np.zeros((self.n_tokens, fit.rows.shape[1]), np.float32)
            self.near, self.usual = np.zeros(len(fit.near)), np.zeros(len(fit.usual))
        self.weight[fit.tokens] += fit.weight
        self.rows[fit.tokens] += fit.rows * fit.weight[:, None].astype(np.float32)
        self.near += fit.near * total
        self.usual += fit.usual * total

    def joined(self) -> Learned:
        tokens = np.flatnonzero(self.weight)
        weight, total = self.weight[tokens], max(self.weight.sum(), 1e-30)
        return Learned(tokens, weight, self.rows[tokens] / weight[:, None].astype(np.float32), self.near / total, self.usual / total)


def train(sequences: list[np.ndarray], n_tokens: int, counts: np.ndarray, seed: int = 1, epochs: int = 2, batch: int = 128, rate: float = 0.02) -> Attention:
    """The model of ``sequences`` alone; ``counts`` are the corpus-wide counts of the tokens."""
    return finished(learn(sequences, n_tokens, counts, seed, epochs, batch, rate), n_tokens, counts)


def learn(
    sequences: list[np.ndarray], n_tokens: int, counts: np.ndarray, seed: int = 1, epochs: int = 2, batch: int = 128, rate: float = 0.02, start: Learned | None = None
) -> Learned:
    """Fits on ``sequences``, from scratch or from what was learned before.

    Mixing is learned by gradient, the parts by online expectation-maximisation.
    """
    rng = np.random.default_rng(seed)
    # Only tokens of the sample have rows of their own while training.
    flat = np.concatenate([np.empty(0, np.int64), *sequences]).astype(np.int64)
    lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
    known = np.unique(flat)
    all_base = (counts + 0.1) / (counts + 0.1).sum()
    n_own = len(known)
    n, d, z = n_own + 1, KEY_WIDTH, PARTS
    pad = n_own
    flat = np.append(np.searchsorted(known, flat), pad)
    base = all_base[known] / max(all_base[known].sum(), 1e-30)
    q, k = rng.normal(0, 0.3, (n, d)).astype(np.float32), rng.normal(0, 0.3, (n, d)).astype(np.float32)
    v, u = np.zeros((n, z), np.float32), rng.normal(0, 0.1, (n, z)).astype(np.float32)
    share = rng.dirichlet(np.full(z, 0.5), n_own).astype(np.float32)
    near = np.zeros(WINDOW, np.float32)
    if start is not None:
        # What another fit has learned, with all of its weight: the online averages go on from it.
        before = start.spread(n_tokens)[known]
        for table, columns in ((q, before[:, :d]), (k, before[:, d : 2 * d]), (v, before[:, 2 * d : 2 * d + z]), (u, before[:, 2 * d + z : 2 * d + 2 * z])):
            table[:n_own] = columns
        near, share = start.near.astype(np.float32).copy(), before[:, -z:]
    held = (share * base[:, None] * 1000).astype(np.float32)
    # The averages are kept as multiples of one factor, and their sums beside them: a step changes the rows it meets.
    factor, column = 1.0, held.sum(axis=0, dtype=np.float64)
    rows_of, near_of = _Adam(np.concatenate((q, k, v, u), axis=1)), _Adam(near[:, None])
    index = _all_windows(lengths)
    steps = epochs * (-(-len(index) // batch))
    # A fit that goes on does so at the falling end of the schedule.
    step, total = (0, max(1, steps)) if start is None else (2 * steps + 1, max(1, 3 * steps + 1))
    rows_of.last[:] = near_of.last[:] = step
    dist = np.clip(np.arange(WINDOW - STRIDE, WINDOW)[:, None] - np.arange(WINDOW)[None, :], -1, WINDOW - 1)
    causal, every, now_rate = dist >= 0, np.arange(WINDOW), rate
    met, place, base = np.zeros(n, bool), np.zeros(n, np.int64), np.append(base, 0).astype(np.float32)
    held, ones_a, ones_z = np.concatenate((held, np.zeros((1, z), np.float32))), np.ones(WINDOW, np.float32), np.ones(z, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(index))
        for i in range(0, len(index), batch):
            step += 1
            rows = index[order[i : i + batch]]
            x = flat[rows]
            target = rows[:, -STRIDE:]
            ok = (target >= 0).ravel()
            t = flat[target.ravel() + 1]
            n_ok = max(int(ok.sum()), 1)
            # The tables of this batch alone, its tokens numbered anew.
            met[x] = True
            own = np.flatnonzero(met)
            met[own] = False
            place[own] = np.arange(len(own))
            here = place[x]
            table, bias = rows_of.read(own, step, now_rate), near_of.read(every, step, now_rate)[:, 0]
            both = table.take(here, axis=0)
            qs, ks, vs = both[:, -STRIDE:, :d], both[:, :, d : 2 * d], both[:, :, 2 * d : 2 * d + z]
            a = np.matmul(qs, ks.swapaxes(1, 2))
            a += np.where(causal, bias[dist], _MASKED)
            a += np.where(x == pad, np.float32(_MASKED), np.float32(0))[:, None, :]
            np.minimum(a, _CLIP, out=a)
            np.exp(a, out=a)
            a *= (1 / np.maximum(a @ ones_a, np.float32(1e-30)))[:, :, None]
            pi = np.matmul(a, vs)
            pi += both[:, -STRIDE:, 2 * d + z :]
            np.minimum(pi, _CLIP, out=pi)
            np.exp(pi, out=pi)
            pi = pi.reshape(-1, z)
            pi *= (1 / (pi @ ones_z))[:, None]
            r = held.take(t, axis=0)
            r *= np.float32(factor)
            r += base[t][:, None] * (0.02 * column).astype(np.float32)
            r *= (1 / (column * 1.02 + 1e-9)).astype(np.float32)
            r *= pi
            r *= (ok / np.maximum(r @ ones_z, np.float32(1e-30)))[:, None].astype(np.float32)
            pi *= ok[:, None]
            pi -= r
            g = pi.reshape(len(x), STRIDE, z)
            da = np.matmul(g, vs.swapaxes(1, 2))
            da -= np.einsum("bqk,bqk->bq", a, da)[:, :, None]
            da *= a
            grads = np.zeros((*x.shape, 2 * d + 2 * z), np.float32)
            grads[:, -STRIDE:, :d] = np.matmul(da, ks)
            grads[:, :, d : 2 * d] = np.matmul(da.swapaxes(1, 2), qs)
            grads[:, :, 2 * d : 2 * d + z] = np.matmul(a.swapaxes(1, 2), g)
            grads[:, -STRIDE:, 2 * d + z :] = g
            scale = np.float32(100 / n_ok)
            now_rate = rate * (1 - step / (total + 1))
            rows_of.write(_sums(here.ravel(), grads.reshape(-1, 2 * d + 2 * z))[1] * scale, step, now_rate)
            near_of.write((np.bincount(dist[causal], da.sum(axis=0)[causal], WINDOW).astype(np.float32) * scale)[:, None], step, now_rate)
            keep = 1 - max(0.02, 1 / (step + 2)) if step < total // 2 else 1 - 1 / (step - total // 2 + 50)
            gain = (1 - keep) * (len(index) * STRIDE / n_ok)
            tokens, fresh = _sums(t, r)
            factor *= keep
            if factor < 1e-6:
                held *= np.float32(factor)
                factor = 1.0
            held[tokens] += fresh * np.float32(gain / factor)
            column = keep * column + gain * fresh.sum(axis=0, dtype=np.float64)
    table, near = rows_of.read(np.arange(n), step + 1, now_rate)[:n_own], near_of.read(every, step + 1, now_rate)[:, 0]
    held = held[:n_own] * np.float32(factor)
    usual = column / max(column.sum(), 1e-30)
    # What part a token belongs to comes from the sample, how often it occurs from the whole corpus.
    usual = np.where(np.isfinite(usual), usual, 0) + 1e-6
    usual /= usual.sum()
    belongs = (held + usual * 0.5) / (held + usual * 0.5).sum(axis=1, keepdims=True)
    rows = np.concatenate((table, belongs), axis=1).astype(np.float32)
    return Learned(known, np.bincount(flat[:-1], minlength=n_own)[:n_own].astype(np.float64), rows, near, usual)


def finished(learned: Learned, n_tokens: int, counts: np.ndarray) -> Attention:
    """The model: each part's distribution is the corpus-wide count of a token times its share of the part."""
    d, z = KEY_WIDTH, PARTS
    table = learned.spread(n_tokens)
    base = (counts + 0.1) / (counts + 0.1).sum()
    parts = table[:, -z:].astype(np.float64) * base[:, None]
    parts = (1 - FLOOR) * parts / parts.sum(axis=0) + FLOOR / n_tokens
    padded = np.concatenate((table, np.zeros((1, table.shape[1]), np.float32)))
    ones = np.ones((n_tokens + 1, 1), np.float32)
    key_pad = np.zeros_like(ones)
    key_pad[n_tokens] = _MASKED
    return Attention(
        np.concatenate((padded[:, :d], ones), axis=1), np.concatenate((padded[:, d : 2 * d], key_pad), axis=1), np.concatenate((padded[:, 2 * d : 2 * d + z], ones), axis=1),
        padded[:, 2 * d + z : 2 * d + 2 * z].copy(), learned.near, np.concatenate((parts, np.ones((1, z))), axis=0).astype(np.float32),
    )
